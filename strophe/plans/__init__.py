"""Queries over the given tables."""

MODULES = ["scalars", "files", "statistics", "pairing", "sequences", "editing", "alignments", "spectra", "feeds"]
