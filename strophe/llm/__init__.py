"""Operators for preparing large text corpora for language-model training.

Each module holds one operator with a general interface; ``queries`` registers
one query per operator over the given tables. Nothing outside this subpackage
imports it.
"""
