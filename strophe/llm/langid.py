"""Language of whole texts by hierarchical discrimination.

Linear support vector machines vote in two levels: first for the language family,
then, one language against another, within the family. Features are hashed letter
pairs and triples of the whole text. The machines are fitted on a bounded sample
of labelled rows; everything else covers every row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strophe.llm.common import lean

SIZE = 2048  # hashed features
SAMPLE_ROWS = 4000  # rows the machines are fitted on (in expectation), spread evenly over the languages
WINDOW = 1 << 20
UNKNOWN = "und"

# Families of languages by code; any other language is a family of its own.
FAMILIES = {
    "germanic": "af da de en is lb nl nn no sv".split(),
    "romance": "ca es fr gl it oc pt ro".split(),
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk".split(),
    "indic": "bn gu hi mr ne pa".split(),
    "turkic": "az kk ky tr uz".split(),
    "uralic": "et fi hu".split(),
}

_LATIN = re.compile("[A-Za-z]")
_KEEP = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def has_letter(text: str | None) -> bool:
    """Whether a text holds any letter."""
    return bool(text) and (_LATIN.search(text) is not None or any(map(str.isalpha, text)))


def features(text: str | None, size: int = SIZE) -> np.ndarray:
    """Square roots of the shares of hashed byte pairs and triples of the lower-cased letters."""
    counts = np.zeros(size, np.int64)
    body = (text or "").lower().encode("utf-8", "replace").translate(_KEEP)
    for start in range(0, len(body), WINDOW):
        b = np.frombuffer(b" " + body[max(0, start - 2) : start + WINDOW] + b" ", np.uint8).astype(np.uint32)
        b = b[(b != 32) | np.append(True, b[:-1] != 32)]
        pair = b[:-1] * np.uint32(0x9E3779B1) ^ b[1:] * np.uint32(0x85EBCA77)
        triple = pair[:-1] * np.uint32(0xC2B2AE3D) ^ b[2:] * np.uint32(0x27D4EB2F)
        for h in (pair, triple):
            counts += np.bincount((h >> 15) % size, minlength=size)
    return np.sqrt(counts / max(1, counts.sum())).astype(np.float32)


def fit_machine(x: np.ndarray, y: np.ndarray, steps: int = 300) -> np.ndarray:
    """Weights (the last is the bias) of a linear machine with squared hinge loss; y is 1 or -1, classes weigh the same."""
    x = np.column_stack([x, np.ones(len(x), np.float32)])
    y = y.astype(np.float32)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    decay = np.float32(1e-5)
    rate = np.float32(1 / (2 * float((weight * (x * x).sum(axis=1)).sum()) + decay))
    w = seen = np.zeros(x.shape[1], np.float32)
    for step in range(steps):  # Nesterov's accelerated gradient
        ahead = w + np.float32(step / (step + 3)) * (w - seen)
        slack = np.maximum(0, 1 - y * (x @ ahead))
        seen, w = w, ahead - rate * (decay * ahead - 2 * ((weight * slack * y) @ x))
    return w


@dataclass
class Model:
    """Per contest (family level, then each family): the two sides and the weights."""

    families: dict[str, list[str]]
    contests: list[tuple[str, str]]
    weights: np.ndarray  # one column per contest


def family_of(lang: str, families: dict[str, list[str]]) -> str:
    return next((f for f, members in families.items() if lang in members), f"only {lang}")


def train(x: np.ndarray, langs: list[str], families: dict[str, list[str]]) -> Model:
    """Machines for every two families, and for every two languages of a family."""
    own: dict[str, list[str]] = {}
    for lang in sorted(set(langs)):
        own.setdefault(family_of(lang, families), []).append(lang)
    names = np.array(langs)
    homes = np.array([family_of(lang, families) for lang in langs])
    jobs = [(p, homes) for p in combinations(sorted(own), 2)]
    jobs += [(p, names) for members in own.values() for p in combinations(members, 2)]
    columns = []
    for (a, b), kind in jobs:
        at = (kind == a) | (kind == b)
        columns.append(fit_machine(x[at], np.where(kind[at] == a, 1.0, -1.0)))
    width = x.shape[1] + 1 if len(x) else SIZE + 1
    return Model(own, [p for p, _ in jobs], np.array(columns).T if columns else np.zeros((width, 0)))


def _winner(options: list[str], margins: dict[tuple[str, str], float]) -> tuple[str, float]:
    """The option with most votes (then the larger sum of margins), and the confidence of its narrowest win."""
    votes: Counter = Counter()
    for a, b in combinations(options, 2):
        m = margins[a, b]
        votes[a if m >= 0 else b] += 1
        votes[a] += 1e-6 * m
        votes[b] -= 1e-6 * m
    best = max(options, key=lambda o: votes[o])
    own = [margins[p] if p[0] == best else -margins[p] for p in combinations(options, 2) if best in p]
    return best, float(1 / (1 + np.exp(-2 * min(own)))) if own else 1.0


def decide(model: Model, x: np.ndarray) -> tuple[str, float]:
    """Language and confidence of one text's features."""
    if not model.families:
        return UNKNOWN, 0.0
    margins = dict(zip(model.contests, (x @ model.weights[:-1] + model.weights[-1]).tolist(), strict=True))
    family, sure = _winner(sorted(model.families), margins)
    lang, surer = _winner(model.families[family], margins)
    return lang, sure * surer


def fit(
    docs: DataFrame,
    training: Column,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    families: dict[str, list[str]] | None = None,
    sample_rows: int = SAMPLE_ROWS,
) -> Model:
    """Fit on about ``sample_rows`` of the rows for which ``training`` holds and text and language are known.

    Rows are drawn by a hash of the id, each language with its own rate, whole texts.
    """
    rows = docs.select(
        F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"),
        training.alias("training"),
    ).where("training and lang is not null and text is not null")
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    rate = F.lit(0.0)
    for name, n in sorted(counts.items()):
        rate = F.when(F.col("lang") == name, F.lit(sample_rows / len(counts) / n)).otherwise(rate)
    drawn = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / F.lit(float(1 << 30)) < rate).select("text", "lang")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            keep = [i for i, t in enumerate(texts) if has_letter(t)]
            body = [features(texts[i]).tobytes() for i in keep]
            yield pa.RecordBatch.from_arrays(
                [pa.array(body, pa.binary()), batch.column(1).take(pa.array(keep, pa.int64()))], names=["x", "lang"]
            )

    got = sorted((bytes(r.x), r.lang) for r in drawn.mapInArrow(lean(encode), "x binary, lang string").collect())
    x = np.array([np.frombuffer(b, np.float32) for b, _ in got]).reshape(-1, SIZE)
    return train(x, [name for _, name in got], FAMILIES if families is None else families)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1); input columns of these names are replaced.

    A text that is null or has no letter is ``und`` with score 0, as is every text
    if there was nothing to learn from. Repeated rows get equal answers.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"))
    place = kept.index(text)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [
                decide(model, features(t)) if has_letter(t) else (UNKNOWN, 0.0)
                for t in (x.as_py() for x in batch.column(0).field(place))
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                names=["row", "lang_pred", "score"],
            )

    schema = source.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema
    return source.mapInArrow(lean(answer), schema).select("row.*", "lang_pred", "score")


def split_of(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts


def detect(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` with held_out, lang_pred and score: learned from the rows not held out (a null id is)."""
    held = F.coalesce(split_of(doc_id, 4) == 2, F.lit(True))
    model = fit(docs, ~held, doc_id, text, lang)
    return predict(docs.withColumn("held_out", held), model, text)
