"""Quality of whole texts by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded; gated attention gives
it a weight; the weighted mean of the encodings is scored. Encoder, attention and
score are learned together from document labels, on a bounded sample of labelled
rows. Scoring goes over every passage, keeping only running sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strophe.llm.common import lean
from strophe.llm.langid import split_of

PASSAGE = 512  # bytes in a passage
BINS = 256  # hashed byte pairs
WIDTH = BINS + 10
HIDDEN, GATE = 24, 12
SAMPLE_ROWS = 3000  # rows the model is fitted on (in expectation), spread evenly over the labels
SAMPLE_PASSAGES = 64  # evenly spaced passages of a row that fitting looks at; scoring looks at all
WINDOW = PASSAGE * 1024

_KINDS = np.zeros(256, np.int64)  # 0 other; 1 lower case, 2 upper case, 3 digit, 4 space, 5 line feed, 6 not ASCII
_KINDS[97:123], _KINDS[65:91], _KINDS[48:58], _KINDS[[32, 9]], _KINDS[[10, 13]], _KINDS[128:] = 1, 2, 3, 4, 5, 6


def passages(body: bytes) -> Iterator[np.ndarray]:
    """Features of every passage of an UTF-8 text, up to 1,024 passages at once; at least one passage."""
    for start in range(0, max(1, len(body)), WINDOW):
        b = np.frombuffer(body[start : start + WINDOW], np.uint8).astype(np.int64)
        n = max(1, -(-len(b) // PASSAGE))
        at = np.arange(len(b)) // PASSAGE
        size = np.maximum(1, np.bincount(at, minlength=n))[:, None]
        kinds = np.bincount(at * 7 + _KINDS[b], minlength=n * 7).reshape(n, 7) / size
        pair = (b[:-1] * 40503 + b[1:] * 30011 >> 4) % BINS
        bins = np.bincount(at[:-1] * BINS + pair, minlength=n * BINS).reshape(n, BINS)
        extra = np.column_stack([(bins > 0).sum(axis=1, keepdims=True) / size, (bins / size).max(axis=1), np.log(size)])
        yield np.column_stack([np.sqrt(bins / size), kinds, extra]).astype(np.float32)


class Model:
    """Parameters of the network, its forward pass, and gradients for fitting."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.p = {
            "W": rng.standard_normal((WIDTH, HIDDEN)) / np.sqrt(WIDTH),
            "b": np.zeros(HIDDEN),
            "V": rng.standard_normal((HIDDEN, GATE)) / np.sqrt(HIDDEN),
            "U": rng.standard_normal((HIDDEN, GATE)) / np.sqrt(HIDDEN),
            "a": rng.standard_normal(GATE) / np.sqrt(GATE),
            "c": rng.standard_normal(HIDDEN) / np.sqrt(HIDDEN),
            "d": np.zeros(1),
        }

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """Encodings, the two gates, and attention logits of passages."""
        p = self.p
        h = np.tanh(((x - self.mean) / self.scale) @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        return h, t, g, (t * g) @ p["a"]

    def score(self, body: bytes) -> float:
        """Probability of label 1; softmax over all passages with running sums."""
        top, total, mean = -np.inf, 0.0, np.zeros(HIDDEN)
        for x in passages(body):
            h, _, _, logit = self.encode(x)
            high = max(top, float(logit.max()))
            e = np.exp(logit - high)
            shrink = np.exp(top - high)
            total, mean, top = total * shrink + e.sum(), mean * shrink + e @ h, high
        return float(1 / (1 + np.exp(-(mean / total @ self.p["c"] + self.p["d"][0]))))

    def gradients(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray):
        """Gradients of the weighted log loss over bags; passages of bag i begin at first[i]."""
        p = self.p
        h, t, g, logit = self.encode(x)
        sizes = np.diff(np.append(first, len(x)))
        bag = np.repeat(np.arange(len(first)), sizes)
        e = np.exp(logit - np.maximum.reduceat(logit, first)[bag])
        att = e / np.add.reduceat(e, first)[bag]
        z = np.add.reduceat(att[:, None] * h, first)
        prob = 1 / (1 + np.exp(-(z @ p["c"] + p["d"])))
        dout = weight * (prob - y)
        dz = dout[:, None] * p["c"]
        dh = att[:, None] * dz[bag]
        datt = (dz[bag] * h).sum(axis=1)
        dlogit = att * (datt - np.add.reduceat(att * datt, first)[bag])
        dt, dg = dlogit[:, None] * p["a"] * g * (1 - t * t), dlogit[:, None] * p["a"] * t * g * (1 - g)
        dh = (dh + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
        grads = {
            "W": ((x - self.mean) / self.scale).T @ dh, "b": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg,
            "a": (t * g).T @ dlogit, "c": z.T @ dout, "d": np.array([dout.sum()]),
        }
        return grads, prob

    def fit(self, bags: list[np.ndarray], y: np.ndarray, weight: np.ndarray, epochs: int = 12, batch: int = 64) -> None:
        """Adam over shuffled batches of bags."""
        rng = np.random.default_rng(3)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(bags))
            for i in range(0, len(order), batch):
                at = order[i : i + batch]
                sizes = np.array([len(bags[j]) for j in at])
                grads, _ = self.gradients(
                    np.concatenate([bags[j] for j in at]), np.cumsum(sizes) - sizes, y[at], weight[at] / len(at)
                )
                step += 1
                for k, g in grads.items():
                    g = g + 1e-4 * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    training: Column,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    sample_rows: int = SAMPLE_ROWS,
) -> Model | None:
    """Fit on about ``sample_rows`` labelled rows for which ``training`` holds; None if both labels are not there.

    Rows are drawn by a hash of the id, each label with its own rate, and weigh in
    the loss as much as the rows they stand for. Labels other than 0 and 1, and
    documents with contradicting labels, are left out of the fitting.
    """
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label"), training.alias("training"))
    known = known.where("training and id is not null and label in (0, 1)").groupBy("id")
    known = known.agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")
    counts = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    if len(counts) < 2:
        return None
    rate = F.when(F.col("label") == 1, F.lit(sample_rows / 2 / counts[1])).otherwise(F.lit(sample_rows / 2 / counts[0]))
    draw = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = known.where(draw < rate)
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("binary").alias("text"))
    # Bounded by ``sample_rows``, so the texts need not be shuffled to meet it.
    rows = texts.join(F.broadcast(drawn), "id").select("text", "label")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = []
            for t in batch.column(0):
                x = np.concatenate(list(passages(t.as_py() or b"")))
                if len(x) > SAMPLE_PASSAGES:
                    x = x[np.linspace(0, len(x) - 1, SAMPLE_PASSAGES).astype(int)]
                bodies.append(x.astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(bodies, pa.binary()), batch.column(1)], names=["x", "label"])

    got = sorted((bytes(r.x), r.label) for r in rows.mapInArrow(lean(encode), "x binary, label int").collect())
    if len({y for _, y in got}) < 2:
        return None
    bags = [np.frombuffer(b, np.float16).reshape(-1, WIDTH).astype(np.float32) for b, _ in got]
    y = np.array([label for _, label in got])
    stands = np.where(y == 1, counts[1] / (y == 1).sum(), counts[0] / (y == 0).sum())
    every = np.concatenate(bags)
    model = Model(every.mean(axis=0), every.std(axis=0) + 1e-3)
    model.fit(bags, y, stands / stands.mean())
    return model


def score(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 if score >= 0.5); input columns of these names are replaced.

    Null and empty texts are one empty passage. Without a model every score is 0.5.
    Repeated rows get equal scores.
    """
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"))
    place = kept.index(text)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ((t.as_py() or "").encode() for t in batch.column(0).field(place))
            got = [0.5 if model is None else model.score(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64())], names=["row", "score"])

    schema = source.withColumn("score", F.lit(0.0)).schema
    scored = source.mapInArrow(lean(answer), schema).select("row.*", "score")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def rate(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """``docs`` with held_out, score and predicted: learned from the labels of rows not held out (a null id is)."""
    held = F.coalesce(split_of(doc_id, 3) == 1, F.lit(True))
    model = fit(docs, labels, ~held, doc_id, text, label)
    return score(docs.withColumn("held_out", held), model, text)
