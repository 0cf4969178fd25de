"""Fill-in-middle, exact top-k and clustering against plain brute force, with odd rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strophe.llm import clusters, fim, topk
from strophe.llm.common import prepare


@pytest.fixture(scope="module")
def session(spark):
    return prepare(spark)


def fim_rows(seed=2):
    rng = random.Random(seed)
    signs = ["a", "é", "漢", "\U0001f600", "\n", "\n", " ", "<", "<P", ">", "\r", "\t"]
    rows = [(None, None, None), (None, "x\ny", "r"), (1, "", "r"), (2, None, None), (3, "\n", "r"), (4, "\n\n\n", "r"), (5, "no break", "r")]
    rows += [(6, "has <M> in\nit\n", "r"), (7, "<P>", "r"), (8, "<<S\n>P>", "r"), (9, "tail\n", "r"), (9, "tail\n", "r"), (9, "other\nx", "r")]
    rows += [(10, "".join(rng.choices(signs[:7], k=60_000)), "r"), (11, "漢" * 5000, "r")]
    rows += [(i, "".join(rng.choices(signs, k=rng.randint(1, 60))), "r") for i in range(20, 140)]
    return rows


def slow_fim(own, text, unit, rate, spm_rate, seed):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
    h = hashlib.sha256(f"{seed}:{'' if own is None else own}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return own, len(units), "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm_rate:
        return own, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return own, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize(
    "unit, rate, spm_rate, seed, block", [("line", 100, 50, 7, 1024), ("line", 60, 0, 1, 3), ("char", 100, 50, 3, 1), ("char", 90, 100, 4, 7)]
)
def test_fill_in_middle(session, unit, rate, spm_rate, seed, block):
    rows = fim_rows()
    docs = session.createDataFrame(rows, "doc_id long, text string, output string").repartition(3)
    made = fim.fill_in_middle(docs, unit=unit, rate=rate, spm_rate=spm_rate, seed=seed, block_bytes=block)
    got = made.withColumn("back", fim.restored()).collect()
    want = [slow_fim(i, t, unit, rate, spm_rate, seed) for i, t, _ in rows]
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got) == Counter(want)
    assert Counter((r.doc_id, r.back) for r in got) == Counter((i, t or "") for i, t, _ in rows)
    assert {r.form for r in got} >= ({"plain", "psm", "spm"} if 0 < spm_rate < 100 else {"plain"})
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


def test_cuts_by_descent():
    text = "".join(random.Random(1).choices(["ab", "é\n", "漢", "\n", "\U0001f600"], k=999))
    data = np.frombuffer(text.encode(), np.uint8)
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    for unit, parts in (("line", lines), ("char", list(text))):
        for block in (1, 2, 5, 64, 10**6):
            tree = fim.BlockTree(data, unit, block)
            assert tree.n == len(parts)
            for k in (0, 1, 2, len(parts) // 2, len(parts) - 1, len(parts)):
                head = "".join(parts[:k])
                assert tree.cut(k) == (len(head.encode()), len(head))


def test_markers_must_be_told_apart(session):
    docs = session.createDataFrame([(1, "a")], "doc_id long, text string")
    for bad in (("<P>", "<P>", "<M>"), ("aba", "<S>", "<M>"), ("<P>", "P", "<M>"), ("", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fim.fill_in_middle(docs, markers=bad)


def vector_rows(seed=5, n=400, dim=6):
    rng = random.Random(seed)
    hot = [0.25] * dim
    rows = [(None, hot, "r"), (0, None, "r"), (50, [], "r"), (100, [0.5] * (dim - 1) + [None], "r"), (150, [math.nan] * dim, None)]
    rows += [(200, [math.inf] + [0.0] * (dim - 1), "r"), (250, hot, "r"), (250, hot, "r"), (300, [0.0] * dim, "r"), (-50, [-0.004] * dim, "r")]
    rows += [(350, [0.5, -0.5], "r"), (7, [0.25, 0.125], "r"), (8, [1e30] + [0.0] * (dim - 1), "r"), (400, [-1e300] + [1.0] * (dim - 1), "r")]
    rows += [(1000 + i, hot, "r") for i in range(n // 3)]
    rows += [(2000 + i, [round(rng.gauss(0, 0.3), rng.choice([1, 7])) for _ in range(dim)], "r") for i in range(n)]
    return rows


def whole(vector, scale):
    if not vector or any(x is None or not math.isfinite(x) for x in vector):
        return None
    return tuple(math.floor(min(max(x * scale, -(2.0**60)), 2.0**60)) for x in vector)


def slow_top_k(rows, k, scale=256, every=50):
    good = [(r[0], v) for r in rows if r[0] is not None and (v := whole(r[1], scale))]
    out = Counter()
    for at, (own, q) in enumerate(good):
        if own % every:
            continue
        scores = []
        for other, (i, v) in enumerate(good):
            if other != at and len(v) == len(q):
                s = sum(a * b for a, b in zip(q, v))
                scores.append((-min(max(s, -(2**63)), 2**63 - 1), i))
        out.update((own, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k], 1))
    return out


@pytest.mark.parametrize("k, bits, queries, held", [(5, 6, 1024, 200_000), (3, 2, 3, 50), (1, 1, 4, 200_000), (1000, 3, 2, 200_000)])
def test_top_k(session, monkeypatch, k, bits, queries, held):
    monkeypatch.setattr(topk, "HELD", held)
    rows = vector_rows()
    df = session.createDataFrame(rows, "vec_id long, embedding array<double>, score string").repartition(5)
    got = topk.top_k(df, k=k, bits=bits, query_rows=queries, block_rows=60).collect()
    assert Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == slow_top_k(rows, k)
    assert topk.top_k(df.limit(0)).count() == 0


def test_bounds_hold_every_product():
    rng = np.random.default_rng(3)
    x, q = rng.integers(-90, 90, (200, 16)), rng.integers(-90, 90, (20, 16))
    for bits in (1, 3, 8):
        low, width, cell = topk.cells_of(x, bits)
        assert cell.max() < 1 << bits
        scan = topk.Scan(16, 201)  # all survive
        scan.ask(np.arange(20), q)
        list(scan.offer(np.arange(200), low, width, cell))
        (out,) = scan.end()
        i, j, upper, lower = (c.to_numpy() for c in out.columns)
        exact = (q @ x.T)[i, j]
        assert len(i) == 4000 and (lower <= exact).all() and (exact <= upper).all()


def test_reader_stops_once_certain():
    x = np.array([[9], [7], [5], [1]])
    reader = topk.Reader(0, 2)
    reader.vector = np.array([1])
    reader.read(np.array([9.0, 7.0]), [[4], [3]], x[:2])
    reader.read(np.array([6.0, 2.0]), [[1], [2]], np.array([[100], [100]]))  # never looked at
    assert [(r["score"], r["vec_id"]) for r in reader.row()["found"]] == [(9, 4), (7, 3)]


def slow_clusters(rows, dims, scale, k, rounds, seed):
    good = [(r[0], v) for r in rows if (v := whole(r[1], scale)) and len(v) == dims]
    drawn = sorted((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in good)
    c = [v for _, v in drawn[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c))

    for _ in range(rounds):
        parts = defaultdict(list)
        for _, v in good:
            parts[nearest(v)[1]].append(v)
        for j, vs in parts.items():
            c[j] = tuple(sum(x) // len(vs) for x in zip(*vs))
    found = [(i, *nearest(v)) for i, v in good]
    most = 2**63 - 1
    sums = Counter()
    for _, d, j in found:
        sums[j] += min(d, most)
    digest = {j: hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest() for j in sums}
    every = min(sum(min(sums[j], 10**38) for j in sums), most)
    return Counter((i, j, min(d, most), min(sums[j], most), every, digest[j]) for i, d, j in found)


@pytest.mark.parametrize("k, rounds, huge", [(16, 3, False), (1, 2, False), (2, 4, False), (40, 6, False), (7, 3, True), (5, 0, False), (9999, 1, False)])
def test_clusters(session, k, rounds, huge):
    rows = [r for r in vector_rows(seed=k) if huge or not r[1] or all(x is None or not abs(x) > 1e9 for x in r[1])]
    df = session.createDataFrame(rows, "vec_id long, embedding array<double>, cluster string").repartition(4)
    got = clusters.cluster_vectors(df, dims=6, scale=8, k=k, rounds=rounds).collect()
    want = slow_clusters(rows, 6, 8, k, rounds, 1)
    columns = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert Counter(tuple(r[c] for c in columns) for r in got) == want
    assert clusters.cluster_vectors(df.limit(0), dims=6).count() == 0


def test_bounds_leave_vectors_unread(monkeypatch):
    """Once centroids rest, no distance but that of a changed vector is computed."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(-9, 9, (300, 8)) + 1000 * j for j in range(5)])
    c = np.stack([x[300 * j : 300 * j + 300].sum(axis=0) // 300 for j in range(5)])
    n = len(x)
    model = clusters.Shallot(c)
    state = model.assign(x, np.zeros(n, np.int32), np.ones(n, np.int32), np.full(n, np.inf), np.full(n, -np.inf))
    assert (state[0] == np.repeat(np.arange(5), 300)).all()
    again = clusters.Shallot(c + 1, c)
    read = []
    plain = clusters.squared
    monkeypatch.setattr(clusters, "squared", lambda a, b: read.append(len(a)) or plain(a, b))
    assert (again.assign(x, *state)[0] == state[0]).all()
    assert sum(read) == 0


def test_ball_shrinks(monkeypatch):
    """The search reads fewer centroids than there are."""
    rng = np.random.default_rng(2)
    x, c = rng.integers(-500, 500, (400, 2)), rng.integers(-500, 500, (60, 2))
    model = clusters.Shallot(c)
    every = np.array([[((a - b) ** 2).sum() for b in c] for a in x])
    first = np.lexsort((np.broadcast_to(np.arange(60), every.shape), every), axis=1)
    read = []
    plain = clusters.squared
    monkeypatch.setattr(clusters, "squared", lambda a, b: read.append(len(a)) or plain(a, b))
    n = len(x)
    # Two near centroids are remembered.
    got = model.assign(x, first[:, 2].astype(np.int32), first[:, 3].astype(np.int32), np.full(n, np.inf), np.full(n, -np.inf))
    assert (got[0] == first[:, 0]).all() and (got[1] == first[:, 1]).all()
    assert sum(read) < 400 * 30


def test_queries_over_whole_tables(session, small):
    """The registered queries give a row for every document and vector."""
    from strophe.llm.queries import QUERIES

    docs, vectors = session.read.parquet(f"{small}/documents.parquet"), session.read.parquet(f"{small}/embeddings.parquet")
    made = QUERIES["op11_fill_in_middle"](session, small)
    assert made.count() == docs.count()
    joined = made.join(docs, "doc_id").where(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256) != F.col("restored_sha256"))
    assert joined.count() == 0
    assert QUERIES["op13_clusters"](session, small).count() == vectors.count()
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    got = QUERIES["op12_top_k"](session, small).collect()
    assert Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == slow_top_k(rows, 5)
