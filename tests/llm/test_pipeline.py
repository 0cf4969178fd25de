"""The corpus pipeline on the smallest tables: every stage's decisions against brute force."""

from collections import Counter

import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from strophe.llm import langid, simhash
from strophe.session import stage
from tools.check import duck, rows_of


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, held = docs.columns, []
    held.append([tuple(r) for r in docs.collect()])
    for _, stage_of in corpus_pipeline.STAGES[:-1]:
        docs = stage(stage_of(spark, docs, small))
        assert docs.columns == columns
        held.append([tuple(r) for r in docs.collect()])
    given, known, once, apart, mixed = held
    assert Counter(known) == Counter(r for r in given if langid.has_letter(r[1]))
    lower = [r[1].translate({c: c + 32 for c in range(65, 91)}) for r in known]
    last = {t: max(r[0] for r, u in zip(known, lower) if u == t) for t in lower}
    assert Counter(once) == Counter(r for r, t in zip(known, lower) if r[0] == last[t])
    kept, gone = set(apart), [r for r in once if r not in set(apart)]
    assert kept <= set(once) and len(apart) == len(kept)
    prints = {r[0]: simhash.fingerprint(r[1].encode(), 5) for r in once}
    for r in gone:
        assert any(simhash.resemblance(r[1].encode(), k[1].encode(), 5) >= 0.8 for k in apart)
    for i, a in enumerate(apart):  # no two that stay are alike in both senses, unless a chain led elsewhere
        for b in apart[:i]:
            if (prints[a[0]] ^ prints[b[0]]).bit_count() <= 6:
                assert simhash.resemblance(a[1].encode(), b[1].encode(), 5) < 0.8
    assert set(mixed) <= set(apart) and 0.5 < len(mixed) / len(apart) < 1.5
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()
    assert {r.doc_id for r in packed} == {r[0] for r in mixed}
    assert sum(r.length for r in packed if r.start == 0) <= sum(r.length for r in packed)


@pytest.mark.parametrize("name", ["op8_mixing", "op10_exact_dedup"])
def test_query_equals_sql(spark, small, name):
    df = queries()[name](spark, small)
    rel = duck(small).execute(oracle_sql()[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in rel.description], rel.fetchall())


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in queries() if n.startswith("op")} >= {f"op{n}" for n in range(1, 14)}
    assert "pipeline" in queries() and len(corpus_pipeline.STAGES) == 5


def test_stages_keep_columns_and_take_odd_rows(spark, small):
    """Columns named like those the operators add, nulls in every column, repeats, and no rows at all."""
    extra = "copy int, copies int, order_key string, held_out string, lang_pred int, score string, row int, place string, body int"
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {extra}"
    tail = (7, 8, "k", "h", 9, "s", 10, "p", 11)
    rows = [(None,) * 14, (1, None, "en", "a", 0, *tail), (2, "", None, None, 0, *tail), (None, "some words", None, None, None, *tail)]
    rows += [(i, f"words of text number {i} and more " * 3, "en" if i % 2 else "de", "ab"[i % 2], 5, *tail) for i in range(3, 40)]
    rows += [rows[5], rows[6]]
    docs = spark.createDataFrame(rows, schema)
    for name, stage_of in corpus_pipeline.STAGES[:-1]:
        got = stage_of(spark, docs, small)
        assert got.schema.simpleString() == docs.schema.simpleString(), name
        found = Counter(map(str, got.collect()))
        assert set(found) <= set(map(str, docs.collect())), name
        if name != "mixing":
            assert sum(found.values()) <= len(rows) and len(found) >= 30, name
        assert stage_of(spark, docs.limit(0), small).count() == 0, name
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    assert sum(r.start == 0 for r in pieces.collect()) == len(rows)
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), small).count() == 0
