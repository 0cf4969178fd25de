"""The language stage of the pipeline on a table without any language to learn from."""

import corpus_pipeline
from strophe.llm.common import prepare


def test_no_labels_lose_no_document(spark):
    rows = [(1, "Some words", None), (2, "слова", None), (3, "12 + 3", None), (4, None, None), (5, "", None), (6, "漢", None)]
    docs = prepare(spark).createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in corpus_pipeline.language(spark, docs, "").collect()) == [1, 2, 6]
