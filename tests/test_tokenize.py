"""Words are spelled from their characters without a shuffle."""

from pyspark.sql import functions as F

from __spark_entry__ import queries
from strophe.functions.text import tokenize


def test_words_need_no_exchange(spark, small):
    found = queries()["tokenize_lyrics"](spark, small)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_words_equal_their_characters(spark, tmp_path):
    texts = [(1, "la  la\n\n d\u00e9j\u00e0 \U0001f3b5\U0001f3b5 vu"), (2, ""), (3, None), (4, " \n ")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    chars = tokenize(docs.withColumnRenamed("doc_id", "song"), "text")
    want = chars.groupBy("song", "line_no", "word_no").agg(
        F.count(F.lit(1)).alias("n_chars"), F.expr("listagg(char, '') WITHIN GROUP (ORDER BY char_no)").alias("spelled")
    )
    found = queries()["tokenize_lyrics"](spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    assert found.count() == 5
