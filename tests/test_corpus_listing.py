"""Folders of a corpus are listed by some tasks, not by one for each song."""

from strophe.sources import charts


def test_listing_takes_few_tasks(spark, tmp_path):
    for k in range(150):
        (tmp_path / f"song={k}").mkdir()
        (tmp_path / f"song={k}" / "a.txt").write_text(f": {k} 1 2 la\nE\n")
    store = spark.sparkContext._jsc.sc().statusStore()
    before = store.executorSummary("driver").totalTasks()
    corpus = charts.read_corpus(spark, str(tmp_path))
    assert store.executorSummary("driver").totalTasks() - before <= 64
    assert corpus.count() == 150
