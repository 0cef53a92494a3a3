"""The pipeline's form of exact dedup loses no text to a hash collision."""

from pyspark.sql import functions as F

from terrane.llm.common import Stash


def test_first_copies_tells_collisions_apart(spark, monkeypatch):
    from terrane.llm import op5_exact_dedup as m

    monkeypatch.setattr(m, "_hash", lambda text: (F.length(text).cast("long"), F.lit(0).cast("long")))  # texts of one length collide
    rows = [(1, "aa"), (2, "bb"), (3, "aa"), (4, "c"), (5, "ddd"), (5, "eee"), (5, "ddd"), (6, "ffff"), (7, "gggg")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for keep, a in (("max", 3), ("min", 1)):
        got = sorted(map(tuple, m.first_copies(d, Stash(spark), keep=keep).collect()))
        assert got == [*sorted([(a, "aa"), (2, "bb")]), (4, "c"), (5, "ddd"), (5, "eee"), (6, "ffff"), (7, "gggg")]
