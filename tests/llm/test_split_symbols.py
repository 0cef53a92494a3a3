"""Scores of the suffix tree do not depend on how many tokens a bucket may have."""

import numpy as np
from pyspark.sql import functions as F

from terrane.llm import op8_suffix_tree as m


def test_split_symbols_change_no_score(spark, monkeypatch):
    monkeypatch.setattr(m, "CHUNK", 3000)
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{int(w)}" for w in (np.cumsum(rng.integers(0, 3, 5 + i % 60)) * 7 + (i if i % 2 else 0)) % (9 + i % 30)) for i in range(80)]
    texts += ["new things here", "", None, " ".join(["w5 w35 w5"] * 300)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    one, many = (m.score(d, F.col("doc_id") % 5 != 0, bucket=b).toPandas().set_index("doc_id").sort_index() for b in (1 << 30, 60))
    assert (one.n_known == many.n_known).all() and np.allclose(one.score, many.score, atol=1e-4)
