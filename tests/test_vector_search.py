"""Exact top-k when a batch's scores come in several blocks of queries."""

import numpy as np
import pytest

from corvane.operators import vector_search as vs


@pytest.mark.parametrize("metric", ["cosine", "l2", "ip"])
def test_blocks_of_queries_give_the_same(spark, monkeypatch, metric):
    x = np.random.default_rng(1).normal(size=(200, 8))
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").coalesce(1)
    asked = d.filter("vec_id % 4 = 0").toDF("query_id", "query_vector")
    got = lambda: sorted(tuple(r) for r in vs.top_k(asked, d, metric=metric).collect())
    whole = got()
    monkeypatch.setattr(vs, "SCORES", 600)  # three queries at a time
    assert got() == whole and len(whole) == 250
