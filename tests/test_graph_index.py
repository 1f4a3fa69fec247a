"""Layered graphs: every row is indexed and reached, and the nearest are found, against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import graph_index as gi
from corvane.operators import vector_search as vs
from corvane.shared import written


def table(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")


def asked(store, each):
    return store.filter(F.col("vec_id") % each == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


def recall(found, exact):
    got, want = ({(r.query_id, r.vec_id) for r in d.collect()} for d in (found, exact))
    return len(got & want) / len(want)


@pytest.mark.parametrize("metric", ["cosine", "ip", "l2"])
def test_recall_and_scores(spark, metric):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 16)) * rng.uniform(0.5, 2, (3000, 1))
    store = written(table(spark, x), "store")
    index = written(gi.build(store, metric=metric, shard_rows=700), "index")
    assert index.count() >= 5 and sorted(r.vec_id for r in gi.keys_of(index).collect()) == list(range(3000))
    q = asked(store, 20)
    found, exact = gi.search(q, index, k=5), vs.top_k(q, store, k=5, metric=metric)
    assert recall(found, exact) >= 0.9
    scores = {(r.query_id, r.vec_id): r.score for r in exact.collect()}
    for r in found.collect():  # a row that both find has one score, and ranks follow scores
        assert scores.get((r.query_id, r.vec_id), r.score) == r.score
    assert found.groupBy("query_id").agg(F.max("rank").alias("n")).filter("n <> 5").isEmpty()


def test_recall_on_the_supplied_vectors(spark):
    store = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    q = asked(store, 20)
    index = written(gi.build(store), "index")
    assert gi.keys_of(index).count() == store.count()
    assert recall(gi.search(q, index), vs.top_k(q, store)) >= 0.9
    # random vectors of 64 dimensions; a narrow beam does for 2,000 of them, and computes a share of all distances
    assert recall(gi.search(q, index, beam=32), vs.top_k(q, store)) >= 0.9
    assert gi.search(q, index, beam=32, work=True).agg(F.sum("distances") / F.sum(F.col("rows") * F.col("queries"))).first()[0] < 0.3


def test_clusters_and_copies_are_reached(spark):
    """Tight clusters far from each other, and a vector that hundreds of rows share: all can be walked to."""
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(150, 8)) * 0.01 + 50 * rng.normal(size=8) for _ in range(6)] + [np.tile(rng.normal(size=8) * 30, (300, 1))])
    layers = gi.graph_of(gi.space_of(x, "l2"), 16, 96, 1)
    nodes, links = layers[0]
    assert len(nodes) == len(x) and all(gi.reached(own, s).all() for _, own in layers for s in [int(np.flatnonzero(np.isin(_, layers[-1][0]))[0])])
    assert (links[:, :32] < len(x)).all() and not (links == np.arange(len(x))[:, None]).any()
    store = written(table(spark, x), "store")
    q = asked(store, 25)
    got = {(r.query_id, r["rank"]): r.score for r in gi.search(q, gi.build(store, metric="l2")).collect()}
    want = {(r.query_id, r["rank"]): r.score for r in vs.top_k(q, store, metric="l2").collect()}
    assert sum(abs(got[k] - want[k]) < 1e-4 for k in want) >= 0.95 * len(want)


def test_small_and_odd_stores(spark):
    for n in (1, 2, 3, 7):
        store = table(spark, np.eye(8)[:n])
        q = asked(store, 1)
        key = lambda r: (r.query_id, r["rank"], r.vec_id, r.score)
        assert sorted(map(key, gi.search(q, gi.build(store), k=3).collect())) == sorted(map(key, vs.top_k(q, store, k=3).collect()))
    odd = table(spark, np.eye(8)).union(spark.createDataFrame([(90, None), (91, [])], "vec_id long, embedding array<double>"))
    index = gi.build(odd.withColumn("x", F.lit("clash")), shard_rows=3)
    assert sorted(r.vec_id for r in gi.keys_of(index).collect()) == list(range(8))
    assert gi.search(asked(odd, 100).limit(0), index).count() == 0
    assert gi.search(asked(table(spark, np.eye(8)), 1), gi.build(odd.limit(0))).count() == 0
    with pytest.raises(ValueError, match="metric"):
        gi.build(odd, metric="hamming")


def test_added_rows_are_found(spark):
    rng = np.random.default_rng(8)
    old, new = table(spark, rng.normal(size=(400, 8))), table(spark, rng.normal(size=(200, 8)), 1000)
    both = written(gi.build(old).unionByName(gi.build(new)), "index")
    q = asked(old.union(new), 10)
    assert recall(gi.search(q, both), vs.top_k(q, old.union(new))) >= 0.95


def test_quality_by_label_counts_what_pairs_list(spark):
    rng = np.random.default_rng(4)
    labels = spark.createDataFrame([(i, int(x) if i % 9 else None) for i, x in enumerate(rng.integers(0, 5, 90))], "vec_id long, label int")
    found = spark.createDataFrame([(q, int(v), r + 1) for q in range(0, 90, 7) for r, v in enumerate(rng.choice([i for i in range(90) if i != q], 6, replace=False))], "query_id long, vec_id long, rank int")
    a, b = labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), labels
    pairs = a.join(b, (F.col("own") == F.col("label")) & (F.col("query_id") != F.col("vec_id"))).select("query_id", "vec_id")
    assert vs.quality_by_label(found, labels, 5).collect() == vs.quality_at_k(found, pairs, 5).collect()
