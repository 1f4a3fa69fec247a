"""Centroid clustering against a version in Python's integers."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, cluster string, distance string, n long"


def brute(rows, k, rounds, dim, seed=2, scale=256):
    kept = [(i, [int(v) * scale if abs(v) > 1e300 else math.floor(scale * v) for v in x]) for i, x, *_ in rows if x is not None and len(x) == dim and all(v is not None and math.isfinite(v) for v in x)]
    first = sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    now = [x for _, x in first]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), n) for n, c in enumerate(now))
    for _ in range(rounds):
        of = [near(x)[1] for _, x in kept]
        held = [[x for (_, x), c in zip(kept, of, strict=True) if c == n] for n in range(len(now))]
        now = [[sum(v) // len(own) for v in zip(*own, strict=True)] if own else c for own, c in zip(held, now, strict=True)]
    out = [(i, *near(x)) for i, x in kept]
    whole = lambda v: v if v < 1 << 63 else None
    far = {c: [d for _, d, n in out if n == c] for _, _, c in out}
    total = lambda ds: None if any(whole(d) is None for d in ds) else whole(sum(ds))
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    return sorted(((i, c, whole(d), total(far[c]), total([d for _, d, _ in out]), digest[c]) for i, d, c in out), key=str)


def got(spark, rows, k, rounds, dim, parts=5):
    df = spark.createDataFrame([(i, x, "clash", "clash", 1) for i, x in rows], SCHEMA).repartition(parts)
    return sorted((tuple(r) for r in centroids.cluster(df, k=k, rounds=rounds, dim=dim).collect()), key=str)


def vectors(n, dim, spread, seed=1):
    return [(i, [float(v) for v in row]) for i, row in enumerate(np.random.default_rng(seed).normal(0, spread, (n, dim)))]


@pytest.mark.parametrize("spread", [1.0, 3e4, 1e9, 1e40, 1e200])
def test_every_kind_of_arithmetic(spark, spread):
    rows = vectors(60, 4, spread) + [(100 + i, x) for i, x in vectors(30, 4, 1.0, 2)]
    assert got(spark, rows, 7, 3, 4) == brute(rows, 7, 3, 4)


def test_odd_rows(spark):
    rows = vectors(40, 3, 2.0)
    rows += [(200, None), (201, []), (202, [1.0, 2.0]), (203, [1.0, None, 2.0]), (204, [float("nan"), 0.0, 0.0]), (205, [float("inf"), 0.0, 0.0]), (206, [0.0] * 4)]
    rows += [(None, [0.5, 0.5, 0.5]), (None, [9.0, 9.0, 9.0]), (7, [1.0, 1.0, 1.0]), (7, [1.0, 1.0, 1.0]), (8, [-0.0, 0.0, -1e-300]), (9, [1.7e308, 0.0, 0.0])]
    assert got(spark, rows, 5, 4, 3) == brute(rows, 5, 4, 3)
    assert got(spark, rows, 5, 4, 3, parts=1) == got(spark, rows, 5, 4, 3, parts=11)


def test_ties_empty_centroids_and_few_rows(spark):
    rows = [(i, [1.0, 0.0]) for i in range(30)] + [(50, [5.0, 0.0])]
    assert got(spark, rows, 8, 3, 2) == brute(rows, 8, 3, 2)  # equal centroids: the smaller number takes all, the others stay empty
    assert got(spark, rows[:3], 8, 2, 2) == brute(rows[:3], 8, 2, 2)
    assert got(spark, [], 8, 2, 2) == []
    assert got(spark, [(1, None)], 8, 2, 2) == []


def test_blocks_of_centroids(spark, monkeypatch):
    rows = vectors(90, 3, 2.0)
    want = brute(rows, 40, 2, 3)
    c = centroids.Centroids(np.array([[int(math.floor(256 * v)) for v in x] for _, x in rows[:40]], object))
    x = np.floor(256 * np.array([x for _, x in rows]))
    once = c.nearest(x, c.floats)
    monkeypatch.setattr(centroids, "CENTROIDS", 7)
    for a, b in zip(once, c.nearest(x, c.floats), strict=True):
        assert (a == b).all()
    assert got(spark, rows, 40, 2, 3) == want


def test_floats_are_widened_first(spark):
    df = spark.createDataFrame([(i, x) for i, x in vectors(20, 2, 0.01)], "vec_id long, embedding array<float>")
    rows = [(r.vec_id, [float(np.float32(v)) for v in r.embedding]) for r in df.collect()]
    assert sorted(map(tuple, centroids.cluster(df.withColumn("size", F.lit(1)), k=3, rounds=2, dim=2).collect()), key=str) == brute(rows, 3, 2, 2)
