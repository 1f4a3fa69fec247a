"""Mixing: targets, the flow against an exhaustive optimum, overlapping sources, and many sources."""

from itertools import product

import numpy as np
from pyspark.sql import functions as F

from corvane.llm import mixing
from corvane.llm.common import written


def shared_out(sizes, weights, total, repeats):
    """Targets by their definition, source by source."""
    out, free, left = [0.0] * len(sizes), list(range(len(sizes))), float(total)
    while free:
        unit = left / sum(weights[i] for i in free)
        full = [i for i in free if weights[i] * unit > repeats * sizes[i]]
        if not full:
            for i in free:
                out[i] = weights[i] * unit
            break
        for i in full:
            out[i] = float(repeats * sizes[i])
            left -= out[i]
        free = [i for i in free if i not in full]
    return out


def test_targets(spark):
    rng = np.random.default_rng(4)
    for sizes, weights in [([10, 100, 100], [1, 2, 3]), ([0, 5], [1, 1]), *(((rng.pareto(0.7, 12) * 10).astype(int).tolist(), rng.integers(1, 9, 12).tolist()) for _ in range(4))]:
        s = spark.createDataFrame([(f"s{i:02}", n, float(w)) for i, (n, w) in enumerate(zip(sizes, weights))], "source string, size long, weight double")
        got = [r.target for r in mixing.targeted(s, float(sum(sizes)), 3).orderBy("source").collect()]
        assert np.allclose(got, shared_out(sizes, weights, sum(sizes), 3), rtol=1e-9)
    assert shared_out([10, 100, 100], [1, 2, 3], 210, 3) == [30.0, 72.0, 108.0]


def test_flow_is_an_exhaustive_optimum():
    """All amounts by pattern are tried; amounts can be routed if no set of patterns sends more than its sources hold."""
    rng = np.random.default_rng(7)
    for _ in range(60):
        n, m = int(rng.integers(1, 4)), int(rng.integers(1, 4))
        supplies = rng.integers(0, 4, n).tolist()
        members = [sorted(rng.choice(m, size=int(rng.integers(1, m + 1)), replace=False).tolist()) for _ in range(n)]
        quotas = rng.integers(0, 8, m).tolist()
        cost = lambda x: sum(max(0, min(v, (k + 1) * s) - k * s) * k * k for v, s in zip(x, supplies) for k in range(3))  # noqa: B023, E731
        sets = [[i for i in range(n) if b >> i & 1] for b in range(1, 1 << n)]
        best = min((-sum(x), cost(x)) for x in product(*(range(3 * s + 1) for s in supplies)) if all(sum(x[i] for i in c) <= sum(quotas[s] for s in {s for i in c for s in members[i]}) for c in sets))
        got = mixing.min_cost_flow(supplies, members, quotas, 3)
        assert (-sum(got), cost(got)) == best and all(v <= 3 * s for v, s in zip(got, supplies))


def test_flow_over_many_patterns():
    rng = np.random.default_rng(1)
    members = [sorted(rng.choice(400, size=3, replace=False).tolist()) for _ in range(20_000)]
    supplies = rng.integers(1, 1000, 20_000).tolist()
    got = mixing.min_cost_flow(supplies, members, [30_000] * 400, 3)
    assert sum(got) == min(400 * 30_000, 3 * sum(supplies))


def test_overlapping_sources(spark):
    # a pattern in both sources gives to either; no second copy is used while firsts are left
    assert mixing.min_cost_flow([100, 50, 50], [[0], [1], [0, 1]], [120, 80], 3) == [100, 50, 50]
    rows = spark.createDataFrame([(i, ["a", "b"] if i % 3 == 0 else ["a"] if i % 3 == 1 else ["b"], 10, "x") for i in range(90)], "doc_id long, sources array<string>, size long, place string")
    mixed, by = mixing.mix(rows, weights={"a": 1, "b": 1})
    assert mixed.columns == ["doc_id", "size", "place", "sources", "copies"]
    assert {r.source: r.source_size for r in by.collect()} == {"a": 600, "b": 600} and all(r.copies == 1 for r in mixed.collect())
    # linked and lone sources, nulls and empty sets together: each pattern's words come near its flow
    rng = np.random.default_rng(9)
    names = ["a", "b", "c", "d", None]
    rows = spark.createDataFrame([(i, [names[k] for k in rng.choice(4, size=int(rng.integers(1, 3)), replace=False)] if i % 4 else [None] if i % 8 else [], int(rng.integers(0, 40))) for i in range(800)], "doc_id long, sources array<string>, size long")
    mixed, by = mixing.mix(rows, weights={"a": 5, "b": 1, "c": 1, None: 2})
    assert {r.source: r.target for r in by.collect()}["d"] == 0
    total = sum(r.size * r.copies for r in mixed.collect())
    assert abs(total - sum(r.target for r in by.collect())) <= 100 and all(0 <= r.copies <= 3 for r in mixed.collect())
    assert not [r for r in mixed.collect() if r.sources == ["d"] and r.copies]


def test_fifty_thousand_sources(spark):
    docs = written(spark.range(120_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("host"), (F.col("id") % 50_000).cast("string")).alias("source"), F.concat_ws(" ", F.array_repeat(F.lit("w"), (F.col("id") % 7 + 1).cast("int"))).alias("text")), "sources")
    found = mixing.mix_documents(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("most")).collect()
    assert len(found) == 50_000 and all(abs(r.taken - r.target) <= r.most for r in found)


def test_rows_without_ids_are_dealt_apart(spark):
    """A third of all rows has no id: their places in the seeded order differ, so no task ranks them all, and targets are met closely."""
    docs = spark.createDataFrame([(None if i % 3 else i, f"s{i % 2}", "w " * (i % 11 + 1) + str(i)) for i in range(3000)], "doc_id long, source string, text string")
    rows = docs.selectExpr("doc_id", "array(source) as sources", "10L as size", "text")
    places = mixing.mix(rows)[0]
    assert places.filter("copies > 1").count() > 0
    found = mixing.mix_documents(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 12 for r in found)
    again = mixing.mix_documents(docs.repartition(7)).groupBy("source", "size", "copies").count()
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, mixing.mix_documents(docs).groupBy("source", "size", "copies").count().collect()))


def test_lone_sources_beyond_the_graph_get_the_same_flow(spark):
    """With more patterns than max_linked, sources that share nothing are left out of the graph: the flow stays that of the whole graph."""
    rng = np.random.default_rng(3)
    pairs = [(["sa", "sb"], 40), (["sa"], 25), (["sb"], 70)] + [([f"sx{i}"], int(rng.integers(0, 90))) for i in range(12)]
    patterns = spark.createDataFrame(pairs, "pattern array<string>, n long")
    sources = spark.createDataFrame([(s, float(rng.integers(0, 200))) for s in sorted({s for p, _ in pairs for s in p})], "source string, target double")
    keep = lambda df: written(df, "flow")
    whole, parts = (sorted(map(str, mixing.routed(patterns, sources, 3, most, keep).collect())) for most in (200, 4))
    assert whole == parts and len(whole) == 15
