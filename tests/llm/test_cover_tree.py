"""Cover trees: their invariants, exact answers, and that node pairs are pruned."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import cover_tree as ct


def clustered(rng, n, centres=30, spread=0.3, dim=64):
    c = rng.normal(size=(centres, dim))
    return np.floor(256 * (c[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, dim))))


SETS = {
    "clustered": lambda r: clustered(r, 8192),
    "tight": lambda r: clustered(r, 3000, spread=0.05),
    "random": lambda r: np.floor(256 * r.normal(size=(1500, 64))),
    "flat": lambda r: np.floor(256 * r.normal(size=(3000, 3))),
    "equal": lambda r: np.ones((500, 8)),
    "one": lambda r: np.ones((1, 8)),
}


@pytest.mark.parametrize("name", SETS)
def test_covering_and_separation(name):
    t = ct.Points(np.arange(len(x := SETS[name](np.random.default_rng(1)))), x, 6).tree
    for k, kids in enumerate(t.children):
        assert all(np.linalg.norm(t.x[t.centre[k]] - t.x[t.centre[c]]) <= t.scale[k] + 1e-6 for c in kids)
        assert np.linalg.norm(t.x[t.rows[k]] - t.x[t.centre[k]], axis=1).max() <= t.radius[k]
        assert kids or len(t.points[k]) <= ct.LEAF
    level = {}
    for k, s in enumerate(t.scale):
        level.setdefault(s, []).append(t.centre[k])
    for s, c in level.items():
        d = np.linalg.norm(t.x[c][:, None] - t.x[c][None, :], axis=2) if len(c) < 800 else None
        assert d is None or len(c) == 1 or d[~np.eye(len(c), dtype=bool)].min() > s - 1e-6
    assert sorted(np.concatenate(t.points).tolist()) == list(range(len(t.x)))


@pytest.mark.parametrize(("name", "least"), [("clustered", 0.5), ("tight", 0.2), ("flat", 0.5), ("random", 2.0), ("equal", 1.0)])
def test_search_prunes_and_is_exact(name, least):
    """164 queries: products with candidates and with nodes' centres together, as a share of all pairs. Random vectors give no radius to prune by."""
    x = SETS[name](np.random.default_rng(2))
    ids = np.arange(len(x))
    asked = np.random.default_rng(3).choice(len(x), size=min(164, len(x)), replace=False)
    s = ct.Search(ct.Points(asked, x[asked], 1 << 62), 5)
    for a in range(0, len(x), 4096):
        s.run(ct.Points(ids[a : a + 4096], x[a : a + 4096], 6))
    g = x[asked] @ x.T
    want = {(int(q), int(j), int(g[i, j])) for i, q in enumerate(asked) for j in [j for j in np.lexsort((ids, -g[i])) if j != q][:5]}
    assert set(s.told()) == want
    share = (s.scored + s.bounded) / (len(x) * len(asked))
    print(f"{name}: {share:.3f} of all pairs")
    assert share <= least


@pytest.mark.parametrize("block_rows", [200, 4096])
def test_clustered_vectors_over_blocks(spark, block_rows):
    x = clustered(np.random.default_rng(4), 3000, dim=16)
    x[:900] = x[0]  # a third of all rows hold one vector
    d = spark.createDataFrame([(i, (v / 256).tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, pivot int")
    got = {tuple(r) for r in ct.top_k(d.repartition(5), block_rows=block_rows).collect()}
    ids, g = np.arange(3000), x @ x[::50].T
    want = {(50 * i, n + 1, int(j), int(g[j, i])) for i in range(60) for n, j in enumerate([j for j in np.lexsort((ids, -g[:, i])) if j != 50 * i][:5])}
    assert got == want


def test_odd_tables(spark):
    d = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "vec_id long, embedding array<double>")
    assert ct.top_k(d).count() == 0  # no query
    assert ct.top_k(d.filter("false")).columns == ["query_id", "rank", "vec_id", "score"]
    with pytest.raises(ValueError, match="1 to 2 components"):
        ct.top_k(d.union(spark.createDataFrame([(3, [1.0, 2.0])], d.schema)))
    with pytest.raises(Exception, match="pass a long"):
        ct.top_k(spark.createDataFrame([(0, [1e300]), (1, [1e300])], d.schema)).collect()
    assert [r.vec_id for r in ct.top_k(d.union(d).union(spark.createDataFrame([(0, [3.0]), (50, [4.0])], d.schema)).withColumn("group", F.lit(1))).filter("query_id = 50").orderBy("rank").collect()] == [0, 2, 1]
