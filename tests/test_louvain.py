"""Communities by modularity: planted blocks, small graphs, moves one after the other, and no dependence on partitions."""

from itertools import combinations

import numpy as np
import pytest

from corvane.operators import graph
from corvane.queries import kg
from corvane.shared import kept

from .conftest import SF


def triples(spark, pairs, parts=3):
    return spark.createDataFrame([(f"n{a:03}", "p", f"n{b:03}") for a, b in pairs], "subject string, predicate string, object string").repartition(parts)


def found(t):
    return sorted((r.node, r.community) for r in graph.louvain(t, kept("louvain")).collect())


def quality(pairs, label):
    pairs = {tuple(sorted(p)) for p in pairs if p[0] != p[1]}
    m, degree = len(pairs), {}
    for a, b in pairs:
        degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
    total = {}
    for n, k in degree.items():
        total[label[n]] = total.get(label[n], 0) + k
    return sum(label[a] == label[b] for a, b in pairs) / m - sum((k / (2 * m)) ** 2 for k in total.values())


def planted(seed, blocks, size, inside, outside):
    r = np.random.default_rng(seed)
    return [(a, b) for a, b in combinations(range(blocks * size), 2) if r.random() < (inside if a // size == b // size else outside)]


def test_planted_blocks_are_found_again_however_rows_are_dealt(spark):
    pairs = planted(1, 6, 20, 0.5, 0.02)
    got = found(triples(spark, pairs + [(a, a) for a in range(3)], 1))
    assert dict(got) == {f"n{i:03}": f"n{i // 20 * 20:03}" for i in range(120)}
    assert found(triples(spark, [(b, a) for a, b in reversed(pairs)] + pairs[:50], 7)) == got


def one_by_one(pairs):
    """The modularity that moving nodes one after the other comes to, level after level."""
    edges = {}
    for a, b in {tuple(sorted(p)) for p in pairs if p[0] != p[1]}:
        for x, y in ((a, b), (b, a)):
            edges.setdefault(x, {})[y] = 1
    label = {n: n for n in edges}
    two_m = sum(len(v) for v in edges.values())
    while True:
        weight = {n: sum(v.values()) for n, v in edges.items()}
        now, total, moved = {n: n for n in edges}, dict(weight), True
        while moved:
            moved = False
            for n in sorted(edges):
                to = {now[n]: 0}
                for o, w in edges[n].items():
                    if o != n:
                        to[now[o]] = to.get(now[o], 0) + w
                total[now[n]] -= weight[n]
                best = max(to, key=lambda c: (to[c] * two_m - weight[n] * total[c], c == now[n]))
                total[best] += weight[n]
                moved, now[n] = moved or best != now[n], best
        if len(set(now.values())) == len(now):
            return quality(pairs, label)
        label, merged = {n: now[c] for n, c in label.items()}, {}
        for a, own in edges.items():
            for b, w in own.items():
                at = merged.setdefault(now[a], {})
                at[now[b]] = at.get(now[b], 0) + w
        edges = merged


def test_no_worse_than_others(spark):
    pairs = planted(2, 5, 16, 0.35, 0.06)
    rows = [(r.subject, r.object) for r in kg(spark, SF).collect()]
    for t, own in ((triples(spark, pairs), pairs), (kg(spark, SF), rows)):
        ours, other = (graph.modularity(t, labels).first()[0] for labels in (graph.louvain(t, kept("a")), graph.communities(t, kept("b"))))
        assert ours >= other and ours >= 0.95 * one_by_one(own), (ours, other, one_by_one(own))


def test_chain_of_rings(spark):
    """Rings of four in a ring: levels above the first join rings, and modularity comes near that of the rings."""
    pairs = [(4 * i + j, 4 * i + (j + 1) % 4) for i in range(8) for j in range(4)] + [(4 * i, (4 * i + 4) % 32) for i in range(8)]
    label = {int(n[1:]): c for n, c in found(triples(spark, pairs))}
    assert quality(pairs, label) >= 0.98 * quality(pairs, {n: n // 4 for n in range(32)})


@pytest.mark.parametrize("pairs, want", [([], {}), ([(1, 1)], {"n001": "n001"}), ([(1, 2)], {"n001": "n001", "n002": "n001"}), ([(1, 2), (2, 1), (1, 2), (3, 4)], {"n001": "n001", "n002": "n001", "n003": "n003", "n004": "n003"})])
def test_small_graphs(spark, pairs, want):
    assert dict(found(triples(spark, pairs))) == want
