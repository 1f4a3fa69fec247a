"""The maximum-entropy model: exact base figures, probabilities, and one model however the rows are partitioned."""

import collections
import math
import zlib

import numpy as np
import pytest

from corvane.llm import maxent
from tests.conftest import SF
from tests.llm.test_llm import docs, empty, rows  # noqa: F401  fixtures

TWO, THREE = maxent.Shape(2, 10, 11, 2, 1 << 20), maxent.Shape(3, 8, 9, 2, 1 << 20)


def test_base_and_model(docs, rows, empty):  # noqa: F811
    found = maxent.score_texts(docs, top_words=300).collect()
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    tokens = {i: [*(t or "").encode().translate(low).split(), None] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    counts = collections.Counter(w for i, _ in rows if not held[i] for w in tokens[i])
    n, v = sum(counts.values()), len(counts)
    assert len(found) == len(rows)
    for r in found:
        ws = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(ws), sum(counts[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score < 0
    assert sum(r.score for r in found if r.doc_id < 900_000) > sum(r.base_score for r in found if r.doc_id < 900_000)
    assert maxent.score_texts(empty).count() == 0


def test_end_token_is_counted_though_words_are_more_frequent(spark):
    d = spark.createDataFrame([(i, "a b c d " * 5) for i in range(20)], "doc_id long, text string")
    for r in maxent.score_texts(d, top_words=2).collect():
        n = r.train_tokens // 21
        assert r.n_known == 21 and math.isclose(r.base_score, 20 * math.log10((5 * n + 1) / (21 * n + 6)) + math.log10((n + 1) / (21 * n + 6)), rel_tol=1e-9)


def test_frequent_long_words_are_no_hot_keys(spark):
    """A separator line that every text holds is broadcast by its digest; the join is left with the rare words, and counts are exact."""
    line, other = "=" * 200, "é" * 40
    d = spark.createDataFrame([(i, f"a {line} b {other} w{i} {'x' * 100}{i}") for i in range(60)], "doc_id long, text string")
    counts = maxent.count_words(d.select("text"))
    words = maxent.frequent(counts, 4, 64)
    assert words.cut == 60 and len(words.counts) == 5 and all(len(w) <= 64 for w in words.words.to_pylist())
    left = maxent.coded_rows(d.selectExpr("doc_id as key", "doc_id", "false as held_out", "text"), words, TWO).select("tail", "near").collect()
    assert all(len(r.tail) == 2 and r.near == 5 for r in left) and not any(w in (line, other) for r in left for w in r.tail)
    tokens = {i: [*f"a {line} b {other} w{i} {'x' * 100}{i}".split(), None] for i in range(60)}
    seen = collections.Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(seen.values()), len(seen)
    for top_words in (2, 4, 1000):
        for r in maxent.score_texts(d, top_words=top_words).collect():
            assert r.n_known == sum(seen[w] > 0 for w in tokens[r.doc_id])
            assert math.isclose(r.base_score, sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in tokens[r.doc_id]), rel_tol=1e-9)


@pytest.mark.parametrize("shape", [TWO, THREE], ids=["two levels", "three levels"])
def test_probabilities_sum_to_one(shape):
    w = shape.fresh()
    w += np.random.default_rng(3).normal(size=w.shape).astype(np.float32)
    total = 0.0
    for a in range(0, shape.head + 1, 50_000):
        last = np.arange(a, min(a + 50_000, shape.head + 1))
        ids = np.stack([np.full(len(last), 5), np.full(len(last), 7), last], axis=1).ravel()
        total += (10 ** maxent.logs(shape, w, ids, np.tile(np.arange(3), len(last)))[2::3]).sum()
    assert abs(total - 1) < 1e-3


@pytest.mark.parametrize("shape", [TWO, THREE], ids=["two levels", "three levels"])
def test_paths_tell_words_apart(shape):
    """Classes, nodes and branches of all words: no two words share all of them, and nodes stay in their range."""
    ids = np.arange(shape.head)
    cls = shape.classes(ids)
    seen = [[c] for c in cls.tolist()]
    for at, node, branch in shape.path(ids, cls):
        assert node.min() >= 0 and node.max() < shape.nodes and branch.min() >= 0 and branch.max() < maxent.WIDTH
        for i, n, b in zip(at.tolist(), node.tolist(), branch.tolist()):
            seen[i] += [n, b]
    assert len({tuple(x) for x in seen}) == shape.head and cls.max() == maxent.RARE - 1
    assert shape.classes(np.array([shape.head]))[0] == maxent.RARE


def test_one_model_however_rows_are_partitioned(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    shape = maxent.Shape(2, 10, 12, 2, 1 << 12)
    assert shape.shards(20_000) == 5
    got = [{r.doc_id: (r.score, r.base_score) for r in maxent.score_texts(x, shape=shape).collect()} for x in (d, d.repartition(7), d.repartition(3, "source"))]
    for other in got[1:]:
        assert all(math.isclose(a, b, rel_tol=1e-9) for i in got[0] for a, b in zip(got[0][i], other[i]))


def test_blocks_do_not_depend_on_batches():
    shape, rng = TWO, np.random.default_rng(1)
    ids, w = rng.integers(0, shape.start, 40_000), TWO.fresh()
    back = np.arange(40_000) % 50
    one, parts = maxent.Learner(shape, w, 0.1), maxent.Learner(shape, w, 0.1)
    one.learn(ids, back)
    for a in range(0, 40_000, 50 * 7):
        parts.learn(ids[a : a + 350], back[a : a + 350])
    assert np.array_equal(one.close(), parts.close()) and one.seen == parts.seen == 40_000


def test_what_is_gathered_grows():
    shapes = [maxent.Shape.of(10**k) for k in (3, 7, 8, 10, 13)]
    for a, b in zip(shapes, shapes[1:]):
        assert b.head >= a.head and b.inner_bits >= a.inner_bits and b.rounds >= a.rounds
    assert shapes[-1].head > 500_000 and shapes[-1].inner_bits > shapes[0].inner_bits and shapes[-1].rounds > shapes[0].rounds
    assert [s.shards(10**9) for s in shapes[:2]] == [477, 477]
