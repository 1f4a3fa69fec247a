"""Near copies whose passages repeat: candidates must follow the Jaccard similarity of the shingle sets, which decides."""

import random

import pytest
from pyspark.sql import functions as F

from corvane.llm import near_duplicates as nd
from corvane.llm.near_duplicates import near_duplicates


@pytest.mark.parametrize("times", [10, 50, 200, 1000])
def test_near_copies_with_a_repeated_passage(spark, times):
    r, rows = random.Random(times), []
    for i in range(40):
        text = " ".join(f"w{r.randrange(10**9)}" for _ in range(204))
        passage = " ".join(f"p{r.randrange(10**9)}" for _ in range(30))
        rows += [(2 * i, text), (2 * i + 1, f"{text} {' '.join([passage] * times)}")]
    # 200 shingles are shared; 4 span the seam, 26 lie in the passage and 4 in its repetition
    assert 200 / 234 > 0.85
    found = {x.doc_id: (x.class_id, x.class_size) for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {i: (i - i % 2, 2) for i in range(80)}


def test_kept_row_does_not_depend_on_partitions(spark):
    """Of rows that repeat id and text, the same one stays however they are dealt."""
    rows = [(i % 5, f"text of number {i % 5} and some more words", i, None if i % 3 else "x") for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string, other int, mark string")
    got = [sorted(tuple(r) for r in nd.keep_first(d.repartition(k)).collect()) for k in (1, 3, 7)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 5


def test_a_leader_with_many_partners_is_dealt_in_parts(spark):
    d = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(300)) + f" e{i}") for i in range(200)], "doc_id long, text string")
    signs = nd.signed(d, id_col="doc_id", text_col="text", width=5, bands=20, rows=5).cache()
    sets = signs.select("node", "n", "codes")
    a = signs.filter("doc_id = 0").first().node
    pairs = signs.filter("doc_id > 0").select(F.lit(a).alias("a"), F.col("node").alias("b"))
    got = nd.verified(pairs, sets, part_bytes=20_000).collect()
    assert len(got) == 199 and all(abs(r.similarity - 296 / 298) < 1e-9 for r in got)


def kept_by_brute_force(rows):
    """Rows that stay: one of each class of near copies, one of each repeated row; a class goes by its smallest (no id, id, digest)."""
    import hashlib

    digest = lambda t: hashlib.md5((t or "").encode()).digest()
    key = lambda r: (r[0] is None, r[0] or 0, digest(r[1]))
    distinct = {key(r): r for r in sorted(rows, key=str, reverse=True)}
    sets = {k: frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for k, r in distinct.items() if (w := (r[1] or "").split())}
    root = {k: k for k in distinct}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((top(a), top(b)))
                root[high] = low
    return sorted((distinct[k][:2] for k in distinct if top(k) == k), key=str)


def test_one_id_with_two_texts(spark):
    t, u = "this text is about one thing and has copies", "quite another text that has no copy in the table at all"
    d = spark.createDataFrame([(3, t), (5, t), (5, u)], "doc_id long, text string")
    assert sorted(map(tuple, nd.keep_first(d).collect())) == [(3, t), (5, u)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_keep_first_against_brute_force(spark, seed):
    r = random.Random(seed)
    texts = [" ".join(r.choice("abcdefghijklmnop") * 2 for _ in range(r.randrange(30, 60))) for _ in range(12)]
    texts += [t + " xx" for t in texts] + [None, "", " \n", "one two", "one two"]
    rows = [(r.choice([None, *range(15)]), r.choice(texts)) for _ in range(120)]
    d = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], "doc_id long, text string, digest string, first string")
    want = kept_by_brute_force(rows)
    for parts in (1, 6):
        out = nd.keep_first(d.repartition(parts))
        assert out.columns == d.columns
        assert sorted(((x.doc_id, x.text if (x.text or "").split() else None) for x in out.collect()), key=str) == sorted(((i, t if (t or "").split() else None) for i, t in want), key=str)
