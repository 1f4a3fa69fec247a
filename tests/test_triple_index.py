"""Bucket tables, the fold by position, and incremental triple merging against one load and a sequential version."""

import os
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import buckets, triple_index, triples
from corvane.shared import kept, new_path, written


def trigrams(dim=48):
    def embed(texts):
        import zlib

        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for k in range(max(1, len(t) - 2)):
                h = zlib.crc32(t[k : k + 3].encode())
                out[i, h % dim] += 1 if h >> 31 else -1
        return out

    return embed


def made(n, seed):
    r = random.Random(seed)
    names = [f"a rather long name of entity {i}" for i in range(12)]
    vary = lambda s: r.choice([s, s.upper(), s + ".", s + "x", s.replace("rather", "rathe"), "  " + s])
    return [(i, vary(r.choice(names)), r.choice(["knows", "knew", "has worked with"]), vary(r.choice(names)), r.choice([0.2, 0.5, 0.9, None]), f"s{i}") for i in range(n)]


def one_by_one(rows, radius, sources):
    """rows: (pos, key, signature, triple, confidence, source) in order."""
    of, lead, out = {}, [], {}
    for pos, key, sign, spo, confidence, source in rows:
        if key not in of:
            near = min(((int(np.unpackbits(np.bitwise_xor(np.frombuffer(sign, np.uint8), np.frombuffer(s, np.uint8))).sum()), p, k) for p, k, s in lead), default=(999,))
            of[key] = near[2] if near[0] <= radius else key
            if of[key] == key:
                lead.append((pos, key, sign))
        e = out.setdefault(of[key], {"n": 0, "parts": 0.0, "rated": 0, "best": (-2, -1), "sources": []})
        e["n"] += 1
        if confidence is not None:
            e["parts"] += 1 / confidence
            e["rated"] += 1
        if (confidence if confidence is not None else -1.0, pos) >= e["best"]:
            e["best"], e["spo"] = (confidence if confidence is not None else -1.0, pos), spo
        e["sources"] = [*e["sources"], source][-sources:]
    return sorted((k, *e["spo"], e["n"], round(e["rated"] / e["parts"], 6) if e["rated"] else None, ",".join(e["sources"])) for k, e in out.items())


def result(index):
    return sorted(tuple(r) for r in index.read().collect())


SCHEMA = "pos long, subject string, predicate string, object string, confidence double, source string"


@pytest.fixture(scope="module")
def loaded(spark):
    rows = made(700, 4)
    df = written(spark.createDataFrame(rows, SCHEMA), "triples")
    embed = trigrams()
    once = triple_index.TripleIndex(spark, new_path(spark, "once"), embed, kept("t"), sources=4, buckets=8)
    once.merge(df, 0)
    return df, embed, once


def test_one_load_is_the_sequential_merge(spark, loaded):
    df, embed, once = loaded
    keyed = df.withColumn("key", triples.canonical_key())
    firsts = keyed.groupBy("key").agg(F.min(F.struct("pos", F.lower(F.concat_ws(" ", *triples.SPO)).alias("text"))).alias("x")).select("key", "x.text")
    sign = {r.key: bytes(r.signature) for r in triple_index.signatures(firsts, "text", embed).collect()}
    rows = [(r.pos, r.key, sign[r.key], (r.subject, r.predicate, r.object), r.confidence, r.source) for r in keyed.orderBy("pos").collect()]
    want = one_by_one(rows, 7, 4)
    assert 0 < len(want) < len(sign)  # some forms are close to earlier ones
    near = lambda rows: [(*r[:5], r[5] and pytest.approx(r[5], abs=2e-6), r[6]) for r in rows]
    assert result(once) == near(want)


def test_batches_give_what_one_load_gives(spark, loaded):
    df, embed, once = loaded
    path = new_path(spark, "batches")
    index = triple_index.TripleIndex(spark, path, embed, kept("t"), sources=4, buckets=8)
    for n, (low, high) in enumerate([(0, 30), (30, 300), (300, 301), (301, 700)]):
        batch = df.filter((F.col("pos") >= low) & (F.col("pos") < high))
        if n == 1:  # broken off before its edges were written: it is run again as a whole
            merge, index.edges.merge = index.edges.merge, lambda *a: (_ for _ in ()).throw(OSError("lost"))
            with pytest.raises(OSError, match="lost"):
                index.merge(batch, n)
            index.edges.merge = merge
        index.merge(batch.repartition(3), n)
        if n == 2:
            index.merge(batch, n)  # a replay
    assert result(triple_index.TripleIndex(spark, path, embed, kept("t"), sources=4)) == result(once)


def test_distance_and_parts(spark):
    rng = np.random.default_rng(0)
    a = rng.integers(0, 256, (50, 16), dtype=np.uint8)
    b = a.copy()
    for i in range(50):
        for k in rng.choice(128, size=i % 9, replace=False):
            b[i, k // 8] ^= 1 << (k % 8)
    d = spark.createDataFrame([(i, bytearray(x.tobytes()), bytearray(y.tobytes())) for i, (x, y) in enumerate(zip(a, b, strict=True))], "i long, a binary, b binary")
    assert [r.d for r in d.orderBy("i").select(triple_index.distance("a", "b").alias("d")).collect()] == [i % 9 for i in range(50)]
    one, two = (triple_index.parted(d.select("i", F.col(c).alias("signature"))).select("i", "part", "value") for c in "ab")
    met = {r.i for r in one.join(two, ["i", "part", "value"]).collect()}
    assert met >= {i for i in range(50) if i % 9 <= 7}  # fewer bits than parts: one part at least agrees
    with pytest.raises(ValueError, match="parts"):
        triple_index.TripleIndex(spark, "x", trigrams(), kept("t"), radius=8)


def folded(links):
    before = defaultdict(list)
    for a, o in links:
        before[a].append(o)
    gone = set()
    for a in sorted(before):
        if any(o not in gone for o in before[a]):
            gone.add(a)
    return gone


@pytest.mark.parametrize("local", [100_000, 5, 0])
def test_fold(spark, local):
    r = random.Random(local)
    links = sorted({(a, o) for _ in range(150) for a, o in [sorted((r.randrange(120), r.randrange(120)), reverse=True)] if a != o})
    df = spark.createDataFrame(links, "at long, other long")
    assert {x.at for x in triples.first_of_links(df, kept("fold"), local=local).collect()} == folded(links)
    assert triples.first_of_links(df.limit(0), kept("fold")).count() == 0


def test_a_long_chain_takes_few_rounds(spark):
    n, tables = 10_000, []

    def keep(df):
        tables.append(1)
        return written(df, "chain")

    got = triples.first_of_links(spark.range(1, n).select(F.col("id").alias("at"), (F.col("id") - 1).alias("other")), keep)
    assert {r.at for r in got.collect()} == set(range(1, n, 2))
    assert len(tables) <= 40  # two a round of the components, and a few; one for each link before


def test_bucket_table(spark, tmp_path):
    table = buckets.BucketTable(spark, str(tmp_path / "t"), ["k"], "k long, v string, at long", buckets=16)
    assert table.read().count() == 0 and table.versions() == []
    put = lambda rows, n: table.merge(spark.createDataFrame(rows, "k long, v string, at long"), buckets.last_wins(["k"], "at"), n)
    assert put([(i, "a", 0) for i in range(200)], 0)
    before = table.manifest()[2]
    assert put([(3, "b", 1), (3, "c", 0), (500, "new", 1)], 1) and not put([(3, "z", 9)], 1) and not put([(3, "z", 9)], 0)
    want = {i: "a" for i in range(200)} | {3: "b", 500: "new"}
    assert {r.k: r.v for r in table.read().collect()} == want
    after, touched = table.manifest()[2], set(table.buckets_of(spark.createDataFrame([(3,), (500,)], "k long")))
    assert {b for b in after if after[b] != before.get(b)} == touched and len(touched) <= 2
    assert table.read([999]).count() == 0 and table.lookup(spark.createDataFrame([(3,)], "k long")).filter("k = 3").count() == 1
    # a merge that breaks off leaves the table as it was; the next one cleans up
    def broken(old, new):
        return old.unionByName(new).withColumn("v", F.raise_error(F.lit("lost")))

    with pytest.raises(Exception, match="lost"):
        table.merge(spark.createDataFrame([(4, "x", 2)], "k long, v string, at long"), broken, 2)
    assert {r.k: r.v for r in table.read().collect()} == want
    for n in range(2, 6):
        assert put([(n, "d", n)], n)
    assert len(table.versions()) == 2 and {r.k: r.v for r in buckets.BucketTable(spark, str(tmp_path / "t"), ["k"], table.schema).read().collect()} == want | {n: "d" for n in range(2, 6)}
    named = {f for v in table.versions() for f in table.manifest(v)[2].values()}
    assert {p.name for p in (tmp_path / "t" / "data").iterdir() if p.is_dir()} == named
    assert table.merge(spark.createDataFrame([], "k long, v string, at long"), buckets.last_wins(["k"], "at"), 9) and table.read().count() == 201


@pytest.mark.parametrize("threshold", [0.7, 0.8, 0.95])
def test_bands_find_alike_terms(spark, threshold):
    """Recall of pairs and of the fold against the exact way; nothing is found that is not alike."""
    rng = np.random.default_rng(3)
    centres = np.repeat(rng.normal(size=(300, 24)), 5, axis=0)
    x = np.concatenate([centres + rng.normal(size=centres.shape) * rng.uniform(0.1, 0.8, (len(centres), 1)), np.zeros((3, 24))])
    v = written(spark.createDataFrame([(f"t{i}", [float(y) for y in row]) for i, row in enumerate(x)] + [(None, [1.0] * 24)], "term string, vector array<double>"), "vectors")
    pairs = lambda **options: {tuple(r) for r in triples.alike_terms(v, kept("alike"), threshold, **options).collect()}
    exact, found = pairs(), pairs(recall=0.95)
    assert found <= exact and {(f"t{i}", f"t{i}") for i in range(1503)} <= found and ("t1500", "t1501") not in exact
    assert len(found) >= 0.9 * len(exact) and pairs(recall=0.95, block=7) == found and pairs(block=100) == exact
    t = spark.createDataFrame([(i, f"t{i}", "p", f"t{(i * 7) % 1500}") for i in range(1500)], "pos long, subject string, predicate string, object string")
    one, two = ({r.pos for r in triples.near_duplicates_dropped(t, v, kept("fold"), entity_threshold=threshold, recall=recall).collect()} for recall in (None, 0.95))
    assert len(one & two) >= 0.9 * len(one | two)


@pytest.mark.parametrize("recall", [None, 0.95])
def test_triples_of_equal_vectors_make_no_links(spark, recall):
    """Ten terms of one vector at each end: a hundred triples are alike, which one head for each vector tells without a pair of them."""
    vec = np.random.default_rng(5).normal(size=(40, 24))
    t = spark.createDataFrame([(i, f"t{(i * 7) % 400}", "p", f"t{(i * 13 + i // 400) % 400}") for i in range(3000)], "pos long, subject string, predicate string, object string")
    v = spark.createDataFrame([(f"t{i}", vec[i // 10].tolist()) for i in range(400)], "term string, vector array<double>")
    sizes = []

    def counting(df):
        out = written(df, "counted")
        sizes.append((out.columns, out.count()))
        return out

    got = sorted(tuple(r)[:2] for r in triples.near_duplicates_dropped(t, v, counting, recall=recall).select("pos", "subject").collect())
    seen = {}
    for r in sorted(t.collect(), key=lambda r: r.pos):
        seen.setdefault((int(r.subject[1:]) // 10, int(r.object[1:]) // 10), (r.pos, r.subject))
    assert got == sorted(seen.values())
    assert {n for columns, n in sizes if columns == ["at", "other"]} == {0}
    assert len(triples.alike_terms(v, kept("alike"), 0.8, recall=recall).collect()) == 40 * 100


def test_parts_are_rarely_shared_by_chance(spark):
    """Unrelated signatures: parts of 24 bits, of which some n^2 / 2^21 pairs agree by chance, not n^2 / 2^14 as of eight parts of 16 bits."""
    x = np.random.default_rng(2).integers(0, 256, (3000, 16), dtype=np.uint8)
    p = triple_index.parted(written(spark.createDataFrame([(i, bytearray(r.tobytes())) for i, r in enumerate(x)], "i long, signature binary"), "signs")).select("i", "part", "value")
    pairs = p.alias("a").join(p.alias("b"), ["part", "value"]).filter("a.i < b.i").count()
    assert pairs < 40  # some 4 are expected; eight parts of 16 bits have 550


def test_sketched_buckets(spark):
    """Bands at a high threshold hand on sketches and no vectors, in blocks too, and find what the comparison of all pairs finds."""
    r = np.random.default_rng(5)
    base = r.normal(size=(40, 32))
    rows = [(f"t{i}-{j}", (base[i] + 0.25 * r.normal(size=32)).tolist()) for i in range(40) for j in range(5)] + [("zero", [0.0] * 32), ("nan", [float("nan")] * 32)]
    v = spark.createDataFrame(rows, "term string, vector array<double>").repartition(3)
    wide = []

    def counting(df):
        wide.append("vector" in df.columns and "bucket" in df.columns)
        return kept("sketched")(df)

    exact, found = ({tuple(x) for x in triples.alike_heads(v, counting, 0.8, **o).collect()} for o in ({}, {"recall": 0.95}))
    assert found <= exact and len(found) >= 0.95 * len(exact) > 600 and not any(wide)
    assert {tuple(x) for x in triples.alike_heads(v, kept("blocks"), 0.8, recall=0.95, block=3).collect()} == found
    told = triples.banded(v, 4, 3, 7)
    assert told.columns == ["term", "bucket", "sketch"] and {len(x.sketch) for x in told.collect()} == {32}


@pytest.mark.parametrize("name", ["near_duplicate_relations", "banded_relations"])
def test_unlike_names_have_unlike_vectors(spark, tmp_path, name):
    """The vectors of customer#40575_ and customer#73539_ by CRC-32 had a cosine of 0.809, so customers of one were dropped for those of the other."""
    import duckdb

    from corvane.queries import QUERIES, SQL

    from .conftest import SF

    for t, where in (("nation", "true"), ("supplier", "true"), ("lineitem", "l_orderkey % 10 = 0")):
        spark.read.parquet(f"{SF}/{t}.parquet").filter(where).write.parquet(f"{tmp_path}/{t}.parquet")
    keys = [k for stem in (40575, 73539) for k in range(10 * stem, 10 * stem + 10)]
    spark.createDataFrame([(k, k % 10) for k in keys], "c_custkey long, c_nationkey int").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    c = duckdb.connect()
    for t in ("nation", "customer", "supplier", "lineitem"):
        c.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = sorted(c.sql(SQL[name]).fetchall())
    assert sorted(tuple(r) for r in QUERIES[name](spark, str(tmp_path)).select("pos", "subject", "predicate", "object").collect()) == want


@pytest.mark.parametrize("radius", [7, 2])
def test_near_signatures(spark, radius):
    """Pairs of new signatures, and of new and stored ones, by parts told in tasks against all pairs; stored ones do not meet each other."""
    r = np.random.default_rng(radius)
    x = np.repeat(r.integers(0, 256, (60, 16), dtype=np.uint8), 5, axis=0)
    for row in x:
        for k in r.choice(128, size=r.integers(0, 6), replace=False):
            row[k // 8] ^= 1 << (k % 8)
    x = np.unique(x, axis=0)[r.permutation(len(np.unique(x, axis=0)))]
    new, old = (spark.createDataFrame([(bytearray(v.tobytes()),) for v in some], "signature binary") for some in (x[: len(x) // 2], x[len(x) // 2 :]))
    apart = np.bitwise_count(x[:, None] ^ x[None]).sum(axis=2)
    want = {(frozenset((i, j)), j >= len(x) // 2, int(apart[i, j])) for i in range(len(x) // 2) for j in range(i + 1, len(x)) if apart[i, j] <= radius}
    at = {v.tobytes(): i for i, v in enumerate(x)}
    got = [(at[bytes(p.a)], at[bytes(p.b)], p.stored, p.far) for p in triple_index.near_signatures(new, old, radius, partitions=3).collect()]
    assert all(a < len(x) // 2 and (b >= len(x) // 2) == stored for a, b, stored, _ in got)
    assert len(got) == len(want) > 20 and {(frozenset((a, b)), stored, far) for a, b, stored, far in got} == want
    assert triple_index.near_signatures(new.limit(0), old, radius, partitions=2).count() == 0


def test_a_merge_keeps_no_row_for_each_part(spark):
    """Where few forms are alike, tables of a batch have a row for each triple at most, not 16 for each form, and are gone after it."""
    from corvane.queries import _by_stem

    rows = [(i, f"supplier {i % 50}", "supplies", f"part {i}", 0.5, "s") for i in range(400)]
    path, sizes, paths = new_path(spark, "lean"), [], []

    def counting(df):
        out = written(df, "lean-batch")
        sizes.append(out.count())
        paths.append(os.path.dirname(out.inputFiles()[0].removeprefix("file://")) if sizes[-1] else "")
        return out

    index = triple_index.TripleIndex(spark, path, _by_stem, counting, buckets=4)
    for n in range(2):
        index.merge(spark.createDataFrame(rows[200 * n : 200 * n + 200], SCHEMA), n)
    assert len(sizes) > 10 and max(sizes) <= 200
    assert any(paths) and not any(os.path.exists(p) for p in paths if p)
    assert sorted(os.listdir(path)) == ["edges", "forms"]


def test_blocks_are_written_once(spark):
    """All pairs in blocks: no vector is copied for each block that it meets, and the pairs are those of one product."""
    r = np.random.default_rng(6)
    x = np.concatenate([np.repeat(r.normal(size=(60, 16)), 4, axis=0) + 0.3 * r.normal(size=(240, 16)), np.zeros((2, 16)), np.full((1, 16), np.nan)])
    v = spark.createDataFrame([(f"t{i}", row.tolist()) for i, row in enumerate(x)], "term string, vector array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True).clip(1e-300)
    want = {(f"t{i}", f"t{j}") for i, j in zip(*np.nonzero(u @ u.T > 0.8), strict=True) if i != j}
    sizes = []

    def counting(df):
        out = written(df, "blocks")
        sizes.append(out.count())
        return out

    found = triples.alike_heads(v, counting, 0.8, block=50)
    rows = [tuple(p) for p in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and len(want) > 300
    assert sizes == [5] and "explode" not in found._jdf.queryExecution().executedPlan().toString()
    # a term of several vectors has the least of them, one that comes twice counts once
    t = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("b", [0.0, 2.0]), ("b", [0.0, 2.0]), ("c", [0.0, 2.0])], "term string, vector array<double>")
    assert sorted(tuple(p) for p in triples.alike_terms(t, counting, 0.8).collect()) == [("a", "a"), ("a", "b"), ("a", "c"), ("b", "a"), ("b", "b"), ("b", "c"), ("c", "a"), ("c", "b"), ("c", "c")]
