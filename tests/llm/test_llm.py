"""Training-data operators against brute force, and their defined results in odd cases."""

import base64
import collections
import hashlib
import math
import os
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import cover_tree, language_id, line_quality, mixing, near_duplicates, packing, pii, token_counts, warc
from tests.conftest import SF

ODD = [(900_001, None), (900_002, ""), (900_003, "x"), (900_004, "word " * 30_000), (900_005, "y" * 60_000), (900_006, "  \n\t \n"), (900_006, "  \n\t \n")]


@pytest.fixture(scope="module")
def docs(spark):
    """Documents with odd rows, repeated rows and columns whose names clash with those of the operators."""
    d = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(i, t, None, None, None) for i, t in ODD], d.schema)
    more = d.union(odd).union(d.limit(3))
    for c in ("score", "size", "key", "node", "n", "bucket", "copies", "kept", "lang_pred", "length", "held_out", "pattern"):
        more = more.withColumn(c, F.lit("clash"))
    return more.cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


PATTERNS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def luhn(digits):
    return sum((v := int(c) * (1 + i % 2)) - 9 * (v > 9) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for k, (name, p) in enumerate(PATTERNS):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".") if name == "ip"), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[name]
            if ok:
                out.append((m.start(), k, m.end(), name))
    return ",".join(f"{n}:{a}:{z}" for a, _, z, n in sorted(out))


HARD = ["a@b.c%d@e.f x@@y.z a@b@c.d", "1" * 3000 + " 4111 1111 1111 1111-4111", "é😀 +1 (017) 555-7713 1.2.3.4.5.6.7.8 256.1.1.1 0255.1.1.1 😀a@b.co", "a@b" + ".c" * 20000, "+1" + " " * 50000 + "2", "4111-1111-1111-1111.+49 30 1234567"]


def test_pii_base_spans(spark, docs, rows):
    hard = spark.createDataFrame([(950_000 + i, t) for i, t in enumerate(HARD)], "doc_id long, text string")
    found = pii.find(docs.select("doc_id", "text").union(hard)).collect()
    texts = dict(rows) | {950_000 + i: t for i, t in enumerate(HARD)}
    assert len(found) == len(rows) + len(HARD)
    for r in found:
        want = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), r.doc_id
        assert {*filter(None, want.split(","))} <= {*r.spans.split(",")}
        assert r.n_email + r.n_ip + r.n_card + r.n_phone == len([x for x in want.split(",") if x])


def test_pii_adds_and_redacts(spark, empty):
    x = spark.createDataFrame([(1, 'key: token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" end'), (2, "write a@b.co or +1 (017) 555-7713 now"), (3, "plain words at home. Nothing in 2020 to 2021."), (4, None)], "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.redact(x).collect()}
    assert out == {1: 'key: token = "[SECRET]" end', 2: "write [EMAIL] or [PHONE] now", 3: "plain words at home. Nothing in 2020 to 2021.", 4: None}
    assert pii.find(empty).count() == 0 and pii.redact(empty).columns == empty.columns


def test_line_quality_figures(docs, rows, empty):
    found = line_quality.clean_lines(docs).collect()
    texts = collections.defaultdict(set)
    for i, t in rows:
        texts[i].add(t)
    assert len(found) == len(rows)
    for r in found:
        (t,) = texts[r.doc_id]
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        twice = collections.Counter(grams)
        covered = {i + j for i, g in enumerate(grams) if twice[g] > 1 for j in range(3)}
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len({*lines}), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    assert line_quality.clean_lines(empty).count() == 0


def test_line_quality_keeps_good_documents(spark):
    d, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    j = line_quality.clean_lines(d, with_text=False).join(labels, "doc_id").filter("not base_failed").collect()
    assert all(r.kept for r in j if r.quality == 1)
    assert sum(r.kept for r in j if r.quality == 0) <= 0.1 * max(1, sum(r.quality == 0 for r in j))


def test_warc_round_trip(spark):
    p = spark.read.parquet(f"{SF}/pages.parquet")
    p = p.union(p.select(F.col("page_id") + 1000, "url", "html").filter("page_id % 3 = 0")).union(spark.createDataFrame([(5000, None, None), (5001, "a b\n", "")], p.schema)).withColumn("payload", F.lit(1))
    rows = p.select("page_id", "html").collect()
    most = {}
    for r in rows:
        most[r.html or ""] = max(most.get(r.html or "", -1), r.page_id)
    for compressed in (True, False):
        got = {r.page_id: tuple(r) for r in warc.round_trip(p, compressed=compressed).collect()}
        assert len(got) == len(rows)
        for r in rows:
            x, keeper = (r.html or "").encode(), most[r.html or ""]
            first = keeper == r.page_id
            assert got[r.page_id] == (r.page_id, len(x), base64.b32encode(hashlib.sha1(x).digest()).decode(), "response" if first else "revisit", None if first else keeper)
    assert all(r.record_type == "response" for r in warc.round_trip(p, min_bytes=1 << 40).collect())
    with pytest.raises(Exception, match="PATH_NOT_FOUND|UNABLE|does not exist"):
        warc.read_archives(spark, "/tmp/none-here").count()


@pytest.mark.parametrize("compressed", [True, False])
def test_warc_salvage(compressed):
    records = [warc.record(i, f"http://x/{i}", os.urandom(50).hex().encode() * (i + 1), None, "2000-01-01T00:00:00Z") for i in range(40)]
    made = [warc.member(r, 5) if compressed else r for r in records]
    data = bytearray(b"".join(made))
    start = [sum(map(len, made[:i])) for i in range(41)]
    for hit in (0, 17, 39):
        data[start[hit + 1] - 12] ^= 0xFF
    del data[start[25] + 30 : start[25] + 60]
    got = list(warc.salvage(bytes(data)))
    pages = [warc._page(r[b"warc-record-id"]) for _, _, r, _ in got if r]
    assert pages == [i for i in range(40) if i not in (0, 17, 25, 39)]
    gaps = [(a, n) for a, n, r, _ in got if r is None]
    assert [a for a, _ in gaps] == [0, start[17], start[25], start[39] - 30]
    assert sum(n for _, n, _, _ in got) == len(data)
    assert not list(warc.salvage(b"")) and [x[2:] for x in warc.salvage(b"junk")] == [(None, "version")]
    cut = bytes(data)[:-5]
    assert list(warc.salvage(cut))[-1][2] is None


def brute_top(ids, x, k):
    out = {}
    for i in np.flatnonzero(ids % 50 == 0):
        s = (x @ x[i]).astype(np.int64)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(n + 1, int(ids[j]), int(s[j])) for n, j in enumerate(order)]
    return out


@pytest.mark.parametrize("block_rows", [64, 8192])
def test_top_k_exact(spark, block_rows):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    hot = spark.createDataFrame([(5000 + i, [0.5] * 64) for i in range(120)] + [(9050, None), (9100, [float("nan")] * 64), (9150, [None] * 64), (9200, [float("inf")] * 64), (None, [1.0] * 64)], e.schema)
    r = e.union(hot).withColumn("block", F.lit(1))
    rows = [x for x in r.collect() if x.vec_id is not None and x.embedding and all(v is not None and math.isfinite(v) for v in x.embedding)]
    want = brute_top(np.array([x.vec_id for x in rows]), np.floor(256 * np.array([x.embedding for x in rows], float)), 5)
    got = {}
    for x in cover_tree.top_k(r.union(r.filter("vec_id = 50")), block_rows=block_rows).collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.vec_id, x.score))
    assert {q: sorted(v) for q, v in got.items()} == want
    assert cover_tree.top_k(r.limit(0)).count() == 0
    two = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(x) for x in cover_tree.top_k(two).collect()] == [(0, 1, 1, 131072)]
    wide = spark.createDataFrame([(0, [3e5, 1.0]), (1, [3e5, 2.0]), (2, [3e5, -1.0])], "vec_id long, embedding array<double>")
    assert [x.vec_id for x in cover_tree.top_k(wide).orderBy("rank").collect()] == [1, 2]


def test_token_counts(spark, docs, rows, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    hard = ["á ́b <|endoftext|>x <|startoftext|> <|end oftext|> <|ENDOFTEXT|>.", "　ab cd'S don't I'LL ' s  's!!", "ΑΣ ΑΣΑ İI ǅ É,É.", "x" * 5000 + ", " + "1" * 50 + "\x1c\x1d y", "a\ǹb <|endoftext|>!? a.b,c d'll,"]
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(960_000 + i, x) for i, x in enumerate(hard)], "doc_id long, text string"))
    texts = dict(rows) | {960_000 + i: x for i, x in enumerate(hard)}
    for r in token_counts.count_tokens(more, path, limit=100).collect():
        x = texts[r.doc_id] or ""
        n = len(t.encode(x, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(x.encode()), n, n > 100), r.doc_id
    assert token_counts.count_tokens(empty, path).count() == 0
    with pytest.raises(ValueError, match="word ends"):
        token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))


def test_mixing_targets(docs, rows, empty):
    found = mixing.mix_documents(docs).collect()
    words = {i: len((t or "").encode().split()) for i, t in rows}
    assert len(found) == len(rows) and all(r.size == words[r.doc_id] and r.taken <= 3 * r.size for r in found)
    by = collections.defaultdict(list)
    for r in found:
        by[r.source].append(r)
    total = sum(r.size for r in found)
    assert abs(sum(v[0].target for v in by.values()) - min(total, 3 * total)) < 1e-6 * total
    for v in by.values():
        assert v[0].source_size == sum(r.size for r in v)
        assert abs(sum(r.taken for r in v) - v[0].target) <= 0.5 * max(r.size for r in v)
    again = mixing.mix_documents(docs.repartition(7)).collect()
    assert collections.Counter((r.doc_id, r.taken) for r in found) == collections.Counter((r.doc_id, r.taken) for r in again)
    assert mixing.mix_documents(empty).count() == 0


def test_near_duplicates_against_brute_force(docs, rows, empty):
    def grams(t):
        w = (t or "").encode().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    first = {}
    for i, t in rows:
        first.setdefault(i, grams(t))
    ids, root = sorted(first), {i: i for i in first}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    where = collections.defaultdict(list)
    for i in ids:
        shared = collections.Counter(j for g in first[i] for j in where[g])
        for j, n in shared.items():
            if n >= 0.8 * (len(first[i]) + len(first[j]) - n):
                a, b = sorted((top(i), top(j)))
                root[b] = a
        for g in first[i]:
            where[g].append(i)
    found = near_duplicates.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    assert {r.doc_id: r.class_id for r in found} == {i: top(i) for i in ids}
    kept = near_duplicates.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(i for i in ids if top(i) == i)
    assert near_duplicates.near_duplicates(empty).count() == 0


def test_near_duplicates_of_a_large_group(spark):
    """Copies of one text with edits: classes are those of all pairs at 0.8, though no pairs are made."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(150):
        w = base.copy()
        for p in rng.choice(120, size=int(rng.integers(0, 7)), replace=False):
            w[p] = f"e{i}_{p}"
        texts.append(" ".join(w))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(116)} for t in texts]
    root = list(range(150))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(150):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n >= 0.8 * (232 - n):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_duplicates.near_duplicates(d).collect()} == {i: top(i) for i in range(150)}


def test_prob_minhash_estimates():
    rng = np.random.default_rng(1)
    a, b = np.arange(0, 900, dtype=np.uint64) * np.uint64(7919), np.arange(100, 1000, dtype=np.uint64) * np.uint64(7919)
    weight = rng.uniform(1, 3, 1000)
    row = np.repeat([0, 1], 900)
    s = near_duplicates.prob_minhash(row, near_duplicates.mix(np.concatenate((a, b))), np.concatenate((weight[:900], weight[100:])), 2, 4000)
    x, y = np.zeros(1000), np.zeros(1000)
    x[:900], y[100:] = weight[:900], weight[100:]
    want = sum(1 / np.maximum(x / x[i], y / y[i]).sum() for i in range(100, 900))
    assert abs((s[0] == s[1]).mean() - want) < 0.03


def test_packing(docs, rows, empty):
    found = packing.pack_documents(docs, buckets=8, token_budget=5000).collect()
    words = {i: len((t or "").encode().split()) for i, t in rows}
    assert len(found) == len(rows) and all(r.length == words[r.doc_id] <= r.bucket_length for r in found)
    batches = collections.defaultdict(list)
    for r in found:
        batches[r.batch_id].append(r)
    for v in batches.values():
        assert len({r.bucket for r in v}) == 1 and len({r.slot for r in v}) == len(v)
        assert len(v) == 1 or len(v) * v[0].bucket_length <= 5000
    assert packing.pack_documents(empty).count() == 0


def test_packing_boundaries_are_optimal():
    from itertools import combinations

    rng = np.random.default_rng(2)
    lengths = np.sort(rng.integers(1, 40, 60))
    values, count = np.unique(lengths, return_counts=True)

    def waste(ends):
        return sum(next(e for e in ends if e >= n) - n for n in lengths.tolist())

    for k in (1, 2, 3):
        ends = packing.boundaries(count, count * values, values, k)
        assert waste(ends) == min(waste(sorted((*c, values[-1]))) for c in combinations(values[:-1].tolist(), min(k, len(values)) - 1))


def test_language_id(spark, docs, empty):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = language_id.identify(d).join(d.select("doc_id", "lang"), "doc_id").collect()
    assert len(r) == d.count() and all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in r)
    held = [x for x in r if x.held_out]
    assert sum(x.lang == x.lang_pred for x in held) >= 0.97 * len(held) and all(0 <= x.score <= 1 for x in r)
    odd = {x.doc_id: x for x in language_id.identify(docs).filter("doc_id > 900000").collect()}
    assert [(odd[i].lang_pred, odd[i].score) for i in (900_001, 900_002, 900_006)] == [("und", 0.0)] * 3
    assert language_id.identify(empty).count() == 0
    assert {x.lang_pred for x in language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id in (900001, 900002, 900006)").count() == 0


def test_languages_with_few_lettered_rows_are_learnt(spark):
    words = [f"l{i:02}" for i in range(60)]
    word = lambda n: "".join(chr(97 + int(c)) for c in str(n))
    rows = [(3 * i + k, " ".join(word(n) for n in range(i * 1000 + k, i * 1000 + k + 40)), lang) for i, lang in enumerate(words) for k in range(3)]
    rows += [(1000 + i, "123 456 " * (i % 7), "zz") for i in range(300)] + [(2000, "zuzu zaza zozo " * 20, "zz")]
    model = language_id.fit(spark.createDataFrame(rows, "key long, text string, lang string"))
    assert {x for langs in model.members.values() for x in langs} == {*words, "zz"}


def test_the_sample_is_bounded_by_rows(spark, monkeypatch):
    rows = [(7, f"text number {language_id.np.base_repr(i, 36)} of one id", "de") for i in range(5000)] + [(8, "the very same words", "en")] * 3000 + [(100 + i, "more words of english here", "en") for i in range(10)]
    seen = []
    monkeypatch.setattr(language_id, "svm", lambda x, y: seen.append(len(x)) or np.zeros(language_id.BINS + 1, np.float32))
    language_id.fit(spark.createDataFrame(rows, "key long, text string, lang string"), max_train_rows=2400)
    assert max(seen) == 1200 + 11  # of `de` its share, of `en` its different rows


def test_pipeline_stages(spark, docs, empty):
    import corpus_pipeline
    from corvane.llm.common import written

    for start in (docs, empty):
        now = start
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = written(stage(spark, now, SF), name)
            if k + 1 < len(corpus_pipeline.STAGES):
                assert out.columns == start.columns
            if k == 1:
                assert out.count() == out.select("doc_id").distinct().count()
            if k == 2:
                assert all(base_spans(r.text) == "" for r in out.select("text").collect())
            now = out
        assert (now.count() > 0) == (start is docs)


def test_pipeline_run(spark):
    import corpus_pipeline
    from corvane import shared
    from corvane.llm import common

    before = common.marked()
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "length", "bucket", "bucket_length", "batch_id", "slot"] and out.count() > 0
    left = shared._PATHS[before:]
    assert len(left) <= 3 and all(os.path.isdir(p) for p in left)
    common.release(spark, before)
    assert not any(os.path.exists(p) for p in left)
