"""Simple-8b words, and token files against the tokenizer on whole texts."""

import json
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.llm import token_files
from corvane.llm.simple8b import BLOCK, BITS, COUNTS, pack, unpack
from tests.conftest import SF

PATH = public_tokenizers.path("byte_bpe_50k.json")


@given(st.lists(st.tuples(st.integers(1, 200), st.sampled_from([0, 1, 5, 1000, 40_000, 1 << 20, (1 << 60) - 1, 1 << 60, (1 << 64) - 1])), max_size=40))
@settings(max_examples=80, deadline=None)
def test_words_round_trip(runs):
    x = np.array([v for n, v in runs for _ in range(n)], np.uint64)
    words, starts, escapes, first = pack(x)
    assert (unpack(words, starts, escapes, first, len(x)) == x).all()
    assert len(starts) == -(-len(x) // BLOCK)
    assert (words >> np.uint64(60) > 0).all() or len(escapes)
    for k in range(len(starts)):  # a block is read from its own offsets alone
        stop, last = (starts[k + 1], first[k + 1]) if k + 1 < len(starts) else (len(words), len(escapes))
        n = min(BLOCK, len(x) - k * BLOCK)
        assert (unpack(words[starts[k] : stop], np.zeros(1, np.int64), escapes[first[k] : last], np.zeros(1, np.int64), n) == x[k * BLOCK : k * BLOCK + n]).all()


def test_greedy_words():
    x = np.arange(5000, dtype=np.uint64) % 700
    words, starts, _, _ = pack(x)
    at, seen = 0, []
    while at < len(x):  # the most numbers that fit, one word after the other
        end = min(len(x), (at // BLOCK + 1) * BLOCK)
        at += max(int(n) for n, b in zip(COUNTS[1:], BITS[1:], strict=True) if all(int(v).bit_length() <= b for v in x[at : min(at + n, end)]))
        at = min(at, end)
        seen.append(at)
    assert len(words) == len(seen)


ALPHABET = st.sampled_from(list("ab'sS.,!?$&(/)<|>1 2\n\t\r\x0b\x0c\x1c\x85\xa0     　éß日̀😀") + ["<|endoftext|>", "  ", "\n\n", "don't ", "it's", " ,", "it'll", "à "])


@given(st.lists(st.lists(ALPHABET, max_size=25).map("".join), max_size=6))
@settings(max_examples=400, deadline=None)
def test_pieces_give_the_ids_of_whole_texts(texts):
    t = token_files.pieces_of(PATH).tokenizer
    padded = pa.array(["skip me", *texts, "end"], pa.string()).slice(1, len(texts))
    ids, ends = token_files.encode(PATH, padded)
    want = [t.encode(x, add_special_tokens=False).ids + [0] for x in texts]
    assert [ids[a:b].tolist() for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)] == want


ODD = [(900_001, None), (900_002, ""), (900_003, "x"), (900_004, "word " * 30_000), (900_005, "y" * 60_000), (900_006, "  \n\t \n"), (900_006, "  \n\t \n"), (None, "null id"), (None, None), (None, "other"), (5, "again"), (900_007, "a<|endoftext|>b <|endoftext|>"), (-3, "negative")]


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    out = d.union(spark.createDataFrame([(i, t, None, None, None) for i, t in ODD], d.schema)).union(d.limit(3))
    for c in ("segment", "shard", "value", "digest", "place", "start", "ids"):
        out = out.withColumn(c, F.lit("clash"))
    return out.cache()


def brute(rows):
    import hashlib

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    out, start = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest())):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"file_bytes": 20_000, "segment_ids": 500}, {"file_bytes": 1 << 30, "segment_ids": 1}])
def test_files_against_whole_texts(docs, options):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in token_files.round_trip(docs, PATH, **options).collect()), key=str) == brute(rows)


def test_ids_come_back(spark, docs, tmp_path):
    token_files.write_tokens(docs, str(tmp_path / "t"), PATH, file_bytes=100_000)
    t = token_files.pieces_of(PATH).tokenizer
    rows = {(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()}
    got = {(r.doc_id, tuple(r.ids)) for r in token_files.read_tokens(spark, str(tmp_path / "t"), with_ids=True).collect()}
    assert got == {(i, (*t.encode(x, add_special_tokens=False).ids, 0)) for i, x in rows}


def test_empty_table(docs):
    assert token_files.round_trip(docs.limit(0), PATH).collect() == []
    assert [tuple(r) for r in token_files.round_trip(docs.limit(0).union(docs.filter("doc_id = 900002")), PATH).collect()] == [(900_002, 0, 1, zlib.crc32(b"\0" * 4))]


def test_damage_is_noticed():
    ids = np.arange(3000, dtype=np.uint32)
    whole = bytearray(token_files.segment(3, [1, None], np.array([1000, 2000]), ids) + token_files.END)
    (shard, doc_ids, null, ends, back), = token_files.segments(memoryview(bytes(whole)))
    assert (shard, doc_ids[0], null.tolist(), ends.tolist()) == (3, 1, [False, True], [1000, 3000]) and (back == ids).all()
    for at in (0, 70, 400, len(whole) - 1):
        bad = bytearray(whole)
        bad[at] ^= 1
        with pytest.raises(ValueError, match="segment"):
            list(token_files.segments(memoryview(bytes(bad))))
    with pytest.raises(ValueError, match="no whole segment"):
        list(token_files.segments(memoryview(bytes(whole[:-40]))))


def test_other_kinds_of_file(tmp_path):
    with pytest.raises(ValueError, match="byte-level"):
        token_files.check_kind(public_tokenizers.path("word_bpe_49k.json"))
    with open(PATH, encoding="utf-8") as f:
        t = json.load(f)
    t["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "t.json").write_text(json.dumps(t))
    with pytest.raises(ValueError, match="byte-level"):
        token_files.check_kind(str(tmp_path / "t.json"))
