"""Tokenizer columns: calls of bounded size, whole results."""

import os

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corvane.functions import tokens as tk


def test_calls_hold_a_budget():
    assert list(tk.spans(np.array([3, 3, 9, 0, 1, 20, 1]), 6)) == [(0, 2), (2, 3), (3, 5), (5, 6), (6, 7)]
    assert list(tk.spans(np.array([], int), 6)) == []


def test_texts_over_several_calls_come_back(spark):
    d = spark.createDataFrame([(i, None if i == 3 else "" if i == 4 else f"über text {i} \U0001f600 " * (60_000 if i < 3 else 5)) for i in range(40)], "i long, text string").coalesce(1)
    encode, decode = tk.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    got = d.select("i", F.size(encode("text")).alias("n"), decode(encode("text")).alias("back"), "text").collect()
    assert all(r.back == (r.text or "") and (r.n > 0) == bool(r.text) for r in got) and len(got) == 40


def test_calls_stay_in_the_cores_of_their_task(spark, monkeypatch):
    texts = [None, "", "plain words", "  \u00a0 spaces\t\n", "über \U0001f600 漢字", "a<|endoftext|>b", "word " * 3000]
    d = spark.createDataFrame(list(enumerate(texts)), "i long, text string").coalesce(1)
    encode, decode = tk.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    got = sorted(d.select("i", encode("text").alias("ids"), decode(encode("text")).alias("back")).collect())
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert [r.ids for r in got] == [whole.encode(x or "", add_special_tokens=False).ids for x in texts]
    assert [r.back for r in got] == ["", "", "plain words", "  \u00a0 spaces\t\n", "über \U0001f600 漢字", "ab", "word " * 3000]
    monkeypatch.delenv("TOKENIZERS_PARALLELISM", raising=False)
    (ids,) = encode.func(iter([pa.array(["plain words", None])]))  # as in a worker
    assert ids.to_pylist() == [got[2].ids, []] and os.environ["TOKENIZERS_PARALLELISM"] == "false"


def test_decoding_skips_null_lists(spark):
    _, decode = tk.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    d = spark.createDataFrame([(0, None), (1, [64]), (2, []), (3, None), (4, [65, 66])], "i long, ids array<int>").coalesce(1)
    assert [r.back for r in d.select("i", decode("ids").alias("back")).orderBy("i").collect()] == ["", "a", "", "", "bc"]
