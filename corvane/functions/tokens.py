"""Token rules as Column expressions: the rule for no tokenizer, its variants, limits, truncation and prices."""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prices in USD (fixed values): per 1k tokens of embedding models, per 1M input tokens of language models.
EMBEDDING_PRICE = {"text-embedding-3-small": 0.00002, "text-embedding-3-large": 0.00013, "text-embedding-ada-002": 0.0001}
MODEL_PRICE = {"gpt-4.1": 2.00, "gpt-4.1-mini": 0.40, "gpt-4.1-nano": 0.10}
#: Encodings by prefix of the model's name (fixed values), longest prefixes first; others have the default.
ENCODINGS = {"gpt-4o": "o200k_base", "gpt-4": "cl100k_base", "gpt-3.5-turbo": "cl100k_base", "text-embedding": "cl100k_base", "text-davinci": "p50k_base"}
DEFAULT_ENCODING = "cl100k_base"
#: Bytes of text that a call of a tokenizer gets.
CALL_BYTES = 1 << 20


def token_count(text: Column) -> Column:
    """0 for null or empty, else a quarter of the characters and 1 at least."""
    n = F.length(text)
    return F.when(text.isNull() | (n == 0), F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(n / 4).cast("int")))


def token_count_or_null(text: Column) -> Column:
    """As token_count, but null for null or empty text."""
    return F.nullif(token_count(text), F.lit(0))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters; 0 below four."""
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / 4).cast("int")


def within_limit(text: Column, limit: int) -> Column:
    return token_estimate(text) <= limit


def valid_token_limit(n: Column) -> Column:
    return n.between(0, 1_000_000)


def truncate_to_tokens(text: Column, n: int) -> Column:
    return F.substring(text, 1, 4 * n)


def spans(sizes: np.ndarray, budget: int) -> Iterator[tuple[int, int]]:
    """(start, stop) of consecutive rows that hold budget together; a larger row comes alone."""
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and held + n > budget:
            yield start, i
            start, held = i, 0
        held += n
    if len(sizes) > start:
        yield start, len(sizes)


def encoder(path: str | None = None):
    """(encode, decode): Column functions from text to array<int> and back, by a tokenizers .json file.

    Without a file there is no tokenizer: encoding gives an empty array and decoding an empty text.
    """
    if path is None:
        return (lambda text: F.array().cast("array<int>")), (lambda ids: F.lit(""))

    def loaded():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # its threads would take the cores of other tasks, and cost more CPU in all
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path)

    # a call's encodings hold many times its text, so calls get a few MB and only ids are kept, in Arrow
    @F.arrow_udf("array<int>")
    def encode(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        t = loaded()
        for s in parts:
            lists = [pa.array([], pa.list_(pa.int32()))]
            for a, b in spans(pc.fill_null(pc.binary_length(s), 0).to_numpy(zero_copy_only=False), CALL_BYTES):
                lists.append(pa.array([e.ids for e in t.encode_batch_fast(s.slice(a, b - a).fill_null("").to_pylist(), add_special_tokens=False)], pa.list_(pa.int32())))
            yield pa.concat_arrays(lists)

    @F.arrow_udf("string")
    def decode(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        t = loaded()
        for s in parts:
            texts, sizes = [pa.array([], pa.string())], pc.fill_null(pc.list_value_length(s), 0).to_numpy(zero_copy_only=False)
            for a, b in spans(sizes, CALL_BYTES // 4):
                ids = s.slice(a, b - a).flatten().to_numpy(zero_copy_only=False)  # numpy hands numbers to Python faster than Arrow
                lists = [ids[i:j].tolist() for i, j in pairwise([0, *sizes[a:b].cumsum().tolist()])]
                texts.append(pa.array(t.decode_batch(lists, skip_special_tokens=True), pa.string()))
            yield pa.concat_arrays(texts)

    return encode, decode


def truncated_by(encode, decode, text: Column, n: int) -> Column:
    """The text of the first n tokens."""
    return decode(F.slice(encode(text), 1, n))


def encoding_of(model: Column) -> Column:
    out = F.lit(DEFAULT_ENCODING)
    for prefix, name in reversed(ENCODINGS.items()):
        out = F.when(F.startswith(model, F.lit(prefix)), F.lit(name)).otherwise(out)
    return out
