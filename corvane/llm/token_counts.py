"""Token counts: batch encoding inside Arrow functions, lengths only.

A text is cut at ASCII white space, where a lower-casing tokenizer with word ends can always be cut: its pre-tokenizer drops
white space, no token and no special string holds any, and Unicode composition never crosses it. Marks that end a piece are cut
off too, as the pre-tokenizer parts them from letters and digits. The distinct pieces of an Arrow batch are encoded in calls of
about equal bytes, and each text's count is the sum over its pieces. Ids never leave the worker. A file of another kind is an
error, as its texts could not be cut there.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows are counted each; columns besides the id and the
text are ignored, so their names cannot clash.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import batch_groups, slices, split_words, sums

_LOADED: dict[str, tuple] = {}
#: Marks that may be cut from the end of a piece; quotes and angle brackets stay, which contractions and special strings need.
MARKS = ",.;:!?#$%&*"
#: Pieces whose lengths a worker remembers at most.
REMEMBERED = 300_000


def check_kind(path: str) -> None:
    """Raises unless the file's tokenizer lower-cases, drops white space, ends words, and has only special strings with a <| in them."""
    with open(path, encoding="utf-8") as f:
        t = json.load(f)
    steps = lambda x, name: x.get(name) or [x] if x else []
    lowers = any(x["type"] == "Lowercase" for x in steps(t["normalizer"], "normalizers"))
    first = next(iter(steps(t["pre_tokenizer"], "pretokenizers")), {})
    drops = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert")
    strings = [x["content"] for x in t["added_tokens"]]
    if not (lowers and drops and t["model"].get("end_of_word_suffix") and all("<|" in x and not any(c.isspace() for c in x) for x in strings)):
        raise ValueError(f"{path}: texts can be cut at white space only for a lower-casing tokenizer with word ends")


def tokenizer(path: str) -> tuple:
    """The tokenizer of a file and the remembered lengths, once per worker."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _LOADED[path] = (t, {})
    return _LOADED[path]


def lengths(path: str, pieces: list[str], call_bytes: int) -> np.ndarray:
    """Tokens of each of some distinct pieces; those not remembered are encoded, the calls balanced by bytes."""
    t, known = tokenizer(path)
    if len(known) > REMEMBERED:
        known.clear()
    stems = [p.rstrip(MARKS) for p in pieces]
    cut = [s if s[-1:].isalnum() and s[-1:].isascii() else p for s, p in zip(stems, pieces, strict=True)]
    tails = [p[len(s) :] for s, p in zip(cut, pieces, strict=True)]
    new = sorted({*cut, *tails} - {""} - known.keys(), key=len)
    for a, b in batch_groups(np.fromiter((len(p.encode()) for p in new), np.int64, len(new)), call_bytes):
        for p, e in zip(new[a:b], t.encode_batch_fast(new[a:b], add_special_tokens=False), strict=True):
            known[p] = len(e)
    known[""] = 0
    return np.fromiter((known[s] + known[x] for s, x in zip(cut, tails, strict=True)), np.int64, len(pieces))


def count_tokens(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, call_bytes: int = 1 << 18) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row. path: a tokenizers .json file (see check_kind) that is present on driver and workers."""
    check_kind(path)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1, 16 << 20):
            # ASCII case is the tokenizer's to drop, but special strings are matched before it drops it
            text = pc.if_else(pc.match_substring(b.column(1), "<|"), b.column(1), pc.ascii_lower(b.column(1)))
            flat, ends = split_words(text)
            coded = flat.dictionary_encode()
            each = lengths(path, coded.dictionary.to_pylist(), call_bytes)
            n = sums(each[np.asarray(coded.indices)] if len(flat) else np.zeros(0, np.int64), ends)
            yield pa.RecordBatch.from_arrays([b.column(0), pc.cast(pc.binary_length(b.column(1)), pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
