"""Helpers that the training-data operators share: words, shared tables and file sizes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.shared import marked, new_path, release, shared_dir, written  # noqa: F401  handed on to the operators

#: A word is a run of characters other than space, \t, \n, \v, \f and \r.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


def word_count(text: Column) -> Column:
    """Words of a text as a long; null counts as empty. JVM side: each word becomes one letter, and white space that is left goes."""
    once = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", "x")
    return F.length(F.translate(once, " \t\n\x0b\x0c\r", "")).cast("long")


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a batch of texts, one after the other, and for each text the offset of its first word (and a last offset)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    parts = pc.ascii_split_whitespace(texts)
    flat, ends = parts.flatten(), np.asarray(parts.offsets, dtype=np.int64)
    ends = ends - ends[0]
    full = np.asarray(pc.greater(pc.binary_length(flat), 0))
    if not full.all():
        flat = flat.filter(pa.array(full))
        ends = np.concatenate(([0], np.cumsum(full)))[ends]
    return flat, ends


def sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of values[ends[i]:ends[i + 1]] for each i."""
    out = np.zeros(len(ends) - 1, values.dtype)
    full = ends[1:] > ends[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, ends[:-1][full])
    return out


def batch_groups(sizes: np.ndarray, budget: int) -> list[tuple[int, int]]:
    """Consecutive ranges whose sizes add up to the budget at most; a larger item is a range of its own."""
    ranges, start, held = [], 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and held + n > budget:
            ranges.append((start, i))
            start, held = i, 0
        held += n
    if len(sizes) > start:
        ranges.append((start, len(sizes)))
    return ranges


_LEAN: list[bool] = []


def lean() -> None:
    """Once per worker: freed memory goes back to the system, as workers stay alive between stages and share an executor's memory."""
    if not _LEAN:
        _LEAN.append(True)
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            libc = ctypes.CDLL("libc.so.6")
            libc.mallopt(-3, 16 << 20)  # M_MMAP_THRESHOLD: blocks over 16 MB are mapped, and unmapped when freed
            libc.mallopt(-1, 64 << 20)  # M_TRIM_THRESHOLD: so much stays at hand for the smaller ones
        except OSError:  # another C library: its own rules hold
            pass


def slices(batches: Iterator[pa.RecordBatch], column: int, budget: int = 6 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches, as many at a time as hold budget bytes of text; a longer text is a batch of its own. This bounds a worker's memory."""
    lean()
    for b in batches:
        for i, j in batch_groups(np.asarray(pc.fill_null(pc.binary_length(b.column(column)), 0)), budget):
            yield b.slice(i, j - i)


def hinted(kept: DataFrame, most_rows: int) -> DataFrame:
    """A written table, counted; hinted for broadcast only if it has most_rows at most, else joined by shuffle."""
    return F.broadcast(kept) if kept.count() <= most_rows else kept


def small_side(df: DataFrame, most_rows: int) -> DataFrame:
    """df, written and hinted."""
    return hinted(written(df, "side"), most_rows)
