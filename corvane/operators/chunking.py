"""Chunkers: tables of pieces of each text.

The chunkers whose next boundary depends on the last are small generators over one text, run per row in Arrow batches by
``chunked``; the others are Column expressions. Offsets are code points, half open.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.functions.tokens import spans, token_count

Piece = tuple[str, int, int]
CHUNKS = "chunk_no int, text string, start_idx int, end_idx int, token_count int"


def tokens(text: str) -> int:
    return max(1, len(text) // 4) if text else 0


@dataclass(frozen=True)
class FixedLength:
    """Chunks of length_tokens, ending at a sentence's end where one is near, overlapping by overlap_tokens."""

    length_tokens: int = 512
    overlap_tokens: int = 64
    tolerance: int = 20
    reach: int = 200
    near: int = 100

    def __post_init__(self):
        if not 0 <= self.overlap_tokens < self.length_tokens:
            raise ValueError("overlap must be at least 0 and below the length")

    def __call__(self, text: str) -> Iterator[Piece]:
        start, n = 0, len(text)
        while start < n:
            end = min(n, start + 4 * self.length_tokens + 3)  # the longest piece within the token rule
            if end < n:
                end = self._at_sentence(text, start, end)
            piece = text[start:end].strip()
            if piece:
                yield piece, start, end
            if end >= n:
                return
            overlap = min(4 * self.overlap_tokens, (end - start) // 2)
            start = max(start + 1, end - overlap)

    def _at_sentence(self, text: str, start: int, end: int) -> int:
        ends = [m.end() for m in re.finditer(r"[.!?]+\s+", text[max(start, end - self.reach) : end + self.reach])]
        near = [e + max(start, end - self.reach) for e in ends]
        near = [e for e in near if abs(e - end) <= self.near and start < e and tokens(text[start:e]) <= self.length_tokens and self.length_tokens - tokens(text[start:e]) <= self.tolerance]
        return min(near, key=lambda e: (abs(e - end), e), default=end)


@dataclass(frozen=True)
class CharWindow:
    """Windows of 4 * max_tokens characters, cut after the last full stop in them, else one character after; the next starts 4 * overlap before."""

    max_tokens: int = 8000
    overlap: int = 200

    def __call__(self, text: str) -> Iterator[Piece]:
        most, start = 4 * self.max_tokens, 0
        while start < len(text):
            if len(text) - start <= most:
                yield text[start:], start, len(text)
                return
            dot = text.rfind(".", start, start + most)
            end = (dot if dot >= start else start + most) + 1
            yield text[start:end], start, end
            start = max(start + 1, end - 4 * self.overlap)


@dataclass(frozen=True)
class LongText:
    """Pieces of max_length characters, ended at a space when the last one is past half of the piece."""

    max_length: int
    overlap: int = 0

    def __call__(self, text: str) -> Iterator[Piece]:
        start = 0
        while start < len(text):
            end = min(len(text), start + self.max_length)
            if end < len(text) and (gap := text.rfind(" ", start, end)) > start + self.max_length // 2:
                end = gap
            if piece := text[start:end].strip():
                yield piece, start, end
            if end >= len(text):
                return
            start = max(start + 1, end - self.overlap)


@dataclass(frozen=True)
class SentencePack:
    """Sentences packed up to max_tokens; the next chunk begins with the last overlap_sentences of the one before."""

    max_tokens: int = 512
    overlap_sentences: int = 50

    def __call__(self, text: str) -> Iterator[Piece]:
        held: list[Piece] = []
        fresh = False
        for s in sentence_spans(text):
            if fresh and sum(tokens(x[0]) for x in held) + tokens(s[0]) > self.max_tokens:
                yield " ".join(x[0] for x in held), held[0][1], held[-1][2]
                held, fresh = held[-self.overlap_sentences :] if self.overlap_sentences else [], False
                while held and sum(tokens(x[0]) for x in held) + tokens(s[0]) > self.max_tokens:
                    held.pop(0)
            held.append(s)
            fresh = True
        if fresh:
            yield " ".join(x[0] for x in held), held[0][1], held[-1][2]


def sentence_spans(text: str) -> list[Piece]:
    out, at = [], 0
    for s in re.split(r"(?<=[.!?])\s+", text):
        s = s.strip()
        if s:
            at = text.index(s, at)
            out.append((s, at, at + len(s)))
            at += len(s)
    return out


@dataclass(frozen=True)
class Semantic:
    """Runs of sentences near their running mean vector; runs below min_tokens are dropped (a lone sentence is not)."""

    embed: Callable[[list[str]], list]
    threshold: float = 0.92
    max_tokens: int = 1024
    min_tokens: int = 50

    def __call__(self, text: str) -> Iterator[Piece]:
        import numpy as np

        spans = sentence_spans(text)
        if len(spans) <= 1:
            yield from spans
            return
        vectors = np.asarray(self.embed([s[0] for s in spans]), float)
        held, mean = [0], vectors[0]

        def piece() -> Piece:
            return " ".join(spans[i][0] for i in held), spans[held[0]][1], spans[held[-1]][2]

        for i in range(1, len(spans)):
            size = float(np.linalg.norm(vectors[i]) * np.linalg.norm(mean))
            near = float(vectors[i] @ mean) / size if size else 0.0
            if near < self.threshold or tokens(piece()[0] + " " + spans[i][0]) > self.max_tokens:
                if tokens(piece()[0]) >= self.min_tokens:
                    yield piece()
                held = []
            held.append(i)
            mean = vectors[held].mean(axis=0)
        if held and tokens(piece()[0]) >= self.min_tokens:
            yield piece()


@dataclass(frozen=True)
class Stride:
    """Consecutive pieces of size characters."""

    size: int = 2048

    def __call__(self, text: str) -> Iterator[Piece]:
        for a in range(0, len(text), self.size):
            yield text[a : a + self.size], a, min(len(text), a + self.size)


#: Other names of the character windows, which these methods fall back to.
ALIASES = {"semantic_similarity": CharWindow, "smart_kg": CharWindow}


def pieces_of(texts: list[str], chunker: Callable[[str], Iterator[Piece]]) -> list[str]:
    """The list form: all pieces' texts of some texts, in order. Texts must pass check_texts."""
    check_texts(texts)
    return [t for text in texts for t, _, _ in chunker(text)]


def check_texts(texts: list[str]) -> None:
    """Raises ValueError unless it is a list of texts, none of them empty or blank."""
    if not isinstance(texts, list) or not texts:
        raise ValueError("texts must be a list that is not empty")
    for i, t in enumerate(texts):
        if not isinstance(t, str) or not t.strip():
            raise ValueError(f"text at index {i} must be a string that is not blank")


def text_faults(df: DataFrame, text_col: str, *, most_tokens: int | None = None) -> DataFrame:
    """Adds `fault`, as a column and not as an error: null for a text that can be embedded, else missing, blank or too_long."""
    t = F.col(text_col)
    fault = F.when(t.isNull(), "missing").when(~t.rlike(r"\S"), "blank")
    return df.withColumn("fault", fault if most_tokens is None else fault.when(token_count(t) > most_tokens, "too_long"))


def chunked(df: DataFrame, chunker: Callable[[str], Iterator[Piece]], *, id_col: str, text_col: str, metadata: list[str] | None = None) -> DataFrame:
    """A row per chunk: id, chunk_no, text, start_idx, end_idx, token_count, and the given columns of its row. A null or empty text has none."""
    extra = [c for c in metadata or [] if c not in (id_col, "id", "chunk_no", "text", "start_idx", "end_idx", "token_count")]

    names = ["id", *(f.split()[0] for f in CHUNKS.split(", ")), *extra]
    kinds = [pa.string() if f.split()[1] == "string" else pa.int64() if f.split()[1] in ("long", "bigint") else pa.int32() for f in CHUNKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low, high in spans(pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False), 1 << 20):
                part = b.slice(low, high - low)
                rows = [(i, k, t, a, z, tokens(t)) for i, text in enumerate(part.column(1).to_pylist()) for k, (t, a, z) in enumerate(chunker(text))]
                at = pa.array([r[0] for r in rows], pa.int64())
                made = [pa.array([r[1 + c] for r in rows], kind) for c, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), *made, *(part.column(2 + c).take(at) for c in range(len(extra)))], names)

    kind = df.schema[id_col].dataType.simpleString()
    ready = df.filter(F.col(text_col) != "").select(F.col(id_col).alias("id"), F.col(text_col).alias("__text"), *extra)
    schema = ", ".join([f"id {kind}", CHUNKS, *(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in extra)])
    return ready.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def timestamped(df: DataFrame, *, id_col: str, segments_col: str, max_tokens: int = 4000, overlap_tokens: int = 100) -> DataFrame:
    """Entries (array<struct<text, start, duration>>) packed into chunks of 4 * max_tokens characters with their time range; overlap in entries."""
    most, again = 4 * max_tokens, max(1, overlap_tokens // 50)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, entries in zip(b["id"], b["segments"], strict=True):
                held: list[dict] = []
                k, fresh = 0, 0
                for e in entries:
                    if fresh and sum(len(x["text"]) + 1 for x in held) + len(e["text"]) > most:
                        out.append((i, k, " ".join(x["text"] for x in held), held[0]["start"], held[-1]["start"] + held[-1]["duration"]))
                        held, k, fresh = held[-again:], k + 1, 0
                        while held and sum(len(x["text"]) + 1 for x in held) + len(e["text"]) > most:
                            held.pop(0)
                    held.append(e)
                    fresh += 1
                if fresh:
                    out.append((i, k, " ".join(x["text"] for x in held), held[0]["start"], held[-1]["start"] + held[-1]["duration"]))
            yield pd.DataFrame(out, columns=["id", "chunk_no", "text", "start_time", "end_time"])

    kind = df.schema[id_col].dataType.simpleString()
    ready = df.filter(F.size(segments_col) > 0).select(F.col(id_col).alias("id"), F.col(segments_col).alias("segments"))
    return ready.mapInPandas(run, f"id {kind}, chunk_no int, text string, start_time double, end_time double").withColumnRenamed("id", id_col)


def exploded_windows(df: DataFrame, *, id_col: str, text_col: str, size: int) -> DataFrame:
    return df.select(id_col, F.posexplode(tx.char_windows(F.col(text_col), size)).alias("chunk_no", "chunk_text"))


def exploded_sentences(df: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    return df.select(id_col, F.posexplode(tx.sentences(F.col(text_col))).alias("sentence_no", "sentence"))


def sentence_windows(df: DataFrame, *, id_col: str, text_col: str, width: int = 4, step: int = 2, most_chars: int = 2000, least_chars: int = 50) -> DataFrame:
    """Windows of `width` sentences every `step`, over the whole sentences that fit in most_chars; windows of least_chars or less are dropped."""
    s = F.col("__s")
    fitting = F.aggregate(s, F.struct(F.lit(0).alias("chars"), F.lit(0).alias("n"), F.lit(True).alias("open")), lambda a, x: F.when(a.open & (a.chars + F.length(x) <= most_chars), F.struct((a.chars + F.length(x)).alias("chars"), (a.n + 1).alias("n"), F.lit(True).alias("open"))).otherwise(F.struct(a.chars.alias("chars"), a.n.alias("n"), F.lit(False).alias("open"))))
    out = df.select(id_col, tx.sentences(tx.without_stamps(F.col(text_col))).alias("__s")).withColumn("__s", F.slice(s, F.lit(1), fitting["n"]))
    starts = F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    wide = out.select(id_col, F.posexplode(F.transform(starts, lambda i: F.array_join(F.slice(s, i + 1, F.lit(width)), " "))).alias("window_no", "window_text"))
    return wide.filter(F.length("window_text") > least_chars)


def statistics(chunks: DataFrame, *, text_col: str = "text", tokens_col: str = "token_count") -> DataFrame:
    """Counts, sums, means and extremes of tokens and characters; zeros for no chunks."""
    n = F.length(text_col)
    z = lambda c, name: F.coalesce(c, F.lit(0)).alias(name)
    t = F.col(tokens_col)
    return chunks.agg(F.count("*").alias("total_chunks"), z(F.sum(t), "total_tokens"), z(F.round(F.avg(t), 4), "average_tokens"), z(F.min(t), "min_tokens"), z(F.max(t), "max_tokens"), z(F.sum(n), "total_characters"), z(F.round(F.avg(n), 4), "average_characters"), z(F.min(n), "min_characters"), z(F.max(n), "max_characters"))


def segments_of(df: DataFrame, *, id_col: str, order: str, text_col: str) -> DataFrame:
    """Turns of one id as timed segments: each starts where the text before it ends (in tokens as seconds), offsets in the joined text."""
    from pyspark.sql import Window

    w = Window.partitionBy(id_col).orderBy(order)
    before = F.coalesce(F.sum(F.length(text_col) + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.select(id_col, order, text_col, before.cast("long").alias("pos"), token_count(F.col(text_col)).cast("double").alias("duration")).withColumn("start", F.coalesce(F.sum("duration").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))


def with_times(chunks: DataFrame, segments: DataFrame, *, id_col: str) -> DataFrame:
    """As-of join: a chunk's start is that of the last segment at or before its first character, its end the end of the last one at or before its last.

    Chunks and segments of one id meet in one ordered window, so each side is read once and nothing is paired out.
    """
    from pyspark.sql import Window

    seg = segments.select(id_col, F.col("pos").alias("__at"), F.lit(0).alias("__side"), F.lit(None).cast("int").alias("chunk_no"), "start", (F.col("start") + F.col("duration")).alias("stop"))
    ends = [chunks.select(id_col, F.col(c).cast("long").alias("__at"), F.lit(k).alias("__side"), "chunk_no", F.lit(None).cast("double").alias("start"), F.lit(None).cast("double").alias("stop")) for k, c in ((1, "start_idx"), (2, "end_idx"))]
    w = Window.partitionBy(id_col).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    seen = seg.unionByName(ends[0]).unionByName(ends[1]).select(id_col, "__side", "chunk_no", F.last("start", True).over(w).alias("start"), F.last("stop", True).over(w).alias("stop")).filter("__side > 0")
    return seen.groupBy(id_col, "chunk_no").agg(F.max(F.when(F.col("__side") == 1, F.col("start"))).alias("start_time"), F.max(F.when(F.col("__side") == 2, F.col("stop"))).alias("end_time"))
