"""Token ids of texts in binary files: written in the order of ids by Spark's writers, packed by Simple-8b, read back block by block.

Writing: rows are dealt by ranges of the id and sorted, the texts of a range are encoded in Arrow batches and written to one file, so
the files, in order, hold all ids in order. A file is a chain of segments of some ``segment_ids`` ids, each followed by an end mark:

    8 words       magic, words in the segment, documents, ids, blocks, packed words, escapes, CRC-32 of the segment's words after these
    1 word        number of the file
    2 words each  a document's id; its tokens with the end id (top bit: its id is null)
    1 word each   for a block of 1,024 ids, its first packed word (low 32 bits) and its first escape (high ones)
    packed words, escapes

All words are little endian and aligned to 8 bytes. Documents never cross segments. Rows are written by Spark's text writer and read
by its reader of binary files, so the files land in any store that Spark reaches; a file comes from one range of rows, of about ``file_bytes``
of text (one longer text is a file of its own at worst), and is read whole by one task.

Encoding: texts are cut before runs of ASCII white space and before marks that end a word, where this kind of pre-tokenizer always
cuts; distinct pieces are encoded once a batch, and remembered by the worker. A file of another kind is an error (`check_kind`).

Defined results: a null or empty text has the end id alone. Null ids come first; rows with one id stand in the order of their texts'
MD5, and equal rows in any order. Columns besides id and text are ignored, so their names cannot clash; an empty table gives no files.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from corvane.llm.common import batch_groups, new_path, slices, written
from corvane.llm.simple8b import BLOCK, pack, unpack

MAGIC, END = int.from_bytes(b"CVTOKEN1", "little"), b"\nSEGEND\n"
HEAD, NULL = 9, 1 << 63
#: Pieces whose ids a worker remembers at most, none longer than so many bytes.
REMEMBERED, SHORT = 600_000, 64

_LOADED: dict[str, Pieces] = {}


def check_kind(path: str) -> None:
    """Raises unless the file is byte-level BPE with the usual pattern, no normalizer or prefix, and special strings without white space or marks."""
    with open(path, encoding="utf-8") as f:
        t = json.load(f)
    pre = t["pre_tokenizer"] or {}
    usual = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    plain = all(not x["lstrip"] and not x["rstrip"] and not x["single_word"] and not any(c.isspace() or c in MARKS for c in x["content"]) for x in t["added_tokens"])
    if not (usual and plain and t["normalizer"] is None):
        raise ValueError(f"{path}: texts can be cut at white space only for byte-level BPE with the usual pattern")


class Pieces:
    """The ids of pieces: in one array, found by the piece's number. Short pieces stay from batch to batch."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = {i: len(x.content.encode()) for i, x in self.tokenizer.get_added_tokens_decoder().items()}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes = np.zeros(max([*vocabulary.values(), *special]) + 1, np.int64)  # a byte-level token has a character for each byte
        for token, i in vocabulary.items():
            self.bytes[i] = len(token)
        for i, n in special.items():
            self.bytes[i] = n
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.bounds = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def add(self, ids: list[np.ndarray], sizes: np.ndarray) -> None:
        self.ids = np.concatenate([self.ids, *ids])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(sizes)])

    def encode(self, pieces: list[str], call_bytes: int) -> None:
        """Adds some pieces. Those that begin with white space and end otherwise are encoded one after the other as one text, which
        is cut between them all the same: where each ends is told by the bytes of its tokens."""
        chained = [p[0] in " \n\t\r\x0b\x0c" and not p[-1].isspace() for p in pieces]
        first = len(self.bounds) - 1
        order = [p for p, c in zip(pieces, chained, strict=True) if c] + [p for p, c in zip(pieces, chained, strict=True) if not c]
        self.number.update(zip(order, range(first, first + len(order)), strict=True))
        n = sum(chained)
        size = np.fromiter((len(p.encode()) for p in order), np.int64, len(order))
        for i, j in batch_groups(size[:n], call_bytes):
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(order[i:j])], add_special_tokens=False)[0].ids, np.uint32)
            stops = np.searchsorted(np.cumsum(self.bytes[ids]), np.cumsum(size[i:j])) + 1
            self.add([ids], np.diff(stops, prepend=0))
        for i, j in batch_groups(size[n:], call_bytes):
            found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(order[n + i : n + j], add_special_tokens=False)]
            self.add(found, np.fromiter(map(len, found), np.int64, len(found)))

    def of(self, pieces: list[str], call_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, number) by which the ids of each piece are found; valid until the next call."""
        if len(self.number) > REMEMBERED:
            self.clear()
        new = [p for p in pieces if p not in self.number]
        self.encode([p for p in new if len(p) <= SHORT], call_bytes)
        keep, long = len(self.bounds), [p for p in new if len(p) > SHORT]
        self.encode(long, call_bytes)
        at = np.fromiter(map(self.number.__getitem__, pieces), np.int64, len(pieces))
        told = self.ids, self.bounds[at], self.bounds[at + 1] - self.bounds[at]
        for p in long:
            del self.number[p]
        self.bounds = self.bounds[:keep]
        self.ids = self.ids[: self.bounds[-1]]
        return told


def pieces_of(path: str) -> Pieces:
    """The tokenizer of a file with what it remembers, once per worker."""
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


#: Marks before which a text is cut if they follow an ASCII letter or digit (no quote, which contractions need, and none of the special strings').
MARKS = ",.;:!?$%&*#)(/"
_SPACE, _MARK, _WORD = (np.zeros(256, bool) for _ in range(3))
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MARK[list(MARKS.encode())] = True
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Pieces of texts (views of their bytes), and for each text the number of its first piece (and a last number).

    A cut stands before a white space that follows anything but white space, and before a mark that follows an ASCII letter or digit.
    A run of white space stays with the word after it, as what becomes of it depends on that. White space beyond ASCII before a cut
    would belong to the run, so there is no cut there.
    """
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    a, z = int(offsets[0]), int(offsets[-1])
    d = data[a:z]
    inner = np.zeros(len(d) + 1, bool)
    if len(d) > 1:
        space = _SPACE[d]
        inner[1:-1] = (space[1:] & ~space[:-1]) | (_MARK[d[1:]] & _WORD[d[:-1]])
        at = np.flatnonzero(inner)
        at = at[d[at - 1] >= 0x80]  # after a character beyond ASCII: is it white space?
        if len(at):
            last, second, third = d[at - 1], d[np.maximum(at - 2, 0)], d[np.maximum(at - 3, 0)]
            wide = (second == 0xC2) & ((last == 0x85) | (last == 0xA0))
            wide |= (third == 0xE1) & (second == 0x9A) & (last == 0x80) | (third == 0xE3) & (second == 0x80) & (last == 0x80) | (third == 0xE2) & (second == 0x81) & (last == 0x9F)
            wide |= (third == 0xE2) & (second == 0x80) & ((last <= 0x8A) | (last == 0xA8) | (last == 0xA9) | (last == 0xAF))
            inner[at[wide]] = False
    inner[offsets - a] = True
    inner[-1] = False
    starts = np.flatnonzero(inner[:-1])
    bounds = np.append(starts, len(d)).astype(np.int32)
    pieces = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(d))])
    return pieces, np.searchsorted(starts, offsets - a)


def encode(path: str, texts: pa.Array, end_id: int | None = 0, call_bytes: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Ids (unsigned 32-bit) of a batch of texts, one after the other, with the end id after each; where each text ends."""
    pieces, first = cut(texts)
    coded = pieces.dictionary_encode()
    which = np.asarray(coded.indices, dtype=np.int64)
    table, start, n = pieces_of(path).of(coded.dictionary.to_pylist(), call_bytes)
    at, size = start[which], n[which]
    ends = np.concatenate(([0], np.cumsum(size)))
    narrow = np.int32 if max(ends[-1], len(table)) < 1 << 31 else np.int64
    where = np.arange(ends[-1], dtype=narrow)
    where += np.repeat((at - ends[:-1]).astype(narrow), size)
    ids = table[where]
    stops = ends[first[1:]]
    if end_id is None:
        return ids, stops
    return np.insert(ids, stops, np.uint32(end_id)), stops + np.arange(1, len(stops) + 1)


def segment(shard: int, doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> bytes:
    words, starts, escapes, first = pack(ids)
    docs = np.zeros((len(doc_ids), 2), np.uint64)
    docs[:, 0] = np.array([0 if i is None else i for i in doc_ids], np.int64).view(np.uint64)
    docs[:, 1] = sizes.astype(np.uint64) | np.array([NULL if i is None else 0 for i in doc_ids], np.uint64)
    body = np.concatenate([np.array([shard], np.uint64), docs.ravel(), starts.astype(np.uint64) | first.astype(np.uint64) << np.uint64(32), words, escapes]).astype("<u8").tobytes()
    head = [MAGIC, HEAD - 1 + len(body) // 8, len(doc_ids), len(ids), len(starts), len(words), len(escapes), zlib.crc32(body)]
    return np.array(head, "<u8").tobytes() + body


def segments(content: memoryview) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(file's number, document ids, whether null, where each ends, all ids) of each segment of a file. What does not match its checksum is an error."""
    pos = 0
    while pos < len(content):
        head = np.frombuffer(content, "<u8", HEAD - 1, pos)
        stop = pos + 8 * int(head[1])
        if head[0] != MAGIC or stop + len(END) > len(content) or bytes(content[stop : stop + len(END)]) != END:
            raise ValueError(f"no whole segment at byte {pos}")
        if zlib.crc32(content[pos + 8 * (HEAD - 1) : stop]) != int(head[7]):
            raise ValueError(f"the segment at byte {pos} does not match its checksum")
        docs, total, blocks, words, escapes = (int(x) for x in head[2:7])
        x = np.frombuffer(content, "<u8", int(head[1]) - HEAD + 1, pos + 8 * (HEAD - 1))
        shard, table, index, x = int(x[0]), x[1 : 1 + 2 * docs].reshape(docs, 2), x[1 + 2 * docs : 1 + 2 * docs + blocks], x[1 + 2 * docs + blocks :]
        ids = unpack(x[:words], (index & np.uint64(0xFFFFFFFF)).astype(np.int64), x[words : words + escapes], (index >> np.uint64(32)).astype(np.int64), total)
        sizes = (table[:, 1] & np.uint64(NULL - 1)).astype(np.int64)
        yield shard, table[:, 0].copy().view(np.int64), table[:, 1] >= NULL, np.cumsum(sizes), ids
        pos = stop + len(END)


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, file_bytes: int = 24 << 20, segment_ids: int = 1 << 20) -> None:
    """Write the ids of all texts to files under path. tokenizer_path: a file (see check_kind) that is present on driver and workers."""
    check_kind(tokenizer_path)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, n = TaskContext.get().partitionId(), [], 0

        def put() -> pa.RecordBatch:
            data = segment(shard, [i for h in held for i in h[0]], np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held]))
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["segment"])

        for b in slices(batches, 1, 10 << 20):
            ids, ends = encode(tokenizer_path, b.column(1), end_id)
            held.append((b.column(0).to_pylist(), np.diff(ends, prepend=0), ids))
            n += len(ids)
            if n >= segment_ids:
                yield put()
                held, n = [], 0
        if held:
            yield put()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # equal ids are told apart by texts, and equal rows by their place, so an id that many rows share is spread over ranges
    keys = [F.col("doc_id"), F.md5("text").alias("digest"), F.monotonically_increasing_id().alias("place")]
    dealt = rows.select("text", *keys).repartitionByRange(max(1, -(-size // file_bytes)), "doc_id", "digest", "place").sortWithinPartitions("doc_id", "digest", "place")
    out = dealt.select("doc_id", "text").mapInArrow(packed, "segment binary")
    out.select(F.col("segment").cast("string").alias("value")).write.option("lineSep", END.decode()).text(path)


def read_tokens(spark: SparkSession, path: str, *, with_ids: bool = False) -> DataFrame:
    """shard, start_in_shard (ids before it in its file), doc_id, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), and the ids if wanted."""
    names = ["shard", "start_in_shard", "doc_id", "n_tokens", "ids_crc32", "ids"][: 6 if with_ids else 5]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                before = 0
                for shard, doc_ids, null, ends, ids in segments(memoryview(content.as_buffer())):
                    starts, raw = ends - np.diff(ends, prepend=0), ids.astype("<u4")
                    crc = np.fromiter((zlib.crc32(raw[i:j]) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)), np.int64, len(ends))
                    columns = [pa.array(np.full(len(ends), shard)), pa.array(starts + before), pa.array(doc_ids, mask=null), pa.array(ends - starts), pa.array(crc)]
                    if with_ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(np.append(starts, ends[-1]), pa.int32()), pa.array(ids.astype(np.int64))))
                    yield pa.RecordBatch.from_arrays(columns, names)
                    before += int(ends[-1])

    schema = "shard long, start_in_shard long, doc_id long, n_tokens long, ids_crc32 long" + (", ids array<bigint>" if with_ids else "")
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, schema)


def with_starts(found: DataFrame) -> DataFrame:
    """read_tokens' rows with `start`, the ids of all documents before. The totals have a row for each file, so a window over them holds as many rows as files."""
    totals = found.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = totals.select(F.col("shard").alias("__shard"), F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return found.join(before, F.col("shard") == F.col("__shard")).withColumn("start", F.col("start_in_shard") + F.col("__before")).drop("__shard", "__before")


def round_trip(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Write the ids of all texts to the shared folder and read the files back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write_tokens(docs, path, tokenizer_path, **options)
    found = written(read_tokens(spark, path), "token-counts")
    return with_starts(found).select("doc_id", "start", "n_tokens", "ids_crc32")
