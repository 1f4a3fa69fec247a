"""Language-model scoring with a hashed maximum-entropy model.

A token's probability is that of its class times that within its class, each a softmax over sums of rows of hashed weight tables:
one row each for the word before (bigram), the two before (trigram) and the word before that alone (skip), plus a bias. Words are
dealt into classes by frequency: the first classes hold WIDTH words each; a deep class is a tree of softmaxes with WIDTH branches,
and holds as many words as the vocabulary's rule gives it. All further words form the rare class, where a word has the share
(c + 1) / (N + V + 1) of its training count.

What the model gathers grows with the training tokens (`Shape.of`): the words with a place of their own, the rows of the tables,
and the rounds of averaging. Texts are coded once, two to four bytes a token, into the shared folder. Training goes over all
training texts once, in rounds; a round's texts are dealt by hash into shards of fixed size, each is learnt in a fixed order from
the round's first weights, and the shards' steps are averaged in that order, by slices of the tables, on the executors. So the
model is that of the rows, however they are partitioned and wherever tasks run. Scoring gathers the rows in numpy batches.

Counts cover all training tokens. The most frequent words (``top_words`` at most) are broadcast with their counts, those longer than
``top_bytes`` by a digest, so no word is too long to be among them; tokens of all other words meet their counts in a shuffle join, so
nothing is left out, no frequent word is a hot key there, and nothing broadcast grows.

Defined results: a null or empty text is one end token; repeated rows are scored each; a null id trains and is not held out;
without training texts every count is 0 and the score is the untrained model's; other columns are ignored, so names cannot clash.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import lean, slices, split_words, sums, written

#: The end token. A word never holds a space.
END = " "
#: Branches of a softmax; classes that hold WIDTH words, and classes that hold trees of words; the last class is the rare one.
WIDTH, FLAT, DEEP = 32, 15, 16
RARE = FLAT + DEEP
#: Rare words as contexts.
BUCKETS = 256
BLOCK = 1 << 14
SLICES = 16
LN10 = np.log(10.0)
_A, _B, _C = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)


@dataclass(frozen=True)
class Shape:
    """levels of a deep class, bits of the outer and inner tables' rows, rounds, and tokens of a shard."""

    levels: int
    outer_bits: int
    inner_bits: int
    rounds: int
    shard_tokens: int
    least_shards: int = 16

    @classmethod
    def of(cls, tokens: int) -> Shape:
        """By training tokens: a third level of words beyond 2 ** 31; tables and shards doubled for each eightfold from 2 ** 26 on, so that
        the steps sent stay in proportion to the tokens; a round more for each doubling from 2 ** 24 on."""
        grow = max(0, int(math.log2(max(tokens, 1) / 2**26) / 3))
        return cls(2 if tokens <= 1 << 31 else 3, 13 + grow, 15 + grow, 3 + max(0, int(math.log2(max(tokens, 1) / 2**24))), 2 << 20 + grow)

    @property
    def head(self) -> int:
        """Words with a place of their own."""
        return WIDTH * FLAT + DEEP * WIDTH**self.levels

    @property
    def start(self) -> int:
        """The context before a text's first token."""
        return self.head + BUCKETS

    @property
    def nodes(self) -> int:
        """Softmaxes below the classes."""
        return RARE + DEEP * sum(WIDTH**k for k in range(1, self.levels))

    def shards(self, tokens: float) -> int:
        """Of one round: so many that all cores of a small cluster work, and no more than one for each shard_tokens beyond."""
        return max(1, min(self.least_shards, int(tokens) >> 16), -(-int(tokens) // self.shard_tokens))

    def fresh(self) -> np.ndarray:
        """All weights in one array of rows: outer and inner tables, the classes' bias and the nodes' biases."""
        return np.zeros(((1 << self.outer_bits) + (1 << self.inner_bits) + 1 + self.nodes, WIDTH), np.float32)

    def parts(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        a, b = 1 << self.outer_bits, (1 << self.outer_bits) + (1 << self.inner_bits)
        return w[:a], w[a:b], w[b], w[b + 1 :]

    def classes(self, ids: np.ndarray) -> np.ndarray:
        flat, size = WIDTH * FLAT, WIDTH**self.levels
        return np.where(ids < flat, ids // WIDTH, np.minimum(FLAT + (ids - flat) // size, RARE))

    def path(self, ids: np.ndarray, cls: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each level below the classes: the tokens that have it, their node, and their branch."""
        flat, own = WIDTH * FLAT, np.flatnonzero(cls < RARE)
        deep = np.flatnonzero((cls >= FLAT) & (cls < RARE))
        inside = (ids[deep] - flat) % WIDTH**self.levels
        first = ids[own] % WIDTH
        first[cls[own] >= FLAT] = inside // WIDTH ** (self.levels - 1)
        yield own, cls[own], first
        before, base = cls[deep] - FLAT, RARE
        for k in range(1, self.levels):
            before = before * WIDTH + inside // WIDTH ** (self.levels - k) % WIDTH
            yield deep, base + before, inside // WIDTH ** (self.levels - 1 - k) % WIDTH
            base += DEEP * WIDTH**k


def features(shape: Shape, ids: np.ndarray, back: np.ndarray) -> list[np.ndarray]:
    """Codes of the three features of each token; back: how many tokens of its text stand before it."""
    start = [shape.start]
    one = np.where(back >= 1, np.concatenate((start, ids[:-1])), shape.start).astype(np.uint32)
    two = np.where(back >= 2, np.concatenate((start, start, ids[:-2]))[: len(ids)], shape.start).astype(np.uint32)
    mixed = lambda x, k: (x + np.uint32(k)) * _A
    return [mixed(one, 1), mixed(one * np.uint32(2654435) + two * np.uint32(40503), 1 << 30), mixed(two, 1 << 29)]


def outer_rows(code: np.ndarray, bits: int) -> np.ndarray:
    return (code >> np.uint32(32 - bits)).astype(np.intp)


def inner_rows(code: np.ndarray, node: np.ndarray, bits: int) -> np.ndarray:
    return ((((code ^ (code >> np.uint32(15))) + node.astype(np.uint32) * _C) * _B) >> np.uint32(32 - bits)).astype(np.intp)


#: Rows of exponents within this are raised as they stand; from others the largest is taken off first.
SAFE = 60.0


def _powers(z: np.ndarray) -> np.ndarray:
    """z turned into powers of e, up to a factor by row; returns their sums."""
    if len(z) and not (z.max() < SAFE and z.min() > -SAFE):
        far = np.flatnonzero((np.abs(z) >= SAFE).any(axis=1))
        z[far] -= z[far].max(axis=1, keepdims=True)
    np.exp(z, out=z)
    return z.sum(axis=1)


def _softmax(z: np.ndarray) -> np.ndarray:
    z /= _powers(z)[:, None]
    return z


def _chosen(z: np.ndarray, branch: np.ndarray) -> np.ndarray:
    """The softmax of each row at its branch."""
    total = _powers(z)
    return z[np.arange(len(z)), branch] / total


def logs(shape: Shape, w: np.ndarray, ids: np.ndarray, back: np.ndarray) -> np.ndarray:
    """log10 probability of each token; of a rare one, that of the rare class."""
    outer, inner, bias, node_bias = shape.parts(w)
    out = np.empty(len(ids))
    feats = features(shape, ids, back)
    for a in range(0, len(ids), BLOCK):
        f, y = [x[a : a + BLOCK] for x in feats], ids[a : a + BLOCK]
        cls = shape.classes(y)
        z = bias + outer.take(outer_rows(f[0], shape.outer_bits), axis=0)
        for x in f[1:]:
            z += outer.take(outer_rows(x, shape.outer_bits), axis=0)
        own = _chosen(z, cls).astype(np.float64)
        for at, node, branch in shape.path(y, cls):
            if len(at):
                z = node_bias.take(node, axis=0)
                for x in f:
                    z += inner.take(inner_rows(x[at], node, shape.inner_bits), axis=0)
                own[at] *= _chosen(z, branch)
        out[a : a + BLOCK] = np.log10(np.maximum(own, 1e-30))
    return out


def sorted_rows(at: np.ndarray) -> np.ndarray:
    """Places of row numbers below 2 ** 32 in their order, equal ones as they stand; 16 bits at a time, which numpy sorts by counting."""
    order = np.argsort(at.astype(np.uint16), kind="stable")
    if len(at) and at.max() >> 16:
        order = order[np.argsort((at[order] >> 16).astype(np.uint16), kind="stable")]
    return order


def run_sums(d: np.ndarray, source: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """For each run of `count` places from `first` on: the sum of d's rows that `source` names there.

    Runs are cut into groups of a few rows, groups into groups of more, so that all sums go over whole rows in numpy and in no long chain. Full
    groups stand before the others, so that those with a k-th row are a slice.
    """
    out = np.empty((len(first), d.shape[1]), np.float32)
    runs, fan = np.arange(len(first)), 2
    while len(runs):
        groups = -(-count // fan)
        ends = np.cumsum(groups)
        heads = ends - groups
        before = (np.arange(ends[-1]) - np.repeat(heads, groups)) * fan
        size = np.minimum(np.repeat(count, groups) - before, fan)
        by = np.argsort((fan - size).astype(np.uint8), kind="stable")
        start = (np.repeat(first, groups) + before)[by]
        x = d.take(source[start], axis=0)
        for k in range(1, fan):
            n = np.count_nonzero(size > k)
            x[:n] += d.take(source[start[:n] + k], axis=0)
        place = np.empty(len(by), np.intp)
        place[by] = np.arange(len(by))
        done = groups == 1
        out[runs[done]] = x.take(place[heads[done]], axis=0)
        first, count, runs = heads[~done], groups[~done], runs[~done]
        d, source, fan = x, place, min(2 * fan, 16)
    return out


def _step(w: np.ndarray, g2: np.ndarray, rows: list[np.ndarray], d: np.ndarray, rate: float) -> None:
    """One adaptive gradient step of the rows that the tokens of a block use; d: gradient by token. A row's tokens are summed in a fixed order."""
    at = np.concatenate(rows)
    order = sorted_rows(at)
    at = at[order]
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    used, count = at[first], np.diff(first, append=len(at))
    g = run_sums(d, order % len(d), first, count)
    new = g2.take(used, axis=0)
    new += g * g
    g2[used] = new
    new += np.float32(1e-6)
    np.sqrt(new, out=new)
    g *= np.float32(rate)
    g /= new
    w[used] = w.take(used, axis=0) - g


class Learner:
    """A shard's gradient updates, in blocks of BLOCK tokens however the tokens come in."""

    def __init__(self, shape: Shape, w: np.ndarray, rate: float):
        self.shape, self.rate, self.w, self.g2, self.seen = shape, rate, w.copy(), np.zeros_like(w), 0
        self.held: list[np.ndarray] | None = None

    def learn(self, ids: np.ndarray, back: np.ndarray) -> None:
        new = [ids, *features(self.shape, ids, back)]
        held = new if self.held is None else [np.concatenate(x) for x in zip(self.held, new, strict=True)]
        full = len(held[0]) // BLOCK * BLOCK
        for a in range(0, full, BLOCK):
            self._block(*(x[a : a + BLOCK] for x in held))
        self.held = [x[full:] for x in held]

    def close(self) -> np.ndarray:
        if self.held is not None and len(self.held[0]):
            self._block(*self.held)
            self.held = None
        return self.w

    def _block(self, y: np.ndarray, *f: np.ndarray) -> None:
        shape, rate = self.shape, self.rate
        outer, inner, bias, node_bias = shape.parts(self.w)
        outer2, inner2, bias2, node_bias2 = shape.parts(self.g2)
        self.seen += len(y)
        cls, rows = shape.classes(y), [outer_rows(x, shape.outer_bits) for x in f]
        d = bias + outer.take(rows[0], axis=0)
        for x in rows[1:]:
            d += outer.take(x, axis=0)
        d = _softmax(d)
        d[np.arange(len(y)), cls] -= 1
        g = d.sum(axis=0)
        bias2 += g * g
        bias -= rate * g / np.sqrt(bias2 + 1e-6)
        _step(outer, outer2, rows, d, rate)
        for at, node, branch in shape.path(y, cls):
            if len(at):
                rows = [inner_rows(x[at], node, shape.inner_bits) for x in f]
                d = node_bias.take(node, axis=0)
                for x in rows:
                    d += inner.take(x, axis=0)
                d = _softmax(d)
                d[np.arange(len(at)), branch] -= 1
                _step(inner, inner2, rows, d, rate)
                _step(node_bias, node_bias2, [node], d, rate)


class Words:
    """The most frequent words and their counts. Codes: a head word's place, else a bucket of the rare class."""

    def __init__(self, words: pa.Array, counts: np.ndarray, cut: int, top_bytes: int):
        self.words, self.counts, self.cut, self.top_bytes, self.place = words, counts, cut, top_bytes, None

    def places(self) -> dict[str, int]:
        if self.place is None:
            self.place = {x: i for i, x in enumerate(self.words.to_pylist())}
        return self.place

    def coded(self, texts: pa.Array, head: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of a batch: distinct words, each token's index in them, text ends, and by distinct word its code and its place (-1: not among the most frequent)."""
        known = self.places()
        flat, ends = split_words(pc.ascii_lower(texts))
        coded = flat.dictionary_encode()
        words = coded.dictionary.to_pylist()
        place = np.fromiter((known.get(x, -1) for x in words), np.int64, len(words))
        for i in np.flatnonzero(np.asarray(pc.binary_length(coded.dictionary)) > self.top_bytes).tolist():
            place[i] = known.get(f"{END}{hashlib.md5(words[i].encode(), usedforsecurity=False).hexdigest()}", -1)
        ids = np.where((place >= 0) & (place < head), place, 0)
        for i in np.flatnonzero((place < 0) | (place >= head)).tolist():
            ids[i] = head + zlib.crc32(words[i].encode()) % BUCKETS
        return coded.dictionary, np.asarray(coded.indices).astype(np.int64) if len(flat) else np.zeros(0, np.int64), ends, ids, place


def with_ends(tokens: np.ndarray, ends: np.ndarray, end_value: int) -> tuple[np.ndarray, np.ndarray]:
    """Token values with the end token's put in after each text, and the new ends."""
    return np.insert(tokens, ends[1:], end_value), ends + np.arange(len(ends))


def backs(ends: np.ndarray) -> np.ndarray:
    """How many tokens of its text stand before each."""
    return np.arange(ends[-1]) - np.repeat(ends[:-1], np.diff(ends))


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n) over all rows of one text column; each Arrow batch is counted before the shuffle."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 0, 16 << 20):
            flat, _ = split_words(pc.ascii_lower(b.column(0)))
            found = flat.value_counts()
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([found.field(0), pa.array([END])]), pa.concat_arrays([found.field(1), pa.array([b.num_rows], pa.int64())])], ["word", "n"])

    return texts.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, top_words: int, top_bytes: int) -> Words:
    """The words that are found at least `cut` times, the least cut that leaves top_words at most, found from a histogram of the counts; and the end token.

    A word of more than top_bytes is held as a space and its digest.
    """
    upto, cut = 0, 1 << 62
    for r in counts.filter(F.col("word") != END).groupBy(F.least("n", F.lit(100_000)).alias("n")).agg(F.count("*").alias("words")).orderBy(F.desc("n")).collect():
        upto += r.words
        if upto > top_words:
            break
        cut = r.n
    held = F.when(F.octet_length("word") > top_bytes, F.concat(F.lit(END), F.md5("word"))).otherwise(F.col("word"))
    top = counts.filter((F.col("n") >= cut) | (F.col("word") == END)).select(held.alias("word"), "n").toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    return Words(top.column("word").combine_chunks() if top.num_rows else pa.array([], pa.string()), top.column("n").to_numpy(), cut, top_bytes)


def coded_rows(rows: DataFrame, words: Words, shape: Shape) -> DataFrame:
    """rows: key, doc_id, held_out, text. A row each with its codes, its figures, and the words whose counts are still to be found."""
    vocabulary = rows.sparkSession.sparkContext.broadcast(words)
    kind = dict(rows.dtypes)["doc_id"]
    code_type = np.uint16 if shape.start < 1 << 16 else np.uint32

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        logs_of = np.append(np.log10(v.counts + 1.0), 0.0)  # at -1: left to the join
        end = v.places().get(END, -1)
        for b in slices(batches, 3):
            distinct_words, tokens, ends, ids, place = v.coded(b.column(3), shape.head)
            full, all_ends = with_ends(ids[tokens], ends, end if 0 <= end < shape.head else shape.head)
            spot, _ = with_ends(place[tokens], ends, end)
            seen, rare = logs_of[spot], full >= shape.head
            far = place[tokens] < 0
            tail = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(far)))[ends], pa.int32()), distinct_words.take(pa.array(tokens[far])))
            raw = full.astype(code_type)
            codes = pa.array([raw[i:j].tobytes() for i, j in zip(all_ends[:-1].tolist(), all_ends[1:].tolist(), strict=True)], pa.binary())
            figures = [np.diff(all_ends), sums((spot >= 0).astype(np.int64), all_ends), sums(seen, all_ends), sums(np.where(rare, seen, 0.0), all_ends), sums(rare.astype(np.int64), all_ends)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *map(pa.array, figures), tail, codes], ["key", "doc_id", "held_out", "n_tokens", "near", "seen", "rare_seen", "rare", "tail", "codes"])

    return rows.mapInArrow(code, f"key long, doc_id {kind}, held_out boolean, n_tokens long, near long, seen double, rare_seen double, rare long, tail array<string>, codes binary")


def _tokens(codes: pa.Array, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of some rows' codes, and their ends."""
    size = 2 if shape.start < 1 << 16 else 4
    ends = np.concatenate(([0], np.cumsum(np.asarray(pc.binary_length(codes), dtype=np.int64)))) // size
    return np.frombuffer(b"".join(codes.to_pylist()), np.uint16 if size == 2 else np.uint32).astype(np.int64), ends


def fit(texts: DataFrame, shape: Shape, tokens: int, *, rate: float = 0.15) -> np.ndarray:
    """Weights after one pass over all texts (columns doc_id, codes), a share of them in each round."""
    sc = texts.sparkSession.sparkContext
    w, shards = shape.fresh(), shape.shards(tokens / shape.rounds)
    size = -(-len(w) // SLICES)
    draw = F.xxhash64(F.col("doc_id").cast("string"), F.xxhash64("codes"))
    dealt = texts.select("codes", F.pmod(draw, F.lit(shape.rounds)).alias("part"), F.pmod(F.shiftrightunsigned(draw, 20), F.lit(shards)).cast("int").alias("shard"), draw.alias("draw"))
    for k in range(shape.rounds):
        now = sc.broadcast(w)

        def told(shard: int, own: Learner, now=now) -> pa.RecordBatch:
            step = own.close() - now.value
            return pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([shard] * SLICES, pa.int32()), pa.array([own.seen] * SLICES, pa.int64()), pa.array([step[i * size : (i + 1) * size].astype(np.float16).tobytes() for i in range(SLICES)], pa.binary())], ["slice", "shard", "seen", "step"])

        def trained(batches: Iterator[pa.RecordBatch], now=now, told=told) -> Iterator[pa.RecordBatch]:
            at, own = None, None
            for b in slices(batches, 1):
                number = np.asarray(b.column(0))
                for s in np.unique(number).tolist():  # rows come sorted by shard
                    mine = b.filter(pa.array(number == s))
                    if s != at:
                        if own is not None:
                            yield told(at, own)
                        at, own = s, Learner(shape, now.value, rate)
                    ids, ends = _tokens(mine.column(1), shape)
                    own.learn(ids, backs(ends))
            if own is not None:
                yield told(at, own)

        def averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lean()
            total: dict[int, list] = {}
            for b in batches:
                for s, n, x in zip(*(b.column(c) for c in range(3)), strict=True):
                    held = total.setdefault(s.as_py(), [0, 0.0])
                    held[0] += n.as_py()
                    held[1] = held[1] + np.frombuffer(x.as_buffer(), np.float16).astype(np.float64) * n.as_py()
            if total:
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([(x / n).astype(np.float32).tobytes() for n, x in total.values()], pa.binary())], ["slice", "step"])

        own = dealt.filter(F.col("part") == k).select("shard", "codes", "draw").repartition(shards, "shard").sortWithinPartitions("shard", "draw", "codes").select("shard", "codes")
        steps = own.mapInArrow(trained, "slice int, shard int, seen long, step binary").repartition(SLICES, "slice").sortWithinPartitions("slice", "shard").select("slice", "seen", "step")
        w = w.copy()
        for r in steps.mapInArrow(averaged, "slice int, step binary").collect():  # SLICES rows, the tables' size
            w[r.slice * size : (r.slice + 1) * size] += np.frombuffer(r.step, np.float32).reshape(-1, WIDTH)
        now.unpersist()
    return w


def score_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, remainder: int = 2, top_words: int = 500_000, top_bytes: int = 64, rate: float = 0.15, shape: Shape | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Learns from rows whose crc32(id) % modulus is not remainder."""
    save = partial(written, name="maxent")
    rows = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).alias("doc_id"), F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus == remainder, F.lit(False)).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts = save(count_words(rows.filter(~F.col("held_out")).select("text")))
    total, distinct = (x or 0 for x in counts.agg(F.sum("n"), F.count("*")).first())
    words, shape = frequent(counts, top_words, top_bytes), shape or Shape.of(total)
    first = save(coded_rows(rows, words, shape))
    w = fit(first.filter(~F.col("held_out")).select("doc_id", "codes"), shape, total, rate=rate)
    weights = docs.sparkSession.sparkContext.broadcast(w)
    figures = ["key", "doc_id", "held_out", "n_tokens", "near", "seen", "rare_seen", "rare"]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, len(figures)):
            ids, ends = _tokens(b.column(len(figures)), shape)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sums(logs(shape, weights.value, ids, backs(ends)), ends))], [*figures, "model"])

    # a word without a count adds log10(0 + 1) = 0, so only words with one need to be found
    others = counts.filter((F.col("n") < words.cut) & (F.col("word") != END))
    met = first.select("key", F.explode("tail").alias("word")).join(others, "word").groupBy("key").agg(F.sum(F.log10(F.col("n") + 1.0)).alias("far_seen"), F.count("*").alias("far"))
    model = first.select(*figures, "codes").mapInArrow(scored, first.select(*figures).schema.add("model", "double"))
    top, top_sum = min(shape.head, len(words.counts)), int(words.counts[: shape.head].sum())
    all_log, rare_log = float(np.log10(total + distinct + 1.0)), float(np.log10(total - top_sum + distinct - top + 1.0))
    far_seen = F.coalesce("far_seen", F.lit(0.0))
    return model.join(met, "key", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("near") + F.coalesce("far", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("seen") + far_seen - F.col("n_tokens") * F.lit(all_log)).alias("base_score"),
        (F.col("model") + F.col("rare_seen") + far_seen - F.col("rare") * F.lit(rare_log)).alias("score"),
    )
