"""Near duplicates by ProbMinHash, banding and verification.

Each text becomes its set of 5-word shingles. Every shingle emits a Poisson process of its weight's rate; an arrival lands in a
random register, which keeps its earliest. A shingle stops when its next arrival comes later than every register's, so long texts
cost little more than one arrival a shingle. All weights are one, however often a shingle repeats, so two registers agree with the
probability that is the Jaccard similarity of the shingle sets. Bands of registers propose by it, and the same similarity decides.

No group is gathered or paired out. Texts with one shingle set are one node. In each band bucket every node is verified against
the bucket's leader, so a bucket costs a row per member. Pairs that miss each other there are looked for afterwards: where a
bucket still holds several components, its members are compared in blocks inside the tasks, which return only links that join
components. So every candidate pair is verified or already in one component.

The sets are compared by 32 bits of their shingles' codes: two texts of m and n shingles share m * n / 2^32 of them by chance on average,
which moves a similarity by n / 2^33 for equal lengths, so by 0.0001 at a million words and by less below.

Defined results: a text without a word is in a class of its own; shorter texts are one shingle of all their words; rows without
an id are left out (`keep_first` compares them too); repeated rows fall into one class; other columns are ignored, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import batch_groups, hinted, lean, slices, small_side, split_words, written
from corvane.operators.graph import connected_components

_GOLD, _P = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x100000001B3)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: pa.Array) -> np.ndarray:
    import xxhash

    coded = words.dictionary_encode()
    each = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(coded.dictionary))
    return each[np.asarray(coded.indices)] if len(words) else each


def shingles(hashes: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: text index, code and count, sorted by text and code."""
    n = np.diff(ends)
    code = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for k in range(width):
        code = code * _P + hashes[k : k + len(code)]
    row = np.repeat(np.arange(len(n)), n)
    full = row[: len(code)] == row[width - 1 :] if len(code) else np.zeros(0, bool)
    code, row = code[full], row[: len(full)][full]
    few = np.flatnonzero((n > 0) & (n < width))
    if len(few):
        whole = []
        for i in few.tolist():
            x = np.full(1, n[i], np.uint64)
            for h in hashes[ends[i] : ends[i + 1]]:
                x = mix(x * _P + h)
            whole.append(x)
        code, row = np.concatenate((code, *whole)), np.concatenate((row, few))
    code = mix(code)
    order = np.lexsort((code, row))
    code, row = code[order], row[order]
    first = np.flatnonzero(np.concatenate(([True], (code[1:] != code[:-1]) | (row[1:] != row[:-1])))) if len(code) else np.zeros(0, np.int64)
    return row[first], code[first], np.diff(np.concatenate((first, [len(code)])))


def prob_minhash(row: np.ndarray, code: np.ndarray, weight: np.ndarray, n_rows: int, registers: int) -> np.ndarray:
    """Signatures (n_rows x registers). Arrivals go on only for shingles that can still be the earliest of some register."""
    best, sign = np.full(n_rows * registers, np.inf), np.zeros(n_rows * registers, np.uint64)
    time, turn = np.zeros(len(code)), 0
    while len(code):
        turn += 1
        draw = mix(code + np.uint64(turn * int(_GOLD) & (1 << 64) - 1))
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / weight
        place = row * registers + (mix(draw ^ _GOLD) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(best, place, time)
        won = best[place] == time
        sign[place[won]] = code[won]
        live, where = np.unique(row, return_inverse=True)
        worst = best.reshape(n_rows, registers)[live].max(axis=1)
        on = time < worst[where]
        row, code, weight, time = row[on], code[on], weight[on], time[on]
    return sign.reshape(n_rows, registers)


def band_keys(sign: np.ndarray, bands: int) -> np.ndarray:
    parts = sign.reshape(len(sign), bands, -1)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _GOLD, parts.shape[:2]).copy()
    for k in range(parts.shape[2]):
        key = mix(key * _P + parts[:, :, k])
    return key.view(np.int64)


def digest_of(text_col: str) -> Column:
    """A text's digest; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))


def signed(docs: DataFrame, *, id_col: str, text_col: str, width: int, bands: int, rows: int, block_words: int = 150_000) -> DataFrame:
    """key, doc_id, digest (of the text), node (digest of the shingle set; null without a word), n (shingles), bands, codes (sorted 32-bit shingles)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in slices(batches, 3):
            words, ends = split_words(b.column(3))
            hashes = word_hashes(words)
            for i, j in batch_groups(np.diff(ends), block_words):
                own = ends[i : j + 1] - ends[i]
                row, code, _ = shingles(hashes[ends[i] : ends[j]], own, width)
                keys = band_keys(prob_minhash(row, code, np.ones(len(code)), j - i, bands * rows), bands)
                cuts = np.searchsorted(row, np.arange(j - i + 1))
                nodes, codes, sizes = [], [], []
                for k in range(j - i):
                    mine = code[cuts[k] : cuts[k + 1]]
                    nodes.append(xxhash.xxh3_128_digest(mine.tobytes()) if len(mine) else None)
                    short = np.unique((mine >> np.uint64(32)).astype(np.uint32))
                    codes.append(short.tobytes())
                    sizes.append(len(short))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (j - i + 1) * bands, bands), pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, j - i) for c in range(3)), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int32()), lists, pa.array(codes, pa.binary())], ["key", "doc_id", "digest", "node", "n", "bands", "codes"])

    ready = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).cast("long").alias("doc_id"), digest_of(text_col).alias("digest"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return ready.mapInArrow(sign, "key long, doc_id long, digest binary, node binary, n int, bands array<bigint>, codes binary")


def verified(pairs: DataFrame, sets: DataFrame, *, part_bytes: int = 8 << 20) -> DataFrame:
    """pairs: a, b, with each a standing in many pairs perhaps. Returns a, b, similarity.

    Rows are dealt by a and a salt, so many that a part holds about part_bytes of sets, and pass by in order: first the set of a,
    then those of its partners. Memory is one set and one Arrow batch.
    """
    sized = pairs.join(sets.select(F.col("node").alias("b"), "n"), "b")
    salts = written(sized.groupBy("a").agg(F.ceil(F.sum(F.col("n") * 4 + 64) / part_bytes).cast("int").alias("parts")), "salts")
    # only an a of several parts is looked up: there are at most as many as part_bytes fit into all pairs' sets, and they are counted
    several = hinted(salts.filter("parts > 1"), 200_000)
    right = pairs.join(several, "a", "left").select("a", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"), F.col("b").alias("node"), F.lit(1).alias("side"))
    left = salts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("a").alias("node"), F.lit(0).alias("side"))
    rows = left.union(right).join(sets.select("node", "codes"), "node")
    dealt = rows.repartition("a", "part").sortWithinPartitions("a", "part", "side").select("a", "node", "side", "codes")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        held = np.zeros(0, np.uint32)
        for b in batches:
            first, second, found = [], [], []
            for a, node, side, codes in zip(*(b.column(k) for k in range(4)), strict=True):
                own = np.frombuffer(codes.as_buffer(), np.uint32)
                if side.as_py() == 0:
                    held = own
                    continue
                both = np.concatenate((held, own))
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                first.append(a.as_py())
                second.append(node.as_py())
                found.append(shared / (len(both) - shared))
            yield pa.RecordBatch.from_arrays([pa.array(first, pa.binary()), pa.array(second, pa.binary()), pa.array(found, pa.float64())], ["a", "b", "similarity"])

    return dealt.mapInArrow(compared, "a binary, b binary, similarity double")


def joined_components(parts: list[int], codes: list[np.ndarray], threshold: float, chunk: int = 2048) -> list[tuple[int, int]]:
    """Of some sets, each in a component: pairs of sets that join different components, one less than the components they join."""
    n = np.array([len(c) for c in codes], np.float32)
    owner, (_, shingle, freq) = np.repeat(np.arange(len(codes)), n.astype(np.int64)), np.unique(np.concatenate(codes), return_inverse=True, return_counts=True)
    often = freq[shingle] > 1
    owner, shingle = owner[often], (np.cumsum(freq > 1) - 1)[shingle[often]]
    order = np.argsort(shingle, kind="stable")
    owner, shingle = owner[order], shingle[order]
    both = np.zeros((len(codes), len(codes)), np.float32)
    for a in range(0, int(shingle[-1]) + 1 if len(shingle) else 0, chunk):
        i, j = np.searchsorted(shingle, [a, a + chunk])
        x = np.zeros((len(codes), chunk), np.float32)
        x[owner[i:j], shingle[i:j] - a] = 1
        both += x @ x.T
    part = np.array(parts)
    first, second = np.nonzero(np.triu(both >= threshold * (n[:, None] + n[None, :] - both) - 1e-3, 1) & (part[:, None] != part[None, :]))
    root = {p: p for p in {*parts}}

    def top(p: int) -> int:
        while root[p] != p:
            root[p] = root[root[p]]
            p = root[p]
        return p

    _, once = np.unique(part[first] * (max(parts) + 1) + part[second], return_index=True)
    out = []
    for k in once.tolist():
        a, b = top(parts[first[k]]), top(parts[second[k]])
        if a != b:
            root[a] = b
            out.append((int(first[k]), int(second[k])))
    return out


def across(rest: DataFrame, sets: DataFrame, threshold: float, *, block_nodes: int = 1500, block_shingles: int = 1_000_000) -> DataFrame:
    """rest: bucket, node, component. Links (src, dst) that join components of a bucket.

    A bucket is cut into blocks by hash, and each pair of its blocks is compared inside a task as a matrix product, so neither
    memory nor the rows that leave a task grow with the bucket: a task returns fewer links than it holds components.
    """
    sized = rest.join(sets.select("node", "n"), "node")
    blocks = sized.groupBy("bucket").agg(F.ceil(F.greatest(F.count("*") / block_nodes, F.sum("n") / block_shingles)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = sized.join(blocks, "bucket").select("bucket", "node", "component", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("bucket", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "node", "component").join(sets.select("node", "codes"), "node")
    ready = dealt.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high").select("bucket", "low", "high", "node", "component", "codes")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        at, nodes, parts, codes = None, [], [], []

        def told() -> pa.RecordBatch:
            place: dict[bytes, int] = {}
            pairs = joined_components([place.setdefault(p, len(place)) for p in parts], codes, threshold) if len(nodes) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([nodes[p[k]] for p in pairs], pa.binary()) for k in (0, 1)], ["src", "dst"])

        for b in batches:
            keys = list(zip(*(b.column(k).to_pylist() for k in range(3)), strict=True))
            for key, node, part, code in zip(keys, b.column(3), b.column(4), b.column(5), strict=True):
                if key != at and nodes:
                    yield told()
                    nodes, parts, codes = [], [], []
                at = key
                nodes.append(node.as_py())
                parts.append(part.as_py())
                codes.append(np.frombuffer(code.as_buffer(), np.uint32).copy())
        if nodes:
            yield told()

    return ready.mapInArrow(compared, "src binary, dst binary")


def classified(docs: DataFrame, *, id_col: str, text_col: str, threshold: float, width: int, bands: int, rows: int) -> DataFrame:
    """doc_id, digest, first (the smallest (no id, doc_id, digest) of the class; null without a word) and class_size, for each row."""
    save = partial(written, name="near-duplicates")
    signs = save(signed(docs, id_col=id_col, text_col=text_col, width=width, bands=bands, rows=rows))
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")
    nodes = save(signs.filter("node is not null").groupBy("node").agg(F.min(own).alias("first"), F.count("*").alias("copies"), F.min(F.struct("key", "n", "bands")).alias("x")).select("node", "first", "copies", "x.key", "x.n", "x.bands"))
    spread = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.count("*").alias("held")).filter("held > 1")
    members = save(spread.join(shared, "bucket"))
    # the leader of a bucket is the node that meets others most often: of the copies of a text most likely the text itself
    met = members.groupBy("node").agg(F.sum("held").alias("met"))
    leaders = members.join(met, "node").groupBy("bucket").agg(F.max(F.struct("met", "node"))["node"].alias("leader"))
    members = save(members.select("bucket", "node").join(leaders, "bucket"))
    pairs = save(members.filter("node != leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct())
    wanted = small_side(nodes.select("node", "key", "n").join(members.select("node").distinct(), "node", "left_semi").select("key"), 1_000_000)
    sets = save(signs.select("key", "node", "n", "codes").join(wanted, "key", "left_semi").select("node", "n", "codes"))
    close = save(verified(pairs, sets))
    links = close.filter(F.col("similarity") >= threshold).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    found = save(connected_components(links, save))
    # buckets that still hold several components: links between them
    placed = members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x != y").select("bucket")
    rest = save(placed.join(mixed, "bucket").filter("node != leader").select("bucket", "node", "component"))
    late = save(across(rest, sets, threshold))
    if not late.isEmpty():
        found = save(connected_components(links.union(late), save))
    classes = nodes.select("node", "first", "copies").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = classes.groupBy("component").agg(F.min("first").alias("first"), F.sum("copies").alias("class_size"))
    named = classes.select("node", "component").join(named, "component").select("node", "first", "class_size")
    return signs.select("doc_id", "digest", "node").join(named, "node", "left").select("doc_id", "digest", "first", "class_size")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, width: int = 5, bands: int = 20, rows: int = 5) -> DataFrame:
    """doc_id, class_id (the smallest id of its class) and class_size, a row for each row with an id."""
    out = classified(docs.filter(F.col(id_col).cast("long").isNotNull()), id_col=id_col, text_col=text_col, threshold=threshold, width=width, bands=bands, rows=rows)
    return out.select("doc_id", F.coalesce("first.doc_id", "doc_id").alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"))


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, width: int = 5, bands: int = 20, rows: int = 5) -> DataFrame:
    """The rows, columns unchanged, of which each class keeps one: that with the smallest id (rows without one come last), then the smallest digest of its text.

    Rows are told apart by id and text, so texts that share an id are classed each on its own. Of rows that repeat id and text the
    one that is first as JSON stays. Texts without a word stay, one for each id.
    """
    found = written(classified(docs, id_col=id_col, text_col=text_col, threshold=threshold, width=width, bands=bands, rows=rows), "classes")
    named = found.select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"), "first")
    other = ~(F.col("__id").eqNullSafe(F.col("first.doc_id")) & (F.col("__digest") == F.col("first.digest")))
    gone = small_side(named.filter(F.col("first").isNotNull() & other).select("__id", "__digest").distinct(), 1_000_000)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row")
    own = docs.select(row, F.col(id_col).cast("long").alias("__i"), digest_of(text_col).alias("__d"))
    match = lambda side: F.col("__i").eqNullSafe(side["__id"]) & (F.col("__d") == side["__digest"])
    out = own.join(gone, match(gone), "left_anti")
    twice = written(named.groupBy("__id", "__digest").count().filter("count > 1").select("__id", "__digest"), "repeated")
    if twice.isEmpty():
        return out.select("__row.*")
    # the group is that of the id itself, which need not be a number
    one = out.join(twice, match(twice), "left_semi").groupBy(F.col(f"__row.`{id_col}`").alias("__key"), "__d").agg(F.min_by("__row", F.to_json("__row")).alias("__row"))
    return out.join(twice, match(twice), "left_anti").select("__row").unionByName(one.select("__row")).select("__row.*")
