"""An inverted index over texts: postings by term, in blocks with their bounds, written once and searched by BM25.

A row is a term in a shard of documents: how many hold it, and for each of them its id, place in the shard, occurrences and length.
For each block of BLOCK places in which the term occurs the row also has the most occurrences and the shortest length, from which the highest
weight of the block follows for any parameters of the ranking and any later mean length. The row of the empty term (which no text
holds) has the shard's documents and words. Rows are written into folders by a hash of their term, so a search reads the folders of its terms
only; terms that stand in every document are many rows, of many shards, spread over files and tasks.

A search takes a stated set of queries, a segment at a time, and no text: the postings of a segment's terms are dealt by shard, and a task
goes through its shards with the k best documents of each query so far. Of a shard it scores the blocks that promise most first, one, two,
four and so on together, until no bound reaches the query's kth score. Results are those of `retrieval.bm25`, which goes through the texts.

Later documents are added as further shards by writing to the same folder. Rows without a text take no part; ids should be unique, as
a store's are; an id that repeats is a document of its own in the results. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.taskcontext import TaskContext

from corvane.operators.retrieval import words_of
from corvane.shared import arrow_batches

BLOCK = 64
#: Folders of an index, and shards whose rows share a file of a folder.
BUCKETS, TOGETHER = 16, 64
LISTS = ["ids", "at", "tf", "n", "blocks", "most", "least"]


def postings_of(ids: pa.Array, words: pa.Array, shard: int) -> pa.RecordBatch:
    """The rows of a shard, by term."""
    flat, ends = words.flatten(), np.asarray(words.offsets, dtype=np.int64)
    ends = ends - ends[0]
    doc = np.repeat(np.arange(len(ids)), np.diff(ends))
    real = np.asarray(pc.not_equal(flat, ""))
    flat, doc = flat.filter(pa.array(real)), doc[real]
    coded = flat.dictionary_encode()
    order = np.asarray(pc.sort_indices(coded.dictionary))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    found, tf = np.unique(rank[np.asarray(coded.indices)] * len(ids) + doc, return_counts=True) if len(flat) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    term, at = found // max(1, len(ids)), found % max(1, len(ids))
    length = np.bincount(doc, minlength=len(ids))
    n, block = length[at], at // BLOCK
    first = np.flatnonzero(np.diff(term * (len(ids) // BLOCK + 1) + block, prepend=-1))
    bounds = np.searchsorted(term, np.arange(len(order) + 1))
    block_bounds = np.searchsorted(term[first], np.arange(len(order) + 1))
    most, least = (np.maximum.reduceat(tf, first), np.minimum.reduceat(n, first)) if len(first) else (tf, n)

    def lists(values: pa.Array, cuts: np.ndarray) -> pa.Array:
        # the row of the empty term comes first, with empty lists
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], cuts)), pa.int32()), values)

    numbers = lambda v: pa.array(v.astype(np.int32))
    columns = [pa.concat_arrays([pa.array([""]), coded.dictionary.take(pa.array(order))]), pa.array(np.full(len(order) + 1, shard)), pa.array(np.concatenate(([len(ids)], np.diff(bounds)))), pa.array(np.concatenate(([len(flat)], np.add.reduceat(tf, bounds[:-1]) if len(tf) else []))).cast(pa.int64())]
    columns += [lists(ids.take(pa.array(at)), bounds), *(lists(numbers(v), bounds) for v in (at, tf, n)), *(lists(numbers(v), block_bounds) for v in (block[first], most, least))]
    return pa.RecordBatch.from_arrays(columns, ["term", "shard", "docs", "words", *LISTS])


def write(docs: DataFrame, path: str, *, id_col: str, text_col: str, shard_docs: int = 4096, shard_words: int = 1_000_000, mode: str = "append") -> None:
    """Index documents into the folder: shards of shard_docs documents, or fewer that hold some shard_words words."""
    found = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), words_of(text_col).alias("words"))
    base = F.shiftleft(F.pmod(F.xxhash64(F.lit(path), F.current_timestamp()), F.lit(1 << 22)), 41)  # one for each call: shards that are added never meet old ones

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, words, turn = [], 0, 0, 0

        def shard() -> pa.RecordBatch:
            nonlocal turn
            turn += 1
            ids, lists = (pa.concat_arrays([b.column(c) for b in held]) for c in (0, 1))
            return postings_of(ids, lists, (TaskContext.get().partitionId() << 20) + turn)

        for b in batches:
            size = np.asarray(pc.list_value_length(b.column(1)), dtype=np.int64)
            start = 0
            for i in range(b.num_rows):
                n, words = n + 1, words + int(size[i])
                if n >= shard_docs or words >= shard_words:
                    held.append(b.slice(start, i + 1 - start))
                    yield shard()
                    held, n, words, start = [], 0, 0, i + 1
                    pa.default_memory_pool().release_unused()
            if start < b.num_rows:
                held.append(b.slice(start))
        if n:
            yield shard()

    kinds = {"ids": found.schema["id"].dataType}
    schema = T.StructType([T.StructField("term", T.StringType()), T.StructField("shard", T.LongType()), T.StructField("docs", T.LongType()), T.StructField("words", T.LongType()), *(T.StructField(c, T.ArrayType(kinds.get(c, T.IntegerType()))) for c in LISTS)])
    out = found.mapInArrow(indexed, schema).withColumn("shard", F.col("shard") + base).withColumn("bucket", bucket_of(F.col("term")))
    dealt = out.repartition("bucket", F.shiftright("shard", 20), F.floor(F.col("shard") % (1 << 20) / TOGETHER)).sortWithinPartitions("bucket", "term", "shard")
    with arrow_batches(docs.sparkSession):
        dealt.write.mode(mode).partitionBy("bucket").parquet(path)


def bucket_of(term):
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


class Ranking:
    """The k best documents of each query that a task has met, and what it has read for them."""

    def __init__(self, idf: np.ndarray, wanted: list[np.ndarray], mean: float, k: int, k1: float, b: float):
        self.idf, self.wanted, self.mean, self.k, self.k1, self.b = idf, wanted, mean, k, k1, b
        self.best: list[list[tuple]] = [[] for _ in wanted]
        self.read = self.total = 0

    def weight(self, place: np.ndarray, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.idf[place] * tf * (self.k1 + 1) / np.maximum(tf + self.k1 * (1 - self.b + self.b * n / self.mean), 1e-12)

    def shard(self, batch: pa.Table) -> None:
        """batch: place and the lists of the asked terms' rows of a shard."""
        lists = {c: batch.column(c).combine_chunks() for c in LISTS}
        flat = {c: lists[c].flatten() for c in LISTS}
        at, tf, n, blocks = (flat[c].to_numpy() for c in ("at", "tf", "n", "blocks"))
        place = batch.column("place").to_numpy()
        ends = np.concatenate(([0], np.cumsum(np.asarray(pc.list_value_length(lists["at"])))))
        sizes = np.asarray(pc.list_value_length(lists["blocks"]))
        weight = self.weight(np.repeat(place, np.diff(ends)), tf, n)
        bound = np.zeros((len(place), int(blocks.max(initial=0)) + 1))
        rows = np.repeat(np.arange(len(place)), sizes)
        bound[rows, blocks] = self.weight(place[rows], flat["most"].to_numpy(), flat["least"].to_numpy())
        row_of = np.full(len(self.idf), -1)
        row_of[place] = np.arange(len(place))
        block, docs = at // BLOCK, int(at.max(initial=0)) + 1
        for j, asked in enumerate(self.wanted):
            mine = row_of[asked]
            mine = mine[mine >= 0]
            if not len(mine):
                continue
            own = np.concatenate([np.arange(ends[r], ends[r + 1]) for r in mine.tolist()])
            self.total += len(own)
            most = bound[mine].sum(axis=0)
            order, done, step = np.argsort(-most, kind="stable"), 0, 1
            while done < len(order):
                low = -self.best[j][-1][0] if len(self.best[j]) == self.k else 0.0
                some = np.zeros(len(most), bool)
                some[order[done : done + step]] = True
                some &= (most > 0) & (most + 1e-4 >= low)  # scores are rounded, so a bound may miss the kth score by half a unit
                if not some.any():
                    break
                self.score(j, own[some[block[own]]], at, weight, docs, flat["ids"])
                done, step = done + step, 2 * step

    def score(self, j: int, own: np.ndarray, at: np.ndarray, weight: np.ndarray, docs: int, ids: pa.Array) -> None:
        if not len(own):
            return
        self.read += len(own)
        total = np.bincount(at[own], weight[own], docs)
        posting = np.full(docs, -1)
        posting[at[own]] = own  # a document's id stands at each of its postings
        met = np.flatnonzero(posting >= 0)
        s = np.round(total[met], 4)
        if len(s) > self.k:
            keep = s >= np.partition(s, len(s) - self.k)[len(s) - self.k]
            met, s = met[keep], s[keep]
        if len(self.best[j]) == self.k:
            keep = -s <= self.best[j][-1][0]
            met, s = met[keep], s[keep]
        names = ids.take(pa.array(posting[met])).to_pylist()
        self.best[j] = sorted(self.best[j] + [(-v, i) for v, i in zip(s.tolist(), names, strict=True)])[: self.k]


def search(queries: DataFrame, index: DataFrame, *, query_key: str, query_text: str, key: str, k: int = 10, k1: float = 1.2, b: float = 0.75, segment: int = 1024, work: bool = False) -> DataFrame:
    """(query, key, score, rank) of the k best documents of each query, as `retrieval.bm25` gives them.

    work: instead a row for each task with the postings that it scored, and those that its queries' terms have (a posting of n queries counts n times).
    """
    spark = index.sparkSession
    asked = queries.select(F.col(query_key), F.array_distinct(F.filter(words_of(query_text), lambda w: w != "")).alias("terms"))
    n_docs, n_words = (x or 0 for x in index.filter((F.col("bucket") == bucket_of(F.lit(""))) & (F.col("term") == "")).agg(F.sum("docs"), F.sum("words")).first())
    schema = T.StructType([queries.schema[query_key], T.StructField(key, index.schema["ids"].dataType.elementType), T.StructField("score", T.DoubleType())])
    if work:
        schema = T.StructType([T.StructField("scored", T.LongType()), T.StructField("postings", T.LongType())])
    ids_type = to_arrow_type(index.schema["ids"].dataType.elementType)
    out, mean = spark.createDataFrame([], schema), max(n_words / max(1, n_docs), 1e-12)
    parts = -(-asked.count() // segment)
    for part in range(parts):
        mine = [r for r in asked.filter(F.pmod(F.xxhash64(query_key), F.lit(parts)) == part).collect() if r.terms]
        terms = sorted({t for r in mine for t in r.terms})
        if not terms:
            continue
        place = {t: i for i, t in enumerate(terms)}
        names = spark.createDataFrame(list(place.items()), "term string, place long")
        folders = sorted(r[0] for r in names.select(bucket_of(F.col("term"))).distinct().collect())
        met = index.filter(F.col("bucket").isin(*folders)).join(F.broadcast(names), "term")  # a segment's terms
        df = np.zeros(len(terms))
        for r in met.groupBy("place").agg(F.sum("docs").alias("docs")).collect():  # a row for each term asked for
            df[r.place] = r.docs
        idf = np.log(1 + (n_docs - df + 0.5) / (df + 0.5))
        shared = spark.sparkContext.broadcast((idf, [np.array([place[t] for t in r.terms]) for r in mine], pa.array([r[query_key] for r in mine])))

        def ranked(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            idf, wanted, keys = shared.value
            state, held, at = Ranking(idf, wanted, mean, k, k1, b), [], None
            for batch in batches:
                shards = batch.column(0).to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
                for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                    if i == j:
                        continue
                    if held and shards[i] != at:
                        state.shard(pa.Table.from_batches(held))
                        held = []
                    at = shards[i]
                    held.append(batch.slice(i, j - i))
            if held:
                state.shard(pa.Table.from_batches(held))
            if work:
                yield pa.RecordBatch.from_arrays([pa.array([state.read]), pa.array([state.total])], schema.names)
                return
            found = [(j, i, -s) for j, own in enumerate(state.best) for s, i in own]
            rows = pa.array([j for j, _, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays([keys.take(rows), pa.array([i for _, i, _ in found], ids_type), pa.array([s + 0.0 for _, _, s in found], pa.float64())], schema.names)

        dealt = met.select("shard", "place", *LISTS).repartition("shard").sortWithinPartitions("shard")
        out = out.unionByName(dealt.mapInArrow(ranked, schema))
    if work:
        return out
    rank = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("score"), key))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k)
