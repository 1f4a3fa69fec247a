"""Vector stores as tables: exact filtered top-k, an inverted-cell index, statistics and quality."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions import vectors as vx
from corvane.functions.filters import matches

#: Queries that are held against the store at a time.
SEGMENT = 2048
#: Scores that a task holds at a time.
SCORES = 1 << 20


def add(store: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """store with rows added; a row replaces the one with its key."""
    return store.join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def delete(store: DataFrame, ids: list[Any], key: str) -> DataFrame:
    return store.filter(~F.col(key).isin(*ids)) if ids else store


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(n > 0, n, 1)


def scores(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Queries by rows, as one matrix product; for cosine both sides have unit length or are zero."""
    if metric == "l2":
        return 1 / (1 + np.maximum((q * q).sum(axis=1)[:, None] + (x * x).sum(axis=1)[None, :] - 2 * (q @ x.T), 0))
    return q @ x.T


def best_of(found: np.ndarray, keys: list, k: int) -> Iterator[tuple[int, int]]:
    """(query, row) of the k best rows of each query, ties to the smaller key."""
    for i, row in enumerate(found):
        if len(row) > k:
            hits = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k])
        else:
            hits = np.arange(len(row))
        for j in sorted(hits.tolist(), key=lambda j: (-row[j], keys[j]))[:k]:
            yield i, j


def top_k(queries: DataFrame, store: DataFrame, *, k: int = 5, metric: str = "cosine", filters: dict | None = None, threshold: float = 0.0, query_key: str = "query_id", query_vector: str = "query_vector", key: str = "vec_id", vector: str = "embedding", digits: int = 6, keep: list[str] | None = None, cell: str | None = None, probes: dict[Any, list[int]] | None = None) -> DataFrame:
    """The k best stored rows of each query, filtered first, ties (of rounded scores) to the smaller key; a threshold above 0 drops lower scores afterwards.

    Queries are a stated set, taken SEGMENT at a time: a segment is sent to the tasks, which score the rows they hold as matrix
    products and let k rows a query and batch through. Rows without a vector take no part.
    """
    if metric not in ("cosine", "ip", "l2"):
        raise ValueError(f"no such metric: {metric}")
    spark, k = store.sparkSession, k or 5
    found = store.filter(matches(filters, store.columns)) if filters else store
    found = found.filter(F.col(vector).isNotNull()).select(key, *(keep or []), *([cell] if cell else []), F.col(vector).cast("array<double>").alias("__x"))
    n_kept = 1 + len(keep or [])
    asked = queries.filter(F.col(query_vector).isNotNull()).select(F.col(query_key), F.col(query_vector).cast("array<double>").alias("__q"))
    parts = -(-asked.count() // SEGMENT)
    schema = T.StructType([asked.schema[query_key], *found.schema.fields[:n_kept], T.StructField("score", T.DoubleType())])
    if not parts:
        return spark.createDataFrame([], schema).withColumn("rank", F.lit(1))
    out = None
    for part in range(parts):
        mine = asked.filter(F.pmod(F.xxhash64(query_key), F.lit(parts)) == part).toArrow()
        ids = mine.column(0).combine_chunks()
        q = _matrix(mine.column(1).combine_chunks()) if len(ids) else np.zeros((0, 1))
        allowed = None if probes is None else [set(probes[i]) for i in ids.to_pylist()]
        shared = spark.sparkContext.broadcast((ids, _unit(q) if metric == "cosine" else q, allowed))

        def near(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q, allowed = shared.value
            for b in batches:
                if not b.num_rows or not len(ids):
                    continue
                x, keys = _matrix(b.column(b.num_columns - 1)), b.column(0).to_pylist()
                x = _unit(x) if metric == "cosine" else x
                cells = None if allowed is None else b.column(n_kept).to_pylist()
                at, rows, told = [], [], []
                step = max(1, SCORES // b.num_rows)
                for low in range(0, len(q), step):
                    s = np.round(scores(q[low : low + step], x, metric), digits)
                    if allowed is not None:
                        s[np.array([[c not in a for c in cells] for a in allowed[low : low + step]])] = -np.inf
                    for i, j in best_of(s, keys, k):
                        if s[i, j] > -np.inf:
                            at.append(low + i)
                            rows.append(j)
                            told.append(float(s[i, j]) + 0.0)
                taken = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), *(b.column(c).take(taken) for c in range(n_kept)), pa.array(told, pa.float64())], schema.names)

        got = found.mapInArrow(near, schema)
        out = got if out is None else out.unionByName(got)
    rank = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("score"), key))
    out = out.withColumn("rank", rank).filter(F.col("rank") <= k)
    return out.filter(F.col("score") >= threshold) if threshold > 0 else out


def centroids_of(store: DataFrame, n: int, *, key: str = "vec_id", vector: str = "embedding", sample: int = 16_384, rounds: int = 8) -> np.ndarray:
    """n centres by spherical k-means over the `sample` stored rows of smallest hash (a bounded sample; every row is indexed)."""
    picked = store.filter(F.col(vector).isNotNull()).select(F.xxhash64(key).alias("h"), F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("x")).orderBy("h", "k").limit(sample).collect()
    x = _unit(np.array([r.x for r in picked]))
    centres = x[:n].copy()
    for _ in range(rounds):
        near = (x @ centres.T).argmax(axis=1)
        for c in np.unique(near).tolist():
            centres[c] = x[near == c].sum(axis=0)
        centres = _unit(centres)
    return centres


def cells(store: DataFrame, centres: np.ndarray, *, vector: str = "embedding") -> DataFrame:
    """store with the cell of its nearest centre, told inside the row."""
    shared, at = store.sparkSession.sparkContext.broadcast(centres), store.columns.index(vector)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(at))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array((x @ shared.value.T).argmax(axis=1) if len(x) else [], pa.int32())], [*b.schema.names, "cell"])

    schema = T.StructType([*store.schema.fields, T.StructField("cell", T.IntegerType())])
    return store.filter(F.col(vector).isNotNull()).mapInArrow(near, schema)


def top_k_cells(queries: DataFrame, indexed: DataFrame, centres: np.ndarray, *, probes: int, k: int = 5, query_key: str = "query_id", query_vector: str = "query_vector", **options: Any) -> DataFrame:
    """top_k over the `probes` cells nearest to each query; rows of cells that no query probes are not read."""
    asked = queries.select(query_key, F.col(query_vector).cast("array<double>").alias("x")).collect()  # the stated queries
    order = np.argsort(-(np.array([r.x for r in asked]) @ centres.T), axis=1, kind="stable")[:, :probes] if asked else np.zeros((0, probes), int)
    wanted = {r[query_key]: o.tolist() for r, o in zip(asked, order, strict=True)}
    used = sorted({c for o in wanted.values() for c in o})
    return top_k(queries, indexed.filter(F.col("cell").isin(*used)) if used else indexed.limit(0), k=k, query_key=query_key, query_vector=query_vector, cell="cell", probes=wanted, **options)


def mean_vectors(df: DataFrame, by: str, vector: str, digits: int = 6) -> DataFrame:
    """(by, dim, value): element-wise means, as a long text's vector is that of its pieces."""
    return df.select(by, F.posexplode(vector).alias("dim", "x")).groupBy(by, "dim").agg(F.round(F.avg(F.col("x").cast("double")), digits).alias("value"))


def store_stats(store: DataFrame, vector: str = "embedding", *, kind: str = "flat", metric: str = "cosine") -> DataFrame:
    """Vectors, dimensions, and the index's kind and metric."""
    return store.agg(F.count("*").alias("total_vectors"), F.coalesce(F.max(F.size(vector)), F.lit(0)).alias("dimension"), F.coalesce(F.min(F.size(vector)), F.lit(0)).alias("smallest_dimension"), F.lit(kind).alias("kind"), F.lit(metric).alias("metric"))


def memory_mb(chunks: DataFrame, dim: int, text: str = "text") -> DataFrame:
    return chunks.agg(F.round((F.coalesce(F.sum(F.octet_length(text)), F.lit(0)) + F.count("*") * dim * 4) / (1024.0 * 1024.0), 4).alias("memory_mb"))


def quality_at_k(found: DataFrame, relevant: DataFrame, k: int, *, query_key: str = "query_id", key: str = "vec_id") -> DataFrame:
    """Mean precision, recall and F1 at k over queries. relevant: (query, key) pairs."""
    hits = found.filter(F.col("rank") <= k).join(relevant, [query_key, key], "left_semi").groupBy(query_key).agg(F.count("*").alias("hits"))
    wanted = relevant.groupBy(query_key).agg(F.count("*").alias("wanted"))
    each = found.select(query_key).distinct().join(hits, query_key, "left").join(wanted, query_key, "left").na.fill(0, ["hits", "wanted"])
    return _means(each, k)


def _means(each: DataFrame, k: int) -> DataFrame:
    """Mean precision, recall and F1 of (hits, wanted) of each query."""
    p, r = F.col("hits") / k, F.coalesce(F.col("hits") / F.nullif("wanted", F.lit(0)), F.lit(0.0))
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return each.agg(F.round(F.avg(p), 6).alias("precision"), F.round(F.avg(r), 6).alias("recall"), F.round(F.avg(f1), 6).alias("f1"))


def quality_by_label(found: DataFrame, labels: DataFrame, k: int, *, query_key: str = "query_id", key: str = "vec_id", label: str = "label") -> DataFrame:
    """As quality_at_k, where a query's relevant rows are the others of its own label. labels: (key, label) of all rows, the queries among them.

    What is wanted is counted once a label and hits are told by the found rows' labels, so relevant pairs are never listed.
    """
    own = labels.select(F.col(key).alias(query_key), F.col(label).alias("__own"))
    told = found.filter(F.col("rank") <= k).select(query_key, key).join(labels.select(key, label), key, "left").join(own, query_key, "left")
    hits = told.groupBy(query_key, "__own").agg(F.count_if(F.col(label) == F.col("__own")).alias("hits"))
    sizes = labels.groupBy(F.col(label).alias("__own")).agg((F.count("*") - 1).alias("wanted"))
    return _means(hits.join(sizes, "__own", "left").na.fill(0, ["hits", "wanted"]), k)


def valid(df: DataFrame, vector: str, dim: int) -> Column:
    return vx.sound(F.col(vector), dim)
