"""Text retrieval: BM25, recency, and the routing, merging, reranking and fusion of rankings."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.operators.vector_search import best_of


def words_of(text_col: str) -> Column:
    """Lower-case runs of ASCII letters and digits; an empty string may stand at either end."""
    return F.split(F.lower(text_col), "[^a-z0-9]+")


def _words(text_col: str) -> Column:
    return F.filter(words_of(text_col), lambda w: w != "")


def _among(terms: list[str], w: Column) -> Column:
    return w.isin(*terms)


def bm25(docs: DataFrame, queries: DataFrame, *, id_col: str, text_col: str, query_key: str, query_text: str, k: int = 10, k1: float = 1.2, b: float = 0.75, segment: int = 1024) -> DataFrame:
    """(query, doc, score, rank) of the k best documents of each query, among those with a term of it; ties to the smaller id.

    Queries are a stated set, taken `segment` at a time: a segment's terms are counted in the documents, then documents are scored
    as products of their terms' weights and the queries' terms, and let k rows a query and batch through. Other words leave a
    document's array before anything is exploded.
    """
    spark = docs.sparkSession
    asked = queries.select(F.col(query_key), F.array_distinct(_words(query_text)).alias("terms"))
    sized = docs.select(id_col, _words(text_col).alias("w")).withColumn("n", F.size("w"))
    n_docs, mean = sized.agg(F.count("*"), F.avg("n")).first()
    schema = T.StructType([queries.schema[query_key], docs.schema[id_col], T.StructField("score", T.DoubleType())])
    parts, out = -(-asked.count() // segment), spark.createDataFrame([], schema)
    for part in range(parts):
        mine = asked.filter(F.pmod(F.xxhash64(query_key), F.lit(parts)) == part).collect()
        terms = sorted({t for r in mine for t in r.terms})
        place = {t: i for i, t in enumerate(terms)}
        if not terms:
            continue
        met = sized.select(id_col, "n", F.filter("w", partial(_among, terms)).alias("w")).filter(F.size("w") > 0)
        df = np.zeros(len(terms))
        for r in met.select(F.explode(F.array_distinct("w")).alias("t")).groupBy("t").count().collect():  # a row for each term asked for
            df[place[r.t]] = r["count"]
        idf = np.log(1 + (n_docs - df + 0.5) / (df + 0.5))
        wanted = np.zeros((len(terms), len(mine)))
        for j, r in enumerate(mine):
            wanted[[place[t] for t in r.terms], j] = 1
        keys = pa.array([r[query_key] for r in mine])
        shared = spark.sparkContext.broadcast((place, idf, wanted, keys))

        def scored(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            place, idf, wanted, keys = shared.value
            for whole in batches:
                for a in range(0, whole.num_rows, 256):
                    x = whole.slice(a, 256)
                    words = x.column(2)
                    tf = np.zeros((x.num_rows, len(idf)))
                    np.add.at(tf, (np.repeat(np.arange(x.num_rows), np.asarray(pc.list_value_length(words))), [place[t] for t in words.flatten().to_pylist()]), 1)
                    size = np.asarray(x.column(1), dtype=float)[:, None]
                    s = np.round((tf * (k1 + 1) / np.maximum(tf + k1 * (1 - b + b * size / mean), 1e-12) * idf) @ wanted, 4)
                    s[((tf > 0) @ wanted) == 0] = -np.inf
                    pairs = [(j, i) for j, i in best_of(s.T, x.column(0).to_pylist(), k) if s[i, j] > -np.inf]
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array([j for j, _ in pairs], pa.int64())), x.column(0).take(pa.array([i for _, i in pairs], pa.int64())), pa.array([float(s[i, j]) for j, i in pairs], pa.float64())], schema.names)

        out = out.unionByName(met.select(id_col, "n", "w").mapInArrow(scored, schema))
    rank = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("score"), id_col))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k)


def recency(df: DataFrame, *, time: str, now, half_life_days: float, score: str = "score") -> DataFrame:
    """df with the score weakened by half for each half_life_days before `now`; later rows keep theirs."""
    age = F.greatest(F.lit(0.0), F.datediff(F.lit(now).cast("date"), F.col(time)).cast("double"))
    return df.withColumn(score, F.col(score) * F.pow(F.lit(0.5), age / half_life_days))


def merged(rankings: list[DataFrame], *, query_key: str, key: str, k: int = 10) -> DataFrame:
    """Several result lists (query, key, score) as one: a row found twice keeps its best score."""
    rows = rankings[0].select(query_key, key, "score")
    for r in rankings[1:]:
        rows = rows.unionByName(r.select(query_key, key, "score"))
    best = rows.groupBy(query_key, key).agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("score"), key))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k)


def reranked(found: DataFrame, other: DataFrame, *, query_key: str, key: str, weight: float = 0.5, k: int = 10) -> DataFrame:
    """found (query, key, score) in the order of its score mixed with that of another scorer; rows that it lacks count 0 there."""
    both = found.select(query_key, key, F.col("score").alias("__a")).join(other.select(query_key, key, F.col("score").alias("__b")), [query_key, key], "left")
    score = F.round((1 - weight) * F.col("__a") + weight * F.coalesce("__b", F.lit(0.0)), 6)
    rank = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("score"), key))
    return both.select(query_key, key, score.alias("score")).withColumn("rank", rank).filter(F.col("rank") <= k)


#: Words of a question that call for a kind of retrieval, in this order (own values).
ROUTES = {"graph": r"\b(?:relat\w*|connect\w*|between|link\w*)\b", "temporal": r"\b(?:when|latest|recent\w*|before|after|since|first|last)\b"}


def route(question: Column) -> Column:
    """Where a question goes: graph, temporal, else text."""
    out = F.lit("text")
    for name, words in reversed(ROUTES.items()):
        out = F.when(F.lower(question).rlike(words), F.lit(name)).otherwise(out)
    return out


def fused(rankings: list[DataFrame], *, query_key: str, key: str, constant: int = 60, k: int = 10) -> DataFrame:
    """Reciprocal rank fusion of rankings (query, key, rank)."""
    rows = rankings[0].select(query_key, key, "rank")
    for r in rankings[1:]:
        rows = rows.unionByName(r.select(query_key, key, "rank"))
    summed = rows.groupBy(query_key, key).agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("score"), key))
    return summed.withColumn("rank", rank).filter(F.col("rank") <= k)
