"""From documents to a searchable table and back: chunk, embed, store; embed a query, search, threshold."""

from __future__ import annotations

from itertools import product
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.embedding import embedded
from corvane.operators.chunking import LongText, chunked
from corvane.operators.vector_search import top_k
from corvane.shared import arrow_batches


def ingest(docs: DataFrame, chunker: Any, embed: Any, *, id_col: str, text_col: str, metadata: list[str] | None = None) -> DataFrame:
    """A row per chunk: chunk_id ({id}_{n}), the document's id and metadata, text, offsets, tokens, embedding. Empty texts have none.

    Metadata comes along with the row, so repeated and null ids keep their own.
    """
    chunks = chunked(docs, chunker, id_col=id_col, text_col=text_col, metadata=metadata).withColumn("chunk_id", F.concat_ws("_", F.col(id_col).cast("string"), "chunk_no"))
    return embedded(chunks, "text", embed)


def long_text_vectors(docs: DataFrame, embed: Any, *, id_col: str, text_col: str, most_tokens: int = 8191) -> DataFrame:
    """(id, pieces, embedding): the element-wise mean of the vectors of a text's pieces, each of most_tokens at most; a text that fits is one piece."""
    pieces = embedded(chunked(docs, LongText(4 * most_tokens), id_col=id_col, text_col=text_col), "text", embed)
    by_dim = pieces.select(id_col, "chunk_no", F.posexplode("embedding").alias("dim", "x")).groupBy(id_col, "dim").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count("*").alias("pieces"))
    # a vector's dimensions are few and fixed, so they may meet in one list
    return by_dim.groupBy(id_col).agg(F.max("pieces").alias("pieces"), F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda d: d["x"]).alias("embedding"))


def ingest_documents(docs: DataFrame, *, chunker: str = "fixed", embedder: str = "hash", path: str | None = None, id_col: str = "id", text_col: str = "text", metadata: list[str] | None = None, registry: Any = None, chunker_options: dict | None = None, embedder_options: dict | None = None) -> DataFrame:
    """Ingest in one call by the components' names; with a path the store is written there and read again."""
    from corvane.plans.registry import Registry
    from corvane.sources.files import load_store, save_store

    found = registry or Registry()
    out = ingest(docs, found.create("chunker", chunker, **(chunker_options or {})), found.create("embedder", embedder, **(embedder_options or {})), id_col=id_col, text_col=text_col, metadata=metadata)
    if path is None:
        return out
    with arrow_batches(docs.sparkSession):
        save_store(out, path)
    return load_store(docs.sparkSession, path)


def retrieve_text(spark: SparkSession, text: str, *, store: DataFrame | None = None, path: str | None = None, embedder: str = "hash", k: int = 5, registry: Any = None, embedder_options: dict | None = None, **options: Any) -> DataFrame:
    """Retrieval in one call, from a store or from the path of one."""
    from corvane.plans.registry import Registry
    from corvane.sources.files import load_store

    if store is None and path is None:
        raise ValueError("a store or its path is needed")
    held = store if store is not None else load_store(spark, path)
    return retrieve(spark, held, [text], (registry or Registry()).create("embedder", embedder, **(embedder_options or {})), k=k, **options)


def ingest_stats(docs: DataFrame, chunks: DataFrame, *, text_col: str) -> DataFrame:
    """documents, chunks, embeddings."""
    n = docs.filter(F.col(text_col) != "").agg(F.count("*").alias("documents"))
    return n.crossJoin(chunks.agg(F.count("*").alias("chunks"), F.count("embedding").alias("embeddings")))


def retrieve(spark: SparkSession, store: DataFrame, texts: list[str], embed: Any, *, k: int = 5, filters: dict | None = None, threshold: float = 0.0, metric: str = "cosine") -> DataFrame:
    """The k best chunks of each distinct query text."""
    once = list(dict.fromkeys(texts))
    queries = spark.createDataFrame([(t, [float(x) for x in v]) for t, v in zip(once, embed(once), strict=True)], "query string, query_vector array<float>")
    return top_k(queries, store, k=k or 5, metric=metric, filters=filters, threshold=threshold, query_key="query", key="chunk_id")


def sweep(docs: DataFrame, chunkers: dict[str, Any], embedders: dict[str, Any], *, id_col: str, text_col: str) -> DataFrame:
    """Chunk counts and sizes for each pair of components; a pair that can't be built is left out."""
    out = None
    for (c, chunker), (e, embed) in product(chunkers.items(), embedders.items()):
        try:
            found = ingest(docs, chunker, embed, id_col=id_col, text_col=text_col)
        except (TypeError, ValueError):
            continue
        row = found.agg(F.lit(c).alias("chunker"), F.lit(e).alias("embedder"), F.count("*").alias("chunks"), F.round(F.avg("token_count"), 4).alias("average_tokens"))
        out = row if out is None else out.unionByName(row)
    if out is None:
        raise ValueError("no pair of components could be built")
    return out
