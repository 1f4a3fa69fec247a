"""The inverted index gives what going through the texts gives, reads a part of the postings, and takes later documents."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import retrieval, text_index
from corvane.shared import new_path

from .conftest import SF

NAMES = {"query_key": "item_id", "query_text": "q"}


def rows(df):
    return sorted((r.item_id, r["rank"], r.doc_id, round(r.score, 3)) for r in df.collect())


def indexed(spark, docs, **options):
    path = new_path(spark, "text-index")
    text_index.write(docs, path, id_col="doc_id", text_col="text", **options)
    return path


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").filter("text is not null")


@pytest.fixture(scope="module")
def questions(spark):
    return spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", F.col("text").alias("q"))


@pytest.mark.parametrize("options", [{}, {"shard_docs": 37}, {"shard_words": 5000}])
@pytest.mark.parametrize("ranking", [{}, {"k1": 0.0, "k": 20}, {"b": 0.0, "k": 3}])
def test_equal_to_the_texts(spark, docs, questions, options, ranking):
    index = text_index.read(spark, indexed(spark, docs, **options))
    assert rows(text_index.search(questions, index, key="doc_id", **NAMES, **ranking)) == rows(retrieval.bm25(docs, questions, id_col="doc_id", text_col="text", **NAMES, **ranking))


def test_segments_and_parts_read(spark, docs, questions):
    index = text_index.read(spark, indexed(spark, docs, shard_docs=100))
    assert rows(text_index.search(questions, index, key="doc_id", segment=3, **NAMES)) == rows(text_index.search(questions, index, key="doc_id", **NAMES))
    rng = np.random.default_rng(1)
    made = spark.createDataFrame([(i, " ".join([f"w{int(x)}" for x in rng.zipf(1.5, 60) % 5000] + (["needle"] if i % 900 == 5 else []))) for i in range(3000)], "doc_id long, text string").coalesce(1)  # one shard: a task knows its own shards' best only
    index = text_index.read(spark, indexed(spark, made))
    q = spark.createDataFrame([(1, "needle w1 w2"), (2, "w1"), (3, "nothing here")], "item_id long, q string")
    got = rows(text_index.search(q, index, key="doc_id", k=3, **NAMES))
    assert got == rows(retrieval.bm25(made, q, id_col="doc_id", text_col="text", k=3, **NAMES)) and {r[0] for r in got} == {1, 2}
    scored, postings = text_index.search(q.filter("item_id = 1"), index, key="doc_id", k=3, work=True, **NAMES).agg(F.sum("scored"), F.sum("postings")).first()
    assert 0 < scored < 0.5 * postings, (scored, postings)


def test_later_documents(spark, docs, questions):
    path = indexed(spark, docs.filter("doc_id % 3 = 0"), shard_docs=20)
    text_index.write(docs.filter("doc_id % 3 <> 0"), path, id_col="doc_id", text_col="text", shard_docs=30)
    index = text_index.read(spark, path)
    assert rows(text_index.search(questions, index, key="doc_id", **NAMES)) == rows(retrieval.bm25(docs, questions, id_col="doc_id", text_col="text", **NAMES))
    assert index.filter("term = ''").agg(F.sum("docs")).first()[0] == docs.count()


def test_folders_of_the_terms_only(spark, docs):
    index = text_index.read(spark, indexed(spark, docs))
    q = spark.createDataFrame([(1, "the")], "item_id long, q string")
    folders = index.filter("term = 'the'").select("bucket").distinct().collect()
    assert len(folders) <= 1
    plan = text_index.search(q, index, key="doc_id", **NAMES)._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:200]


def test_odd_rows(spark):
    d = spark.createDataFrame([("a", None), ("b", ""), ("c", " ,"), ("d", "Word wörd WORD"), ("e", "word"), ("e", "word"), (None, "word")], "doc_id string, text string")
    q = spark.createDataFrame([(1, "word"), (2, None), (3, "")], "item_id long, q string")
    index = text_index.read(spark, indexed(spark, d.filter("doc_id is not null")))
    got = [(r.item_id, r.doc_id) for r in text_index.search(q, index, key="doc_id", **NAMES).collect()]
    assert sorted(got) == [(1, "d"), (1, "e"), (1, "e")]
    empty = text_index.read(spark, indexed(spark, d.filter("doc_id = 'b'")))
    assert text_index.search(q, empty, key="doc_id", **NAMES).count() == 0 and text_index.search(q.limit(0), index, key="doc_id", **NAMES).count() == 0


def small(batches):
    for b in batches:
        if b.nbytes > 6 << 20:
            raise ValueError(f"a batch of {b.nbytes} bytes")
        yield b


def test_batches_are_bounded_by_bytes(spark):
    """30 MB of texts of one task come to Python a few MB at a time; the setting is put back."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    d = spark.range(3000).coalesce(1).select(F.col("id").alias("doc_id"), F.expr("repeat('word ', 2000)").alias("text")).mapInArrow(small, "doc_id long, text string")
    index = text_index.read(spark, indexed(spark, d))
    assert tuple(index.filter("term = 'word'").agg(F.sum("docs"), F.sum("words")).first()) == (3000, 6_000_000) and spark.conf.get(name) == before
