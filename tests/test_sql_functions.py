"""Table functions give the rows of `chunked`."""

import pytest

from corvane.operators import chunking
from corvane.plans.registry import Registry
from corvane.plans.sql_functions import register_chunkers

from .conftest import SF


@pytest.mark.parametrize("name, make, options", [("window", chunking.CharWindow, {"max_tokens": 64, "overlap": 8}), ("fixed", chunking.FixedLength, {"length_tokens": 64, "overlap_tokens": 8}), ("pack", chunking.SentencePack, {"max_tokens": 50, "overlap_sentences": 1})])
def test_sql_gives_the_rows_of_chunked(spark, name, make, options):
    registry = Registry()
    registry.register("chunker", "pack", chunking.SentencePack)
    registry.register("chunker", "no name", chunking.Stride)  # no name that SQL could call
    assert register_chunkers(spark, registry) == ["chunk_fixed", "chunk_pack", "chunk_semantic", "chunk_window"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, ""), (-3, "x")], "doc_id long, text string"))
    docs.createOrReplaceTempView("chunk_docs")
    said = str(options).replace("'", '"')
    got = spark.sql(f"SELECT d.doc_id, c.* FROM chunk_docs d, LATERAL chunk_{name}(d.text, '{said}') c")
    want = chunking.chunked(docs, make(**options), id_col="doc_id", text_col="text").select(*got.columns)
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(map(tuple, want.collect())) and {-3} == {r[0] for r in rows if r[0] < 0}


def test_a_wrong_option_is_an_error(spark):
    register_chunkers(spark, Registry())
    with pytest.raises(Exception, match="overlap|unexpected"):
        spark.sql("""SELECT * FROM chunk_fixed('some text', '{"length_tokens": 4, "overlap_tokens": 9}')""").collect()
