"""Chunks and their metadata stay in Arrow."""

from corvane.operators import chunking


def test_metadata_is_handed_on_as_it_is(spark):
    d = spark.createDataFrame([(1, "abcdef", 2**60 + 1), (2, "xyz", None), (3, "", 5), (4, None, 6)], "doc_id long, text string, big long").coalesce(1)
    got = chunking.chunked(d, chunking.Stride(4), id_col="doc_id", text_col="text", metadata=["big"]).orderBy("doc_id", "chunk_no").collect()
    assert [(r.doc_id, r.chunk_no, r.text, r.big) for r in got] == [(1, 0, "abcd", 2**60 + 1), (1, 1, "ef", 2**60 + 1), (2, 0, "xyz", None)]
