"""The registered cell index, with its own parameters, on the larger tables."""

from corvane.queries import QUERIES

SF = "/root/testdata/sf0.1"


def test_registered_cells_recall(spark):
    exact, near = ({tuple(r) for r in QUERIES[name](spark, SF).select("query_id", "vec_id").collect()} for name in ("topk_cosine", "topk_cells"))
    recall = len(exact & near) / len(exact)
    print(f"recall {recall:.4f} of {len(exact)}")
    assert recall >= 0.9
