"""The registered queries that SQL can say, against DuckDB."""

import pytest

from corvane.llm.queries import ORACLE_SQL, QUERIES
from tests.conftest import SF
from tests.test_oracle import duck, plain  # noqa: F401  a fixture


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query(spark, duck, name):  # noqa: F811
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rel = duck.sql(ORACLE_SQL[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    want = sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert got == want
