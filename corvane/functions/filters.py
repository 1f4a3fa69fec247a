"""The metadata filter language, compiled to Column predicates that Spark pushes to the scan."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

RANGES = {"$gte": "__ge__", "$lte": "__le__", "$gt": "__gt__", "$lt": "__lt__"}


def matches(filters: dict[str, Any] | None, columns: list[str]) -> Column:
    """Scalars are equality, lists membership, dicts ranges (all must hold; unknown operators count for nothing). A missing key or value matches nothing."""

    def one(name: str, wanted: Any) -> Column:
        if name not in columns:
            return F.lit(False)
        c = F.col(name)
        if isinstance(wanted, dict):
            parts = [getattr(c, RANGES[op])(F.lit(v)) for op, v in wanted.items() if op in RANGES]
            return reduce(Column.__and__, parts, c.isNotNull())
        if isinstance(wanted, (list, tuple, set)):
            return c.isin(*wanted)
        return c == F.lit(wanted)

    return F.coalesce(reduce(Column.__and__, [one(k, v) for k, v in (filters or {}).items()], F.lit(True)), F.lit(False))
