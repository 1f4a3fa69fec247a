"""Paged sources: a Python data source that reads pages of an interface in parallel, and batched lookups by id.

A page function is named as ``module:function``; it gets the page's number and the options and returns records as dictionaries
of text (an empty page ends that partition). It runs on the executors, with Spark's task retry around it.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def named(path: str) -> Callable:
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


def sample_page(page: int, options: dict[str, str]) -> list[dict[str, str]]:
    """A page function for tests and offline runs: records numbered through, `size` a page, `total` in all."""
    size, total = int(options.get("size", "50")), int(options.get("total", "120"))
    return [{"id": str(i), "json": json.dumps({"id": str(i), "snippet": {"title": f"video {i}"}})} for i in range(page * size, min(total, (page + 1) * size))]


class PagedSource(DataSource):
    """Format `paged`. Options: page_function, pages (how many), pages_per_partition, and whatever the function reads."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "id string, json string, page int"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(dict(self.options))


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        pages, each = int(self.options.get("pages", "1")), int(self.options.get("pages_per_partition", "1"))
        return [InputPartition(range(a, min(pages, a + each))) for a in range(0, pages, each)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        fetch = named(self.options.get("page_function", f"{__name__}:sample_page"))
        for page in partition.value:
            records = fetch(page, self.options)
            if not records:
                return
            for r in records:
                yield r["id"], r["json"], page


def looked_up(ids: DataFrame, fetch: Callable[[list[str]], dict[str, str]], *, key: str = "id", batch: int = 50) -> DataFrame:
    """(key, json) of ids, asked for `batch` at a time; ids without an answer have null. All ids are asked for."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            wanted, found = p[key].tolist(), {}
            for i in range(0, len(wanted), batch):
                found |= fetch(wanted[i : i + batch])
            yield pd.DataFrame({key: wanted, "json": [found.get(x) for x in wanted]})

    return ids.select(F.col(key).cast("string").alias(key)).mapInPandas(run, f"{key} string, json string")
