"""Tables in the folder that driver and executors share, running totals without a large group in one task, and slices of texts."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Keep = Callable[[DataFrame], DataFrame]


#: Paths that this process has written to the shared folder and not released, and its own folder by application.
_PATHS: list[str] = []
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset: a folder of our own if all runs in one process (tests), else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="corvane-")
        found = _OWN[app]
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    _PATHS.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _PATHS[-1]


def marked() -> int:
    """A place in the list of written paths, for release()."""
    return len(_PATHS)


def release(spark: SparkSession, since: int = 0, *, keep_last: bool = False) -> None:
    """Delete what was written to the shared folder since a mark, except the last path if wanted. Results that still read there must have been used."""
    stop = len(_PATHS) - keep_last
    for path in _PATHS[since:stop]:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    del _PATHS[since:stop]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: the lineage is cut, it is computed once, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept(name: str) -> Keep:
    """written() under a name."""
    return lambda df: written(df, name)


def bucketed(df: DataFrame, name: str, by: str, rows: int, *, each: int = 500_000) -> DataFrame:
    """written(), dealt by a column into buckets of about `each` rows, so that joins on it do not shuffle this side. rows: how many there are."""
    spark, n = df.sparkSession, max(1, -(-rows // each))
    path = new_path(spark, name)
    told = "t" + path.rsplit("-", 1)[1]
    df.repartition(n, by).write.option("path", path).bucketBy(n, by).sortBy(by).format("parquet").saveAsTable(told)
    return spark.table(told)


def running(df: DataFrame, keep: Keep, *, by: list[str], order: list[str], value: str | None = None, into: str) -> DataFrame:
    """df with the total of `value` (or the number of rows) over the rows of its group up to its own, in the given order.

    Rows are dealt by ranges of group and order; a row's total is that within its range and those of its group's ranges before.
    So a group that holds a third of all rows is spread over many tasks. The order should be unique within a group.
    """
    ranged = keep(df.repartitionByRange(*(F.col(c) for c in by + order)).withColumn("__part", F.spark_partition_id()))
    total = F.sum(value) if value else F.count(F.lit(1))
    # a row for each range and group that meet: no more than groups and ranges together
    sums = ranged.groupBy(*by, "__part").agg(total.alias("__sum"))
    before = F.coalesce(F.sum("__sum").over(Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select(*(F.col(c).alias(f"__by{i}") for i, c in enumerate(by)), F.col("__part").alias("__p"), before.alias("__before"))
    own = total.over(Window.partitionBy(*by, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    same = ranged["__part"] == offsets["__p"]
    for i, c in enumerate(by):
        same = same & ranged[c].eqNullSafe(offsets[f"__by{i}"])
    out = ranged.withColumn("__own", own).join(offsets, same)
    return out.select(*df.columns, (F.col("__own") + F.col("__before")).alias(into))


@contextmanager
def arrow_batches(spark: SparkSession, size: int = 4 << 20) -> Iterator[None]:
    """Jobs that run inside hand rows to Python in Arrow batches of some `size` bytes, or one larger row, and not of 10,000 rows up to 64 MB."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def listing_tasks(spark: SparkSession) -> Iterator[None]:
    """Reads that begin inside list folders in as many tasks as a shuffle has, and not in a task for every folder."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def byte_slices(batches: Iterator[pd.DataFrame], column: str, budget: int = 4 << 20) -> Iterator[pd.DataFrame]:
    """Rows of batches, as many at a time as hold budget characters of text; a longer text comes alone."""
    for b in batches:
        size = b[column].str.len().fillna(0).to_numpy()
        start, held = 0, 0
        for i, n in enumerate(size.tolist()):
            if i > start and held + n > budget:
                yield b.iloc[start:i]
                start, held = i, 0
            held += n
        if len(b) > start:
            yield b.iloc[start:]
