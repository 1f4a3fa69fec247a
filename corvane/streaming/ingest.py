"""Structured Streaming: micro-batch ingest with idempotent sinks, running state, and windows over event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvane.operators.buckets import BucketTable


def stream_table(spark: SparkSession, path: str, schema, files: int = 8) -> DataFrame:
    """A folder of Parquet files as a stream, `files` of them a batch at most."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def ingest_stream(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, *, error_path: str | None = None, valid: str = "true") -> StreamingQuery:
    """Each micro-batch's valid rows go through transform into path/batch=<n>, others to error_path. A batch that is run again overwrites its own folder, so replays change nothing."""

    def sink(batch: DataFrame, n: int) -> None:
        transform(batch.filter(valid)).write.mode("overwrite").parquet(f"{path}/batch={n}")
        if error_path:
            batch.filter(f"not coalesce({valid}, false)").write.mode("overwrite").parquet(f"{error_path}/batch={n}")

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the written versions of a table, those that were finished."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    found = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("version=")]
    done = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(int(p.getName().split("=")[1]) for p in found if fs.exists(done(p, "_SUCCESS")))


def upsert_sink(spark: SparkSession, path: str, key: str, order: str, *, start: int = 0) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps the last row per key: versions of the table are folders, and a batch writes the next from the last before it.

    A batch that is run again starts from the same version. A batch beyond `start` that finds no finished version before it is an
    error, as state would be lost.
    """
    from corvane.operators.store import last_by_key

    def sink(batch: DataFrame, n: int) -> None:
        before = [v for v in versions(spark, path) if v < n]
        if n > start and not before:
            raise RuntimeError(f"no version of {path} before {n}")
        rows = spark.read.parquet(f"{path}/version={before[-1]}").unionByName(batch, allowMissingColumns=True) if before else batch
        last_by_key(rows, key, order).write.mode("overwrite").parquet(f"{path}/version={n}")

    return sink


def bucket_sink(table: BucketTable, order: str, *, start: int = 0) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps the last row per key of a bucket table: a batch rewrites its own buckets, and a replay changes nothing.

    A batch beyond `start` that finds an empty table is an error, as state would be lost.
    """
    from corvane.operators.buckets import last_wins
    from corvane.operators.store import last_by_key

    def sink(batch: DataFrame, n: int) -> None:
        if n > start and not table.versions():
            raise RuntimeError(f"no version of {table.path} before {n}")
        table.merge(last_by_key(batch, table.key[0], order), last_wins(table.key, order), n)

    return sink


def running_counts(stream: DataFrame, key: str) -> DataFrame:
    return stream.groupBy(key).agg(F.count("*").alias("n"))


def windowed(events: DataFrame, *, time: str = "ts", late: str = "10 minutes", width: str = "5 minutes", by: str = "event_type") -> DataFrame:
    """Counts by tumbling window with a watermark. Event times are cast, as a watermark needs a zoned timestamp."""
    e = events.withColumn(time, F.col(time).cast("timestamp"))
    e = e.withWatermark(time, late) if events.isStreaming else e
    return e.groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), by, "n", "total")


#: States of a task and those that may follow each (fixed values).
NEXT = {"pending": ("processing", "failed"), "processing": ("completed", "failed"), "completed": (), "failed": ("pending",)}


def wrong_transitions(tasks: DataFrame, *, key: str, time: str, status: str, tie: str) -> DataFrame:
    """(key, time, from, to): steps of tasks that their state does not allow; a first state other than pending comes from null.

    The state before a row is that of its task's last earlier row; a task's rows are few, its window is ordered by time and tie.
    """
    from pyspark.sql import Window

    steps = tasks.select(key, time, F.lag(status).over(Window.partitionBy(key).orderBy(time, tie)).alias("from"), F.col(status).alias("to"))
    allowed = F.when(F.col("from").isNull(), F.col("to") == "pending").otherwise(F.lit(False))
    for state, after in NEXT.items():
        allowed = F.when(F.col("from") == state, F.col("to").isin(*after) if after else F.lit(False)).otherwise(allowed)
    return steps.filter(~F.coalesce(allowed, F.lit(False)))


def latest_status(tasks: DataFrame, *, key: str, time: str, status: str, tie: str) -> DataFrame:
    """The last status of each task."""
    return tasks.groupBy(key).agg(F.max(F.struct(time, tie, status))[status].alias(status))
