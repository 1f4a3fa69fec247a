"""Keyed tables in hash buckets: a merge reads and rewrites the buckets of its own keys, and no others.

A table is a folder. `data/` holds the folders that merges have written, each with the buckets it touched; `versions/` holds a manifest
for each finished merge: for every bucket the folder that has it, and the number of the batch. A reader takes the last finished manifest, so it
never sees half a merge, and a merge that was broken off leaves nothing but a folder that no manifest names. A batch whose number is not above the
last one is left out, so replays change nothing. Folders that neither the last manifest nor the one before names are deleted by the next merge.

Bytes read and written follow the batch: keys of a batch of b rows lie in at most b of the table's buckets. The manifest has a row a bucket,
and only it reaches the driver. One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.shared import new_path

Combine = Callable[[DataFrame, DataFrame], DataFrame]
BUCKET = "__bucket"


def last_wins(key: list[str], order: str) -> Combine:
    """Combines old and new rows to one a key: that of the greatest order; of equals the new one."""

    def combine(old: DataFrame, new: DataFrame) -> DataFrame:
        both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
        row = F.struct(*(c for c in both.columns if c not in (*key, "__new")))
        return both.groupBy(*key).agg(F.max_by(row, F.struct(order, "__new")).alias("__row")).select(*key, "__row.*")

    return combine


class BucketTable:
    """A table at a path, by key columns. `buckets` counts when it is written first; later the table's own number holds."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], schema: str | T.StructType, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

    def _files(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        where, fs = self._files(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    def versions(self) -> list[int]:
        """Finished versions, the oldest first."""
        done = []
        for name in self._names(f"{self.path}/versions"):
            where, fs = self._files(f"{self.path}/versions/{name}/_SUCCESS")
            if fs.exists(where):
                done.append(int(name))
        return sorted(done)

    def manifest(self, version: int | None = None) -> tuple[int, int, dict[int, str]]:
        """(version, last batch, folder of each bucket that has rows); version -1 before the first merge."""
        done = self.versions()
        if not done:
            return -1, -1, {}
        version = done[-1] if version is None else version
        rows = self.spark.read.parquet(f"{self.path}/versions/{version:012d}").collect()  # a row for each bucket
        self.buckets = rows[0].buckets
        return version, rows[0].batch, {r.bucket: r.folder for r in rows if r.folder is not None}

    def bucket_of(self, key: list[str | Column] | None = None) -> Column:
        return F.pmod(F.xxhash64(*(key or self.key)), F.lit(self.buckets)).cast("int")

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets."""
        _, _, folders = self.manifest()
        paths = [f"{self.path}/data/{folder}/{BUCKET}={b}" for b, folder in sorted(folders.items()) if buckets is None or b in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def buckets_of(self, rows: DataFrame) -> list[int]:
        """The buckets that rows with the key columns lie in."""
        self.manifest()
        return sorted(r[0] for r in rows.select(self.bucket_of()).distinct().collect())

    def lookup(self, rows: DataFrame) -> DataFrame:
        """The stored rows of the buckets that rows lie in: all that a join by key can meet."""
        return self.read(self.buckets_of(rows))

    def merge(self, rows: DataFrame, combine: Combine, batch: int) -> bool:
        """Combine rows with the stored ones of their buckets. False, and nothing done, if this batch or a later one was merged before.

        combine gets the old rows of the touched buckets and the new ones, and returns all rows that these buckets then hold.
        """
        version, last, folders = self.manifest()
        if batch <= last:
            return False
        held = new_path(self.spark, "batch")
        rows.write.parquet(held)  # rows may come from a stream or a join: computed once
        rows = self.spark.read.schema(rows.schema).parquet(held)
        touched = self.buckets_of(rows)
        folder = f"{version + 1:012d}-{uuid.uuid4().hex}"
        if touched:
            out = combine(self.read(touched), rows).select(*self.schema.names).withColumn(BUCKET, self.bucket_of())
            out.repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/data/{folder}")
        wrote = {int(n.split("=")[1]) for n in self._names(f"{self.path}/data/{folder}") if n.startswith(BUCKET)}
        if not wrote <= set(touched):
            raise ValueError("combine has made rows of other buckets")
        folders = {b: f for b, f in folders.items() if b not in touched} | {b: folder for b in wrote}
        named = [(batch, self.buckets, b, folders.get(b)) for b in range(self.buckets)]
        self.spark.createDataFrame(named, "batch long, buckets int, bucket int, folder string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/versions/{version + 1:012d}")
        self._clean(version, held)
        return True

    def _clean(self, before: int, held: str) -> None:
        """Delete manifests before the last two, and folders that those two do not name."""
        kept = [v for v in self.versions() if v >= before]
        named = {f for v in kept for f in self.manifest(v)[2].values()}
        old = [f"{self.path}/data/{n}" for n in self._names(f"{self.path}/data") if n not in named]
        old += [f"{self.path}/versions/{n}" for n in self._names(f"{self.path}/versions") if int(n) < before]
        for path in [held, *old]:
            where, fs = self._files(path)
            fs.delete(where, True)
