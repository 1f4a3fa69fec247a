"""Keyed tables: upsert, insert, lookup, delete, pages, existence, incremental loads and outcome counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return sorted({*required} - {*df.columns})


def upsert(target: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """target with changes by key: given columns overwrite, others keep their values, new keys are added. Columns that target lacks are dropped; of changes with one key the last in `key` order of all values wins."""
    if key not in changes.columns:
        raise ValueError(f"changes have no {key}")
    given = [c for c in target.columns if c in changes.columns and c != key]
    one = changes.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(*(F.max(F.struct(*given))[c].alias(f"__new_{c}") for c in given))
    joined = target.join(one, target[key] == one["__key"], "full_outer")
    new = F.col("__key").isNotNull()
    return joined.select(*(F.coalesce(F.col(key), F.col("__key")).alias(c) if c == key else F.when(new, F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c) if c in given else F.col(c) for c in target.columns))


def insert(target: DataFrame, rows: DataFrame) -> DataFrame:
    known = [c for c in rows.columns if c in target.columns]
    return target.unionByName(rows.select(*known), allowMissingColumns=True)


def by_key(df: DataFrame, key: str, value: object) -> DataFrame:
    return df.filter(F.col(key) == F.lit(value)).limit(2)


def without_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """df less the rows whose key is in keys (a delete, or a skip of what is known)."""
    return df.join(keys.select(key).distinct(), key, "left_anti")


def with_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key).distinct(), key, "left_semi")


def page(df: DataFrame, key: str, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page in order of the key, which makes pages repeatable."""
    return df.orderBy(key).offset(offset).limit(limit)


def until_known(stream: DataFrame, known: DataFrame, key: str, position: str) -> DataFrame:
    """Rows of a newest-first stream before the first known one."""
    stop = with_keys(stream, known, key).agg(F.min(position).alias("__stop"))  # one row
    return stream.join(F.broadcast(stop), F.col("__stop").isNull() | (F.col(position) < F.col("__stop"))).drop("__stop")


def outcomes(df: DataFrame, created: Column, updated: Column, skipped: Column) -> DataFrame:
    count = lambda c, n: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).alias(n)
    return df.agg(count(created, "created"), count(updated, "updated"), count(skipped, "skipped"))


def last_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with one key the last in order: overwriting adds, latest states."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("x")).select(key, "x.*")


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal keys the first in order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def add_missing(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """df with the columns it lacks, null."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in schema.items() if c not in df.columns})


def names_from(df: DataFrame, dim: DataFrame, key: str, dim_key: str, name: str, default: str = "Unknown") -> DataFrame:
    """df with a name looked up in a dimension, or the default."""
    looked = dim.select(F.col(dim_key).alias("__k"), F.col(name).alias("__v"))
    return df.join(looked, F.col(key) == F.col("__k"), "left").withColumn(name, F.coalesce("__v", F.lit(default))).drop("__k", "__v")


def in_order_of(ids: DataFrame, df: DataFrame, key: str, position: str) -> DataFrame:
    """A row for each wanted id, in their order; unknown ids have nulls."""
    return ids.join(df, key, "left").orderBy(position)
