"""Packing into optimal length buckets.

A global histogram of lengths is small whatever the table's size: lengths up to 1024 have a bin each, longer ones a bin for each
64th part of a power of two, and each bin carries its count, sum and largest length. Dynamic programming over the bins chooses
the bucket boundaries with the least padding. Inside a bucket, rows are dealt into batches whose padded size keeps within a
token budget; ranks come from counts by bucket and shard, so no bucket passes through one task.

Defined results: a null or empty text has length 0 and is packed in the lowest bucket; a text longer than the budget is a batch
of its own; repeated rows are packed each; an empty table gives an empty result; other columns are ignored, so names cannot clash.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import word_count, written


def bin_of(length: Column) -> Column:
    power = F.floor(F.log2(length.cast("double"))).cast("int")
    part = F.floor((length / F.pow(F.lit(2.0), power) - 1) * 64).cast("int")
    return F.when(length <= 1024, length.cast("int")).otherwise(1024 + (power - 10) * 64 + part + 1)


def boundaries(count: np.ndarray, total: np.ndarray, largest: np.ndarray, buckets: int) -> list[int]:
    """The largest length of each bucket, ascending: at most `buckets` of them, with the least padding over all rows."""
    n = len(count)
    if not n:
        return []
    c, t = np.concatenate(([0], np.cumsum(count))).astype(np.float64), np.concatenate(([0], np.cumsum(total))).astype(np.float64)
    # waste[i, j]: padding of bins i..j in one bucket
    i, j = np.arange(n)[:, None], np.arange(n)[None, :]
    waste = np.where(i <= j, (c[j + 1] - c[i]) * largest[j] - (t[j + 1] - t[i]), np.inf)
    best, cuts = waste[0].copy(), []
    for _ in range(1, min(buckets, n)):
        way = best[:-1, None] + waste[1:, :]
        cut = way.argmin(axis=0)
        new = way[cut, np.arange(n)]
        better = new < best
        cuts.append(np.where(better, cut + 1, 0))
        best = np.where(better, new, best)
    ends, j = [], n - 1
    for cut in reversed(cuts):
        if j >= 0 and cut[j] > 0:
            ends.append(int(largest[j]))
            j = int(cut[j]) - 1
    ends.append(int(largest[j]))
    return sorted(set(ends))


def pack(rows: DataFrame, *, buckets: int = 16, token_budget: int = 65_536, shard_rows: int = 100_000) -> DataFrame:
    """rows: doc_id, length. Returns doc_id, length, bucket, bucket_length, batch_id and slot."""
    kept = written(rows.select("doc_id", F.coalesce("length", F.lit(0)).cast("long").alias("length"), F.monotonically_increasing_id().alias("key")), "pack")
    bins = sorted(kept.groupBy(bin_of(F.col("length")).alias("bin")).agg(F.count("*").alias("n"), F.sum("length").alias("total"), F.max("length").alias("most")).collect())
    ends = boundaries(*(np.array([r[k] for r in bins], np.int64) for k in (1, 2, 3)), buckets) or [0]
    shards = max(1, sum(r.n for r in bins) // shard_rows)
    bucket, most = F.lit(len(ends) - 1), F.lit(ends[-1])
    for i in reversed(range(len(ends) - 1)):
        bucket, most = F.when(F.col("length") <= ends[i], i).otherwise(bucket), F.when(F.col("length") <= ends[i], ends[i]).otherwise(most)
    dealt = kept.withColumn("bucket", bucket.cast("int")).withColumn("bucket_length", most.cast("long")).withColumn("shard", F.pmod(F.xxhash64("doc_id", "key"), F.lit(shards)).cast("int"))
    counts = dealt.groupBy("bucket", "shard").agg(F.count("*").alias("n"))
    before = counts.select("bucket", "shard", (F.sum("n").over(Window.partitionBy("bucket").orderBy("shard")) - F.col("n")).alias("before"))
    ranked = dealt.withColumn("own", F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("doc_id", "key")) - 1).join(before, ["bucket", "shard"])
    held = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.greatest(F.lit(1), F.col("bucket_length")))).cast("long")
    place = F.col("own") + F.col("before")
    return ranked.select("doc_id", "length", "bucket", "bucket_length", (F.shiftleft(F.col("bucket").cast("long"), 40) + F.floor(place / held)).alias("batch_id"), F.pmod(place, held).cast("int").alias("slot"))


def pack_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", buckets: int = 16, token_budget: int = 65_536) -> DataFrame:
    """Documents packed by their words."""
    return pack(docs.select(F.col(id_col).alias("doc_id"), word_count(F.col(text_col)).alias("length")), buckets=buckets, token_budget=token_budget)
