"""Token budgets: batches of a fixed number, windows with overlap, and context selection."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.shared import Keep, running


def batches(df: DataFrame, keep: Keep, *, by: str, order: str, tokens: str, size: int, limit: int) -> DataFrame:
    """Rows in batches of `size` within each `by`; a batch over the limit is read one by one, and a row over it alone is skipped."""
    numbered = running(df, keep, by=[by], order=[order], into="__n").withColumn("batch_no", F.floor((F.col("__n") - 1) / size).cast("int")).drop("__n")
    total = F.sum(tokens).over(Window.partitionBy(by, "batch_no"))
    return numbered.withColumn("batch_tokens", total).withColumn("handling", F.when(F.col("batch_tokens") <= limit, "batch").when(F.col(tokens) <= limit, "single").otherwise("skipped"))


def windows(df: DataFrame, *, by: str, order: str, tokens: str, window: int = 900_000, overlap: int = 50_000) -> DataFrame:
    """(by, order, window_no): rows packed in order up to `window` tokens; each window begins with the tail of the last, of `overlap` tokens at most, if it fits.

    Groups stream through their task in order, one row at a time; only the open window is held, whose rows' texts stay behind.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, total, k, fresh = None, [], 0, 0, 0
        for b in parts:
            out = []
            for g, o, n in b.itertuples(index=False):
                if g != at:
                    at, held, total, k, fresh = g, [], 0, 0, 0
                if fresh and total + n > window:
                    tail, used = [], 0
                    for x in reversed(held):
                        if used + x[1] > overlap or used + x[1] + n > window:
                            break
                        tail.insert(0, x)
                        used += x[1]
                    held, total, k, fresh = tail, used, k + 1, 0
                    out += [(g, x[0], k) for x in tail]
                held.append((o, n))
                total += n
                fresh += 1
                out.append((g, o, k))
            yield pd.DataFrame(out, columns=[by, order, "window_no"])

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in (by, order))
    ready = df.select(by, order, F.col(tokens).cast("long").alias("n")).repartition(by).sortWithinPartitions(by, order)
    return ready.mapInPandas(run, f"{kinds}, window_no int")


def context(df: DataFrame, keep: Keep, *, by: str, rank: str, tokens: str, budget: int, share: float = 0.9) -> DataFrame:
    """Rows in rank order as long as their running tokens keep within a share of the budget."""
    return running(df, keep, by=[by], order=[rank], value=tokens, into="running_tokens").filter(F.col("running_tokens") <= int(budget * share))
