"""The analytic queries over a transcripts table: video_id, title, publish_date, length_seconds, category_name, channel, transcript_text, openai_tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.tokens import EMBEDDING_PRICE, MODEL_PRICE


def _has_text():
    return F.coalesce(F.col("transcript_text") != "", F.lit(False))


def all_videos(t: DataFrame) -> DataFrame:
    return t.select("video_id", "title", "publish_date", "length_seconds", "category_name", "openai_tokens").orderBy(F.desc("publish_date"), "video_id")


def video_stats(t: DataFrame) -> DataFrame:
    n, have = F.count("*"), F.coalesce(F.sum(F.when(_has_text(), 1).otherwise(0)), F.lit(0))
    return t.agg(n.alias("total_videos"), have.alias("with_transcripts"), F.round(have * 100.0 / F.nullif(n, F.lit(0)), 1).alias("transcript_percentage"), F.coalesce(F.sum("length_seconds"), F.lit(0)).alias("total_seconds"), F.round(F.avg("length_seconds"), 1).alias("avg_seconds"), F.countDistinct("category_name").alias("categories"))


def category_stats(t: DataFrame) -> DataFrame:
    return t.groupBy("category_name").agg(F.count("*").alias("video_count"), F.round(F.avg("length_seconds"), 1).alias("avg_seconds"), F.sum("length_seconds").alias("total_seconds")).orderBy(F.desc("video_count"), "category_name")


def longest_videos(t: DataFrame, n: int = 10) -> DataFrame:
    return t.select("video_id", "title", "length_seconds", "category_name").orderBy(F.desc("length_seconds"), "video_id").limit(n)


def recent_videos(t: DataFrame, n: int = 10) -> DataFrame:
    return t.select("video_id", "title", "publish_date").orderBy(F.desc("publish_date"), "video_id").limit(n)


def token_total(t: DataFrame) -> DataFrame:
    return t.agg(F.coalesce(F.sum("openai_tokens"), F.lit(0)).cast("long").alias("total_tokens"))


def transcript_of(t: DataFrame, video_id: object) -> DataFrame:
    return t.filter(F.col("video_id") == F.lit(video_id)).select("video_id", "title", "transcript_text")


def nonempty(t: DataFrame) -> DataFrame:
    """Rows with a text, token counts filled in where null."""
    from corvane.functions.tokens import token_count

    return t.filter(_has_text()).select("video_id", "title", F.coalesce("openai_tokens", token_count(F.col("transcript_text"))).alias("openai_tokens"))


def first_above(t: DataFrame, tokens: int) -> DataFrame:
    return t.filter(F.col("openai_tokens") > tokens).select("video_id", "openai_tokens").orderBy("video_id").limit(1)


def model_costs(t: DataFrame) -> DataFrame:
    """Input cost of all tokens by model; the price table is a fixed dimension."""
    prices = t.sparkSession.createDataFrame(sorted(MODEL_PRICE.items()), "model string, per_million double")
    return token_total(t).crossJoin(F.broadcast(prices)).select("model", F.round(F.col("total_tokens") * F.col("per_million") / 1e6, 3).alias("cost"))


def embedding_costs(t: DataFrame) -> DataFrame:
    prices = t.sparkSession.createDataFrame(sorted(EMBEDDING_PRICE.items()), "model string, per_thousand double")
    return token_total(t).crossJoin(F.broadcast(prices)).select("model", F.round(F.col("total_tokens") * F.col("per_thousand") / 1e3, 6).alias("cost"))


def strategy(t: DataFrame, by: str) -> DataFrame:
    """How a channel's tokens can be read: at once, by sliding windows, or in batches."""
    total = F.coalesce(F.sum("openai_tokens"), F.lit(0)).cast("long")
    return t.groupBy(by).agg(total.alias("total_tokens")).withColumn("strategy", F.when(F.col("total_tokens") < 1_000_000, "direct").when(F.col("total_tokens") < 10_000_000, "sliding_window").otherwise("batch"))


CATALOG = {"all_videos": all_videos, "video_stats": video_stats, "category_stats": category_stats, "longest_videos": longest_videos, "recent_videos": recent_videos, "openai_tokens": token_total}


def run_catalog(t: DataFrame, names: list[str] | None = None) -> dict[str, DataFrame]:
    return {n: CATALOG[n](t) for n in names or CATALOG}
