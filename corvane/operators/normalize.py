"""Raw video records (nested JSON) to flat rows, and the predicates on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import duration_or_zero, duration_seconds

RAW = """id STRING, snippet STRUCT<title STRING, description STRING, channelId STRING, channelTitle STRING, publishedAt STRING, categoryId STRING, tags ARRAY<STRING>, defaultLanguage STRING, customUrl STRING, resourceId STRUCT<videoId: STRING>, playlistId STRING>,
contentDetails STRUCT<duration STRING, relatedPlaylists STRUCT<uploads STRING>>, statistics STRUCT<viewCount STRING, likeCount STRING, commentCount STRING>,
status STRUCT<privacyStatus STRING, embeddable BOOLEAN, madeForKids BOOLEAN>"""
SHORT_CATEGORY, SHORT_SECONDS = "42", 60


def parsed(df: DataFrame, json_col: str) -> DataFrame:
    """Adds `raw`: the record of a JSON column; fields that are absent are null."""
    return df.withColumn("raw", F.from_json(json_col, RAW))


def _count(name: str) -> Column:
    return F.coalesce(F.col(f"raw.statistics.{name}").try_cast("bigint"), F.lit(0))


def is_short(title: Column, tags: Column, category: Column, seconds: Column) -> Column:
    """Category 42, 60 seconds or less, or a word for short videos in the title or a tag. What is missing decides nothing."""
    word = lambda c: F.contains(F.lower(c), F.lit("shorts")) | F.contains(F.lower(c), F.lit("#short"))
    parts = [category == SHORT_CATEGORY, seconds <= SHORT_SECONDS, word(title), F.exists(tags, word)]
    out = F.lit(False)
    for p in parts:
        out = out | F.coalesce(p, F.lit(False))
    return out


def normalized(df: DataFrame) -> DataFrame:
    """The flat row of each `raw` record: missing texts '', counts 0, tags [], duration null."""
    tags = F.coalesce("raw.snippet.tags", F.array().cast("array<string>"))
    seconds = duration_seconds(F.col("raw.contentDetails.duration"))
    return df.select(
        F.col("raw.id").alias("video_id"), F.coalesce("raw.snippet.title", F.lit("")).alias("title"), F.coalesce("raw.snippet.description", F.lit("")).alias("description"),
        F.coalesce("raw.snippet.channelId", F.lit("")).alias("channel_id"), F.coalesce("raw.snippet.channelTitle", F.lit("")).alias("channel_title"), F.try_to_timestamp("raw.snippet.publishedAt").alias("published_at"),
        seconds.alias("duration_seconds"), _count("viewCount").alias("view_count"), _count("likeCount").alias("like_count"), _count("commentCount").alias("comment_count"),
        F.coalesce("raw.snippet.categoryId", F.lit("")).alias("category_id"), tags.alias("tags"), F.coalesce("raw.status.privacyStatus", F.lit("")).alias("privacy_status"),
        F.coalesce("raw.status.embeddable", F.lit(True)).alias("embeddable"), F.coalesce("raw.status.madeForKids", F.lit(False)).alias("made_for_kids"),
        F.coalesce("raw.contentDetails.duration", F.lit("")).alias("duration_iso"), F.to_json("raw").alias("raw_json"),
        is_short(F.col("raw.snippet.title"), tags, F.col("raw.snippet.categoryId"), seconds).alias("is_short"),
    )


def public_videos(df: DataFrame, *, include_shorts: bool = False, most: int | None = None, order: str = "video_id") -> DataFrame:
    """Public rows of normalized(), short forms left out unless wanted, the first `most` by order."""
    out = df.filter(F.col("privacy_status") == "public")
    out = out if include_shorts else out.filter(~F.col("is_short"))
    return out if most is None else out.orderBy(order).limit(most)


def uploads_playlist(df: DataFrame) -> DataFrame:
    return df.select("raw.id", F.col("raw.contentDetails.relatedPlaylists.uploads").alias("uploads"))


def channel_videos(channels: DataFrame, items: DataFrame, videos: DataFrame, reference: str, *, include_shorts: bool = False, most: int | None = None) -> DataFrame:
    """The public videos of one channel: its reference (an id, @name or custom name; the first hit by id) to its uploads list, that
    list's items to their videos, each once, and the rows that public_videos keeps. All three tables have a `raw` record.
    An unknown channel is an error."""
    wanted = F.lit(reference.removeprefix("@").lower())
    named = channels.filter((F.col("raw.id") == reference) | (F.lower(F.ltrim(F.col("raw.snippet.customUrl"), F.lit("@"))) == wanted) | (F.lower("raw.snippet.title") == wanted))
    uploads = uploads_playlist(named).filter("uploads is not null").orderBy("id").limit(1).collect()
    if not uploads:
        raise LookupError(f"no channel {reference}")
    ids = items.filter(F.col("raw.snippet.playlistId") == uploads[0].uploads).select(F.col("raw.snippet.resourceId.videoId").alias("__id")).distinct()
    mine = videos.join(ids, F.col("raw.id") == F.col("__id"), "left_semi")
    return public_videos(normalized(mine), include_shorts=include_shorts, most=most)


def legacy_metadata(df: DataFrame) -> DataFrame:
    """(video_id, title, publish_date, length_seconds) by the older rules: title N/A where missing, the date alone, 0 seconds for a duration that can't be read."""
    title, day = F.coalesce("raw.snippet.title", F.lit("N/A")), F.to_date(F.try_to_timestamp("raw.snippet.publishedAt"))
    return df.select(F.col("raw.id").alias("video_id"), title.alias("title"), day.alias("publish_date"), duration_or_zero(F.col("raw.contentDetails.duration")).alias("length_seconds"))


def with_transcripts(ids: DataFrame, meta: DataFrame, key: str) -> DataFrame:
    """A row per id with its metadata, or the defaults for ids without any."""
    return ids.join(meta, key, "left").withColumns({"title": F.coalesce("title", F.lit("N/A")), "category_name": F.coalesce("category_name", F.lit("Unknown")), "length_seconds": F.coalesce("length_seconds", F.lit(0))})


def chosen_transcript(transcripts: DataFrame, languages: list[str]) -> DataFrame:
    """One transcript per video: the first preferred language, else the first manual one, else the first."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, languages)), F.col("language_code")), F.lit(0)), F.when(F.col("is_generated"), F.lit(1_000_001)).otherwise(F.lit(1_000_000)))
    rest = [c for c in transcripts.columns if c != "video_id"]
    return transcripts.groupBy("video_id").agg(F.min_by(F.struct(*rest), F.struct(rank, "position")).alias("x")).select("video_id", "x.*")
