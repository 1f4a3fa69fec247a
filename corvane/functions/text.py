"""Text functions as Column expressions: addresses, ids, file names, cleaning, durations, stamps and sentences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Forms of a video's address (fixed values), anchored at the start; the id has 11 characters.
VIDEO_URLS = (r"^(?:https?://)?(?:www\.)?youtube\.com/watch\?v=([A-Za-z0-9_-]{11})", r"^(?:https?://)?(?:www\.)?youtu\.be/([A-Za-z0-9_-]{11})", r"^(?:https?://)?(?:www\.)?youtube\.com/embed/([A-Za-z0-9_-]{11})")
CHANNEL_URLS = (r"/channel/([A-Za-z0-9_-]+)", r"/@([A-Za-z0-9._-]+)", r"/user/([A-Za-z0-9_-]+)", r"/c/([A-Za-z0-9_-]+)")
STAMP = r"\[\d{1,2}:\d{2}(?::\d{2})?\]"


def _first(found: list[Column]) -> Column:
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in found))


def video_id(url: Column) -> Column:
    """The id in a video's address, else the text itself if it is 11 letters and digits, else null."""
    return F.coalesce(_first([F.regexp_extract(url, p, 1) for p in VIDEO_URLS]), F.when(url.rlike("^[A-Za-z0-9]{11}$"), url))


def is_video_url(url: Column) -> Column:
    return F.coalesce(_first([F.regexp_extract(url, p, 1) for p in VIDEO_URLS]).isNotNull(), F.lit(False))


def is_channel_url(url: Column) -> Column:
    """Whether an address names a channel in one of the known forms, on the host itself."""
    return F.coalesce(url.rlike(r"^(?:https?://)?(?:www\.)?youtube\.com/(?:channel/|@|user/|c/)[A-Za-z0-9._-]+"), F.lit(False))


def legacy_channel_name(url: Column) -> Column:
    """The name in an @ address, null if the address is no channel's or has none."""
    return F.when(is_channel_url(url), F.nullif(F.regexp_extract(url, r"/@([A-Za-z0-9._-]+)", 1), F.lit("")))


def channel_ref(url: Column) -> Column:
    """What names a channel in its address, in the order /channel/, /@, /user/, /c/; null if nothing does."""
    return _first([F.regexp_extract(url, p, 1) for p in CHANNEL_URLS])


def host_of(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"^[a-z]+://([^/:?#]+)", 1), F.lit(""))


def safe_filename(name: Column) -> Column:
    return F.left(F.regexp_replace(F.regexp_replace(name, r'[<>:"/\\|?*]', "_"), r"^\s+|\s+$", ""), F.lit(255))


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    return F.regexp_replace(strip(text), r"\s+", " ")


def without_stamps(text: Column) -> Column:
    return squeeze(F.regexp_replace(text, STAMP, ""))


def strip_html(html: Column) -> Column:
    """The text of a page: scripts, styles, comments and tags out, white space squeezed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>|<!--.*?-->", " ")
    return squeeze(F.regexp_replace(bare, r"(?s)<[^>]+>", " "))


def _part(text: Column, unit: str) -> Column:
    return F.coalesce(F.regexp_extract(text, rf"(\d+){unit}", 1).try_cast("int"), F.lit(0))


def duration_seconds(text: Column) -> Column:
    """ISO 8601 durations of weeks, days, hours, minutes and seconds; null if empty or malformed."""
    ok = text.rlike(r"^P(?=\d|T\d)(?:\d+W)?(?:\d+D)?(?:T(?=\d)(?:\d+H)?(?:\d+M)?(?:\d+S)?)?$")
    date, time = F.regexp_extract(text, "^P([^T]*)", 1), F.regexp_extract(text, "T(.*)$", 1)
    return F.when(ok, _part(date, "W") * 604800 + _part(date, "D") * 86400 + _part(time, "H") * 3600 + _part(time, "M") * 60 + _part(time, "S"))


def duration_or_zero(text: Column) -> Column:
    return F.coalesce(duration_seconds(text), F.lit(0))


#: Stamp patterns, all applied in this order (fixed values): digits of the hour or minute, of what follows, and the text up to the next mark.
STAMPS = (
    r"(?s)\[(\d{1,2}):(\d{2}):(\d{2})\]\s*(.+?)(?=\[|\z)",
    r"(?s)\[(\d{1,2}):(\d{2})\]\s*(.+?)(?=\[|\z)",
    r"(?s)(\d{1,2}):(\d{2}):(\d{2})\s+(.+?)(?=\d{1,2}:|\z)",
    r"(?s)(\d{1,2}):(\d{2})\s+(.+?)(?=\d{1,2}:|\z)",
    r"(?s)\((\d{1,2}):(\d{2})\)\s*(.+?)(?=\(|\z)",
)


def _stamp(numbers: int, seconds: int) -> Callable[[Column], Column]:
    """From a match of so many numbers and a text to a stamp."""

    def read(x: Column) -> Column:
        start = F.lit(0)
        for i in range(numbers):
            start = start * 60 + x[str(i)].cast("int")
        return F.struct(start.cast("double").alias("start"), (start + seconds).cast("double").alias("end"), strip(x[str(numbers)]).alias("text"))

    return read


def stamps(text: Column, seconds: int = 30) -> Column:
    """array<struct<start, end, text>> of a text's stamps in seconds, form by form; each lasts `seconds` and has the text after it.

    A bare stamp of hours, minutes and seconds is one stamp: for the bare form of minutes and seconds it is no stamp, but still ends a text.
    """
    hours = F.regexp_replace(text, r"(\d{1,2}):\d{2}:\d{2}(?=\s)", "$1:x")
    found = []
    for k, p in enumerate(STAMPS):
        parts = [F.regexp_extract_all(hours if k == 3 else text, F.lit(p), F.lit(i + 1)).alias(str(i)) for i in range(p.count("(\\d") + 1)]
        found.append(F.transform(F.arrays_zip(*parts), _stamp(len(parts) - 1, seconds)))
    return F.concat(*found)


def sentences(text: Column) -> Column:
    """Pieces after each full stop, exclamation or question mark that white space follows, stripped, without empty ones."""
    pieces = F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+"), strip)
    return F.filter(pieces, lambda s: s != "")


def char_windows(text: Column, size: int) -> Column:
    """Consecutive pieces of `size` characters; none for an empty text."""
    n = F.length(F.coalesce(text, F.lit("")))
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.substring(text, s + 1, F.lit(size)))
