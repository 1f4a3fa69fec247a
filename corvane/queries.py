"""The registered queries of the library's own operators over the supplied tables, each with the SQL it is held against."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.functions import tokens as tk
from corvane.functions import vectors as vx
from corvane.functions.embedding import hash_embedder
from corvane.functions.filters import matches
from corvane.operators import analytics, budget, chunking, graph, graph_index, normalize, retrieval, store, text_index, triples
from corvane.operators import vector_search as vs
from corvane.operators.buckets import BucketTable
from corvane.operators.triple_index import TripleIndex
from corvane.plans import ingest
from corvane.plans.registry import Registry
from corvane.plans.sql_functions import register_chunkers
from corvane.shared import kept as keep
from corvane.shared import listing_tasks, new_path
from corvane.sources import files
from corvane.sources.files import check_source, query_source, table
from corvane.streaming import ingest as streaming
from corvane.streaming import keyed_state
from corvane.streaming.ingest import latest_status, windowed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return put


# --- bindings: the supplied tables as the entities that the operators work on ---


def transcripts(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "documents")
    return x.select(F.col("doc_id").alias("video_id"), F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("title"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 1000).cast("int")).alias("publish_date"), F.col("n_chars").alias("length_seconds"), F.col("lang").alias("category_name"), F.col("source").alias("channel"), F.col("text").alias("transcript_text"), tk.token_count(F.col("text")).cast("long").alias("openai_tokens"))


TOKENS = "CASE WHEN {0} IS NULL OR {0} = '' THEN 0 ELSE greatest(1, length({0}) // 4) END"
T = f"WITH t AS (SELECT doc_id AS video_id, 'doc ' || doc_id AS title, CAST(DATE '2020-01-01' + CAST(doc_id % 1000 AS INTEGER) AS DATE) AS publish_date, n_chars AS length_seconds, lang AS category_name, source AS channel, text AS transcript_text, CAST({TOKENS.format('text')} AS BIGINT) AS openai_tokens FROM documents) "


def kg(s: SparkSession, d: str) -> DataFrame:
    """Triples of the star schema: nations in regions, customers and suppliers in nations, suppliers supplying parts (with repeats)."""
    named = lambda c, n: F.concat(F.lit(n + "#"), F.col(c).cast("string"))
    parts = [
        table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("pos"), named("n_nationkey", "nation").alias("subject"), F.lit("in").alias("predicate"), named("n_regionkey", "region").alias("object")),
        table(s, d, "customer").select(F.col("c_custkey") + 1_000, named("c_custkey", "customer"), F.lit("lives in"), named("c_nationkey", "nation")),
        table(s, d, "supplier").select(F.col("s_suppkey") + 10_000_000, named("s_suppkey", "supplier"), F.lit("located in"), named("s_nationkey", "nation")),
        table(s, d, "lineitem").select(F.col("l_orderkey") * 10 + F.col("l_linenumber") + 1_000_000_000, named("l_suppkey", "supplier"), F.lit("supplies"), named("l_partkey", "part")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


KG = """WITH kg AS (SELECT CAST(n_nationkey AS BIGINT) AS pos, 'nation#' || n_nationkey AS subject, 'in' AS predicate, 'region#' || n_regionkey AS object FROM nation
UNION ALL SELECT c_custkey + 1000, 'customer#' || c_custkey, 'lives in', 'nation#' || c_nationkey FROM customer
UNION ALL SELECT s_suppkey + 10000000, 'supplier#' || s_suppkey, 'located in', 'nation#' || s_nationkey FROM supplier
UNION ALL SELECT l_orderkey * 10 + l_linenumber + 1000000000, 'supplier#' || l_suppkey, 'supplies', 'part#' || l_partkey FROM lineitem) """
DEG = KG + ", ends AS (SELECT subject AS node, 0 AS i, 1 AS o FROM kg UNION ALL SELECT object, 1, 0 FROM kg), deg AS (SELECT node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, count(*) AS degree FROM ends GROUP BY node) "


def asked(s: SparkSession, d: str) -> DataFrame:
    """Query vectors: every 20th stored vector, a stated set."""
    return table(s, d, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


DOT = "list_sum(list_transform(range(1, len({0}) + 1), lambda i: CAST({0}[i] AS DOUBLE) * CAST({1}[i] AS DOUBLE)))"
SCORES = {
    "ip": DOT.format("q.embedding", "e.embedding"),
    "cosine": f"{DOT.format('q.embedding', 'e.embedding')} / (sqrt({DOT.format('q.embedding', 'q.embedding')}) * sqrt({DOT.format('e.embedding', 'e.embedding')}))",
    "l2": "1 / (1 + list_sum(list_transform(range(1, len(q.embedding) + 1), lambda i: (CAST(q.embedding[i] AS DOUBLE) - CAST(e.embedding[i] AS DOUBLE)) * (CAST(q.embedding[i] AS DOUBLE) - CAST(e.embedding[i] AS DOUBLE)))))",
}


def topk_sql(metric: str, where: str = "TRUE", after: str = "TRUE", k: int = 5) -> str:
    return f"WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, round({SCORES[metric]}, 6) AS score FROM embeddings q CROSS JOIN embeddings e WHERE q.vec_id % 20 = 0 AND {where}), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s) SELECT query_id, vec_id, score, rank FROM r WHERE rank <= {k} AND {after}"


# --- analytic queries and scans ---


@query(T + "SELECT video_id, title, publish_date, length_seconds, category_name, openai_tokens FROM t")
def all_videos(s, d):
    return analytics.all_videos(transcripts(s, d))


@query(T + "SELECT count(*) AS total_videos, CAST(coalesce(sum(CASE WHEN transcript_text <> '' THEN 1 ELSE 0 END), 0) AS BIGINT) AS with_transcripts, round(sum(CASE WHEN transcript_text <> '' THEN 1 ELSE 0 END) * 100.0 / nullif(count(*), 0), 1) AS transcript_percentage, CAST(coalesce(sum(length_seconds), 0) AS BIGINT) AS total_seconds, round(avg(length_seconds), 1) AS avg_seconds, count(DISTINCT category_name) AS categories FROM t")
def video_stats(s, d):
    return analytics.video_stats(transcripts(s, d)).withColumn("transcript_percentage", F.col("transcript_percentage").cast("double"))


@query(T + "SELECT category_name, count(*) AS video_count, round(avg(length_seconds), 1) AS avg_seconds, CAST(sum(length_seconds) AS BIGINT) AS total_seconds FROM t GROUP BY category_name")
def category_stats(s, d):
    return analytics.category_stats(transcripts(s, d))


@query(T + "SELECT video_id, title, length_seconds, category_name FROM t ORDER BY length_seconds DESC, video_id LIMIT 10")
def longest_videos(s, d):
    return analytics.longest_videos(transcripts(s, d))


@query(T + "SELECT video_id, title, publish_date FROM t ORDER BY publish_date DESC, video_id LIMIT 10")
def recent_videos(s, d):
    return analytics.recent_videos(transcripts(s, d))


@query(T + "SELECT CAST(coalesce(sum(openai_tokens), 0) AS BIGINT) AS total_tokens FROM t")
def openai_tokens(s, d):
    return analytics.token_total(transcripts(s, d))


@query(T + "SELECT video_id, title, transcript_text FROM t WHERE video_id = 7")
def video_transcript(s, d):
    return analytics.transcript_of(transcripts(s, d), 7)


@query(T + "SELECT video_id, title, openai_tokens FROM t WHERE transcript_text <> ''")
def nonempty_scan(s, d):
    return analytics.nonempty(transcripts(s, d))


@query(T + "SELECT video_id, openai_tokens FROM t WHERE openai_tokens > 2000 ORDER BY video_id LIMIT 1")
def first_long_text(s, d):
    return analytics.first_above(transcripts(s, d), 2000)


@query("SELECT * FROM (VALUES ('video_id', true), ('title', true), ('publish_date', true), ('length_seconds', true), ('description', false), ('tags', false), ('category_name', true), ('transcript_text', true)) v(\"column\", present)")
def source_validation(s, d):
    return check_source(transcripts(s, d))


@query(T + "SELECT channel, count(*) AS n FROM t WHERE length_seconds > 1000 GROUP BY channel")
def sql_over_view(s, d):
    return query_source(s, transcripts(s, d), "SELECT channel, count(*) AS n FROM transcripts WHERE length_seconds > 1000 GROUP BY channel")


@query(T + "SELECT m AS model, round((SELECT coalesce(sum(openai_tokens), 0) FROM t) * p / 1e6, 3) AS cost FROM (VALUES ('gpt-4.1', 2.0::DOUBLE), ('gpt-4.1-mini', 0.4::DOUBLE), ('gpt-4.1-nano', 0.1::DOUBLE)) v(m, p)")
def api_costs(s, d):
    return analytics.model_costs(transcripts(s, d))


@query(T + "SELECT m AS model, round((SELECT coalesce(sum(openai_tokens), 0) FROM t) * p / 1e3, 6) AS cost FROM (VALUES ('text-embedding-3-small', 0.00002::DOUBLE), ('text-embedding-3-large', 0.00013::DOUBLE), ('text-embedding-ada-002', 0.0001::DOUBLE)) v(m, p)")
def embedding_costs(s, d):
    return analytics.embedding_costs(transcripts(s, d))


@query(T + "SELECT channel, CAST(sum(openai_tokens) AS BIGINT) AS total_tokens, CASE WHEN sum(openai_tokens) < 1000000 THEN 'direct' WHEN sum(openai_tokens) < 10000000 THEN 'sliding_window' ELSE 'batch' END AS strategy FROM t GROUP BY channel")
def strategy_by_tokens(s, d):
    return analytics.strategy(transcripts(s, d), "channel")


# --- keyed tables ---


def _changes(s, d):
    x = table(s, d, "documents").filter("doc_id % 10 = 0").select("doc_id", F.upper("source").alias("source"), F.lit("x").alias("unknown"))
    return x.union(s.range(3).select(F.col("id") + 1_000_000_000, F.lit("NEW"), F.lit("x")))


@query("SELECT d.doc_id, lang, CASE WHEN d.doc_id % 10 = 0 THEN upper(source) ELSE source END AS source, n_chars FROM documents d UNION ALL SELECT 1000000000 + i, NULL, 'NEW', NULL FROM range(3) r(i)")
def upsert(s, d):
    return store.upsert(table(s, d, "documents").select("doc_id", "lang", "source", "n_chars"), _changes(s, d), "doc_id")


@query("SELECT doc_id, source, lang FROM documents UNION ALL SELECT 1000000000 + i, 'NEW', NULL FROM range(3) r(i)")
def insert_rows(s, d):
    rows = s.range(3).select((F.col("id") + 1_000_000_000).alias("doc_id"), F.lit("NEW").alias("source"), F.lit(1).alias("unknown"))
    return store.insert(table(s, d, "documents").select("doc_id", "source", "lang"), rows)


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id = 42")
def point_lookup(s, d):
    return store.by_key(table(s, d, "documents").select("doc_id", "lang", "source"), "doc_id", 42)


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_by_keys(s, d):
    return store.without_keys(table(s, d, "documents").select("doc_id", "lang"), table(s, d, "labels").filter("toxic = 1"), "doc_id")


@query("SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 25 OFFSET 50")
def page_list(s, d):
    return store.page(table(s, d, "documents").select("doc_id", "source"), "doc_id", 25, 50)


@query("SELECT doc_id, lang, n_chars FROM documents WHERE source = 'src3'")
def filter_by_column(s, d):
    return table(s, d, "documents").filter(matches({"source": "src3"}, ["source"])).select("doc_id", "lang", "n_chars")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def exists_semi(s, d):
    return store.with_keys(table(s, d, "documents").select("doc_id"), table(s, d, "labels"), "doc_id")


@query("SELECT 1 AS ok")
def connectivity(s, d):
    return s.range(1).select(F.lit(1).alias("ok"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def incremental_skip_known(s, d):
    return store.without_keys(table(s, d, "documents").select("doc_id"), table(s, d, "labels"), "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id < (SELECT min(doc_id) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1))")
def incremental_until_known(s, d):
    stream = table(s, d, "documents").select("doc_id", F.col("doc_id").alias("pos"))
    return store.until_known(stream, table(s, d, "labels").filter("toxic = 1"), "doc_id", "pos").select("doc_id")


@query("SELECT CAST(sum(CASE WHEN l.doc_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS created, CAST(sum(CASE WHEN l.quality = 1 THEN 1 ELSE 0 END) AS BIGINT) AS updated, CAST(sum(CASE WHEN l.quality = 0 THEN 1 ELSE 0 END) AS BIGINT) AS skipped FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def load_outcomes(s, d):
    x = table(s, d, "documents").select("doc_id").join(table(s, d, "labels").withColumnRenamed("doc_id", "known"), F.col("doc_id") == F.col("known"), "left")
    return store.outcomes(x, F.col("known").isNull(), F.col("quality") == 1, F.col("quality") == 0)


@query("SELECT c_custkey, coalesce(n_name, 'Unknown') AS category FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) n ON c_nationkey = n_nationkey")
def dim_lookup(s, d):
    dim = table(s, d, "nation").filter("n_regionkey <> 2").withColumnRenamed("n_name", "category")
    return store.names_from(table(s, d, "customer").select("c_custkey", "c_nationkey"), dim, "c_nationkey", "n_nationkey", "category").select("c_custkey", "category")


@query("SELECT i AS pos, i * 7 AS doc_id, source FROM range(200) r(i) LEFT JOIN documents ON doc_id = i * 7")
def get_by_ids(s, d):
    ids = s.range(200).select(F.col("id").alias("pos"), (F.col("id") * 7).alias("doc_id"))
    return store.in_order_of(ids, table(s, d, "documents").select("doc_id", "source"), "doc_id", "pos").select("pos", "doc_id", "source")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY user_id")
def latest_status_by_task(s, d):
    return latest_status(table(s, d, "events"), key="user_id", time="ts", status="event_type", tie="event_id").withColumnRenamed("event_type", "status")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def status_counts(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_counts(s, d):
    return windowed(table(s, d, "events")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


# --- metadata normalisation ---


def _raw(s, d):
    """Raw records as an interface gives them: nested, counts as text, parts absent."""
    x = table(s, d, "documents")
    i = F.col("doc_id")
    snippet = F.struct(F.concat(F.lit("Title "), i.cast("string"), F.when(i % 11 == 0, " #Shorts").otherwise("")).alias("title"), F.when(i % 3 == 0, F.lit("text")).alias("description"), F.col("source").alias("channelId"), F.when(i % 13 == 0, F.lit("42")).otherwise(F.lit("22")).alias("categoryId"))
    duration = F.when(i % 5 == 0, F.lit(None)).when(i % 7 == 0, F.lit("bad")).otherwise(F.concat(F.lit("PT"), (i % 3).cast("string"), F.lit("H"), (i % 60).cast("string"), F.lit("M"), (i % 50).cast("string"), F.lit("S")))
    stats = F.when(i % 4 != 0, F.struct(F.col("n_chars").cast("string").alias("viewCount"), F.lit("7").alias("likeCount")))
    status = F.struct(F.when(i % 17 == 0, "private").otherwise("public").alias("privacyStatus"))
    return normalize.parsed(x.select(F.to_json(F.struct(i.cast("string").alias("id"), snippet.alias("snippet"), F.struct(duration.alias("duration")).alias("contentDetails"), stats.alias("statistics"), status.alias("status"))).alias("json")), "json")


_SECONDS = "CASE WHEN doc_id % 5 = 0 OR doc_id % 7 = 0 THEN NULL ELSE (doc_id % 3) * 3600 + (doc_id % 60) * 60 + doc_id % 50 END"
_NORM = f"WITH n AS (SELECT CAST(doc_id AS VARCHAR) AS video_id, 'Title ' || doc_id || CASE WHEN doc_id % 11 = 0 THEN ' #Shorts' ELSE '' END AS title, CASE WHEN doc_id % 3 = 0 THEN 'text' ELSE '' END AS description, coalesce(source, '') AS channel_id, CAST({_SECONDS} AS INTEGER) AS duration_seconds, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE n_chars END AS view_count, CASE WHEN doc_id % 17 = 0 THEN 'private' ELSE 'public' END AS privacy_status, (doc_id % 13 = 0 OR coalesce({_SECONDS} <= 60, false) OR doc_id % 11 = 0) AS is_short FROM documents) "


@query(_NORM + "SELECT * FROM n")
def normalize_metadata(s, d):
    return normalize.normalized(_raw(s, d)).select("video_id", "title", "description", "channel_id", "duration_seconds", "view_count", "privacy_status", "is_short")


@query(_NORM + "SELECT video_id, title FROM n WHERE privacy_status = 'public' AND NOT is_short")
def public_long_videos(s, d):
    return normalize.public_videos(normalize.normalized(_raw(s, d))).select("video_id", "title")


@query(_NORM + "SELECT video_id FROM n WHERE privacy_status = 'public' AND NOT is_short ORDER BY video_id LIMIT 20")
def capped_videos(s, d):
    return normalize.public_videos(normalize.normalized(_raw(s, d)), most=20).select("video_id")


@query("SELECT doc_id, coalesce(title, 'N/A') AS title, coalesce(lang, 'Unknown') AS category_name, coalesce(n_chars, 0) AS length_seconds FROM labels l LEFT JOIN (SELECT doc_id AS k, 'doc ' || doc_id AS title, lang, n_chars FROM documents WHERE doc_id % 3 <> 0) m ON l.doc_id = m.k")
def metadata_left_join(s, d):
    meta = transcripts(s, d).filter("video_id % 3 <> 0").select(F.col("video_id").alias("doc_id"), "title", "category_name", "length_seconds")
    return normalize.with_transcripts(table(s, d, "labels").select("doc_id"), meta, "doc_id").select("doc_id", "title", "category_name", "length_seconds")


@query("WITH t AS (SELECT conv_id AS video_id, turn AS position, CASE role WHEN 'user' THEN 'en' WHEN 'assistant' THEN 'de' ELSE 'fr' END AS language_code, turn % 2 = 0 AS is_generated FROM conversations) SELECT video_id, arg_min(language_code, (CASE language_code WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE CASE WHEN is_generated THEN 1000001 ELSE 1000000 END END, position)) AS language_code FROM t GROUP BY video_id")
def chosen_transcript(s, d):
    t = table(s, d, "conversations").select(F.col("conv_id").alias("video_id"), F.col("turn").alias("position"), F.when(F.col("role") == "user", "en").when(F.col("role") == "assistant", "de").otherwise("fr").alias("language_code"), (F.col("turn") % 2 == 0).alias("is_generated"))
    return normalize.chosen_transcript(t, ["fr", "de"]).select("video_id", "language_code")


# --- scalar functions ---


@query("SELECT page_id, nullif(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '') AS host, left(regexp_replace(regexp_replace(url, '[<>:\"/\\\\|?*]', '_', 'g'), '^\\s+|\\s+$', '', 'g'), 255) AS file_name FROM pages")
def url_parts(s, d):
    return table(s, d, "pages").select("page_id", tx.host_of(F.col("url")).alias("host"), tx.safe_filename(F.col("url")).alias("file_name"))


_ADDRESS = "WITH p AS (SELECT page_id AS i, substring(md5(CAST(page_id AS VARCHAR)), 1, 11) AS v FROM pages), u AS (SELECT *, i % 8 AS form FROM p) "


@query(_ADDRESS + "SELECT i, CASE WHEN form <= 3 THEN v END AS video_id, form <= 2 AS is_video, CASE form WHEN 4 THEN 'UC' || v WHEN 5 THEN v || '.x' WHEN 6 THEN 'n' || v END AS channel, form BETWEEN 4 AND 6 AS is_channel, CASE WHEN form = 5 THEN v || '.x' END AS legacy_name FROM u")
def address_forms(s, d):
    """Ids of pages in every form of an address, and in none."""
    v = F.substring(F.md5(F.col("page_id").cast("string")), 1, 11)
    forms = [("https://www.youtube.com/watch?v=", v, "&t=1"), ("youtu.be/", v, ""), ("http://youtube.com/embed/", v, "?x"), ("", v, ""), ("https://www.youtube.com/channel/UC", v, ""), ("https://youtube.com/@", v, ".x"), ("youtube.com/c/n", v, "/videos"), ("nothing here ", v, "")]
    url = F.lit(None).cast("string")
    for k, (before, mid, after) in enumerate(forms):
        url = F.when(F.col("page_id") % 8 == k, F.concat(F.lit(before), mid, F.lit(after))).otherwise(url)
    u = table(s, d, "pages").select(F.col("page_id").alias("i"), url.alias("url"))
    return u.select("i", tx.video_id(F.col("url")).alias("video_id"), tx.is_video_url(F.col("url")).alias("is_video"), tx.channel_ref(F.col("url")).alias("channel"), tx.is_channel_url(F.col("url")).alias("is_channel"), tx.legacy_channel_name(F.col("url")).alias("legacy_name"))


@query("SELECT event_id AS i, CAST(CASE event_id % 6 WHEN 0 THEN event_id % 59 * 60 + event_id % 47 WHEN 1 THEN event_id % 23 * 3600 + 62 WHEN 2 THEN (event_id % 5 + 1) * 86400 + 3600 WHEN 3 THEN (event_id % 4 + 1) * 604800 END AS INTEGER) AS seconds, CAST(CASE event_id % 6 WHEN 0 THEN event_id % 59 * 60 + event_id % 47 WHEN 1 THEN event_id % 23 * 3600 + 62 WHEN 2 THEN (event_id % 5 + 1) * 86400 + 3600 WHEN 3 THEN (event_id % 4 + 1) * 604800 ELSE 0 END AS INTEGER) AS or_zero FROM events")
def parse_durations(s, d):
    """Durations written from each event's number, in four forms, a malformed one and none."""
    i = F.col("event_id")
    t = F.when(i % 6 == 0, F.format_string("PT%dM%dS", i % 59, i % 47)).when(i % 6 == 1, F.format_string("PT%dH1M2S", i % 23)).when(i % 6 == 2, F.format_string("P%dDT1H", i % 5 + 1)).when(i % 6 == 3, F.format_string("P%dW", i % 4 + 1)).when(i % 6 == 4, F.lit("PT"))
    return table(s, d, "events").select(i.alias("i"), tx.duration_seconds(t).alias("seconds"), tx.duration_or_zero(t).alias("or_zero"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events")
def json_extract(s, d):
    return table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("SELECT conv_id, turn, trim(regexp_replace(regexp_replace(text, '\\[[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?\\]', '', 'g'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS clean FROM conversations")
def clean_text(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", tx.without_stamps(F.col("text")).alias("clean"))


@query()
def html_text(s, d):
    return table(s, d, "pages").select("page_id", F.length(tx.strip_html(F.col("html"))).alias("n_chars"))


@query("SELECT conv_id, turn, k AS stamp_no, CASE k WHEN 0 THEN 3723.0 ELSE turn % 24 * 3600.0::DOUBLE + turn % 60 * 60 + 5 END AS start_time, CASE k WHEN 0 THEN 3753.0 ELSE turn % 24 * 3600.0::DOUBLE + turn % 60 * 60 + 35 END AS end_time, CASE k WHEN 0 THEN 'end' ELSE regexp_replace(translate(text, '[(:', '') || ' [', '^\\s+|\\s+$', '', 'g') END AS text FROM (SELECT * FROM conversations WHERE text IS NOT NULL) c, range(2) r(k)")
def stamp_extraction(s, d):
    """All stamps of every turn: a bare one of hours before its text, one in brackets after it."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    stamped = F.concat(two(F.col("turn") % 24), F.lit(":"), two(F.col("turn") % 60), F.lit(":05 "), F.translate("text", "[(:", ""), F.lit(" [62:03] end"))
    found = table(s, d, "conversations").select("conv_id", "turn", F.posexplode(tx.stamps(stamped)).alias("k", "z"))
    return found.select("conv_id", "turn", F.col("k").cast("long").alias("stamp_no"), F.col("z.start").alias("start_time"), F.col("z.end").alias("end_time"), F.col("z.text").alias("text"))


@query(f"SELECT doc_id, CAST({TOKENS.format('text')} AS INTEGER) AS tokens, CAST(length(coalesce(text, '')) // 4 AS INTEGER) AS estimate, length(coalesce(text, '')) // 4 <= 500 AS fits, substring(text, 1, 40) AS cut FROM documents")
def token_count(s, d):
    t = F.col("text")
    return table(s, d, "documents").select("doc_id", tk.token_count(t).alias("tokens"), tk.token_estimate(t).alias("estimate"), tk.within_limit(F.coalesce(t, F.lit("")), 500).alias("fits"), tk.truncate_to_tokens(t, 10).alias("cut"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'cl100k_base' WHEN 1 THEN 'o200k_base' WHEN 2 THEN 'p50k_base' ELSE 'cl100k_base' END AS encoding FROM events")
def model_encoding(s, d):
    i = F.col("event_id")
    m = F.when(i % 5 == 0, F.format_string("gpt-4-%d", i)).when(i % 5 == 1, F.format_string("gpt-4o-mini-%d", i)).when(i % 5 == 2, F.format_string("text-davinci-%d", i)).when(i % 5 == 3, F.format_string("text-embedding-%d", i)).otherwise(F.format_string("other %d", i))
    return table(s, d, "events").select("event_id", tk.encoding_of(m).alias("encoding"))


_B = T + ", b AS (SELECT video_id, channel, openai_tokens, CAST((row_number() OVER (PARTITION BY channel ORDER BY video_id) - 1) // 3 AS INTEGER) AS batch_no FROM t), c AS (SELECT *, CAST(sum(openai_tokens) OVER (PARTITION BY channel, batch_no) AS BIGINT) AS batch_tokens FROM b) "


@query(_B + "SELECT video_id, batch_no, batch_tokens, CASE WHEN batch_tokens <= 2500 THEN 'batch' WHEN openai_tokens <= 2500 THEN 'single' ELSE 'skipped' END AS handling FROM c")
def batch_by_tokens(s, d):
    return budget.batches(transcripts(s, d), keep("batches"), by="channel", order="video_id", tokens="openai_tokens", size=3, limit=2500).select("video_id", "batch_no", "batch_tokens", "handling")


@query()
def window_packing(s, d):
    return budget.windows(transcripts(s, d), by="channel", order="video_id", tokens="openai_tokens", window=9_000, overlap=500)


@query(T + ", r AS (SELECT channel, video_id, sum(openai_tokens) OVER (PARTITION BY channel ORDER BY video_id ROWS UNBOUNDED PRECEDING) AS x FROM t) SELECT channel, video_id, CAST(x AS BIGINT) AS running_tokens FROM r WHERE x <= 9000")
def context_budget(s, d):
    return budget.context(transcripts(s, d), keep("context"), by="channel", rank="video_id", tokens="openai_tokens", budget=10_000).select("channel", "video_id", "running_tokens")


_PARTS = T + f", r AS (SELECT *, CAST((sum(openai_tokens) OVER (PARTITION BY category_name ORDER BY video_id) - openai_tokens) // 20000 AS BIGINT) AS part FROM t) "


@query(_PARTS + "SELECT category_name, part, string_agg('=== ' || title || ' ===' || chr(10) || transcript_text, chr(10) || chr(10) ORDER BY video_id) AS prompt FROM r GROUP BY ALL")
def prompt_assembly(s, d):
    """Titled texts of each category in parts: a part's texts begin within 20,000 tokens, so no prompt grows with the table."""
    t = budget.running(transcripts(s, d), keep("prompts"), by=["category_name"], order=["video_id"], value="openai_tokens", into="upto")
    blocks = t.select("category_name", F.floor((F.col("upto") - F.col("openai_tokens")) / 20_000).alias("part"), F.struct("video_id", triples.prompts(t, title="title", text="transcript_text").alias("b")).alias("x"))
    return blocks.groupBy("category_name", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["b"]), "\n\n").alias("prompt"))


# --- chunking ---


@query("WITH s AS (SELECT doc_id, unnest(range(0, length(text), 2048)) AS a, text FROM documents WHERE length(text) > 0) SELECT doc_id, CAST(a // 2048 AS INTEGER) AS chunk_no, substring(text, a + 1, 2048) AS chunk_text FROM s")
def stride_chunks(s, d):
    return chunking.exploded_windows(table(s, d, "documents"), id_col="doc_id", text_col="text", size=2048)


@query("SELECT doc_id, CAST(a // 2048 AS INTEGER) AS chunk_no, substring(text, a + 1, 2048) AS chunk_text, CAST(a AS INTEGER) AS start_idx FROM (SELECT doc_id, unnest(range(0, length(text), 2048)) AS a, text FROM documents WHERE length(text) > 0)")
def sql_chunks(s, d):
    """A chunker called from SQL as a table function of its registered name."""
    chunkers = Registry()
    chunkers.register("chunker", "stride", chunking.Stride)
    register_chunkers(s, chunkers)
    table(s, d, "documents").createOrReplaceTempView("sql_chunks_documents")
    return s.sql("SELECT d.doc_id, c.chunk_no, c.text AS chunk_text, c.start_idx FROM sql_chunks_documents d, LATERAL chunk_stride(d.text, '{\"size\": 2048}') c")


_SENT = "WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])[ \\t\\n\\r\\f\\v]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^[ \\t\\n\\r\\f\\v]+|[ \\t\\n\\r\\f\\v]+$', '', 'g')), lambda x: x <> '') AS x FROM documents) "


@query(_SENT + "SELECT doc_id, CAST(i AS INTEGER) AS sentence_no, x[i + 1] AS sentence FROM (SELECT doc_id, x, unnest(range(len(x))) AS i FROM p)")
def sentence_split(s, d):
    return chunking.exploded_sentences(table(s, d, "documents"), id_col="doc_id", text_col="text")


@query("WITH c AS (SELECT length(substring(text, a + 1, 2048)) AS n FROM (SELECT text, unnest(range(0, length(text), 2048)) AS a FROM documents WHERE length(text) > 0)), t AS (SELECT n, greatest(1, n // 4) AS k FROM c) SELECT count(*) AS total_chunks, CAST(coalesce(sum(k), 0) AS BIGINT) AS total_tokens, coalesce(round(avg(k), 4), 0) AS average_tokens, CAST(coalesce(min(k), 0) AS INTEGER) AS min_tokens, CAST(coalesce(max(k), 0) AS INTEGER) AS max_tokens, CAST(coalesce(sum(n), 0) AS BIGINT) AS total_characters, coalesce(round(avg(n), 4), 0) AS average_characters, CAST(coalesce(min(n), 0) AS INTEGER) AS min_characters, CAST(coalesce(max(n), 0) AS INTEGER) AS max_characters FROM t")
def chunk_statistics(s, d):
    c = chunking.exploded_windows(table(s, d, "documents"), id_col="doc_id", text_col="text", size=2048).withColumn("token_count", tk.token_count(F.col("chunk_text")))
    return chunking.statistics(c, text_col="chunk_text")


@query()
def fixed_chunks(s, d):
    return chunking.chunked(table(s, d, "documents"), chunking.FixedLength(128, 16), id_col="doc_id", text_col="text")


@query()
def window_chunks(s, d):
    return chunking.chunked(table(s, d, "documents"), chunking.CharWindow(200, 20), id_col="doc_id", text_col="text")


@query()
def long_text_pieces(s, d):
    return chunking.chunked(table(s, d, "documents"), chunking.LongText(1000, 50), id_col="doc_id", text_col="text")


@query()
def sentence_pack_chunks(s, d):
    return chunking.chunked(table(s, d, "documents"), chunking.SentencePack(256, 3), id_col="doc_id", text_col="text")


@query()
def semantic_chunks(s, d):
    return chunking.chunked(table(s, d, "documents"), chunking.Semantic(hash_embedder(64), 0.2, 256, 20), id_col="doc_id", text_col="text")


@query()
def sentence_window_chunks(s, d):
    return chunking.sentence_windows(table(s, d, "documents"), id_col="doc_id", text_col="text")


def _segments(s, d):
    return chunking.segments_of(table(s, d, "conversations"), id_col="conv_id", order="turn", text_col="text")


@query()
def timestamped_chunks(s, d):
    x = _segments(s, d).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text", "start", "duration"))), lambda e: F.struct(e["text"].alias("text"), e["start"].alias("start"), e["duration"].alias("duration"))).alias("segments"))
    return chunking.timestamped(x, id_col="conv_id", segments_col="segments", max_tokens=100, overlap_tokens=50)


_SEG = f"WITH s AS (SELECT conv_id, turn, text, CAST({TOKENS.format('text')} AS DOUBLE) AS duration, coalesce(sum(length(text) + 1) OVER w, 0) AS pos, coalesce(sum({TOKENS.format('text')}) OVER w, 0) AS start FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), j AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS full_text FROM conversations GROUP BY conv_id), c AS (SELECT conv_id, CAST(a // 300 AS INTEGER) AS chunk_no, a AS start_idx, least(a + 300, length(full_text)) AS end_idx FROM (SELECT conv_id, full_text, unnest(range(0, length(full_text), 300)) AS a FROM j WHERE length(full_text) > 0)) "


@query(_SEG + "SELECT c.conv_id, c.chunk_no, CAST((SELECT arg_max(s.start, s.pos) FROM s WHERE s.conv_id = c.conv_id AND s.pos <= c.start_idx) AS DOUBLE) AS start_time, CAST((SELECT arg_max(s.start + s.duration, s.pos) FROM s WHERE s.conv_id = c.conv_id AND s.pos <= c.end_idx) AS DOUBLE) AS end_time FROM c")
def asof_segment_times(s, d):
    seg = _segments(s, d)
    full = table(s, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("full_text"))
    c = chunking.exploded_windows(full, id_col="conv_id", text_col="full_text", size=300).select("conv_id", "chunk_no", (F.col("chunk_no") * 300).alias("start_idx"), (F.col("chunk_no") * 300 + F.length("chunk_text")).alias("end_idx"))
    return chunking.with_times(c, seg, id_col="conv_id")


@query(f"SELECT conv_id, CAST(sum({TOKENS.format('text')}) AS BIGINT) AS tokens, string_agg(text, chr(10) ORDER BY turn) AS full_text FROM conversations GROUP BY conv_id")
def segment_concat(s, d):
    x = table(s, d, "conversations").groupBy("conv_id").agg(F.sum(tk.token_count(F.col("text"))).alias("tokens"), F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("x"))
    return x.select("conv_id", "tokens", F.array_join(F.transform("x", lambda e: e["text"]), "\n").alias("full_text"))


@query("SELECT conv_id, custom_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS place FROM (SELECT conv_id, 'segment-' || turn AS custom_id, turn FROM conversations)")
def suffix_order(s, d):
    """Segments of each conversation in the order of the number at the end of their ids. A conversation's segments are few."""
    x = table(s, d, "conversations").select("conv_id", F.concat(F.lit("segment-"), F.col("turn").cast("string")).alias("custom_id"))
    return x.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.split("custom_id", "-")[1].cast("int"))))


# --- vectors ---


@query(topk_sql("cosine"))
def topk_cosine(s, d):
    return vs.top_k(asked(s, d), table(s, d, "embeddings"))


@query(topk_sql("ip"))
def topk_inner_product(s, d):
    return vs.top_k(asked(s, d), table(s, d, "embeddings"), metric="ip")


@query(topk_sql("l2"))
def topk_l2(s, d):
    return vs.top_k(asked(s, d), table(s, d, "embeddings"), metric="l2")


@query(topk_sql("cosine", "e.label IN (1, 2, 3) AND e.vec_id >= 10 AND e.vec_id < 400", "score >= 0.1"))
def topk_filtered(s, d):
    return vs.top_k(asked(s, d), table(s, d, "embeddings"), filters={"label": [1, 2, 3], "vec_id": {"$gte": 10, "$lt": 400}}, threshold=0.1)


@query()
def topk_cells(s, d):
    e = table(s, d, "embeddings")
    c = vs.centroids_of(e, 16)
    return vs.top_k_cells(asked(s, d), vs.cells(e, c), c, probes=12)


@query()
def topk_graph_index(s, d):
    """Top-k by walks through layered graphs; recall against the exact way is held by tests."""
    return graph_index.search(asked(s, d), keep("graph-index")(graph_index.build(table(s, d, "embeddings"))))


@query("SELECT vec_id FROM embeddings WHERE len(embedding) > 0")
def graph_index_keys(s, d):
    """Every stored vector stands in one graph."""
    return graph_index.keys_of(keep("graph-index")(graph_index.build(table(s, d, "embeddings"), shard_rows=4096))).select("vec_id")


@query("SELECT vec_id, label FROM embeddings WHERE label = 4 AND vec_id > 100")
def metadata_filter(s, d):
    e = table(s, d, "embeddings")
    return e.filter(matches({"label": 4, "vec_id": {"$gt": 100, "$odd": 1}}, e.columns)).select("vec_id", "label")


@query("SELECT label, CAST(i - 1 AS INTEGER) AS dim, round(avg(CAST(embedding[i] AS DOUBLE)), 6) AS value FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY label, i")
def centroid_means(s, d):
    return vs.mean_vectors(table(s, d, "embeddings"), "label", "embedding")


@query("SELECT vec_id, CAST(i - 1 AS INTEGER) AS dim, round(CAST(embedding[i] AS DOUBLE) / sqrt(n), 5) AS value FROM (SELECT vec_id, embedding, " + DOT.format("embedding", "embedding") + " AS n, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)")
def normalized_vectors(s, d):
    e = table(s, d, "embeddings")
    return e.select("vec_id", F.posexplode(vx.normalized(F.col("embedding"))).alias("dim", "x")).select("vec_id", "dim", F.round("x", 5).alias("value"))


@query("SELECT vec_id, len(embedding) = 64 AS sound FROM embeddings")
def vector_validation(s, d):
    return table(s, d, "embeddings").select("vec_id", vx.sound(F.col("embedding"), 64).alias("sound"))


@query("SELECT count(*) AS total_vectors, CAST(max(len(embedding)) AS INTEGER) AS dimension, CAST(min(len(embedding)) AS INTEGER) AS smallest_dimension, 'flat' AS kind, 'cosine' AS metric FROM embeddings")
def store_stats(s, d):
    return vs.store_stats(table(s, d, "embeddings"))


@query("SELECT round((sum(strlen(text)) + count(*) * 64 * 4) / (1024.0 * 1024.0)::DOUBLE, 4) AS memory_mb FROM documents")
def memory_estimate(s, d):
    return vs.memory_mb(table(s, d, "documents"), 64).withColumn("memory_mb", F.col("memory_mb").cast("double"))


@query("SELECT vec_id, CASE WHEN vec_id % 50 = 0 THEN 99 ELSE label END AS label FROM embeddings WHERE vec_id NOT IN (1, 2, 3)")
def store_add_delete(s, d):
    e = table(s, d, "embeddings").select("vec_id", "label")
    return vs.delete(vs.add(e, e.filter("vec_id % 50 = 0").withColumn("label", F.lit(99)), "vec_id"), [1, 2, 3], "vec_id")


@query(f"WITH f AS ({topk_sql('cosine', 'q.vec_id <> e.vec_id')}), w AS (SELECT q.vec_id AS query_id, count(*) AS wanted FROM embeddings q JOIN embeddings e ON q.label = e.label AND q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0 GROUP BY 1), h AS (SELECT f.query_id, count(*) AS hits FROM f JOIN embeddings a ON a.vec_id = f.query_id JOIN embeddings b ON b.vec_id = f.vec_id WHERE a.label = b.label GROUP BY 1), p AS (SELECT coalesce(hits, 0) / 5.0::DOUBLE AS p, coalesce(coalesce(hits, 0) / nullif(wanted, 0)::DOUBLE, 0) AS r FROM (SELECT DISTINCT query_id FROM f) q LEFT JOIN h USING (query_id) LEFT JOIN w USING (query_id)) SELECT round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) AS f1 FROM p")
def quality_at_k(s, d):
    e, q = table(s, d, "embeddings"), asked(s, d)
    found = vs.top_k(q, e, k=6).filter("query_id <> vec_id")
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).filter("rank <= 5")
    return vs.quality_by_label(found, e.select("vec_id", "label"), 5)


@query()
def hashed_embeddings(s, d):
    from corvane.functions.embedding import embedded

    return embedded(table(s, d, "documents").select("doc_id", "text"), "text", hash_embedder(32)).select("doc_id", F.size("embedding").alias("dim"), F.round(vx.norm(F.col("embedding")), 3).alias("norm"))


@query("SELECT count(*) FILTER (text <> '') AS documents, CAST(sum(ceil(length(text) / 2048.0)) AS BIGINT) AS chunks, CAST(sum(ceil(length(text) / 2048.0)) AS BIGINT) AS embeddings FROM documents")
def ingest_counts(s, d):
    docs = table(s, d, "documents")
    return ingest.ingest_stats(docs, ingest.ingest(docs, chunking.Stride(2048), hash_embedder(16), id_col="doc_id", text_col="text", metadata=["source"]), text_col="text")


@query("SELECT doc_id, lang, source, count(*) AS chunks, CAST(sum(len(c)) AS BIGINT) AS characters FROM (SELECT doc_id, lang, source, substring(text, a + 1, 1000) AS c FROM (SELECT *, unnest(range(0, length(text), 1000)) AS a FROM documents WHERE length(text) > 0)) GROUP BY ALL")
def chunk_metadata(s, d):
    """The metadata of its document on every chunk."""
    c = chunking.chunked(table(s, d, "documents"), chunking.Stride(1000), id_col="doc_id", text_col="text", metadata=["lang", "source"])
    return c.groupBy("doc_id", "lang", "source").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("characters"))


@query()
def ingest_and_retrieve(s, d):
    chunks = ingest.ingest(table(s, d, "documents"), chunking.FixedLength(64, 8), hash_embedder(32), id_col="doc_id", text_col="text", metadata=["lang"])
    return ingest.retrieve(s, chunks, ["the of and", "de la que", "the of and"], hash_embedder(32), k=5, filters={"lang": ["en", "fr", "es"]})


@query("SELECT CAST(5 AS BIGINT) AS found, 5 AS last_rank")
def one_call_wrappers(s, d):
    """Ingest and retrieval in one call each, by the names of their components, over a store on disk."""
    path = new_path(s, "one-call")
    ingest.ingest_documents(table(s, d, "documents"), chunker="window", chunker_options={"max_tokens": 256, "overlap": 16}, embedder_options={"dim": 16}, path=path, id_col="doc_id", text_col="text")
    found = ingest.retrieve_text(s, "the of and", path=path, embedder_options={"dim": 16}, k=5)
    return found.agg(F.count("*").alias("found"), F.max("rank").alias("last_rank"))


@query()
def component_sweep(s, d):
    return ingest.sweep(table(s, d, "documents"), {"fixed": chunking.FixedLength(64, 8), "window": chunking.CharWindow(64, 8)}, {"hash": hash_embedder(16)}, id_col="doc_id", text_col="text")


@query()
def long_text_means(s, d):
    """The mean vector of each text's pieces of at most 100 tokens."""
    v = ingest.long_text_vectors(table(s, d, "documents"), hash_embedder(8), id_col="doc_id", text_col="text", most_tokens=100)
    return v.select("doc_id", "pieces", F.posexplode("embedding").alias("dim", "x")).select("doc_id", "pieces", "dim", F.round("x", 6).alias("value"))


@query("SELECT doc_id, CASE WHEN text IS NULL THEN 'missing' WHEN NOT regexp_matches(text, '\\S') THEN 'blank' WHEN length(text) // 4 > 500 THEN 'too_long' END AS fault FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 7 = 1 THEN '  ' ELSE text END AS text FROM documents)")
def text_validation(s, d):
    t = F.when(F.col("doc_id") % 7 == 0, F.lit(None)).when(F.col("doc_id") % 7 == 1, F.lit("  ")).otherwise(F.col("text"))
    return chunking.text_faults(table(s, d, "documents").withColumn("text", t), "text", most_tokens=500).select("doc_id", "fault")


# --- text retrieval ---


def _questions(s, d):
    return table(s, d, "benchmark").select("item_id", F.col("text").alias("q"))


_BM = "WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL), z AS (SELECT doc_id, len(w) AS n, w FROM w), tot AS (SELECT count(*) AS docs, avg(n) AS mean FROM z), q AS (SELECT DISTINCT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS term FROM benchmark), tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM z) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), "
_BM += "sc AS (SELECT q.item_id, tf.doc_id, round(sum(ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean))), 4) AS score, round(sum(ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))), 4) AS shared FROM tf JOIN df USING (term) JOIN q USING (term), tot GROUP BY 1, 2), bm AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM sc) "
_SECOND = ", bi AS (SELECT item_id, doc_id, shared AS score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, doc_id) AS INTEGER) AS rank FROM sc) "


def _index(s, d):
    """The texts' inverted index, written once for all rankings of a query."""
    path = new_path(s, "text-index")
    text_index.write(table(s, d, "documents"), path, id_col="doc_id", text_col="text")
    return text_index.read(s, path)


def _bm25(s, d, index, **options):
    return text_index.search(_questions(s, d), index, query_key="item_id", query_text="q", key="doc_id", **options).select("item_id", "doc_id", "score", "rank")


@query(_BM + "SELECT * FROM bm WHERE rank <= 10")
def bm25_by_texts(s, d):
    """The same ranking without an index, by going through the texts."""
    docs = table(s, d, "documents").filter("text is not null")
    return retrieval.bm25(docs, _questions(s, d), id_col="doc_id", text_col="text", query_key="item_id", query_text="q").select("item_id", "doc_id", "score", "rank")


@query("SELECT term, count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS term FROM documents) WHERE term <> '' GROUP BY 1, 2) GROUP BY term")
def index_terms(s, d):
    """Each term of the index with its documents and occurrences."""
    return _index(s, d).filter("term <> ''").groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("words").alias("words"))


@query(_BM + "SELECT * FROM bm WHERE rank <= 10")
def bm25_topk(s, d):
    return _bm25(s, d, _index(s, d))


@query(_BM + _SECOND + ", f AS (SELECT item_id, doc_id, rank FROM bm WHERE rank <= 20 UNION ALL SELECT item_id, doc_id, rank FROM bi WHERE rank <= 20), x AS (SELECT item_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM f GROUP BY 1, 2), y AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM x) SELECT * FROM y WHERE rank <= 10")
def rank_fusion(s, d):
    """BM25 fused with the ranking by shared rare terms, however often they stand in a document."""
    index = _index(s, d)
    return retrieval.fused([_bm25(s, d, index, k=20).select("item_id", "doc_id", "rank"), _bm25(s, d, index, k=20, k1=0.0).select("item_id", "doc_id", "rank")], query_key="item_id", key="doc_id")


@query(_BM + _SECOND + ", u AS (SELECT item_id, doc_id, max(score) AS score FROM (SELECT item_id, doc_id, score FROM bm WHERE rank <= 10 UNION ALL SELECT item_id, doc_id, score FROM bi WHERE rank <= 10) GROUP BY 1, 2), y AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM u) SELECT * FROM y WHERE rank <= 10")
def merged_results(s, d):
    index = _index(s, d)
    return retrieval.merged([_bm25(s, d, index), _bm25(s, d, index, k1=0.0)], query_key="item_id", key="doc_id")


@query(_BM + _SECOND + ", u AS (SELECT bm.item_id, bm.doc_id, round(0.5::DOUBLE * bm.score + 0.5::DOUBLE * coalesce(bi.score, 0), 6) AS score FROM bm LEFT JOIN (SELECT * FROM bi WHERE rank <= 50) bi USING (item_id, doc_id) WHERE bm.rank <= 20), y AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM u) SELECT * FROM y WHERE rank <= 10")
def reranked_results(s, d):
    index = _index(s, d)
    return retrieval.reranked(_bm25(s, d, index, k=20), _bm25(s, d, index, k=50, k1=0.0), query_key="item_id", key="doc_id")


@query("SELECT doc_id, round(n_chars * pow(0.5::DOUBLE, greatest(0.0::DOUBLE, CAST(date_diff('day', CAST(DATE '2020-01-01' + CAST(doc_id % 1000 AS INTEGER) AS DATE), DATE '2022-01-01') AS DOUBLE)) / 90), 4) AS score FROM documents")
def recency_scores(s, d):
    t = transcripts(s, d).select(F.col("video_id").alias("doc_id"), "publish_date", F.col("length_seconds").cast("double").alias("score"))
    return retrieval.recency(t, time="publish_date", now="2022-01-01", half_life_days=90).select("doc_id", F.round("score", 4).alias("score"))


@query("SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '\\b(?:relat\\w*|connect\\w*|between|link\\w*)\\b') THEN 'graph' WHEN regexp_matches(lower(text), '\\b(?:when|latest|recent\\w*|before|after|since|first|last)\\b') THEN 'temporal' ELSE 'text' END AS route FROM conversations")
def query_routing(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", retrieval.route(F.col("text")).alias("route"))


# --- knowledge graphs ---


@query(KG + "SELECT count(*) AS triples, count(DISTINCT subject) AS subjects, count(DISTINCT object) AS objects, count(DISTINCT predicate) AS predicates, (SELECT count(*) FROM (SELECT subject FROM kg UNION SELECT object FROM kg)) AS entities FROM kg")
def kg_stats(s, d):
    return graph.statistics(kg(s, d))


@query(KG + "SELECT predicate, n FROM (SELECT predicate, count(*) AS n, min(pos) AS f FROM kg GROUP BY 1 ORDER BY n DESC, f LIMIT 10)")
def top_predicates(s, d):
    return graph.top_predicates(kg(s, d))


@query(KG + "SELECT min(pos) AS pos, subject, predicate, object FROM kg GROUP BY ALL")
def triple_dedup(s, d):
    return triples.first_occurrences(kg(s, d))


@query(KG + "SELECT subject, object, arg_max(predicate, pos) AS predicate FROM (SELECT * FROM kg UNION ALL SELECT pos + 5000000000, subject, 'near', object FROM kg WHERE pos % 7 = 0) GROUP BY 1, 2")
def edge_collapse(s, d):
    t = kg(s, d)
    return triples.last_edges(t.union(t.filter("pos % 7 = 0").select(F.col("pos") + 5_000_000_000, "subject", F.lit("near"), "object")))


@query(KG + ", n AS (SELECT 'supplier ' || l_suppkey AS s, 'part ' || l_partkey AS o, l_orderkey * 10 + l_linenumber AS pos, (1 + l_linenumber) / 10.0::DOUBLE AS c, l_orderkey % 100 AS src FROM lineitem), k AS (SELECT left(sha256(s || '|supplies|' || o), 16) AS key, * FROM n), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY pos DESC) AS i FROM k) SELECT key, count(*) AS frequency, round(count(*) / sum(1 / c), 6) AS confidence, arg_max(s, (c, pos)) AS subject, string_agg(CAST(src AS VARCHAR), ',' ORDER BY pos) FILTER (i <= 10) AS sources FROM r GROUP BY key")
def canonical_merge(s, d):
    x = table(s, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.concat(F.lit("supplier "), F.col("l_suppkey").cast("string")).alias("subject"), F.lit("supplies").alias("predicate"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("object"), ((1 + F.col("l_linenumber")) / F.lit(10.0)).alias("confidence"), (F.col("l_orderkey") % 100).cast("string").alias("source"))
    return triples.merged(x, keep("merged")).select("key", "frequency", "confidence", "subject", "sources")


def _by_stem(texts):
    """A vector for each text without its last digit, so ten forms have one vector; those of others are unrelated."""
    seed = lambda t: int.from_bytes(hashlib.md5(re.sub(r"[0-9]$", "", t).encode(), usedforsecurity=False).digest()[:8], "little")
    return np.stack([np.random.default_rng(seed(t)).normal(size=64) for t in texts]) if texts else np.zeros((0, 64))


@query("WITH n AS (SELECT 'supplier ' || l_suppkey AS s, 'part ' || l_partkey AS o, l_orderkey * 10 + l_linenumber AS pos, (1 + l_linenumber) / 10.0::DOUBLE AS c, l_orderkey % 100 AS src FROM lineitem), k AS (SELECT *, regexp_replace(s || ' supplies ' || o, '[0-9]$', '') AS stem, left(sha256(s || '|supplies|' || o), 16) AS form FROM n), r AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY pos DESC) AS i FROM k) SELECT arg_min(form, pos) AS key, count(*) AS frequency, round(count(*) / sum(1 / c) + 1e-9, 4) AS confidence, arg_max(o, (c, pos)) AS object, string_agg(CAST(src AS VARCHAR), ',' ORDER BY pos) FILTER (i <= 10) AS sources FROM r GROUP BY stem")
def incremental_merge(s, d):
    """The line items' triples, merged in two batches against a stored signature index."""
    x = table(s, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.concat(F.lit("supplier "), F.col("l_suppkey").cast("string")).alias("subject"), F.lit("supplies").alias("predicate"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("object"), ((1 + F.col("l_linenumber")) / F.lit(10.0)).alias("confidence"), (F.col("l_orderkey") % 100).cast("string").alias("source"))
    middle = x.agg(F.max("pos")).first()[0] // 2
    index = TripleIndex(s, new_path(s, "triples"), _by_stem, keep("triple-index"), buckets=16)
    index.merge(x.filter(F.col("pos") <= middle), 0)
    index.merge(x.filter(F.col("pos") > middle), 1)
    return index.read(digits=12).select("key", "frequency", F.round(F.col("confidence") + 1e-9, 4).alias("confidence"), "object", "sources")


@query(DEG + "SELECT * FROM deg")
def node_degrees(s, d):
    return graph.degrees(kg(s, d))


@query(DEG + "SELECT count(*) AS nodes, CAST(sum(degree) / 2 AS BIGINT) AS edges, round(CAST(sum(degree) / 2 AS BIGINT) / (count(*) * (count(*) - 1))::DOUBLE, 9) AS density, round(2 * CAST(sum(degree) / 2 AS BIGINT) / count(*)::DOUBLE, 6) AS average_degree FROM deg")
def graph_metrics(s, d):
    return graph.metrics(kg(s, d))


@query(DEG + "SELECT node, degree, round(degree / ((SELECT count(*) FROM deg) - 1)::DOUBLE, 9) AS centrality FROM deg ORDER BY degree DESC, node LIMIT 20")
def degree_centrality(s, d):
    return graph.centrality(kg(s, d))


@query(DEG + "SELECT node, CASE WHEN in_degree > 0 AND out_degree > 0 THEN 'both' WHEN out_degree > 0 THEN 'subject' ELSE 'object' END AS role FROM deg")
def node_roles(s, d):
    return graph.roles(kg(s, d))


_COL = "CASE WHEN contains(lower(node), 'research') OR contains(lower(node), 'study') OR contains(lower(node), 'paper') THEN '#3b82f6' WHEN contains(lower(node), 'person') OR contains(lower(node), 'author') THEN '#ef4444' WHEN contains(lower(node), 'technology') OR contains(lower(node), 'ai') OR contains(lower(node), 'machine learning') THEN '#10b981' WHEN contains(lower(node), 'health') OR contains(lower(node), 'longevity') OR contains(lower(node), 'biohacking') THEN '#f59e0b' WHEN contains(lower(node), 'company') OR contains(lower(node), 'organization') THEN '#8b5cf6' ELSE '#6b7280' END"


@query(DEG + f"SELECT node, greatest(5, least(25, degree * 3)) AS size, {_COL} AS colour FROM deg")
def view_nodes(s, d):
    return graph.view_nodes(kg(s, d))


@query(DEG + f"SELECT {_COL} AS colour, count(*) AS n FROM deg GROUP BY 1")
def node_type_histogram(s, d):
    return graph.colour_histogram(kg(s, d))


@query(DEG + "SELECT node FROM deg WHERE contains(lower(node), 'r#12')")
def node_search(s, d):
    return graph.search_nodes(graph.nodes_of(kg(s, d)).select("node"), "R#12")


@query(KG + "SELECT subject AS node, 'INFERRED' AS type FROM kg WHERE subject NOT LIKE 'nation%' UNION SELECT object, CASE WHEN object LIKE 'nation%' THEN 'PLACE' ELSE 'INFERRED' END FROM kg UNION SELECT subject, 'PLACE' FROM kg WHERE subject LIKE 'nation%'")
def graph_nodes(s, d):
    t = kg(s, d)
    return graph.nodes_of(t, table(s, d, "nation").select(F.concat(F.lit("nation#"), F.col("n_nationkey").cast("string")).alias("node"), F.lit("PLACE").alias("type")))


@query(KG + "SELECT 'edge-' || pos AS key, subject AS source, object AS target, CASE WHEN pos % 3 = 0 THEN 'label' WHEN pos % 3 = 1 THEN predicate ELSE 'related_to' END AS label FROM kg WHERE object NOT LIKE 'part%'")
def edge_cleaning(s, d):
    t = kg(s, d)
    nodes = graph.nodes_of(t).filter("node not like 'part%'")
    e = t.select("pos", F.col("subject").alias("source"), F.col("object").alias("target"), F.when(F.col("pos") % 3 == 0, "label").alias("label"), F.when(F.col("pos") % 3 == 1, F.col("predicate")).otherwise("").alias("predicate"))
    return graph.clean_edges(e, nodes)


def _component_sql(rounds: int = 16) -> str:
    """Smallest labels passed on for as many rounds as the star schema's graph is wide."""
    out = KG + ", e AS MATERIALIZED (SELECT subject AS a, object AS b FROM kg UNION SELECT object, subject FROM kg), c0 AS MATERIALIZED (SELECT DISTINCT a AS node, a AS component FROM e)"
    for i in range(rounds):
        out += f", c{i + 1} AS MATERIALIZED (SELECT c.node, least(c.component, min(n.component)) AS component FROM c{i} c JOIN e ON e.a = c.node JOIN c{i} n ON n.node = e.b GROUP BY c.node, c.component)"
    return out + f" SELECT * FROM c{rounds}"


@query(_component_sql())
def weak_components(s, d):
    return graph.connected_components(kg(s, d).select(F.col("subject").alias("src"), F.col("object").alias("dst")), keep("components"))


def _rank_sql(rounds: int, last: str = "SELECT node, round(rank, 9) AS rank FROM p{0}") -> str:
    out = KG + ", e AS MATERIALIZED (SELECT DISTINCT subject AS a, object AS b FROM kg), o AS MATERIALIZED (SELECT a, count(*) AS k FROM e GROUP BY a), v AS MATERIALIZED (SELECT a AS node FROM e UNION SELECT b FROM e), n AS (SELECT count(*)::DOUBLE AS n FROM v), p0 AS (SELECT node, 1 / n AS rank FROM v, n)"
    for i in range(rounds):
        out += f", p{i + 1} AS MATERIALIZED (SELECT v.node, 0.15::DOUBLE / n.n + 0.85::DOUBLE * (coalesce(g.x, 0) + (SELECT coalesce(sum(rank), 0) FROM p{i} WHERE node NOT IN (SELECT a FROM o)) / n.n) AS rank FROM n, v LEFT JOIN (SELECT e.b AS node, sum(p.rank / o.k) AS x FROM e JOIN o ON o.a = e.a JOIN p{i} p ON p.node = e.a GROUP BY 1) g ON g.node = v.node)"
    return f"{out} {last.format(rounds)}"


@query(_rank_sql(10))
def page_rank(s, d):
    return graph.page_rank(kg(s, d), keep("rank"), rounds=10, tolerance=0)


@query(_rank_sql(10, ", best AS (SELECT node FROM p{0} ORDER BY round(rank, 9) DESC, node LIMIT 100) SELECT pos, subject, predicate, object FROM kg WHERE subject IN (SELECT node FROM best) AND object IN (SELECT node FROM best)").replace(" , best", ", best"))
def top_subgraph(s, d):
    t = kg(s, d)
    return graph.top_subgraph(t, graph.page_rank(t, keep("rank"), rounds=10, tolerance=0))


@query()
def communities(s, d):
    return graph.communities(kg(s, d), keep("communities"))


@query()
def louvain_communities(s, d):
    """Communities by modularity; tests hold it against label propagation and planted blocks."""
    return graph.louvain(kg(s, d), keep("louvain"))


@query(KG + ", e AS (SELECT DISTINCT least(subject, object) AS a, greatest(subject, object) AS b FROM kg WHERE subject <> object), l AS (SELECT split_part(a, '#', 1) || length(a) AS x, split_part(b, '#', 1) || length(b) AS y FROM e), m AS (SELECT count(*)::DOUBLE AS m FROM l), i AS (SELECT x AS c, count(*) AS n FROM l WHERE x = y GROUP BY 1), g AS (SELECT c, count(*) AS k FROM (SELECT x AS c FROM l UNION ALL SELECT y FROM l) GROUP BY 1) SELECT round(sum(coalesce(i.n, 0) / m - pow(k / (2 * m), 2)), 9) AS modularity FROM g LEFT JOIN i USING (c), m")
def partition_modularity(s, d):
    t = kg(s, d)
    return graph.modularity(t, graph.nodes_of(t).select("node", F.concat(F.split("node", "#")[0], F.length("node").cast("string")).alias("community")))


@query(KG + ", l AS (SELECT 'c' || c_custkey AS node, c_custkey AS p FROM customer), r AS (SELECT node, row_number() OVER (ORDER BY p, node) AS i FROM l) SELECT node FROM r WHERE i > (SELECT count(*) // 3 FROM l) UNION SELECT subject FROM kg UNION SELECT object FROM kg")
def isolated_pruning(s, d):
    t = kg(s, d)
    nodes = graph.nodes_of(t).select("node", F.lit(0).cast("long").alias("p")).union(table(s, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")), "c_custkey"))
    return graph.pruned(nodes, t, keep("pruned"), "p").select("node")


@query(KG + "SELECT subject, object FROM kg WHERE predicate = 'in' UNION ALL SELECT subject, object FROM kg WHERE predicate = 'located in'")
def union_all(s, d):
    t = kg(s, d)
    return t.filter("predicate = 'in'").select("subject", "object").unionByName(t.filter("predicate = 'located in'").select("subject", "object"))


@query("SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def set_difference(s, d):
    return table(s, d, "part").select("p_partkey").exceptAll(table(s, d, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")).distinct())


@query("SELECT l_orderkey * 10 + l_linenumber AS pos, 'supplier ' || l_suppkey AS subject, lower(replace(CASE WHEN l_linenumber % 2 = 0 THEN 'WORKS_AT' ELSE 'Supplies' END, '_', ' ')) AS predicate, 'part ' || l_partkey AS object FROM lineitem")
def relationship_triples(s, d):
    x = table(s, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.concat(F.lit("supplier "), F.col("l_suppkey").cast("string")).alias("source"), F.when(F.col("l_linenumber") % 2 == 0, "WORKS_AT").otherwise("Supplies").alias("type"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("target"), F.col("l_orderkey").alias("chunk_id"))
    return triples.from_relationships(x, provenance=["chunk_id"]).select("pos", "subject", "predicate", "object")


@query(f"SELECT doc_id, CASE WHEN {TOKENS.format('text')} <= 400 THEN 'primary' WHEN {TOKENS.format('text')} <= 800 THEN 'fallback' ELSE 'skipped' END AS route FROM documents")
def chunk_routing(s, d):
    return table(s, d, "documents").select("doc_id", triples.routed(tk.token_count(F.col("text")), 400, 800).alias("route"))


_SUPPLIED = "SELECT l_orderkey * 10 + l_linenumber AS i, k AS triple_no, CASE k WHEN 0 THEN 's' || l_suppkey ELSE 'p' || l_partkey END AS subject, CASE k WHEN 0 THEN 'supplies' ELSE 'is in' END AS predicate, CASE k WHEN 0 THEN 'p' || l_partkey ELSE 'o' || l_orderkey END AS object FROM lineitem, (SELECT CAST(range AS INTEGER) AS k FROM range(2)) r"


def _replies(s, d, form: str) -> DataFrame:
    """A reply for each line item, with two triples in a form that a model answers in."""
    x = table(s, d, "lineitem")
    part = F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    ends = [F.concat(F.lit("s"), F.col("l_suppkey").cast("string")), part, part, F.concat(F.lit("o"), F.col("l_orderkey").cast("string"))]
    return x.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("i"), F.format_string(form, *ends).alias("t"))


@query(_SUPPLIED)
def quoted_triples(s, d):
    return triples.parse_quoted(_replies(s, d, 'so ("%s", "supplies", "%s"), ("%s","is in","%s") and ("a", "b")'), "t").select("i", "triple_no", "subject", "predicate", "object")


@query(_SUPPLIED)
def split_triples(s, d):
    return triples.parse_split(_replies(s, d, "(%s, supplies, '%s'), (%s, is in, %s)"), "t").select("i", "triple_no", "subject", "predicate", "object")


@query(_SUPPLIED)
def loose_triples(s, d):
    return triples.parse_loose(_replies(s, d, "((%s, 'supplies', %s), (%s, is in, %s), (Bob Lee, likes, tea), (p, one two three four, q))"), "t").select("i", "triple_no", "subject", "predicate", "object")


@query(KG + "SELECT pos, subject, predicate, object FROM kg WHERE length(subject) BETWEEN 2 AND 10 AND length(object) BETWEEN 2 AND 10 AND lower(predicate) NOT IN ('mentions', 'says', 'talks about')")
def triple_quality_filter(s, d):
    return triples.quality_filter(kg(s, d), 2, 10)


@query("WITH s AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, 'p' || l_partkey) AS p, 'p' || l_partkey AS label FROM lineitem) SELECT a.l_orderkey, a.label AS subject, 'co_occurs_with' AS predicate, b.label AS object FROM s a JOIN s b ON a.l_orderkey = b.l_orderkey AND a.p < b.p AND a.label <> b.label")
def cooccurrence(s, d):
    x = table(s, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("position"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("label"))
    return triples.cooccurrences(x, ["l_orderkey"])


@query(KG + ", x AS (SELECT *, row_number() OVER (PARTITION BY lower(subject), lower(predicate), lower(object) ORDER BY pos) - 1 AS b FROM kg) SELECT pos, round((1.0::DOUBLE + 0.5 + 1.0 + (1 - least(1.0::DOUBLE, b / 5.0::DOUBLE)) + CASE WHEN lower(subject) <> lower(object) THEN 0.5 ELSE 0 END) / 5, 6) AS score FROM x")
def relation_quality(s, d):
    return triples.relation_scores(kg(s, d), keep("relations")).select("pos", "score")


@query(KG + ", x AS (SELECT pos, subject AS entity, row_number() OVER (PARTITION BY subject ORDER BY pos) - 1 AS b FROM kg) SELECT pos, round((1.0::DOUBLE + 1.0 + 0.5 + 1.0 + (1 - least(1.0::DOUBLE, b / 10.0::DOUBLE))) / 5, 6) AS score FROM x")
def entity_quality(s, d):
    return triples.entity_scores(kg(s, d).select("pos", F.col("subject").alias("entity")), keep("entities"), order=["pos"]).select("pos", "score")


@query(KG + ", r AS (SELECT pos, subject, predicate, object, 0 AS origin FROM kg WHERE predicate IN ('in', 'lives in') UNION ALL SELECT pos, subject, predicate, object, 1 FROM kg WHERE pos % 10 / 10.0 > 0.7) SELECT min(origin) AS origin, subject, predicate, object FROM r GROUP BY ALL", name="merged_extractions")
def merged_extractions(s, d):
    t = kg(s, d)
    return triples.merged_extractions(t.filter("predicate in ('in', 'lives in')"), t.withColumn("confidence", F.col("pos") % 10 / 10)).select("origin", "subject", "predicate", "object")


_STEM = "regexp_replace(lower({0}), '[0-9]$', '')"


_ALIKE = KG + f"SELECT min(pos) AS pos, arg_min(subject, (pos, lower(subject), lower(predicate), lower(object))) AS subject, arg_min(predicate, (pos, lower(subject), lower(predicate), lower(object))) AS predicate, arg_min(object, (pos, lower(subject), lower(predicate), lower(object))) AS object FROM kg GROUP BY {_STEM.format('subject')}, lower(predicate), {_STEM.format('object')}"


@query(_ALIKE)
def near_duplicate_relations(s, d, recall=None):
    """Terms have the vector of their name without its last digit, so ten of them are alike and others are not.

    A component is a 64-bit hash of stem and place. CRC-32 is linear: names of equal length differ by one pattern at all places, and a few in 100,000 then are alike.
    """
    t = kg(s, d)
    stem = F.regexp_replace("term", "[0-9]$", "")
    terms = graph.nodes_of(t).select(F.lower("node").alias("term")).union(t.select(F.lower("predicate"))).distinct()
    vectors = terms.select("term", F.transform(F.sequence(F.lit(0), F.lit(127)), lambda i: (F.pmod(F.xxhash64(stem, i), F.lit(1001)) - 500).cast("double")).alias("vector"))
    return triples.near_duplicates_dropped(t, vectors, keep("near-duplicates"), recall=recall)


@query(_ALIKE)
def banded_relations(s, d):
    """The same by bands of random planes: terms that are alike here have one vector, so every pair shares its buckets."""
    return near_duplicate_relations(s, d, recall=0.95)


@query()
def capitalized_entities(s, d):
    return table(s, d, "documents").select("doc_id", F.explode(triples.capitalized_spans(F.col("text"))).alias("entity"))


@query("WITH w AS (SELECT CAST(item_id AS VARCHAR) AS id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM benchmark) SELECT id, CAST(i AS INTEGER) AS triple_no, w[i + 1] AS subject, 'precedes' AS predicate, w[i + 2] AS object FROM (SELECT id, w, unnest(range(len(w) - 1)) AS i FROM w)")
def extracted_triples(s, d):
    return triples.extract(table(s, d, "benchmark"), lambda t: [(a, "precedes", b) for w in [t.split()] for a, b in zip(w, w[1:], strict=False)], id_col="item_id")


@query("WITH w AS (SELECT CAST(item_id AS VARCHAR) AS id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM benchmark) SELECT id, CAST(i AS INTEGER) AS triple_no, w[i + 1] AS subject, 'precedes' AS predicate, w[i + 2] AS object FROM (SELECT id, w, unnest(range(len(w) - 1)) AS i FROM w)")
def batched_extraction(s, d):
    return triples.extract_batched(table(s, d, "benchmark"), lambda ts: [[(a, "precedes", b) for a, b in zip(t.split(), t.split()[1:], strict=False)] for t in ts], id_col="item_id")


@query()
def parsed_relations(s, d):
    return triples.parsed_relations(table(s, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text"), triples.simple_patterns(), id_col="id", text_col="text")


_OUTCOMES = ("content", "null_content", "error", "missing_response", "body_error", "bad_choices", "bad_json", "content")


@query("SELECT CASE WHEN event_id % 8 = 6 THEN 'unknown' ELSE 'e' || event_id END AS custom_id, ['" + "', '".join(_OUTCOMES) + "'][CAST(event_id % 8 AS INTEGER) + 1] AS outcome, CASE event_id % 8 WHEN 0 THEN 'hi ' || event_id WHEN 7 THEN '' END AS content FROM events")
def batch_result_classes(s, d):
    """A result line of each outcome for the events in turn."""
    i = F.col("event_id")
    body = lambda b: f'{{"custom_id": "e%d", "response": {{"body": {b}}}}}'
    forms = [body('{"choices": [{"message": {"content": "hi %d"}}]}'), body('{"choices": [{"message": {"content": null}}]}'), '{"custom_id": "e%d", "error": {"message": "no"}}', '{"custom_id": "e%d"}', body('{"error": {"message": "x"}}'), body('{"choices": []}'), "{broken", body('{"choices": [{"message": {"content": ""}}]}')]
    line = F.lit(None).cast("string")
    for k, form in enumerate(forms):
        line = F.when(i % 8 == k, F.format_string(form, *[i] * form.count("%d"))).otherwise(line)
    return triples.batch_results(table(s, d, "events").select(line.alias("value")))


@query("SELECT event_id AS i, event_id % 3 = 0 AS valid FROM events")
def response_validation(s, d):
    i = F.col("event_id")
    j = F.when(i % 3 == 0, F.format_string('{"entities": %d, "relations": 2, "types": 3, "summary": 4}', i)).when(i % 3 == 1, F.format_string('{"entities": %d}', i)).otherwise(F.lit("no json"))
    return triples.valid_responses(table(s, d, "events").select(i.alias("i"), j.alias("j")), "j", ["entities", "relations", "types", "summary"]).select("i", "valid")


@query(KG + ", x AS (SELECT CASE WHEN predicate = 'supplies' THEN CAST(pos % 5 AS INTEGER) ELSE 0 END AS channel, * FROM kg) SELECT channel, subject, predicate, object, count(*) AS frequency, min(pos) AS first_pos FROM x GROUP BY ALL")
def channel_graphs(s, d):
    return triples.merged_by(kg(s, d).withColumn("channel", F.when(F.col("predicate") == "supplies", (F.col("pos") % 5).cast("int")).otherwise(0)), "channel")


@query(KG + "SELECT count(DISTINCT pos % 97) AS chunks, count(*) AS triples, count(DISTINCT (subject, object)) AS entity_pairs FROM kg")
def extraction_stats(s, d):
    return triples.extraction_stats(kg(s, d).withColumn("chunk", F.col("pos") % 97), "chunk")


@query("SELECT l_orderkey * 10 + l_linenumber AS pos, 'a ' || l_suppkey AS subject, 'sells to' AS predicate, 'b ' || l_partkey AS object FROM lineitem WHERE l_linenumber > 1")
def cleaned_triples(s, d):
    x = table(s, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.concat(F.lit("  a   "), F.col("l_suppkey").cast("string")).alias("subject"), F.when(F.col("l_linenumber") > 1, "sells \n to").otherwise("  ").alias("predicate"), F.concat(F.lit("b  "), F.col("l_partkey").cast("string"), F.lit(" ")).alias("object"))
    return triples.cleaned(x).select("pos", "subject", "predicate", "object")


@query("SELECT CAST(i AS VARCHAR) AS video_id, 'video ' || i AS title FROM range(120) r(i)")
def paged_scan(s, d):
    from corvane.sources.paged import PagedSource

    s.dataSource.register(PagedSource)
    raw = s.read.format("paged").option("pages", 5).option("size", 50).option("total", 120).load()
    return normalize.normalized(normalize.parsed(raw, "json")).select("video_id", "title")


@query("SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 2 = 0 THEN '{\"id\": ' || doc_id || '}' END AS json FROM documents")
def batched_lookup(s, d):
    from corvane.sources.paged import looked_up

    return looked_up(table(s, d, "documents").select(F.col("doc_id").alias("id")), lambda ids: {i: f'{{"id": {i}}}' for i in ids if int(i) % 2 == 0})


@query("SELECT source, count(*) AS n FROM documents WHERE text <> '' GROUP BY source")
def streaming_ingest(s, d):
    """All documents through a stream into the shared folder, then counted from there."""
    base = new_path(s, "stream")
    stream = streaming.stream_table(s, f"{d}/documents.parquet*", table(s, d, "documents").schema)
    streaming.ingest_stream(stream, lambda b: b.select("doc_id", "source", F.length("text").alias("n")), f"{base}/out", f"{base}/checkpoint", valid="text <> ''").awaitTermination()
    return s.read.parquet(f"{base}/out").groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY user_id")
def streaming_upsert(s, d):
    """The last event of each user, kept by a sink that rewrites the buckets of each batch."""
    base = new_path(s, "upsert")
    e = table(s, d, "events").select("user_id", F.struct("ts", "event_id").alias("at"), F.col("event_type").alias("status"))
    e.repartition(3).write.parquet(f"{base}/in")
    stream = streaming.stream_table(s, f"{base}/in", e.schema, files=1)
    kept = BucketTable(s, f"{base}/table", ["user_id"], e.schema, buckets=16)
    stream.writeStream.foreachBatch(streaming.bucket_sink(kept, "at")).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return kept.read().select("user_id", "status")


@query("WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS first FROM events), g AS (SELECT user_id, ts, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS period FROM e) SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n FROM g GROUP BY user_id, period HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def streaming_idle_periods(s, d):
    """Users' periods of activity by session windows: four starts of one query, the second with a late copy of early events, the last with nothing new."""
    base = new_path(s, "periods")
    e = table(s, d, "events").select("user_id", "ts")
    low, high = e.agg(F.min("ts"), F.max("ts")).first()
    cuts = [low + (high - low) * k / 3 for k in (1, 2)]
    parts = [e.filter(F.col("ts") < cuts[0]), e.filter((F.col("ts") >= cuts[0]) & (F.col("ts") < cuts[1])).union(e.filter(F.col("ts") < low + (high - low) / 6)), e.filter(F.col("ts") >= cuts[1]), None]
    before = {k: s.conf.get(k, None) for k in keyed_state.STORE}
    try:
        for k, v in keyed_state.STORE.items():
            s.conf.set(k, v)
        for part in parts:
            if part is not None:
                part.write.mode("append").parquet(f"{base}/in")
            found = keyed_state.sessions(streaming.stream_table(s, f"{base}/in", e.schema, files=1000), key="user_id", time="ts", idle_seconds=6 * 3600, late="1 hour")
            found.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            s.conf.unset(k) if v is None else s.conf.set(k, v)
    zone = lambda c: F.col(c).cast("timestamp_ntz")
    return s.read.parquet(f"{base}/out").select(F.col("key").cast("long").alias("user_id"), zone("start").alias("start"), zone("last").alias("last"), "n")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def streaming_counts(s, d):
    """Running counts of a stream, as they stand at its end."""
    base = new_path(s, "counts")
    stream = streaming.stream_table(s, f"{d}/events.parquet*", table(s, d, "events").schema)
    sink = lambda b, n: b.write.mode("overwrite").parquet(f"{base}/out")
    streaming.running_counts(stream, "event_type").writeStream.outputMode("complete").foreachBatch(sink).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(f"{base}/out")


@query("SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2 HAVING time_bucket(INTERVAL 5 MINUTE, ts) + INTERVAL 5 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE")
def streaming_windows(s, d):
    """The windows of a stream that its watermark has closed when it ends."""
    base = new_path(s, "windows")
    stream = streaming.stream_table(s, f"{d}/events.parquet*", table(s, d, "events").schema)
    windowed(stream).writeStream.outputMode("append").format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(f"{base}/out").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


_STATES = "CASE WHEN event_id % 4 = 0 THEN 'pending' WHEN event_id % 4 = 1 THEN 'processing' WHEN event_id % 4 = 2 THEN 'completed' ELSE 'failed' END"


@query(f"WITH t AS (SELECT user_id, ts, lag({_STATES}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a, {_STATES} AS b FROM events) SELECT user_id, ts, a AS \"from\", b AS \"to\" FROM t WHERE NOT coalesce(CASE WHEN a IS NULL THEN b = 'pending' WHEN a = 'pending' THEN b IN ('processing', 'failed') WHEN a = 'processing' THEN b IN ('completed', 'failed') WHEN a = 'failed' THEN b = 'pending' ELSE false END, false)")
def wrong_task_transitions(s, d):
    e = table(s, d, "events").withColumn("status", F.expr(_STATES))
    return streaming.wrong_transitions(e, key="user_id", time="ts", status="status", tie="event_id")


# --- sources and sinks, round trips through the shared folder ---


def _folder(s, name):
    return new_path(s, name)


@query(KG + "SELECT subject, predicate, object, count(*) AS n FROM kg GROUP BY ALL")
def triples_round_trip(s, d):
    """Triples to JSON files with a `triples` array and back."""
    path = _folder(s, "triples")
    files.write_triples(kg(s, d), path)
    return files.read_triples(s, path).groupBy("subject", "predicate", "object").agg(F.count("*").alias("n"))


@query(KG + "SELECT count(*) AS triple_count FROM kg")
def dataset_metadata(s, d):
    """What is known of graph files: their triples, while sizes and times must be there."""
    path = _folder(s, "datasets")
    files.write_triples(kg(s, d), path)
    found = files.read_dataset(s, path).filter("size > 0 and modified is not null").join(files.datasets(s, path).filter("length > 0").select(F.col("path").alias("file")), "file", "left_semi")
    return found.agg(F.sum("triple_count").cast("long").alias("triple_count"))


@query("SELECT conv_id, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS characters FROM conversations GROUP BY conv_id")
def raw_sink(s, d):
    """Raw records in a folder for each id, written twice: the second replaces the first."""
    path = _folder(s, "raw")
    x = table(s, d, "conversations").select("conv_id", "turn", "text")
    for _ in range(2):
        files.write_raw(x, path, "overwrite", key="conv_id")
    return s.read.schema("turn long, text string, conv_id long").json(path).groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("characters"))


@query("WITH p AS (SELECT page_id, 'word ' || page_id || chr(10) || url AS text FROM pages) SELECT CAST(page_id AS VARCHAR) AS page_id, CAST(greatest(1, length(text) // 4) AS BIGINT) AS tokens FROM p UNION ALL SELECT NULL, CAST(sum(greatest(1, length(text) // 4)) AS BIGINT) FROM p")
def text_files_and_totals(s, d):
    """Text files with a header, read again without it, and their tokens by file and in all."""
    path = _folder(s, "texts")
    p = table(s, d, "pages").select("page_id", F.concat(F.lit("word "), F.col("page_id").cast("string"), F.lit("\n"), F.col("url")).alias("text"))
    files.write_texts(p.withColumn("__page", F.col("page_id")), path, headers={"page": "__page"}, text="text", key="page_id")
    with listing_tasks(s):
        found = s.read.text(path, wholetext=True, pathGlobFilter="*.txt", recursiveFileLookup=True)
    texts = found.select(F.regexp_extract(F.col("_metadata.file_path"), "page_id=([0-9]+)", 1).alias("file"), F.rtrim(F.regexp_replace("value", files.COMMENT, ""), F.lit("\n")).alias("text"))
    # in as many tasks as wrote them: each file counts as 4 MB to Spark, so by itself it would start a task for every few
    texts = texts.coalesce(int(s.conf.get("spark.sql.shuffle.partitions")))
    return files.token_totals(texts).withColumnRenamed("file", "page_id")


@query(KG + "SELECT 'graphml' AS kind, (SELECT count(*) FROM (SELECT subject FROM kg UNION SELECT object FROM kg)) AS nodes, (SELECT count(*) FROM kg) AS edges, 2 AS frame UNION ALL SELECT 'gexf', (SELECT count(*) FROM (SELECT subject FROM kg UNION SELECT object FROM kg)), (SELECT count(*) FROM kg), 3")
def graph_documents(s, d):
    """Elements and frame of whole GraphML and GEXF documents."""
    t, out = kg(s, d), None
    nodes = graph.nodes_of(t)
    for kind in ("graphml", "gexf"):
        path = _folder(s, kind)
        files.write_graph_document(t, nodes, path, kind)
        x = s.read.text(path)
        count = lambda c: F.count(F.when(c, 1))
        node, edge = F.startswith("value", F.lit("<node ")), F.startswith("value", F.lit("<edge "))
        row = x.agg(F.lit(kind).alias("kind"), count(node).alias("nodes"), count(edge).alias("edges"), count(~node & ~edge).cast("int").alias("frame"))
        out = row if out is None else out.union(row)
    return out


@query(DEG + "SELECT 'nodes: ' || count(*) AS line FROM deg UNION ALL SELECT 'edges: ' || CAST(sum(degree) / 2 AS BIGINT) FROM deg")
def graph_analysis_text(s, d):
    path = _folder(s, "analysis")
    files.write_analysis(graph.metrics(kg(s, d)).select("nodes", "edges"), path)
    return s.read.text(path).withColumnRenamed("value", "line")


@query("SELECT vec_id, label, len(embedding) AS dim FROM embeddings")
def store_persist_load(s, d):
    path = _folder(s, "store")
    files.save_store(table(s, d, "embeddings"), path)
    return files.load_store(s, path).select("vec_id", "label", F.size("embedding").cast("long").alias("dim"))


@query("SELECT doc_id, true AS same FROM documents")
def token_round_trip(s, d):
    """Texts through a byte-level tokenizer and back."""
    import public_tokenizers

    encode, decode = tk.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    return table(s, d, "documents").select("doc_id", F.coalesce(decode(encode(F.col("text"))) == F.col("text"), F.lit(True)).alias("same"))


@query("SELECT name, valid FROM (VALUES ('listed_documents', false), ('listed_transcripts', true)) v(name, valid)")
def list_sources(s, d):
    transcripts(s, d).select("*", F.lit("").alias("description"), F.lit("").alias("tags")).createOrReplaceTempView("listed_transcripts")
    table(s, d, "documents").createOrReplaceTempView("listed_documents")
    return files.sources(s).filter("name in ('listed_documents', 'listed_transcripts')")


@query("SELECT doc_id, lang, CAST(NULL AS VARCHAR) AS summary, CAST(NULL AS BIGINT) AS views FROM documents")
def missing_columns(s, d):
    return store.add_missing(table(s, d, "documents").select("doc_id", "lang"), {"lang": "string", "summary": "string", "views": "bigint"})


@query("SELECT * FROM (VALUES ('primary_limit', '10'), ('fallback_limit', '8000'), ('dropped', '[\"says\"]')) v(name, value)")
def yaml_settings(s, d):
    import json
    import tempfile

    from corvane.plans.config import ExtractionConfig

    with tempfile.NamedTemporaryFile("w", suffix=".yaml") as f:  # read on the driver only
        f.write("extraction:\n  primary_limit: 10\n  dropped: [says]\n")
        f.flush()
        found = ExtractionConfig.from_yaml(f.name).describe()
    return s.createDataFrame([(k, json.dumps(found[k])) for k in ("primary_limit", "fallback_limit", "dropped")], "name string, value string")


@query("SELECT * FROM (VALUES ('chunker', 'fixed'), ('chunker', 'semantic'), ('chunker', 'window'), ('embedder', 'hash')) v(kind, name)")
def registered_components(s, d):
    from corvane.plans.registry import Registry

    return s.createDataFrame([(k, n) for k, names in Registry().info().items() for n in names], "kind string, name string")


@query(T + "SELECT 'total_videos' AS name, CAST(count(*) AS BIGINT) AS value FROM t UNION ALL SELECT 'total_tokens', CAST(coalesce(sum(openai_tokens), 0) AS BIGINT) FROM t")
def query_catalog(s, d):
    found = analytics.run_catalog(transcripts(s, d), ["video_stats", "openai_tokens"])
    return found["video_stats"].select(F.lit("total_videos").alias("name"), F.col("total_videos").alias("value")).union(found["openai_tokens"].select(F.lit("total_tokens"), "total_tokens"))


def _channels(s, d):
    """Channels, list items and videos as raw records: sources are channels, documents their videos."""
    x = table(s, d, "documents").filter("source is not null")
    record = lambda df, c: normalize.parsed(df.select(F.to_json(c).alias("json")), "json")
    c = record(x.select("source").distinct(), F.struct(F.concat(F.lit("UC"), F.col("source")).alias("id"), F.struct(F.concat(F.lit("@"), F.col("source")).alias("customUrl"), F.upper("source").alias("title")).alias("snippet"), F.struct(F.struct(F.concat(F.lit("UU"), F.col("source")).alias("uploads")).alias("relatedPlaylists")).alias("contentDetails")))
    items = record(x, F.struct(F.struct(F.concat(F.lit("UU"), F.col("source")).alias("playlistId"), F.struct(F.col("doc_id").cast("string").alias("videoId")).alias("resourceId")).alias("snippet")))
    return c, items.union(items), _raw(s, d)


@query(_NORM + "SELECT video_id, title FROM n WHERE channel_id = 'src3' AND privacy_status = 'public' AND NOT is_short")
def channel_videos(s, d):
    return normalize.channel_videos(*_channels(s, d), "@src3").select("video_id", "title")


@query("SELECT DISTINCT 'UC' || source AS id, 'UU' || source AS uploads FROM documents WHERE source IS NOT NULL")
def uploads_lists(s, d):
    return normalize.uploads_playlist(_channels(s, d)[0])


@query(f"SELECT CAST(doc_id AS VARCHAR) AS video_id, CASE WHEN doc_id % 3 = 0 THEN 'N/A' ELSE 'Title ' || doc_id END AS title, CAST(CASE WHEN doc_id % 5 <> 0 THEN DATE '2020-01-01' + CAST(doc_id % 900 AS INTEGER) END AS DATE) AS publish_date, CAST(coalesce({_SECONDS}, 0) AS INTEGER) AS length_seconds FROM documents")
def legacy_metadata(s, d):
    r = _raw(s, d).withColumn("i", F.col("raw.id").cast("long"))
    snippet = F.struct(F.when(F.col("i") % 3 != 0, F.concat(F.lit("Title "), F.col("raw.id"))).alias("title"), F.when(F.col("i") % 5 != 0, F.concat(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("i") % 900).cast("int")).cast("string"), F.lit("T10:00:00Z"))).alias("publishedAt"))
    json = F.to_json(F.struct(F.col("raw.id").alias("id"), snippet.alias("snippet"), F.struct(F.col("raw.contentDetails.duration").alias("duration")).alias("contentDetails")))
    return normalize.legacy_metadata(normalize.parsed(r.select(json.alias("json")), "json"))