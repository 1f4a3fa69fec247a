"""The registered queries of the training-data operators, each over its whole table, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import centroids, cover_tree, divergence, language_id, line_quality, maxent, mixing, near_duplicates, packing, pii, token_counts, token_files, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op2_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.clean_lines(table(spark, sf_dir, "documents"), with_text=False)


def op3_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), min_bytes=0)


def op4_cover_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.top_k(table(spark, sf_dir, "embeddings"), k=5, scale=256.0, modulus=50)


def op5_maxent_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score_texts(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


def op9_length_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), buckets=16, token_budget=65_536)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"), k=40, rounds=5, dim=64, scale=256.0, seed=2)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), min_docs=10, top=10)


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii_spans": op1_pii_spans,
    "op2_line_quality": op2_line_quality,
    "op3_warc_salvage": op3_warc_salvage,
    "op4_cover_tree_top_k": op4_cover_tree_top_k,
    "op5_maxent_score": op5_maxent_score,
    "op6_token_counts": op6_token_counts,
    "op7_source_mixing": op7_source_mixing,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_length_packing": op9_length_packing,
    "op10_language_id": op10_language_id,
    "op11_centroid_clusters": op11_centroid_clusters,
    "op12_source_divergence": op12_source_divergence,
    "op13_token_files": op13_token_files,
}

WORDS = r"list_filter(string_split_regex({0}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_LINES = (
    r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, """
    + WORDS.format("text")
    + r""" AS w FROM d),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM (SELECT r, i, w[i + 1] AS a, w[i + 2] AS b, w[i + 3] AS c FROM (SELECT r, w, unnest(range(len(w) - 2)) AS i FROM w))),
rw AS (SELECT r, count(DISTINCT i + k) AS repeats FROM g, range(3) k(k) WHERE n > 1 GROUP BY r),
l0 AS (SELECT r, i, l[i + 1] AS line FROM (SELECT r, l, unnest(range(len(l))) AS i FROM (SELECT r, string_split(text, chr(10)) AS l FROM d)) WHERE regexp_matches(l[i + 1], '[^\x20\x09-\x0D]')),
l AS (SELECT *, coalesce(lag(line) OVER o, '') AS before, coalesce(lead(line) OVER o, '') AS after, row_number() OVER (PARTITION BY r, line ORDER BY i) AS turn, """
    + WORDS.format("line")
    + r""" AS w FROM l0 WINDOW o AS (PARTITION BY r ORDER BY i)),
rep AS (SELECT line FROM l WHERE strlen(line) <= 120 GROUP BY line HAVING count(DISTINCT (before, after)) >= 10 AND count(DISTINCT (before, after)) > (SELECT count(*) FROM l WHERE strlen(line) <= 120) // 50000),
p AS (SELECT *, string_split_regex(line, '[ \t]+(?:[|>/]|»|›|•|·|->|::)[ \t]+') AS parts, len(w) AS n, length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) AS marks, regexp_replace(line, '[^A-Za-z]', '', 'g') AS letters FROM l),
f AS (SELECT *, CASE WHEN turn > 1 THEN 'duplicate'
WHEN len(parts) >= 3 AND 5 * len(list_filter(parts, lambda x: len("""
    + WORDS.format("x").replace("lambda x: x <>", "lambda y: y <>")
    + r""") BETWEEN 1 AND 4)) >= 4 * len(parts) THEN 'navigation'
WHEN marks > 0.3::DOUBLE * n THEN 'symbols'
WHEN n >= 3 AND length(regexp_replace(letters, '[a-z]', '', 'g')) > 0.6::DOUBLE * length(letters) THEN 'shouting'
WHEN (n <= 15 AND regexp_matches(line, '"""
    + line_quality.BOILERPLATE.pattern.replace("\u00c0-\u024f", r"\x{00c0}-\x{024f}")
    + r"""')) OR line IN (SELECT line FROM rep) THEN 'boilerplate'
WHEN n >= 10 AND len(list_distinct(w)) <= n // 5 THEN 'repetition'
WHEN n BETWEEN 3 AND 29 AND NOT regexp_matches(line, '[.!?"'':);”…»][\x20\x09-\x0D]*$') THEN 'punctuation' END AS fault FROM p),
a AS (SELECT r, coalesce(sum(length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g'))) FILTER (fault IS NULL), 0)::DOUBLE AS held, count(fault) AS n_removed, """
    + ", ".join(f"CAST(count(*) FILTER (fault = '{x}') AS INTEGER) AS removed_{x}" for x in line_quality.RULES)
    + r""" FROM f GROUP BY r),
b AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(repeats, 0) AS n_repeat_words FROM d JOIN w USING (r) LEFT JOIN rw USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, CAST(coalesce(removed_duplicate, 0) AS BIGINT) AS n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND coalesce(held / nullif(word_chars, 0), 0) >= 0.5 AS kept, coalesce(held / nullif(word_chars, 0), 0) AS kept_share, coalesce(n_removed, 0) AS n_removed, """
    + ", ".join(f"coalesce(removed_{x}, 0) AS removed_{x}" for x in line_quality.RULES)
    + " FROM b LEFT JOIN a USING (r)"
)

# base32 of a SHA-1: eight groups of five hex digits, four letters each
_WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), k AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS keeper, sha1(html) AS h FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, list_aggregate(list_transform(range(8), lambda i: list_aggregate(list_transform(range(4), lambda j: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substring(h, 5 * i + 1, 5) AS BIGINT) >> (15 - 5 * j)) & 31 AS INTEGER) + 1, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keeper THEN keeper END AS refers_to FROM k"""

_TOP = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x::DOUBLE[], c.x::DOUBLE[]) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s) SELECT * FROM r WHERE rank <= 5"""

_NEAR = (
    "WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, "
    + WORDS.format("coalesce(text, '')")
    + """ AS w FROM documents WHERE doc_id IS NOT NULL),
g AS (SELECT DISTINCT r, CASE WHEN len(w) < 5 THEN w ELSE w[i + 1 : i + 5] END AS g FROM (SELECT r, w, unnest(range(greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM g GROUP BY r),
e AS (SELECT a.r AS a, b.r AS b FROM g a JOIN g b ON a.g = b.g AND a.r < b.r GROUP BY 1, 2 HAVING count(*) >= 0.8 * ((SELECT n FROM n WHERE n.r = a.r) + (SELECT n FROM n WHERE n.r = b.r) - count(*))),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
c AS (SELECT r, r AS root FROM d UNION SELECT both_ways.b, c.root FROM c JOIN both_ways ON c.r = both_ways.a),
m AS (SELECT r, min(root) AS root FROM c GROUP BY r)
SELECT doc_id, min(doc_id) OVER (PARTITION BY root) AS class_id, count(*) OVER (PARTITION BY root) AS class_size FROM d JOIN m USING (r)"""
)



def _clusters(k: int = 40, rounds: int = 5, dim: int = 64, seed: int = 2) -> str:
    """The rounds one after the other. Distances as double products, exact for whole numbers of this size."""
    near = "arg_min(c, (list_dot_product(v.y, v.y) - 2 * list_dot_product(v.y, c.y) + list_dot_product(c.y, c.y), c))"
    far = "CAST(min(list_dot_product(v.y, v.y) - 2 * list_dot_product(v.y, c.y) + list_dot_product(c.y, c.y)) AS BIGINT)"
    sql = f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS y FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, y) - 1 AS c, y FROM (SELECT sha256('{seed}:' || vec_id) AS h, y FROM v ORDER BY h NULLS LAST, y LIMIT {k})),
"""
    for i in range(1, rounds + 1):
        sql += f"""a{i} AS MATERIALIZED (SELECT r, {near} AS c FROM v, c{i - 1} c GROUP BY r),
s{i} AS (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT c, unnest(range({dim})) AS i, unnest(y) AS x FROM v JOIN a{i} USING (r)) GROUP BY c, i),
m{i} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY i) AS y FROM s{i} GROUP BY c),
c{i} AS MATERIALIZED (SELECT c0.c, coalesce(m{i}.y, o.y) AS y FROM c0 JOIN c{i - 1} o USING (c) LEFT JOIN m{i} USING (c)),
"""
    return sql + f"""f AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, {near} AS c, {far} AS distance FROM v, c{rounds} c GROUP BY r)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(list_transform(e.y, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256 FROM f JOIN c{rounds} e USING (c)"""


_DIVERGENCE = r"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
e AS MATERIALIZED (SELECT lang, source, r, term, count(*) AS n FROM (SELECT lang, source, r, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d) GROUP BY ALL),
k AS MATERIALIZED (SELECT lang, term, sum(n) AS total FROM e GROUP BY lang, term HAVING count(*) >= 10),
v AS (SELECT lang, count(*) AS v, sum(total) AS ln FROM k GROUP BY lang),
c AS (SELECT e.lang, e.source, term, sum(n) AS n FROM e JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, (SELECT sum(n) FROM c WHERE c.lang = x.lang AND c.source = x.source) AS sn FROM (SELECT DISTINCT lang, source FROM d) x),
p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 2)) // (coalesce(sn, 0) + 2 * v) AS p, 1 + (1000000000::HUGEINT * (total + 2)) // (ln + 2 * v) AS q
FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce((SELECT sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p WHERE n > 0 AND p > q),
o AS (SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM f)
SELECT * FROM o WHERE part = 'pair' OR rank <= 10"""

#: The other operators have parts that SQL can't say (boosted trees, trained models, a tokenizer, a flow, dynamic programming); tests hold them.
ORACLE_SQL: dict[str, str] = {"op2_line_quality": _LINES, "op3_warc_salvage": _WARC, "op4_cover_tree_top_k": _TOP, "op8_near_duplicates": _NEAR, "op11_centroid_clusters": _clusters(), "op12_source_divergence": _DIVERGENCE}
