"""Sources and sinks on files: tables, triples, raw records, text folders, graph exports and vector stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.tokens import token_count

SPO = ["subject", "predicate", "object"]

#: Columns that a transcripts source must have (fixed values).
REQUIRED = ["video_id", "title", "publish_date", "length_seconds", "description", "tags", "category_name", "transcript_text"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def check_source(df: DataFrame, required: list[str] | None = None) -> DataFrame:
    """(column, present): one row per required column."""
    names = required or REQUIRED
    return df.sparkSession.createDataFrame([(c, c in df.columns) for c in names], "column string, present boolean")


def query_source(spark: SparkSession, df: DataFrame, sql: str, view: str = "transcripts") -> DataFrame:
    df.createOrReplaceTempView(view)
    return spark.sql(sql)


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """Triples of JSON files with a `triples` array, in file and array order; rows with a null or empty part are left out."""
    schema = "triples array<struct<subject string, predicate string, object string>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode("triples").alias("pos", "t"))
    return rows.select("file", F.col("pos").cast("long").alias("pos"), "t.*").filter("coalesce(subject,'') <> '' and coalesce(predicate,'') <> '' and coalesce(object,'') <> ''")


def write_triples(t: DataFrame, path: str, mode: str = "errorifexists", *, per_file: int = 10_000) -> None:
    """JSON files as read_triples takes them: one object with a `triples` array in each, of per_file triples at most."""
    at = F.floor((F.row_number().over(Window.partitionBy("__task").orderBy("__row")) - 1) / per_file)
    dealt = t.select(*SPO, F.monotonically_increasing_id().alias("__row")).withColumn("__task", F.shiftright("__row", 33)).withColumn("__file", at)
    rows = dealt.groupBy("__task", "__file").agg(F.array_sort(F.collect_list(F.struct("__row", *SPO))).alias("x"))
    lines = rows.select("__task", "__file", F.to_json(F.struct(F.transform("x", lambda e: F.struct(*(e[c].alias(c) for c in SPO))).alias("triples"))).alias("value"))
    lines.repartition("__task", "__file").select("value").write.mode(mode).option("maxRecordsPerFile", 1).text(path)


def datasets(spark: SparkSession, path: str) -> DataFrame:
    """Files under a path with size and time."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")


#: Lines of a text file that are left out.
COMMENT = r"(?m)^\s*#.*(?:\r?\n|$)"


def read_texts(spark: SparkSession, path: str, kinds: str = "{txt,md,csv}") -> DataFrame:
    """(file, text) of whole text files; lines that begin with # are left out."""
    rows = spark.read.text(path, wholetext=True, pathGlobFilter=f"*.{kinds}")
    return rows.select(F.col("_metadata.file_name").alias("file"), F.regexp_replace("value", COMMENT, "").alias("text"))


def token_totals(texts: DataFrame) -> DataFrame:
    """(file, tokens) of read_texts, and the grand total under a null file."""
    return texts.rollup("file").agg(F.sum(token_count(F.col("text"))).alias("tokens"))


def write_texts(df: DataFrame, path: str, *, headers: dict[str, str], text: str, mode: str = "errorifexists", key: str | None = None) -> None:
    """Texts with a header of `# name: value` lines (names and their columns; nulls are left out). With a key, a folder `key=<value>` with one file for each."""
    lines = [F.concat(F.lit(f"# {name}: "), F.col(c).cast("string")) for name, c in headers.items()]
    value = F.concat_ws("\n", *lines, F.col(text)).alias("value")
    _per_key(df.select(*([F.col(key).alias(key)] if key else []), value), path, mode, key, lambda w: w.text(path))


def write_raw(df: DataFrame, path: str, mode: str = "errorifexists", *, key: str | None = None) -> None:
    """Raw records as JSON. With a key, a folder `key=<value>` with one file for each, which a later write of the same key replaces."""
    _per_key(df, path, mode, key, lambda w: w.json(path))


def _per_key(df: DataFrame, path: str, mode: str, key: str | None, write) -> None:
    if key is None:
        write(df.write.mode(mode))
    else:
        # with a number of tasks, as adaptive execution would let one task write all folders of small records
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        write(df.repartition(n, key).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(key))


def write_graph_csv(t: DataFrame, nodes: DataFrame, path: str, mode: str = "errorifexists") -> None:
    t.select(F.col("subject").alias("source"), F.col("object").alias("target"), F.col("predicate").alias("relation")).write.mode(mode).option("header", True).csv(f"{path}/edges")
    nodes.write.mode(mode).option("header", True).csv(f"{path}/nodes")


def node_link(t: DataFrame, nodes: DataFrame) -> DataFrame:
    """Node-link JSON lines: one line per node and per link, in a form that graph tools read in parts."""
    n = nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct(F.col("node").alias("id"), "type")).alias("value"))
    return n.union(t.select(F.lit("link"), F.to_json(F.struct(F.col("subject").alias("source"), F.col("object").alias("target"), F.col("predicate").alias("relation")))))


def _safe(c: str) -> Column:
    out = F.col(c)
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(mark), F.lit(name))
    return out


def graphml_lines(t: DataFrame, nodes: DataFrame) -> DataFrame:
    """The node and edge elements of a GraphML document."""
    n = nodes.select(F.format_string('<node id="%s"/>', _safe("node")).alias("value"))
    return n.union(t.select(F.format_string('<edge source="%s" target="%s"><data key="relation">%s</data></edge>', _safe("subject"), _safe("object"), _safe("predicate"))))


def gexf_lines(t: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The node and the edge elements of a GEXF document."""
    n = nodes.select(F.format_string('<node id="%s" label="%s"/>', _safe("node"), _safe("node")).alias("value"))
    e = t.select(F.format_string('<edge id="%s" source="%s" target="%s" label="%s"/>', F.monotonically_increasing_id().cast("string"), _safe("subject"), _safe("object"), _safe("predicate")).alias("value"))
    return n, e


#: What stands before, between and after the elements of the two formats (fixed values).
GRAPHML = ('<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="relation" for="edge" attr.name="relation" attr.type="string"/><graph edgedefault="directed">', "", "</graph></graphml>")
GEXF = ('<?xml version="1.0" encoding="UTF-8"?><gexf xmlns="http://gexf.net/1.3" version="1.3"><graph defaultedgetype="directed"><nodes>', "</nodes><edges>", "</edges></graph></gexf>")


def write_graph_document(t: DataFrame, nodes: DataFrame, path: str, kind: str = "graphml", mode: str = "errorifexists") -> None:
    """A whole GraphML or GEXF document as text files that are one document in the order of their names.

    An element's place is its part (frame, nodes, edges), so the lines are sorted by ranges and written side by side.
    """
    spark = t.sparkSession
    if kind == "graphml":
        frame, n, e = GRAPHML, graphml_lines(t.limit(0), nodes), graphml_lines(t, nodes.limit(0))
    elif kind == "gexf":
        frame, (n, e) = GEXF, gexf_lines(t, nodes)
    else:
        raise ValueError(f"no such kind: {kind}")
    lines = spark.createDataFrame([(i, x) for i, x in zip((0, 2, 4), frame, strict=True) if x], "at int, value string")
    lines = lines.union(n.select(F.lit(1), "value")).union(e.select(F.lit(3), "value"))
    lines.orderBy("at", "value").select("value").write.mode(mode).text(path)


def write_analysis(metrics: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The analysis text of a graph: a line `name: value` for each column of its one row of metrics."""
    cells = F.array(*(F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in metrics.columns))
    metrics.limit(1).select(F.array_join(cells, "\n").alias("value")).coalesce(1).write.mode(mode).text(path)


def save_store(store: DataFrame, path: str, mode: str = "overwrite") -> None:
    store.write.mode(mode).parquet(path)


def load_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def sources(spark: SparkSession, database: str | None = None) -> DataFrame:
    """(name, valid): tables of the catalog, by name, and whether each has the required columns."""
    names = sorted(t.name for t in spark.catalog.listTables(database))
    return spark.createDataFrame([(n, {*REQUIRED} <= {*spark.table(n).columns}) for n in names], "name string, valid boolean")


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """(file, triple_count, size, modified) of graph files."""
    schema = "triples array<struct<subject string, predicate string, object string>>"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.col("_metadata.file_path").alias("file"), F.size(F.coalesce("triples", F.array())).alias("triple_count"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("modified"))
