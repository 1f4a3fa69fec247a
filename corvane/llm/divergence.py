"""Source divergence audit: how far the terms of the sources of a language differ, and which terms stand out in a source.

Plain relational, all of it DataFrame operators. Matches of the term pattern are exploded and counted by (lang, source, term), with
partial sums before the shuffle, so a frequent source or term costs a row a task. The vocabulary of a language is its terms in
``min_docs`` documents. Its groups are crossed with it so that absent terms count as zero: the join is by language and a salt that
deals the vocabulary over tasks, so no task holds a language. The dense table, joined to itself by language and term, gives the sums
over pairs of sources, each unordered pair once; windows rank pairs and terms.

Numbers are exact: probabilities are whole parts of 10^9, computed in decimals where a product may pass a long.

Defined results: null text, lang or source count as empty strings; repeated rows are documents of their own; a language without kept
terms gives pairs of value 0 and no terms; a source alone in its language gives no pair; an empty table gives no rows. Other columns are
ignored, so their names cannot clash. The pairs of a language are part of the result, so that grows with the square of its sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import written

#: What parts terms: a term is a longest run of other characters, that is of ASCII letters and of all characters beyond ASCII.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ONE = 1_000_000_000


def part(count: Column, total: Column, vocabulary: Column) -> Column:
    """1 + floor(10^9 * (count + 2) / (total + 2 * vocabulary)), exact for any long counts."""
    above = F.lit(ONE).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)")
    return (F.lit(1) + F.call_function("div", above, (total + 2 * vocabulary).cast("decimal(20,0)"))).cast("long")


def parted(p: str, q: str) -> Column:
    """floor((p - q)^2 / (p + q)) of two columns; both are at most 10^9 + 1, so the square fits a long."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def term_counts(docs: DataFrame, *, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it); every group has a row of the empty term or one of a term."""
    text = F.translate(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), UPPER, LOWER)
    # the matches are what lies between the runs of other characters (and the empty string before, after or instead of them)
    terms = F.sort_array(F.split(text, BETWEEN))
    named = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = docs.select(named(lang_col).alias("lang"), named(source_col).alias("source"), terms.alias("terms"))
    # equal terms of a document stand side by side: the first of them, unlike the one before, counts the document
    beside = F.arrays_zip(F.col("terms").alias("term"), F.concat(F.array(F.lit(None).cast("string")), "terms").alias("before"))
    each = rows.select("lang", "source", F.inline(beside).alias("term", "before")).filter("term is not null")
    return each.groupBy("lang", "source", "term").agg(F.count("*").alias("n"), F.count_if(~F.col("term").eqNullSafe(F.col("before"))).alias("docs"))


def audit(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = 10, top: int = 10, slice_terms: int = 20_000) -> DataFrame:
    """lang, source, part, item, value, rank: for each source all other sources of its language, and its `top` terms.

    slice_terms: kept terms of a language that a task crosses with that language's sources, about.
    """
    counts = written(term_counts(docs, text_col=text_col, lang_col=lang_col, source_col=source_col), "term-counts")
    vocabulary = written(counts.filter("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs).select("lang", "term", "total"), "vocabulary")
    sizes = vocabulary.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    held = counts.join(vocabulary, ["lang", "term"]).select("lang", "source", "term", "n")
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("source_n"))
    groups = counts.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = written(groups.select("lang", "source", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("lang_n", F.lit(0)).alias("lang_n"), F.coalesce("source_n", F.lit(0)).alias("source_n")), "groups")
    # every group meets every kept term of its language: the slices of a vocabulary are dealt over tasks
    slices = F.greatest(F.lit(1), F.ceil(F.col("v") / slice_terms)).cast("int")
    sliced = vocabulary.join(sizes.select("lang", slices.alias("slices")), "lang").select("lang", "term", "total", F.pmod(F.xxhash64("term"), "slices").cast("int").alias("slice"))
    spread = groups.filter("v > 0").select("*", F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"))
    crossed = sliced.join(spread, ["lang", "slice"]).select("lang", "term", "source", "total", "v", "lang_n", "source_n")
    full = crossed.join(held, ["lang", "term", "source"], "left")
    n = F.coalesce("n", F.lit(0))
    dense = written(full.select("lang", "source", "term", part(n, F.col("source_n"), F.col("v")).alias("p"), F.when(n > 0, part(F.col("total"), F.col("lang_n"), F.col("v"))).alias("q")), "dense")

    mine, other = dense.select("lang", "term", "source", "p"), dense.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"))
    once = mine.join(other, ["lang", "term"]).filter("source < item").groupBy("lang", "source", "item").agg(F.sum(parted("p", "q")).alias("value"))
    # a language without kept terms has its pairs all the same
    bare = groups.filter("v = 0").select("lang", "source")
    none = bare.join(bare.withColumnRenamed("source", "item"), "lang").filter("source < item").withColumn("value", F.lit(0).cast("long"))
    halves = once.unionByName(none)
    pairs = halves.select("lang", F.inline(F.array(F.struct("source", "item", "value"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), "value"))))
    terms = dense.filter("p > q").select("lang", "source", F.col("term").alias("item"), parted("p", "q").alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = lambda df, name: df.select("lang", "source", F.lit(name).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return ranked(pairs, "pair").unionByName(ranked(terms, "term").filter(F.col("rank") <= top))
