"""Knowledge-graph triples: parsing, cleaning, routing, de-duplication, merging and quality. Triples are rows (pos, subject, predicate, object)."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import vectors as vx
from corvane.functions.text import squeeze, strip
from corvane.operators.graph import connected_components
from corvane.shared import Keep, running

SPO = ["subject", "predicate", "object"]
#: Words of a relation that say little (fixed values), and relations that a quality filter drops.
GENERIC = ("be", "is", "are", "was", "were", "have", "has", "had", "do", "does", "did", "make", "makes", "made", "get", "gets", "got")
DROPPED = ("mentions", "says", "talks about")
#: Pronouns, which are no entities (own list).
PRONOUNS = ("i", "you", "he", "she", "it", "we", "they", "this", "that", "these", "those", "him", "her", "them", "us", "me", "who", "what")


def relation_name(kind: Column) -> Column:
    return F.replace(F.lower(kind), F.lit("_"), F.lit(" "))


def from_relationships(df: DataFrame, *, provenance: list[str]) -> DataFrame:
    """Extractor relationships (source, type, target) as triples; the given columns become the provenance map, nulls left out."""
    entries = F.map_from_arrays(F.array(*map(F.lit, provenance)), F.array(*(F.col(c).cast("string") for c in provenance)))
    return df.select("pos", F.col("source").alias("subject"), relation_name(F.col("type")).alias("predicate"), F.col("target").alias("object"), F.map_filter(entries, lambda _, v: v.isNotNull()).alias("provenance"))


def routed(tokens: Column, primary: int = 4000, fallback: int = 8000) -> Column:
    return F.when(tokens <= primary, "primary").when(tokens <= fallback, "fallback").otherwise("skipped")


def parse_quoted(df: DataFrame, text_col: str) -> DataFrame:
    """("a", "b", "c") groups of a text as rows; other columns stay."""
    p = r'\(\s*"([^"]*)"\s*,\s*"([^"]*)"\s*,\s*"([^"]*)"\s*\)'
    parts = [F.regexp_extract_all(text_col, F.lit(p), F.lit(k)).alias(n) for k, n in enumerate(SPO, 1)]
    return df.select("*", F.posexplode(F.arrays_zip(*parts)).alias("triple_no", "__t")).select(*df.columns, "triple_no", "__t.*")


def parse_split(df: DataFrame, text_col: str, *, keep_commas: bool = True) -> DataFrame:
    """Groups parted by '), (': fields parted by ', ', exactly three, or with keep_commas the rest as the object."""
    body = F.regexp_replace(strip(F.col(text_col)), r"^\(|\)$", "")
    fields = F.transform(F.split(body, r"\), \("), lambda x: F.split(x, ", ", 3 if keep_commas else -1))
    whole = F.filter(fields, lambda x: F.size(x) == 3)
    rows = df.select("*", F.posexplode(whole).alias("triple_no", "__t"))
    return rows.select(*df.columns, "triple_no", *(strip(F.regexp_replace(F.col("__t")[k], r"^['\"]|['\"]$", "")).alias(n) for k, n in enumerate(SPO)))


def parse_loose(df: DataFrame, text_col: str, *, allowed: tuple[str, ...] = ()) -> DataFrame:
    """Innermost bracket groups with three parts by commas, unquoted; empty parts, parts over three words and entities of several words (unless allowed) drop the group."""
    inner = F.regexp_extract_all(text_col, F.lit(r"\(([^()]*)\)"), F.lit(1))
    rows = df.select("*", F.posexplode(inner).alias("triple_no", "__x")).withColumn("__p", F.split("__x", ","))
    rows = rows.filter(F.size("__p") == 3).select(*df.columns, "triple_no", *(F.regexp_replace(F.col("__p")[k], r"^[\s'\"]+|[\s'\"]+$", "").alias(n) for k, n in enumerate(SPO)))
    words = lambda c: F.size(F.split(F.col(c), r"\s+"))
    for n in SPO:
        rows = rows.filter((F.col(n) != "") & (words(n) <= 3))
    for n in ("subject", "object"):
        rows = rows.filter((words(n) == 1) | F.col(n).isin(*allowed)) if allowed else rows.filter(words(n) == 1)
    return rows


def complete(t: DataFrame) -> DataFrame:
    """Triples without a null or empty part."""
    return t.filter(" and ".join(f"coalesce({c}, '') <> ''" for c in SPO))


def quality_filter(t: DataFrame, least: int = 2, most: int = 100, dropped: tuple[str, ...] = DROPPED) -> DataFrame:
    return t.filter(F.length("subject").between(least, most) & F.length("object").between(least, most) & ~F.lower("predicate").isin(*dropped))


def cleaned(t: DataFrame) -> DataFrame:
    """White space squeezed; triples that lose a part go."""
    return complete(t.select(*[c for c in t.columns if c not in SPO], *(squeeze(F.col(c)).alias(c) for c in SPO)))


def first_occurrences(t: DataFrame) -> DataFrame:
    """Each distinct triple once, at its first position. The minimum combines before the shuffle, so a common triple is no hot spot."""
    return t.groupBy(*SPO).agg(F.min("pos").alias("pos")).select("pos", *SPO)


def last_edges(t: DataFrame) -> DataFrame:
    """One relation per (subject, object): the last."""
    return t.groupBy("subject", "object").agg(F.max_by("predicate", "pos").alias("predicate"))


def canonical_key() -> Column:
    """16 hex digits of the normalised triple: lower case, punctuation out, white space squeezed."""
    norm = lambda c: squeeze(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\s]", ""))
    return F.substring(F.sha2(F.concat_ws("|", *(norm(F.col(c)) for c in SPO)), 256), 1, 16)


def merged(t: DataFrame, keep: Keep, sources: int = 10) -> DataFrame:
    """Triples (with confidence, source) merged by canonical key: frequency, harmonic mean confidence, best form, last sources by position.

    A row's key is computed where the row is, once, so forms need not meet their rows in a join.
    """
    keyed = keep(t.select(*SPO, "pos", "confidence", "source", canonical_key().alias("key")))
    agg = keyed.groupBy("key").agg(F.count("*").alias("frequency"), F.round(F.count("confidence") / F.sum(1 / F.col("confidence")), 6).alias("confidence"), F.max_by(F.struct(*SPO), F.struct("confidence", "pos")).alias("best"))
    last = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("pos")))  # keeps `sources` rows per key and task before the shuffle
    kept = keyed.select("key", "pos", "source").withColumn("__n", last).filter(F.col("__n") <= sources).groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "source"))), lambda x: x["source"]), ",").alias("sources"))
    return agg.join(kept, "key").select("key", "best.*", "frequency", "confidence", "sources")


def cooccurrences(spans: DataFrame, sentence: list[str], *, label: str = "label", position: str = "position") -> DataFrame:
    """Ordered pairs of different labels inside a sentence. Spans of one sentence are few, so they pair inside its array."""
    held = spans.groupBy(*sentence).agg(F.array_sort(F.collect_list(F.struct(position, label))).alias("x"))
    pairs = F.flatten(F.transform("x", lambda a, i: F.transform(F.filter(F.slice(F.col("x"), i + 2, F.size("x")), lambda b: b[label] != a[label]), lambda b: F.struct(a[label].alias("subject"), b[label].alias("object")))))
    return held.select(*sentence, F.explode(pairs).alias("p")).select(*sentence, "p.subject", F.lit("co_occurs_with").alias("predicate"), "p.object")


def capitalized_spans(text: Column) -> Column:
    """Stand-in for a named-entity model, which is not here: runs of up to three capitalised words that do not open a sentence."""
    return F.regexp_extract_all(text, F.lit(r"(?<=[\p{L}\p{N},;:] )(\p{Lu}\p{L}+(?: \p{Lu}\p{L}+){0,2})"), F.lit(1))


def entity_scores(entities: DataFrame, keep: Keep, *, order: list[str], least: float = 0.6) -> DataFrame:
    """Entities with the mean of their quality factors and whether they are kept. Frequency is the running count before the row."""
    e = F.lower("entity")
    words = F.size(F.split(squeeze(F.col("entity")), r"\s+"))
    columns = entities.columns
    entities = running(entities.withColumn("__e", e), keep, by=["__e"], order=order, into="__n")
    before = F.col("__n") - 1
    one = lambda c, no: F.when(c, 1.0).otherwise(no)
    factors = [one(F.length("entity").between(2, 50), 0.0), one(words.between(1, 5), 0.0), one(F.col("entity").rlike(r"\p{Lu}"), 0.5), one(~e.isin(*PRONOUNS), 0.0), 1.0 - F.least(F.lit(1.0), before / 10)]
    score = sum(factors[1:], factors[0]) / len(factors)
    return entities.withColumn("score", F.round(score, 6)).withColumn("kept", F.col("score") >= least).select(*columns, "score", "kept")


def relation_scores(t: DataFrame, keep: Keep, *, vectors: DataFrame | None = None, least: float = 0.7) -> DataFrame:
    """Triples with the mean of their quality factors and whether they are kept.

    vectors: (term, vector) of lower-case terms; the likeness of a triple's ends is their cosine, and unknown (0.5) where one has none.
    """
    columns = t.columns
    low = [f"__{c}" for c in SPO]
    t = running(t.withColumns({n: F.lower(c) for n, c in zip(low, SPO, strict=True)}), keep, by=low, order=["pos"], into="__n")
    before, near = F.col("__n") - 1, F.lit(0.5)
    if vectors is not None:
        for c in ("subject", "object"):
            t = t.join(vectors.select(F.col("term").alias(f"__{c}"), F.col("vector").alias(f"__v{c}")), f"__{c}", "left")
        near = F.when(F.col("__vsubject").isNull() | F.col("__vobject").isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), vx.similarity(F.col("__vsubject"), F.col("__vobject"), "cosine")))
    generic = F.exists(F.split(F.lower("predicate"), " "), lambda w: w.isin(*GENERIC))
    factors = [F.when(F.length("predicate").between(2, 30), 1.0).otherwise(0.0), near, F.when(generic, 0.3).otherwise(1.0), 1.0 - F.least(F.lit(1.0), before / 5), F.when(F.lower("subject") != F.lower("object"), 0.5).otherwise(0.0)]
    score = sum(factors[1:], factors[0]) / len(factors)
    return t.withColumn("score", F.round(score, 6)).withColumn("kept", F.col("score") >= least).select(*columns, "score", "kept")


def merged_extractions(nlp: DataFrame, llm: DataFrame, least: float = 0.7) -> DataFrame:
    """Rule triples with model triples of confidence above least; rules first."""
    rows = nlp.select("pos", *SPO, F.lit(0).alias("origin")).unionByName(llm.filter(F.col("confidence") > least).select("pos", *SPO, F.lit(1).alias("origin")))
    return rows.groupBy(*SPO).agg(F.min(F.struct("origin", "pos")).alias("x")).select("x.origin", "x.pos", *SPO)


def digests(vectors: DataFrame, keep: Keep) -> tuple[DataFrame, DataFrame]:
    """(term, digest) of distinct terms, and (term, vector), of several vectors of a term the least. A digest is null unless the vector has a finite length above 0."""
    rows = vectors.filter(F.col("term").isNotNull() & F.col("vector").isNotNull()).select("term", "vector")
    many = keep(rows.groupBy("term").agg(F.count("*").alias("n")).filter("n > 1").select("term"))
    if not many.isEmpty():
        rows = rows.join(many, "term", "left_anti").unionByName(rows.join(many, "term", "left_semi").groupBy("term").agg(F.min("vector").alias("vector")))
    size = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    stands = (size > 0) & (size < float("inf"))
    return keep(rows.select("term", F.when(stands, F.unhex(F.sha2(F.array_join("vector", ","), 256))).alias("digest"))), rows


def vector_heads(told: DataFrame, rows: DataFrame, keep: Keep, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(term, head) of distinct terms, and (term, vector) of heads, from `digests`. Terms of one vector are alike to the same terms and to each other, so the
    smallest of them, their head, stands for all. A vector without a finite length above 0 is alike to nothing, and no vector is to its equal from a
    threshold of 1 on: such terms are their own heads. Only digests are dealt by term, and vectors of heads alone are handed on.
    """
    if threshold >= 1 - 1e-9:
        told = told.withColumn("digest", F.lit(None).cast("binary"))
    heads = told.filter("digest is not null").groupBy("digest").agg(F.min("term").alias("head"))
    headed = keep(told.join(heads, "digest", "left").select("term", F.coalesce("head", "term").alias("head")))
    return headed, rows.join(keep(headed.filter("term = head").select("term")), "term", "left_semi")


def alike_terms(vectors: DataFrame, keep: Keep, threshold: float, *, recall: float | None = None, block: int = 16384, held: int = 64, seed: int = 7) -> DataFrame:
    """(term, other) of distinct terms whose vectors' cosine is above the threshold, both ways, and each term with itself.

    Heads (`vector_heads`) are compared as in `alike_heads`, and their alike pairs are told for all terms that they stand for.
    """
    rows, heads = vector_heads(*digests(keep(vectors), keep), keep, threshold)
    near = alike_heads(heads, keep, threshold, recall=recall, block=block, held=held, seed=seed)
    both = near.unionByName(rows.filter("term = head").select("term", F.col("term").alias("other")))
    side = lambda c: rows.select(F.col("term").alias(f"__{c}"), F.col("head").alias(c))
    return both.join(side("term"), "term").join(side("other"), "other").select(F.col("__term").alias("term"), F.col("__other").alias("other"))


def alike_heads(rows: DataFrame, keep: Keep, threshold: float, *, recall: float | None = None, block: int = 16384, held: int = 64, seed: int = 7) -> DataFrame:
    """(term, other) of terms, each once with its vector, whose cosine is above the threshold, both ways; none with itself.

    Without `recall` all pairs are found (`blocked_heads`). With it, only terms that share a bucket are compared: random planes cut the space, and in each of several bands the sides of some planes are a bucket.
    There are so many planes that an unrelated term meets about `held` others in a band, and so many bands that a pair at the threshold is found
    with the probability `recall`, pairs above it with a higher one. Buckets larger than a block are compared block by block. Either way tasks
    return alike pairs only, verified by the cosine itself. Vectors of zeros are alike to nothing but themselves.
    """
    n, wide = rows.agg(F.count("*"), F.max(F.size("vector"))).first()
    if recall is None:
        return blocked_heads(rows, keep, threshold, blocks=max(1, -(-n // min(block, max(1, BLOCK_BYTES // (8 * max(1, wide or 1)))))))
    else:
        bits = min(30, max(4, math.ceil(math.log2(max(2, n) / held))))
        same = (1 - math.acos(min(1.0, threshold)) / math.pi) ** bits
        bands = 1 if same >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - same))
        unlike = math.acos(min(1.0, threshold)) / math.pi
        # a pair at the threshold differs in more sides of the sketch with a probability of some 1e-9
        most = math.ceil(SKETCH * unlike + 6 * math.sqrt(SKETCH * unlike * (1 - unlike)))
        if most <= SKETCH * 7 // 16:  # unrelated vectors differ in a half, give or take a thirty-second: one in 44 of them passes at most
            return sketched_heads(rows, keep, threshold, bits=bits, bands=bands, most=most, block=block, seed=seed)
        told = keep(banded(rows, bits, bands, seed).select("term", "bucket"))
        sizes = told.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
        met = told.join(sizes, "bucket").join(rows, "term").select("bucket", "term", "vector", "blocks")
    own = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")
    met = met.select("bucket", "term", "vector", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = met.select("bucket", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "term", "vector").repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, terms, of, parts = None, [], [], []

        def told() -> pa.RecordBatch:
            x, own = np.concatenate(parts), np.array(of)
            n = np.sqrt((x * x).sum(axis=1, keepdims=True))
            x = x / np.where(n > 0, n, 1)
            a, b = np.flatnonzero(own == at[1]), np.flatnonzero(own == at[2])
            other = x[b].T
            # some rows at a time, so the product of two full blocks is never held
            hits = [np.nonzero(x[a[k : k + 256]] @ other > threshold) for k in range(0, len(a), 256)]
            i = np.concatenate([a[256 * k + h[0]] for k, h in enumerate(hits)]) if hits else np.zeros(0, int)
            j = np.concatenate([b[h[1]] for h in hits]) if hits else np.zeros(0, int)
            i, j = i[i != j], j[i != j]
            if at[1] != at[2]:
                i, j = np.concatenate((i, j)), np.concatenate((j, i))
            return pa.RecordBatch.from_arrays([pa.array([terms[k] for k in i.tolist()], pa.string()), pa.array([terms[k] for k in j.tolist()], pa.string())], ["term", "other"])

        for b in batches:
            x = np.asarray(b.column(5).flatten(), dtype=float).reshape(b.num_rows, -1)
            for k, key in enumerate(zip(*(b.column(c).to_pylist() for c in range(3)), strict=True)):
                if key != at and terms:
                    yield told()
                    terms, of, parts = [], [], []
                at = key
                terms.append(b.column(4)[k].as_py())
                of.append(b.column(3)[k].as_py())
                parts.append(x[k : k + 1])
        if terms:
            yield told()

    return dealt.mapInArrow(near, "term string, other string").distinct()


#: A block of vectors, which is one row of a table, has so many bytes at most.
BLOCK_BYTES = 16 << 20


def blocked_heads(rows: DataFrame, keep: Keep, threshold: float, *, blocks: int) -> DataFrame:
    """alike_heads of all pairs: terms are dealt into blocks by hash, a block is written once as one row, and each pair of blocks is one matrix product in a task.

    Pairs of blocks meet by replication: a task reads the two blocks where they lie, so the disk holds each block and not each pair. The number of
    products is the square of the number of blocks. Products in single precision propose pairs, and the cosine in double precision decides.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, terms, parts = None, [], []
        for b in batches:
            if b.num_rows:
                own = b.column(0)[0].as_py()
                terms += b.column(1).to_pylist()
                x = np.asarray(b.column(2).flatten(), dtype=float).reshape(b.num_rows, -1)
                n = np.sqrt((x * x).sum(axis=1, keepdims=True))
                parts.append(x / np.where(n > 0, n, 1))
        if terms:
            x = np.concatenate(parts)
            yield pa.RecordBatch.from_arrays([pa.array([own], pa.int32()), pa.array([terms], pa.list_(pa.string())), pa.array([x.tobytes()], pa.binary())], ["block", "terms", "x"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one, two, terms, others = batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), batch.column(2)[k].values, batch.column(3)[k].values
                x, y = (np.frombuffer(batch.column(c)[k].as_buffer(), np.float64).reshape(n, -1) for c, n in ((4, len(terms)), (5, len(others))))
                least = threshold - 1e-6 * max(64, x.shape[1])
                a, b = x.astype(np.float32), y.astype(np.float32)
                for u in range(0, len(a), 512):  # some rows at a time, so the product of two full blocks is never held
                    for v in range(0, len(b), 4096):
                        near = np.flatnonzero(a[u : u + 512] @ b[v : v + 4096].T > least)
                        for w in range(0, len(near), 8192):
                            i, j = np.divmod(near[w : w + 8192], min(4096, len(b) - v))
                            i, j = i + u, j + v
                            hit = (x[i] * y[j]).sum(axis=1) > threshold
                            if one == two:
                                hit &= i < j
                            i, j = pa.array(i[hit]), pa.array(j[hit])
                            found = [terms.take(i), others.take(j)]
                            yield pa.RecordBatch.from_arrays(found, ["term", "other"])
                            yield pa.RecordBatch.from_arrays(found[::-1], ["term", "other"])

    own = F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int")
    dealt = rows.select(own.alias("block"), "term", F.col("vector").cast("array<double>").alias("vector")).repartitionById(blocks, "block")
    held = keep(dealt.mapInArrow(packed, "block int, terms array<string>, x binary"))
    one, two = (held.select(F.col("block").alias(c), F.col("terms").alias(f"terms_{c}"), F.col("x").alias(f"x_{c}")).repartitionById(blocks, c) for c in ("low", "high"))
    pairs = one.join(two.hint("shuffle_replicate_nl"), F.col("low") <= F.col("high")).select("low", "high", "terms_low", "terms_high", "x_low", "x_high")
    return pairs.mapInArrow(near, "term string, other string")


#: Sides of a sketch: a multiple of 64.
SKETCH = 256


def sketched_heads(rows: DataFrame, keep: Keep, threshold: float, *, bits: int, bands: int, most: int, block: int, seed: int) -> DataFrame:
    """alike_heads by bands, where a bucket's terms stand with a sketch of 32 bytes: its pairs that differ in `most` sides or fewer meet their vectors, each once."""
    told = keep(banded(rows, bits, bands, seed))
    sizes = told.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    met = told.join(sizes, "bucket")
    own = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")
    met = met.select("bucket", "term", "sketch", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = met.select("bucket", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "term", "sketch").repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def told() -> pa.RecordBatch:
            own = np.concatenate([np.asarray(b.column(3)) for b in held])
            terms = pa.concat_arrays([b.column(4) for b in held])
            x = np.frombuffer(b"".join(s for b in held for s in b.column(5).to_pylist()), np.uint64).reshape(len(own), -1)
            a, b = np.flatnonzero(own == at[1]), np.flatnonzero(own == at[2])
            hits = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for k in range(0, len(a), 64):  # some rows at a time, so all pairs of two full blocks are never held
                i, j = np.nonzero(np.bitwise_count(x[a[k : k + 64], None, :] ^ x[None, b, :]).sum(axis=2, dtype=np.int64) <= most)
                hits.append((a[k + i], b[j]))
            i, j = (np.concatenate(h) for h in zip(*hits, strict=True))
            if at[1] == at[2]:
                i, j = i[i < j], j[i < j]
            return pa.RecordBatch.from_arrays([terms.take(pa.array(i)), terms.take(pa.array(j))], ["term", "other"])

        for b in batches:
            keys = np.stack([np.asarray(b.column(c), dtype=np.int64) for c in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i == j:
                    continue
                key = tuple(keys[i].tolist())
                if held and key != at:
                    yield told()
                    held = []
                at = key
                held.append(b.slice(i, j - i))
        if held:
            yield told()

    pairs = dealt.mapInArrow(near, "term string, other string").select(F.least("term", "other").alias("term"), F.greatest("term", "other").alias("other")).distinct()

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.asarray(b.column(c).flatten(), dtype=float).reshape(b.num_rows, -1) for c in (2, 3))
            dots, sizes = (x * y).sum(axis=1), np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1))
            yield b.select(["term", "other"]).filter(pa.array(dots / np.where(sizes > 0, sizes, 1) > threshold))

    vectors = rows.select("term", F.col("vector").cast("array<double>").alias("vector"))
    both = pairs.join(vectors.withColumnRenamed("vector", "__x"), "term").join(vectors.select(F.col("term").alias("other"), F.col("vector").alias("__y")), "other").select("term", "other", "__x", "__y")
    found = keep(both.mapInArrow(verified, "term string, other string"))
    return found.union(found.select(F.col("other"), F.col("term")))


def banded(rows: DataFrame, bits: int, bands: int, seed: int) -> DataFrame:
    """(term, bucket, sketch) of each band: the sides of `bits` random planes on which a term's vector lies, and those of SKETCH further ones. Vectors of zeros have none."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = None
        for b in batches:
            x = np.asarray(b.column(1).flatten(), dtype=float).reshape(b.num_rows, -1)
            if planes is None:
                planes = np.random.default_rng(seed).normal(size=(x.shape[1], bits * bands))
                further = np.random.default_rng(seed + 1).normal(size=(x.shape[1], SKETCH))
            full = np.flatnonzero((x != 0).any(axis=1))
            for k in range(0, len(full), 1024):
                some = full[k : k + 1024]
                side = (x[some] @ planes > 0).reshape(len(some), bands, bits)
                key = (side << np.arange(bits)).sum(axis=2) + (np.arange(bands) << bits)
                sketch = pa.array([r.tobytes() for r in np.packbits(x[some] @ further > 0, axis=1)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(some, bands))), pa.array(key.ravel()), sketch.take(pa.array(np.repeat(np.arange(len(some)), bands)))], ["term", "bucket", "sketch"])

    return rows.select("term", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(told, "term string, bucket long, sketch binary")


def first_of_links(links: DataFrame, keep: Keep, *, local: int = 100_000) -> DataFrame:
    """(at) of the rows that go when rows are taken in order and one with an earlier kept partner goes. links: (at, other), other < at, each once.

    Components of up to `local` links are decided each by one pass in order inside a task, so a long chain costs no rounds of its own. Larger ones go in
    rounds of joins: without an earlier open or kept partner a row is kept, with an earlier kept one it goes, until none is open.
    """
    parts = keep(connected_components(links.select(F.col("at").alias("src"), F.col("other").alias("dst")), keep))
    placed = keep(links.join(parts, links["at"] == parts["node"]).select("at", "other", "component"))
    sizes = placed.groupBy("component").count()
    small = placed.join(sizes.filter(F.col("count") <= local), "component", "left_semi")
    name = lambda c: F.to_json(F.struct(F.col(c).alias("x")))
    dealt = small.repartition("component").sortWithinPartitions("component", "at", "other").select(name("component"), name("at"), name("other"), "at")

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        component, dropped = None, set()
        for b in batches:
            rows = []
            for i, (c, at, other) in enumerate(zip(*(b.column(k).to_pylist() for k in range(3)), strict=True)):
                if c != component:
                    component, dropped = c, set()
                # all earlier rows are decided: one goes with its first kept partner
                if at not in dropped and other not in dropped:
                    dropped.add(at)
                    rows.append(i)
            yield pa.RecordBatch.from_arrays([b.column(3).take(pa.array(rows, pa.int64()))], ["at"])

    gone = keep(dealt.mapInArrow(decided, links.select("at").schema))
    rest = keep(placed.join(sizes.filter(F.col("count") > local), "component", "left_semi").select("at", "other"))
    open_ = keep(rest.select("at").union(rest.select("other")).distinct())
    chosen = open_.limit(0)
    while not open_.isEmpty():
        held = rest.join(open_, "at", "left_semi").join(chosen.withColumnRenamed("at", "other"), "other", "left_semi")
        dropped = keep(held.select("at").distinct())
        left = keep(open_.join(dropped, "at", "left_anti"))
        waits = rest.join(left, "at", "left_semi").join(left.withColumnRenamed("at", "other"), "other", "left_semi").select("at").distinct()
        now = left.join(waits, "at", "left_anti")
        gone, chosen = keep(gone.union(dropped)), keep(chosen.union(now))
        open_ = keep(left.join(chosen, "at", "left_anti"))
    return gone


def near_duplicates_dropped(t: DataFrame, vectors: DataFrame, keep: Keep, *, entity_threshold: float = 0.8, relation_threshold: float = 0.7, recall: float | None = None) -> DataFrame:
    """Triples without those whose ends and relation are all alike to an earlier kept one. vectors: (term, vector) of lower-case terms.

    A term without a vector is alike to itself only. Equal triples (but for case) are one row, the first; so are triples whose ends and relation have
    the same heads (`vector_heads`): they are alike to each other and to the same others, so only the first of them can be kept. Alike heads are found
    once, among the terms that stand as ends and as relations, triples meet through them, and `first_of_links` folds by position.
    """
    low = [f"l_{c}" for c in SPO]
    heads = [f"h_{c}" for c in SPO]
    rows = keep(t.select("pos", *SPO))
    ends = rows.select(F.lower("subject").alias("term")).union(rows.select(F.lower("object")))
    vectors = keep(vectors)  # computed once a term: behind a plain select Spark would drop a distinct that made the terms
    marks, of_term = digests(vectors, keep)
    near = {}
    for kind, used, threshold in (("end", ends, entity_threshold), ("name", rows.select(F.lower("predicate").alias("term")), relation_threshold)):
        told, leads = vector_heads(marks.join(used.distinct(), "term", "left_semi"), of_term, keep, threshold)
        near[kind] = told, keep(alike_heads(leads, keep, threshold, recall=recall))
    of = lambda c: near["name" if c == "predicate" else "end"]
    headed = rows
    for c, n, h in zip(SPO, low, heads, strict=True):
        # a row that shuffles carries its terms once; lower case is told again where it is wanted
        headed = headed.join(of(c)[0].select(F.col("term").alias(n), F.col("head").alias(h)), F.lower(c) == F.col(n), "left").drop(n).withColumn(h, F.coalesce(h, F.lower(c)))
    at = F.struct("pos", *(F.lower(c).alias(n) for c, n in zip(SPO, low, strict=True)))  # positions may repeat
    lead = keep(headed.groupBy(*heads).agg(F.min(F.struct(at.alias("at"), *SPO)).alias("x")).select("x.*", *heads))
    met, any_ = lead.select("at", *heads), F.lit(False)
    for c, h in zip(SPO, heads, strict=True):
        others = of(c)[1].groupBy(F.col("term").alias(h)).agg(F.collect_list("other").alias(f"m_{c}"))
        met, any_ = met.join(others, h, "left"), any_ | F.col(f"m_{c}").isNotNull()
    near_ = keep(met.filter(any_))  # a triple without alike ends or relations has no link
    other = near_.select(F.col("at").alias("other"), *(F.col(h).alias(f"o_{c}") for c, h in zip(SPO, heads, strict=True)))
    for c, h in zip(SPO, heads, strict=True):
        near_ = near_.withColumn(f"o_{c}", F.explode(F.concat(F.array(h), F.coalesce(f"m_{c}", F.array().cast("array<string>")))))
    links = keep(near_.select("at", *(f"o_{c}" for c in SPO)).join(other, [f"o_{c}" for c in SPO]).filter("other < at").select("at", "other"))
    gone = first_of_links(links, keep)
    return lead.join(gone, "at", "left_anti").select("at.pos", *SPO)


Patterns = Callable[[str], list[tuple[str, str, str]]]


def parsed_relations(df: DataFrame, parser: Patterns, *, id_col: str, text_col: str) -> DataFrame:
    """(id, triple_no, subject, predicate, object) of a dependency parser's patterns, which names them itself.

    parser: a text's relations, as a parsing model finds them (subject - verb - object, prepositions, appositions as `is`, compounds as
    `part_of`). Ends of one character and relations of a term with itself are left out, and relations are numbered anew.
    """
    rows = extract(df, parser, id_col=id_col, text_col=text_col, retries=1)
    sound = rows.filter((F.length("subject") > 1) & (F.length("object") > 1) & (F.col("subject") != F.col("object")))
    again = F.row_number().over(Window.partitionBy("id").orderBy("triple_no")) - 1
    return sound.withColumn("triple_no", again.cast("int"))


def simple_patterns(verbs: tuple[str, ...] = ("is", "was", "has", "had", "knows", "likes", "uses", "makes")) -> Patterns:
    """A stand-in for a dependency parser, which is not here: word - verb - word, word in/of word, and capitalised pairs as compounds."""
    import re

    svo = re.compile(rf"(\w+) ({'|'.join(verbs)}) (?:a |an |the )?(\w+)")
    preposition = re.compile(r"(\w+) (in|of|at|for|with) (?:a |an |the )?(\w+)")
    compound = re.compile(r"\b([A-Z]\w+) ([A-Z]\w+)\b")

    def parse(text: str) -> list[tuple[str, str, str]]:
        return [m.groups() for m in svo.finditer(text)] + [m.groups() for m in preposition.finditer(text)] + [(m[1], "part_of", m[2]) for m in compound.finditer(text)]

    return parse


def extract(chunks: DataFrame, extractor: Callable[[str], list[tuple[str, str, str]]], *, id_col: str = "id", text_col: str = "text", retries: int = 3, first_wait: float = 0.0, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """Triples of each chunk by a pluggable extractor. A failed chunk is tried again after first_wait * 2 ** attempt seconds; one that fails `retries` times has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, text in zip(b["id"], b["text"], strict=True):
                found: list = []
                for attempt in range(retries):
                    try:
                        found = extractor(text or "")
                        break
                    except Exception:  # noqa: BLE001  an extractor may fail in any way
                        if first_wait and attempt + 1 < retries:
                            sleep(first_wait * 2**attempt)
                out += [(str(i), k, *x) for k, x in enumerate(found)]
            yield pd.DataFrame(out, columns=["id", "triple_no", *SPO])

    return chunks.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, "id string, triple_no int, subject string, predicate string, object string")


def extract_batched(chunks: DataFrame, extractor: Callable[[list[str]], list[list[tuple[str, str, str]]]], *, id_col: str = "id", text_col: str = "text", size: int = 5, retries: int = 3) -> DataFrame:
    """As extract, with `size` chunks a call; a call that fails `retries` times gives its chunks nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, texts, out = b["id"].tolist(), b["text"].fillna("").tolist(), []
            for a in range(0, len(ids), size):
                found: list = []
                for _ in range(retries):
                    try:
                        found = extractor(texts[a : a + size])
                        break
                    except Exception:  # noqa: BLE001  an extractor may fail in any way
                        continue
                out += [(str(i), k, *x) for i, xs in zip(ids[a : a + size], found, strict=False) for k, x in enumerate(xs)]
            yield pd.DataFrame(out, columns=["id", "triple_no", *SPO])

    return chunks.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, "id string, triple_no int, subject string, predicate string, object string")


RESULT = "custom_id string, error struct<message string>, response struct<body struct<error struct<message string>, choices array<struct<message struct<content string>>>>>"


def batch_results(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """JSON lines of a batch job by outcome: bad_json, error, missing_response, body_error, bad_choices, bad_message, null_content, content."""
    r = F.from_json(line_col, RESULT)
    top = F.get_json_object(line_col, "$")
    c = lambda p: F.col(f"__r.{p}")
    kind = (
        F.when(F.col("__j").isNull(), "bad_json").when(c("error").isNotNull(), "error").when(c("response").isNull(), "missing_response").when(c("response.body.error").isNotNull(), "body_error")
        .when(F.coalesce(F.size(c("response.body.choices")), F.lit(0)) < 1, "bad_choices").when(F.get(c("response.body.choices"), F.lit(0))["message"].isNull(), "bad_message").when(F.get(c("response.body.choices"), F.lit(0))["message"]["content"].isNull(), "null_content").otherwise("content")
    )
    return lines.withColumns({"__r": r, "__j": top}).select(F.coalesce(c("custom_id"), F.lit("unknown")).alias("custom_id"), kind.alias("outcome"), F.get(c("response.body.choices"), F.lit(0))["message"]["content"].alias("content"))


def valid_responses(df: DataFrame, json_col: str, required: list[str]) -> DataFrame:
    """Adds `valid`: whether a JSON response has all required keys."""
    keys = F.json_object_keys(json_col)
    return df.withColumn("valid", F.coalesce(F.size(F.array_intersect(keys, F.array(*map(F.lit, required)))) == len(required), F.lit(False)))


def prompts(df: DataFrame, *, title: str, text: str) -> Column:
    """One titled block of a prompt."""
    return F.concat(F.lit("=== "), F.col(title), F.lit(" ===\n"), F.col(text))


def merged_by(t: DataFrame, by: str) -> DataFrame:
    """Distinct triples of each group (a video, a channel) with how often and where first they stand."""
    return t.groupBy(by, *SPO).agg(F.count("*").alias("frequency"), F.min("pos").alias("first_pos"))


def extraction_stats(t: DataFrame, chunk: str) -> DataFrame:
    return t.agg(F.countDistinct(chunk).alias("chunks"), F.count("*").alias("triples"), F.countDistinct("subject", "object").alias("entity_pairs"))
