"""Incremental merging of triples against a stored signature index.

A triple's canonical key tells exact duplicates. Its signature, 128 bits (which side of 128 fixed random planes its vector lies on), tells close ones:
signatures that differ in at most `radius` bits. The first triple of a kind stays as the edge, later ones count into it: exact ones by
key, close ones by the nearest edge that is earlier (least distance, then first position).

The nearest edges are found by a multi-index: a signature is cut into four groups of four bytes, and a part is three bytes of a group. Two signatures
that differ in at most 7 bits agree in one of these 16 parts (`parted`), of which some n / 2^20 of n unrelated ones meet a form by chance, all
parts together. No part is stored: two bytes of each group's halves deal a signature to eight tasks, which tell the parts themselves (`near_signatures`),
and only a signature that no edge has is looked up at all. Two tables are kept in buckets (`buckets.BucketTable`): forms by key and edges, with their
signatures, by key. A batch rewrites only the buckets that its keys lie in and reads the signatures of all edges (16 rows an edge in a table of parts
were more than that for any batch of some ten forms). Batches that come in the order of positions give what one load gives. A form whose edge is known
is never looked up again. Batches are numbered; a replay, or a batch that broke off between two tables and is run again, changes nothing that was done.
A batch's own tables in the shared folder are deleted when it is done.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.operators.buckets import BucketTable
from corvane.operators.triples import SPO, canonical_key, first_of_links
from corvane.shared import Keep, marked, release

#: Signatures of BITS bits; those that differ in fewer than PARTS are found. A part is 24 bits of one of GROUPS groups.
BITS, PARTS, GROUPS = 128, 8, 4
FORM = "key string, edge string, pos long"
EDGE = "edge string, subject string, predicate string, object string, signature binary, pos long, frequency long, parts double, rated long, best struct<confidence:double,pos:long>, sources array<struct<pos:long,source:string>>"


def signatures(df: DataFrame, text: str, embed: Callable[[list[str]], np.ndarray], *, seed: int = 11) -> DataFrame:
    """df with the 16-byte signature of a text's vector."""
    names = df.columns

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = None
        for b in batches:
            x = np.asarray(embed([t or "" for t in b.column(names.index(text)).to_pylist()]), np.float64).reshape(b.num_rows, -1)
            if planes is None:
                planes = np.random.default_rng(seed).normal(size=(x.shape[1], BITS))
            bits = np.packbits(x @ planes > 0, axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([r.tobytes() for r in bits], pa.binary())], [*names, "signature"])

    return df.mapInArrow(told, T.StructType([*df.schema.fields, T.StructField("signature", T.BinaryType())]))


def distance(a: str, b: str) -> Column:
    """Bits in which two signatures differ."""
    halves = [F.bit_count(F.conv(F.hex(F.substring(F.col(a), k, 4)), 16, 10).cast("long").bitwiseXOR(F.conv(F.hex(F.substring(F.col(b), k, 4)), 16, 10).cast("long"))) for k in (1, 5, 9, 13)]
    return sum(halves[1:], halves[0])


def parted(df: DataFrame) -> DataFrame:
    """A row for each part of each signature: in each GROUP of bits, all of its bytes but one.

    Of fewer than PARTS differing bits one GROUP has one at most, which spoils one byte of it, so the part without that byte agrees.
    """
    wide = BITS // 8 // GROUPS
    parts = []
    for k in range(GROUPS):
        for left in range(wide):
            held = F.concat(*(F.substring("signature", 1 + k * wide + i, 1) for i in range(wide) if i != left))
            parts.append(F.struct(F.lit(k * wide + left).alias("part"), F.conv(F.hex(held), 16, 10).cast("int").alias("value")))
    return df.withColumn("__p", F.explode(F.array(*parts))).select("*", "__p.part", "__p.value").drop("__p")


def near_signatures(new: DataFrame, stored: DataFrame, radius: int, *, partitions: int) -> DataFrame:
    """(a, b, stored, far): pairs of signatures that differ in at most `radius` bits, fewer than PARTS, each pair once.

    a is of `new`; b of `new` too, or where `stored` says so of the other table. Signatures are distinct within and between both. A signature goes to
    a task for each of its eight pairs of bytes; there it has the two parts of these and one further byte of their group, and rows of one part are compared.
    """
    side = lambda df, flag: df.select("signature", F.explode(F.array(*(F.lit(2 * p + flag).cast("byte") for p in range(BITS // 16)))).alias("tag"))
    both = side(new, 0).union(side(stored, 1)).select("tag", "signature")
    part = F.shiftright("tag", 1)
    dealt = both.repartition(partitions, part, F.substring("signature", part * 2 + 1, F.lit(2)))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tags, signs = [np.zeros(0, np.int8)], [b""]
        for b in batches:
            tags.append(np.asarray(b.column(0)))
            signs.append(b"".join(b.column(1).to_pylist()))
        tag, x = np.concatenate(tags), np.frombuffer(b"".join(signs), np.uint8).reshape(-1, BITS // 8)
        words, kept, part = x.view(np.uint64), (tag & 1) == 1, (tag >> 1).astype(np.intp)
        row = np.arange(len(x))
        for third in range(2):
            key = part << 24 | x[row, 2 * part].astype(np.intp) << 16 | x[row, 2 * part + 1].astype(np.intp) << 8 | x[row, 2 * (part ^ 1) + third]
            order = np.argsort(key, kind="stable")
            key = key[order]
            at, step = np.flatnonzero(key[1:] == key[:-1]), 1
            while len(at):  # each row and the one so many steps on, as long as they have one part
                for k in range(0, len(at), 1 << 18):
                    i, j = order[at[k : k + (1 << 18)]], order[at[k : k + (1 << 18)] + step]
                    far = np.bitwise_count(words[i] ^ words[j]).sum(axis=1, dtype=np.int32)
                    hit = np.flatnonzero((far <= radius) & ~(kept[i] & kept[j]))
                    if len(hit):
                        i, j, far = i[hit], j[hit], far[hit]
                        same = x[i] == x[j]
                        halves = same[:, 0::2] & same[:, 1::2]
                        agree = np.stack([halves[:, p] & same[:, 2 * (p ^ 1) + o] for p in range(BITS // 16) for o in range(2)], axis=1)
                        first = agree.argmax(axis=1) == 2 * part[i] + third  # told by the first of the parts that it shares
                        i, j, far = i[first], j[first], far[first]
                        i, j = np.where(kept[i], j, i), np.where(kept[i], i, j)
                        tell = lambda rows: pa.array([r.tobytes() for r in x[rows]], pa.binary())
                        yield pa.RecordBatch.from_arrays([tell(i), tell(j), pa.array(kept[j]), pa.array(far)], ["a", "b", "stored", "far"])
                step += 1
                at = at[at + step < len(key)]
                at = at[key[at + step] == key[at]]

    return dealt.mapInArrow(near, "a binary, b binary, stored boolean, far int")


class TripleIndex:
    """The merged triples at a path."""

    def __init__(self, spark: SparkSession, path: str, embed: Callable[[list[str]], np.ndarray], keep: Keep, *, radius: int = PARTS - 1, sources: int = 10, buckets: int = 64):
        if not 0 <= radius < PARTS:
            raise ValueError(f"a radius of {radius} bits needs more than {PARTS} parts")
        self.spark, self.embed, self.keep, self.radius, self.sources = spark, embed, keep, radius, sources
        self.forms = BucketTable(spark, f"{path}/forms", ["key"], FORM, buckets)
        self.edges = BucketTable(spark, f"{path}/edges", ["edge"], EDGE, buckets)

    def read(self, digits: int = 6) -> DataFrame:
        """key, subject, predicate, object, frequency, confidence (harmonic mean), sources (the last by position)."""
        return self.edges.read().select(F.col("edge").alias("key"), *SPO, "frequency", F.round(F.try_divide(F.col("rated").cast("double"), "parts"), digits).alias("confidence"), F.array_join(F.transform("sources", lambda x: x["source"]), ",").alias("sources"))

    def merge(self, triples: DataFrame, batch: int) -> None:
        """Merge triples (pos, subject, predicate, object, confidence, source). Positions of a later batch are above those of earlier ones."""
        if batch <= self.edges.manifest()[1]:
            return
        since = marked()
        t = self.keep(triples.select("pos", *SPO, "confidence", "source").withColumn("key", canonical_key()))
        new = self.keep(self.unknown(t))
        placed = self.keep(self.placed(new))
        self.forms.merge(placed.select("key", "edge", "pos"), lambda old, rows: old.unionByName(rows.join(old, "key", "left_anti")), batch)
        # the edges come last: their batch number says that a batch is done
        leaders = placed.filter("key = edge").select("edge", "signature", "pos")
        of = self.forms.lookup(t.select("key")).select("key", "edge")
        self.edges.merge(self.summed(t.join(of, "key"), leaders), self.combined, batch)
        release(self.spark, since)

    def unknown(self, t: DataFrame) -> DataFrame:
        """(key, pos, signature) of the forms that no batch before has brought."""
        stored = self.forms.lookup(t.select("key")).filter(F.col("pos") < (t.agg(F.min("pos")).first()[0] or 0)).select("key")  # a batch that is run again finds its own forms
        text = F.lower(F.concat_ws(" ", *SPO))
        firsts = t.groupBy("key").agg(F.min(F.struct("pos", text.alias("text"))).alias("x")).select("key", "x.*").join(stored, "key", "left_anti")
        return signatures(firsts, "text", self.embed).select("key", "pos", "signature")

    def placed(self, new: DataFrame) -> DataFrame:
        """new with the edge of each form, its own key if it is one: by stored edges, and by the fold over positions among the rest."""
        stored = self.edges.read().select("signature", F.col("edge").alias("had"), F.col("pos").alias("at"))
        # of equal signatures only the first can be an edge; one that a stored edge has is that edge's
        firsts = new.groupBy("signature").agg(F.min(F.struct("pos", "key")).alias("x")).select("signature", "x.*")
        firsts = self.keep(firsts.join(stored.select("signature", "had"), "signature", "left"))
        open_ = firsts.filter("had is null").select("signature", "pos", "key")
        rows = open_.count() + stored.count()
        near = self.keep(near_signatures(open_.select("signature"), stored.select("signature"), self.radius, partitions=max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")), rows * 8 >> 21)))
        old = near.filter("stored").join(stored.withColumnRenamed("signature", "b"), "b").select(F.col("a").alias("signature"), "far", "at", F.col("had").alias("edge"))
        old = self.keep(old.groupBy("signature").agg(F.min(F.struct("far", "at", "edge")).alias("best")))
        # the others meet each other
        among = near.filter("not stored").select("a", "b", "far")
        among = among.union(among.select("b", "a", "far")).join(open_.select(F.col("signature").alias("b"), F.struct("pos", "key").alias("other")), "b")
        among = self.keep(among.select("a", "other", "b", "far"))
        free = among.join(old.select(F.col("signature").alias("a")), "a", "left_anti").join(old.select(F.col("signature").alias("b")), "b", "left_anti")
        links = free.join(open_.select(F.col("signature").alias("a"), F.struct("pos", "key").alias("at")), "a").filter("other < at").select("at", "other")
        gone = self.keep(first_of_links(self.keep(links), self.keep).select("at.key"))
        led = open_.join(old.select("signature"), "signature", "left_anti").join(gone, "key", "left_anti").select("signature", F.col("key").alias("lead"))
        told = self.keep(firsts.join(led, "signature", "left").select("signature", F.coalesce("had", "lead").alias("edge")))
        # what is left is close to an edge, stored or of this batch, and takes the nearest that is earlier
        left = new.join(told.filter("edge is null").select("signature"), "signature", "left_semi")
        leads = among.join(led.select(F.col("signature").alias("b")), "b", "left_semi").select(F.col("a").alias("signature"), F.struct("far", F.col("other.pos").alias("at"), F.col("other.key").alias("edge")).alias("x"))
        here = left.join(leads, "signature").filter("x.at < pos or (x.at = pos and x.edge <= key)").select("key", "x")
        here = here.union(left.join(old, "signature").select("key", "best")).groupBy("key").agg(F.min("x").alias("x")).select("key", F.col("x.edge").alias("nearest"))
        return new.join(told, "signature").join(here, "key", "left").select("key", "pos", "signature", F.coalesce("edge", "nearest").alias("edge"))

    def summed(self, t: DataFrame, leaders: DataFrame) -> DataFrame:
        """The rows of a batch by edge, in the form that is stored."""
        best = F.struct(F.coalesce("confidence", F.lit(-1.0)).alias("confidence"), "pos")
        sums = t.groupBy("edge").agg(F.count("*").alias("frequency"), F.coalesce(F.sum(1 / F.nullif("confidence", F.lit(0.0))), F.lit(0.0)).alias("parts"), F.count("confidence").alias("rated"), F.max(F.struct(best.alias("best"), *SPO)).alias("x"))
        last = F.row_number().over(Window.partitionBy("edge").orderBy(F.desc("pos")))
        held = t.select("edge", "pos", "source").withColumn("__n", last).filter(F.col("__n") <= self.sources).groupBy("edge").agg(F.array_sort(F.collect_list(F.struct("pos", "source"))).alias("sources"))
        out = sums.join(held, "edge").join(leaders.select("edge", "signature", F.col("pos").alias("pos")), "edge", "left")
        return out.select("edge", *(F.col(f"x.{c}").alias(c) for c in SPO), "signature", "pos", "frequency", "parts", "rated", F.col("x.best").alias("best"), "sources")

    def combined(self, old: DataFrame, new: DataFrame) -> DataFrame:
        """Stored and new sums of each edge: sums add up, the best form and the last sources are those of both."""
        both = old.unionByName(new)
        few = F.slice(F.sort_array(F.flatten(F.collect_list("sources")), asc=False), 1, self.sources)
        sums = both.groupBy("edge").agg(F.max_by("signature", F.col("signature").isNotNull()).alias("signature"), F.min("pos").alias("pos"), F.sum("frequency").alias("frequency"), F.sum("parts").alias("parts"), F.sum("rated").alias("rated"), F.max(F.struct("best", *SPO)).alias("x"), few.alias("sources"))
        return sums.select("edge", *(F.col(f"x.{c}").alias(c) for c in SPO), "signature", "pos", "frequency", "parts", "rated", F.col("x.best").alias("best"), F.array_sort("sources").alias("sources"))
