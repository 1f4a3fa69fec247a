"""Hierarchical language identification: the family first, then one-versus-one linear support vector machines within it.

Features are hashed byte bigrams and trigrams of the whole text (ASCII lower-cased, other ASCII as one separator), damped and
normalised. The machines are fitted on a bounded sample of labelled rows (``max_train_rows``, spread evenly over the languages,
chosen by the hash of id and text, so reruns agree); every row is predicted.

Defined results: a null text or one without a letter is ``und`` with score 0; so is every row if there is nothing to learn from.
Null languages and ids and texts without a letter do not train; of equal hashes the smaller id trains. Repeated rows get equal answers; other columns are ignored, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import slices, written

#: Families of languages by code (fixed values); a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "semitic": "am ar he mt",
    "indic": "bn gu hi mr ne pa ta te ur",
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
BINS = 4096
#: Bytes whose features are counted at once.
SLICE = 1 << 21

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[:128] = 0
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def family(lang: str) -> str:
    return FAMILY.get(lang, lang)


def _counted(raw: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
    """Counts of bigrams and trigrams by row and bin. A feature that crosses rows is left out."""
    x = _FOLD[raw]
    two = x[:-1] * np.uint32(0x9E3779B1) + x[1:] * np.uint32(0x85EBCA6B)
    three = two[:-1] * np.uint32(0xC2B2AE35) + x[2:] * np.uint32(0x27D4EB2F)
    counts = np.zeros(n_rows * BINS, np.int64)
    for code, span in ((two, 1), (three, 2)):
        ok = (row[span:] == row[:-span]) & ((x[:-span] > 0) | (x[span:] > 0))
        counts += np.bincount(row[:-span][ok] * BINS + (code[ok] >> np.uint32(20)), minlength=n_rows * BINS)
    return counts.reshape(n_rows, BINS)


def features(texts: pa.Array) -> Iterator[np.ndarray]:
    """Normalised features of some consecutive rows at a time; a long text is counted in slices, so memory stays bounded."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32 if texts.type == pa.string() else np.int64)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    sizes, i = np.diff(offsets), 0
    while i < len(sizes):
        j, held = i + 1, sizes[i]
        while j < len(sizes) and j - i < 256 and held + sizes[j] <= SLICE:
            held += sizes[j]
            j += 1
        counts = np.zeros((j - i, BINS), np.int64)
        row = np.repeat(np.arange(j - i), sizes[i:j])
        for a in range(0, int(held), SLICE):
            part = raw[offsets[i] + a : min(offsets[i] + a + SLICE + 2, offsets[j])]  # slices overlap by the two bytes that a trigram reaches over
            if len(part) >= 3:
                counts += _counted(part, row[a : a + len(part)], j - i)
        x = np.sqrt(counts, dtype=np.float32)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-6)
        yield x
        i = j


def svm(x: np.ndarray, y: np.ndarray, *, rounds: int = 80, penalty: float = 1e-3) -> np.ndarray:
    """Weights (the last is the bias) of a linear machine with squared hinge loss; y is -1 or 1, both sides weigh the same."""
    x = np.hstack((x, np.ones((len(x), 1), np.float32)))
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w, v = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32)
    for k in range(rounds):
        ahead = w + k / (k + 3) * (w - v)
        slack = np.maximum(0, 1 - y * (x @ ahead))
        v, w = w, ahead - 0.25 * (penalty * ahead - 2 * x.T @ (share * y * slack))
    return w


@dataclass
class Model:
    """families: names; roots: one machine a family (that family against the rest); pairs: machines (first, second, weights) by family."""

    families: list[str]
    roots: np.ndarray
    members: dict[str, list[str]]
    pairs: dict[str, list[tuple[int, int, np.ndarray]]]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        x = np.hstack((x, np.ones((len(x), 1), np.float32)))
        odds = np.exp(3 * np.clip(x @ self.roots.T, -8, 8))
        odds /= odds.sum(axis=1, keepdims=True)
        best = odds.argmax(axis=1)
        lang, score = [""] * len(x), odds[np.arange(len(x)), best].astype(np.float64)
        for f, name in enumerate(self.families):
            rows = np.flatnonzero(best == f)
            langs = self.members[name]
            votes, belief = np.zeros((len(rows), len(langs))), np.ones((len(rows), len(langs)))
            for a, b, w in self.pairs[name]:
                p = 1 / (1 + np.exp(-6 * np.clip(x[rows] @ w, -5, 5)))
                votes[:, a] += p >= 0.5
                votes[:, b] += p < 0.5
                belief[:, a] = np.minimum(belief[:, a], p)
                belief[:, b] = np.minimum(belief[:, b], 1 - p)
            won = (votes + 0.5 * belief).argmax(axis=1)
            for r, k in zip(rows.tolist(), won.tolist(), strict=True):
                lang[r] = langs[k]
            score[rows] *= belief[np.arange(len(rows)), won]
        return lang, score


def fit(rows: DataFrame, *, max_train_rows: int = 2400, max_languages: int = 1000) -> Model | None:
    """rows: key, lang, text of labelled rows, of which those with a letter train. Each language has its share of the sample, and one row at
    least; more than max_languages are an error.

    Rows are told apart by key, language and text (rows that repeat all three train once), so at most max_train_rows of them are chosen,
    or one for each language if that is more. Texts are hashed, and only those of the sample are read again.
    """
    named = rows.filter(F.col("lang").isNotNull() & F.col("key").isNotNull() & F.col("text").rlike(r"\p{L}")).select("key", "lang", "text", F.xxhash64("text").alias("hash"))
    different = written(named.select("key", "lang", "hash").distinct(), "labelled")
    sizes = {r["lang"]: r["count"] for r in different.groupBy("lang").count().limit(max_languages + 1).collect()}
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not sizes:
        return None
    each = max(1, max_train_rows // len(sizes))
    # only hashes low enough for about four times the sample (and 32 rows more) are ranked, so a frequent language is no hot spot and a rare one is not missed
    draw = F.shiftrightunsigned(F.xxhash64("key", "hash"), 1)
    low = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, (int(min(1.0, (4 * each + 32) / n) * 2**53) << 10) - 1)))
    order = Window.partitionBy("lang").orderBy("draw", "key", "hash")
    drawn = different.withColumn("draw", draw).filter(F.col("draw") <= F.element_at(low, F.col("lang")))
    chosen = drawn.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= each).select("key", "lang", "hash")
    # at most max_train_rows rows (more than one per language only below that), so this side is always small
    sample = named.join(F.broadcast(chosen), ["key", "lang", "hash"], "left_semi").dropDuplicates(["key", "lang", "hash"])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            at = 0
            for x in features(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(x)), pa.array([v.astype(np.float16).tobytes() for v in x], pa.binary())], ["lang", "x"])
                at += len(x)

    found = sample.select("lang", "text").mapInArrow(vectors, "lang string, x binary").collect()
    if not found:
        return None
    found.sort(key=lambda r: (r.lang, bytes(r.x)))
    x = np.stack([np.frombuffer(r.x, np.float16) for r in found]).astype(np.float32)
    y = np.array([r.lang for r in found])
    members: dict[str, list[str]] = {}
    for lang in sorted({*y.tolist()}):
        members.setdefault(family(lang), []).append(lang)
    of = np.array([family(lang) for lang in y.tolist()])
    signs = lambda hit: np.where(hit, 1, -1).astype(np.float32)
    roots = np.stack([svm(x, signs(of == f)) for f in members])
    pairs = {f: [(a, b, svm(x[both], signs(y[both] == langs[a]))) for a, b in combinations(range(len(langs)), 2) for both in [np.isin(y, [langs[a], langs[b]])]] for f, langs in members.items()}
    return Model(list(members), roots, members, pairs)


def predict(rows: DataFrame, model: Model | None, *, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score"), keep_text: bool = False) -> DataFrame:
    """Adds language and score under the given names (replacing such columns). The model is a few machines of BINS weights, whatever the data's size."""
    kept = [c for c in rows.columns if c not in names and (keep_text or c != text_col)]
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in slices(batches, n_kept):
            n = b.num_rows
            langs, scores = ["und"] * n, np.zeros(n)
            if m is not None:
                at = 0
                for x in features(b.column(n_kept)):
                    langs[at : at + len(x)], scores[at : at + len(x)] = m.predict(x)
                    at += len(x)
                for i in np.flatnonzero(~np.asarray(b.column(n_kept + 1))).tolist():
                    langs[i], scores[i] = "und", 0.0
            yield pa.RecordBatch.from_arrays([*b.columns[:n_kept], pa.array(langs, pa.string()), pa.array(scores)], [*kept, *names])

    n_kept = len(kept)
    text = F.col(f"`{text_col}`")
    ready = rows.select(*(F.col(f"`{c}`") for c in kept), F.coalesce(text, F.lit("")).alias("__text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("__letter"))
    schema = T.StructType([*ready.schema.fields[:n_kept], T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    return ready.mapInArrow(told, schema)


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", modulus: int = 5, max_train_rows: int = 2400) -> DataFrame:
    """doc_id, held_out, lang_pred, score. Learns from rows with a language whose crc32(id) % modulus is not 0."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    model = fit(rows.filter(~held_out(F.col("doc_id"), modulus, 0)).select(F.col("doc_id").alias("key"), "lang", "text"), max_train_rows=max_train_rows)
    return predict(rows.select("doc_id", held_out(F.col("doc_id"), modulus, 0).alias("held_out"), "text"), model)


def keep_identified(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", modulus: int = 5, min_score: float = 0.3, max_train_rows: int = 2400) -> DataFrame:
    """The rows, columns unchanged, whose language is told with a score of min_score or more; the others (no letter, no clear language) go."""
    rows = docs.select(F.col(id_col).alias("key"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    model = fit(rows.filter(~held_out(F.col("key"), modulus, 0)), max_train_rows=max_train_rows)
    told = predict(docs, model, text_col=text_col, names=("__lang", "__score"), keep_text=True)
    return told.filter((F.col("__lang") != "und") & (F.col("__score") >= min_score)).select(*docs.columns)
