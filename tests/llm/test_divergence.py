"""The divergence audit against a version in Python's integers."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from corvane.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, part string, slice int"


def brute(rows, min_docs, top):
    docs = [(lang or "", source or "", [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for _, text, lang, source, *_ in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        kept = sorted(t for t, n in Counter(t for d in own for t in set(d[2])).items() if n >= min_docs)
        sources = sorted({d[1] for d in own})

        def parts(some, kept=kept):
            c = Counter(t for d in some for t in d[2] if t in set(kept))
            return c, {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        _, whole = parts(own)
        by = {s: parts([d for d in own if d[1] == s]) for s in sources}
        for s in sources:
            pairs = [(sum(f(by[s][1][t], by[o][1][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(by[s][1][t], whole[t]), t) for t in kept if by[s][0][t] > 0 and by[s][1][t] > whole[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[: None if part == "pair" else top]
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


def made(n, seed=1):
    r = random.Random(seed)
    words = ["Haus", "haus", "éa", "ÉA", "x1y", "a-b", "日本", "𝒳", "\x80z", "_"] + [chr(97 + i) * 2 for i in range(20)]
    text = lambda k: " ".join(r.choice(words[: 8 + 2 * k]) for _ in range(r.randrange(12)))
    return [(i, r.choice([None, "", text(i % 9), text(3)]), r.choice(["de", "de", "en", None, "xx"][: 5 if i % 40 == 0 else 4]), r.choice(["a", "b", "c", "É", "￿", "𝒳", None]), "clash", 1, "clash", 1) for i in range(n)]


def got(spark, rows, min_docs, top, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    return sorted(tuple(r) for r in divergence.audit(df, min_docs=min_docs, top=top, **options).select("lang", "source", "part", "item", "value", "rank").collect())


def test_against_brute_force(spark):
    rows = made(400) + made(30)[:20]  # some rows repeat
    want = brute(rows, 5, 3)
    assert {r[2] for r in want} == {"pair", "term"}
    assert got(spark, rows, 5, 3) == want
    assert got(spark, rows, 5, 3, slice_terms=2) == want  # vocabularies dealt over many slices


def test_languages_without_terms(spark):
    rows = made(60) + [(1000 + i, None, "zz", s, None, None, None, None) for i, s in enumerate(["a", "b", "b", "c"])]
    want = brute(rows, 1000, 3)
    assert want and not any(r[4] for r in want) and {r[0] for r in want} >= {"zz", "de"}
    assert got(spark, rows, 1000, 3) == want


def test_empty_and_long(spark):
    assert got(spark, [], 1, 3) == []
    rows = [(1, "ab cd " * 200_000 + "x" * 100_000, "l", "s", None, None, None, None), (2, "ab", "l", "t", None, None, None, None)]
    assert got(spark, rows, 1, 3) == brute(rows, 1, 3)


def test_counts_beyond_a_long(spark):
    row = spark.createDataFrame([(10**18, 3 * 10**18, 10**6)], "n long, total long, v long")
    assert row.select(divergence.part(F.col("n"), F.col("total"), F.col("v"))).first()[0] == 1 + 10**9 * (10**18 + 2) // (3 * 10**18 + 2 * 10**6)
