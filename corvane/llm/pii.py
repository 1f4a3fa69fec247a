"""Personal data: base formats by rule, and further spans by gradient boosting over proposed candidates. DataFrame functions only.

Base spans come from four fixed formats with checks. Beside them, generators of high recall propose overlapping candidates:
runs of digits in any grouping, long mixed strings (keys), spelt-out addresses and network addresses. Format and context
features of a candidate go through boosted trees, which are compiled to Column expressions; a span is selected when its margin
passes its generator's threshold. The trees are fitted on the driver to a few hundred rows of seeds, made by rule from fixed
templates, so nothing of the corpus trains them and every run gives the same trees. A threshold is calibrated on the margins that
seeds have under trees which have seen no seed of their template.

Every pattern is written so that a search is linear in the text: runs are tried from their first character only and never given
back, which neither changes the matches nor overflows the matcher's stack on very long runs. So is what follows: offsets, overlaps
and redaction come from running sums and maxima over blocks of an array (`_running`), never from one array grown span by span.

Bounds of what is proposed: a number has 7 to 24 digits, as no telephone, card, account or identity number has fewer or more; a key
has 20 characters or more and a digit; a hardware or network address has 6 to 8 groups of up to 4 hex digits.

Defined results: a null text counts as empty and has no span; repeated rows get equal spans; columns of the input keep their
values except those that a function says it adds, which are replaced; offsets are code points, the end exclusive.
"""

from __future__ import annotations

import json
import random
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL = "A-Za-z0-9._%+-"
#: Base formats in the order of ties: kind, pattern, and what a text must hold to be searched.
BASE = {
    "email": (rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", ""),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
CHECKS = {
    "email": "true",
    "ip": rf"s.hit rlike r'^{OCTET}(?:\.{OCTET}){{3}}$'",
    "card": "length(translate(s.hit, ' -', '')) between 12 and 19 and luhn_check(translate(s.hit, ' -', ''))",
    "phone": "length(regexp_replace(s.hit, '[^0-9]', '')) between 9 and 15",
}
#: Generators: kind and pattern.
PROPOSED = {
    "number": r"(?<![0-9A-Za-z.,])[0-9](?:[\x20().\x2F-]{0,2}[0-9])++",
    "secret": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{20,}+",
    "address": rf"(?<![{LOCAL}])[{LOCAL}]++ ?(?:\[at\]|\(at\)|\{{at\}}| at |＠) ?[A-Za-z0-9-]++(?: ?(?:\.|\[dot\]|\(dot\)|\{{dot\}}| dot ) ?[A-Za-z0-9-]++)++",
    "net": r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{1,4}+){5,7}+(?![0-9A-Za-z:])",
}
#: What a text must hold to be searched for a generator's candidates.
NEEDS = {"number": "[0-9][^0-9]{0,2}[0-9]", "secret": "[0-9]", "address": r"(?:\[at\]|\(at\)|\{at\}| at |＠)", "net": ":[0-9A-Fa-f]{1,4}:"}
#: Words before a span that speak for it, by group (fixed values).
CONTEXT = {
    "3": "token|secret|password|passwd|api|apikey|key|bearer|auth|credential",
    "2": "card|visa|mastercard|account|acct|iban|ssn|passport|credit|debit|social security|konto|cuenta|compte|tarjeta|carte|karte",
    "1": "phone|tel|telephone|mobile|cell|fax|call|whatsapp|email|e-mail|mail|contact|telefon|teléfono|téléphone|handy|ip|host|mac",
}
AGAINST = "version|page|pages|chapter|section|isbn|issn|year|vol|volume|figure|table|order|model|part|no|nr|article|page"


def _running(rows: DataFrame, column: str, value: str, into: str, *, fold: str = "{a} + {b}") -> DataFrame:
    """Adds, for each element x of an array column, what the values of the elements before it come to (0 for the first): sums, or with greatest(...) maxima.

    Each block of 256 is folded by itself, then the blocks' ends, so nothing longer than a block or the list of blocks is ever copied.
    """
    both = lambda a, b: fold.format(a=a, b=b)
    empty = "cast(array() as array<int>)"
    scan = lambda x, v: f"aggregate({x}, named_struct('at', 0, 'out', {empty}), (a, x) -> named_struct('at', {both('a.at', v)}, 'out', concat(a.out, array(a.at))))"
    blocks = f"transform(sequence(0, (size({column}) - 1) div 256), b -> slice({column}, b * 256 + 1, 256))"
    out = rows.withColumn("__w", F.expr(f"case when size({column}) > 0 then transform({blocks}, k -> {scan('k', value)}) end"))
    return out.withColumn(into, F.expr(f"case when __w is null then {empty} else flatten(zip_with(__w, {scan('__w', 'x.at')}.out, (w, s) -> transform(w.out, v -> {both('s', 'v')}))) end")).drop("__w")


def _searched(rows: DataFrame, patterns: dict[str, str], guards: dict[str, str]) -> DataFrame:
    """Adds s_<kind>: the spans of each pattern in __text, with what stands before and after. Texts that fail a guard are not searched, those without a match not split."""
    out = rows.withColumns({f"__h_{k}": F.expr(f"case when {guards[k]} then regexp_extract_all(__text, r'{p}', 0) else cast(array() as array<string>) end") for k, p in patterns.items()})
    out = out.withColumns({f"__g_{k}": F.expr(f"case when size(__h_{k}) > 0 then split(__text, r'{p}', -1) else cast(array() as array<string>) end") for k, p in patterns.items()})
    for k in patterns:
        out = out.withColumn("__l", F.expr(f"zip_with(__h_{k}, slice(__g_{k}, 1, size(__h_{k})), (h, g) -> length(h) + length(g))"))
        out = _running(out, "__l", "x", f"__r_{k}").drop("__l")
        n = F.size(f"__h_{k}")
        parts = F.arrays_zip(F.col(f"__h_{k}").alias("hit"), F.slice(f"__g_{k}", F.lit(1), n).alias("gap"), F.slice(f"__g_{k}", F.lit(2), n).alias("next"), F.col(f"__r_{k}").alias("run"))
        out = out.withColumn(f"s_{k}", F.transform(parts, lambda z: F.struct((z.run + F.length(z.gap)).alias("start"), (z.run + F.length(z.gap) + F.length(z.hit)).alias("stop"), z.hit.alias("hit"), F.right(z.gap, F.lit(24)).alias("before"), F.left(z["next"], F.lit(4)).alias("after"))))
    return out.drop(*(f"__{x}_{k}" for k in patterns for x in "hgr"))


def with_base(docs: DataFrame, text_col: str) -> DataFrame:
    """Adds __text and __base: array of (start, ord, stop, kind), in order of start and kind."""
    out = docs.withColumn("__text", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    out = _searched(out, {k: p for k, (p, _) in BASE.items()}, {k: f"instr(__text, '{needed}') > 0" if needed else "__text rlike '[0-9](?:[ -]?[0-9]){11}'" for k, (_, needed) in BASE.items()})
    found = [F.expr(f"transform(filter(s_{kind}, s -> {CHECKS[kind]}), s -> named_struct('start', s.start, 'ord', {k}, 'stop', s.stop, 'kind', '{kind}'))") for k, kind in enumerate(BASE)]
    out = out.withColumn("__base", F.array_sort(F.concat(*found)))
    return out.drop(*(f"s_{k}" for k in BASE))


#: Features of a candidate c, as SQL over its kind, hit, before and after.
FEATURES = {
    "kind": "c.ord",
    "digits": "least(40, length(regexp_replace(c.hit, '[^0-9]', '')))",
    "length": "least(80, length(c.hit))",
    "letters": "least(40, length(regexp_replace(c.hit, '[^A-Za-z]', '')))",
    "groups": "least(9, size(split(c.hit, '[^0-9]+')))",
    "luhn": "int(luhn_check(regexp_replace(c.hit, '[^0-9]', '')))",
    "context": "case " + " ".join(f"when lower(c.before) rlike '(?:^|[^a-z])(?:{words})[^a-z0-9]{{0,6}}$' then {k}" for k, words in CONTEXT.items()) + f" when lower(c.before) rlike '(?:^|[^a-z])(?:{AGAINST})[^a-z0-9]{{0,3}}$' then -1 else 0 end",
    "joined": "int(c.before rlike '[A-Za-z0-9_.,/-]$') + 2 * int(c.after rlike '^[A-Za-z0-9_%/-]')",
    "opened": "int(c.before rlike '[=:\"(]\\\\s*$')",
    "hexed": "int(c.hit rlike '^[0-9A-Fa-f]+$')",
    "variety": "least(20, size(array_distinct(split(c.hit, ''))))",
    "dated": "int(c.hit rlike '^(?:(?:19|20)[0-9]{2}[./-]|[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)?[0-9]{2}(?![0-9]))')",
    "spelt": "int(lower(c.hit) rlike '[(\\\\[{]at[)\\\\]}]| dot |[(\\\\[{]dot[)\\\\]}]')",
}


def with_candidates(rows: DataFrame) -> DataFrame:
    """From __text, adds __cand: array of candidates with their features."""
    out = _searched(rows, PROPOSED, {k: f"__text rlike r'{NEEDS[k]}'" for k in PROPOSED})
    whole = {"number": "length(regexp_replace(s.hit, '[^0-9]', '')) between 7 and 24"}
    kinds = [F.expr(f"transform(filter(s_{kind}, s -> {whole.get(kind, 'true')}), s -> named_struct('ord', {len(BASE) + k}, 'kind', '{kind}', 'start', s.start, 'stop', s.stop, 'hit', s.hit, 'before', s.before, 'after', s.after))") for k, kind in enumerate(PROPOSED)]
    out = out.withColumn("__cand", F.concat(*kinds))
    told = ", ".join(f"'{n}', cast({x} as int)" for n, x in FEATURES.items())
    out = out.withColumn("__cand", F.expr(f"transform(__cand, c -> named_struct('start', c.start, 'ord', c.ord, 'stop', c.stop, 'name', c.kind, 'f', named_struct({told})))"))
    return out.drop(*(f"s_{k}" for k in PROPOSED))


def seeds(per_template: int = 12, seed: int = 7) -> list[tuple[int, str, int]]:
    """(template, text, whether its candidate is personal): fixed templates filled by a seeded generator."""
    r = random.Random(seed)
    n = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    h = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    m = lambda k: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(k - 4)) + n(2) + "xQ"
    w = lambda: "".join(r.choice(["tion", "er", "an", "le", "st", "ou", "de", "en", "ra"]) for _ in range(r.randint(2, 4)))
    good = [
        lambda: f"{w()} {n(16)} {w()}", lambda: f"{w()} {n(16)}. {w()}", lambda: f"{n(16)}{r.choice(['###', '$$$', '!!', ','])} {w()}", lambda: f"{w()} {n(4)}.{n(4)}.{n(4)}.{n(4)} {w()}", lambda: f"card {n(4)} {n(6)} {n(5)} {w()}", lambda: f"{w()} {n(4)} {n(4)} {n(4)} {n(4)} {w()}",
        lambda: f"call ({n(3)}) {n(3)}-{n(4)} {w()}", lambda: f"phone: {n(3)}-{n(3)}-{n(4)}", lambda: f"{w()} ({n(3)}) {n(3)}-{n(4)} {w()}", lambda: f"tel 0{n(2)} {n(4)} {n(4)}", lambda: f"ssn {n(3)}-{n(2)}-{n(4)}", lambda: f"account {n(10)} {w()}", lambda: f"mobile {n(10)}",
        lambda: f'token = "{h(40)}" {w()}', lambda: f"api key: {m(32)}", lambda: f"password={m(24)} {w()}", lambda: f"secret {h(32)}", lambda: f'{w()} = "{h(40)}"', lambda: f"bearer {m(40)}", lambda: f"{w()} {h(64)} {w()}",
        lambda: f"Telefon: 0{n(3)} {n(7)}", lambda: f"Handy 01{n(2)}/{n(8)} {w()}", lambda: f"téléphone 0{n(1)} {n(2)} {n(2)} {n(2)} {n(2)}", lambda: f"teléfono {n(3)} {n(3)} {n(3)}, {w()}", lambda: f"whatsapp {n(3)} {n(4)} {n(4)}",
        lambda: f"Konto {n(10)} {w()}", lambda: f"tarjeta {n(4)} {n(4)} {n(4)} {n(4)}", lambda: f"carte: {n(16)}", lambda: f"passport {n(9)}", lambda: f"{w()} {n(4)}-{n(4)}-{n(4)}-{n(4)} {w()}", lambda: f"{w()} {n(15)} {w()}", lambda: f"{w()} {n(16)}; {w()}",
        lambda: f"auth: {h(48)}", lambda: f"credential {m(28)} {w()}", lambda: f"apikey={h(32)}", lambda: f"{w()}: {m(36)}", lambda: f"passwd: {m(20)}", lambda: f"{w()} {m(44)} {w()}",
        lambda: f"{w()}{n(2)} [at] {w()} [dot] com", lambda: f"{w()}_{w()} {{at}} {w()} {{dot}} net", lambda: f"contact {w()} at {w()} dot org", lambda: f"{w()}[at]{w()}[dot]de", lambda: f"ip {':'.join(h(4) for _ in range(8))} {w()}", lambda: f"{w()} {':'.join(h(2) for _ in range(6))} {w()}", lambda: f"{w()}.{w()} (at) {w()}.org", lambda: f"mail {w()}{n(2)} at {w()} dot com", lambda: f"mac {':'.join(h(2) for _ in range(6))} {w()}", lambda: f"host {':'.join(h(4) for _ in range(8))}",
    ]
    bad = [
        lambda: f"{w()} 20{n(2)}-{r.randint(10, 12)}-{r.randint(10, 28)} {w()}", lambda: f"{w()} {r.randint(10, 28)}.{r.randint(10, 12)}.19{n(2)} {w()}", lambda: f"version {n(1)}.{n(2)}.{n(4)}.{n(3)}", lambda: f"pages {n(3)}-{n(4)} {w()}", lambda: f"isbn {n(3)}-{n(1)}-{n(3)}-{n(5)}-{n(1)}", lambda: f"order {n(8)} {w()}", lambda: f"{w()} {n(3)} {n(3)} {n(3)} {w()}",
        lambda: f"{w()} 20{n(2)}-{r.randint(10, 12)}-{r.randint(10, 28)} {r.randint(10, 23)}:{n(2)} {w()}", lambda: f"{w()} {r.randint(10, 28)}.{r.randint(10, 12)}.20{n(2)} {r.randint(10, 23)}:{n(2)}", lambda: f"{w()} {r.randint(1, 99)} {n(3)} {n(3)} {n(3)} {w()}",
        lambda: f"{w()} {n(7)} {w()}", lambda: f"no {n(9)} {w()}", lambda: f"{w()} 19{n(2)} - 20{n(2)} {w()}", lambda: f"{w()} 20{n(2)}/20{n(2)} {w()}", lambda: f"{w()} {n(8)} {w()}",
        lambda: f"{w()}-{w()}-{w()}-{w()}-{n(1)}{w()} {w()}", lambda: f"the {w()}_{w()}_{w()}_{w()}_{n(2)} {w()}", lambda: f"{w()}{w()}{w()}{w()}{w()}{w()}2 {w()}",
        lambda: f"volume {n(2)}, page {n(3)} {n(4)}", lambda: f"model {n(4)}-{n(4)} {w()}", lambda: f"{w()} {n(1)} {n(3)} {n(3)} {w()}", lambda: f"table {n(3)} {n(3)} {n(3)} {w()}", lambda: f"{r.randint(10, 28)}/{r.randint(10, 12)}/20{n(2)} {r.randint(10, 23)}:{n(2)} {w()}", lambda: f"issn {n(4)}-{n(4)}", lambda: f"figure {n(7)} {w()}", lambda: f"in 19{n(2)}, 20{n(2)} {w()}",
        lambda: f"{w()}-{w()}-{w()}-{w()}-20{n(2)}-{w()}", lambda: f"{w()}_{w()}_{w()}_{w()}_{w()}{n(1)} {w()}", lambda: f"{w()}{w()}{w()}{w()}{w()}{w()}{n(1)}{w()} {w()}", lambda: f"{'a' + w()}-{w()}-{w()}-{w()}{n(2)}-{w()} {w()}",
        lambda: f"{w()} at {w()}.{w()} {w()}", lambda: f"look at {w()}.{w()}. {w()}", lambda: f"{w()} {w()} at {w()}.", lambda: f"{n(2)}:{n(2)}:{n(2)}:{n(2)}:{n(2)}:{n(2)} {w()}", lambda: f"the {w()} at {w()}. {w()}", lambda: f"{w()} at {w()} .{w()}", lambda: f"at {w()} at {w()}.{w().capitalize()}", lambda: f"{w()} {n(2)}:{n(2)}:{n(2)}:{n(2)}:{n(2)}:{n(2)}:{n(2)} {w()}",
    ]
    return [(k, f(), y) for k, (f, y) in enumerate([*((f, 1) for f in good), *((f, 0) for f in bad)]) for _ in range(per_template)]


@dataclass
class Model:
    """Depth-two trees: (feature, at most, left (feature, at most, leaf, leaf), right (same)); margin thresholds by generator."""

    trees: list[tuple]
    thresholds: dict[str, float]

    def margin(self, c: str) -> str:
        """SQL of the summed trees for a candidate named c."""
        leaf = lambda x: f"{x:.6f}D"
        stump = lambda s: f"case when {c}.f.{s[0]} <= {s[1]} then {leaf(s[2])} else {leaf(s[3])} end"
        return " + ".join(f"(case when {c}.f.{f} <= {at} then {stump(a)} else {stump(b)} end)" for f, at, a, b in self.trees)

    def selected(self, c: str) -> str:
        return f"({self.margin(c)}) > case {c}.name {' '.join(f"when '{k}' then {t:.6f}D" for k, t in self.thresholds.items())} end"


def boosted(x: np.ndarray, y: np.ndarray, names: list[str], trees: int, rate: float) -> list[tuple]:
    """Gradient boosting of the logistic loss with trees of depth two, each the best of all pairs of cuts by second-order gain."""
    cuts = [(f, at) for f in range(x.shape[1]) for at in np.unique(x[:, f])[:-1].tolist()]
    z, score, out = np.stack([x[:, f] <= at for f, at in cuts], axis=1).astype(float), np.zeros(len(y)), []
    value = lambda g, h: g * g / (h + 1.0)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        # sums below each cut (columns) among the rows below each cut (rows), and among the others
        low, high = [], []
        for v in (g, h):
            one, both = z.T @ v, z.T @ (z * v[:, None])
            low.append((both, one[:, None] - both))
            high.append((one[None, :] - both, v.sum() - one[:, None] - one[None, :] + both))
        gain = [value(s[0][0], s[1][0]) + value(s[0][1], s[1][1]) for s in (low, high)]
        root = int((gain[0].max(axis=1) + gain[1].max(axis=1)).argmax())
        sides = []
        for s, of in ((low, gain[0]), (high, gain[1])):
            k = int(of[root].argmax())
            leaf = [rate * s[0][i][root, k] / (s[1][i][root, k] + 1.0) for i in (0, 1)]
            sides.append((names[cuts[k][0]], cuts[k][1], *leaf))
        out.append((names[cuts[root][0]], cuts[root][1], *sides))
        score = score + _apply(out[-1:], x, names)
    return out


def _apply(trees: list[tuple], x: np.ndarray, names: list[str]) -> np.ndarray:
    col = {n: x[:, i] for i, n in enumerate(names)}
    side = lambda s: np.where(col[s[0]] <= s[1], s[2], s[3])
    return sum((np.where(col[f] <= at, side(a), side(b)) for f, at, a, b in trees), np.zeros(len(x)))


_FITTED: dict[tuple, Model] = {}


def fit(spark: SparkSession, *, trees: int = 16, rate: float = 0.4, precision: float = 0.97, folds: int = 5) -> Model:
    """Trees from all seeds; each generator's threshold is the lowest margin that keeps `precision` among seeds whose template the trees had not seen."""
    if (key := (trees, rate, precision, folds)) in _FITTED:
        return _FITTED[key]
    made = seeds()
    rows = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps([{"i": i, "__text": t, "y": y} for i, t, y in made])), "array<struct<i: int, __text: string, y: int>>")).alias("s")).select("s.*")
    found = with_candidates(rows).select("i", "y", F.explode("__cand").alias("c")).select("i", "y", "c.name", "c.f.*").collect()
    names = list(FEATURES)
    x, y = np.array([[r[n] for n in names] for r in found]), np.array([r.y for r in found])
    template, kind = np.array([r.i for r in found]), np.array([r["name"] for r in found])
    margin = np.zeros(len(found))
    for k in range(folds):
        out = template % folds == k
        margin[out] = _apply(boosted(x[~out], y[~out].astype(float), names, trees, rate), x[out], names)
    thresholds = {}
    for k in PROPOSED:
        cut = 50.0
        for t in sorted({*margin[kind == k].tolist()}, reverse=True):
            over = (kind == k) & (margin >= t)
            if y[over].mean() < precision:
                break
            cut = t - 1e-6
        thresholds[k] = cut
    _FITTED[key] = Model(boosted(x, y.astype(float), names, trees, rate), thresholds)
    return _FITTED[key]


def with_spans(docs: DataFrame, text_col: str = "text", model: Model | None = None) -> DataFrame:
    """Adds __text, __base and __spans: all spans (start, ord, stop, kind); an added one never overlaps a base span."""
    model = model or fit(docs.sparkSession)
    out = with_candidates(with_base(docs, text_col))
    out = out.withColumn("__cand", F.expr(f"filter(__cand, c -> {model.selected('c')})"))
    # the ends of candidates among the starts of base spans: a candidate is free if all base spans that start before its end stop before its start
    both = "size(__base) > 0 and size(__cand) > 0"
    out = out.withColumn("__ends", F.expr(f"""case when {both} then array_sort(concat(
        transform(__base, b -> named_struct('at', b.start, 'base', 1, 'i', -1, 'stop', b.stop)),
        transform(__cand, (c, i) -> named_struct('at', c.stop, 'base', 0, 'i', i, 'stop', 0)))) else cast(array() as array<struct<at: int, base: int, i: int, stop: int>>) end"""))
    out = _running(out, "__ends", "x.stop", "__most", fold="greatest({a}, {b})")
    out = out.withColumn("__order", F.expr("array_sort(filter(zip_with(__ends, __most, (e, m) -> named_struct('i', e.i, 'most', m)), x -> x.i >= 0))"))
    free = "case when size(__ends) = 0 then __cand else filter(zip_with(__cand, __order, (c, o) -> case when o.most <= c.start then c end), c -> c is not null) end"
    out = out.withColumn("__more", F.expr(f"transform({free}, c -> named_struct('start', c.start, 'ord', c.ord, 'stop', c.stop, 'kind', c.name))"))
    return out.withColumn("__spans", F.expr("case when size(__more) = 0 then __base else array_sort(concat(__base, __more)) end")).drop("__cand", "__more", "__ends", "__most", "__order")


def joined(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.stop)), ',')")


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base counts by kind, base_sha256, all spans of each row and their number; redact() replaces these spans."""
    rows = with_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    counts = [F.expr(f"cast(size(filter(__base, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in BASE]
    return rows.select("doc_id", *counts, F.sha2(joined("__base"), 256).alias("base_sha256"), joined("__spans").alias("spans"), F.size("__spans").cast("long").alias("n_spans"))


def redact(docs: DataFrame, *, text_col: str = "text", piece: int = 4096) -> DataFrame:
    """The rows with each span of their text replaced by its kind in brackets; overlapping spans become one. Null texts stay null.

    The text is cut into pieces once, so that what stands between two spans is read from their pieces and not from the text's start.
    """
    columns = docs.columns
    rows = _running(with_spans(docs, text_col), "__spans", "x.stop", "__most", fold="greatest({a}, {b})")
    # of overlapping spans the first counts; what was covered before it ends where the text goes on
    rows = rows.withColumn("__first", F.expr("filter(zip_with(__spans, __most, (s, m) -> named_struct('at', m, 'start', s.start, 'kind', s.kind)), x -> x.start >= x.at)"))
    rows = rows.withColumn("__end", F.expr("array_max(transform(__spans, s -> s.stop))"))
    rows = rows.withColumn("__cut", F.expr(f"case when size(__spans) > 0 then regexp_extract_all(__text, r'(?s).{{1,{piece}}}', 0) end"))

    def between(a: str, b: str) -> str:
        i, j, k = f"({a} div {piece})", f"(({b} - 1) div {piece})", f"{a} % {piece} + 1"
        return f"""case when {b} <= {a} then '' when {i} = {j} then substring(__cut[{i}], {k}, {b} - {a})
            else concat(substring(__cut[{i}], {k}), array_join(slice(__cut, {i} + 2, {j} - {i} - 1), ''), substring(__cut[{j}], 1, ({b} - 1) % {piece} + 1)) end"""

    cleaned = F.expr(f"concat(array_join(transform(__first, x -> concat({between('x.at', 'x.start')}, '[', upper(x.kind), ']')), ''), {between('__end', 'length(__text)')})")
    return rows.withColumn(text_col, F.when(F.size("__spans") > 0, cleaned).otherwise(F.col(text_col))).select(*columns)
