"""Mixing overlapping sources to target weights by a min-cost flow.

Documents are summed by membership pattern (the set of sources they belong to). A flow routes each pattern's words to the
sources' quotas; a pattern's first copy costs least and each further copy more (convex), so repetition is used only where quotas
need it. A source that shares no document with another has a pattern of its own, whose flow is its quota; only patterns that
link sources, and the sources they link, are solved as a graph. A pattern's flow is met by whole copies of all its documents
and, for the rest, by documents taken in a seeded order: histograms by the leading bits of the order's hash, 256 bins at a time,
find where to stop, and single documents of fitting size close the gap.

Sources, quotas, patterns and stops are tables throughout, of any number of rows. Only the graph reaches the driver, a number a
pattern; its linked part is limited by ``max_linked`` patterns (an error beyond, never a cut). Documents are never ranked
in one task.

Defined results: a null text has size 0 and is never short of its target; a document without sources (null) forms a source of
its own, the last; repeated rows are documents of their own; an empty table gives an empty mix; columns of the input with the
names of the output are replaced.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import hinted, small_side, word_count, written

#: The order's hash has 63 bits; a histogram looks at BITS of them, and so many follow one another.
ORDER_BITS, BITS, LEVELS = 63, 8, 3
#: Rows of a table by pattern or source up to which it is broadcast.
SMALL = 200_000


def key_of(source: Column) -> Column:
    """A source's name as a key that is never null and sorts by code point, null last."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("~"))


def name_of(key: Column) -> Column:
    return F.when(key != "~", F.substring(key, 2, 1 << 30))


def weighed(sources: DataFrame, weights: dict[str | None, float] | None, save) -> DataFrame:
    """Adds the weight: the given one (else 0), or by place in the order of names 1, 2, 3, and so on anew.

    Places come from ranges of names: a row's place is that in its range and the rows of the ranges before.
    """
    if weights is not None:
        given = sources.sparkSession.createDataFrame([("~" if s is None else f"s{s}", float(w)) for s, w in weights.items()], "source string, weight double")
        return sources.join(given, "source", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    ranged = save(sources.repartitionByRange("source").withColumn("part", F.spark_partition_id()))
    held, offset, before = {r.part: r["count"] for r in ranged.groupBy("part").count().collect()}, 0, []  # a row for each partition
    for part in sorted(held):
        before += [F.lit(part), F.lit(offset)]
        offset += held[part]
    if not before:
        return ranged.select("source", "size", F.lit(0.0).alias("weight"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("source")) - 1 + F.element_at(F.create_map(*before), F.col("part"))
    return ranged.select("source", "size", (1.0 + place % 3).alias("weight"))


def targeted(sources: DataFrame, total: float, repeats: int) -> DataFrame:
    """Adds the target: shares of the total by weight; none is above `repeats` times its source's size, and what is cut off is shared anew.

    The water level rises until no further source is full; each rise is one aggregation.
    """
    most = F.col("size") * float(repeats)
    level, full = None, -1
    while True:
        over = F.col("weight") * F.lit(level if level is not None else 0.0) > most
        held, weight, n = sources.filter("weight > 0").agg(F.sum(F.when(over, most)), F.sum(F.when(~over, F.col("weight"))), F.count(F.when(over, 1))).first()
        if n == full or not weight:
            break
        level, full = (total - (held or 0.0)) / weight, n
    share = F.lit(float("inf") if level is None or not weight else level) * F.col("weight")
    return sources.withColumn("target", F.when(F.col("weight") > 0, F.least(share, most)).otherwise(0.0))


def min_cost_flow(supplies: list[int], members: list[list[int]], quotas: list[int], repeats: int) -> list[int]:
    """Words to take from each pattern: as much as the quotas can hold, at the least cost where copy k costs k * k a word.

    Only entering a pattern costs anything, so cheapest paths come copy by copy: a maximum flow with one copy of each pattern, then
    raised with a second, and so on. Each is raised by blocking flows over shortest paths.
    """
    users: list[list[int]] = [[] for _ in quotas]
    for p, own in enumerate(members):
        for s in own:
            users[s].append(p)
    sent = [dict.fromkeys(own, 0) for own in members]
    room = list(quotas)
    for _ in range(repeats):
        spare = list(supplies)
        while (depth := _depths(spare, members, users, sent, room)) is not None:
            _block(spare, members, users, sent, room, *depth)
    return [sum(x.values()) for x in sent]


def _depths(spare, members, users, sent, room) -> tuple[dict[int, int], dict[int, int]] | None:
    """Distances of patterns and sources from the patterns with words left, up to the nearest source with room; None if there is none."""
    deep_p, deep_s = {p: 0 for p, n in enumerate(spare) if n > 0}, {}
    front, d = list(deep_p), 0
    while front:
        reached = []
        for p in front:
            for s in members[p]:
                if s not in deep_s:
                    deep_s[s] = d + 1
                    reached.append(s)
        if any(room[s] > 0 for s in reached):
            return deep_p, deep_s
        d, front = d + 2, []
        for s in reached:
            for p in users[s]:
                if p not in deep_p and sent[p][s] > 0:
                    deep_p[p] = d
                    front.append(p)
    return None


def _block(spare, members, users, sent, room, deep_p, deep_s) -> None:
    """Sends all that shortest paths can carry. Each list of arcs is walked once."""
    at_p, at_s = dict.fromkeys(deep_p, 0), dict.fromkeys(deep_s, 0)
    for start in [p for p, d in deep_p.items() if d == 0]:
        path = [start]  # pattern, source, pattern, source, ...
        while path and spare[start] > 0:
            if len(path) % 2:
                p = path[-1]
                own = members[p]
                while at_p[p] < len(own) and deep_s.get(own[at_p[p]]) != deep_p[p] + 1:
                    at_p[p] += 1
                if at_p[p] == len(own):
                    path.pop()
                    if path:
                        at_s[path[-1]] += 1
                    continue
                path.append(own[at_p[p]])
                continue
            s = path[-1]
            if room[s] > 0:
                x = min([spare[start], room[s], *(sent[path[i + 1]][path[i]] for i in range(1, len(path) - 1, 2))])
                for i in range(0, len(path), 2):
                    sent[path[i]][path[i + 1]] += x
                    if i:
                        sent[path[i]][path[i - 1]] -= x
                spare[start] -= x
                room[s] -= x
                path = [start]
                continue
            while at_s[s] < len(users[s]) and not (deep_p.get(users[s][at_s[s]]) == deep_s[s] + 1 and sent[users[s][at_s[s]]][s] > 0):
                at_s[s] += 1
            if at_s[s] == len(users[s]):
                path.pop()
                at_p[path[-1]] += 1
                continue
            path.append(users[s][at_s[s]])


def routed(patterns: DataFrame, sources: DataFrame, repeats: int, max_linked: int, save) -> DataFrame:
    """(pattern, n, flow) by the min-cost flow over all patterns, or over those of sources that others share where there are too many."""
    quota = F.round("target").cast("long")
    goals = sources.select("source", quota.alias("flow"))
    found, rest = patterns.limit(max_linked + 1).collect(), None
    if len(found) > max_linked:
        several = patterns.filter(F.size("pattern") > 1)
        alone = patterns.filter(F.size("pattern") == 1).withColumn("source", F.col("pattern")[0])
        links = save(several.select(F.explode("pattern").alias("source")).distinct())
        found = save(several.union(alone.join(links, "source", "left_semi").select("pattern", "n"))).limit(max_linked + 1).collect()
        if len(found) > max_linked:
            raise ValueError(f"more than {max_linked} membership patterns link sources")
        rest = alone.join(links, "source", "left_anti").join(goals, "source").select("pattern", "n", F.least("flow", F.col("n") * repeats).alias("flow"))
        goals = goals.join(links, "source", "left_semi")
    found.sort(key=lambda r: r.pattern)
    goal = {r.source: r.flow for r in goals.collect()}  # sources of those patterns
    place = {s: i for i, s in enumerate(sorted(goal))}
    flow = min_cost_flow([r.n for r in found], [[place[s] for s in r.pattern] for r in found], [goal[s] for s in place], repeats)
    solved = patterns.sparkSession.createDataFrame([(r.pattern, r.n, f) for r, f in zip(found, flow, strict=True)], "pattern array<string>, n long, flow long")
    return solved if rest is None else solved.union(rest)


def stopped(docs: DataFrame, plan: DataFrame, save) -> DataFrame:
    """(pattern, whole, cut, gap, fill): the last place that the seeded order takes, and the words still missing then."""
    last = docs.schema["place"].dataType.simpleString()
    state = save(plan.filter("rest > 0").select("pattern", "whole", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before")))
    full = docs.filter("size > 0")
    for k in range(LEVELS):
        inside = full.join(hinted(state, SMALL), "pattern").filter(F.shiftright("order", ORDER_BITS - BITS * k) == F.col("prefix"))
        held = inside.groupBy("pattern", "whole", "rest", "before", F.shiftright("order", ORDER_BITS - BITS * (k + 1)).alias("bin")).agg(F.sum("size").alias("held"))
        upto = held.withColumn("upto", F.col("before") + F.sum("held").over(Window.partitionBy("pattern").orderBy("bin")))  # 2 ** BITS bins a pattern at most
        stop = upto.filter("upto > rest").groupBy("pattern", "whole", "rest").agg(F.min(F.struct("bin", (F.col("upto") - F.col("held")).alias("before"))).alias("x"))
        state = save(stop.select("pattern", "whole", "rest", F.col("x.bin").alias("prefix"), "x.before"))
    shift = ORDER_BITS - BITS * LEVELS
    edge = full.join(hinted(state, SMALL), "pattern").filter(F.shiftright("order", shift) == F.col("prefix"))
    edge = edge.withColumn("upto", F.col("before") + F.sum("size").over(Window.partitionBy("pattern").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)))
    cut = edge.filter("upto <= rest").groupBy("pattern").agg(F.max("place").alias("cut"), F.max("upto").alias("upto"))
    # nulls sort first, so a place of nulls takes no row of its own order
    nothing = F.struct(F.shiftleft("prefix", shift).alias("order"), *(F.lit(None).alias(c) for c in ("doc_id", "size", "key"))).cast(last)
    done = state.join(cut, "pattern", "left").select("pattern", "whole", F.coalesce("cut", nothing).alias("cut"), (F.col("rest") - F.coalesce("upto", "before")).alias("gap"), F.array().cast("array<bigint>").alias("fill"))
    return done.union(plan.filter("rest = 0").select("pattern", "whole", F.lit(None).cast(last), F.lit(0).cast("long"), F.array().cast("array<bigint>")))


def mix(rows: DataFrame, *, weights: dict[str | None, float] | None = None, repeats: int = 3, seed: int = 17, max_linked: int = SMALL) -> tuple[DataFrame, DataFrame]:
    """rows: doc_id, sources (array of strings), size, and others. Returns the rows with `copies` (0 to repeats), and source, source_size and target.

    weights: by source; where absent, sources by code point, null last, weigh 1, 2, 3, and so on anew.
    """
    save = partial(written, name="mix")
    row = F.struct(*(F.col(f"`{c}`") for c in rows.columns if c not in ("sources", "copies"))).alias("row")
    some = F.when(F.size(F.coalesce("sources", F.array())) > 0, F.col("sources")).otherwise(F.array(F.lit(None).cast("string")))
    # the whole row is hashed, so rows that share an id (or have none) do not share a place
    hashed = [F.col(f"`{f.name}`") for f in rows.schema.fields if f.name not in ("sources", "copies") and "map<" not in f.dataType.simpleString()]
    order = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *hashed), 64 - ORDER_BITS)
    named = rows.select(row, "doc_id", "size", F.array_sort(F.array_distinct(F.transform(some, key_of))).alias("pattern"), order.alias("order"), F.monotonically_increasing_id().alias("__key"))
    docs = save(named.withColumn("place", F.struct("order", "doc_id", "size", F.col("__key").alias("key"))))
    lean = docs.select("pattern", "order", "place", "size")
    patterns = save(lean.groupBy("pattern").agg(F.sum("size").alias("n")))
    sources = weighed(patterns.select(F.explode("pattern").alias("source"), "n").groupBy("source").agg(F.sum("n").alias("size")), weights, save)
    sources = save(targeted(save(sources), float(patterns.agg(F.sum("n")).first()[0] or 0), repeats))
    flow = routed(patterns, sources, repeats, max_linked, save)
    plan = save(flow.select("pattern", F.when(F.col("n") > 0, F.floor(F.col("flow") / F.col("n"))).otherwise(0).cast("int").alias("whole"), F.when(F.col("n") > 0, F.col("flow") % F.col("n")).otherwise(0).alias("rest")))
    state = save(stopped(lean, plan, save))

    def taken() -> Column:
        """Whether the seeded order or a fill takes one more copy of a row."""
        return F.coalesce((F.col("size") > 0) & (F.col("place") <= F.col("cut")), F.lit(False)) | F.coalesce(F.array_contains("fill", F.col("place.key")), F.lit(False))

    for _ in range(3):  # the document whose size comes nearest to the gap, if that leaves less of a gap
        if state.filter("gap > 0").isEmpty():
            break
        open_ = lean.join(small_side(state.filter("gap > 0"), SMALL), "pattern").filter("size > 0 and size < 2 * gap").filter(~taken())
        best = open_.groupBy("pattern").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), "place")).alias("x"))
        better = state.join(best, "pattern", "left")
        state = save(better.select("pattern", "whole", "cut", F.coalesce(F.col("gap") - F.col("x.place.size"), F.lit(0)).alias("gap"), F.when(F.col("x").isNotNull(), F.array_append("fill", F.col("x.place.key"))).otherwise(F.col("fill")).alias("fill")))
    out = docs.join(hinted(state, SMALL), "pattern", "left").withColumn("copies", (F.coalesce("whole", F.lit(0)) + taken().cast("int")).cast("int"))
    return out.withColumn("sources", F.transform("pattern", name_of)).select("row.*", "sources", "copies"), sources.select(name_of(F.col("source")).alias("source"), F.col("size").alias("source_size"), "target")


def mix_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", repeats: int = 3, seed: int = 17) -> DataFrame:
    """doc_id, size, source, source_size, target, copies and taken (size times copies) of documents with one source each."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.array(F.col(source_col).cast("string")).alias("sources"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.col(text_col)).alias("__text"))
    mixed, by_source = mix(rows, repeats=repeats, seed=seed)
    known = small_side(by_source.select(F.col("source").alias("s"), "source_size", "target"), SMALL)
    return mixed.join(known, F.col("source").eqNullSafe(F.col("s")), "left").select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))
