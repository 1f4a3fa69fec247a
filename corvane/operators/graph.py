"""Graph operators on edge tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from corvane.shared import bucketed, running


def connected_components(edges: DataFrame, keep: Callable[[DataFrame], DataFrame], *, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; the component is its smallest node.

    Alternates large and small stars: every node's neighbours are hung onto its smallest neighbour until nothing moves, which
    takes few rounds even on long chains. Neighbours are never gathered into a list: each half is a minimum per node (combined
    before the shuffle) joined back to the edges. keep: writes a table and reads it again, which cuts the lineage each round.
    """
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).filter("u > v").distinct()
    e = keep(e)
    mark = None
    for _ in range(max_rounds):
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(now) == mark:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
        mark = tuple(now)
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = keep(large)
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        e = keep(large.join(small, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", "m")).distinct())
    raise RuntimeError("components did not settle")


def nodes_of(t: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """(node, type): all ends of triples; a node without a known type is INFERRED."""
    nodes = t.select(F.explode(F.array("subject", "object")).alias("node")).distinct()
    if types is None:
        return nodes.withColumn("type", F.lit("INFERRED"))
    return nodes.join(types, "node", "left").withColumn("type", F.coalesce("type", F.lit("INFERRED")))


def numbered(t: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(id, name) of all ends of triples, with ids in the order of names, and the distinct (src, dst) by id: rounds over edges then carry no strings."""
    nodes = nodes_of(t).select(F.col("node").alias("name"), F.lit(0).alias("__all"))
    nodes = keep(running(nodes, keep, by=["__all"], order=["name"], into="id").select("id", "name"))
    side = lambda end, c: nodes.select(F.col("name").alias(end), F.col("id").alias(c))
    ends = t.select("subject", "object").join(side("subject", "src"), "subject").join(side("object", "dst"), "object")
    return nodes, keep(ends.select("src", "dst").distinct())


def degrees(t: DataFrame) -> DataFrame:
    """(node, in_degree, out_degree, degree); a loop counts twice."""
    ends = t.select(F.col("subject").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(t.select("object", F.lit(1), F.lit(0)))
    return ends.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.count("*").alias("degree"))


def metrics(t: DataFrame) -> DataFrame:
    """nodes, edges, density of the directed graph, and average degree."""
    d = degrees(t)
    return d.agg(F.count("*").alias("nodes"), F.coalesce((F.sum("degree") / 2).cast("long"), F.lit(0)).alias("edges")).select("nodes", "edges", F.when(F.col("nodes") > 1, F.round(F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1)), 9)).otherwise(0.0).alias("density"), F.when(F.col("nodes") > 0, F.round(2 * F.col("edges") / F.col("nodes"), 6)).otherwise(0.0).alias("average_degree"))


def centrality(t: DataFrame, top: int = 20) -> DataFrame:
    """The nodes of highest degree / (n - 1)."""
    d = degrees(t)
    n = d.agg(F.count("*").alias("n"))
    return d.crossJoin(F.broadcast(n)).select("node", "degree", F.round(F.when(F.col("n") > 1, F.col("degree") / (F.col("n") - 1)).otherwise(0.0), 9).alias("centrality")).orderBy(F.desc("degree"), "node").limit(top)


def statistics(t: DataFrame) -> DataFrame:
    """Counts of triples, subjects, objects, predicates and entities (subjects and objects together)."""
    entities = t.select(F.col("subject").alias("e")).union(t.select("object")).distinct().agg(F.count("*").alias("entities"))
    own = t.agg(F.count("*").alias("triples"), F.countDistinct("subject").alias("subjects"), F.countDistinct("object").alias("objects"), F.countDistinct("predicate").alias("predicates"))
    return own.crossJoin(F.broadcast(entities))


def top_predicates(t: DataFrame, k: int = 10) -> DataFrame:
    """The most frequent predicates, ties by first position."""
    return t.groupBy("predicate").agg(F.count("*").alias("n"), F.min("pos").alias("first")).orderBy(F.desc("n"), "first").limit(k).select("predicate", "n")


def page_rank(t: DataFrame, keep: Callable[[DataFrame], DataFrame], *, rounds: int = 100, damping: float = 0.85, every: int = 5, tolerance: float = 1e-6) -> DataFrame:
    """(node, rank) over distinct edges; the mass of nodes without edges out is dealt to all.

    Rounds end when ranks move by less than tolerance a node in sum (looked at every few rounds), or after the given number;
    tolerance 0 takes them all. keep: writes a table at once and reads it again.
    """
    ids, edges = numbered(t, keep)
    edges = bucketed(edges, "edges", "src", edges.count())
    out = edges.groupBy("src").agg(F.count("*").alias("out"))
    nodes = keep(ids.join(out, F.col("id") == F.col("src"), "left").select("id", "out"))
    n, loose = nodes.agg(F.count("*"), F.count_if(F.isnull("out")) / F.greatest(F.lit(1), F.count("*"))).first()
    ranks = nodes.withColumn("rank", F.lit(1.0 / max(1, n)))
    # what the next round asks of all ranks is summed as they are written, not by reading them again
    asked = [F.sum(F.when(F.isnull("out"), F.col("rank"))).alias("loose")] + ([F.sum(F.abs(F.col("rank") - F.col("was"))).alias("moved")] if tolerance else [])
    for k in range(rounds):
        shares = ranks.filter("out is not null").select(F.col("id").alias("src"), (F.col("rank") / F.col("out")).alias("share"))
        given = edges.join(shares, "src").groupBy(F.col("dst").alias("id")).agg(F.sum("share").alias("got"))
        old = ranks.select("id", "out", *([F.col("rank").alias("was")] if tolerance else []))
        rank = F.lit((1 - damping) / max(1, n)) + damping * (F.coalesce("got", F.lit(0.0)) + F.lit(loose / max(1, n)))
        sums = Observation()
        ranks = keep(old.join(given, "id", "left").select(*old.columns, rank.alias("rank")).observe(sums, *asked))
        loose = sums.get["loose"] or 0.0
        if tolerance and k % every == every - 1 and (sums.get["moved"] or 0.0) < n * tolerance:
            break
    return ranks.join(ids, "id").select(F.col("name").alias("node"), F.round("rank", 9).alias("rank"))


def top_subgraph(t: DataFrame, ranks: DataFrame, top: int = 100) -> DataFrame:
    """Triples whose ends both are among the best nodes."""
    best = F.broadcast(ranks.orderBy(F.desc("rank"), "node").limit(top).select("node"))  # `top` rows
    return t.join(best, t.subject == best.node, "left_semi").join(best, t.object == best.node, "left_semi")


def modularity(t: DataFrame, labels: DataFrame) -> DataFrame:
    """The modularity of a partition (node, community) of the undirected graph without loops: the share of edges inside, less what degrees alone would give."""
    e = t.select(F.least("subject", "object").alias("a"), F.greatest("subject", "object").alias("b")).filter("a <> b").distinct()
    side = lambda c: labels.select(F.col("node").alias(c), F.col("community").alias(f"of_{c}"))
    placed = e.join(side("a"), "a").join(side("b"), "b").select("of_a", "of_b")
    inside = placed.filter("of_a = of_b").groupBy(F.col("of_a").alias("community")).agg(F.count("*").alias("inside"))
    degree = placed.select(F.explode(F.array("of_a", "of_b")).alias("community")).groupBy("community").agg(F.count("*").alias("degree"))
    m = placed.agg(F.count("*").alias("m"))
    part = F.coalesce("inside", F.lit(0)) / F.col("m") - F.pow(F.col("degree") / (2 * F.col("m")), 2)
    return degree.join(inside, "community", "left").crossJoin(F.broadcast(m)).agg(F.round(F.coalesce(F.sum(part), F.lit(0.0)), 9).alias("modularity"))


def communities(t: DataFrame, keep: Callable[[DataFrame], DataFrame], *, rounds: int = 12) -> DataFrame:
    """(node, community) by label propagation: a node takes its neighbours' most frequent label, the smaller of equals.

    In each round only half of the nodes move, chosen by a hash of node and round, so two sides never swap their labels for ever;
    rounds end early when none moves in two of them. Of the labellings seen after even rounds the one of most modularity counts.
    """
    ids, e = numbered(t, keep)
    e = keep(e.filter("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b")).union(e.filter("src <> dst").select("dst", "src")).distinct())
    twice = e.count()
    e = bucketed(e, "edges", "b", twice)
    weights = e.groupBy("b").agg(F.count("*").alias("k"))
    labels = keep(ids.join(weights, ids.id == weights.b, "left").select(F.col("id").alias("node"), "name", F.col("id").alias("community"), F.coalesce("k", F.lit(0)).alias("k")))
    best, most, still, stands = labels, float("-inf"), 0, False
    for k in range(rounds + 1):  # the last only tells what the one before has gained
        votes = e.join(labels.select(F.col("node").alias("b"), "community"), "b").select("a", "community", F.lit(1).alias("n"), F.lit(False).alias("own"))
        votes = votes.union(labels.select("node", "community", F.lit(0), F.lit(True))).repartition("a").groupBy("a", "community").agg(F.sum("n").alias("n"), F.max("own").alias("own"))
        new = votes.groupBy("a").agg(F.min(F.when(F.col("n") > 0, F.struct((-F.col("n")).alias("n"), "community")))["community"].alias("new"), F.max(F.when(F.col("own"), F.col("n"))).alias("held"))
        moves = F.col("new").isNotNull() & (F.pmod(F.xxhash64("name", F.lit(k)), F.lit(2)) == 0)
        after = labels.join(new, labels.node == new.a).select("node", "name", F.when(moves, F.col("new")).otherwise(F.col("community")).alias("community"), "k", "held", F.col("community").alias("was"), (moves & (F.col("new") != F.col("community"))).alias("moved"))
        after = keep(after)
        if stands:  # the modularity of the labels before this round, by what lies inside of them
            sums = after.groupBy("was").agg((F.sum("held") / 2).alias("inside"), F.sum("k").alias("degree"))
            part = F.col("inside") / (twice / 2) - F.pow(F.col("degree") / twice, 2) if twice else F.lit(0.0)
            gained = sums.agg(F.round(F.coalesce(F.sum(part), F.lit(0.0)), 9)).first()[0]
            if gained > most:
                best, most = labels, gained
        if still > 1 or k == rounds:
            break
        still = still + 1 if after.filter("moved").isEmpty() else 0
        labels = after.select("node", "name", "community", "k")
        stands = bool(k % 2) or still > 1 or k == rounds - 1
    of = ids.select(F.col("id").alias("community"), F.col("name").alias("of"))
    return best.join(of, "community").select(F.col("name").alias("node"), F.col("of").alias("community"))


def louvain(t: DataFrame, keep: Callable[[DataFrame], DataFrame], *, rounds: int = 16, levels: int = 10) -> DataFrame:
    """(node, community) by modularity: local moves, then the communities become the nodes of a smaller graph, level after level.

    A move takes a node to the neighbouring community that gains most, where w * 2m - k * total is compared in full (w: weight between
    the node and the community, k: the node's weight, total: the community's, without the node). Nodes move at the same time, a half of
    them in a round, chosen by a hash of node and round; of a level's rounds the one of most modularity counts, and a level ends after three
    rounds in a row without gain. All weights are whole numbers and modularity is compared as a whole number, so the result does not depend on partitions. A community
    is named by its smallest node; nodes without an edge (but loops) stay alone. Neighbours are never gathered: votes are sums per
    node and community. Rounds go over numbered nodes (`numbered`), whose names only decide who moves.
    """
    ids, e = numbered(t, keep)
    pairs = e.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).filter("a <> b").distinct()
    one = F.lit(1).cast("long").alias("w")
    edges = keep(pairs.select("a", "b", one).union(pairs.select("b", "a", one)))
    weights = edges.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("k"))
    nodes = keep(weights.join(ids, "id").select(F.col("id").alias("node"), "name", "k", F.lit(0).cast("long").alias("inner")))
    twice = nodes.agg(F.sum("k")).first()[0] or 0
    places = nodes.select("node", F.col("node").alias("community"))
    if twice:
        most = None
        for level in range(levels):
            count = edges.count()
            edges = bucketed(edges.join(nodes.select(F.col("node").alias("a"), "k"), "a").select("a", "b", "w", "k"), "edges", "b", count)
            labels, gained = _moved(nodes, edges, twice, most, rounds, level, keep)
            if gained == most:
                break
            most = gained
            # the community takes its smallest node's number and name
            named = labels.groupBy("community").agg(F.min("node").alias("first"))
            labels = keep(labels.join(named, "community").select("node", "name", F.col("first").alias("community"), "k", "inner"))
            of = labels.select(F.col("node").alias("__n"), F.col("community").alias("__c"))
            places = keep(places.join(of, F.col("community") == F.col("__n")).select("node", F.col("__c").alias("community")))
            side = lambda end, of=of: of.select(F.col("__n").alias(end), F.col("__c").alias(f"of_{end}"))
            placed = keep(edges.select("a", "b", "w").join(side("b"), "b").join(side("a"), "a").groupBy(F.col("of_a").alias("a"), F.col("of_b").alias("b")).agg(F.sum("w").alias("w")))
            loops = placed.filter("a = b").select(F.col("a").alias("node"), "w")
            merged = labels.groupBy(F.col("community").alias("node")).agg(F.min_by("name", "node").alias("name"), F.sum("k").alias("k"), F.sum("inner").alias("inner"))
            nodes = keep(merged.join(loops, "node", "left").select("node", "name", "k", (F.col("inner") + F.coalesce("w", F.lit(0))).alias("inner")))
            edges = placed.filter("a <> b")
    told = ids.join(places, ids.id == places.node, "left").select("name", F.coalesce("community", "id").alias("community"))
    return told.join(ids.select(F.col("id").alias("community"), F.col("name").alias("of")), "community").select(F.col("name").alias("node"), F.col("of").alias("community"))


def _moved(nodes: DataFrame, edges: DataFrame, twice: int, most: int | None, rounds: int, level: int, keep: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, int | None]:
    """The labels (node, name, community, k, inner) of most modularity that the rounds of a level come to, and that modularity times (2m)^2.

    A round is one written table and one sum over it: the votes tell how much weight lies inside the communities before it. edges: (a, b, w, k),
    with the weight k of a, in buckets by b; they are dealt once a round, by a, where votes are summed and the best is taken.
    """
    square = lambda c: F.sum(F.col(c).cast("decimal(19,0)") * F.col(c).cast("decimal(19,0)"))
    labels = best = nodes.select("node", "name", F.col("node").alias("community"), "k", "inner")
    squares, own = nodes.agg(square("k"), F.sum("inner")).first()
    still = 0
    for turn in range(rounds + 1):  # the last only tells what the one before has gained
        totals = labels.groupBy("community").agg(F.sum("k").alias("total"))
        rated = labels.join(totals, "community")
        votes = edges.join(rated.select(F.col("node").alias("b"), "community", "total"), "b").select("a", "community", "w", "k", "total", F.lit(False).alias("stays"))
        votes = votes.union(rated.select("node", "community", F.lit(0).cast("long"), "k", "total", F.lit(True))).repartition("a")
        votes = votes.groupBy("a", "community").agg(F.sum("w").alias("w"), F.max("k").alias("k"), F.max("total").alias("total"), F.max("stays").alias("stays"))
        gain = F.col("w").cast("double") * twice - F.col("k").cast("double") * (F.col("total") - F.when(F.col("stays"), F.col("k")).otherwise(0))
        wish = votes.withColumn("gain", gain).groupBy("a").agg(F.min(F.struct((-F.col("gain")).alias("loss"), "community")).alias("x"), F.max(F.when(F.col("stays"), F.col("gain"))).alias("stay"), F.max(F.when(F.col("stays"), F.col("w"))).alias("held")).select(F.col("a").alias("node"), "held", F.when(-F.col("x.loss") > F.col("stay"), F.col("x.community")).alias("new"))
        turns = F.pmod(F.xxhash64("name", F.lit(level * 1000 + turn)), F.lit(2)) == 0
        after = keep(labels.join(wish, "node").select("node", "name", F.when(turns & F.col("new").isNotNull(), F.col("new")).otherwise(F.col("community")).alias("community"), "k", "inner", "held", F.col("new").isNotNull().alias("moves")))
        sums = after.groupBy("community").agg(F.sum("k").alias("total"), F.sum("held").alias("held"), F.max("moves").alias("moves"))
        then, held, moves = sums.agg(square("total"), F.sum("held"), F.max("moves")).first()
        gained = (int(own) + int(held)) * twice - int(squares)
        better = most is None or gained > most
        still = 0 if better else still + 1
        if better:
            best, most = labels, gained
        if not moves or still > 2:  # nobody wishes to move, of either half
            break
        labels, squares = after.select("node", "name", "community", "k", "inner"), then
    return best, most


def pruned(nodes: DataFrame, edges: DataFrame, keep: Callable[[DataFrame], DataFrame], position: str) -> DataFrame:
    """nodes without the first third (of their number) of those without an edge."""
    ends = edges.select(F.col("subject").alias("node")).union(edges.select("object")).distinct()
    lone = keep(nodes.join(ends, "node", "left_anti").select("node", F.col(position).alias("__at"), F.lit(0).alias("__all")))
    third = lone.count() // 3
    gone = running(lone, keep, by=["__all"], order=["__at", "node"], into="__n").filter(F.col("__n") <= third)
    return nodes.join(gone.select("node"), "node", "left_anti")


#: Colours by words in a node's label, in this order, and that of all others (fixed values).
COLOURS = (("#3b82f6", ("research", "study", "paper")), ("#ef4444", ("person", "author", "researcher")), ("#10b981", ("technology", "ai", "machine learning")), ("#f59e0b", ("health", "longevity", "biohacking")), ("#8b5cf6", ("company", "organization")))
OTHER_COLOUR = "#6b7280"


def view_nodes(t: DataFrame) -> DataFrame:
    """Nodes to draw: size three times the degree between 5 and 25, colour by words of the label."""
    colour = F.lit(OTHER_COLOUR)
    for c, words in reversed(COLOURS):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(F.lower("node"), F.lit(w))
        colour = F.when(hit, F.lit(c)).otherwise(colour)
    return degrees(t).select("node", F.greatest(F.lit(5), F.least(F.lit(25), F.col("degree") * 3)).cast("long").alias("size"), colour.alias("colour"))


def colour_histogram(t: DataFrame) -> DataFrame:
    return view_nodes(t).groupBy("colour").agg(F.count("*").alias("n"))


def search_nodes(nodes: DataFrame, text: str) -> DataFrame:
    return nodes.filter(F.contains(F.lower("node"), F.lower(F.lit(text))))


def clean_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (pos, source, target, label, predicate) whose ends exist, with a key and a label: label, else predicate, else related_to."""
    kept = edges.join(nodes.select(F.col("node").alias("source")), "source", "left_semi").join(nodes.select(F.col("node").alias("target")), "target", "left_semi")
    return kept.select(F.concat(F.lit("edge-"), F.col("pos").cast("string")).alias("key"), "source", "target", F.coalesce(F.nullif("label", F.lit("")), F.nullif("predicate", F.lit("")), F.lit("related_to")).alias("label"))


def roles(t: DataFrame) -> DataFrame:
    """(node, role): subject, object or both."""
    d = degrees(t)
    return d.select("node", F.when((F.col("in_degree") > 0) & (F.col("out_degree") > 0), "both").when(F.col("out_degree") > 0, "subject").otherwise("object").alias("role"))
