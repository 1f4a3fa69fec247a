"""Exact top-k by inner product: dual-tree search over cover trees.

Rows are dealt by their nearest pivot (a few rows of smallest hash) into blocks of bounded size, and each block becomes a cover
tree: nodes of one level lie further apart than the level's distance, and none is further from its parent than the distance of the
level above. Queries are indexed in the same way, a tree for each pivot's queries. A pair of a query node and a candidate node is
dropped when no point of the candidate node can reach the worst k-th score of the query node's group, as the covering radii bound
it (|q p| <= q0 p0 + r |p0| + s |q0| + r s). Near the leaves each query is held against the candidate radii by itself.

First each query tree searches the candidates of its own pivot, which gives it its worst scores. Then the roots of all other
candidate trees are held against them, and only trees that may still help are sent to a block of queries, the most promising
first. Equal vectors of a block are one point that keeps the ids it may need. The queries are a stated set, held against all rows
in blocks of fixed size; no row meets another outside such a pair of blocks.

Where vectors keep the same distance from one another, as random ones do, no radius excludes anything and all pairs are scored.

Defined results: vectors that are null, empty or hold null or non-finite components take no part; nor do rows without an id; a
query is never its own candidate, nor is any row with its id; ties go to the smaller id; fewer than k candidates give fewer
rows; rows that repeat both id and vector count once; vectors of differing length are an error, as are those whose products may
pass a long; other columns are ignored, so names cannot clash.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import lean, written

#: Points of a leaf at most, unless they are too near to part.
LEAF = 32
#: Products of whole numbers up to this size add up exactly in doubles; beyond, longs are used up to their own limit.
EXACT, LONGEST = 2.0**53, 2.0**63
#: Distances between levels of a tree.
BASE = 1.5
#: Points or queries of a matrix product at most.
WIDE = 512
#: Pivots at most; candidates of one pivot beyond a block's size are dealt by hash.
PIVOTS = 1024


def distances(a: np.ndarray, a2: np.ndarray, b: np.ndarray, b2: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(a2[:, None] + b2[None, :] - 2 * (a @ b.T), 0))


class Tree:
    """Cover tree of the distinct points x (n x d). By node: centre, radius (to its farthest point), level's distance, children, and the points of a leaf."""

    def __init__(self, x: np.ndarray):
        self.x, self.square = x, (x * x).sum(axis=1)
        self.norm = np.sqrt(self.square)
        self.centre: list[int] = []
        self.scale: list[float] = []
        self.children: list[list[int]] = []
        self.points: list[np.ndarray] = []
        if len(x):
            self._grow()
        self._close()

    def _node(self, centre: int, scale: float) -> int:
        self.centre.append(centre)
        self.scale.append(scale)
        self.children.append([])
        self.points.append(np.zeros(0, np.int64))
        return len(self.centre) - 1

    def _far(self, rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return distances(self.x[rows], self.square[rows], self.x[centres], self.square[centres])

    def _net(self, rows: np.ndarray, held: np.ndarray, goal: float) -> np.ndarray:
        """Rows to add to the held centres, each further than goal from all others, until every row is within goal of one."""
        out = held
        for a in range(0, len(rows), WIDE):
            part = rows[a : a + WIDE]
            part = part[self._far(part, out).min(axis=1) > goal]
            near = self._far(part, part) <= goal
            open_, new = np.ones(len(part), bool), []
            for i in range(len(part)):
                if open_[i]:
                    new.append(part[i])
                    open_ &= ~near[i]
            out = np.concatenate((out, np.array(new, np.int64)))
        return out[len(held) :]

    def _nearest(self, rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        owner, far = np.empty(len(rows), np.int64), np.empty(len(rows))
        for a in range(0, len(rows), WIDE):
            d = self._far(rows[a : a + WIDE], centres)
            owner[a : a + WIDE] = d.argmin(axis=1)
            far[a : a + WIDE] = d.min(axis=1)
        return owner, far

    def _grow(self) -> None:
        """Level by level: the centres of a level stay centres of the next, which adds more at a smaller distance."""
        rows = np.arange(len(self.x))
        middle = self.x.mean(axis=0)
        centres = np.array([int((self.square - 2 * (self.x @ middle)).argmin())])
        owner, far = self._nearest(rows, centres)
        nodes = [self._node(int(centres[0]), float(far.max()))]
        tiny = 1e-7 * (1 + float(self.norm.max()))
        while len(rows):
            size = np.bincount(owner, minlength=len(centres))
            most = np.zeros(len(centres))
            np.maximum.at(most, owner, far)
            done = (size <= LEAF) | (most <= tiny)
            order = np.argsort(owner, kind="stable")
            cuts = np.concatenate(([0], np.cumsum(size)))
            for k in np.flatnonzero(done).tolist():
                self.points[nodes[k]] = rows[order[cuts[k] : cuts[k + 1]]]
            on = ~done[owner]
            rows, owner, far = rows[on], owner[on], far[on]
            if not len(rows):
                break
            live = np.flatnonzero(~done)
            place = np.full(len(centres), -1)
            place[live] = np.arange(len(live))
            parents, centres, owner = [nodes[k] for k in live.tolist()], centres[live], place[owner]
            goal = float(far.max()) / BASE
            new = self._net(rows, centres, goal)
            above = dict(zip(rows.tolist(), owner.tolist(), strict=True))
            nodes = []
            for k, c in enumerate(np.concatenate((centres, new)).tolist()):
                up = parents[k] if k < len(parents) else parents[above[c]]
                nodes.append(self._node(c, goal))
                self.children[up].append(nodes[-1])
            centres = np.concatenate((centres, new))
            owner, far = self._nearest(rows, centres)
            # rounding may leave a centre with another of its own point
            at = {c: k for k, c in enumerate(centres.tolist())}
            for i in np.flatnonzero(np.isin(rows, centres)).tolist():
                owner[i], far[i] = at[int(rows[i])], 0.0

    def _close(self) -> None:
        """Radii from the leaves upwards, and arrays of children."""
        n = len(self.centre)
        self.rows: list[np.ndarray] = [np.zeros(0, np.int64)] * n
        self.radius = np.zeros(n)
        for k in range(n - 1, -1, -1):  # children come after their parents
            own = self.points[k] if not self.children[k] else np.concatenate([self.rows[c] for c in self.children[k]])
            self.rows[k] = own
            far = self._far(own, np.array([self.centre[k]]))
            self.radius[k] = float(far.max(initial=0)) * (1 + 1e-7) + 1e-6
        self.kids = [np.array(c, np.int64) for c in self.children]
        self.at = np.array(self.centre, np.int64)
        #: Leaves, and nodes that fall apart into leaves of hardly more than a point: their points are held one by one against the candidates' radii.
        self.low = [not any(self.children[c] for c in kids) and (not kids or 2 * len(kids) > len(self.rows[k])) for k, kids in enumerate(self.children)]


class Points:
    """A tree with the ids of its points: those of point p are ids[at[p]:at[p + 1]], ascending."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, keep: int):
        """Of equal vectors the `keep` smallest ids are kept, as more can never be among the answers."""
        order = np.lexsort((ids, *x.T[::-1])) if len(ids) else np.zeros(0, np.int64)
        ids, x = ids[order], x[order]
        once = np.concatenate(([True], (ids[1:] != ids[:-1]) | (x[1:] != x[:-1]).any(axis=1))) if len(ids) else np.zeros(0, bool)
        ids, x = ids[once], x[once]
        new = np.concatenate(([True], (x[1:] != x[:-1]).any(axis=1))) if len(ids) else np.zeros(0, bool)
        first, group = np.flatnonzero(new), np.cumsum(new) - 1
        kept = np.arange(len(ids)) - first[group] < keep if len(ids) else new
        self.tree, self.ids, self.at = Tree(x[first]), ids[kept], np.searchsorted(group[kept], np.arange(len(first) + 1))


class Search:
    """The queries of a tree and the best candidates found for each so far: a heap of (score, -id), worst first."""

    def __init__(self, asked: Points, k: int, best: list[list[tuple[int, int]]] | None = None):
        self.asked, self.k = asked, k
        self.best = best or [[] for _ in range(len(asked.ids))]
        self.owners = [range(asked.at[p], asked.at[p + 1]) for p in range(len(asked.tree.x))]
        self.worst = np.array([self._least(p) for p in range(len(self.owners))])
        #: Products of a query with a candidate, and with a candidate node's centre.
        self.scored = self.bounded = 0

    def _least(self, p: int) -> float:
        return min((float(self.best[r][0][0]) if len(self.best[r]) == self.k else -np.inf for r in self.owners[p]), default=np.inf)

    def reach(self, q: int, tree: Tree, nodes: np.ndarray) -> np.ndarray:
        """What a pair of a point of query node q and one of each candidate node can score at most."""
        own = self.asked.tree
        a, r, b, s = own.at[q], own.radius[q], tree.at[nodes], tree.radius[nodes]
        most = tree.x[b] @ own.x[a] + r * tree.norm[b] + s * own.norm[a] + r * s
        return most + 1e-9 * (1 + np.abs(most))

    def run(self, found: Points) -> None:
        """Improves the best by the candidates of one tree, pairs of nodes in the order of their bounds."""
        own, tree = self.asked.tree, found.tree
        if not len(own.x) or not len(tree.x):
            return
        size = max(float(np.abs(own.x).max()), 1) * max(float(np.abs(tree.x).max()), 1) * own.x.shape[1]
        if size >= LONGEST:
            raise ValueError("scores may pass a long")
        self.whole = size < EXACT
        heap, turn = [(-float(self.reach(0, tree, np.zeros(1, np.int64))[0]), 0, 0, 0)], 0
        while heap:
            top, _, q, p = heapq.heappop(heap)
            if -top < self.worst[own.rows[q]].min():
                continue
            if own.low[q]:
                pairs = self._expand(q, found, p)
            elif len(tree.kids[p]) and tree.radius[p] * own.norm[own.at[q]] >= own.radius[q] * tree.norm[tree.at[p]]:
                pairs = [(m, q, c) for m, c in zip(self.reach(q, tree, tree.kids[p]).tolist(), tree.kids[p].tolist(), strict=True)]
            else:
                pairs = [(float(self.reach(c, tree, np.array([p]))[0]), c, p) for c in own.kids[q].tolist()]
            for most, a, b in pairs:
                if most >= self.worst[own.rows[a]].min():
                    turn += 1
                    heapq.heappush(heap, (-most, turn, a, b))

    def _expand(self, q: int, found: Points, p: int) -> list[tuple[float, int, int]]:
        """Scores the leaves below a candidate node that may help a query of q; returns its other children, with their bounds."""
        own, tree, rows = self.asked.tree, found.tree, self.asked.tree.rows[q]
        if not len(tree.kids[p]):
            self._score(rows, found, tree.points[p])
            return []
        kids = tree.kids[p]
        leaf = np.array([not len(tree.kids[c]) for c in kids.tolist()])
        most = np.full(len(kids), -np.inf)
        for a in range(0, len(rows), WIDE):
            part = rows[a : a + WIDE]
            b = own.x[part] @ tree.x[tree.at[kids]].T + own.norm[part][:, None] * tree.radius[kids][None, :]
            b += 1e-9 * (1 + np.abs(b))
            self.bounded += b.size
            live = b >= self.worst[part][:, None]
            top = np.where(live, b, -np.inf).max(axis=0)
            most = np.maximum(most, top)
            order = np.flatnonzero(leaf & (top > -np.inf))
            order = order[np.argsort(-top[order], kind="stable")]
            if 2 * np.count_nonzero(live[:, order]) > len(part) * len(order):
                self._score_wide(part, found, [tree.points[kids[c]] for c in order.tolist()], top[order])
            else:
                for c in order.tolist():
                    wanted = part[b[:, c] >= self.worst[part]]
                    if len(wanted):
                        self._score(wanted, found, tree.points[kids[c]])
        return [(float(most[c]), q, int(kids[c])) for c in np.flatnonzero(~leaf & (most > -np.inf)).tolist()]

    def _score_wide(self, rows: np.ndarray, found: Points, leaves: list[np.ndarray], top: np.ndarray) -> None:
        """Leaves that most of the queries must see, several in a product."""
        held, size = [], 0
        for points, most in zip(leaves, top.tolist(), strict=True):
            if most >= self.worst[rows].min():
                held.append(points)
                size += len(points)
            if size >= WIDE:
                self._score(rows, found, np.concatenate(held))
                held, size = [], 0
        if held:
            self._score(rows, found, np.concatenate(held))

    def _score(self, rows: np.ndarray, found: Points, points: np.ndarray) -> None:
        own, tree = self.asked.tree, found.tree
        a, b = own.x[rows], tree.x[points]
        scores = a @ b.T if self.whole else a.astype(np.int64) @ b.T.astype(np.int64)
        self.scored += scores.size
        near = scores >= self.worst[rows][:, None]
        for i in np.flatnonzero(near.any(axis=1)).tolist():
            q = int(rows[i])
            hits = np.flatnonzero(near[i])
            hits = hits[np.argsort(-scores[i][hits], kind="stable")]
            values, places = scores[i][hits].tolist(), points[hits].tolist()
            for row in self.owners[q]:
                self._offer(self.best[row], int(self.asked.ids[row]), values, places, found)
            self.worst[q] = self._least(q)

    def _offer(self, heap: list, me: int, values: list, places: list, found: Points) -> None:
        for score, p in zip(values, places, strict=True):
            score = int(score)
            if len(heap) == self.k and score < heap[0][0]:
                return
            for x in found.ids[found.at[p] : found.at[p + 1]].tolist():
                if x == me or (score, -x) in heap:
                    continue
                if len(heap) < self.k:
                    heapq.heappush(heap, (score, -x))
                elif (score, -x) > heap[0]:
                    heapq.heapreplace(heap, (score, -x))
                else:
                    break

    def told(self) -> list[tuple[int, int, int]]:
        return [(int(self.asked.ids[row]), -x, s) for row, heap in enumerate(self.best) for s, x in heap]


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten())
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _placed(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds each row's nearest pivot. The pivots are few, whatever the table's size."""
    shared, square = rows.sparkSession.sparkContext.broadcast(pivots), (pivots * pivots).sum(axis=1)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in batches:
            x = _matrix(b.column(1))
            found = [np.zeros(0, np.int32)] + [(square[None, :] - 2 * (x[a : a + WIDE] @ shared.value.T)).argmin(axis=1).astype(np.int32) for a in range(0, len(x), WIDE)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(found))], ["id", "x", "pivot"])

    return rows.select("id", "x").mapInArrow(near, "id long, x array<double>, pivot int")


def _trees(rows: DataFrame, blocks: int, keep: int) -> DataFrame:
    """(block, tree, root, radius): the rows of each block made into a tree where its partition ends."""

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        held: dict[int, list] = {}
        for b in batches:
            number, ids, x = np.asarray(b.column(0)), np.asarray(b.column(1)), _matrix(b.column(2))
            for n in np.unique(number).tolist():
                held.setdefault(n, []).append((ids[number == n], x[number == n]))
        for n in list(held):
            parts = held.pop(n)
            made = Points(np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts]), keep)
            root = made.tree.x[made.tree.at[0]]
            yield _batch([(n, pickle.dumps(made), root, float(made.tree.radius[0]))], ["block", "tree", "root", "radius"], [pa.int32(), pa.binary(), pa.list_(pa.float64()), pa.float64()])

    return rows.select("block", "id", "x").repartition(blocks, "block").mapInArrow(grown, "block int, tree binary, root array<double>, radius double")


def _numbered(counts: dict[int, int], block_rows: int) -> tuple[dict[int, tuple[int, int]], int]:
    """For each pivot the number of its first block and how many it has, and the number of all blocks."""
    out, n = {}, 0
    for p in sorted(counts):
        parts = max(1, -(-counts[p] // block_rows))
        out[p] = (n, parts)
        n += parts
    return out, n


def _block(places: dict[int, tuple[int, int]]) -> F.Column:
    first = F.create_map(*(F.lit(v) for p, x in places.items() for v in (p, x[0])))
    parts = F.create_map(*(F.lit(v) for p, x in places.items() for v in (p, x[1])))
    return (F.element_at(first, F.col("pivot")) + F.pmod(F.xxhash64("id", "x"), F.element_at(parts, F.col("pivot")))).cast("int")


def _helpful(roots: DataFrame, asked: list) -> DataFrame:
    """(block, group, most): candidate trees and the groups of query trees that they may still help, by the roots' bounds.

    asked: a part of the query trees, of bounded size, as (group, home, root, radius, worst); a tree's own home has been searched.
    """
    shared = roots.sparkSession.sparkContext.broadcast(asked)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, home, root, radius, worst = (np.array([a[k] for a in shared.value]) for k in range(5))
        norm = np.sqrt((root * root).sum(axis=1))
        for b in batches:
            out = []
            x, s = _matrix(b.column(1)), np.asarray(b.column(2))
            for i, block in enumerate(b.column(0).to_pylist()):
                size = float(np.sqrt(x[i] @ x[i]))
                most = root @ x[i] + radius * size + s[i] * norm + radius * s[i]
                most += 1e-9 * (1 + np.abs(most))
                for g in np.unique(group[(most >= worst) & (home != block)]).tolist():
                    out.append((block, g, float(most[group == g].max())))
            yield _batch(out, ["block", "group", "most"], [pa.int32(), pa.int32(), pa.float64()])

    return roots.select("block", "root", "radius").mapInArrow(held, "block int, group int, most double")


FOUND = "query_id long, vec_id long, score long"


def _told(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return _batch(rows, ["query_id", "vec_id", "score"], [pa.int64()] * 3)


def top_k(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: float = 256.0, modulus: int = 50, block_rows: int = 4096, lanes: int = 64, part_bytes: int = 32 << 20) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by modulus its k best other rows."""
    save = partial(written, name="top-k")
    spark = vectors.sparkSession
    x = F.transform(F.col(vector_col), lambda v: F.floor(F.lit(scale) * v.cast("double")).cast("double"))
    sound = F.col(id_col).isNotNull() & F.coalesce(F.size(vector_col) > 0, F.lit(False)) & F.forall(vector_col, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.filter(sound).select(F.col(id_col).cast("long").alias("id"), x.alias("x"))
    n, short, long_ = rows.agg(F.count("*"), F.min(F.size("x")), F.max(F.size("x"))).first()
    if short != long_:
        raise ValueError(f"vectors of {short} to {long_} components")
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    few = rows.select("x", F.xxhash64("x", "id").alias("h")).orderBy("h", "x").limit(4 * min(PIVOTS, -(-n // block_rows)))  # 4 * PIVOTS rows at most
    pivots = np.unique(np.array([r.x for r in few.collect()]), axis=0)
    pivots = pivots[np.random.default_rng(5).permutation(len(pivots))[: min(PIVOTS, -(-n // block_rows))]]
    placed = save(_placed(rows, pivots))
    counts = {r.pivot: (r.n, r.q) for r in placed.groupBy("pivot").agg(F.count("*").alias("n"), F.count(F.when(F.col("id") % modulus == 0, 1)).alias("q")).collect()}  # a row for each pivot
    places, n_data = _numbered({p: c[0] for p, c in counts.items()}, block_rows)
    query_places, n_query = _numbered({p: c[1] for p, c in counts.items() if c[1]}, block_rows)
    if not n_query:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # query trees of small pivots share a group, so that a candidate tree is sent to them once
    home, group, held = {}, {}, block_rows + 1
    for p, (first, parts) in query_places.items():
        each = -(-counts[p][1] // parts)
        for unit in range(first, first + parts):
            if held + each > block_rows:
                held, last = 0, len({*group.values()})
            held, group[unit], home[unit] = held + each, last, places[p][0]
    data = save(_trees(placed.withColumn("block", _block(places)), n_data, k + 1))
    asked = _trees(placed.filter(F.col("id") % modulus == 0).withColumn("block", _block(query_places)), n_query, 1 << 62)
    units = spark.createDataFrame([(u, group[u], home[u]) for u in group], "block int, group int, home int")
    asked = asked.join(units, "block")

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in batches:
            for unit, g, h, root, radius, tree, own in zip(*b.columns, strict=True):
                s = Search(pickle.loads(tree.as_buffer()), k)
                s.run(pickle.loads(own.as_buffer()))
                state = pickle.dumps((s.asked, s.best))
                yield _batch([(unit.as_py(), g.as_py(), h.as_py(), root.values.to_numpy(), radius.as_py(), float(s.worst.min(initial=np.inf)), state)], ["unit", "group", "home", "root", "radius", "worst", "state"], [pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.float64(), pa.float64(), pa.binary()])

    met = asked.join(data.select(F.col("block").alias("home"), F.col("tree").alias("own")), "home").select("block", "group", "home", "root", "radius", "tree", "own")
    states = save(met.mapInArrow(at_home, "unit int, group int, home int, root array<double>, radius double, worst double, state binary"))
    # the query trees' roots in parts of bounded size, one after the other
    each, pairs = max(1, part_bytes // (8 * (len(pivots[0]) + 8))), None
    for a in range(0, len(group), each):
        part = states.filter((F.col("unit") >= a) & (F.col("unit") < a + each)).select("group", "home", "root", "radius", "worst").collect()
        found = _helpful(data, [tuple(r) for r in part])
        pairs = found if pairs is None else pairs.union(found)
    pairs = save(pairs.groupBy("block", "group").agg(F.max("most").alias("most")).withColumn("lane", F.pmod("block", F.lit(min(n_data, lanes)))))
    left = states.join(pairs.select("group", "lane").distinct(), "group").select("group", "lane", F.lit(0).alias("side"), F.lit(0.0).alias("most"), F.col("state").alias("tree"))
    right = pairs.join(data.select("block", "tree"), "block").select("group", "lane", F.lit(1).alias("side"), (-F.col("most")).alias("most"), "tree")

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        at, own = None, []
        for b in batches:
            for g, lane, side, tree in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                if at != (g, lane):
                    for s in own:
                        yield _told(s.told())
                    at, own = (g, lane), []
                if side == 0:
                    asked_, best = pickle.loads(tree.as_buffer())
                    own.append(Search(asked_, k, best))
                else:
                    found = pickle.loads(tree.as_buffer())
                    for s in own:
                        s.run(found)
        for s in own:
            yield _told(s.told())

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for state in b.column(0):
                asked_, best = pickle.loads(state.as_buffer())
                yield _told(Search(asked_, k, best).told())

    dealt = left.union(right).repartition("group", "lane").sortWithinPartitions("group", "lane", "side", "most").select("group", "lane", "side", "tree")
    near = dealt.mapInArrow(searched, FOUND).union(states.select("state").mapInArrow(kept, FOUND)).distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
