"""Layered proximity graphs over vectors (the HNSW index kind): one graph for each shard of a store, searched by beams.

A shard is `shard_rows` vectors, dealt evenly whatever their keys, and its graph is one row of the index: keys, vectors, and for each
layer the links of its nodes. Layer 0 holds all nodes, each layer above about one in M of those below. A node is linked to near
nodes of its layer, leaving out those that lie nearer to a node already taken than to itself, and links go both ways while there is room:
M on upper layers, 2M on layer 0. Candidates come from the exact distances inside the shard, as blocked matrix products, so
building costs a row of the store `shard_rows` products and is linear in the store. What cannot be reached from the entry is linked
from the nearest node that can.

A search takes a stated set of queries, a segment at a time, and walks all of a segment's queries through a shard together: down the
upper layers to the nearest node, then with a beam of `beam` nodes on layer 0. The k best of the beams are scored exactly and
ranked over all shards. Results are approximate; `vector_search.top_k` beside it is exact, and is the way to search with filters.

Later rows are added as shards of their own (union of two indexes); rows that are deleted are taken out of the results by their keys.
Inner product is searched as distance, in one dimension more (the reduction that adds sqrt(max |x|^2 - |x|^2)).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.taskcontext import TaskContext

from corvane.operators.vector_search import SEGMENT, _matrix, _unit, best_of, scores

#: Rows whose distances to all others are held at once when a graph is built.
BLOCK = 512


def space_of(x: np.ndarray, metric: str, widest: float | None = None) -> np.ndarray:
    """Vectors so placed that the nearest are the most alike. widest: the greatest squared length of stored rows; without it, x are queries."""
    if metric == "cosine":
        return _unit(x)
    if metric == "l2":
        return x
    beyond = np.zeros(len(x)) if widest is None else np.sqrt(np.maximum(widest - (x * x).sum(axis=1), 0))
    return np.column_stack([x, beyond])


def nearest(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n nearest other rows of each row, nearest first, and their squared distances."""
    n = min(n, len(x) - 1)
    own = (x * x).sum(axis=1)
    near, far = np.zeros((len(x), n), np.int32), np.zeros((len(x), n))
    for a in range(0, len(x), BLOCK):
        d = own[a : a + BLOCK, None] - 2 * (x[a : a + BLOCK] @ x.T) + own[None, :]
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        some = np.argpartition(d, n - 1, axis=1)[:, :n] if n < len(x) - 1 else np.argsort(d, axis=1)[:, :n]
        part = np.take_along_axis(d, some, axis=1)
        order = np.lexsort((some, part), axis=1)
        near[a : a + BLOCK], far[a : a + BLOCK] = np.take_along_axis(some, order, axis=1), np.take_along_axis(part, order, axis=1)
    return near, far


def spread(x: np.ndarray, near: np.ndarray, far: np.ndarray, m: int) -> np.ndarray:
    """Up to m of each row's candidates, those in other directions first: one that lies nearer to a taken one than to the row waits. -1 where there are fewer."""
    out = np.full((len(x), m), -1, np.int32)
    for a in range(0, len(x), BLOCK):
        c, d = near[a : a + BLOCK], far[a : a + BLOCK]
        y = x[c]
        own = (y * y).sum(axis=2)
        between = own[:, :, None] - 2 * (y @ y.transpose(0, 2, 1)) + own[:, None, :]
        taken = np.zeros(c.shape, bool)
        for e in range(c.shape[1]):
            covered = (taken & (between[:, e, :] <= d[:, e, None])).any(axis=1)
            taken[:, e] = ~covered & (taken.sum(axis=1) < m)
        order = np.argsort(~taken, axis=1, kind="stable")[:, :m]  # the taken ones, then the nearest of the others
        out[a : a + BLOCK, : order.shape[1]] = np.take_along_axis(c, order, axis=1)
    return out


def both_ways(x: np.ndarray, links: np.ndarray, most: int) -> np.ndarray:
    """Links with those that come back, at most `most` a row: its own first, then the nearest of the others."""
    src, col = np.nonzero(links >= 0)
    dst = links[src, col]
    gap = ((x[src] - x[dst]) ** 2).sum(axis=1)
    rows, to, back, gap = np.concatenate([src, dst]), np.concatenate([dst, src]), np.repeat([0, 1], len(src)), np.tile(gap, 2)
    order = np.lexsort((to, gap, back, rows))
    rows, to = rows[order], to[order]
    _, first = np.unique(rows.astype(np.int64) * len(x) + to, return_index=True)
    keep = np.sort(first)  # a link that goes both ways counts once, as the row's own
    rows, to = rows[keep], to[keep]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    out = np.full((len(x), most), -1, np.int32)
    fits = place < most
    out[rows[fits], place[fits]] = to[fits]
    return out


def reached(links: np.ndarray, start: int) -> np.ndarray:
    seen, front = np.zeros(len(links), bool), np.array([start])
    seen[start] = True
    while len(front):
        front = np.unique(links[front])
        front = front[front >= 0]
        front = front[~seen[front]]
        seen[front] = True
    return seen


def connected(x: np.ndarray, links: np.ndarray, start: int) -> np.ndarray:
    """Links by which every row is reached from the start: of those that are not, the nearest to one that is gets a link from it, and so on."""
    seen = reached(links, start)
    while not seen.all():
        inside, outside = np.flatnonzero(seen), np.flatnonzero(~seen)
        own = (x[inside] * x[inside]).sum(axis=1)
        best = (np.inf, 0, 0)
        for a in range(0, len(outside), BLOCK):
            y = x[outside[a : a + BLOCK]]
            d = (y * y).sum(axis=1)[:, None] - 2 * (y @ x[inside].T) + own[None, :]
            i, j = np.unravel_index(d.argmin(), d.shape)
            best = min(best, (float(d[i, j]), int(inside[j]), int(outside[a + i])))
        _, here, there = best
        free = np.flatnonzero(links[here] < 0)
        if not len(free):  # a wider row: no link is lost
            links, free = np.column_stack([links, np.full(len(links), -1, np.int32)]), [links.shape[1]]
        links[here, free[0]] = there
        seen |= reached(links, there)
    return links


def graph_of(x: np.ndarray, m: int, candidates: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(nodes, links by place among the nodes) of each layer, from 0 up. The first node of the top layer is the entry."""
    level = np.floor(-np.log(1 - np.random.default_rng(seed).random(len(x))) / math.log(m)).astype(int)
    layers = []
    for k in range(int(level.max(initial=0)) + 1):
        nodes = np.flatnonzero(level >= k).astype(np.int32)
        own = x[nodes]
        if len(nodes) == 1:
            layers.append((nodes, np.full((1, 1), -1, np.int32)))
            continue
        links = both_ways(own, spread(own, *nearest(own, candidates), m), 2 * m if k == 0 else m)
        layers.append((nodes, connected(own, links, int(np.flatnonzero(level[nodes] == level[nodes].max())[0]))))
    return layers


def walked(q: np.ndarray, x: np.ndarray, links: np.ndarray, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each query, the `beam` nearest nodes that a best-first walk from its start finds (-1 where fewer), their squared distances, and the distances computed.

    All queries take a step together: each opens the nearest node of its beam that it has not opened, until none of the beam is left.
    """
    n = len(q)

    def far(rows: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        apart = x[nodes] - q[rows][:, None, :]  # differences keep what products of long vectors would lose
        return np.einsum("ikj,ikj->ik", apart, apart)

    node, gap = np.full((n, beam), -1, np.int32), np.full((n, beam), np.inf)
    opened, seen = np.zeros((n, beam), bool), np.zeros((n, len(x)), bool)
    node[:, 0], gap[:, 0] = start, far(np.arange(n), start[:, None])[:, 0]
    seen[np.arange(n), start] = True
    live, work = np.arange(n), n
    while len(live):
        best = np.where(opened[live] | (node[live] < 0), np.inf, gap[live]).argmin(axis=1)
        go = ~opened[live, best] & (node[live, best] >= 0)
        live, best = live[go], best[go]
        if not len(live):
            break
        opened[live, best] = True
        to = links[node[live, best]]
        old = (to < 0) | seen[live[:, None], np.maximum(to, 0)]
        seen[live[:, None], np.maximum(to, 0)] |= to >= 0
        d = far(live, np.maximum(to, 0))
        work += int((~old).sum())
        d[old] = np.inf
        all_gap, all_node = np.column_stack([gap[live], d]), np.column_stack([node[live], np.where(old, -1, to)])
        all_open = np.column_stack([opened[live], np.zeros(to.shape, bool)])
        order = np.argpartition(all_gap, beam - 1, axis=1)[:, :beam]
        gap[live], node[live], opened[live] = (np.take_along_axis(v, order, axis=1) for v in (all_gap, all_node, all_open))
    return node, gap, work


def build(store: DataFrame, *, key: str = "vec_id", vector: str = "embedding", metric: str = "cosine", m: int = 16, candidates: int = 96, shard_rows: int = 8192) -> DataFrame:
    """The index of a store: a row for each graph. Every row with a vector is in one graph. Write it once; searches read it."""
    if metric not in ("cosine", "ip", "l2"):
        raise ValueError(f"no such metric: {metric}")
    found = store.filter(F.col(vector).isNotNull() & (F.size(vector) > 0)).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("x"))
    shards = max(1, -(-found.count() // shard_rows))
    layer = pa.struct([("nodes", pa.binary()), ("links", pa.binary())])

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, turn = [], 0, 0

        def graph() -> pa.RecordBatch:
            nonlocal turn
            keys, x = pa.concat_arrays([b.column(0) for b in held]), np.concatenate([_matrix(b.column(1)) for b in held])
            widest = float((x * x).sum(axis=1).max())
            layers = graph_of(space_of(x, metric, widest), m, candidates, turn)
            shard = (TaskContext.get().partitionId() << 20) + turn
            turn += 1
            told = [{"nodes": nodes.astype("<i4").tobytes(), "links": links.astype("<i4").tobytes()} for nodes, links in layers]
            return pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([x.shape[1]], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), pa.array([x.astype("<f8").tobytes()], pa.binary()), pa.array([told], pa.list_(layer))], ["shard", "dim", "keys", "vectors", "layers"])

        for b in batches:
            while b.num_rows:  # a graph has no more than shard_rows nodes, however rows were dealt
                some = b.slice(0, shard_rows - n)
                held.append(some)
                n, b = n + some.num_rows, b.slice(some.num_rows)
                if n == shard_rows:
                    yield graph()
                    held, n = [], 0
        if n:
            yield graph()

    kind = found.schema["key"].dataType
    schema = T.StructType([T.StructField("shard", T.LongType()), T.StructField("dim", T.IntegerType()), T.StructField("keys", T.ArrayType(kind)), T.StructField("vectors", T.BinaryType()), T.StructField("layers", T.ArrayType(T.StructType([T.StructField("nodes", T.BinaryType()), T.StructField("links", T.BinaryType())])))])
    return found.repartition(shards).mapInArrow(built, schema).withColumn("metric", F.lit(metric))


def keys_of(index: DataFrame, key: str = "vec_id") -> DataFrame:
    """(shard, key) of every row that an index holds."""
    return index.select("shard", F.explode("keys").alias(key))


def search(queries: DataFrame, index: DataFrame, *, k: int = 5, beam: int = 96, query_key: str = "query_id", query_vector: str = "query_vector", key: str = "vec_id", digits: int = 6, work: bool = False) -> DataFrame:
    """(query, key, score, rank) of about the k best rows; ties of rounded scores to the smaller key. work: instead the distances computed, by shard."""
    spark = index.sparkSession
    asked = queries.filter(F.col(query_vector).isNotNull()).select(F.col(query_key), F.col(query_vector).cast("array<double>").alias("__q"))
    parts = -(-asked.count() // SEGMENT)
    kind = index.schema["keys"].dataType.elementType
    schema = T.StructType([asked.schema[query_key], T.StructField(key, kind), T.StructField("score", T.DoubleType())])
    if work:
        schema = T.StructType([T.StructField("shard", T.LongType()), T.StructField("rows", T.LongType()), T.StructField("queries", T.LongType()), T.StructField("distances", T.LongType())])
    out = spark.createDataFrame([], schema)
    for part in range(parts):
        mine = asked.filter(F.pmod(F.xxhash64(query_key), F.lit(parts)) == part).toArrow()
        if not mine.num_rows:
            continue
        shared = spark.sparkContext.broadcast((mine.column(0).combine_chunks(), _matrix(mine.column(1).combine_chunks())))

        def found(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            for b in batches:
                for shard, dim, keys, vectors, layers, metric in zip(*(b.column(c) for c in range(6)), strict=True):
                    metric, keys = metric.as_py(), keys.values
                    x = np.frombuffer(vectors.as_buffer(), "<f8").reshape(-1, dim.as_py())
                    place, asks = space_of(x, metric, float((x * x).sum(axis=1).max())), space_of(q, metric)
                    levels = [(np.frombuffer(y["nodes"], "<i4"), np.frombuffer(y["links"], "<i4")) for y in layers.as_py()]
                    at, done = np.full(len(q), levels[-1][0][0]), 0
                    for depth in range(len(levels) - 1, -1, -1):
                        nodes, links = levels[depth]
                        here = np.searchsorted(nodes, at)
                        wide = min(beam if depth == 0 else 1, len(nodes))
                        near, gap, n = walked(asks, place[nodes], links.reshape(len(nodes), -1), here, wide)
                        at, done = nodes[near[np.arange(len(q)), gap.argmin(axis=1)]], done + n
                    if work:
                        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (shard.as_py(), len(x), len(q), done)], schema.names)
                        continue
                    names, rows, cols, values = keys.to_pylist(), [], [], []
                    for i in range(len(q)):
                        some = np.sort(near[i][near[i] >= 0])
                        y = _unit(x[some]) if metric == "cosine" else x[some]
                        s = np.round(scores(_unit(q[i : i + 1]) if metric == "cosine" else q[i : i + 1], y, metric), digits)
                        for _, j in best_of(s, [names[o] for o in some], k):
                            rows.append(i)
                            cols.append(int(some[j]))
                            values.append(float(s[0, j]) + 0.0)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows, pa.int64())), keys.take(pa.array(cols, pa.int64())), pa.array(values, pa.float64())], schema.names)

        out = out.unionByName(index.select("shard", "dim", "keys", "vectors", "layers", "metric").mapInArrow(found, schema))
    if work:
        return out
    rank = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("score"), key))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k)
