"""Approximate nearest neighbours by a small-world graph per shard (operator 9).

Vectors get one more component, so that the largest inner product with a query is the nearest point. A shard's
graph is a flat array of neighbours for each layer; nodes are numbered by falling level, so a layer is a prefix.
Building and searching move many points in step, with one gather and one product for each step. A query goes to
every shard; the shards' finds are scored in double precision on the original vectors and merged. Equal vectors are
one node, which holds the least vec_ids, so many as a result can need; finds are expanded to these.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prospectrum.llm import common

TOP, EVERY = 20, 20
#: Links of a node by inner product and in space; points that a search keeps, when building and when asked.
M_PRODUCT, M_SPACE, EF_PRODUCT, EF_SPACE, EF_SEARCH = 32, 16, 48, 24, 160
#: Layers: each has so many times fewer nodes, down to so many; a search takes ENTRIES points of the layer above.
SHRINK, TOP_NODES, EF_UPPER, ENTRIES = 16, 128, 16, 8
EXPAND, SEEN, BATCH = 4, 4096, 1024
NOBODY = -(1 << 63)
ONE, NONE = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)
#: Shards: so many at least (a constant, so that work grows with the rows), and one more for so many vectors.
SHARDS, SHARD_ROWS = 4, 50_000
#: Queries of a block: as many bytes as a shard, since blocks go to every shard and shards to every block.
BLOCK_QUERIES = 65_536
#: Queries that walk in step.
WALKERS = 256


def packed(dist: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """One number that sorts by distance and then by id; its lowest bit says whether the point was expanded."""
    return np.maximum(dist, 0).astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32) | ids.astype(np.uint64) << ONE


def ids_of(keys: np.ndarray) -> np.ndarray:
    return (keys >> ONE & np.uint64(0x7FFFFFFF)).astype(np.int64)


class Graph:
    """points: rows by falling level, all equally long; sizes: nodes of each layer from the base up; near: neighbours
    of a layer's nodes in flat rows, -1 for none. Half of the links lead to large inner products, the others to
    points near in space, apart from each other; the latter keep what lies apart connected."""

    def __init__(self, points: np.ndarray, sizes: list[int], near: list[np.ndarray]) -> None:
        self.points, self.sizes, self.near = points, sizes, near
        self.length = np.float32(np.sqrt((points[:1].astype(np.float64) ** 2).sum()))
        self.seen_points = 0  # products computed

    def search(self, queries: np.ndarray, ef: int, layer: int = 0, nodes: int | None = None) -> np.ndarray:
        """Ids of up to ef points of a layer near each query, nearest first, -1 beyond."""
        nodes = self.sizes[layer] if nodes is None else nodes
        if layer + 1 < len(self.sizes):
            entry = self.search(queries, EF_UPPER, layer + 1)[:, :ENTRIES]
        else:
            entry = np.broadcast_to(np.linspace(0, nodes - 1, ENTRIES).astype(np.int64), (len(queries), ENTRIES))
        return self.beam(queries, entry, ef, layer, nodes)

    def beam(self, queries: np.ndarray, entry: np.ndarray, ef: int, layer: int, nodes: int) -> np.ndarray:
        """Best-first search of all queries in step: each step expands the EXPAND nearest open points of each query.

        What a query has seen is kept in a table of fixed size, where a later point may take an earlier one's place:
        a point may then be looked at again, and is dropped when it meets itself among the ef best."""
        points, near = self.points, self.near[layer]
        n, width = len(queries), near.shape[1]
        most = np.sqrt(np.einsum("ij,ij->i", queries, queries)) * self.length  # no product is larger
        seen = np.full((n, SEEN), -1, np.int32)

        def fresh(rows: np.ndarray, block: np.ndarray) -> np.ndarray:
            slot = block & (SEEN - 1)
            r, c = np.nonzero((block >= 0) & (block < nodes) & (seen[rows[:, None], slot] != block))
            which, row = block[r, c], rows[r]
            seen[row, slot[r, c]] = which
            self.seen_points += len(r)
            out = np.full(block.shape, NONE, np.uint64)
            out[r, c] = packed(most[row] - np.einsum("ij,ij->i", points[which], queries[row]), which)
            return out

        def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            both = np.concatenate([a, b], axis=1)
            both.sort(axis=1)
            twice = (both[:, 1:] >> ONE == both[:, :-1] >> ONE) & (both[:, 1:] != NONE)
            if twice.any():
                both[:, :-1][twice] = NONE
                both.sort(axis=1)
            return both[:, :ef]

        rows = np.arange(n)
        keys = merged(np.full((n, ef), NONE, np.uint64), fresh(rows, entry.astype(np.int32)))
        while True:
            own = keys[rows]
            open_ = own & ONE == 0
            alive = open_.any(axis=1)
            rows, own, open_ = rows[alive], own[alive], open_[alive]
            if not len(rows):
                return np.where(keys != NONE, ids_of(keys), -1)
            turn = np.cumsum(open_, axis=1, dtype=np.int32)
            r, c = np.nonzero(open_ & (turn <= EXPAND))
            block = np.full((len(rows), EXPAND, width), -1, np.int32)
            block[r, turn[r, c] - 1] = near[ids_of(own[r, c])]
            own[r, c] |= ONE
            keys[rows] = merged(own, fresh(rows, block.reshape(len(rows), -1)))


def products(v: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows a with rows b, in blocks."""
    out = np.empty(len(a), np.float32)
    for at in range(0, len(a), 1 << 16):
        out[at : at + (1 << 16)] = np.einsum("ij,ij->i", v[a[at : at + (1 << 16)]], v[b[at : at + (1 << 16)]])
    return out


def apart(v: np.ndarray, own: np.ndarray, ids: np.ndarray, m: int) -> np.ndarray:
    """Up to m of each row's candidates, nearest first: those nearer to the row's point than to one chosen before,
    then the nearest of the rest."""
    cand = v[ids]
    close = np.einsum("ijk,ik->ij", cand, v[own])
    between = np.matmul(cand, cand.transpose(0, 2, 1))
    picked = np.zeros(ids.shape, bool)
    for j in range(ids.shape[1]):
        picked[:, j] = (ids[:, j] >= 0) & ~(picked[:, :j] & (between[:, j, :j] > close[:, j : j + 1])).any(axis=1)
    picked &= np.cumsum(picked, axis=1) <= m
    order = np.argsort(np.where(ids < 0, 2, np.where(picked, 0, 1)), axis=1, kind="stable")[:, :m]
    return np.take_along_axis(ids, order, 1)


def connect(v: np.ndarray, near: np.ndarray, new: np.ndarray, to: np.ndarray) -> None:
    """Links from the new nodes and back; a node keeps those of the largest products."""
    r, c = np.nonzero(to >= 0)
    target, source = np.concatenate([to[r, c], new[r]]), np.concatenate([new[r], to[r, c]])
    old = np.unique(target)
    have = near[old]
    hr, hc = np.nonzero(have >= 0)
    pair = np.unique(np.concatenate([old[hr], target]) << 31 | np.concatenate([have[hr, hc], source]))
    target, source = pair >> 31, pair & 0x7FFFFFFF
    order = np.lexsort((-products(v, target, source), target))
    target, source = target[order], source[order]
    start = np.concatenate([[True], target[1:] != target[:-1]])
    place = np.arange(len(target)) - np.maximum.accumulate(np.where(start, np.arange(len(target)), 0))
    ok = place < near.shape[1]
    near[old] = -1
    near[target[ok], place[ok]] = source[ok]


def layers(n: int) -> list[int]:
    sizes = [n]
    while sizes[-1] > TOP_NODES:
        sizes.append(sizes[-1] // SHRINK)
    return sizes


def build(points: np.ndarray) -> Graph:
    """points: see augmented(), in any fixed order; a layer holds the first of them. Points are inserted batch by
    batch: each searches the graph of those before it, and is compared with its own batch."""
    sizes = layers(len(points))
    graph = Graph(points, sizes, [np.full((s, M_PRODUCT + M_SPACE), -1, np.int32) for s in sizes])
    flat = points.copy()
    flat[:, -1] = 0  # so that products are those of the original vectors
    for layer in range(len(sizes) - 1, -1, -1):
        size, near, begun = sizes[layer], graph.near[layer], 0
        while begun < size:
            own = np.arange(begun, min(size, begun + max(64, min(begun, BATCH))))
            found = []
            for v, ef in ((flat, EF_PRODUCT), (points, EF_SPACE)):
                q = v[own]
                dot = q @ q.T
                np.fill_diagonal(dot, -np.inf)
                order = np.argsort(-dot, axis=1, kind="stable")[:, : min(len(own) - 1, M_PRODUCT)]
                ids, dot = own[order], np.take_along_axis(dot, order, 1)
                if begun:
                    old = graph.search(q, ef, layer, begun)
                    product = np.einsum("ijk,ik->ij", v[old], q)
                    product[old < 0] = -np.inf
                    ids, dot = np.concatenate([old, ids], axis=1), np.concatenate([product, dot], axis=1)
                    order = np.argsort(-dot, axis=1, kind="stable")[:, :M_PRODUCT]
                    ids = np.take_along_axis(ids, order, 1)
                found.append(ids)
            if found[0].shape[1]:
                connect(flat, near[:, :M_PRODUCT], own, found[0])
                connect(points, near[:, M_PRODUCT:], own, apart(points, own, found[1], M_SPACE // 2))
            begun += len(own)
    return graph


def augmented(x: np.ndarray) -> np.ndarray:
    """One more component, with which all rows are equally long: nearest means largest inner product."""
    square = (x.astype(np.float64) ** 2).sum(axis=1)
    return np.concatenate([x, np.sqrt(np.maximum(square.max(initial=0) - square, 0))[:, None]], axis=1).astype(np.float32)


def build_shard(t: pa.Table) -> pa.Table:
    """A row that holds a shard: the nodes' vec_ids (so many each, NOBODY beyond), vectors in double precision, layers."""
    ids = t.column("vec_id").combine_chunks().to_numpy()
    dim = t.column("dim")[0].as_py()
    x = t.column("v").combine_chunks().values.to_numpy(zero_copy_only=False).reshape(-1, dim)
    lists = t.column("same").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    held = np.full((len(ids), sizes.max()), NOBODY, np.int64)
    held[np.arange(held.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy()
    # Any fixed order that the vectors don't follow: levels are drawn by it.
    order = np.lexsort((ids, (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)))
    held, x = np.ascontiguousarray(held[order]), np.ascontiguousarray(x[order])
    graph = build(augmented(x))
    near = b"".join(a.tobytes() for a in graph.near)
    return pa.table({"dim": pa.array([dim], pa.int32()), "shard": [t.column("shard")[0].as_py()], "ids": pa.array([held.tobytes()], pa.binary()), "x": pa.array([x.tobytes()], pa.binary()), "near": pa.array([near], pa.binary())}).cast(pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("ids", pa.binary()), ("x", pa.binary()), ("near", pa.binary())]))


def stored_graph(points: np.ndarray, near: bytes) -> Graph:
    flat, at, width, out = np.frombuffer(near, np.int32), 0, M_PRODUCT + M_SPACE, []
    sizes = layers(len(points))
    for size in sizes:
        out.append(flat[at : at + size * width].reshape(size, width))
        at += size * width
    return Graph(points, sizes, out)


def nearest(vectors: DataFrame, top: int = TOP, every: int = EVERY) -> DataFrame:
    """For each row whose vec_id is divisible by ``every``, its ``top`` nearest other rows by inner product.

    Gives query_id, rank, vec_id, score; ties go to the smaller vec_id; with fewer candidates, all. Vectors that
    are null, empty or zero, or hold null or non-finite components, and rows without vec_id, take no part.
    Vectors meet only those of their own length. Rows that repeat or share a vec_id are each a candidate and, where
    it is divisible, a query; only the query's own row is no candidate. Extra columns are ignored; an empty table
    gives an empty result."""
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0))  # no -0.0
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null").where(~odd & F.exists("v", lambda x: x != 0))
    rows = common.written(rows.withColumn("dim", F.size("v")).withColumn("row", F.monotonically_increasing_id()))
    same = W.partitionBy(F.xxhash64("v"), "v").orderBy("vec_id", "row")
    least = rows.withColumn("place", F.row_number().over(same)).where(F.col("place") <= top + 1)
    nodes = least.groupBy("dim", "v").agg(F.array_sort(F.collect_list("vec_id")).alias("same")).select("dim", "v", "same", F.get("same", F.lit(0)).alias("vec_id"))
    nodes = common.written(nodes)
    n = nodes.count()
    shards = max(SHARDS, -(-n // SHARD_ROWS))
    queries = rows.where(F.col("vec_id") % every == 0)
    blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    common.ship(vectors.sparkSession)
    index = nodes.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int")).groupBy("dim", "shard").applyInArrow(build_shard, "dim int, shard int, ids binary, x binary, near binary")
    index = common.written(index).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    # The stated query set goes to every shard, block by block.
    asked = queries.withColumn("block", F.pmod(F.xxhash64(F.lit(7), "row"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def find(shard: pa.Table, q: pa.Table) -> pa.Table:
        out = pa.schema([("row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not shard.num_rows or not q.num_rows:
            return out.empty_table()
        dim = shard.column("dim")[0].as_py()
        x = np.frombuffer(shard.column("x")[0].as_py(), np.float64).reshape(-1, dim)
        ids = np.frombuffer(shard.column("ids")[0].as_py(), np.int64).reshape(len(x), -1)
        graph = stored_graph(augmented(x), shard.column("near")[0].as_py())
        qid, row = (q.column(c).combine_chunks().to_numpy() for c in ("vec_id", "row"))
        qv = q.column("v").combine_chunks().values.to_numpy(zero_copy_only=False).reshape(-1, dim)
        got: list[tuple[np.ndarray, ...]] = []
        for at in range(0, len(qid), WALKERS):
            own, me = qv[at : at + WALKERS], qid[at : at + WALKERS]
            hit = graph.search(np.pad(own, ((0, 0), (0, 1))).astype(np.float32), max(EF_SEARCH, 2 * top))
            score = np.einsum("ijk,ik->ij", x[hit], own)
            score[hit < 0] = -np.inf
            # One node more than results, as the query's own may hold nothing else.
            best = np.lexsort((ids[hit, 0], -score), axis=1)[:, : top + 1]
            hit, score = np.take_along_axis(hit, best, 1), np.take_along_axis(score, best, 1)
            who = ids[hit]
            # The query itself is once among the ids of the node that has its vector, if it is one of the least.
            it = ((x[hit] == own[:, None, :]).all(axis=2) & (score > -np.inf))[:, :, None] & (who == me[:, None, None])
            it &= np.cumsum(it, axis=2) == 1
            who = np.where(it, NOBODY, who).reshape(len(own), -1)
            score = np.where(who == NOBODY, -np.inf, np.repeat(score, ids.shape[1], axis=1))
            order = np.lexsort((who, -score), axis=1)[:, :top]
            score, who = np.take_along_axis(score, order, 1), np.take_along_axis(who, order, 1)
            ok = score > -np.inf
            got.append((np.repeat(row[at : at + WALKERS], ok.sum(axis=1)), np.repeat(me, ok.sum(axis=1)), who[ok], score[ok]))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*got, strict=True)], schema=out)

    keys = ["dim", "shard", "block"]
    found = index.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(find, "row long, query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= top)


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(common.table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable] = {"op9_nearest_neighbours": op9_nearest_neighbours}
