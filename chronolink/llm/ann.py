"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Distinct vectors are dealt by hash to shards of bounded size. Each shard builds
a graph of its own: nodes get levels with exponentially falling frequency and
enter in a hashed order; a node links to earlier nodes of its level, chosen
among its nearest by the diversity rule (a candidate stays if it is closer to
the node than to any neighbour chosen before), and links are kept in both
directions and pruned by the same rule. The graph is one flat integer array:
per level its members and a fixed number of neighbours each. Queries come in
blocks of bounded size; each block descends every shard's levels greedily,
searches the ground level with a beam, and the shards' results are merged and
measured again in double precision on the original vectors.

Copies of a vector are one node with the smallest ids of the group, as many as
an answer can hold; of equally near rows these come first, so no answer is lost
by that, and a vector that a third of all rows share stays one node.

Defined results: vectors that are null, empty or zero, or hold a null or a
non-finite component, take no part, as queries or candidates; ids that are null
take no part either; only vectors of the query's dimension are candidates; a
query with fewer candidates than k gets all; other columns are ignored; an
empty table gives no rows. A repeated (id, vector) row is one candidate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolink.llm.common import store


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all rows of b."""
    out = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.maximum(out, 0)


def _diverse(vectors: np.ndarray, node: np.ndarray, cand: np.ndarray, dist: np.ndarray, most: int) -> np.ndarray:
    """Up to most neighbours per node among candidates that are sorted by distance (-1: none), nearest rejected ones filling up."""
    n, width = cand.shape
    v = vectors[np.maximum(cand, 0)]
    norm = (v * v).sum(2)
    between = norm[:, :, None] + norm[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
    kept = np.zeros((n, width), bool)
    count = np.zeros(n, np.int64)
    for j in range(width):
        closest = np.where(kept, between[:, j, :], np.inf).min(1)
        ok = (cand[:, j] >= 0) & (dist[:, j] < closest) & (count < most)
        kept[:, j] = ok
        count += ok
    place = np.where(kept, 0, 1) * width + np.arange(width)[None, :] + np.where(cand < 0, 2 * width, 0)
    order = np.argsort(place, axis=1)[:, :most]
    out = np.take_along_axis(cand, order, 1)
    if out.shape[1] < most:
        out = np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)
    return out.astype(np.int32)


def _level(vectors: np.ndarray, members: np.ndarray, links: int, most: int, reach: int, block: int = 256) -> np.ndarray:
    """Neighbours (as node numbers, -1: none) of a level's members, which stand in order of entry."""
    n, own = len(members), vectors[members]
    forward = np.full((n, links), -1, np.int32)
    for at in range(0, n, block):
        end = min(n, at + block)
        d = squared(own[at:end], own[:end])
        d[np.arange(end)[None, :] >= np.arange(at, end)[:, None]] = np.inf  # only those that entered before
        width = min(reach, end)
        near = np.argpartition(d, width - 1, axis=1)[:, :width]
        dist = np.take_along_axis(d, near, 1)
        order = np.argsort(dist, axis=1, kind="stable")
        near, dist = np.take_along_axis(near, order, 1), np.take_along_axis(dist, order, 1)
        near = np.where(np.isinf(dist), -1, near)
        forward[at:end] = _diverse(own, np.arange(at, end), near, dist, links)
    a = np.repeat(np.arange(n), links)
    b = forward.ravel()
    real = b >= 0
    a, b = np.concatenate([a[real], b[real]]), np.concatenate([b[real], a[real]])
    dist = ((own[a] - own[b]) ** 2).sum(1)
    order = np.lexsort((b, dist, a))
    a, b, dist = a[order], b[order], dist[order]
    start = np.searchsorted(a, np.arange(n + 1))
    nth = np.arange(len(a)) - start[a]
    width = 4 * most
    out = np.full((n, most), -1, np.int32)
    short = nth < width
    cand = np.full((n, width), -1, np.int64)
    away = np.full((n, width), np.inf, np.float32)
    cand[a[short], nth[short]], away[a[short], nth[short]] = b[short], dist[short]
    few = (start[1:] - start[:-1]) <= most
    out[few] = cand[few][:, :most]
    many = np.flatnonzero(~few)
    for at in range(0, len(many), block):
        rows = many[at : at + block]
        out[rows] = _diverse(own, rows, cand[rows], away[rows], most)
    return np.where(out >= 0, members[np.maximum(out, 0)], -1).astype(np.int32)


def build_graph(ids: np.ndarray, vectors: np.ndarray, links: int = 16, reach: int = 64) -> np.ndarray:
    """The graph of one shard as a flat integer array.

    It holds the number of levels, then from the ground level up: number of
    members, neighbours of each, members, neighbours.
    """
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    entry = np.argsort(mixed, kind="stable")
    chance = (mixed >> np.uint64(11)).astype(np.float64) / 2**53
    chance = (chance * 7919.0) % 1.0
    level = np.minimum(np.floor(-np.log(np.maximum(chance, 1e-12)) / np.log(links)).astype(int), 8)
    level[entry[0]] = level.max()
    parts = [np.array([level.max() + 1], np.int32)]
    for k in range(level.max() + 1):
        members = entry[level[entry] >= k]
        most = 2 * links if k == 0 else links
        near = _level(vectors, members, links, most, reach)
        parts += [np.array([len(members), most], np.int32), members.astype(np.int32), near.ravel()]
    return np.concatenate(parts)


def _levels(graph: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 1
    for _ in range(graph[0]):
        n, most = int(graph[at]), int(graph[at + 1])
        members = graph[at + 2 : at + 2 + n]
        out.append((members, graph[at + 2 + n : at + 2 + n + n * most].reshape(n, most)))
        at += 2 + n + n * most
    return out


def _beam(vectors: np.ndarray, members: np.ndarray, near: np.ndarray, queries: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The width nearest nodes found per query on one level, nearest first, and their squared distances."""
    n_q, n = len(queries), len(vectors)
    place = np.full(n, -1, np.int32)
    place[members] = np.arange(len(members), dtype=np.int32)
    seen = np.zeros((n_q, n), bool)
    rows = np.arange(n_q)
    found = np.full((n_q, width), -1, np.int64)
    dist = np.full((n_q, width), np.inf, np.float32)
    done = np.ones((n_q, width), bool)
    found[:, 0], done[:, 0] = start, False
    dist[:, 0] = ((vectors[start] - queries) ** 2).sum(1)
    seen[rows, start] = True
    live = rows
    while len(live):
        at = np.where(done[live], np.inf, dist[live]).argmin(1)
        done[live, at] = True
        nb = near[place[found[live, at]]].astype(np.int64)
        fresh = (nb >= 0) & ~seen[live[:, None], np.maximum(nb, 0)]
        seen[live[:, None], np.maximum(nb, 0)] |= fresh
        diff = vectors[np.maximum(nb, 0)] - queries[live][:, None, :]
        d = np.where(fresh, np.einsum("qnd,qnd->qn", diff, diff), np.inf).astype(np.float32)
        all_d = np.concatenate([dist[live], d], 1)
        order = np.argsort(all_d, axis=1, kind="stable")[:, :width]
        dist[live] = np.take_along_axis(all_d, order, 1)
        found[live] = np.take_along_axis(np.concatenate([found[live], nb], 1), order, 1)
        done[live] = np.take_along_axis(np.concatenate([done[live], ~fresh], 1), order, 1)
        live = live[(~done[live] & np.isfinite(dist[live])).any(1)]
    return found, dist


def search_graph(graph: np.ndarray, vectors: np.ndarray, queries: np.ndarray, k: int, width: int = 96) -> tuple[np.ndarray, np.ndarray]:
    """Nodes (-1: none) and squared distances of the k nearest found per query."""
    levels = _levels(graph)
    start = np.full(len(queries), levels[-1][0][0], np.int64)
    for members, near in reversed(levels[1:]):
        start = _beam(vectors, members, near, queries, start, 4)[0][:, 0]
    found, dist = _beam(vectors, *levels[0], queries, start, max(width, k))
    return np.where(np.isfinite(dist[:, :k]), found[:, :k], -1), dist[:, :k]


def _valid(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array, dtype) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(dtype)


def build_index(nodes: DataFrame, shards: int, links: int = 16, reach: int = 64) -> DataFrame:
    """shard, dim, ids, vectors, graph: a row per shard and dimension; nodes: distinct columns node, vector."""

    def build(table: pa.Table) -> pa.Table:
        ids = table["node"].combine_chunks().to_numpy()
        order = np.argsort(ids)
        vectors = _matrix(table["vector"].combine_chunks(), np.float32)[order]
        graph = build_graph(ids[order], vectors, links, reach)
        return pa.table(
            {"shard": table["shard"][:1], "dim": table["dim"][:1], "ids": [ids[order].tobytes()], "vectors": [vectors.tobytes()], "graph": [graph.tobytes()]},
            schema=pa.schema([("shard", pa.int32()), ("dim", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()), ("graph", pa.binary())]),
        )

    dealt = nodes.select(
        F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int").alias("shard"), F.size("vector").alias("dim"), "node", F.col("vector").cast("array<float>").alias("vector")
    )
    return dealt.groupBy("shard", "dim").applyInArrow(build, "shard int, dim int, ids binary, vectors binary, graph binary")


def search_index(index: DataFrame, queries: DataFrame, shards: int, n_queries: int, k: int, width: int = 96, block_rows: int = 512) -> DataFrame:
    """node, near, d: each shard's k nearest nodes per query; queries: distinct columns node, vector.

    Blocks of about block_rows queries meet each shard of their dimension.
    """
    blocks = max(1, -(-n_queries // block_rows))
    dealt = queries.select(F.pmod(F.xxhash64("node"), F.lit(blocks)).alias("block"), F.size("vector").alias("dim"), F.struct("node", F.col("vector").cast("array<float>").alias("vector")).alias("q"))
    dealt = dealt.groupBy("block", "dim").agg(F.collect_list("q").alias("qs"))
    met = dealt.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).join(index, ["shard", "dim"])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                dim, qs = batch.column(0)[i].as_py(), batch.column(1)[i].values
                ids = np.frombuffer(batch.column(2)[i].as_buffer(), np.int64)
                vectors = np.frombuffer(batch.column(3)[i].as_buffer(), np.float32).reshape(len(ids), dim)
                graph = np.frombuffer(batch.column(4)[i].as_buffer(), np.int32)
                own = _matrix(qs.field("vector"), np.float32)
                found, dist = search_graph(graph, vectors, own, k, width)
                real = found >= 0
                who = np.repeat(qs.field("node").to_numpy(zero_copy_only=False)[:, None], found.shape[1], 1)[real]
                yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(ids[found[real]]), pa.array(dist[real].astype(np.float64))], names=["node", "near", "d"])

    return met.select("dim", "qs", "ids", "vectors", "graph").mapInArrow(run, "node long, near long, d double")


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", shard_rows: int = 8192, links: int = 16, reach: int = 64, width: int = 96) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other rows found for each row that is_query marks.

    shard_rows: vectors per graph. width: beam of the search on the ground level.
    """
    rows = vectors.where(F.col(key).isNotNull() & _valid(F.col(vector))).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"), is_query.alias("asks"))
    copies = rows.select("id", "vector").withColumn("nth", F.dense_rank().over(Window.partitionBy("vector").orderBy("id"))).where(F.col("nth") <= k + 1)
    nodes = store(copies.groupBy("vector").agg(F.sort_array(F.collect_set("id")).alias("ids")).withColumn("node", F.col("ids")[0]), "ann-nodes")
    n = nodes.count()
    shards = max(1, -(-n // shard_rows))
    index = store(build_index(nodes, shards, links, reach), "ann-index")
    asking = rows.where("asks").select("id", "vector").distinct()
    asked = store(asking.join(nodes.select("vector", "node"), "vector").select("id", "node"), "ann-asked")
    asked_nodes = store(nodes.join(asked, "node", "left_semi").select("node", "vector"), "ann-queries")
    found = search_index(index, asked_nodes, shards, asked_nodes.count(), 2 * k + 4, width)
    best = found.withColumn("nth", F.row_number().over(Window.partitionBy("node").orderBy("d", "near"))).where(F.col("nth") <= 2 * k + 4)
    q = asked_nodes.select("node", F.col("vector").alias("q"))
    c = nodes.select(F.col("node").alias("near"), F.col("vector").alias("c"), "ids")
    square = F.zip_with("q", "c", lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double")))
    score = F.sqrt(F.aggregate(square, F.lit(0.0), lambda s, x: s + x))
    scored = store(best.select("node", "near").join(q, "node").join(c, "near").select("node", score.alias("score"), "ids"), "ann-scored")
    members = scored.select("node", "score", F.explode("ids").alias("id"))
    members = members.withColumn("nth", F.row_number().over(Window.partitionBy("node").orderBy("score", "id"))).where(F.col("nth") <= k + 1)
    lists = members.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("score", "id"))).alias("all"))
    own = asked.join(lists, "node").select(F.col("id").alias("query_id"), F.slice(F.filter("all", lambda x: x["id"] != F.col("id")), 1, k).alias("all"))
    out = own.select("query_id", F.posexplode("all").alias("pos", "x"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x")["id"].alias("vec_id"), F.col("x")["score"].alias("score"))
