"""Approximate nearest neighbours by largest inner product: one small-world graph per shard.

Equal vectors are one point: the graphs hold distinct vectors only, dealt over shards of about
``shard_rows`` by a hash, so a vector that many rows share takes one place.  A shard holds
vectors of one band of lengths (the longest under 16 times the shortest).  For each shard a
hierarchical navigable small-world graph is built over its vectors divided by the longest length
and lengthened by one component (sqrt(1 - |x|^2)), in which the largest inner product is the
least distance: the scale of one band takes no precision from another.  A shard's graph is one
row of flat arrays in a table in the shared folder: vectors, and for
each layer its points and their neighbours (-1: none).  Every query is searched in every
shard, ``query_block`` queries and one graph at a time; all points found are scored in double
precision on the original vectors, the best with ``k`` + 1 different ids leave the shard (a search
that finds less ids is repeated, wider, up to the whole shard), and are given to all rows that
share them and merged.

Points go in by batches (each batch searches the graph as it stands, and itself); neighbours
are chosen by the rule that one is kept only if it is nearer to the point than to those kept.

Defined results: vectors that are null, empty, all zero or hold a null or non-finite component
take no part; vectors of another length than the query's are never its neighbours (each
length has graphs of its own); a row is found by its id, so rows with a null id take no part;
of rows that repeat an id each takes part, none as the neighbour of its own id; an empty table
gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracetrim.llm.common import pick
from tracetrim.session import ship_package, shared_table


def _distances(x: np.ndarray, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Squared distances of each q to its candidates (rows of ids), up to |q|^2."""
    v = x[ids]
    return np.einsum("qcd,qcd->qc", v, v) - 2 * np.einsum("qcd,qd->qc", v, q)


def search_layer(x: np.ndarray, nbr: np.ndarray, q: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of all queries at once: each keeps its ``ef`` nearest points found and opens the
    nearest one not yet opened, until there is none.  (ids, distances), nearest first, -1 where there are less."""
    nq, width = len(q), nbr.shape[1]
    ids = np.full((nq, ef), -1, dtype=np.int64)
    dist = np.full((nq, ef), np.inf)
    opened = np.ones((nq, ef), dtype=bool)
    seen = np.zeros((nq, len(x)), dtype=bool)
    start = entry[:, :ef]
    k = start.shape[1]
    d0 = np.where(start >= 0, _distances(x, q, np.maximum(start, 0)), np.inf)
    order = np.argsort(d0, axis=1, kind="stable")
    ids[:, :k] = np.take_along_axis(start, order, 1)
    dist[:, :k] = np.take_along_axis(d0, order, 1)
    opened[:, :k] = ~np.isfinite(dist[:, :k])
    r, c = np.nonzero(start >= 0)
    seen[r, start[r, c]] = True
    live = np.arange(nq)
    while len(live):
        todo = np.where(opened[live], np.inf, dist[live])
        at = todo.argmin(axis=1)
        more = np.isfinite(todo[np.arange(len(live)), at])
        live, at = live[more], at[more]
        if not len(live):
            break
        opened[live, at] = True
        near = nbr[ids[live, at]].astype(np.int64)
        safe = np.maximum(near, 0)
        new = (near >= 0) & ~seen[live[:, None], safe]
        seen[np.repeat(live, width)[new.ravel()], safe.ravel()[new.ravel()]] = True
        d = np.where(new, _distances(x, q[live], safe), np.inf)
        alld = np.concatenate([dist[live], d], axis=1)
        keep = np.argpartition(alld, ef - 1, axis=1)[:, :ef]
        alli = np.concatenate([ids[live], near], axis=1)
        allo = np.concatenate([opened[live], ~new], axis=1)
        dist[live] = np.take_along_axis(alld, keep, 1)
        ids[live] = np.take_along_axis(alli, keep, 1)
        opened[live] = np.take_along_axis(allo, keep, 1)
    order = np.argsort(dist, axis=1, kind="stable")
    ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
    return np.where(np.isfinite(dist), ids, -1), dist


def choose(x: np.ndarray, q: np.ndarray, ids: np.ndarray, dist: np.ndarray, m: int) -> np.ndarray:
    """Of each point's candidates (nearest first, -1: none) at most ``m``, spread out: one is kept if it is
    nearer to the point than to every one kept; places left go to the nearest others."""
    nq, c = ids.shape
    v = x[np.maximum(ids, 0)]
    sq = np.einsum("qcd,qcd->qc", v, v)
    between = sq[:, :, None] + sq[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
    to_q = dist + np.einsum("qd,qd->q", q, q)[:, None]
    kept = np.zeros((nq, c), dtype=bool)
    n = np.zeros(nq, dtype=np.int64)
    for j in range(c):
        nearer = ~((between[:, j, :] < to_q[:, j, None]) & kept).any(axis=1)
        ok = nearer & (ids[:, j] >= 0) & (n < m)
        kept[:, j] = ok
        n += ok
    rank = np.where(kept, 0, np.where(ids >= 0, 1, 2)) * c + np.arange(c)
    order = np.argsort(rank, axis=1)[:, :m]
    return np.take_along_axis(ids, order, 1)


def _link_back(x: np.ndarray, nbr: np.ndarray, points: np.ndarray, chosen: np.ndarray) -> None:
    """Adds each point to its chosen neighbours' lists; a full list is chosen anew."""
    width = nbr.shape[1]
    r, c = np.nonzero(chosen >= 0)
    to, new = chosen[r, c], points[r]
    fresh = ~(nbr[to] == new[:, None]).any(axis=1)  # two points of one batch may have chosen each other
    to, new = to[fresh], new[fresh]
    order = np.argsort(to, kind="stable")
    to, new = to[order], new[order]
    uniq, first, count = np.unique(to, return_index=True, return_counts=True)
    for lo in range(0, len(uniq), 512):
        u, f, n = uniq[lo:lo + 512], first[lo:lo + 512], count[lo:lo + 512]
        cand = np.full((len(u), width + int(n.max())), -1, dtype=np.int64)
        cand[:, :width] = nbr[u]
        rows = np.repeat(np.arange(len(u)), n)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        cand[rows, width + within] = new[np.repeat(f, n) + within]
        d = np.where(cand >= 0, _distances(x, x[u], np.maximum(cand, 0)), np.inf)
        o = np.argsort(d, axis=1, kind="stable")
        cand, d = np.take_along_axis(cand, o, 1), np.take_along_axis(d, o, 1)
        full = (cand >= 0).sum(axis=1) > width
        nbr[u[~full]] = cand[~full, :width]
        if full.any():
            nbr[u[full]] = choose(x, x[u[full]], cand[full], d[full], width)


class Graph:
    """Layers from the ground (all points) up; ``top`` holds the points of the highest layer."""

    def __init__(self, x: np.ndarray, m: int = 16, ef: int = 80, seed: int = 3, batch: int = 192):
        self.x = x.astype(np.float32)
        n = len(x)
        rng = np.random.default_rng(seed)
        level = np.minimum((-np.log(1 - rng.random(n)) / math.log(m)).astype(np.int64), 8)
        levels = int(level.max()) + 1 if n else 1
        self.layers = [np.full((n, m if i else 2 * m), -1, dtype=np.int32) for i in range(levels)]
        order = rng.permutation(n)
        if n:
            first = int(np.flatnonzero(level == levels - 1)[0])
            order = np.concatenate([[first], order[order != first]])
            self.entry = first
        lo, size = 1, 1
        while lo < n:
            points = order[lo: lo + size]
            self._insert(points, level[points], m, ef)
            lo += size
            size = min(batch, max(1, lo // 2), max(16, (1 << 26) // n))

    def _insert(self, points: np.ndarray, level: np.ndarray, m: int, ef: int) -> None:
        q = self.x[points]
        at = np.full((len(points), 1), self.entry, dtype=np.int64)
        sq = np.einsum("qd,qd->q", q, q)
        own = sq[None, :] - 2 * q @ q.T
        for i in range(len(self.layers) - 1, -1, -1):
            linked = level >= i
            nbr = self.layers[i]
            if (~linked).any():
                ids, _ = search_layer(self.x, nbr, q[~linked], at[~linked], 1)
                lower = ids
            if linked.any():
                w = np.flatnonzero(linked)
                ids, dist = search_layer(self.x, nbr, q[w], at[w], ef)
                mates = np.where(np.eye(len(w), dtype=bool), np.inf, own[np.ix_(w, w)])
                k = min(len(w), 2 * m)
                best = np.argsort(mates, axis=1, kind="stable")[:, :k]
                ids2 = np.concatenate([ids, np.where(np.isfinite(np.take_along_axis(mates, best, 1)), points[w][best], -1)], axis=1)
                d2 = np.concatenate([dist, np.take_along_axis(mates, best, 1)], axis=1)
                o = np.argsort(d2, axis=1, kind="stable")[:, :ef]
                ids2, d2 = np.take_along_axis(ids2, o, 1), np.take_along_axis(d2, o, 1)
                chosen = choose(self.x, q[w], ids2, d2, m)
                nbr[points[w], : chosen.shape[1]] = chosen
                _link_back(self.x, nbr, points[w], chosen)
                at2 = np.full((len(points), ef), -1, dtype=np.int64)
                at2[w] = ids
                if (~linked).any():
                    at2[~linked, :1] = lower
                at = at2[:, : max(1, int((at2 >= 0).sum(axis=1).max()))]
            else:
                at = lower

    def search(self, q: np.ndarray, k: int, ef: int) -> np.ndarray:
        return search_graph(self.x, self.layers, self.entry, q.astype(np.float32), k, ef)


def search_graph(x: np.ndarray, layers: list[np.ndarray], entry: int, q: np.ndarray, k: int, ef: int) -> np.ndarray:
    """The ``k`` nearest points found of each query, -1 where there are less."""
    out, step = [], int(max(16, min(256, (1 << 26) // max(1, len(x)))))
    for lo in range(0, len(q), step):
        part = q[lo: lo + step]
        at = np.full((len(part), 1), entry, dtype=np.int64)
        for nbr in reversed(layers[1:]):
            at, _ = search_layer(x, nbr, part, at, 1)
        ids, _ = search_layer(x, layers[0], part, at, max(k, ef))
        out.append(ids[:, :k])
    return np.concatenate(out) if out else np.empty((0, k), dtype=np.int64)


def lengthened(x: np.ndarray) -> np.ndarray:
    """The vectors over the longest one's length, and one component more that gives each length 1."""
    x = x / np.abs(x).max()  # no square overflows
    x = x / math.sqrt(np.einsum("nd,nd->n", x, x).max())
    more = np.sqrt(np.maximum(0, 1 - np.einsum("nd,nd->n", x, x)))
    return np.concatenate([x, more[:, None]], axis=1).astype(np.float32)


def directions(q: np.ndarray) -> np.ndarray:
    """The queries at length 1, which leaves the order of their inner products, beside a zero."""
    q = q / np.abs(q).max(axis=1, keepdims=True)
    q = q / np.sqrt(np.einsum("qd,qd->q", q, q))[:, None]
    return np.concatenate([q, np.zeros((len(q), 1))], axis=1).astype(np.float32)


def best_found(x: np.ndarray, least: np.ndarray, q: np.ndarray, found: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, point, score) of the points found (-1: none) down to the one with which a query has ``k`` + 1
    different ``least`` ids, and those of equal score; and which queries have so many ids."""
    safe = np.maximum(found, 0)
    score = np.concatenate([(q[i: i + 32, None, :] * x[safe[i: i + 32]]).sum(axis=2) for i in range(0, len(q), 32)])
    score = np.where(found >= 0, score, -np.inf)
    order = np.argsort(-score, axis=1, kind="stable")
    found, score = np.take_along_axis(found, order, 1), np.take_along_axis(score, order, 1)
    _, code = np.unique(least, return_inverse=True)
    pair = np.arange(len(q))[:, None] * len(least) + code[np.maximum(found, 0)]
    r, c = np.nonzero(found >= 0)
    _, first = np.unique(pair[r, c], return_index=True)
    new = np.zeros(found.shape, dtype=np.int64)
    new[r[first], c[first]] = 1
    ids = new.cumsum(axis=1)
    full = ids[:, -1] > k
    last = np.where(full, (ids > k).argmax(axis=1), found.shape[1] - 1)
    r, c = np.nonzero((found >= 0) & (score >= score[np.arange(len(q)), last][:, None]))
    return r, found[r, c], score[r, c], full


GRAPH = ("dim int, band int, shard long, points long, entry long, vectors binary, keys array<long>, least array<long>, widths array<int>, "
         "neighbours array<binary>")


def build(points: DataFrame, m: int, ef: int) -> DataFrame:
    """One row of flat arrays for each shard of (dim, band, shard, key, least, vec)."""
    def run(key, table):
        x = np.array(table.column("vec").to_pylist(), dtype=np.float64)
        g = Graph(lengthened(x), m, ef)
        return pa.table({
            **{c: table.column(c).slice(0, 1) for c in ("dim", "band", "shard")}, "points": pa.array([len(x)], pa.int64()),
            "entry": pa.array([g.entry], pa.int64()), "vectors": pa.array([x.astype("<f8").tobytes()], pa.binary()),
            **{c + "s" * (c == "key"): pa.array([table.column(c).to_pylist()], pa.list_(pa.int64())) for c in ("key", "least")},
            "widths": pa.array([[a.shape[1] for a in g.layers]], pa.list_(pa.int32())),
            "neighbours": pa.array([[a.astype("<i4").tobytes() for a in g.layers]], pa.list_(pa.binary()))})

    return points.groupBy("dim", "band", "shard").applyInArrow(run, GRAPH)


def nearest(vectors: DataFrame, queries, k: int = 20, shard_rows: int = 8192, m: int = 16, ef_build: int = 80,
            ef_search: int = 160, query_block: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: for rows (vec_id, vec) where the condition ``queries`` holds, the ``k``
    rows with another id that are nearest among those found, ties to smaller ids."""
    spark = vectors.sparkSession
    ship_package(spark)
    bad = F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    v = (vectors.select(F.col("vec_id").cast("long"), F.col("vec").cast("array<double>"))
         .where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & ~bad & F.exists("vec", lambda v: v != 0)))
    v = v.withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0)))  # -0.0 is 0.0
    # of equal vectors at most k + 1 different ids can be in one query's answer: the smallest, its own left out
    order = Window.partitionBy("vec").orderBy("vec_id")
    least = v.groupBy("vec", "vec_id").agg(F.count("*").alias("n")).withColumn("at", F.row_number().over(order)).where(F.col("at") <= k + 1)
    points = least.groupBy("vec").agg(F.sort_array(F.collect_list(F.struct("vec_id", "n"))).alias("ids")).withColumn("key", F.monotonically_increasing_id())
    top = F.array_max(F.transform("vec", F.abs))
    length = F.log2(top) + F.log2(F.aggregate(F.transform("vec", lambda x: x / top), F.lit(0.0), lambda a, x: a + x * x)) / 2
    points, _ = shared_table(points.withColumn("dim", F.size("vec")).withColumn("band", F.floor(length / 4 + 0.5).cast("int")), "vectors")
    shards = points.groupBy("dim", "band").agg(F.ceil(F.count("*") / shard_rows).cast("long").alias("shards"))
    dealt = points.join(shards, ["dim", "band"]).withColumn("shard", F.pmod(F.xxhash64("vec"), F.col("shards"))).withColumn("least", F.col("ids")[0]["vec_id"])
    graphs, _ = shared_table(build(dealt.select("dim", "band", "shard", "key", "least", "vec"), m, ef_build), "graphs")

    asked = v.where(queries).select("vec", "vec_id")
    ask = asked.groupBy("vec").agg(F.lit(1).alias("one")).select("vec", F.size("vec").alias("dim"), F.xxhash64("vec").alias("h"))
    ask = ask.join(points.select(F.col("vec").alias("of"), F.col("key").alias("query")), F.col("vec") == F.col("of")).drop("of")
    ask, _ = shared_table(ask, "queries")
    blocks = ask.groupBy("dim").agg(F.ceil(F.count("*") / query_block).cast("long").alias("blocks"))
    ask = ask.join(blocks, "dim").join(shards, "dim").withColumn("block", F.pmod(F.col("h"), F.col("blocks")))
    ask = ask.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1))).select("dim", "band", "shard", "block", "query", "vec")
    fanned = graphs.join(blocks, "dim").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))

    def run(key, left, right):
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], t) for c, t in (("query", pa.int64()), ("key", pa.int64()), ("score", pa.float64()))})
        dim, points_, entry = (left.column(c)[0].as_py() for c in ("dim", "points", "entry"))
        x = np.frombuffer(left.column("vectors")[0].as_py(), "<f8").reshape(points_, dim)
        keys, least = (np.array(left.column(c)[0].as_py()) for c in ("keys", "least"))
        layers = [np.frombuffer(a, "<i4").reshape(points_, w) for a, w in zip(left.column("neighbours")[0].as_py(), left.column("widths")[0].as_py())]
        q = np.array(right.column("vec").to_pylist(), dtype=np.float64)
        long_x, long_q, query = lengthened(x), directions(q), right.column("query").to_numpy()
        todo, ef, out = np.arange(len(q)), ef_search, []
        while len(todo):
            again, step = [], max(1, (1 << 22) // max(ef, 1024))
            for part in np.split(todo, range(step, len(todo), step)):
                found = (search_graph(long_x, layers, entry, long_q[part], ef, ef) if ef < points_
                         else np.broadcast_to(np.arange(points_), (len(part), points_)))
                r, at, score, full = best_found(x, least, q[part], found, k)
                full |= ef >= points_
                out.append(tuple(a[full[r]] for a in (query[part][r], keys[at], score)))
                again.append(part[~full])
            todo, ef = np.concatenate(again), 4 * ef
        return pa.table({c: pa.array(np.concatenate(a), t) for (c, t), a in zip((("query", pa.int64()), ("key", pa.int64()), ("score", pa.float64())), zip(*out))})

    hits = (fanned.groupBy("dim", "band", "shard", "block")
            .cogroup(ask.groupBy("dim", "band", "shard", "block")).applyInArrow(run, "query long, key long, score double"))
    ids = hits.join(points.select("key", "ids"), "key").select("query", "score", F.inline("ids")).repartition("query")
    # k + 1 different ids for each distinct query vector, each as often as k times: every row that asks it leaves out its own id
    of_id = Window.partitionBy("query", "vec_id").orderBy(F.col("score").desc())
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ids = ids.withColumn("nth", F.row_number().over(of_id)).where(F.col("nth") <= k)
    ids = ids.withColumn("seen", F.count(F.when(F.col("nth") == 1, 1)).over(best)).withColumn("at", F.row_number().over(best)).where(F.col("seen") <= k + 1)
    of = points.select(F.col("key").alias("query"), F.col("vec").alias("of"))
    rows = asked.join(of, F.col("vec") == F.col("of")).select(F.col("vec_id").alias("query_id"), "query")
    lists = ids.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("at", "vec_id", "score", "n"))).alias("found"))
    others = rows.join(lists, "query").withColumn("found", F.filter("found", lambda s: s["vec_id"] != F.col("query_id")))
    repeated = F.flatten(F.transform(F.slice("found", 1, k), lambda s: F.array_repeat(s, F.least(s["n"], F.lit(k)).cast("int"))))
    return others.select("query_id", F.posexplode(F.slice(repeated, 1, k)).alias("p", "s")).select(
        "query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("s.vec_id").alias("vec_id"), F.col("s.score").alias("score"))


def nearest_of(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """The queries are the rows whose id is divisible by ``every``."""
    v = pick(vectors, "vec_id", "embedding").toDF("vec_id", "vec")
    return nearest(v, F.pmod("vec_id", F.lit(every)) == 0, k)
