"""Exact search for the greatest inner products, by dual trees over queries and data.

All vectors are dealt to cells around pivots picked farthest first, the top level of one tree
that holds queries and data alike; a block of a cell and a batch of queries are indexed
together in a cover tree below it. A node has a centre, one of its points, and the greatest
distance of a point to it, so no query of a node Q has a product with a point of a node R over
``<q, r> + |q| rad R + |r| rad Q + rad Q rad R``. A pair of nodes is dropped where that is less
than the worst k-th score of the queries in Q. The first scores come from each query's own cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonolith.llm import scratch
from sonolith.llm.vectors import integers, lists, matrix, products, profile, usable

LEAST = -(1 << 62)


@dataclass(frozen=True)
class SearchOptions:
    """``every``: queries are rows whose id it divides. Blocks hold about ``block`` vectors and batches
    about ``batch`` queries; pivots, ``cells`` at most, come from ``sample`` rows; nodes have at most
    ``fan`` children and leaves at most ``leaf`` points."""

    k: int = 10
    every: int = 100
    scale: int = 1024
    block: int = 4096
    batch: int = 4096
    cells: int = 256
    sample: int = 2048
    fan: int = 12
    leaf: int = 64


class Points:
    """Integer rows, as they are for exact scores and as doubles for bounds."""

    def __init__(self, x: np.ndarray):
        self.x, self.f = x, x.astype(np.float64)
        self.norm = np.sqrt((self.f * self.f).sum(axis=1))

    def away(self, rows: np.ndarray, centre: int) -> np.ndarray:
        d = self.f[rows] - self.f[centre]
        return np.sqrt((d * d).sum(axis=1))


class Tree:
    """A cover tree over queries and data together: each level's centres are picked farthest
    first, so they lie farther apart than the radius that they cover. A node's queries and
    data are ranges of ``queries`` and ``data``."""

    def __init__(self, points: Points, is_query: np.ndarray, fan: int, leaf: int):
        self.points, self.is_query, self.fan, self.leaf = points, is_query, fan, leaf
        self.centre, self.radius, self.children, self.q, self.r = [], [], [], [], []
        queries, data = [], []
        self.nq = self.nr = 0
        todo = [(np.arange(len(points.x)), 0, points.away(np.arange(len(points.x)), 0), None)]
        while todo:
            rows, centre, away, parent = todo.pop()
            node = len(self.centre)
            if parent is not None:
                self.children[parent].append(node)
            inside = self.is_query[rows]
            self.centre.append(centre)
            self.radius.append(float(away.max()) * (1 + 1e-9))
            self.children.append([])
            self.q.append([self.nq, self.nq + int(inside.sum())])
            self.r.append([self.nr, self.nr + int((~inside).sum())])
            if len(rows) <= leaf or away.max() == 0:
                queries.append(rows[inside])
                data.append(rows[~inside])
                self.nq, self.nr = self.q[node][1], self.r[node][1]
                continue
            todo.extend((*part, node) for part in reversed(self._split(rows, centre, away)))
        self.queries, self.data = np.concatenate(queries), np.concatenate(data)
        # in the order of a depth-first walk the ranges of a node follow from those of its leaves
        for node in range(len(self.centre) - 1, -1, -1):
            if kids := self.children[node]:
                self.q[node] = [min(self.q[k][0] for k in kids), max(self.q[k][1] for k in kids)]
                self.r[node] = [min(self.r[k][0] for k in kids), max(self.r[k][1] for k in kids)]
        self.centre, self.radius = np.array(self.centre), np.array(self.radius)
        self.q, self.r = np.array(self.q), np.array(self.r)
        self.c, self.norm = points.f[self.centre], points.norm[self.centre]

    def _split(self, rows: np.ndarray, centre: int, away: np.ndarray) -> list:
        """Children: the parent's centre and the farthest points, each with the points nearest to it."""
        near, of, centres = away.copy(), np.zeros(len(rows), np.int64), [centre]
        while len(centres) < self.fan and near.max() > 0:
            centres.append(int(rows[near.argmax()]))
            d = self.points.away(rows, centres[-1])
            closer = d < near
            of[closer], near = len(centres) - 1, np.minimum(near, d)
        return [(rows[of == k], c, near[of == k]) for k, c in enumerate(centres) if (of == k).any()]


class Search:
    """The best ``k`` data points of each query of a tree: score descending, id ascending, null ids last."""

    def __init__(self, tree: Tree, ids: np.ndarray, null: np.ndarray, kth: np.ndarray, k: int):
        self.t, self.k, self.kth = tree, k, kth[tree.queries]
        n = len(tree.queries)
        self.score, self.id, self.null = np.full((n, k), LEAST), np.zeros((n, k), np.int64), np.ones((n, k), bool)
        self.ids, self.nulls = ids[tree.data], null[tree.data]
        self.met = 0  # products worked out

    def run(self) -> None:
        if len(self.t.queries) and len(self.t.data):
            self._visit(0, np.array([0]))

    def _bounds(self, node: int, others: np.ndarray) -> np.ndarray:
        t = self.t
        high = t.c[others] @ t.c[node] + t.radius[others] * t.norm[node] + t.norm[others] * t.radius[node] + t.radius[others] * t.radius[node]
        return high + 1e-9 * (t.norm[others] + t.radius[others]) * (t.norm[node] + t.radius[node]) + 1e-6

    def _visit(self, node: int, others: np.ndarray) -> None:
        t = self.t
        lo, hi = t.q[node]
        if lo == hi:
            return
        others = others[t.r[others, 0] < t.r[others, 1]]
        others = others[self._bounds(node, others) >= self.kth[lo:hi].min()]
        if not len(others):
            return
        if t.children[node]:
            nearer = np.concatenate([np.array(t.children[o] or [o], dtype=np.int64) for o in others])
            for child in t.children[node]:
                self._visit(child, nearer)
            return
        while len(inner := [o for o in others if t.children[o]]):  # down to the leaves that may matter
            others = np.array([o for o in others if not t.children[o]] + [c for o in inner for c in t.children[o] if t.r[c, 0] < t.r[c, 1]])
            others = others[self._bounds(node, others) >= self.kth[lo:hi].min()]
        self._leaves(lo, hi, others)

    def _leaves(self, lo: int, hi: int, leaves: np.ndarray) -> None:
        """Leaves by falling bound, several at a time, until none can better any query's k-th score."""
        t = self.t
        q, norm = t.points.f[t.queries[lo:hi]], t.points.norm[t.queries[lo:hi]]
        high = q @ t.c[leaves].T + norm[:, None] * t.radius[leaves][None]
        high += 1e-9 * norm[:, None] * (t.norm[leaves] + t.radius[leaves])[None] + 1e-6
        order = np.argsort(-high.max(axis=0), kind="stable")
        leaves, high = leaves[order], high[:, order]
        at, several = 0, 4
        while at < len(leaves):
            some = np.flatnonzero((high[:, at : at + several] >= self.kth[lo:hi, None]).any(axis=0)) + at
            at += several
            if len(some):
                self._meet(lo, hi, np.concatenate([np.arange(*t.r[o]) for o in leaves[some]]))

    def _meet(self, lo: int, hi: int, data: np.ndarray) -> None:
        t = self.t
        score = products(t.points.x[t.queries[lo:hi]], t.points.x[t.data[data]])
        self.met += score.size
        rows = np.flatnonzero((score >= self.kth[lo:hi, None]).any(axis=1))
        if not len(rows):
            return
        at, n = lo + rows, len(rows)
        score = np.concatenate([self.score[at], score[rows]], axis=1)
        ids = np.concatenate([self.id[at], np.broadcast_to(self.ids[data], (n, len(data)))], axis=1)
        null = np.concatenate([self.null[at], np.broadcast_to(self.nulls[data], (n, len(data)))], axis=1)
        best = np.lexsort((ids, null, -score), axis=1)[:, : self.k]
        line = np.arange(n)[:, None]
        self.score[at], self.id[at], self.null[at] = score[line, best], ids[line, best], null[line, best]
        self.kth[at] = np.maximum(self.kth[at], self.score[at, -1])


def top_products(vectors: DataFrame, options: SearchOptions | None = None) -> DataFrame:
    """The ``k`` candidates of greatest integer inner product with each query.

    ``vectors`` needs vec_id (integer) and embedding; other columns are ignored. Queries are the rows
    whose vec_id is divisible by ``every``, candidates all rows but the query's own. Returns query_id,
    rank (from 1), vec_id and score; ties go to the smaller vec_id, a null one last. A query with fewer
    candidates gets all of them, one without any gets no row.

    Vectors that are null or hold a null or non-finite component take no part. Repeated rows (equal
    vec_id and vector) count once, as query and as candidate; rows of one vec_id with different vectors
    are different rows. Shorter vectors count as ending in zeros; components stop at 2**26. An empty table
    gives no rows.

    Of equal vectors the ``k + 1`` smallest ids are searched: no other can be among the best ``k``. So
    a group of copies is met once, and its result goes to each of its queries.
    """
    o = options or SearchOptions()
    x = integers(F.col("embedding"), o.scale)
    rows = vectors.where(usable(F.col("embedding"))).select("vec_id", x.alias("x"))
    size = F.array_max(F.transform("x", lambda v, i: F.when(v != 0, i + 1).otherwise(0)))  # without the zeros at the end
    rows = rows.withColumn("x", F.slice("x", 1, F.coalesce(size, F.lit(0))))
    rows = rows.withColumn("key", F.substring(F.sha2(F.array_join("x", ","), 256), 1, 40)).dropDuplicates(["vec_id", "key"])
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy(F.col("vec_id").asc_nulls_last())))
    points = scratch.save(ranked.where(F.col("place") <= o.k + 1), "points")
    n, width = profile(points)
    width = max(1, width)
    asks = rows.where(F.col("vec_id") % o.every == 0).select("vec_id", "key")
    asks = scratch.save(asks, "asks")

    pivots = _pivots(points, n, width, o)
    celled = scratch.save(points.mapInArrow(_dealing(pivots, width), "vec_id long, key string, x array<int>, place int, cell int, away double"), "cells")
    asked = asks.select("key").distinct()
    queries = scratch.save(celled.where("place = 1").join(asked, "key", "left_semi").select("key", "x", "cell", "away"), "queries")
    radius, blocks = _sizes(celled, len(pivots), o.block)
    query_radius, asking = _sizes(queries, len(pivots), 1)
    batch_of = _batches(asking, o.batch)

    own = {(c, c) for c in range(len(pivots))}
    none = queries.withColumn("kth", F.lit(LEAST))
    first = scratch.save(_met(celled, none, own, blocks, batch_of, width, o), "first")
    kth = _best(first, o.k + 1).groupBy("key").agg(F.when(F.count(F.lit(1)) > o.k, F.min("score")).alias("kth"))
    known = scratch.save(queries.join(kth, "key", "left").withColumn("kth", F.coalesce("kth", F.lit(LEAST))), "known")
    worst = {r.cell: r.kth for r in known.groupBy("cell").agg(F.min("kth").alias("kth")).collect()}  # a row per cell
    pairs = _pairs(pivots, query_radius, radius, worst) - own
    rest = scratch.save(_met(celled, known, pairs, blocks, batch_of, width, o), "rest")

    best = _best(first.unionByName(rest), o.k + 1).withColumnRenamed("vec_id", "found")
    listed = asks.join(best, "key").where(~((F.col("candidate_key") == F.col("key")) & F.col("found").eqNullSafe(F.col("vec_id"))))
    rank = F.row_number().over(Window.partitionBy("vec_id", "key").orderBy("rank"))
    listed = listed.withColumn("rank", rank).where(F.col("rank") <= o.k)
    return listed.select(F.col("vec_id").alias("query_id"), "rank", F.col("found").alias("vec_id"), "score")


def _pivots(points: DataFrame, n: int, width: int, o: SearchOptions) -> np.ndarray:
    """Cells' centres, farthest first, from a sample of at most ``sample`` rows by digest."""
    sample = matrix(points.orderBy("key", F.col("vec_id").asc_nulls_last()).limit(o.sample).select("x").toArrow().column("x"), width).astype(np.float64)
    if not len(sample):
        return np.zeros((1, width))
    chosen, near = [0], ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(o.cells, -(-n // o.block)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def _dealing(pivots: np.ndarray, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = (pivots * pivots).sum(axis=1) / 2
        for batch in batches:
            x = matrix(batch.column("x"), width).astype(np.float64)
            cell = (half[None] - x @ pivots.T).argmin(axis=1)
            away = np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "key", "x", "place")), pa.array(cell.astype(np.int32)), pa.array(away)], ["vec_id", "key", "x", "place", "cell", "away"])

    return run


def _sizes(rows: DataFrame, cells: int, block: int) -> tuple[np.ndarray, list[int]]:
    """Per cell: covering radius, and number of blocks (0 if empty)."""
    radius, blocks = np.zeros(cells), [0] * cells
    for r in rows.groupBy("cell").agg(F.max("away").alias("away"), F.count(F.lit(1)).alias("n")).collect():
        radius[r.cell], blocks[r.cell] = r.away * (1 + 1e-9), -(-r.n // block)
    return radius, blocks


def _batches(queries: list[int], batch: int) -> dict[int, tuple[int, int]]:
    """Batches of queries as (first, number) per cell: small cells share one, large ones have several."""
    out, first, held = {}, 0, 0
    for cell, n in enumerate(queries):
        if held and held + n > batch:
            first, held = first + 1, 0
        out[cell] = (first, max(1, -(-n // batch)))
        if n > batch:
            first, held = first + out[cell][1], 0
        else:
            held += n
    return out


def _pairs(pivots: np.ndarray, query_radius: np.ndarray, radius: np.ndarray, worst: dict[int, int]) -> set[tuple[int, int]]:
    """Pairs (cell of queries, cell of data) that may better the worst k-th score of the former."""
    norm = np.sqrt((pivots * pivots).sum(axis=1))
    high = pivots @ pivots.T + norm[:, None] * radius[None] + query_radius[:, None] * (norm + radius)[None]
    high += 1e-9 * (norm + query_radius)[:, None] * (norm + radius)[None] + 1e-6
    return {(a, b) for a, kth in worst.items() for b in range(len(pivots)) if high[a, b] >= kth}


def _met(celled: DataFrame, queries: DataFrame, pairs: set[tuple[int, int]], blocks: list[int], batch_of: dict[int, tuple[int, int]], width: int, o: SearchOptions) -> DataFrame:
    """Scores of the best candidates in each block for the queries whose cell is paired with the block's."""
    spark = celled.sparkSession
    # cells x cells entries at most
    targets, batches = {}, {}
    for a, b in pairs:
        if not blocks[b]:
            continue
        targets.setdefault(a, []).append(b)
        batches.setdefault(b, set()).update(range(batch_of[a][0], sum(batch_of[a])))
    if not targets:
        return spark.createDataFrame([], _FOUND)
    firsts = np.concatenate([[0], np.cumsum(blocks)]).tolist()
    sub = lambda many: F.pmod(F.xxhash64("key", F.lit(13)), many)
    to = spark.createDataFrame([(a, batch_of[a][0], batch_of[a][1], [k for b in bs for k in range(firsts[b], firsts[b + 1])]) for a, bs in targets.items()], "c int, first int, many int, blocks array<int>")
    at = spark.createDataFrame([(b, firsts[b], blocks[b], sorted(s)) for b, s in batches.items()], "c int, first int, many int, batches array<int>")
    q = queries.join(F.broadcast(to), F.col("cell") == F.col("c"))
    q = q.select("key", "x", "kth", (F.col("first") + sub(F.col("many"))).cast("int").alias("batch"), F.explode("blocks").alias("block"))
    r = celled.join(F.broadcast(at), F.col("cell") == F.col("c"))
    r = r.select("vec_id", "key", "x", (F.col("first") + sub(F.col("many"))).cast("int").alias("block"), F.explode("batches").alias("batch"))
    return r.groupBy("block", "batch").cogroup(q.groupBy("block", "batch")).applyInArrow(_searching(width, o), _FOUND)


_FOUND = "key string, score long, vec_id long, candidate_key string"


def _searching(width: int, o: SearchOptions):
    def run(data: pa.Table, queries: pa.Table) -> pa.Table:
        nr, nq = data.num_rows, queries.num_rows
        names = ["key", "score", "vec_id", "candidate_key"]
        types = [pa.string(), pa.int64(), pa.int64(), pa.string()]
        if not nr or not nq:
            return pa.table([pa.array([], t) for t in types], names)
        points = Points(np.concatenate([matrix(data.column("x"), width), matrix(queries.column("x"), width)]))
        is_query = np.arange(nr + nq) >= nr
        tree = Tree(points, is_query, o.fan, o.leaf)
        ids, null = data.column("vec_id").fill_null(0).to_numpy(), np.asarray(data.column("vec_id").is_null())
        kth = np.concatenate([np.full(nr, LEAST), queries.column("kth").to_numpy()])
        # the place of a data point stands for its id, in the order of ids
        place = np.lexsort((ids, null))
        order = np.empty(nr, np.int64)
        order[place] = np.arange(nr)
        search = Search(tree, np.concatenate([order, np.zeros(nq, np.int64)]), np.zeros(nr + nq, bool), kth, o.k + 1)
        search.run()
        line, column = np.nonzero(search.score > LEAST)
        found = pa.array(place[search.id[line, column]])
        asked = pa.array(tree.queries[line] - nr)
        columns = [queries.column("key").take(asked), pa.chunked_array([pa.array(search.score[line, column])]), data.column("vec_id").take(found), data.column("key").take(found)]
        return pa.table([c.cast(t) for c, t in zip(columns, types, strict=True)], names)

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("key").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "candidate_key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
