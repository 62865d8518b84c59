"""Product codes of vectors: a k-means per part whose bounds use true net displacements.

A row keeps, for each part and each group of entries, a lower bound of its distance to the
group's entries other than its own, and the round in which that bound was computed (its
stamp). The whole codebook history is kept, so what a bound loses since its stamp is the
greatest net displacement of the group's entries between the two rounds, the norm of the sum
of their moves, which is never more than the sum of the norms of moves that an ordinary
drift bound adds up. A group whose bound still exceeds the distance to the row's own entry
is passed over; every other group is scanned again exactly, in integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonolith.llm import scratch
from sonolith.llm.vectors import integers, lists, matrix, products, profile, usable


@dataclass(frozen=True)
class CodeOptions:
    """``entries`` of a codebook (256 at most), ``groups`` of entries that share a bound. A label
    with more than 1 / ``hot`` of all rows is joined by broadcast: fewer than ``hot`` such labels exist."""

    parts: int = 4
    entries: int = 256
    rounds: int = 4
    scale: int = 1024
    groups: int = 16
    hot: int = 1000


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows to entries."""
    return (x * x).sum(axis=1)[:, None] - 2 * products(x, c) + (c * c).sum(axis=1)[None]


def grouped(entries: np.ndarray, groups: int) -> np.ndarray:
    """A group number per entry: nearest of ``groups`` entries picked farthest first."""
    near = squared(entries, entries[:1])[:, 0]
    of = np.zeros(len(entries), np.int64)
    for g in range(1, min(groups, len(entries))):
        d = squared(entries, entries[[int(near.argmax())]])[:, 0]
        of[d < near] = g
        near = np.minimum(near, d)
    return of


class Assigner:
    """Nearest entries in the newest codebook of ``history`` (round, part, entry, component)."""

    def __init__(self, history: list[np.ndarray], groups: int):
        self.history = history
        self.now = len(history) - 1
        self.members = []  # by part: entry indexes of each group, ascending
        self.lost = []  # by part: round, group -> greatest net displacement since that round
        for p in range(history[0].shape[0]):
            of = grouped(history[0][p], groups)
            members = [np.flatnonzero(of == g) for g in range(groups)]
            move = [np.sqrt(((history[-1][p] - h[p]).astype(np.float64) ** 2).sum(axis=1)) for h in history]
            self.members.append(members)
            self.lost.append(np.array([[m[i].max() if len(i) else 0.0 for i in members] for m in move]))

    def part(self, p: int, x: np.ndarray, own: np.ndarray, bound: np.ndarray, stamp: np.ndarray) -> np.ndarray:
        """Update ``own`` (entry per row, -1 before the first round), ``bound`` and ``stamp``
        (row, group) in place; the squared distances to the new own entries."""
        c, members = self.history[-1][p], self.members[p]
        best = np.full(len(x), np.iinfo(np.int64).max)
        known = own >= 0
        d = x[known] - c[own[known]]
        best[known] = (d * d).sum(axis=1)
        before, far = own.copy(), best.copy()
        groups = np.arange(len(members))
        left = bound - self.lost[p][stamp, groups[None]]
        left = np.where(known[:, None], left * (1 - 1e-9) - 1e-6, -np.inf)
        home = np.full(len(x), -1)
        second = {}
        for g in groups:
            if not len(members[g]):
                continue
            rows = np.flatnonzero(left[:, g] <= np.sqrt(np.minimum(best, 1 << 62).astype(np.float64)))
            if not len(rows):
                continue
            dist = squared(x[rows], c[members[g]])
            at = dist.argmin(axis=1)  # the first of equals: the least index
            least, index = dist[np.arange(len(rows)), at], members[g][at]
            wins = (least < best[rows]) | ((least == best[rows]) & (index < own[rows]))
            best[rows[wins]], own[rows[wins]] = least[wins], index[wins]
            second[g] = (rows, dist)
        for g, i in enumerate(members):
            home[np.isin(own, i)] = g
        for g, (rows, dist) in second.items():  # a fresh bound leaves out the row's own entry
            mine = home[rows] == g
            dist = dist.astype(np.float64)
            dist[np.flatnonzero(mine), np.searchsorted(members[g], own[rows[mine]])] = np.inf
            bound[rows, g], stamp[rows, g] = np.sqrt(dist.min(axis=1)), self.now
        moved = np.flatnonzero(known & (own != before))
        for g, i in enumerate(members):  # the entry that a row left counts in its group's bound again
            rows = moved[np.isin(before[moved], i)]
            if g in second:
                rows = np.setdiff1d(rows, second[g][0], assume_unique=True)
            low = np.minimum(left[rows, g], np.sqrt(far[rows].astype(np.float64)))
            bound[rows, g], stamp[rows, g] = np.maximum(low, 0), self.now
        return best


def compress(vectors: DataFrame, options: CodeOptions | None = None) -> DataFrame:
    """Codes of the vectors of a table with vec_id, embedding and label.

    Returns per kept row vec_id, label, code (an index per part, two hex digits each), error,
    label_error (error summed over equal labels, nulls together) and codebooks_sha256.

    Rows whose vector is null or holds a null or non-finite component are dropped. The first
    codebook takes the first rows by vec_id (nulls last; equal ids by their components), fewer
    if the table has fewer; repeated rows each count and get equal codes; ties go to the lower
    index. A vector whose length is not the longest, rounded up to a multiple of ``parts``,
    counts as ending in zeros (an empty one is all zeros); components stop at 2**26 either way.
    An empty table gives no rows. Other columns are ignored. Vectors have no texts.
    """
    o = options or CodeOptions()
    spark = vectors.sparkSession
    x = integers(F.col("embedding"), o.scale)
    rows = scratch.save(vectors.where(usable(F.col("embedding"))).select("vec_id", "label", x.alias("x")), "vectors")
    n, width = profile(rows)
    width = max(1, -(-width // o.parts)) * o.parts
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(o.entries).select("x").toArrow()
    start = matrix(first.column("x"), width)
    history = [start.reshape(len(start), o.parts, width // o.parts).transpose(1, 0, 2)]
    state, old = rows, [rows]
    types = rows.schema
    schema = f"vec_id {types['vec_id'].dataType.simpleString()}, label {types['label'].dataType.simpleString()}, x array<int>, own array<short>, error long, bound array<float>, stamp array<byte>"
    if n == 0:
        history = []
    for k in range(o.rounds + 1 if n else 0):
        new = scratch.save(state.mapInArrow(_assigning(history, o.groups, width), schema), "codes")
        scratch.drop(*old)
        state, old = new, [new]
        if k < o.rounds:
            history.append(_means(state, history[-1], width))
    text = ",".join(map(str, history[-1].reshape(-1).tolist())) if n else ""
    digest = hashlib.sha256(text.encode()).hexdigest()
    if n == 0:
        state = spark.createDataFrame([], schema)
    code = F.concat_ws("", F.transform("own", lambda e: F.lpad(F.lower(F.hex(e.cast("int"))), 2, "0")))
    coded = state.select("vec_id", "label", code.alias("code"), "error")
    return _with_label_errors(coded, n, o.hot).withColumn("codebooks_sha256", F.lit(digest))


def _assigning(history: list[np.ndarray], groups: int, width: int):
    parts, first = history[0].shape[0], len(history) == 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assigner = Assigner(history, groups)
        for batch in batches:
            x = matrix(batch.column("x"), width)
            n = len(x)
            cut = x.reshape(n, parts, width // parts)
            if first:
                own, bound, stamp = np.full((n, parts), -1), np.zeros((n, parts, groups)), np.zeros((n, parts, groups), np.int64)
            else:
                own, stamp = matrix(batch.column("own"), parts), matrix(batch.column("stamp"), parts * groups).reshape(n, parts, groups)
                bound = batch.column("bound").flatten().to_numpy().astype(np.float64).reshape(n, parts, groups)
            error = np.zeros(n, np.int64)
            for p in range(parts):
                error += assigner.part(p, cut[:, p], own[:, p], bound[:, p], stamp[:, p])
            low = np.nextafter(bound.astype(np.float32), np.float32(-np.inf))  # rounded down
            columns = [batch.column("vec_id"), batch.column("label"), batch.column("x"), lists(own, pa.int16()), pa.array(error), lists(low.reshape(n, -1), pa.float32()), lists(stamp.reshape(n, -1), pa.int8())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "x", "own", "error", "bound", "stamp"])

    return run


def _means(state: DataFrame, codebook: np.ndarray, width: int) -> np.ndarray:
    """The next codebook: sums per task and entry, added up by Spark; the result is of the codebook's size."""
    parts, entries, w = codebook.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, w), np.int64)
        for batch in batches:
            x, own = matrix(batch.column("x"), width).reshape(-1, parts, w), matrix(batch.column("own"), parts)
            for p in range(parts):
                count[p] += np.bincount(own[:, p], minlength=entries)
                np.add.at(total[p], own[:, p], x[:, p])
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(count[part, entry]), lists(total[part, entry], pa.int64())], ["part", "entry", "n", "total"])

    partial = state.select("x", "own").mapInArrow(sums, "part long, entry long, n long, total array<long>")
    spread = partial.select("part", "entry", "n", F.posexplode("total").alias("at", "v"))
    added = spread.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    out = codebook.copy()
    for r in added.collect():  # parts x entries x components
        out[r.part, r.entry, r.at] = int(r.v) // r.n
    return out


def _with_label_errors(coded: DataFrame, n: int, hot: int) -> DataFrame:
    """Add the sum of errors of equal labels. Labels with over 1 / ``hot`` of all rows, fewer than
    ``hot``, come by broadcast; the others by a join in which no key has more rows than that."""
    totals = scratch.save(coded.groupBy("label").agg(F.count(F.lit(1)).alias("rows"), F.sum("error").alias("label_error")).withColumnRenamed("label", "of"), "labels")
    often = F.broadcast(totals.where(F.col("rows") * hot > n).select("of", "label_error"))
    rest = totals.where(F.col("rows") * hot <= n).select("of", "label_error")
    same = coded["label"].eqNullSafe(totals["of"])
    met = coded.join(often, same).drop("of")
    rare = coded.join(often.select("of"), same, "left_anti").join(rest, same).drop("of")
    return met.unionByName(rare)
