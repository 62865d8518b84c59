"""k-d cells over all feature axes, cut by counts, and searches through them.

An asset's rows start in one cell. In each round every cell with over twice the target gets a
small tree: median cuts along its widest axis, worked out from a bounded sample of the cell,
as deep as the cell's count asks for. Rows then move to the tree's leaves and are counted
again, so the size of a cell rests on counts of all rows, and a table of any size takes a few
rounds (each divides cells by up to 1024). Trees are rows of arrays in heap order; a point
walks down, and a ball spreads out over, a tree inside JVM expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonolith.plans.sizing import broadcast_if_small
from sonolith.session import cut_lineage, write_table

CELL = ["asset_key", "cell"]
DEPTH = 10
ROUNDS = 5  # 1024 ** 5 cells
_FAN = 1 << (DEPTH + 1)
_TREE = "asset_key string, cell long, depth int, axis array<int>, value array<double>"


def cut(x: np.ndarray, depth: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Axis and value of each inner node of a tree of that depth, in heap order from 1; rows
    with more than the value go right. Each side keeps ``least`` rows or more; a node for which
    no axis allows that, the widest tried first, sends all rows left."""
    axis, value = np.zeros(1 << depth, np.int32), np.full(1 << depth, np.inf)
    rows = {1: np.arange(len(x))}
    for node in range(1, 1 << depth):
        own = rows.pop(node)
        spread = np.ptp(x[own], axis=0) if len(own) >= 2 * least else np.zeros(0)
        for a in np.argsort(-spread, kind="stable").tolist():
            v = np.sort(x[own, a])
            ends = np.flatnonzero(v[:-1] < v[1:])  # last rows of runs of equal values
            ends = ends[(ends + 1 >= least) & (len(v) - 1 - ends >= least)]
            if len(ends):
                axis[node], value[node] = a, v[ends[np.abs(2 * ends + 2 - len(v)).argmin()]]
                break
        right = x[own, axis[node]] > value[node]
        rows[2 * node], rows[2 * node + 1] = own[~right], own[right]
    return axis, value


def _features(feats: Sequence[str]) -> Column:
    return F.array(*[F.col(f) for f in feats])


def descend(rows: DataFrame, trees: DataFrame, feats: Sequence[str], max_rows: int) -> DataFrame:
    """Move rows from cells that have a tree to its leaves."""
    j = rows.join(broadcast_if_small(trees, max_rows), CELL, "left").withColumn("_x", _features(feats))
    leaf = F.expr("aggregate(sequence(1, depth), 1, (n, i) -> 2 * n + if(_x[axis[n]] > value[n], 1, 0))")
    cell = F.when(F.col("depth").isNotNull(), F.col("cell") * _FAN + leaf).otherwise(F.col("cell"))
    return j.withColumn("cell", cell).drop("depth", "axis", "value", "_x")


def reach(queries: DataFrame, rounds: list[DataFrame], feats: Sequence[str], radius: str, max_rows: int) -> DataFrame:
    """A row per query and cell that the ball around the query may touch."""
    out = queries.withColumn("cell", F.lit(1).cast("long")).withColumn("_x", _features(feats))
    spread = f"""aggregate(sequence(1, depth), cast(array(1) as array<int>), (nodes, i) -> flatten(transform(nodes, n -> filter(
        array(if(_x[axis[n]] - {radius} <= value[n], 2 * n, 0), if(_x[axis[n]] + {radius} > value[n], 2 * n + 1, 0)), m -> m > 0))))"""
    for trees in rounds:
        j = out.join(broadcast_if_small(trees, max_rows), CELL, "left")
        cells = F.when(F.col("depth").isNull(), F.array("cell")).otherwise(F.transform(F.expr(spread), lambda n: F.col("cell") * _FAN + n))
        out = j.withColumn("cell", F.explode(cells)).drop("depth", "axis", "value")
    return out.drop("_x")


def grow(rows: DataFrame, feats: Sequence[str], target: int, least: int, sample: int, max_rows: int) -> tuple[DataFrame, list[DataFrame]]:
    """``rows`` (asset_key, row_id, features) with their ``cell``, and the trees of each round.

    A cell with over ``2 * target`` rows is cut further unless too many of its rows are equal; no
    cell falls below ``least`` rows, as its leaf in the sample has that many."""

    def tree(pdf: pd.DataFrame) -> pd.DataFrame:
        x, n = pdf[list(feats)].to_numpy(dtype=float), int(pdf["_n"].iloc[0])
        depth = min(DEPTH, int(np.ceil(np.log2(n / target))), int(np.log2(max(1, len(x) / least))))
        axis, value = cut(x, max(depth, 0), least)
        if not np.isfinite(value).any():
            return pd.DataFrame({c: pd.Series([], dtype=t) for c, t in (("asset_key", object), ("cell", "int64"), ("depth", "int32"), ("axis", object), ("value", object))})
        return pd.DataFrame({"asset_key": pdf["asset_key"].iloc[:1], "cell": pdf["cell"].iloc[:1], "depth": [depth], "axis": [axis.tolist()], "value": [value.tolist()]})

    placed, rounds = write_table(rows.withColumn("cell", F.lit(1).cast("long")), "kd-rows"), []
    order = Window.partitionBy(*CELL).orderBy(F.xxhash64("row_id"), "row_id")
    while len(rounds) < ROUNDS:
        crowded = cut_lineage(placed.groupBy(*CELL).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 2 * target))
        some = placed.join(broadcast_if_small(crowded, max_rows), CELL).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= sample)
        trees = cut_lineage(some.groupBy(*CELL).applyInPandas(tree, _TREE))
        if trees.isEmpty():
            break
        rounds.append(trees)
        placed = write_table(descend(placed, trees, feats, max_rows), "kd-rows")
    return placed, rounds


def boxes(placed: DataFrame, feats: Sequence[str]) -> DataFrame:
    """Per cell the least box that holds its rows, and their number."""
    return placed.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n_t"), *[e for f in feats for e in (F.min(f).alias(f"_lo_{f}"), F.max(f).alias(f"_hi_{f}"))])


def box_distance(feats: Sequence[str]) -> Column:
    """Distance from a row's features to the box joined to it."""
    off = [F.greatest(F.col(f"_lo_{f}") - F.col(f), F.col(f) - F.col(f"_hi_{f}"), F.lit(0.0)) for f in feats]
    return F.sqrt(sum((o * o for o in off), F.lit(0.0)))
