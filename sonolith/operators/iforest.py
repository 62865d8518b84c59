"""Isolation forest (Liu, Ting & Zhou 2008) as Spark jobs (M9).

* Sub-samples: every tree draws its own ``m = min(256, n_train)`` rows.  Each (tree, row) is
  taken with probability q (about 1.75 m / n), independently, by a keyed hash; the tree keeps
  the m least hashes of them.  A row finds the first tree that takes it in one step (geometric
  skip), so only rows that some tree takes look at the other trees: no rows x trees are emitted,
  and the m least are cut before the shuffle.
* Growth: a row and its draws travel once (an array of tree and place), so an asset's group has at
  most about 1.75 m rows per tree. All its trees are cut to their m least places and grow level by
  level together (random feature among non-constant ones, uniform threshold, depth limit
  ceil(log2 m)); nodes are numbered as in a heap and draw from the hash of (seed, asset, tree, node).
  The forest is one row per asset.
* Scoring: rows are split into bounded chunks per asset and co-grouped with the asset's forest;
  they walk down all its trees at once in numpy.
  s(x) = 2^(-E[h(x)] / c(m)).  Path lengths are multiples of 2^-20: their sums are exact in any order.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonolith.operators.ensemble import FEATURE_SLOTS
from sonolith.options import Options
from sonolith.plans.sizing import broadcast_if_small

EULER_GAMMA = 0.5772156649015329


def average_path_length(n: np.ndarray | float) -> np.ndarray:
    """c(n): mean path length of an unsuccessful BST search (0 for n <= 1, 1 for n = 2)."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    two = n == 2
    big = n > 2
    out[two] = 1.0
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER_GAMMA) - 2.0 * (n[big] - 1.0) / n[big]
    return out


def path_units(n: np.ndarray | float) -> np.ndarray:
    """c(n) to the nearest multiple of 2^-20."""
    return np.floor(average_path_length(n) * 2.0**20 + 0.5) / 2.0**20


def unit_hash(*cols) -> F.Column:
    """Deterministic uniform [0, 1) from columns (stable under task retries)."""
    h = F.xxhash64(*cols)
    return (F.pmod(h, F.lit(2**53)).cast("double")) / F.lit(float(2**53))


def _digest(*parts) -> F.Column:
    """MD5 of the parts: its first 13 hex digits and the next 13 are two independent uniform numbers."""
    return F.md5(F.concat_ws("|", *parts))


def _draw(digest: F.Column, at: int) -> F.Column:
    """Uniform [0, 2^52) from the 13 hex digits at that place, as :func:`_node_draws` has them."""
    return F.conv(F.substring(digest, at, 13), 16, 10).cast("long")


def _node_draws(seed: int, asset: str, tree: int, node: int) -> tuple[float, float]:
    digest = hashlib.md5(f"{seed}|{asset}|{tree}|n{node}".encode()).hexdigest()
    return int(digest[:13], 16) / 2.0**52, int(digest[13:26], 16) / 2.0**52


def on_grid(x: F.Column) -> F.Column:
    """The nearest multiple of 2^-30: rounding noise of a standardised value must not make a constant feature vary."""
    return F.floor(x * F.lit(2.0**30) + F.lit(0.5)) / F.lit(2.0**30)


def take_rate(m, n):
    """Chance of a row to be drawn by one tree: the count drawn falls below m once in over 10^9 trees."""
    return F.least(F.lit(1.0), (m + 12.0 * F.sqrt(m)) / n)


def drawn(train: DataFrame, plan: DataFrame, opts: Options, keys: Sequence[str]) -> DataFrame:
    """The training rows that some tree draws, with ``draws``: an array of (tree, place).

    ``plan`` has one row per asset: keys, asset_key, m, n_train.  Draws of different trees are
    independent; repeated runs and retried tasks draw the same rows.
    """
    s3 = opts.stage3
    n_trees, seed = s3.iforest_trees, F.lit(s3.random_state)
    d = train.join(plan.select(*keys, "asset_key", "m", take_rate(F.col("m"), F.col("n_train")).alias("_q")), list(keys), "inner")
    skip = _draw(_digest(seed, F.col("asset_key"), F.col("row_id")), 1) / F.lit(2.0**52)
    d = d.withColumn(
        "_first", F.when(F.col("_q") >= 1.0, F.lit(0)).otherwise(F.floor(F.log1p(-skip) / F.log1p(-F.col("_q")))).cast("long")
    ).where(F.col("_first") < n_trees)
    # a draw is below q if its hex digits come before those of q * 2^52 (all do where q is 1)
    least = F.lower(F.lpad(F.hex(F.ceil(F.col("_q") * F.lit(2.0**52))), 13, "0"))
    d = d.withColumns(
        {
            "_least": F.when(F.col("_q") >= 1.0, F.lit("g")).otherwise(least),
            "_head": F.concat_ws("|", seed, F.col("asset_key")),
            "_tail": F.col("row_id").cast("string"),
        }
    )
    trees = F.sequence(F.col("_first").cast("int"), F.lit(n_trees - 1))
    each = F.transform(trees, lambda t: F.struct(t.alias("tree"), _digest(F.col("_head"), t.cast("string"), F.col("_tail")).alias("digest")))
    each = F.filter(each, lambda e: (e["tree"] == F.col("_first")) | (F.substring(e["digest"], 1, 13) < F.col("_least")))
    draws = F.transform(each, lambda e: F.struct(e["tree"].alias("tree"), _draw(e["digest"], 14).alias("place")))
    return d.withColumn("draws", draws).drop("_q", "_first", "_least", "_head", "_tail")


def tree_samples(train: DataFrame, plan: DataFrame, opts: Options, keys: Sequence[str]) -> DataFrame:
    """(keys, asset_key, tree, m, row_id, features): a simple random sample of the training rows per tree."""
    d = drawn(train, plan, opts, keys).withColumn("_e", F.explode("draws"))
    d = d.withColumns({"tree": F.col("_e.tree").cast("long"), "_place": F.col("_e.place")})
    w = Window.partitionBy(*keys, "tree").orderBy("_place", "row_id")
    return d.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= opts.stage3.iforest_max_samples).drop("draws", "_e", "_place", "_rank")


def grow_trees(x: np.ndarray, tree: np.ndarray, seed: int, asset: str, m: int) -> dict[str, np.ndarray]:
    """All trees of an asset from their rows ``x`` and each row's tree: nodes level by level, the
    roots first. An inner node has a feature, a threshold and its left child (the right one is
    next to it); a leaf has feature -1 and its path length as the threshold."""
    max_depth = int(math.ceil(math.log2(max(m, 2))))
    rows = np.argsort(tree, kind="stable")
    of, counts = np.unique(tree, return_counts=True)
    roots = len(of)
    heap = [1] * roots
    feature, threshold, left = [], [], []
    known = 0
    for depth in range(max_depth + 1):
        known += len(of)
        starts, some = np.cumsum(counts) - counts, counts > 0
        lo, hi = np.zeros((len(of), x.shape[1])), np.zeros((len(of), x.shape[1]))
        if len(rows):
            here = x[rows]
            lo[some], hi[some] = np.minimum.reduceat(here, starts[some], axis=0), np.maximum.reduceat(here, starts[some], axis=0)
        varying = hi > lo
        ways = varying.sum(axis=1)
        f, t, to = np.full(len(of), -1), depth + path_units(counts), np.full(len(of), -1)
        inner = np.flatnonzero(ways) if depth < max_depth else np.zeros(0, int)
        if len(inner):
            draws = np.array([_node_draws(seed, asset, int(of[i]), heap[i]) for i in inner.tolist()])
            nth = (draws[:, 0] * ways[inner]).astype(int)
            f[inner] = np.argsort(~varying[inner], axis=1, kind="stable")[np.arange(len(inner)), nth]
            low = lo[inner, f[inner]]
            t[inner] = low + draws[:, 1] * (hi[inner, f[inner]] - low)
            to[inner] = known + 2 * np.arange(len(inner))
        feature.append(f)
        threshold.append(t)
        left.append(to)
        if not len(inner):
            break
        node = np.repeat(np.arange(len(of)), counts)
        split = f[node] >= 0
        rows, node = rows[split], node[split]
        child = to[node] - known + ~(x[rows, f[node]] <= t[node])
        rows = rows[np.argsort(child, kind="stable")]
        counts = np.bincount(child, minlength=2 * len(inner))
        of, heap = np.repeat(of[inner], 2), [2 * heap[i] + k for i in inner.tolist() for k in (0, 1)]
    return {"roots": np.int32(roots), "feature": np.concatenate(feature).astype(np.int32), "threshold": np.concatenate(threshold), "left": np.concatenate(left).astype(np.int32)}


def _grow(seed: int, most: int):
    """The forest of an asset from the rows that its trees draw; each tree keeps its ``most`` least places."""

    def grow(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        draws = rows.column("draws").combine_chunks()
        own = np.repeat(np.arange(len(draws)), draws.value_lengths().to_numpy())
        tree, place = (draws.flatten().field(i).to_numpy() for i in (0, 1))
        row_id = rows.column("row_id").to_numpy()
        order = np.lexsort((row_id[own], place, tree))
        tree, own = tree[order], own[order]
        new = np.append(True, tree[1:] != tree[:-1])
        keep = np.arange(len(tree)) - np.flatnonzero(new)[np.cumsum(new) - 1] < most
        x = np.column_stack([rows.column(f).to_numpy() for f in FEATURE_SLOTS])
        asset = rows.column("asset_key")[0].as_py()
        out = grow_trees(x[own[keep]], tree[keep], seed, asset, int(rows.column("m")[0].as_py()))
        lists = [pa.array([out[c].tolist()], t) for c, t in (("feature", pa.list_(pa.int32())), ("threshold", pa.list_(pa.float64())), ("left", pa.list_(pa.int32())))]
        return pa.Table.from_arrays([pa.array([asset]), pa.array([int(out["roots"])], pa.int32()), *lists], names=["asset_key", "roots", "feature", "threshold", "left"])

    return grow


FOREST_SCHEMA = "asset_key string, roots int, feature array<int>, threshold array<double>, left array<int>"
#: Rows x trees that a task walks at a time.
WALKS = 500_000


def path_sums(x: np.ndarray, roots: int, feature: np.ndarray, threshold: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Per row the sum of its path lengths over the trees."""
    total, inner = np.zeros(len(x)), feature >= 0
    step = max(1, WALKS // max(roots, 1))
    for s in range(0, len(x), step):
        block = x[s : s + step]
        row = np.repeat(np.arange(len(block)), roots)
        at = np.tile(np.arange(roots), len(block))
        open_ = np.flatnonzero(inner[at])
        while len(open_):
            node = at[open_]
            node = left[node] + ~(block[row[open_], feature[node]] <= threshold[node])
            at[open_] = node
            open_ = open_[inner[node]]
        total[s : s + step] = threshold[at].reshape(len(block), roots).sum(axis=1)
    return total


def _score(rows: pd.DataFrame, forest: pd.DataFrame) -> pd.DataFrame:
    if rows.empty:
        return pd.DataFrame({"asset_key": [], "row_id": [], "iforest_s": []})
    x = rows[FEATURE_SLOTS].to_numpy(dtype=float)
    total, n_trees = np.zeros(len(x)), 0
    if len(forest):
        n_trees = int(forest["roots"].iloc[0])
        total = path_sums(x, n_trees, *(np.asarray(forest[c].iloc[0]) for c in ("feature", "threshold", "left")))
    mean_path = total / max(n_trees, 1)
    s = np.power(2.0, -mean_path / float(average_path_length(float(rows["m"].iloc[0]))))
    return pd.DataFrame({"asset_key": rows["asset_key"].to_numpy(), "row_id": rows["row_id"].to_numpy(), "iforest_s": s})


def iforest_scores(df: DataFrame, plan: DataFrame, opts: Options, keys: Sequence[str] = ("asset_id",)) -> DataFrame:
    """Raw isolation score s(x) in (0, 1] for every valid row: (keys, row_id, iforest_s)."""
    keys = list(keys)
    s3 = opts.stage3
    df = df.withColumns({f: on_grid(F.col(f)) for f in FEATURE_SLOTS})
    key = F.concat_ws("\u0001", *[F.col(k).cast("string") for k in keys])
    p = plan.select(
        *keys,
        key.alias("asset_key"),
        F.least(F.lit(s3.iforest_max_samples), F.col("n_train")).cast("long").alias("m"),
        "n_train",
        "n_valid",
    )
    p = broadcast_if_small(p, opts.scale.broadcast_max_rows)
    rows = drawn(df.where(F.col("stage3_train")).select(*keys, "row_id", *FEATURE_SLOTS), p, opts, keys)
    rows = rows.select("asset_key", "m", "row_id", "draws", *FEATURE_SLOTS)
    forest = rows.groupBy("asset_key").applyInArrow(_grow(s3.random_state, s3.iforest_max_samples), FOREST_SCHEMA)

    # score valid rows in bounded chunks per asset; the forest is replicated per chunk
    chunk_rows = opts.scale.chunk_rows
    p2 = p.withColumn("n_chunks", F.greatest(F.lit(1), F.ceil(F.col("n_valid") / F.lit(chunk_rows))).cast("long"))
    valid = df.where(F.col("stage3_valid")).select(*keys, "row_id", *FEATURE_SLOTS).join(
        p2.select(*keys, "asset_key", "m", "n_chunks"), keys, "inner"
    )
    valid = valid.withColumn("chunk", F.pmod(F.xxhash64("row_id"), F.col("n_chunks")))
    chunk_keys = p2.select("asset_key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_chunks") - 1)).alias("chunk"))
    rep = forest.join(chunk_keys, "asset_key", "inner")
    out_schema = "asset_key string, row_id long, iforest_s double"
    scored = (
        valid.select("asset_key", "chunk", "row_id", "m", *FEATURE_SLOTS)
        .groupBy("asset_key", "chunk")
        .cogroup(rep.select(*[F.col(x).alias(x) for x in rep.columns]).groupBy("asset_key", "chunk"))
        .applyInPandas(_score, out_schema)
    )
    return scored.join(p.select(*keys, "asset_key"), "asset_key", "inner").select(*keys, "row_id", "iforest_s")
