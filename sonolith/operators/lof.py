"""Local outlier factor in novelty mode (Breunig et al. 2000), exact k-NN (M8).

k-NN join without emitting all pairs:

1. Equal feature vectors are one point: of equal training rows only the ``k + 1`` least row ids
   can be among the nearest of any query, and equal query rows have one answer.
2. Training points are dealt to k-d cells over all axes, cut by counts (``kdcells``).
3. Each query meets its home cell; the (k+1)-th distance there bounds its true one. The cells
   that this ball touches are listed by walking the trees and measured by their boxes; the
   query meets the nearest ``knn_ring`` of them, which tightens the bound, and then those
   further out that the tighter ball still touches.
4. Each (cell, query chunk) group computes distances in numpy and emits exactly the best
   k+1 per query; a merge per query keeps the best.

The result is exact (ties by training row id).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonolith.operators.ensemble import FEATURE_SLOTS
from sonolith.operators.kdcells import CELL, box_distance, boxes, descend, grow, reach
from sonolith.options import Options
from sonolith.plans.sizing import broadcast_if_small
from sonolith.session import cut_lineage, write_table

#: Distances that a task works out at a time.
DISTANCES = 250_000
CAND_SCHEMA = "asset_key string, q_row long, d double, o long"


def _topk(n_feat: int):
    feats = FEATURE_SLOTS[:n_feat]

    def fn(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if q.empty or t.empty:
            return pd.DataFrame({"asset_key": [], "q_row": [], "d": [], "o": []})
        kk = int(q["kk"].iloc[0])
        qx = q[feats].to_numpy(dtype=float)
        tx = t[feats].to_numpy(dtype=float)
        trow = t["t_row"].to_numpy()
        torder = np.argsort(trow, kind="stable")
        tx, trow = tx[torder], trow[torder]
        outs_q, outs_d, outs_o = [], [], []
        step = max(1, DISTANCES // max(len(tx), 1))
        for s in range(0, len(qx), step):
            block = qx[s : s + step]
            diff = block[:, None, :] - tx[None, :, :]
            d = np.sqrt(np.einsum("ijk,ijk->ij", diff, diff))
            take = min(kk, d.shape[1])
            if take < d.shape[1]:
                cut = np.partition(d, take - 1, axis=1)[:, take - 1 : take]
                # of those tied with the cut value the first by row id, as many as are needed
                tied = d == cut
                mask = d < cut
                mask |= tied & (np.cumsum(tied, axis=1) <= take - mask.sum(axis=1, keepdims=True))
            else:
                mask = np.ones_like(d, dtype=bool)
            qi, ti = np.nonzero(mask)
            outs_q.append(q["q_row"].to_numpy()[s + qi])
            outs_d.append(d[qi, ti])
            outs_o.append(trow[ti])
        return pd.DataFrame(
            {"asset_key": q["asset_key"].iloc[0], "q_row": np.concatenate(outs_q), "d": np.concatenate(outs_d), "o": np.concatenate(outs_o)}
        )

    return fn


def _merge_top(cands: DataFrame, kk_max: int, kk_col: str = "kk") -> DataFrame:
    """Best ``kk`` candidates per query, ordered by (distance, row id).

    ``row_number() <= kk_max`` (a literal) lets Spark keep a partial top-k per
    query before the shuffle; only at most ``kk`` entries are collected.
    """
    w = Window.partitionBy("asset_key", "q_row").orderBy("d", "o")
    top = cands.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= F.lit(kk_max)).where(F.col("_r") <= F.col(kk_col))
    lst = F.array_sort(F.collect_list(F.struct(F.col("d"), F.col("o"))))
    return top.groupBy("asset_key", "q_row", kk_col).agg(lst.alias("nbrs"))


def knn(df: DataFrame, plan: DataFrame, opts: Options, keys: Sequence[str] = ("asset_id",)) -> DataFrame:
    """(asset_key, q_row, kk, k, nbrs: array<struct<d, o>>) for every valid row vs training rows."""
    keys = list(keys)
    n_feat = len(FEATURE_SLOTS)
    s3 = opts.stage3
    block_rows = opts.scale.knn_block_rows
    q_chunk_rows = opts.scale.knn_query_chunk_rows
    key = F.concat_ws("\u0001", *[F.col(c).cast("string") for c in keys])
    k = F.greatest(F.lit(2), F.least(F.lit(s3.lof_neighbors), F.greatest(F.lit(2), F.col("n_train") - 1)))
    p = plan.select(*keys, key.alias("asset_key"), k.cast("int").alias("k"), (k + 1).cast("int").alias("kk"))
    p = broadcast_if_small(p, opts.scale.broadcast_max_rows)

    feats, mx = list(FEATURE_SLOTS), opts.scale.broadcast_max_rows
    kk_max = max(2, s3.lof_neighbors) + 1

    same = Window.partitionBy("asset_key", *feats).orderBy("row_id")
    train = df.where(F.col("stage3_train")).select(*keys, "row_id", *feats).join(p, keys, "inner")
    train = train.select("asset_key", "row_id", *feats).withColumn("_r", F.row_number().over(same)).where(F.col("_r") <= kk_max).drop("_r")
    placed, rounds = grow(train, feats, block_rows, kk_max, opts.scale.knn_sample_rows, mx)

    rows = df.where(F.col("stage3_valid")).select(*keys, "row_id", *feats).join(p, keys, "inner")
    q = rows.groupBy("asset_key", "kk", *feats).agg(F.min("row_id").alias("q_row"))
    q = q.withColumn("cell", F.lit(1).cast("long"))
    for trees in rounds:
        q = descend(q, trees, feats, mx)
    q = write_table(q.withColumnRenamed("cell", "home"), "lof-query")

    def candidates(pairs: DataFrame) -> DataFrame:
        """pairs: (asset_key, cell, q_row, kk, f*) -> the top kk of each query in each cell."""
        chunks = pairs.groupBy(*CELL).agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / F.lit(q_chunk_rows))).cast("long").alias("n_qchunk"))
        chunks = broadcast_if_small(cut_lineage(chunks), mx)
        qs = pairs.join(chunks, CELL).withColumn("qchunk", F.pmod(F.xxhash64("q_row"), F.col("n_qchunk")))
        ts = placed.join(chunks, CELL).withColumn("qchunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_qchunk") - 1)))
        g = [*CELL, "qchunk"]
        # fresh aliases: both sides descend from the same rows (self co-group)
        ts = ts.select(*[F.col(x).alias(x) for x in g], F.col("row_id").alias("t_row"), *[F.col(x).alias(x) for x in feats])
        return qs.select(*g, "q_row", "kk", *feats).groupBy(*g).cogroup(ts.groupBy(*g)).applyInPandas(_topk(n_feat), CAND_SCHEMA)

    kk = q.select("asset_key", "q_row", "kk")
    found = write_table(candidates(q.withColumnRenamed("home", "cell")), "lof-home")
    if rounds:
        shapes = broadcast_if_small(cut_lineage(boxes(placed, feats)), mx)

        def within(met: DataFrame) -> DataFrame:
            """Radius per query from what it has met so far; every cell holds k + 1 points unless the asset has fewer."""
            top = _merge_top(met.join(kk, ["asset_key", "q_row"]), kk_max)
            radius = F.when(F.size("nbrs") >= F.col("kk"), F.element_at("nbrs", -1)["d"] * (1 + 1e-9)).otherwise(F.lit(float("inf")))
            return top.select("asset_key", "q_row", radius.alias("radius"))

        touched = reach(q.join(within(found), ["asset_key", "q_row"]), rounds, feats, "radius", mx).where("cell <> home")
        touched = touched.join(shapes, CELL).withColumn("away", box_distance(feats)).where("away <= radius")
        nearest = Window.partitionBy("asset_key", "q_row").orderBy("away", "cell")
        touched = write_table(touched.select("asset_key", "q_row", "cell", "away", F.row_number().over(nearest).alias("place")), "lof-touched")
        points = q.drop("home")
        ring = write_table(touched.where(F.col("place") <= opts.scale.knn_ring).select("asset_key", "q_row", "cell"), "lof-ring")
        found = found.unionByName(write_table(candidates(ring.join(points, ["asset_key", "q_row"])), "lof-near"))
        outer = touched.where(F.col("place") > opts.scale.knn_ring).join(within(found), ["asset_key", "q_row"]).where("away <= radius")
        outer = write_table(outer.select("asset_key", "q_row", "cell"), "lof-outer")
        found = found.unionByName(candidates(outer.join(points, ["asset_key", "q_row"])))
    best = _merge_top(found.join(kk, ["asset_key", "q_row"]), kk_max).drop("kk")
    best = best.join(q.select("asset_key", "q_row", *feats), ["asset_key", "q_row"]).drop("q_row")
    out = rows.withColumnRenamed("row_id", "q_row").join(best, ["asset_key", *feats])
    return write_table(out.select(*keys, "asset_key", "q_row", "kk", "k", "nbrs"), "lof-knn")


def lof_scores(df: DataFrame, plan: DataFrame, opts: Options, keys: Sequence[str] = ("asset_id",)) -> DataFrame:
    """LOF(x) for every valid row (keys, row_id, lof): mean lrd of the k nearest
    training rows over the row's own lrd; training lrd excludes the row itself,
    a training row queried as a new point counts itself (novelty scoring)."""
    keys = list(keys)
    nb = knn(df, plan, opts, keys)
    train_ids = df.where(F.col("stage3_train")).select(*keys, F.col("row_id").alias("q_row"))
    tr = nb.join(train_ids, keys + ["q_row"], "left_semi")
    own = F.slice(F.filter("nbrs", lambda x: x["o"] != F.col("q_row")), 1, F.col("k"))
    tr = tr.withColumn("own", own).withColumn("kdist", F.element_at("own", F.col("k"))["d"])
    kd = tr.select("asset_key", F.col("q_row").alias("o"), "kdist")
    ex = tr.select("asset_key", "q_row", F.explode("own").alias("n")).select("asset_key", "q_row", F.col("n.d").alias("d"), F.col("n.o").alias("o"))
    lrd_t = (
        ex.join(kd, ["asset_key", "o"], "inner")
        .groupBy("asset_key", "q_row")
        .agg((F.lit(1.0) / (F.avg(F.greatest(F.col("kdist"), F.col("d"))) + F.lit(1e-10))).alias("lrd"))
    )
    stats = write_table(kd.join(lrd_t.withColumnRenamed("q_row", "o"), ["asset_key", "o"], "inner"), "lof-train-stats")
    qn = nb.select(*keys, "asset_key", "q_row", F.explode(F.slice("nbrs", 1, F.col("k"))).alias("n")).select(
        *keys, "asset_key", "q_row", F.col("n.d").alias("d"), F.col("n.o").alias("o")
    )
    agg = (
        qn.join(stats, ["asset_key", "o"], "inner")
        .groupBy(*keys, "q_row")
        .agg(
            (F.lit(1.0) / (F.avg(F.greatest(F.col("kdist"), F.col("d"))) + F.lit(1e-10))).alias("lrd_q"),
            F.avg("lrd").alias("lrd_nbrs"),
        )
    )
    return agg.select(*keys, F.col("q_row").alias("row_id"), (F.col("lrd_nbrs") / F.col("lrd_q")).alias("lof"))
