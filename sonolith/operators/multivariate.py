"""Multivariate Stage 2.

Statistics are per asset and come from single partial aggregations; the only
Python step is the eigen-decomposition of each asset's tiny p x p matrix
(``applyInPandas`` over one row per asset).  Row scoring stays JVM-side.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonolith.operators.persistence import persistent_flag
from sonolith.operators.quantiles import quantile_table
from sonolith.operators.rules import severity, stage2_message
from sonolith.options import Options
from sonolith.plans.sizing import broadcast_if_small
from sonolith.session import cut_lineage

STAGE2_BASE = ("avg_decibel", "peak_decibel", "min_decibel", "peak_minus_avg", "avg_minus_min", "peak_minus_min")
OPTIONAL_SHARES = ("low_share", "mid_share", "high_share")


def stage2_features(df: DataFrame) -> list[str]:
    """6 base features + the band shares that exist (M1), decided at plan time."""
    return [c for c in STAGE2_BASE if c in df.columns] + [c for c in OPTIONAL_SHARES if c in df.columns]


def complete(features: Sequence[str]) -> Column:
    cond = F.lit(True)
    for f in features:
        cond = cond & F.col(f).isNotNull()
    return cond


def feature_stats(df: DataFrame, features: Sequence[str], keys: Sequence[str] = ("asset_id",), where: Column | None = None) -> DataFrame:
    """Per-asset mean and population std (ddof 0); std 0 becomes 1."""
    src = df if where is None else df.where(where)
    aggs = []
    for f in features:
        aggs.append(F.avg(f).alias(f"{f}_mean"))
        aggs.append(F.stddev_pop(f).alias(f"_{f}_sd"))
    stats = src.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *aggs)
    return stats.select(
        *keys,
        "n_rows",
        *[c for f in features for c in (F.col(f"{f}_mean"), F.when(F.col(f"_{f}_sd") == 0, F.lit(1.0)).otherwise(F.col(f"_{f}_sd")).alias(f"{f}_std"))],
    )


def standardize(df: DataFrame, stats: DataFrame, features: Sequence[str], keys: Sequence[str], max_rows: int, prefix: str = "z_") -> DataFrame:
    """(x - mean) / std with the asset's statistics (M2); stats are one row per asset."""
    keys = list(keys)
    s = stats.select(*keys, *[c for f in features for c in (f"{f}_mean", f"{f}_std")])
    j = df.join(broadcast_if_small(s, max_rows), keys, "left")
    return j.withColumns({f"{prefix}{f}": (F.col(f) - F.col(f"{f}_mean")) / F.col(f"{f}_std") for f in features}).drop(
        *[c for f in features for c in (f"{f}_mean", f"{f}_std")]
    )


def correlation_matrix(df: DataFrame, features: Sequence[str], keys: Sequence[str] = ("asset_id",)) -> DataFrame:
    """Pearson correlation of every feature pair over complete rows, long format (A10).

    ``covar_pop / (sd_a * sd_b)`` with ``try_divide``: a constant feature gives NULL
    instead of an ANSI division error.
    """
    keys = list(keys)
    src = df.where(complete(features))
    aggs = []
    for i, a in enumerate(features):
        aggs.append(F.stddev_pop(a).alias(f"_sd_{i}"))
        for j, b in enumerate(features):
            if j > i:
                aggs.append(F.covar_pop(a, b).alias(f"_cv_{i}_{j}"))
    wide = src.groupBy(*keys).agg(*aggs)
    entries = []
    for i, a in enumerate(features):
        for j, b in enumerate(features):
            if i == j:
                val = F.try_divide(F.col(f"_sd_{i}") * F.col(f"_sd_{i}"), F.col(f"_sd_{i}") * F.col(f"_sd_{i}"))
            else:
                lo, hi = min(i, j), max(i, j)
                val = F.try_divide(F.col(f"_cv_{lo}_{hi}"), F.col(f"_sd_{i}") * F.col(f"_sd_{j}"))
            entries.append(F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), val.cast("double").alias("corr")))
    return wide.select(*keys, F.explode(F.array(*entries)).alias("_e")).select(*keys, "_e.feature_a", "_e.feature_b", "_e.corr")


def quantile_per_key(df: DataFrame, col: str, q: float, opts: Options, keys: Sequence[str], out: str) -> DataFrame:
    """Linear-interpolated quantile per key (A12), exact with bounded memory or sketch-based."""
    return quantile_table(df.where(F.col(col).isNotNull()), list(keys), [(col, q, out)], opts)


def _eig_top2(features: list[str], keys: list[str]):
    p = len(features)

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, row in pdf.iterrows():
            m = np.zeros((p, p))
            for i in range(p):
                for j in range(i, p):
                    m[i, j] = m[j, i] = row[f"_xx_{i}_{j}"]
            vals, vecs = np.linalg.eigh(m)
            order = np.argsort(vals)[::-1][:2]
            rec = {k: row[k] for k in keys}
            for c, idx in enumerate(order, start=1):
                v = vecs[:, idx]
                if v[np.argmax(np.abs(v))] < 0:  # sign convention: largest loading positive
                    v = -v
                for i in range(p):
                    rec[f"pc{c}_w{i}"] = float(v[i])
            for c in range(len(order) + 1, 3):
                for i in range(p):
                    rec[f"pc{c}_w{i}"] = 0.0
            out.append(rec)
        cols = keys + [f"pc{c}_w{i}" for c in (1, 2) for i in range(p)]
        return pd.DataFrame(out, columns=cols)

    return fn


def pca_components(zdf: DataFrame, features: Sequence[str], keys: Sequence[str], prefix: str = "z_") -> DataFrame:
    """Top-2 principal axes per asset from the Gram matrix of standardised rows (M3).

    The Gram matrix is one partial aggregation (p(p+1)/2 sums); ``eigh`` runs on
    one small row per asset.  Right singular vectors of X equal eigenvectors of
    X^T X; the sign is fixed so the largest-magnitude loading is positive.
    """
    keys = list(keys)
    features = list(features)
    p = len(features)
    aggs = [F.sum(F.col(f"{prefix}{features[i]}") * F.col(f"{prefix}{features[j]}")).alias(f"_xx_{i}_{j}") for i in range(p) for j in range(i, p)]
    gram = zdf.groupBy(*keys).agg(*aggs)
    key_fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in gram.schema.fields if f.name in keys)
    schema = key_fields + ", " + ", ".join(f"pc{c}_w{i} double" for c in (1, 2) for i in range(p))
    return gram.groupBy(*keys).applyInPandas(_eig_top2(features, keys), schema)


def project(zdf: DataFrame, comps: DataFrame, features: Sequence[str], keys: Sequence[str], max_rows: int, prefix: str = "z_") -> DataFrame:
    keys = list(keys)
    j = zdf.join(broadcast_if_small(comps, max_rows), keys, "left")
    out = {}
    for c in (1, 2):
        expr = F.lit(0.0)
        for i, f in enumerate(features):
            expr = expr + F.col(f"{prefix}{f}") * F.col(f"pc{c}_w{i}")
        out[f"pc{c}"] = expr
    return j.withColumns(out).drop(*[f"pc{c}_w{i}" for c in (1, 2) for i in range(len(features))])


def run_stage2(
    df: DataFrame, opts: Options, keys: Sequence[str] = ("asset_id",), with_pca: bool = True, cut=None
) -> DataFrame:
    """Annotate every row with Stage-2 columns; rows with missing features stay NORMAL.

    Scores are kept in the same lineage (``when(complete, ...)``) instead of a
    row-id join back; persistence counts only complete rows (W7).  ``cut`` (e.g. a
    checkpoint) is applied to the scored rows before the ordered scans.
    """
    keys = list(keys)
    feats = stage2_features(df)
    ok = complete(feats)
    d = df.withColumn("stage2_complete", ok)
    stats = cut_lineage(feature_stats(d, feats, keys, where=F.col("stage2_complete")))
    z = standardize(d, stats, feats, keys, opts.scale.broadcast_max_rows)
    score = F.sqrt(sum((F.col(f"z_{f}") * F.col(f"z_{f}") for f in feats), F.lit(0.0)))
    z = z.withColumn("multivariate_score", F.when(F.col("stage2_complete"), score))
    thr = cut_lineage(quantile_per_key(z, "multivariate_score", opts.stage2.distance_quantile, opts, keys, "stage2_threshold"))
    z = z.join(broadcast_if_small(thr, opts.scale.broadcast_max_rows), keys, "left")
    z = z.withColumn("stage2_warning_now", F.col("stage2_complete") & (F.col("multivariate_score") >= F.col("stage2_threshold")))
    if with_pca:
        comps = cut_lineage(pca_components(z.where(F.col("stage2_complete")), feats, keys))
        z = project(z, comps, feats, keys, opts.scale.broadcast_max_rows)
        z = z.withColumns({c: F.when(F.col("stage2_complete"), F.col(c)) for c in ("pc1", "pc2")})
    if cut is not None:
        z = cut(z)
    z = persistent_flag(z, "stage2_warning_now", opts.stage2.persistence_windows, "stage2_persistent_warning", keys, eligible="stage2_complete")
    p, w = F.col("stage2_persistent_warning"), F.coalesce(F.col("stage2_warning_now"), F.lit(False))
    return z.withColumns({"stage2_severity": severity(p, w), "stage2_message": stage2_message(p, w)}).drop(
        *[f"z_{f}" for f in feats]
    )
