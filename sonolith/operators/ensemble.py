"""Stage 3: feature choice, training set, scaling, per-model thresholds,
normalisation, votes and consensus (M6, M7, M11-M13).

Every statistic is per asset.  Features are carried as a fixed list of
standardised columns ``f0..f6``; an asset that uses only the four base features
gets zeros in the share slots, which changes no distance, split or kernel value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonolith.functions.vocab import REDUCED_QUALITY
from sonolith.operators.multivariate import OPTIONAL_SHARES
from sonolith.operators.quantiles import quantile_table
from sonolith.options import Options
from sonolith.plans.sizing import broadcast_if_small
from sonolith.session import cut_lineage

STAGE3_BASE = ("avg_decibel", "peak_minus_avg", "avg_minus_min", "peak_minus_min")
FEATURE_SLOTS = [f"f{i}" for i in range(len(STAGE3_BASE) + len(OPTIONAL_SHARES))]


def _all_not_null(cols: Sequence[str]) -> Column:
    c = F.lit(True)
    for x in cols:
        c = c & F.col(x).isNotNull()
    return c


def min_training_rows(n_features: Column | int) -> Column:
    return F.greatest(F.lit(250), F.lit(5) * (n_features if isinstance(n_features, Column) else F.lit(n_features)))


def training_plan(df: DataFrame, opts: Options, keys: Sequence[str] = ("asset_id",)) -> DataFrame:
    """Per asset: feature set, valid/training counts and the training rule (M6, M7).

    Shares are used only if all three exist and at least max(250, 5 * 7) rows are
    complete with them; training drops reduced-quality / near-gap rows unless
    fewer than max(250, 5 * features) remain, then all valid rows train.
    """
    keys = list(keys)
    base = [c for c in STAGE3_BASE if c in df.columns]
    if len(base) < 2:
        raise ValueError("Stage 3 needs at least two base feature columns")
    shares_exist = all(c in df.columns for c in OPTIONAL_SHARES)
    ts_ok = F.col("timestamp").isNotNull()
    base_ok = _all_not_null(base) & ts_ok
    cand_ok = _all_not_null(base + list(OPTIONAL_SHARES)) & ts_ok if shares_exist else F.lit(False)
    s3 = opts.stage3
    quality_ok = F.lit(True)
    if s3.exclude_reduced_quality_from_training:
        quality_ok = quality_ok & ~F.coalesce(F.col("quality_flag") == F.lit(REDUCED_QUALITY), F.lit(False))
    if s3.exclude_near_gap_from_training:
        quality_ok = quality_ok & ~F.coalesce(F.col("near_gap_flag"), F.lit(False))
    n_cand = len(base) + len(OPTIONAL_SHARES)
    plan = df.groupBy(*keys).agg(
        F.count_if(cand_ok).alias("_n_cand"),
        F.count_if(base_ok).alias("_n_base"),
        F.count_if(cand_ok & quality_ok).alias("_n_cand_q"),
        F.count_if(base_ok & quality_ok).alias("_n_base_q"),
    )
    use_shares = F.lit(shares_exist) & (F.col("_n_cand") >= min_training_rows(n_cand))
    n_feat = F.when(use_shares, F.lit(n_cand)).otherwise(F.lit(len(base)))
    n_valid = F.when(use_shares, F.col("_n_cand")).otherwise(F.col("_n_base"))
    n_q = F.when(use_shares, F.col("_n_cand_q")).otherwise(F.col("_n_base_q"))
    plan = plan.select(
        *keys,
        use_shares.alias("use_shares"),
        n_feat.alias("n_features"),
        n_valid.alias("n_valid"),
        n_q.alias("_n_q"),
        (n_q >= min_training_rows(n_feat)).alias("quality_filtered"),
    )
    return plan.withColumns(
        {
            "n_train": F.when(F.col("quality_filtered"), F.col("_n_q")).otherwise(F.col("n_valid")),
            "scored": F.col("n_valid") >= F.lit(10),
        }
    ).drop("_n_q")


def annotate_training(df: DataFrame, plan: DataFrame, opts: Options, keys: Sequence[str] = ("asset_id",)) -> DataFrame:
    """Adds ``stage3_valid``, ``stage3_train`` and raw feature slots ``x0..x6``."""
    keys = list(keys)
    base = [c for c in STAGE3_BASE if c in df.columns]
    shares = list(OPTIONAL_SHARES) if all(c in df.columns for c in OPTIONAL_SHARES) else []
    j = df.join(broadcast_if_small(plan, opts.scale.broadcast_max_rows), keys, "left")
    use = F.coalesce(F.col("use_shares"), F.lit(False))
    valid = F.coalesce(F.col("scored"), F.lit(False)) & F.col("timestamp").isNotNull() & _all_not_null(base) & (
        ~use | _all_not_null(shares) if shares else F.lit(True)
    )
    s3 = opts.stage3
    quality_ok = F.lit(True)
    if s3.exclude_reduced_quality_from_training:
        quality_ok = quality_ok & ~F.coalesce(F.col("quality_flag") == F.lit(REDUCED_QUALITY), F.lit(False))
    if s3.exclude_near_gap_from_training:
        quality_ok = quality_ok & ~F.coalesce(F.col("near_gap_flag"), F.lit(False))
    train = valid & (~F.col("quality_filtered") | quality_ok)
    slots = {}
    for i, c in enumerate(base):
        slots[f"x{i}"] = F.col(c)
    for i in range(len(base), len(FEATURE_SLOTS)):
        share = shares[i - len(base)] if shares and i - len(base) < len(shares) else None
        slots[f"x{i}"] = F.when(use, F.col(share)).otherwise(F.lit(0.0)) if share else F.lit(0.0)
    return j.withColumns({"stage3_valid": valid, "stage3_train": train, **slots})


def scale_features(df: DataFrame, opts: Options, keys: Sequence[str] = ("asset_id",)) -> DataFrame:
    """Standardise ``x*`` with training mean / population std (0 -> 1) into ``f*`` (M2)."""
    keys = list(keys)
    n = len(FEATURE_SLOTS)
    train = df.where(F.col("stage3_train"))
    aggs = []
    for i in range(n):
        aggs += [F.avg(f"x{i}").alias(f"_m{i}"), F.stddev_pop(f"x{i}").alias(f"_s{i}")]
    stats = train.groupBy(*keys).agg(*aggs)
    stats = stats.select(
        *keys, *[c for i in range(n) for c in (F.col(f"_m{i}"), F.when(F.col(f"_s{i}") == 0, 1.0).otherwise(F.col(f"_s{i}")).alias(f"_s{i}"))]
    )
    j = df.join(broadcast_if_small(cut_lineage(stats), opts.scale.broadcast_max_rows), keys, "left")
    return j.withColumns(
        {f"f{i}": F.when(F.col("stage3_valid"), (F.col(f"x{i}") - F.col(f"_m{i}")) / F.col(f"_s{i}")) for i in range(n)}
    ).drop(*[f"_m{i}" for i in range(n)], *[f"_s{i}" for i in range(n)], *[f"x{i}" for i in range(n)])


def thresholds_and_norms(scored: DataFrame, models: Sequence[str], opts: Options, keys: Sequence[str] = ("asset_id",)) -> DataFrame:
    """Per asset and model: threshold = (1 - contamination) quantile of training
    scores (M11); q05/q95 of all scored rows for normalisation (M12)."""
    keys = list(keys)
    c = opts.stage3.clamped_contamination
    valid = scored.where(F.col("stage3_valid"))
    thr = quantile_table(
        valid.where(F.col("stage3_train")), keys, [(f"stage3_{m}_score", 1.0 - c, f"stage3_{m}_threshold") for m in models], opts
    )
    norms = quantile_table(
        valid, keys, [(f"stage3_{m}_score", q, f"_{m}_q{int(q * 100):02d}") for m in models for q in (0.05, 0.95)], opts
    )
    return norms.join(thr, keys, "left")


def combine(scored: DataFrame, stats: DataFrame, models: Sequence[str], opts: Options, keys: Sequence[str] = ("asset_id",)) -> DataFrame:
    """Flags, normalised scores, votes, consensus, warning/strong; defaults for
    unscored rows (flags False, votes 0, scores and consensus 0.0) (M12, M13, J6)."""
    keys = list(keys)
    j = scored.join(broadcast_if_small(stats, opts.scale.broadcast_max_rows), keys, "left")
    v = F.col("stage3_valid")
    out = {}
    for m in models:
        s = F.col(f"stage3_{m}_score")
        lo, hi = F.col(f"_{m}_q05"), F.col(f"_{m}_q95")
        close = F.abs(lo - hi) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(hi)
        norm = F.when(close, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (s - lo) / (hi - lo))))
        out[f"stage3_{m}_flag"] = F.coalesce(v & (s >= F.col(f"stage3_{m}_threshold")), F.lit(False))
        out[f"stage3_{m}_score_norm"] = F.when(v, norm)
    j = j.withColumns(out)
    votes = sum((F.col(f"stage3_{m}_flag").cast("int") for m in models), F.lit(0))
    consensus = sum((F.col(f"stage3_{m}_score_norm") for m in models), F.lit(0.0)) / F.lit(float(len(models)))
    j = j.withColumns(
        {
            "stage3_votes": votes,
            "stage3_consensus_score": F.when(v, consensus).otherwise(F.lit(0.0)),
            **{f"stage3_{m}_score": F.when(v, F.col(f"stage3_{m}_score")).otherwise(F.lit(0.0)) for m in models},
        }
    )
    j = j.withColumns({"stage3_warning_now": F.col("stage3_votes") >= 1, "stage3_strong_now": F.col("stage3_votes") >= 2})
    return j.drop(*[f"_{m}_{q}" for m in models for q in ("q05", "q95")])
