"""Robust baselines (A1-A8), baseline joins (J1-J2) and robust z."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonolith.functions.vocab import GRANULARITY_HOUR, GRANULARITY_WEEKDAY_HOUR
from sonolith.operators.quantiles import RUN, merge_runs, quantile_table, run_quantiles, value_runs
from sonolith.options import Options
from sonolith.plans.sizing import broadcast_if_small
from sonolith.session import cut_lineage, write_table

BASELINE_METRICS = ("avg_decibel", "peak_minus_avg", "peak_minus_min")
MAD_SCALE = 1.4826
MIN_SCALE = 1e-9


def group_columns(granularity: str) -> list[str]:
    return ["weekday", "hour_of_day"] if granularity == GRANULARITY_WEEKDAY_HOUR else ["hour_of_day"]


def baseline_tables(
    df: DataFrame,
    opts: Options,
    granularities: Sequence[str] = (GRANULARITY_HOUR, GRANULARITY_WEEKDAY_HOUR),
    keys: Sequence[str] = ("asset_id",),
    metrics: Sequence[str] = BASELINE_METRICS,
) -> list[DataFrame]:
    """Per granularity: count, median and MAD (unscaled) per slot over rows complete in keys and metrics.

    The rows are scanned once, into runs of equal values per finest slot. Hour slots are
    merged from weekday slots, and MAD = median(|x - median|) is taken from runs of deviations.
    """
    if not opts.scale.exact_quantiles:
        return [_sketched_baseline(df, opts, g, keys, metrics) for g in granularities]
    days = GRANULARITY_WEEKDAY_HOUR in granularities
    finest = [*keys, *group_columns(GRANULARITY_WEEKDAY_HOUR if days else GRANULARITY_HOUR)]
    runs = value_runs(df.select(*finest, *metrics).na.drop(), finest, metrics)
    slot = [*keys, "weekday", "hour_of_day"]
    all_days = F.lit(None).cast("int")  # the hour slots' weekday
    sets = []
    if GRANULARITY_HOUR in granularities:
        sets.append(runs.withColumn("weekday", all_days))
    if days:
        sets.append(runs.select(*slot, *RUN, "n"))
    runs = merge_runs(sets[0].select(*slot, *RUN, "n"), slot)
    for more in sets[1:]:
        runs = runs.unionByName(more)
    runs = write_table(runs, "slots") if len(sets) > 1 else runs
    middle = [(i, 0.5, f"{m}_baseline_median") for i, m in enumerate(metrics)]
    med = cut_lineage(run_quantiles(runs, slot, middle, [(0, "baseline_count")], opts))  # assets x slots
    small = broadcast_if_small(med, opts.scale.broadcast_max_rows)
    same = runs["hour_of_day"].eqNullSafe(small["hour_of_day"]) & runs["weekday"].eqNullSafe(small["weekday"])
    for k in keys:
        same &= runs[k].eqNullSafe(small[k])
    of = F.element_at(F.array(*[F.col(name) for _, _, name in middle]), F.col("var") + 1)
    off = runs.join(small, same).select(*[runs[c] for c in slot], "var", F.abs(F.col("x") - of).alias("x"), "n")
    mads = [(i, 0.5, f"{m}_baseline_mad") for i, m in enumerate(metrics)]
    dev = run_quantiles(merge_runs(off, slot), slot, mads, [], opts)
    cols = ["baseline_count"]
    for m in metrics:
        cols += [f"{m}_baseline_median", f"{m}_baseline_mad"]
    joined = med.join(dev, [med[c].eqNullSafe(dev[c]) for c in slot]).select(*[med[c] for c in slot], *cols)
    joined = cut_lineage(joined)
    out = []
    for g in granularities:
        hour = g == GRANULARITY_HOUR
        rows = joined.where(F.col("weekday").isNull() if hour else F.col("weekday").isNotNull())
        out.append(rows.select(*keys, *group_columns(g), *cols))
    return out


def baseline_table(df: DataFrame, opts: Options, granularity: str = GRANULARITY_HOUR, keys: Sequence[str] = ("asset_id",), metrics: Sequence[str] = BASELINE_METRICS) -> DataFrame:
    """The baseline of one granularity."""
    return baseline_tables(df, opts, [granularity], keys, metrics)[0]


def _sketched_baseline(df: DataFrame, opts: Options, granularity: str, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    group = [*keys, *group_columns(granularity)]
    src = df.select(*group, *metrics).na.drop()
    med = cut_lineage(quantile_table(src, group, [(m, 0.5, f"{m}_baseline_median") for m in metrics], opts, counts=[(metrics[0], "baseline_count")]))
    off = src.join(broadcast_if_small(med, opts.scale.broadcast_max_rows), group)
    off = off.select(*group, *[F.abs(F.col(m) - F.col(f"{m}_baseline_median")).alias(f"_dev_{m}") for m in metrics])
    dev = quantile_table(off, group, [(f"_dev_{m}", 0.5, f"{m}_baseline_mad") for m in metrics], opts)
    cols = [c for m in metrics for c in (f"{m}_baseline_median", f"{m}_baseline_mad")]
    return med.join(dev, group).select(*group, "baseline_count", *cols)


def robust_z(x: Column, median: Column, mad: Column) -> Column:
    """(x - median) / (1.4826 * MAD); a zero or missing scale becomes 1e-9."""
    scale = F.coalesce(F.nullif(F.lit(MAD_SCALE) * mad, F.lit(0.0)), F.lit(MIN_SCALE))
    return (x - median) / scale


def apply_baseline(
    df: DataFrame,
    hourly: DataFrame,
    weekday_hourly: DataFrame,
    opts: Options,
    keys: Sequence[str] = ("asset_id",),
    metrics: Sequence[str] = BASELINE_METRICS,
) -> DataFrame:
    """Left-join both baselines (J1, J2), choose per row, add robust z.

    The weekday x hour slot is used when the configured granularity is weekday x
    hour and the slot holds at least ``weekday_hour_min_count`` rows.
    """
    keys = list(keys)
    h = hourly.select(
        *keys, "hour_of_day",
        *[F.col(c).alias(f"hourly_{c}") for c in hourly.columns if c not in keys + ["hour_of_day"]],
    )
    w = weekday_hourly.select(
        *keys, "weekday", "hour_of_day",
        *[F.col(c).alias(f"weekday_hourly_{c}") for c in weekday_hourly.columns if c not in keys + ["weekday", "hour_of_day"]],
    )
    limit = opts.scale.broadcast_max_rows
    merged = df.join(broadcast_if_small(h, limit), keys + ["hour_of_day"], "left").join(
        broadcast_if_small(w, limit), keys + ["weekday", "hour_of_day"], "left"
    )
    use_weekday = opts.baseline.default_granularity == GRANULARITY_WEEKDAY_HOUR
    mask = F.lit(use_weekday) & (
        F.coalesce(F.col("weekday_hourly_baseline_count"), F.lit(0)) >= F.lit(opts.baseline.weekday_hour_min_count)
    )
    out = {}
    for m in metrics:
        med = F.when(mask, F.col(f"weekday_hourly_{m}_baseline_median")).otherwise(F.col(f"hourly_{m}_baseline_median"))
        mad = F.when(mask, F.col(f"weekday_hourly_{m}_baseline_mad")).otherwise(F.col(f"hourly_{m}_baseline_mad"))
        out[f"{m}_baseline_median"] = med
        out[f"{m}_baseline_mad"] = mad
        out[f"{m}_baseline_scope"] = F.when(mask, F.lit(GRANULARITY_WEEKDAY_HOUR)).otherwise(F.lit(GRANULARITY_HOUR))
    merged = merged.withColumns(out)
    return merged.withColumns(
        {
            f"{m}_robust_z": robust_z(F.col(m), F.col(f"{m}_baseline_median"), F.col(f"{m}_baseline_mad"))
            for m in metrics
        }
    )


def baseline_band(profile: DataFrame, metric: str) -> DataFrame:
    """median +- 1.4826 * MAD for a baseline table (A7); missing MAD counts as 0."""
    med = F.col(f"{metric}_baseline_median")
    spread = F.lit(MAD_SCALE) * F.coalesce(F.col(f"{metric}_baseline_mad"), F.lit(0.0))
    return profile.withColumns({"band_low": med - spread, "band_high": med + spread})


def hourly_profile(df: DataFrame, metric: str, opts: Options, keys: Sequence[str] = ("asset_id",)) -> DataFrame:
    """Median, q10, q90 and count of any metric per hour (A4)."""
    keys = list(keys)
    src = df.select(*keys, "hour_of_day", metric).na.drop(subset=[metric, "hour_of_day"])
    return quantile_table(
        src, keys + ["hour_of_day"], [(metric, 0.5, "median"), (metric, 0.10, "q10"), (metric, 0.90, "q90")], opts,
        counts=[(metric, "count")],
    )


def _with_scope(profile: DataFrame, chosen: DataFrame, keys: list[str], use_col: str) -> DataFrame:
    from sonolith.operators.explore import weekday_label

    scope = F.when(
        F.col(use_col), F.concat(F.lit(f"{GRANULARITY_WEEKDAY_HOUR} ("), weekday_label(F.col("active_weekday")), F.lit(")"))
    ).otherwise(F.lit(f"{GRANULARITY_HOUR} (Fallback)"))
    return profile.join(chosen.select(*keys, scope.alias("scope")), keys, "left")


def generic_profile(
    df: DataFrame,
    metric: str,
    opts: Options,
    granularity: str = GRANULARITY_HOUR,
    selected_weekday: str = "Auto",
    end_timestamp=None,
    keys: Sequence[str] = ("asset_id",),
    min_points: int = 10,
) -> DataFrame:
    """Hour profile of any metric, optionally for one weekday (A5).

    With weekday granularity the profile uses only rows of the active weekday
    (W11) unless that weekday has fewer than ``min_points`` rows, in which case it
    falls back to all rows.
    """
    from sonolith.operators.explore import active_weekday

    keys = list(keys)
    src = df.where(F.col(metric).isNotNull() & F.col("hour_of_day").isNotNull())
    if granularity != GRANULARITY_WEEKDAY_HOUR:
        return hourly_profile(src, metric, opts, keys).withColumn("scope", F.lit(GRANULARITY_HOUR))
    chosen = active_weekday(src, keys, selected_weekday, end_timestamp).withColumn(
        "_use", F.col("active_weekday_rows") >= F.lit(min_points)
    )
    chosen = broadcast_if_small(chosen, opts.scale.broadcast_max_rows)
    rows = src.join(chosen, keys, "inner").where(~F.col("_use") | (F.col("weekday") == F.col("active_weekday")))
    return _with_scope(hourly_profile(rows, metric, opts, keys), chosen, keys, "_use")


def stage1_profile(
    df: DataFrame,
    opts: Options,
    selected_weekday: str = "Auto",
    end_timestamp=None,
    keys: Sequence[str] = ("asset_id",),
    weekday_hourly: DataFrame | None = None,
    hourly: DataFrame | None = None,
) -> DataFrame:
    """Baseline profile of the active weekday; falls back to the hour baseline when
    the weekday's largest slot has fewer than ``weekday_hour_min_count`` rows (A6).

    ``df`` is whichever rows the baseline should come from: whole history or the
    current timeframe (A8).
    """
    from sonolith.operators.explore import active_weekday

    keys = list(keys)
    hb, wb = hourly, weekday_hourly
    if hb is None or wb is None:
        hb, wb = baseline_tables(df, opts, keys=keys)
    act = active_weekday(df, keys, selected_weekday, end_timestamp)
    day = wb.join(act.select(*keys, "active_weekday"), keys, "inner").where(F.col("weekday") == F.col("active_weekday"))
    best = day.groupBy(*keys).agg(F.max("baseline_count").alias("_max_slot"))
    chosen = act.join(best, keys, "left").withColumn(
        "_use", F.coalesce(F.col("_max_slot") >= F.lit(opts.baseline.weekday_hour_min_count), F.lit(False))
    )
    chosen = broadcast_if_small(chosen, opts.scale.broadcast_max_rows)
    picked_day = day.drop("active_weekday").join(chosen.where(F.col("_use")).select(*keys), keys, "left_semi")
    picked_hour = hb.join(chosen.where(~F.col("_use")).select(*keys), keys, "left_semi").withColumn(
        "weekday", F.lit(None).cast("int")
    )
    profile = picked_day.unionByName(picked_hour)
    return _with_scope(profile, chosen, keys, "_use")
