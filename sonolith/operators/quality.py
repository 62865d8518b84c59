"""Gaps, segments, quality flags, calendar parts and derived columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonolith.operators.sequence import BUCKET, add_bucket
from sonolith.options import Options

CANONICAL_ORDER = ("timestamp", "row_id")
_SCAN_HELPERS = (
    "_rn", "_prev_ts", "_next_ts", "_is_last", "_inner_gap", "_inner_gaps", "_prev_last",
    "_next_first", "_first_gap", "_gaps_before", "_rows_before", "_next_gap",
)
BAND_COLUMNS = ("low_freq_avg", "mid_freq_avg", "high_freq_avg")
SHARE_COLUMNS = ("low_share", "mid_share", "high_share")


def minutes_between(earlier: Column, later: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", earlier, later) / F.lit(60_000_000.0)


def add_quality_columns(
    df: DataFrame,
    opts: Options,
    keys: Sequence[str] = ("asset_id",),
    order: Sequence[str] = CANONICAL_ORDER,
) -> DataFrame:
    """delta_minutes, gap_flag, segment_id, near_gap_flag, seq_pos (W2-W5) + P8/P9.

    ``gap_flag`` is ``delta > threshold`` (missing delta -> False); ``segment_id`` is
    the running count of gaps (0-based); ``near_gap_flag`` is this row's or the
    next row's gap, the next row's gap being ``next.ts - ts > threshold``.

    One fused two-level scan: inside each (asset, bucket) a window gives lag/lead
    and running gap counts; the per-bucket summary (first/last timestamp, gap and
    row counts) is scanned per asset to carry them across bucket borders.
    """
    keys = list(keys)
    thr = F.lit(float(opts.gap_threshold_minutes))
    ts = F.col("timestamp")
    sc = opts.scale
    if sc.scan_bucket_rows:
        b = add_bucket(df, "timestamp", keys=keys, target_rows=sc.scan_bucket_rows, max_rows=sc.broadcast_max_rows)
    else:
        b = add_bucket(df, "timestamp", sc.scan_bucket_hours)
    part = keys + [BUCKET]
    w = Window.partitionBy(*part).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = b.withColumns(
        {
            "_rn": F.row_number().over(w),
            "_prev_ts": F.lag(ts).over(w),
            "_next_ts": F.lead(ts).over(w),
            "_is_last": F.lead(F.lit(1)).over(w).isNull(),
        }
    )
    inner = inner.withColumn(
        "_inner_gap", F.coalesce(minutes_between(F.col("_prev_ts"), ts) > thr, F.lit(False)).cast("long")
    ).withColumn("_inner_gaps", F.sum("_inner_gap").over(upto))
    summary = inner.groupBy(*part).agg(
        F.min_by(ts, F.col("_rn")).alias("_first_ts"),
        F.max_by(ts, F.col("_rn")).alias("_last_ts"),
        F.count(F.lit(1)).alias("_n"),
        F.sum("_inner_gap").alias("_gaps"),
    )
    ws = Window.partitionBy(*keys).orderBy(BUCKET)
    before = ws.rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.withColumns(
        {
            "_prev_last": F.lag("_last_ts").over(ws),
            "_next_first": F.lead("_first_ts").over(ws),
        }
    ).withColumn(
        "_first_gap", F.coalesce(minutes_between(F.col("_prev_last"), F.col("_first_ts")) > thr, F.lit(False)).cast("long")
    )
    summary = summary.select(
        *part,
        "_prev_last",
        "_next_first",
        "_first_gap",
        F.coalesce(F.sum(F.col("_gaps") + F.col("_first_gap")).over(before), F.lit(0)).alias("_gaps_before"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_rows_before"),
    )
    joined = inner.join(summary.hint("shuffle_hash"), part, "left")
    prev_ts = F.when(F.col("_rn") == 1, F.col("_prev_last")).otherwise(F.col("_prev_ts"))
    next_ts = F.when(F.col("_is_last"), F.col("_next_first")).otherwise(F.col("_next_ts"))
    delta = minutes_between(prev_ts, ts)
    return (
        joined.withColumns(
            {
                "delta_minutes": delta,
                "gap_flag": F.coalesce(delta > thr, F.lit(False)),
                "segment_id": F.col("_gaps_before") + F.col("_first_gap") + F.col("_inner_gaps"),
                "seq_pos": F.col("_rows_before") + F.col("_rn") - 1,
                "_next_gap": F.coalesce(minutes_between(ts, next_ts) > thr, F.lit(False)),
            }
        )
        .withColumns(
            {
                "near_gap_flag": F.col("gap_flag") | F.col("_next_gap"),
                "quality_flag": F.when(
                    F.col("samples_count") < F.lit(opts.reduced_quality_min_samples), F.lit("reduced_quality")
                ).otherwise(F.lit("normal")),
                "hour_of_day": F.hour("timestamp"),
                "weekday": F.weekday("timestamp"),
                "date": F.to_date("timestamp"),
            }
        )
        .drop(*_SCAN_HELPERS)
    )


def add_derived_columns(df: DataFrame) -> DataFrame:
    """Spreads (P6) and band shares (P7, only when all three bands exist)."""
    out = {
        "peak_minus_avg": F.col("peak_decibel") - F.col("avg_decibel"),
        "avg_minus_min": F.col("avg_decibel") - F.col("min_decibel"),
        "peak_minus_min": F.col("peak_decibel") - F.col("min_decibel"),
    }
    if all(c in df.columns for c in BAND_COLUMNS):
        ok = ~F.col("freq_format_error")
        total = F.nullif(
            F.coalesce(F.col("low_freq_avg"), F.lit(0.0))
            + F.coalesce(F.col("mid_freq_avg"), F.lit(0.0))
            + F.coalesce(F.col("high_freq_avg"), F.lit(0.0)),
            F.lit(0.0),
        )
        for band, share in zip(BAND_COLUMNS, SHARE_COLUMNS):
            out[share] = F.when(ok, F.col(band) / total)
    return df.withColumns(out)


def prepare_series(
    df: DataFrame, opts: Options, keys: Sequence[str] = ("asset_id",), order: Sequence[str] = CANONICAL_ORDER
) -> DataFrame:
    """Quality + derived columns: the measurement table every stage reads."""
    return add_derived_columns(add_quality_columns(df, opts, keys, order))


__all__ = ["BUCKET", "CANONICAL_ORDER", "add_quality_columns", "add_derived_columns", "prepare_series"]
