"""Exploration: timeframes (P10), weekday choice (W11), down-sampling (W10),
event windows (J3), overlap filters (J4), latest-event lists (T1-T4),
overview/status records (A20, A24) and window export (S9)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonolith.functions import vocab as V
from sonolith.functions.formatting import display_timestamp
from sonolith.operators.quality import CANONICAL_ORDER
from sonolith.operators.ranges import rows_in_windows
from sonolith.operators.sequence import ordered_scan
from sonolith.options import ScaleOptions
from sonolith.plans.sizing import broadcast_if_small

_LOOKBACK_HOURS = {"Letzte 24h": 24, "Letzte 7 Tage": 7 * 24, "Letzte 30 Tage": 30 * 24, "Letzte 90 Tage": 90 * 24}


def _hours(h: int) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(h))


def timeframe_bounds(df: DataFrame, timeframe: str, keys: Sequence[str] = ("asset_id",)) -> DataFrame:
    """Per-asset ``(window_start, window_end)`` of a named timeframe, from max(timestamp).

    Lookbacks end at the last timestamp (lower bound inclusive); the last
    calendar day is ``[midnight, midnight + 1 day)``; "Gesamt" has no bounds.
    """
    keys = list(keys)
    mx = df.where(F.col("timestamp").isNotNull()).groupBy(*keys).agg(F.max("timestamp").alias("_max"))
    if timeframe in _LOOKBACK_HOURS:
        return mx.select(*keys, (F.col("_max") - _hours(_LOOKBACK_HOURS[timeframe])).alias("window_start"), F.col("_max").alias("window_end"))
    if timeframe == "Letzter Kalendertag":
        day = F.to_date("_max").cast("timestamp_ntz")
        return mx.select(*keys, day.alias("window_start"), (day + F.make_dt_interval(F.lit(1))).alias("window_end"))
    return mx.select(*keys, F.lit(None).cast("timestamp_ntz").alias("window_start"), F.lit(None).cast("timestamp_ntz").alias("window_end"))


def timeframe_slice(
    df: DataFrame, timeframe: str, keys: Sequence[str] = ("asset_id",), max_rows: int = 2_000_000
) -> DataFrame:
    """Rows of the timeframe per asset (P10); rows without timestamp are dropped.

    Bounds are one row per asset, joined with a size-checked broadcast.  When the
    bounds are known literals use :func:`slice_between` so the filter reaches the
    parquet scan.
    """
    keys = list(keys)
    base = df.where(F.col("timestamp").isNotNull())
    if timeframe not in _LOOKBACK_HOURS and timeframe != "Letzter Kalendertag":
        return base
    bounds = broadcast_if_small(timeframe_bounds(df, timeframe, keys), max_rows)
    cond = F.col("timestamp") >= F.col("window_start")
    if timeframe == "Letzter Kalendertag":
        cond = cond & (F.col("timestamp") < F.col("window_end"))
    return base.join(bounds, keys, "inner").where(cond).drop("window_start", "window_end")


def slice_between(df: DataFrame, start: dt.datetime | None, end: dt.datetime | None, end_inclusive: bool = True) -> DataFrame:
    """Literal time bounds: pushed down to the parquet scan as data filters."""
    out = df.where(F.col("timestamp").isNotNull())
    if start is not None:
        out = out.where(F.col("timestamp") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        e = F.lit(end).cast("timestamp_ntz")
        out = out.where(F.col("timestamp") <= e if end_inclusive else F.col("timestamp") < e)
    return out


def active_weekday(
    df: DataFrame,
    keys: Sequence[str] = ("asset_id",),
    selected: str = "Auto",
    end_timestamp: dt.datetime | None = None,
) -> DataFrame:
    """Per asset: the weekday to show.

    An explicit Mo..So wins; "Auto" is the weekday of the range end when bounded,
    else of the last row in canonical order.  Also returns the row count of that
    weekday (for the profile fallbacks).
    """
    keys = list(keys)
    per_day = df.where(F.col("timestamp").isNotNull() & F.col("weekday").isNotNull()).groupBy(*keys, "weekday").agg(
        F.count(F.lit(1)).alias("_n"), F.max("seq_pos").alias("_last")
    )
    if selected in V.WEEKDAY_NAMES:
        chosen = F.lit(V.WEEKDAY_NAMES.index(selected))
    elif end_timestamp is not None:
        chosen = F.lit(end_timestamp.weekday())
    else:
        chosen = None
    agg = per_day.groupBy(*keys).agg(
        F.max_by("weekday", "_last").alias("_auto"),
        F.map_from_entries(F.collect_list(F.struct("weekday", "_n"))).alias("_counts"),
    )
    wd = chosen if chosen is not None else F.col("_auto")
    return agg.select(
        *keys,
        wd.cast("int").alias("active_weekday"),
        F.coalesce(F.element_at(F.col("_counts"), wd.cast("int")), F.lit(0)).alias("active_weekday_rows"),
    )


def weekday_label(col: Column) -> Column:
    expr = F.lit(None).cast("string")
    for i, name in enumerate(V.WEEKDAY_NAMES):
        expr = F.when(col == F.lit(i), F.lit(name)).otherwise(expr)
    return expr


def downsample(
    df: DataFrame, required: Sequence[str], max_points: int, keys: Sequence[str] = ("asset_id",)
) -> DataFrame:
    """Stride down-sampling per asset (W10): complete rows only; when more than
    ``max_points`` remain keep every ``n div max_points``-th row (positions 0, step, ...).

    Positions come from the two-level scan; the per-asset count is one small table.
    """
    keys = list(keys)
    src = df.na.drop(subset=list(required))
    counts = src.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    step = F.when(F.col("_n") <= max_points, F.lit(1)).otherwise(F.greatest(F.lit(1), F.floor(F.col("_n") / F.lit(max_points))))
    counts = counts.select(*keys, step.cast("long").alias("_step"))
    pos = ordered_scan(src, keys, CANONICAL_ORDER, sums={"_pos": F.lit(1).cast("long")})
    return (
        pos.join(broadcast_if_small(counts, ScaleOptions.broadcast_max_rows), keys, "inner")
        .where(((F.col("_pos") - 1) % F.col("_step")) == 0)
        .drop("_pos", "_step")
    )


def events_in_range(events: DataFrame, start: Column | None, end: Column | None) -> DataFrame:
    """Events overlapping a closed range; either bound may be missing."""
    out = events
    if start is not None:
        out = out.where(F.col("end_timestamp") >= start)
    if end is not None:
        out = out.where(F.col("start_timestamp") <= end)
    return out


def events_in_timeframe(events: DataFrame, bounds: DataFrame, keys: Sequence[str] = ("asset_id",)) -> DataFrame:
    """J4 against per-asset timeframe bounds (upper bound inclusive, as documented)."""
    keys = list(keys)
    j = events.join(broadcast_if_small(bounds, ScaleOptions.broadcast_max_rows), keys, "inner")
    cond = (F.col("window_start").isNull() | (F.col("end_timestamp") >= F.col("window_start"))) & (
        F.col("window_end").isNull() | (F.col("start_timestamp") <= F.col("window_end"))
    )
    return j.where(cond).drop("window_start", "window_end")


def event_windows(
    rows: DataFrame, events: DataFrame, hours: int, keys: Sequence[str] = ("asset_id",), event_cols: Sequence[str] = ("stage", "event_id")
) -> DataFrame:
    """Rows within ``[start - h, end + h]`` of every event (J3), closed bounds.

    Windows and rows meet by dyadic covers (:mod:`sonolith.operators.ranges`).
    """
    keys = list(keys)
    ev = events.select(
        *keys,
        *event_cols,
        (F.col("start_timestamp") - _hours(hours)).alias("window_start"),
        (F.col("end_timestamp") + _hours(hours)).alias("window_end"),
    )
    return rows_in_windows(rows, ev, "window_start", "window_end", keys)


def union_events(stage_events: Sequence[DataFrame]) -> DataFrame:
    """Union of stage event tables with differing columns + priority 1..3."""
    out = None
    for prio, ev in enumerate(stage_events, start=1):
        e = ev.withColumn("priority", F.lit(prio))
        out = e if out is None else out.unionByName(e, allowMissingColumns=True)
    return out


def latest_events(events: DataFrame, k: int, keys: Sequence[str] = ("asset_id",), by_priority: bool = True) -> DataFrame:
    """Latest ``k`` events per asset by start desc, then priority desc, event id.

    ``row_number() <= k`` lets Spark apply a group limit before the shuffle.
    """
    order = [F.col("start_timestamp").desc_nulls_last()]
    if by_priority and "priority" in events.columns:
        order.append(F.col("priority").desc())
    order.append(F.col("event_id").asc())
    if "stage" in events.columns:
        order.append(F.col("stage").asc())
    w = Window.partitionBy(*keys).orderBy(*order)
    return events.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def ranked(df: DataFrame, order: Sequence[Column], keys: Sequence[str] = ("asset_id",)) -> DataFrame:
    """Presentation order as an explicit column ``rank`` from 1 (T4)."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def overview_counts(
    rows: DataFrame, contexts: dict[str, DataFrame], keys: Sequence[str] = ("asset_id",)
) -> DataFrame:
    """Rows, gaps, reduced-quality rows plus alert rows and events per stage.

    ``contexts`` maps a stage prefix to its alert-context table (A19)."""
    keys = list(keys)
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("gap_flag").alias("gaps"),
        F.count_if(F.col("quality_flag") == F.lit(V.REDUCED_QUALITY)).alias("reduced_quality_rows"),
    )
    for prefix, ctx in contexts.items():
        out = out.join(
            ctx.select(*keys, F.col("row_alerts_total").alias(f"{prefix}_alert_rows"), F.col("events_total").alias(f"{prefix}_events")),
            keys,
            "left",
        )
    return out


def status_record(
    rows: DataFrame,
    events: DataFrame,
    timeframe: str,
    baseline_mode: str,
    granularity: str,
    weekday: str = "Auto",
    computed_at: dt.datetime | None = None,
    keys: Sequence[str] = ("asset_id",),
) -> DataFrame:
    """Status per asset: timeframe, baseline mode, granularity, weekday, rows, events."""
    keys = list(keys)
    r = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"))
    e = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("event_count"))
    computed = display_timestamp(F.lit(computed_at).cast("timestamp_ntz")) if computed_at else F.lit("-")
    out = r.join(e, keys, "left").fillna(0, subset=["event_count"])
    return out.select(
        *keys,
        F.lit(timeframe).alias("timeframe"),
        F.lit(baseline_mode).alias("baseline_mode"),
        F.lit(granularity).alias("granularity"),
        F.lit(weekday).alias("weekday"),
        "row_count",
        "event_count",
        computed.alias("computed_at"),
    )


def export_csv(df: DataFrame, path: str) -> None:
    """Write rows (e.g. an event window) as CSV with a header, no index."""
    df.write.mode("overwrite").option("header", True).csv(path)
