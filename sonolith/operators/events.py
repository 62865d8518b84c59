"""Alert rows, event sessionisation and event rollups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonolith.functions import vocab as V
from sonolith.operators.quality import CANONICAL_ORDER
from sonolith.operators.sequence import count_breaks

Z_COLUMNS = ("avg_decibel_robust_z", "peak_minus_avg_robust_z", "peak_minus_min_robust_z")


def is_alert(prefix: str) -> Column:
    return F.col(f"{prefix}_severity").isin(*V.ALERT_SEVERITIES)


def alert_rows_with_event_ids(
    df: DataFrame, prefix: str, keys: Sequence[str] = ("asset_id",), adjacency: str = "file"
) -> DataFrame:
    """Alert rows (WARNING/ANOMALY) with 1-based ``event_id`` per asset.

    A new event starts when the row is not adjacent to the previous alert row or
    the segment changes (gaps-and-islands over the sparse alert rows).  Adjacency
    is by file position (``row_id``, the documented behaviour: an unsorted file
    splits events) or, with ``adjacency="time"``, by position in time order
    (``seq_pos``).
    """
    pos = {"file": "row_id", "time": "seq_pos"}[adjacency]

    def new_event(cur, prev):
        return (
            prev[pos].isNull()
            | (cur[pos] - prev[pos] != F.lit(1))
            | (cur["segment_id"] != prev["segment_id"])
        )

    alerts = df.filter(is_alert(prefix))
    # the first alert row of an asset has no previous row: a break, so ids start at 1
    numbered = count_breaks(alerts, keys, CANONICAL_ORDER, [pos, "segment_id"], new_event, "event_id")
    return numbered.withColumns(
        {
            "is_reduced_quality": F.coalesce(F.col("quality_flag") == F.lit(V.REDUCED_QUALITY), F.lit(False)),
            "is_near_gap": F.coalesce(F.col("near_gap_flag"), F.lit(False)),
        }
    )


def _top_messages(alerts: DataFrame, message_col: str, group: list[str]) -> DataFrame:
    """Two most frequent messages per event, ``' | '``-joined.

    Ties: higher count first, then the message seen first in the event.
    """
    counts = alerts.groupBy(*group, F.col(message_col).alias("_msg")).agg(
        F.count(F.lit(1)).alias("_cnt"), F.min("seq_pos").alias("_first")
    )
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("_cnt")).alias("k"), F.col("_first").alias("f"), F.col("_msg").alias("m"))))
    return counts.groupBy(*group).agg(
        F.array_join(F.transform(F.slice(ranked, 1, 2), lambda x: x["m"]), " | ").alias("message")
    )


def build_events(
    alerts: DataFrame,
    prefix: str,
    opts_interval_minutes: float,
    keys: Sequence[str] = ("asset_id",),
    score_column: str | None = None,
    extra_aggs: Sequence[Column] = (),
) -> DataFrame:
    """One row per event: bounds, duration (= rows x interval), severity, message,
    quality context and optional max score (A13, A14, J7).
    """
    group = list(keys) + ["event_id"]
    aggs = [
        F.min("timestamp").alias("start_timestamp"),
        F.max("timestamp").alias("end_timestamp"),
        F.count(F.lit(1)).alias("row_count"),
        F.max(V.severity_rank(F.col(f"{prefix}_severity"))).alias("_sev_rank"),
        F.count_if(F.col("is_reduced_quality")).alias("reduced_quality_rows"),
        F.count_if(F.col("is_near_gap")).alias("near_gap_rows"),
    ]
    if score_column is not None:
        aggs.append(F.max(score_column).alias(score_column))
    aggs.extend(extra_aggs)
    ev = alerts.groupBy(*group).agg(*aggs)
    msgs = _top_messages(alerts, f"{prefix}_message", group)
    ev = ev.join(msgs, group, "left")
    return ev.withColumns(
        {
            "duration_minutes": F.col("row_count").cast("double") * F.lit(float(opts_interval_minutes)),
            "stage": F.lit(V.STAGE_NAMES[prefix]),
            "severity": V.severity_name(F.col("_sev_rank")),
            "message": F.coalesce(F.col("message"), F.lit("")),
            "has_reduced_quality": F.col("reduced_quality_rows") > 0,
            "has_near_gap": F.col("near_gap_rows") > 0,
        }
    ).drop("_sev_rank")


def stage1_event_aggs() -> list[Column]:
    """Stage-1 enrichment folded into the event aggregate.

    The dominant rule is the rule with most fired rows, ties in the order
    Pegel, Spike, Spannweite.
    """
    return [
        F.count_if(F.col("warn_avg")).alias("_n_avg"),
        F.count_if(F.col("warn_spike")).alias("_n_spike"),
        F.count_if(F.col("warn_range")).alias("_n_range"),
        *[F.max(F.abs(F.col(z))).alias(f"{z}_max") for z in Z_COLUMNS],
    ]


def finish_stage1_events(events: DataFrame) -> DataFrame:
    a, s, r = F.col("_n_avg"), F.col("_n_spike"), F.col("_n_range")
    top = F.greatest(a, s, r)
    dominant = (
        F.when(top <= 0, F.lit(V.RULE_UNKNOWN))
        .when(a == top, F.lit(V.RULE_LABELS["warn_avg"]))
        .when(s == top, F.lit(V.RULE_LABELS["warn_spike"]))
        .otherwise(F.lit(V.RULE_LABELS["warn_range"]))
    )
    return events.withColumns(
        {
            "dominant_rule": dominant,
            "quality_label": F.when(F.col("has_reduced_quality"), F.lit(V.REDUCED_QUALITY)).otherwise(F.lit(V.NORMAL_QUALITY)),
        }
    ).drop("_n_avg", "_n_spike", "_n_range")


def extract_alerts(df: DataFrame, prefix: str, columns: Sequence[str], keys: Sequence[str] = ("asset_id",)) -> DataFrame:
    """Alert-row table: fixed projection, severity/message renamed, stage literal."""
    cols = [*keys, "timestamp", F.lit(V.STAGE_NAMES[prefix]).alias("stage"),
            F.col(f"{prefix}_severity").alias("severity"), F.col(f"{prefix}_message").alias("message"), *columns]
    return df.filter(is_alert(prefix)).select(*cols)


def alert_context(df: DataFrame, events: DataFrame, prefix: str, keys: Sequence[str] = ("asset_id",)) -> DataFrame:
    """Rows/events in alert, with reduced quality, near a gap, or both."""
    keys = list(keys)
    alert = is_alert(prefix)
    rq = F.coalesce(F.col("quality_flag") == F.lit(V.REDUCED_QUALITY), F.lit(False))
    ng = F.coalesce(F.col("near_gap_flag"), F.lit(False))
    rows = df.groupBy(*keys).agg(
        F.count_if(alert).alias("row_alerts_total"),
        F.count_if(alert & rq).alias("row_alerts_reduced_quality"),
        F.count_if(alert & ng).alias("row_alerts_near_gap"),
        F.count_if(alert & rq & ng).alias("row_alerts_both"),
    )
    ev = events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("events_total"),
        F.count_if("has_reduced_quality").alias("events_reduced_quality"),
        F.count_if("has_near_gap").alias("events_near_gap"),
        F.count_if(F.col("has_reduced_quality") & F.col("has_near_gap")).alias("events_both"),
    )
    out = rows.join(ev, keys, "left")
    return out.fillna(0, subset=["events_total", "events_reduced_quality", "events_near_gap", "events_both"])


def percent(value: Column, total: Column) -> Column:
    """100 * value / total, 0 when total is 0."""
    return F.coalesce(F.try_divide(F.lit(100.0) * value, total.cast("double")), F.lit(0.0))


def rule_summary(df: DataFrame, events: DataFrame, keys: Sequence[str] = ("asset_id",)) -> DataFrame:
    """Rows per rule and the most common dominant rule with its event count."""
    keys = list(keys)
    counts = df.groupBy(*keys).agg(
        F.count_if(F.coalesce(F.col("warn_avg"), F.lit(False))).alias("warn_avg_rows"),
        F.count_if(F.coalesce(F.col("warn_range"), F.lit(False))).alias("warn_range_rows"),
        F.count_if(F.coalesce(F.col("warn_spike"), F.lit(False))).alias("warn_spike_rows"),
    )
    order = F.when(F.col("dominant_rule") == V.RULE_LABELS["warn_avg"], 0).when(
        F.col("dominant_rule") == V.RULE_LABELS["warn_spike"], 1
    ).when(F.col("dominant_rule") == V.RULE_LABELS["warn_range"], 2).otherwise(3)
    per_rule = events.groupBy(*keys, "dominant_rule").agg(F.count(F.lit(1)).alias("_n")).withColumn("_o", order)
    top = per_rule.groupBy(*keys).agg(
        F.max_by(F.col("dominant_rule"), F.struct(F.col("_n"), -F.col("_o"))).alias("dominant_rule"),
        F.max("_n").alias("dominant_rule_events"),
    )
    return counts.join(top, keys, "left")
