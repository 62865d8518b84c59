"""The hourly measurement series derived from the driver's ``events`` table.

One asset per ``event_type``; one row per asset and hour with level statistics
of ``value``; band levels are the quartiles of ``value`` and are missing on every
20th row (``row_id % 20 = 7``), which acts as a band format error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonolith.operators.quality import BAND_COLUMNS, add_derived_columns, add_quality_columns
from sonolith.operators.quantiles import quantile_table
from sonolith.options import Options
from sonolith.session import write_table


def hour_floor(ts: F.Column) -> F.Column:
    """Truncate a TIMESTAMP_NTZ to the hour without a time-zone round trip."""
    return F.make_timestamp_ntz(F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts), F.lit(0), F.lit(0))


def hourly_groups(events: DataFrame, opts: Options) -> DataFrame:
    """One row per (asset, hour): level statistics, quartiles and duration (partial aggregation)."""
    src = events.select(F.col("event_type").alias("asset_id"), hour_floor(F.col("ts")).alias("timestamp"), "ts", "value")
    return quantile_table(
        src,
        ["asset_id", "timestamp"],
        [("value", 0.25, "_q1"), ("value", 0.5, "_q2"), ("value", 0.75, "_q3")],
        opts,
        extra_aggs=[
            F.avg("value").alias("avg_decibel"),
            F.max("value").alias("peak_decibel"),
            F.min("value").alias("min_decibel"),
            F.count(F.lit(1)).cast("double").alias("samples_count"),
            (F.timestamp_diff("MICROSECOND", F.min("ts"), F.max("ts")) / F.lit(1e6)).alias("measurement_duration"),
        ],
    ).withColumn("_q", F.array("_q1", "_q2", "_q3")).drop("_q1", "_q2", "_q3")


def measurement_table(spark: SparkSession, sf_dir: str, opts: Options) -> DataFrame:
    """The prepared series (quality + derived columns) for the driver tables.

    ``row_id`` is the 0-based position per asset in time order, which the fused
    quality scan already computes as ``seq_pos`` (hours are unique per asset).
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "ts", "value")
    # the events aggregation is the expensive pass: materialise it once for the scans
    grouped = write_table(hourly_groups(events, opts), "hourly")
    q = add_quality_columns(grouped, opts, ["asset_id"], order=["timestamp"])
    q = q.withColumn("row_id", F.col("seq_pos"))
    band_error = (F.col("row_id") % 20) == 7
    cols = {band: F.when(~band_error, F.col("_q")[i]) for i, band in enumerate(BAND_COLUMNS)}
    cols.update({f"{band}_format_valid": ~band_error for band in BAND_COLUMNS})
    cols["freq_format_error"] = band_error
    cols["id"] = F.col("row_id").cast("double")
    return add_derived_columns(q.withColumns(cols).drop("_q"))
