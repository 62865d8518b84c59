"""Stage-1 rules (R2-R4), severities (R3) and Stage-2/3 messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonolith.functions import vocab as V
from sonolith.operators.persistence import persistent_flag
from sonolith.options import Options


def _ge(z: str, t: float) -> Column:
    return F.coalesce(F.abs(F.col(z)) >= F.lit(t), F.lit(False))


def severity(persistent: Column, warning: Column) -> Column:
    return F.when(persistent, F.lit("ANOMALY")).when(warning, F.lit("WARNING")).otherwise(F.lit("NORMAL"))


def apply_stage1_rules(df: DataFrame, opts: Options, keys: Sequence[str] = ("asset_id",)) -> DataFrame:
    """Threshold rules on robust z, persistence per segment, severity and message."""
    s1 = opts.stage1
    flagged = df.withColumns(
        {
            "warn_avg": _ge("avg_decibel_robust_z", s1.robust_z_threshold),
            "warn_range": _ge("peak_minus_min_robust_z", s1.range_z_threshold),
            "warn_spike": _ge("peak_minus_avg_robust_z", s1.range_z_threshold),
        }
    ).withColumn("warning_now", F.col("warn_avg") | F.col("warn_range") | F.col("warn_spike"))
    flagged = persistent_flag(flagged, "warning_now", s1.persistence_windows, "persistent_warning", keys)
    p, w = F.col("persistent_warning"), F.col("warning_now")
    return flagged.withColumns(
        {
            "stage1_severity": severity(p, w),
            "stage1_message": F.when(p & F.col("warn_avg"), F.lit(V.STAGE1_MSG_PERSISTENT_LEVEL))
            .when(p & F.col("warn_range"), F.lit(V.STAGE1_MSG_PERSISTENT_RANGE))
            .when(w & F.col("warn_spike"), F.lit(V.STAGE1_MSG_SPIKE))
            .when(w, F.lit(V.STAGE1_MSG_SINGLE))
            .otherwise(F.lit(V.MSG_NORMAL)),
        }
    )


def stage2_message(persistent: Column, warning: Column) -> Column:
    return (
        F.when(persistent, F.lit(V.STAGE2_MSG_PERSISTENT))
        .when(warning, F.lit(V.STAGE2_MSG_SINGLE))
        .otherwise(F.lit(V.MSG_NORMAL))
    )


def stage3_message(persistent: Column, warning: Column, votes: Column) -> Column:
    return (
        F.when(persistent & (votes == 3), F.lit(V.STAGE3_MSG_ALL_THREE))
        .when(persistent & (votes >= 2), F.lit(V.STAGE3_MSG_SEVERAL))
        .when(warning & (votes == 1), F.lit(V.STAGE3_MSG_SINGLE_MODEL))
        .when(warning, F.lit(V.STAGE3_MSG_MULTI_MODEL))
        .otherwise(F.lit(V.MSG_NORMAL))
    )
