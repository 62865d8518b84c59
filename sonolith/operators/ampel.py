"""Four-level status ("Ampel") for rows and events, distribution and overall
status (R7-R10, A21-A23)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonolith.functions import vocab as V


def _clip(c: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(3), c))


def apply_row_ampel(df: DataFrame) -> DataFrame:
    """Row rank: 1 warning; 2 strong or (warning and consensus >= 0.65); 3 persistent
    with >= 2 votes; minus one each for reduced quality and near gap, clipped (R7)."""
    w, s = F.col("stage3_warning_now"), F.col("stage3_strong_now")
    raw = (
        F.when(F.col("stage3_persistent_warning") & (F.col("stage3_votes") >= 2), F.lit(3))
        .when(s | (w & (F.col("stage3_consensus_score") >= F.lit(0.65))), F.lit(2))
        .when(w, F.lit(1))
        .otherwise(F.lit(0))
    )
    discount = F.coalesce(F.col("quality_flag") == F.lit(V.REDUCED_QUALITY), F.lit(False)).cast("int") + F.coalesce(
        F.col("near_gap_flag"), F.lit(False)
    ).cast("int")
    out = df.withColumn("stage3_ampel_rank_raw", raw).withColumn("stage3_ampel_rank", _clip(F.col("stage3_ampel_rank_raw") - discount))
    return out.withColumns(
        {
            "stage3_ampel_label": V.ampel_label(F.col("stage3_ampel_rank")),
            "stage3_ampel_discounted": F.col("stage3_ampel_rank") < F.col("stage3_ampel_rank_raw"),
        }
    )


def stage3_event_aggs() -> list[Column]:
    """Inputs of the event status and enrichment, folded into the event aggregate."""
    return [
        F.max("stage3_ampel_rank").alias("_max_row_rank"),
        F.count_if("stage3_strong_now").alias("_strong_rows"),
        F.max("stage3_votes").alias("consensus_count"),
        F.bool_or("stage3_persistent_warning").alias("persistent_flag"),
        F.max("stage3_consensus_score").alias("stage3_consensus_score_max"),
        F.max("stage3_iforest_score").alias("stage3_iforest_score_max"),
        F.max("stage3_lof_score").alias("stage3_lof_score_max"),
        F.max("stage3_ocsvm_score").alias("stage3_ocsvm_score_max"),
    ]


def finish_stage3_events(events: DataFrame, persistence_windows: int) -> DataFrame:
    """Event rank (R8), enrichment (R9) and reason text.

    The rank starts at the highest row rank, is raised to 2 by two strong rows or
    a multi-vote row in a multi-row event, to 3 by max(2, persistence) strong rows,
    then discounted for any reduced-quality and any near-gap row.  The reason's
    label is the highest *row* status, as documented.
    """
    need = max(2, int(persistence_windows))
    base = F.col("_max_row_rank")
    lifted2 = F.when(
        (base < 2) & ((F.col("_strong_rows") >= 2) | ((F.col("consensus_count") >= 2) & (F.col("row_count") >= 2))), F.lit(2)
    ).otherwise(base)
    lifted3 = F.when((lifted2 < 3) & (F.col("_strong_rows") >= need), F.lit(3)).otherwise(lifted2)
    discount = F.col("has_reduced_quality").cast("int") + F.col("has_near_gap").cast("int")
    rank = _clip(lifted3 - discount)
    text = F.format_string("%d Modell(e) gleichzeitig, Dauer %.0f min", F.col("consensus_count"), F.col("duration_minutes"))
    text = F.concat(text, F.when(F.col("persistent_flag"), F.lit(", Persistenz erkannt")).otherwise(F.lit(", keine Persistenz")))
    rq, ng = F.col("has_reduced_quality"), F.col("has_near_gap")
    suffix = (
        F.when(rq & ng, F.lit(", Reduced Quality + Gap-Nähe => Abschlag"))
        .when(rq, F.lit(", Reduced Quality => Abschlag"))
        .when(ng, F.lit(", Gap-Nähe => Abschlag"))
        .otherwise(F.lit(""))
    )
    reason = F.concat(V.ampel_label(_clip(base)), F.lit(": "), text, suffix)
    return events.withColumns(
        {"ampel_rank": rank, "ampel_reason": reason}
    ).withColumn("ampel_label", V.ampel_label(F.col("ampel_rank"))).drop("_max_row_rank", "_strong_rows")


def ampel_distribution(events: DataFrame, assets: DataFrame, keys: Sequence[str] = ("asset_id",)) -> DataFrame:
    """Events per status label, every label present (zero-filled) per asset."""
    keys = list(keys)
    labels = F.explode(F.array(*[F.lit(v) for v in V.AMPEL_LABELS.values()]))
    dim = assets.select(*keys).distinct().select(*keys, labels.alias("ampel_label"))
    counts = events.groupBy(*keys, "ampel_label").agg(F.count(F.lit(1)).alias("events"))
    return dim.join(counts, keys + ["ampel_label"], "left").fillna(0, subset=["events"])


def ampel_summary(events: DataFrame, assets: DataFrame, keys: Sequence[str] = ("asset_id",)) -> DataFrame:
    """Overall status = highest event rank, 'normal' without events (A22), with the
    explanation text and the number of alert rows behind it (A23)."""
    keys = list(keys)
    per = events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("events"),
        F.max("ampel_rank").alias("_max_rank"),
        F.count_if(F.col("ampel_rank") == 0).alias("normal_events"),
        F.count_if(F.col("ampel_rank") == 1).alias("_n1"),
        F.count_if(F.col("ampel_rank") == 2).alias("_n2"),
        F.count_if(F.col("ampel_rank") == 3).alias("_n3"),
        F.sum("row_count").alias("alert_rows"),
    )
    out = assets.select(*keys).distinct().join(per, keys, "left")
    out = out.fillna(0, subset=["events", "normal_events", "_n1", "_n2", "_n3", "alert_rows"])
    rank = F.coalesce(F.col("_max_rank"), F.lit(0))
    reason = (
        F.when(F.col("events") == 0, F.lit("Im gewählten Zeitraum gibt es keine Stage-3-Events."))
        .when(rank == 3, F.format_string("Mindestens ein Event wurde als persistent anomal eingestuft (%d Events).", F.col("_n3")))
        .when(rank == 2, F.format_string("Es gibt keine roten Events, aber %d konsistent auffällige Events.", F.col("_n2")))
        .when(
            rank == 1,
            F.format_string(
                "Es gibt nur lokale Auffälligkeiten (%d Events), aber keine konsistenten oder persistenten roten Phasen.", F.col("_n1")
            ),
        )
        .otherwise(F.lit("Die vorhandenen Events wurden nach Abschlägen eher als normal eingestuft."))
    )
    reason = F.when(
        (F.col("events") > 0) & (F.col("normal_events") > 0),
        F.concat(reason, F.format_string(" %d Event(s) wurden durch Reduced Quality oder Gap-Nähe auf normal abgewertet.", F.col("normal_events"))),
    ).otherwise(reason)
    return out.select(
        *keys,
        V.ampel_label(rank).alias("overall_ampel"),
        "events",
        "normal_events",
        "alert_rows",
        reason.alias("ampel_explanation"),
    )
