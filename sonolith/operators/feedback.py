"""Defect labels and inspection notes: normalisation, batch upserts, deletes,
lookups and the rows inside learning windows (L1-L6, J5, J8, J9, P13)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonolith.functions import vocab as V
from sonolith.functions.formatting import display_timestamp, event_signature, iso_text
from sonolith.functions.parsing import parse_iso_timestamp, parse_timestamp
from sonolith.operators.quality import CANONICAL_ORDER
from sonolith.operators.ranges import rows_in_windows
from sonolith.operators.sequence import ordered_scan

LABEL_FORM_FORMAT = "d.M.yyyy H:m"


def normalize_labels(raw: DataFrame) -> DataFrame:
    """Parse the four timestamps (bad -> NULL), default pre-failure hours to 24 and
    derive the learning window ``[end - hours, end]`` with end = repaired_at, else
    event_end (L1)."""
    hours = F.coalesce(F.col("pre_failure_hours").cast("string").try_cast("double").cast("int"), F.lit(24))
    out = raw.withColumns(
        {
            "event_start": parse_iso_timestamp(F.col("event_start")),
            "event_end": parse_iso_timestamp(F.col("event_end")),
            "repaired_at": parse_iso_timestamp(F.col("repaired_at")),
            "created_at": parse_iso_timestamp(F.col("created_at")),
            "pre_failure_hours": hours,
        }
    )
    end = F.coalesce(F.col("repaired_at"), F.col("event_end"))
    return out.withColumns(
        {"learning_window_end": end, "learning_window_start": end - F.make_dt_interval(F.lit(0), F.col("pre_failure_hours"))}
    )


def strict_form_timestamp(c: Column) -> Column:
    """Form text ``dd.MM.yyyy HH:mm`` -> timestamp; NULL marks a rejected entry."""
    return parse_timestamp(c, LABEL_FORM_FORMAT)


def label_id_for(*parts: Column) -> Column:
    """``LBL-`` + 10 upper-case hex digits from the natural key: reproducible under retries.

    Forty bits do not tell all labels of a large store apart; stores are keyed by LABEL_KEY."""
    return F.concat(F.lit("LBL-"), F.upper(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 10)))


# Keys of the stores: a signature or a short id alone can belong to several assets.
LABEL_KEY = ("asset_id", "label_id", "source_stage", "event_start", "event_end")
NOTE_KEY = ("asset_id", "event_signature")


def labels_from_events(
    events: DataFrame,
    defect_type: Column,
    pre_failure_hours: Column,
    created_at: dt.datetime,
    keys: Sequence[str] = ("asset_id",),
    repaired_at: Column | None = None,
) -> DataFrame:
    """Label records prefilled from events (L5): stage (blank -> Manuell), start, end,
    repaired_at = end (minute precision, as entered in the form); rows without a
    defect type are rejected."""
    stage = F.coalesce(F.nullif(F.trim(F.col("stage")), F.lit("")), F.lit(V.MANUAL_STAGE))
    # the form shows dd.MM.yyyy HH:mm and parses it back strictly (P12 -> P13): minute precision
    minute = lambda c: strict_form_timestamp(display_timestamp(c))
    start, end = minute(F.col("start_timestamp")), minute(F.col("end_timestamp"))
    rep = minute(repaired_at) if repaired_at is not None else end
    out = events.select(
        *keys,
        label_id_for(*[F.col(k).cast("string") for k in keys], stage, iso_text(start), iso_text(end)).alias("label_id"),
        stage.alias("source_stage"),
        iso_text(start).alias("event_start"),
        iso_text(end).alias("event_end"),
        F.trim(defect_type).alias("defect_type"),
        iso_text(rep).alias("repaired_at"),
        F.lit("").alias("repaired_what"),
        pre_failure_hours.cast("string").alias("pre_failure_hours"),
        F.lit("").alias("target_metric"),
        F.lit("").alias("notes"),
        F.lit(created_at.isoformat()).alias("created_at"),
    )
    return out.where(F.coalesce(F.col("defect_type"), F.lit("")) != "")


def _same_key(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & a[k].eqNullSafe(b[k])
    return cond


def upsert(base: DataFrame, updates: DataFrame, keys: Sequence[str], order_col: str) -> DataFrame:
    """Batch upsert: the newest update per key (by ``order_col``; ties by the whole record)
    replaces the base record, other base records stay (L2, L3)."""
    tie = F.xxhash64(*[F.col(c) for c in sorted(updates.columns)])
    w = Window.partitionBy(*keys).orderBy(F.col(order_col).desc_nulls_last(), tie)
    latest = updates.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")
    new = latest.select(*keys)
    kept = base.join(new, _same_key(base, new, keys), "left_anti")
    return kept.unionByName(latest, allowMissingColumns=True)


def delete_by_key(base: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Delete records whose key appears in ``gone``."""
    names = gone.select(*keys).distinct()
    return base.join(names, _same_key(base, names, keys), "left_anti")


def notes_from_events(events: DataFrame, verdict: Column, notes: Column, updated_at: Column, keys: Sequence[str] = ("asset_id",)) -> DataFrame:
    """Inspection-note records keyed by the event signature (L3 input)."""
    return events.select(
        *keys,
        event_signature(F.col("stage"), F.col("start_timestamp"), F.col("end_timestamp")).alias("event_signature"),
        F.col("stage"),
        iso_text(F.col("start_timestamp")).alias("start_timestamp"),
        iso_text(F.col("end_timestamp")).alias("end_timestamp"),
        verdict.alias("verdict"),
        notes.alias("notes"),
        updated_at.alias("updated_at"),
    )


def normalize_notes(raw: DataFrame) -> DataFrame:
    """Parse note timestamps (bad -> NULL) (L4); order newest first only when presenting."""
    return raw.withColumns({c: parse_iso_timestamp(F.col(c)) for c in ("start_timestamp", "end_timestamp", "updated_at")})


def note_lookup(events: DataFrame, notes: DataFrame, keys: Sequence[str] = ("asset_id",)) -> DataFrame:
    """Every event with its note by signature; default verdict when none."""
    keys = list(keys)
    ev = events.withColumn("event_signature", event_signature(F.col("stage"), F.col("start_timestamp"), F.col("end_timestamp")))
    n = notes.select(*keys, "event_signature", F.col("verdict").alias("_v"), F.col("notes").alias("_n"))
    j = ev.join(n, keys + ["event_signature"], "left")
    return j.withColumns(
        {"verdict": F.coalesce(F.col("_v"), F.lit(V.DEFAULT_VERDICT)), "note": F.coalesce(F.col("_n"), F.lit(""))}
    ).drop("_v", "_n")


def windows_in_range(labels: DataFrame, start: Column | None, end: Column | None) -> DataFrame:
    """Labels whose learning window meets a closed range; flag repair instants inside it."""
    ok = F.col("learning_window_start").isNotNull() & F.col("learning_window_end").isNotNull()
    if start is not None:
        ok = ok & (F.col("learning_window_end") >= start)
    if end is not None:
        ok = ok & (F.col("learning_window_start") <= end)
    rep = F.col("repaired_at").isNotNull()
    if start is not None:
        rep = rep & (F.col("repaired_at") >= start)
    if end is not None:
        rep = rep & (F.col("repaired_at") <= end)
    return labels.withColumns({"window_visible": ok, "repair_visible": rep})


def labelled_rows(rows: DataFrame, labels: DataFrame, keys: Sequence[str] = ("asset_id",), metrics: Sequence[str] = ("avg_decibel", "peak_minus_min")) -> DataFrame:
    """Measurement rows inside any label's learning window, with next-row targets
    ``next_<metric>`` inside the same segment (J5 bulk form, L6).

    Rows and windows meet by dyadic covers as in J3.  ``next_*`` comes from the two-level
    scan (lead across bucket borders), NULL at a segment end.
    """
    keys = list(keys)
    nxt = {f"_next_{m}": F.col(m) for m in metrics}
    nxt["_next_seg"] = F.col("segment_id")
    r = ordered_scan(rows, keys, CANONICAL_ORDER, nxt=nxt)
    r = r.withColumns(
        {f"next_{m}": F.when(F.col("_next_seg") == F.col("segment_id"), F.col(f"_next_{m}")) for m in metrics}
    ).drop(*nxt.keys())
    lw = labels.select(*keys, "label_id", "learning_window_start", "learning_window_end")
    return rows_in_windows(r, lw, "learning_window_start", "learning_window_end", keys, hours_from=rows)
