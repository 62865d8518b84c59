"""Two-level ordered scans over long per-asset series.

A plain ``Window.partitionBy(asset).orderBy(ts)`` puts a whole asset into one
task; one hot asset can hold a third of all rows.  Every ordered operator in this
package therefore runs as a two-level scan:

1. rows are windowed inside ``(asset, bucket)`` where ``bucket`` is a stretch of the
   series cut by counts of its rows -- thousands of independent small sorts;
2. a per-bucket summary (one row per asset and bucket: totals, maxima, first and
   last values) is scanned per asset -- a table ``bucket_rows`` times smaller;
3. the summary is joined back on ``(asset, bucket)``, which the rows are already
   hash-partitioned on, so the large side is not shuffled again.

Running sums, running maxima, ``lag`` and ``lead`` across bucket borders are
composed from the two levels; the result equals the plain window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = "scan_bucket"
# Rows without timestamp sort last: they get a bucket after every real one.
NULL_BUCKET = 2**62
_HELPER_PREFIXES = ("_sv_", "_mv_", "_pv_", "_nv_", "_si_", "_mi_", "_pi_", "_ni_", "_sp_", "_mp_", "_pp_", "_np_", "_sc_")


def epoch_minutes(ts: Column) -> Column:
    """Minutes since 1970-01-01 of a TIMESTAMP_NTZ, without time-zone conversion."""
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long")
    return (days * 24 + F.hour(ts)) * 60 + F.minute(ts)


def bucket_expr(ts_col: str = "timestamp", hours: int = 24, width_minutes: Column | None = None) -> Column:
    """Time bucket: fixed ``hours`` wide, or ``width_minutes`` (a per-row column)."""
    ts = F.col(ts_col)
    width = width_minutes if width_minutes is not None else F.lit(int(hours) * 60)
    return F.when(ts.isNull(), F.lit(NULL_BUCKET)).otherwise(F.floor(epoch_minutes(ts) / width)).cast("long")


def add_bucket(
    df: DataFrame,
    ts_col: str = "timestamp",
    hours: int = 24,
    keys: Sequence[str] | None = None,
    target_rows: int | None = None,
    max_rows: int = 2_000_000,
) -> DataFrame:
    """Add the scan bucket: a fixed number of hours, or with ``keys`` and ``target_rows`` one cut by counts."""
    if keys is None or target_rows is None:
        return df.withColumn(BUCKET, bucket_expr(ts_col, hours))
    return counted_bucket(df, list(keys), int(target_rows), ts_col, max_rows)


def counted_bucket(df: DataFrame, keys: list[str], target: int, ts_col: str = "timestamp", max_rows: int = 2_000_000, row_id: str = "row_id") -> DataFrame:
    """Buckets of at most ``2 * target`` rows along (timestamp NULLS LAST, row_id), whatever the gaps and densities.

    Rows are counted per day; only days above the target are counted again per minute, those
    minutes per second, those seconds per microsecond. One instant above the target, and the
    rows without a timestamp, are cut by row id: ids are unique, so ``target`` consecutive
    ones are at most ``target`` rows. A bucket starts wherever the cells before it, added up
    along the key, pass a multiple of the target.
    """
    from sonolith.plans.sizing import broadcast_if_small
    from sonolith.session import cut_lineage

    ts = F.col(ts_col)
    minutes = epoch_minutes(ts)
    micros = (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    fine = [
        F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long"),
        minutes,
        minutes * 60 + F.floor(micros / 1_000_000),
        minutes * 60_000_000 + micros,
        F.floor(F.col(row_id) / target),
    ]
    levels = [f"_c{i}" for i in range(len(fine))]
    rows = df.withColumns({"_c0": F.coalesce(fine[0], F.lit(NULL_BUCKET)), **{c: F.lit(0).cast("long") for c in levels[1:]}})
    at = [*keys, "_c0"]
    counts = cut_lineage(rows.groupBy(*at).agg(F.count(F.lit(1)).alias("_n")))
    cells = counts.where(F.col("_n") <= target)
    crowded = counts.where(F.col("_n") > target).drop("_n")
    for i in range(1, len(levels)):
        if crowded.isEmpty():
            break
        hit = broadcast_if_small(crowded.withColumn("_hit", F.lit(True)), max_rows)
        rows = rows.join(hit, at, "left").withColumn(levels[i], F.when(F.col("_hit"), F.coalesce(fine[i], F.lit(0))).otherwise(0).cast("long"))
        at = [*at, levels[i]]
        counts = cut_lineage(rows.where("_hit").groupBy(*at).agg(F.count(F.lit(1)).alias("_n")))
        rows = rows.drop("_hit")
        whole = F.col("_n") <= target if i < len(levels) - 1 else F.lit(True)
        cells = cells.withColumn(levels[i], F.lit(0).cast("long")).unionByName(counts.where(whole))
        crowded = counts.where(~whole).drop("_n")
    along = Window.partitionBy(*keys).orderBy(*at[len(keys) :]).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(along), F.lit(0))
    cells = cells.withColumn(BUCKET, F.floor(before / target) * 2 + (F.col("_c0") == NULL_BUCKET).cast("long")).drop("_n")
    return rows.join(broadcast_if_small(cut_lineage(cells), max_rows), at, "left").drop(*levels)


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    sums: Mapping[str, Column] | None = None,
    maxes: Mapping[str, Column] | None = None,
    prev: Mapping[str, Column] | None = None,
    nxt: Mapping[str, Column] | None = None,
    bucket: str = BUCKET,
) -> DataFrame:
    """Add sequence-wide running aggregates per ``keys`` in ``order``.

    ``sums``: inclusive running sum; ``maxes``: inclusive running max (NULLs
    skipped); ``prev``/``nxt``: the expression's value on the previous/next row of
    the sequence (NULL at the ends).  ``order`` columns are ascending; within one
    bucket they must be non-NULL (NULL timestamps live in their own last bucket).
    """
    sums, maxes, prev, nxt = dict(sums or {}), dict(maxes or {}), dict(prev or {}), dict(nxt or {})
    keys = list(keys)
    part = keys + [bucket]
    src = {f"_sv_{n}": e for n, e in sums.items()}
    src.update({f"_mv_{n}": e for n, e in maxes.items()})
    src.update({f"_pv_{n}": e for n, e in prev.items()})
    src.update({f"_nv_{n}": e for n, e in nxt.items()})
    base = df.withColumns(src)

    w = Window.partitionBy(*part).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner_cols: dict[str, Column] = {"_sc_rn": F.row_number().over(w), "_sc_last": F.lead(F.lit(1)).over(w).isNull()}
    for n in sums:
        inner_cols[f"_si_{n}"] = F.sum(f"_sv_{n}").over(upto)
    for n in maxes:
        inner_cols[f"_mi_{n}"] = F.max(f"_mv_{n}").over(upto)
    for n in prev:
        inner_cols[f"_pi_{n}"] = F.lag(f"_pv_{n}").over(w)
    for n in nxt:
        inner_cols[f"_ni_{n}"] = F.lead(f"_nv_{n}").over(w)
    inner = base.withColumns(inner_cols)

    # The summary is aggregated from the windowed rows: same partitioning, so the
    # rows' exchange is shared by both branches instead of recomputed.
    aggs = []
    for n in sums:
        aggs.append(F.sum(f"_sv_{n}").alias(f"_sb_{n}"))
    for n in maxes:
        aggs.append(F.max(f"_mv_{n}").alias(f"_mb_{n}"))
    for n in prev:
        aggs.append(F.max_by(F.col(f"_pv_{n}"), F.col("_sc_rn")).alias(f"_pb_{n}"))
    for n in nxt:
        aggs.append(F.min_by(F.col(f"_nv_{n}"), F.col("_sc_rn")).alias(f"_nb_{n}"))
    if not aggs:
        aggs.append(F.count(F.lit(1)).alias("_sc_n"))
    summary = inner.groupBy(*part).agg(*aggs)

    ws = Window.partitionBy(*keys).orderBy(bucket)
    before = ws.rowsBetween(Window.unboundedPreceding, -1)
    sum_cols = []
    for n in sums:
        sum_cols.append(F.sum(f"_sb_{n}").over(before).alias(f"_sp_{n}"))
    for n in maxes:
        sum_cols.append(F.max(f"_mb_{n}").over(before).alias(f"_mp_{n}"))
    for n in prev:
        sum_cols.append(F.lag(f"_pb_{n}").over(ws).alias(f"_pp_{n}"))
    for n in nxt:
        sum_cols.append(F.lead(f"_nb_{n}").over(ws).alias(f"_np_{n}"))
    carried = summary.select(*part, *sum_cols)

    # The rows are hash-partitioned on (keys, bucket) by the inner window, so a
    # shuffled hash join only moves the (small) summary.
    joined = inner.join(carried.hint("shuffle_hash"), part, "left")

    out: dict[str, Column] = {}
    for n in sums:
        out[n] = F.coalesce(F.col(f"_sp_{n}"), F.lit(0)) + F.col(f"_si_{n}")
    for n in maxes:
        out[n] = F.greatest(F.col(f"_mp_{n}"), F.col(f"_mi_{n}"))
    for n in prev:
        out[n] = F.when(F.col("_sc_rn") == 1, F.col(f"_pp_{n}")).otherwise(F.col(f"_pi_{n}"))
    for n in nxt:
        out[n] = F.when(F.col("_sc_last"), F.col(f"_np_{n}")).otherwise(F.col(f"_ni_{n}"))
    helper = [c for c in joined.columns if c.startswith(_HELPER_PREFIXES)]
    return joined.withColumns(out).drop(*helper)


def sequence_position(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "seq_pos") -> DataFrame:
    """0-based dense position per key in ``order`` (distributed, no per-key task)."""
    return ordered_scan(df, keys, order, sums={out: F.lit(1).cast("long")}).withColumn(out, F.col(out) - 1)


def count_breaks(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    carry: Sequence[str],
    is_break,
    out: str,
    bucket: str = BUCKET,
) -> DataFrame:
    """Running count of "break" rows, where a break depends on the previous row.

    ``is_break(cur, prev)`` gets two dicts of Columns (current and previous row
    values of ``carry``; previous values are NULL on the first row) and returns a
    boolean Column.  Gaps-and-islands in one fused two-level scan: the previous
    row of a bucket's first row comes from the bucket summary.
    """
    keys = list(keys)
    part = keys + [bucket]
    w = Window.partitionBy(*part).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = df.withColumns({"_cb_rn": F.row_number().over(w), **{f"_cb_p_{c}": F.lag(c).over(w) for c in carry}})
    cur = {c: F.col(c) for c in carry}
    inner = inner.withColumn(
        "_cb_inner",
        F.when(F.col("_cb_rn") > 1, F.coalesce(is_break(cur, {c: F.col(f"_cb_p_{c}") for c in carry}), F.lit(False)))
        .otherwise(F.lit(False))
        .cast("long"),
    ).withColumn("_cb_inner_cum", F.sum("_cb_inner").over(upto))
    summary = inner.groupBy(*part).agg(
        *[F.min_by(F.col(c), F.col("_cb_rn")).alias(f"_cb_f_{c}") for c in carry],
        *[F.max_by(F.col(c), F.col("_cb_rn")).alias(f"_cb_l_{c}") for c in carry],
        F.sum("_cb_inner").alias("_cb_n"),
    )
    ws = Window.partitionBy(*keys).orderBy(bucket)
    before = ws.rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.withColumns({f"_cb_pl_{c}": F.lag(f"_cb_l_{c}").over(ws) for c in carry})
    summary = summary.withColumn(
        "_cb_first",
        F.coalesce(
            is_break({c: F.col(f"_cb_f_{c}") for c in carry}, {c: F.col(f"_cb_pl_{c}") for c in carry}), F.lit(False)
        ).cast("long"),
    )
    summary = summary.select(
        *part,
        "_cb_first",
        F.coalesce(F.sum(F.col("_cb_n") + F.col("_cb_first")).over(before), F.lit(0)).alias("_cb_before"),
    )
    joined = inner.join(summary.hint("shuffle_hash"), part, "left")
    helpers = ["_cb_rn", "_cb_inner", "_cb_inner_cum", "_cb_first", "_cb_before"] + [f"_cb_p_{c}" for c in carry]
    return joined.withColumn(
        out, F.col("_cb_before") + F.col("_cb_first") + F.col("_cb_inner_cum")
    ).drop(*helpers)
