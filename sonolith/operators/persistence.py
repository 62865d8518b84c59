"""Persistence rules (W6-W8): the last N rows of a segment all carry a flag.

pandas' ``rolling(N, min_periods=1).sum() >= N`` per segment equals "the run of
consecutive flagged rows ending here, inside the segment, is at least N long".
That run length is computed as ``pos - run_start + 1`` where ``run_start`` is a
running maximum of restart positions -- an associative scan, so it runs on the
two-level bucketed scan instead of one window task per segment.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonolith.operators.quality import CANONICAL_ORDER
from sonolith.operators.sequence import ordered_scan


def persistent_flag(
    df: DataFrame,
    flag: str,
    n: int,
    out: str,
    keys: Sequence[str] = ("asset_id",),
    eligible: str | None = None,
    order: Sequence[str] = CANONICAL_ORDER,
) -> DataFrame:
    """Add ``out`` = ``flag`` held for ``n`` consecutive rows of the same segment.

    Requires ``seq_pos``, ``gap_flag`` and the scan bucket from the quality step.
    With ``eligible`` given, only eligible rows count as the sequence (rows that
    are not eligible neither extend nor break a run, W7); the result is False on
    rows that are not eligible.
    """
    keys = list(keys)
    f = F.coalesce(F.col(flag), F.lit(False))
    gap = F.col("gap_flag")
    if eligible is None:
        pos = F.col("seq_pos")
        restart = F.when(~f, pos + 1).when(gap, pos)
        scanned = ordered_scan(df, keys, order, maxes={"_run_start": restart})
        run_len = F.col("seq_pos") - F.coalesce(F.col("_run_start"), F.lit(0)) + 1
        return scanned.withColumn(out, f & (run_len >= F.lit(n))).drop("_run_start")

    e = F.coalesce(F.col(eligible), F.lit(False))
    counted = ordered_scan(df, keys, order, sums={"_elig_cum": e.cast("long")})
    before = F.col("_elig_cum") - e.cast("long")  # eligible rows strictly before this one
    restart = F.greatest(F.when(gap, before), F.when(e & ~f, before + 1))
    scanned = ordered_scan(counted.withColumn("_elig_before", before), keys, order, maxes={"_run_start": restart})
    run_len = F.col("_elig_before") - F.coalesce(F.col("_run_start"), F.lit(0)) + 1
    return scanned.withColumn(out, e & f & (run_len >= F.lit(n))).drop("_run_start", "_elig_cum", "_elig_before")
