"""Rows inside closed time windows, by dyadic covers instead of a nested loop.

Time is cut into hours.  A window is covered by at most two dyadic spans (2^k hours, aligned)
per level, so a window of a year has a few dozen keys and one of a century not many more.  The
hours of a series that hold rows are found by one partial aggregation; each lies in one span
per level.  Windows and hours meet on (series, level, span); rows then meet their hour's
windows on (series, hour), each moved once, with the exact predicate on top.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonolith.options import ScaleOptions
from sonolith.plans.sizing import row_bound

#: Spans of up to 2^24 hours, about 1900 years; longer windows repeat the widest span.
LEVELS = 24


def hour_of(ts: Column) -> Column:
    """Hours since 1970, from the clock fields alone (no session zone for zone-free values)."""
    return (F.unix_date(F.to_date(ts)).cast("long") * 24 + F.hour(ts)).cast("long")


def span_key(level: Column, index: Column) -> Column:
    """One number per (level, span)."""
    return (index * F.lit(LEVELS + 1) + level).cast("long")


def dyadic_cover(first: Column, last: Column) -> Column:
    """Keys of the spans that cover the hours ``first`` to ``last``, both included, each hour once.

    No keys if ``last`` is before ``first``."""
    shift = lambda c, k: F.call_function("shiftright", c, k.cast("int"))

    def inside(k: Column) -> tuple[Column, Column]:
        """Spans of level ``k`` that lie wholly inside: from, and up to (left out)."""
        return -shift(-first, k), shift(last + 1, k)

    def of_level(k: Column) -> Column:
        low, high = inside(k)
        low_up, high_up = inside(k + 1)
        top = k == F.lit(LEVELS)
        # only the outermost spans of a level can lie outside the level above
        alone = lambda i: (low_up >= high_up) | (shift(i, F.lit(1)) < low_up) | (shift(i, F.lit(1)) >= high_up)
        ends = F.array_distinct(F.array(low, high - 1))
        own = F.when(top, F.sequence(low, F.greatest(low, high - 1))).otherwise(F.filter(ends, alone))
        return F.when(low < high, F.transform(own, lambda i: span_key(k, i))).otherwise(F.array().cast("array<long>"))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), of_level))


def spans_of(hour: Column, levels: Sequence[int]) -> Column:
    """Keys of the spans of some levels that hold an hour."""
    return F.array(*[span_key(F.lit(k), F.shiftright(hour, k)) for k in levels]).cast("array<long>")


def rows_in_windows(rows: DataFrame, windows: DataFrame, start: str, end: str, keys: Sequence[str], ts: str = "timestamp", hours_from: DataFrame | None = None) -> DataFrame:
    """Each row with every window of its series that holds it; bounds included.

    ``hours_from`` may give a cheaper table with the same keys and times to find the filled
    hours from.  Windows with a null bound, or that end before they start, hold nothing."""
    keys = list(keys)
    w = windows.where(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(start) <= F.col(end)))
    w = w.withColumn("_span", F.explode(dyadic_cover(hour_of(F.col(start)), hour_of(F.col(end)))))
    r = rows.where(F.col(ts).isNotNull()).withColumn("_hour", hour_of(F.col(ts)))
    filled = (rows if hours_from is None else hours_from).where(F.col(ts).isNotNull())
    filled = filled.select(*keys, hour_of(F.col(ts)).alias("_hour")).distinct()
    # one number of keys and at most LEVELS + 1 levels come back
    n, levels = w.agg(F.count(F.lit(1)), F.collect_set(F.pmod("_span", F.lit(LEVELS + 1)))).first()
    filled = filled.withColumn("_span", F.explode(spans_of(F.col("_hour"), sorted(levels))))
    met = filled.join(F.broadcast(w) if n <= row_bound(w, ScaleOptions.broadcast_max_rows) else w, keys + ["_span"], "inner").drop("_span")
    within = (F.col(ts) >= F.col(start)) & (F.col(ts) <= F.col(end))
    return r.join(met, keys + ["_hour"], "inner").where(within).drop("_hour")
