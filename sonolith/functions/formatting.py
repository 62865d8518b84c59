"""Formatting expressions: event signature (P11), display timestamps.

Wall-clock values (TIMESTAMP_NTZ) are printed from their parts, so that no session
time zone can shift them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _parts(ts: Column) -> dict[str, Column]:
    ts = ts.cast("timestamp_ntz")
    return {"y": F.year(ts), "M": F.month(ts), "d": F.dayofmonth(ts), "H": F.hour(ts), "m": F.minute(ts), "s": F.second(ts)}


def print_timestamp(ts: Column, template: str, parts: str) -> Column:
    """``template`` (printf style) filled with the named parts; NULL stays NULL."""
    p = _parts(ts)
    return F.when(ts.isNotNull(), F.format_string(template, *[p[k] for k in parts]))


def iso_text(ts: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ss``."""
    return print_timestamp(ts, "%04d-%02d-%02dT%02d:%02d:%02d", "yMdHms")


def event_signature(stage: Column, start: Column, end: Column) -> Column:
    """``stage|yyyyMMddTHHmmss|yyyyMMddTHHmmss`` with ``NA`` for a missing bound."""
    compact = lambda c: F.coalesce(print_timestamp(c, "%04d%02d%02dT%02d%02d%02d", "yMdHms"), F.lit("NA"))
    return F.concat_ws("|", stage, compact(start), compact(end))


def display_timestamp(ts: Column) -> Column:
    """``dd.MM.yyyy HH:mm``; missing -> empty string."""
    return F.coalesce(print_timestamp(ts, "%02d.%02d.%04d %02d:%02d", "dMyHm"), F.lit(""))
