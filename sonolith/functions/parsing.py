"""Parsing expressions for messy, locale-formatted text (P1-P5). JVM-side, no UDFs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed value: frequency-band text shape "dd.ddd.ddd.ddd.ddd"
BAND_PATTERN = r"^[0-9]{2}(\.[0-9]{3}){4}$"
# plain decimal number after locale repair (guards try_cast, which also accepts 1d / nan / inf)
NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _last_pos(text: Column, ch: str) -> Column:
    """1-based position of the last ``ch`` (0 when absent)."""
    r = F.instr(F.reverse(text), ch)
    return F.when(r == 0, F.lit(0)).otherwise(F.length(text) - r + 1)


def _count(text: Column, ch: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(ch), F.lit("")))


def _keep_first(text: Column, ch: str) -> Column:
    """Keep the first ``ch`` and drop every later one."""
    pos = F.instr(text, ch)
    return F.concat(F.substring_index(text, ch, 1), F.lit(ch), F.replace(F.substr(text, pos + 1), F.lit(ch), F.lit("")))


def locale_number(c: Column) -> Column:
    """Repair a locale-formatted number and parse it (P3); junk gives NULL.

    both ``,`` and ``.``: the later one is the decimal mark, the other a grouping
    mark; several dots only: the first is decimal; several commas only: the first
    is kept as a comma (unparsable); otherwise a comma is a decimal mark.
    """
    t = F.replace(_strip(c.cast("string")), F.lit(" "), F.lit(""))
    has_c, has_d = F.instr(t, ",") > 0, F.instr(t, ".") > 0
    repaired = (
        F.when(has_c & has_d & (_last_pos(t, ",") > _last_pos(t, ".")), F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(has_c & has_d, F.replace(t, F.lit(","), F.lit("")))
        .when((_count(t, ".") > 1) & ~has_c, _keep_first(t, "."))
        .when((_count(t, ",") > 1) & ~has_d, _keep_first(t, ","))
        .otherwise(F.replace(t, F.lit(","), F.lit(".")))
    )
    return F.when(repaired.rlike(NUMBER_PATTERN), repaired.try_cast("double"))


def frequency_band(c: Column) -> tuple[Column, Column]:
    """(value, valid) for ``dd.ddd.ddd.ddd.ddd``: first dot decimal, the rest removed."""
    t = _strip(c.cast("string"))
    valid = F.coalesce(t.rlike(BAND_PATTERN), F.lit(False))
    value = F.concat(F.substring_index(t, ".", 1), F.lit("."), F.replace(F.substr(t, F.lit(4)), F.lit("."), F.lit("")))
    return F.when(valid, value.try_cast("double")), valid


# fixed value: day-first patterns tried when the configured format matches no row
DAY_FIRST_PATTERNS = (
    "d.M.yyyy H:m:s",
    "d.M.yyyy H:m",
    "d.M.yyyy",
    "d/M/yyyy H:m:s",
    "d/M/yyyy H:m",
    "d/M/yyyy",
    "d-M-yyyy H:m:s",
    "d-M-yyyy H:m",
    "d-M-yyyy",
    "yyyy-M-d H:m:s",
    "yyyy-M-d'T'H:m:s",
    "yyyy-M-d H:m",
    "yyyy-M-d",
)


# date letters of a Java pattern -> digits they accept (one letter: padded or not)
_FIELD = {"yyyy": "[0-9]{4}", "d": "[0-9]{1,2}", "M": "[0-9]{1,2}", "H": "[0-9]{1,2}", "m": "[0-9]{1,2}", "s": "[0-9]{1,2}"}
_FIELD |= {k * 2: "[0-9]{2}" for k in "dMHms"}


def _wall_time(text: Column, fmt: str) -> Column:
    """Text in a Java pattern of year to second -> TIMESTAMP_NTZ without any time zone; bad -> NULL.

    The fields are taken out by a pattern and put together as ISO text; the cast rejects
    impossible dates and times."""
    pattern, order = "", []
    for quoted, letters, other in re.findall(r"'([^']*)'|([a-zA-Z]+)|([^a-zA-Z'])", fmt):
        if not letters:
            pattern += re.sub(r"([^0-9A-Za-z ])", r"\\\1", quoted or other)
            continue
        for run in re.findall(r"((.)\2*)", letters):
            if run[0] not in _FIELD:
                raise ValueError(f"timestamp pattern {fmt!r}: field {run[0]!r} is not supported")
            pattern += f"({_FIELD[run[0]]})"
            order.append(run[1])
    full = f"^{pattern}$"
    part = lambda k: f"${order.index(k) + 1}" if k in order else "00"
    iso = F.regexp_replace(text, full, f"{part('y')}-{part('M')}-{part('d')} {part('H')}:{part('m')}:{part('s')}")
    return F.when(text.rlike(full), iso.try_cast("timestamp_ntz"))


def parse_timestamp(c: Column, fmt: str) -> Column:
    """Trimmed text in ``fmt`` -> TIMESTAMP_NTZ, bad -> NULL (P1); the session time zone plays no part."""
    return _wall_time(_strip(c.cast("string")), fmt)


def parse_timestamp_day_first(c: Column) -> Column:
    """Fallback: the first of several day-first patterns that parses."""
    t = _strip(c.cast("string"))
    return F.coalesce(*[_wall_time(t, p) for p in DAY_FIRST_PATTERNS])


def parse_iso_timestamp(c: Column) -> Column:
    """ISO-8601 text -> TIMESTAMP_NTZ; bad -> NULL. A text with an offset gives its UTC wall time,
    one without keeps its own; the session time zone plays no part."""
    t = _strip(c.cast("string"))
    instant = F.unix_micros(t.try_cast("timestamp"))
    utc = F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(secs=(instant / F.lit(1_000_000)).cast("decimal(18,6)"))
    return F.when(t.rlike(r"[T ][0-9:.]+\s*(Z|UTC|GMT|[+-][0-9]{1,2}(:?[0-9]{2})?)$"), utc).otherwise(t.try_cast("timestamp_ntz"))
