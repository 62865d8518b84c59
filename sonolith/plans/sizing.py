"""Size-checked broadcast: broadcast a table only where its bytes are bounded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Greatest estimated size of a broadcast table.
MAX_BYTES = 64 << 20


def row_bound(df: DataFrame, max_rows: int, max_bytes: int = MAX_BYTES) -> int:
    """Rows of ``df`` that may be broadcast: at most ``max_rows``, of together ``max_bytes`` by the width of the schema."""
    return max(1, min(max_rows, max_bytes // max(8, df._jdf.schema().defaultSize())))


def broadcast_if_small(df: DataFrame, max_rows: int, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``broadcast(df)`` when it has at most ``max_rows`` rows of together ``max_bytes``, else ``df``.

    The bound in bytes is put in rows by the width of the schema.  The count is one small
    job over an aggregate-sized table (callers pass tables keyed by asset x hour, asset x
    bucket, events ...).  Beyond the bound the join stays a shuffle join and AQE's skew
    handling applies.
    """
    bound = row_bound(df, max_rows, max_bytes)
    n = df.limit(bound + 1).count()
    return F.broadcast(df) if n <= bound else df
