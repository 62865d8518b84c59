"""sonolith: condition-monitoring analytics as Spark DataFrame operators.

Every operator takes DataFrames and returns DataFrames; nothing row-scale is
collected to the driver.  Series are keyed by ``asset_id`` and ordered by
``(timestamp NULLS LAST, row_id)``.
"""

from sonolith.options import Options

__all__ = ["Options"]
