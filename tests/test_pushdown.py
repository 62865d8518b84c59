"""Literal time bounds and projections reach the parquet scan."""

import datetime as dt

from pyspark.sql import functions as F

from sonolith.operators.explore import slice_between
from sonolith.plans.catalog import series


def test_literal_bounds_are_pushed_to_parquet(spark):
    m = series(spark, "/root/testdata/sf0.001")  # a written parquet table
    q = slice_between(m, dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 12)).select("asset_id", "timestamp", "avg_decibel")
    plan = q._jdf.queryExecution().executedPlan().toString()
    scan = [line for line in plan.splitlines() if "FileScan parquet" in line][0]
    assert "GreaterThanOrEqual(timestamp" in scan and "LessThanOrEqual(timestamp" in scan
    assert "ReadSchema: struct<asset_id:string,timestamp:timestamp_ntz,avg_decibel:double>" in scan
    assert q.where(F.col("timestamp") < dt.datetime(2024, 1, 10)).count() == 0
