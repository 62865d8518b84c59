"""The reload stream produces the same Stage-1 events as the batch pipeline."""

import os
import tempfile
import uuid

from pyspark.sql import functions as F

from sonolith.options import hourly_series_options


def test_reload_stream_matches_batch(spark):
    from sonolith.plans.pipeline import run_stage1
    from sonolith.sources.measurements import measurement_table
    from sonolith.streaming.reload import start_reload_stream

    opts = hourly_series_options()
    m = measurement_table(spark, "/root/testdata/sf0.001", opts)
    root = tempfile.mkdtemp(prefix="sonolith-stream-")
    src = os.path.join(root, "in")
    text = m.select(
        "asset_id", *[F.col(c).cast("string").alias(c) for c in ("id", "avg_decibel", "peak_decibel", "min_decibel", "measurement_duration", "samples_count")],
        F.date_format("timestamp", "dd.MM.yyyy HH:mm").alias("created_at"),
        F.lit("12.345.678.901.234").alias("low_freq_avg"),
        F.lit("23.456.000.000.000").alias("mid_freq_avg"),
        F.when(F.col("row_id") % 9 == 4, F.lit("ungültig")).otherwise(F.lit("34.567.000.000.000")).alias("high_freq_avg"),
        "timestamp",
    )
    # two arrivals: first and second half of January, one file each
    for i, cond in enumerate([F.col("timestamp") < "2024-01-15", F.col("timestamp") >= "2024-01-15"]):
        text.where(cond).orderBy("asset_id", "timestamp").drop("timestamp").coalesce(1).write.option("header", True).csv(os.path.join(root, f"part{i}"))
    os.makedirs(src)
    opts_csv = opts.with_(csv=opts.csv.__class__(separator=",", timestamp_format="d.M.yyyy H:m"))
    for i in range(2):
        d = os.path.join(root, f"part{i}")
        f = [x for x in os.listdir(d) if x.endswith(".csv")][0]
        os.rename(os.path.join(d, f), os.path.join(src, f"batch{i}.csv"))
    q = start_reload_stream(spark, src, os.path.join(root, "store"), os.path.join(root, "events"), opts_csv, name=uuid.uuid4().hex)
    q.awaitTermination(600)
    got = spark.read.parquet(os.path.join(root, "events"))
    want = run_stage1(m.drop("low_share", "mid_share", "high_share"), opts, cut=False).events
    cols = ["asset_id", "start_timestamp", "end_timestamp", "row_count", "severity"]
    assert sorted(got.where(F.col("stage") == "Stage 1").select(cols).collect()) == sorted(want.select(cols).collect())
    assert {r.stage for r in got.select("stage").distinct().collect()} <= {"Stage 1", "Stage 2", "Stage 3"}
    assert got.where(F.col("stage") == "Stage 2").count() > 0


def test_a_batch_that_runs_again_changes_nothing(spark):
    from sonolith.sources.csv_ingest import location
    from sonolith.streaming.reload import _process, text_schema

    opts = hourly_series_options()
    root = tempfile.mkdtemp(prefix="sonolith-replay-")
    rows = [("a", str(i), str(50 + (40 if 10 <= i < 20 else 0)), "60", "40", "1", "200", f"01.01.2024 {i:02d}:00") for i in range(24)]
    names = ["asset_id", "id", "avg_decibel", "peak_decibel", "min_decibel", "measurement_duration", "samples_count", "created_at"]
    spark.createDataFrame(rows, names).coalesce(1).write.option("header", True).csv(f"{root}/in")
    schema = text_schema(opts, "asset_id")
    batch = spark.read.schema(schema.fromJson({"type": "struct", "fields": [f.jsonValue() for f in schema.fields[: len(names)]]})).option("header", True).csv(f"{root}/in").withColumns(location())
    for c in schema.fieldNames()[len(names):]:
        batch = batch.withColumn(c, F.lit(None).cast("string"))
    run = _process(opts, "asset_id", f"{root}/store", f"{root}/events", 1)
    os.makedirs(f"{root}/events/asset_id=a")  # left by an earlier batch
    run(batch, 0)
    once = spark.read.parquet(f"{root}/store").count()
    run(batch, 0)
    assert spark.read.parquet(f"{root}/store").count() == once == 24
