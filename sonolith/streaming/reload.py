"""Re-run the pipeline when new measurement files arrive.

The documented tool reloads its file and recomputes every stage.  Here a
file-source stream picks up new CSV files; each micro-batch (``foreachBatch``)

1. parses the new rows (same expressions as the batch ingest) and appends them to
   a parquet store partitioned by asset, with ``row_id = batch_id * 2^32 + file
   position`` so file order stays monotone across batches;
2. recomputes the prepared series and the events of Stages 1-3 for the assets
   touched by the batch only (``left_semi`` on the touched assets); across arrivals, row
   adjacency follows time order (``row_id`` := position per asset);
3. overwrites those assets' partitions of the event table (dynamic partition
   overwrite), so a replayed batch produces the same result.

The stream's progress lives under the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from sonolith.operators.quality import BAND_COLUMNS, prepare_series
from sonolith.options import Options
from sonolith.plans.pipeline import run_stage1, run_stage2, run_stage3
from sonolith.session import ensure_checkpoint_dir, write_table
from sonolith.sources.csv_ingest import NUMBER_COLUMNS, location, parse_measurements, with_file_row_ids


def text_schema(opts: Options, asset_col: str) -> StructType:
    names = [asset_col, *NUMBER_COLUMNS, opts.csv.source_column, *BAND_COLUMNS]
    return StructType([StructField(n, StringType(), True) for n in names])


def _drop_partitions(spark: SparkSession, events_dir: str, assets: DataFrame) -> None:
    """Remove what an earlier batch found for assets that have no event any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for row in assets.toLocalIterator():
        name = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(row["asset_id"])
        path = jvm.org.apache.hadoop.fs.Path(f"{events_dir}/asset_id={name}")
        path.getFileSystem(conf).delete(path, True)


def _process(opts: Options, asset_col: str, store_dir: str, events_dir: str, stages: int):
    def fn(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch.limit(1).count() == 0:
            return
        parsed = parse_measurements(with_file_row_ids(batch), opts, asset_col=asset_col)
        parsed = parsed.withColumn("row_id", F.lit(batch_id).cast("long") * F.lit(2**32) + F.col("row_id"))
        keep = ["asset_id", "row_id", "timestamp", *NUMBER_COLUMNS, *BAND_COLUMNS,
                *[f"{b}_format_valid" for b in BAND_COLUMNS], "freq_format_error"]
        parsed = write_table(parsed.select(*keep), "stream-batch")
        # a batch that runs again replaces its own rows
        parsed.write.mode("overwrite").partitionBy("asset_id").parquet(f"{store_dir}/batch_id={batch_id}")
        touched = parsed.select("asset_id").distinct()
        history = spark.read.parquet(store_dir).drop("batch_id").join(touched, "asset_id", "left_semi")
        # adjacency across arrivals follows time order: row_id becomes the position
        # per asset (file positions of different files are not comparable)
        series = write_table(prepare_series(history, opts).withColumn("row_id", F.col("seq_pos")), "stream-series")
        s1 = run_stage1(series, opts)
        events = s1.events
        if stages >= 2:
            s2 = run_stage2(s1.rows, opts)
            events = events.unionByName(s2.events, allowMissingColumns=True)
            if stages >= 3:
                events = events.unionByName(run_stage3(s2.rows, opts).events, allowMissingColumns=True)
        events = write_table(events, "stream-events")
        _drop_partitions(spark, events_dir, touched.join(events.select("asset_id").distinct(), "asset_id", "left_anti"))
        (
            events.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("asset_id")
            .parquet(events_dir)
        )

    return fn


def start_reload_stream(
    spark: SparkSession,
    source_dir: str,
    store_dir: str,
    events_dir: str,
    opts: Options,
    asset_col: str = "asset_id",
    name: str = "reload",
    available_now: bool = True,
    stages: int = 3,
) -> StreamingQuery:
    """Start the reload stream; ``stages`` (1-3) selects how many stages are recomputed."""
    ckpt = ensure_checkpoint_dir(spark).rstrip("/") + f"/stream-{name}"
    stream = (
        spark.readStream.schema(text_schema(opts, asset_col))
        .option("header", True)
        .option("sep", opts.csv.separator)
        .option("maxFilesPerTrigger", 1)
        .csv(source_dir)
        .withColumns(location())
    )
    writer = stream.writeStream.foreachBatch(_process(opts, asset_col, store_dir, events_dir, stages)).option("checkpointLocation", ckpt)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
