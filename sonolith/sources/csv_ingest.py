"""Raw measurement CSV ingest.

Every column is read as text with an explicit schema-free header read; numbers
and timestamps are repaired with JVM expressions.  ``row_id`` is the position
in file order, built from the row counts of file stretches (one small table)
instead of a single-partition numbering.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonolith.functions.parsing import frequency_band, locale_number, parse_timestamp, parse_timestamp_day_first
from sonolith.operators.quality import BAND_COLUMNS
from sonolith.options import Options, ScaleOptions
from sonolith.plans.sizing import broadcast_if_small
from sonolith.session import cut_lineage

REQUIRED_COLUMNS = ("id", "avg_decibel", "peak_decibel", "min_decibel", "measurement_duration", "samples_count", "created_at")
NUMBER_COLUMNS = ("id", "avg_decibel", "peak_decibel", "min_decibel", "measurement_duration", "samples_count")
STANDARD_CHARSETS = {"utf-8", "utf8", "us-ascii", "iso-8859-1", "utf-16", "utf-16le", "utf-16be", "utf-32"}


def read_raw_csv(spark: SparkSession, path: str, opts: Options) -> DataFrame:
    """Header CSV, all columns as strings, configured separator and encoding."""
    enc = opts.csv.encoding
    if enc.lower() not in STANDARD_CHARSETS:
        # e.g. cp1252 needs the JVM's full charset list
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    return (
        spark.read.option("header", True)
        .option("inferSchema", False)
        .option("sep", opts.csv.separator)
        .option("encoding", enc)
        .option("mode", "PERMISSIVE")
        .csv(path)
    )


def rename_columns(df: DataFrame, opts: Options) -> DataFrame:
    """External -> internal names, only for columns present."""
    mapping = {ext: internal for internal, ext in opts.csv.columns if ext in df.columns}
    return df.withColumnsRenamed(mapping) if mapping else df


def check_required(df: DataFrame) -> None:
    missing = [c for c in REQUIRED_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"required columns missing from the CSV: {missing}")


#: Where a row stands; streams take these along, as their batches know no files.
def location() -> dict:
    return {"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start")}


def with_file_row_ids(df: DataFrame, out: str = "row_id") -> DataFrame:
    """Contiguous 0-based position in file order (W0): files by path, rows as they stand.

    A scan reads each stretch of a file in one task, in order, so a row's place in its
    stretch is its ``monotonically_increasing_id`` less the stretch's first; the stretches'
    row counts give the offsets.  File scans split deterministically, so both uses agree and
    retries reproduce the same ids.  The table of offsets has one row per stretch.
    """
    d = df if "_file" in df.columns else df.withColumns(location())
    d = d.withColumn("_mid", F.monotonically_increasing_id())
    blocks = cut_lineage(d.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first")))
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = blocks.groupBy("_file").agg(F.sum("_n").alias("_n")).select("_file", before(Window.orderBy("_file")).alias("_f0"))
    offs = blocks.withColumn("_b0", before(Window.partitionBy("_file").orderBy("_block"))).join(files, "_file")
    offs = cut_lineage(offs.select("_file", "_block", (F.col("_f0") + F.col("_b0") - F.col("_first")).alias("_off")))
    j = d.join(broadcast_if_small(offs, ScaleOptions.broadcast_max_rows), ["_file", "_block"])
    return j.withColumn(out, F.col("_off") + F.col("_mid")).drop("_mid", "_file", "_block", "_off")


def parse_measurements(df: DataFrame, opts: Options, asset_col: str | None = None, asset_id: str = "asset") -> DataFrame:
    """Typed measurement table from text columns (P1-P5); keeps ``*_raw`` band text."""
    src = opts.csv.source_column
    ts = parse_timestamp(F.col(src), opts.csv.timestamp_format)
    if df.where(ts.isNotNull()).limit(1).count() == 0:
        ts = parse_timestamp_day_first(F.col(src))
        if df.where(ts.isNotNull()).limit(1).count() == 0 and df.limit(1).count() > 0:
            sample = [r[0] for r in df.select(src).limit(5).collect()]
            raise ValueError(f"the time column could not be parsed; check the format. Samples: {sample}")
    cols = {"timestamp": ts}
    for c in NUMBER_COLUMNS:
        if c in df.columns:
            cols[c] = locale_number(F.col(c))
    valid_flags = []
    for b in BAND_COLUMNS:
        if b in df.columns:
            v, ok = frequency_band(F.col(b))
            cols[f"{b}_raw"] = F.col(b)
            cols[b] = v
            cols[f"{b}_format_valid"] = ok
            valid_flags.append(ok)
    err = F.lit(False)
    if valid_flags:
        allv = valid_flags[0]
        for v in valid_flags[1:]:
            allv = allv & v
        err = ~allv
    cols["freq_format_error"] = err
    cols["asset_id"] = F.col(asset_col).cast("string") if asset_col else F.lit(asset_id)
    return df.withColumns(cols)


def load_measurement_csv(
    spark: SparkSession, path: str, opts: Options, asset_col: str | None = None, asset_id: str = "asset"
) -> DataFrame:
    """S1-S3 + W0 + P1-P5.  Canonical order (timestamp NULLS LAST, row_id) is
    applied inside the ordered operators, never as a global sort (W1)."""
    raw = read_raw_csv(spark, path, opts)
    check_required(rename_columns(raw, opts))
    return parse_measurements(rename_columns(with_file_row_ids(raw), opts), opts, asset_col, asset_id)


def numeric_columns(df: DataFrame, drop: Sequence[str] = ()) -> list[str]:
    """Numeric (and boolean) columns of a table, from the schema."""
    from pyspark.sql.types import BooleanType, NumericType

    return [f.name for f in df.schema.fields if isinstance(f.dataType, (NumericType, BooleanType)) and f.name not in drop]


def load_quality_report(df: DataFrame, keys: Sequence[str] = ("asset_id",)) -> DataFrame:
    """Rows, invalid timestamps and invalid frequency rows in one aggregate."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("timestamp").isNull()).alias("invalid_timestamps"),
        F.count_if(F.col("freq_format_error")).alias("invalid_frequency_rows"),
    )
