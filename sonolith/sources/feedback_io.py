"""Label and inspection-note files.

Reader: JSON arrays (UTF-8, optional byte-order mark) or JSON lines; a file that is not
a list yields no rows, elements that are not objects are left out, a missing path yields
an empty table.  An array is cut at its closing braces while it is read, so one file
spreads over many rows and tasks; no task holds more than an element.  The writer
emits JSON lines into a new version directory, never into the path being read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from sonolith.session import cut_lineage
from sonolith.sources.csv_ingest import location, with_file_row_ids

#: The field names of the two kinds of records.
LABEL_FIELDS = (
    "label_id", "source_stage", "event_start", "event_end", "defect_type", "repaired_at", "repaired_what",
    "pre_failure_hours", "target_metric", "notes", "created_at",
)
NOTE_FIELDS = ("event_signature", "stage", "start_timestamp", "end_timestamp", "verdict", "notes", "updated_at")


def text_schema(fields) -> StructType:
    """All fields as text; typing happens in the normalisation operators."""
    return StructType([StructField(f, StringType(), True) for f in fields])


def _path_kind(spark: SparkSession, path: str) -> str | None:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    if not fs.exists(p):
        return None
    return "dir" if fs.getFileStatus(p).isDirectory() else "file"


def _sum_before(df: DataFrame, value: Column, out: str, stretch: int = 4096) -> DataFrame:
    """Sum of ``value`` over the earlier rows of the file: stretches of rows first, then inside each."""
    d = df.withColumns({"_v": value, "_stretch": F.floor(F.col("row_id") / stretch)})
    earlier = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = d.groupBy("file", "_stretch").agg(F.sum("_v").alias("_total"))
    sums = sums.select("file", "_stretch", earlier(Window.partitionBy("file").orderBy("_stretch"), "_total").alias("_base"))
    inside = earlier(Window.partitionBy("file", "_stretch").orderBy("row_id"), "_v")
    return cut_lineage(d.join(sums, ["file", "_stretch"]).withColumn(out, F.col("_base") + inside).drop("_v", "_stretch", "_base"))


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def read_array_documents(spark: SparkSession, path: str, fields) -> DataFrame:
    """The objects of JSON-array files (a file, or all files below a directory) as rows of text fields.

    Pieces end at closing braces.  Prefix sums tell of each piece whether it starts inside a
    string (quotes so far) and how deep it ends (brackets outside strings so far); a brace that
    ends at depth one ends an element.  A file that is no list, or not valid to its end, gives no
    rows; elements that are no objects give none; numbers come through as their text; an empty
    table comes from an empty file.
    """
    raw = spark.read.option("lineSep", "}").option("recursiveFileLookup", True).text(path)
    d = with_file_row_ids(raw.withColumns(location()).withColumn("file", F.col("_file")))
    ends = d.groupBy("file").agg(F.max("row_id").alias("_end"))
    plain = F.regexp_replace("value", r"(?s)\\.", "")  # no escaped characters: every quote counts
    d = d.join(ends, "file").select("file", "row_id", "value", (F.col("row_id") < F.col("_end")).alias("closed"), plain.alias("plain"))
    d = _sum_before(d, _count(F.col("plain"), '"'), "quotes")
    inside = F.col("quotes") % 2 == 1
    outer = F.regexp_replace(F.when(inside, F.concat(F.lit('"'), "plain")).otherwise(F.col("plain")), r'"[^"]*("|\z)', "")
    after = F.col("closed") & ((F.col("quotes") + _count(F.col("plain"), '"')) % 2 == 0)
    change = _count(outer, "{") + _count(outer, "[") - _count(outer, "]") - after.cast("int")
    d = d.withColumns({"change": change, "brace": after, "odd": _count(F.col("plain"), '"') % 2}).drop("plain")
    d = _sum_before(d, F.col("change"), "depth")
    d = _sum_before(d, (F.col("brace") & (F.col("depth") + F.col("change") == 1)).cast("int"), "element")
    part = F.struct("row_id", F.when(F.col("closed"), F.concat("value", F.lit("}"))).otherwise(F.col("value")).alias("text"))
    g = d.groupBy("file", "element").agg(
        F.sum("change").alias("change"), F.sum("odd").alias("odd"), F.bool_and("closed").alias("closed"),
        F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda x: x["text"]), "").alias("text"),
    )
    strip = lambda pattern: F.when(F.col("text").rlike(pattern), F.regexp_replace("text", pattern, ""))
    inner = F.when(F.col("element") == 0, strip(r"^\x{FEFF}?\s*\[")).otherwise(strip(r"^\s*(,|(?=\]))"))
    items = F.from_json(F.concat(F.lit("["), inner, F.when(F.col("closed"), F.lit("]")).otherwise(F.lit(""))), "array<string>")
    g = cut_lineage(g.select("file", "change", "odd", items.alias("items")))
    valid = g.groupBy("file").agg(
        ((F.sum("change") == 0) & (F.sum("odd") % 2 == 0) & F.bool_and(F.col("items").isNotNull())).alias("valid")
    ).where("valid")
    raw_items = g.join(valid, "file", "left_semi").select(F.explode("items").alias("item")).where(F.trim("item").startswith("{"))
    return raw_items.select(F.from_json("item", text_schema(fields)).alias("r")).where(F.col("r").isNotNull()).select("r.*")


def read_records(spark: SparkSession, path: str, fields) -> DataFrame:
    """A file is one JSON array document (anything else: no rows); a directory is
    a JSON-lines data set as written by :func:`write_records`."""
    schema = text_schema(fields)
    kind = _path_kind(spark, path)
    if kind is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path) if kind == "dir" else read_array_documents(spark, path, fields)


def write_records(df: DataFrame, path: str) -> None:
    """Full rewrite as JSON lines into ``path`` (a fresh version directory)."""
    df.write.mode("overwrite").json(path)
