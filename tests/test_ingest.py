"""CSV ingest paths: renames, required columns, numeric discovery, day-first fallback, row ids."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from sonolith.operators.explore import active_weekday
from sonolith.operators.quality import prepare_series
from sonolith.options import CsvOptions, Options
from sonolith.sources.csv_ingest import load_measurement_csv, load_quality_report, numeric_columns

HEADER = "Nr;Mittel;Spitze;Minimum;Dauer;Proben;Zeit;low_freq_avg;mid_freq_avg;high_freq_avg"
MAPPING = (("id", "Nr"), ("avg_decibel", "Mittel"), ("peak_decibel", "Spitze"), ("min_decibel", "Minimum"),
           ("measurement_duration", "Dauer"), ("samples_count", "Proben"), ("created_at", "Zeit"))


def _write(lines, encoding="utf-8"):
    d = tempfile.mkdtemp(prefix="sonolith-csv-")
    p = os.path.join(d, "m.csv")
    with open(p, "w", encoding=encoding) as f:
        f.write("\n".join(lines) + "\n")
    return p


def test_rename_parse_and_row_ids(spark):
    rows = [HEADER]
    for i in range(30):
        rows.append(f"{i};45,{i % 10};1.050,5;40;60;{100 + i};{1 + i // 60}.1.2024 0:{i % 60};12.345.678.901.234;12.000.000.000.000;1.1")
    opts = Options(csv=CsvOptions(separator=";", encoding="cp1252", columns=MAPPING))
    df = load_measurement_csv(spark, _write(rows, "cp1252"), opts)
    got = df.orderBy("row_id").select("row_id", "avg_decibel", "peak_decibel", "timestamp", "freq_format_error").collect()
    assert [r.row_id for r in got] == list(range(30))
    assert got[3].avg_decibel == 45.3 and got[3].peak_decibel == 1050.5
    assert got[3].timestamp == dt.datetime(2024, 1, 1, 0, 3)
    assert all(r.freq_format_error for r in got)  # the high band is malformed
    assert "avg_decibel" in numeric_columns(df) and "freq_format_error" in numeric_columns(df)
    rep = load_quality_report(df).first()
    assert (rep.rows, rep.invalid_timestamps, rep.invalid_frequency_rows) == (30, 0, 30)
    q = prepare_series(df, opts)
    assert q.where(F.col("quality_flag") == "reduced_quality").count() == 0


def test_required_columns_error(spark):
    p = _write(["id;avg_decibel", "1;2"])
    with pytest.raises(ValueError, match="required columns"):
        load_measurement_csv(spark, p, Options(csv=CsvOptions(separator=";")))


def test_day_first_fallback(spark):
    hdr = "id;avg_decibel;peak_decibel;min_decibel;measurement_duration;samples_count;created_at"
    p = _write([hdr, "1;1;2;0;60;100;2024-01-02 03:04:05", "2;1;2;0;60;100;31/12/2023 23:59"])
    df = load_measurement_csv(spark, p, Options(csv=CsvOptions(separator=";")))
    got = sorted(r.timestamp for r in df.collect())
    assert got == [dt.datetime(2023, 12, 31, 23, 59), dt.datetime(2024, 1, 2, 3, 4, 5)]


def test_unparsable_time_column_raises(spark):
    hdr = "id;avg_decibel;peak_decibel;min_decibel;measurement_duration;samples_count;created_at"
    p = _write([hdr, "1;1;2;0;60;100;gestern"])
    with pytest.raises(ValueError, match="time column"):
        load_measurement_csv(spark, p, Options(csv=CsvOptions(separator=";")))


def test_active_weekday_modes(spark):
    base = dt.datetime(2024, 1, 1)  # a Monday
    rows = [("a", i, base + dt.timedelta(hours=12 * i), 200.0) for i in range(6)]  # last row: Wednesday
    df = spark.createDataFrame(rows, "asset_id string, row_id long, timestamp timestamp_ntz, samples_count double")
    q = prepare_series(df.withColumns({"avg_decibel": F.lit(1.0), "peak_decibel": F.lit(2.0), "min_decibel": F.lit(0.0)}), Options(gap_threshold_minutes=1e6))
    assert active_weekday(q).first().active_weekday == 2
    assert active_weekday(q, selected="Fr").first().active_weekday == 4
    assert active_weekday(q, end_timestamp=dt.datetime(2024, 1, 7)).first().active_weekday == 6
    assert active_weekday(q).first().active_weekday_rows == 2


def test_row_ids_when_one_file_spans_partitions(spark):
    hdr = "id;avg_decibel;peak_decibel;min_decibel;measurement_duration;samples_count;created_at"
    rows = [hdr] + [f"{i};{i},5;2;0;60;100;1.1.2024 {i // 60 % 24}:{i % 60}" for i in range(3000)]
    p = _write(rows)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = load_measurement_csv(spark, p, Options(csv=CsvOptions(separator=";")))
        assert df.rdd.getNumPartitions() > 1
        got = [(r.row_id, r.id) for r in df.select("row_id", "id").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(got) == [(i, float(i)) for i in range(3000)]


def test_row_ids_follow_files_of_unequal_size(spark, tmp_path):
    from sonolith.sources.csv_ingest import with_file_row_ids

    n = 0
    for name, rows in (("a", 10), ("b", 100), ("c", 1)):
        (tmp_path / f"{name}.csv").write_text("v\n" + "".join(f"{n + i}\n" for i in range(rows)))
        n += rows
    got = with_file_row_ids(spark.read.option("header", True).csv(str(tmp_path))).collect()
    assert sorted((r.row_id, int(r.v)) for r in got) == [(i, i) for i in range(n)]
