"""Literal fixtures (FIXTURES.md section 2): hand-computed expectations."""

import datetime as dt

from pyspark.sql import functions as F

from sonolith.functions.formatting import display_timestamp, event_signature
from sonolith.functions.parsing import frequency_band, locale_number, parse_timestamp
from sonolith.operators.baseline import robust_z
from sonolith.operators.events import alert_rows_with_event_ids, build_events
from sonolith.operators.explore import downsample
from sonolith.operators.feedback import normalize_labels, strict_form_timestamp
from sonolith.operators.persistence import persistent_flag
from sonolith.operators.quality import add_quality_columns
from sonolith.options import Options, Stage1Options


def test_locale_numbers(spark):
    cases = {
        "45,3": 45.3, "1.234,5": 1234.5, "1,234.5": 1234.5, " 1 234,5 ": 1234.5, "1.234.567": 1.234567,
        "1,234,567": None, "1,234": 1.234, "": None, "abc": None, "1d": None, "nan": None, "inf": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: r.v for r in df.select("t", locale_number(F.col("t")).alias("v")).collect()}
    assert got == cases


def test_frequency_bands(spark):
    cases = {"12.345.678.901.234": (12.345678901234, True), "12.345": (None, False), "": (None, False), "1.345.678.901.234": (None, False)}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    v, ok = frequency_band(F.col("t"))
    got = {r.t: (r.v, r.ok) for r in df.select("t", v.alias("v"), ok.alias("ok")).collect()}
    assert got == cases


def test_timestamps_padded_and_unpadded(spark):
    df = spark.createDataFrame([("01.02.2024 03:04",), ("1.2.2024 3:4",), ("bad",)], "t string")
    got = [r.p for r in df.select(parse_timestamp(F.col("t"), "d.M.yyyy H:m").alias("p")).collect()]
    assert got == [dt.datetime(2024, 2, 1, 3, 4), dt.datetime(2024, 2, 1, 3, 4), None]
    got = [r.p for r in df.select(strict_form_timestamp(F.col("t")).alias("p")).collect()]
    assert got[2] is None


def _series(spark, minutes, warn=None):
    base = dt.datetime(2024, 1, 1)
    rows = [("a", i, base + dt.timedelta(minutes=m), 200.0, bool(warn[i]) if warn else False) for i, m in enumerate(minutes)]
    return spark.createDataFrame(rows, "asset_id string, row_id long, timestamp timestamp_ntz, samples_count double, w boolean")


def test_gaps_segments_near_gap(spark):
    df = add_quality_columns(_series(spark, [0, 1, 2, 10, 11]), Options())
    got = [(r.delta_minutes, r.gap_flag, r.segment_id, r.near_gap_flag) for r in df.orderBy("row_id").collect()]
    assert got == [(None, False, 0, False), (1.0, False, 0, False), (1.0, False, 0, True), (8.0, True, 1, True), (1.0, False, 1, False)]


def test_gaps_across_tiny_buckets(spark):
    from sonolith.options import ScaleOptions

    opts = Options(scale=ScaleOptions(scan_bucket_rows=None, scan_bucket_hours=1))
    minutes = [0, 1, 2, 59, 60, 61, 200, 201, 320]
    df = add_quality_columns(_series(spark, minutes), opts)
    ref = add_quality_columns(_series(spark, minutes), Options())
    cols = ["row_id", "delta_minutes", "gap_flag", "segment_id", "near_gap_flag", "seq_pos"]
    assert df.select(cols).orderBy("row_id").collect() == ref.select(cols).orderBy("row_id").collect()


def test_persistence_n3(spark):
    warn = [1, 1, 1, 1, 0, 1]
    df = add_quality_columns(_series(spark, list(range(6)), warn), Options())
    out = persistent_flag(df, "w", 3, "p")
    got = [r.p for r in out.orderBy("row_id").collect()]
    assert got == [False, False, True, True, False, False]


def test_persistence_restarts_at_segment(spark):
    warn = [1, 1, 1, 1, 1]
    df = add_quality_columns(_series(spark, [0, 1, 10, 11, 12], warn), Options())
    got = [r.p for r in persistent_flag(df, "w", 3, "p").orderBy("row_id").collect()]
    assert got == [False, False, False, False, True]


def test_event_split(spark):
    minutes = list(range(12))
    minutes[10] = 30  # row 10 starts a new segment
    rows = add_quality_columns(_series(spark, minutes), Options())
    sev = F.when(F.col("row_id").isin(3, 4, 5, 8, 9, 10), F.lit("WARNING")).otherwise(F.lit("NORMAL"))
    rows = rows.withColumns({"stage1_severity": sev, "stage1_message": F.lit("m"), "quality_flag": F.lit("normal")})
    a = alert_rows_with_event_ids(rows, "stage1")
    assert [r.event_id for r in a.orderBy("row_id").collect()] == [1, 1, 1, 2, 2, 3]
    ev = build_events(a, "stage1", 1.0).orderBy("event_id").collect()
    assert [e.duration_minutes for e in ev] == [3.0, 2.0, 1.0]


def test_robust_z(spark):
    df = spark.createDataFrame([(10.0, 2.5, 1.0), (2.5, 2.5, 0.0), (3.0, None, None)], "x double, m double, mad double")
    got = [r.z for r in df.select(robust_z(F.col("x"), F.col("m"), F.col("mad")).alias("z")).collect()]
    assert abs(got[0] - 7.5 / 1.4826) < 1e-12 and got[1] == 0.0 and got[2] is None


def test_signature_and_display(spark):
    df = spark.createDataFrame([("Stage 1", dt.datetime(2024, 1, 2, 3, 4, 5), None)], "s string, a timestamp_ntz, b timestamp_ntz")
    r = df.select(event_signature(F.col("s"), F.col("a"), F.col("b")).alias("sig"), display_timestamp(F.col("a")).alias("d"), display_timestamp(F.col("b")).alias("e")).first()
    assert r.sig == "Stage 1|20240102T030405|NA" and r.d == "02.01.2024 03:04" and r.e == ""


def test_label_window(spark):
    df = spark.createDataFrame(
        [("L1", "2024-01-01T00:00:00", "2024-01-02T00:00:00", "2024-01-02T12:00:00", "24", "2024-01-03T00:00:00+00:00"),
         ("L2", "2024-01-01T00:00:00", "2024-01-02T00:00:00", None, None, None)],
        "label_id string, event_start string, event_end string, repaired_at string, pre_failure_hours string, created_at string",
    )
    got = {r.label_id: (r.learning_window_start, r.learning_window_end, r.pre_failure_hours) for r in normalize_labels(df).collect()}
    assert got["L1"] == (dt.datetime(2024, 1, 1, 12), dt.datetime(2024, 1, 2, 12), 24)
    assert got["L2"] == (dt.datetime(2024, 1, 1, 0), dt.datetime(2024, 1, 2, 0), 24)


def test_downsample(spark):
    for n, expect in [(5, 5), (9, 9), (10, 5)]:
        df = add_quality_columns(_series(spark, list(range(n))), Options()).withColumn("v", F.lit(1.0))
        assert downsample(df, ["v"], 5).count() == expect


def test_row_ampel_truth_table(spark):
    from sonolith.operators.ampel import apply_row_ampel

    rows = [
        (False, False, False, 0, 0.90, "normal", False, 0, 0),
        (True, False, False, 1, 0.64, "normal", False, 1, 1),
        (True, False, False, 1, 0.65, "normal", False, 2, 2),
        (True, True, False, 2, 0.10, "reduced_quality", False, 2, 1),
        (True, True, True, 3, 0.90, "reduced_quality", True, 3, 1),
    ]
    df = spark.createDataFrame(
        rows,
        "stage3_warning_now boolean, stage3_strong_now boolean, stage3_persistent_warning boolean, stage3_votes int, "
        "stage3_consensus_score double, quality_flag string, near_gap_flag boolean, raw int, final int",
    )
    for r in apply_row_ampel(df).collect():
        assert (r.stage3_ampel_rank_raw, r.stage3_ampel_rank) == (r.raw, r.final)


def test_event_ampel(spark):
    from sonolith.operators.ampel import finish_stage3_events

    rows = [
        # two strong rows of row rank 1, all reduced quality -> raised to 2, minus 1 -> 1
        (1, 2, 2, 2, True, False, False, 120.0, 1),
        # five strong rows, clean -> 3
        (2, 5, 2, 5, False, False, True, 300.0, 3),
        # one 1-vote row of rank 1, clean -> 1
        (1, 0, 1, 1, False, False, False, 60.0, 1),
    ]
    df = spark.createDataFrame(
        rows,
        "_max_row_rank int, _strong_rows long, consensus_count int, row_count long, has_reduced_quality boolean, "
        "has_near_gap boolean, persistent_flag boolean, duration_minutes double, expect int",
    )
    for r in finish_stage3_events(df, 5).collect():
        assert r.ampel_rank == r.expect


def test_event_adjacency_file_vs_time(spark):
    """An unsorted file: time neighbours 1,2,3 sit at file positions 0, 5, 2."""
    base = dt.datetime(2024, 1, 1)
    order = [0, 3, 2, 4, 5, 1]  # file position -> minute
    rows = [("a", pos, base + dt.timedelta(minutes=m), 200.0, False) for pos, m in enumerate(order)]
    df = spark.createDataFrame(rows, "asset_id string, row_id long, timestamp timestamp_ntz, samples_count double, w boolean")
    q = add_quality_columns(df, Options())
    alert = F.col("timestamp").isin(base + dt.timedelta(minutes=1), base + dt.timedelta(minutes=2), base + dt.timedelta(minutes=3))
    q = q.withColumns({"stage1_severity": F.when(alert, F.lit("WARNING")).otherwise(F.lit("NORMAL")), "stage1_message": F.lit("m")})
    by_file = alert_rows_with_event_ids(q, "stage1").select("event_id").distinct().count()
    by_time = alert_rows_with_event_ids(q, "stage1", adjacency="time").select("event_id").distinct().count()
    assert (by_file, by_time) == (3, 1)


def test_wall_times_do_not_depend_on_the_session_zone(spark):
    from sonolith.functions.parsing import parse_iso_timestamp, parse_timestamp_day_first

    zone = spark.conf.get("spark.sql.session.timeZone")
    texts = ["31.03.2024 02:30", "31.02.2024 02:30", "1.1.24 1:1", "31/03/2024 02:30:05", "2024-03-31T02:30:00", "2024-03-31 02:30:00+02:00", "2024-03-31", "x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    try:
        for z in ("UTC", "Europe/Berlin", "America/Sao_Paulo"):
            spark.conf.set("spark.sql.session.timeZone", z)
            t = F.col("t")
            got = [tuple(r) for r in df.select(parse_timestamp(t, "d.M.yyyy H:m"), parse_timestamp_day_first(t), parse_iso_timestamp(t)).collect()]
            at, wall = dt.datetime(2024, 3, 31, 2, 30), "timestamp_ntz'2024-03-31 02:30:00'"
            assert [r[0] for r in got] == [at] + [None] * 7
            assert [r[1] for r in got] == [at, None, None, at.replace(second=5), at, None, at.replace(hour=0, minute=0), None]
            assert [r[2] for r in got][4:] == [at, at.replace(hour=0), at.replace(hour=0, minute=0), None]
            r = df.limit(1).select(event_signature(F.lit("S"), F.expr(wall), F.lit(None).cast("timestamp_ntz")).alias("s"), display_timestamp(F.expr(wall)).alias("d")).first()
            assert (r.s, r.d) == ("S|20240331T023000|NA", "31.03.2024 02:30")
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_notes_of_two_assets_at_the_same_time(spark):
    from sonolith.operators.feedback import NOTE_KEY, delete_by_key, note_lookup, upsert

    at = dt.datetime(2024, 1, 1)
    ev = spark.createDataFrame([(a, "Stage 1", at, at) for a in "ab"], "asset_id string, stage string, start_timestamp timestamp_ntz, end_timestamp timestamp_ntz")
    sig = event_signature(F.col("stage"), F.col("start_timestamp"), F.col("end_timestamp"))
    note = lambda a, v, t: ev.where(F.col("asset_id") == a).select("asset_id", sig.alias("event_signature"), F.lit(v).alias("verdict"), F.lit("n").alias("notes"), F.lit(t).alias("updated_at"))
    base = note("a", "old", "1").unionByName(note("b", "other", "1"))
    notes = upsert(base, note("a", "tie", "2").unionByName(note("a", "tie", "2")), NOTE_KEY, "updated_at")
    assert {r.asset_id: r.verdict for r in note_lookup(ev, notes).collect()} == {"a": "tie", "b": "other"}
    assert notes.count() == 2
    left = delete_by_key(notes, note("b", "x", "3"), NOTE_KEY)
    assert [r.asset_id for r in left.collect()] == ["a"]
