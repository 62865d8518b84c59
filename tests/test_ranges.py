"""Dyadic covers and the range join on them."""

import datetime as dt
import random

from pyspark.sql import functions as F

from sonolith.operators.feedback import labelled_rows
from sonolith.operators.ranges import LEVELS, dyadic_cover, hour_of, rows_in_windows, span_key
from sonolith.operators.sequence import add_bucket


def test_cover_holds_each_hour_once_with_few_spans(spark):
    rng = random.Random(3)
    pairs = [(a, a + n) for a in (-70, -1, 0, 1, 5, 64, 1023) for n in (0, 1, 2, 3, 7, 8, 63, 200)]
    pairs += [(a, a + rng.randrange(400)) for a in (rng.randrange(-500, 500) for _ in range(100))] + [(5, 4), (9, -9)]
    df = spark.createDataFrame(pairs, "a long, b long").select("a", "b", dyadic_cover(F.col("a"), F.col("b")).alias("spans"))
    for a, b, spans in df.collect():
        hours = []
        for s in spans:
            index, level = divmod(s, LEVELS + 1)
            hours += range(index << level, (index + 1) << level)
        assert sorted(hours) == list(range(a, b + 1))
        assert len(spans) <= 2 * max(1, (b - a + 1).bit_length())


def test_keys_per_window_are_logarithmic(spark):
    windows = [(dt.datetime(2023, 3, 5, 7), dt.datetime(2024, 3, 4, 5)), (dt.datetime(1970, 1, 1, 1), dt.datetime(2069, 12, 31, 22))]
    df = spark.createDataFrame(windows, "s timestamp_ntz, e timestamp_ntz")
    sizes = [r.n for r in df.select(F.size(dyadic_cover(hour_of(F.col("s")), hour_of(F.col("e")))).alias("n")).collect()]
    assert sizes[0] <= 28 and sizes[1] <= 40  # 8,759 and 876,574 hours


def test_span_keys_differ_between_levels(spark):
    keys = [(k, i) for k in range(LEVELS + 1) for i in range(-3, 4)]
    got = spark.createDataFrame(keys, "k int, i long").select(span_key(F.col("k"), F.col("i")).alias("key")).distinct().count()
    assert got == len(keys)


def _nested(rows, windows):
    return sorted((a, i, w) for a, i, t in rows for b, w, s, e in windows if a == b and None not in (t, s, e) and s <= t <= e)


def test_join_matches_nested_loop_with_odd_windows(spark):
    rng = random.Random(11)
    t0 = dt.datetime(2024, 2, 27, 22)
    at = lambda minutes: t0 + dt.timedelta(minutes=minutes)
    # one hot hour, a stray row of 1969, rows without a time, repeated instants
    rows = [("hot", i, at(rng.randrange(60))) for i in range(400)] + [("hot", 400 + i, at(rng.randrange(600_000))) for i in range(200)]
    rows += [("b", i, at(37 * (i // 3))) for i in range(150)] + [("b", 900, dt.datetime(1969, 12, 31, 23, 30)), ("b", 901, None)]
    windows = []
    for k in range(60):
        s = rng.randrange(600_000)
        windows.append((rng.choice(["hot", "b", "c"]), k, at(s), at(s + rng.choice([0, 1, 90, 5_000, 525_600]))))
    windows += [("b", 100, dt.datetime(1900, 1, 1), dt.datetime(2100, 1, 1)), ("b", 101, at(50), at(10)), ("b", 102, None, at(1)), ("b", 103, at(1), None)]
    windows += [("hot", 104, at(7), at(7)), ("hot", 104, at(7), at(7))]
    r = spark.createDataFrame(rows, "asset_id string, row_id long, timestamp timestamp_ntz")
    w = spark.createDataFrame(windows, "asset_id string, wid long, s timestamp_ntz, e timestamp_ntz")
    got = rows_in_windows(r, w, "s", "e", ["asset_id"])
    assert sorted(tuple(x) for x in got.select("asset_id", "row_id", "wid").collect()) == _nested(rows, windows)
    assert "NestedLoop" not in got._jdf.queryExecution().toString()
    assert rows_in_windows(r, w.limit(0), "s", "e", ["asset_id"]).count() == 0
    assert rows_in_windows(r.limit(0), w, "s", "e", ["asset_id"]).count() == 0


def test_learning_window_that_ends_before_it_starts_holds_nothing(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([("a", i, t0 + dt.timedelta(hours=i), 0, float(i), 1.0) for i in range(9)], "asset_id string, row_id long, timestamp timestamp_ntz, segment_id long, avg_decibel double, peak_minus_min double")
    labels = spark.createDataFrame([("a", "x", t0 + dt.timedelta(hours=5), t0), ("a", "y", t0, t0 + dt.timedelta(hours=1))], "asset_id string, label_id string, learning_window_start timestamp_ntz, learning_window_end timestamp_ntz")
    assert [(r.label_id, r.row_id, r.next_avg_decibel) for r in labelled_rows(add_bucket(rows, "timestamp", keys=["asset_id"], target_rows=4), labels).orderBy("row_id").collect()] == [("y", 0, 1.0), ("y", 1, 2.0)]
