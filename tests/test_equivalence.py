"""Scale formulations equal the plain ones on seeded random data."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sonolith.operators.explore import event_windows
from sonolith.operators.persistence import persistent_flag
from sonolith.operators.quality import add_quality_columns
from sonolith.operators.sequence import add_bucket, count_breaks, ordered_scan
from sonolith.options import Options, ScaleOptions


def _random_series(spark, n=400, assets=3, seed=7):
    rng = random.Random(seed)
    rows = []
    for a in range(assets):
        t = dt.datetime(2024, 1, 1)
        for i in range(n):
            t += dt.timedelta(minutes=rng.choice([1, 1, 1, 2, 5, 90, 600]))
            rows.append((f"a{a}", i, t, float(rng.randint(0, 3)), rng.random() < 0.4, rng.random() < 0.8))
    rows.append(("a0", n, None, 1.0, True, True))  # a row without timestamp sorts last
    df = spark.createDataFrame(rows, "asset_id string, row_id long, timestamp timestamp_ntz, v double, w boolean, e boolean")
    return df.withColumn("samples_count", F.col("v") * 100)


def test_ordered_scan_matches_plain_window(spark):
    df = add_bucket(_random_series(spark), "timestamp", 3)
    got = ordered_scan(
        df, ["asset_id"], ["timestamp", "row_id"],
        sums={"s": F.col("v")}, maxes={"m": F.when(F.col("w"), F.col("row_id"))},
        prev={"p": F.col("v")}, nxt={"n": F.col("row_id")},
    )
    w = Window.partitionBy("asset_id").orderBy(F.col("timestamp").asc_nulls_last(), "row_id")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    ref = df.select(
        "asset_id", "row_id",
        F.sum("v").over(upto).alias("s"), F.max(F.when(F.col("w"), F.col("row_id"))).over(upto).alias("m"),
        F.lag("v").over(w).alias("p"), F.lead("row_id").over(w).alias("n"),
    )
    cols = ["asset_id", "row_id", "s", "m", "p", "n"]
    assert sorted(got.select(cols).collect()) == sorted(ref.select(cols).collect())


def test_count_breaks_matches_plain_window(spark):
    df = add_bucket(_random_series(spark), "timestamp", 5)
    brk = lambda c, p: p["v"].isNull() | (c["v"] != p["v"])
    got = count_breaks(df, ["asset_id"], ["timestamp", "row_id"], ["v"], brk, "k")
    w = Window.partitionBy("asset_id").orderBy(F.col("timestamp").asc_nulls_last(), "row_id")
    ref = df.withColumn("_p", F.lag("v").over(w)).withColumn(
        "k", F.sum(F.coalesce(F.col("_p").isNull() | (F.col("v") != F.col("_p")), F.lit(False)).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    assert sorted(got.select("asset_id", "row_id", "k").collect()) == sorted(ref.select("asset_id", "row_id", "k").collect())


def test_quality_scan_independent_of_bucket_width(spark):
    base = _random_series(spark)
    cols = ["asset_id", "row_id", "delta_minutes", "gap_flag", "segment_id", "near_gap_flag", "seq_pos"]
    outs = [
        sorted(add_quality_columns(base, Options(gap_threshold_minutes=30, scale=ScaleOptions(scan_bucket_rows=None, scan_bucket_hours=h))).select(cols).collect())
        for h in (1, 24, 100000)
    ]
    adaptive = [
        sorted(add_quality_columns(base, Options(gap_threshold_minutes=30, scale=ScaleOptions(scan_bucket_rows=r))).select(cols).collect())
        for r in (7, 50, 10**9)
    ]
    assert outs[0] == outs[1] == outs[2] == adaptive[0] == adaptive[1] == adaptive[2]


def test_persistence_matches_rolling_window(spark):
    q = add_quality_columns(_random_series(spark), Options(gap_threshold_minutes=30))
    n = 3
    got = persistent_flag(q, "w", n, "p").select("asset_id", "row_id", "p")
    got_e = persistent_flag(q, "w", n, "pe", eligible="e").select("asset_id", "row_id", "pe")
    pdf = q.select("asset_id", "row_id", "timestamp", "segment_id", "w", "e").toPandas()
    pdf = pdf.sort_values(["asset_id", "timestamp", "row_id"], na_position="last")
    pdf["p"] = pdf.groupby(["asset_id", "segment_id"])["w"].transform(lambda s: s.astype(int).rolling(n, min_periods=1).sum() >= n)
    el = pdf[pdf["e"]].copy()
    el["pe"] = el.groupby(["asset_id", "segment_id"])["w"].transform(lambda s: s.astype(int).rolling(n, min_periods=1).sum() >= n)
    pdf = pdf.merge(el[["asset_id", "row_id", "pe"]], on=["asset_id", "row_id"], how="left")
    pdf["pe"] = pdf["pe"].astype("boolean").fillna(False).astype(bool)
    exp = {(r.asset_id, r.row_id): (bool(r.p), bool(r.pe)) for r in pdf.itertuples()}
    g1 = {(r.asset_id, r.row_id): r.p for r in got.collect()}
    g2 = {(r.asset_id, r.row_id): r.pe for r in got_e.collect()}
    assert all(exp[k] == (g1[k], g2[k]) for k in exp)


def test_binned_range_join_matches_nested_loop(spark):
    rows = _random_series(spark).where(F.col("timestamp").isNotNull())
    ev = rows.where(F.col("row_id") % 37 == 5).select(
        "asset_id", F.col("row_id").alias("event_id"), F.lit("Stage 1").alias("stage"),
        F.col("timestamp").alias("start_timestamp"), (F.col("timestamp") + F.expr("INTERVAL 3 HOURS")).alias("end_timestamp"),
    )
    got = event_windows(rows, ev, 2, event_cols=["event_id"]).select("asset_id", "event_id", "row_id")
    r, e = rows.alias("r"), ev.alias("e")
    ref = r.join(
        e,
        (F.col("r.asset_id") == F.col("e.asset_id"))
        & (F.col("r.timestamp") >= F.col("e.start_timestamp") - F.expr("INTERVAL 2 HOURS"))
        & (F.col("r.timestamp") <= F.col("e.end_timestamp") + F.expr("INTERVAL 2 HOURS")),
    ).select("r.asset_id", "e.event_id", "r.row_id")
    assert sorted(got.collect()) == sorted(ref.collect())


def _uneven_series(spark):
    """A stray row of 1970, a dense second, one instant of many rows, many rows without a timestamp, a sparse asset."""
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", 0, dt.datetime(1970, 1, 1))]
    rows += [("a", 1 + i, t0 + dt.timedelta(minutes=i)) for i in range(800)]
    rows += [("a", 1000 + i, t0 + dt.timedelta(days=3, microseconds=1000 * i)) for i in range(900)]
    rows += [("a", 2000 + 3 * i, t0 + dt.timedelta(days=9)) for i in range(700)]
    rows += [("a", 9000 + i, None) for i in range(600)]
    rows += [("b", i, t0 + dt.timedelta(days=40 * i)) for i in range(30)] + [("c", i, None) for i in range(300)]
    return spark.createDataFrame([(*r, float(r[1] % 3), 100.0) for r in rows], "asset_id string, row_id long, timestamp timestamp_ntz, v double, samples_count double")


@pytest.mark.parametrize("target", [10, 50, 10_000])
def test_counted_buckets_are_bounded_and_ordered(spark, target):
    df = _uneven_series(spark)
    got = add_bucket(df, "timestamp", keys=["asset_id"], target_rows=target)
    rows = sorted(((r.asset_id, r.timestamp is None, r.timestamp or dt.datetime.min, r.row_id, r.scan_bucket) for r in got.collect()))
    assert len(rows) == df.count()
    sizes = {}
    for (a, *_, bucket), nxt in zip(rows, rows[1:] + [None]):
        sizes[a, bucket] = sizes.get((a, bucket), 0) + 1
        assert nxt is None or nxt[0] != a or nxt[-1] >= bucket  # buckets follow the order of the series
    assert max(sizes.values()) <= 2 * target
    assert len(sizes) <= 3 * (1 + len(rows) // target) + 3  # and are not more than the rows need


@pytest.mark.parametrize("target", [10, 50])
def test_scans_of_uneven_series_match_plain_windows(spark, target):
    df = _uneven_series(spark)
    cols = ["asset_id", "row_id", "delta_minutes", "gap_flag", "segment_id", "near_gap_flag", "seq_pos"]
    plain, cut = (Options(gap_threshold_minutes=30, scale=ScaleOptions(**s)) for s in ({"scan_bucket_rows": None, "scan_bucket_hours": 10**9}, {"scan_bucket_rows": target}))
    assert sorted(add_quality_columns(df, cut).select(cols).collect()) == sorted(add_quality_columns(df, plain).select(cols).collect())
    b = add_bucket(df, "timestamp", keys=["asset_id"], target_rows=target)
    got = ordered_scan(b, ["asset_id"], ["timestamp", "row_id"], sums={"s": F.col("v")}, prev={"p": F.col("row_id")}, nxt={"n": F.col("row_id")})
    w = Window.partitionBy("asset_id").orderBy(F.col("timestamp").asc_nulls_last(), "row_id")
    ref = df.select("asset_id", "row_id", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"), F.lag("row_id").over(w).alias("p"), F.lead("row_id").over(w).alias("n"))
    assert sorted(got.select(ref.columns).collect(), key=str) == sorted(ref.collect(), key=str)


def _brute_lof(train, allx, k):
    d_tt = np.sqrt(((train[:, None, :] - train[None, :, :]) ** 2).sum(-1))
    np.fill_diagonal(d_tt, np.inf)
    nn = np.argsort(d_tt, axis=1, kind="stable")[:, :k]
    kd = np.take_along_axis(d_tt, nn, 1)[:, -1]
    lrd = 1.0 / (np.maximum(np.take_along_axis(d_tt, nn, 1), kd[nn]).mean(1) + 1e-10)
    d_q = np.sqrt(((allx[:, None, :] - train[None, :, :]) ** 2).sum(-1))
    nq = np.argsort(d_q, axis=1, kind="stable")[:, :k]
    lq = 1.0 / (np.maximum(np.take_along_axis(d_q, nq, 1), kd[nq]).mean(1) + 1e-10)
    return lrd[nq].mean(1) / lq


def test_lof_cells_match_brute_force(spark):
    from sonolith.operators.ensemble import FEATURE_SLOTS
    from sonolith.operators.lof import lof_scores

    rng = np.random.default_rng(3)
    n = 900
    x = np.zeros((n, len(FEATURE_SLOTS)))
    x[:, :4] = rng.normal(size=(n, 4))
    x[:20, :4] += 6.0  # planted outliers
    x[-5:, :4] = 50.0 + np.arange(5)[:, None]  # query-only rows beyond every training row
    train_mask = (np.arange(n) % 3 != 0) & (np.arange(n) < n - 5)
    pdf = pd.DataFrame(x, columns=FEATURE_SLOTS)
    pdf.insert(0, "row_id", np.arange(n, dtype=np.int64))
    pdf.insert(0, "asset_id", "a")
    pdf["stage3_train"] = train_mask
    pdf["stage3_valid"] = True
    df = spark.createDataFrame(pdf)
    plan = spark.createDataFrame([("a", int(train_mask.sum()))], "asset_id string, n_train long")
    from sonolith.options import Options, ScaleOptions, Stage3Options

    exp = _brute_lof(x[train_mask], x, 10)
    # one cell, many small cells, and cells cut in several rounds from small samples
    for scale in (ScaleOptions(), ScaleOptions(knn_block_rows=40, knn_query_chunk_rows=64), ScaleOptions(knn_block_rows=15, knn_sample_rows=60, knn_ring=2)):
        opts = Options(stage3=Stage3Options(lof_neighbors=10), scale=scale)
        got = {r.row_id: r.lof for r in lof_scores(df, plan, opts).collect()}
        assert len(got) == n
        assert max(abs(got[i] - exp[i]) for i in range(n)) < 1e-9


def _knn(spark, monkeypatch, x, train_mask, scale, k=10):
    """Neighbours by row id, and the intermediate tables of the search by name."""
    from sonolith.operators import lof
    from sonolith.operators.ensemble import FEATURE_SLOTS
    from sonolith.options import Options, Stage3Options

    pdf = pd.DataFrame(np.pad(x, ((0, 0), (0, len(FEATURE_SLOTS) - x.shape[1]))), columns=FEATURE_SLOTS)
    pdf.insert(0, "row_id", np.arange(len(x), dtype=np.int64))
    pdf.insert(0, "asset_id", "a")
    pdf["stage3_train"], pdf["stage3_valid"] = train_mask, True
    plan = spark.createDataFrame([("a", int(train_mask.sum()))], "asset_id string, n_train long")
    tables, write = {}, lof.write_table
    monkeypatch.setattr(lof, "write_table", lambda df, name: tables.setdefault(name, write(df, name)))
    got = lof.knn(spark.createDataFrame(pdf), plan, Options(stage3=Stage3Options(lof_neighbors=k), scale=scale)).collect()
    return {r.q_row: [(n.d, n.o) for n in r.nbrs] for r in got}, tables


def _plain_knn(x, train_mask, kk):
    rows = np.flatnonzero(train_mask)
    d = np.sqrt(((x[:, None] - x[rows][None]) ** 2).sum(-1))
    return {i: [(d[i, j], int(rows[j])) for j in np.lexsort((rows, d[i]))[:kk]] for i in range(len(x))}


def _same_neighbours(got, want):
    assert got.keys() == want.keys()
    for i, pairs in want.items():
        assert [o for _, o in got[i]] == [o for _, o in pairs]
        assert np.allclose([d for d, _ in got[i]], [d for d, _ in pairs], rtol=1e-12, atol=1e-12)


def test_knn_in_seven_dimensions_meets_few_cells(spark, monkeypatch):
    from sonolith.options import ScaleOptions

    rng = np.random.default_rng(5)
    x = (rng.normal(size=(60, 1, 7)) * 10 + rng.normal(size=(60, 50, 7)) * 0.2).reshape(-1, 7)
    train = np.arange(len(x)) % 4 != 0
    got, tables = _knn(spark, monkeypatch, x, train, ScaleOptions(knn_block_rows=30))
    _same_neighbours(got, _plain_knn(x, train, 11))
    cells = tables["lof-query"].select("home").distinct().count()
    met = sum(tables[t].count() for t in ("lof-ring", "lof-outer"))
    assert cells > 40
    assert met < 6 * len(x)  # cells per query besides its own, of more than 40


def test_knn_with_equal_rows(spark, monkeypatch):
    """Nine tenths of the rows are one point: one query, k + 1 training points, and k + 1 candidates per query and cell."""
    from sonolith.options import ScaleOptions

    rng = np.random.default_rng(6)
    x = np.where(np.arange(3000)[:, None] % 10 == 0, np.round(rng.normal(size=(3000, 7)), 1), 0.5)
    train = np.arange(len(x)) % 3 != 0
    got, tables = _knn(spark, monkeypatch, x, train, ScaleOptions(knn_block_rows=20))
    _same_neighbours(got, _plain_knn(x, train, 11))
    assert tables["lof-query"].count() == len(np.unique(x, axis=0))
    per_query = {r["count"] for r in tables["lof-home"].groupBy("q_row").count().collect()}
    assert per_query == {11}


def test_knn_with_fewer_rows_than_neighbours(spark, monkeypatch):
    from sonolith.options import ScaleOptions

    x = np.arange(12.0)[:, None] * [1, 2, 0, 0, 0, 1, 0]
    train = np.arange(12) < 6
    got, _ = _knn(spark, monkeypatch, x, train, ScaleOptions(knn_block_rows=2))
    _same_neighbours(got, _plain_knn(x, train, 6))


def test_cells_are_cut_by_counts(spark):
    """Skewed rows: no cell above twice the target, none empty, whatever the sample; equal rows stay together."""
    from sonolith.operators.kdcells import boxes, grow

    rng = np.random.default_rng(7)
    x = np.exp(rng.normal(size=(6000, 3)) * 3)
    pdf = pd.DataFrame(x, columns=["f0", "f1", "f2"]).assign(asset_key="a", row_id=np.arange(6000))
    placed, rounds = grow(spark.createDataFrame(pdf), ["f0", "f1", "f2"], 50, 10, 200, 1000)
    sizes = [r["n_t"] for r in boxes(placed, ["f0", "f1", "f2"]).collect()]
    assert sum(sizes) == 6000 and max(sizes) <= 100 and len(rounds) > 1
    same, none = grow(spark.createDataFrame(pdf.assign(f0=1.0, f1=1.0, f2=1.0)), ["f0", "f1", "f2"], 50, 10, 200, 1000)
    assert none == [] and same.select("cell").distinct().count() == 1
