"""Bounded-memory exact quantiles equal numpy's linear interpolation."""

import numpy as np
import pandas as pd

from sonolith.operators.quantiles import quantile_table
from sonolith.options import Options


def test_runs_match_numpy(spark):
    rng = np.random.default_rng(11)
    frames = []
    for k, n in (("a", 5000), ("b", 3000), ("c", 7)):
        x = rng.normal(size=n) * 10
        if k == "b":
            x[:1500] = 3.25  # heavy duplicates
        frames.append(pd.DataFrame({"k": k, "x": x, "y": np.abs(x)}))
    pdf = pd.concat(frames, ignore_index=True)
    df = spark.createDataFrame(pdf)
    probs = (0.0, 0.05, 0.5, 0.9, 0.99, 1.0)
    specs = [("x", p, f"x{i}") for i, p in enumerate(probs)] + [("y", 0.5, "ymed")]
    opts = Options()
    from pyspark.sql import functions as F

    got = {r.k: r for r in quantile_table(df, ["k"], specs, opts, extra_aggs=[F.count(F.lit(1)).alias("n")]).collect()}
    assert set(got) == {"a", "b", "c"}
    for k, g in pdf.groupby("k"):
        for i, p in enumerate(probs):
            assert abs(got[k][f"x{i}"] - np.quantile(g["x"], p)) < 1e-9
        assert abs(got[k]["ymed"] - np.median(g["y"])) < 1e-9
        assert got[k]["n"] == len(g)


def test_groups_without_values_and_null_keys(spark):
    df = spark.createDataFrame([(None, 1.0, None), (None, 3.0, None), ("a", None, None), ("b", -0.0, 5.0), ("b", 0.0, None)], "k string, x double, y double")
    got = {r.k: tuple(r)[1:] for r in quantile_table(df, ["k"], [("x", 0.5, "x"), ("y", 0.25, "y")], Options(), counts=[("x", "nx"), ("y", "ny")]).collect()}
    assert got == {None: (2.0, None, 2, 0), "a": (None, None, 0, 0), "b": (0.0, 5.0, 2, 1)}


def test_a_hot_group_spreads_over_partitions(spark, monkeypatch):
    """One group with nearly all values: its runs lie in many partitions, each of a bounded share."""
    from sonolith.operators import quantiles

    tables, write = {}, quantiles.write_table
    monkeypatch.setattr(quantiles, "write_table", lambda df, name: tables.setdefault(name, write(df, name)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rng = np.random.default_rng(3)
        x = rng.normal(size=40_000)
        df = spark.createDataFrame(pd.DataFrame({"k": np.where(np.arange(len(x)) % 100, "hot", "rare"), "x": x}))
        got = quantile_table(df, ["k"], [("x", 0.37, "q")], Options()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    hot = np.arange(len(x)) % 100 != 0
    assert {r.k: r.q for r in got} == {"hot": np.quantile(x[hot], 0.37), "rare": np.quantile(x[~hot], 0.37)} or all(abs(r.q - np.quantile(x[hot if r.k == "hot" else ~hot], 0.37)) < 1e-12 for r in got)
    sizes = [r["count"] for r in tables["ranks"].groupBy("_pid").count().collect()]
    assert len(sizes) >= 4 and max(sizes) < 0.5 * len(x)


def test_baselines_scan_the_rows_once(spark):
    """Both granularities, medians and deviations: one pass over the measurements, values as numpy has them."""
    from sonolith.operators.baseline import BASELINE_METRICS, baseline_tables

    rng = np.random.default_rng(4)
    n = 3000
    pdf = pd.DataFrame({"asset_id": rng.choice(["a", "b"], n), "weekday": rng.integers(0, 7, n).astype("int32"), "hour_of_day": rng.integers(0, 3, n).astype("int32")})
    for m in BASELINE_METRICS:
        pdf[m] = np.round(rng.normal(size=n), 2)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    src = spark.createDataFrame(pdf)
    hourly, weekly = baseline_tables(src.mapInArrow(count, src.schema), Options())
    hourly, weekly = hourly.toPandas(), weekly.toPandas()
    assert seen.value == n
    for table, by in ((hourly, ["asset_id", "hour_of_day"]), (weekly, ["asset_id", "weekday", "hour_of_day"])):
        groups = {k: g for k, g in pdf.groupby(by)}
        assert len(table) == len(groups)
        for _, r in table.iterrows():
            g = groups[tuple(r[c] for c in by)]
            assert r.baseline_count == len(g)
            for m in BASELINE_METRICS:
                med = np.median(g[m])
                assert abs(r[f"{m}_baseline_median"] - med) < 1e-12
                assert abs(r[f"{m}_baseline_mad"] - np.median(np.abs(g[m] - med))) < 1e-12
