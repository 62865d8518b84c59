"""Exact per-group quantiles from value and count runs.

Rows become runs, one per (group, value), by a partial aggregation: one scan, in which equal
values of a hot group meet before the shuffle. The runs are dealt by range of (group, value),
so a group of any size spreads over as many partitions as it needs, and each partition's
total, added up along its group, gives every run the ranks that it covers. An order statistic
is the value of the run that covers its rank. No group is ever held by one task, and the same
steps and the same arithmetic serve groups of any size.

Quantiles of what runs can be turned into (absolute deviations from a median, coarser groups)
need no further scan of the rows.

Linear interpolation between the order statistics around ``p (n-1)`` as ``percentile`` and
numpy have it. ``exact_quantiles=False`` uses sketches (``percentile_approx``) instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonolith.options import Options
from sonolith.plans.sizing import broadcast_if_small
from sonolith.session import cut_lineage, write_table

RUN = ["var", "x"]


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out &= a[k].eqNullSafe(b[k])
    return out


def merge_runs(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Runs of (keys, var, x) from runs of finer groups or of values that have become equal."""
    return runs.groupBy(*keys, *RUN).agg(F.sum("n").cast("long").alias("n"))


def value_runs(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """(keys, var, x, n): how often each value of each column occurs in a group; ``var`` is the
    column's position. Written once, so that what follows does not scan ``df`` again."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("var"), F.col(v).cast("double").alias("x")) for i, v in enumerate(values)]))
    rows = df.select(*keys, each.alias("_e")).select(*keys, "_e.var", "_e.x", F.lit(1).cast("long").alias("n"))
    return write_table(merge_runs(rows, keys), "runs")


def run_quantiles(runs: DataFrame, keys: Sequence[str], specs: Sequence[tuple[int, float, str]], counts: Sequence[tuple[int, str]], opts: Options) -> DataFrame:
    """One row per group: a column per spec ``(var, p, out)``, NULL where a column has no value, and
    per ``(var, out)`` the number of its values."""
    keys = list(keys)
    group, part = [*keys, "var"], [*keys, "var", "_pid"]
    order = [*[F.col(c) for c in group], F.col("x").asc_nulls_first()]
    dealt = runs.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id())
    dealt = write_table(dealt.withColumn("n", F.when(F.col("x").isNotNull(), F.col("n")).otherwise(0)), "ranks")
    totals = dealt.groupBy(*part).agg(F.sum("n").alias("_t"))
    along = Window.partitionBy(*group).orderBy("_pid")
    before = F.coalesce(F.sum("_t").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select(*part, before.alias("_before"), F.sum("_t").over(Window.partitionBy(*group)).alias("_all"))
    totals = broadcast_if_small(cut_lineage(totals), opts.scale.broadcast_max_rows)
    within = Window.partitionBy(*part).orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    ranked = dealt.withColumn("_upto", F.sum("n").over(within))
    ranked = ranked.join(totals, _same(ranked, totals, part)).select(*[ranked[c] for c in group], "x", "n", "_all", (F.col("_before") + F.col("_upto")).alias("_end"))

    def at(var: int, rank: Column) -> Column:
        return F.max(F.when((F.col("var") == var) & (F.col("_end") - F.col("n") <= rank) & (rank < F.col("_end")), F.col("x")))

    found, out = [], []
    for i, (var, p, name) in enumerate(specs):
        h = F.lit(float(p)) * (F.col("_all") - 1)
        found += [at(var, F.floor(h)).alias(f"_a{i}"), at(var, F.ceil(h)).alias(f"_b{i}"), F.max(F.when(F.col("var") == var, h)).alias(f"_h{i}")]
        a, b, h = F.col(f"_a{i}"), F.col(f"_b{i}"), F.col(f"_h{i}")
        out.append(F.when(a == b, a).otherwise((F.ceil(h) - h) * a + (h - F.floor(h)) * b).alias(name))
    for var, name in counts:
        found.append(F.sum(F.when(F.col("var") == var, F.col("n")).otherwise(0)).cast("long").alias(name))
    return ranked.groupBy(*keys).agg(*found).select(*keys, *out, *[name for _, name in counts])


def quantile_table(
    df: DataFrame,
    keys: Sequence[str],
    specs: Sequence[tuple[str, float, str]],
    opts: Options,
    extra_aggs: Sequence[Column] = (),
    counts: Sequence[tuple[str, str]] = (),
) -> DataFrame:
    """One row per group: ``keys``, a column ``out`` per spec ``(value column, p, out)`` (NULL values
    ignored), per ``counts`` entry ``(value column, out)`` the number of its values, and optional
    extra aggregates over the same rows (those scan ``df`` once more)."""
    keys = list(keys)
    values = sorted({v for v, *_ in [*specs, *counts]})
    if not opts.scale.exact_quantiles:
        aggs = [F.percentile_approx(F.col(v), F.lit(float(p)), opts.scale.approx_accuracy).cast("double").alias(out) for v, p, out in specs]
        return df.groupBy(*keys).agg(*aggs, *[F.count(v).alias(out) for v, out in counts], *extra_aggs)
    at = {v: i for i, v in enumerate(values)}
    out = run_quantiles(value_runs(df, keys, values), keys, [(at[v], p, name) for v, p, name in specs], [(at[v], name) for v, name in counts], opts)
    if not extra_aggs:
        return out
    extra = df.groupBy(*keys).agg(*extra_aggs)
    return out.join(extra, _same(out, extra, keys)).select(*[out[c] for c in out.columns], *[extra[c] for c in extra.columns if c not in keys])
