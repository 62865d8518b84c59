"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

A source's target fixes the expected number of copies of each of its documents. Their
prefix sum within the source, in the order of size, is shifted by one random offset per
source, and a document is emitted once for each whole number that its step crosses. In
that order the taken words stay within about one longest document of the target.

Prefix sums run on three levels - rows of one (source, size, digest prefix), prefixes of
one (source, size), sizes of one source - so that no task holds a source.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

WORD_PATTERN = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixOptions:
    """``weights`` go round over the sources by code point, null last; ``at_most`` is the
    greatest ratio of a target to its source's size; ``prefix`` hex digits split equal sizes."""

    weights: tuple[int, ...] = (1, 2, 3)
    at_most: int = 3
    seed: str = "mix"
    prefix: int = 2


def source_key(source: str = "source") -> Column:
    """Not null, and in the order of code points with null last."""
    return F.coalesce(F.concat(F.lit("a"), F.col(source)), F.lit("b"))


def targets(sizes: DataFrame, o: MixOptions) -> DataFrame:
    """Adds ``target`` to a table of one row per source (src, source_size).

    Sorted by cap to weight, the capped sources come first: a source is capped if its cap is
    at most what an equal level of all from here on would give it. Both windows run over one
    row per source, never over documents."""
    one = W.partitionBy(F.lit(1))
    turn = F.element_at(F.array(*map(F.lit, o.weights)), (F.row_number().over(one.orderBy("src")) - 1) % len(o.weights) + 1)
    t = sizes.withColumn("weight", turn.cast("long")).withColumn("cap", F.col("source_size") * o.at_most).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = one.orderBy("ratio", "src")
    t = t.withColumn("before", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    t = t.withColumn("rest", F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing)))
    t = t.withColumn("level", (F.sum("source_size").over(one) - F.col("before")) / F.col("rest"))
    t = t.withColumn("capped", F.col("ratio") <= F.col("level"))
    level = F.max(F.when(~F.col("capped"), F.col("level"))).over(one)
    return t.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(level * F.col("weight"))).select("src", "source_size", "target")


def mix_sources(docs: DataFrame, options: MixOptions | None = None, keep: list[str] | None = None) -> DataFrame:
    """How often the mix takes each document.

    ``docs`` needs doc_id, text and source. Returns one row per input row: row (the input
    columns ``keep``, by default all, as a struct, so that none can clash), size (words; null text: 0), source_size,
    target, copies. Copies are the floor or the ceiling of target / source_size and never
    above ``at_most``. A null source is a source of its own, the last one. Sources without
    a word have the target 0 and no copies. Repeated rows are sampled one by one; rows with
    equal doc_id and size are interchangeable. Runs agree: order and offset are digests.
    An empty table gives no rows.
    """
    o = options or MixOptions()
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"),
        F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size"),
        source_key().alias("src"),
        F.coalesce(F.md5(F.col("doc_id").cast("string")), F.lit("")).alias("digest"),
    ).withColumn("part", F.substring("digest", 1, o.prefix))
    counts = rows.groupBy("src", "size", "part").agg(F.count(F.lit(1)).alias("n"))
    by_size = counts.groupBy("src", "size").agg(F.sum("n").alias("n"))
    sums = by_size.groupBy("src").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    up_to = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = by_size.join(targets(sums, o), "src").select("src", "size", "source_size", "target", up_to(W.partitionBy("src").orderBy("size")).alias("off1"))
    parts = counts.select("src", "size", "part", up_to(W.partitionBy("src", "size").orderBy("part")).alias("off2")).join(sizes, ["src", "size"])
    parts = parts.select("src", "size", "part", "source_size", "target", (F.col("off1") + F.col("off2")).alias("off"))
    rank = F.col("off") + F.row_number().over(W.partitionBy("src", "size", "part").orderBy("digest"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    seed = F.conv(F.substring(F.md5(F.concat(F.lit(o.seed), F.col("src"))), 1, 8), 16, 10).cast("long")
    out = rows.join(parts, ["src", "size", "part"]).withColumn("rank", rank).withColumn("rate", rate).withColumn("shift", (seed % 1_000_000 + F.lit(0.5)) / 1_000_000)
    copies = F.floor(F.col("rate") * F.col("rank") + F.col("shift")) - F.floor(F.col("rate") * (F.col("rank") - 1) + F.col("shift"))
    return out.select("row", "size", "source_size", "target", copies.cast("long").alias("copies"))
