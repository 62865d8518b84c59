"""Shards that each match the mixture: proportional stratified interleaving.

Rows of a source are shuffled by a seeded digest and ranked; row r of n gets the
fractional rank (2r - 1) / 2n. In that order all sources run through the table evenly,
and cutting it into stretches of equal row counts gives every shard the same mixture.

Ranks are prefix counts over value buckets (digest prefixes within a source, then
stretches of the fractional rank), so no task sorts a source or the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sonolith.llm.mixing import source_key

#: Hex digits of the digest that split a source; stretches of the fractional rank.
PREFIX = 3
STRETCHES = 16_384


def interleave(docs: DataFrame, shards: int, seed: str = "shard") -> DataFrame:
    """Deal rows into ``shards`` shards of row counts at most one apart.

    ``docs`` needs doc_id, text and source. Returns one row per input row: doc_id, size
    (UTF-8 bytes plus 8; null text: 8), text_crc32 (unsigned; null as empty: 0), source,
    shard, slot (from 0 without gaps). A null source is a stratum of its own. Repeated rows
    take a place each. With fewer rows than shards some shards stay empty. Runs agree:
    the shuffle is a digest of seed and doc_id, ties go by checksum and size.
    """
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).alias("text_crc32"),
        "source",
        source_key().alias("src"),
        F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))).alias("digest"),
    ).withColumn("part", F.substring("digest", 1, PREFIX))
    up_to = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = rows.groupBy("src", "part").agg(F.count(F.lit(1)).alias("n"))
    parts = parts.select("src", "part", up_to(W.partitionBy("src").orderBy("part")).alias("off"), F.sum("n").over(W.partitionBy("src")).alias("of"))
    tie = ["digest", "text_crc32", "size"]
    ranked = rows.withColumn("in", F.row_number().over(W.partitionBy("src", "part").orderBy(*tie))).join(parts, ["src", "part"])
    ranked = ranked.withColumn("place", (2 * (F.col("off") + F.col("in")) - 1) / (2 * F.col("of")))
    ranked = ranked.withColumn("stretch", F.floor(F.col("place") * STRETCHES))
    # at most STRETCHES rows meet in the one window below
    whole = W.partitionBy(F.lit(1))
    stretches = ranked.groupBy("stretch").agg(F.count(F.lit(1)).alias("n")).select("stretch", up_to(whole.orderBy("stretch")).alias("before"), F.sum("n").over(whole).alias("total"))
    at = F.col("before") + F.row_number().over(W.partitionBy("stretch").orderBy("place", "src", *tie)) - 1
    out = ranked.join(stretches, "stretch").withColumn("at", at)
    out = out.withColumn("shard", F.expr(f"at * {shards} div total"))
    first = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    return out.select("doc_id", "size", "text_crc32", "source", F.col("shard").cast("int").alias("shard"), (F.col("at") - first).alias("slot"))
