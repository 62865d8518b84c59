"""A corpus pipeline: language, near duplicates, repeated passages, mixture, sequences.

Each stage is a function of (spark, docs, sf_dir). ``docs`` has the columns of
``documents``, and so has every result but the last one's. Stages are meant to be written
and read back one after the other, as ``run`` does; a stage removes the intermediate
tables of the one before, whose result is on disk by then.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonolith.llm import langid, scratch
from sonolith.llm.minhash import near_duplicates
from sonolith.llm.mixing import mix_sources
from sonolith.llm.packing import pack
from sonolith.llm.queries import tokenizer_path
from sonolith.llm.substring import remove_repeats
from sonolith.session import ensure_checkpoint_dir, ship_package

#: No SQL can express character models, sketches or tokenizers; tests hold the stages against plain versions.
ORACLE_SQL = None

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_MADE: dict[str, list[str]] = {}


def _stage(fn: Stage) -> Stage:
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ensure_checkpoint_dir(spark)
        ship_package(spark)
        scratch.small_batches(spark)
        app = spark.sparkContext.applicationId
        scratch.release(spark, _MADE.pop(app, []))
        scratch.settle(spark)
        before = scratch.saved(spark)
        out = fn(spark, docs, sf_dir)
        _MADE[app] = [t for t in scratch.saved(spark) if t not in before]
        return out

    return run_stage


def _row(docs: DataFrame):
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter, in a language that was learned and within its calibrated range.

    Null and empty texts go; with no labelled document at all, everything goes."""
    verdicts = langid.predict(docs, langid.fit(docs))
    gone = scratch.save(verdicts.where("rejected").select(F.col("doc_id").alias("id"), "th").distinct(), "rejected")
    rows = docs.select(F.col("doc_id").alias("k1"), F.xxhash64("text").alias("k2"), _row(docs))
    return rows.join(gone, rows["k1"].eqNullSafe(gone["id"]) & (rows["k2"] == gone["th"]), "left_anti").select("row.*")


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of the least doc_id (a null one only if the
    group has no other), whatever other groups share that id; of repeated rows one. Texts without
    a word are in no group."""
    kept = near_duplicates(docs).where("kept").select("component", F.col("doc_id").alias("id"), "th")
    # a group's kept rows have one id
    alone = [F.when(F.col("component").isNull(), F.col(c)).alias(f"alone_{c}") for c in ("id", "th")]
    named = kept.groupBy("component", *alone).agg(F.min("id").alias("id"), F.min("th").alias("th")).select("id", "th")
    rows = docs.select(F.col("doc_id").alias("k1"), F.xxhash64("text").alias("k2"), _row(docs))
    return rows.join(named, rows["k1"].eqNullSafe(named["id"]) & (rows["k2"] == named["th"]), "left_semi").dropDuplicates(["k1", "k2"]).select("row.*")


@_stage
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that occur elsewhere; what is left has single spaces."""
    out = remove_repeats(docs, keep_text=True, carry=True)
    length = F.when(F.col("n_removed") > 0, F.length("new_text").cast("long")).otherwise(F.col("row.n_chars"))
    new = {"text": F.col("new_text"), "n_chars": length}
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


@_stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources take them."""
    return mix_sources(docs).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return pack(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language),
    ("minhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mix_sources", mixture),
    ("best_fit_packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read back."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{root}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
