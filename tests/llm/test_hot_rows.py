"""Rows repeated very often, and null ids: the same fit, groups of bounded size."""

from pyspark.sql import functions as F

from sonolith.llm import langid
from sonolith.llm.packing import PackOptions, dealt, pack
from sonolith.llm.queries import tokenizer_path


def test_fit_does_not_depend_on_repeats_or_their_places(spark, documents):
    o = langid.LangIdOptions(sample=20, parts=4)
    known = documents.where("lang is not null and text is not null")
    hot = known.where(langid.fold() != 0).orderBy(F.xxhash64("doc_id")).limit(1)
    copies = hot.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(30_000)))).drop("n")
    other = known.orderBy(F.col("doc_id").desc()).limit(1).select(*[F.lit("an other text of the same id").alias(c) if c == "text" else c for c in known.columns])
    plain = langid.fit(known.unionByName(other), o)
    again = langid.fit(copies.repartition(7).unionByName(other).unionByName(known.repartition(5)), o)
    assert plain.langs == again.langs and plain.softness == again.softness and plain.limit.tolist() == again.limit.tolist()
    for name in ("keys", "logp", "contexts", "backoff"):
        assert all((a == b).all() for a, b in zip(getattr(plain, name), getattr(again, name), strict=True)), name


def test_parts_of_a_language_change_nothing(spark, documents):
    one, many = (langid.fit(documents, langid.LangIdOptions(sample=30, parts=p)) for p in (1, 64))
    assert all((a == b).all() for a, b in zip(one.logp, many.logp, strict=True)) and one.limit.tolist() == many.limit.tolist()


def test_equal_pieces_are_spread(spark):
    n = 30_000
    df = spark.range(n + 500).select(F.when(F.col("id") >= n, F.col("id")).alias("doc_id"), F.lit(0).alias("piece"), F.when(F.col("id") >= n, F.col("id")).otherwise(7).alias("ids_crc32"), F.col("id").alias("place"))
    sizes = [r["count"] for r in dealt(df, -(-df.count() // 64), 8).groupBy("g").count().collect()]
    assert sum(sizes) == n + 500 and max(sizes) <= 3 * 64


def test_repeated_rows_are_packed_whole(spark):
    rows = [(None, None)] * 3000 + [(4, "some words to pack")] * 2000 + [(i, f"text {i}") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = pack(df, tokenizer_path(), PackOptions(group=128)).collect()
    assert len(got) == len(rows)
    ends = {}
    for r in got:
        ends.setdefault(r.sequence_id, []).append((r.offset, r.offset + r.length))
    for spans in ends.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= 2048 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert len(ends) <= 1.5 * -(-sum(r.length for r in got) // 2048) + len(rows) // 128 + 1
