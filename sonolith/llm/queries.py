"""Registered queries of the operators: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonolith.llm import chat, langid, scratch
from sonolith.llm.codes import compress
from sonolith.llm.covertree import top_products
from sonolith.llm.extraction import extract
from sonolith.llm.minhash import near_duplicates
from sonolith.llm.mixing import mix_sources
from sonolith.llm.packing import pack
from sonolith.llm.quality import judge
from sonolith.llm.repair import repair
from sonolith.llm.sharding import interleave
from sonolith.llm.spotsigs import fingerprints
from sonolith.llm.substring import remove_repeats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    scratch.small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_substring_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         coalesce('a' || source, 'b') AS src, coalesce(md5(doc_id::VARCHAR), '') AS digest
  FROM documents),
s AS (SELECT src, sum(size)::BIGINT AS source_size FROM d GROUP BY src),
w AS (SELECT *, ((row_number() OVER (ORDER BY src) - 1) % 3 + 1)::BIGINT AS weight, 3 * source_size AS cap FROM s),
r AS (SELECT *, cap / weight AS ratio FROM w),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT
        / (sum(weight) OVER (ORDER BY ratio, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level FROM r),
t AS (SELECT src, source_size, CASE WHEN ratio <= level THEN cap::DOUBLE
        ELSE max(CASE WHEN ratio > level THEN level END) OVER () * weight END AS target FROM l),
k AS (SELECT d.doc_id, d.size, t.source_size, t.target, row_number() OVER (PARTITION BY src ORDER BY d.size, d.digest) AS rank,
        CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
        (('0x' || substr(md5('mix' || src), 1, 8))::BIGINT % 1000000 + 0.5::DOUBLE) / 1000000 AS shift
      FROM d JOIN t USING (src))
SELECT doc_id, size::BIGINT AS size, source_size, target,
       size * (floor(rate * rank + shift) - floor(rate * (rank - 1) + shift))::BIGINT AS taken
FROM k
"""


@query("op2_mix_sources", MIX_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mix_sources(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return mix.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query("op3_spot_signatures")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


@query("op4_language_id")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.predict(docs, langid.fit(docs))
    return out.select("doc_id", F.coalesce(langid.fold() == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


SHARD_SQL = r"""
WITH c AS (
  SELECT list(list_reduce(list_prepend(i, [1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[]),
                          lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc
  FROM (SELECT range AS i FROM range(256))),
d AS (
  SELECT doc_id, source, coalesce(strlen(text), 0) + 8 AS size, coalesce('a' || source, 'b') AS src,
         md5('shard' || coalesce(doc_id::VARCHAR, 'null')) AS digest,
         xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
                         lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM documents, c),
r AS (SELECT *, (2 * row_number() OVER (PARTITION BY src ORDER BY digest, text_crc32, size) - 1) / (2 * count(*) OVER (PARTITION BY src)) AS place FROM d),
g AS (SELECT *, row_number() OVER (ORDER BY place, src, digest, text_crc32, size) - 1 AS pos, count(*) OVER () AS total FROM r)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, (pos * 24 // total)::INTEGER AS shard,
       pos - ((pos * 24 // total) * total + 23) // 24 AS slot, NULL::INTEGER AS grown_shard
FROM g
"""


@query("op5_interleaved_shards", SHARD_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = interleave(table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op6_best_fit_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), str(tokenizer_path()))


@query("op7_html_extraction")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


@query("op8_minhash_near_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("th", "component")


QUALITY_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('a' || source, 'b') AS src, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT rid, unnest(range(1, len(w) - 1)) AS p, w FROM d WHERE len(w) >= 3),
h AS (SELECT rid, p, count(*) OVER (PARTITION BY rid, w[p], w[p + 1], w[p + 2]) AS n FROM g),
rep AS (SELECT rid, count(DISTINCT q) AS n_repeat_words FROM (SELECT rid, unnest([p, p + 1, p + 2]) AS q FROM h WHERE n > 1) GROUP BY rid),
l AS (SELECT rid, src, text, unnest(string_split(text, chr(10))) AS line FROM d),
v AS (SELECT rid, src, text, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words,
             regexp_replace(translate(array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), ' '),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g') AS norm
      FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM v GROUP BY rid),
often AS (SELECT src, norm FROM v GROUP BY src, norm HAVING count(DISTINCT text) > 10),
rem AS (SELECT rid, sum(words) AS removed FROM v JOIN often USING (src, norm) GROUP BY rid),
b AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(removed, 0) AS removed
  FROM d LEFT JOIN rep USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN rem USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * (n_words - removed) >= 75 * n_words AS kept
FROM b
"""


@query("op9_line_frequency_rules", QUALITY_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).drop("removed_words")


@query("op10_transcript_roles")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return chat.parse_transcripts(turns, chat.fit(turns))


def _codes_sql() -> str:
    """Four rounds of assignment and means, each as common table expressions."""
    steps = [r"""
WITH k AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(embedding, lambda v: floor(1024 * v::DOUBLE)) AS x
  FROM documents_of_embeddings),
v AS (SELECT rid, p, x[p * len(x) // 4 + 1 : (p + 1) * len(x) // 4] AS y FROM k, range(4) t(p)),
c0 AS (SELECT p, rid - 1 AS e, y FROM v WHERE rid <= 256)""".replace(
        "documents_of_embeddings", "embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0"
    )]
    for r in range(5):
        steps.append(f"""
a{r} AS (
  SELECT rid, p, any_value(v.y) AS y, min(list_inner_product(v.y, v.y) - 2 * list_inner_product(v.y, c.y) + list_inner_product(c.y, c.y))::BIGINT AS d,
         arg_min(e, {{'d': list_inner_product(v.y, v.y) - 2 * list_inner_product(v.y, c.y) + list_inner_product(c.y, c.y), 'e': e}}) AS e
  FROM v JOIN c{r} c USING (p) GROUP BY rid, p)""")
        if r < 4:
            steps.append(f"""
s{r} AS (SELECT p, e, i, floor(sum(y[i]) / count(*)) AS m FROM a{r}, range(1, len(y) + 1) t(i) GROUP BY p, e, i),
m{r} AS (SELECT p, e, list(m ORDER BY i) AS y FROM s{r} GROUP BY p, e),
c{r + 1} AS (SELECT p, e, coalesce(m.y, c.y) AS y FROM c{r} c LEFT JOIN m{r} m USING (p, e))""")
    return (
        ",".join(steps)
        + """,
h AS (SELECT sha256(string_agg(array_to_string(list_transform(y, lambda v: v::BIGINT), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c4),
w AS (SELECT rid, string_agg(format('{:02x}', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a4 GROUP BY rid)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM k JOIN w USING (rid), h
"""
    )


@query("op11_vector_codes", _codes_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings")).drop("label")


REPAIR_SQL = r"""
WITH RECURSIVE b AS (
  SELECT list(list_reduce(list_prepend(i, [1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[]),
                          lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc
  FROM (SELECT range AS i FROM range(256))),
h AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))), '..'), lambda h: ('0x' || h)::BIGINT)),
                         lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS hit
  FROM conversations, b),
g AS (
  SELECT conv_id, turn, CASE hit WHEN 4 THEN 'user' ELSE role END AS role,
         CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE hit WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM h WHERE hit <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(concat(length(role), chr(0), role, chr(0), text)), copy) AS i FROM g),
q AS (
  SELECT *, left(role, 1) AS t, lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS t2,
         CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
              WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 't' ELSE '' END AS fault FROM o),
-- backward: the cheapest rest of a conversation from each state (start, system, user, assistant)
r AS (
  SELECT conv_id, max(i) AS i, {'c': 0, 'a': '', 'x': ''} AS w0, {'c': 4, 'a': 'II', 'x': chr(10) || 'user:' || chr(10) || 'assistant:'} AS ws,
         {'c': 2, 'a': 'I', 'x': chr(10) || 'assistant:'} AS wu, {'c': 0, 'a': '', 'x': ''} AS wa
  FROM q GROUP BY conv_id
  UNION ALL
  SELECT conv_id, i - 1,
    least(n0, {'c': least(nu, {'c': na.c + 2, 'a': 'I' || na.a, 'x': chr(10) || 'assistant:' || na.x}).c + 2,
               'a': 'I' || least(nu, {'c': na.c + 2, 'a': 'I' || na.a, 'x': chr(10) || 'assistant:' || na.x}).a,
               'x': chr(10) || 'user:' || least(nu, {'c': na.c + 2, 'a': 'I' || na.a, 'x': chr(10) || 'assistant:' || na.x}).x}),
    least(ns, {'c': least(nu, {'c': na.c + 2, 'a': 'I' || na.a, 'x': chr(10) || 'assistant:' || na.x}).c + 2,
               'a': 'I' || least(nu, {'c': na.c + 2, 'a': 'I' || na.a, 'x': chr(10) || 'assistant:' || na.x}).a,
               'x': chr(10) || 'user:' || least(nu, {'c': na.c + 2, 'a': 'I' || na.a, 'x': chr(10) || 'assistant:' || na.x}).x}),
    least(nu, {'c': na.c + 2, 'a': 'I' || na.a, 'x': chr(10) || 'assistant:' || na.x}),
    least(na, {'c': nu.c + 2, 'a': 'I' || nu.a, 'x': chr(10) || 'user:' || nu.x})
  FROM (
    SELECT r.conv_id, r.i,
      least({'c': w0.c + 3, 'a': 'D' || w0.a, 'x': w0.x}, CASE WHEN fault IN ('', 't') THEN least(
        CASE WHEN t = 's' THEN {'c': ws.c + e, 'a': 'K' || ws.a, 'x': chr(10) || role || ':' || text || ws.x} WHEN t = 'u' THEN {'c': wu.c + e, 'a': 'K' || wu.a, 'x': chr(10) || role || ':' || text || wu.x} END,
        {'c': wu.c + e + 2, 'a': 'R' || wu.a, 'x': chr(10) || 'user:' || text || wu.x}) END) AS n0,
      least({'c': ws.c + 3, 'a': 'D' || ws.a, 'x': ws.x}, CASE WHEN fault IN ('', 't') THEN least(
        CASE WHEN t = 'u' THEN {'c': wu.c + e, 'a': 'K' || wu.a, 'x': chr(10) || role || ':' || text || wu.x} END,
        {'c': wu.c + e + 2, 'a': 'R' || wu.a, 'x': chr(10) || 'user:' || text || wu.x}) END) AS ns,
      least({'c': wu.c + 3, 'a': 'D' || wu.a, 'x': wu.x}, CASE WHEN fault IN ('', 't') THEN least(
        CASE WHEN t = 'a' THEN {'c': wa.c + e, 'a': 'K' || wa.a, 'x': chr(10) || role || ':' || text || wa.x} END,
        {'c': wa.c + e + 2, 'a': 'R' || wa.a, 'x': chr(10) || 'assistant:' || text || wa.x}) END) AS nu,
      least({'c': wa.c + 3, 'a': 'D' || wa.a, 'x': wa.x}, CASE WHEN fault IN ('', 't') THEN least(
        CASE WHEN t = 'u' THEN {'c': wu.c + e, 'a': 'K' || wu.a, 'x': chr(10) || role || ':' || text || wu.x} END,
        {'c': wu.c + e + 2, 'a': 'R' || wu.a, 'x': chr(10) || 'user:' || text || wu.x}) END) AS na
    FROM r JOIN (SELECT *, (fault = 't')::INTEGER AS e FROM q) p ON p.conv_id IS NOT DISTINCT FROM r.conv_id AND p.i = r.i)),
s AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
         count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (t2 IS NOT NULL AND t || t2 NOT IN ('su', 'ua', 'au')) AS illegal
  FROM q GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(w0.c, 0)::BIGINT AS cost, coalesce(w0.a, '') AS audit, sha256(substr(coalesce(w0.x, ''), 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM c.conv_id AND r.i = 0
"""


@query("op12_structure_repair", REPAIR_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"))


SEARCH_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda v: floor(1024 * v::DOUBLE)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM p QUALIFY rank <= 10
"""


@query("op13_cover_tree_search", SEARCH_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"))
