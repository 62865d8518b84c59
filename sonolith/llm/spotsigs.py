"""Document fingerprints by spot signatures.

An anchor is a common word; its signature is the anchor with the ``chain`` content words
that follow it. Running text has many of them, menus and lists have few. A fingerprint is
the set of a document's signatures (32 bits each); the first content words of a document
make one more, so that every text with a word has a fingerprint.

Two sets can reach a Jaccard similarity of t only if the smaller has at least t times the
size of the larger. Fingerprints are therefore compared within, and across neighbouring,
partitions of set length, and a comparison ends as soon as t is out of reach.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sonolith.llm import scratch
from sonolith.llm.graph import components
from sonolith.llm.minhash import block_meetings, spanning
from sonolith.llm.words import WORD_BASES, Windows, mix, slices

# Common words of English, German, French and Spanish.
ANCHORS = (
    "the of and to a in is that for it with as was on be by this are or an at from not he "
    "der die das und den von zu mit sich des auf für ist im dem nicht ein eine als "
    "de la le et les en un du une que est pour qui dans par au sur "
    "el y los se del las por para con no una"
).split()

#: Letters, digits and all of UTF-8 beyond ASCII; the rest separates words.
_BYTES = np.zeros(256, dtype=bool)
_BYTES[128:] = True
for _a, _z in ("az", "AZ", "09"):
    _BYTES[ord(_a) : ord(_z) + 1] = True


@dataclass(frozen=True)
class SpotOptions:
    anchors: tuple[str, ...] = tuple(ANCHORS)
    chain: int = 2
    percent: int = 75


def _anchor_hashes(o: SpotOptions) -> np.ndarray:
    texts = pa.array(sorted(set(o.anchors)))
    return np.unique(np.concatenate([w.hashes() for _, _, w in slices(texts, lower=True, word_bytes=_BYTES)]))


def signatures(texts: pa.Array, o: SpotOptions) -> list[np.ndarray]:
    """The fingerprint of each text: ascending distinct 32-bit signatures; empty only for an empty text."""
    anchors = _anchor_hashes(o)
    out: list[np.ndarray] = []
    for i, j, words in slices(texts, lower=True, word_bytes=_BYTES):
        h = words.hashes()
        at = np.searchsorted(anchors, h)
        at[at == len(anchors)] = 0
        anchor = anchors[at] == h if len(anchors) else np.zeros(len(h), dtype=bool)
        content = np.flatnonzero(~anchor)
        ends = np.searchsorted(content, words.first)  # of each document's content words
        doc = words.doc_of()
        spots = np.flatnonzero(anchor)
        begin = np.searchsorted(content, spots)  # the first content word after the anchor
        whole = begin + o.chain <= ends[doc[spots] + 1]
        spots, begin = spots[whole], begin[whole]
        roll = Windows(h[content], WORD_BASES[0])
        sig = mix(roll.of(begin, begin + o.chain) + h[spots] * np.uint64(3))
        # the start of a document counts as an anchor; what is there of content words, else the first word, follows
        some = np.flatnonzero(np.diff(words.first) > 0)
        head, tail = ends[some], np.minimum(ends[some] + o.chain, ends[some + 1])
        opening = np.where(tail > head, roll.of(head, tail), h[words.first[some]] if len(h) else np.zeros(0, np.uint64))
        every = (np.concatenate([sig, mix(opening + (tail - head).astype(np.uint64))]) >> np.uint64(32)).astype(np.uint32)
        owner = np.concatenate([doc[spots], some])
        order = np.lexsort((every, owner))
        every, owner = every[order], owner[order]
        fresh = np.ones(len(every), dtype=bool)
        fresh[1:] = (every[1:] != every[:-1]) | (owner[1:] != owner[:-1])
        out += np.split(every[fresh], np.searchsorted(owner[fresh], np.arange(1, j - i)))
    # a text without a word, but not empty: all of it is the one signature
    for d in [d for d, s in enumerate(out) if not len(s)]:
        body = texts[d].as_py()
        if body:
            out[d] = np.frombuffer(hashlib.sha256(body.encode()).digest()[:4], dtype=np.uint32)
    return out


def pruned_jaccard(a: np.ndarray, b: np.ndarray, at_least: float = 0.0) -> float:
    """Similarity of two fingerprints, or 0 where it cannot reach ``at_least``. Two empty ones are equal."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if len(small) < at_least * len(large):
        return 0.0
    need, hits, step = at_least / (1 + at_least) * (len(a) + len(b)), 0, 256
    for i in range(0, len(small), step):
        if hits + len(small) - i < need:
            return 0.0
        part = small[i : i + step]
        at = np.searchsorted(large, part)
        at[at == len(large)] = 0
        hits += int((large[at] == part).sum())
    score = hits / (len(a) + len(b) - hits)
    return score if score >= at_least else 0.0


def text_of(s: np.ndarray) -> str:
    return base64.b64encode(s.astype("<u4").tobytes()).decode()


def _compare(batches: Iterator[pa.RecordBatch], o: SpotOptions) -> Iterator[pa.RecordBatch]:
    """Rows arrive in order; a row and the one after it make a result unless the row is a copy."""
    rest: list[tuple] = []
    for b in batches:
        cols = [b.column(c).to_pylist() for c in ("doc_id", "text", "copy")]
        rows = rest + list(zip(*cols, strict=True))
        lo = 0
        while lo < len(rows) - 1:
            hi, chars = lo, 0
            while hi < len(rows) - 1 and (hi == lo or chars < 1 << 20):
                chars += len(rows[hi][1] or "")
                hi += 1
            yield _results(rows[lo : hi + 1], b.schema.field("doc_id").type, o)
            lo = hi
        rest = rows[-1:]


def _results(rows: list[tuple], id_type: pa.DataType, o: SpotOptions) -> pa.RecordBatch:
    own = [r[1] or "" for r in rows]
    use = [i for i in range(len(rows) - 1) if not rows[i][2]]
    edited = [own[i][: len(own[i]) - len(own[i]) // 2] + own[i + 1][: len(own[i]) // 2] for i in use]
    sets = signatures(pa.array(own + edited, pa.large_string()), o)
    after = sets[len(own) :]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([rows[i][0] for i in use], id_type),
            pa.array([len(own[i]) for i in use], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
            pa.array([text_of(sets[i]) for i in use], pa.string()),
            pa.array([text_of(s) for s in after], pa.string()),
            pa.array([pruned_jaccard(sets[i], s) for i, s in zip(use, after, strict=True)], pa.float64()),
            pa.array([pruned_jaccard(sets[i], sets[i + 1]) for i in use], pa.float64()),
        ],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


#: Stretches of doc_id in which neighbours are found: about so many rows each, at most so many.
STRETCH_ROWS, STRETCHES = 256, 65_536


def in_order(docs: DataFrame) -> DataFrame:
    """Rows in partitions sorted by descending doc_id (null last, then by text hash), in which
    every row is followed by its next one, and the last row of all by the first.

    Equal stretches of the range of doc_id go to one partition each; the first row of the
    next stretch follows as a copy. There are at most STRETCHES + 2 such copies."""
    n, lo, hi = docs.agg(F.count("doc_id"), F.min("doc_id"), F.max("doc_id")).first()
    width = 1 if not n else max(1, -(-(hi - lo + 1) // min(STRETCHES, max(1, n // STRETCH_ROWS))))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("th")).withColumn("stretch", F.coalesce(F.expr(f"(doc_id - {lo or 0}L) div {width}L"), F.lit(-1)))
    first = rows.groupBy("stretch").agg(F.max(F.struct(F.col("doc_id"), F.bitwise_not("th").alias("th"))).alias("head")).select("stretch", "head.doc_id", F.bitwise_not("head.th").alias("th"))
    # a window over one row per stretch
    by = W.partitionBy(F.lit(1)).orderBy("stretch")
    first = first.withColumn("to", F.coalesce(F.lead("stretch").over(by), F.min("stretch").over(W.partitionBy(F.lit(1)))))
    heads = first.select(F.col("doc_id").alias("head_id"), F.col("th").alias("head_th"), "to")
    copies = rows.join(F.broadcast(heads), rows["doc_id"].eqNullSafe(heads["head_id"]) & (rows["th"] == heads["head_th"])).select("doc_id", "text", "th", F.col("to").alias("stretch"), F.lit(1).alias("copy"))
    every = rows.withColumn("copy", F.lit(0)).unionByName(copies)
    return every.repartition("stretch").sortWithinPartitions("stretch", "copy", F.col("doc_id").desc_nulls_last(), "th").select("doc_id", "text", "copy")


def fingerprints(docs: DataFrame, options: SpotOptions | None = None) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, and how alike they are.

    ``docs`` needs doc_id (integer) and text; other columns are ignored. The edited text is
    the text with its second half replaced by the start of the next one (descending doc_id).
    Returns one row per input row: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint (base64 of the signatures), near_edited, near_next. Null texts count
    as empty and have an empty fingerprint; two empty ones are alike (1), an empty and
    another are not (0). Null doc_ids come last; rows of equal doc_id follow each other by
    text hash. A single row is its own next. An empty table gives no rows.
    """
    o = options or SpotOptions()
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _compare(batches, o)

    return in_order(docs).mapInArrow(compare, f"doc_id {id_type}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _length_partition(n: str, percent: int):
    """Sets that can be alike are in the same or in neighbouring partitions."""
    return F.floor(F.log(F.col(n)) / F.log(F.lit(100.0 / percent)) + 1e-9)


def similar(docs: DataFrame, options: SpotOptions | None = None) -> DataFrame:
    """Groups of documents whose fingerprints have a Jaccard similarity of ``percent`` / 100 or more.

    ``docs`` needs doc_id and text; other columns are ignored. Returns one row per input row:
    doc_id, n_signatures, component_id (least doc_id reachable). Equal fingerprints are one
    class. Two classes are candidates if they share one of their rarest signatures (as many
    as a set may lack and still be alike) in the same or neighbouring partitions of length;
    connected candidates are compared in blocks. Empty texts are linked with nothing; a null
    doc_id is least only where there is no other. An empty table gives no rows.
    """
    o = options or SpotOptions()
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = signatures(b.column("text").fill_null(""), o)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([s.astype(np.int64).tolist() for s in sets], pa.list_(pa.int64()))], names=["doc_id", "sigs"])

    signed = scratch.save(docs.select("doc_id", "text").mapInArrow(sign, f"doc_id {id_type}, sigs array<long>").withColumn("n", F.size("sigs")).withColumn("cid", F.when(F.col("n") > 0, F.xxhash64("sigs"))), "spots")
    classes = scratch.save(signed.where("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("first_id"), F.first("sigs").alias("sigs"), F.first("n").alias("n")), "classes")
    each = classes.select("cid", "n", F.explode("sigs").alias("sig"))
    rare = each.join(each.groupBy("sig").agg(F.count(F.lit(1)).alias("df")), "sig")
    rank = F.row_number().over(W.partitionBy("cid").orderBy("df", "sig"))  # within one set
    prefix = rare.withColumn("rank", rank).where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * o.percent / F.lit(100)) + 1)
    at = _length_partition("n", o.percent)
    members = prefix.select("cid", "sig", F.explode(F.array(at, at - 1)).alias("length"))
    shared = members.groupBy("sig", "length").agg(F.count(F.lit(1)).alias("n"), F.min("cid").alias("lead")).where("n > 1").drop("n")
    near = components(members.join(shared, ["sig", "length"]).select("cid", "lead").where("cid != lead").distinct(), "cid", "lead")

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = {int(c): np.asarray(s, dtype=np.int64) for c, s in zip(pdf["cid"], pdf["sigs"], strict=True)}
        left, right = ([int(c) for c in pdf["cid"][pdf["side"] == side]] for side in (0, 1))
        right = right or left
        linked = np.array([[a != b and pruned_jaccard(sets[a], sets[b], o.percent / 100) > 0 for b in right] for a in left], dtype=bool).reshape(len(left), len(right))
        return spanning(left, right, linked)

    links = scratch.save(block_meetings(near, classes, 128, 100_000).groupBy("component", "x", "y").applyInPandas(link, "a long, b long"), "links")
    groups = components(links, "a", "b")
    least = groups.join(classes, groups["node"] == classes["cid"]).groupBy("component").agg(F.min("first_id").alias("least"))
    by_class = classes.select("cid", "first_id").join(groups.withColumnRenamed("node", "cid"), "cid", "left").join(least, "component", "left")
    out = signed.join(by_class.select("cid", F.coalesce("least", "first_id").alias("component_id")), "cid", "left")
    return out.select("doc_id", F.col("n").alias("n_signatures"), F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
