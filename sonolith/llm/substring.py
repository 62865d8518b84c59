"""Exact removal of long repeated word passages over a compacted De Bruijn graph.

Token k-mers are the nodes; only minimizers are kept (in every window of ``window``
words the k-mer with the least hash), so that any window that occurs twice is anchored
at the same node in both places while the graph has about 2 / (window - k + 2) of the
corpus' k-mers. A node's edges are the words that lead to it and from it, as far as a
window through it can reach. One aggregate over all occurrences (count, least and
greatest edge hash; combined before the shuffle) sorts nodes into

* unique: its windows occur once and stay,
* nonbranching: every occurrence has the same edges, so the paths through it are one
  path and compact to a repeated span without looking at single windows,
* branching: occurrences differ somewhere within reach; there the source coordinates
  decide, by comparing 96-bit hashes of each whole window.

Equal windows have the same minimizer, hence the same node and the same kind, so the
result is that of comparing all windows. Rows go by the pair (doc_id, hash of the
text): repeated rows are separate documents with equal results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonolith.llm import scratch
from sonolith.llm.words import WORD_BASES, Windows, Words, mix, signed, slices

KMER = 12


def _minimizers(words: Words, h: np.ndarray, roll: Windows, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window inside one document: its first word, and the first word of its minimizer."""
    n, reach = len(h), window - k + 1
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.arange(n - k + 1)
    kmer = mix(roll.of(at, at + k))
    low = np.empty(n - window + 1, dtype=np.int64)
    for i in range(0, len(low), 1 << 16):
        part = kmer[i : i + (1 << 16) + reach - 1]
        low[i : i + (1 << 16)] = np.lib.stride_tricks.sliding_window_view(part, reach).argmin(axis=1)
    start = np.arange(len(low))
    last = words.first[1:][words.doc_of()[: len(low)]]  # end of the window's document
    start = start[start + window <= last]
    return start, start + low[start]


def _anchors(batches: Iterator[pa.RecordBatch], window: int, k: int) -> Iterator[pa.RecordBatch]:
    """One row per minimizer occurrence: node, its edges, document, first word."""
    for b in batches:
        for i, j, words in slices(b.column("text")):
            h = words.hashes()
            roll = Windows(h, WORD_BASES[0])
            _, low = _minimizers(words, h, roll, window, k)
            pos = np.unique(low)
            doc = words.doc_of()[pos] if len(pos) else pos
            head, tail = words.first[doc], words.first[doc + 1]
            lo, hi = np.maximum(head, pos + k - window), np.minimum(tail, pos + window)
            edges = mix(roll.of(lo, pos + k) + (pos - lo).astype(np.uint64)) * np.uint64(3) + mix(roll.of(pos, hi) ^ (hi - pos).astype(np.uint64))
            take = pa.array(doc + i)
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(mix(roll.of(pos, pos + k)))), pa.array(signed(edges)), b.column("doc_id").take(take), b.column("dk").take(take), pa.array((pos - head).astype(np.int32))],
                names=["node", "edges", "doc_id", "dk", "pos"],
            )


def _windows(batches: Iterator[pa.RecordBatch], window: int, k: int) -> Iterator[pa.RecordBatch]:
    """Spans of nonbranching nodes (no hash), and each window of a branching node with its hash."""
    for b in batches:
        at = b.column("at")
        offs = at.offsets.to_numpy().astype(np.int64)
        flat = at.values.to_numpy(zero_copy_only=False)
        for i, j, words in slices(b.column("text")):
            h = words.hashes()
            roll = Windows(h, WORD_BASES[0])
            start, low = _minimizers(words, h, roll, window, k)
            mark = flat[offs[i] : offs[j]]
            kind = np.zeros(len(h), dtype=np.int8)  # 1 nonbranching, 2 branching
            kind[np.abs(mark) - 1 + np.repeat(words.first[:-1], np.diff(offs[i : j + 1]))] = np.where(mark > 0, 1, 2)
            doc_of = words.doc_of()
            whole = start[kind[low] == 1]
            cut = np.flatnonzero((np.diff(whole) != 1) | (np.diff(doc_of[whole]) != 0)) + 1 if len(whole) else np.zeros(0, int)
            runs = np.split(whole, cut) if len(whole) else []
            s1 = np.array([r[0] for r in runs], dtype=np.int64)
            e1 = np.array([r[-1] + window for r in runs], dtype=np.int64)
            s2 = start[kind[low] == 2]
            roll2 = Windows(words.hashes(1), WORD_BASES[1])
            s, e = np.concatenate([s1, s2]), np.concatenate([e1, s2 + window])
            doc = doc_of[s]
            null = np.arange(len(s)) < len(s1)
            take = pa.array(doc + i)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(take), b.column("dk").take(take), pa.array((s - words.first[doc]).astype(np.int32)), pa.array((e - words.first[doc]).astype(np.int32)), pa.array(signed(mix(roll.of(s, e))), mask=null), pa.array((mix(roll2.of(s, e)) >> np.uint64(32)).astype(np.uint32).view(np.int32), mask=null)],
                names=["doc_id", "dk", "start", "end", "h1", "h2"],
            )


def _rewrite(batches: Iterator[pa.RecordBatch], keep_text: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        spans = b.column("spans")
        offs = spans.offsets.to_numpy().astype(np.int64)
        ends = [spans.values.field(f).to_numpy(zero_copy_only=False) for f in ("start", "end")]
        n_words, n_removed, digest, texts = [], [], [], []
        for i, j, words in slices(b.column("text")):
            body = words.data.tobytes()
            for d in range(i, j):
                lo, hi = int(words.first[d - i]), int(words.first[d - i + 1])
                step = np.zeros(hi - lo + 1, dtype=np.int64)
                own = slice(offs[d], offs[d + 1])
                np.add.at(step, ends[0][own], 1)
                np.add.at(step, ends[1][own], -1)
                kept = np.flatnonzero(np.cumsum(step[:-1]) == 0) + lo
                text = b" ".join([body[s:e] for s, e in zip(words.start[kept].tolist(), words.end[kept].tolist(), strict=True)])
                n_words.append(hi - lo)
                n_removed.append(hi - lo - len(kept))
                digest.append(hashlib.sha256(text).hexdigest())
                if keep_text:
                    texts.append(text if len(kept) < hi - lo else b.column("text")[d].as_py().encode() if b.column("text")[d].is_valid else None)
            del body
        cols = [b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        if keep_text:
            cols, names = [*cols, pa.array(texts, pa.binary()).cast(pa.string())], [*names, "new_text"]
        if "row" in b.schema.names:
            cols, names = [*cols, b.column("row")], [*names, "row"]
        yield pa.RecordBatch.from_arrays(cols, names=names)


def key_column(doc_id: str = "doc_id", text: str = "text"):
    return F.xxhash64(F.col(doc_id), F.col(text))


def _same(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["dk"] == b["dk"])


def _candidates(rows: DataFrame, id_type: str, window: int, k: int) -> DataFrame:
    """What the compacted graph leaves: repeated spans (h1 null), and windows to compare by hash."""
    occ = scratch.save(rows.mapInArrow(partial(_anchors, window=window, k=k), f"node long, edges long, doc_id {id_type}, dk long, pos int"), "anchors")
    nodes = occ.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("edges").alias("lo"), F.max("edges").alias("hi")).where("n > 1")
    # compaction: each occurrence learns from its node whether the path through it branches
    marks = (
        occ.select("node", "doc_id", "dk", "pos")
        .join(nodes.select("node", (F.col("lo") == F.col("hi")).alias("path")), "node")
        .groupBy("doc_id", "dk")
        .agg(F.collect_set(F.when(F.col("path"), F.col("pos") + 1).otherwise(-F.col("pos") - 1)).alias("at"))
    )
    marked = rows.join(marks, _same(rows, marks)).select(rows["doc_id"], rows["dk"], "text", "at")
    found = scratch.save(marked.mapInArrow(partial(_windows, window=window, k=k), f"doc_id {id_type}, dk long, start int, end int, h1 long, h2 int"), "windows")
    scratch.drop(occ)
    return found


def remove_repeats(docs: DataFrame, window: int = 35, k: int = KMER, keep_text: bool = False, carry: bool = False) -> DataFrame:
    """Remove every word covered by a ``window``-word sequence that starts anywhere else as well.

    ``docs`` needs doc_id (long) and text; other columns are ignored. Returns one row per
    input row: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one
    space), with ``keep_text`` also new_text (these kept words, or the text as it was where
    nothing is removed), with ``carry`` also row, all input columns but text.
    Null and empty texts and texts of fewer than ``window`` words lose nothing (null: no
    words, the digest of an empty text). A null doc_id is a value like any other. Repeated
    rows repeat each other's windows, so all of these go. An empty table gives no rows.
    """
    if not 1 <= k <= window:
        raise ValueError(f"a k-mer of {k} words does not fit a window of {window}")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", key_column().alias("dk"))
    found = _candidates(rows, id_type, window, k)
    scratch.settle(docs.sparkSession)
    single = found.where(F.col("h1").isNotNull())
    twice = single.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2")
    spans = (
        single.select("h1", "h2", "doc_id", "dk", "start")
        .join(twice, ["h1", "h2"], "left_semi")
        .select("doc_id", "dk", "start", (F.col("start") + window).alias("end"))
        .unionByName(found.where(F.col("h1").isNull()).select("doc_id", "dk", "start", "end"))
        .groupBy("doc_id", "dk")
        .agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    )
    none = F.expr("cast(array() as array<struct<start: int, end: int>>)")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")
    base = docs.select("doc_id", "text", key_column().alias("dk"), *[whole] * carry)
    joined = base.join(spans, _same(base, spans), "left").select(base["doc_id"], "text", F.coalesce("spans", none).alias("spans"), *["row"] * carry)
    fields = [base.schema["doc_id"], *T.StructType.fromDDL("n_words long, n_removed long, kept_sha256 string" + ", new_text string" * keep_text)]
    return joined.mapInArrow(partial(_rewrite, keep_text=keep_text), T.StructType(fields + [f for f in base.schema if f.name == "row"]))
