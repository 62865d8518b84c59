"""Quality rules: per-document counts, and lines that recur across the documents of a host.

Lines are normalised (words joined by one space, A-Z in lower case, digits as 0) and
hashed. A line is dropped where more distinct texts of the same host contain it than the
limit allows; a document that keeps too small a share of its words is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonolith.llm import scratch
from sonolith.llm.mixing import source_key
from sonolith.llm.words import WORD_BASES, Windows, Words, mix, one_by_one, signed, slices

#: Fixed values of the base rules.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_FOLD[ord("0") : ord("9") + 1] = ord("0")


@dataclass(frozen=True)
class QualityOptions:
    """A line goes if more than ``documents`` distinct texts of its host have it, whatever the host's
    size; a document stays with ``keep_percent`` of its words or more."""

    documents: int = 10
    keep_percent: int = 75


def _per_doc(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offs[1:]] - total[offs[:-1]]


def _repeat_words(words: Words) -> np.ndarray:
    """Words covered by 3-word windows that the document has twice or more."""
    n, doc = len(words.start), words.doc_of()
    cover = np.zeros(n + 3, dtype=bool)
    if n >= 3:
        at = np.arange(n - 2)
        at = at[doc[at] == doc[at + 2]]
        h = mix(Windows(words.hashes(), WORD_BASES[0]).of(at, at + 3))
        order = np.lexsort((h, doc[at]))
        same = (h[order][1:] == h[order][:-1]) & (doc[at][order][1:] == doc[at][order][:-1])
        twice = np.zeros(len(at), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for k in range(3):
            cover[at[twice] + k] = True
    return _per_doc(cover[:n], words.first)


def _lines(words: Words, doc_bytes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Lines with a word: document, hash as it stands, normalised hash, words."""
    newline = np.cumsum(words.data == 10)
    line_of = newline[words.start] if len(words.start) else np.zeros(0, np.int64)
    doc = words.doc_of()
    head = np.ones(len(line_of), dtype=bool)
    head[1:] = (line_of[1:] != line_of[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(head)
    last = np.append(first[1:], len(line_of)).astype(np.int64)
    # as it stands: all bytes between the line breaks, the white space around words included
    breaks = np.flatnonzero(words.data == 10)
    lo = np.maximum(np.append(-1, breaks)[line_of[first]] + 1, doc_bytes[doc[first]])
    hi = np.minimum(np.append(breaks, len(words.data))[line_of[first]], doc_bytes[doc[first] + 1])
    raw = Words(words.data, lo, hi, first).hashes()
    folded = Words(_FOLD[words.data], words.start, words.end, words.first).hashes()
    norm = mix(Windows(folded, WORD_BASES[1]).of(first, last) + (last - first).astype(np.uint64))
    norm = one_by_one(norm, folded, first, last)
    return doc[first], raw, norm, last - first


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, j, words in slices(b.column("text")):
            doc_bytes = np.concatenate([[0], np.cumsum(_byte_lengths(b.column("text").slice(i, j - i)))])
            starts = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])
            chars = np.concatenate([[0], np.cumsum(starts[words.end] - starts[words.start])])
            doc, raw, norm, n = _lines(words, doc_bytes)
            order = np.lexsort((raw, doc))
            dup = (raw[order][1:] == raw[order][:-1]) & (doc[order][1:] == doc[order][:-1])
            dups = np.bincount(doc[order][1:][dup], minlength=j - i)
            # distinct normalised lines of a document with all their words
            order = np.lexsort((norm, doc))
            doc, norm, n = doc[order], norm[order], n[order]
            head = np.ones(len(doc), dtype=bool)
            head[1:] = (norm[1:] != norm[:-1]) | (doc[1:] != doc[:-1])
            total = np.add.reduceat(n, np.flatnonzero(head)) if len(doc) else n
            offs = np.searchsorted(doc[head], np.arange(j - i + 1)).astype(np.int32)
            lines = pa.StructArray.from_arrays([pa.array(signed(norm[head])), pa.array(total.astype(np.int64))], names=["line", "words"])
            yield pa.RecordBatch.from_arrays(
                [
                    *(b.column(c).slice(i, j - i) for c in ("doc_id", "src", "th")),
                    pa.array(np.diff(words.first).astype(np.int64)),
                    pa.array(chars[words.first[1:]] - chars[words.first[:-1]]),
                    pa.array(_per_doc(_SYMBOL[words.data], doc_bytes)),
                    pa.array(dups.astype(np.int64)),
                    pa.array(_repeat_words(words)),
                    pa.ListArray.from_arrays(pa.array(offs), lines),
                ],
                names=["doc_id", "src", "th", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"],
            )


def _byte_lengths(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def judge(docs: DataFrame, options: QualityOptions | None = None) -> DataFrame:
    """Counts and verdict of every row of ``docs`` (doc_id, text, source; others are ignored).

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    removed_words (in lines above the limit), kept. Null and empty texts have no words and
    fail the base rules. A null source is a host of its own. Equal texts of a host count
    once, so copies make no line frequent; repeated rows get equal results. A line without a
    word is no line. An empty table gives no rows.
    """
    o = options or QualityOptions()
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", source_key().alias("src"), F.xxhash64("text").alias("th"), "text")
    counts = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    measured = scratch.save(rows.mapInArrow(_measure, f"doc_id {id_type}, src string, th long, {counts}, lines array<struct<line: long, words: long>>"), "measured")
    lines = measured.select("doc_id", "src", "th", F.inline("lines"))
    often = lines.select("src", "line", "th").distinct().groupBy("src", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > o.documents).select("src", "line")
    removed = lines.join(often, ["src", "line"]).dropDuplicates(["doc_id", "src", "th", "line"]).groupBy("doc_id", "src", "th").agg(F.sum("words").alias("removed"))
    base = measured.drop("lines")
    same = base["doc_id"].eqNullSafe(removed["doc_id"]) & (base["src"] == removed["src"]) & (base["th"] == removed["th"])
    out = base.join(removed, same, "left").select(*[base[c] for c in base.columns if c not in ("src", "th")], F.coalesce("removed", F.lit(0)).alias("removed_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    stays = 100 * (F.col("n_words") - F.col("removed_words")) >= o.keep_percent * F.col("n_words")
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & stays)
