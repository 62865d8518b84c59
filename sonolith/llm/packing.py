"""Packing token pieces into sequences by vector best fit.

A sequence has three capacities: tokens, documents, and attention cost (the sum of the
squared lengths). Pieces are placed longest first, each into the open sequence where all
three still hold and the weighted norm of what would remain is least, else into a new one.

Pieces are dealt by digest into groups of bounded size that are packed independently;
a group's few half-empty last sequences are the only loss.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonolith.llm import scratch

SPACE = "\u0120"  # how byte-level vocabularies write a space


@dataclass(frozen=True)
class PackOptions:
    """Each piece has at least one token, so the defaults for documents and attention cost
    bind only where tokens do; lower ones trade sequences for shorter attention."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 1e-4, 1e-4)
    end_id: int = 0
    group: int = 4096


class _Numbers(dict):
    """Numbers for chunks, in the order of their first use; ``new`` are those not yet encoded."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self[chunk] = n = len(self)
        self.new.append(chunk)
        return n


class ChunkEncoder:
    """Token ids of whole texts through a cache of chunks.

    The tokenizer never merges across a single space between two characters that are not
    white space, so the text is cut before each such space and every distinct chunk is
    encoded once. New chunks are encoded many in one string: each begins with the only token
    in it that starts with a space. Chunks next to other white space are odd; they send
    their whole text down the plain way, and so does an added token in the text."""

    def __init__(self, path: str, limit: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.spaced[[i for token, i in vocabulary.items() if token[0] == SPACE]] = True
        self.limit = limit
        self.clear()

    def forget(self) -> None:
        """Keep the chunks that most of the batches met, half as many as the limit."""
        n, keep = len(self.known), self.limit // 2
        often = np.sort(np.argsort(-self.met[:n], kind="stable")[:keep])
        chunks = list(self.known)
        known, start, length, odd, met, ids = [chunks[i] for i in often.tolist()], self.start[often], self.length[often], self.odd[often], self.met[often], self.ids
        self.clear()
        self._room(len(known))
        for chunk in known:
            self.known[chunk]
        self.known.new = []
        to = np.cumsum(length)
        self.length[: len(known)], self.odd[: len(known)], self.met[: len(known)] = length, odd, met // 2
        self.start[: len(known)] = self._store(ids[np.repeat(start - to + length, length) + np.arange(to[-1] if len(to) else 0)]) + to - length

    def clear(self) -> None:
        self.known = _Numbers()
        self.ids = np.zeros(1 << 16, dtype=np.uint32)
        self.start = np.zeros(1 << 14, dtype=np.int64)
        self.length = np.zeros(1 << 14, dtype=np.int64)
        self.odd = np.zeros(1 << 14, dtype=bool)
        self.met = np.zeros(1 << 14, dtype=np.int64)  # batches that had the chunk
        self.used = 0

    def _room(self, n: int) -> None:
        while n > len(self.start):
            self.start, self.length, self.odd, self.met = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length, self.odd, self.met))

    def _have_added(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), dtype=bool)
        for token in self.added:
            out |= np.fromiter([token in t for t in texts], dtype=bool, count=len(texts))
        return out

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _store(self, ids: np.ndarray) -> int:
        """Append ids; where they are."""
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return self.used - len(ids)

    def _learn(self, added: bool) -> None:
        """``added``: some of the new chunks may hold an added token."""
        chunks, self.known.new = self.known.new, []
        first, n = len(self.known) - len(chunks), len(self.known)
        self._room(n)
        odd = np.fromiter((not c or c[0].isspace() or c[-1].isspace() for c in chunks), dtype=bool, count=len(chunks))
        if added:
            odd |= self._have_added(chunks)
        even = [c for c, o in zip(chunks, odd, strict=True) if not o]
        ids = np.concatenate([np.zeros(0, np.uint32), *self.plain(["".join([f" {c}" for c in even[i : i + 1000]]) for i in range(0, len(even), 1000)])])
        begins = np.flatnonzero(self.spaced[ids])
        if len(begins) != len(even):
            raise ValueError("the tokenizer does not keep chunks apart at spaces")
        at = first + np.flatnonzero(~odd)
        self.start[at] = self._store(ids) + begins
        self.length[at] = np.diff(np.append(begins, len(ids)))
        self.odd[first:n] = odd

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > self.limit:
            self.forget()
        added = self._have_added(texts)
        # only the distinct chunks of these texts become Python strings and meet the large cache
        cut = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        counts = cut.value_lengths().to_numpy()
        coded = pc.dictionary_encode(cut.flatten())
        own, index = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        distinct = np.fromiter(map(self.known.__getitem__, own), dtype=np.int64, count=len(own))
        if self.known.new:
            self._learn(bool(added.any()))
        self.met[distinct] += 1
        ends = np.cumsum(counts)
        head = ends - counts
        firsts = [own[k] for k in index[head].tolist()]
        index = distinct[index]
        odd = self.odd[index]
        odd[head] = [not c and n > 1 or c[-1:].isspace() for c, n in zip(firsts, counts, strict=True)]
        start, length = self.start[index], self.length[index]
        # a text's first chunk has no space before it; its ids stand behind the cache for now
        keep, begin = self.used, self.plain(firsts)
        length[head] = [len(x) for x in begin]
        start[head] = self._store(np.concatenate([np.zeros(0, np.uint32), *begin])) + np.cumsum(length[head]) - length[head]
        self.used = keep
        to = np.cumsum(length)
        flat = self.ids[np.repeat(start - to + length, length) + np.arange(to[-1] if len(to) else 0)]
        out = np.split(flat, to[ends[:-1] - 1]) if texts else []
        odd[head] |= added
        for d in np.flatnonzero(np.logical_or.reduceat(odd, head)) if texts else []:
            out[d] = self.plain([texts[d]])[0]
        return out


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One per Python worker, kept between tasks with its bounded cache."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def _some(texts: list[str | None], chars: int = 1 << 21) -> Iterator[tuple[int, list[str]]]:
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n < chars):
            n += len(texts[j] or "")
            j += 1
        yield i, [t or "" for t in texts[i:j]]
        i = j


def cut_pieces(docs: DataFrame, tokenizer: str, o: PackOptions) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: documents' ids with the end id, the long ones cut."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([o.end_id], dtype="<u4")
        for b in batches:
            ids = b.column("doc_id")
            rows: list[tuple[int, int, int, int, int]] = []
            for i, texts in _some(b.column("text").to_pylist()):
                for d, got in enumerate(enc.encode(texts), i):
                    body = np.concatenate([got, end]).astype("<u4").tobytes()
                    n = len(body) // 4
                    head = (n - 1) % o.tokens + 1  # the first piece may be shorter
                    for p, hi in enumerate(range(head, n + 1, o.tokens)):
                        lo = max(0, hi - o.tokens)
                        rows.append((d, p, lo, hi - lo, zlib.crc32(body[4 * lo : 4 * hi])))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(pieces, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], o: PackOptions) -> tuple[list[int], list[int]]:
    """Sequence number and offset of each piece."""
    wt, wd, wa = o.weights
    seq, offset = [0] * len(lengths), [0] * len(lengths)
    left: list[int] = []  # per sequence: tokens, documents and attention cost that remain
    docs: list[int] = []
    cost: list[int] = []
    at: list[set[int]] = [set() for _ in range(o.tokens + 1)]  # open sequences by remaining tokens
    open_at = 0  # bit r: at[r] is not empty
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        best, best_norm = -1, float("inf")
        bits = open_at >> n
        while bits:
            r = (bits & -bits).bit_length() - 1
            token_norm = wt * (r / o.tokens) ** 2
            if token_norm >= best_norm:
                break
            for s in at[r + n]:
                if docs[s] >= 1 and cost[s] >= n * n:
                    norm = token_norm + wd * ((docs[s] - 1) / o.documents) ** 2 + wa * ((cost[s] - n * n) / o.attention) ** 2
                    if norm < best_norm or norm == best_norm and s < best:
                        best, best_norm = s, norm
            bits &= bits - 1
        if best < 0:
            best = len(left)
            left.append(o.tokens)
            docs.append(o.documents)
            cost.append(o.attention)
        else:
            at[left[best]].discard(best)
            if not at[left[best]]:
                open_at &= ~(1 << left[best])
        seq[i], offset[i] = best, o.tokens - left[best]
        left[best] -= n
        docs[best] -= 1
        cost[best] -= n * n
        if left[best]:
            at[left[best]].add(best)
            open_at |= 1 << left[best]
    return seq, offset


def pack(docs: DataFrame, tokenizer: str, options: PackOptions | None = None) -> DataFrame:
    """Pack all documents' tokens into sequences.

    ``docs`` needs doc_id and text; other columns are ignored. ``tokenizer`` is the path of a
    byte-level BPE file of the tokenizers library, the same on every executor. Returns one
    row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null or
    empty text is the end id alone. Only documents longer than a sequence are cut, into whole
    sequences after a shorter first piece. Repeated rows are packed one by one. An empty
    table gives no rows.
    """
    o = options or PackOptions()
    if o.attention < o.tokens * o.tokens or o.documents < 1:
        raise ValueError("a whole sequence must hold one piece of full length")
    pieces = scratch.save(cut_pieces(docs, tokenizer, o).withColumn("place", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-pieces.count() // o.group))
    schema = pieces.drop("place").schema.simpleString()[7:-1].replace(":", " ") + ", sequence_id long, offset long"

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        seq, offset = best_fit(pdf["length"].tolist(), o)
        first = int(pdf["g"].iat[0]) << 32
        return pdf.drop(columns="g").assign(sequence_id=np.array(seq, dtype=np.int64) + first, offset=np.array(offset, dtype=np.int64))

    return dealt(pieces, groups, max(1, o.group // 8)).groupBy("g").applyInPandas(fill, schema)


def dealt(pieces: DataFrame, groups: int, most: int) -> DataFrame:
    """The group ``g`` of every piece. Equal pieces of which there are more than ``most`` (repeated
    rows, or null ids without text) go to as many groups as that asks for, by their place in the table."""
    keys = ["doc_id", "piece", "ids_crc32"]
    often = pieces.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    often = often.select(*[F.col(c).alias(f"k_{c}") for c in keys], F.ceil(F.col("n") / most).alias("spread"))
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"k_{c}"))
    deal = F.xxhash64("k_ids_crc32", F.pmod(F.xxhash64("place"), F.col("spread")))
    g = F.pmod(F.xxhash64(*keys).bitwiseXOR(F.when(F.col("spread").isNull(), 0).otherwise(deal)), F.lit(groups))
    return pieces.join(often, same, "left").withColumn("g", g).drop("place", "spread", *[f"k_{c}" for c in keys])
