"""Roles of transcript lines by a hidden Markov model, and canonical turns.

The states are roles; a line's features are its speaker marker, its length, its ending,
its first letter, and the length of the record that it opens. Roles change at records and
at marked lines by one transition matrix, and between other lines by another. Viterbi
finds the most likely roles of a whole conversation; turns are then rendered alike.

A record (one row) is summed up by the best score from each role of its first line to each
role of its last; log probabilities are multiples of 2^-20, so sums are exact in any order.
These small matrices, without texts, are sorted over the whole table by (conversation, turn)
and cut into chunks by rows, whatever the conversations' lengths: many short conversations
share a chunk, and a long one spans many, chained by the matrices of its pieces. Every record
gets the roles that it begins and ends with, and is decoded between them on its own.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonolith.llm import scratch

#: Words that mark a speaker, by role.
MARKERS = {
    "system": ("system", "instruction", "instructions", "context"),
    "user": ("user", "human", "q", "question", "customer", "prompter"),
    "assistant": ("assistant", "bot", "ai", "a", "answer", "agent", "model", "gpt"),
}
ROLE_OF = {w: role for role, words in MARKERS.items() for w in words}
_MARKER = re.compile(r"^\s*(?:[#*>\[<|(]+\s*)?(" + "|".join(sorted(ROLE_OF, key=len, reverse=True)) + r")\s*(?:[\])>|*]+\s*:?|:)\s*[*]*\s*", re.I)


@dataclass(frozen=True)
class ChatOptions:
    """Trained on at most ``sample`` labelled conversations of at most ``longest`` turns each;
    ``prior`` counts say that a marker names its role; chunks hold at most ``chunk`` rows, without texts."""

    sample: int = 2000
    longest: int = 256
    prior: float = 200.0
    smooth: float = 0.5
    chunk: int = 4096


def _bucket(n: int) -> int:
    return sum(n >= b for b in (1, 20, 60, 150, 400, 1000))


def observe(text: str | None) -> list[tuple[tuple[str, ...], bool, str]]:
    """Features of each line of a record, whether the role may change there, and the line without its marker."""
    out = []
    for k, line in enumerate((text or "").split("\n")):
        m = _MARKER.match(line)
        body = line[m.end() :] if m else line
        end = body.rstrip()[-1:]
        features = (
            f"marker={ROLE_OF[m[1].lower()] if m else '-'}",
            f"length={_bucket(len(body))}",
            f"end={end if end in '?.!:,;' and end else 'x'}",
            f"first={'lower' if body[:1].islower() else 'upper' if body[:1].isupper() else 'x'}",
            f"record={_bucket(len(text or ''))}" if k == 0 else "inside",
        )
        out.append((features, k == 0 or m is not None, body))
    return out


@dataclass
class Model:
    roles: list[str]
    start: np.ndarray
    change: np.ndarray  # from role to role where a record or a marked line begins
    stay: np.ndarray
    emit: dict[str, np.ndarray]
    unknown: dict[str, np.ndarray]  # by kind of feature
    known: dict[tuple[str, ...], np.ndarray] = field(default_factory=dict)  # features take few values

    def scores(self, features: tuple[str, ...]) -> np.ndarray:
        total = self.known.get(features)
        if total is None:
            total = sum((self.emit.get(f, self.unknown[f.split("=")[0]]) for f in features), np.zeros(len(self.roles)))
            self.known[features] = total
        return total


def _log(p: np.ndarray) -> np.ndarray:
    """Logarithms as multiples of 2^-20: their sums are exact."""
    return np.round(np.log(p) * (1 << 20)) / (1 << 20)


def train(conversations: list[list[tuple[str, str | None]]], o: ChatOptions) -> Model:
    """From labelled conversations: lists of (role, text)."""
    roles = sorted({r for c in conversations for r, _ in c} | set(MARKERS))
    at = {r: i for i, r in enumerate(roles)}
    k = len(roles)
    start, change, stay = (np.full(s, o.smooth) for s in (k, (k, k), (k, k)))
    # without labels: user and assistant take turns after an optional system message
    start[at["user"]] += 2
    start[at["system"]] += 1
    for a, b in (("system", "user"), ("user", "assistant"), ("assistant", "user")):
        change[at[a], at[b]] += 2
    stay += np.eye(k) * o.prior
    counts: dict[str, Counter] = defaultdict(Counter)
    for role in MARKERS:
        counts[f"marker={role}"][role] += o.prior
    for turns in conversations:
        last = None
        for role, text in turns:
            for features, boundary, _ in observe(text):
                if last is None:
                    start[at[role]] += 1
                else:
                    (change if boundary else stay)[at[last], at[role]] += 1
                for f in features:
                    counts[f][role] += 1
                last = role
    kinds: dict[str, list[str]] = defaultdict(list)
    for f in counts:
        kinds[f.split("=")[0]].append(f)
    for kind in ("marker", "length", "end", "first", "record", "inside"):
        kinds.setdefault(kind, [])
    emit, unknown = {}, {}
    for kind, names in kinds.items():
        total = np.array([sum(counts[f][r] for f in names) for r in roles]) + o.smooth * (len(names) + 1)
        for f in names:
            emit[f] = _log((np.array([counts[f][r] for r in roles]) + o.smooth) / total)
        unknown[kind] = _log(o.smooth / total)
    log = lambda x: _log(x / x.sum(axis=-1, keepdims=True))
    return Model(roles, log(start), log(change), log(stay), emit, unknown)


def in_training_fold(conv_id: str = "conv_id") -> Column:
    return F.crc32(F.col(conv_id).cast("string").cast("binary")) % 5 != 0


def fit(turns: DataFrame, options: ChatOptions | None = None) -> Model:
    """Fit on the first conversations by digest outside the held-out fold; rows without a role are left out."""
    o = options or ChatOptions()
    ids = turns.where(in_training_fold()).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= o.longest)
    ids = ids.orderBy(F.xxhash64("conv_id"), "conv_id").limit(o.sample).select("conv_id")
    rows = turns.join(F.broadcast(ids), "conv_id").select("conv_id", "turn", "role", "text").where("role is not null").toPandas()  # at most sample x longest rows
    rows = rows.sort_values(["conv_id", "turn"], kind="stable")
    return train([list(zip(g["role"], g["text"], strict=True)) for _, g in rows.groupby("conv_id")], o)


def _steps(model: Model, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray, str, int]]:
    """Of each line: its transition matrix, scores, body, and record."""
    return [(model.change if boundary else model.stay, model.scores(f), body, k) for k, t in enumerate(texts) for f, boundary, body in observe(t)]


def _begin(model: Model) -> np.ndarray:
    """Before a conversation any state stands for its start."""
    return np.tile(model.start, (len(model.roles), 1))


def decode(model: Model, steps: list, enter: int, leave: int, first: bool) -> list[int]:
    """Most likely roles between the role before (``enter``) and the last role (``leave``)."""
    score = np.full(len(model.roles), -np.inf)
    score[enter] = 0
    back = []
    for k, (move, emit, _, _) in enumerate(steps):
        ways = score[:, None] + (_begin(model) if first and k == 0 else move)
        back.append(ways.argmax(axis=0))
        score = ways.max(axis=0) + emit
    out = [leave]
    for b in reversed(back[1:]):
        out.append(int(b[out[-1]]))
    return out[::-1]


def render(role: str, text: str) -> str:
    """The canonical turn; the marks of a turn inside a text are escaped."""
    return f"<|{role}|>\n{text.strip().replace('<|', '<\\|')}\n<|end|>"


def within(model: Model, text: str | None) -> np.ndarray:
    """Best scores from each role of a record's first line to each role of its last."""
    steps = _steps(model, [text])
    best = np.where(np.eye(len(model.roles), dtype=bool), steps[0][1], -np.inf)
    for move, emit, _, _ in steps[1:]:
        best = (best[:, :, None] + move[None]).max(axis=1) + emit
    return best


def _onward(model: Model, inner: np.ndarray) -> np.ndarray:
    """Best scores from each role before a record to each role of its last line, of many records."""
    return (model.change[None, :, :, None] + inner[:, None, :, :]).max(axis=2)


def walk(model: Model, inner: np.ndarray, begin: int | None = None, leave: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The roles that each of some consecutive records, given by its scores, begins and ends with.

    ``begin`` and ``leave`` are the roles of the first and the last line of all; None for a whole
    conversation, which starts as the model says."""
    n = len(inner)
    first = model.start if begin is None else np.where(np.arange(len(model.roles)) == begin, 0.0, -np.inf)
    score = (first[:, None] + inner[0]).max(axis=0)
    back = np.zeros((n, len(model.roles)), dtype=np.int64)
    for i, onward in enumerate(_onward(model, inner[1:]), 1):
        ways = score[:, None] + onward
        back[i] = ways.argmax(axis=0)
        score = ways.max(axis=0)
    ends = np.zeros(n, dtype=np.int64)
    ends[-1] = score.argmax() if leave is None else leave
    for i in range(n - 1, 0, -1):
        ends[i - 1] = back[i, ends[i]]
    before = np.vstack([first[None], model.change[ends[:-1]]])
    return (before + inner[np.arange(n), :, ends]).argmax(axis=1), ends


def _inner(table: pa.Table, k: int) -> np.ndarray:
    flat = table.column("inner").combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), k, k)


def _pieces(table: pa.Table) -> list[tuple[str, int, int]]:
    """The conversations of a sorted chunk: (ck, from row, to row)."""
    out, i = [], 0
    for ck, run in groupby(table.column("ck").to_pylist()):
        n = sum(1 for _ in run)
        out.append((ck, i, i + n))
        i += n
    return out


def _placed(ck, chunk, begin, leave) -> pa.Table:
    return pa.table({"ck": pa.array(ck, pa.string()), "chunk": pa.array(chunk, pa.int64()), "begin": pa.array(begin, pa.int32()), "leave": pa.array(leave, pa.int32())})


def parse_transcripts(turns: DataFrame, model: Model, options: ChatOptions | None = None) -> DataFrame:
    """Recover the roles of transcripts and render their turns.

    ``turns`` needs conv_id, turn (integer) and text; role and other columns are ignored, so
    that labels never reach a prediction. Returns one row per recovered turn: conv_id, turn,
    part (from 0; a record splits where a marked line changes the role), role_pred, text
    (without markers), rendered. Null texts count as empty and are still turns; texts of any
    length are decoded one at a time. Rows with a null conv_id are one conversation; null turns
    come last; equal turns go by the digest of their text, repeated rows follow each other.
    Ties between roles go to the first by code point. An empty table gives no rows.

    Chunks are cut by rows of the sorted table: no task holds a conversation, and no group more
    than ``chunk`` rows (the chain of a conversation that spans chunks: one matrix per chunk).
    """
    o = options or ChatOptions()
    k = len(model.roles)
    types = {c: turns.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            inner = [within(model, t).reshape(-1) for t in b.column("text").to_pylist()]
            yield b.append_column("inner", pa.array(inner, pa.list_(pa.float64())))

    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    digest = F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 40)
    rows = turns.select("conv_id", "turn", "text", key.alias("ck"), digest.alias("digest")).withColumn("id", F.monotonically_increasing_id())
    schema = f"conv_id {types['conv_id']}, turn {types['turn']}, text string, ck string, digest string, id long, inner array<double>"
    rows = scratch.save(rows.mapInArrow(measured, schema), "turns")
    order = [F.col("ck"), F.col("turn").asc_nulls_last(), F.col("digest"), F.col("id")]
    light = rows.select("ck", "turn", "digest", "id", "inner").repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    # a partition's numbers start at a multiple of 2^33
    chunk = F.shiftleft(F.shiftright("at", 33), 33) + F.floor(F.col("at").bitwiseAND((1 << 33) - 1) / o.chunk)
    light = scratch.save(light.withColumn("at", at).select("ck", "id", "at", chunk.alias("chunk"), "inner"), "placed")

    def summed(table: pa.Table) -> pa.Table:
        """Of the pieces at a chunk's ends: best scores from the first line's role to the last line's."""
        table = table.sort_by("at")
        inner, pieces = _inner(table, k), _pieces(table)
        out = []
        for ck, i, j in pieces[:1] + pieces[1:][-1:]:
            best = inner[i]
            for onward in _onward(model, inner[i + 1 : j]):
                best = (best[:, :, None] + onward[None]).max(axis=1)
            out.append((ck, best.reshape(-1)))
        chunk = table.column("chunk")[0].as_py()
        return pa.table({"ck": pa.array([r[0] for r in out], pa.string()), "chunk": pa.array([chunk] * len(out), pa.int64()), "inner": pa.array([r[1] for r in out], pa.list_(pa.float64()))})

    def chained(table: pa.Table) -> pa.Table:
        """The roles that a conversation's pieces begin and end with."""
        table = table.sort_by("chunk")
        return _placed(table.column("ck"), table.column("chunk"), *walk(model, _inner(table, k)))

    def walked(table: pa.Table, ends: pa.Table) -> pa.Table:
        """The roles that each record of a chunk begins and ends with."""
        table = table.sort_by("at")
        inner = _inner(table, k)
        known = {r["ck"]: (r["begin"], r["leave"]) for r in ends.to_pylist()}
        parts = [walk(model, inner[i:j], *known.get(ck, ())) for ck, i, j in _pieces(table)]
        begin, leave = (pa.array(np.concatenate([p[c] for p in parts]), pa.int32()) for c in (0, 1))
        return pa.table({"of": table.column("id"), "begin": begin, "leave": leave})

    def rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "turn", "part", "role_pred", "text", "rendered"]
        for b in batches:
            at, part, roles, texts = [], [], [], []
            for i, (text, begin, leave) in enumerate(zip(*(b.column(c).to_pylist() for c in ("text", "begin", "leave")), strict=True)):
                steps = _steps(model, [text])
                path = [begin] + (decode(model, steps[1:], begin, leave, False) if len(steps) > 1 else [])
                for n, (role, run) in enumerate(groupby(zip(path, steps, strict=True), key=lambda x: x[0])):
                    at.append(i)
                    part.append(n)
                    roles.append(model.roles[role])
                    texts.append("\n".join(step[2] for _, step in run).strip())
            done = [pa.array(part, pa.int32()), pa.array(roles, pa.string()), pa.array(texts, pa.string()), pa.array(list(map(render, roles, texts)), pa.string())]
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("conv_id").take(at), b.column("turn").take(at), *done], names=names)

    sums = light.select("ck", "chunk", "at", "inner").groupBy("chunk").applyInArrow(summed, "ck string, chunk long, inner array<double>")
    ends = sums.groupBy("ck").applyInArrow(chained, "ck string, chunk long, begin int, leave int")
    roles = light.groupBy("chunk").cogroup(ends.groupBy("chunk")).applyInArrow(walked, "of long, begin int, leave int")
    placed = rows.select("conv_id", "turn", "text", "id").join(roles, F.col("id") == F.col("of")).select("conv_id", "turn", "text", "begin", "leave")
    return placed.mapInArrow(rendered, f"conv_id {types['conv_id']}, turn {types['turn']}, part int, role_pred string, text string, rendered string")
