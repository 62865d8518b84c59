"""Cheapest repair of a conversation's structure, by a dynamic programme with checkpoints.

A conversation is well formed if its role initials match ``(s?(ua)+)?``. Four states follow
what was written so far, and the state costs before a row (what the rest costs at least, from
each state) come from those after it. Only the costs at checkpoints are stored: those of the
blocks of a chunk, as many as the square root of its rows, and those of the chunks of a long
conversation. Walking forward, a block's costs are recomputed from its checkpoint, and at each
step the first tight edit by ASCII is taken.

In Spark: rows are sorted over the whole table by (conversation, turn, digest) and cut into
chunks of ``1 << chunk_bits`` rows, whatever the conversations' lengths, so a long conversation
spans many chunks. The pieces at a chunk's ends are summed up by (min, +) matrices, whose
product along a conversation gives the costs at every chunk's end; a second walk gives the
state that each piece is entered in. Texts meet the edits once, in the order of the turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonolith.llm import scratch

#: States: nothing yet, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a turn with this initial, by state.
NEXT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: The turn that may come next, by state: what is inserted, and the role that a turn is given.
WANTED = ["u", "u", "a", "u"]
AFTER = [USER, USER, ASSISTANT, USER]
ROLE = {"u": "user", "a": "assistant"}
NEVER = 1 << 60
END = (0, 4, 2, 0)  # after the last row: nothing, two, one, or no insertions
#: Edit costs.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
Costs = tuple[int, int, int, int]


@dataclass(frozen=True)
class RepairOptions:
    """Chunks hold ``1 << chunk_bits`` different rows; pieces of text of ``piece`` characters reach the digest at a time."""

    chunk_bits: int = 12
    piece: int = 1 << 20


def choices(kind: str, after: Costs) -> list[tuple[int, str, int]]:
    """The ways past a row, by state: lists of (cost with the rest, edit, next state), edits in ASCII order.

    ``kind`` is ``d`` for a row that must go, else the initial (``o`` for any other), a capital
    where the row is truncated."""
    out: list = []
    for state in range(4):
        ways = [(DELETE + after[state], "D", state)]
        if kind != "d":
            more = TRUNCATED if kind.isupper() else 0
            kept = NEXT.get(kind.lower(), {}).get(state)
            if kept is not None:
                ways.append((more + after[kept], "K", kept))
            ways.append((REROLE + more + after[AFTER[state]], "R", AFTER[state]))
        out.append(ways)
    return out


class Steps:
    """State costs before a row from those after it. Costs are kept relative to their least, of
    which few different ones occur, so each (row kind, costs) is worked out once."""

    def __init__(self):
        self.known: dict[tuple[str, Costs], tuple[Costs, int, list]] = {}

    def back(self, kind: str, after: Costs) -> tuple[Costs, int]:
        return self._step(kind, after)[:2]

    def edit(self, kind: str, after: Costs, state: int) -> tuple[str, str, int, int]:
        """From a state before a row: initials inserted, edit, next state, cost."""
        return self._step(kind, after)[2][state]

    def _step(self, kind: str, after: Costs):
        found = self.known.get((kind, after))
        if found is None:
            found = self.known[kind, after] = self._work_out(kind, after)
        return found

    @staticmethod
    def _work_out(kind: str, after: Costs):
        ways = choices(kind, after)
        cost = [min(w[0] for w in ways[s]) for s in range(4)]
        for _ in range(3):  # insertions before the row
            cost = [min(cost[s], INSERT + cost[AFTER[s]]) for s in range(4)]
        edits = []
        for state in range(4):
            inserted, at = "", state
            while cost[state] < NEVER:
                tight = [w for w in ways[at] if w[0] == cost[at]]
                if any(w[1] == "D" for w in tight) or cost[at] != INSERT + cost[AFTER[at]]:
                    break  # D comes before I, and I before K and R
                inserted, at = inserted + WANTED[at], AFTER[at]
            else:
                edits.append(None)
                continue
            total, edit, after_it = min(tight, key=lambda w: w[1])
            edits.append((inserted, edit, after_it, INSERT * len(inserted) + total - after[after_it]))
        least = min(cost)
        return tuple(min(c - least, NEVER) for c in cost), least, edits


STEPS = Steps()


def costs_before(kinds: list[tuple[str, int]], after: Costs) -> list[int]:
    """State costs before a run of rows, each with the number of its copies (which all go)."""
    total = 0
    for kind, copies in reversed(kinds):
        after, more = STEPS.back(kind, after)
        total += more + DELETE * (copies - 1)
    return [min(NEVER, c + total) if c < NEVER else NEVER for c in after]


def relative(costs: list[int]) -> Costs:
    least = min(costs)
    return tuple(c - least if c < NEVER else NEVER for c in costs)


def edits(kinds: list[tuple[str, int]], state: int, after: Costs) -> Iterator[tuple[str, str, int]]:
    """Per row the insertions before it, its edit and the state after it, of the least tight edits.

    Costs are kept at about sqrt(n) checkpoints; each block's are recomputed on the way."""
    size = isqrt(len(kinds)) + 1
    starts = range(0, len(kinds), size)
    checkpoints = [after]
    for i in reversed(starts):
        for kind, _ in reversed(kinds[i : i + size]):
            after, _ = STEPS.back(kind, after)
        checkpoints.append(after)
    for i in starts:
        checkpoints.pop()
        block = [checkpoints[-1]]
        for kind, _ in reversed(kinds[i + 1 : i + size]):
            block.append(STEPS.back(kind, block[-1])[0])
        for kind, _ in kinds[i : i + size]:
            inserted, edit, state, _ = STEPS.edit(kind, block.pop(), state)
            yield inserted, edit, state


def tail(state: int) -> str:
    """What is inserted after the last row."""
    out = ""
    while END[state]:
        out, state = out + WANTED[state], AFTER[state]
    return out


def damaged(turns: DataFrame) -> DataFrame:
    """The rows after damage: ck (a text key of the conversation), turn, role, text and copies."""
    space = F.lit(" ")
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    hit = (F.crc32(key.cast("binary")) % 20).alias("hit")
    rows = turns.select(conversation(), "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), hit).where("hit <> 0")
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("hit") == 4, "user").otherwise(F.col("role"))
    return rows.select("ck", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.when(F.col("hit") == 3, 2).otherwise(1).alias("copies"))


def conversation() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("ck")


def _digest() -> Column:
    return F.substring(F.sha2(F.concat_ws("\x00", F.length("role").cast("string"), "role", "text"), 256), 1, 40).alias("digest")


def _classified(rows: DataFrame) -> DataFrame:
    """One row per different (ck, turn, digest): kind, whether it is blank, initial, copies; kind ``d`` must go."""
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    whole = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    initial = F.substring("role", 1, 1)
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    kind = F.when(blank, "d").when(whole, kind).otherwise(F.upper(kind))
    narrow = rows.select("ck", "turn", _digest(), kind.alias("kind"), blank.alias("blank"), initial.alias("initial"), "copies")
    met = narrow.groupBy("ck", "turn", "digest", "kind", "blank", "initial").agg(F.sum("copies").cast("long").alias("copies"))
    met = scratch.save(met, "turns")
    again = met.groupBy("ck", "digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn").alias("turn"))).alias("head")).where("n > 1")
    again = again.select(F.col("ck").alias("k1"), F.col("digest").alias("k2"), F.col("head.turn").alias("first"))
    joined = met.join(again, (met["ck"] == again["k1"]) & (met["digest"] == again["k2"]), "left")
    later = F.col("k1").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first"))
    return joined.select("ck", "turn", "digest", F.when(later, "d").otherwise(F.col("kind")).alias("kind"), "blank", "initial", "copies")


def repair(turns: DataFrame, options: RepairOptions | None = None) -> DataFrame:
    """Damage conversations by a fixed rule, and report the faults and the cheapest repair of each.

    ``turns`` needs conv_id, turn (integer), role and text; other columns are ignored. Returns one
    row per conv_id of the table (rows without one are one conversation): gaps, blank, duplicate,
    truncated, illegal, cost, audit (initials of Delete, Insert, Keep, Rerole) and repaired_sha256.

    Null roles and texts, and a null conv_id or turn in the damage key, are one space; null turns
    come first. Rows of the same turn go by the digest of their role and text; equal rows are
    adjacent, and all but the first of them are duplicates. Texts of any length are read as a
    stream, and an empty one is blank. A conversation without rows after damage has zeros, an
    empty audit and the digest of the empty text. An empty table gives no rows. A turn number
    is a long; gaps beyond a long stop at its end.

    A digest of a whole conversation can only be taken in order: its texts pass one after the
    other through one task, which holds ``piece`` characters of them. All else is cut by rows.
    """
    o = options or RepairOptions()
    rows = damaged(turns)
    order = [F.col("ck"), F.col("turn").asc_nulls_first(), F.col("digest")]
    classified = _classified(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = scratch.save(classified.withColumn("at", F.monotonically_increasing_id()).withColumn("chunk", F.shiftright("at", o.chunk_bits)), "placed")
    light = placed.select("chunk", "at", "ck", "kind", "copies")
    ends = scratch.save(light.groupBy("chunk").applyInArrow(_matrices, "ck string, chunk long, matrix array<long>"), "ends")
    after = ends.groupBy("ck").applyInArrow(_costs_after, "ck string, chunk long, costs array<long>")
    after = scratch.save(after, "after")
    maps = light.groupBy("chunk").cogroup(after.groupBy("chunk")).applyInArrow(_state_maps, "ck string, chunk long, leave array<int>")
    entered = maps.groupBy("ck").applyInArrow(_entered, "ck string, chunk long, state int, last boolean")
    joined = after.join(entered, ["ck", "chunk"])
    schema = "ck string, chunk long, turn long, digest string, before string, edit string, behind string, stats struct<whole:boolean,rows:long,gap_least:long,gap_most:long,turns:long,first_turn:long,last_turn:long,blank:long,duplicate:long,truncated:long,illegal:long,first_initial:string,last_initial:string,cost:long,audit:string>"
    repaired = scratch.save(placed.groupBy("chunk").cogroup(joined.groupBy("chunk")).applyInArrow(_edited, schema), "edits")

    pieces = repaired.where("stats is not null").select("ck", "chunk", "stats.*")
    figures = "ck string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    span = F.least(F.col("gap_most").cast("decimal(38,0)") - F.col("gap_least") + 1 - F.col("turns"), F.lit((1 << 63) - 1)).cast("long")
    span = F.when(F.col("gap_most").isNotNull(), span).otherwise(0)
    same = ["blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    report = pieces.where("whole").select("ck", span.cast("long").alias("gaps"), *same)
    report = report.unionByName(pieces.where("not whole").groupBy("ck").applyInArrow(_reported, figures))

    kept = repaired.where("stats is null").select("ck", "turn", "digest", F.lit(0).alias("side"), "before", "edit", "behind", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    none = F.lit(None).cast("string")
    texts = rows.select("ck", "turn", _digest(), F.lit(1).alias("side"), none.alias("before"), none.alias("edit"), none.alias("behind"), "role", "text")
    merged = kept.unionByName(texts).repartition("ck").sortWithinPartitions("ck", F.col("turn").asc_nulls_first(), "digest", "side")
    hashes = merged.mapInArrow(_hashing(o.piece), "ck string, repaired_sha256 string")

    ids = turns.select(conversation(), "conv_id").groupBy("ck").agg(F.first("conv_id").alias("conv_id"))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    out = ids.join(report, "ck", "left").join(hashes, "ck", "left")
    empty = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))


def _pieces(table: pa.Table) -> list[tuple[str, int, int]]:
    """The conversations of a sorted chunk: (ck, from row, to row)."""
    out, i = [], 0
    for ck, run in groupby(table.column("ck").to_pylist()):
        n = sum(1 for _ in run)
        out.append((ck, i, i + n))
        i += n
    return out


def _kinds(table: pa.Table) -> list[tuple[str, int]]:
    return list(zip(table.column("kind").to_pylist(), table.column("copies").to_pylist(), strict=True))


def _at_ends(pieces: list) -> list:
    """The pieces that may go on in another chunk."""
    return pieces[:1] + pieces[1:][-1:]


def _matrices(table: pa.Table) -> pa.Table:
    """Of the pieces at the ends of a chunk: the least cost from each state before to each state after."""
    table = table.sort_by("at")
    chunk, kinds, out = table.column("chunk")[0].as_py(), _kinds(table), []
    for ck, i, j in _at_ends(_pieces(table)):
        unit = [tuple(0 if s == t else NEVER for s in range(4)) for t in range(4)]
        columns = [costs_before(kinds[i:j], u) for u in unit]
        out.append((ck, chunk, [columns[t][s] for s in range(4) for t in range(4)]))
    return pa.table({"ck": [r[0] for r in out], "chunk": pa.array([r[1] for r in out], pa.int64()), "matrix": pa.array([r[2] for r in out], pa.list_(pa.int64()))})


def _costs_after(table: pa.Table) -> pa.Table:
    """The checkpoints of a conversation's chunks, last to first."""
    table = table.sort_by("chunk")
    after, out = list(END), []
    for matrix in reversed(table.column("matrix").to_pylist()):
        out.append(list(relative(after)))
        after = [min(NEVER, min(matrix[4 * s + t] + after[t] for t in range(4))) for s in range(4)]
    return pa.table({"ck": table.column("ck"), "chunk": table.column("chunk"), "costs": pa.array(out[::-1], pa.list_(pa.int64()))})


def _at(side: pa.Table, name: str) -> dict:
    return dict(zip(side.column("ck").to_pylist(), side.column(name).to_pylist(), strict=True))


def _state_maps(table: pa.Table, ends: pa.Table) -> pa.Table:
    """Of the pieces at the ends of a chunk: the state after them, by the state before."""
    table = table.sort_by("at")
    kinds, out = _kinds(table), []
    costs = _at(ends, "costs")
    for ck, i, j in _at_ends(_pieces(table)):
        leave = []
        for state in range(4):
            for _, _, state in edits(kinds[i:j], state, tuple(costs[ck])):  # noqa: B020
                pass
            leave.append(state)
        out.append((ck, leave))
    chunk = table.column("chunk")[0].as_py()
    return pa.table({"ck": [r[0] for r in out], "chunk": pa.array([chunk] * len(out), pa.int64()), "leave": pa.array([r[1] for r in out], pa.list_(pa.int32()))})


def _entered(table: pa.Table) -> pa.Table:
    """The state in which each piece of a conversation is entered."""
    table = table.sort_by("chunk")
    state, out = START, []
    for leave in table.column("leave").to_pylist():
        out.append(state)
        state = leave[state]
    last = [False] * (len(out) - 1) + [True]
    return pa.table({"ck": table.column("ck"), "chunk": table.column("chunk"), "state": pa.array(out, pa.int32()), "last": last})


def _edited(table: pa.Table, ends: pa.Table) -> pa.Table:
    """The edits of a chunk's rows (deleted rows are left out), and figures of each piece."""
    table = table.sort_by("at")
    chunk, kinds = table.column("chunk")[0].as_py(), _kinds(table)
    turn, digest, initial, blank = (table.column(c).to_pylist() for c in ("turn", "digest", "initial", "blank"))
    costs, entered, last = (_at(ends, c) for c in ("costs", "state", "last"))
    out: list[tuple] = []
    for ck, i, j in _pieces(table):
        after, state = tuple(costs.get(ck, END)), entered.get(ck, START)
        closes = last.get(ck, True)
        audit, cost = [], 0
        for k, (before, edit, leave) in enumerate(edits(kinds[i:j], state, after), i):
            state = leave
            kind, copies = kinds[k]
            audit.append("I" * len(before) + edit + "D" * (copies - 1))
            cost += INSERT * len(before) + DELETE * (copies - 1) + {"D": DELETE, "K": 0, "R": REROLE}[edit] + (TRUNCATED if edit != "D" and kind.isupper() else 0)
            behind = tail(state) if closes and k == j - 1 else ""
            if behind:
                audit.append("I" * len(behind))
                cost += INSERT * len(behind)
            if edit != "D" or before or behind:
                # the role that a turn is given follows from the state after it
                role = edit if edit != "R" else "a" if leave == ASSISTANT else "u"
                out.append((ck, chunk, turn[k], digest[k], before, role, behind, None))
        some = [t for t in turn[i:j] if t is not None]
        pairs = zip(initial[i : j - 1], initial[i + 1 : j], strict=True)
        same = [copies - 1 for _, copies in kinds[i:j]]
        figures = {
            "whole": ck not in costs, "rows": j - i, "gap_least": min(some, default=None), "gap_most": max(some, default=None), "turns": len(set(some)),
            "first_turn": turn[i], "last_turn": turn[j - 1], "blank": sum(c for (_, c), b in zip(kinds[i:j], blank[i:j], strict=True) if b),
            "duplicate": sum(s if k != "d" else s + 1 for (k, _), s, b in zip(kinds[i:j], same, blank[i:j], strict=True) if not b),
            "truncated": sum(k.isupper() for k, _ in kinds[i:j]),
            "illegal": sum(a + b not in ("su", "ua", "au") for a, b in pairs) + sum(same),
            "first_initial": initial[i], "last_initial": initial[j - 1], "cost": cost, "audit": "".join(audit),
        }
        out.append((ck, chunk, None, None, None, None, None, figures))
    return pa.Table.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(_EDITS.types)], schema=_EDITS)


_FIGURES = [("whole", pa.bool_())] + [(c, pa.int64()) for c in ("rows", "gap_least", "gap_most", "turns", "first_turn", "last_turn", "blank", "duplicate", "truncated", "illegal")]
_FIGURES += [("first_initial", pa.string()), ("last_initial", pa.string()), ("cost", pa.int64()), ("audit", pa.string())]
_EDITS = pa.schema([("ck", pa.string()), ("chunk", pa.int64()), ("turn", pa.int64()), ("digest", pa.string()), ("before", pa.string()), ("edit", pa.string()), ("behind", pa.string()), ("stats", pa.struct(_FIGURES))])


def _reported(table: pa.Table) -> pa.Table:
    """The figures of one conversation from those of its pieces."""
    pieces = table.sort_by("chunk").to_pylist()
    sums = {c: sum(p[c] for p in pieces) for c in ("blank", "duplicate", "truncated", "illegal", "cost", "turns")}
    for a, b in zip(pieces, pieces[1:]):
        sums["illegal"] += a["last_initial"] + b["first_initial"] not in ("su", "ua", "au")
        sums["turns"] -= a["last_turn"] is not None and a["last_turn"] == b["first_turn"]
    some = [p for p in pieces if p["gap_least"] is not None]
    gaps = max(p["gap_most"] for p in some) - min(p["gap_least"] for p in some) + 1 - sums["turns"] if some else 0
    row = {"ck": pieces[0]["ck"], "gaps": min(gaps, (1 << 63) - 1), **{c: sums[c] for c in ("blank", "duplicate", "truncated", "illegal", "cost")}, "audit": "".join(p["audit"] for p in pieces)}
    return pa.table({c: pa.array([v], pa.string() if c in ("ck", "audit") else pa.int64()) for c, v in row.items()})


def _hashing(piece: int):
    """Digests of repaired conversations from rows in order, an edit ahead of the texts it concerns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, lines, held, started, edit = None, None, [], 0, False, None
        done: list[tuple[str, str]] = []

        def flush():
            nonlocal lines, held, started
            if lines:
                state.update((("\n" if started else "") + "\n".join(lines)).encode())
                lines, held, started = [], 0, True

        def put(line: str):
            nonlocal held
            lines.append(line)
            held += len(line)
            if held > piece:
                flush()

        for batch in batches:
            for ck, turn, digest, side, before, act, behind, role, text in zip(*(batch.column(c).to_pylist() for c in range(9)), strict=True):
                if ck != now:
                    if now is not None:
                        flush()
                        done.append((now, state.hexdigest()))
                    now, state, started, edit = ck, hashlib.sha256(), False, None
                if side == 0:
                    edit = (turn, digest, act, behind)
                    for c in before:
                        put(f"{ROLE[c]}:")
                    if act == "D":
                        for c in behind:
                            put(f"{ROLE[c]}:")
                        edit = None
                elif edit is not None and edit[:2] == (turn, digest):  # the first of equal rows
                    put(f"{role if edit[2] == 'K' else ROLE[edit[2]]}:{text}")
                    for c in edit[3]:
                        put(f"{ROLE[c]}:")
                    edit = None
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in done], pa.string()) for c in (0, 1)], ["ck", "repaired_sha256"])
                done = []
        if now is not None:
            flush()
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([state.hexdigest()])], ["ck", "repaired_sha256"])

    return run
