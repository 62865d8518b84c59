"""Vector codes, structure repair and cover-tree search against plain versions, with nulls, ties, copies and hot groups."""

import random
from itertools import groupby

import numpy as np
import plain
import pytest

from sonolith.llm import chat, scratch
from sonolith.llm import repair as R
from sonolith.llm.codes import Assigner, CodeOptions, compress, squared
from sonolith.llm.covertree import LEAST, Points, Search, SearchOptions, Tree, top_products
from sonolith.llm.repair import RepairOptions, repair

VECTORS = "vec_id long, embedding array<float>, label int, x string, key string, cell int, own int, state string"
TURNS = "conv_id long, turn long, role string, text string, ck string, digest string, chunk string, copies string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, "a", "b", 1, 2, "c") for i, v, label in rows], VECTORS)


def turns(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], TURNS)


def listed(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def odd_vectors(n=700, seed=3):
    rnd = random.Random(seed)
    values = [0.0, 0.25, -0.5, 1.0, 1e30, -3e38]
    rows = [(rnd.choice([None, *range(1000)]), [rnd.choice(values[: 4 if k % 50 else 6]) for _ in range(rnd.choice([0, 3, 8, 8, 8]))], rnd.choice([None, 1, 2])) for k in range(n)]
    rows += [(k, v, 1) for k, v in enumerate([None, [None, 1.0], [float("nan")], [float("inf"), 0.0]])]
    return rows + [(5, [1.0] * 8, None)] * 300 + [(k * 50, [0.5] * 8, 7) for k in range(100)]  # copies


@pytest.fixture(scope="module")
def embedded(spark):
    return [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]


@pytest.mark.parametrize("groups", [1, 16])
def test_codes(spark, embedded, groups):
    got = compress(vectors(spark, embedded), CodeOptions(groups=groups)).drop("label")
    assert listed(got) == plain.codes([(i, label, v) for i, v, label in embedded])


@pytest.mark.parametrize("hot", [1000, 2])
def test_codes_of_odd_vectors(spark, hot):
    rows = odd_vectors()
    got = compress(vectors(spark, rows), CodeOptions(entries=40, hot=hot)).drop("label")
    assert listed(got) == plain.codes([(i, label, v) for i, v, label in rows], entries=40)


def test_bounds_hold_and_save_work():
    """Clustered rows: bounds never exceed a true distance, and groups are passed over."""
    rng = np.random.default_rng(1)
    x = (rng.integers(-40, 40, (64, 1, 8)) * 100 + rng.integers(-20, 20, (64, 50, 8))).reshape(-1, 8)
    history = [x[::50][None].copy()]
    own, bound, stamp = np.full(len(x), -1), np.zeros((len(x), 8)), np.zeros((len(x), 8), np.int64)
    for k in range(4):
        a = Assigner(history, 8)
        before = stamp.copy()
        error = a.part(0, x, own, bound, stamp)
        d = squared(x, history[-1][0])
        assert (own == d.argmin(1)).all() and (error == d.min(1)).all()
        for g, members in enumerate(a.members[0]):
            others = np.where(members[None] == own[:, None], np.inf, np.sqrt(d[:, members]))
            if len(members):
                assert (bound[:, g] - a.lost[0][stamp[:, g], g] <= others.min(1) + 1e-6).all()
        if k:
            assert (stamp == before).mean() > 0.8  # not computed again
        sums = np.stack([x[own == e].sum(0) // max(1, (own == e).sum()) for e in range(64)])
        history.append(np.where((np.bincount(own, minlength=64) > 0)[:, None], sums, history[-1][0])[None])


def test_empty_tables(spark):
    none = vectors(spark, [])
    assert compress(none).collect() == top_products(none).collect() == []
    assert compress(vectors(spark, [(1, None, 1)])).collect() == []
    assert repair(turns(spark, [])).collect() == []


@pytest.mark.parametrize("options", [SearchOptions(), SearchOptions(block=40, batch=3, cells=9, fan=3, leaf=4)])
def test_search(spark, embedded, options):
    assert listed(top_products(vectors(spark, embedded), options)) == plain.search([r[:2] for r in embedded])


@pytest.mark.parametrize("options", [SearchOptions(every=10), SearchOptions(every=7, block=30, batch=4, cells=9, fan=3, leaf=4)])
def test_search_odd_vectors(spark, options):
    rows = odd_vectors()
    assert listed(top_products(vectors(spark, rows), options)) == plain.search([r[:2] for r in rows], every=options.every)


def test_search_prunes():
    """In clustered data most pairs of queries and data are never multiplied."""
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(40, 1, 8)) * 1000 + rng.normal(size=(40, 100, 8)) * 5).reshape(-1, 8).astype(np.int64)
    is_query = np.arange(len(x)) % 20 == 0
    tree = Tree(Points(x), is_query, 12, 64)
    assert sorted(tree.queries) == np.flatnonzero(is_query).tolist() and sorted(tree.data) == np.flatnonzero(~is_query).tolist()
    s = Search(tree, np.arange(len(x)), np.zeros(len(x), bool), np.full(len(x), LEAST), 5)
    s.run()
    product = x[tree.queries] @ x[tree.data].T
    assert (s.score == -np.sort(-product, axis=1)[:, :5]).all()
    assert s.met < 0.2 * product.size


def odd_turns(n=1500, seed=4):
    rnd = random.Random(seed)
    texts = [None, "", "a.", "b", "c!\n", " \t", "dd?", "e e.", "é…", "f."]
    rows = [(rnd.choice([None, *range(40)]), rnd.choice([None, *range(9), *range(9)]), rnd.choice(["user", "assistant", "system", None, "", "tool", "u2"]), rnd.choice(texts)) for _ in range(n)]
    return rows + [(1, 4, "user", "long " * 100_000 + ".")] + [(77, t, "user" if t % 2 else "assistant", f"{t}.") for t in range(900)] + [(78, None, "user", "same.")] * 700


@pytest.mark.parametrize("options", [RepairOptions(), RepairOptions(chunk_bits=3, piece=4)])
def test_repair(spark, options):
    """Conversations inside a chunk and over many, with null keys, equal turns and many copies of a row."""
    rows = odd_turns()
    assert {r.conv_id: tuple(r)[1:] for r in repair(turns(spark, rows), options).collect()} == plain.repairs(rows)


def test_repair_of_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert {r.conv_id: tuple(r)[1:] for r in repair(df).collect()} == plain.repairs(rows)


def test_chunks_of_a_hot_conversation(spark):
    """No chunk has more rows than its size, whatever the conversation's length."""
    rows = [(1, t, "user", f"{t}.") for t in range(3000)]
    placed = []
    save = R.scratch.save
    try:
        R.scratch.save = lambda df, name: placed.append(save(df, name)) or placed[-1] if name == "placed" else save(df, name)
        assert repair(turns(spark, rows), RepairOptions(chunk_bits=6)).count() == 1
    finally:
        R.scratch.save = save
    assert max(r["count"] for r in placed[0].groupBy("chunk").count().collect()) <= 64


# ------------------------------------------------------------------ 10
def _viterbi(model, texts):
    """The best roles of all lines of a conversation, in one go."""
    steps = chat._steps(model, texts)
    score, back = model.start + steps[0][1], []
    for move, emit, _, _ in steps[1:]:
        ways = score[:, None] + move
        back.append(ways.argmax(axis=0))
        score = ways.max(axis=0) + emit
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1], steps, float(score.max())


@pytest.mark.parametrize("chunk", [1, 3, 64, 4096])
def test_roles_by_chunks_are_as_good_as_plain_viterbi(spark, chunk):
    rng = random.Random(chunk)
    say = ["User: hi", "what is it?", "Assistant: this.\nand that", "a\nB?\nbot: c\nd", "", None, "system: be kind", "x" * 70, "fine."]
    model = chat.train([[("user", "hi?"), ("assistant", "Hello.\nWell."), ("user", "x")]] * 5, chat.ChatOptions())
    rows = [(c, t, rng.choice(say)) for c, n in enumerate([1, 2, 7, 30, 3, 1, 12]) for t in range(n)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, text string").repartition(5)
    got = {}
    for r in chat.parse_transcripts(df, model, chat.ChatOptions(chunk=chunk)).collect():
        got.setdefault((r.conv_id, r.turn), []).append((r.part, r.role_pred, r.text))
    for c in {r[0] for r in rows}:
        texts = [t for cc, _, t in rows if cc == c]
        path, steps, best = _viterbi(model, texts)
        # the roles of all lines, from the parts: a part's lines are counted by the plain steps
        lines, total, last = [], 0.0, None
        for turn, text in enumerate(texts):
            parts = sorted(got[c, turn])
            bodies = [s[2] for s in chat._steps(model, [text])]
            assert [p[0] for p in parts] == list(range(len(parts)))
            assert "".join(p[2] for p in parts).replace("\n", "") == "".join(bodies).replace("\n", "").strip()
            if len(parts) == 1:
                lines += [parts[0][1]] * len(bodies)
            else:
                lines += [model.roles[path[len(lines) + i]] for i in range(len(bodies))]
                assert [role for role, _ in groupby(lines[-len(bodies) :])] == [p[1] for p in parts]
        for (move, emit, _, _), role in zip(steps, map(model.roles.index, lines), strict=True):
            total += emit[role] + (model.start[role] if last is None else move[last, role])
            last = role
        assert total == best  # sums are exact


def test_hot_conversation_of_null_turns_is_cut_by_rows(spark):
    model = chat.train([], chat.ChatOptions())
    rows = [(None, None, "again")] * 6000 + [(None, i % 3, f"User: {i}") for i in range(3000)] + [(7, 0, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, text string")
    out = chat.parse_transcripts(df, model, chat.ChatOptions(chunk=256))
    assert out.count() == 9001
    saved = [p for p in scratch.saved(spark) if "/placed-" in p][-1]
    sizes = [r["count"] for r in spark.read.parquet(saved).groupBy("chunk").count().collect()]
    assert max(sizes) <= 256 and sum(sizes) == 9001
