"""Nulls, empty and long texts, repeated rows, empty tables, clashing columns: every operator and stage."""

import brute
import corpus_pipeline
import pytest
from conftest import SAME, edge_rows

from sonolith.llm import chat, langid
from sonolith.llm.extraction import extract
from sonolith.llm.minhash import near_duplicates
from sonolith.llm.mixing import mix_sources
from sonolith.llm.packing import pack
from sonolith.llm.quality import judge
from sonolith.llm.queries import tokenizer_path
from sonolith.llm.sharding import interleave
from sonolith.llm.spotsigs import fingerprints, similar
from sonolith.llm.substring import remove_repeats

PLAIN = [(r[0], r[1]) for r in edge_rows()]
OPERATORS = {
    "substring": remove_repeats,
    "mix": mix_sources,
    "spots": fingerprints,
    "similar": similar,
    "language": lambda d: langid.predict(d, langid.fit(d)),
    "shards": lambda d: interleave(d, 24),
    "pack": lambda d: pack(d, tokenizer_path()),
    "near": near_duplicates,
    "quality": judge,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(empty, name):
    assert OPERATORS[name](empty).collect() == []


@pytest.mark.parametrize("name", [n for n in OPERATORS if n != "pack"])
def test_one_row_per_input_row(edge, name):
    assert len(OPERATORS[name](edge).collect()) == len(PLAIN)


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, edge, empty, k):
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, edge, "")
    rows = out.collect()
    if k < len(corpus_pipeline.STAGES) - 1:
        assert out.columns == edge.columns
        assert {r["odd name"] for r in rows} <= {"clash"}
    assert stage(spark, empty, "").collect() == []


def test_substring(edge):
    got = sorted((tuple(r) for r in remove_repeats(edge).collect()), key=str)
    assert got == brute.substring(PLAIN)


def test_near(edge):
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(edge).collect()}
    n = len(brute.shingle_set(SAME))
    assert {(7, n, 7, True), (8, n, 7, False), (13, n, 7, False), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (None, 0, None, True)} <= got
    assert (None, n + 1, 7, False) in got  # a copy with one more word


def test_near_stage_keeps_one_row_of_each_group(spark, edge):
    rows = corpus_pipeline.near_dedup(spark, edge, "").collect()
    assert sum((r.text or "").lower().startswith("p0 p1 p2") for r in rows) == 1


def test_language(edge):
    got = {r.doc_id: r for r in langid.predict(edge, langid.fit(edge)).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1, 2, 3, 11))
    assert got[9].lang_pred == "en"


def test_language_without_labels(edge):
    rows = langid.predict(edge, None).collect()
    assert {(r.lang_pred, r.score, r.rejected) for r in rows} == {("und", 0.0, True)}


def test_shards(edge):
    rows = interleave(edge, 24).collect()
    assert sorted((r.shard, r.slot) for r in rows) == sorted((k * 24 // len(rows), 0) for k in range(len(rows)))
    assert {(r.size, r.text_crc32) for r in rows if r.doc_id in (1, 2)} == {(8, 0)}


def test_quality(edge):
    got = {r.doc_id: r for r in judge(edge).collect() if r.doc_id}
    assert got[1].n_words == got[2].n_words == got[3].n_words == 0 and not got[1].kept
    assert got[12].n_words == 5 and got[11].n_symbols == 3 and got[10].n_symbols == 3
    assert got[7].kept and got[9].base_failed


def test_spots(edge):
    got = {r.doc_id: r for r in fingerprints(edge).collect() if r.doc_id}
    assert got[1].fingerprint == got[2].fingerprint == "" and got[3].fingerprint != ""
    assert got[1].n_chars == 0 and got[2].near_next == 1.0
    assert got[7].fingerprint == got[8].fingerprint


PAGES = [(1, "u1", None), (2, None, ""), (3, "u3", "<p>" * 3000 + "x"), (4, "u4", "<article><h1>T&amp;t</h1><p>One  two\n three<br>four</p>"), (4, "u4", "plain words only"), (None, "u5", "</div></p>< <b"), (6, "u6", "<!-- <article>")]


def test_pages(spark):
    df = spark.createDataFrame([(*p, "clash", 1) for p in PAGES], "page_id long, url string, html string, text string, n_chars long")
    rows = extract(df).collect()
    assert len(rows) == len(PAGES)
    got = {(r.page_id, r.url): r for r in rows}
    assert got[1, "u1"].text == "" and got[2, None].n_chars == 0
    assert extract(df.limit(0)).collect() == []


def test_turns(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "hi"), (1, 1, None, "hi"), (None, 0, "user", ""), (2, None, "x", "a <|user|> b"), (2, 5, "user", "z")]
    df = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], "conv_id long, turn int, role string, text string, part string, chunk int, first int")
    out = chat.parse_transcripts(df, chat.fit(df)).collect()
    assert len(out) == len(rows)
    assert all(r.rendered.count("<|") == 2 for r in out)
    assert chat.parse_transcripts(df.limit(0), chat.fit(df.limit(0))).collect() == []
