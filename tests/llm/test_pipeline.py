"""The pipeline's stages, each on what the one before kept."""

import brute
import corpus_pipeline


def test_stages_against_plain_versions(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [r.asDict() for r in docs.collect()]
        path = f"file://{tmp_path}/{k}"
        stage(spark, docs, "").write.parquet(path)
        docs = spark.read.parquet(path)
        after = [r.asDict() for r in docs.collect()]
        rows = [(r["doc_id"], r["text"]) for r in before]
        if name == "language_id":
            assert len(after) == len(before)  # clean documents stay
        if name == "minhash_near_dedup":
            assert sorted(r["doc_id"] for r in after) == [i for i, _, _, kept in brute.near(rows) if kept]
        if name == "substring_dedup":
            left = {i: n - gone for i, n, gone, _ in brute.substring(rows)}
            assert {r["doc_id"]: len(brute.words(r["text"])) for r in after} == left
        if name == "mix_sources":
            assert {r["doc_id"] for r in after} <= {r["doc_id"] for r in before}
            assert 0.7 < sum(len(brute.words(r["text"])) for r in after) / sum(len(brute.words(t)) for _, t in rows) < 1.3
        if name == "best_fit_packing":
            assert sum(r["piece"] == 0 for r in after) == len(before)
        else:
            assert docs.columns == columns


def test_near_dedup_keeps_one_text_of_each_group(spark):
    """Ids that stand for unrelated texts, and groups without an id."""
    text = lambda g, *tail: " ".join([f"g{g}w{i}" for i in range(60)] + list(tail))
    rows = [
        (1, text(0)), (1, text(1)), (1, text(1).upper()), (2, text(1, "tail")), (2, text(2)), (2, text(2)),
        (None, text(3)), (None, text(3, "tail")), (None, text(3)), (None, text(4)), (None, text(5)), (3, text(5, "tail")),
        (4, ""), (4, " "), (4, ""), (None, None), (None, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    groups = {g: [(i, t) for i, t in got if (t or "").lower().startswith(f"g{g}w0 ")] for g in range(6)}
    assert {g: [i for i, _ in kept] for g, kept in groups.items()} == {0: [1], 1: [1], 2: [2], 3: [None], 4: [None], 5: [3]}
    assert sorted((str(i), str(t)) for i, t in got if not (t or "").strip()) == [("4", ""), ("4", " "), ("None", "None")]
    assert all(row in rows for row in got) and len(got) == 9


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and "sequence_id" in out.columns
