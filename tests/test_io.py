"""Label/note files (S6-S8) and window export."""

import json
import os
import tempfile

from sonolith.operators.explore import export_csv
from sonolith.sources.feedback_io import LABEL_FIELDS, read_array_documents, read_records, write_records


def test_read_array_with_bom_and_junk(spark):
    d = tempfile.mkdtemp(prefix="sonolith-io-")
    path = os.path.join(d, "labels.json")
    recs = [{"label_id": "LBL-1", "pre_failure_hours": 12, "event_start": "2024-01-01T00:00:00"}, 5, "x", {"label_id": "LBL-2"}]
    with open(path, "w", encoding="utf-8-sig") as f:
        json.dump(recs, f)
    got = sorted((r.label_id, r.pre_failure_hours) for r in read_records(spark, path, LABEL_FIELDS).collect())
    assert got == [("LBL-1", "12"), ("LBL-2", None)]


def test_non_list_and_missing(spark):
    d = tempfile.mkdtemp(prefix="sonolith-io-")
    path = os.path.join(d, "labels.json")
    with open(path, "w") as f:
        json.dump({"label_id": "not-a-list"}, f, indent=2)
    assert read_records(spark, path, LABEL_FIELDS).count() == 0
    assert read_records(spark, os.path.join(d, "absent.json"), LABEL_FIELDS).count() == 0


def test_arrays_are_cut_at_braces_outside_strings(spark):
    d = tempfile.mkdtemp(prefix="sonolith-io-")
    texts = ['a } b', 'say \\"}\\" \\\\', "{[", "", "x" * 5000, "line\nbreak }", "]"]
    recs = [{"label_id": f"L{k}", "notes": texts[k % 7], "extra": [{"label_id": "inner"}, [{}], {"a": {"b": "}"}}]} for k in range(300)]
    mixed = [v for r in recs for v in (r, 1, "}", [{"label_id": "nested"}], None)]
    docs = {
        "ok": json.dumps(mixed, indent=1), "empty_list": "[ ]", "empty": "", "scalars": '[1, "}{", null]', "object": json.dumps(recs[0]),
        "cut": json.dumps(recs)[:-40], "no_comma": '[{"label_id": "q"} {"label_id": "r"}]', "bad_element": '[{"label_id": "q"}, {"label_id" 1}]', "word": "labels",
    }
    for name, text in docs.items():
        with open(os.path.join(d, name), "w", encoding="utf-8") as f:
            f.write(text)
    whole = read_array_documents(spark, d, LABEL_FIELDS).collect()
    assert sorted((r.label_id, r.notes) for r in whole) == sorted((r["label_id"], r["notes"]) for r in recs)
    for name in set(docs) - {"ok"}:
        assert read_records(spark, os.path.join(d, name), LABEL_FIELDS).count() == 0, name


def test_write_then_read_round_trip(spark):
    d = tempfile.mkdtemp(prefix="sonolith-io-")
    df = spark.createDataFrame([("LBL-A", "Stage 1"), ("LBL-B", "Manuell")], "label_id string, source_stage string")
    write_records(df, os.path.join(d, "v1"))
    got = sorted(r.label_id for r in read_records(spark, os.path.join(d, "v1"), LABEL_FIELDS).collect())
    assert got == ["LBL-A", "LBL-B"]


def test_export_csv(spark):
    d = tempfile.mkdtemp(prefix="sonolith-io-")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "row_id long, v string")
    export_csv(df, os.path.join(d, "win"))
    back = spark.read.option("header", True).csv(os.path.join(d, "win"))
    assert sorted(r.v for r in back.collect()) == ["a", "b"] and back.columns == ["row_id", "v"]
