import os

import pytest

from quietlines.llm import packing, pii, splitting, subjects, tokens


def test_limits_without_id_and_twice(spark):
    if not os.path.exists(tokens.VOCABULARY):
        pytest.skip("no vocabulary")
    docs = spark.createDataFrame([(1, "word " * 30, 9), (1, "word " * 30, 9), (None, "x", 9), (2, None, 9)], "doc_id long, text string, container_id int")
    limits = spark.createDataFrame([(None, 16), (1, 16), (1, 16), (1, 8), (2, None)], "limit_id long, capacity_tokens long")
    rows = packing.pack(docs, limits).collect()
    assert {(r["limit_id"], r["capacity_tokens"]) for r in rows} == {(1, 16)}
    fill = {}
    for r in rows:
        fill[r["container_id"]] = fill.get(r["container_id"], 0) + r["n_tokens"]
    assert max(fill.values()) <= 16 and sum(r["n_tokens"] for r in rows if r["doc_id"] == 1) == 2 * len(tokens.loaded(open(tokens.VOCABULARY, "rb").read()).encode("word " * 30))
    assert [r["n_tokens"] for r in rows if r["doc_id"] == 2] == [0] and len([r for r in rows if r["doc_id"] is None]) == 1


def test_configurations_listed_twice(spark):
    sessions = spark.createDataFrame([(1, "a", "x" * 30), (None, "a", "x" * 30)], "row_id long, relative_path string, content string")
    files = spark.createDataFrame([("a", 1), ("a", 1), ("b", None)], "relative_path string, config_id long")
    configs = spark.createDataFrame([(1, 20, 2), (1, 20, 2), (1, 10, 2), (None, 5, 0), (2, None, None)], "config_id long, chunk_size long, overlap_chars long")
    got = splitting.oversized(sessions, files, configs).collect()
    assert sorted((r["row_id"] or 0, r["chunk_size"]) for r in got) == [(0, 20), (1, 20)]


def test_subjects_with_nulls(spark):
    docs = spark.createDataFrame([(i, "The court met. The court met again." if i % 2 else "We sailed home. We sailed out.") for i in range(40)] + [(None, "court"), (50, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i, "law" if i % 2 else "sea", None) for i in range(40)] + [(98, None, "law", None), (99, 3, None, None)], "label_id long, doc_id long, subject_label string, annotator string")
    areas = spark.createDataFrame([("law", None), ("sea", "ships"), (None, "nothing")], "subject string, covers string")
    got = {(r["doc_id"], r["subject"]) for r in subjects.find_subjects(docs, labels, areas).collect()}
    assert got == {(i, "law" if i % 2 else "sea") for i in range(40)} | {(None, "law")}


def test_persons_of_rows_without_keys(spark):
    text = "Author: Karen Ostsen <karen@post.example>"
    df = spark.createDataFrame([(None, None, text)] * 3 + [("t", i, "Nothing here.") for i in range(5)], "tbl string, row_id long, text string")
    found = pii.find_pii(df).collect()
    assert len(found) == 3 and all({s["pii_kind"] for s in r["spans"]} >= {"email"} for r in found)
