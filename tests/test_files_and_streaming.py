import json
import os
import time
import zipfile
from pathlib import Path

import pytest

from quietlines import api
from quietlines.config import RedactionConfig
from quietlines.operators import reports
from quietlines.sinks import files as sink
from quietlines.sources import discovery
from quietlines.sources.trace_lines import read_lines, register
from quietlines.streaming import scrub


def _tree(root: Path) -> None:
    good = {
        ".codex/sessions/session.jsonl": b'{"content":"PASSWORD=abcdefgh"}\r\n\n{"a":1}',
        "sub/_u.ndjson": "﻿bom\rsecond\nthird\n".encode(),
        "a[1]/b c.JSON": b"\xff\xfe bad bytes\n",
        "notes.txt": b"no",
        "bin.jsonl": b"\0\1",
        ".hidden/x.jsonl": b"{}",
        "node_modules/x.jsonl": b"{}",
        ".dot.jsonl": b"{}",
    }
    for name, data in good.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)


def test_discovery_reads_what_the_reader_should(spark, tmp_path):
    _tree(tmp_path)
    found = {r["relative_path"]: r for r in discovery.discover_path(spark, tmp_path).collect()}
    assert set(found) == {"sub/_u.ndjson", "a[1]/b c.JSON"}
    assert found["sub/_u.ndjson"]["line_count"] == 2 and found["sub/_u.ndjson"]["status"] == "ready" and found["a[1]/b c.JSON"]["agent_guess"] == "Unknown"
    codex = discovery.discover_path(spark, tmp_path / ".codex").collect()
    assert [(r["relative_path"], r["agent_guess"], r["line_count"]) for r in codex] == [("sessions/session.jsonl", "Codex", 3)]
    assert discovery.discover_path(spark, tmp_path / "missing").count() == 0
    one = discovery.discover_uploads(spark, [None, str(tmp_path / "sub/_u.ndjson"), str(tmp_path / "a[1]/b c.JSON")])
    assert {r["relative_path"] for r in one.collect()} == {"sub/_u.ndjson", "a[1]/b c.JSON"}
    lines = read_lines(spark, discovery.discover_path(spark, tmp_path))
    assert {(r["relative_path"], r["line_number"]): r["raw"] for r in lines.collect()} == {("sub/_u.ndjson", 1): "﻿bom", ("sub/_u.ndjson", 2): "second", ("sub/_u.ndjson", 3): "third", ("a[1]/b c.JSON", 1): "�� bad bytes"}


def test_selection(spark):
    files = spark.createDataFrame([("a.jsonl", "a.jsonl"), ("b.json", "b.json"), (None, None)], "relative_path string, filename string")
    assert [r["selected"] for r in discovery.with_selection(files).orderBy("relative_path").collect()] == [False, True, False]
    marks = spark.createDataFrame([("yes", "b.json"), ("0", "a.jsonl"), (None, "x"), ("1", "b.json")], "selected string, relative_path string")
    assert [r["relative_path"] for r in discovery.select_files(files, marks).collect()] == ["b.json"]


def test_scrub_files_end_to_end(spark, tmp_path):
    _tree(tmp_path / "in")
    (tmp_path / "in/big.jsonl").write_text("".join(json.dumps({"n": i, "t": "x"}) + "\n" for i in range(3000)))
    report = api.scrub_files(spark, [tmp_path / "in", tmp_path / "in/.codex"], tmp_path / "out", RedactionConfig())
    by_path = {f["input_relative_path"]: f for f in report["files"]}
    session = by_path["sessions/session.jsonl"]
    assert (session["lines_processed"], session["invalid_json_lines"], session["counts_by_regex_secret_rule"]) == (3, 1, {"env_secret_assignment": 1})
    assert session["warnings"] == ["Line 2 is invalid JSON; sanitized as raw text."]
    assert report["aggregate_totals"]["files_processed"] == 4 and "abcdefgh" not in json.dumps(report)
    big = (tmp_path / "out/sanitized/big.jsonl").read_text().splitlines()
    assert [json.loads(x)["n"] for x in big] == list(range(3000)) and by_path["big.jsonl"]["bytes_out"] == (tmp_path / "out/sanitized/big.jsonl").stat().st_size
    with zipfile.ZipFile(tmp_path / "out/sanitized_sessions.zip") as z:
        assert set(z.namelist()) == {*by_path, "redaction_report.json", "README_FIRST.txt"}
        assert z.read("sessions/session.jsonl").decode() == '{"content":"PASSWORD=<REDACTED:env_secret_assignment>"}\n\n{"a":1}\n'
    with pytest.raises(ValueError):
        api.scrub_files(spark, [tmp_path / "missing"], tmp_path / "o", RedactionConfig())
    with pytest.raises(ValueError):
        api.scrub_files(spark, [tmp_path / "in"], tmp_path / "o", RedactionConfig(regex_enabled=False, model_enabled=False))


def test_safe_paths_and_workspaces(monkeypatch, tmp_path):
    assert sink.safe_relative("/../a/./b") == "a/b" and sink.safe_relative("..") == "sanitized.jsonl"
    monkeypatch.setattr("tempfile.tempdir", str(tmp_path))
    old = tmp_path / (sink.WORKSPACE + "old")
    old.mkdir()
    os.utime(old, (time.time() - 7 * 3600,) * 2)
    assert sink.make_workspace().is_dir() and not old.exists()


def test_reports(spark):
    rows = [("a", i, "x", "y", i > 1, {"k": 1}, {}) for i in range(1, 140)] + [("b", 1, "{}", "{}", False, {}, {"m": 2})]
    lines = spark.createDataFrame(rows, "relative_path string, line_number long, raw string, output string, invalid_json boolean, regex_counts map<string,bigint>, pii_counts map<string,bigint>")
    got = {r["input_relative_path"]: r for r in reports.file_report(lines).collect()}
    assert len(got["a"]["warnings"]) == 101 and got["a"]["warnings"][-1] == reports.OMITTED and got["a"]["counts_by_regex_secret_rule"] == {"k": 139} and got["a"]["invalid_json_lines"] == 138
    assert got["b"]["warnings"] == [] and got["b"]["counts_by_pii_label"] == {"m": 2} and got["b"]["bytes_in"] == 3
    assert reports.output_preview(lines, "a", 2) == "y\ny"
    two = spark.createDataFrame(
        [(10, 11, 2, 1, ["e"], None, 0.1, {"email": 1}, {"openai_api_key": 2}), (20, None, 3, 0, None, ["w"], 0.2, {}, {"openai_api_key": 1, "jwt": 1})],
        "bytes_in long, bytes_out long, lines_processed long, invalid_json_lines long, errors array<string>, warnings array<string>, duration_seconds double, counts_by_pii_label map<string,bigint>, counts_by_regex_secret_rule map<string,bigint>",
    )
    total = reports.aggregate_report(two).first().asDict()
    assert (total["files_processed"], total["bytes_in"], total["lines_processed"], total["errors"], total["warnings"]) == (2, 30, 5, 1, 1)
    assert total["counts_by_regex_secret_rule"] == {"jwt": 1, "openai_api_key": 3}
    assert reports.aggregate_report(two.limit(0)).first()["files_processed"] == 0


def test_stream_delivers_each_file_once(spark, tmp_path):
    _tree(tmp_path / "in")
    register(spark)
    got = []
    stream = spark.readStream.format("trace_lines").option("path", str(tmp_path / "in/.codex")).load()
    query = scrub.scrub_stream(stream, RedactionConfig(), lambda batch, n: got.extend(batch.collect()), str(tmp_path / "cp"), processingTime="1 second")
    try:
        for _ in range(60):
            if len(got) >= 3:
                break
            time.sleep(0.5)
        time.sleep(2)
    finally:
        query.stop()
    assert len(got) == 3 and got[0]["output"] == '{"content":"PASSWORD=<REDACTED:env_secret_assignment>"}'


def test_streamed_counts_by_window(spark, tmp_path):
    spark.createDataFrame([("f", 1, "{}", "2025-01-01 00:10:00"), ("f", 2, "no", "2025-01-01 00:20:00"), ("f", 3, "{}", "2025-01-09 01:00:00")], "relative_path string, line_number long, raw string, at string").selectExpr("relative_path", "line_number", "raw", "timestamp(at) AS at").write.parquet(str(tmp_path / "t"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "t")).schema).parquet(str(tmp_path / "t"))
    counted = scrub.counts_by_window(scrub.sanitized_stream(stream, RedactionConfig()), "at")
    query = counted.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r["lines"], r["invalid_json_lines"]) for r in spark.table("windows").collect()) == [(1, 0), (2, 1)]


def test_one_broken_file_leaves_the_others(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    (root / "good.jsonl").write_text('{"a":"TOKEN=abcdefgh"}\n')
    (root / "deep.jsonl").write_text('{"a":' * 3000 + "1" + "}" * 3000 + "\n")
    (root / "odd.jsonl").write_text('{"a":"\\ud800"}\n')
    (root / "gone.jsonl").write_text("{}\n")
    files = discovery.list_roots([root])
    (root / "gone.jsonl").unlink()
    rows = read_lines(spark, spark.createDataFrame([(f.path, f.relative_path) for f in files], "path string, relative_path string"))
    out = {r["input_relative_path"]: r for r in reports.file_report(api.sanitize_lines(rows, RedactionConfig())).collect()}
    assert out["gone.jsonl"]["errors"] == ["File processing failed: No such file or directory"] and out["gone.jsonl"]["lines_processed"] == 0
    assert all(not out[n]["errors"] and out[n]["lines_processed"] == 1 for n in ("good.jsonl", "deep.jsonl", "odd.jsonl"))
    assert {r["error"] for r in api.sanitize_lines(rows, RedactionConfig(model_enabled=False)).where("relative_path = 'gone.jsonl'").collect()} == {"No such file or directory"}


def test_a_file_that_vanishes_is_reported_and_not_packaged(spark, tmp_path, monkeypatch):
    root = tmp_path / "in"
    root.mkdir()
    (root / "a.jsonl").write_text('{"a":1}\n')
    (root / "b.jsonl").write_text('{"a":1}\n')
    found = api.discover_roots

    def then_gone(spark, roots):
        files = found(spark, roots).persist()
        files.count()
        (root / "b.jsonl").unlink()
        return files

    monkeypatch.setattr(api, "discover_roots", then_gone)
    report = api.scrub_files(spark, [root], tmp_path / "out", RedactionConfig())
    by_path = {f["input_relative_path"]: f for f in report["files"]}
    assert by_path["b.jsonl"]["errors"] == ["File processing failed: No such file or directory"] and by_path["a.jsonl"]["errors"] == []
    assert (tmp_path / "out/sanitized/a.jsonl").read_text() == '{"a":1}\n' and not (tmp_path / "out/sanitized/b.jsonl").exists()
    assert report["aggregate_totals"]["errors"] == 1


def test_two_roots_with_one_name(spark, tmp_path):
    for folder, text in (("one/logs", "first"), ("two/logs", "second")):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "s.jsonl").write_text(f'{{"a":"{text}"}}\n')
    report = api.scrub_files(spark, [tmp_path / "one/logs", tmp_path / "two/logs", tmp_path / "one/logs"], tmp_path / "out", RedactionConfig())
    names = [f["input_relative_path"] for f in report["files"]]
    assert names == ["logs/s.jsonl", "s.jsonl"]
    assert [(tmp_path / "out/sanitized" / n).read_text() for n in names] == ['{"a":"second"}\n', '{"a":"first"}\n']


def test_what_a_caller_may_hand_over(spark):
    import pandas as pd

    class Upload:
        name = "/x/b.jsonl"

    assert discovery.named_files(None) == [] and discovery.named_files("a") == ["a"] and discovery.named_files(["a", Upload(), 3]) == ["a", "/x/b.jsonl"]
    rows = [[True, "Codex", "a.jsonl"], ["no", "Pi Agent", "b.jsonl"], [True]]
    for table in (rows, {"data": rows}, pd.DataFrame(rows[:2])):
        got = [tuple(r) for r in discovery.selection_table(spark, table).collect()]
        assert got == [("True", "a.jsonl"), ("no", "b.jsonl")]
    assert discovery.selection_table(spark, None).count() == 0
    samples = discovery.discover_samples(spark)
    assert {(r["agent_guess"], r["line_count"]) for r in samples.collect()} >= {("Codex", 3), ("Claude Code", 3)}
    table = reports.rows_for_table(samples)
    assert table.columns == ["selected", "agent_guess", "relative_path", "filename", "size_kb", "line_count", "status"]
    assert discovery.select_files(samples, discovery.selection_table(spark, table)).count() == 3


def test_sample_sessions_hold_every_rule(spark):
    lines = api.sanitize_lines(read_lines(spark, discovery.discover_samples(spark)), RedactionConfig())
    found = {k for r in lines.collect() for k in r["regex_counts"]}
    from quietlines.functions.rules import RULE_NAMES

    assert found == set(RULE_NAMES)


def test_progress_events_and_running_totals(spark):
    rows = [("a", i, {"k": 1} if i % 2 else {}, {}) for i in range(1, 251)] + [("b", 1, {}, {"m": 3})]
    lines = spark.createDataFrame(rows, "relative_path string, line_number long, regex_counts map<string,bigint>, pii_counts map<string,bigint>")
    got = [(r["relative_path"], r["line_number"], r["percent"], r["regex_counts"], r["pii_counts"]) for r in reports.progress_events(lines, 100).orderBy("relative_path", "line_number").collect()]
    assert got == [("a", 1, 0, 1, 0), ("a", 100, 40, 50, 0), ("a", 200, 80, 100, 0), ("a", 250, 100, 125, 0), ("b", 1, 100, 0, 3)]
    files = spark.createDataFrame([(f"f{i:03d}", i, i % 3) for i in range(100)], "input_relative_path string, lines_processed long, invalid_json_lines long").repartition(7)
    total = reports.running_totals(files).orderBy("input_relative_path").collect()
    assert [r["files_so_far"] for r in total] == list(range(1, 101)) and [r["lines_so_far"] for r in total] == [sum(range(i + 1)) for i in range(100)]


def test_progress_is_debounced_and_ends_with_all_rows():
    now, told = [0.0], []
    listener = scrub.ProgressListener(lambda batch, rows: told.append((batch, rows)), interval=10, debounce=5.0, clock=lambda: now[0])
    for batch, (rows, at) in enumerate([(0, 0.0), (1, 1.0), (20, 2.0), (20, 7.0), (5, 20.0)]):
        now[0] = at
        listener.seen(batch, rows)
    listener.onQueryTerminated(None)
    assert told == [(1, 1), (3, 41), (4, 46)]


def test_checkpoints_need_a_shared_folder_on_a_cluster(spark):
    from types import SimpleNamespace

    from quietlines.plans.tables import durable

    unset = SimpleNamespace(isEmpty=lambda: True)
    context = SimpleNamespace(_jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: unset)), getConf=lambda: SimpleNamespace(get=lambda name: None), master="spark://host:7077")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        durable(SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=context)))
