import json

import numpy as np

from quietlines.operators import drift


def test_flooding_uses_types_and_nesting():
    right = drift.Graph({"agent": {"string"}, "input": {"object"}, "input.cmd": {"string"}})
    # Equal starts: the field of the shared type and the field inside the shared parent gain more.
    left = drift.Graph({"agent": {"string"}, "input": {"object"}, "input.a": {"string"}, "input.b": {"number"}, "x": {"string"}})
    start = np.array([[1, 0, 0], [0, 1, 0], [0, 0, 0.6], [0, 0, 0.6], [0, 0, 0.6]])
    got = drift.flood(left, right, start)[:, 2]
    assert got[2] > got[3] and got[2] > got[4]


def test_flooding_reaches_its_fixpoint_within_bounds():
    rng = np.random.default_rng(1)
    left, right = (drift.Graph({f"{p}{i}" if i else "input": {drift.TYPES[i % 5]} for i in range(n)} | {f"input.{p}{i}": {"string"} for i in range(3)}) for p, n in (("a", 9), ("b", 7)))
    start = rng.random((12, 10))
    got = drift.flood(left, right, start)
    assert (got >= 0).all() and (got <= 1).all() and (got != start).any()
    assert drift.flood(left, right, np.zeros((12, 10))).max() == 0.0


EXPECTED = {"agent": "string", "input": "object", "input.command": "string", "text": "string"}


def _field(kind, start=None):
    return {"types": {kind}, "start": start or {}}


def test_a_type_edge_changes_the_choice():
    fields = {"agent": _field("string"), "text": _field("string"), "input": _field("object"), "input.aaa": _field("string", {"input.command": 0.70}), "input.zzz": _field("boolean", {"input.command": 0.72})}
    assert drift.correspondences(fields, EXPECTED)["input.command"][0] == "input.aaa"
    fields["input.aaa"], fields["input.zzz"] = _field("boolean", {"input.command": 0.70}), _field("string", {"input.command": 0.72})
    assert drift.correspondences(fields, EXPECTED)["input.command"][0] == "input.zzz"


def test_a_nesting_edge_changes_the_choice():
    fields = {"agent": _field("string"), "text": _field("string"), "args": _field("object", {"input": 0.60}), "meta": _field("object", {"input": 0.62})}
    assert drift.correspondences(fields, EXPECTED) == {"input": ["meta"]}
    assert drift.correspondences(fields | {f"args{drift.INSIDE}command": _field("string")}, EXPECTED) == {"input": ["args"]}


def test_a_pair_below_the_chance_is_never_accepted():
    fields = {"agent": _field("string"), "input": _field("object"), "text": _field("string"), "input.a": _field("string", {"input.command": drift.CHANCE - 1e-6})}
    assert drift.correspondences(fields, EXPECTED) == {}


def _base(spark, expected, kinds):
    return spark.createDataFrame([(a, f, kinds.get(f, "string")) for a, fields in expected.items() for f in fields], "agent string, field_name string, json_type string")


def test_every_line_is_in_one_table_with_its_fields(spark):
    expected = {"codex": ("agent", "ts", "seq", "input", "input.cmd", "input.cwd"), "claude-code": ("agent", "ts", "type")}
    base = _base(spark, expected, {"seq": "number", "input": "object"})
    at = [f"2025-01-01T00:00:{i:02d}Z" for i in range(12)]
    made = [("plain", {"agent": "codex", "ts": t, "seq": i, "input": {"cmd": f"git log -n {i}", "cwd": f"/srv/a{i}"}}) for i, t in enumerate(at)]
    made += [("moved", {"agent": "codex", "ts": t, "seq": i, "input": {"cmd": f"git log -n {i}", "workdir": f"/srv/a{i}", "more": 1}}) for i, t in enumerate(at)]
    made += [("claude", {"agent": "claude-code", "ts": t, "type": "user"}) for t in at]
    made += [("claude", {"ts": at[0]}), ("moved", {}), ("moved", {"agent": "codex", "input": "git log"}), ("none", {"zzz": 1}), (None, {"agent": "codex", "seq": 7}), ("moved", {"agent": None, "input": {"workdir": "/x"}}), ("claude", {"agent": "codex", "type": "user"}), ("claude", {"agent": 5})]
    rows = [(i, p, json.dumps(x)) for i, (p, x) in enumerate(made)] + [(99, "moved", '{"ts":"\\ud800x"}'), (100, "moved", "{")]
    lines = spark.createDataFrame(rows, "line_id long, relative_path string, raw string")
    got = {r["line_id"]: r for r in drift.consistent_table(lines, base, "codex").collect()}
    assert set(got) == {*range(24), 37, 38, 40, 41, 99}
    assert (got[12]["input.cmd"], got[12]["input.cwd"]) == ("git log -n 0", "/srv/a0") == (got[0]["input.cmd"], got[0]["input.cwd"])
    assert json.loads(got[12]["input"]) == {"cmd": "git log -n 0", "cwd": "/srv/a0", "more": 1} and got[12]["extra"] is None
    assert got[38]["input"] == "git log" and got[38]["input.cmd"] is None and got[40]["seq"] == 7 and got[41]["input.cwd"] == "/x" and got[99]["ts"] == "?x"
    assert set(r["line_id"] for r in drift.consistent_table(lines, base, "claude-code").collect()) == {*range(24, 37), 42, 43}


def test_a_wide_baseline_and_a_file_without_it(spark):
    expected = {"codex": ["agent", *(f"field{i}" for i in range(40))]}
    base = _base(spark, expected, {})
    made = [("all", {"agent": "codex"} | {f"field{i}": f"v {i}" for i in range(40)})] * 3 + [("few", {"agent": "codex", "field0": "v 0"})]
    lines = spark.createDataFrame([(i, p, json.dumps(x)) for i, (p, x) in enumerate(made)], "line_id long, relative_path string, raw string")
    got = [(r["relative_path"], r["change_kind"]) for r in drift.schema_changes(lines, base).collect()]
    assert got == [("few", "removed")] * 39
    assert drift.schema_changes(lines, base.limit(0)).count() == 0


def test_data_made_keys_are_additions_that_are_not_gathered(spark):
    base = _base(spark, {"codex": ("agent", "ts")}, {})
    made = [("f", {"agent": "codex", "ts": "2025-01-01", f"key {i}": i, "input": {f"k{i}": 1}}) for i in range(300)]
    lines = spark.createDataFrame([(i, p, json.dumps(x)) for i, (p, x) in enumerate(made)], "line_id long, relative_path string, raw string")
    stats = drift.field_statistics(lines, drift.read_baseline(base)).persist()
    assert drift.scored_extras(stats, drift.read_baseline(base)).where("size(start) > 0").count() == 0
    got = {(r["field_name"], r["change_kind"]) for r in drift.schema_changes(lines, base).collect()}
    assert got == {(f"key {i}", "added") for i in range(300)} | {("input", "added")}


def test_nulls_and_repeats_in_the_baseline(spark):
    rows = [("codex", "agent", "string"), ("codex", "agent", "string"), ("codex", "x", None), (None, "y", "string"), ("codex", None, "string")]
    base = spark.createDataFrame(rows, "agent string, field_name string, json_type string")
    lines = spark.createDataFrame([(1, "f", '{"agent":"codex","x":[1]}', 0), (1, "f", '{"agent":"codex","x":[1]}', 0), (2, "g", '{"agent":"codex"}', 0), (3, None, None, 0)], "line_id long, relative_path string, raw string, field int")
    got = {(r["relative_path"], r["field_name"], r["change_kind"]) for r in drift.schema_changes(lines, base).collect()}
    assert got == {("g", "x", "removed")}
    table = drift.consistent_table(lines, base, "codex").collect()
    assert [(r["line_id"], r["x"]) for r in sorted(table, key=lambda r: r["line_id"])] == [(1, "[1]"), (1, "[1]"), (2, None)]
