import csv
import io
import json
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from quietlines.operators import drift, rejects


def strict_json(text: str) -> bool:
    try:
        json.loads(text, parse_constant=lambda c: 1 / 0)
    except (ValueError, ZeroDivisionError):
        return False
    return True


BITS = st.lists(st.sampled_from(list('{}[]:,"\\ \t\n01.-+eE') + ['"a"', "true", "null", "NaN", "\\u00e9", "\\x", "﻿", "\x00", "é", " "]), max_size=14).map("".join)


@settings(max_examples=600, deadline=None)
@given(st.one_of(BITS, st.recursive(st.none() | st.booleans() | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=4), lambda v: st.lists(v, max_size=3) | st.dictionaries(st.text(max_size=3), v, max_size=3), max_leaves=8).map(json.dumps)))
def test_scanner_equals_a_strict_parser(text):
    assert (rejects.scan_json(text) is None) == strict_json(text)


def test_json_lines(spark):
    deep = "[" * 3000 + "]" * 3000
    wide = '{"a":"' + "\\n" * 100_000 + '"}'
    cases = {'{"a":1}': None, " 1 ": None, deep: None, wide: None, '{"a":[[[[[[1]]]]]]}': None, "": "blank line", " ": "blank line", "﻿{}": "byte order mark", "{} x": "trailing content", '{"a":1,}': "trailing comma", "{'a':1}": "unquoted key",
             '{"a" 1}': "missing colon", '{"a":1 "b":2}': "missing comma", '{"a":"\\x"}': "bad escape", '{"a":"\t"}': "control character in string", '{"a":NaN}': "bad value", '{"a":{"b":[1,': "truncated", "[1,]": "trailing comma", deep[:-1]: "truncated"}
    rows = [(i, t, "x") for i, t in enumerate(cases)] + [(99, None, "x"), (100, "", "again")]
    df = spark.createDataFrame(rows, "line_id int, raw string, reason string")
    got = {r["line_id"]: (r["reason"], r["broken_field"]) for r in rejects.rejected_lines(df).collect()}
    assert {i: got.get(i, (None,))[0] for i, _ in enumerate(cases)} == dict(enumerate(cases.values()))
    assert got[99] == ("null", None) and got[100][0] == "blank line" and got[list(cases).index('{"a":{"b":[1,')][1] == "a.b"
    assert {r["line_id"] for r in rejects.valid_lines(df).collect()} == {i for i, v in enumerate(cases.values()) if v is None}
    assert rejects.rejected_lines(df.limit(0)).count() == 0


GOOD = 'a/b.jsonl,"c, d.jsonl",10,"11",3,1,[],"[""line 1: """,1.5,{},"{""jwt"": 2}"'.replace('"[""line 1: """', '"[""line 1: \\""x\\"""", ""b""]"')


def test_records(spark):
    changed = {
        GOOD: (None, None),
        GOOD.replace("10,", "1o,", 1): ("invalid value of bytes_in", "bytes_in"),
        GOOD.replace("1.5", "1,5"): ("wrong column count", "counts_by_pii_label"),
        GOOD + ",x": ("wrong column count", "counts_by_regex_secret_rule"),
        GOOD[:-1]: ("broken quoting", "counts_by_regex_secret_rule"),
        GOOD.replace("[]", "[1]"): ("invalid value of errors", "errors"),
        GOOD.replace("{}", '"{""a"": -1}"'): ("invalid value of counts_by_pii_label", "counts_by_pii_label"),
        GOOD.replace("a/b.jsonl", '""', 1): ("invalid value of input_relative_path", "input_relative_path"),
        "": ("blank record", "input_relative_path"),
        '"' + "x" * 200_000: ("broken quoting", "input_relative_path"),
    }
    rows = [(i, t) for i, t in enumerate(changed)] + [(99, None)]
    df = spark.createDataFrame(rows, "record_id int, raw string")
    got = {r["record_id"]: (r["reason"], r["broken_field"]) for r in rejects.check_records(df).collect()}
    assert [got[i] for i in range(len(changed))] == list(changed.values()) and got[99] == ("null", None)
    loaded = rejects.load_records(df).collect()
    assert len(loaded) == 1 and loaded[0]["output_relative_path"] == "c, d.jsonl" and loaded[0]["bytes_out"] == 11 and loaded[0]["warnings"] == ['line 1: "x"', "b"] and loaded[0]["counts_by_regex_secret_rule"] == {"jwt": 2}
    assert next(csv.reader(io.StringIO(GOOD)))[1] == "c, d.jsonl"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", '"', '""', ",", "\n", "1", "[]", "{}", '"1"', " "]), max_size=12).map("".join))
def test_generic_field_pattern_is_rfc_4180(text):
    pattern = re.compile(rejects.record_pattern(["any", "any"]).replace(r"\z", r"\Z"))
    brute = re.fullmatch(r'(?:"(?:[^"]|"")*"|[^",\r\n]*),(?:"(?:[^"]|"")*"|[^",\r\n]*)', text)
    assert bool(pattern.search(text)) == bool(brute)


def test_line_report(spark):
    rows = [(i, "f", i, "" if i > 1 else "{}") for i in range(1, 6)] + [(9, "g", 1, "{}")]
    df = spark.createDataFrame(rows, "line_id long, relative_path string, line_number long, raw string")
    got = {r["relative_path"]: r for r in rejects.line_report(df, rejects.rejected_lines(df), most=2).collect()}
    assert got["f"]["errors"] == ["line 2: blank line", "line 3: blank line", "2 more omitted"] and got["f"]["invalid_json_lines"] == 4
    assert got["g"]["errors"] == [] and got["g"]["invalid_json_lines"] == 0


def _lines():
    uid = "0f0f0f0f-1111-2222-3333-%012d"
    plain = [{"agent": "pi-agent", "ts": f"2025-01-01T00:00:{i:02d}Z", "uuid": uid % i, "event": ("prompt", "tool", "result")[i % 3], "text": f"Hello there {i}"} for i in range(12)]
    out = [("plain", json.dumps(x)) for x in plain]
    for x in plain:
        y = dict(x)
        y["event_type"] = y.pop("event")
        y["extra"] = {"a": 1}
        y["text"] = [y["text"]]
        del y["uuid"]
        out.append(("drifted", json.dumps(y)))
    out += [("plain", "broken {"), ("plain", "3"), ("plain", '{"agent":"other","zzz":1}'), ("unknown", '{"agent":"other","zzz":1}'), (None, "{}"), ("deep", '{"agent":"pi-agent","ts":"2025-01-01","x":' + "[" * 50_000 + "]" * 50_000 + "}")]
    return out


def test_drift(spark):
    lines = spark.createDataFrame([(i, p, r) for i, (p, r) in enumerate(_lines())], "line_id long, relative_path string, raw string")
    base = spark.createDataFrame([("pi-agent", f, t) for f, t in (("agent", "string"), ("ts", "string"), ("uuid", "string"), ("event", "string"), ("text", "string"))], "agent string, field_name string, json_type string")
    got = {}
    for r in drift.schema_changes(lines, base).collect():
        got.setdefault(r["relative_path"], set()).add((r["field_name"], r["change_kind"]))
    assert got["plain"] == {("zzz", "added")}
    assert got["drifted"] == {("event", "renamed"), ("extra", "added"), ("text", "retyped"), ("uuid", "removed")}
    assert "unknown" not in got and ("x", "added") in got["deep"] and ("uuid", "removed") in got["deep"]
    table = {r["line_id"]: r for r in drift.consistent_table(lines, base, "pi-agent").collect()}
    assert table[12]["event"] == "prompt" and json.loads(table[12]["extra"]) == {"extra": {"a": 1}} and table[12]["text"] == '["Hello there 0"]' and table[0]["extra"] is None
    assert drift.schema_changes(lines.limit(0), base).count() == 0
