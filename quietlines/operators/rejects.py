"""Problem 4: rows that fail to parse, apart from the valid ones and with the reason.

Method: per schema an anchored regular expression for a whole row is generated; rows
that match it are valid. The others go through patterns that grow field by field: the
first that fails names the broken field.

* Delimited records: the schema is a list of (column, kind); the expression has one
  alternative per column for the bare and one for the quoted form, JSON values inside
  a quoted field with their quotes doubled. It runs in the JVM, prefixes included.
* JSON lines: the schema is the grammar of RFC 8259. The generated expression nests to
  `DEPTH` levels and runs in the JVM; what it rejects is consumed token by token by
  anchored patterns with a stack, which is exact at any depth and yields the reason and
  the path of the field.

All quantifiers are possessive, so no row backtracks or deepens the matcher's stack.

Defined results: a null row fails with reason `null`; an empty or blank JSON line fails
with `blank line`; repeated rows are judged each on their own; extra columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietlines.plans.tables import plain

#: Levels of nesting the JVM expression covers; deeper lines are judged in Python.
DEPTH = 4

_WS = r"[ \t\n\r]*+"
_STRING = r'"(?:[^"\\\x00-\x1f]++|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"'
_NUMBER = r"-?+(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][+-]?+[0-9]++)?+"
_SCALAR = rf"(?:{_STRING}|{_NUMBER}|true|false|null)"

# The columns of a report record and the kind of each.
REPORT_SCHEMA = (
    ("input_relative_path", "path"),
    ("output_relative_path", "path"),
    ("bytes_in", "digits"),
    ("bytes_out", "digits"),
    ("lines_processed", "digits"),
    ("invalid_json_lines", "digits"),
    ("errors", "json_strings"),
    ("warnings", "json_strings"),
    ("duration_seconds", "decimal"),
    ("counts_by_pii_label", "json_counts"),
    ("counts_by_regex_secret_rule", "json_counts"),
)


def json_pattern(depth: int = DEPTH) -> str:
    """Anchored expression for one JSON value of at most `depth` nested levels."""
    value = _SCALAR
    for _ in range(depth):
        members = rf"\{{{_WS}(?:{_STRING}{_WS}:{_WS}{value}{_WS}(?:,{_WS}(?!\}})|(?=\}})))*+\}}"
        items = rf"\[{_WS}(?:{value}{_WS}(?:,{_WS}(?!\])|(?=\])))*+\]"
        value = rf"(?:{_SCALAR}|{members}|{items})"
    return rf"\A{_WS}{value}{_WS}\z"


def _list_of(item: str, opening: str, closing: str) -> str:
    return rf"{_WS}{opening}{_WS}(?:{item}{_WS}(?:,{_WS}(?!{closing})|(?={closing})))*+{closing}{_WS}"


def field_pattern(kind: str) -> str:
    """Expression for one delimited field of a kind, bare or quoted."""
    text = r'""(?:[^"\\\x00-\x1f]++|\\(?:""|[\\/bfnrt]|u[0-9a-fA-F]{4}))*+""'
    empty_list, empty_map = r"[ \t]*+\[[ \t]*+\][ \t]*+", r"[ \t]*+\{[ \t]*+\}[ \t]*+"
    bare, quoted = {
        "path": (r'[^",\r\n]++', r'(?:[^"]++|"")++'),
        "digits": (r"[0-9]++", r"[0-9]++"),
        "decimal": (r"[0-9]++(?:\.[0-9]++)?+", r"[0-9]++(?:\.[0-9]++)?+"),
        "json_strings": (empty_list, _list_of(text, r"\[", r"\]")),
        "json_counts": (empty_map, _list_of(rf"{text}{_WS}:{_WS}(?:0|[1-9][0-9]*+)", r"\{", r"\}")),
        "any": (r'[^",\r\n]*+', r'(?:[^"]++|"")*+'),
    }[kind]
    return rf'(?:"{quoted}"|{bare})'


def record_pattern(kinds: list[str], whole: bool = True) -> str:
    """Anchored expression for a record, or for its first fields up to the next comma."""
    return r"\A" + ",".join(map(field_pattern, kinds)) + (r"\z" if whole else r"(?:,|\z)")


def _matches(raw: Column, pattern: str) -> Column:
    return F.coalesce(raw.rlike(pattern), F.lit(False))


def check_records(df: DataFrame, raw: str = "raw", schema: tuple[tuple[str, str], ...] = REPORT_SCHEMA) -> DataFrame:
    """Add `reason` and `broken_field`, both null for valid records."""
    names, kinds = [n for n, _ in schema], [k for _, k in schema]
    text = F.col(raw)
    quoting = rf"\A{field_pattern('any')}(?:,{field_pattern('any')})*+\z"
    counted = record_pattern(["any"] * len(names))
    broken = F.lit(None).cast("string")
    for i in range(len(names), 0, -1):
        last = i == len(names)
        broken = F.when(~_matches(text, record_pattern(kinds[:i], whole=last)), names[i - 1]).otherwise(broken)
    return (
        df.withColumn("_valid", _matches(text, record_pattern(kinds)))
        .withColumn("broken_field", F.when(~F.col("_valid"), F.when(text.isNull(), None).otherwise(broken)))
        .withColumn(
            "reason",
            F.when(
                ~F.col("_valid"),
                F.when(text.isNull(), "null")
                .when(F.trim(text) == "", "blank record")
                .when(~_matches(text, quoting), "broken quoting")
                .when(~_matches(text, counted), "wrong column count")
                .otherwise(F.concat(F.lit("invalid value of "), F.col("broken_field"))),
            ),
        )
        .drop("_valid")
    )


_TOKENS = {
    "ws": re.compile(r"[ \t\n\r]*"),
    "string": re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"'),
    "part": re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*'),
    "number": re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"),
    "literal": re.compile(r"true|false|null"),
}


def scan_json(text: str) -> tuple[str, str] | None:
    """None if `text` is one JSON value, else (reason, path of the broken field)."""
    if not text.strip(" \t\n\r"):
        return ("blank line", "")
    if text[0] == "﻿":
        return ("byte order mark", "")
    at, end = _TOKENS["ws"].match(text).end(), len(text)
    stack: list[list] = []  # [closing bracket, key of the member being read]
    state = "value"

    def fail(reason: str) -> tuple[str, str]:
        return ("truncated" if at >= end and reason != "trailing content" else reason, ".".join(str(k) for _, k in stack if k is not None))

    while True:
        c = text[at : at + 1]
        if state in ("value", "value or end"):
            if c == "]" and state == "value or end":
                stack.pop()
                at, state = at + 1, "after"
            elif c == "{":
                stack.append(["}", None])
                at, state = at + 1, "key or end"
            elif c == "[":
                stack.append(["]", None])
                at, state = at + 1, "value or end"
            elif found := _TOKENS["string"].match(text, at) or _TOKENS["number"].match(text, at) or _TOKENS["literal"].match(text, at):
                at, state = found.end(), "after"
            elif c == '"':
                at = _TOKENS["part"].match(text, at).end()
                return fail("bad escape" if text[at : at + 1] == "\\" else "control character in string")
            else:
                return fail("trailing comma" if c == "]" else "bad value")
        elif state in ("key", "key or end"):
            if c == "}" and state == "key or end":
                stack.pop()
                at, state = at + 1, "after"
            elif found := _TOKENS["string"].match(text, at):
                stack[-1][1] = text[at + 1 : found.end() - 1]
                at = _TOKENS["ws"].match(text, found.end()).end()
                if text[at : at + 1] != ":":
                    return fail("missing colon")
                at, state = at + 1, "value"
            elif c == '"':
                at = _TOKENS["part"].match(text, at).end()
                return fail("bad escape" if text[at : at + 1] == "\\" else "control character in string")
            else:
                return fail("trailing comma" if c == "}" else "unquoted key")
        elif not stack:
            return None if at == end else fail("trailing content")
        elif c == ",":
            stack[-1][1] = None
            at, state = at + 1, "key" if stack[-1][0] == "}" else "value"
        elif c == stack[-1][0]:
            stack.pop()
            at += 1
        else:
            return fail("missing comma")
        at = _TOKENS["ws"].match(text, at).end()


def rejected_lines(df: DataFrame, raw: str = "raw") -> DataFrame:
    """The rows whose `raw` is not one JSON value, with `reason` and `broken_field` (columns of these names are replaced)."""
    df = df.drop("reason", "broken_field")
    suspects = df.where(~_matches(F.col(raw), json_pattern()))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            verdicts = [("null", "") if t is None else scan_json(t) for t in rows[raw]]
            bad = [v is not None for v in verdicts]
            out = plain(rows).loc[bad].reset_index(drop=True)
            out["reason"] = pd.Series([v[0] for v in verdicts if v], dtype=object)
            out["broken_field"] = pd.Series([v[1] or None for v in verdicts if v], dtype=object)
            yield out

    return suspects.mapInPandas(run, f"{fields}, reason string, broken_field string")


def valid_lines(df: DataFrame, raw: str = "raw") -> DataFrame:
    """The rows whose `raw` is one JSON value."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            kept = [ok or t is not None and scan_json(t) is None for ok, t in zip(rows["_shallow"], rows[raw], strict=True)]
            yield plain(rows).loc[kept].drop(columns="_shallow").reset_index(drop=True)

    return df.withColumn("_shallow", _matches(F.col(raw), json_pattern())).mapInPandas(run, fields)


def load_records(df: DataFrame, raw: str = "raw", schema: tuple[tuple[str, str], ...] = REPORT_SCHEMA) -> DataFrame:
    """The valid records as typed columns beside the other columns of `df`."""
    types = {"path": "string", "digits": "bigint", "decimal": "double", "json_strings": "array<string>", "json_counts": "map<string,bigint>"}
    valid = check_records(df, raw, schema).where(F.col("reason").isNull()).drop("reason", "broken_field")
    field = field_pattern("any")
    cells = F.regexp_extract_all(F.concat(F.lit(","), F.col(raw)), F.lit(rf",({field})"), F.lit(1))
    out = valid.withColumn("_cells", cells)
    for i, (name, kind) in enumerate(schema):
        cell = F.get("_cells", F.lit(i))
        cell = F.when(cell.startswith('"'), F.replace(F.substring(cell, 2, 1 << 30).substr(F.lit(1), F.char_length(cell) - 2), F.lit('""'), F.lit('"'))).otherwise(cell)
        out = out.withColumn(name, F.from_json(cell, types[kind]) if kind.startswith("json") else cell.try_cast(types[kind]))
    return out.drop("_cells", raw)


def line_report(df: DataFrame, rejects: DataFrame, most: int = 100) -> DataFrame:
    """Per file: lines, invalid_json_lines, and its first `most` errors with one line on the rest.

    Only (path, line, reason) of rejected lines is grouped; errors are first cut to the
    first `most` by rank inside the file, so no file gathers all of its errors.
    """
    from pyspark.sql import Window

    total = df.groupBy("relative_path").agg(F.count("*").alias("lines_processed"))
    bad = rejects.groupBy("relative_path").agg(F.count("*").alias("invalid_json_lines"))
    ranked = rejects.withColumn("_rank", F.row_number().over(Window.partitionBy("relative_path").orderBy("line_number", "line_id"))).where(F.col("_rank") <= most)
    first = ranked.groupBy("relative_path").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_rank", F.concat(F.lit("line "), F.col("line_number").cast("string"), F.lit(": "), F.col("reason")).alias("message")))), lambda s: s["message"]).alias("errors")
    )
    rest = F.col("invalid_json_lines") - most
    joined = total.join(bad, "relative_path", "left").join(first, "relative_path", "left").fillna({"invalid_json_lines": 0})
    none = F.array().cast("array<string>")
    return joined.select(
        "relative_path",
        "lines_processed",
        "invalid_json_lines",
        F.when(rest > 0, F.concat("errors", F.array(F.concat(rest.cast("string"), F.lit(" more omitted"))))).otherwise(F.coalesce("errors", none)).alias("errors"),
    )
