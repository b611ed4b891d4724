"""JSON lines: string leaves out, redacted leaves back in.

A line is parsed as Python parses JSON; its string leaves are numbered in document
order. Keys are never redacted. A string that stands directly under an identifier key
(`id`, `session_id`, `parentUuid` ...) stays as it is and is seen by neither the rules
nor the model; lists and objects under such keys are walked. A line that does not parse
is one raw string, is redacted as text and counted as invalid; the blank line too.

Lines nested deeper than `DEEP` are rewritten token by token, so that no depth ends a
job; of a repeated key they keep every value, other lines the last. A lone surrogate
escape stays an escape in the output; where a text crosses to another stage (`json_leaves`,
the model) it is a question mark. A failure in one line is that line's `error`, without
its text, and never ends the job.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietlines.config import RedactionConfig
from quietlines.functions.text import is_protected_key
from quietlines.operators.redact import redact_text
from quietlines.operators.rejects import scan_json

LEAVES = "array<struct<idx:int, path:string, key:string, value:string>>"
LINE = "struct<output:string, invalid_json:boolean, regex_counts:map<string,bigint>, error:string>"
#: Levels of nesting up to which a line is parsed as a whole.
DEEP = 200

# visit(text, key, way): `way` leads back to the root, as (way of the parent, key or position), or as a function that gives the path.
Visit = Callable[[str, "str | None", object], str]

_SURROGATE = re.compile("[\ud800-\udfff]")
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]{},:]|[^\s\[\]{},:"]+', re.S)


def path_of(way: object) -> str:
    """`$.a[0]` for the way to a leaf."""
    if callable(way):
        return way()
    steps = []
    while way:
        way, step = way
        steps.append(f"[{step}]" if isinstance(step, int) else f".{step}")
    return "$" + "".join(reversed(steps))


def walk(value: object, visit: Visit, strict: bool = False, key: str | None = None, way: tuple = ()) -> object:
    """`value` rebuilt with `visit` in place of every string leaf.

    With `strict`, identifier values are visited like any other.
    """
    if isinstance(value, str):
        return visit(value, key, way)
    if isinstance(value, list):
        return [visit(v, key, (way, i)) if isinstance(v, str) else walk(v, visit, strict, key, (way, i)) if isinstance(v, (list, dict)) else v for i, v in enumerate(value)]
    if isinstance(value, dict):
        return {
            k: (v if not strict and is_protected_key(k) else visit(v, k, (way, k))) if isinstance(v, str) else walk(v, visit, strict, k, (way, k)) if isinstance(v, (list, dict)) else v for k, v in value.items()
        }
    return value


def is_deep(raw: str) -> bool:
    if raw.count("[") + raw.count("{") <= DEEP:
        return False
    depth = 0
    for m in _TOKEN.finditer(raw):
        if m.group() in ("[", "{"):
            depth += 1
            if depth > DEEP:
                return True
        elif m.group() in ("]", "}"):
            depth -= 1
    return False


def rewrite_deep(raw: str, visit: Visit, strict: bool = False) -> str:
    """A valid line of any depth in compact form with its string leaves visited."""
    out: list[str] = []
    stack: list[list] = []  # [opening bracket, key that names what stands here, position, key being read]
    wants_key = False
    for m in _TOKEN.finditer(raw):
        token = m.group()
        if token in "[{":
            outer = (stack[-1][3] if stack[-1][0] == "{" else stack[-1][1]) if stack else None
            stack.append([token, outer, 0, None])
            wants_key = token == "{"
            out.append(token)
        elif token in "]}":
            stack.pop()
            wants_key = False
            out.append(token)
        elif token == ",":
            stack[-1][2] += 1
            wants_key = stack[-1][0] == "{"
            out.append(token)
        elif token == ":":
            wants_key = False
            out.append(token)
        elif wants_key:
            stack[-1][3] = json.loads(token)
            out.append(_dump(stack[-1][3]))
        elif token[0] == '"':
            text = json.loads(token)
            frame = stack[-1] if stack else ["", None, 0, None]
            key = frame[3] if frame[0] == "{" else frame[1]
            if frame[0] == "{" and not strict and is_protected_key(key):
                out.append(_dump(text))
            else:
                path = lambda: "$" + "".join(f".{f[3]}" if f[0] == "{" else f"[{f[2]}]" for f in stack)
                out.append(_dump(visit(text, key, path)))
        else:
            out.append(_dump(json.loads(token)))
    return "".join(out)


def _dump(value: object) -> str:
    """Compact JSON; a lone surrogate stays an escape."""
    text = json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    return text if text.isascii() else _SURROGATE.sub(lambda m: f"\\u{ord(m.group()):04x}", text)


def sendable(text: str | None) -> str | None:
    """`text` without lone surrogates, which no table can hold."""
    return text if text is None or text.isascii() else text.encode("utf-8", "replace").decode()


def transform(raw: str, visit: Visit, strict: bool = False) -> tuple[str, bool]:
    """(output line, invalid) of a line with every string leaf, or the line itself where it does not parse, visited."""
    try:
        if is_deep(raw):
            if scan_json(raw) is None:
                return rewrite_deep(raw, visit, strict), False
        else:
            value = json.loads(raw)
            return _dump(walk(value, visit, strict)), False
    except json.JSONDecodeError:
        pass
    return visit(raw, None, ()), True


def is_invalid(raw: str | None) -> bool:
    """Whether a line does not parse; the missing line does not."""
    if raw is None:
        return True
    if is_deep(raw):
        return scan_json(raw) is not None
    try:
        json.loads(raw)
    except json.JSONDecodeError:
        return True
    return False


def invalid_json(raw: Column) -> Column:
    """Whether a line does not parse; the missing line too."""

    @F.pandas_udf("boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for lines in batches:
            yield pd.Series([is_invalid(t) for t in lines], dtype=bool)

    return run(raw)


def leaves_of(raw: str | None) -> tuple[list[tuple[int, str, str | None, str]], bool]:
    """(leaves, invalid) of a line."""
    if raw is None:
        return [], True
    found: list[tuple[int, str, str | None, str]] = []

    def visit(text: str, key: str | None, way: object) -> str:
        found.append((len(found), sendable(path_of(way)), sendable(key), sendable(text)))
        return text

    invalid = transform(raw, visit)[1]
    return found, invalid


def json_leaves(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Add `leaves`, the redactable strings of each line, and `invalid_json`."""

    @F.pandas_udf(f"struct<leaves:{LEAVES}, invalid:boolean>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = ("idx", "path", "key", "value")
        for lines in batches:
            done = [leaves_of(t) for t in lines]
            yield pd.DataFrame({"leaves": pd.Series([[dict(zip(names, leaf, strict=True)) for leaf in found] for found, _ in done], dtype=object), "invalid": [bad for _, bad in done]})

    return df.withColumn("_parsed", run(raw)).withColumn("leaves", F.col("_parsed.leaves")).withColumn("invalid_json", F.col("_parsed.invalid")).drop("_parsed")


def sanitize_line(raw: str | None, config: RedactionConfig, strict: bool = False) -> tuple[str | None, bool, dict[str, int]]:
    """(output line, invalid, counts) of one line by the rules alone."""
    if raw is None:
        return None, True, {}
    if not config.preserve_json_structure:
        text, counts = redact_text(raw, config)
        return text, False, counts
    total: Counter = Counter()

    def visit(text: str, key: str | None, way: object) -> str:
        out, counts = redact_text(text, config)
        if counts:
            total.update(counts)
        return out

    output, invalid = transform(raw, visit, strict)
    return output, invalid, dict(total)


def safe_error(error: BaseException) -> str:
    """The message of an error, or its kind where it has none."""
    return str(error).strip() or type(error).__name__


def sanitize_json(df: DataFrame, config: RedactionConfig, raw: str = "raw", strict: bool = False) -> DataFrame:
    """Add `line` (LINE): every line sanitized by the rules, in one Python stage, no shuffle."""

    def one(text: str | None) -> tuple:
        try:
            return (*sanitize_line(text, config, strict), None)
        except Exception as error:  # one line must not end the job; its kind says enough and holds no text
            return None, False, {}, type(error).__name__

    @F.pandas_udf(LINE)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for lines in batches:
            done = [one(t) for t in lines]
            column = lambda i: pd.Series([d[i] for d in done], dtype=object)
            yield pd.DataFrame({"output": column(0), "invalid_json": [d[1] for d in done], "regex_counts": column(2), "error": column(3)})

    return df.withColumn("line", run(raw))


def rebuild(df: DataFrame, raw: str = "raw", redacted: str = "redacted") -> DataFrame:
    """Add `output`: the line with its leaves, in order, taken from the array column `redacted`."""

    @F.pandas_udf("string")
    def run(lines: pd.Series, texts: pd.Series) -> pd.Series:
        def one(line: str | None, new: list[str] | None) -> str | None:
            if line is None:
                return None
            at = iter(new if new is not None else ())
            return transform(line, lambda text, key, way: next(at, text))[0]

        return pd.Series([one(a, b) for a, b in zip(lines, texts, strict=True)], dtype=object)

    return df.withColumn("output", run(raw, redacted))
