"""Problem 5: schemas that drift between files, brought to one table per agent.

Method: similarity flooding. Each file becomes a small schema graph (fields, nesting,
JSON types), the expected schema of its agent another; pairs of fields start with the
similarity of their names and of the values seen under them and pass it on along edges
with equal labels, damped, until nothing changes. Of the pairs that are possible (a
baseline field never stands beside its own new name in a line) the flooded similarity
selects the best consistent correspondences; from them follow renamed, removed, added
and retyped fields, and the casts that bring all files into one table.

Lines are folded to per-file field statistics inside each partition before the shuffle
(counts by type, value and context histograms of fixed length), so that a hot file
sends one row per field and task, never its lines. What is known of the baseline's
fields is a table as long as the baseline, which is fixed. A file's graph is gathered
from its baseline fields and from those other fields whose start leaves any chance of a
correspondence; all others are additions without being gathered.

Defined results: lines that are no valid JSON object count for nothing; a file whose
lines name no known agent is compared with none and has no rows; repeated lines change
nothing; an empty table gives no rows. A baseline field without a type is never retyped
and is text in the table; of a field listed twice the last type in order counts.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quietlines.operators.rejects import scan_json
from quietlines.plans.tables import durable, salted_lookup

TYPES = ("string", "number", "boolean", "array", "object")
# Kinds of values that a histogram tells apart.
SHAPES = ("uuid", "short_id", "time", "small", "middle", "large", "fraction", "truth", "path", "version", "command", "prose", "object", "list", "text", "empty")
WORDS, CONTEXT = 24, 24
OWN = len(SHAPES) + WORDS
WIDTH = OWN + CONTEXT
COUNTS = ["n", "nn", *(f"t{i}" for i in range(len(TYPES))), *(f"p{i}" for i in range(WIDTH))]
#: Share of a pair's similarity that comes from its neighbours, in every round.
DAMP = 0.2
#: Flooded similarity from which a correspondence counts, and what a second name must have more.
ACCEPT, SECOND = 0.575, 0.07
#: Change under which propagation has come to rest.
STILL = 1e-6
#: Between a field and a key inside its object, where that field is not `input`.
INSIDE = "\x1f"
#: Values up to this length are classified once and remembered.
REMEMBERED = 64

_UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", re.I)
_SHORT = re.compile(r"[a-z]?[0-9a-f]{6,40}|[a-z]{1,4}_[0-9a-zA-Z]{6,}")
_TIME = re.compile(r"\d{4}-\d\d-\d\d(?:[T ]\d\d:\d\d.*)?")
_DIGITS = re.compile(r"-?\d{1,15}(?:\.\d+)?")
_VERSION = re.compile(r"\d+(?:\.\d+){1,3}")
_PATH = re.compile(r"(?:~|\.)?/[^\s]*")
_DIGIT = re.compile(r"\d")
_WORDY = re.compile(r"[A-Za-z][A-Za-z_-]{0,23}")
_COMMAND = re.compile(r"(?:\./|[a-z][\w.-]*=?)(?:\s|$)[^A-ZÀ-Þ]?|[a-z][\w-]*\s+-{1,2}\w")


def json_type(value: object) -> str | None:
    if value is None:
        return None
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    return "string" if isinstance(value, str) else "array" if isinstance(value, list) else "object"


def _bucket(word: str, size: int) -> int:
    return zlib.crc32(word.lower().encode()) % size


def value_shape(value: object) -> tuple[str, str | None]:
    """The kind of a value, whatever JSON type wraps it, and the word if it is one word."""
    if isinstance(value, list):
        if len(value) > 1 and all(isinstance(v, str) for v in value):
            return value_shape(" ".join(value))
        return value_shape(value[0]) if value else ("list", None)
    if isinstance(value, dict):
        if len(value) == 1:
            return value_shape(next(iter(value.values())))
        if "name" in value and len(value) == 2:
            return value_shape(value["name"])
        return ("object", None)
    if isinstance(value, bool):
        return ("truth", None)
    if isinstance(value, (int, float)):
        size = abs(value)
        if 1.4e9 <= size < 2.0e9 or 1.4e12 <= size < 2.0e12:
            return ("time", None)
        if isinstance(value, float) and value != int(value):
            return ("fraction", None)
        return ("small" if size < 200 else "middle" if size < 1e6 else "large", None)
    text = str(value)
    if not text:
        return ("empty", None)
    # Each pattern is tried only on text of a length and a beginning it can match.
    size, first = len(text), text[0]
    if first in "-0123456789":
        if size <= 400 and _DIGITS.fullmatch(text):
            return value_shape(float(text) if "." in text else int(text))
        if size >= 10 and _TIME.fullmatch(text):
            return ("time", None)
        if _VERSION.fullmatch(text):
            return ("version", None)
    if size == 36 and _UUID.fullmatch(text):
        return ("uuid", None)
    if first in "/~." and _PATH.fullmatch(text):
        return ("path", None)
    if size <= 46 and _SHORT.fullmatch(text) and _DIGIT.search(text):
        return ("short_id", None)
    if size <= 24 and _WORDY.fullmatch(text):
        return ("text", text)
    return ("command" if _COMMAND.match(text) else "prose", None)


def _no_constant(name: str) -> None:
    raise ValueError(name)


def _integer(digits: str) -> int | float:
    return int(digits) if len(digits) < 400 else math.inf


def parse_object(raw: str | None) -> dict | None:
    """The JSON object of a valid line, else None."""
    if raw is None:
        return None
    try:
        value = json.loads(raw, parse_constant=_no_constant, parse_int=_integer)
    except ValueError:
        return None
    except RecursionError:
        return shallow_object(raw) if scan_json(raw) is None else None
    return value if isinstance(value, dict) else None


def shallow_object(raw: str) -> dict | None:
    """A valid object too deep for the parser, with what lies below its fields emptied."""
    parts, depth, at = [], 0, 0
    for m in re.finditer(r'"(?:[^"\\]|\\.)*"|[\[\]{}]', raw, re.S):
        token = m.group()
        if depth <= 2:
            parts.append(raw[at : m.start()])
        if token[0] == '"':
            if depth <= 2:
                parts.append(token)
        elif token in "[{":
            depth += 1
            if depth <= 2 or depth == 3:
                parts.append(token)
        else:
            if depth <= 3:
                parts.append(token)
            depth -= 1
        at = m.end()
    value = json.loads("".join(parts) + raw[at:])
    return value if isinstance(value, dict) else None


def flat_fields(line: dict) -> dict[str, object]:
    """The fields of an object and those directly inside `input`."""
    fields = dict(line)
    if isinstance(line.get("input"), dict):
        fields |= {f"input.{k}": v for k, v in line["input"].items()}
    return fields


@lru_cache(1 << 16, typed=True)
def _scalar_profile(value: object) -> tuple[int, int, int, int]:
    shape, word = value_shape(value)
    own = len(SHAPES) + _bucket(word, WORDS) if word else SHAPES.index(shape)
    return TYPES.index(json_type(value)), own, _bucket(word, CONTEXT) if word else -1, zlib.crc32(repr(value).encode("utf-8", "replace"))


def profile(value: object) -> tuple[int, int, int, int]:
    """(type, place in the value histogram, context bucket or -1, hash) of a value that is not null."""
    kind = type(value)
    if kind is str and len(value) <= REMEMBERED or kind is int or kind is float or kind is bool:
        return _scalar_profile(value)
    found = _scalar_profile.__wrapped__(value)
    return found if kind is str else (*found[:3], 0)


def field_slots(expected: dict[str, dict[str, str]]) -> dict[str, int]:
    """A number for every field name of the baseline, whatever the agent."""
    return {f: i for i, f in enumerate(sorted({f for fields in expected.values() for f in fields}))}


_AT = 2 + len(TYPES)


class Fold:
    """Statistics of the fields of files, folded line by line.

    The row of a file for the field `""` counts lines in `n` and, in the first slots,
    the lines that name each known agent.
    """

    def __init__(self, expected: dict[str, dict[str, str]]):
        self.slots = field_slots(expected)
        self.agents = {a: i for i, a in enumerate(sorted(expected))}
        self.inside = sorted({f.partition(".")[2] for f in self.slots if "." in f})
        self.wide = 2 + len(TYPES) + WIDTH + max(len(self.slots), len(self.agents), 1)
        self.rows: dict[tuple[str, str], list] = {}  # (file, field) -> [counts, lowest hash, highest hash]
        self.company: Counter = Counter()  # (file, fields, context buckets) -> lines

    def _row(self, file: str, field: str) -> list:
        held = self.rows.get((file, field))
        if held is None:
            held = self.rows[file, field] = [[0] * self.wide, None, None]
        return held

    def add(self, file: str, line: dict) -> None:
        counts = self._row(file, "")[0]
        counts[0] += 1
        named = line.get("agent")
        if isinstance(named, str) and named in self.agents:
            counts[2 + len(TYPES) + WIDTH + self.agents[named]] += 1
        names, words, rows = [], [], self.rows
        for field, value in flat_fields(line).items():
            held = rows.get((file, field)) or self._row(file, field)
            counts = held[0]
            counts[0] += 1
            if value is None:
                continue
            kind, own, context, mark = profile(value)
            counts[1] += 1
            counts[2 + kind] += 1
            counts[_AT + own] += 1
            if held[1] is None:
                held[1] = held[2] = mark
            elif mark < held[1]:
                held[1] = mark
            elif mark > held[2]:
                held[2] = mark
            names.append(field)
            words.append(context if context >= 0 and field != "agent" and not field.startswith("input.") else -1 - context)
            if isinstance(value, dict) and field != "input":
                for key in self.inside:
                    if value.get(key) is not None:
                        counts = self._row(file, field + INSIDE + key)[0]
                        counts[0] += 1
                        counts[1] += 1
                        counts[2 + TYPES.index(json_type(value[key]))] += 1
        self.company[file, tuple(names), tuple(words)] += 1

    def columns(self) -> list[pa.Array]:
        """The rows as Arrow columns; the fold is empty afterwards."""
        at, after = 2 + len(TYPES) + OWN, 2 + len(TYPES) + WIDTH
        for (file, names, words), n in self.company.items():
            context = {w for w in words if w >= 0}
            present = [after + self.slots[f] for f in names if f in self.slots]
            for field, word in zip(names, words, strict=True):
                counts = self.rows[file, field][0]
                own = word if word >= 0 else -1 - word
                for c in context:
                    if c != own:
                        counts[at + c] += n
                for i in present:
                    counts[i] += n
        matrix = np.array([r[0] for r in self.rows.values()], np.int64).reshape(len(self.rows), self.wide)
        keys = list(self.rows)
        text = lambda part: pa.array([k[part].encode("utf-8", "replace").decode() for k in keys], pa.string())
        marks = [pa.array([r[i] for r in self.rows.values()], pa.int64()) for i in (1, 2)]
        self.rows, self.company = {}, Counter()
        return [text(0), text(1), *marks, *(pa.array(matrix[:, i]) for i in range(self.wide))]


def field_statistics(lines: DataFrame, expected: dict[str, dict[str, str]], path: str = "relative_path", raw: str = "raw") -> DataFrame:
    """(relative_path, file_agent, field, low, high, counts...), one row per field of every file of a known agent."""
    slots = max(len(field_slots(expected)), len(expected), 1)
    sums = [*COUNTS, *(f"c{i}" for i in range(slots))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = Fold(expected)
        names = ["relative_path", "field", "low", "high", *sums]
        for batch in batches:
            for file, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                line = parse_object(text)
                if line is not None and file is not None:
                    fold.add(file, line)
            if len(fold.rows) + len(fold.company) > 20_000:
                yield pa.RecordBatch.from_arrays(fold.columns(), names)
        yield pa.RecordBatch.from_arrays(fold.columns(), names)

    schema = "relative_path string, field string, low bigint, high bigint, " + ", ".join(f"{s} bigint" for s in sums)
    partial = lines.select(F.col(path).cast("string"), raw).mapInArrow(run, schema)
    whole = partial.groupBy("relative_path", "field").agg(F.min("low").alias("low"), F.max("high").alias("high"), *(F.sum(s).alias(s) for s in sums))
    # The agent most lines of a file name; lines without one belong to it too.
    votes = F.array(*(F.struct(F.col(f"c{i}").alias("n"), F.lit(a).alias("agent")) for i, a in enumerate(sorted(expected)))).cast("array<struct<n:bigint,agent:string>>")
    most = F.when(F.col("field") == "", F.array_max(votes))
    named = whole.withColumn("_most", F.max(most).over(Window.partitionBy("relative_path")))
    return named.where("field <> '' AND _most.n > 0").withColumn("file_agent", F.col("_most.agent")).drop("_most")


def _name_parts(name: str) -> list[str]:
    last = name.rpartition(".")[2]
    return [p.lower() for p in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", last)]


@lru_cache(1 << 14)
def name_similarity(a: str, b: str) -> float:
    """Shared word parts and letter trigrams of two field names, between 0 and 1."""
    pa, pb = set(_name_parts(a)), set(_name_parts(b))
    words = len(pa & pb) / max(min(len(pa), len(pb)), 1)
    ja, jb = "".join(sorted(pa)), "".join(sorted(pb))
    ta, tb = ({f"^{j}$"[i : i + 3] for i in range(len(j))} for j in ("".join(_name_parts(a)), "".join(_name_parts(b))))
    return 1.0 if ja == jb else max(0.8 * words, len(ta & tb) / max(len(ta | tb), 1))


def _cosine(a: np.ndarray, b: np.ndarray) -> float:
    size = float(np.linalg.norm(a) * np.linalg.norm(b))
    return float(a @ b) / size if size else 0.0


def value_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """How alike the values and the company of two fields are."""
    values, company = _cosine(a[:OWN], b[:OWN]), _cosine(a[OWN:], b[OWN:])
    if not a[OWN:].any() or not b[OWN:].any():
        return values
    return 0.75 * values + 0.25 * company


def start_similarity(field: dict, name: str, wanted: str, known: dict | None) -> float:
    """Similarity of a file's field to a baseline field before flooding; `known` is the latter's profile.

    0 where a line of the file holds both; less where both stand together elsewhere.
    """
    if name.rpartition(".")[0] != wanted.rpartition(".")[0] or field["beside"] > 0:
        return 0.0
    alike = value_similarity(field["p"], known["p"]) if known else 0.5
    steady = known["steady"] if known else 0.5
    if field["nn"] >= 3 and max(steady, 1 - steady) > 0.8:
        alike *= 1.0 - 0.5 * abs(float(field["low"] == field["high"]) - steady)
    return (0.7 * alike + 0.3 * name_similarity(name, wanted)) * (1.0 - min(field["elsewhere"] * 1.5, 1.0))


#: A pair that starts below this cannot come to be accepted, whatever its neighbours.
CHANCE = (ACCEPT - DAMP) / (1 - DAMP)


def parent(name: str) -> str:
    """The field whose object holds a field, `""` for the object of the line."""
    return name.rpartition(INSIDE)[0] if INSIDE in name else "input" if name.startswith("input.") else ""


class Graph:
    """Fields of a schema with their types; nesting follows from the names."""

    def __init__(self, types: dict[str, set[str]]):
        self.fields = list(types)
        index = {f: i for i, f in enumerate(self.fields)}
        self.parent = np.array([index.get(parent(f), -1) for f in self.fields], int)
        self.typed = np.array([[t in types[f] for t in TYPES] for f in self.fields], bool).reshape(len(self.fields), len(TYPES))


def flood(left: Graph, right: Graph, start: np.ndarray) -> np.ndarray:
    """Similarity flooding over the pairs of two schema graphs.

    A pair of fields has up to three kinds of neighbours: the pair of their parents (the
    two roots are alike), the pairs of their children, each child of `right` with its
    likest child of `left`, and the pairs of equal types, each as alike as the fields
    that it has on both sides. What comes from the kinds is averaged and mixed with the
    start by `DAMP`, so that every round brings the values closer to the only fixpoint.
    """
    scores = start.copy()
    if not scores.size:
        return scores
    both = (left.typed[:, None, :] & right.typed[None, :, :]).astype(float)
    shared = both.sum(2)
    has_types = left.typed.any(1)[:, None] & right.typed.any(1)[None, :]
    children = [np.flatnonzero(right.parent == j) for j in range(len(right.fields))]
    while True:
        kinds = np.ones_like(scores)
        flow = np.ones_like(scores)  # the roots
        nested = left.parent >= 0
        for j in np.flatnonzero(right.parent >= 0):
            flow[nested, j] = scores[left.parent[nested], right.parent[j]]
            flow[~nested, j] = 0.0
        flow[np.ix_(nested, right.parent < 0)] = 0.0
        types = np.array([max((scores[left.typed[:, t], j].max() for j in np.flatnonzero(right.typed[:, t]) if left.typed[:, t].any()), default=0.0) for t in range(len(TYPES))])
        flow = flow + np.where(shared > 0, (both * types).sum(2) / np.maximum(shared, 1.0), 0.0) * has_types
        kinds = kinds + has_types
        for j, below in enumerate(children):
            if len(below):
                for i in range(len(left.fields)):
                    own = np.flatnonzero(left.parent == i)
                    flow[i, j] += scores[np.ix_(own, below)].max(0).mean() if len(own) else 0.0
                kinds[:, j] += 1
        new = (1 - DAMP) * start + DAMP * flow / kinds
        new[start == 0] = 0.0  # what cannot correspond stays apart
        moved = np.abs(new - scores).max()
        scores = new
        if moved < STILL:
            return scores


def correspondences(fields: dict[str, dict], expected: dict[str, str]) -> dict[str, list[str]]:
    """Baseline field -> the other names under which a file holds it.

    `fields` gives every field of the file its `types` and, where it is not of the
    baseline, its `start` similarity to each baseline field.
    """
    wanted = sorted(expected)
    extra = [f for f in sorted(fields) if f not in expected and INSIDE not in f]
    if not any(fields[x]["start"].get(b, 0.0) for x in extra for b in wanted):
        return {}
    held = sorted(fields)
    at = {b: j for j, b in enumerate(wanted)}
    start = np.zeros((len(held), len(wanted)))
    for i, f in enumerate(held):
        if f in at:
            start[i, at[f]] = 1.0
        elif INSIDE in f:  # a key inside some object is like the baseline's key of that name
            for b, j in at.items():
                start[i, j] = float(b.rpartition(".")[2] == f.rpartition(INSIDE)[2] and "." in b)
        else:
            for b, s in fields[f]["start"].items():
                start[i, at[b]] = s
    scores = flood(Graph({f: fields[f]["types"] for f in held}), Graph({b: {expected[b]} for b in wanted}), start)
    found: dict[str, list[str]] = {}
    order = sorted(((scores[held.index(x), j], x, b) for x in extra for b, j in at.items()), key=lambda s: (-s[0], s[1], s[2]))
    used: set[str] = set()
    for s, x, b in order:
        # Two names may share a baseline field only if they never stand in one line; a weak second name is an addition.
        if s < ACCEPT or x in used or b in found and s < ACCEPT + SECOND:
            continue
        used.add(x)
        found.setdefault(b, []).append(x)
    return found


def changes(fields: dict[str, dict], expected: dict[str, str], renamed: dict[str, list[str]]) -> list[tuple[str, str, str | None]]:
    """(field, change, other name) of one file."""
    found: list[tuple[str, str, str | None]] = []
    moved = {x for names in renamed.values() for x in names}
    for b, kind in expected.items():
        found += [(b, "renamed", x) for x in renamed.get(b, ())]
        if b not in renamed and b not in fields:
            found.append((b, "removed", None))
        if kind is not None and any(fields[name]["types"] - {kind} for name in (b, *renamed.get(b, ())) if name in fields):
            found.append((b, "retyped", None))
    found += [(x, "added", None) for x in fields if x not in expected and x not in moved and INSIDE not in x]
    return found


def read_baseline(baseline: DataFrame) -> dict[str, dict[str, str]]:
    """agent -> field -> type; the baseline is a fixed table. Rows without agent or field say nothing."""
    expected: dict[str, dict[str, str]] = {}
    for r in baseline.where("agent IS NOT NULL AND field_name IS NOT NULL").orderBy("agent", "field_name", "json_type").collect():
        expected.setdefault(r["agent"], {})[r["field_name"]] = r["json_type"]
    return expected


def _is_expected(expected: dict[str, dict[str, str]]) -> Column:
    known = [f"{a}\x1f{f}" for a, fields in expected.items() for f in fields]
    return F.concat_ws("\x1f", "file_agent", "field").isin(known) if known else F.lit(False)


def baseline_profiles(stats: DataFrame, expected: dict[str, dict[str, str]]) -> dict[tuple[str, str], dict]:
    """(agent, baseline field) -> value histogram and how often it is constant in a file; as long as the baseline."""
    some = stats.where(_is_expected(expected) & (F.col("nn") > 0))
    sums = [F.sum(F.col(f"p{i}") / F.col("nn")).alias(f"p{i}") for i in range(WIDTH)]
    rows = some.groupBy("file_agent", "field").agg(F.avg((F.col("low") == F.col("high")).cast("double")).alias("steady"), *sums).collect()
    return {(r["file_agent"], r["field"]): {"p": np.array([float(r[f"p{i}"] or 0) for i in range(WIDTH)]), "steady": float(r["steady"] or 0.0)} for r in rows}


def scored_extras(stats: DataFrame, expected: dict[str, dict[str, str]]) -> DataFrame:
    """The fields no baseline names: (relative_path, file_agent, field, types, start), with the baseline fields they may stand for."""
    slots, profiles = field_slots(expected), baseline_profiles(stats, expected)
    extra = stats.where(~_is_expected(expected) & ~F.col("field").contains(INSIDE))
    beside = [f"c{i}" for i in range(len(slots))]
    # How often a name stands beside each baseline field, over all files of its agent.
    everywhere = extra.groupBy("file_agent", "field").agg(F.sum("nn").alias("all"), F.array(*(F.sum(c) for c in beside)).alias("together"))
    known = everywhere.withColumn("_key", F.xxhash64("file_agent", "field")).withColumnsRenamed({"file_agent": "_agent", "field": "_field"})
    joined = salted_lookup(extra.withColumn("_key", F.xxhash64("file_agent", "field")), known, "_key", "relative_path").where("_agent = file_agent AND _field = field")
    rows = joined.select(
        "relative_path", "file_agent", "field", "low", "high", "nn", "all", "together",
        F.array(*(f"t{i}" for i in range(len(TYPES)))).alias("t"), F.array(*(f"p{i}" for i in range(WIDTH))).alias("p"), F.array(*beside).alias("c"),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                start, p = {}, np.asarray(r.p, float)
                for b in expected[r.file_agent] if r.nn else ():
                    field = {"nn": r.nn, "low": r.low, "high": r.high, "p": p, "beside": r.c[slots[b]], "elsewhere": r.together[slots[b]] / max(r.all, 1)}
                    s = start_similarity(field, r.field, b, profiles.get((r.file_agent, b)))
                    if s >= CHANCE:
                        start[b] = s
                out.append((r.relative_path, r.file_agent, r.field, [t for t, n in zip(TYPES, r.t, strict=True) if n], list(start.items())))
            yield pd.DataFrame(out, columns=["relative_path", "file_agent", "field", "types", "start"]).assign(start=lambda f: [dict(s) for s in f["start"]])

    return rows.mapInPandas(run, "relative_path string, file_agent string, field string, types array<string>, start map<string,double>")


CHANGES = "relative_path string, agent string, field_name string, other_name string, change_kind string"


def match_files(stats: DataFrame, expected: dict[str, dict[str, str]]) -> DataFrame:
    """(relative_path, agent, field_name, other_name, change_kind), also inside an `input` that has changed itself; `stats` is read twice."""
    scored = durable(scored_extras(stats, expected))
    known = stats.where(_is_expected(expected) | F.col("field").contains(INSIDE)).select(
        "relative_path", "file_agent", "field",
        F.array_compact(F.array(*(F.when(F.col(f"t{i}") > 0, t) for i, t in enumerate(TYPES)))).alias("types"), F.create_map().cast("map<string,double>").alias("start"),
    )
    hopeful = F.size("start") > 0
    graphs = known.unionByName(scored.where(hopeful)).groupBy("relative_path", "file_agent").agg(F.collect_list(F.struct("field", "types", "start")).alias("fields"))
    files = stats.select("relative_path", "file_agent").distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for path, agent, held in zip(rows["relative_path"], rows["file_agent"], rows["fields"], strict=True):
                fields = {f["field"]: {"types": set(f["types"]), "start": dict(f["start"])} for f in held} if held is not None else {}
                out += [(path, agent, f, other, kind) for f, kind, other in changes(fields, expected[agent], correspondences(fields, expected[agent]))]
            yield pd.DataFrame(out, columns=["relative_path", "agent", "field_name", "other_name", "change_kind"])

    # A file none of whose fields is gathered misses all of its baseline.
    matched = files.join(graphs, ["relative_path", "file_agent"], "left").mapInPandas(run, CHANGES)
    added = scored.where(~hopeful).select("relative_path", F.col("file_agent").alias("agent"), F.col("field").alias("field_name"), F.lit(None).cast("string").alias("other_name"), F.lit("added").alias("change_kind"))
    return matched.unionByName(added)


def schema_changes(lines: DataFrame, baseline: DataFrame) -> DataFrame:
    """Every change of every file against the baseline of its agent; where `input` itself has one, none of what is inside it."""
    expected = read_baseline(baseline)
    found = match_files(durable(field_statistics(lines, expected)), expected)
    changed = F.max(F.col("field_name") == "input").over(Window.partitionBy("relative_path"))
    return found.withColumn("_input", changed).where(~(F.col("_input") & F.col("field_name").startswith("input."))).drop("_input")


def restored(line: dict, fields: dict[str, str], back: dict[str, str]) -> tuple[dict[str, object], dict[str, object]]:
    """(values by baseline field, other fields) of a line; `back` gives new names their baseline field.

    What the baseline does not have inside `input` stays in the value of `input`.
    """
    held: dict[str, object] = {}
    extra: dict[str, object] = {}
    for k, v in line.items():
        name = k if k in fields else back.get(k)
        if name not in fields:
            extra[k] = v
        elif held.get(name) is None:
            held[name] = v
    if isinstance(held.get("input"), dict) and any(f.startswith("input.") for f in fields):
        inside: dict[str, object] = {}
        for k, v in held["input"].items():
            name = f"input.{k}" if f"input.{k}" in fields else back.get(f"input.{k}", f"input.{k}")
            if inside.get(name) is None:
                inside[name] = v
        held |= {f: v for f, v in inside.items() if f in fields and v is not None}
        held["input"] = {f.removeprefix("input."): v for f, v in inside.items()}
    return held, extra


def consistent_table(lines: DataFrame, baseline: DataFrame, agent: str) -> DataFrame:
    """All lines of an agent's files with the baseline's columns, renamed fields put back and values cast.

    Every valid line stands in the table of its file's agent, whatever the line itself
    names, so in exactly one table; only a line without a file goes by its own agent. A value that cannot be cast to the baseline's type
    becomes null; `extra` keeps the fields the baseline does not have, as JSON.
    """
    expected = read_baseline(baseline)
    columns = list(expected[agent])
    stats = durable(field_statistics(lines, expected))
    moved = match_files(stats, expected).where((F.col("agent") == agent) & (F.col("change_kind") == "renamed"))
    renames = moved.groupBy("relative_path").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("other_name", "field_name")))).alias("renames"))
    files = stats.where(F.col("file_agent") == agent).select("relative_path").distinct().join(renames, "relative_path", "left")
    casts = {"string": "string", "number": "double", "boolean": "boolean", "array": "string", "object": "string"}
    kinds = {c: casts.get(expected[agent][c], "string") for c in columns}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for line_id, path, raw, names in zip(rows["line_id"], rows["relative_path"], rows["raw"], rows["renames"], strict=True):
                line = parse_object(raw)
                if line is None or path is None and line.get("agent") != agent:
                    continue
                held, extra = restored(line, expected[agent], dict(names) if names is not None else {})
                out.append((line_id, path, *(cast_value(held.get(c), kinds[c]) for c in columns), _json(extra) if extra else None))
            frame = pd.DataFrame(out, columns=["line_id", "relative_path", *columns, "extra"])
            for c in columns:
                if kinds[c] == "double":
                    frame[c] = frame[c].astype("Float64")
            yield frame

    schema = "line_id bigint, relative_path string, " + ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", extra string"
    some = lines.select("line_id", "relative_path", "raw")
    homeless = some.where("relative_path IS NULL").withColumn("renames", F.lit(None).cast("map<string,string>"))
    return salted_lookup(some, files, "relative_path", "line_id").unionByName(homeless).mapInPandas(run, schema)


def _json(value: object) -> str:
    return json.dumps(value, ensure_ascii=False).encode("utf-8", "replace").decode()


def cast_value(value: object, kind: str) -> object:
    """`value` as the column's type; wrapped scalars are unwrapped, the impossible is null."""
    if value is None:
        return None
    if kind == "string":
        return value.encode("utf-8", "replace").decode() if isinstance(value, str) else _json(value)
    if isinstance(value, (list, dict)) and len(value) == 1:
        value = value[0] if isinstance(value, list) else next(iter(value.values()))
    if kind == "boolean":
        return value if isinstance(value, bool) else None
    try:
        return None if isinstance(value, bool) else float(value)
    except (TypeError, ValueError, OverflowError):
        return None
