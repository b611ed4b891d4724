"""The secret rules over a text column: two interchangeable back ends.

`arrow` runs the rules as Python expressions on Arrow batches behind necessary
conditions and is the default; `native` is made of JVM expressions only, one fold over
the rules. Both give `struct<text, regex_counts>` with the same text and counts. Null text
gives null text and no counts; placeholders that already stand in the text are matched
but neither changed nor counted.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietlines.config import RedactionConfig
from quietlines.functions.placeholders import is_placeholder, is_placeholder_column, replacement, replacement_column
from quietlines.functions.rules import RULES

_COMPILED = [(r.name, r.python(), r.python_gate(), r.fold, r.marks()) for r in RULES]
RESULT = "struct<text:string, regex_counts:map<string,bigint>>"


def apply_rules(text: str, mode: str, seed: int, counts: Counter, names: frozenset[str] | None = None) -> str:
    """One pass of the rules over one text; `counts` is added to."""
    low = text.lower() if text.isascii() else None  # plain search is enough where folding is simple
    for name, pattern, gate, fold, marks in _COMPILED:
        if names is not None and name not in names:
            continue
        if low is None:
            if not gate.search(text):
                continue
        else:
            held = low if fold else text
            for mark in marks:
                if mark in held:
                    break
            else:
                continue

        def put(m, name=name) -> str:
            value = m.group(2)
            if is_placeholder(value):
                return m.group()
            counts[name] += 1
            return m.group(1) + replacement(value, name, mode, seed) + m.group(3)

        new = pattern.sub(put, text)
        if new is not text and new != text:
            text, low = new, new.lower() if new.isascii() else None
    return text


def apply_passes(text: str, mode: str, seed: int, counts: Counter, passes: int, names: frozenset[str] | None = None) -> str:
    """Up to `passes` passes; one that changes nothing is the last, since the next could not either."""
    for _ in range(passes):
        before, text = text, apply_rules(text, mode, seed, counts, names)
        if text == before:
            break
    return text


def redact_text(text: str | None, config: RedactionConfig, passes: int = 2) -> tuple[str | None, dict[str, int]]:
    """The rule passes of the run contract without a model; counts add up."""
    if text is None:
        return None, {}
    counts: Counter = Counter()
    if config.regex_enabled:
        text = apply_passes(text, config.mode, config.seed, counts, passes)
    return text, dict(counts)


def redacted(text: Column, config: RedactionConfig, passes: int = 2, rules: tuple[str, ...] | None = None) -> Column:
    """Column of `RESULT` by the arrow back end."""
    names = frozenset(rules) if rules else None
    mode, seed = config.mode, config.seed

    @F.pandas_udf(RESULT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            done: list[str | None] = []
            counted: list[dict[str, int]] = []
            for t in texts:
                counts: Counter = Counter()
                done.append(None if t is None else apply_passes(t, mode, seed, counts, passes, names))
                counted.append(dict(counts))
            yield pd.DataFrame({"text": pd.Series(done, dtype=object), "regex_counts": pd.Series(counted, dtype=object)})

    return run(text)


def any_rule(text: Column) -> Column:
    """Whether some rule can match; evaluated in the JVM before anything crosses to Python."""
    gates = "|".join(f"(?:{r.java(r.gate)})" if not r.fold else f"(?iu:{r.gate})" for r in RULES)
    return F.coalesce(text.rlike(gates), F.lit(False))


def with_redaction(df: DataFrame, column: str, config: RedactionConfig, passes: int = 2) -> DataFrame:
    """Add `redaction` (RESULT); texts that no rule can match stay in the JVM."""
    text = F.col(column)
    plain = F.struct(text.alias("text"), F.create_map().cast("map<string,bigint>").alias("regex_counts"))
    gated = df.withColumn("_gated", F.when(any_rule(text), text)).withColumn("_done", redacted(F.col("_gated"), config, passes))
    return gated.withColumn("redaction", F.when(F.col("_gated").isNotNull(), F.col("_done")).otherwise(plain)).drop("_gated", "_done")


def native_redaction(text: Column, config: RedactionConfig, passes: int = 2) -> Column:
    """Column of `RESULT` made of JVM expressions only.

    The rules are an array of literals that a fold runs over, so the expression stays as
    small as one rule however many rules and passes there are. A rule's matches are taken
    apart into prefix, value and suffix with the gaps between them, and put together again.
    """
    table = F.array(*(F.struct(F.lit(r.name).alias("name"), F.lit(r.java(r.gate)).alias("gate"), F.lit(r.java()).alias("pattern")) for r in RULES * passes))
    names = F.array(*(F.lit(r.name) for r in RULES))
    start = F.struct(text.alias("text"), F.array().cast("array<string>").alias("hits"))

    def step(state: Column, rule: Column) -> Column:
        group = lambda i: F.regexp_extract_all(state["text"], rule["pattern"], F.lit(i))
        parts = F.array(F.struct(group(1).alias("pre"), group(2).alias("val"), group(3).alias("suf"), F.split(state["text"], rule["pattern"], -1).alias("gaps")))

        def put(p: Column) -> Column:
            new = lambda x: F.concat(x["pre"], F.when(is_placeholder_column(x["val"]), x["val"]).otherwise(replacement_column(x["val"], rule["name"], config.mode, config.seed)), x["suf"])
            filled = F.transform(F.arrays_zip(p["pre"].alias("pre"), p["val"].alias("val"), p["suf"].alias("suf")), new)
            joined = F.array_join(F.zip_with(p["gaps"], F.concat(filled, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
            counted = F.transform(F.filter(p["val"], lambda v: ~is_placeholder_column(v)), lambda v: rule["name"])
            return F.struct(F.when(F.size(p["val"]) > 0, joined).otherwise(state["text"]).alias("text"), F.concat(state["hits"], counted).alias("hits"))

        return F.when(F.coalesce(F.rlike(state["text"], rule["gate"]), F.lit(False)), F.get(F.transform(parts, put), F.lit(0))).otherwise(state)

    def finish(state: Column) -> Column:
        counts = F.map_from_arrays(names, F.transform(names, lambda n: F.size(F.filter(state["hits"], lambda h: h == n)).cast("bigint")))
        return F.struct(state["text"].alias("text"), F.map_filter(counts, lambda _, n: n > 0).alias("regex_counts"))

    return F.aggregate(table, start, step, finish)


def with_redaction_native(df: DataFrame, column: str, config: RedactionConfig, passes: int = 2) -> DataFrame:
    """Add `redaction` (RESULT) with JVM expressions only; texts that no rule can match skip the fold."""
    text = F.col(column)
    plain = F.struct(text.alias("text"), F.create_map().cast("map<string,bigint>").alias("regex_counts"))
    return df.withColumn("redaction", F.when(any_rule(text), native_redaction(text, config, passes)).otherwise(plain))
