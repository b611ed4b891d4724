"""The library's entry points."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quietlines.config import RedactionConfig
from quietlines.operators import json_lines, reports
from quietlines.operators.model import PIIRedactor, with_model
from quietlines.operators.model import chunks as model_chunks
from quietlines.operators.redact import redact_text, redacted, with_redaction
from quietlines.plans.tables import durable
from quietlines.sinks.files import build_archive, write_lines
from quietlines.sources.discovery import discover_roots, select_files
from quietlines.sources.trace_lines import read_lines

Factory = Callable[[], PIIRedactor]


def sanitize_texts(df: DataFrame, text: str, config: RedactionConfig, model: Factory | None = None) -> DataFrame:
    """Rules, then the model on distinct texts, then the rules again; counts add up.

    Adds `text`'s sanitized form as `sanitized`, and `regex_counts`, `pii_counts`.
    """
    config.require_a_pass()
    none = F.create_map().cast("map<string,bigint>")
    use_model = config.model_enabled and model is not None
    first = with_redaction(df, text, config, passes=1 if use_model else 2) if config.regex_enabled else df.withColumn("redaction", F.struct(F.col(text).alias("text"), none.alias("regex_counts")))
    out = first.withColumn("_first", F.col("redaction.text")).withColumn("regex_counts", F.col("redaction.regex_counts")).drop("redaction")
    if not use_model:
        return out.withColumn("sanitized", F.col("_first")).withColumn("pii_counts", none).drop("_first")
    out = with_model(out, "_first", model).withColumnRenamed("model_text", "sanitized").drop("_first")
    if config.regex_enabled:
        out = with_redaction(out, "sanitized", config, passes=1)
        added = F.map_zip_with("regex_counts", "redaction.regex_counts", lambda _, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
        out = out.withColumn("regex_counts", added).withColumn("sanitized", F.col("redaction.text")).drop("redaction")
    return out


def sanitize_text(column, config: RedactionConfig):
    """Column: the text after both rule passes."""
    return redacted(column, config)["text"]


def sanitize_lines(lines: DataFrame, config: RedactionConfig, model: Factory | None = None, strict: bool = False) -> DataFrame:
    """(relative_path, line_number, raw, output, invalid_json, regex_counts, pii_counts, error) of JSON lines.

    Without a model one Python stage does all. With one, every line gets an id of its own in
    a durable copy, so that lines delivered twice or files of one name never mix; the leaves
    of all lines are exploded, sanitized by distinct text, and put back by id and position.
    """
    config.require_a_pass()
    none = F.create_map().cast("map<string,bigint>")
    if not (config.model_enabled and model is not None):
        done = json_lines.sanitize_json(lines, config, strict=strict)
        own = F.col("error") if "error" in lines.columns else F.lit(None).cast("string")
        kept = [c for c in lines.columns if c != "error"]
        return done.select(*kept, "line.output", "line.invalid_json", "line.regex_counts", F.coalesce(own, "line.error").alias("error")).withColumn("pii_counts", none)
    own = lines if "error" in lines.columns else lines.withColumn("error", F.lit(None).cast("string"))
    if not config.preserve_json_structure:
        done = sanitize_texts(own, "raw", config, model)
        return done.withColumnRenamed("sanitized", "output").withColumn("invalid_json", F.lit(False))
    marked = durable(json_lines.json_leaves(own).withColumn("_line", F.monotonically_increasing_id()))
    leaves = marked.select("_line", F.explode("leaves").alias("leaf")).select("_line", "leaf.idx", F.col("leaf.value").alias("value"))
    clean = durable(sanitize_texts(leaves, "value", config, model).select("_line", "idx", "sanitized", "regex_counts", "pii_counts"))
    entries = lambda c: F.transform(F.map_entries(c), lambda e: F.struct(F.lit(c).alias("map"), e["key"].alias("key"), e["value"].alias("n")))
    per_line = clean.groupBy("_line").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("idx", "sanitized"))), lambda s: s["sanitized"]).alias("redacted"),
        F.flatten(F.collect_list(F.concat(entries("regex_counts"), entries("pii_counts")))).alias("counts"),
    )

    def summed(name: str) -> Column:
        own = F.filter(F.coalesce("counts", F.array().cast("array<struct<map:string,key:string,n:bigint>>")), lambda e: e["map"] == name)
        keys = F.array_sort(F.array_distinct(F.transform(own, lambda e: e["key"])))
        return F.map_from_arrays(keys, F.transform(keys, lambda k: F.aggregate(F.filter(own, lambda e: e["key"] == k), F.lit(0).cast("bigint"), lambda a, e: a + e["n"])))

    out = json_lines.rebuild(marked.join(per_line, "_line", "left"))
    return out.withColumn("regex_counts", summed("regex_counts")).withColumn("pii_counts", summed("pii_counts")).drop("redacted", "counts", "leaves", "_line")


def scrub_files(spark: SparkSession, roots: Iterable[str | Path], target: str | Path, config: RedactionConfig, model: Factory | None = None, selection: DataFrame | None = None) -> dict:
    """Discover, sanitize and package session files; returns the counts-only report.

    A failing model stops the run (ModelRedactionError); nothing partial is packaged. A file
    that cannot be read or sanitized is reported with its error and not written; the others
    are. The report of a run is one small row per file.
    """
    began = time.monotonic()
    target = Path(target)
    files = discover_roots(spark, roots)
    if selection is not None:
        files = select_files(files, selection)
    if files.isEmpty():
        raise ValueError("no session file was selected")
    config.require_a_pass()
    lines = durable(sanitize_lines(read_lines(spark, files), config, model))
    failed = lines.where("error IS NOT NULL").select("relative_path").distinct()
    written = write_lines(lines.join(failed, "relative_path", "left_anti"), str(target / "sanitized"))
    per_file = reports.file_report(lines).drop("bytes_in", "bytes_out")
    sizes = files.select(F.col("relative_path").alias("input_relative_path"), F.col("size_bytes").alias("bytes_in"))
    empty = F.array().cast("array<string>")
    complete = (
        sizes.join(per_file, "input_relative_path", "left")
        .join(written.withColumnRenamed("relative_path", "input_relative_path"), "input_relative_path", "left")
        .fillna({"bytes_out": 0, "lines_processed": 0, "invalid_json_lines": 0})
        .withColumns({c: F.coalesce(c, empty) for c in ("errors", "warnings")})
        .withColumn("duration_seconds", F.lit(round(time.monotonic() - began, 3)))
        .orderBy("input_relative_path")
    )
    rows = [r.asDict(recursive=True) for r in complete.collect()]
    totals = reports.aggregate_report(complete).first().asDict(recursive=True)
    report = reports.package_report(rows, totals, config)
    build_archive(target / "sanitized", [r["input_relative_path"] for r in rows if not r["errors"]], report, target / "sanitized_sessions.zip")
    return report


def register_functions(spark: SparkSession, config: RedactionConfig | None = None, prefix: str = "") -> None:
    """Make redaction, hashing and chunking available to SQL.

    `redact(text)` gives the text after both rule passes, `redact_counts(text)` the counts,
    `stable_hash(text, label)` the ten hex digits, and the table function `chunks(text, size)`
    rows of (chunk_no, start_pos, chunk).
    """
    config = config or RedactionConfig()

    @F.pandas_udf("string")
    def text_of(texts: pd.Series) -> pd.Series:
        return pd.Series([redact_text(t, config)[0] for t in texts], dtype=object)

    @F.pandas_udf("map<string,bigint>")
    def counts_of(texts: pd.Series) -> pd.Series:
        return pd.Series([redact_text(t, config)[1] for t in texts], dtype=object)

    @F.udtf(returnType="chunk_no: int, start_pos: int, chunk: string")
    class Chunks:
        def eval(self, text: str, size: int):
            for i, (chunk, start) in enumerate(model_chunks(text, size) if text else []):
                yield i, start, chunk

    spark.udf.register(f"{prefix}redact", text_of)
    spark.udf.register(f"{prefix}redact_counts", counts_of)
    spark.udtf.register(f"{prefix}chunks", Chunks)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}stable_hash(value STRING, label STRING) RETURNS STRING RETURN substring(sha2(concat('{config.seed}|', label, '|', value), 256), 1, 10)")
