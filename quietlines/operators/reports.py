"""Counts-only reports: per file, over all files, and previews.

Reports never hold matched values. Counts are summed on the map side before they are
shuffled; warnings of a file are cut by rank, not by collecting them all.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quietlines import __version__
from quietlines.config import RedactionConfig
from quietlines.plans.tables import durable

# How many warnings a file keeps, and what they say.
MOST_WARNINGS = 100
#: Tasks that share the invalid lines of one file.
SHARES = 64
OMITTED = "Additional invalid JSON line warnings omitted."
NOTICE = "Automated redaction is imperfect: read the sanitized traces before you share them."


def warning_text(line_number: Column) -> Column:
    return F.concat(F.lit("Line "), line_number.cast("string"), F.lit(" is invalid JSON; sanitized as raw text."))


def summed_maps(df: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """Per key: the sum of map values by map key, as one map in key order."""
    pairs = df.select(*keys, F.explode(column).alias("_k", "_v")).groupBy(*keys, "_k").agg(F.sum("_v").alias("_v"))
    entries = F.array_sort(F.collect_list(F.struct("_k", "_v")))  # one entry per rule or label
    return pairs.groupBy(*keys).agg(F.map_from_entries(entries).alias(name))


def file_report(lines: DataFrame) -> DataFrame:
    """Per file, from (relative_path, line_number, raw, output, invalid_json, regex_counts, pii_counts) and, if there, `error`.

    One pass: every line becomes rows of one kind (totals, a count of a rule or a label, an
    invalid line), all summed on the map side by (file, kind, name). The report keeps the
    first MOST_WARNINGS invalid lines of a file, as its contract says; all of them with
    their reasons come from `rejects.rejected_lines`. A file with an error reports only its size and the error.
    """
    size = lambda c: F.octet_length(c).cast("bigint") + 1
    error = F.col("error") if "error" in lines.columns else F.lit(None).cast("string")
    number = F.col("line_number").cast("bigint")
    fact = "struct<kind:string,name:string,n:bigint,bytes_in:bigint,bytes_out:bigint,last:bigint>"

    def facts(kind: str, counts: str) -> Column:
        entry = lambda e: F.struct(F.lit(kind).alias("kind"), e["key"].alias("name"), e["value"].alias("n"), F.lit(0).alias("bytes_in"), F.lit(0).alias("bytes_out"), F.lit(0).alias("last")).cast(fact)
        return F.coalesce(F.transform(F.map_entries(counts), entry), F.array().cast(f"array<{fact}>"))

    one = lambda kind, name, n: F.struct(F.lit(kind).alias("kind"), name.cast("string").alias("name"), n.cast("bigint").alias("n"), F.lit(0).alias("bytes_in"), F.lit(0).alias("bytes_out"), F.lit(0).alias("last")).cast(fact)
    total = F.struct(F.lit("total").alias("kind"), F.lit("").alias("name"), F.col("invalid_json").cast("bigint").alias("n"), size("raw").alias("bytes_in"), size("output").alias("bytes_out"), number.alias("last")).cast(fact)
    bad = F.when(F.coalesce("invalid_json", F.lit(False)), F.array(one("invalid", number, F.lit(1)))).otherwise(F.array().cast(f"array<{fact}>"))
    failed = F.when(error.isNotNull(), F.array(one("error", error, number))).otherwise(F.array().cast(f"array<{fact}>"))
    rows = lines.select("relative_path", F.explode(F.concat(F.array(total), facts("rule", "regex_counts"), facts("label", "pii_counts"), bad, failed)).alias("f")).select("relative_path", "f.*")
    summed = rows.groupBy("relative_path", "kind", "name").agg(F.sum("n").alias("n"), F.sum("bytes_in").alias("bytes_in"), F.sum("bytes_out").alias("bytes_out"), F.max("last").alias("last"))
    # The names of invalid lines are their numbers; the first of a file go on, found in shares so that no file's are sorted in one task.
    number_of, share = F.when(F.col("kind") == "invalid", F.col("name").cast("bigint")), F.when(F.col("kind") == "invalid", F.pmod(F.xxhash64("name"), F.lit(SHARES))).otherwise(0)
    first = Window.partitionBy("relative_path", "kind", "_share").orderBy("_number")
    ranked = summed.withColumn("_number", number_of).withColumn("_share", share).withColumn("_rank", F.row_number().over(first)).where((F.col("kind") != "invalid") | (F.col("_rank") <= MOST_WARNINGS + 1))
    when = lambda kind, value: F.when(F.col("kind") == kind, value)
    pairs = lambda kind: F.map_from_entries(F.array_sort(F.collect_list(when(kind, F.struct("name", "n")))))
    out = ranked.groupBy("relative_path").agg(
        F.sum(when("total", F.col("bytes_in"))).alias("bytes_in"),
        F.sum(when("total", F.col("bytes_out"))).alias("bytes_out"),
        F.max(when("total", F.col("last"))).alias("lines_processed"),
        F.sum(when("total", F.col("n"))).alias("invalid_json_lines"),
        F.transform(F.array_sort(F.collect_list(when("error", F.struct("n", "name")))), lambda e: F.concat(F.lit("File processing failed: "), e["name"])).alias("errors"),
        F.slice(F.array_sort(F.collect_list(when("invalid", F.struct("_number", "n")))), 1, MOST_WARNINGS + 1).alias("_bad"),
        pairs("label").alias("counts_by_pii_label"),
        pairs("rule").alias("counts_by_regex_secret_rule"),
    )
    # A line delivered twice warns twice.
    said = F.flatten(F.transform("_bad", lambda e: F.array_repeat(warning_text(e["_number"]), F.least(e["n"], F.lit(MOST_WARNINGS + 1)).cast("int"))))
    out = out.withColumn("_said", said).withColumn("warnings", F.when(F.size("_said") > MOST_WARNINGS, F.concat(F.slice("_said", 1, MOST_WARNINGS), F.array(F.lit(OMITTED)))).otherwise(F.col("_said")))
    whole = F.size("errors") == 0
    none_map, none_list = F.create_map().cast("map<string,bigint>"), F.array().cast("array<string>")
    kept = lambda c, none: F.when(whole, F.col(c)).otherwise(none).alias(c)
    return out.select(
        F.col("relative_path").alias("input_relative_path"),
        F.col("relative_path").alias("output_relative_path"),
        "bytes_in",
        *(kept(c, F.lit(0).cast("bigint")) for c in ("bytes_out", "lines_processed", "invalid_json_lines")),
        "errors",
        kept("warnings", none_list),
        kept("counts_by_pii_label", none_map),
        kept("counts_by_regex_secret_rule", none_map),
    )


def progress_events(lines: DataFrame, interval: int = 100) -> DataFrame:
    """What a run over each file reports on its way: (relative_path, line_number, percent, regex_counts, pii_counts).

    The first line, every `interval`th and the last one, with all counts up to there. Lines
    are summed by stretch of `interval` lines on the map side; only stretches are ordered.
    """
    stretch = F.when(F.col("line_number") <= 1, F.lit(0)).otherwise(F.ceil(F.col("line_number") / max(1, interval))).cast("bigint")
    counts = [F.sum(F.aggregate(F.map_values(c), F.lit(0).cast("bigint"), lambda a, v: a + v)).alias(c) for c in ("regex_counts", "pii_counts")]
    summed = lines.withColumn("_stretch", stretch).groupBy("relative_path", "_stretch").agg(F.max("line_number").alias("line_number"), *counts)
    so_far = Window.partitionBy("relative_path").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.max("line_number").over(Window.partitionBy("relative_path"))
    return summed.select("relative_path", "line_number", F.floor(F.col("line_number") * 100 / last).cast("int").alias("percent"), *(F.sum(F.coalesce(c, F.lit(0))).over(so_far).alias(c) for c in ("regex_counts", "pii_counts")))


def running_totals(reports: DataFrame, order: str = "input_relative_path") -> DataFrame:
    """Add `files_so_far`, `lines_so_far` and `invalid_so_far` in the order of a column.

    Rows are range-partitioned and summed inside partitions; the sums of the partitions
    before, one number each, are added, so no task holds all files.
    """
    placed = durable(reports.repartitionByRange(order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    measures = {"files_so_far": F.lit(1), "lines_so_far": F.coalesce("lines_processed", F.lit(0)), "invalid_so_far": F.coalesce("invalid_json_lines", F.lit(0))}
    parts = placed.groupBy("_part").agg(*(F.sum(m).alias(f"_{n}") for n, m in measures.items()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = parts.select("_part", *(F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in measures))
    inside = Window.partitionBy("_part").orderBy(order, "_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = placed.join(F.broadcast(offsets), "_part")
    return joined.select(*reports.columns, *((F.sum(m).over(inside) + F.col(f"_{n}")).alias(n) for n, m in measures.items()))


def aggregate_report(reports: DataFrame) -> DataFrame:
    """One row: totals over all file reports, maps in key order."""
    n = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).cast("bigint").alias(c)
    length = lambda c: F.sum(F.greatest(F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))), F.lit(0))).cast("bigint").alias(c)
    totals = reports.agg(
        F.count("*").alias("files_processed"), n("bytes_in"), n("bytes_out"), n("lines_processed"), n("invalid_json_lines"), F.round(F.sum("duration_seconds"), 3).alias("duration_seconds"), length("errors"), length("warnings")
    )
    empty = F.create_map().cast("map<string,bigint>")
    for c in ("counts_by_pii_label", "counts_by_regex_secret_rule"):
        one = summed_maps(reports.withColumn("_one", F.lit(1)), ["_one"], c, c)
        totals = totals.withColumn("_one", F.lit(1)).join(one, "_one", "left").drop("_one").withColumn(c, F.coalesce(c, empty))
    return totals


def preview_rows(reports: DataFrame) -> DataFrame:
    """The short table: per file its counts."""
    total = lambda c: F.aggregate(F.map_values(F.coalesce(F.col(c), F.create_map().cast("map<string,bigint>"))), F.lit(0).cast("bigint"), lambda a, v: a + v)
    length = lambda c: F.greatest(F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))), F.lit(0))
    return reports.select(
        "input_relative_path",
        "lines_processed",
        "invalid_json_lines",
        total("counts_by_regex_secret_rule").alias("secrets"),
        total("counts_by_pii_label").alias("personal"),
        length("errors").alias("n_errors"),
        length("warnings").alias("n_warnings"),
        F.bround("duration_seconds", 2).alias("duration"),
    )


def rows_for_table(files: DataFrame, selected: bool = True) -> DataFrame:
    """Discovered files as the rows of a selection table."""
    return files.select(F.lit(selected).alias("selected"), "agent_guess", "relative_path", "filename", "size_kb", "line_count", "status")


def output_preview(lines: DataFrame, path: str, most_lines: int = 8, most_chars: int = 4000) -> str:
    """The first lines of one sanitized file, for a look; a bounded top-k."""
    first = lines.where(F.col("relative_path") == path).orderBy("line_number").limit(most_lines).select("output").collect()
    return "\n".join(r["output"] or "" for r in first)[:most_chars]


def package_report(reports: list[dict], totals: dict, config: RedactionConfig) -> dict:
    """The report that goes into an archive: settings, files, totals, notice."""
    return {
        "app_name": "quietlines",
        "app_version": __version__,
        "timestamp": datetime.now(timezone.utc).isoformat(),
        "selected_model": config.model_name,
        "redaction_mode": config.mode,
        "regex_sweep_enabled": config.regex_enabled,
        "model_pii_redaction_enabled": config.model_enabled,
        "preserve_json_structure": config.preserve_json_structure,
        "files_processed": len(reports),
        "files": reports,
        "aggregate_totals": totals,
        "disclaimer": NOTICE,
    }
