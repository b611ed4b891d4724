"""The queries of the core operators and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietlines.operators import drift, rejects
from quietlines.plans import redaction_queries
from quietlines.plans.tables import table

redact_mask = redaction_queries.redact_mask

Query = Callable[[SparkSession, str], DataFrame]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    lines = rejects.rejected_lines(table(spark, d, "trace_lines").select(F.col("line_id").alias("row_id"), "raw"))
    records = rejects.check_records(table(spark, d, "report_rows").select(F.col("record_id").alias("row_id"), "raw")).where("reason IS NOT NULL")
    return lines.select(F.lit("trace_lines").alias("tbl"), "row_id").unionByName(records.select(F.lit("report_rows").alias("tbl"), "row_id"))


def p4_rejects(spark: SparkSession, d: str) -> DataFrame:
    """Every row that fails to parse, with the reason and the first broken field."""
    lines = rejects.rejected_lines(table(spark, d, "trace_lines").select(F.col("line_id").alias("row_id"), "raw"))
    records = rejects.check_records(table(spark, d, "report_rows").select(F.col("record_id").alias("row_id"), "raw")).where("reason IS NOT NULL")
    columns = ["row_id", "raw", "reason", "broken_field"]
    return lines.select(F.lit("trace_lines").alias("tbl"), *columns).unionByName(records.select(F.lit("report_rows").alias("tbl"), *columns))


def p4_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines that parse."""
    return rejects.valid_lines(table(spark, d, "trace_lines").select("line_id", "relative_path", "line_number", "raw"))


def p4_reports(spark: SparkSession, d: str) -> DataFrame:
    """The records that parse, as typed columns."""
    return rejects.load_records(table(spark, d, "report_rows"))


def p4_report_values(spark: SparkSession, d: str) -> DataFrame:
    """What the loaded records hold, as plain values."""
    r = rejects.load_records(table(spark, d, "report_rows"))
    total = lambda c: F.aggregate(F.map_values(c), F.lit(0).cast("bigint"), lambda a, v: a + v).alias(c)
    listed = lambda c: F.array_join(c, "|").alias(c)
    plain = [n for n, kind in rejects.REPORT_SCHEMA if not kind.startswith("json")]
    return r.select("record_id", *plain, listed("errors"), listed("warnings"), total("counts_by_pii_label"), total("counts_by_regex_secret_rule"))


def p4_file_report(spark: SparkSession, d: str) -> DataFrame:
    """invalid_json_lines and errors of every file."""
    lines = table(spark, d, "trace_lines").select("line_id", "relative_path", "line_number", "raw")
    return rejects.line_report(lines, rejects.rejected_lines(lines).drop("raw"))


def p5_changes(spark: SparkSession, d: str) -> DataFrame:
    """Every change of every file, with the new names of renamed fields."""
    return drift.schema_changes(table(spark, d, "trace_lines"), table(spark, d, "schema_baseline"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_changes(spark, d).select("relative_path", "field_name", "change_kind").distinct()


def _p5_table(agent: str) -> Query:
    return lambda spark, d: drift.consistent_table(table(spark, d, "trace_lines"), table(spark, d, "schema_baseline"), agent)


def queries() -> dict[str, Query]:
    own = (p4_found, p4_rejects, p4_lines, p4_reports, p4_report_values, p4_file_report, p5_found, p5_changes)
    drawn = redaction_queries.queries() | {q.__name__: q for q in own}
    return drawn | {f"p5_table_{a.partition('-')[0]}": _p5_table(a) for a in ("codex", "claude-code", "pi-agent")}


def _record_sql() -> str:
    """SQL expression for a whole report record."""
    ws, text = r"[ \t\n\r]*", r'""([^"\\\x00-\x1f]|\\(""|[\\/bfnrt]|u[0-9a-fA-F]{4}))*""'
    pair = rf"{text}{ws}:{ws}(0|[1-9][0-9]*)"
    kinds = {
        "path": r'("([^"]|"")+"|[^",\r\n]+)',
        "digits": r'("[0-9]+"|[0-9]+)',
        "decimal": r'("[0-9]+(\.[0-9]+)?"|[0-9]+(\.[0-9]+)?)',
        "json_strings": rf'("{ws}\[{ws}({text}{ws}(,{ws}{text}{ws})*)?\]{ws}"|[ \t]*\[[ \t]*\][ \t]*)',
        "json_counts": rf'("{ws}\{{{ws}({pair}{ws}(,{ws}{pair}{ws})*)?\}}{ws}"|[ \t]*\{{[ \t]*\}}[ \t]*)',
    }
    return ",".join(kinds[k] for _, k in rejects.REPORT_SCHEMA)


def oracle_sql() -> dict[str, str]:
    lines = redaction_queries.json_valid_sql("raw")
    bad = f"""
        SELECT 'trace_lines' AS tbl, line_id AS row_id FROM trace_lines WHERE NOT {lines}
        UNION ALL SELECT 'report_rows', record_id FROM report_rows WHERE NOT coalesce(regexp_full_match(raw, '{_record_sql()}'), false)"""
    cell = {n: f"CASE WHEN starts_with(c[{i}], '\"') THEN replace(c[{i}][2:-2], '\"\"', '\"') ELSE c[{i}] END" for i, (n, _) in enumerate(rejects.REPORT_SCHEMA, 1)}
    typed = {"path": "{}", "digits": "({})::BIGINT", "decimal": "({})::DOUBLE", "json_strings": "coalesce(array_to_string(json_extract_string({}, '$[*]'), '|'), '')", "json_counts": "coalesce(list_sum(json_extract({}, '$.*')::BIGINT[]), 0)::BIGINT"}
    columns = ", ".join(f"{typed[kind].format(cell[n])} AS {n}" for n, kind in rejects.REPORT_SCHEMA)
    field = r',("([^"]|"")*"|[^",\r\n]*)'
    values = f"""
        SELECT record_id, {columns} FROM (SELECT record_id, regexp_extract_all(',' || raw, '{field}', 1) AS c FROM report_rows WHERE coalesce(regexp_full_match(raw, '{_record_sql()}'), false))"""
    own = {"p4_found": bad, "p4_lines": f"SELECT line_id, relative_path, line_number, raw FROM trace_lines WHERE {lines}", "p4_report_values": values}
    return redaction_queries.oracle_sql() | own
