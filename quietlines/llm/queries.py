"""The queries of the training-data operators, over whole tables."""

from __future__ import annotations

import importlib
import warnings
from collections.abc import Callable
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietlines.plans.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _operator(name: str) -> ModuleType | None:
    """A module of this subpackage, or None with a warning where a library it needs is missing."""
    try:
        return importlib.import_module(f"quietlines.llm.{name}")
    except ImportError as error:
        if (error.name or "").startswith("quietlines"):
            raise
        warnings.warn(f"queries of {name} left out: {error}", stacklevel=2)
        return None


credentials, packing, pii, splitting, subjects, tokens = map(_operator, ("credentials", "packing", "pii", "splitting", "subjects", "tokens"))


def _code(spark: SparkSession, d: str) -> DataFrame:
    parts = (("codex_session", "input.cmd"), ("claude_session", "input.command"), ("pi_session", "input"))
    rows = [table(spark, d, t).select(F.lit(t).alias("tbl"), "row_id", F.col(c).alias("code")) for t, c in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def _prose(spark: SparkSession, d: str) -> DataFrame:
    parts = (("codex_session", "content"), ("claude_session", "message"), ("pi_session", "text"))
    rows = [table(spark, d, t).select(F.lit(t).alias("tbl"), "row_id", F.col(c).alias("text")) for t, c in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = credentials.with_credentials(_code(spark, d), "code")
    return found.select("tbl", "row_id", F.explode("credential_spans").alias("s")).select("tbl", "row_id", "s.start_pos", "s.end_pos").distinct()


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every text of the three fields, with its credentials replaced."""
    return credentials.with_credentials(_code(spark, d), "code", "redacted").select("tbl", "row_id", "redacted", F.size("credential_spans").alias("n_credentials"))


def _oversized(spark: SparkSession, d: str) -> DataFrame:
    return splitting.oversized(table(spark, d, "claude_session"), table(spark, d, "trace_files"), table(spark, d, "redaction_configs"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _oversized(spark, d).select("row_id")


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.pieces(table(spark, d, "claude_session"), table(spark, d, "trace_files"), table(spark, d, "redaction_configs"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    found = pii.find_pii(_prose(spark, d))
    return found.select("tbl", "row_id", F.explode("spans").alias("s")).select("tbl", "row_id", "s.pii_kind", "s.start_pos", "s.end_pos")


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    """The texts that mention persons, with typed placeholders."""
    found = pii.find_pii(_prose(spark, d), keep=("tbl", "row_id", "text"))
    return found.select("tbl", "row_id", pii.replace_spans("text").alias("redacted"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.with_ids(table(spark, d, "documents"), "doc_id", "text")


def p6_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """How many documents decode to their text again, and the tokens of the corpus."""
    trips = tokens.round_trip(table(spark, d, "documents"), "doc_id", "text")
    return trips.groupBy("same").agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), table(spark, d, "pack_limits"))


def p7_summary(spark: SparkSession, d: str) -> DataFrame:
    return packing.summary(p7_containers(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.find_subjects(table(spark, d, "documents"), table(spark, d, "doc_labels"), table(spark, d, "subject_areas")).select("doc_id", "subject")


def p8_composition(spark: SparkSession, d: str) -> DataFrame:
    """Documents and their share of the corpus by subject, source and language."""
    documents = table(spark, d, "documents")
    lang = F.lower(F.substring_index("lang", "-", 1)).alias("lang")
    found = p8_found(spark, d).join(documents.select("doc_id", "source", lang), "doc_id")
    return found.groupBy("subject", "source", "lang").agg(F.count("*").alias("documents"))


def queries() -> dict[str, Query]:
    own = (
        (credentials, (p1_found, p1_redacted)),
        (splitting, (p2_found, p2_pieces)),
        (pii, (p3_found, p3_redacted)),
        (tokens, (p6_ids, p6_roundtrip)),
        (packing, (p7_containers, p7_summary)),
        (subjects, (p8_found, p8_composition)),
    )
    return {q.__name__: q for needed, some in own if needed for q in some}


def oracle_sql() -> dict[str, str]:
    """SQL where it can say the same; the others are tested against brute force."""
    joined = """claude_session s
            JOIN (SELECT relative_path, max(config_id) AS config_id FROM trace_files GROUP BY relative_path) f USING (relative_path)
            JOIN redaction_configs c USING (config_id)
            WHERE length(s.content) > c.chunk_size"""
    # The end of a core: as far as a boundary of the strongest kind that the second half of the window holds.
    kinds = (r"\n[ \t]{0,8}\r?\n", r"\n", r"[.!?。！？;][\"'')\]]?[\s\x0b]", r"[。！？\s\x0b]")
    ends = ", ".join(f"CASE WHEN length(regexp_extract(w, '(?s)^.*{k}')) >= least THEN length(regexp_extract(w, '(?s)^.*{k}')) END" for k in kinds)
    size = f"CASE WHEN length(content) - pos <= core THEN length(content) - pos ELSE coalesce({ends}, core) END"
    return {
        "p2_found": f"SELECT s.row_id FROM {joined}",
        "p2_pieces": f"""
            WITH RECURSIVE big AS (
                SELECT row_id, content, chunk_size, lap, chunk_size - lap AS core, greatest((chunk_size - lap) // 2, 1) AS least
                FROM (SELECT s.row_id, s.content, c.chunk_size, CASE WHEN greatest(coalesce(overlap_chars, 0), 0) < c.chunk_size THEN greatest(coalesce(overlap_chars, 0), 0) ELSE c.chunk_size - greatest(c.chunk_size // 8, 1) END AS lap FROM {joined})),
            p AS (
                SELECT row_id, content, chunk_size, lap, core, least, 0 AS piece_no, lap AS pos, lap + {size} AS stop FROM (SELECT *, lap AS pos, substring(content, lap + 1, core) AS w FROM big)
                UNION ALL
                SELECT row_id, content, chunk_size, lap, core, least, piece_no + 1, pos, pos + {size} FROM (SELECT * EXCLUDE (pos), stop AS pos, substring(content, stop + 1, core) AS w FROM p WHERE stop < length(content)))
            SELECT row_id, chunk_size, piece_no, (pos - lap)::BIGINT AS start_pos, stop::BIGINT AS end_pos, substring(content, pos - lap + 1, stop - pos + lap) AS piece FROM p""",
    }
