"""Finding session files: known places, folders, uploads; one row per file.

Listing runs on the driver (names and sizes only), because built-in readers drop names
that begin with `_` and read brackets as patterns; everything that opens files (line
counts, binary check) can run on executors through `measured`.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from pathlib import Path
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietlines.functions.text import agent_guess, is_likely_trace, size_kb, size_status, truthy

# Endings of session files, folders never entered, where agents keep sessions.
ENDINGS = (".jsonl", ".ndjson", ".json")
SKIPPED = frozenset({".git", ".hg", ".svn", "__pycache__", ".pytest_cache", ".ruff_cache", "node_modules"})
KNOWN = {"Codex": "~/.codex/sessions", "Claude Code": "~/.claude/projects", "Pi Agent": "~/.pi/agent/sessions"}
SNIFFED = 4096

LISTED = "path string, relative_path string, filename string, size_bytes bigint, line_count bigint, binary boolean"


class Listed(NamedTuple):
    path: str
    relative_path: str
    size_bytes: int


def is_candidate(name: str) -> bool:
    return not name.startswith(".") and name.lower().endswith(ENDINGS)


def candidate_files(root: Path) -> Iterator[Path]:
    """Session files under a folder, or the file itself; hidden sub-folders are skipped."""
    if root.is_file():
        if is_candidate(root.name):
            yield root
        return
    for folder, below, names in os.walk(root):
        below[:] = sorted(b for b in below if b not in SKIPPED and not b.startswith("."))
        yield from (Path(folder, n) for n in sorted(names) if is_candidate(n))


def list_root(root: str | Path, base: Path | None = None) -> list[Listed]:
    """The files of one root; a file reached twice counts once."""
    root = Path(root).expanduser()
    if not root.exists():
        return []
    base = (base or (root if root.is_dir() else root.parent)).resolve()
    seen: dict[Path, Listed] = {}
    for file in candidate_files(root):
        real = file.resolve()
        if real in seen:
            continue
        try:
            size = real.stat().st_size
        except OSError:
            continue
        relative = real.relative_to(base).as_posix() if real.is_relative_to(base) else real.name
        seen[real] = Listed(str(real), relative, size)
    return list(seen.values())


def common_parent(paths: list[Path]) -> Path:
    if len(paths) == 1:
        return paths[0] if paths[0].is_dir() else paths[0].parent
    return Path(os.path.commonpath([p.resolve() for p in paths]))


def measure(path: str) -> tuple[int | None, bool]:
    """(lines, binary) of a file; the lines of a file that cannot be read are unknown."""
    lines, last, first = 0, b"\n", True
    try:
        with open(path, "rb") as f:
            while block := f.read(1 << 20):
                if first and b"\0" in block[:SNIFFED]:
                    return 0, True
                first = False
                lines += block.count(b"\n")
                last = block[-1:]
    except OSError:
        return None, False
    return lines + (last != b"\n"), False


def measured(spark: SparkSession, files: list[Listed], warn_mb: int = 50) -> DataFrame:
    """Rows of session files, without binary ones; files are opened on the executors."""
    rows = spark.createDataFrame([tuple(f) for f in files], "path string, relative_path string, size_bytes bigint")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            sizes = [measure(p) for p in rows["path"]]
            rows["filename"] = [os.path.basename(p) for p in rows["path"]]
            rows["line_count"], rows["binary"] = pd.array([s[0] for s in sizes], dtype="Int64"), [s[1] for s in sizes]
            yield rows[["path", "relative_path", "filename", "size_bytes", "line_count", "binary"]]

    wide = max(1, min(len(files), spark.sparkContext.defaultParallelism * 4))
    return (
        rows.repartition(wide)
        .mapInPandas(run, LISTED)
        .where("NOT binary")
        .drop("binary")
        .withColumn("agent_guess", agent_guess(F.col("path")))
        .withColumn("status", size_status(F.col("size_bytes"), warn_mb))
        .withColumn("size_kb", size_kb(F.col("size_bytes")))
    )


def list_roots(roots: Iterable[str | Path]) -> list[Listed]:
    """The files of several roots, each once; names that two roots share get the root's name before them."""
    found: dict[str, Listed] = {}
    real: set[str] = set()
    for root in roots:
        for f in list_root(root):
            if f.path in real:
                continue
            real.add(f.path)
            name, n = f.relative_path, 1
            while name in found:
                n += 1
                name = f"{Path(root).expanduser().resolve().name or 'root'}{'' if n == 2 else f'-{n}'}/{f.relative_path}"
            found[name] = f._replace(relative_path=name)
    return list(found.values())


def discover_roots(spark: SparkSession, roots: Iterable[str | Path], warn_mb: int = 50) -> DataFrame:
    return measured(spark, list_roots(roots), warn_mb).orderBy("relative_path")


def discover_samples(spark: SparkSession, warn_mb: int = 50) -> DataFrame:
    """The sample sessions that come with the package; all secrets in them are invented."""
    return discover_roots(spark, [Path(__file__).parent.parent / "samples"], warn_mb)


def named_files(value: object) -> list[str]:
    """Paths from what a caller hands over: nothing, one path, or a list of paths and of objects with a `name`."""
    if value is None:
        return []
    if isinstance(value, (str, Path)):
        return [str(value)]
    return [str(v) if isinstance(v, (str, Path)) else str(v.name) for v in value if isinstance(v, (str, Path)) or hasattr(v, "name")]


def selection_table(spark: SparkSession, table: object, path_column: int = 2) -> DataFrame:
    """(selected, relative_path) from a table-like thing: a Spark or pandas frame, `{"data": rows}` or a list of rows.

    In rows the mark comes first and the path stands at `path_column`; shorter rows are dropped.
    """
    if isinstance(table, DataFrame):
        return table.select(F.col("selected").cast("string").alias("selected"), "relative_path")
    if isinstance(table, dict):
        table = table.get("data")
    rows = table.values.tolist() if hasattr(table, "values") else [list(r) for r in table] if isinstance(table, list) else []
    marks = [(str(r[0]), str(r[path_column])) for r in rows if len(r) > path_column]
    return spark.createDataFrame(marks, "selected string, relative_path string")


def discover_path(spark: SparkSession, path: str | Path, warn_mb: int = 50) -> DataFrame:
    return discover_roots(spark, [path], warn_mb)


def discover_known(spark: SparkSession, name: str, warn_mb: int = 50) -> DataFrame:
    return discover_roots(spark, [KNOWN[name]], warn_mb)


def discover_uploads(spark: SparkSession, paths: Iterable[str | Path | None], warn_mb: int = 50) -> DataFrame:
    """Uploaded files and folders, relative to what they have in common."""
    given = [Path(p) for p in paths if p]
    if not given:
        return measured(spark, [], warn_mb)
    base = common_parent(given)
    return measured(spark, [f for p in given for f in list_root(p, base)], warn_mb)


def select_files(files: DataFrame, selection: DataFrame) -> DataFrame:
    """The files whose relative path a selection table (selected, relative_path) has marked."""
    return files.join(selection.where(truthy(F.col("selected").cast("string"))).select("relative_path").distinct(), "relative_path", "left_semi")


def with_selection(files: DataFrame, which: str = "likely") -> DataFrame:
    """Add `selected`: all, none, or the files that are likely session logs."""
    flag = {"all": F.lit(True), "none": F.lit(False), "likely": F.coalesce(is_likely_trace(F.col("filename")), F.lit(False))}[which]
    return files.withColumn("selected", flag)
