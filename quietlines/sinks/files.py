"""Writing sanitized files under their own names, and the archive of a run."""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietlines.operators.reports import NOTICE
from quietlines.plans.tables import durable

WORKSPACE = "quietlines-run-"
READ_FIRST = f"""Sanitized session logs

{NOTICE}

Beside the sanitized files this archive holds redaction_report.json. The report has
counts and categories only, never a value that was found.
"""


def safe_relative(path: str) -> str:
    """A path that cannot leave the output folder."""
    parts = [p for p in path.replace("\\", "/").split("/") if p not in ("", ".", "..")]
    return "/".join(parts) or "sanitized.jsonl"


def write_lines(lines: DataFrame, root: str, path: str = "relative_path", output: str = "output") -> DataFrame:
    """Write every file of (path, line_number, output) under `root` and return (path, bytes_out).

    Rows are range-partitioned by file and line, so that a file of any size is sorted by
    many tasks; each task writes its stretch as a part and the parts are joined in order.
    """
    parts_root = os.path.join(root, ".parts")
    ordered = lines.select(path, "line_number", output).repartitionByRange(path, "line_number").sortWithinPartitions(path, "line_number")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        context = TaskContext.get()
        written: dict[str, str] = {}
        sizes: dict[str, int] = {}
        for rows in batches:
            for name, held in rows.groupby(path, sort=False):
                relative = safe_relative(name)
                target = Path(parts_root, relative, f"{context.partitionId():08d}.{context.taskAttemptId()}")
                target.parent.mkdir(parents=True, exist_ok=True)
                with open(target, "a" if name in written else "w", encoding="utf-8", errors="replace", newline="\n") as f:
                    f.writelines(("" if t is None else t) + "\n" for t in held[output])
                written[name] = str(target)
                sizes[name] = target.stat().st_size
        yield pd.DataFrame([(n, p, context.partitionId(), sizes[n]) for n, p in written.items()], columns=["path", "part", "task", "bytes"])

    parts = ordered.mapInPandas(run, "path string, part string, task int, bytes bigint").persist()
    joined = parts.groupBy("path").agg(F.sum("bytes").alias("bytes_out"), F.transform(F.array_sort(F.collect_list(F.struct("task", "part"))), lambda s: s["part"]).alias("parts"))

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for name, pieces in zip(rows["path"], rows["parts"], strict=True):
                target = Path(root, safe_relative(name))
                target.parent.mkdir(parents=True, exist_ok=True)
                unfinished = target.with_name(target.name + ".unfinished")
                with open(unfinished, "wb") as out:
                    for piece in pieces:
                        with open(piece, "rb") as f:
                            shutil.copyfileobj(f, out)
                os.replace(unfinished, target)  # readers never see a partial file
            yield rows[["path", "bytes_out"]].rename(columns={"path": "relative_path"})

    done = durable(joined.mapInPandas(join, "relative_path string, bytes_out bigint"))
    parts.unpersist()
    shutil.rmtree(parts_root, ignore_errors=True)
    return done


def build_archive(root: str | Path, paths: Iterable[str], report: dict, target: str | Path) -> Path:
    """A zip of the sanitized files that exist, the report and a note."""
    target = Path(target)
    with zipfile.ZipFile(target, "w", compression=zipfile.ZIP_DEFLATED) as z:
        for path in paths:
            file = Path(root, safe_relative(path))
            if file.is_file():
                z.write(file, arcname=safe_relative(path))
        z.writestr("redaction_report.json", json.dumps(report, indent=2, ensure_ascii=False))
        z.writestr("README_FIRST.txt", READ_FIRST)
    return target


def make_workspace(hours: float = 6.0) -> Path:
    """A new folder for one run; folders of runs older than `hours` are removed."""
    clean_workspaces(hours)
    return Path(tempfile.mkdtemp(prefix=WORKSPACE))


def clean_workspaces(hours: float = 6.0) -> None:
    oldest = time.time() - hours * 3600
    for folder in Path(tempfile.gettempdir()).glob(WORKSPACE + "*"):
        try:
            if folder.is_dir() and folder.stat().st_mtime < oldest:
                shutil.rmtree(folder, ignore_errors=True)
        except OSError:
            continue
