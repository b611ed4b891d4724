"""Sanitizing as lines arrive.

The rules need no state, so a stream is a projection; with a model each micro-batch
goes through the distinct-text plan. Progress comes from the query's own metrics, and
the stream stops with `query.stop()`. A failed batch is retried whole from the
checkpoint, so no partial output is committed.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from quietlines.api import Factory, sanitize_lines
from quietlines.config import RedactionConfig
from quietlines.operators.json_lines import sanitize_json


def sanitized_stream(lines: DataFrame, config: RedactionConfig) -> DataFrame:
    """A stream of lines with `output`, `invalid_json` and `regex_counts`; stateless."""
    config.require_a_pass()
    return sanitize_json(lines, config).select("*", "line.output", "line.invalid_json", "line.regex_counts").drop("line")


def counts_by_window(stream: DataFrame, time: str, window: str = "1 hour", late: str = "2 days") -> DataFrame:
    """Lines and invalid lines per window of event time; rows later than `late` are not counted."""
    return (
        stream.withWatermark(time, late)
        .groupBy(F.window(time, window).alias("window"))
        .agg(F.count("*").alias("lines"), F.sum(F.col("invalid_json").cast("bigint")).alias("invalid_json_lines"))
        .select("window.start", "window.end", "lines", "invalid_json_lines")
    )


def scrub_stream(lines: DataFrame, config: RedactionConfig, sink: Callable[[DataFrame, int], None], checkpoint: str, model: Factory | None = None, **trigger) -> StreamingQuery:
    """Run `sink(sanitized batch, batch id)` for every micro-batch."""

    def each(batch: DataFrame, number: int) -> None:
        sink(sanitize_lines(batch, config, model), number)

    return lines.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class ProgressListener(StreamingQueryListener):
    """Hands (batch id, rows so far) to a callback: for the first batch with rows, then whenever `interval`
    more rows have come and `debounce` seconds have passed, and once more at the end if something is unreported."""

    def __init__(self, report: Callable[[int, int], None], interval: int = 1, debounce: float = 0.0, clock: Callable[[], float] = time.monotonic):
        self.report, self.interval, self.debounce, self.clock = report, max(1, interval), debounce, clock
        self.rows, self.told, self.told_at, self.batch = 0, 0, 0.0, -1

    def _tell(self) -> None:
        self.told, self.told_at = self.rows, self.clock()
        self.report(self.batch, self.rows)

    def seen(self, batch: int, rows: int) -> None:
        """Count the rows of a batch and report if it is time."""
        self.rows, self.batch = self.rows + rows, batch
        due = self.rows - self.told >= self.interval and self.clock() - self.told_at >= self.debounce
        if self.rows and (not self.told or due):
            self._tell()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.seen(event.progress.batchId, event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if self.rows != self.told:
            self._tell()
