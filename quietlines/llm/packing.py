"""Problem 7: documents packed into containers of fixed token capacity.

Method: bounded-space online packing. Each partition keeps a fixed number of open
windows; a document goes into the open window it fills best; when none has room the
fullest is closed and a new one opened. Windows still open at the end of a partition
are merged: their fillings are packed again, largest first, in buckets of bounded
size. A document is cut only where it alone exceeds the capacity: its first pieces
fill containers of their own, the rest is placed like a document.

State per task is the number of windows; nothing is gathered per key, so no source or
group of copies can fill one task.

Defined results: null and empty texts have no tokens and go with size 0 into an open
window; every repeated row is placed on its own; limits without id and null or
non-positive capacities get no containers, of a limit listed twice the larger capacity
counts; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietlines.llm.tokens import VOCABULARY, loaded, shared_vocabulary
from quietlines.plans.tables import durable

#: Windows open at a time, per partition and capacity.
OPEN_WINDOWS = 256
#: Left-over windows that one merging task packs.
MERGE_BUCKET = 50_000

#: Documents that one open window holds before it is closed; only documents without tokens can be so many.
MOST_HELD = 10_000

PLACED = "limit_id bigint, capacity_tokens bigint, container_id bigint, doc_id bigint, piece_no int, start_token bigint, n_tokens bigint, open_fill bigint"


class Windows:
    """Open windows of one capacity, ordered by the room they have left."""

    def __init__(self, capacity: int, first_id: int, limit: int = OPEN_WINDOWS):
        self.capacity, self.limit, self.next_id = capacity, limit, first_id
        self.room: list[tuple[int, int]] = []  # (room left, window id)
        self.held: dict[int, list] = {}  # window id -> what was placed in it
        self.done: list[int] = []  # windows closed since they were last taken away

    def place(self, size: int, item: object = None) -> int:
        """The window that takes an item of `size` (at most the capacity)."""
        at = bisect_left(self.room, (size, -1))
        if at < len(self.room):
            left, window = self.room.pop(at)
        else:
            if len(self.room) >= self.limit:
                self.done.append(self.room.pop(0)[1])  # the fullest is closed
            left, window, self.next_id = self.capacity, self.next_id, self.next_id + 1
        held = self.held.setdefault(window, [])
        held.append(item)
        if left == size or len(held) >= MOST_HELD:
            self.done.append(window)
        else:
            insort(self.room, (left - size, window))
        return window

    def closed(self) -> int:
        """The id of a container that an item fills by itself."""
        self.next_id += 1
        return self.next_id - 1


def _pack(documents: DataFrame, capacities: list[tuple[int, int]], path: str) -> DataFrame:
    """Rows of placed pieces; those of windows left open have `open_fill`, and each such window a row without piece_no."""
    merges = shared_vocabulary(documents, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = loaded(merges.value)
        base = TaskContext.get().partitionId() << 40
        windows = {limit: Windows(capacity, base) for limit, capacity in capacities}
        columns = [c.split()[0] for c in PLACED.split(", ")]
        for rows in batches:
            out = []
            sizes = [len(vocabulary.encode(t)) for t in rows["text"]]
            for limit, capacity in capacities:
                own = windows[limit]
                for doc, size in zip(rows["doc_id"], sizes, strict=True):
                    whole, rest = divmod(size, capacity)
                    if size and not rest:
                        whole, rest = whole - 1, capacity
                    for piece in range(whole):
                        out.append((limit, capacity, own.closed(), doc, piece, piece * capacity, capacity, None))
                    own.place(rest, (doc, whole, whole * capacity, rest))
                out += [(limit, capacity, w, *item, None) for w in own.done for item in own.held.pop(w)]
                own.done = []
            yield _frame(out, columns)
        still = [(limit, own, window, own.capacity - left) for limit, own in windows.items() for left, window in own.room]
        yield _frame(
            [(limit, own.capacity, window, None, None, None, None, fill) for limit, own, window, fill in still]
            + [(limit, own.capacity, window, *item, fill) for limit, own, window, fill in still for item in own.held[window]],
            columns,
        )

    return documents.select("doc_id", "text").mapInPandas(run, PLACED)


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=columns)
    return frame.astype({c: "Int64" for c in columns if c != "piece_no"} | {"piece_no": "Int32"})


def _merge(group: pd.DataFrame) -> pd.DataFrame:
    """Left-over windows of one bucket, largest first, each into the best-fitting container."""
    group = group.sort_values(["open_fill", "container_id"], ascending=[False, True])
    own = Windows(int(group["capacity_tokens"].iloc[0]), 0, len(group) + 1)
    names: dict[int, int] = {}  # a merged container is named by its first window
    target = []
    for window, fill in zip(group["container_id"], group["open_fill"], strict=True):
        placed = own.place(int(fill))
        target.append(names.setdefault(placed, int(window)))
    return pd.DataFrame({"limit_id": group["limit_id"], "container_id": group["container_id"], "merged_id": target})


def pack(documents: DataFrame, limits: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(limit_id, capacity_tokens, container_id, doc_id, piece_no, start_token, n_tokens), one row per piece.

    `limits` is a small fixed table; its rows come to the driver.
    """
    some = limits.where("limit_id IS NOT NULL AND capacity_tokens > 0").groupBy("limit_id").agg(F.max("capacity_tokens").alias("capacity_tokens"))
    capacities = sorted((r["limit_id"], r["capacity_tokens"]) for r in some.collect())
    placed = durable(_pack(documents, capacities, path))
    columns = ["limit_id", "capacity_tokens", "container_id", "doc_id", "piece_no", "start_token", "n_tokens"]
    left = placed.where("open_fill IS NOT NULL AND piece_no IS NULL").select("limit_id", "capacity_tokens", "container_id", "open_fill")
    buckets = left.groupBy("limit_id").count().agg(F.max("count")).first()[0] or 0
    spread = F.pmod(F.xxhash64("container_id"), F.lit(buckets // MERGE_BUCKET + 1))
    merged = left.withColumn("bucket", spread).groupBy("limit_id", "bucket").applyInPandas(_merge, "limit_id bigint, container_id bigint, merged_id bigint")
    # Only pieces of windows left open move; what stands in a closed one is final.
    final = placed.where("open_fill IS NULL").select(*columns)
    moved = placed.where("open_fill IS NOT NULL AND piece_no IS NOT NULL").join(merged, ["limit_id", "container_id"]).withColumn("container_id", F.col("merged_id")).select(*columns)
    return final.unionByName(moved)


def summary(packed: DataFrame) -> DataFrame:
    """Per capacity: containers, tokens, the share of space used, and the least containers possible by volume."""
    return (
        packed.groupBy("limit_id", "capacity_tokens")
        .agg(F.count_distinct("container_id").alias("containers"), F.sum("n_tokens").alias("tokens"), F.count_distinct("doc_id").alias("documents"))
        .withColumn("used", F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")))
        .withColumn("least_by_volume", F.ceil(F.col("tokens") / F.col("capacity_tokens")))
    )
