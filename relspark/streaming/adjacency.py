"""Adjacency of a stream of edges: each parent's children get their places in order of time as the watermark passes them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PLACED = "parent_key long, child_key long, child_ms long, rank long"
#: Groups of parents that share their state's calls, and the milliseconds of a span: a week.
GROUPS, SPAN = 1024, 7 * 86_400_000
#: Parents of one row of counts, and rows of one piece at most.
COUNTS, PIECE = 4096, 65_536
#: Stands for a child without a key, which comes last of its time.
NO_CHILD = 2**63 - 1


def _packed(*columns: np.ndarray) -> bytes:
    return np.stack([c.astype(np.int64) for c in columns]).tobytes() if len(columns[0]) else b""


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, np.int64).reshape(n, -1)


class Children(StatefulProcessor):
    """What a group of parents waits for: their children in pieces by time, until a timer says that no earlier one can come; then only their numbers are kept.

    State is read and written in packed pieces of many rows, as a call costs more than a row. A span of time is in memory at once, and so are the
    numbers of a group's parents.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "part int", "parents binary")
        self.waiting = handle.getMapState("waiting", "span long, piece int", "rows binary")
        self.pieces = handle.getMapState("pieces", "span long", "n int, least long")

    def _keep(self, span: int, rows: np.ndarray) -> None:
        """``rows`` (parents, children, times) of a span beside what it has."""
        n, least = self.pieces.getValue((span,)) if self.pieces.containsKey((span,)) else (0, None)
        for i in range(0, rows.shape[1], PIECE):
            self.waiting.updateValue((span, n), (_packed(*rows[:, i : i + PIECE]),))
            n += 1
        first = int(rows[2].min())
        if least is None or first < least:
            self.handle.registerTimer(first)
            least = first
        self.pieces.updateValue((span,), (n, least))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        now = timerValues.getCurrentWatermarkInMs()
        held: list[np.ndarray] = []
        size = 0

        def flush() -> None:
            every = np.concatenate(held, axis=1)
            spans = every[2] // SPAN
            order = np.argsort(spans, kind="stable")
            every, spans = every[:, order], spans[order]
            for part in np.split(every, np.flatnonzero(np.diff(spans)) + 1, axis=1):
                self._keep(int(part[2, 0] // SPAN), part)

        for part in rows:
            some = part[["parent_key", "child_key", "child_ms"]].to_numpy(np.int64).T
            if now > 0:
                some = some[:, some[2] > now]
            if some.shape[1]:
                held.append(some)
                size += some.shape[1]
            if size > 16 * PIECE:
                flush()
                held, size = [], 0
        if held:
            flush()
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        # all that the watermark has passed, in order of time, whichever timer comes first
        now = timerValues.getCurrentWatermarkInMs()
        due = sorted((k[0], v[0]) for k, v in self.pieces.iterator() if v[1] <= now)
        if not due:
            return
        held = [_unpacked(v[0], 2) for _, v in self.counts.iterator()]
        before = np.concatenate(held, axis=1) if held else np.zeros((2, 0), np.int64)
        before = before[:, np.argsort(before[0])]
        for span, n in due:
            rows = np.concatenate([_unpacked(self.waiting.getValue((span, i))[0], 3) for i in range(n)], axis=1)
            for i in range(n):
                self.waiting.removeKey((span, i))
            self.pieces.removeKey((span,))
            if (later := rows[2] > now).any():
                self._keep(span, rows[:, later])
                rows = rows[:, ~later]
            parents, children, times = rows[:, np.lexsort((rows[1], rows[2], rows[0]))]
            known, starts, sizes = np.unique(parents, return_index=True, return_counts=True)
            at = np.searchsorted(before[0], known)
            old = np.zeros(len(known), bool)
            old[at < before.shape[1]] = before[0][at[at < before.shape[1]]] == known[at < before.shape[1]]
            have = np.zeros(len(known), np.int64)
            have[old] = before[1][at[old]]
            rank = np.arange(len(parents)) - np.repeat(starts - have, sizes)
            before = before.copy()
            before[1, at[old]] += sizes[old]
            before = np.insert(before, at[~old], np.stack([known[~old], sizes[~old]]), axis=1)
            for i in range(0, len(parents), PIECE):
                one = slice(i, i + PIECE)
                yield pd.DataFrame({"parent_key": parents[one], "child_key": children[one], "child_ms": times[one], "rank": rank[one]})
        for part, i in enumerate(range(0, before.shape[1], COUNTS)):
            self.counts.updateValue((part,), (_packed(*before[:, i : i + COUNTS]),))

    def close(self) -> None:
        pass


def placed_children(stream: DataFrame, parent: str, child: str, ts: str, late: str = "0 seconds") -> DataFrame:
    """``parent_key, child_key, child_ms, rank`` of a stream of edges: a child's place from 0 among its parent's, in order of time and child.

    A place is given once, when the watermark (``late`` behind the latest time seen) has passed the child's time; later comers are
    dropped, and children that the watermark hasn't passed stay in the state. Edges without parent or time are left out. State
    survives restarts from the query's checkpoint. The session's state store becomes RocksDB, which this kind of state needs.
    Parents share state by hash, in GROUPS groups.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    at = F.col(ts).cast("timestamp")
    # the watermark runs a second ahead of the times, so that the latest is passed as well
    edges = stream.filter(F.col(parent).isNotNull() & F.col(ts).isNotNull()).select(
        F.col(parent).cast("long").alias("parent_key"), F.coalesce(F.col(child).cast("long"), F.lit(NO_CHILD)).alias("child_key"), F.unix_millis(at).alias("child_ms"), (at + F.expr("INTERVAL 1 SECOND")).alias("passed")
    )
    grouped = edges.withColumn("group", F.pmod(F.xxhash64("parent_key"), F.lit(GROUPS))).withWatermark("passed", late).groupBy("group")
    placed = grouped.transformWithStateInPandas(Children(), PLACED, "Append", "EventTime")
    return placed.withColumn("child_key", F.when(F.col("child_key") != NO_CHILD, F.col("child_key")))
