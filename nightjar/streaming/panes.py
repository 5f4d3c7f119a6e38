"""Trailing windows on streams out of hour panes (ST-5).

A row enters one pane: its hour. Panes are aggregated in the JVM and leave the first operator
once, when the watermark closes them. Windows that slide by an hour are then combinations of
closed panes, so no row is copied once per window.

* ``sliding_counts``  per client: the second operator keeps one state row a client, the list
  of its last panes, and emits a window when the watermark reaches its end (event-time timer);
* ``sliding_names``   per registrable domain: panes hold mergeable distinct sketches, which the
  second operator merges by window.
"""
from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import sketches

HOUR_MS = 3_600_000


def panes(mapped: DataFrame, by: str, delay: str = "0 seconds", **aggregates: Column) -> DataFrame:
    """Closed panes: ``pane`` (the hour's start), ``closed`` (its last instant, the event time of
    what follows), ``by`` and the aggregates. All valid rows move the watermark, so a quiet
    key's windows close too."""
    return (mapped.filter("valid").withWatermark("ts", delay).groupBy(F.window("ts", "1 hour").alias("w"), by)
            .agg(*[a.alias(n) for n, a in aggregates.items()])
            .select(F.col("w.start").alias("pane"), F.window_time("w").alias("closed"), by, *aggregates))


class Windows(StatefulProcessor):
    """Closed panes of a client in, finished windows out. A pane comes in the batch whose
    watermark closes it, and windows go out up to the same watermark, so none comes too late."""

    def __init__(self, hours: int):
        self.hours = hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("panes", "due long, starts array<long>, counts array<long>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        due, starts, counts = self.held.get() if self.held.exists() else (None, [], [])
        held = dict(zip(starts, counts))
        for r in rows:
            held[r.start] = held.get(r.start, 0) + r.n
        if due is None:                         # the first window that holds a pane
            due = min(held) + HOUR_MS
            self.handle.registerTimer(due - 1)
        self._keep(due, held)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        due, starts, counts = self.held.get()
        held, out = dict(zip(starts, counts)), []
        while held and due <= timerValues.getCurrentWatermarkInMs():
            first = due - self.hours * HOUR_MS
            out.append(Row(start=first, end=due, client=key[0], n=sum(n for at, n in held.items() if at < due)))
            held.pop(first, None)               # no later window holds it
            due = max(due, min(held, default=due)) + HOUR_MS
        if held:
            self._keep(due, held)
            self.handle.registerTimer(due - 1)
        else:
            self.held.clear()
        return iter(out)

    def _keep(self, due: int, held: dict[int, int]) -> None:
        order = sorted(held)
        self.held.update((due, order, [held[k] for k in order]))

    def close(self) -> None:
        pass


def sliding_counts(mapped: DataFrame, predicate: str = "blocked", hours: int = 24, delay: str = "0 seconds") -> DataFrame:
    """Per client and window of ``hours`` that slides by one: rows matching ``predicate``, where
    there are any. Append mode; needs the RocksDB state store."""
    counted = panes(mapped, "client", delay, n=F.count_if(predicate)).filter("n > 0") \
        .select("closed", "client", F.unix_millis("pane").alias("start"), "n")
    out = counted.groupBy("client").transformWithState(
        Windows(hours), "start long, end long, client string, n long", "Append", "EventTime")
    return out.select(F.timestamp_millis("start").alias("window_start"), F.timestamp_millis("end").alias("window_end"),
                      "client", "n")


def sliding_names(mapped: DataFrame, hours: int = 24, delay: str = "0 seconds") -> DataFrame:
    """Per registrable domain and window: distinct names and clients (estimates within
    ``sketches.BOUND``), query rows and the entropy sum. A pane's sketches, not its rows, are
    merged into its windows."""
    hourly = panes(mapped, "registrable_domain", delay, **sketches.aggregates())
    w = F.window("closed", f"{hours} hours", "1 hour")
    merged = hourly.groupBy(w.alias("w"), "registrable_domain").agg(*sketches.merged())
    return merged.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                         "registrable_domain", *sketches.estimates())
