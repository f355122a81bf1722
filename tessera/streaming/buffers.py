"""Conversations kept as state: buffers with their texts, timers and flushes, idle reviews; streams and their batch twins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

FLUSH_DDL = "conv_id string, flush long, reason string, rounds array<struct<ts:long,text:string>>, flushes long, proactive long, passive long"
REVIEW_DDL = "key string, started long, outcome string, kept array<long>"
#: Reports that are kept for each key.
REPORTS = 20


class _Buffer(StatefulProcessor):
    """One conversation: its rounds that wait, and what is known of its flushes. Times are milliseconds of event time.

    A round waits until (proactive) `entry` meaningful flushes have been done, `batch` rounds wait and none is under way; (idle) no round
    came for `idle`; (session_end, manual) an event says so. While a flush is under way another one only marks that one is wanted; it
    is taken, as proactive, when `done` comes. With done_at_once a flush is done, and meaningful, as soon as it is out.
    """

    def __init__(self, idle: int, batch: int, entry: int, done_at_once: bool):
        self.idle, self.batch, self.entry, self.done_at_once = idle, batch, entry, done_at_once

    def init(self, handle) -> None:
        self.handle = handle
        self.rounds = handle.getListState("rounds", "ts long, text string")
        self.meta = handle.getValueState("meta", "waiting long, last long, meaningful long, under_way boolean, wanted boolean, flush long, proactive long")

    def _trigger(self, reason: str) -> Iterator[tuple]:
        if not self.waiting:
            return
        if self.under_way:
            self.wanted = True
            return
        held, self.waiting, self.wanted = [*self.stored, *self.added], 0, False
        self.stored, self.added = [], []
        self.flush, self.proactive, self.under_way = self.flush + 1, self.proactive + (reason == "proactive"), not self.done_at_once
        self.meaningful += self.done_at_once
        yield self.flush, reason, [{"ts": ts, "text": text} for ts, text in held], self.flush, self.proactive, self.flush - self.proactive

    def _advance(self, kind: str, ts: int, text: str | None, meaningful: bool) -> Iterator[tuple]:
        if self.waiting and ts - self.last > self.idle:
            yield from self._trigger("idle")
        if kind == "round":
            self.added.append((ts, text))
            self.waiting, self.last = self.waiting + 1, ts
            if self.entry > 0 and self.meaningful >= self.entry and not self.under_way and self.waiting >= self.batch:
                yield from self._trigger("proactive")
        elif kind == "done":
            self.under_way, self.meaningful = False, self.meaningful + meaningful
            if self.wanted:
                yield from self._trigger("proactive")
        else:
            yield from self._trigger(kind)

    def _load(self) -> None:
        self.waiting, self.last, self.meaningful, self.under_way, self.wanted, self.flush, self.proactive = self.meta.get() or (0, 0, 0, False, False, 0, 0)
        self.stored, self.added = [tuple(r) for r in self.rounds.get()] if self.waiting else [], []
        self.before = len(self.stored)

    def _save(self) -> None:
        self.meta.update((self.waiting, self.last, self.meaningful, self.under_way, self.wanted, self.flush, self.proactive))
        if len(self.stored) < self.before:
            self.rounds.clear()
        if self.added:
            self.rounds.appendList(self.added)
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if self.waiting and not self.wanted:
            self.handle.registerTimer(self.last + self.idle + 1)

    @staticmethod
    def _frame(key, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in out], columns=["conv_id", "flush", "reason", "rounds", "flushes", "proactive", "passive"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self._load()
        events = sorted((r.ms, r.ord, r.kind, r.text, bool(r.meaningful)) for part in rows for r in part.itertuples())
        out = [f for ms, _, kind, text, meaningful in events for f in self._advance(kind, ms, text, meaningful)]
        self._save()
        yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._load()
        out = list(self._trigger("idle")) if expiredTimerInfo.getExpiryTimeInMs() > self.last + self.idle else []
        self._save()
        yield self._frame(key, out)

    def close(self) -> None:
        pass


def stream_buffers(events: DataFrame, idle_seconds: int = 90, batch: int = 6, entry: int = 3, late: str = "1 minute", done_at_once: bool = False) -> DataFrame:
    """Flushes of a stream of (conv_id, ts, ord, kind, text, meaningful): conv_id, flush (from 1), reason, rounds with their texts, and the
    counters of flushes so far. kind is round, session_end, manual or done (a flush is done; meaningful counts it).

    Rounds are list state, appended to and cleared, never rewritten; a conversation's state is what waits. Events are taken in the order of
    (ts, ord) within a micro-batch; between micro-batches they must not go back. State is in RocksDB (set it as the state store).
    """
    marked = events.withWatermark("ts", late)
    rows = marked.select("conv_id", "ts", F.unix_millis("ts").alias("ms"), "ord", F.coalesce("kind", F.lit("round")).alias("kind"), "text", F.coalesce("meaningful", F.lit(False)).alias("meaningful"))
    return rows.groupBy("conv_id").transformWithStateInPandas(_Buffer(idle_seconds * 1000, batch, entry, done_at_once), FLUSH_DDL, "append", "eventtime")


def buffers(rounds: DataFrame, flushes: DataFrame) -> DataFrame:
    """conv_id, flush, reason, n, first, last, texts: the batch twin of stream_buffers with done_at_once. rounds: conv_id, round, ts, text.
    flushes: conv_id, round (the last that each takes), reason, of sessions.flush_reasons. texts are the hashes of the rounds' texts in order.

    A flush takes the rounds after the one before: a running count of flushes numbers them, so no range join is needed.
    """
    ends = rounds.join(flushes, ["conv_id", "round"], "left")
    before = Window.partitionBy("conv_id").orderBy("round").rowsBetween(Window.unboundedPreceding, -1)
    numbered = ends.withColumn("flush", F.count("reason").over(before) + 1)
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("round", F.md5(F.coalesce("text", F.lit(""))).alias("h")))), lambda r: r["h"])
    grouped = numbered.groupBy("conv_id", "flush").agg(F.max("reason").alias("reason"), F.count(F.lit(1)).alias("n"), F.min("round").alias("first"), F.max("round").alias("last"), F.md5(F.array_join(ordered, "")).alias("texts"))
    return grouped.filter("reason IS NOT NULL")


class _Review(StatefulProcessor):
    """One key: its last activity, its last review, and the newest reports."""

    def __init__(self, idle: int, interval: int, takes: int):
        self.idle, self.interval, self.takes = idle, interval, takes

    def init(self, handle) -> None:
        self.handle = handle
        self.meta = handle.getValueState("meta", "active long, reviewed long, running long")
        self.kept = handle.getListState("kept", "started long")

    def _due(self, active: int, reviewed: int) -> int:
        return max(active + self.idle, reviewed + self.interval if reviewed else 0)

    def _advance(self, now: int) -> Iterator[tuple]:
        """What has begun or ended before now."""
        while True:
            if self.running:
                end = self.running + self.takes
                if end > now:
                    return
                self.reports = [*self.reports, self.running][-REPORTS:]
                yield self.running, "report", list(self.reports)
                self.running = 0
            due = self._due(self.active, self.reviewed)
            if not self.active or due >= now or self.reviewed >= self.active:
                return
            self.running = self.reviewed = due

    def _active(self, at: int) -> Iterator[tuple]:
        yield from self._advance(at)
        if self.running:  # activity during a review: its result is thrown away
            yield self.running, "aborted", list(self.reports)
            self.running = 0
        self.active = max(self.active, at)

    def _load(self) -> None:
        self.active, self.reviewed, self.running = self.meta.get() or (0, 0, 0)
        self.reports = [r[0] for r in self.kept.get()]

    def _save(self) -> None:
        self.meta.update((self.active, self.reviewed, self.running))
        if self.reports:
            self.kept.put([(r,) for r in self.reports])
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if self.running:
            self.handle.registerTimer(self.running + self.takes)
        elif self.active and self.reviewed < self.active:
            self.handle.registerTimer(self._due(self.active, self.reviewed) + 1)

    def _frame(self, key, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in out], columns=["key", "started", "outcome", "kept"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self._load()
        out = [r for at in sorted(int(x) for part in rows for x in part["ms"]) for r in self._active(at)]
        self._save()
        yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._load()
        out = list(self._advance(expiredTimerInfo.getExpiryTimeInMs()))
        self._save()
        yield self._frame(key, out)

    def close(self) -> None:
        pass


def stream_reviews(activity: DataFrame, idle_seconds: int = 300, interval_seconds: int = 1800, takes_seconds: int = 60, late: str = "1 minute") -> DataFrame:
    """key, started (milliseconds), outcome and kept of a stream of activity (key, ts): reviews begin when a key has been idle for idle_seconds
    and its last review began interval_seconds ago; activity within takes_seconds aborts one, else it is a report; kept are the newest
    REPORTS. One review follows each activity at most. Two event-time timers a key at most: the next beginning or the end of the one that runs.
    """
    rows = activity.withWatermark("ts", late).select("key", "ts", F.unix_millis("ts").alias("ms"))
    return rows.groupBy("key").transformWithStateInPandas(_Review(idle_seconds * 1000, interval_seconds * 1000, takes_seconds * 1000), REVIEW_DDL, "append", "eventtime")


def reviews(activity: DataFrame, idle_seconds: int = 300, interval_seconds: int = 1800, takes_seconds: int = 60) -> DataFrame:
    """key, started, outcome of activity (key, ts): the batch twin of stream_reviews, of all reviews that begin.

    Each gap between activities of a key may hold one review, at the later of the idle end and the interval after the one before. That is a
    recurrence along a key, so gaps are read in order by the task that has the key, which holds one number.
    """
    ms = F.unix_millis("ts")
    ahead = F.lead("at").over(Window.partitionBy("key").orderBy("at"))
    gaps = activity.select("key", ms.alias("at")).distinct().withColumn("next", ahead)
    long = gaps.filter(F.col("next").isNull() | (F.col("next") - F.col("at") > idle_seconds * 1000))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = last = None
        for batch in batches:
            out = []
            for r in batch.itertuples():
                key, last = r.key, last if r.key == key else None
                start = max(r.at + idle_seconds * 1000, last + interval_seconds * 1000 if last is not None else 0)
                if pd.isna(r.next) or start < r.next:
                    last = start
                    out.append((r.key, start, "aborted" if r.next < start + takes_seconds * 1000 else "report"))
            yield pd.DataFrame(out, columns=["key", "started", "outcome"])

    ordered = long.repartition("key").sortWithinPartitions("key", "at")
    return ordered.mapInPandas(run, f"key {dict(activity.dtypes)['key']}, started long, outcome string")
