"""Sessions, request idempotency and tails: streaming queries and their batch twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gap_sessions(events: DataFrame, key: str, ts: str, order: str, gap_seconds: int) -> DataFrame:
    """events with session, from 1 for each key: a new one after more than the gap. Batch twin of stream_sessions."""
    w = Window.partitionBy(key).orderBy(ts, order)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    new = F.when(micros - F.lag(micros).over(w) <= gap_seconds * 1_000_000, 0).otherwise(1)
    return events.withColumn("_new", new).withColumn("session", F.sum("_new").over(w)).drop("_new")


def stream_sessions(events: DataFrame, key: str, ts: str, gap: str = "90 seconds", late: str = "10 minutes") -> DataFrame:
    """Session windows of a stream: key, started, ended, n, once the watermark has passed a session."""
    marked = events.withWatermark(ts, late)
    return marked.groupBy(key, F.session_window(ts, gap).alias("s")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("s.start").alias("started"), F.col("s.end").alias("ended"), "n")


def stream_requests(requests: DataFrame, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Requests of a stream without repeats of (user_id, request_id) within the watermark."""
    return requests.withWatermark(ts, late).dropDuplicatesWithinWatermark(["user_id", "request_id"])


def flush_reasons(rounds: DataFrame, idle_seconds: int = 90, batch: int = 6, entry: int = 3) -> DataFrame:
    """conv_id, round, reason for each flush of a conversation: idle where the next round comes after the idle time, end at the
    last; from `entry` such flushes on, size after each `batch` further rounds, which comes first. rounds: conv_id, round (from 1), ts.
    """
    w = Window.partitionBy("conv_id").orderBy("round")
    gap = F.unix_micros(F.lead("ts").over(w).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    marked = rounds.withColumn("reason", F.when(gap.isNull(), "end").when(gap > idle_seconds * 1_000_000, "idle"))
    flushes = F.count("reason").over(w.rowsBetween(Window.unboundedPreceding, -1))
    part = marked.withColumn("part", flushes)
    within = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("round"))
    sized = part.withColumn("reason", F.when((F.col("part") >= entry) & (within % batch == 0), "size").otherwise(F.col("reason")))
    return sized.filter("reason IS NOT NULL").select("conv_id", "round", "reason")


def tail(log: DataFrame, n: int, order: str) -> DataFrame:
    """The last n rows of a log, newest last; a top-n over partitions, not a global sort."""
    return log.orderBy(F.desc(order)).limit(n).orderBy(order)


def upsert_batches(target: str):
    """A foreachBatch writer that appends each micro-batch once, under its batch id, so that a replayed one overwrites itself."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{target}/batch={batch}")

    return write


def stream_flushes(rounds: DataFrame, idle_seconds: int = 90, batch: int = 6, late: str = "1 minute") -> DataFrame:
    """conv_id, rounds, reason of a stream (conv_id, text, ts): what a conversation's buffer holds when it is flushed, for its size
    or because event time passed its last round by the idle time.

    The buffer is counted, not kept: state is a count and a time for each conversation, and goes when it is idle.
    """
    from collections.abc import Iterator

    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        held, last = state.get if state.exists else (0, 0)
        if state.hasTimedOut:
            if held:
                out.append((key[0], held, "idle"))
            state.remove()
        else:
            for at in sorted(t.value // 1000 for part in parts for t in part["ts"]):
                if held and at - last > idle_seconds * 1_000_000:
                    out.append((key[0], held, "idle"))
                    held = 0
                held, last = held + 1, max(last, at)
                if held >= batch:
                    out.append((key[0], held, "size"))
                    held = 0
            state.update((held, last))
            state.setTimeoutTimestamp(max(last // 1000 + idle_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["conv_id", "rounds", "reason"])

    grouped = rounds.withWatermark("ts", late).groupBy("conv_id")
    return grouped.applyInPandasWithState(run, "conv_id string, rounds long, reason string", "held long, last long", "append", GroupStateTimeout.EventTimeTimeout)
