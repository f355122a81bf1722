"""Backfill of stored messages into the graph: in groups, committed with their cursor, resumable, with a budget and a way to stop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.routing import pack_batches
from tessera.sources.versions import Store


def plan(messages: DataFrame, size: int = 6, chars: int = 1500) -> DataFrame:
    """space, pos, batch of messages (space, pos, channel, text) that are no documents: greedy batches in the order of pos."""
    talk = messages.filter(~F.coalesce(F.col("channel") == "doc", F.lit(False)))
    rows = pack_batches(talk.select(F.col("space").alias("conv_id"), F.col("pos").alias("turn"), "text"), size, chars)
    return rows.select(F.col("conv_id").alias("space"), F.col("turn").alias("pos"), "batch")


def backfill(
    store: Store,
    messages: DataFrame,
    work: Callable[[DataFrame], DataFrame],
    step: int = 8,
    seconds_per_group: float = 20.0,
    budget_minutes: float | None = None,
    cancelled: Callable[[], bool] = lambda: False,
) -> None:
    """Runs work over all batches of all spaces, `step` batches of each space at a time, and commits its result with the cursors.

    The store gets the tables plan (space, pos, batch), progress (space, total, done, status) and built, what work makes of messages with
    their batch. Each commit is one version with both the result and the cursors, so a run that is lost repeats nothing and leaves nothing
    out: call backfill again. Spaces whose batches would take longer than the budget are skipped; cancelled() is asked before each
    step and leaves the rest of every space skipped, what is built stays. Spaces without messages for the graph are done at once.
    """
    if "plan" not in store.manifest()["tables"]:
        batches = plan(messages)
        totals = messages.select("space").distinct().join(batches.groupBy("space").agg((F.max("batch") + 1).alias("total")), "space", "left").na.fill(0, ["total"])
        over = F.lit(False) if budget_minutes is None else F.col("total") * seconds_per_group / 60 > budget_minutes
        status = F.when(F.col("total") == 0, "done").when(over, "skipped").otherwise("running")
        store.commit(replace={"plan": batches, "progress": totals.select("space", F.col("total").cast("int").alias("total"), F.lit(0).alias("done"), status.alias("status"))})
    while True:
        progress = store.read("progress")
        running = progress.filter("status = 'running'")
        if running.isEmpty():
            return
        if cancelled():
            left = progress.withColumn("status", F.when(F.col("status") == "running", "skipped").otherwise(F.col("status")))
            store.commit(replace={"progress": left})
            return
        due = store.read("plan").join(running.select("space", "done"), "space").filter((F.col("batch") >= F.col("done")) & (F.col("batch") < F.col("done") + step))
        rows = messages.join(due.select("space", "pos", "batch"), ["space", "pos"])
        done = F.when(F.col("status") == "running", F.least(F.col("done") + step, F.col("total"))).otherwise(F.col("done"))
        moved = progress.withColumn("done", done).withColumn("status", F.when((F.col("status") == "running") & (F.col("done") >= F.col("total")), "done").otherwise(F.col("status")))
        store.commit(replace={"progress": moved}, append={"built": work(rows)})
