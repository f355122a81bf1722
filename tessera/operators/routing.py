"""Input routing and answer assembly: batch shapes, modes, precision route, evidence budget, abstention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ordered import scan


def batch_shape(messages: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, shape: document for at most two texts of 10000 characters on average, noise without text, else conversation."""
    full = F.length(F.trim(F.coalesce("text", F.lit("")))) > 0
    n = F.count_if(full)
    mean = F.avg(F.when(full, F.length("text")))
    return messages.groupBy(key).agg(F.when(n == 0, "noise").when((n <= 2) & (mean >= 10000), "document").otherwise("conversation").alias("shape"), n.alias("texts"))


def abstain(best: Column, verdict: Column | None = None, floor: float = 0.48, band: float = 0.60) -> Column:
    """abstain below the floor; within the band the verdict (true: answer) decides, `judge` where none is given; else answer."""
    inside = F.lit("judge") if verdict is None else F.when(verdict.isNull() | verdict, "answer").otherwise("abstain")
    return F.when(best < floor, "abstain").when(best < band, inside).otherwise("answer")


def effective_seed_k(n: Column, seed_k: Column, least: int) -> Column:
    """All nodes (two at least) where there are few; else a tenth of them within the least and seed_k."""
    return F.when(n <= seed_k, F.greatest(F.lit(2), n)).otherwise(F.greatest(F.lit(2), F.lit(least), F.least(seed_k, F.floor(n / 10)))).cast("long")


def space_mode(p: Column, estimate_minutes: Column, budget_minutes: float = 30.0, cut: float = 0.5) -> Column:
    """graph where the probability reaches the cut and the backfill fits its time; else vector."""
    return F.when((p >= cut) & (estimate_minutes <= budget_minutes), "graph").otherwise("vector")


def running_sample(chunks: DataFrame, key: str, order: list[str], limit: int) -> DataFrame:
    """key, sample: the chunks of each key from the start until `limit` characters, the last one cut.

    Chunks past the limit go before anything is listed, so a list holds `limit` characters at most.
    """
    w = Window.partitionBy(key).orderBy(*order)
    before = F.coalesce(F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = chunks.withColumn("_before", before).filter(F.col("_before") < limit).withColumn("_cut", F.left("text", (F.lit(limit) - F.col("_before")).cast("int")))
    ordered = F.sort_array(F.collect_list(F.struct(*order, "_cut")))
    return kept.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["_cut"]), "").alias("sample"))


def evidence(nodes: DataFrame, edges: DataFrame, top_k: int) -> DataFrame:
    """Items of each query within top_k: a legend (from 3 on), nodes, then edges between kept nodes; spare places go to nodes.

    nodes: query_id, node_id, rank. edges: query_id, src, dst, rank. Edges have min(edges, top_k // 2) places reserved.
    """
    legend = 1 if top_k >= 3 else 0
    room = top_k - legend
    n_edges = edges.groupBy("query_id").agg(F.count(F.lit(1)).alias("ne"))
    counted = nodes.join(n_edges, "query_id", "left").withColumn("nodes_room", F.lit(room) - F.least(F.coalesce("ne", F.lit(0)), F.lit(top_k // 2)))
    core = counted.filter(F.col("rank") <= F.col("nodes_room"))
    ends = core.select("query_id", "node_id")
    usable = edges.join(ends.withColumnRenamed("node_id", "src"), ["query_id", "src"], "left_semi").join(ends.withColumnRenamed("node_id", "dst"), ["query_id", "dst"], "left_semi")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    taken = usable.withColumn("place", place)
    used = core.groupBy("query_id").agg(F.count(F.lit(1)).alias("nn"))
    fit = taken.join(used, "query_id").filter(F.col("place") <= F.lit(room) - F.col("nn"))
    spare = used.join(fit.groupBy("query_id").agg(F.count(F.lit(1)).alias("ee")), "query_id", "left").select("query_id", (F.lit(room) - F.coalesce("ee", F.lit(0))).alias("final"))
    shown = nodes.join(spare, "query_id").filter(F.col("rank") <= F.col("final"))
    items = shown.select("query_id", F.lit("node").alias("kind"), F.col("node_id").alias("item"), F.col("rank").cast("int").alias("place"))
    items = items.union(fit.select("query_id", F.lit("edge"), F.concat("src", F.lit("→"), "dst"), F.col("place").cast("int")))
    if legend:
        items = items.union(nodes.select("query_id").distinct().select("query_id", F.lit("legend"), F.lit("legend"), F.lit(0)))
    return items


def pack_batches(messages: DataFrame, count: int = 6, chars: int = 1500) -> DataFrame:
    """conv_id, turn, batch: greedy batches of at most `count` messages and `chars` characters, in turn order.

    Greedy batches depend on the one before, so a conversation's lengths are read in order (see ordered.scan); texts stay where they are.
    A message longer than the budget is a batch of its own (split it before, see documents.chunks).
    """
    rows = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), F.length(F.coalesce("text", F.lit(""))).alias("n"))

    def step(state: tuple[int, int, int], row: tuple) -> tuple[tuple[int, int, int], int]:
        batch, held, size = state
        if held and (held >= count or size + row.n > chars):
            batch, held, size = batch + 1, 0, 0
        return (batch, held + 1, size + row.n), batch

    return scan(rows, "conv_id", ["turn", "n"], lambda: (0, 0, 0), step, "batch", "int").select("conv_id", "turn", "batch")
