"""Set-based graph maintenance: validation, id assignment, application of operations, orphans, log replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.graph import jump_weight, with_reverse
from tessera.schema import MUTUAL, RELATIONS
from tessera.session import materialize


def edge_reject_reason(proposed: DataFrame, nodes: DataFrame, existing: DataFrame | None = None, check_weight: bool = True) -> DataFrame:
    """Proposed edges (src, dst, rel_type) with reject_reason, null where an edge may be created.

    In order: missing endpoint, self loop, note endpoint (where nodes has is_note), unknown relation, forward weight zero, pair exists.
    """
    attrs = ["node_id", "node_type", *(["is_note"] if "is_note" in nodes.columns else [])]
    side = lambda p: nodes.select(*[F.col(c).alias(f"{p}_{c}") for c in attrs])
    joined = proposed.join(side("s"), F.col("src") == F.col("s_node_id"), "left").join(side("d"), F.col("dst") == F.col("d_node_id"), "left")
    reason = F.when(F.col("s_node_id").isNull() | F.col("d_node_id").isNull(), "missing endpoint").when(F.col("src") == F.col("dst"), "self loop")
    if "is_note" in nodes.columns:
        reason = reason.when(F.coalesce("s_is_note", F.lit(False)) | F.coalesce("d_is_note", F.lit(False)), "note endpoint")
    reason = reason.when(~F.coalesce(F.lower("rel_type").isin(RELATIONS), F.lit(False)), "unknown relation")
    if check_weight:
        reason = reason.when(jump_weight(F.col("s_node_type"), F.lower("rel_type"), F.lit(False)) <= 0, "zero weight")
    if existing is not None:
        joined = joined.join(existing.select("src", "dst", F.lit(True).alias("_there")), ["src", "dst"], "left")
        reason = reason.when(F.col("_there"), "pair exists")
    return joined.withColumn("reject_reason", reason).select(*proposed.columns, "reject_reason")


def next_ids(nodes: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """New rows with node_id n<k>, k counting on from the largest numeric suffix in use.

    Rows are dealt by ranges of the order and numbered within their range; the ranges' prefix counts are added.
    """
    top = nodes.agg(F.coalesce(F.max(F.regexp_extract("node_id", r"^n(\d+)$", 1).try_cast("long")), F.lit(0)).alias("top")).first()["top"]
    dealt = materialize(new.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "new")
    before = F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = dealt.groupBy("_part").count().withColumn("_before", before).drop("count")  # a row for each range
    place = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    numbered = dealt.withColumn("_k", place).join(F.broadcast(offsets), "_part")
    return numbered.withColumn("node_id", F.concat(F.lit("n"), F.lit(top) + F.col("_before") + F.col("_k"))).drop("_part", "_before", "_k")


def resolve_ids(edge_ops: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edge operations with temporary ids replaced by (temp_id, node_id); malformed ones, without both ends, go."""
    m = lambda side: mapping.select(F.col("temp_id").alias(side), F.col("node_id").alias(f"_{side}"))
    joined = edge_ops.filter(F.col("src").isNotNull() & F.col("dst").isNotNull()).join(m("src"), "src", "left").join(m("dst"), "dst", "left")
    return joined.withColumn("src", F.coalesce("_src", "src")).withColumn("dst", F.coalesce("_dst", "dst")).select(*edge_ops.columns)


def create_edges(existing: DataFrame, proposed: DataFrame, nodes: DataFrame) -> DataFrame:
    """All edges after creating the valid proposed ones (first of a pair) and the reverse of mutual ones."""
    valid = edge_reject_reason(proposed, nodes, existing).filter("reject_reason IS NULL").drop("reject_reason")
    once = valid.groupBy("src", "dst").agg(F.min_by("rel_type", "ord").alias("rel_type"))
    fresh = with_reverse(once).join(existing.select("src", "dst"), ["src", "dst"], "left_anti")
    return existing.select("src", "dst", "rel_type").union(fresh)


def delete_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges without the given pairs, and without the reverse of mutual ones."""
    hit = edges.join(gone.select("src", "dst"), ["src", "dst"], "left_semi")
    back = hit.filter(F.col("rel_type").isin(MUTUAL)).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.join(gone.select("src", "dst").union(back).distinct(), ["src", "dst"], "left_anti")


def apply_node_ops(nodes: DataFrame, ops: DataFrame) -> DataFrame:
    """Nodes after update, fix_type and deprecate operations (target_id, action, content, node_type, ord), the last one winning a field."""
    last = lambda action, value: F.max_by(value, F.when(F.col("action").isin(*action), F.col("ord")))
    merged = ops.groupBy(F.col("target_id").alias("node_id")).agg(
        last(("update",), F.when(F.col("action") == "update", F.col("content"))).alias("_content"),
        last(("fix_type",), F.when(F.col("action") == "fix_type", F.lower("node_type"))).alias("_type"),
        F.max((F.col("action") == "deprecate")).alias("_gone"),
    )
    return (
        nodes.join(merged, "node_id", "left")
        .withColumn("content", F.coalesce("_content", "content"))
        .withColumn("node_type", F.coalesce("_type", "node_type"))
        .withColumn("deprecated", F.col("deprecated") | F.coalesce("_gone", F.lit(False)))
        .select(*nodes.columns)
    )


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without the given ids, and edges without those that touch them."""
    ids = gone.select("node_id").distinct()
    left = edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_anti").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_anti")
    return nodes.join(ids, "node_id", "left_anti"), left


def orphan_rounds(linked: DataFrame, nodes: DataFrame, rounds: int, threshold: int = 3) -> DataFrame:
    """node_id, streak, forgotten: trailing rounds without an edge, of 1..rounds; linked has (node_id, round). Forgotten from the threshold on."""
    last = linked.groupBy("node_id").agg(F.max("round").alias("last"))
    streak = F.lit(rounds) - F.coalesce("last", F.lit(0))
    return nodes.select("node_id").join(last, "node_id", "left").select("node_id", streak.cast("long").alias("streak"), (streak >= threshold).alias("forgotten"))


def replay_messages(log: DataFrame) -> DataFrame:
    """Messages of an append log (seq, rid, doc_id, msg_index, ...): a batch whose rid came before is skipped whole, then of a
    message key the first one stays."""
    first = log.filter("rid IS NOT NULL").groupBy("rid").agg(F.min("seq").alias("first"))
    fresh = log.join(first, "rid", "left").filter(F.col("rid").isNull() | (F.col("seq") == F.col("first"))).drop("first")
    fields = [c for c in fresh.columns if c not in ("doc_id", "msg_index")]
    return fresh.groupBy("doc_id", "msg_index").agg(F.min_by(F.struct(*fields), "seq").alias("r")).select("doc_id", "msg_index", *[f"r.{c}" for c in fields])


def fallback_reason(triage: Column, node_ops: Column, creates: Column, created: Column) -> Column:
    """Why a conversation's text has to be stored raw; null where something of it was created or merged."""
    return F.when(~triage, "triage").when(node_ops == 0, "no_ops").when(creates == 0, "no_create").when(created == 0, "create_rejected")


def quarantine(messages: DataFrame) -> DataFrame:
    """Messages with reject_reason: role outside user and assistant, blank text, or a timestamp that is no positive integer."""
    reason = F.when(~F.coalesce(F.col("role").isin("user", "assistant"), F.lit(False)), "role").when(F.trim(F.coalesce("text", F.lit(""))) == "", "empty")
    if "ts" in messages.columns:
        reason = reason.when(F.col("ts").isNotNull() & (F.col("ts") <= 0), "timestamp")
    return messages.withColumn("reject_reason", reason)
