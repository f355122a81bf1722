"""Time to events: anchors that answer a question's period, and the facts that point to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T


def is_time_node(nodes: DataFrame) -> Column:
    """Ids th..., T and digits, or things whose text names a period."""
    named = (F.col("node_type") == "thing") & (F.size(T.period_literals(F.col("content"))) > 0)
    return F.col("node_id").startswith("th") | F.col("node_id").rlike(r"^T\d+$") | named


def anchors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Active time nodes with a temporal edge into them."""
    live = nodes.filter(~F.col("deprecated") & ~F.col("forgotten"))
    real = edges.filter("rel_type = 'temporal'").select(F.col("dst").alias("node_id"))
    return live.filter(is_time_node(live)).join(real, "node_id", "left_semi")


def lookup(candidates: DataFrame, nodes: DataFrame, edges: DataFrame, max_facts: int = 8, max_anchors: int = 3) -> tuple[DataFrame, DataFrame]:
    """(anchors, facts) per question from candidates (query_id, query, node_id, content, place).

    An explicit period must be shared word for word; vague words and school stages need one of their anchors within the anchor's
    text; other questions take what is nearest. mode is exact, fuzzy, fallback, or rejected where none of the candidates fits.
    Facts are active sources of temporal edges, with time_consistent true, false or null; max_facts 0 is unlimited.
    """
    q, c = F.col("query"), F.coalesce("content", F.lit(""))
    explicit = T.explicit_periods(q)
    within = lambda words: F.exists(words, lambda w: F.contains(c, w))
    fuzzy, era = T.fuzzy_anchors(q), T.era_anchors(q)
    mode = F.when(F.size(explicit) > 0, "exact").when((F.size(fuzzy) > 0) | (F.size(era) > 0), "fuzzy").otherwise("fallback")
    fits = F.when(F.size(explicit) > 0, F.arrays_overlap(explicit, T.explicit_periods(c))).when(F.size(fuzzy) > 0, within(fuzzy)).when(F.size(era) > 0, within(era)).otherwise(True)
    judged = candidates.withColumn("mode", mode).withColumn("fits", fits)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("place"))
    kept = judged.filter("fits").withColumn("rank", rank).filter(F.col("rank") <= max_anchors).select("query_id", "node_id", "content", "mode", "rank")
    lost = judged.groupBy("query_id").agg(F.max("fits").alias("any")).filter("NOT any").select("query_id", F.lit(None).cast("string").alias("node_id"), F.lit(None).cast("string").alias("content"), F.lit("rejected").alias("mode"), F.lit(0).alias("rank"))
    live = nodes.filter(~F.col("deprecated") & ~F.col("forgotten")).select(F.col("node_id").alias("fact_id"), F.col("content").alias("fact"), "ord")
    into = edges.filter("rel_type = 'temporal'").select(F.col("src").alias("fact_id"), F.col("dst").alias("node_id"))
    place = F.row_number().over(Window.partitionBy("query_id", "node_id").orderBy("ord"))
    facts = kept.join(into, "node_id").join(live, "fact_id").withColumn("place", place)
    facts = facts.filter(F.col("place") <= max_facts) if max_facts else facts
    return kept.union(lost), facts.select("query_id", "node_id", "fact_id", "place", T.time_consistent(T.anchor_periods(F.col("content")), F.col("fact")).alias("time_consistent"))
