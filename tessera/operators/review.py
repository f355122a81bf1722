"""Review and context operators: duplicates of new texts, widened recall, reranking, logs, quotas, timeline evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import ascii_edges
from tessera.operators.vectors import knn


def find_duplicates(new: DataFrame, nodes: DataFrame, vectors: DataFrame, threshold: float = 0.85) -> DataFrame:
    """query_id, duplicate_of, score for new vectors (query_id, embedding): of the three nearest by distance the active ones that
    are no notes, the best strictly above the threshold; a fit at a later place is not looked for. A column own names a stored vector
    that is the new one's and doesn't count."""
    near = knn(new.select("query_id", "embedding"), vectors, 4 if "own" in new.columns else 3, "l2")
    if "own" in new.columns:
        others = near.join(new.select("query_id", F.col("own").alias("id")), ["query_id", "id"], "left_anti")
        near = others.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("place"))).filter("place <= 3")
    drop = F.col("is_note") if "is_note" in nodes.columns else F.lit(False)
    live = nodes.filter(~F.col("deprecated") & ~F.col("forgotten") & ~drop).select(F.col("node_id").alias("id"))
    from tessera.functions.vectors import cosine

    scored = near.join(live, "id", "left_semi").join(vectors.select("id", F.col("embedding").alias("v")), "id").join(new.select("query_id", "embedding"), "query_id")
    scored = scored.select("query_id", "id", "ord", F.round(cosine(F.col("v"), F.col("embedding")), 9).alias("score")).filter(F.col("score") > threshold)
    best = F.max_by("id", F.struct("score", (-F.col("ord")).alias("o"))).alias("duplicate_of")
    return scored.groupBy("query_id").agg(best, F.max("score").alias("score"))


def exact_content(new: DataFrame, nodes: DataFrame) -> DataFrame:
    """The fallback without vectors: query_id, duplicate_of by equal content, the first node in order."""
    key = F.sha2("content", 256).alias("_key")  # texts may be long
    first = nodes.groupBy(key).agg(F.min_by("node_id", "ord").alias("duplicate_of"))
    return new.select("query_id", key).join(first, "_key").select("query_id", "duplicate_of")


def widen(base: DataFrame, extra: DataFrame, base_k: int = 15, most: int = 15) -> DataFrame:
    """group_id, id, place: the first base_k of base, then at most `most` further ids of extra in the order first seen."""
    kept = base.filter(F.col("place") <= base_k).select("group_id", "id", "place")
    new = extra.groupBy("group_id", "id").agg(F.min(F.struct("message", "place")).alias("at")).join(kept, ["group_id", "id"], "left_anti")
    numbered = new.withColumn("p", F.row_number().over(Window.partitionBy("group_id").orderBy("at", "id"))).filter(F.col("p") <= most)
    return kept.union(numbered.select("group_id", "id", F.lit(base_k) + F.col("p")))


def rerank(items: DataFrame, scores: DataFrame) -> DataFrame:
    """items (query_id, id, place, score) by external scores, those without one after, in their old order; score stays."""
    joined = items.join(scores.select("query_id", "id", F.col("score").alias("_new")), ["query_id", "id"], "left")
    order = Window.partitionBy("query_id").orderBy(F.col("_new").desc_nulls_last(), "place")
    return joined.withColumn("place", F.row_number().over(order)).drop("_new")


def context_edges(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends among a group's nodes (group_id, node_id)."""
    left = edges.join(groups.select("group_id", F.col("node_id").alias("src")), "src")
    return left.join(groups.select("group_id", F.col("node_id").alias("dst")), ["group_id", "dst"]).select("group_id", "src", "dst", "rel_type")


def context_neighbours(groups: DataFrame, edges: DataFrame, most: int = 20) -> DataFrame:
    """group_id, node_id, place: nodes one step from a group's nodes and not of them, the first `most` by id."""
    step = lambda a, b: edges.select(F.col(a).alias("node_id"), F.col(b).alias("next")).join(groups, "node_id").select("group_id", F.col("next").alias("node_id"))
    around = step("src", "dst").union(step("dst", "src")).distinct().join(groups, ["group_id", "node_id"], "left_anti")
    place = F.row_number().over(Window.partitionBy("group_id").orderBy("node_id"))
    return around.withColumn("place", place).filter(F.col("place") <= most)


def request_counters(log: DataFrame) -> DataFrame:
    """method, total, errors, with the grand total under a null method."""
    return log.rollup("method").agg(F.count(F.lit(1)).alias("total"), F.count_if("error").alias("errors"))


def eviction_order(spaces: DataFrame, capacity: int) -> DataFrame:
    """Spaces (space, last_access, busy) to close, oldest first, so that `capacity` stay; busy ones never close."""
    order = Window.orderBy(F.col("busy").desc(), F.col("last_access").desc(), "space")
    return spaces.withColumn("keep_rank", F.row_number().over(order)).filter((F.col("keep_rank") > capacity) & ~F.col("busy")).select("space", "last_access")


def timeline(hits: DataFrame, anchors: DataFrame) -> DataFrame:
    """query_id, recall, anchored, order_accuracy from hits (query_id, gold_rank, rank null if missed, node_id) and anchors
    (node_id, anchor_rank). Order is judged over pairs of anchored hits with unequal ranks; null without such a pair."""
    first = hits.groupBy("query_id", "gold_rank").agg(F.min_by("node_id", "rank").alias("node_id"), F.min("rank").alias("rank"))
    placed = first.join(anchors, "node_id", "left")
    base = placed.groupBy("query_id").agg(F.avg(F.col("rank").isNotNull().cast("int")).alias("recall"), F.avg(F.when(F.col("rank").isNotNull(), F.col("anchor_rank").isNotNull().cast("int"))).alias("anchored"))
    on = placed.filter("rank IS NOT NULL AND anchor_rank IS NOT NULL")
    a, b = on.alias("a"), on.alias("b")
    pairs = a.join(b, (F.col("a.query_id") == F.col("b.query_id")) & (F.col("a.gold_rank") < F.col("b.gold_rank")) & (F.col("a.anchor_rank") != F.col("b.anchor_rank")))
    order = pairs.groupBy(F.col("a.query_id").alias("query_id")).agg(F.avg((F.col("a.anchor_rank") < F.col("b.anchor_rank")).cast("int")).alias("order_accuracy"))
    return base.join(order, "query_id", "left")


def domain_of(node_id: Column, prefixes: dict[str, str], other: str = "noise") -> Column:
    """The domain of the longest prefix that an id starts with."""
    out = F.lit(other)
    for p in sorted(prefixes, key=len):
        out = F.when(node_id.startswith(p), prefixes[p]).otherwise(out)
    return out


def causal_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(ascii_edges(r"(?i)\b(because|so|therefore)\b|因为|所以|因此|导致"))), F.lit(0))


# Words that date a text.
TIME_SIGNAL = r"\d{4}年|\d{1,2}月|\d{1,2}[日号]|昨天|今天|明天|前天|上周|这周|下周|去年|今年|明年"


def has_temporal_signal(text: Column) -> Column:
    """Two distinct date words at least."""
    return F.size(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TIME_SIGNAL), F.lit(0)))) >= 2


def backfill_estimate(groups: DataFrame, seconds_per_group: float = 4.5, gate_minutes: float = 30.0) -> DataFrame:
    """space, minutes, over of (space, group_id)."""
    return groups.groupBy("space").agg((F.count_distinct("group_id") * seconds_per_group / 60).alias("minutes")).withColumn("over", F.col("minutes") > gate_minutes)


def usage(call: Column) -> dict[str, Column]:
    """Token counts of a JSON call record under any of its known names; the cached part never exceeds the input."""
    pick = lambda *names: F.coalesce(*[F.get_json_object(call, f"$.{n}").try_cast("long") for n in names], F.lit(0))
    prompt, output = pick("usage.prompt_tokens", "usage.input_tokens"), pick("usage.completion_tokens", "usage.output_tokens")
    cached = pick("usage.prompt_cache_hit_tokens", "usage.prompt_tokens_details.cached_tokens", "usage.input_tokens_details.cached_tokens")
    cached = F.greatest(F.lit(0), F.least(cached, prompt))
    total = F.coalesce(F.get_json_object(call, "$.usage.total_tokens").try_cast("long"), prompt + output)
    missed = F.greatest(F.lit(0), F.coalesce(F.get_json_object(call, "$.usage.prompt_cache_miss_tokens").try_cast("long"), prompt - cached))
    return {"input": prompt, "output": output, "total": total, "cached": cached, "missed": missed}


def verdict(answer: Column) -> Column:
    """Whether triage wants maintenance: NEEDED but not NOT NEEDED."""
    up = F.upper(answer)
    return F.contains(up, F.lit("NEEDED")) & ~F.contains(up, F.lit("NOT NEEDED"))


def should_maintain(conversation: Column, answer: Column, long: int = 900) -> Column:
    return (F.length(conversation) > long) | F.coalesce(verdict(answer), F.lit(False))


# A line's label in brackets, an account number in it or after it, and labels that are times.
SPEAKER_LABEL = r"^\s*\[([^\[\]\n]{1,40})\]\s*"
ACCOUNT = r"(?i)[（(]\s*QQ\s*[:：]?\s*(\d{5,12})[^）)]*[）)]"
TIME_LABEL = r"\d{1,2}:\d{2}|^\d{4}[-/.]\d{1,2}[-/.]\d{1,2}"


def speakers(text: Column) -> dict[str, Column]:
    """Speaker and account number of a round whose lines are `[name] words`, each where all lines that have one agree; both null if a
    line has no label, or a time for one."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), F.trim), lambda x: x != "")

    def parsed(line: Column) -> Column:
        label = F.trim(F.regexp_extract(line, SPEAKER_LABEL, 1))
        rest = F.regexp_replace(line, SPEAKER_LABEL, "")
        inner = F.regexp_extract(label, ACCOUNT, 1)
        outer = F.regexp_extract(rest, ACCOUNT.replace("(?i)", "(?i)^"), 1)
        name = F.trim(F.regexp_replace(label, ACCOUNT, ""))
        return F.struct(F.when((name != "") & ~name.rlike(TIME_LABEL), name).alias("name"), F.when(inner != "", inner).otherwise(F.when(outer != "", outer)).alias("account"))

    found = F.transform(lines, parsed)
    plain = (F.size(found) > 0) & ~F.exists(found, lambda p: p["name"].isNull())
    one = lambda field: F.array_distinct(F.filter(F.transform(found, lambda p: p[field]), lambda x: x.isNotNull()))
    return {"speaker": F.when(plain & (F.size(one("name")) == 1), F.get(one("name"), 0)), "speaker_id": F.when(plain & (F.size(one("account")) == 1), F.get(one("account"), 0))}


def parse_ops(answer: Column, ddl: str) -> Column:
    """Operations of a model's JSON answer, markdown fences stripped; null where it doesn't parse."""
    return F.from_json(F.regexp_replace(F.trim(answer), r"^```(?:json)?\s*|\s*```$", ""), ddl)


