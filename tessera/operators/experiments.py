"""Experiment operators: set stability, perturbation, overlap, greedy matching, threshold sweeps, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.evalstats import jaccard
from tessera.session import materialize


def pairwise_jaccard(sets: DataFrame, group: str, member: str, both_empty: float = 0.0) -> DataFrame:
    """group, a, b, jaccard for each pair of a group's few members (reruns, intents); sets: group, member, ids."""
    x, y = sets.alias("x"), sets.alias("y")
    pairs = x.join(y, (F.col(f"x.{group}") == F.col(f"y.{group}")) & (F.col(f"x.{member}") < F.col(f"y.{member}")))
    return pairs.select(F.col(f"x.{group}").alias(group), F.col(f"x.{member}").alias("a"), F.col(f"y.{member}").alias("b"), jaccard(F.col("x.ids"), F.col("y.ids"), both_empty).alias("jaccard"))


def stability(pairs: DataFrame, group: str) -> DataFrame:
    """One row: mean Jaccard of the groups' means, its 5 % place by floor index, and how many groups never changed."""
    each = pairs.groupBy(group).agg(F.avg("jaccard").alias("j"), F.min("jaccard").alias("low"))
    counts = each.groupBy("j").agg(F.count(F.lit(1)).alias("c"))
    placed = counts.withColumn("hi", F.sum("c").over(Window.orderBy("j"))).withColumn("n", F.sum("c").over(Window.partitionBy()))
    p05 = placed.agg(F.min(F.when(F.col("hi") >= F.floor(0.05 * F.col("n")) + 1, F.col("j"))).alias("p05"))
    return each.agg(F.avg("j").alias("mean"), F.count_if(F.col("low") == 1.0).alias("identical"), F.count(F.lit(1)).alias("groups")).join(F.broadcast(p05))


def shuffle_key(*cols: Column) -> Column:
    """An order that looks random and never changes."""
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))


def delete_share(edges: DataFrame, share: float) -> DataFrame:
    """Edges without about a share of them, chosen by a hash of the pair: no global sort."""
    u = F.conv(F.substring(shuffle_key(F.col("src"), F.col("dst")), 1, 8), 16, 10).cast("long") / float(1 << 32)
    return edges.filter(u >= share)


def rewire_share(edges: DataFrame, share: float) -> DataFrame:
    """src, dst, rel_type: a share of the edges get the target of the next one of their type and hash range; those that would be
    loops or exist already go. Types keep their counts but for these."""
    u = F.conv(F.substring(shuffle_key(F.col("src"), F.col("dst")), 1, 8), 16, 10).cast("long") / float(1 << 32)
    marked = edges.select("src", "dst", "rel_type", (u < share).alias("moved"), shuffle_key(F.col("dst"), F.col("src")).alias("key"))
    ring = Window.partitionBy("rel_type", F.substring("key", 1, 1)).orderBy("key")
    moved = marked.filter("moved").withColumn("to", F.coalesce(F.lead("dst").over(ring), F.first("dst").over(ring)))
    fresh = moved.filter("to <> src").select("src", F.col("to").alias("dst"), "rel_type").dropDuplicates(["src", "dst"])
    return marked.filter("NOT moved").select("src", "dst", "rel_type").union(fresh.join(edges.select("src", "dst"), ["src", "dst"], "left_anti").select("src", "dst", "rel_type"))


def overlap(found: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """One row: gold, found, covered, precision and recall of distinct keys."""
    f, g = found.select(*keys).distinct(), gold.select(*keys).distinct()
    both = f.withColumn("f", F.lit(1)).join(g.withColumn("g", F.lit(1)), keys, "full_outer")
    out = both.agg(F.count("g").alias("gold"), F.count("f").alias("found"), F.count_if(F.col("f").isNotNull() & F.col("g").isNotNull()).alias("covered"))
    return out.withColumns({"precision": F.try_divide("covered", "found"), "recall": F.try_divide("covered", "gold")})


def normalised_fact(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\s\p{P}]+", "")


def fact_hits(facts: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """key, facts, hits: facts (key, fact) found in the normalised answer (key, answer) of their key."""
    joined = facts.join(answers, key, "left")
    hit = F.contains(normalised_fact(F.col("answer")), normalised_fact(F.col("fact"))) & (normalised_fact(F.col("fact")) != "")
    return joined.groupBy(key).agg(F.count(F.lit(1)).alias("facts"), F.count_if(hit).alias("hits"))


def greedy_match(pairs: DataFrame, group: str, threshold: float = 0.75) -> DataFrame:
    """group, a, b, score: pairs (group, a, b, score) taken by falling score, then a and b, each side once per group.

    Only pairs at the threshold or above are read. Each round takes the pairs that are the best of both their sides, which
    are those that one pass in order would take, and drops what these use. Rounds are written to the shared folder; there
    are as many as the longest run of pairs that wait for one another, so equal scores throughout make many.
    """
    cols = [group, "a", "b", "score"]
    rest = materialize(pairs.filter(F.col("score") >= threshold).select(*cols), "pairs")
    taken = rest.limit(0)

    def best(side: str, other: str) -> DataFrame:
        first = F.min(F.struct((-F.col("score")).alias("s"), other))
        return rest.groupBy(group, side).agg(first.alias("m")).select(group, side, F.col(f"m.{other}").alias(other), (-F.col("m.s")).alias("score")).select(*cols)

    while not rest.isEmpty():
        mutual = materialize(best("a", "b").intersect(best("b", "a")), "matched")
        taken = taken.union(mutual)
        for side in "ab":
            used = mutual.select(F.col(group).alias("_group"), F.col(side).alias("_used"))
            rest = rest.join(used, F.col(group).eqNullSafe(F.col("_group")) & F.col(side).eqNullSafe(F.col("_used")), "left_anti")
        rest = materialize(rest, "pairs")
    return taken


def tau_sweep(scored: DataFrame, taus: list[float]) -> DataFrame:
    """tau, mean_size, least, most, pass_rate, recall over queries from (query_id, score, gold): sums for all thresholds in one pass."""
    cells = [x for i, t in enumerate(taus) for x in (F.count_if(F.col("score") >= t).alias(f"n{i}"), F.count_if((F.col("score") >= t) & F.col("gold")).alias(f"g{i}"))]
    per = scored.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("gold").alias("g"), *cells)
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("tau"), F.col(f"n{i}").alias("k"), F.col(f"g{i}").alias("h")) for i, t in enumerate(taus)]))
    each = per.select("n", "g", rows.alias("r")).select("r.*", "n", "g")
    return each.groupBy("tau").agg(F.avg("k").alias("mean_size"), F.min("k").alias("least"), F.max("k").alias("most"), F.avg(F.col("k") / F.col("n")).alias("pass_rate"), F.avg(F.try_divide("h", "g")).alias("recall"))
