"""Mixing sources to target weights: weighted sampling without replacement to a word budget for each source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import n_words, uniform
from tessera.session import materialize

#: Key ranges for each doubling of the key: none holds more than a seven-hundredth of a source's documents.
CLASSES = 256


def quality(size: Column, text: Column) -> Column:
    """Default document weight, 0.5 to 1: how near the mean length of words is to six characters."""
    mean = F.length(text) / F.greatest(size, F.lit(1))
    return F.coalesce(0.5 + 0.5 / (1.0 + F.abs(mean - 6.0) / 6.0), F.lit(0.5))


def budgets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Targets by source from (_source_key, source_size): weight shares of the budget, none above cap times its size.

    Sources in key order weigh as `weights`, repeating. Sorted by cap/weight, the capped sources come first: each of
    them is above what is left shared by the weights left; the first that is not sets the level for the rest. The
    window runs over one row per source.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy("_source_key")))
    weighed = ranked.select(
        "_source_key",
        "source_size",
        F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")).alias("w"),
        (F.col("source_size") * cap).alias("most"),
    )
    order = Window.orderBy(F.col("most") / F.col("w"), "_source_key")
    earlier, later = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = weighed.select(
        "*",
        F.row_number().over(order).alias("place"),
        ((F.sum("source_size").over(everything) * share - F.coalesce(F.sum("most").over(earlier), F.lit(0.0))) / F.sum("w").over(later)).alias("level"),
    )
    free = F.when(F.col("most") > F.col("level") * F.col("w"), F.struct("place", "level"))
    level = F.min(free).over(everything)["level"]
    return levels.select("_source_key", "source_size", F.least("most", F.coalesce(level * F.col("w"), F.col("most"))).alias("target"))


def level(key: Column) -> Column:
    """The range of a positive key: CLASSES of them for each doubling, so that ranges fit keys of any scale."""
    return F.floor(F.log2(F.greatest(key, F.lit(2.0**-40))) * CLASSES).cast("int")


def source_key(source: Column) -> Column:
    """Sources as text in order of their code points, null last."""
    return F.when(source.isNull(), F.lit("t")).otherwise(F.concat(F.lit("s"), source.cast("string")))


def order_key(doc_id: Column, text: Column, weight: Column) -> Column:
    """The exponential key -ln(u)/weight; u derives from doc_id, or from the text where that is null."""
    u = uniform(F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), F.xxhash64(text).cast("string"))))
    return -F.log(u) / F.when(weight > 1e-6, weight).otherwise(F.lit(1e-6))


def narrow(docs: DataFrame, weight: Column | None) -> DataFrame:
    """sk, doc_id, source, size, key and level of every document; all that the mix has to know."""
    n = n_words(F.col("text"))
    sized = docs.select(source_key(F.col("source")).alias("sk"), "doc_id", "source", "text", n.alias("size"), (weight if weight is not None else quality(n, F.col("text"))).alias("weight"))
    keyed = sized.select("sk", "doc_id", "source", "size", order_key(F.col("doc_id"), F.col("text"), F.col("weight")).alias("key"))
    return keyed.withColumn("level", level(F.col("key")))


def cuts(keyed: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """One row per source: sk, source_size, target, epochs and `last`, the last (key, doc_id, size) that is taken once more.

    Taken documents are those before a cut in key order. Sums of the levels tell the level that holds the cut; only its rows
    are ordered. Rows alike in key, doc_id and size count as one there.
    """
    totals = materialize(keyed.groupBy("sk", "level").agg(F.sum("size").alias("words")), "mix")
    plan = budgets(totals.groupBy("sk").agg(F.sum("words").alias("source_size")).withColumnRenamed("sk", "_source_key"), weights, share, cap)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = plan.withColumnRenamed("_source_key", "sk").withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    plan = materialize(plan, "plan")
    upto = F.sum("words").over(Window.partitionBy("sk").orderBy("level"))
    at = totals.withColumn("before", upto - F.col("words")).join(plan.select("sk", "rest"), "sk")
    edge = materialize(at.filter((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words"))).select("sk", "level", "before", "rest"), "edge")
    alike = keyed.join(edge, ["sk", "level"]).filter("size > 0").groupBy("sk", "key", "doc_id", "size", "before", "rest").agg(F.sum("size").alias("words"))
    within = F.sum("words").over(Window.partitionBy("sk").orderBy("key", "doc_id", "size")) - F.col("words") / 2.0
    taken = alike.withColumn("middle", F.col("before") + within).filter(F.col("middle") <= F.col("rest"))
    last = taken.groupBy("sk").agg(F.max(F.struct("key", "doc_id", "size")).alias("last"))
    return materialize(plan.join(edge.select("sk", F.col("level").alias("edge")), "sk", "left").join(last, "sk", "left").select("sk", "source_size", "target", "epochs", "edge", "last"), "cuts")


def copies(size: Column) -> Column:
    """How often a document is taken, from its size, key, level and doc_id and the row of cuts of its source."""
    own = F.struct("key", "doc_id", size.alias("size"))
    within = (F.col("level") < F.col("edge")) | ((F.col("level") == F.col("edge")) & (own <= F.col("last")))
    return F.when(size > 0, F.col("epochs") + F.when(within, 1).otherwise(0)).otherwise(0).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, weight: Column | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target (both of the source), copies and taken (size times copies) of all documents.

    Efraimidis-Spirakis keys -ln(u)/weight order each source; u derives from doc_id (of a null one, from the text), so reruns
    agree. A source's target takes complete epochs first; the rest takes documents in key order while the middle of the
    document lies within it, so a source misses its target by at most half a document. Prefix sums run over levels of
    the key, and only the level with a source's cut is ordered; so a hot source is spread over tasks, whatever the scale of the weights.

    A null source is a source of its own, ordered last; a null or wordless text has size 0 and is taken for nothing.
    A weight that is null or not positive counts as the least weight 1e-6. Repeated rows are documents of their own, but
    rows alike in doc_id and size at the cut of a source are taken or left together. Only doc_id, text, source and what
    weight reads are looked at. Empty input, empty result.
    """
    keyed = materialize(narrow(docs, weight), "keys")
    found = keyed.join(cuts(keyed, weights, share, cap), "sk").withColumn("copies", copies(F.col("size")))
    return found.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, weight: Column | None = None) -> DataFrame:
    """The mix itself: each document repeated as often as it is taken, with the columns of the input.

    Documents are not shuffled for it: the cut of a source tells from a row alone how often it is taken.
    """
    found = cuts(materialize(narrow(docs, weight), "keys"), weights, share, cap)
    whole = docs.select(F.struct(*docs.columns).alias("document"), *([weight.alias("weight")] if weight is not None else []))
    part = lambda c: F.col(f"document.{c}")
    n = n_words(part("text"))
    sized = whole.withColumn("size", n)
    sized = sized if weight is not None else sized.withColumn("weight", quality(F.col("size"), part("text")))
    keyed = sized.select("document", source_key(part("source")).alias("sk"), part("doc_id").alias("doc_id"), "size", order_key(part("doc_id"), part("text"), F.col("weight")).alias("key"))
    taken = keyed.withColumn("level", level(F.col("key"))).join(found, "sk").withColumn("copies", copies(F.col("size"))).filter("copies > 0")
    return taken.select("document", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("document.*")
