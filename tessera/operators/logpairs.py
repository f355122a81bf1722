"""Lines of service logs as events, and answers paired with the requests that they belong to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines of a file that are numbered together.
RANGE = 65_536
#: A line: time, what it is (request, return or feedback), its space, and fields that depend on the kind.
LINE = r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d) \[(\w+)\] space=(\S+)(?: (.*))?$"


def field(rest: Column, name: str) -> Column:
    """The value of name=value in what follows a line's space; null where there is none."""
    found = F.regexp_extract(rest, rf"(?:^| ){name}=(\S+)", 1)
    return F.when(found != "", found)


def parse(lines: DataFrame) -> DataFrame:
    """lines (ord, line) as ord, ts, kind, space and rest; lines of no known form go."""
    part = lambda k: F.regexp_extract("line", LINE, k)
    known = lines.filter(F.col("line").rlike(LINE))
    return known.select("ord", F.to_timestamp(part(1)).alias("ts"), part(2).alias("kind"), part(3).alias("space"), part(4).alias("rest"))


def pair(events: DataFrame, size: int = RANGE) -> DataFrame:
    """space, request, answer: ord of each request and of the return that belongs to it, null where none has come.

    In a space a return belongs to the first request that waits; one that comes while none waits belongs to none. So the k-th return that
    counts meets the k-th request, and a return counts unless the returns up to it outnumber the requests by more than ever before.
    Both are running sums and maxima. A space's lines are cut into ranges of the file, numbered on their own; the sums and maxima of the
    ranges, a row each, are put before them, so no task has a whole space.
    """
    one = lambda kind: (F.col("kind") == kind).cast("long")
    rows = events.filter(F.col("kind").isin("request", "return")).select("space", "ord", "kind", F.floor(F.col("ord") / size).alias("part"))
    own = Window.partitionBy("space", "part").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lead = F.sum(one("return") - one("request")).over(own)
    local = rows.withColumns({"asked": F.sum(one("request")).over(own), "given": F.sum(one("return")).over(own), "lead": lead})
    local = local.withColumn("most", F.max("lead").over(own))
    totals = rows.withColumn("lead", lead).groupBy("space", "part").agg(F.sum(one("request")).alias("asked"), F.sum(one("return")).alias("given"), F.max("lead").alias("most"))
    before = Window.partitionBy("space").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    placed = totals.withColumns({"asked_before": sums("asked"), "given_before": sums("given")}).withColumn("peak", F.col("most") + F.col("given_before") - F.col("asked_before"))
    starts = placed.select("space", "part", "asked_before", "given_before", F.greatest(F.max("peak").over(before), F.lit(0)).alias("peak_before"))
    whole = local.join(starts, ["space", "part"])
    dropped = F.greatest("peak_before", F.col("most") + F.col("given_before") - F.col("asked_before"))
    counted = whole.select("space", "ord", "kind", (F.col("asked_before") + F.col("asked")).alias("n_asked"), (F.col("given_before") + F.col("given") - dropped).alias("n_given"), (F.col("given_before") + F.col("given") - F.col("asked_before") - F.col("asked")).alias("over"), dropped.alias("dropped"))
    # a return is dropped where it raises the maximum: its lead is then that maximum, and the one before it was lower by one
    last = F.lag("dropped").over(Window.partitionBy("space", F.floor(F.col("ord") / size)).orderBy("ord"))
    first = whole.select("space", "ord", "peak_before")
    returns = counted.withColumn("last", last).join(first, ["space", "ord"]).filter((F.col("kind") == "return") & (F.col("dropped") == F.coalesce("last", "peak_before")))
    requests = counted.filter("kind = 'request'").select("space", F.col("n_asked").alias("k"), F.col("ord").alias("request"))
    return requests.join(returns.select("space", F.col("n_given").alias("k"), F.col("ord").alias("answer")), ["space", "k"], "left").select("space", "request", "answer")


def search_metrics(events: DataFrame, pairs: DataFrame) -> DataFrame:
    """space, requests, answered, mean_candidates, abstained, feedback, mean_score: what a log says of each space; feedback counts once for each
    (space, qa_id), since a writer may log it twice."""
    kinds = lambda kind: events.filter(F.col("kind") == kind)
    answers = kinds("return").select("space", F.col("ord").alias("answer"), field(F.col("rest"), "candidates").cast("double").alias("candidates"), (field(F.col("rest"), "abstain") == "1").alias("abstain"))
    met = pairs.join(answers, ["space", "answer"], "left")
    searches = met.groupBy("space").agg(F.count(F.lit(1)).alias("requests"), F.count("answer").alias("answered"), F.avg("candidates").alias("mean_candidates"), F.count_if("abstain").alias("abstained"))
    once = kinds("feedback").select("space", "ord", field(F.col("rest"), "qa_id").alias("qa_id"), field(F.col("rest"), "score").cast("double").alias("score")).filter("qa_id IS NOT NULL")
    judged = once.groupBy("space", "qa_id").agg(F.min_by("score", "ord").alias("score")).groupBy("space").agg(F.count(F.lit(1)).alias("feedback"), F.avg("score").alias("mean_score"))
    return searches.join(judged, "space", "left").na.fill(0, ["feedback"])
