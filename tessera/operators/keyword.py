"""Keyword search over title, tags and text with field weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import tokens

# What a term found in a field counts.
FIELD_WEIGHTS = {"title": 3, "tags": 2, "text": 1}
MOST = 50


def postings(docs: DataFrame, fields: tuple[str, ...] = ("title", "tags", "text")) -> DataFrame:
    """term, id, field for every distinct token of each field; docs has id and the fields, of which it may lack some."""
    there = [f for f in fields if f in docs.columns]
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), tokens(F.col(f)).alias("terms")) for f in there]))
    return docs.select("id", each.alias("p")).select(F.explode("p.terms").alias("term"), "id", "p.field")


def search(queries: DataFrame, index: DataFrame, docs: DataFrame, top_k: int | None = 8) -> DataFrame:
    """query_id, id, score, place: min(1, weighted hits / (3 * query terms)), 4 digits, best first, then newest, then id.

    queries: query_id, text. index: postings. docs: id, observed_at (null counts as 0). One join on the term, sums taken before the
    shuffle; a term that most documents have is spread by the size of its posting list, which Spark splits.
    """
    k = top_k if isinstance(top_k, int) and not isinstance(top_k, bool) else 8
    asked = queries.select("query_id", tokens(F.col("text")).alias("terms")).withColumn("n", F.size("terms"))
    weight = F.create_map(*[x for f, w in FIELD_WEIGHTS.items() for x in (F.lit(f), F.lit(w))])
    hits = asked.select("query_id", "n", F.explode("terms").alias("term")).join(index, "term")
    raw = hits.groupBy("query_id", "id", "n").agg(F.sum(weight[F.col("field")]).alias("hit"))
    scored = raw.withColumn("score", F.round(F.least(F.lit(1.0), F.col("hit") / (3.0 * F.col("n"))), 4)).join(docs.select("id", F.coalesce("observed_at", F.lit(0)).alias("at")), "id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("at"), "id"))
    return scored.withColumn("place", place).filter(F.col("place") <= max(1, min(MOST, k))).select("query_id", "id", "score", "place")


def new_notes(notes: DataFrame, proposed: DataFrame) -> DataFrame:
    """Proposed notes (title, text, tags, ...) with note_id of the same stored note, null where it is new, and reject_reason."""
    reason = (
        F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "empty text")
        .when(F.length("text") > 4000, "text too long")
        .when(F.length("title") > 200, "title too long")
        .when((F.size("tags") > 20) | F.exists("tags", lambda t: F.length(t) > 50), "tags")
    )
    key = [F.col("title"), F.col("text"), F.array_join(F.sort_array(F.coalesce("tags", F.array().cast("array<string>"))), "\x1f").alias("_tags")]
    known = notes.select(*key, "note_id").groupBy("title", "text", "_tags").agg(F.min("note_id").alias("note_id"))
    return proposed.withColumn("_tags", key[2]).withColumn("reject_reason", reason).join(known, ["title", "text", "_tags"], "left").drop("_tags")
