"""Exact dedup by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, parted
from tessera.session import materialize

PREFIX = 64


def normalised(text: Column) -> Column:
    """Every run of ASCII white space becomes one space; a null text is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def fingerprints(docs: DataFrame, prefix: int = PREFIX) -> DataFrame:
    """One narrow row per document, written once: row, doc_id, n (length), head (prefix hash), digest (SHA-256).

    The text is read by this scan alone. What follows reads from the written table only the columns it needs: lengths
    first, prefix hashes of rows whose length occurs again, digests of rows whose prefix occurs again.
    """
    text = docs.select("doc_id", normalised(F.col("text")).alias("t"))
    return materialize(
        text.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            F.length("t").alias("n"),
            F.xxhash64(F.substring("t", 1, prefix)).alias("head"),
            F.unhex(F.sha2("t", 256)).alias("digest"),
        ),
        "exact",
    )


def refine(prints: DataFrame) -> DataFrame:
    """Groups of two or more equal texts: n, head, digest, keep_id, keep_row, group_size.

    Each level counts with map-side sums, and only rows that survived a level take part in the next one. Survivors' keys are
    written, so that the joins with them have plain shuffles, which Spark can split at hot keys. The last level sums by a salt first, so that a group with a third of all rows leaves the join evenly dealt.
    """
    again = lambda df, keys: materialize(df.groupBy(*keys).count().filter("count > 1").select(*keys), "again")
    same_n = prints.join(again(prints, ["n"]), "n", "left_semi")
    same_head = same_n.join(again(same_n, ["n", "head"]), ["n", "head"], "left_semi")
    keys = ["n", "head", "digest"]
    salted = same_head.withColumn("salt", F.pmod("row", F.lit(64))).repartition(*keys, "salt").groupBy(*keys, "salt")
    return (
        salted.agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"), F.count(F.lit(1)).alias("rows"))
        .groupBy(*keys)
        .agg(F.min("first").alias("first"), F.sum("rows").alias("group_size"))
        .filter("group_size > 1")
        .select("n", "head", "digest", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"), "group_size")
    )


def exact_dedup(docs: DataFrame, prefix: int = PREFIX) -> DataFrame:
    """One row per document with its verdict: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal normalised texts the smallest doc_id stays; a null doc_id comes after all others. Rows repeated with the
    same doc_id are documents of their own, of which one stays. Null texts are empty texts. An empty table gives an
    empty result. Other columns are not read.
    """
    prints = fingerprints(docs, prefix)
    keys = ["n", "head", "digest"]
    return prints.join(materialize(refine(prints), "groups"), keys, "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("keep_row").isNull() | (F.col("keep_row") == F.col("row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def distinct_documents(docs: DataFrame, prefix: int = PREFIX) -> DataFrame:
    """The documents that stay, all columns.

    Lengths and prefix hashes come from one narrow scan; the full hash is taken only of texts whose length and prefix occur
    again. Of equal texts the smallest doc_id stays, null last; of its repeated rows, one. Dropped documents are named by
    (doc_id, digest); only rows whose doc_id may be among those (see parted) move, to be joined with them.
    Null texts are empty texts; empty input, empty result; columns of any name pass through.
    """
    text = normalised(F.col("text"))
    heads = {"n": F.length(text), "head": F.xxhash64(F.substring(text, 1, prefix))}
    first = materialize(docs.select("doc_id", *[c.alias(k) for k, c in heads.items()]), "heads")
    again = lambda df, keys: materialize(df.groupBy(*keys).count().filter("count > 1").select(*keys), "again")
    shared = again(first.join(again(first, ["n"]), "n", "left_semi"), ["n", "head"])
    _, like = parted(docs.select("doc_id", "text", *[c.alias(k) for k, c in heads.items()]), shared, {k: F.col(k) for k in heads})
    digests = materialize(like.select("doc_id", F.unhex(F.sha2(text, 256)).alias("digest")), "digests")
    found = digests.groupBy("digest", "doc_id").count().withColumn("order", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id"))
    stays = found.groupBy("digest").agg(F.min("order").alias("keep"), F.sum("count").alias("rows")).filter("rows > 1").select("digest", "keep")
    verdict = found.join(materialize(stays, "stays"), "digest").select("doc_id", "digest", (F.col("order") == F.col("keep")).alias("stays"), "count")
    named = materialize(verdict.filter("NOT stays OR count > 1").select(F.col("doc_id").alias("named"), F.col("digest").alias("named_digest"), "stays"), "named")
    clean, touched = parted(docs, named.select("named"), {"named": F.col("doc_id")})
    marked = touched.select(F.struct(*docs.columns).alias("document"), F.col("doc_id").alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"))
    met = marked.join(named, F.col("id").eqNullSafe(F.col("named")) & (F.col("digest") == F.col("named_digest")), "left").filter("stays IS NULL OR stays")
    if not named.filter("stays").isEmpty():  # some document that stays has repeated rows
        own = F.when(F.col("stays").isNull(), F.monotonically_increasing_id())
        met = met.withColumn("own", own).dropDuplicates(["id", "digest", "own"])
    return clean.unionByName(met.select("document.*"))
