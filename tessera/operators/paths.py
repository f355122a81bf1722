"""Path activation counters and path keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def path_key(src: Column, dst: Column, rel_type: Column) -> Column:
    return F.concat(src, F.lit("→"), dst, F.lit("@"), rel_type)


def sequence_key(nodes: Column, relations: Column) -> Column:
    """The key of a whole walk: arrays of its nodes and of the relations between them."""
    return F.concat(F.lit("["), F.array_join(nodes, "→"), F.lit("]|["), F.array_join(relations, "→"), F.lit("]"))


def lifetime_factor(n: Column) -> Column:
    """Grows by 0.05 an activation, 2 at most."""
    return F.least(F.lit(2.0), 1.0 + 0.05 * n)


def satiation_factor(n: Column) -> Column:
    """Falls by 0.15 an activation within the session, 0.3 at least."""
    return F.greatest(F.lit(0.3), 1.0 - 0.15 * n)


def multiplier(lifetime: Column, session: Column) -> Column:
    """1 for a path never activated, else the product of both factors."""
    life = F.coalesce(lifetime, F.lit(0))
    return F.when(life == 0, F.lit(1.0)).otherwise(lifetime_factor(life) * satiation_factor(F.coalesce(session, F.lit(0))))


def counters(activations: DataFrame, session: Column) -> DataFrame:
    """path_key, lifetime, session counts of an activation log (path_key, session_id)."""
    return activations.groupBy("path_key").agg(F.count(F.lit(1)).alias("lifetime"), F.count_if(F.col("session_id") == session).alias("session"))


def summary(counts: DataFrame) -> DataFrame:
    """One row of counts, maxima, means and paths at the cap and the floor of their factors."""
    return counts.agg(
        F.count(F.lit(1)).alias("paths"),
        F.sum("lifetime").alias("activations"),
        F.max("lifetime").alias("most"),
        F.count_if(F.abs(lifetime_factor(F.col("lifetime")) - 2.0) <= 0.01).alias("at_cap"),
        F.count_if((F.col("session") > 0) & (F.abs(satiation_factor(F.col("session")) - 0.3) <= 0.01)).alias("at_floor"),
        F.round(F.avg("lifetime"), 6).alias("mean_lifetime"),
    )
