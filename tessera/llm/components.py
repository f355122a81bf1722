"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import materialize


def _minimum(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = _minimum(both).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _minimum(down)
    moved = down.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, name: str = "stars") -> DataFrame:
    """(u, v): every node u of the edge table (u, v) that is not its component's smallest node, which is v.

    Rounds keep reachability and end when nothing changes, after about log(longest chain) of them. Each round is
    written to the shared folder, so lineage stays short and a lost executor costs a part of one round. Minima are taken
    map-side first and joined back, so a node with many neighbours is never gathered in one place.
    """
    before, stars = None, edges.filter("u <> v")
    while True:
        stars = materialize(_small_star(_large_star(stars).filter("u <> v").distinct()).filter("u <> v").distinct(), name)
        state = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(state) == before:
            return stars
        before = tuple(state)
