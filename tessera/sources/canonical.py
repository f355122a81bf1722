"""The provided tables seen as a memory graph; each rule has a DuckDB twin in BASE_SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.schema import NODE_TYPES
from tessera.session import table

BLOCK = 8


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, ord, scene, node_type, content, deprecated, forgotten: a node for every vector, its text where there is one."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("content"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("vec_id"), "quality", "toxic")
    kinds = F.array(*[F.lit(t) for t in NODE_TYPES])
    return (
        vectors.join(texts, "vec_id", "left")
        .join(labels, "vec_id", "left")
        .select(
            F.concat(F.lit("n"), "vec_id").alias("node_id"),
            F.col("vec_id").alias("ord"),
            F.col("label").alias("scene"),
            F.get(kinds, F.col("label") % 6).alias("node_type"),
            "content",
            F.coalesce(F.col("quality") == 0, F.lit(False)).alias("deprecated"),
            F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("forgotten"),
        )
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.concat(F.lit("n"), "vec_id").alias("id"), F.col("vec_id").alias("ord"), "embedding")


def scene_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, scene, pos: places within the scene by vec_id, the order of the rule builder.

    Numbered per scene and hash range of vec_id, so that a hot scene's window is never one task's work alone: ranges of
    4096 consecutive ids are counted first and their prefix sums added.
    """
    base = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("scene"), F.floor(F.col("vec_id") / 4096).alias("part"))
    counts = base.groupBy("scene", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("scene").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("scene", "part").orderBy("vec_id")) - 1
    placed = base.withColumn("own", own).join(counts.withColumn("before", before).drop("n"), ["scene", "part"])
    return placed.select(F.concat(F.lit("n"), "vec_id").alias("node_id"), "vec_id", "scene", (F.col("before") + F.col("own")).alias("pos"))


def edge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of the rule builder: src, dst, rel_type, src_ord, dst_ord, rank (0 sequence, 1 scenario, 2 attribute).

    Within a scene each node leads to the next (sequence), within a block of eight every earlier node to every later one
    (scenario), and the block's first to the others (attribute). A node joins its own block's later places, seven at most.
    """
    m = scene_members(spark, sf_dir)
    ahead = F.explode(F.sequence(F.lit(1), F.lit(BLOCK - 1))).alias("step")
    reach = m.select("scene", "pos", F.col("node_id").alias("src"), F.col("vec_id").alias("src_ord"), ahead)
    reach = reach.filter((F.col("step") == 1) | (F.col("pos") % BLOCK + F.col("step") < BLOCK)).withColumn("to", F.col("pos") + F.col("step"))
    later = m.select("scene", F.col("pos").alias("to"), F.col("node_id").alias("dst"), F.col("vec_id").alias("dst_ord"))
    pairs = reach.join(later, ["scene", "to"])
    inside = F.col("pos") % BLOCK + F.col("step") < BLOCK
    ranks = F.array_compact(F.array(F.when(F.col("step") == 1, 0), F.when(inside, 1), F.when(inside & (F.col("pos") % BLOCK == 0), 2)))
    names = F.array(F.lit("sequence"), F.lit("scenario"), F.lit("attribute"))
    return pairs.select("src", "dst", "src_ord", "dst_ord", F.explode(ranks).alias("rank")).withColumn("rel_type", F.get(names, F.col("rank")))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, rel_type, src_ord, dst_ord: one edge for each ordered pair, the last row of the builder winning."""
    best = F.max_by("rel_type", "rank").alias("rel_type")
    return edge_rows(spark, sf_dir).groupBy("src", "dst", "src_ord", "dst_ord").agg(best)


#: CTEs for DuckDB, of the same names and columns.
BASE_SQL = """
WITH nodes AS (
  SELECT 'n' || e.vec_id AS node_id, e.vec_id AS ord, e.label AS scene,
         ['status','reason','action','thing','person','emotion'][(e.label % 6 + 1)::INT] AS node_type, d.text AS content,
         coalesce(l.quality = 0, false) AS deprecated, coalesce(l.toxic = 1, false) AS forgotten, e.embedding::DOUBLE[] AS v
  FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id LEFT JOIN labels l ON l.doc_id = e.vec_id),
active AS (SELECT * FROM nodes WHERE NOT deprecated AND NOT forgotten),
members AS (SELECT node_id, ord, scene, row_number() OVER (PARTITION BY scene ORDER BY ord) - 1 AS pos FROM nodes),
edge_rows AS (
  SELECT a.node_id AS src, b.node_id AS dst, a.ord AS src_ord, b.ord AS dst_ord, 'sequence' AS rel_type, 0 AS rank
  FROM members a JOIN members b ON a.scene = b.scene AND b.pos = a.pos + 1
  UNION ALL SELECT a.node_id, b.node_id, a.ord, b.ord, 'scenario', 1
  FROM members a JOIN members b ON a.scene = b.scene AND a.pos // 8 = b.pos // 8 AND a.pos < b.pos
  UNION ALL SELECT a.node_id, b.node_id, a.ord, b.ord, 'attribute', 2
  FROM members a JOIN members b ON a.scene = b.scene AND a.pos // 8 = b.pos // 8 AND a.pos < b.pos AND a.pos % 8 = 0),
edges AS (SELECT src, dst, src_ord, dst_ord, arg_max(rel_type, rank) AS rel_type FROM edge_rows GROUP BY ALL)
"""
BASE_SQL = BASE_SQL.replace("GROUP BY ALL", "GROUP BY src, dst, src_ord, dst_ord").strip()
