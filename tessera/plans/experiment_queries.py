"""Experiment queries over the provided tables, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import experiments as X
from tessera.session import table
from tessera.sources import canonical as C
from tessera.sources.canonical import BASE_SQL

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


SETS = """WITH s AS (SELECT user_id AS query_id, event_id % 3 AS rep, list(DISTINCT event_type) AS ids FROM events GROUP BY 1, 2),
  p AS (SELECT x.query_id, x.rep AS a, y.rep AS b, len(list_intersect(x.ids, y.ids)) / len(list_distinct(list_concat(x.ids, y.ids)))::DOUBLE AS jaccard FROM s x JOIN s y ON x.query_id = y.query_id AND x.rep < y.rep)"""


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "events").groupBy(F.col("user_id").alias("query_id"), (F.col("event_id") % 3).alias("rep")).agg(F.collect_set("event_type").alias("ids"))
    return X.pairwise_jaccard(s, "query_id", "rep")


@query(SETS + "SELECT query_id, a, b, round(jaccard, 6) AS jaccard FROM p")
def rerun_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).withColumn("jaccard", F.round("jaccard", 6))


@query(SETS + ", e AS (SELECT query_id, avg(jaccard) AS j, min(jaccard) AS low FROM p GROUP BY query_id), l AS (SELECT list_sort(list(j)) AS a FROM e) SELECT round(avg(j), 6) AS mean, count(*) FILTER (low = 1) AS identical, count(*) AS groups, round(any_value(a[floor(0.05 * (SELECT count(*) FROM e))::INT + 1]), 6) AS p05 FROM e, l")
def rerun_stability(spark: SparkSession, sf: str) -> DataFrame:
    s = X.stability(_pairs(spark, sf), "query_id")
    return s.select(F.round("mean", 6).alias("mean"), "identical", "groups", F.round("p05", 6).alias("p05"))


U = "(('0x' || substr(md5(src || '|' || dst), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


@query(BASE_SQL + f"SELECT src, dst, rel_type FROM edges WHERE {U} >= 0.3")
def perturb_delete(spark: SparkSession, sf: str) -> DataFrame:
    return X.delete_share(C.edges(spark, sf), 0.3).select("src", "dst", "rel_type")


@query(BASE_SQL + f""", m AS (SELECT src, dst, rel_type, {U} < 0.3 AS moved, md5(dst || '|' || src) AS key FROM edges),
  r AS (SELECT src, rel_type, coalesce(lead(dst) OVER w, first_value(dst) OVER w) AS dst FROM m WHERE moved WINDOW w AS (PARTITION BY rel_type, substr(key, 1, 1) ORDER BY key))
  SELECT src, count(*) AS n FROM (SELECT src, dst FROM m WHERE NOT moved UNION ALL (SELECT src, dst FROM r WHERE src <> dst AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = r.src AND e.dst = r.dst) GROUP BY src, dst)) GROUP BY src""")
def perturb_rewire(spark: SparkSession, sf: str) -> DataFrame:
    return X.rewire_share(C.edges(spark, sf), 0.3).groupBy("src").agg(F.count(F.lit(1)).alias("n"))


@query(BASE_SQL + f", f AS (SELECT src, dst FROM edges WHERE {U} >= 0.3), g AS (SELECT src, dst FROM edges WHERE rel_type <> 'sequence'), b AS (SELECT f.src AS f, g.src AS g FROM f FULL JOIN g ON f.src = g.src AND f.dst = g.dst) SELECT count(g) AS gold, count(f) AS found, count(*) FILTER (f IS NOT NULL AND g IS NOT NULL) AS covered, round(count(*) FILTER (f IS NOT NULL AND g IS NOT NULL) / count(f)::DOUBLE, 6) AS precision, round(count(*) FILTER (f IS NOT NULL AND g IS NOT NULL) / count(g)::DOUBLE, 6) AS recall FROM b")
def structure_overlap(spark: SparkSession, sf: str) -> DataFrame:
    e = C.edges(spark, sf)
    o = X.overlap(X.delete_share(e, 0.3), e.filter("rel_type <> 'sequence'"), ["src", "dst"])
    return o.select("gold", "found", "covered", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(r"""
WITH a AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn, text) FILTER (role = 'assistant') AS answer FROM conversations GROUP BY conv_id),
n AS (
  SELECT c.conv_id, regexp_replace(lower(coalesce(text, '')), '[\s\p{P}]+', '', 'g') AS f, regexp_replace(lower(coalesce(answer, '')), '[\s\p{P}]+', '', 'g') AS a
  FROM conversations c JOIN a USING (conv_id))
SELECT conv_id, count(*) AS facts, count(*) FILTER (contains(a, f) AND f <> '') AS hits FROM n GROUP BY conv_id
""")
def fact_match(spark: SparkSession, sf: str) -> DataFrame:
    """Every turn as a fact that the answer, all that the assistant said, may hold."""
    c = table(spark, sf, "conversations")
    said = F.sort_array(F.collect_list(F.when(F.col("role") == "assistant", F.struct("turn", "text"))))
    answers = c.groupBy("conv_id").agg(F.array_join(F.transform(said, lambda r: r["text"]), " ").alias("answer"))
    return X.fact_hits(c.select("conv_id", F.col("text").alias("fact")), answers, "conv_id")


@query("""WITH s AS (SELECT user_id AS query_id, value / 100.0::DOUBLE AS score, event_type = 'purchase' AS gold FROM events), t AS (SELECT unnest([0.1, 0.3, 0.5, 0.7]::DOUBLE[]) AS tau),
  e AS (SELECT tau, query_id, count(*) FILTER (score >= tau) AS k, count(*) FILTER (score >= tau AND gold) AS h, count(*) AS n, count(*) FILTER (gold) AS g FROM s, t GROUP BY tau, query_id)
  SELECT tau, round(avg(k), 6) AS mean_size, min(k) AS least, max(k) AS most, round(avg(k / n::DOUBLE), 6) AS pass_rate, round(avg(h / nullif(g, 0)::DOUBLE), 6) AS recall FROM e GROUP BY tau""")
def filter_tau_sweep(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "events").select(F.col("user_id").alias("query_id"), (F.col("value") / 100.0).alias("score"), (F.col("event_type") == "purchase").alias("gold"))
    out = X.tau_sweep(s, [0.1, 0.3, 0.5, 0.7])
    return out.select("tau", F.round("mean_size", 6).alias("mean_size"), "least", "most", F.round("pass_rate", 6).alias("pass_rate"), F.round("recall", 6).alias("recall"))


@query()
def greedy_matching(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes matched one to one with near nodes of the next scene block, by falling cosine."""
    from tessera.operators.vectors import duplicate_pairs

    n = C.nodes(spark, sf)
    pairs = duplicate_pairs(n, C.vectors(spark, sf), 0.3).join(n.select(F.col("node_id").alias("a"), "scene"), "a")
    return X.greedy_match(pairs.select("scene", "a", "b", F.round("score", 6).alias("score")), "scene", 0.3)
