"""Graph, edge and statistics queries over the provided tables, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import graph as G
from tessera.schema import MUTUAL, jump_rows
from tessera.sources import canonical as C
from tessera.sources.canonical import BASE_SQL

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


#: The 96 weights as SQL rows.
JUMP_SQL = "jump(node_type, rel_type, is_reverse, weight) AS (VALUES " + ", ".join(f"('{t}', '{r}', {str(v).lower()}, {w}::DOUBLE)" for t, r, v, w in jump_rows()) + ")"
ADJ_SQL = """adj AS (SELECT src AS node_id, dst AS nbr, rel_type, false AS is_reverse, dst_ord AS edge_ord FROM edges
  UNION ALL SELECT dst, src, rel_type, true, src_ord FROM edges)"""
DEG_SQL = """deg AS (SELECT n.node_id, coalesce(i.c, 0)::BIGINT AS in_degree, coalesce(o.c, 0)::BIGINT AS out_degree FROM nodes n
  LEFT JOIN (SELECT dst, count(*) c FROM edges GROUP BY dst) i ON i.dst = n.node_id LEFT JOIN (SELECT src, count(*) c FROM edges GROUP BY src) o ON o.src = n.node_id)"""
quoted = lambda names: ", ".join(f"'{x}'" for x in names)


@query(BASE_SQL + "SELECT node_id, node_type, content FROM active")
def nodes_active(spark: SparkSession, sf: str) -> DataFrame:
    return G.active(C.nodes(spark, sf)).select("node_id", "node_type", "content")


@query(BASE_SQL + ", " + DEG_SQL + """SELECT count(*) AS total_nodes, count(*) FILTER (deprecated) AS deprecated, count(*) FILTER (forgotten) AS forgotten,
  count(*) FILTER (NOT deprecated AND NOT forgotten) AS active, count(*) FILTER (in_degree + out_degree = 0) AS orphans,
  count(*) FILTER (in_degree + out_degree = 0 AND NOT deprecated AND NOT forgotten) AS active_orphans, sum(out_degree)::BIGINT AS total_edges,
  round(sum(out_degree) / (count(*)::DOUBLE * (count(*) - 1)), 6) AS density FROM nodes JOIN deg USING (node_id)""")
def graph_stats(spark: SparkSession, sf: str) -> DataFrame:
    return G.stats(C.nodes(spark, sf), C.edges(spark, sf))


@query(BASE_SQL + "SELECT node_type, count(*) AS n, count(*) FILTER (deprecated) AS deprecated, count(*) FILTER (forgotten) AS forgotten FROM nodes GROUP BY node_type")
def type_counts(spark: SparkSession, sf: str) -> DataFrame:
    return C.nodes(spark, sf).groupBy("node_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("deprecated").alias("deprecated"), F.count_if("forgotten").alias("forgotten"))


@query(BASE_SQL + ", " + DEG_SQL + "SELECT * FROM deg")
def degrees(spark: SparkSession, sf: str) -> DataFrame:
    return G.degrees(C.nodes(spark, sf), C.edges(spark, sf))


@query(BASE_SQL + ", " + DEG_SQL + "SELECT node_id FROM deg WHERE in_degree = 0")
def rootless_nodes(spark: SparkSession, sf: str) -> DataFrame:
    ends = C.edges(spark, sf).select(F.col("dst").alias("node_id"))
    return C.nodes(spark, sf).select("node_id").join(ends, "node_id", "left_anti")


_SPARSE = ", sparse AS (SELECT * FROM edges WHERE (src_ord + dst_ord) % 7 = 0)"


@query(BASE_SQL + _SPARSE + """
SELECT n.node_id FROM active n
WHERE NOT EXISTS (SELECT 1 FROM sparse e JOIN active a ON a.node_id = e.dst WHERE e.src = n.node_id)
  AND NOT EXISTS (SELECT 1 FROM sparse e JOIN active a ON a.node_id = e.src WHERE e.dst = n.node_id)
""")
def orphans(spark: SparkSession, sf: str) -> DataFrame:
    """Active nodes without an active neighbour, in a thinned graph (a seventh of the edges), so that there are some."""
    live, e = G.active(C.nodes(spark, sf)).select("node_id"), C.edges(spark, sf).filter("(src_ord + dst_ord) % 7 = 0")
    kept = e.join(live.withColumnRenamed("node_id", "src"), "src", "left_semi").join(live.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    return live.join(kept.select(F.explode(F.array("src", "dst")).alias("node_id")), "node_id", "left_anti")


@query(BASE_SQL + "SELECT src, dst, rel_type FROM edge_rows")
def edges_rule_build(spark: SparkSession, sf: str) -> DataFrame:
    return C.edge_rows(spark, sf).select("src", "dst", "rel_type")


@query(BASE_SQL + "SELECT src, dst, rel_type FROM edges")
def edges_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    rows = C.edge_rows(spark, sf).select("src", "dst", "rel_type", F.lit(False).alias("bidirectional"), F.col("rank").alias("ord"))
    return G.load_edges(rows, "last_wins").select("src", "dst", "rel_type")


@query(BASE_SQL + "SELECT src, dst, arg_min(rel_type, rank) AS rel_type FROM edge_rows GROUP BY src, dst")
def edges_first_wins(spark: SparkSession, sf: str) -> DataFrame:
    rows = C.edge_rows(spark, sf).select("src", "dst", "rel_type", F.lit(False).alias("bidirectional"), F.col("rank").alias("ord"))
    return G.load_edges(rows, "first_wins").select("src", "dst", "rel_type")


@query(BASE_SQL + "SELECT src, dst, rel_type, CASE WHEN row_number() OVER (PARTITION BY src, dst ORDER BY rank) > 1 THEN 'pair exists' END AS reject_reason FROM edge_rows")
def edges_reject(spark: SparkSession, sf: str) -> DataFrame:
    rows = C.edge_rows(spark, sf).select("src", "dst", "rel_type", F.lit(False).alias("bidirectional"), F.col("rank").alias("ord"))
    return G.load_edges(rows, "reject").select("src", "dst", "rel_type", "reject_reason")


_BOTH = f""", both_ways AS (SELECT src, dst, rel_type, src_ord, dst_ord FROM edges UNION ALL
  SELECT dst, src, rel_type, dst_ord, src_ord FROM edges WHERE rel_type IN ({quoted(MUTUAL)}))"""


@query(BASE_SQL + _BOTH + """SELECT arg_min(src, (src_ord, dst_ord)) AS src, arg_min(dst, (src_ord, dst_ord)) AS dst, rel_type, count(DISTINCT src) > 1 AS bidirectional
  FROM both_ways GROUP BY least(src, dst), greatest(src, dst), rel_type""")
def edges_canonical_bidirectional(spark: SparkSession, sf: str) -> DataFrame:
    e = C.edges(spark, sf)
    back = e.filter(F.col("rel_type").isin(MUTUAL)).select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("dst_ord").alias("src_ord"), F.col("src_ord").alias("dst_ord"), "rel_type")
    return G.canonical_edges(e.unionByName(back))


@query(BASE_SQL + _BOTH + "SELECT src, dst, rel_type FROM both_ways")
def edges_with_reverse(spark: SparkSession, sf: str) -> DataFrame:
    return G.with_reverse(C.edges(spark, sf))


@query(BASE_SQL + ", " + DEG_SQL + """SELECT n.node_id, n.node_type, CASE WHEN length(content) > 50 THEN substr(content, 1, 50) || '…' ELSE coalesce(content, '') END AS label,
  in_degree, out_degree, CASE node_type WHEN 'action' THEN 5 WHEN 'thing' THEN 5 WHEN 'person' THEN 7 ELSE 6 END AS radius, deprecated, forgotten FROM nodes n JOIN deg USING (node_id)""")
def export_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return G.export_nodes(C.nodes(spark, sf), C.edges(spark, sf))


@query(BASE_SQL + ", " + ADJ_SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY is_reverse, edge_ord) AS place FROM adj WHERE node_id IN (SELECT node_id FROM nodes WHERE ord % 50 = 0))
  SELECT r.node_id, place::INT AS place, nbr, rel_type, is_reverse, substr(n.content, 1, 400) AS content, length(n.content) > 400 AS truncated FROM r LEFT JOIN nodes n ON n.node_id = r.nbr WHERE place <= 80""")
def inspect_graph(spark: SparkSession, sf: str) -> DataFrame:
    n = C.nodes(spark, sf)
    return G.inspect(n, C.edges(spark, sf), n.filter("ord % 50 = 0"))


@query(BASE_SQL + ", " + DEG_SQL + """, top AS (SELECT n.node_id, node_type FROM nodes n JOIN deg USING (node_id) ORDER BY in_degree + out_degree DESC, ord LIMIT 50),
  c AS (SELECT arg_min(src, (src_ord, dst_ord)) AS s, arg_min(dst, (src_ord, dst_ord)) AS d, rel_type, count(DISTINCT src) > 1 AS b FROM edges GROUP BY least(src, dst), greatest(src, dst), rel_type)
  SELECT '  ' || node_id || '[' || node_type || ']' AS line FROM top UNION ALL
  SELECT '  ' || s || CASE WHEN b THEN ' <--> ' ELSE ' --> ' END || '|' || rel_type || '| ' || d FROM c WHERE s IN (SELECT node_id FROM top) AND d IN (SELECT node_id FROM top)""")
def mermaid_top_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return G.mermaid(C.nodes(spark, sf), C.edges(spark, sf))


@query(BASE_SQL + ", " + ADJ_SQL + ", " + JUMP_SQL + """, f AS (SELECT ord AS query_id, node_id FROM nodes WHERE ord % 50 = 0)
  SELECT f.query_id, a.nbr AS node_id, max(j.weight) AS weight FROM f JOIN adj a ON a.node_id = f.node_id JOIN nodes n ON n.node_id = a.node_id
  JOIN jump j ON j.node_type = n.node_type AND j.rel_type = a.rel_type AND j.is_reverse = a.is_reverse WHERE j.weight > 0 AND a.nbr <> f.node_id GROUP BY f.query_id, a.nbr""")
def expand_max_weight(spark: SparkSession, sf: str) -> DataFrame:
    n = C.nodes(spark, sf)
    frontier = n.filter("ord % 50 = 0").select(F.col("ord").alias("query_id"), "node_id", F.lit(0).alias("pos"))
    return G.expand(frontier, G.weighted_adjacency(C.edges(spark, sf), n)).select("query_id", "node_id", "weight")


@query(BASE_SQL + ", " + ADJ_SQL + ", " + JUMP_SQL + """, f AS (SELECT scene AS query_id, node_id, (ord // 50)::INT AS pos FROM nodes WHERE ord % 50 = 0),
  m AS (SELECT f.query_id, a.nbr, j.weight, a.node_id AS parent, a.rel_type, a.is_reverse, row_number() OVER (PARTITION BY f.query_id, a.nbr ORDER BY j.weight DESC, pos, a.is_reverse, edge_ord) AS rn
    FROM f JOIN adj a ON a.node_id = f.node_id JOIN nodes n ON n.node_id = a.node_id JOIN jump j ON j.node_type = n.node_type AND j.rel_type = a.rel_type AND j.is_reverse = a.is_reverse WHERE j.weight > 0)
  SELECT m.query_id, nbr AS node_id, weight, parent, rel_type, is_reverse FROM m WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM f WHERE f.query_id = m.query_id AND f.node_id = m.nbr)""")
def expand_trace_argmax(spark: SparkSession, sf: str) -> DataFrame:
    n = C.nodes(spark, sf)
    frontier = n.filter("ord % 50 = 0").select(F.col("scene").alias("query_id"), "node_id", F.floor(F.col("ord") / 50).cast("int").alias("pos"))
    return G.expand(frontier, G.weighted_adjacency(C.edges(spark, sf), n))


@query(BASE_SQL + ", " + ADJ_SQL + ", " + JUMP_SQL + """SELECT n.node_type, a.rel_type, a.is_reverse, coalesce(any_value(j.weight), 0) AS weight, count(*) AS n FROM adj a JOIN nodes n USING (node_id)
  LEFT JOIN jump j ON j.node_type = n.node_type AND j.rel_type = a.rel_type AND j.is_reverse = a.is_reverse GROUP BY n.node_type, a.rel_type, a.is_reverse""")
def jump_weights(spark: SparkSession, sf: str) -> DataFrame:
    """The weight of every kind of step that the graph has, and how many there are."""
    kinds = ["node_type", "rel_type", "is_reverse"]
    steps = G.adjacency(C.edges(spark, sf)).join(C.nodes(spark, sf).select("node_id", "node_type"), "node_id").groupBy(*kinds).agg(F.count(F.lit(1)).alias("n"))
    return steps.select(*kinds, G.jump_weight(*[F.col(c) for c in kinds]).alias("weight"), "n")


@query(BASE_SQL + "SELECT src, dst, rel_type, src || '→' || dst || '@' || rel_type AS path_key FROM edges")
def path_keys(spark: SparkSession, sf: str) -> DataFrame:
    from tessera.operators.paths import path_key

    return C.edges(spark, sf).select("src", "dst", "rel_type", path_key(F.col("src"), F.col("dst"), F.col("rel_type")).alias("path_key"))


@query(BASE_SQL.replace("WITH nodes", "WITH RECURSIVE nodes") + """, u AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
  walk(query_id, node_id, depth) AS (SELECT ord, node_id, 0 FROM nodes WHERE ord % 50 = 0 UNION SELECT w.query_id, u.b, w.depth + 1 FROM walk w JOIN u ON u.a = w.node_id WHERE w.depth < 2)
  SELECT query_id, node_id, min(depth) AS depth FROM walk GROUP BY query_id, node_id""")
def khop_undirected(spark: SparkSession, sf: str) -> DataFrame:
    starts = C.nodes(spark, sf).filter("ord % 50 = 0").select(F.col("ord").alias("query_id"), "node_id")
    return G.khop(C.edges(spark, sf), starts, 2)


@query(BASE_SQL + "SELECT node_id FROM nodes WHERE contains(lower(content), 'resh') OR contains(lower(node_id), 'resh')")
def substring_search(spark: SparkSession, sf: str) -> DataFrame:
    return C.nodes(spark, sf).filter(F.contains(F.lower("content"), F.lit("resh")) | F.contains(F.lower("node_id"), F.lit("resh"))).select("node_id")


@query(BASE_SQL + ", " + DEG_SQL + """, s AS (SELECT a.node_id FROM active a JOIN deg USING (node_id) WHERE node_type IN ('status', 'action', 'thing')
    AND in_degree + out_degree >= (SELECT quantile_cont(in_degree + out_degree, 0.5) FROM deg))
  SELECT src, dst, rel_type FROM edges WHERE src IN (SELECT node_id FROM s) AND dst IN (SELECT node_id FROM s) AND rel_type IN ('sequence', 'attribute')""")
def layer_filter(spark: SparkSession, sf: str) -> DataFrame:
    return G.layer_filter(C.nodes(spark, sf), C.edges(spark, sf), ["status", "action", "thing"], ["sequence", "attribute"], dense=True)[1].select("src", "dst", "rel_type")


@query(BASE_SQL + """SELECT rel_type, count(*) AS n, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM edges GROUP BY rel_type""")
def edge_type_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return C.edges(spark, sf).groupBy("rel_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("src").alias("sources"), F.count_distinct("dst").alias("targets"))


@query(BASE_SQL + """, r AS (SELECT src, dst, rel_type FROM edge_rows UNION ALL SELECT src, src, 'scenario' FROM edges WHERE rel_type = 'sequence' UNION ALL SELECT src, 'gone', 'causal' FROM edges WHERE rel_type = 'attribute'
    UNION ALL SELECT src, dst, 'unknown' FROM edges WHERE rel_type = 'scenario'),
  t AS (SELECT r.*, s.node_id AS s, d.node_id AS d FROM r LEFT JOIN nodes s ON s.node_id = r.src LEFT JOIN nodes d ON d.node_id = r.dst)
  SELECT CASE WHEN s IS NULL OR d IS NULL THEN 'missing endpoint' WHEN src = dst THEN 'self loop' WHEN rel_type = 'unknown' THEN 'unknown relation' ELSE 'accepted' END AS verdict, count(*) AS n FROM t GROUP BY 1""")
def edge_validation_reject_reasons(spark: SparkSession, sf: str) -> DataFrame:
    from tessera.operators.maintenance import edge_reject_reason

    e, rows = C.edges(spark, sf), C.edge_rows(spark, sf).select("src", "dst", "rel_type")
    pick = lambda rel, *cols: e.filter(F.col("rel_type") == rel).select(*cols)
    proposed = (
        rows.union(pick("sequence", "src", "src", F.lit("scenario")))
        .union(pick("attribute", "src", F.lit("gone"), F.lit("causal")))
        .union(pick("scenario", "src", "dst", F.lit("unknown")))
    )
    judged = edge_reject_reason(proposed, C.nodes(spark, sf), check_weight=False)
    return judged.groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query(BASE_SQL + ", " + DEG_SQL + """, d AS (SELECT node_id, node_type, length(content) AS chars, in_degree + out_degree AS d FROM nodes JOIN deg USING (node_id)),
  l AS (SELECT list_sort(list(chars)) AS a, count(chars) AS n FROM d WHERE chars IS NOT NULL)
  SELECT round(avg(d), 6) AS mean_degree, round(avg((d = 0)::INT), 6) AS isolated_ratio, any_value(a[round_even(0.5 * (n - 1), 0)::INT + 1]) AS chars_median,
    any_value(a[round_even(0.9 * (n - 1), 0)::INT + 1]) AS chars_p90, max(chars) AS chars_max, round(avg(chars), 6) AS chars_mean FROM d, l""")
def graph_profile(spark: SparkSession, sf: str) -> DataFrame:
    from tessera.operators.evalstats import nearest_rank

    n = C.nodes(spark, sf)
    d = n.join(G.degrees(n, C.edges(spark, sf)), "node_id").withColumn("d", F.col("in_degree") + F.col("out_degree")).withColumn("chars", F.length("content"))
    base = d.agg(
        F.round(F.avg("d"), 6).alias("mean_degree"),
        F.round(F.avg((F.col("d") == 0).cast("int")), 6).alias("isolated_ratio"),
        F.max("chars").alias("chars_max"),
        F.round(F.avg("chars"), 6).alias("chars_mean"),
    )
    ranks = nearest_rank(d.filter("chars IS NOT NULL").select(F.lit(0).alias("g"), F.col("chars").alias("x")), ["g"], "x", {"chars_median": 0.5, "chars_p90": 0.9}).drop("g")
    return base.join(F.broadcast(ranks))
