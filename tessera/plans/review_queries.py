"""Review, context, log and quota queries over the provided tables, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import graph as G
from tessera.operators import review as R
from tessera.operators.vectors import knn
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


COS = "coalesce(list_cosine_similarity(q.v, n.v), 0)"


@query(BASE_SQL + f", k AS (SELECT q.ord AS query_id, n.node_id AS id, n.ord, n.deprecated OR n.forgotten AS off, round({COS}, 9) AS s, row_number() OVER (PARTITION BY q.ord ORDER BY round(pow(list_distance(q.v, n.v), 2), 9), n.ord) AS p FROM nodes q JOIN nodes n ON n.ord <> q.ord WHERE q.ord % 50 = 0), f AS (SELECT * FROM k WHERE p <= 3 AND NOT off AND s > 0.3) SELECT query_id, arg_max(id, (s, -ord)) AS duplicate_of, round(max(s), 6) AS score FROM f GROUP BY query_id")
def find_duplicate(spark: SparkSession, sf: str) -> DataFrame:
    v, n = C.vectors(spark, sf), C.nodes(spark, sf)
    q = v.filter("ord % 50 = 0").select(F.col("ord").alias("query_id"), F.col("embedding"), F.col("id").alias("own"))
    found = R.find_duplicates(q, n, v, 0.3)
    return found.select("query_id", "duplicate_of", F.round("score", 6).alias("score"))


_NEAREST = f""", nearest AS MATERIALIZED (
  SELECT * FROM (SELECT q.ord AS group_id, n.node_id, row_number() OVER (PARTITION BY q.ord ORDER BY round({COS}, 9) DESC, n.ord) AS place FROM nodes q, nodes n WHERE q.ord % 50 = 0)
  WHERE place <= 15)"""


def _nearest(spark: SparkSession, sf: str) -> DataFrame:
    """The fifteen nearest nodes of every node whose number is divisible by 50."""
    v = C.vectors(spark, sf)
    return knn(v.filter("ord % 50 = 0").select(F.col("ord").alias("query_id"), "embedding"), v, 15).select(F.col("query_id").alias("group_id"), F.col("id").alias("node_id"))


@query(BASE_SQL + _NEAREST + """
SELECT a.group_id, e.src, e.dst, e.rel_type FROM edges e JOIN nearest a ON a.node_id = e.src JOIN nearest b ON b.node_id = e.dst AND b.group_id = a.group_id
""")
def context_edges(spark: SparkSession, sf: str) -> DataFrame:
    return R.context_edges(_nearest(spark, sf), C.edges(spark, sf))


@query(BASE_SQL + _NEAREST + """
, around AS (
  SELECT group_id, dst AS node_id FROM edges e JOIN nearest k ON k.node_id = e.src UNION SELECT group_id, src FROM edges e JOIN nearest k ON k.node_id = e.dst),
p AS (SELECT a.*, row_number() OVER (PARTITION BY group_id ORDER BY node_id) AS place FROM around a WHERE NOT EXISTS (SELECT 1 FROM nearest k WHERE k.group_id = a.group_id AND k.node_id = a.node_id))
SELECT group_id, node_id, place::INT AS place FROM p WHERE place <= 20
""")
def context_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return R.context_neighbours(_nearest(spark, sf), C.edges(spark, sf))


@query("SELECT event_type AS method, count(*) AS total, count(*) FILTER (value < 1) AS errors FROM events GROUP BY ROLLUP (event_type)")
def request_counters(spark: SparkSession, sf: str) -> DataFrame:
    return R.request_counters(table(spark, sf, "events").select(F.col("event_type").alias("method"), (F.col("value") < 1).alias("error")))


@query("WITH s AS (SELECT user_id AS space, max(ts) AS last_access, user_id % 7 = 0 AS busy FROM events GROUP BY user_id), k AS (SELECT *, row_number() OVER (ORDER BY busy DESC, last_access DESC, space) AS r FROM s) SELECT space, last_access FROM k WHERE r > 50 AND NOT busy")
def space_eviction(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "events").groupBy(F.col("user_id").alias("space")).agg(F.max("ts").alias("last_access"), F.first(F.col("user_id") % 7 == 0).alias("busy"))
    return R.eviction_order(s, 50)


@query("SELECT space, minutes, minutes > 30 AS over FROM (SELECT user_id AS space, round(count(DISTINCT event_id // 10) * 4.5::DOUBLE / 60, 6) AS minutes FROM events GROUP BY user_id)")
def backfill_estimate(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "events").select(F.col("user_id").alias("space"), F.floor(F.col("event_id") / 10).alias("group_id"))
    return R.backfill_estimate(g).withColumn("minutes", F.round("minutes", 6))


@query(BASE_SQL + "SELECT CASE WHEN starts_with(node_id, 'n31') OR starts_with(node_id, 'n32') THEN 'work' WHEN starts_with(node_id, 'n3') THEN 'home' ELSE 'noise' END AS domain, count(*) AS n FROM nodes GROUP BY 1")
def node_domains(spark: SparkSession, sf: str) -> DataFrame:
    d = R.domain_of(F.col("node_id"), {"n3": "home", "n31": "work", "n32": "work"})
    return C.nodes(spark, sf).groupBy(d.alias("domain")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, len(regexp_extract_all(text, '(?i)\\b(because|so|therefore)\\b|因为|所以|因此|导致'))::INT AS n FROM documents")
def causal_word_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", R.causal_words(F.col("text")).cast("int").alias("n"))


@query("""WITH h AS (SELECT user_id AS query_id, event_id % 7 AS gold_rank, CASE WHEN event_id % 3 <> 0 THEN event_id END AS rank, 'e' || event_id AS node_id, event_id FROM events), f AS (SELECT query_id, gold_rank, arg_min(node_id, rank) AS node_id, min(rank) AS rank FROM h GROUP BY 1, 2),
  a AS (SELECT 'e' || event_id AS node_id, day(ts) AS anchor_rank FROM events WHERE event_id % 2 = 0), p AS (SELECT f.*, a.anchor_rank FROM f LEFT JOIN a USING (node_id)), b AS (SELECT query_id, round(avg((rank IS NOT NULL)::INT), 6) AS recall, round(avg((anchor_rank IS NOT NULL)::INT) FILTER (rank IS NOT NULL), 6) AS anchored FROM p GROUP BY query_id),
  o AS (SELECT x.query_id, round(avg((x.anchor_rank < y.anchor_rank)::INT), 6) AS order_accuracy FROM p x JOIN p y ON x.query_id = y.query_id AND x.gold_rank < y.gold_rank AND x.anchor_rank <> y.anchor_rank WHERE x.rank IS NOT NULL AND y.rank IS NOT NULL GROUP BY x.query_id) SELECT b.*, o.order_accuracy FROM b LEFT JOIN o USING (query_id)""")
def timeline_eval(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("node_id", F.concat(F.lit("e"), "event_id"))
    hits = e.select(F.col("user_id").alias("query_id"), (F.col("event_id") % 7).alias("gold_rank"), F.when(F.col("event_id") % 3 != 0, F.col("event_id")).alias("rank"), "node_id")
    anchors = e.filter("event_id % 2 = 0").select("node_id", F.dayofmonth("ts").alias("anchor_rank"))
    out = R.timeline(hits, anchors)
    return out.select("query_id", *[F.round(c, 6).alias(c) for c in ("recall", "anchored", "order_accuracy")])


@query("""WITH i AS (SELECT user_id AS query_id, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place, value AS score FROM events), s AS (SELECT user_id AS query_id, event_id AS id, value % 10 AS r FROM events WHERE event_id % 4 <> 0)
  SELECT query_id, id, score, (row_number() OVER (PARTITION BY query_id ORDER BY s.r DESC NULLS LAST, i.place))::INT AS place FROM i LEFT JOIN s USING (query_id, id)""")
def rerank_items(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumnsRenamed({"user_id": "query_id", "event_id": "id"})
    items = e.select("query_id", "id", F.row_number().over(Window.partitionBy("query_id").orderBy("id")).alias("place"), F.col("value").alias("score"))
    return R.rerank(items, e.filter("id % 4 <> 0").select("query_id", "id", (F.col("value") % 10).alias("score"))).select("query_id", "id", "score", "place")


@query("""WITH b AS (SELECT user_id AS group_id, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM events WHERE event_type = 'view'), x AS (SELECT user_id AS group_id, event_id AS id, event_id % 5 AS message, event_id AS place FROM events),
  k AS (SELECT * FROM b WHERE place <= 15), n AS (SELECT group_id, id, min((message, place)) AS f FROM x WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.group_id = x.group_id AND k.id = x.id) GROUP BY group_id, id), r AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY f, id) AS p FROM n)
  SELECT group_id, id, place::BIGINT AS place FROM k UNION ALL SELECT group_id, id, 15 + p FROM r WHERE p <= 15""")
def widen_recall(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumnsRenamed({"user_id": "group_id", "event_id": "id"})
    base = e.filter("event_type = 'view'").withColumn("place", F.row_number().over(Window.partitionBy("group_id").orderBy("id")))
    extra = e.select("group_id", "id", (F.col("id") % 5).alias("message"), F.col("id").alias("place"))
    return R.widen(base, extra).withColumn("place", F.col("place").cast("long"))


@query()
def embed_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Every document embedded by the pluggable model, here the hashed bag of words."""
    from tessera.functions.models import embedder

    return table(spark, sf, "documents").select("doc_id", embedder()(F.col("text")).alias("embedding"))


_OPTIONS = r"""
WITH asked AS (
  SELECT doc_id, text || CASE doc_id % 3 WHEN 0 THEN chr(10) || 'A. ' || coalesce(lang, '') || ' B. ' || coalesce(source, '') || ' C. neither' WHEN 1 THEN ' (A) ' || coalesce(lang, '') || ' (B) none' ELSE '' END AS q FROM documents WHERE text IS NOT NULL),
m AS (SELECT *, string_split_regex(q, '(?:^|[\s（(])[A-H][.、．)）]\s') AS p, regexp_extract_all(q, '(?:^|[\s（(])[A-H][.、．)）]\s') AS marks,
        array_to_string(regexp_extract_all(q, '(?:^|[\s（(])([A-H])[.、．)）]\s', 1), '') AS labels FROM asked),
k AS (SELECT *, length(regexp_extract(labels, '^(.*)A.*B.*C', 1)) AS k FROM m),
c AS (SELECT *, CASE WHEN regexp_matches(labels, 'A.*B.*C') THEN length(array_to_string(p[1:k + 1], '')) + length(array_to_string(marks[1:k], '')) + strpos(marks[k + 1], 'A') - 1 ELSE length(q) END AS cut FROM k)
SELECT doc_id, regexp_replace(substr(q, 1, cut), '^\s+|\s+$', '', 'g') AS question, length(labels) AS n_marks FROM c
"""


@query(_OPTIONS)
def strip_option_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Every text as a question: a third has a block of options behind it, a third two options, which are no block."""
    from tessera.operators.documents import OPTION, without_options

    k, none = F.col("doc_id") % 3, F.lit("")
    lang, source = F.coalesce("lang", none), F.coalesce("source", none)
    block = F.when(k == 0, F.concat(F.lit("\nA. "), lang, F.lit(" B. "), source, F.lit(" C. neither"))).when(k == 1, F.concat(F.lit(" (A) "), lang, F.lit(" (B) none"))).otherwise("")
    asked = table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", F.concat("text", block).alias("q"))
    return asked.select("doc_id", without_options(F.col("q")).alias("question"), F.regexp_count("q", F.lit(OPTION)).cast("long").alias("n_marks"))


@query(BASE_SQL + """, t AS (SELECT scene AS tau_scene, v FROM nodes), r AS (SELECT e.rel_type, round(list_cosine_similarity(a.v, b.v), 6) AS s FROM edges e JOIN nodes a ON a.node_id = e.src JOIN nodes b ON b.node_id = e.dst), q AS (SELECT rel_type, list_sort(list(s)) AS a, count(*) AS n FROM r GROUP BY rel_type)
  SELECT rel_type, n, a[1] AS lowest, a[round_even(0.25 * (n - 1), 0)::INT + 1] AS q25, a[round_even(0.5 * (n - 1), 0)::INT + 1] AS q50, a[round_even(0.75 * (n - 1), 0)::INT + 1] AS q75, a[n::INT] AS highest FROM q""")
def cosine_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    from tessera.functions.vectors import cosine
    from tessera.operators.evalstats import nearest_rank

    v = C.vectors(spark, sf)
    e = C.edges(spark, sf).join(v.select(F.col("id").alias("src"), F.col("embedding").alias("a")), "src").join(v.select(F.col("id").alias("dst"), F.col("embedding").alias("b")), "dst")
    s = e.select("rel_type", F.round(cosine(F.col("a"), F.col("b")), 6).alias("s"))
    return s.groupBy("rel_type").agg(F.count(F.lit(1)).alias("n")).join(nearest_rank(s, ["rel_type"], "s", {"lowest": 0.0, "q25": 0.25, "q50": 0.5, "q75": 0.75, "highest": 1.0}), "rel_type")
