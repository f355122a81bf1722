"""Evaluation statistics and maintenance over the provided tables, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import evalstats as E
from tessera.operators import graph as G
from tessera.operators import maintenance as M
from tessera.operators import paths
from tessera.schema import DIRECTIONAL, MUTUAL
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


quoted = lambda names: ", ".join(f"'{x}'" for x in names)
#: Ratings: suppliers as units, return flags as judges, mean quantity as the score.
RATINGS = """WITH r0 AS (SELECT l_suppkey AS unit, l_returnflag AS judge, floor(avg(l_quantity::DOUBLE))::BIGINT AS score, avg(l_quantity::DOUBLE) AS raw FROM lineitem GROUP BY 1, 2),
  ratings AS (SELECT * FROM r0 WHERE unit IN (SELECT unit FROM r0 GROUP BY unit HAVING count(*) = 3))"""


def ratings(spark: SparkSession, sf: str) -> DataFrame:
    q = F.avg(F.col("l_quantity").cast("double"))
    r = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("unit"), F.col("l_returnflag").alias("judge")).agg(F.floor(q).alias("score"), q.alias("raw"))
    full = r.groupBy("unit").count().filter("count = 3").select("unit")
    return r.join(full, "unit", "left_semi")


@query(RATINGS + """, m AS (SELECT *, avg(raw) OVER (PARTITION BY unit) AS u, avg(raw) OVER (PARTITION BY judge) AS j, avg(raw) OVER () AS g FROM ratings),
  s AS (SELECT count(DISTINCT unit) AS n, count(DISTINCT judge) AS k, sum((u - g) ** 2) AS su, sum((j - g) ** 2) AS sj, sum((raw - u - j + g) ** 2) AS se FROM m),
  t AS (SELECT n, su / (n - 1) AS msr, sj / (k - 1) AS msc, se / ((n - 1) * (k - 1)) AS mse FROM s) SELECT round((msr - mse) / (msr + (msc - mse) / n), 6) AS icc2k, round(msr / mse, 6) AS f FROM t""")
def icc2k(spark: SparkSession, sf: str) -> DataFrame:
    return E.icc2k(ratings(spark, sf).select("unit", "judge", F.col("raw").alias("score"))).select(F.round("icc2k", 6).alias("icc2k"), F.round("f", 6).alias("f"))


@query(RATINGS + """, v AS (SELECT unit, score, count(*) AS c FROM ratings GROUP BY unit, score), m AS (SELECT *, sum(c) OVER (PARTITION BY unit) AS m FROM v), t AS (SELECT score, sum(c) AS n FROM m GROUP BY score),
  k AS (SELECT *, sum(n) OVER (ORDER BY score) AS cum FROM t), d AS (SELECT a.score AS x, b.score AS y, a.n AS nx, b.n AS ny, (b.cum - a.cum + a.n - (a.n + b.n) / 2.0::DOUBLE) ** 2 AS d FROM k a JOIN k b ON a.score < b.score),
  o AS (SELECT coalesce(sum(p.c * q.c / (p.m - 1) * d.d), 0) AS o FROM m p JOIN m q ON p.unit = q.unit AND p.score < q.score JOIN d ON d.x = p.score AND d.y = q.score), e AS (SELECT sum(nx * ny * d) AS e FROM d)
  SELECT round(1.0::DOUBLE - ((SELECT sum(n) FROM t) - 1) * o.o / e.e, 6) AS alpha FROM o, e""")
def kripp_alpha(spark: SparkSession, sf: str) -> DataFrame:
    return E.krippendorff_ordinal(ratings(spark, sf).select("unit", "score")).select(F.round("alpha", 6).alias("alpha"))


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    r = ratings(spark, sf)
    return r.groupBy("unit").agg(F.max(F.when(F.col("judge") == "A", F.col("raw"))).alias("a"), F.max(F.when(F.col("judge") == "N", F.col("raw"))).alias("b"))


PAIRS = RATINGS + ", pairs AS (SELECT unit, max(raw) FILTER (judge = 'A') AS a, max(raw) FILTER (judge = 'N') AS b FROM ratings GROUP BY unit)"


@query(PAIRS + """, d AS (SELECT a - b AS d FROM pairs), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0::DOUBLE AS r FROM d WHERE d <> 0)
  SELECT round(avg(d), 6) AS mean_diff, count(*) FILTER (d > 0) AS wins, count(*) FILTER (d = 0) AS ties, count(*) FILTER (d < 0) AS losses, round(avg(d) / stddev_samp(d), 6) AS dz,
    round((SELECT sum(CASE WHEN d > 0 THEN r ELSE -r END) / sum(r) FROM r), 6) AS rank_biserial FROM d""")
def rank_biserial(spark: SparkSession, sf: str) -> DataFrame:
    p = E.paired(_pairs(spark, sf))
    return p.select(F.round("mean_diff", 6).alias("mean_diff"), "wins", "ties", "losses", F.round("dz", 6).alias("dz"), F.round("rank_biserial", 6).alias("rank_biserial"))


@query(PAIRS + """, r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0::DOUBLE AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0::DOUBLE AS rb FROM pairs) SELECT round(corr(ra, rb), 6) AS rho FROM r""")
def spearman(spark: SparkSession, sf: str) -> DataFrame:
    return E.spearman(_pairs(spark, sf)).select(F.round("rho", 6).alias("rho"))


@query(RATINGS + """, l AS (SELECT unit, max(score) FILTER (judge = 'A') AS a, max(score) FILTER (judge = 'N') AS b FROM ratings GROUP BY unit), n AS (SELECT count(*)::DOUBLE AS n FROM l),
  e AS (SELECT sum((SELECT count(*) FROM l WHERE a = x) * (SELECT count(*) FROM l WHERE b = x)) / any_value(n * n) AS e FROM (SELECT DISTINCT a AS x FROM l), n), g AS (SELECT avg((a = b)::INT) AS agreement FROM l)
  SELECT round(agreement, 6) AS agreement, round((agreement - e) / (1 - e), 6) AS kappa FROM g, e""")
def cohen_kappa(spark: SparkSession, sf: str) -> DataFrame:
    r = ratings(spark, sf)
    labels = r.groupBy("unit").agg(F.max(F.when(F.col("judge") == "A", F.col("score"))).alias("a"), F.max(F.when(F.col("judge") == "N", F.col("score"))).alias("b"))
    return E.kappa(labels).select(F.round("agreement", 6).alias("agreement"), F.round("kappa", 6).alias("kappa"))


@query(RATINGS + """, t AS (SELECT unit, max(raw) AS top FROM ratings GROUP BY unit), w AS (SELECT r.unit, min(judge) AS j, count(*) AS c FROM ratings r JOIN t ON t.unit = r.unit AND r.raw = t.top GROUP BY r.unit)
  SELECT CASE WHEN c > 1 THEN 'TIE' ELSE j END AS top, count(*) AS n FROM w GROUP BY 1""")
def top_labels(spark: SparkSession, sf: str) -> DataFrame:
    r = ratings(spark, sf)
    best = r.groupBy("unit").agg(F.max("raw").alias("top"))
    won = r.join(best, "unit").filter("raw = top").groupBy("unit").agg(F.min("judge").alias("j"), F.count(F.lit(1)).alias("c"))
    return won.groupBy(F.when(F.col("c") > 1, "TIE").otherwise(F.col("j")).alias("top")).agg(F.count(F.lit(1)).alias("n"))


#: Scores of edges: cosine of the ends; positive where it is an attribute edge.
SCORES = BASE_SQL + ", scores AS (SELECT round(coalesce(list_cosine_similarity(a.v, b.v), 0), 6) AS score, e.rel_type <> 'sequence' AS positive FROM edges e JOIN nodes a ON a.node_id = e.src JOIN nodes b ON b.node_id = e.dst)"


def scores(spark: SparkSession, sf: str) -> DataFrame:
    from tessera.functions.vectors import cosine

    v = C.vectors(spark, sf)
    e = C.edges(spark, sf).join(v.select(F.col("id").alias("src"), F.col("embedding").alias("a")), "src").join(v.select(F.col("id").alias("dst"), F.col("embedding").alias("b")), "dst")
    return e.select(F.round(cosine(F.col("a"), F.col("b")), 6).alias("score"), (F.col("rel_type") != "sequence").alias("positive"), "src", "dst")


@query(SCORES + ", p AS (SELECT score FROM scores WHERE positive), q AS (SELECT score FROM scores WHERE NOT positive) SELECT round(avg(CASE WHEN p.score > q.score THEN 1.0::DOUBLE WHEN p.score = q.score THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END), 6) AS auc, (SELECT count(*) FROM p) AS positives, (SELECT count(*) FROM q) AS negatives FROM p, q")
def auc_within_across(spark: SparkSession, sf: str) -> DataFrame:
    a = E.auc(scores(spark, sf).withColumn("g", F.lit(0)), ["g"])
    return a.select(F.round("auc", 6).alias("auc"), "positives", "negatives")


@query(SCORES + """, c AS (SELECT score, count(*) FILTER (positive) AS p, count(*) FILTER (NOT positive) AS q FROM scores GROUP BY score), u AS (SELECT score, sum(p) OVER (ORDER BY score DESC)::DOUBLE / sum(p) OVER () AS tpr, sum(q) OVER (ORDER BY score DESC)::DOUBLE / sum(q) OVER () AS fpr FROM c),
  s AS (SELECT fpr, tpr, coalesce(lag(fpr) OVER (ORDER BY fpr, tpr), 0) AS f0, coalesce(lag(tpr) OVER (ORDER BY fpr, tpr), 0) AS t0 FROM u), i AS (SELECT *, CASE WHEN fpr > f0 THEN (least(fpr, 0.1::DOUBLE) - f0) / (fpr - f0) ELSE 1 END AS share FROM s WHERE f0 < 0.1::DOUBLE)
  SELECT round(sum((least(fpr, 0.1::DOUBLE) - f0) * (t0 + share * (tpr - t0) + t0) / 2), 6) AS pauc, round(max(t0 + share * (tpr - t0)), 6) AS tpr_at FROM i""")
def pauc_tpr(spark: SparkSession, sf: str) -> DataFrame:
    return E.partial_auc(E.roc(scores(spark, sf))).select(F.round("pauc", 6).alias("pauc"), F.round("tpr_at", 6).alias("tpr_at"))


@query(SCORES + """, t AS (SELECT unnest([0.5, 0.75, 0.9, 0.95, 0.99])::DOUBLE AS q), a AS (SELECT list_sort(list(score)) AS a, count(*) AS n FROM scores WHERE NOT positive), u AS (SELECT q, a[round_even(q * (n - 1), 0)::INT + 1] AS tau FROM t, a)
  SELECT q, tau, round(avg((score >= tau)::INT) FILTER (positive), 6) AS keep_within, round(avg((score >= tau)::INT) FILTER (NOT positive), 6) AS keep_across,
    round(avg((score >= tau)::INT) FILTER (NOT positive) / nullif(avg((score >= tau)::INT) FILTER (positive) + avg((score >= tau)::INT) FILTER (NOT positive), 0), 6) AS mix,
    round(1 - avg((score >= tau)::INT) FILTER (NOT positive), 6) AS blocked FROM u, scores GROUP BY q, tau""")
def quantile_curve(spark: SparkSession, sf: str) -> DataFrame:
    s = scores(spark, sf)
    wanted = {f"q{i}": q for i, q in enumerate((0.5, 0.75, 0.9, 0.95, 0.99))}
    taus = E.nearest_rank(s.filter("NOT positive").withColumn("g", F.lit(0)), ["g"], "score", wanted)
    over = lambda n: (F.col("score") >= F.col(n)).cast("int")
    kept = lambda n, own: F.avg(F.when(own, over(n)))

    def row(n: str, q: float) -> Column:
        within, across = kept(n, F.col("positive")), kept(n, ~F.col("positive"))
        parts = {"keep_within": within, "keep_across": across, "mix": F.try_divide(across, within + across), "blocked": 1 - across}
        return F.struct(F.lit(q).alias("q"), F.max(n).alias("tau"), *[F.round(c, 6).alias(k) for k, c in parts.items()])

    rows = [row(n, q) for n, q in wanted.items()]
    return s.join(F.broadcast(taus)).agg(F.array(*rows).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")  # taus is one row


@query(SCORES + """, t AS (SELECT (range / 100.0)::DOUBLE AS tau FROM range(20, 91)) SELECT tau, round(avg((score >= tau)::INT) FILTER (positive) - avg((score >= tau)::INT) FILTER (NOT positive), 6) AS margin FROM t, scores GROUP BY tau""")
def tau_margin(spark: SparkSession, sf: str) -> DataFrame:
    """The sweep counts each distinct score once and sums from above, so the grid never multiplies the scores."""
    s = scores(spark, sf)
    step = F.floor(F.round(F.col("score") * 100, 6)).cast("int")
    binned = s.groupBy(F.greatest(F.lit(19), F.least(F.lit(90), step)).alias("b")).agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("q"))
    grid = s.sparkSession.range(19, 91).select(F.col("id").cast("int").alias("b"))
    w, whole = Window.orderBy(F.desc("b")), Window.partitionBy()
    filled = F.broadcast(grid).join(binned, "b", "left")
    share = lambda c: F.sum(F.coalesce(c, F.lit(0))).over(w) / F.sum(F.coalesce(c, F.lit(0))).over(whole)
    return filled.select("b", F.round(share("p") - share("q"), 6).alias("margin")).filter("b >= 20").select((F.col("b") / 100.0).alias("tau"), "margin")


@query(SCORES + """, t AS (SELECT (range / 100.0)::DOUBLE AS tau FROM range(20, 91)),
  m AS (SELECT tau, round(avg((score >= tau)::INT) FILTER (positive) - avg((score >= tau)::INT) FILTER (NOT positive), 6) AS margin FROM t, scores GROUP BY tau),
  b AS (SELECT tau AS best_tau, margin AS best_margin FROM m ORDER BY margin DESC, tau LIMIT 1)
  SELECT best_tau, best_margin, round(best_margin - min(margin), 6) AS plateau_drop FROM b, m WHERE abs(tau - best_tau) <= 0.0501 GROUP BY best_tau, best_margin""")
def tau_best(spark: SparkSession, sf: str) -> DataFrame:
    """The threshold of the largest margin, the lowest on ties, and how far margins fall within 0.05 of it; over 71 thresholds."""
    return E.best_threshold(tau_margin(spark, sf))


@query(BASE_SQL + """, s AS (SELECT src, list(DISTINCT dst) AS a FROM edges GROUP BY src), m AS (SELECT x.node_id AS a, y.node_id AS b FROM members x JOIN members y ON x.scene = y.scene AND y.pos = x.pos + 1)
  SELECT m.a, m.b, round(CASE WHEN len(list_distinct(list_concat(coalesce(x.a, []), coalesce(y.a, [])))) = 0 THEN 0 ELSE len(list_intersect(coalesce(x.a, []), coalesce(y.a, []))) / len(list_distinct(list_concat(coalesce(x.a, []), coalesce(y.a, []))))::DOUBLE END, 6) AS jaccard FROM m LEFT JOIN s x ON x.src = m.a LEFT JOIN s y ON y.src = m.b""")
def jaccard_pairs(spark: SparkSession, sf: str) -> DataFrame:
    m = C.scene_members(spark, sf)
    sets = C.edges(spark, sf).groupBy("src").agg(F.collect_set("dst").alias("s"))
    pairs = m.select("scene", "pos", F.col("node_id").alias("a")).join(m.select("scene", (F.col("pos") - 1).alias("pos"), F.col("node_id").alias("b")), ["scene", "pos"])
    side = lambda c: sets.select(F.col("src").alias(c), F.col("s").alias(f"s{c}"))
    none = F.array().cast("array<string>")
    both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return both.select("a", "b", F.round(E.jaccard(F.coalesce("sa", none), F.coalesce("sb", none)), 6).alias("jaccard"))


@query(BASE_SQL + """, c AS (SELECT scene % 3 AS arm, node_type AS kind, count(*) AS n FROM nodes GROUP BY 1, 2), p AS (SELECT *, n / sum(n) OVER (PARTITION BY arm)::DOUBLE AS p FROM c), k AS (SELECT DISTINCT kind FROM c), g AS (SELECT DISTINCT arm FROM c)
  SELECT x.arm AS a, y.arm AS b, round(sum(abs(coalesce(u.p, 0) - coalesce(v.p, 0))) / 2, 6) AS tvd FROM g x JOIN g y ON x.arm < y.arm CROSS JOIN k LEFT JOIN p u ON u.arm = x.arm AND u.kind = k.kind LEFT JOIN p v ON v.arm = y.arm AND v.kind = k.kind GROUP BY 1, 2""")
def tvd_types(spark: SparkSession, sf: str) -> DataFrame:
    counts = C.nodes(spark, sf).groupBy((F.col("scene") % 3).alias("arm"), F.col("node_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return E.total_variation(counts).select("a", "b", F.round("tvd", 6).alias("tvd"))


@query(BASE_SQL + """, g AS (SELECT src AS query_id, dst AS id FROM edges WHERE rel_type = 'attribute'), f AS (SELECT src AS query_id, dst AS id FROM edges WHERE dst_ord % 3 <> 0)
  SELECT g.query_id, count(*) AS gold, count(f.id) AS found, round(count(f.id) / count(*)::DOUBLE, 6) AS recall FROM g LEFT JOIN f USING (query_id, id) GROUP BY g.query_id""")
def recall_at_all(spark: SparkSession, sf: str) -> DataFrame:
    e = C.edges(spark, sf)
    gold = e.filter("rel_type = 'attribute'").select(F.col("src").alias("query_id"), F.col("dst").alias("id"))
    found = e.filter("dst_ord % 3 <> 0").select(F.col("src").alias("query_id"), F.col("dst").alias("id"), F.lit(1).alias("hit"))
    counted = gold.join(found, ["query_id", "id"], "left").groupBy("query_id").agg(F.count(F.lit(1)).alias("gold"), F.count("hit").alias("found"))
    return counted.withColumn("recall", F.round(F.col("found") / F.col("gold"), 6))


@query(BASE_SQL + f""", n AS (SELECT count(*) AS n FROM edges WHERE rel_type IN ({quoted(DIRECTIONAL)})), r AS (SELECT *, row_number() OVER (ORDER BY md5(src || '|' || dst), src, dst) AS k FROM edges)
  SELECT arm, rel_type, count(*) AS n FROM (SELECT 'base' AS arm, rel_type FROM edges UNION ALL SELECT 'directional', rel_type FROM edges WHERE rel_type IN ({quoted(DIRECTIONAL)})
    UNION ALL SELECT 'mutual', rel_type FROM edges WHERE rel_type IN ({quoted(MUTUAL)}) UNION ALL SELECT 'random', rel_type FROM r, n WHERE k <= n.n) GROUP BY arm, rel_type""")
def edge_type_ablation(spark: SparkSession, sf: str) -> DataFrame:
    """Arms of the ablation; the random control takes as many edges as the directional arm, by a hash."""
    e = C.edges(spark, sf)
    one = e.filter(F.col("rel_type").isin(DIRECTIONAL))
    control = E.smallest(e.withColumn("h", F.md5(F.concat_ws("|", "src", "dst"))), "h", one.count())
    arms = {"base": e, "directional": one, "mutual": e.filter(F.col("rel_type").isin(MUTUAL)), "random": control}
    parts = [df.select(F.lit(a).alias("arm"), "rel_type") for a, df in arms.items()]
    whole = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    return whole.groupBy("arm", "rel_type").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH a AS (SELECT user_id || '→' || (event_id % 20) || '@' || event_type AS path_key, event_id % 5 AS session_id FROM events), c AS (SELECT path_key, count(*) AS life, count(*) FILTER (session_id = 0) AS ses FROM a GROUP BY path_key)
  SELECT path_key, life AS lifetime, ses AS session, round(least(2.0::DOUBLE, 1 + 0.05::DOUBLE * life) * greatest(0.3::DOUBLE, 1 - 0.15::DOUBLE * ses), 6) AS multiplier FROM c""")
def path_multiplier(spark: SparkSession, sf: str) -> DataFrame:
    log = table(spark, sf, "events").select(paths.path_key(F.col("user_id").cast("string"), (F.col("event_id") % 20).cast("string"), F.col("event_type")).alias("path_key"), (F.col("event_id") % 5).alias("session_id"))
    c = paths.counters(log, F.lit(0))
    return c.select("path_key", "lifetime", "session", F.round(paths.multiplier(F.col("lifetime"), F.col("session")), 6).alias("multiplier"))


@query("""WITH a AS (SELECT user_id || '→' || (event_id % 20) || '@' || event_type AS path_key, event_id % 5 AS session_id FROM events), c AS (SELECT path_key, count(*) AS life, count(*) FILTER (session_id = 0) AS ses FROM a GROUP BY path_key)
  SELECT count(*) AS paths, sum(life)::BIGINT AS activations, max(life) AS most, count(*) FILTER (abs(least(2.0::DOUBLE, 1 + 0.05::DOUBLE * life) - 2) <= 0.01::DOUBLE) AS at_cap,
    count(*) FILTER (ses > 0 AND abs(greatest(0.3::DOUBLE, 1 - 0.15::DOUBLE * ses) - 0.3::DOUBLE) <= 0.01::DOUBLE) AS at_floor, round(avg(life), 6) AS mean_lifetime FROM c""")
def path_summary(spark: SparkSession, sf: str) -> DataFrame:
    log = table(spark, sf, "events").select(paths.path_key(F.col("user_id").cast("string"), (F.col("event_id") % 20).cast("string"), F.col("event_type")).alias("path_key"), (F.col("event_id") % 5).alias("session_id"))
    return paths.summary(paths.counters(log, F.lit(0)))


@query(BASE_SQL + """, m AS (SELECT avg((score)) AS x FROM (SELECT 1 AS score)), s AS (SELECT ord, row_number() OVER (ORDER BY ord) AS k FROM active) SELECT 'n' || ((SELECT max(ord) FROM nodes) + k) AS node_id, ord AS source FROM s""")
def next_node_ids(spark: SparkSession, sf: str) -> DataFrame:
    n = C.nodes(spark, sf)
    new = G.active(n).select(F.col("ord").alias("source"))
    return M.next_ids(n.select("node_id"), new, "source").select("node_id", "source")


@query(BASE_SQL + """, g AS (SELECT node_id FROM nodes WHERE deprecated) SELECT src, dst, rel_type FROM edges WHERE src NOT IN (SELECT node_id FROM g) AND dst NOT IN (SELECT node_id FROM g)""")
def delete_cascade(spark: SparkSession, sf: str) -> DataFrame:
    n, e = C.nodes(spark, sf), C.edges(spark, sf)
    return M.delete_nodes(n, e, n.filter("deprecated"))[1].select("src", "dst", "rel_type")


@query(BASE_SQL + f""", g AS (SELECT src, dst FROM edges WHERE src_ord % 9 = 0), h AS (SELECT e.src, e.dst FROM edges e JOIN g USING (src, dst) UNION SELECT e.dst, e.src FROM edges e JOIN g USING (src, dst) WHERE rel_type IN ({quoted(MUTUAL)}))
  SELECT src, dst, rel_type FROM edges e WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.src = e.src AND h.dst = e.dst)""")
def delete_edges(spark: SparkSession, sf: str) -> DataFrame:
    e = C.edges(spark, sf)
    return M.delete_edges(e, e.filter("src_ord % 9 = 0").select("src", "dst")).select("src", "dst", "rel_type")


@query(BASE_SQL + """SELECT node_id, CASE WHEN ord % 4 = 0 THEN 'updated ' || ord ELSE content END AS content, CASE WHEN ord % 6 = 0 THEN 'thing' ELSE node_type END AS node_type, deprecated OR ord % 10 = 0 AS deprecated FROM nodes""")
def apply_node_ops(spark: SparkSession, sf: str) -> DataFrame:
    n = C.nodes(spark, sf)
    op = lambda cond, action, content, kind: n.filter(cond).select(F.col("node_id").alias("target_id"), F.lit(action).alias("action"), content.alias("content"), kind.alias("node_type"), F.col("ord"))
    none = F.lit(None).cast("string")
    ops = op("ord % 4 = 0", "update", F.concat(F.lit("updated "), "ord"), none).union(op("ord % 6 = 0", "fix_type", none, F.lit("THING"))).union(op("ord % 10 = 0", "deprecate", none, none))
    return M.apply_node_ops(n, ops).select("node_id", "content", "node_type", "deprecated")


@query(BASE_SQL + """, d AS (SELECT node_id, node_type, content, count(*) FILTER (true) OVER (PARTITION BY content) AS c FROM active WHERE content IS NOT NULL) SELECT node_id, arg_min(node_id, ord) OVER (PARTITION BY content) AS same_as FROM active WHERE content IS NOT NULL""")
def exact_content_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    from tessera.operators.review import exact_content

    a = G.active(C.nodes(spark, sf)).filter("content IS NOT NULL")
    found = exact_content(a.select(F.col("node_id").alias("query_id"), "content"), a)
    return found.select(F.col("query_id").alias("node_id"), F.col("duplicate_of").alias("same_as"))


@query("""WITH s AS (SELECT event_type AS g, value AS x FROM events WHERE value IS NOT NULL), a AS (SELECT g, list_sort(list(x)) AS a, count(*) AS n FROM s GROUP BY g)
  SELECT g AS event_type, a[round_even(0.5 * (n - 1), 0)::INT + 1] AS p50, a[round_even(0.95 * (n - 1), 0)::INT + 1] AS p95, a[round_even(0.99 * (n - 1), 0)::INT + 1] AS p99 FROM a""")
def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").filter("value IS NOT NULL")
    return E.nearest_rank(e, ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query(BASE_SQL + """, k AS (SELECT q.scene AS qs, n.scene AS ns, q.ord AS query_id, coalesce(list_cosine_similarity(q.v, n.v), 0) AS s, n.ord FROM nodes q, nodes n WHERE q.ord % 50 = 0 AND n.ord <> q.ord), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, ord) AS p FROM k)
  SELECT query_id, round(coalesce(avg((ns <> qs)::INT) FILTER (round(s, 9) >= 0.1), 0), 6) AS cross_share FROM r WHERE p <= 10 GROUP BY query_id""")
def cross_scene_share(spark: SparkSession, sf: str) -> DataFrame:
    from tessera.operators.vectors import knn

    v, n = C.vectors(spark, sf), C.nodes(spark, sf)
    q = v.filter("ord % 50 = 0").select(F.col("ord").alias("query_id"), "embedding")
    top = knn(q, v, 11).withColumnRenamed("id", "node_id").filter("ord <> query_id")
    w = Window.partitionBy("query_id").orderBy("place")
    near = top.withColumn("p", F.row_number().over(w)).filter("p <= 10").join(n.select("node_id", "scene"), "node_id")
    own = n.select(F.col("ord").alias("query_id"), F.col("scene").alias("own"))
    over = F.round("score", 9) >= 0.1
    return near.join(own, "query_id").groupBy("query_id").agg(F.round(F.coalesce(F.avg(F.when(over, (F.col("scene") != F.col("own")).cast("int"))), F.lit(0.0)), 6).alias("cross_share"))


@query("""WITH g AS (SELECT (range / 20.0)::DOUBLE AS tau FROM range(0, 21)), s AS (SELECT (value / (SELECT max(value) FROM events))::DOUBLE AS p, event_type = 'purchase' AS answerable FROM events)
  SELECT tau, round(avg((p >= tau)::INT) FILTER (answerable), 6) AS recall_a, round(avg((p < tau)::INT) FILTER (NOT answerable), 6) AS acc_h FROM g, s GROUP BY tau""")
def abstention_sweep(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    top = e.agg(F.max("value").alias("top"))
    s = e.join(F.broadcast(top)).select((F.col("value") / F.col("top")).alias("p"), (F.col("event_type") == "purchase").alias("a"))
    grid = [i / 20.0 for i in range(21)]
    sums = s.agg(*[x for i, t in enumerate(grid) for x in (F.avg(F.when(F.col("a"), (F.col("p") >= t).cast("int"))).alias(f"r{i}"), F.avg(F.when(~F.col("a"), (F.col("p") < t).cast("int"))).alias(f"h{i}"))])
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("tau"), F.round(F.col(f"r{i}"), 6).alias("recall_a"), F.round(F.col(f"h{i}"), 6).alias("acc_h")) for i, t in enumerate(grid)]))
    return sums.select(rows.alias("r")).select("r.*")


@query()
def auc_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """AUC of all edges with its intervals, resampled by nodes and by pairs."""
    pairs = scores(spark, sf).select(F.col("src").alias("a"), F.col("dst").alias("b"), "score", "positive")
    by = [E.auc_interval(pairs, nodes).select(F.lit(name).alias("resampled"), *[F.round(c, 6).alias(c) for c in ("auc", "low", "high")]) for name, nodes in (("nodes", True), ("pairs", False))]
    return by[0].unionByName(by[1])


@query()
def bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and 95 % interval of each judge from 10000 Poisson resamples; a hash gives each row its count in each resample."""
    return E.bootstrap(ratings(spark, sf).select("judge", F.col("unit").alias("id"), F.col("raw").alias("x")), ["judge"], "id", "x")
