"""Vector search and associative retrieval over the provided tables, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import graph as G
from tessera.operators import par as P
from tessera.operators import vectors as V
from tessera.plans.graph_queries import ADJ_SQL, JUMP_SQL
from tessera.sources import canonical as C
from tessera.schema import DIRECTIONAL, FRAME_CUES, FRAME_RELATIONS, FRAME_TYPES, jump_rows
from tessera.sources.canonical import BASE_SQL
from tessera.session import materialize

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


COS = "coalesce(list_cosine_similarity({a}, {b}), 0)"
#: Queries: every vector whose id is divisible by 50 is a text; the next vector of the table stands for its purpose.
ASKED_SQL = "asked AS (SELECT a.ord AS query_id, a.v AS tv, coalesce(b.v, a.v) AS pv FROM nodes a LEFT JOIN nodes b ON b.ord = a.ord + 1 WHERE a.ord % 50 = 0)"


def asked(spark: SparkSession, sf: str) -> DataFrame:
    v = C.vectors(spark, sf)
    after = v.select((F.col("ord") - 1).alias("ord"), F.col("embedding").alias("next"))
    return v.filter("ord % 50 = 0").join(after, "ord", "left").select(F.col("ord").alias("query_id"), F.col("embedding").alias("text_vec"), F.coalesce("next", "embedding").alias("purpose_vec"))


def _knn(spark: SparkSession, sf: str, k: int, metric: str) -> DataFrame:
    v = C.vectors(spark, sf)
    q = v.filter("ord % 50 = 0").select(F.col("ord").alias("query_id"), "embedding")
    return V.knn(q, v, k, metric)


@query(BASE_SQL + f", r AS (SELECT q.ord AS query_id, n.node_id AS id, {COS.format(a='q.v', b='n.v')} AS s, n.ord FROM nodes q, nodes n WHERE q.ord % 50 = 0), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, ord) AS place FROM r) SELECT query_id, id, round(s, 6) AS score, place::INT AS place FROM k WHERE place <= 10")
def knn_cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _knn(spark, sf, 10, "cosine").select("query_id", "id", F.round("score", 6).alias("score"), "place")


@query(BASE_SQL + ", r AS (SELECT q.ord AS query_id, n.node_id AS id, pow(list_distance(q.v, n.v), 2) AS s, n.ord FROM nodes q, nodes n WHERE q.ord % 50 = 0), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9), ord) AS place FROM r) SELECT query_id, id, round(s, 6) AS score, place::INT AS place FROM k WHERE place <= 10")
def knn_l2_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _knn(spark, sf, 10, "l2").select("query_id", "id", F.abs(F.round("score", 6)).alias("score"), "place")


@query(BASE_SQL + ", r AS (SELECT q.ord AS query_id, n.node_id AS id, n.deprecated OR n.forgotten AS off, " + COS.format(a="q.v", b="n.v") + " AS s, n.ord FROM nodes q, nodes n WHERE q.ord % 50 = 0), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, ord) AS p FROM r), f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY p) AS place FROM k WHERE p <= 25 AND NOT off) SELECT query_id, id, round(s, 6) AS score, place::INT AS place FROM f WHERE place <= 10")
def pure_vector_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Two stores searched on their own, merged by score; inactive nodes go after the cut."""
    v = C.vectors(spark, sf)
    q = v.filter("ord % 50 = 0").select(F.col("ord").alias("query_id"), "embedding")
    both = V.knn(q, v.filter("ord % 2 = 0"), 25).unionByName(V.knn(q, v.filter("ord % 2 = 1"), 25))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "ord")
    live = C.nodes(spark, sf).filter("NOT deprecated AND NOT forgotten").select(F.col("node_id").alias("id"))
    merged = both.withColumn("p", F.row_number().over(w)).filter("p <= 25").join(live, "id", "left_semi")
    return merged.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("p"))).filter("place <= 10").select("query_id", "id", F.round("score", 6).alias("score"), "place")


@query(BASE_SQL + ", m AS (SELECT * FROM active WHERE node_type <> 'thing' AND length(regexp_replace(content, '\\s', '', 'g')) >= 4), r AS (SELECT v, arg_min(node_id, ord) AS id, min(ord) AS ord FROM m GROUP BY v) SELECT a.id AS a, b.id AS b, round(" + COS.format(a="a.v", b="b.v") + ", 6) AS score FROM r a JOIN r b ON a.ord < b.ord WHERE round(" + COS.format(a="a.v", b="b.v") + ", 9) >= 0.4")
def duplicate_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return V.duplicate_pairs(C.nodes(spark, sf), C.vectors(spark, sf), 0.4).select("a", "b", F.round("score", 6).alias("score"))


@query(BASE_SQL + ", s AS (SELECT node_id AS id, CASE WHEN ord % 5 = 0 THEN 'old' ELSE content END AS content FROM nodes WHERE ord % 7 <> 0), d AS (SELECT node_id AS id, content FROM active), j AS (SELECT coalesce(d.id, s.id) AS id, CASE WHEN s.id IS NULL THEN 'added' WHEN d.id IS NULL THEN 'removed' WHEN s.content IS DISTINCT FROM d.content THEN 'updated' END AS change FROM d FULL JOIN s ON d.id = s.id) SELECT change, count(*) AS n FROM j WHERE change IS NOT NULL GROUP BY change")
def vector_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    n = C.nodes(spark, sf)
    stored = n.filter("ord % 7 <> 0").select(F.col("node_id").alias("id"), F.when(F.col("ord") % 5 == 0, F.lit("old")).otherwise(F.col("content")).alias("content"))
    desired = n.filter("NOT deprecated AND NOT forgotten").select(F.col("node_id").alias("id"), "content")
    return V.reconcile(desired, stored).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH st AS (SELECT DISTINCT user_id AS id FROM events WHERE user_id % 4 = 0), rm AS (SELECT user_id AS id, max(event_id) AS epoch FROM events WHERE event_type = 'error' GROUP BY user_id),
  em AS (SELECT doc_id AS id, doc_id * 3 AS epoch, n_chars FROM documents UNION ALL SELECT user_id, event_id, -event_id FROM events WHERE event_type = 'view')
  SELECT em.id, max(em.epoch) AS epoch, arg_max(n_chars, em.epoch) AS n_chars FROM em ANTI JOIN st ON st.id = em.id LEFT JOIN rm ON rm.id = em.id WHERE coalesce(rm.epoch, -1) <= em.epoch GROUP BY em.id""")
def vector_epochs(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings that come back: ids stored meanwhile, removed before, removed after and never removed."""
    from tessera.session import table

    e = table(spark, sf, "events")
    of = lambda kind: e.filter(F.col("event_type") == kind)
    embedded = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") * 3).alias("epoch"), "n_chars")
    embedded = embedded.unionByName(of("view").select(F.col("user_id").alias("id"), F.col("event_id").alias("epoch"), (-F.col("event_id")).alias("n_chars")))
    return V.accept_embedded(e.filter("user_id % 4 = 0").select(F.col("user_id").alias("id")).distinct(), of("error").select(F.col("user_id").alias("id"), F.col("event_id").alias("epoch")), embedded)


@query("WITH log AS (SELECT user_id AS id, event_id // 512 AS seq, event_id % 512 AS pos, event_type = 'logout' OR event_id % 11 = 0 AS deleted, value FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC, pos DESC) AS rn FROM log) SELECT id, value FROM k WHERE rn = 1 AND NOT deleted")
def vector_log_replay(spark: SparkSession, sf: str) -> DataFrame:
    from tessera.session import table

    log = table(spark, sf, "events").select(F.col("user_id").alias("id"), F.floor(F.col("event_id") / 512).alias("seq"), (F.col("event_id") % 512).alias("pos"), ((F.col("event_type") == "logout") | (F.col("event_id") % 11 == 0)).alias("deleted"), "value")
    return V.replay(log).select("id", "value")


def par_sql(hops: int = 5, k: int = 5, thr: float = 0.30, patience: int = 2, delta: float = 0.015, tol: float = 0.10, k_sigma: float | None = None, blind: bool = False, frame: str | None = None, uniform: bool = False, anchor: float = 0.0, floor: float | None = None, first_peak: bool = False, ratio: float = 0.0, thr_decay: float = 0.0, log: str | None = None) -> str:
    """The unrolled twin of P.retrieve: CTEs seeds, hop0.., mean0.., and `hops`, `means`, `banded`."""
    half = max(1, k // 2)
    slots = max(1, k - half)
    near = lambda vec: f"(SELECT query_id, node_id, ord, row_number() OVER (PARTITION BY query_id ORDER BY round({COS.format(a='q.' + vec, b='n.v')}, 9) DESC, ord) AS place, round({COS.format(a='q.' + vec, b='n.v')}, 9) AS cos FROM asked q, nodes n)"
    high = f" AND cos >= {floor}" if floor is not None else ""
    channels = f"SELECT query_id, node_id, 2 AS channel, place FROM tk WHERE place <= {k if blind else 2 * k}{high if blind else ''}"
    if not blind:
        channels += f" UNION ALL SELECT query_id, node_id, 0, place FROM tk WHERE place <= {half}{high} UNION ALL SELECT query_id, node_id, 1, place FROM pk WHERE place <= {slots}{'' if frame else high}"
    topic = f"round({COS.format(a='n.v', b='q.pv')}, 9)"
    if anchor:
        topic = f"round({1 - anchor!r}::DOUBLE * {topic} + {anchor!r}::DOUBLE * round({COS.format(a='n.v', b='q.tv')}, 9), 9)"
    if blind:  # the purpose channel is closed: no purpose score exists, and the jump part alone is combined
        topic = "0.0::DOUBLE"
    seed_score = score = topic
    if frame:
        case = lambda col, prefs: f"CASE {col} " + " ".join(f"WHEN '{x}' THEN {v / max(prefs.values())!r}::DOUBLE" for x, v in prefs.items()) + " ELSE 0::DOUBLE END"
        by_type, by_rel = f"(0.25::DOUBLE + 0.75::DOUBLE * {case('n.node_type', FRAME_TYPES[frame])})", f"(0.15::DOUBLE + 0.85::DOUBLE * {case('m.rel_type', FRAME_RELATIONS[frame])})"
        seed_score = f"round({topic} * (0.55::DOUBLE + 0.35::DOUBLE * {by_type}) / (0.55::DOUBLE + 0.35::DOUBLE), 9)"
        score = f"round({topic} * (0.55::DOUBLE + 0.35::DOUBLE * {by_type} + 0.10::DOUBLE * {by_rel}) / (0.55::DOUBLE + 0.35::DOUBLE + 0.10::DOUBLE), 9)"
        wide = f"(SELECT * FROM {near('pv')} WHERE place <= {4 * slots}{high})"
        framed = f"(SELECT query_id, w.node_id, w.ord, row_number() OVER (PARTITION BY query_id ORDER BY {seed_score} DESC, w.ord) AS place FROM {wide} w JOIN asked q USING (query_id) JOIN nodes n ON n.node_id = w.node_id)"
    out = [
        BASE_SQL, ADJ_SQL, JUMP_SQL, ASKED_SQL, f"tk AS {near('tv')}", f"pk AS {framed if frame else near('pv')}",
        "steps AS MATERIALIZED (SELECT a.*, j.weight FROM adj a JOIN nodes n USING (node_id) JOIN jump j ON j.node_type = n.node_type AND j.rel_type = a.rel_type AND j.is_reverse = a.is_reverse WHERE weight > 0)" if not uniform else "steps AS MATERIALIZED (SELECT a.*, 1.0::DOUBLE AS weight FROM adj a)",
        *([f"acts AS MATERIALIZED ({log})"] if log else []),
        f"ch AS ({channels})",
        f"sd AS MATERIALIZED (SELECT * FROM (SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY min((channel, place))) AS pos FROM ch JOIN active USING (node_id) GROUP BY query_id, node_id) WHERE pos <= {k})",
        f"hop0 AS MATERIALIZED (SELECT sd.query_id, 0 AS hop, sd.node_id, NULL::VARCHAR AS parent, NULL::VARCHAR AS rel_type, NULL::BOOLEAN AS is_reverse, NULL::DOUBLE AS weight, {seed_score} AS ps, {seed_score} * 0.5 AS combined, pos FROM sd JOIN nodes n USING (node_id) JOIN asked q USING (query_id))",
        "mean0 AS (SELECT query_id, 0 AS hop, avg(ps) AS mu FROM hop0 GROUP BY query_id)",
        "vis0 AS (SELECT query_id, node_id FROM hop0)",
        "st0 AS (SELECT query_id, NULL::DOUBLE AS peak, NULL::DOUBLE AS prev, false AS declining, 0 AS cnt, false AS found FROM asked)",
    ]
    for h in range(1, hops + 1):
        g = h - 1
        front = f"(SELECT query_id, node_id, pos FROM hop{g} WHERE pos <= {k} AND query_id IN (SELECT query_id FROM st{g} WHERE NOT found))"
        limit = "0.0" if blind else (f"avg(ps) OVER (PARTITION BY query_id) + {k_sigma} * stddev_pop(ps) OVER (PARTITION BY query_id)" if k_sigma is not None else f"{thr * thr_decay**h!r}" if thr_decay else f"{thr}")
        out += [
            f"met{h} AS MATERIALIZED (SELECT m.query_id, m.nbr AS node_id, weight, parent, rel_type, is_reverse FROM (SELECT f.query_id, s.nbr, s.weight, s.node_id AS parent, s.rel_type, s.is_reverse, row_number() OVER (PARTITION BY f.query_id, s.nbr ORDER BY s.weight DESC, f.pos, s.is_reverse, s.edge_ord) AS rn FROM {front} f JOIN steps s ON s.node_id = f.node_id) m WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM vis{g} v WHERE v.query_id = m.query_id AND v.node_id = m.nbr))",
            f"vis{h} AS (SELECT * FROM vis{g} UNION ALL SELECT query_id, node_id FROM met{h})",
            f"sc{h} AS (SELECT m.*, n.ord, {score} AS ps FROM met{h} m JOIN active n USING (node_id) JOIN asked q USING (query_id))",
            f"ft{h} AS (SELECT *, {limit} AS thr FROM sc{h})",
            f"hop{h} AS MATERIALIZED (SELECT query_id, {h} AS hop, node_id, parent, rel_type, is_reverse, weight, ps, weight * {0.85**h!r} * 0.5 + ps * 0.5 AS combined, row_number() OVER (PARTITION BY query_id ORDER BY round(weight * {0.85**h!r} * 0.5 + ps * 0.5, 9) DESC, ord) AS pos FROM ft{h} WHERE ps >= thr)",
            f"mean{h} AS (SELECT query_id, {h} AS hop, avg({'weight' if blind else 'ps'}) AS mu FROM hop{h} GROUP BY query_id)",
            f"""st{h} AS MATERIALIZED (SELECT * EXCLUDE (fell), (f0 OR {'fell' if first_peak else f'cnt >= {patience}'}) AS found FROM (SELECT s.query_id, coalesce(mu - prev < -{delta}, false) AS fell, CASE WHEN mu IS NULL THEN peak ELSE greatest(coalesce(peak, mu), mu) END AS peak, coalesce(mu, prev) AS prev,
              CASE WHEN mu IS NULL OR prev IS NULL THEN declining WHEN mu - prev > {delta} THEN false WHEN declining OR mu - prev < -{delta} THEN true ELSE false END AS declining,
              CASE WHEN mu IS NULL OR prev IS NULL THEN cnt WHEN mu - prev > {delta} THEN 0 WHEN declining THEN cnt + 1 ELSE cnt END AS cnt, found AS f0 FROM st{g} s LEFT JOIN mean{h} USING (query_id)))""",
        ]
        front = f"(SELECT query_id, node_id, pos FROM hop{g} WHERE pos <= {k} AND query_id IN (SELECT query_id FROM st{g} WHERE NOT found))"
        out.append(f"act{h} AS (SELECT f.query_id, {h} AS hop, s.node_id || '→' || s.nbr || '@' || s.rel_type AS path_key FROM {front} f JOIN steps s ON s.node_id = f.node_id JOIN met{h} m ON m.query_id = f.query_id AND m.node_id = s.nbr)")
    out.append("activated AS (" + " UNION ALL ".join(f"SELECT * FROM act{h}" for h in range(1, hops + 1)) + ")")
    every = lambda name: " UNION ALL ".join(f"SELECT * FROM {name}{h}" for h in range(hops + 1))
    out += [
        f"hops AS MATERIALIZED ({every('hop')})", f"means AS MATERIALIZED ({every('mean')})",
        "pk2 AS (SELECT query_id, max(mu) AS peak, min(mu) AS low, count(*) AS rounds FROM means WHERE hop > 0 GROUP BY query_id)",
        f"inband AS (SELECT query_id, hop FROM means JOIN pk2 USING (query_id) WHERE hop > 0 AND round(mu - peak + {f'{ratio!r} * (peak - low)' if ratio else tol}, 9) >= 0 UNION ALL SELECT query_id, hop FROM means WHERE hop = 0)",
        "banded AS MATERIALIZED (SELECT query_id, node_id, max(combined) AS score, min(hop) AS hop FROM hops JOIN inband USING (query_id, hop) GROUP BY query_id, node_id)",
    ]
    sql = ", ".join(out)
    if log:  # what the log says of each path; lifetime and session count alike when all was one session
        grown = "SELECT k, least(2.0::DOUBLE, 1.0::DOUBLE + 0.05::DOUBLE * n) * greatest(0.3::DOUBLE, 1.0::DOUBLE - 0.15::DOUBLE * n) AS f FROM (SELECT path_key AS k, count(*) AS n FROM acts GROUP BY path_key)"
        plain = "SELECT a.*, j.weight FROM adj a"
        assert plain in sql
        sql = sql.replace(plain, "SELECT a.*, j.weight * coalesce(g.f, 1.0::DOUBLE) AS weight FROM adj a LEFT JOIN (" + grown + ") g ON g.k = a.node_id || '→' || a.nbr || '@' || a.rel_type", 1).replace("WHERE weight > 0)", "WHERE j.weight > 0)", 1)
        acts = f"acts AS MATERIALIZED ({log})"
        sql = sql.replace(", " + acts, "", 1).replace("WITH nodes AS (", f"WITH {acts}, nodes AS (", 1)
    return sql


def _run(spark: SparkSession, sf: str, p: P.Params = P.Params()):
    nodes = C.nodes(spark, sf)
    return P.retrieve(asked(spark, sf), nodes, C.edges(spark, sf), C.vectors(spark, sf), p), nodes


HOPS = "SELECT query_id, hop, node_id, parent, rel_type, is_reverse, weight, round(ps, 6) AS ps, round(combined, 6) AS combined FROM hops"
RESULT = """SELECT query_id, node_id, hop, round(score, 6) AS score, rank::INT AS rank FROM (SELECT b.*, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, ord) AS rank
  FROM banded b JOIN active a USING (node_id) WHERE length(a.content) > 0)"""
LOOSE = P.Params(threshold=0.1)
r6 = lambda c: F.round(c, 6).alias(c)


@query(par_sql() + RESULT)
def par_result(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: seeds, hops, peak stop and band for every query, ranked."""
    (hops, means), nodes = _run(spark, sf)
    return P.result(hops, means, nodes).select("query_id", "node_id", "hop", r6("score"), "rank")


@query(par_sql(thr=0.1) + HOPS)
def par_hops(spark: SparkSession, sf: str) -> DataFrame:
    (hops, _), _ = _run(spark, sf, LOOSE)
    return hops.select("query_id", "hop", "node_id", "parent", "rel_type", "is_reverse", "weight", r6("ps"), r6("combined"))


def _tracked(spark: SparkSession, sf: str) -> tuple:
    """A first run without a log, and what it takes to run again under its activations."""
    n, e, v, q = C.nodes(spark, sf), C.edges(spark, sf), C.vectors(spark, sf), asked(spark, sf)
    none = spark.createDataFrame([], "path_key string, session_id string")
    _, _, used = P.retrieve_tracked(q, n, e, v, LOOSE, none, "s1")
    return q, n, e, v, used


@query(par_sql(thr=0.1) + "SELECT query_id, hop, path_key FROM activated")
def par_activations(spark: SparkSession, sf: str) -> DataFrame:
    """Every path that a run activates."""
    return _tracked(spark, sf)[-1].select("query_id", "hop", "path_key")


@query(par_sql(thr=0.1, log=par_sql(thr=0.1) + "SELECT path_key FROM activated") + HOPS.replace("weight,", "round(weight, 6) AS weight,"))
def par_second_run(spark: SparkSession, sf: str) -> DataFrame:
    """The same queries again in the same session: paths that many of them took are worn, others come first."""
    q, n, e, v, used = _tracked(spark, sf)
    hops, _, _ = P.retrieve_tracked(q, n, e, v, LOOSE, materialize(used, "log"), "s1")
    return hops.select("query_id", "hop", "node_id", "parent", "rel_type", "is_reverse", r6("weight"), r6("ps"), r6("combined"))


@query(par_sql(thr=0.1) + "SELECT query_id, hop, round(mu, 6) AS mu FROM means")
def par_hop_means(spark: SparkSession, sf: str) -> DataFrame:
    (_, means), _ = _run(spark, sf, LOOSE)
    return means.select("query_id", "hop", r6("mu"))


@query(par_sql(k_sigma=0.5) + HOPS)
def relative_threshold_filter(spark: SparkSession, sf: str) -> DataFrame:
    (hops, _), _ = _run(spark, sf, P.Params(k_sigma=0.5))
    return hops.select("query_id", "hop", "node_id", "parent", "rel_type", "is_reverse", "weight", r6("ps"), r6("combined"))


@query(par_sql(blind=True) + RESULT)
def par_blind(spark: SparkSession, sf: str) -> DataFrame:
    (hops, means), nodes = _run(spark, sf, P.Params(blind=True))
    return P.result(hops, means, nodes).select("query_id", "node_id", "hop", r6("score"), "rank")


def _hops(spark: SparkSession, sf: str, p: P.Params) -> DataFrame:
    (hops, _), _ = _run(spark, sf, p)
    return hops.select("query_id", "hop", "node_id", "parent", "rel_type", "is_reverse", "weight", r6("ps"), r6("combined"))


@query(par_sql(blind=True) + HOPS)
def par_blind_hops(spark: SparkSession, sf: str) -> DataFrame:
    return _hops(spark, sf, P.Params(blind=True))


@query(par_sql(thr=0.1, floor=0.3) + HOPS)
def par_seed_floor(spark: SparkSession, sf: str) -> DataFrame:
    """Seeds of both channels need a cosine of 0.3; the top-up does not."""
    return _hops(spark, sf, P.Params(threshold=0.1, seed_floor=0.3))


@query(par_sql(thr=0.1, first_peak=True) + HOPS)
def par_first_peak(spark: SparkSession, sf: str) -> DataFrame:
    return _hops(spark, sf, P.Params(threshold=0.1, first_peak=True))


@query(par_sql(thr=0.2, thr_decay=0.8) + HOPS)
def par_threshold_decay(spark: SparkSession, sf: str) -> DataFrame:
    return _hops(spark, sf, P.Params(threshold=0.2, threshold_decay=0.8))


@query(par_sql(thr=0.05, frame="recommend", anchor=0.25) + HOPS)
def par_frame_anchor(spark: SparkSession, sf: str) -> DataFrame:
    return _hops(spark, sf, P.Params(threshold=0.05, frame="recommend", anchor=0.25))


@query(par_sql(thr=0.1, ratio=0.5) + "SELECT query_id, node_id, round(score, 6) AS score, hop FROM banded")
def par_tolerance_ratio(spark: SparkSession, sf: str) -> DataFrame:
    (hops, means), _ = _run(spark, sf, LOOSE)
    return P.band(hops, means, P.Params(threshold=0.1, tolerance_ratio=0.5)).select("query_id", "node_id", r6("score"), "hop")


@query(par_sql(thr=0.1) + "SELECT query_id, round(peak, 6) AS peak, 0.1::DOUBLE AS delta, rounds, in_band, round(in_band / rounds, 3) AS ratio FROM pk2 JOIN (SELECT query_id, count(*) AS in_band FROM inband WHERE hop > 0 GROUP BY query_id) USING (query_id)")
def par_band_stats(spark: SparkSession, sf: str) -> DataFrame:
    (_, means), _ = _run(spark, sf, LOOSE)
    return P.band_stats(means, LOOSE).withColumn("peak", F.round("peak", 6))


_PASSED = " UNION ALL ".join(f"SELECT query_id, {h} AS hop, count(*) AS n_in, count(*) FILTER (ps >= thr) AS n_out, 0.1::DOUBLE AS thr FROM ft{h} GROUP BY query_id" for h in range(1, 6))


@query(par_sql(thr=0.1) + _PASSED)
def par_pass_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates that met and passed the purpose filter, by hop."""
    return P.retrieve_all(asked(spark, sf), C.nodes(spark, sf), C.edges(spark, sf), C.vectors(spark, sf), LOOSE)[2]


@query(par_sql(thr=0.1) + """, pool AS (SELECT query_id, node_id, min(CASE WHEN hop = 0 THEN 1 ELSE 2 END) AS tier, max(combined) AS score FROM hops GROUP BY query_id, node_id)
  SELECT query_id, node_id, tier, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY tier, round(score, 9) DESC, node_id)::INT AS place FROM pool""")
def par_candidate_pool(spark: SparkSession, sf: str) -> DataFrame:
    (hops, _), _ = _run(spark, sf, LOOSE)
    return P.candidate_pool(hops).withColumn("score", F.round("score", 6))


@query(par_sql(thr=0.1) + "SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY hop, pos, node_id)::INT AS step, hop, node_id, parent, rel_type FROM hops")
def par_visiting_order(spark: SparkSession, sf: str) -> DataFrame:
    (hops, _), _ = _run(spark, sf, LOOSE)
    return P.visiting_order(hops)


@query(par_sql(thr=0.1) + "SELECT query_id, count(DISTINCT node_id) AS candidates FROM hops GROUP BY query_id")
def par_total_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct candidates over all hops of each query."""
    (hops, _), _ = _run(spark, sf, LOOSE)
    return hops.groupBy("query_id").agg(F.count_distinct("node_id").alias("candidates"))


_CUE_TEXT = "concat_ws(' ', coalesce(text, ''), CASE doc_id % 5 WHEN 0 THEN '安排步骤，推荐方向' WHEN 1 THEN '推荐选项 建议 安慰' WHEN 2 THEN '寻求安慰' ELSE '' END)"


@query(f"WITH t AS (SELECT doc_id, {_CUE_TEXT} AS t FROM documents), n AS (SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(t, '{cues}')) AS {name}" for name, cues in FRAME_CUES.items()) + ") FROM t) SELECT doc_id, CASE WHEN greatest(vent, plan, recommend) = 0 THEN 'neutral' WHEN vent >= plan AND vent >= recommend THEN 'vent' WHEN plan >= recommend THEN 'plan' ELSE 'recommend' END AS frame FROM n".replace(") FROM t)", " FROM t)"))
def frame_compile(spark: SparkSession, sf: str) -> DataFrame:
    """The frame of each document's text, with cue phrases added to three fifths of them."""
    from tessera.session import table

    added = F.element_at(F.array(F.lit("安排步骤，推荐方向"), F.lit("推荐选项 建议 安慰"), F.lit("寻求安慰"), F.lit(""), F.lit("")), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, sf, "documents").select("doc_id", P.compile_frame(F.array(F.col("text"), added)).alias("frame"))


@query(par_sql(thr=0.05, frame="plan") + HOPS)
def par_framed(spark: SparkSession, sf: str) -> DataFrame:
    """Retrieval under the plan frame: topic scores gated by type and relation."""
    (hops, _), _ = _run(spark, sf, P.Params(threshold=0.05, frame="plan"))
    return hops.select("query_id", "hop", "node_id", "parent", "rel_type", "is_reverse", "weight", r6("ps"), r6("combined"))


@query(par_sql(thr=0.1, uniform=True) + HOPS)
def par_uniform_weights(spark: SparkSession, sf: str) -> DataFrame:
    """The ablation with all step weights at 1."""
    nodes = C.nodes(spark, sf)
    ones = [(t, r, rev, 1.0) for t, r, rev, _ in jump_rows()]
    hops, _ = P.retrieve(asked(spark, sf), nodes, C.edges(spark, sf), C.vectors(spark, sf), LOOSE, ones)
    return hops.select("query_id", "hop", "node_id", "parent", "rel_type", "is_reverse", "weight", r6("ps"), r6("combined"))


@query(par_sql(thr=0.1) + """SELECT query_id, node_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, node_id) AS p FROM banded) WHERE p <= 12""")
def peak_band_collect(spark: SparkSession, sf: str) -> DataFrame:
    (hops, means), _ = _run(spark, sf, LOOSE)
    return P.band(hops, means, P.Params(threshold=0.1, max_nodes=12)).select("query_id", "node_id", r6("score"))


_CORE = """, tree AS (SELECT query_id, node_id, arg_min(parent, hop) AS parent, min(hop) AS depth FROM hops GROUP BY query_id, node_id),
  up0 AS (SELECT query_id, node_id, node_id AS now FROM banded)""" + "".join(f", up{k} AS (SELECT u.query_id, u.node_id, t.parent AS now FROM up{k - 1} u JOIN tree t ON t.query_id = u.query_id AND t.node_id = u.now WHERE t.parent IS NOT NULL)" for k in range(1, 6)) + """,
  chain AS (SELECT u.*, t.depth FROM (""" + " UNION ALL ".join(f"SELECT * FROM up{k}" for k in range(6)) + """) u JOIN tree t ON t.query_id = u.query_id AND t.node_id = u.now),
  roots AS (SELECT query_id, node_id, arg_min(now, depth) AS root FROM chain GROUP BY query_id, node_id),
  core AS (SELECT DISTINCT c.query_id, r.root, c.now AS node_id, c.depth FROM chain c JOIN roots r ON r.query_id = c.query_id AND r.node_id = c.node_id)"""


@query(par_sql(thr=0.1) + _CORE + "SELECT * FROM core")
def core_groups(spark: SparkSession, sf: str) -> DataFrame:
    (hops, means), _ = _run(spark, sf, LOOSE)
    return P.core_groups(hops, P.band(hops, means, LOOSE))


@query(par_sql(thr=0.1) + _CORE + """, pl AS (SELECT query_id, node_id, arg_min(pos, hop) AS p FROM hops GROUP BY query_id, node_id)
  SELECT c.query_id, c.root, c.node_id, c.depth, (row_number() OVER (PARTITION BY c.query_id ORDER BY c.depth, r.p, pl.p, c.node_id))::INT AS pos
  FROM core c JOIN pl USING (query_id, node_id) JOIN pl r ON r.query_id = c.query_id AND r.node_id = c.root""")
def path_level_order(spark: SparkSession, sf: str) -> DataFrame:
    (hops, means), _ = _run(spark, sf, LOOSE)
    return P.level_order(P.core_groups(hops, P.band(hops, means, LOOSE)), hops).select("query_id", "root", "node_id", "depth", "pos")


@query(par_sql(thr=0.1) + _CORE + """, fe AS (SELECT query_id, node_id, arg_min((parent, rel_type, is_reverse), hop) AS e FROM hops WHERE parent IS NOT NULL GROUP BY query_id, node_id)
  SELECT query_id, CASE WHEN e[3] THEN node_id ELSE e[1] END AS src, CASE WHEN e[3] THEN e[1] ELSE node_id END AS dst, e[2] AS rel_type FROM fe JOIN (SELECT DISTINCT query_id, node_id FROM core) USING (query_id, node_id)""")
def path_tree_edges(spark: SparkSession, sf: str) -> DataFrame:
    (hops, means), _ = _run(spark, sf, LOOSE)
    return P.tree_edges(P.core_groups(hops, P.band(hops, means, LOOSE)), hops)


_AUGMENT = f""", fe AS (SELECT query_id, node_id, arg_min((parent, rel_type, is_reverse), hop) AS e FROM hops WHERE parent IS NOT NULL GROUP BY query_id, node_id),
  g AS MATERIALIZED (SELECT DISTINCT query_id AS group_id, node_id FROM core),
  c AS MATERIALIZED (SELECT query_id AS group_id, CASE WHEN e[3] THEN node_id ELSE e[1] END AS src, CASE WHEN e[3] THEN e[1] ELSE node_id END AS dst FROM fe WHERE EXISTS (SELECT 1 FROM g WHERE g.group_id = fe.query_id AND g.node_id = fe.node_id)),
  o AS (
    SELECT g.group_id, e.src, e.dst, e.rel_type, (rel_type NOT IN ({", ".join(f"'{r}'" for r in DIRECTIONAL)}))::INT AS late FROM edges e JOIN g ON g.node_id = e.src JOIN g h ON h.node_id = e.dst AND h.group_id = g.group_id
    WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.group_id = g.group_id AND least(c.src, c.dst) = least(e.src, e.dst) AND greatest(c.src, c.dst) = greatest(e.src, e.dst))),
  b AS (SELECT group_id, least(greatest(60, least(300, 2 * count(*))), 2 * count(*) - coalesce((SELECT count(*) FROM c WHERE c.group_id = g.group_id), 0)) AS budget FROM g GROUP BY group_id),
  u AS (SELECT *, row_number() OVER (PARTITION BY group_id, least(src, dst), greatest(src, dst) ORDER BY late, src, dst) AS turn FROM o),
  pl2 AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY late, src, dst) AS place FROM u WHERE turn = 1)"""


def _path(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes of each query's paths (group_id, node_id), the edges that led to them, and the edges added among them."""
    (hops, means), _ = _run(spark, sf, LOOSE)
    groups = materialize(P.core_groups(hops, P.band(hops, means, LOOSE)), "groups")
    nodes = groups.select(F.col("query_id").alias("group_id"), "node_id").distinct()
    tree = materialize(P.tree_edges(groups, hops).withColumnRenamed("query_id", "group_id"), "tree")
    return nodes, tree, G.augment(nodes, tree.select("group_id", "src", "dst"), C.edges(spark, sf))


@query(par_sql(thr=0.1) + _CORE + _AUGMENT + " SELECT p.group_id, src, dst, rel_type, place::INT AS place FROM pl2 p JOIN b USING (group_id) WHERE place <= budget")
def path_augmented_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges among the nodes of each query's retrieved paths that the paths did not take."""
    return _path(spark, sf)[2]


_WHOLE_PATH = """, whole AS (SELECT group_id, e[2] AS rel_type FROM fe JOIN g ON g.group_id = fe.query_id AND g.node_id = fe.node_id UNION ALL SELECT p.group_id, rel_type FROM pl2 p JOIN b USING (group_id) WHERE place <= budget)
  SELECT group_id AS query_id, rel_type, count(*) AS n FROM whole GROUP BY group_id, rel_type"""


@query(par_sql(thr=0.1) + _CORE + _AUGMENT + _WHOLE_PATH)
def path_edge_types(spark: SparkSession, sf: str) -> DataFrame:
    """Paths put together from the edges that led to their nodes and those added, by relation."""
    _, tree, added = _path(spark, sf)
    whole = tree.select("group_id", "rel_type").unionByName(added.select("group_id", "rel_type"))
    return whole.groupBy(F.col("group_id").alias("query_id"), "rel_type").agg(F.count(F.lit(1)).alias("n"))


@query(par_sql(thr=0.1) + "SELECT query_id, hop, node_id, round(combined, 4) AS score, pos::INT AS pos FROM hops WHERE pos <= 8")
def hop_digest(spark: SparkSession, sf: str) -> DataFrame:
    (hops, _), _ = _run(spark, sf, LOOSE)
    return hops.filter("pos <= 8").select("query_id", "hop", "node_id", F.round("combined", 4).alias("score"), "pos")


@query(par_sql(thr=0.1) + ", " + RESULT.replace("SELECT query_id, node_id, hop", "res AS (SELECT query_id, node_id, hop", 1) + ") SELECT query_id, greatest(4, least(40, floor(2000 / avg(length(content)))))::BIGINT AS cap FROM res JOIN nodes USING (node_id) WHERE rank <= 40 GROUP BY query_id")
def precision_cap(spark: SparkSession, sf: str) -> DataFrame:
    (hops, means), nodes = _run(spark, sf, LOOSE)
    ranked = P.result(hops, means, nodes, LOOSE).join(nodes.select("node_id", "content"), "node_id")
    return P.adaptive_cap(ranked)


def _frame_sql(frame: str) -> str:
    case = lambda col, prefs: f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {v / max(prefs.values())!r}" for k, v in prefs.items()) + " ELSE 0 END"
    return f"SELECT '{frame}' AS frame, e.src, e.dst, round((0.55::DOUBLE + 0.35 * (0.25 + 0.75 * ({case('n.node_type', FRAME_TYPES[frame])})) + 0.10 * (0.15 + 0.85 * ({case('e.rel_type', FRAME_RELATIONS[frame])})))::DOUBLE, 6) AS gate FROM edges e JOIN nodes n ON n.node_id = e.dst"


@query(BASE_SQL + " UNION ALL ".join(map(_frame_sql, ("vent", "plan", "recommend"))))
def frame_gate_scores(spark: SparkSession, sf: str) -> DataFrame:
    kinds = C.nodes(spark, sf).select(F.col("node_id").alias("dst"), "node_type")
    e = C.edges(spark, sf).join(kinds, "dst")
    parts = [e.select(F.lit(f).alias("frame"), "src", "dst", F.round(P.frame_score(F.lit(1.0), f, F.col("node_type"), F.col("rel_type")), 6).alias("gate")) for f in ("vent", "plan", "recommend")]
    return parts[0].union(parts[1]).union(parts[2])


@query(BASE_SQL + ", " + ASKED_SQL + f", s AS (SELECT query_id, {COS.format(a='q.pv', b='n.v')} AS s FROM asked q, nodes n WHERE NOT n.deprecated AND NOT n.forgotten), b AS (SELECT query_id, max(s) AS best FROM s GROUP BY query_id) SELECT query_id, round(best, 6) AS best, CASE WHEN round(best, 9) < 0.48 THEN 'abstain' WHEN round(best, 9) < 0.60 THEN 'judge' ELSE 'answer' END AS decision FROM b")
def abstain_decision(spark: SparkSession, sf: str) -> DataFrame:
    from tessera.operators.routing import abstain

    live = C.nodes(spark, sf).filter("NOT deprecated AND NOT forgotten").select(F.col("node_id").alias("id"))
    v = C.vectors(spark, sf).join(live, "id", "left_semi")
    best = V.knn(asked(spark, sf).select("query_id", F.col("purpose_vec").alias("embedding")), v, 1)
    return best.select("query_id", F.round("score", 6).alias("best"), abstain(F.round("score", 9)).alias("decision"))


@query(BASE_SQL + ", n AS (SELECT count(*) AS n FROM active), k AS (SELECT unnest([3, 5, 10, 40, 400]) AS seed_k) SELECT seed_k, (CASE WHEN n <= seed_k THEN greatest(2, n) ELSE greatest(2, 5, least(seed_k, n // 10)) END)::BIGINT AS effective FROM k, n")
def seed_k_adaptive(spark: SparkSession, sf: str) -> DataFrame:
    from tessera.operators.routing import effective_seed_k

    n = C.nodes(spark, sf).filter("NOT deprecated AND NOT forgotten").agg(F.count(F.lit(1)).alias("n"))
    ks = n.select("n", F.explode(F.array(*[F.lit(k) for k in (3, 5, 10, 40, 400)])).alias("seed_k"))
    return ks.select("seed_k", effective_seed_k(F.col("n"), F.col("seed_k"), 5).alias("effective"))
