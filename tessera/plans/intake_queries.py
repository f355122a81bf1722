"""Queries of intake and bookkeeping over the provided tables, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.render import evidence_node
from tessera.operators import intake as I
from tessera.operators import keyword as K
from tessera.operators import review as R
from tessera.plans.graph_queries import JUMP_SQL
from tessera.plans.text_queries import tok
from tessera.session import materialize, table
from tessera.sources import canonical as C
from tessera.sources.canonical import BASE_SQL
from tessera.streaming.sessions import tail

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
_MS = "(epoch_us(ts) // 1000)"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))


#: What a request has instead of a good field, by doc_id: texts that are numbers, fields in other objects, lists of the wrong things, half a body.
_ODD_SEARCH = [
    ("query", "5"), ("query", '" \u3000 "'), ("query", "null"), ("query", '["a"]'), ("user_id", "true"), ("user_id", '""'), ("top_k", "true"), ("top_k", '"7"'), ("top_k", "7.5"), ("top_k", "0"), ("top_k", "-3"),
    ("top_k", '{"top_k": 5}'), ("options", '"abc"'), ("options", '["a", 1]'), ("options", "[null]"), ("options", "[]"), ("options", "null"), ("options", '["a", "b"]'), ("top_k", "250"), ("top_k", "null"),
]
_ODD_ADD = [
    ("request_id", "5"), ("user_id", '"  "'), ("session_id", "null"), ("messages", "[]"), ("messages", '{"role": "user"}'), ("messages", '[{"role": "user", "content": "x"}, 5]'),
    ("messages", '[{"role": "system", "content": "x"}]'), ("messages", '[{"role": "user", "content": "x"}, {"role": "assistant", "content": ""}]'), ("messages", '[{"role": "user", "content": 7}]'),
    ("messages", '[{"role": "user", "content": "x", "timestamp": true}]'), ("messages", '[{"role": "user", "content": "x", "timestamp": 1.5}]'), ("messages", '[{"role": "user", "content": "x", "timestamp": null}]'),
]


def _json_text(text: Column) -> Column:
    """A text as JSON: what stands between the brackets of a list of it."""
    listed = F.to_json(F.array(text))
    return F.when(text.isNull(), "null").otherwise(listed.substr(F.lit(2), F.length(listed) - 2))


def _bodies(spark: SparkSession, sf: str, fields: dict, odd: list[tuple[str, str]]) -> DataFrame:
    """doc_id, body: a request made of each document; of three, one has an odd field and one in nine is cut short."""
    k, good = F.col("doc_id"), F.lit("")
    which = (F.floor(k / 3) % len(odd)).cast("int")
    name, value = (F.get(F.array(*[F.lit(o[i]) for o in odd]), which) for i in (0, 1))
    parts = [F.concat(F.lit(f'"{n}": '), F.when((k % 3 == 0) & (name == n), value).otherwise(c)) for n, c in fields.items()]
    extra = F.when((k % 3 == 0) & (name == "options"), F.concat(F.lit(', "options": '), value)).otherwise(good)
    body = F.concat(F.lit("{"), F.concat_ws(", ", *parts), extra, F.when(k % 9 == 1, "").otherwise("}"))
    return table(spark, sf, "documents").select("doc_id", body.alias("body"))


def _bodies_sql(fields: dict[str, str], odd: list[tuple[str, str]]) -> str:
    quoted = lambda values: "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"
    at = f"[((doc_id // 3) % {len(odd)} + 1)::INT]"
    name, value = f"{quoted([o[0] for o in odd])}{at}", f"{quoted([o[1] for o in odd])}{at}"
    parts = " || ', ' || ".join(f"""'"{n}": ' || CASE WHEN doc_id % 3 = 0 AND {name} = '{n}' THEN {value} ELSE {c} END""" for n, c in fields.items())
    return f"""bodies AS (SELECT doc_id, '{{' || {parts} || CASE WHEN doc_id % 3 = 0 AND {name} = 'options' THEN ', "options": ' || {value} ELSE '' END || CASE WHEN doc_id % 9 = 1 THEN '' ELSE '}}' END AS body FROM documents),
  v AS (SELECT doc_id, CASE WHEN json_valid(body) THEN body::JSON END AS v FROM bodies)"""


_SEARCH_FIELDS = {"query": "coalesce(to_json(text)::VARCHAR, 'null')", "user_id": "to_json(coalesce(source, 'u'))::VARCHAR", "top_k": "(doc_id + 1)::VARCHAR"}
_ADD_FIELDS = {
    "request_id": "to_json('r' || doc_id)::VARCHAR", "user_id": "to_json(coalesce(source, 'u'))::VARCHAR", "session_id": "to_json(coalesce(lang, 's'))::VARCHAR",
    "messages": """'[{"role": "user", "content": ' || coalesce(to_json(text)::VARCHAR, 'null') || ', "timestamp": ' || doc_id || '}, {"role": "assistant", "content": "yes"}]'""",
}
_NO_TEXT = r"coalesce(json_type(v, '$.{0}') <> 'VARCHAR' OR regexp_matches(v ->> '$.{0}', '^[\s\x{{3000}}]*$'), true)"
_NO_MESSAGE = r"""CASE WHEN json_type(m) <> 'OBJECT' THEN 'message' WHEN NOT coalesce(json_type(m, '$.role') = 'VARCHAR' AND (m ->> '$.role') IN ('user', 'assistant'), false) THEN 'role'
    WHEN coalesce(json_type(m, '$.content') <> 'VARCHAR' OR regexp_matches(m ->> '$.content', '^[\s\x{3000}]*$'), true) THEN 'content' WHEN coalesce(json_type(m, '$.timestamp') NOT IN ('NULL', 'BIGINT', 'UBIGINT'), false) THEN 'timestamp' END"""


@query(f"""
WITH {_bodies_sql(_SEARCH_FIELDS, _ODD_SEARCH)},
o AS (SELECT *, CASE WHEN json_type(v, '$.options') = 'ARRAY' THEN coalesce(list_bool_and([coalesce(json_type(x) = 'VARCHAR', false) FOR x IN (v -> '$.options')::JSON[]]), true) ELSE coalesce(json_type(v, '$.options') = 'NULL', true) END AS listed FROM v),
j AS (SELECT *, CASE WHEN v IS NULL OR json_type(v) <> 'OBJECT' THEN 'body' WHEN {_NO_TEXT.format('query')} THEN 'query' WHEN {_NO_TEXT.format('user_id')} THEN 'user_id'
    WHEN NOT coalesce(json_type(v, '$.top_k') IN ('BIGINT', 'UBIGINT') AND try_cast(v ->> '$.top_k' AS HUGEINT) > 0, false) THEN 'top_k' WHEN NOT listed THEN 'options' END AS reject_reason FROM o)
SELECT doc_id, CASE WHEN reject_reason IS NULL THEN md5(v ->> '$.query') END AS query_md5, CASE WHEN reject_reason IS NULL THEN v ->> '$.user_id' END AS user_id,
  CASE WHEN reject_reason IS NULL THEN least(try_cast(v ->> '$.top_k' AS BIGINT), 100) END AS top_k, CASE WHEN reject_reason IS NULL THEN coalesce(json_array_length(v, '$.options'), 0)::BIGINT END AS n_options, reject_reason FROM j
""")
def search_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Every text as the query of a request, with odd fields of all kinds among them."""
    text = _json_text(F.col("text"))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    fields = {"query": text, "user_id": quoted(F.coalesce("source", F.lit("u"))), "top_k": (F.col("doc_id") + 1).cast("string")}
    found = I.search_request(F.col("body"))
    rows = _bodies(spark, sf, fields, _ODD_SEARCH).select("doc_id", *[c.alias(n) for n, c in found.items()])
    n = F.when(F.col("reject_reason").isNull(), F.coalesce(F.size("options"), F.lit(0)).cast("long"))
    return rows.select("doc_id", F.md5("query").alias("query_md5"), "user_id", "top_k", n.alias("n_options"), "reject_reason")


@query(f"""
WITH {_bodies_sql(_ADD_FIELDS, _ODD_ADD)},
m AS (SELECT doc_id, k - 1 AS k, {_NO_MESSAGE} AS why FROM (SELECT doc_id, generate_subscripts(l, 1) AS k, unnest(l) AS m FROM (SELECT doc_id, CASE WHEN json_type(v, '$.messages') = 'ARRAY' THEN (v -> '$.messages')::JSON[] END AS l FROM v))),
f AS (SELECT doc_id, min(k) AS k, arg_min(why, k) AS why FROM m WHERE why IS NOT NULL GROUP BY doc_id),
j AS (SELECT v.*, CASE WHEN v IS NULL OR json_type(v) <> 'OBJECT' THEN 'body' WHEN {_NO_TEXT.format('request_id')} THEN 'request_id' WHEN {_NO_TEXT.format('user_id')} THEN 'user_id' WHEN {_NO_TEXT.format('session_id')} THEN 'session_id'
    WHEN coalesce(json_type(v, '$.messages') <> 'ARRAY' OR json_array_length(v, '$.messages') = 0, true) THEN 'messages' WHEN why IS NOT NULL THEN 'messages[' || k || '].' || why END AS reject_reason FROM v LEFT JOIN f USING (doc_id))
SELECT doc_id, CASE WHEN reject_reason IS NULL THEN v ->> '$.request_id' END AS request_id, CASE WHEN reject_reason IS NULL THEN json_array_length(v, '$.messages')::BIGINT END AS n_messages,
  CASE WHEN reject_reason IS NULL THEN md5(v ->> '$.messages[0].content') END AS first_md5, CASE WHEN reject_reason IS NULL THEN (v ->> '$.messages[0].timestamp')::BIGINT END AS first_ts, reject_reason FROM j
""")
def add_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Every text as the first message of a request to add, with odd ids and messages among them."""
    text = _json_text(F.col("text"))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    messages = F.concat(F.lit('[{"role": "user", "content": '), text, F.lit(', "timestamp": '), F.col("doc_id").cast("string"), F.lit('}, {"role": "assistant", "content": "yes"}]'))
    fields = {"request_id": quoted(F.concat(F.lit("r"), F.col("doc_id").cast("string"))), "user_id": quoted(F.coalesce("source", F.lit("u"))), "session_id": quoted(F.coalesce("lang", F.lit("s"))), "messages": messages}
    rows = _bodies(spark, sf, fields, _ODD_ADD).select("doc_id", *[c.alias(n) for n, c in I.add_request(F.col("body")).items()])
    first = F.get("messages", 0)
    n = F.when(F.col("reject_reason").isNull(), F.size("messages").cast("long"))
    return rows.select("doc_id", "request_id", n.alias("n_messages"), F.md5(first["content"]).alias("first_md5"), first["timestamp"].alias("first_ts"), "reject_reason")


@query(r"""
WITH n AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'g' || page_id || '.yaml' WHEN 1 THEN url WHEN 2 THEN '.g.yml' WHEN 3 THEN 'g.json' WHEN 4 THEN '' ELSE 'G.YML' END AS name FROM pages)
SELECT page_id, CASE WHEN length(name) = 0 THEN 'empty' WHEN regexp_matches(name, '[\\/:]') THEN 'path' WHEN starts_with(name, '.') THEN 'hidden'
  WHEN NOT regexp_matches(lower(name), '\.ya?ml$') THEN 'suffix' END AS reason
FROM n
""")
def graph_names(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("page_id") % 6
    name = F.when(p == 0, F.concat(F.lit("g"), "page_id", F.lit(".yaml"))).when(p == 1, F.col("url")).when(p == 2, ".g.yml").when(p == 3, "g.json").when(p == 4, "").otherwise("G.YML")
    return table(spark, sf, "pages").select("page_id", I.graph_name_reason(name).alias("reason"))


@query(f"SELECT event_id, CASE WHEN event_id % 4 = 0 THEN event_type ELSE '[' || strftime(make_timestamp({_MS} * 1000), '%Y-%m-%d %H:%M:%S') || '] ' || event_type END AS round FROM events")
def round_texts(spark: SparkSession, sf: str) -> DataFrame:
    ms = F.when(F.col("event_id") % 4 != 0, F.col("ms"))
    return events(spark, sf).select("event_id", I.round_text(ms, F.col("event_type")).alias("round"))


@query(r"""
WITH d AS (SELECT event_id, CASE event_id % 6
    WHEN 0 THEN '[Ann] one' || chr(10) || chr(10) || '  [Ann （QQ 12345，x）] two'
    WHEN 1 THEN '[Ann] （QQ 3512593260，y）hi' || chr(10) || '[Bob] (qq: 3512593260) ho'
    WHEN 2 THEN '[14:56] late' WHEN 3 THEN 'no label' WHEN 4 THEN '[Cid' || event_id || '] text' END AS t FROM events)
SELECT event_id,
  CASE event_id % 6 WHEN 0 THEN 'Ann' WHEN 4 THEN 'Cid' || event_id END AS speaker,
  CASE event_id % 6 WHEN 0 THEN '12345' WHEN 1 THEN '3512593260' END AS speaker_id
FROM d
""")
def round_speakers(spark: SparkSession, sf: str) -> DataFrame:
    """Speakers of made-up rounds; the SQL states what each must give."""
    e = F.col("event_id")
    t = (
        F.when(e % 6 == 0, "[Ann] one\n\n  [Ann （QQ 12345，x）] two")
        .when(e % 6 == 1, "[Ann] （QQ 3512593260，y）hi\n[Bob] (qq: 3512593260) ho")
        .when(e % 6 == 2, "[14:56] late")
        .when(e % 6 == 3, "no label")
        .when(e % 6 == 4, F.concat(F.lit("[Cid"), e, F.lit("] text")))
    )
    return table(spark, sf, "events").select("event_id", *[c.alias(k) for k, c in R.speakers(t).items()])


@query(BASE_SQL + """
, p AS (SELECT a.ord, list_cosine_similarity(a.v, b.v) AS c, pow(list_distance(a.v, b.v), 2) AS d FROM nodes a JOIN nodes b ON b.ord = a.ord + 1)
SELECT ord, round(CASE WHEN ord % 5 = 0 THEN 1 - greatest(d, 0) / 2 ELSE c END, 6) AS relevance FROM p
""")
def relevance_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbours in the table; every fifth has lost its vector and is judged by its distance."""
    v = C.vectors(spark, sf).select("ord", "embedding")
    met = v.join(v.select((F.col("ord") - 1).alias("ord"), F.col("embedding").alias("w")), "ord")
    d = F.aggregate(F.zip_with("embedding", "w", lambda x, y: (x.cast("double") - y.cast("double")) ** 2), F.lit(0.0), lambda s, x: s + x)
    own = F.when(F.col("ord") % 5 != 0, F.col("embedding"))
    return met.select("ord", F.round(I.relevance(own, F.col("w"), d), 6).alias("relevance"))


@query(BASE_SQL + "SELECT l.doc_id AS place, 'n' || l.doc_id AS id, len(n.v)::INT AS dims FROM labels l LEFT JOIN nodes n ON n.node_id = 'n' || l.doc_id")
def vector_fetch(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of all labelled documents, in their places, whether they have one or not."""
    wanted = table(spark, sf, "labels").select(F.col("doc_id").alias("place"), F.concat(F.lit("n"), "doc_id").alias("id"))
    return I.fetch(wanted, C.vectors(spark, sf)).select("place", "id", "dims")


@query(f"""
WITH d AS (SELECT doc_id AS id, text, source, n_chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1) AND trim(text) <> ''),
p AS (SELECT id, unnest({tok('text')}) AS term, 1 AS w FROM d UNION ALL SELECT id, unnest({tok('source')}), 2 FROM d),
q AS (SELECT item_id AS query_id, {tok('text')} AS terms FROM benchmark),
e AS (SELECT query_id, len(terms) AS n, unnest(terms) AS term FROM q),
s AS (SELECT query_id, id, round(least(1.0::DOUBLE, sum(w) / (3.0::DOUBLE * n)), 4) AS score FROM e JOIN p USING (term) GROUP BY query_id, id, n),
r AS (SELECT s.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, n_chars DESC, id) AS place, length(text) > 1200 AS truncated FROM s JOIN d USING (id)),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY (id * 7 + query_id) % 11 DESC, place) AS p FROM r WHERE place <= 24 AND id % 3 <> 0)
SELECT query_id, id, score, p::INT AS place, truncated FROM k WHERE p <= 8
""")
def knowledge_tool(spark: SparkSession, sf: str) -> DataFrame:
    """Notes by keywords, then in a reranker's order, which leaves a third of them out."""
    toxic = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), (F.col("toxic") == 1).alias("forgotten"))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("tags"), "text", F.col("n_chars").alias("observed_at"))
    notes = I.searchable(d.join(toxic, "id", "left").withColumn("deprecated", F.lit(False)))
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")

    def rerank(hits: DataFrame) -> DataFrame:
        return hits.filter("id % 3 <> 0").select("query_id", "id", ((F.col("id") * 7 + F.col("query_id")) % 11).alias("score"))

    return I.knowledge(q, K.postings(notes), notes, 8, rerank).select("query_id", "id", "score", "place", "truncated")


_BATCH = BASE_SQL + ", " + JUMP_SQL + """
, top AS (SELECT max(ord) AS top FROM nodes),
ops AS (SELECT item_id AS ord, 't' || item_id AS temp_id, CASE WHEN item_id % 7 = 0 THEN (SELECT content FROM nodes WHERE ord = item_id) ELSE text END AS content,
  ['status','reason','action','thing','person','emotion'][(item_id % 6 + 1)::INT] AS node_type FROM benchmark),
grp AS (SELECT content, min(ord) AS ord, arg_min(temp_id, ord) AS maker, arg_min(node_type, ord) AS node_type FROM ops WHERE trim(coalesce(content, '')) <> '' GROUP BY content),
known AS (SELECT content, min(node_id) AS known FROM nodes GROUP BY content),
made AS (SELECT g.content, g.node_type, 'n' || (top + row_number() OVER (ORDER BY g.ord)) AS made FROM grp g LEFT JOIN known k USING (content), top WHERE k.known IS NULL),
mapping AS (SELECT o.temp_id, coalesce(k.known, m.made) AS node_id, k.known IS NULL AND o.temp_id = g.maker AS created FROM ops o JOIN grp g USING (content) LEFT JOIN known k USING (content) LEFT JOIN made m USING (content))
"""


def _batch(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    n = C.nodes(spark, sf)
    b = table(spark, sf, "benchmark")
    own = n.select(F.col("ord").alias("item_id"), F.col("content").alias("there"))
    kinds = F.array(*[F.lit(t) for t in ("status", "reason", "action", "thing", "person", "emotion")])
    ops = b.join(own, "item_id", "left").select(
        F.col("item_id").alias("ord"),
        F.concat(F.lit("t"), "item_id").alias("temp_id"),
        F.when(F.col("item_id") % 7 == 0, F.col("there")).otherwise(F.col("text")).alias("content"),
        F.get(kinds, (F.col("item_id") % 6).cast("int")).alias("node_type"),
    )
    edge = lambda src, dst, rel: b.select(src.alias("src"), dst.alias("dst"), F.lit(rel).alias("rel_type"))
    t, n_ = F.concat(F.lit("t"), "item_id"), F.concat(F.lit("n"), "item_id")
    following = F.concat(F.lit("t"), F.col("item_id") + 1)
    edges = edge(t, following, "sequence").union(edge(t, n_, "scenario")).union(edge(n_, F.concat(F.lit("n"), F.col("item_id") + 1), "causal")).union(edge(t, n_, "nothing"))
    return I.apply_batch(n, C.edges(spark, sf), ops, edges)


@query(_BATCH + "SELECT * FROM mapping")
def batch_mapping(spark: SparkSession, sf: str) -> DataFrame:
    """Temporary ids of a batch and the nodes that they became; some texts are there already."""
    return _batch(spark, sf)[0]


@query(_BATCH + """
, given AS (
  SELECT 't' || item_id AS a, 't' || (item_id + 1) AS b, 'sequence' AS rel_type FROM benchmark UNION ALL SELECT 't' || item_id, 'n' || item_id, 'scenario' FROM benchmark
  UNION ALL SELECT 'n' || item_id, 'n' || (item_id + 1), 'causal' FROM benchmark UNION ALL SELECT 't' || item_id, 'n' || item_id, 'nothing' FROM benchmark),
res AS (SELECT coalesce(x.node_id, a) AS src, coalesce(y.node_id, b) AS dst, rel_type FROM given LEFT JOIN mapping x ON x.temp_id = a LEFT JOIN mapping y ON y.temp_id = b),
every AS (SELECT node_id, node_type FROM nodes UNION ALL SELECT made, node_type FROM made)
SELECT r.src, r.dst, r.rel_type, CASE
  WHEN s.node_id IS NULL OR d.node_id IS NULL THEN 'missing endpoint' WHEN r.src = r.dst THEN 'self loop'
  WHEN r.rel_type = 'nothing' THEN 'unknown relation' WHEN coalesce(j.weight, 0) <= 0 THEN 'zero weight' WHEN e.src IS NOT NULL THEN 'pair exists' END AS reject_reason
FROM res r LEFT JOIN every s ON s.node_id = r.src LEFT JOIN every d ON d.node_id = r.dst
LEFT JOIN jump j ON j.node_type = s.node_type AND j.rel_type = r.rel_type AND NOT j.is_reverse LEFT JOIN edges e ON e.src = r.src AND e.dst = r.dst
""")
def batch_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edge operations of the same batch, resolved and judged one by one."""
    return _batch(spark, sf)[1]


@query(BASE_SQL + "SELECT n.scene, count(*) FILTER (src_ord % 3 = 0 AND dst_ord % 3 = 0) AS inner, count(*) FILTER ((src_ord % 3 = 0) <> (dst_ord % 3 = 0)) AS cross FROM edges e JOIN nodes n ON n.node_id = e.src GROUP BY n.scene".replace("AS inner,", 'AS "inner",').replace("AS cross ", 'AS "cross" '))
def edge_reach(spark: SparkSession, sf: str) -> DataFrame:
    """Edges inside a batch and out of it, by scene; every third node is new."""
    n = C.nodes(spark, sf).select("node_id", "scene", "ord")
    e = C.edges(spark, sf).join(n.select(F.col("node_id").alias("src"), "scene"), "src").select("scene", "src", "dst")
    return I.edge_reach(e, n.filter("ord % 3 = 0").select("scene", "node_id"), ["scene"])


@query("SELECT user_id, event_id, ((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 24)::INT AS batch FROM events")
def link_batches(spark: SparkSession, sf: str) -> DataFrame:
    return I.link_batches(table(spark, sf, "events").select("user_id", "event_id"), "user_id", "event_id")


_ROUNDS = "WITH r AS (SELECT user_id AS conv_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS round, event_id FROM events)"


def _rounds(spark: SparkSession, sf: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return table(spark, sf, "events").select(F.col("user_id").alias("conv_id"), place.cast("long").alias("round"), "event_id")


@query(_ROUNDS + """
, m AS (SELECT *, min(CASE WHEN event_id % 13 = 0 THEN round END) OVER (PARTITION BY conv_id ORDER BY round ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS flush FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, flush ORDER BY round DESC) AS back FROM m WHERE flush IS NOT NULL)
SELECT conv_id, round, flush, CASE WHEN back <= 10 THEN 'batch' ELSE 'raw' END AS part FROM k
""")
def flush_bodies(spark: SparkSession, sf: str) -> DataFrame:
    r = _rounds(spark, sf)
    return I.flush_bodies(r.select("conv_id", "round"), r.filter("event_id % 13 = 0").select("conv_id", "round"))


@query()
def flush_skips(spark: SparkSession, sf: str) -> DataFrame:
    """Which flushes are skipped after empty ones; a fold in order, held against a plain loop in the tests."""
    reason = F.when(F.col("event_id") % 9 == 0, "end").when(F.col("event_id") % 10 == 0, "manual").otherwise("idle")
    return I.auto_skips(_rounds(spark, sf).select("conv_id", "round", reason.alias("reason"), (F.col("event_id") % 7 != 0).alias("empty")))


@query("""
WITH l AS (SELECT event_id AS seq, CASE WHEN event_id % 17 <> 0 THEN 'r' || (event_id * 7919 % 3001) END AS rid FROM events),
m AS (SELECT rid, max(seq) AS seq FROM l WHERE coalesce(rid, '') <> '' GROUP BY rid)
SELECT * FROM m ORDER BY seq DESC LIMIT 500
""")
def request_log(spark: SparkSession, sf: str) -> DataFrame:
    rid = F.when(F.col("event_id") % 17 != 0, F.concat(F.lit("r"), F.col("event_id") * 7919 % 3001))
    return I.remembered_requests(table(spark, sf, "events").select(F.col("event_id").alias("seq"), rid.alias("rid")), 500)


@query(r"""
WITH f AS (SELECT CASE event_id % 4 WHEN 0 THEN 'u' || user_id || '/graph.yaml' WHEN 1 THEN 'u' || user_id || '.docs.index' WHEN 2 THEN 'u' || user_id || '.index/shard-' || event_id ELSE 'notes.txt' END AS path, epoch_us(ts) // 1000 AS modified FROM events),
s AS (SELECT CASE WHEN regexp_matches(split_part(path, '/', 1), '(\.docs\.yaml|\.docs\.log|\.docs\.index|\.index|\.yaml)$') THEN regexp_replace(split_part(path, '/', 1), '(\.docs\.yaml|\.docs\.log|\.docs\.index|\.index|\.yaml)$', '')
  WHEN contains(path, '/') THEN split_part(path, '/', 1) END AS space, modified FROM f)
SELECT space, count(*) AS files, max(modified) AS newest FROM s WHERE space IS NOT NULL GROUP BY space
""")
def space_inventory(spark: SparkSession, sf: str) -> DataFrame:
    u, k = F.concat(F.lit("u"), "user_id"), F.col("event_id") % 4
    path = F.when(k == 0, F.concat(u, F.lit("/graph.yaml"))).when(k == 1, F.concat(u, F.lit(".docs.index"))).when(k == 2, F.concat(u, F.lit(".index/shard-"), "event_id")).otherwise("notes.txt")
    return I.space_inventory(events(spark, sf).select(path.alias("path"), F.col("ms").alias("modified")))


@query("SELECT ts, event_id, event_type AS method FROM events WHERE value < 1 ORDER BY ts DESC, event_id DESC LIMIT 20")
def recent_errors(spark: SparkSession, sf: str) -> DataFrame:
    log = table(spark, sf, "events").select("ts", "event_id", F.col("event_type").alias("method"), (F.col("value") < 1).alias("error"))
    return I.recent_errors(log).drop("error")


@query("SELECT * FROM (SELECT event_id, user_id FROM events ORDER BY event_id DESC LIMIT 200)")
def log_tail(spark: SparkSession, sf: str) -> DataFrame:
    return tail(table(spark, sf, "events").select("event_id", "user_id"), 200, "event_id")


@query(f"SELECT user_id, max(CASE WHEN event_id % 3 <> 0 THEN {_MS} END) AS latest FROM events GROUP BY user_id")
def latest_times(spark: SparkSession, sf: str) -> DataFrame:
    ts = F.when(F.col("event_id") % 3 == 0, -F.col("ms")).otherwise(F.col("ms"))
    return I.latest_time(events(spark, sf).select("user_id", ts.alias("ts")), "user_id")


@query("""
WITH r AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn, text) AS rank FROM conversations),
t AS (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY rank) + rank - 1 AS upto FROM r WHERE rank <= 40)
SELECT conv_id AS query_id, md5(substr(string_agg(text, ' ' ORDER BY rank), 1, 2000)) AS story, count(*) FILTER (upto <= 2000) AS used FROM t GROUP BY conv_id
""")
def story_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """What stands in for a story that a model failed to write: here the longest turns first."""
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("query_id"), F.length("text").alias("score"), F.struct("turn", "text").alias("place"), F.col("text").alias("content"))
    return I.story_fallback(c).withColumn("story", F.md5("story"))


@query("""
WITH s AS (SELECT l_orderkey % 4 AS k, l_suppkey % 5 AS name, avg(l_quantity::DOUBLE) AS score FROM lineitem GROUP BY 1, 2),
r AS (SELECT k AS judge, list(name ORDER BY score DESC, name) AS r FROM s GROUP BY k)
SELECT x.judge AS a, y.judge AS b, x.r = y.r AS same_order, x.r[1] = y.r[1] AS same_first FROM r x JOIN r y ON x.judge < y.judge
""")
def rank_agreement(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "lineitem").groupBy((F.col("l_orderkey") % 4).alias("judge"), (F.col("l_suppkey") % 5).alias("name")).agg(F.avg(F.col("l_quantity").cast("double")).alias("score"))
    return I.rank_agreement(s)


@query("""
WITH s AS (SELECT l_linestatus AS grp, l_returnflag AS arm, l_suppkey AS unit, avg(l_quantity::DOUBLE) AS score FROM lineitem GROUP BY 1, 2, 3),
m AS (SELECT a.grp, a.arm, a.score, b.score AS base FROM s a JOIN s b ON a.grp = b.grp AND a.unit = b.unit AND b.arm = 'N' WHERE a.arm <> 'N'
  UNION ALL SELECT NULL, NULL, NULL, NULL WHERE false)
SELECT grp, arm, count(*) AS n, round(avg(score), 6) AS mean, round(avg(score - base), 6) AS mean_diff, round(avg(score) / avg(base), 6) AS kept FROM m GROUP BY grp, arm
""")
def arm_retention(spark: SparkSession, sf: str) -> DataFrame:
    keys = [F.col("l_linestatus").alias("grp"), F.col("l_returnflag").alias("arm"), F.col("l_suppkey").alias("unit")]
    s = table(spark, sf, "lineitem").groupBy(*keys).agg(F.avg(F.col("l_quantity").cast("double")).alias("score"))
    return I.retention(s, "N").select("grp", "arm", "n", *[F.round(c, 6).alias(c) for c in ("mean", "mean_diff", "kept")])


@query("SELECT label, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents)::DOUBLE, 6) AS share FROM (SELECT unnest([lang, source]) AS label FROM documents) GROUP BY label")
def label_shares(spark: SparkSession, sf: str) -> DataFrame:
    return I.label_shares(table(spark, sf, "documents").select(F.array("lang", "source").alias("l")), "l").withColumn("share", F.round("share", 6))


@query(r"""
WITH wanted AS (SELECT list_distinct(list(w ORDER BY item_id, k)) AS e FROM (
    SELECT item_id, generate_subscripts(w, 1) AS k, unnest(w) AS w FROM (SELECT item_id, regexp_extract_all(text, '[A-Za-z]{5,}') AS w FROM benchmark WHERE item_id = (SELECT min(item_id) FROM benchmark WHERE regexp_matches(text, '[A-Za-z]{5,}'))))),
e AS (SELECT unnest(e) AS name FROM wanted),
g AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(CASE WHEN doc_id % 2 = 1 THEN translate(text, 'oiea', '0134') ELSE text END, '[A-Za-z0-9]+'))) AS given FROM documents),
pl AS (SELECT *, regexp_replace(translate(lower(given), '01345789', 'oieastbg'), '[^a-z0-9]', '', 'g') AS p FROM g),
pe AS (SELECT name, regexp_replace(translate(lower(name), '01345789', 'oieastbg'), '[^a-z0-9]', '', 'g') AS p FROM e),
same AS (SELECT doc_id, name FROM g JOIN e ON given = name),
rest AS (SELECT x.* FROM (SELECT doc_id, name, pe.p FROM documents CROSS JOIN pe) x ANTI JOIN same ON same.doc_id = x.doc_id AND same.name = x.name),
spare AS (SELECT pl.* FROM pl ANTI JOIN same ON same.doc_id = pl.doc_id AND same.name = pl.given),
like_ AS (SELECT r.doc_id, r.p, least(count(DISTINCT r.name), count(DISTINCT s.given)) AS n FROM rest r JOIN spare s ON r.doc_id = s.doc_id AND r.p = s.p GROUP BY ALL)
SELECT d.doc_id, coalesce(a.n, 0)::BIGINT AS exact, coalesce(b.n, 0)::BIGINT AS plain FROM documents d
LEFT JOIN (SELECT doc_id, count(*) AS n FROM same GROUP BY doc_id) a USING (doc_id) LEFT JOIN (SELECT doc_id, sum(n) AS n FROM like_ GROUP BY doc_id) b USING (doc_id)
""")
def name_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """The words of every text as given names, with digits for letters in every other text; the words of the first benchmark item are
    expected. How many of them each text has as they are, and how many by their plain names."""
    long = F.regexp_extract_all("text", F.lit("[A-Za-z]{5,}"), F.lit(0))
    first = table(spark, sf, "benchmark").filter(F.size(long) > 0).orderBy("item_id").select(F.array_distinct(long).alias("e")).first()
    given = F.array_distinct(F.regexp_extract_all(F.when(F.col("doc_id") % 2 == 1, F.translate("text", "oiea", "0134")).otherwise(F.col("text")), F.lit("[A-Za-z0-9]+"), F.lit(0)))
    words = table(spark, sf, "documents").select("doc_id", F.posexplode(given).alias("pos", "given"))
    found = I.aligned(words, ["doc_id"], first["e"] if first else [], least=2.0).groupBy("doc_id")
    counts = found.agg(F.count_if(F.col("level") == 1).alias("exact"), F.count_if(F.col("level") == 2).alias("plain"))
    return table(spark, sf, "documents").select("doc_id").join(counts, "doc_id", "left").na.fill(0, ["exact", "plain"])


_SIGNAL = R.TIME_SIGNAL.replace("'", "''")


@query(f"""
WITH t AS (SELECT event_id, concat(month(ts), '月', CASE event_id % 3 WHEN 0 THEN '昨天' WHEN 1 THEN month(ts) || '月' ELSE '' END) AS t FROM events)
SELECT event_id, len(list_distinct(regexp_extract_all(t, '{_SIGNAL}'))) >= 2 AS dated FROM t
""")
def temporal_signals(spark: SparkSession, sf: str) -> DataFrame:
    month = F.concat(F.month("ts"), F.lit("月"))
    t = F.concat(month, F.when(F.col("event_id") % 3 == 0, "昨天").when(F.col("event_id") % 3 == 1, month).otherwise(""))
    return table(spark, sf, "events").select("event_id", R.has_temporal_signal(t).alias("dated"))


@query("SELECT conv_id, turn, length(text) > 900 OR turn % 3 = 0 AS maintain FROM conversations")
def triage(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("turn") % 3
    answer = F.when(k == 0, "Maintenance is NEEDED.").when(k == 1, "not needed")
    return table(spark, sf, "conversations").select("conv_id", "turn", R.should_maintain(F.col("text"), answer).alias("maintain"))


@query("""
WITH u AS (SELECT user_id, event_id % 900 + 10 AS i, event_id % 70 AS o, CASE event_id % 3 WHEN 0 THEN event_id % 2000 ELSE 0 END AS c FROM events)
SELECT user_id, sum(i)::BIGINT AS input, sum(o)::BIGINT AS output, sum(least(c, i))::BIGINT AS cached, sum(i - least(c, i))::BIGINT AS missed, sum(i + o)::BIGINT AS total FROM u GROUP BY user_id
""")
def token_usage(spark: SparkSession, sf: str) -> DataFrame:
    """Usage of call records that name their counts in three ways."""
    e = F.col("event_id")
    i, o = (e % 900 + 10).cast("string"), (e % 70).cast("string")
    call = (
        F.when(e % 3 == 0, F.concat(F.lit('{"usage": {"prompt_tokens": '), i, F.lit(', "completion_tokens": '), o, F.lit(', "prompt_tokens_details": {"cached_tokens": '), (e % 2000).cast("string"), F.lit("}}}")))
        .when(e % 3 == 1, F.concat(F.lit('{"usage": {"input_tokens": '), i, F.lit(', "output_tokens": '), o, F.lit("}}")))
        .otherwise(F.concat(F.lit('{"usage": {"prompt_tokens": '), i, F.lit(', "completion_tokens": '), o, F.lit(', "prompt_cache_hit_tokens": 0}}')))
    )
    found = table(spark, sf, "events").select("user_id", *[c.alias(k) for k, c in R.usage(call).items()])
    return found.groupBy("user_id").agg(*[F.sum(c).alias(c) for c in ("input", "output", "cached", "missed", "total")])


@query("SELECT event_id, event_id % 4 <> 3 AS parsed, CASE WHEN event_id % 4 <> 3 THEN 'n' || event_id END AS target, CASE event_id % 4 WHEN 3 THEN NULL ELSE event_type END AS content FROM events")
def op_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Operations in model answers, with and without a fence, and answers that are none."""
    e = F.col("event_id")
    ops = F.concat(F.lit('{"node_ops": [{"action": "update", "target_id": "n'), e, F.lit('", "content": "'), "event_type", F.lit('"}]}'))
    answer = F.when(e % 4 == 0, ops).when(e % 4 == 1, F.concat(F.lit("```json\n"), ops, F.lit("\n```"))).when(e % 4 == 2, F.concat(F.lit("```\n"), ops, F.lit("\n```"))).otherwise("sorry")
    found = R.parse_ops(answer, "node_ops array<struct<action:string,target_id:string,content:string>>")["node_ops"]
    return table(spark, sf, "events").select("event_id", found.isNotNull().alias("parsed"), F.get(found, 0)["target_id"].alias("target"), F.get(found, 0)["content"].alias("content"))


@query("""
WITH n AS (SELECT text, lang AS title, min(doc_id) AS note_id FROM documents WHERE doc_id % 2 = 0 GROUP BY text, lang)
SELECT d.doc_id, n.note_id, CASE WHEN trim(coalesce(d.text, '')) = '' THEN 'empty text' WHEN length(d.text) > 4000 THEN 'text too long' END AS reject_reason
FROM documents d LEFT JOIN n ON n.text = d.text AND n.title = d.lang
""")
def note_reuse(spark: SparkSession, sf: str) -> DataFrame:
    """Documents proposed as notes, where those of even number are stored already."""
    d = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("title"), "text", F.array("source").alias("tags"))
    stored = d.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("note_id"), "title", "text", F.array().cast("array<string>").alias("tags"))
    return K.new_notes(stored, d.withColumn("tags", F.array().cast("array<string>"))).select("doc_id", "note_id", "reject_reason")


@query(f"SELECT event_id, '[' || event_type || '] ' || CASE WHEN event_id % 2 = 0 THEN strftime(make_timestamp({_MS} * 1000), '%Y-%m-%d') || ' ' ELSE '' END || user_id AS line FROM events")
def evidence_lines(spark: SparkSession, sf: str) -> DataFrame:
    ms = F.when(F.col("event_id") % 2 == 0, F.col("ms"))
    return events(spark, sf).select("event_id", evidence_node(F.col("event_type"), F.col("user_id").cast("string"), ms).alias("line"))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '…(' || length(text) || ')' ELSE text END AS shown FROM documents")
def log_previews(spark: SparkSession, sf: str) -> DataFrame:
    from tessera.sources.graph_io import summarise

    return table(spark, sf, "documents").select("doc_id", summarise(F.col("text")).alias("shown"))


@query("SELECT conv_id, string_agg(role, ' ' ORDER BY turn, role) AS purposes FROM conversations GROUP BY conv_id")
def purpose_texts(spark: SparkSession, sf: str) -> DataFrame:
    from tessera.functions.models import purpose_text

    said = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda r: r["role"])
    return table(spark, sf, "conversations").groupBy("conv_id").agg(said.alias("p")).select("conv_id", purpose_text(F.col("p")).alias("purposes"))


@query(r"""
WITH n AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'con' WHEN 1 THEN 'user_' || user_id ELSE 'a/b' || user_id END AS u FROM events)
SELECT event_id, CASE WHEN u = 'con' THEN '%63on' ELSE replace(u, '/', '%2F') END AS folder FROM n
""")
def space_folders(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id") % 3
    u = F.when(k == 0, "con").when(k == 1, F.concat(F.lit("user_"), "user_id")).otherwise(F.concat(F.lit("a/b"), "user_id"))
    return table(spark, sf, "events").select("event_id", T.space_dirname(u).alias("folder"))


#: Rounds of a conversation: the events of a user; twelve hours without one are idle.
_ROUNDS_SQL = "r AS (SELECT user_id AS conv_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS round, ts, event_type || ' ' || coalesce(props, '') AS text FROM events)"
_IDLE = 43_200


def _talk(spark: SparkSession, sf: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return table(spark, sf, "events").select(F.col("user_id").alias("conv_id"), place.alias("round"), "ts", F.concat("event_type", F.lit(" "), F.coalesce("props", F.lit(""))).alias("text"))


@query(f"""WITH {_ROUNDS_SQL},
m AS (SELECT *, CASE WHEN n IS NULL THEN 'end' WHEN n > {_IDLE * 1_000_000} THEN 'idle' END AS mark FROM (SELECT *, epoch_us(lead(ts) OVER (PARTITION BY conv_id ORDER BY round)) - epoch_us(ts) AS n FROM r)),
p AS (SELECT *, count(mark) OVER (PARTITION BY conv_id ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS part FROM m),
f AS (SELECT *, CASE WHEN part >= 3 AND row_number() OVER (PARTITION BY conv_id, part ORDER BY round) % 6 = 0 THEN 'size' ELSE mark END AS reason FROM p),
k AS (SELECT *, count(reason) OVER (PARTITION BY conv_id ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 AS flush FROM f)
SELECT conv_id, flush, max(reason) AS reason, count(*) AS n, min(round) AS first, max(round) AS last, md5(string_agg(md5(text), '' ORDER BY round)) AS texts FROM k GROUP BY conv_id, flush HAVING max(reason) IS NOT NULL""")
def conversation_buffers(spark: SparkSession, sf: str) -> DataFrame:
    """What each flush of each conversation takes: the batch twin of the stream."""
    from tessera.streaming import buffers as B
    from tessera.streaming.sessions import flush_reasons

    r = _talk(spark, sf)
    return B.buffers(r, flush_reasons(r, _IDLE))


@query(f"""WITH RECURSIVE a AS (SELECT DISTINCT user_id AS key, epoch_us(ts) // 1000 AS seen FROM events), g AS (SELECT key, seen, lead(seen) OVER (PARTITION BY key ORDER BY seen) AS next FROM a),
l AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seen) AS k FROM g WHERE next IS NULL OR next - seen > {_IDLE * 1000}),
s AS (SELECT key, k, next, seen + {_IDLE * 1000} AS start, 0::BIGINT AS before FROM l WHERE k = 1
  UNION ALL SELECT l.key, l.k, l.next, greatest(l.seen + {_IDLE * 1000}, CASE WHEN last > 0 THEN last + 172800000 ELSE 0 END), last
  FROM (SELECT *, CASE WHEN next IS NULL OR start < next THEN start ELSE before END AS last FROM s) s JOIN l ON l.key = s.key AND l.k = s.k + 1)
SELECT key, start AS started, CASE WHEN next < start + 600000 THEN 'aborted' ELSE 'report' END AS outcome FROM s WHERE next IS NULL OR start < next""")
def idle_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """Reviews of users without events for twelve hours, two days apart at least, ten minutes long."""
    from tessera.streaming import buffers as B

    return B.reviews(table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts")), _IDLE, 172_800, 600)


#: A service log: a line for each event, some twice, with lines of no known form among them. A third are returns, so some requests wait for ever
#: and some returns have no request.
_LOG_SQL = """line AS (SELECT event_id AS ord, CASE WHEN event_id % 29 = 0 THEN 'starting up' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') || ' [' || kind || '] space=s' || user_id % 6 || rest END AS line FROM (
    SELECT *, CASE WHEN event_type IN ('view', 'error') THEN 'request' WHEN event_type IN ('click', 'signup') THEN 'return' ELSE 'feedback' END AS kind,
      CASE WHEN event_type IN ('view', 'error') THEN ' q=' || event_id WHEN event_type IN ('click', 'signup') THEN ' candidates=' || event_id % 40 || ' abstain=' || (event_id % 9 = 0)::INT ELSE ' qa_id=' || event_id // 40 || ' score=' || event_id % 2 END AS rest FROM events)),
  e AS (SELECT ord, regexp_extract(line, '\\[(\\w+)\\]', 1) AS kind, regexp_extract(line, 'space=(\\S+)', 1) AS space, line FROM line WHERE line <> 'starting up'),
  io AS (SELECT *, sum((kind = 'return')::INT) OVER w AS t, sum((kind = 'request')::INT) OVER w AS r, row_number() OVER (PARTITION BY space ORDER BY ord) AS n FROM e WHERE kind <> 'feedback' WINDOW w AS (PARTITION BY space ORDER BY ord)),
  d AS (SELECT *, greatest(0, max(t - r) OVER (PARTITION BY space ORDER BY ord)) AS d FROM io), d2 AS (SELECT *, coalesce(lag(d) OVER (PARTITION BY space ORDER BY ord), 0) AS before FROM d),
  pairs AS (SELECT q.space, q.ord AS request, a.ord AS answer FROM (SELECT space, ord, r AS k FROM d2 WHERE kind = 'request') q LEFT JOIN (SELECT space, ord, t - d AS k FROM d2 WHERE kind = 'return' AND d = before) a USING (space, k))"""


def _log(spark: SparkSession, sf: str) -> DataFrame:
    from tessera.operators.logpairs import parse

    e, kind, i = table(spark, sf, "events"), F.col("event_type"), F.col("event_id")
    text = lambda c: c.cast("string")
    asks, answers = kind.isin("view", "error"), kind.isin("click", "signup")
    name = F.when(asks, "request").when(answers, "return").otherwise("feedback")
    rest = (
        F.when(asks, F.concat(F.lit(" q="), text(i)))
        .when(answers, F.concat(F.lit(" candidates="), text(i % 40), F.lit(" abstain="), text((i % 9 == 0).cast("int"))))
        .otherwise(F.concat(F.lit(" qa_id="), text(F.floor(i / 40)), F.lit(" score="), text(i % 2)))
    )
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" ["), name, F.lit("] space=s"), text(F.col("user_id") % 6), rest)
    return parse(e.select(i.alias("ord"), F.when(i % 29 == 0, "starting up").otherwise(line).alias("line")))


@query(f"WITH {_LOG_SQL} SELECT space, request, answer FROM pairs")
def log_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Requests of the log with their returns, in ranges of a thousand lines."""
    from tessera.operators.logpairs import pair

    return pair(_log(spark, sf), 1000)


@query(f"""WITH {_LOG_SQL}, s AS (SELECT p.space, count(*) AS requests, count(answer) AS answered, avg(regexp_extract(e.line, 'candidates=(\\d+)', 1)::DOUBLE) AS mean_candidates, count(*) FILTER (e.line LIKE '%abstain=1') AS abstained
    FROM pairs p LEFT JOIN e ON e.ord = p.answer GROUP BY p.space),
  f AS (SELECT space, count(*) AS feedback, avg(score) AS mean_score FROM (SELECT space, regexp_extract(line, 'qa_id=(\\S+)', 1) AS qa, arg_min(regexp_extract(line, 'score=(\\S+)', 1)::DOUBLE, ord) AS score FROM e WHERE kind = 'feedback' GROUP BY 1, 2) GROUP BY space)
  SELECT s.space, requests, answered, round(mean_candidates, 6) AS mean_candidates, abstained, coalesce(feedback, 0) AS feedback, round(mean_score, 6) AS mean_score FROM s LEFT JOIN f USING (space)""")
def log_metrics(spark: SparkSession, sf: str) -> DataFrame:
    from tessera.operators.logpairs import pair, search_metrics

    log = materialize(_log(spark, sf), "log")
    return search_metrics(log, pair(log, 1000)).select("space", "requests", "answered", F.round("mean_candidates", 6).alias("mean_candidates"), "abstained", "feedback", F.round("mean_score", 6).alias("mean_score"))


@query("""WITH RECURSIVE m AS (SELECT conv_id AS space, turn, length(coalesce(text, '')) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn, length(coalesce(text, ''))) AS r FROM conversations WHERE turn % 5 <> 4),
  w AS (SELECT space, turn, r, 0 AS batch, 1 AS k, n AS c FROM m WHERE r = 1 UNION ALL
    SELECT m.space, m.turn, m.r, CASE WHEN w.k >= 6 OR w.c + m.n > 1500 THEN w.batch + 1 ELSE w.batch END, CASE WHEN w.k >= 6 OR w.c + m.n > 1500 THEN 1 ELSE w.k + 1 END, CASE WHEN w.k >= 6 OR w.c + m.n > 1500 THEN m.n ELSE w.c + m.n END
    FROM w JOIN m ON m.space = w.space AND m.r = w.r + 1),
  t AS (SELECT space, max(batch) + 1 AS total FROM w GROUP BY space), ok AS (SELECT space FROM t WHERE total * 20.0 / 60 <= 1.0)
  SELECT space, batch, count(*) AS n, sum(length(c.text))::BIGINT AS chars FROM w JOIN ok USING (space) JOIN conversations c ON c.conv_id = w.space AND c.turn = w.turn GROUP BY space, batch""")
def backfill_groups(spark: SparkSession, sf: str) -> DataFrame:
    """All conversations built in groups, each fifth message a document, spaces of more than three groups over the budget."""
    import uuid

    from tessera.operators.backfill import backfill
    from tessera.session import shared_dir
    from tessera.sources.versions import Store

    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("space"), F.col("turn").cast("long").alias("pos"), F.when(F.col("turn") % 5 == 4, "doc").otherwise("conv").alias("channel"), "text")
    store = Store(spark, f"{shared_dir(spark)}/tessera-backfill-{uuid.uuid4().hex[:12]}")
    backfill(store, c, lambda rows: rows.groupBy("space", "batch").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")), 2, budget_minutes=1.0)
    return store.read("built")
