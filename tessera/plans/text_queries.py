"""Keyword, text, document-channel, routing and log queries over the provided tables, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import documents as D
from tessera.operators import keyword as K
from tessera.operators import maintenance as M
from tessera.operators import routing as R
from tessera.session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


STOP_SQL = ", ".join(f"'{w}'" for w in T.STOP)
_ASCII_SQL = "regexp_extract_all(lower(coalesce({t}, '')), '[a-z0-9_./:-]{2,}')"
#: Bigrams of Chinese runs; of a run of one character that itself.
_CJK_SQL = r"flatten([[substr(r, i, 2) FOR i IN range(1, greatest(length(r), 2))] FOR r IN regexp_extract_all(coalesce({t}, ''), '[\x{4e00}-\x{9fff}]+')])"
TOKENS_SQL = f"list_filter(list_distinct(list_concat({_ASCII_SQL}, {_CJK_SQL})), lambda x: x NOT IN ({STOP_SQL}))"
tok = lambda t: TOKENS_SQL.replace("{t}", t)
PERIODS = T.EXPLICIT_PERIODS
docs = lambda s, sf: table(s, sf, "documents")


#: What stands behind each text, so that the Chinese rules have something to do.
_TAILS = ["", " 好", "，接口超时。错误码E42", " 我们 的 数据库 版本", "x错误y码 z"]
_TAIL_SQL = "text || [" + ", ".join(f"'{t}'" for t in _TAILS) + f"][(doc_id % {len(_TAILS)} + 1)::INT]"
_NOTES_SQL = f"notes AS (SELECT doc_id AS id, lang AS title, source AS tags, {_TAIL_SQL} AS text, n_chars AS seen FROM documents)"
_ASKED_SQL = "asked AS (SELECT item_id AS query_id, text || CASE item_id % 3 WHEN 0 THEN ' 接口的错误码' WHEN 1 THEN ' 数据库 en' ELSE '' END AS text FROM benchmark)"


def notes(spark: SparkSession, sf: str) -> DataFrame:
    tail = F.get(F.array(*[F.lit(t) for t in _TAILS]), (F.col("doc_id") % len(_TAILS)).cast("int"))
    return docs(spark, sf).select(F.col("doc_id").alias("id"), F.col("lang").alias("title"), F.col("source").alias("tags"), F.concat("text", tail).alias("text"), F.col("n_chars").alias("observed_at"))


def questions(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("item_id") % 3
    tail = F.when(k == 0, " 接口的错误码").when(k == 1, " 数据库 en").otherwise("")
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.concat("text", tail).alias("text"))


def _stored(spark: SparkSession):
    """An index in a folder of its own below the shared one."""
    import uuid

    from tessera.session import shared_dir
    from tessera.sources.keyword_index import KeywordIndex

    return KeywordIndex(spark, f"{shared_dir(spark)}/tessera-index-{uuid.uuid4().hex[:12]}")


@query(f"WITH {_NOTES_SQL} SELECT id, len({tok('text')})::INT AS n_tokens, list_aggregate(list_sort({tok('text')}), 'string_agg', ' ') AS tokens FROM notes")
def kw_tokenize(spark: SparkSession, sf: str) -> DataFrame:
    t = T.tokens(F.col("text"))
    return notes(spark, sf).select("id", F.size(t).alias("n_tokens"), F.array_join(F.sort_array(t), " ").alias("tokens"))


_FIELDS_SQL = f"p AS (SELECT id, unnest({tok('text')}) AS term, 1 AS w FROM now UNION ALL SELECT id, unnest({tok('tags')}), 2 FROM now UNION ALL SELECT id, unnest({tok('title')}), 3 FROM now)"
_SEARCH_SQL = f"""{_FIELDS_SQL}, q AS (SELECT query_id, {tok('text')} AS terms FROM asked), e AS (SELECT query_id, len(terms) AS n, unnest(terms) AS term FROM q),
  s AS (SELECT query_id, id, round(least(1.0::DOUBLE, sum(w) / (3.0::DOUBLE * n)), 4) AS score FROM e JOIN p USING (term) GROUP BY query_id, id, n),
  r AS (SELECT s.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, coalesce(seen, 0) DESC, id) AS place FROM s JOIN now USING (id))
  SELECT query_id, id, score, place::INT AS place FROM r WHERE place <= 8"""


@query(f"WITH {_NOTES_SQL}, now AS (SELECT * FROM notes), {_FIELDS_SQL} SELECT term, count(*) AS n FROM p GROUP BY term")
def kw_postings(spark: SparkSession, sf: str) -> DataFrame:
    """How many postings each term has in the stored index."""
    index = _stored(spark)
    index.add(notes(spark, sf))
    return index.statistics()


@query(f"WITH {_NOTES_SQL}, now AS (SELECT * FROM notes), {_ASKED_SQL}, {_SEARCH_SQL}")
def kw_search(spark: SparkSession, sf: str) -> DataFrame:
    """All questions against the stored index, which is written first."""
    index = _stored(spark)
    index.add(notes(spark, sf))
    return index.search(questions(spark, sf))


_NOW_SQL = "now AS (SELECT id, title, tags, CASE WHEN id % 7 = 0 THEN 'replaced ' || text ELSE text END AS text, CASE WHEN id % 7 = 0 THEN seen + 1 ELSE seen END AS seen FROM notes WHERE id % 11 <> 0 OR id % 77 = 0)"


@query(f"WITH {_NOTES_SQL}, {_NOW_SQL}, {_ASKED_SQL}, {_SEARCH_SQL}")
def kw_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """The stored index after changes: two thirds of the notes, then the others, some removed, some replaced (removed ones come back)."""
    index, all_ = _stored(spark), notes(spark, sf)
    index.add(all_.filter("id % 3 <> 0"))
    index.add(all_.filter("id % 3 = 0"))
    index.remove(all_.filter("id % 11 = 0").select("id"))
    index.add(all_.filter("id % 7 = 0").select("id", "title", "tags", F.concat(F.lit("replaced "), "text").alias("text"), (F.col("observed_at") + 1).alias("observed_at")))
    return index.search(questions(spark, sf))


@query("""WITH c AS (SELECT doc_id, text, length(text) AS n, substr(text, 1, 1200) AS cut FROM documents), e AS (SELECT *, length(regexp_extract(cut, '(?s)^(.*[。！？；\n.!?;])', 1)) AS p FROM c)
  SELECT doc_id, CASE WHEN n <= 1200 THEN text WHEN p - 1 >= 1000 AND p < 1200 THEN rtrim(substr(cut, 1, p)) || '…' ELSE substr(rtrim(cut), 1, 1199) || '…' END AS short FROM e""")
def truncate_for_return(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", T.truncate(F.col("text"), 1200).alias("short"))


_LANGUAGE = r"""
WITH given AS (SELECT doc_id, text || repeat('好', (doc_id % 7 * length(text) // 40)::INT) AS t FROM documents),
n AS (SELECT doc_id, len(regexp_extract_all(t, '[\x{4e00}-\x{9fff}]')) AS c, len(regexp_extract_all(t, '[A-Za-z]')) AS l FROM given)
SELECT doc_id, CASE WHEN c > 0 AND c / (c + l) >= 0.10 THEN 'Chinese' ELSE 'English' END AS language FROM n
"""


@query(_LANGUAGE)
def language_guess(spark: SparkSession, sf: str) -> DataFrame:
    """The documents with Chinese characters added, none to six for each forty others, on both sides of the tenth that decides."""
    t = F.concat("text", F.repeat(F.lit("好"), F.floor(F.col("doc_id") % 7 * F.length("text") / 40).cast("int")))
    return docs(spark, sf).select("doc_id", T.language(t).alias("language"))


#: Look-around is not in this SQL: the digit runs of a text are taken apart, judged and put together again.
_REDACTED = r"""
WITH given AS (
  SELECT doc_id, text || CASE doc_id % 4 WHEN 0 THEN ' 13912345678, 23912345678 @12345' WHEN 1 THEN ' x.y+z@mail-a.org.cn @bob @1234567 12345678' ELSE '' END AS t
  FROM documents),
mail AS (SELECT doc_id, regexp_replace(t, '[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.]+', '***@***', 'g') AS t FROM given),
mobile AS (SELECT doc_id, list_aggregate(list_transform(regexp_extract_all(t, '[0-9]+|[^0-9]+'),
    lambda x: CASE WHEN regexp_full_match(x, '1[3-9][0-9]{9}') THEN '1**********' ELSE x END), 'string_agg', '') AS t FROM mail),
tagged AS (SELECT doc_id, regexp_replace(t, '@[0-9]{4,}', '@***', 'g') AS t FROM mobile),
digits AS (SELECT doc_id, list_aggregate(list_transform(regexp_extract_all(t, '[0-9]+|[^0-9]+'),
    lambda x: CASE WHEN regexp_full_match(x, '[0-9]{8,}') THEN '***' ELSE x END), 'string_agg', '') AS t FROM tagged)
SELECT doc_id, md5(coalesce(t, '')) AS digest FROM digits
"""


@query(_REDACTED)
def redaction(spark: SparkSession, sf: str) -> DataFrame:
    """Every document, with identifiers of all kinds added to half of them."""
    added = [" 13912345678, 23912345678 @12345", " x.y+z@mail-a.org.cn @bob @1234567 12345678", "", ""]
    t = F.concat("text", F.element_at(F.array(*[F.lit(x) for x in added]), (F.col("doc_id") % 4 + 1).cast("int")))
    return docs(spark, sf).select("doc_id", F.md5(T.redact(t)).alias("digest"))


_FEEDBACK = r"""
WITH given AS (
  SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text
    ELSE 'Streaming online QA Feedback: {"qa_id": "set1:q' || conv_id || '", "score": -' || turn || '.5, "question": "say  \"' || role || '\" twice", "method": "judge"}' END AS t
  FROM conversations)
SELECT conv_id, turn, contains(lower(t), 'streaming online qa feedback') OR contains(lower(t), 'streaming-online-feedback') AS feedback,
  CASE WHEN contains(t, '"qa_id"') THEN regexp_extract(t, '"qa_id": "([^"]*)"', 1) END AS qa_id,
  CASE WHEN contains(t, '"method"') THEN regexp_extract(t, '"method": "([^"]*)"', 1) END AS method,
  CASE WHEN contains(t, '"score"') THEN regexp_extract(t, '"score": (-?[0-9.]+)', 1) END AS score,
  CASE WHEN contains(t, '"question"') THEN replace(regexp_extract(t, '"question": "(.*)", "method"', 1), '  ', ' ') END AS question,
  NULL::VARCHAR AS predicted
FROM given
"""


@query(_FEEDBACK)
def qa_feedback(spark: SparkSession, sf: str) -> DataFrame:
    """Feedback messages told from others, with their fields; every other turn is written as one."""
    parts = [F.lit('Streaming online QA Feedback: {"qa_id": "set1:q'), "conv_id", F.lit('", "score": -'), "turn", F.lit('.5, "question": "say  \\"'), "role", F.lit('\\" twice", "method": "judge"}')]
    t = F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(F.concat(*parts))
    return table(spark, sf, "conversations").select("conv_id", "turn", T.is_feedback(t).alias("feedback"), *[c.alias(k) for k, c in T.feedback_fields(t).items()])


_WHOLE = " OR ".join(f"contains(t, '{w}')" for w in T.GLOBAL_HINTS)


@query(f"""
WITH g AS (SELECT doc_id, text || CASE doc_id % 3 WHEN 0 THEN ' 总结一下' WHEN 1 THEN ' 昨天' ELSE '' END AS t FROM documents)
SELECT doc_id, {_WHOLE} AS global_view FROM g
""")
def global_view(spark: SparkSession, sf: str) -> DataFrame:
    added = F.when(F.col("doc_id") % 3 == 0, " 总结一下").when(F.col("doc_id") % 3 == 1, " 昨天").otherwise("")
    return docs(spark, sf).select("doc_id", T.asks_for_the_whole(F.concat("text", added)).alias("global_view"))


@query()
def redaction_full(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", T.redact(F.col("text")).alias("text"))


ANCHOR = "concat(month(ts), '月', day(ts), '日')"


def _timeline(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Events as facts that point to the day they fell on: nodes and temporal edges."""
    e = table(spark, sf, "events")
    day = F.concat(F.month("ts").cast("string"), F.lit("月"), F.dayofmonth("ts").cast("string"), F.lit("日"))
    facts = e.select(F.concat(F.lit("e"), "event_id").alias("node_id"), F.col("event_id").alias("ord"), F.lit("action").alias("node_type"), F.when(F.col("event_id") % 3 == 0, F.concat("event_type", F.lit(" "), day)).when(F.col("event_id") % 3 == 1, F.concat("event_type", F.lit(" 昨天"))).otherwise(F.col("event_type")).alias("content"), F.lit(False).alias("deprecated"), (F.col("value") < 1).alias("forgotten"), day.alias("day"))
    days = facts.select("day").distinct().select(F.concat(F.lit("th"), "day").alias("node_id"), F.lit(-1).cast("long").alias("ord"), F.lit("thing").alias("node_type"), F.col("day").alias("content"), F.lit(False).alias("deprecated"), F.lit(False).alias("forgotten"))
    edges = facts.select(F.col("node_id").alias("src"), F.concat(F.lit("th"), "day").alias("dst"), F.lit("temporal").alias("rel_type"))
    return facts.drop("day").unionByName(days), edges


_TIME = f"""WITH f AS (SELECT 'e' || event_id AS node_id, event_id AS ord, {ANCHOR} AS day, CASE WHEN event_id % 3 = 0 THEN event_type || ' ' || {ANCHOR} WHEN event_id % 3 = 1 THEN event_type || ' 昨天' ELSE event_type END AS content, value < 1 AS forgotten FROM events),
  d AS (SELECT DISTINCT day FROM f), q AS (SELECT event_type AS query_id, min({ANCHOR}) AS day FROM events GROUP BY event_type)"""


@query(_TIME + """, k AS (SELECT q.query_id, 'th' || d.day AS node_id, f.node_id AS fact_id, row_number() OVER (PARTITION BY q.query_id, d.day ORDER BY f.ord) AS place, f.content, d.day FROM q JOIN d ON d.day = q.day JOIN f ON f.day = d.day WHERE NOT f.forgotten)
  SELECT query_id, node_id, fact_id, place::INT AS place, CASE WHEN contains(content, day) THEN true WHEN contains(content, '昨天') THEN false END AS time_consistent FROM k WHERE place <= 8""")
def temporal_anchor_facts(spark: SparkSession, sf: str) -> DataFrame:
    from tessera.operators import temporal

    nodes, edges = _timeline(spark, sf)
    e = table(spark, sf, "events")
    day = F.concat(F.month("ts").cast("string"), F.lit("月"), F.dayofmonth("ts").cast("string"), F.lit("日"))
    asked = e.groupBy(F.col("event_type").alias("query_id")).agg(F.min(day).alias("query"))
    found = temporal.anchors(nodes, edges).select("node_id", "content").withColumn("token", F.explode(T.explicit_periods(F.col("content"))))
    cands = asked.withColumn("token", F.explode(T.explicit_periods(F.col("query")))).join(found, "token").select("query_id", "query", "node_id", "content", F.lit(1).alias("place")).distinct()
    return temporal.lookup(cands, nodes, edges)[1]


@query("WITH e AS (SELECT event_id, event_type || ' ' || concat(month(ts), '月', day(ts), '日') || CASE event_id % 4 WHEN 0 THEN ' 上周三' WHEN 1 THEN ' 去年' ELSE '' END AS t FROM events) SELECT event_id, list_aggregate(list_sort(list_distinct(regexp_extract_all(t, '" + PERIODS + "'))), 'string_agg', '|') AS periods FROM e")
def period_flags(spark: SparkSession, sf: str) -> DataFrame:
    day = F.concat(F.month("ts").cast("string"), F.lit("月"), F.dayofmonth("ts").cast("string"), F.lit("日"))
    extra = F.when(F.col("event_id") % 4 == 0, " 上周三").when(F.col("event_id") % 4 == 1, " 去年").otherwise("")
    t = F.concat("event_type", F.lit(" "), day, extra)
    return table(spark, sf, "events").select("event_id", F.array_join(F.sort_array(T.explicit_periods(t)), "|").alias("periods"))


@query("""WITH h AS (SELECT i.item_id AS query_id, conv_id AS doc_id, turn AS idx, row_number() OVER (PARTITION BY i.item_id ORDER BY conv_id, turn) AS place FROM conversations c JOIN benchmark i ON c.conv_id % 40 = i.item_id % 40),
  a AS (SELECT h.query_id, h.doc_id, c.turn AS hit_at, h.place, c.turn - h.idx AS step FROM h JOIN conversations c ON c.conv_id = h.doc_id AND c.turn BETWEEN h.idx - 1 AND h.idx + 1),
  f AS (SELECT query_id, doc_id, hit_at, min((place, step)) AS f, max(CASE WHEN step = 0 THEN 1.0::DOUBLE / place END) AS score FROM a GROUP BY query_id, doc_id, hit_at)
  SELECT query_id, doc_id, hit_at AS idx, (row_number() OVER (PARTITION BY query_id ORDER BY f, doc_id, hit_at))::INT AS place, score FROM f""")
def doc_neighbour_expand(spark: SparkSession, sf: str) -> DataFrame:
    """Every turn is a hit of the items of its class; hits are ranked by conversation and turn."""
    from pyspark.sql import Window

    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("idx"))
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 40).alias("m"))
    hits = c.withColumn("m", F.col("doc_id") % 40).join(items, "m")
    hits = hits.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id", "idx"))).withColumn("score", 1.0 / F.col("place"))
    return D.neighbours(hits, c, 1)


def _chunks_sql(given: str, budget: int) -> str:
    """pieces(k, i, piece) of the CTE `given` (k, t), cut as documents.split_text does, one cut at a step, without blank ones."""
    half = budget // 2
    ends = rf"greatest(length(regexp_extract(h, '(?s)^(.*[。！？!?；;\n])', 1)), length(regexp_extract(h, '(?s)^(.*\.)(?:\s|$)', 1)))"
    at = rf"CASE WHEN {ends} >= {half} THEN {ends} WHEN length(regexp_extract(h, '(?s)^(.*\s)', 1)) >= {half} THEN length(regexp_extract(h, '(?s)^(.*\s)', 1)) ELSE {budget} END"
    return f"""cut(k, i, t, piece) AS (SELECT k, -1, t, NULL::VARCHAR FROM {given} WHERE t <> '' UNION ALL
  SELECT k, i + 1, substr(t, n + 1), substr(t, 1, n) FROM (SELECT k, i, t, CASE WHEN length(t) <= {budget} THEN length(t) ELSE {at} END AS n FROM (SELECT *, substr(t, 1, {budget}) AS h FROM cut WHERE t <> ''))),
  pieces AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY i) - 1 AS i, piece FROM cut WHERE i >= 0 AND regexp_replace(piece, '\\s', '', 'g') <> '')"""


@query(f"""WITH RECURSIVE given AS (SELECT doc_id AS k, coalesce(text, '') AS t FROM documents), {_chunks_sql('given', 1800)}
  SELECT k AS doc_id, k || 'c' || lpad(i::VARCHAR, 4, '0') AS chunk_id, i::INT AS idx, (count(*) OVER (PARTITION BY k))::INT AS total, piece AS text FROM pieces""")
def doc_chunks(spark: SparkSession, sf: str) -> DataFrame:
    m = docs(spark, sf).select("doc_id", F.lit(0).alias("msg_index"), F.col("text").alias("content"))
    return D.chunks(m)


@query("SELECT conv_id, CASE WHEN n = 0 THEN 'noise' WHEN n <= 2 AND m >= 10000 THEN 'document' ELSE 'conversation' END AS shape, n AS texts FROM (SELECT conv_id, count(*) FILTER (length(trim(coalesce(text, ''))) > 0) AS n, avg(length(text)) FILTER (length(trim(coalesce(text, ''))) > 0) AS m FROM (SELECT conv_id, text FROM conversations UNION ALL SELECT -1 - doc_id, text FROM documents) GROUP BY conv_id)")
def batch_shape(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").select("conv_id", "text").union(docs(spark, sf).select((-1 - F.col("doc_id")).alias("conv_id"), "text"))
    return R.batch_shape(c)


@query("SELECT CASE WHEN role NOT IN ('user', 'assistant') THEN 'role' WHEN trim(coalesce(text, '')) = '' THEN 'empty' ELSE 'accepted' END AS verdict, count(*) AS n FROM conversations GROUP BY 1")
def message_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    return M.quarantine(table(spark, sf, "conversations")).groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH RECURSIVE m AS (SELECT conv_id, turn, length(coalesce(text, '')) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn, length(coalesce(text, ''))) AS r FROM conversations),
  w AS (SELECT conv_id, turn, r, 0 AS batch, 1 AS k, n AS c FROM m WHERE r = 1 UNION ALL
    SELECT m.conv_id, m.turn, m.r, CASE WHEN w.k >= 6 OR w.c + m.n > 1500 THEN w.batch + 1 ELSE w.batch END, CASE WHEN w.k >= 6 OR w.c + m.n > 1500 THEN 1 ELSE w.k + 1 END, CASE WHEN w.k >= 6 OR w.c + m.n > 1500 THEN m.n ELSE w.c + m.n END
    FROM w JOIN m ON m.conv_id = w.conv_id AND m.r = w.r + 1) SELECT conv_id, turn, batch FROM w""")
def message_batches(spark: SparkSession, sf: str) -> DataFrame:
    return R.pack_batches(table(spark, sf, "conversations"))


@query("""WITH c AS (SELECT conv_id, turn, text, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM conversations)
  SELECT conv_id, string_agg(substr(text, 1, (800 - b)::INT), '' ORDER BY turn) AS sample FROM c WHERE b < 800 GROUP BY conv_id""")
def route_sample(spark: SparkSession, sf: str) -> DataFrame:
    return R.running_sample(table(spark, sf, "conversations"), "conv_id", ["turn"], 800)


@query("SELECT conv_id, string_agg('[' || role || '] ' || text, chr(10) ORDER BY turn) AS content FROM conversations GROUP BY conv_id")
def format_conversation(spark: SparkSession, sf: str) -> DataFrame:
    from tessera.functions.render import conversation

    return conversation(table(spark, sf, "conversations"))


@query("SELECT doc_id, 'story:' || substr(sha1(text), 1, 10) AS story_id FROM documents")
def story_ids(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", T.story_id(F.col("text")).alias("story_id"))


@query("WITH k AS (SELECT event_id, event_type || '|' || user_id AS rid FROM events) SELECT min(event_id) AS event_id, rid FROM k GROUP BY rid")
def request_dedup(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", F.concat_ws("|", "event_type", F.col("user_id").cast("string")).alias("rid"))
    return e.groupBy("rid").agg(F.min("event_id").alias("event_id"))


@query("""WITH log AS (SELECT event_id AS seq, CASE WHEN event_id % 10 = 0 THEN NULL ELSE user_id || ':' || event_id // 100 END AS rid, user_id AS doc_id, event_id % 97 AS msg_index, event_type AS content FROM events),
  f AS (SELECT rid, min(seq) AS s FROM log WHERE rid IS NOT NULL GROUP BY rid), k AS (SELECT l.* FROM log l LEFT JOIN f USING (rid) WHERE l.rid IS NULL OR l.seq = f.s)
  SELECT doc_id, msg_index, arg_min(content, seq) AS content, min(seq) AS seq FROM k GROUP BY doc_id, msg_index""")
def message_log_replay(spark: SparkSession, sf: str) -> DataFrame:
    rid = F.when(F.col("event_id") % 10 != 0, F.concat_ws(":", F.col("user_id").cast("string"), F.floor(F.col("event_id") / 100).cast("string")))
    log = table(spark, sf, "events").select(F.col("event_id").alias("seq"), rid.alias("rid"), F.col("user_id").alias("doc_id"), (F.col("event_id") % 97).alias("msg_index"), F.col("event_type").alias("content"))
    return M.replay_messages(log).select("doc_id", "msg_index", "content", "seq")


@query("""WITH g AS (SELECT user_id, ts, event_id, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 5400000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g) SELECT user_id, session::BIGINT AS session, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY user_id, session""")
def session_gap_batches(spark: SparkSession, sf: str) -> DataFrame:
    from tessera.streaming.sessions import gap_sessions

    return gap_sessions(table(spark, sf, "events"), "user_id", "ts", "event_id", 5400).groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("WITH m AS (SELECT user_id, max(ts) AS newest FROM events GROUP BY user_id), t AS (SELECT max(ts) AS now FROM events) SELECT user_id, newest, newest < now - INTERVAL 2 DAY AS purge FROM m, t")
def space_retention(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    now = e.agg(F.max("ts").alias("now"))
    newest = e.groupBy("user_id").agg(F.max("ts").alias("newest"))
    return newest.join(F.broadcast(now)).select("user_id", "newest", (F.col("newest") < F.col("now") - F.expr("INTERVAL 2 DAY")).alias("purge"))


@query("SELECT event_type AS op, count(*) AS n, count(*) FILTER (value < 1) AS errors, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY event_type")
def oplog_summary_by_op(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("op")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") < 1).alias("errors"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("SELECT role, count(*) AS calls, sum(length(text)) FILTER (role <> 'assistant') AS input_chars, sum(length(text)) FILTER (role = 'assistant') AS output_chars FROM conversations GROUP BY ROLLUP (role)")
def token_cost_rollup(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    return c.rollup("role").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.when(F.col("role") != "assistant", F.length("text"))).alias("input_chars"), F.sum(F.when(F.col("role") == "assistant", F.length("text"))).alias("output_chars"))


@query("""WITH r AS (SELECT user_id AS node_id, date_trunc('hour', ts) AS h FROM events), n AS (SELECT DISTINCT node_id FROM r), k AS (SELECT node_id, (epoch(h) // 3600 - (SELECT min(epoch(h) // 3600) FROM r) + 1)::BIGINT AS round FROM r),
  m AS (SELECT max(round) AS rounds FROM k), l AS (SELECT node_id, max(round) AS last FROM k GROUP BY node_id) SELECT n.node_id, (rounds - coalesce(last, 0))::BIGINT AS streak, rounds - coalesce(last, 0) >= 3 AS forgotten FROM n LEFT JOIN l USING (node_id), m""")
def orphan_rounds(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id").alias("node_id"), F.floor(F.unix_timestamp("ts") / 3600).alias("hour"))
    ends = e.agg(F.min("hour").alias("lo"), F.max("hour").alias("hi")).first()
    return M.orphan_rounds(e.select("node_id", (F.col("hour") - ends["lo"] + 1).alias("round")), e.select("node_id").distinct(), ends["hi"] - ends["lo"] + 1)


@query("""WITH d AS (SELECT doc_id, text, coalesce(quality, 1) AS q, coalesce(toxic, 0) AS t, n_chars FROM documents LEFT JOIN labels USING (doc_id))
  SELECT doc_id, CASE WHEN n_chars < 200 THEN 'triage' WHEN q = 0 THEN 'no_ops' WHEN t = 1 THEN 'no_create' WHEN n_chars % 7 = 0 THEN 'create_rejected' END AS reason FROM d""")
def fallback_reason(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left")
    ops = F.when(F.coalesce("quality", F.lit(1)) == 0, 0).otherwise(3)
    creates = F.when(F.coalesce("toxic", F.lit(0)) == 1, 0).otherwise(2)
    created = F.when(F.col("n_chars") % 7 == 0, 0).otherwise(1)
    return d.select("doc_id", M.fallback_reason(F.col("n_chars") >= 200, ops, creates, created).alias("reason"))


@query("""WITH n AS (SELECT item_id AS query_id, 'd' || doc_id AS node_id, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS rank FROM benchmark b JOIN documents d ON d.doc_id % 40 = b.item_id % 40),
  e AS (SELECT a.query_id, a.node_id AS src, b.node_id AS dst, row_number() OVER (PARTITION BY a.query_id ORDER BY a.rank) AS rank FROM n a JOIN n b ON a.query_id = b.query_id AND b.rank = a.rank + 3),
  ne AS (SELECT query_id, count(*) AS ne FROM e GROUP BY query_id), core AS (SELECT n.* FROM n LEFT JOIN ne USING (query_id) WHERE rank <= 19 - least(coalesce(ne, 0), 10)), nn AS (SELECT query_id, count(*) AS nn FROM core GROUP BY query_id),
  u AS (SELECT e.*, row_number() OVER (PARTITION BY e.query_id ORDER BY e.rank) AS place FROM e JOIN core a ON a.query_id = e.query_id AND a.node_id = e.src JOIN core b ON b.query_id = e.query_id AND b.node_id = e.dst),
  f AS (SELECT u.* FROM u JOIN nn USING (query_id) WHERE place <= 19 - nn), sp AS (SELECT nn.query_id, 19 - coalesce((SELECT count(*) FROM f WHERE f.query_id = nn.query_id), 0) AS final FROM nn)
  SELECT query_id, 'node' AS kind, node_id AS item, rank::INT AS place FROM n JOIN sp USING (query_id) WHERE rank <= final
  UNION ALL SELECT query_id, 'edge', src || '→' || dst, place::INT FROM f UNION ALL SELECT DISTINCT query_id, 'legend', 'legend', 0 FROM n""")
def evidence_budget(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 40).alias("m"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id"))
    n = docs(spark, sf).select("doc_id", (F.col("doc_id") % 40).alias("m")).join(items, "m").withColumn("rank", rank).select("query_id", F.concat(F.lit("d"), "doc_id").alias("node_id"), "rank")
    a, b = n.select("query_id", F.col("node_id").alias("src"), F.col("rank").alias("r")), n.select("query_id", F.col("node_id").alias("dst"), (F.col("rank") - 3).alias("r"))
    e = a.join(b, ["query_id", "r"]).select("query_id", "src", "dst", F.row_number().over(Window.partitionBy("query_id").orderBy("r")).alias("rank"))
    return R.evidence(n, e, 20)


_QUESTION = " A. one B. two C. three Choose the correct option."
_HEADS = ["When did", "How long was", "What", "Which", "Whose", "Where is", "Why", "Could", "In 1987 on Monday \"he\" did not know:"]


def _features_sql() -> str:
    from tessera.functions import route_features as R

    heads = ", ".join("'" + h + "'" for h in _HEADS)
    flag = lambda condition: f"({condition})::INT::DOUBLE"
    quoted = lambda pattern: "'" + pattern.replace("'", "''") + "'"
    found = lambda pattern: flag(f"regexp_matches(r, {quoted(pattern)})")
    yes_no = ", ".join(f"'{w}'" for w in "is are was were do does did can could should would will".split())
    sql = {
        "has_options": flag("k % 2 = 0"),
        "n_options": "ln(1 + (k % 2 = 0)::INT * 2)",
        "n_options_raw": "((k % 2 = 0)::INT * 2)::DOUBLE",
        "has_answer_instruction": flag("k % 3 = 0"),
        "stripped_ratio": "1 - length(r) / length(q)",
        "query_chars": "ln(1 + length(q))",
        "retrieval_chars": "ln(1 + length(r))",
        "n_tokens": "ln(1 + len(t))",
        "avg_token_len": "coalesce(list_avg(list_transform(t, lambda x: length(x))), 0)",
        "has_digit": found("[0-9]"),
        "n_digits": "ln(1 + len(regexp_extract_all(r, '[0-9]')))",
        "has_year": found(R.YEAR),
        "has_date_word": found(R.DATE_WORD),
        "has_quote": found("[\"']"),
        "proper_ratio": "len(list_filter(t, lambda x: regexp_matches(x, '^[A-Z]'))) / greatest(len(t), 1)",
        "has_negation": found(R.NEGATION),
        "is_temporal": found(R.TEMPORAL),
        **{f"is_{w}": flag(f"head = '{w}'") for w in ("when", "how", "what", "which", "where", "why")},
        "is_who": flag("head IN ('who', 'whom', 'whose')"),
        "is_yesno": flag(f"head IN ({yes_no})"),
        "is_precision_shape": flag("k % 2 = 0 OR k % 3 = 0"),
    }
    columns = ", ".join(f"round({v}, 6) AS {n}" for n, v in sql.items())
    return rf"""
WITH asked AS (SELECT doc_id AS k, [{heads}][(doc_id % {len(_HEADS)} + 1)::INT] || ' ' || text AS plain FROM documents),
q AS (SELECT k, CASE WHEN k % 3 = 0 THEN plain || '{_QUESTION}' ELSE plain END AS q,
        CASE WHEN k % 3 = 0 THEN regexp_replace(plain, '^\s+|\s+$', '', 'g') ELSE plain END AS r FROM asked),
p AS (SELECT *, regexp_extract_all(r, {quoted(R.WORD)}) AS t, lower(regexp_extract(r, '{R.HEAD}', 1)) AS head FROM q)
SELECT k AS doc_id, {columns} FROM p
"""


@query(_features_sql())
def route_features(spark: SparkSession, sf: str) -> DataFrame:
    """All features of questions made of every document: a head, the text and, for a third of them, options with an instruction."""
    from tessera.functions.route_features import features

    k = F.col("doc_id")
    head = F.element_at(F.array(*[F.lit(h) for h in _HEADS]), (k % len(_HEADS) + 1).cast("int"))
    asked = docs(spark, sf).select("doc_id", F.concat(head, F.lit(" "), "text", F.when(k % 3 == 0, _QUESTION).otherwise("")).alias("q"))
    options = F.when(k % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    found = features(F.col("q"), options, F.col("r"))
    return D.with_retrieval_text(asked, "q", "r", D.ADJOINING).select("doc_id", *[F.round(c, 6).alias(n) for n, c in found.items()])


#: Requests: every conversation, and every document as one of its own, feedback and blanks among them; a third of the spaces keep documents only.
_ADDS_SQL = """msgs AS (SELECT conv_id, turn, role, CASE WHEN (conv_id + turn) % 13 = 0 THEN 'qa_id: 7 previous search results were wrong ' || coalesce(text, '') ELSE text END AS text FROM conversations
    UNION ALL SELECT -1 - doc_id, 0, 'user', CASE WHEN doc_id % 17 = 0 THEN ' ' ELSE text END FROM documents),
  fl AS (SELECT *, FEEDBACK AS fb FROM msgs), pl AS (SELECT *, NOT fb AND row_number() OVER (PARTITION BY conv_id, fb ORDER BY turn) > 5 AS over FROM fl),
  sh AS (SELECT conv_id, CASE WHEN count(*) FILTER (length(trim(coalesce(text, ''))) > 0) = 0 THEN 'noise' WHEN conv_id % 3 = 0 OR (count(*) FILTER (length(trim(coalesce(text, ''))) > 0) <= 2
    AND avg(length(text)) FILTER (length(trim(coalesce(text, ''))) > 0) >= 10000) THEN 'document' ELSE 'conversation' END AS shape FROM pl WHERE NOT fb AND NOT over GROUP BY conv_id),
  ro AS (SELECT pl.*, CASE WHEN fb THEN 'feedback' WHEN shape <> 'conversation' THEN shape WHEN over THEN 'overflow' ELSE 'graph' END AS route FROM pl LEFT JOIN sh USING (conv_id))""".replace(
    "FEEDBACK", " OR ".join(f"contains(lower(coalesce(text, '')), '{m}')" for m in T.FEEDBACK_MARKS)
)


def _adds(spark: SparkSession, sf: str) -> DataFrame:
    """The routed messages of all requests, with a limit of five messages."""
    from tessera.operators import adds as A

    c = table(spark, sf, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    c = c.withColumn("text", F.when(F.pmod(F.col("conv_id") + F.col("turn"), F.lit(13)) == 0, F.concat(F.lit("qa_id: 7 previous search results were wrong "), F.coalesce("text", F.lit("")))).otherwise(F.col("text")))
    d = docs(spark, sf).select((-1 - F.col("doc_id")).alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.when(F.col("doc_id") % 17 == 0, " ").otherwise(F.col("text")).alias("text"))
    messages = c.unionByName(d)
    modes = messages.select("conv_id").distinct().filter("conv_id % 3 = 0").withColumn("mode", F.lit("documents"))
    return A.route(messages, modes, 5)


@query(f"""WITH RECURSIVE {_ADDS_SQL}, g AS (SELECT conv_id, turn, length(coalesce(text, '')) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn, length(coalesce(text, ''))) AS r FROM ro WHERE route = 'graph'),
  w AS (SELECT conv_id, turn, r, 0 AS batch, 1 AS k, n AS c FROM g WHERE r = 1 UNION ALL
    SELECT g.conv_id, g.turn, g.r, CASE WHEN w.k >= 6 OR w.c + g.n > 1500 THEN w.batch + 1 ELSE w.batch END, CASE WHEN w.k >= 6 OR w.c + g.n > 1500 THEN 1 ELSE w.k + 1 END, CASE WHEN w.k >= 6 OR w.c + g.n > 1500 THEN g.n ELSE w.c + g.n END
    FROM w JOIN g ON g.conv_id = w.conv_id AND g.r = w.r + 1)
  SELECT ro.conv_id, ro.turn, route, batch FROM ro LEFT JOIN w USING (conv_id, turn)""")
def add_routes(spark: SparkSession, sf: str) -> DataFrame:
    return _adds(spark, sf).select("conv_id", "turn", "route", "batch")


@query(f"""WITH RECURSIVE {_ADDS_SQL}, given AS (SELECT (conv_id, turn) AS k, role || ': ' || regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM ro WHERE route IN ('graph', 'overflow') AND regexp_replace(coalesce(text, ''), '\\s', '', 'g') <> ''),
  {_chunks_sql('given', 500)}, pl2 AS (SELECT k[1] AS conv_id, row_number() OVER (PARTITION BY k[1] ORDER BY k[2], i) - 1 AS place, piece FROM pieces), top AS (SELECT max(vec_id) AS top FROM embeddings),
  nn AS (SELECT *, 'n' || (top + row_number() OVER (ORDER BY conv_id, place)) AS node_id FROM pl2, top WHERE place < 20)
  SELECT 'node' AS kind, node_id, conv_id, place, md5(piece) AS content_md5 FROM nn UNION ALL SELECT 'overflow', NULL, conv_id, place, md5(piece) FROM pl2 WHERE place >= 20""".replace("role || ': '", "coalesce(role, '') || ': '"))
def raw_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Requests whose messages went to the graph, stored raw: 20 chunks of each as nodes that count on from the graph's, the rest as documents."""
    from tessera.operators import adds as A
    from tessera.sources import canonical as C

    talk = _adds(spark, sf).filter("route IN ('graph', 'overflow')")
    new, over = A.store_raw(talk, C.nodes(spark, sf), most=20)
    both = new.select(F.lit("node").alias("kind"), "node_id", "conv_id", "place", "content").unionByName(over.select(F.lit("overflow").alias("kind"), F.lit(None).cast("string").alias("node_id"), "conv_id", "place", "content"))
    return both.select("kind", "node_id", "conv_id", "place", F.md5("content").alias("content_md5"))
