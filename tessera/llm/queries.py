"""The numbered queries of this subpackage: each applies its operator to the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import materialize, table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.sharding import shard

    return shard(table(spark, sf_dir, "documents"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.chat import digests, format_turns, read_turns, text_parts

    plain = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], plain.schema)
    messages = plain.unionByName(extra).select("conv_id", "turn", "role", text_parts(F.col("text")).alias("parts"))
    return digests(read_turns(format_turns(messages)))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.langid import fit, held_out, identify

    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.common import Members
    from tessera.llm.lm_scoring import fit_corpus, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    good = materialize(table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id").distinct(), "good")
    return score(docs, fit_corpus(docs, members=Members(docs, good, "doc_id")))


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.ann import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.line_dedup import line_dedup

    return line_dedup(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessera.llm.best_fit import pack_best_fit

    return pack_best_fit(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.fill_middle import fill_in_middle, restore

    made = fill_in_middle(table(spark, sf_dir, "documents"))
    restored = restore(F.col("output"), F.col("form"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored).alias("restored_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.hard_negatives import mine

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


QUERIES = {f.__name__: f for f in (op1_mixing, op2_exact_dedup, op3_sharding, op4_chat, op5_langid, op6_ann, op7_packing, op8_line_dedup, op9_simhash, op10_lm_scoring, op11_best_fit, op12_fill_middle, op13_hard_negatives)}

# The mix in one plain window per source; MD5 gives both engines the same u.
_OP1 = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 't' ELSE 's' || source END AS sk,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, length(text) AS n,
         (('0x' || substr(md5(doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
k AS (SELECT *, -ln(u) / coalesce(0.5 + 0.5 / (1.0 + abs(n / greatest(size, 1) - 6.0) / 6.0), 0.5) AS key FROM d),
s AS (SELECT sk, sum(size)::BIGINT AS source_size FROM k GROUP BY sk),
w AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY sk) - 1) % 3 + 1)::INT]::DOUBLE AS w, source_size * 2.0::DOUBLE AS most FROM s),
l AS (SELECT *, row_number() OVER o AS place,
        (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
        / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM w WINDOW o AS (ORDER BY most / w, sk)),
f AS (SELECT arg_min(level, place) AS level FROM l WHERE most > level * w),
t AS (SELECT sk, source_size, least(most, coalesce(f.level * w, most)) AS target FROM l LEFT JOIN f ON true),
r AS (SELECT k.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs,
        coalesce(sum(size) OVER (PARTITION BY k.sk ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM k JOIN t ON k.sk = t.sk)
SELECT doc_id, size, source_size, target,
       (size * (epochs + CASE WHEN size > 0 AND before + size / 2.0::DOUBLE <= target - epochs * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""
_OP2 = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM n WINDOW g AS (PARTITION BY text_sha256)
"""
_OP4 = r"""
WITH m AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e AS (SELECT *, length('### ' || role || chr(10) || regexp_replace(text, '\\|### |</turn>|<\|', '\\\0', 'g') || '</turn>' || chr(10)) AS chars FROM m)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
# Lines as a list, cut by list slices.
_OP12 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
l AS (SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS lines,
             [('0x' || substr(h, 1, 8))::BIGINT, ('0x' || substr(h, 9, 8))::BIGINT, ('0x' || substr(h, 17, 8))::BIGINT, ('0x' || substr(h, 25, 8))::BIGINT] AS r FROM d),
c AS (SELECT *, len(lines)::BIGINT AS n, least(r[1] % (len(lines) + 1), r[2] % (len(lines) + 1)) AS a, greatest(r[1] % (len(lines) + 1), r[2] % (len(lines) + 1)) AS b,
             CASE WHEN text = '' OR text LIKE '%<P>%' OR text LIKE '%<S>%' OR text LIKE '%<M>%' OR r[3] % 100 >= 100 THEN 'plain' WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM l),
p AS (SELECT *, array_to_string(lines[1:a], '') AS pre, array_to_string(lines[a + 1:b], '') AS mid, array_to_string(lines[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
# All products.
_OP13 = r"""
WITH e AS (
  SELECT row_number() OVER () AS id, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.id AS a, b.id AS b, a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.id <> b.id AND len(a.v) = len(b.v) WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, other_id, b) <= 5),
n AS (
  SELECT p.anchor_id, p.other_id AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.other_id, s.b) AS rank,
         s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT * FROM n WHERE rank <= 3
"""

ORACLE = {"op13_hard_negatives": _OP13, "op12_fill_middle": _OP12, "op4_chat": _OP4, "op1_mixing": _OP1, "op2_exact_dedup": _OP2}
