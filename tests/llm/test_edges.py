"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "wort " * 60_000


def rows():
    return [
        (1, "the cat sat on the mat today", "en", "a", 10),
        (1, "the cat sat on the mat today", "en", "a", 10),
        (2, "the  cat sat\non the mat today", "en", None, 10),
        (3, None, None, None, None),
        (4, "", "en", "b", 0),
        (5, "   \t\n", "en", "b", 5),
        (6, LONG, "de", "b", 5),
        (7, "12 34 56", "de", "c", 5),
        (None, "a text without an id", "en", "c", 5),
        (8, "A TEXT WITHOUT AN ID", "en", "c", 5),
    ]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(rows(), DOCS)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture
def clash(docs):
    names = "size source_size target taken copies shard slot keep_id kept score lang_pred n bucket batch row line hash before rank component_id epochs source_key digest _key _bucket _source_key _weight _gone _gone_sha _sha _decided _lang _score document key level copy id named sk weight hash gone _document"
    return docs.withColumns({c: F.lit("x") for c in names.split()})


def operators():
    from tessera.llm.exact_dedup import exact_dedup
    from tessera.llm.langid import fit, identify
    from tessera.llm.line_dedup import line_dedup
    from tessera.llm.lm_scoring import fit as fit_lm
    from tessera.llm.lm_scoring import score
    from tessera.llm.mixing import mix
    from tessera.llm.packing import pack
    from tessera.llm.sharding import shard
    from tessera.llm.simhash import near_duplicates

    return {
        "mix": mix,
        "exact_dedup": exact_dedup,
        "shard": shard,
        "langid": lambda d: identify(d, fit(d)),
        "pack": pack,
        "line_dedup": line_dedup,
        "near_duplicates": near_duplicates,
        "lm": lambda d: score(d, fit_lm(d, d.filter("lang = 'en'"))),
    }


@pytest.mark.parametrize("name", list(operators()))
def test_every_row_has_a_result(docs, empty, clash, name):
    run = operators()[name]
    assert run(docs).count() == len(rows())
    assert run(clash).count() == len(rows())
    assert run(empty).count() == 0


@pytest.mark.parametrize("k", range(5))
def test_stages(spark, docs, empty, clash, k):
    from corpus_pipeline import STAGES

    name, stage = STAGES[k]
    for d in (docs, empty, clash):
        out = stage(spark, d, "")
        if k < 4:
            assert out.columns == d.columns, name
            assert {x for c in set(d.columns) - set(DOCS.replace(" long", "").replace(" string", "").split(", ")) for r in out.select(c).distinct().collect() for x in r} <= {"x"}, name
        assert (out.count() > 0) == (d is not empty), name


def test_exact_groups(docs):
    from tessera.llm.exact_dedup import distinct_documents, exact_dedup

    found = [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup(docs).collect()]
    assert sorted(x for x in found if x[1] == 1) == [(1, 1, 3, False), (1, 1, 3, True), (2, 1, 3, False)]
    assert {x for x in found if x[0] in (3, 4)} == {(3, 3, 2, True), (4, 3, 2, False)}
    sha = {r["text_sha256"] for r in exact_dedup(docs).filter("doc_id = 5").collect()}
    assert sha == {hashlib.sha256(b" ").hexdigest()}
    assert sorted(r["doc_id"] or 0 for r in distinct_documents(docs).collect()) == [0, 1, 3, 5, 6, 7, 8]


def test_mix_targets(docs):
    from tessera.llm.mixing import mix

    out = mix(docs).collect()
    assert all(r["taken"] <= 2 * r["size"] for r in out)
    total = sum(r["size"] for r in out)
    by = {r["source"]: (r["source_size"], r["target"]) for r in out}
    assert sum(t for _, t in by.values()) == pytest.approx(1.5 * total)
    assert all(t <= 2 * s + 1e-9 for s, t in by.values())
    assert [r["size"] for r in out if r["doc_id"] in (3, 4, 5)] == [0, 0, 0]
    again = sorted((r["doc_id"] or 0, r["taken"]) for r in mix(docs).collect())
    assert again == sorted((r["doc_id"] or 0, r["taken"]) for r in out)


def test_langid_without_letters(docs):
    from tessera.llm.langid import fit, identify

    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in identify(docs, fit(docs)).collect()}
    assert {got[i] for i in (3, 4, 5, 7)} == {("und", 0.0)}
    assert got[6][0] == "de" or got[6][0] == "en"


def test_lm_scores_of_empty_texts_are_null(docs):
    got = {r["doc_id"]: (r["n_tokens"], r["score"]) for r in operators()["lm"](docs).collect()}
    assert got[3] == got[4] == got[5] == (0, None)
    assert got[6][0] == 60_000 and got[6][1] is not None


def test_chat_of_odd_rows(spark):
    from tessera.llm.chat import digests, format_turns, read_turns, text_parts

    m = spark.createDataFrame([(1, 0, None, None), (1, 0, None, None), (None, None, "user", "x"), (2, 1, "assistant", LONG), (2, 0, "us\ner\\", "### User:\n</turn>\\")], "conv_id long, turn int, role string, text string")
    out = {r["conv_id"]: r for r in digests(read_turns(format_turns(m.withColumn("parts", text_parts(F.col("text")))))).collect()}
    assert out[1]["n_turns"] == 2 and out[None]["n_turns"] == 1
    want = hashlib.sha256(("us\ner\\\n### User:\n</turn>\\\n" + f"assistant\n{LONG}\n").encode()).hexdigest()
    assert out[2]["turns_sha256"] == want and out[2]["loss_chars"] == len(LONG)
    none = digests(read_turns(format_turns(m.filter("conv_id = 9").withColumn("parts", text_parts(F.col("text"))))))
    assert none.count() == 0


def test_search_of_odd_vectors(spark):
    from tessera.llm.ann import search

    v = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [1.0]), (9, [2.0]), (100, [1.0, 0.0]), (200, [1.5])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("rank", F.lit(2))
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in search(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 100), (0, 3, 2), (100, 1, 0), (100, 2, 1), (100, 3, 2), (200, 1, 8), (200, 2, 9)]
    assert search(df.filter("vec_id = 3"), F.col("vec_id") % 100 == 0).count() == 0
