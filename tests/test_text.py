from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.render import batch_time, conversation
from tessera.functions.route_features import NAMES, features, vectorize
from tessera.operators.documents import ADJOINING, salvage, split_text, without_options
from tessera.operators.review import causal_words


def ask(spark, expr, *values):
    df = spark.createDataFrame([(v,) for v in values], "t string")
    return [r[0] for r in df.select(expr(F.col("t"))).collect()]


def test_tokens(spark):
    got = ask(spark, T.tokens, "Use API v1.2 的 数据库 x", None, "我", "a b")
    assert [sorted(g) for g in got] == [sorted(["use", "api", "v1.2", "数据", "据库"]), [], ["我"], []]


def test_periods(spark):
    assert [sorted(x) for x in ask(spark, T.explicit_periods, "上周三和3月5日", "上周", "x")] == [sorted(["上周三", "3月5日"]), ["上周"], []]
    assert ask(spark, T.fuzzy_anchors, "前几天", None)[0] == "前天 大前天 前几天 前两天 前些天".split()
    assert sorted(ask(spark, T.era_anchors, "高二那年")[0]) == sorted("高中 高一 高二 高三".split())
    assert ask(spark, T.anchor_periods, "nothing")[0] is None


def test_time_consistency(spark):
    df = spark.createDataFrame([("昨天", "昨天去了"), ("那天", "上周三见面"), ("昨天", "明天去"), ("昨天", "去了"), ("x", "昨天")], "a string, t string")
    got = [r[0] for r in df.select(T.time_consistent(T.anchor_periods(F.col("a")), F.col("t"))).collect()]
    assert got == [True, True, False, None, None]


def test_redaction_and_evidence(spark):
    assert ask(spark, T.redact, "mail a.b@c.org tel 13912345678 @bob @12345 123456789 1234567", None) == ["mail ***@*** tel 1********** @bob @*** *** 1234567", ""]
    df = spark.createDataFrame([("he said, hi!", "He: he said hi there"), ("abc", "abc"), (None, "x")], "e string, c string")
    assert [r[0] for r in df.select(T.valid_evidence(F.col("e"), F.col("c"))).collect()] == [True, False, False]


def test_truncation(spark):
    assert ask(spark, lambda t: T.truncate(t, 10), "short", "one. two three", "abcdefghijklmnop") == ["short", "one.…", "abcdefghi…"]


def test_names_and_numbers(spark):
    assert ask(spark, T.space_dirname, "user-1_ü/x")[0] == "user-1_%C3%BC%2Fx"
    assert ask(spark, T.parse_probability, "p = 0.7", "1.4", "none") == [0.7, 1.0, None]
    assert ask(spark, T.language, "hello", "你好 world", "abcdefghijabcdefghij好", None) == ["English", "Chinese", "English", "English"]
    assert ask(spark, lambda t: T.date_of(t.cast("long")), "86400000", "-5") == ["1970-01-02", None]
    df = spark.createDataFrame([("abcd", "xabcy")], "a string, b string")
    assert df.select(T.bigram_cover(F.col("a"), F.col("b"))).first()[0] == pytest.approx(2 / 3)


def test_route_features(spark):
    df = spark.createDataFrame([("When did Ann visit in 2019?", ["a", "b"]), ("", [])], "q string, o array<string>")
    f = features(F.col("q"), F.col("o"))
    assert list(f) == NAMES and len(NAMES) == 26
    a, b = df.select(*[v.alias(k) for k, v in f.items()]).collect()
    assert a["is_when"] == a["is_temporal"] == a["has_year"] == a["has_options"] == 1 and a["is_what"] == 0 and a["n_options_raw"] == 2
    assert a["proper_ratio"] == pytest.approx(2 / 5) and sum(b.asDict().values()) == 0
    assert len(df.select(vectorize(F.array(F.lit(1.0), F.lit(2.0)), f)).first()[0]) == 28


def test_route_features_of_words_with_accents_and_adjoining_marks(spark):
    df = spark.createDataFrame([("Noña said siño", 1), ("nota casa", 0), ("el añoé2019", 1)], "q string, want int")
    f = features(F.col("q"), F.array().cast("array<string>"))
    got = df.select(f["has_negation"].alias("n"), f["has_year"].alias("y")).collect()
    assert [(r["n"], r["y"]) for r in got] == [(1, 0), (0, 0), (0, 1)]
    marks = ["It was A. A. one B. two C. three", "A. A. B. C. x"]
    assert ask(spark, lambda q: without_options(q, ADJOINING), *marks) == ["It was A.", "A."]
    assert ask(spark, causal_words, "so soñ añso therefore") == [4]


def test_chunks_join_to_the_text():
    text = "First sentence. Second one! " * 20 + "x" * 90
    for budget in (0, 10, 33, 50, 1000):
        parts = split_text(text, budget)
        assert "".join(parts) == text and (budget <= 0 or all(len(p) <= budget for p in parts))
    assert split_text(None, 5) == [] and split_text("abc. def", 6) == ["abc.", " def"]


def test_pieces_in_the_jvm_are_those_of_split_text(spark):
    import random

    from tessera.operators.documents import text_pieces

    rng, signs = random.Random(3), "ab. .\n \u3000\x1c。！?;é字😀"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(300)] + [None, "", "x" * 50, " " * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    for budget in (-1, 1, 2, 3, 7, 10, 25):
        plan = df.select("k", text_pieces(F.col("t"), budget).alias("p"))
        got = {r["k"]: r["p"] for r in plan.collect()}
        assert [k for k, t in enumerate(texts) if got[k] != [p for p in split_text(t, budget) if p.strip()]] == []
    assert "Python" not in plan._jdf.queryExecution().toString()


def test_options_and_salvage(spark):
    stem, options = "Who is right?", "A. one B. two C. three D. four"
    cases = {
        "Which?\nA. one\nB. two\nC. three": "Which?",
        "Plan A. is fine\nA. x\nB. y": "Plan A. is fine\nA. x\nB. y",
        f"{stem} {options} Choose the correct option.": stem,
        "Plan B. is (A) x (C) z (B) y (C) w": "Plan B. is (",
        " A. one B. two D. four ": "A. one B. two D. four",
        "": "",
        f"{stem} See A. of it. {options}": f"{stem} See A. of it.",
        f"{stem} {options} {stem} {options}": f"{stem} {options} {stem}",
        "A. x\u3000B. y\u00a0C. z": "",
        "\u3000问题（A）\u3000甲 （B） 乙 （C） 丙": "问题（",
    }
    df = spark.createDataFrame([*cases.items(), (None, "")], "q string, want string").withColumn("got", without_options(F.col("q")))
    assert [r for r in df.collect() if r["got"] != r["want"]] == []
    assert salvage('[{"a": "}"}, {"b": {"c": 1}}, {"d": ') == ['{"a": "}"}', '{"b": {"c": 1}}']


def test_rendering(spark):
    m = spark.createDataFrame([(1, 1, "assistant", "yes", None), (1, 0, "user", "hi", 86400000)], "conv_id int, turn int, role string, text string, ts long")
    assert conversation(m).first()["content"] == "[user@1970-01-02] hi\n[assistant] yes"
    assert batch_time(m).first()["ts"] == 86400000


def test_retrieval_text(spark):
    from tessera.operators.documents import with_retrieval_text

    q = ["Who? A. one B. two C. three Only one correct.", "Compare A. alpha, B. beta, and C. gamma", "A. one B. two C. three only one correct", "谁？ A. 一 B. 二 C. 三 请只回答选项", None]
    got = [r["retrieval"] for r in with_retrieval_text(spark.createDataFrame([(x,) for x in q], "q string"), "q").collect()]
    assert got == ["Who?", q[1], q[2], "谁？", None]
    assert ask(spark, T.has_answer_instruction, "give it enclosed in parentheses, e.g. (X)", "choose the option") == [True, False]
    assert ask(spark, T.is_feedback, "STREAMING online QA feedback: x", "feedback") == [True, False]


def test_raw_chunks_are_cut_once(spark):
    from tessera.operators.adds import store_raw

    m = spark.createDataFrame([(1, 0, "user", "One. " * 40)], "conv_id long, turn long, role string, text string")
    new, over = store_raw(m, spark.createDataFrame([("n7",)], "node_id string"), size=50, most=2)
    assert [r["node_id"] for r in new.orderBy("place").collect()] == ["n8", "n9"] and over.count() == 3
    assert all("tessera-chunks" in f for f in over.inputFiles()) and over.inputFiles()


def test_frames_count_each_cue_once(spark):
    from tessera.operators.par import compile_frame

    df = spark.createDataFrame([(["安排步骤", None, "推荐"],), (["x"],), (None,), (["推荐 选项", "寻求安慰"],)], "p array<string>").select(compile_frame(F.col("p")).alias("f"))
    assert [r["f"] for r in df.collect()] == ["plan", "neutral", "neutral", "vent"]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 3


def test_names_are_read_once(spark):
    from tessera.operators.intake import aligned

    read = spark.sparkContext.accumulator(0)

    def seen(parts):
        for part in parts:
            read.add(len(part))
            yield part

    rows = [(1, 0, "Alpha"), (1, 1, "4lph4"), (1, 2, "a-lpha"), (2, 0, None), (2, 1, "be"), (3, 0, "4LPHA"), (3, 1, "gamma")]
    given = spark.createDataFrame(rows, "k int, pos int, given string").mapInPandas(seen, "k int, pos int, given string")
    found = sorted((r["k"], r["name"], r["given"], r["level"]) for r in aligned(given, ["k"], ["Alpha", "gamma"], least=2.0).collect())
    assert found == [(1, "Alpha", "Alpha", 1), (3, "Alpha", "4LPHA", 2), (3, "gamma", "gamma", 1)] and read.value == len(rows)
