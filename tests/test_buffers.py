"""Buffers and reviews as streams, over restarts, against their batch twins."""

from __future__ import annotations

import datetime as dt
import random
from collections import defaultdict

import pytest

from tessera.streaming import buffers as B
from tessera.streaming import sessions as S

DDL = "conv_id string, ts timestamp, ord long, kind string, text string, meaningful boolean"
START = dt.datetime(2024, 1, 1)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def streamed(spark, tmp_path, make, ddl, parts):
    """What a stream over several files gives; it is stopped and started anew after each."""
    out = str(tmp_path / "out")
    for part in parts:
        spark.createDataFrame(part, ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = make(spark.readStream.schema(ddl).parquet(str(tmp_path / "in"))).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(out)


def test_flush_rules(spark, tmp_path, rocks):
    rounds = lambda first, n: [("a", at(s), s, "round", f"t{s}", None) for s in range(first, first + n)]
    first = [*rounds(0, 2), ("a", at(2), 2, "session_end", None, None), *rounds(3, 1), ("a", at(4), 4, "manual", None, None)]  # the second waits: the first is under way
    second = [("a", at(5), 5, "done", None, True), ("a", at(6), 6, "done", None, True), *rounds(7, 1), ("b", at(8), 8, "round", None, None)]
    third = [*rounds(200, 1), ("a", at(201), 201, "done", None, True), *rounds(202, 5), ("a", at(600), 600, "manual", None, None), ("b", at(700), 700, "manual", None, None)]
    got = streamed(spark, tmp_path, lambda e: B.stream_buffers(e, 90, 6, 3), DDL, [first, second, third]).orderBy("conv_id", "flush").collect()
    found = [(r["conv_id"], r["flush"], r["reason"], [x["text"] for x in r["rounds"]], r["proactive"], r["passive"]) for r in got]
    assert found == [
        ("a", 1, "session_end", ["t0", "t1"], 0, 1),
        ("a", 2, "proactive", ["t3"], 1, 1),  # wanted while the first was under way
        ("a", 3, "idle", ["t7"], 1, 2),
        ("a", 4, "proactive", ["t200", "t202", "t203", "t204", "t205", "t206"], 2, 2),
        ("b", 1, "idle", [None], 0, 1),
    ]


def test_stream_is_its_batch_twin(spark, tmp_path, rocks):
    rng, rows, clock = random.Random(8), [], defaultdict(float)
    for k in range(240):
        c = rng.choice("abc")
        clock[c] = max(clock[c], k) + rng.choice([1, 2, 30, 200])
        rows.append((c, at(clock[c]), k, "round", f"text {k}", None))
    rows.sort(key=lambda r: r[1])
    ends = [(c, at(99_999), 10_000, "manual", None, None) for c in "abc"]
    out = streamed(spark, tmp_path, lambda e: B.stream_buffers(e, 90, 6, 3, done_at_once=True), DDL, [rows[:80], rows[80:160], [*rows[160:], *ends]]).collect()
    import hashlib

    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    got = {(r["conv_id"], r["flush"]): (r["reason"], len(r["rounds"]), md5("".join(md5(x["text"]) for x in r["rounds"]))) for r in out}
    numbered = defaultdict(int)
    table = []
    for c, ts, _, _, text, _ in rows:
        numbered[c] += 1
        table.append((c, numbered[c], ts, text))
    rounds = spark.createDataFrame(table, "conv_id string, round long, ts timestamp, text string")
    twin = {(r["conv_id"], r["flush"]): (r["reason"], r["n"], r["texts"]) for r in B.buffers(rounds, S.flush_reasons(rounds)).collect()}
    names = {"size": "proactive", "end": "idle"}
    assert got == {k: (names.get(r, r), n, t) for k, (r, n, t) in twin.items()} and {r for r, _, _ in got.values()} == {"proactive", "idle"}


def test_reviews(spark, tmp_path, rocks):
    ddl = "key string, ts timestamp"
    rng, rows = random.Random(2), []
    for key in "pq":
        now = 0
        for _ in range(60):
            now += rng.choice([5, 100, 301, 340, 800, 2500])
            rows.append((key, at(now)))
    rows.sort(key=lambda r: r[1])
    last = [("clock", at(10**6)), ("clock", at(10**6 + 10_000))]
    out = streamed(spark, tmp_path, B.stream_reviews, ddl, [rows[:40], rows[40:90], rows[90:], last[:1], last[1:]])
    got = sorted((r["key"], r["started"], r["outcome"]) for r in out.filter("key <> 'clock'").collect())
    twin = sorted((r["key"], r["started"], r["outcome"]) for r in B.reviews(spark.createDataFrame(rows, ddl)).collect())
    assert got == twin and {o for _, _, o in got} == {"aborted", "report"}
    kept = out.filter("outcome = 'report' AND key = 'p'").orderBy("started").collect()
    assert kept[-1]["kept"] == [r["started"] for r in kept][-20:]
