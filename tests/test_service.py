"""Log pairing, backfill and the tail source against plain loops."""

from __future__ import annotations

import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from tessera.operators import logpairs as L
from tessera.operators.backfill import backfill
from tessera.sources.versions import Store


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_pairs_against_queues(spark, size):
    rng = random.Random(size)
    rows = [(k, rng.choice(["request", "return", "return", "request", "feedback"]), rng.choice("ab")) for k in range(0, 900, 3)]
    waiting, want = defaultdict(deque), {}
    for k, kind, space in rows:
        if kind == "request":
            waiting[space].append(k)
            want[space, k] = None
        elif kind == "return" and waiting[space]:
            want[space, waiting[space].popleft()] = k
    got = L.pair(spark.createDataFrame(rows, "ord long, kind string, space string"), size).collect()
    assert {(r["space"], r["request"]): r["answer"] for r in got} == want and len(got) == len(want)


def test_lines_and_metrics(spark):
    lines = [
        "2024-01-01 00:00:00 [request] space=a q=1", "noise", "2024-01-01 00:00:01 [return] space=a candidates=4 abstain=1", "2024-01-01 00:00:02 [return] space=a candidates=9",
        "2024-01-01 00:00:03 [feedback] space=a qa_id=7 score=1", "2024-01-01 00:00:03 [feedback] space=a qa_id=7 score=0", "2024-01-01 00:00:04 [request] space=b", None,
    ]
    log = L.parse(spark.createDataFrame(list(enumerate(lines)), "ord long, line string"))
    got = {r["space"]: tuple(r)[1:] for r in L.search_metrics(log, L.pair(log)).collect()}
    assert got == {"a": (1, 1, 4.0, 1, 1, 1.0), "b": (1, 0, None, 0, 0, None)}


def spaces(spark):
    rows = [(s, p, "doc" if p % 4 == 3 else "conv", "x" * (50 + 90 * ((p + s) % 7))) for s in range(3) for p in range(20 + 10 * s)] + [(9, 0, "doc", "only a document"), (8, 0, "conv", "t")]
    return spark.createDataFrame(rows, "space int, pos long, channel string, text string")


def built(store):
    return sorted((r["space"], r["pos"], r["batch"]) for r in store.read("built").collect())


def test_backfill_goes_on_where_it_stopped(spark, tmp_path):
    messages = spaces(spark)
    whole, broken = Store(spark, f"file://{tmp_path}/whole"), Store(spark, f"file://{tmp_path}/broken")
    work = lambda rows: rows.select("space", "pos", "batch")
    backfill(whole, messages, work, step=2)
    state = {r["space"]: (r["total"], r["done"], r["status"]) for r in whole.read("progress").collect()}
    assert all(total == done and status == "done" for total, done, status in state.values()) and state[9][0] == 0
    assert {(s, p) for s, p, _ in built(whole)} == {(r["space"], r["pos"]) for r in messages.filter("channel <> 'doc'").collect()}
    calls = []

    def dies(rows):
        calls.append(1)
        if len(calls) == 2:
            return rows.select("space", "pos", F.raise_error(F.lit("lost")).cast("int").alias("batch"))
        return work(rows)

    with pytest.raises(Exception, match="lost"):
        backfill(broken, messages, dies, step=2)
    half = built(broken)
    assert 0 < len(half) < len(built(whole))
    backfill(broken, messages, work, step=2)
    assert built(broken) == built(whole)
    version = broken.manifest()["version"]
    backfill(broken, messages, work, step=2)
    assert broken.manifest()["version"] == version


def test_backfill_budget_and_cancel(spark, tmp_path):
    messages, work = spaces(spark), lambda rows: rows.select("space", "pos", "batch")
    store, asked = Store(spark, f"file://{tmp_path}/s"), []
    backfill(store, messages, work, step=1, seconds_per_group=60, budget_minutes=4.0, cancelled=lambda: len(asked) == 2 or asked.append(1))
    state = {r["space"]: (r["total"], r["done"], r["status"]) for r in store.read("progress").collect()}
    assert state[9] == (0, 0, "done") and state[8] == (1, 1, "done")
    assert all(status == "skipped" and done == (2 if total <= 4 else 0) for s, (total, done, status) in state.items() if s < 3)
    assert {b for _, _, b in built(store)} == {0, 1} or {b for _, _, b in built(store)} == {0}


def test_log_tail(spark, tmp_path):
    from tessera.streaming.tails import LogTail

    spark.dataSource.register(LogTail)
    log = tmp_path / "log"
    q = spark.readStream.format("log_tail").option("path", str(log)).load().writeStream.format("memory").queryName("tail").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        def said():
            q.processAllAvailable()
            return [r["line"] for r in spark.table("tail").collect()]

        assert said() == []
        log.write_text("one\ntwo\nhal")
        assert said() == ["one", "two"]
        with log.open("a") as f:
            f.write("f\nümlaut\r\n\n")
        assert said() == ["one", "two", "half", "ümlaut", ""]
        log.write_text("new\n")  # cut
        assert said()[5:] == ["new"]
        log.write_text("other beginning\nand more lines than before\n")  # replaced by a longer file
        assert said()[6:] == ["other beginning", "and more lines than before"]
    finally:
        q.stop()


def test_lines_over_pieces(tmp_path, monkeypatch):
    from tessera.streaming import tails

    monkeypatch.setattr(tails, "CHUNK", 7)
    log = tmp_path / "log"
    log.write_bytes(b"a\nlong line of many bytes\n\nxy\nno end")
    reader = tails.LogTailReader(str(log))
    end = reader.latestOffset()
    assert end["at"] == 30
    lines = [line for piece in reader.partitions(reader.initialOffset(), end) for _, line in reader.read(piece)]
    assert lines == ["a", "long line of many bytes", "", "xy"]
