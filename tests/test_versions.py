"""Versioned tables and the stored keyword index."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.operators import keyword as K
from tessera.sources.keyword_index import KeywordIndex
from tessera.sources.versions import Conflict, Store


def test_versions(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    rows = spark.createDataFrame([(1, "a", {"k": 1}), (2, None, None)], "id int, x string, m map<string,int>")
    assert store.manifest()["version"] == 0 and store.commit(replace={"t": rows}) == 1
    assert store.commit(replace={"t": rows.orderBy(F.desc("id"))}) is None  # nothing has changed
    assert store.versions() == [1] and sorted(r["id"] for r in store.read("t").collect()) == [1, 2]
    assert store.commit(append={"t": rows.filter("id = 9")}) is None
    assert store.commit(append={"t": rows.filter("id = 1")}, expect=1) == 2 and store.read("t").count() == 3
    with pytest.raises(Conflict):
        store.commit(replace={"t": rows}, expect=1)
    assert store.commit(replace={"t": rows.filter("id = 2")}) == 3
    assert store.read("t", 2).count() == 3 and store.read("t").count() == 1
    assert store.restore(2) == 4 and store.read("t").count() == 3
    assert store.compact("t", parts=1) and store.read("t").count() == 3 and not store.compact("t", parts=1)
    assert store.compact("t", size=1) is False  # rewriting would change nothing
    assert store.prune(1) >= 2 and store.versions() == [5] and store.read("t").count() == 3
    with pytest.raises(ValueError):
        store.read("t", 1)


def test_a_killed_write_leaves_the_old_version(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.commit(replace={"t": spark.range(5)})

    @F.udf("long")
    def dies(x):
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        store.commit(replace={"t": spark.range(9).select(dies("id").alias("id"))})
    assert store.manifest()["version"] == 1 and store.read("t").count() == 5
    assert store.commit(replace={"t": spark.range(9)}) == 2 and store.prune(1) >= 2


def test_two_writers(spark, tmp_path):
    one, two = Store(spark, f"file://{tmp_path}/s"), Store(spark, f"file://{tmp_path}/s")
    one.commit(replace={"t": spark.range(1)})
    base = two.manifest()
    one.commit(replace={"t": spark.range(2)})
    with pytest.raises(Conflict):
        two._publish(base | {"version": 2})
    assert two.read("t").count() == 2


def test_stored_index(spark, tmp_path):
    notes = spark.createDataFrame(
        [(1, "timeout handling", ["net"], "error E42 接口超时", 5), (2, None, None, "接口 文档", 7), (3, "E42", [], "e42", None), (4, "x", None, "gone soon e42", 1)],
        "id long, title string, tags array<string>, text string, observed_at long",
    ).withColumn("tags", F.array_join("tags", " "))
    asked = spark.createDataFrame([(1, "e42 timeout"), (2, "接口超时"), (3, "nothing here zz"), (4, ""), (5, None)], "query_id int, text string")
    index = KeywordIndex(spark, f"file://{tmp_path}/i", buckets=8)
    index.add(notes.filter("id < 3"))
    index.add(notes.filter("id >= 3"))
    index.remove(notes.filter("id = 4").select("id"))
    index.add(notes.filter("id = 2").withColumn("text", F.lit("接口超时 again")))
    now = notes.filter("id <> 4").withColumn("text", F.when(F.col("id") == 2, "接口超时 again").otherwise(F.col("text")))
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    want = rows(K.search(asked, K.postings(now), now))
    assert rows(index.search(asked)) == want and {r[1] for r in want} == {1, 2, 3}
    again = KeywordIndex(spark, f"file://{tmp_path}/i")
    assert again.buckets == 8 and rows(again.search(asked)) == want
    assert not index.compact() and index.compact(parts=2) and rows(index.search(asked)) == want
    assert index.store.read("postings").filter("id = 4").count() == 0
    assert rows(index.search(asked.filter("query_id = 3"))) == []
    plan = index.store.read("postings").filter(F.col("bucket").isin([3]))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan


def test_stored_index_in_small_blocks(spark, tmp_path, monkeypatch):
    import tessera.sources.keyword_index as stored
    from tessera.operators.keyword import postings, search

    monkeypatch.setattr(stored, "SHARE", 4)
    monkeypatch.setattr(stored, "NOTE_BLOCK", 8)
    monkeypatch.setattr(stored, "QUERY_BLOCK", 2)
    words = "alpha beta gamma delta 数据库 接口".split()
    notes = spark.createDataFrame([(f"n{i}", words[i % 6], " ".join(words[: i % 5]), f"common {words[i * 7 % 6]} {i}", i % 3) for i in range(60)], "id string, title string, tags string, text string, observed_at long")
    asked = spark.createDataFrame([(f"q{i}", f"common {words[i % 6]} {words[i * 5 % 6]} {i * 4}") for i in range(7)], "query_id string, text string")
    index = stored.KeywordIndex(spark, f"file://{tmp_path}/i", buckets=2)
    index.add(notes)
    assert index._dealt(index.store.read("postings"), 30).rdd.getNumPartitions() == 15
    want = search(asked, postings(notes), notes, 5).collect()
    assert sorted(index.search(asked, 5).collect()) == sorted(want) and len(want) == 35
