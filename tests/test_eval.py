from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import evalstats as E


def test_average_ranks(spark):
    rng = random.Random(3)
    rows = [(k % 3, rng.choice([1.0, 2.0, rng.random() * 10])) for k in range(600)] + [(0, None)]
    got = E.average_rank(spark.createDataFrame(rows, "g int, x double"), ["g"], "x", "r", ranges=8).collect()
    for g in range(3):
        values = sorted(x for h, x in rows if h == g and x is not None)
        want = {x: np.mean([k + 1 for k, y in enumerate(values) if y == x]) for x in set(values)}
        assert all(r["r"] == pytest.approx(want[r["x"]]) for r in got if r["g"] == g and r["x"] is not None)
    assert [r["r"] for r in got if r["x"] is None] == [None]


def test_bootstrap_against_resampling(spark):
    rng = np.random.default_rng(5)
    x = rng.gamma(2.0, 3.0, 150)
    df = spark.createDataFrame([("a", k, float(v)) for k, v in enumerate(x)] + [("b", k, 1.0) for k in range(5)], "g string, id long, x double")
    got = {r["g"]: r for r in E.bootstrap(df, ["g"], "id", "x", 4000).collect()}
    means = np.array([rng.choice(x, len(x)).mean() for _ in range(4000)])
    low, high = np.percentile(means, [2.5, 97.5])
    assert got["a"]["mean"] == pytest.approx(x.mean()) and abs(got["a"]["low"] - low) < 0.12 and abs(got["a"]["high"] - high) < 0.12
    assert got["b"]["low"] == got["b"]["high"] == 1.0


def test_smallest_digests(spark):
    df = spark.range(1000).withColumn("h", F.md5(F.col("id").cast("string")))
    want = [r["id"] for r in df.orderBy("h").limit(37).collect()]
    assert sorted(r["id"] for r in E.smallest(df, "h", 37).collect()) == sorted(want) and E.smallest(df, "h", 0).count() == 0


def plain_auc(score, positive, weight):
    won = sum(weight[i] * weight[j] * (1.0 if score[i] > score[j] else 0.5 if score[i] == score[j] else 0.0) for i in np.flatnonzero(positive) for j in np.flatnonzero(~positive))
    return won / (weight[positive].sum() * weight[~positive].sum())


@pytest.mark.parametrize("nodes", [True, False])
def test_resampled_auc_against_a_loop(spark, nodes):
    rng = np.random.default_rng(3)
    rows = [(int(a), int(b), float(np.round(rng.random() + 0.3 * k, 1)), bool(k)) for k in (0, 1) for a, b in rng.integers(0, 12, (40, 2))] + [(1, 2, None, True)]
    df = spark.createDataFrame(rows, "a int, b int, score double, positive boolean").repartition(5)
    hashed = df.filter("score IS NOT NULL").select("score", "positive", F.xxhash64(F.lit(7), "a"), F.xxhash64(F.lit(7), "b"), F.xxhash64(F.lit(7), "a", "b")).toPandas()
    score, positive = hashed["score"].to_numpy(), hashed["positive"].to_numpy(dtype=bool)
    h = [hashed.iloc[:, k].to_numpy() for k in (2, 3, 4)]
    weight = E.draws(h[0], 50) * E.draws(h[1], 50) if nodes else E.draws(h[2], 50)
    got = {r["b"]: r["auc"] for r in E.resampled_auc(df, nodes, 50).collect()}
    assert len(got) == 50
    for b in range(50):
        w = weight[:, b].astype(float)
        if w[positive].sum() and w[~positive].sum():
            assert got[b] == pytest.approx(plain_auc(score, positive, w))
        else:
            assert got[b] is None
    one = E.auc_interval(df, nodes, 400).first()
    assert one["low"] < one["auc"] < one["high"] and one["auc"] == pytest.approx(plain_auc(score, positive, np.ones(len(score))))


def test_node_intervals_are_wider_where_pairs_share_nodes(spark):
    rng = np.random.default_rng(4)
    level = rng.normal(size=40)
    rows = [(a, b, float(level[a] + level[b] + rng.normal() * 0.1), (a + b) % 2 == 0) for a in range(40) for b in range(a)]
    df = spark.createDataFrame(rows, "a int, b int, score double, positive boolean")
    by_node, by_pair = (E.auc_interval(df, nodes, 1000).first() for nodes in (True, False))
    assert by_node["high"] - by_node["low"] > 1.3 * (by_pair["high"] - by_pair["low"])
    values = []
    for _ in range(300):  # nodes drawn with replacement, pairs of different draws
        c = np.bincount(rng.integers(0, 40, 40), minlength=40)
        w = np.array([c[a] * c[b] for a, b, _, _ in rows], dtype=float)
        s, p = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
        order = np.argsort(s)
        below = np.cumsum(np.where(p[order], 0, w[order]))
        values.append((w[order][p[order]] * below[p[order]]).sum() / (w[p].sum() * w[~p].sum()))
    low, high = np.percentile(values, [2.5, 97.5])
    assert abs(by_node["low"] - low) < 0.03 and abs(by_node["high"] - high) < 0.03
