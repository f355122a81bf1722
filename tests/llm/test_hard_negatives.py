"""Hard negatives against all products."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.harness import compare

VECTORS = "vec_id long, embedding array<float>, label int, row string, dim string, slot string, centre string"


def brute(rows, is_anchor, scale=256, positives=5, negatives=3):
    good = []
    for k, (i, v, label) in enumerate(rows):
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.append((k, i, label, [math.floor(scale * float(np.float32(x))) for x in v]))
    out = []
    for k, i, label, v in good:
        if not is_anchor(i):
            continue
        scored = [(-sum(map(int.__mul__, v, w)), j, m, other) for m, j, other, w in good if m != k and len(w) == len(v)]
        scored.sort()
        for p in [s for s in scored if s[3] == label][:positives]:
            fits = [s for s in scored if s[3] != label and 50 * -p[0] <= 100 * -s[0] <= 95 * -p[0]]
            out += [(i, p[1], r, s[1], -p[0], -s[0]) for r, s in enumerate(fits[:negatives], 1)]
    return sorted(out)


def mined(spark, rows, **how):
    from tessera.llm.hard_negatives import mine

    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], VECTORS)
    return sorted(tuple(r) for r in mine(df, F.col("vec_id") % 3 == 0, **how).collect())


def test_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=4)], int(rng.integers(0, 3))) for i in range(60)]
    rows += [(3, rows[3][1], rows[3][2]), (3, rows[3][1], rows[3][2]), (None, rows[4][1], 1), (70, rows[4][1], None), (71, None, 1), (72, [None, 1.0, 1.0, 1.0], 1)]
    rows += [(73, [float("nan")] * 4, 1), (75, [float("inf")] * 4, 1), (78, [0.0] * 4, 1), (81, [1.0, 2.0], 1), (82, [1.0, 1.9], 1), (83, [1.0, 1.0], 0), (84, [], 1), (85, [], 0), (86, [], 1), (87, [1.0], 2)]
    assert mined(spark, rows) == brute(rows, lambda i: i % 3 == 0)
    assert mined(spark, rows[60:62] + rows[64:68]) == []
    assert mined(spark, []) == []


@pytest.mark.parametrize("tight", [False, True])
def test_many_blocks(spark, monkeypatch, tight):
    """Small blocks and shards, clusters in the data and not, a third of the rows one vector, ties everywhere."""
    import tessera.llm.hard_negatives as h

    monkeypatch.setattr(h, "BLOCK", 32)
    monkeypatch.setattr(h, "SHARD", 64)
    monkeypatch.setattr(h, "STRIDE", 16)
    rng = np.random.default_rng(7)
    middles = rng.normal(size=(8, 6))
    rows = []
    for i in range(450):
        v = middles[i % 8] + rng.normal(size=6) * (0.05 if tight else 2)
        if i % 3 == 1:
            v = middles[0]
        rows.append((i, [float(x) for x in np.round(v / np.linalg.norm(v), 1)], int(rng.integers(0, 4))))
    got = mined(spark, rows)
    assert got == brute(rows, lambda i: i % 3 == 0) and len(got) > 500


def test_walks_stop_early(spark):
    """In clustered data the shared list is left long before its end."""
    import pyarrow as pa

    from tessera.llm.hard_negatives import Walk

    rng = np.random.default_rng(3)
    v = np.floor(256 * rng.normal(size=(4096, 8)) * np.linspace(0.05, 1, 4096)[:, None])
    norm = np.linalg.norm(v, axis=1)
    shard = pa.table({"row": np.arange(4096), "vec_id": np.arange(4096), "label": np.zeros(4096, dtype=np.int64), "norm": norm, "v": pa.array(v.tolist(), pa.list_(pa.float64()))})
    seen = []

    class Counted(np.ndarray):
        def __getitem__(self, at):
            seen.append(np.size(at))
            return np.asarray(self)[at]

    walk = Walk({8: v[-1:] / norm[-1]}, True, 5)
    members = pa.table({"row": [-1], "label": [0], "norm": norm[-1:], "angle": [0.0], "v": pa.array(v[-1:].tolist(), pa.list_(pa.float64())), "low": [[-(2**63)]], "high": [[2**63 - 1]]})
    info = {c: shard[c].to_numpy() for c in ("row", "vec_id", "label")}
    cosine = v @ v[-1] / norm / norm[-1]
    bound = norm * (cosine + 1e-6)
    out = walk.members(members, v.view(Counted), bound, np.argsort(-bound, kind="stable"), info)
    assert out[0][2].tolist() == sorted((v @ v[-1]).astype(int), reverse=True)[:5] and sum(seen) < 1200


def test_against_sql(spark):
    from tessera.llm.queries import ORACLE, QUERIES

    assert compare(spark, QUERIES["op13_hard_negatives"], ORACLE["op13_hard_negatives"], "/root/testdata/sf0.01") > 0
