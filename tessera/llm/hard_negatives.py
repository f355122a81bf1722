"""Hard negatives by exact inner products: clusters of anchors share candidate lists sorted by an angular upper bound."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import uniform
from tessera.session import materialize

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: Percents of a positive's score between which a negative's must lie.
LOW, HIGH = 50, 95
#: Centres are fit on about SAMPLE anchors; there are as many as the root of the anchors, CENTRES at most for each length.
SAMPLE, CENTRES = 16_384, 256
#: Rows of a block of anchors and of a shard of candidates, on average; members walk their list in strides.
BLOCK, SHARD, STRIDE = 4_096, 8_192, 512
_LEAST, _MOST = -(2**63), 2**63 - 1
#: Angles and bounds are widened by this share, far more than doubles lose.
_SLACK = 1e-6


def integers(vectors: DataFrame, label: Column, scale: int = SCALE) -> DataFrame:
    """row (a number of its own), vec_id, label, dim, norm and v, the components as whole numbers; only rows that take part.

    Rows with a null id, label or vector, or with a null or non-finite component, don't.
    """
    real = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = vectors.select("vec_id", label.alias("label"), "embedding").filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & real)
    v = F.transform("embedding", lambda x: F.floor(scale * x.cast("double")).cast("double"))
    rows = good.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return materialize(rows.withColumns({"dim": F.size("v"), "norm": norm}), "integers")


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).reshape(len(whole), -1)


def _angles(v: np.ndarray, norm: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Angles of vectors with unit centres; a zero vector has angle 0 with all."""
    cosine = (v @ centres.T) / np.where(norm > 0, norm, 1)[:, None]
    return np.where(norm[:, None] > 0, np.arccos(np.clip(cosine, -1, 1)), 0)


def centres_of(anchors: DataFrame, sample: int = SAMPLE, most: int = CENTRES, rounds: int = 8) -> dict[int, np.ndarray]:
    """Unit centres by length of vector: spherical k-means of a bounded sample of anchors, chosen by a hash of vec_id."""
    n = anchors.count()
    chosen = anchors.filter(F.col("norm") > 0).filter(uniform(F.col("vec_id")) < sample / max(n, 1)).select("dim", "v").toPandas()
    found, rng = {}, np.random.default_rng(13)
    for dim, rows in chosen.groupby("dim"):
        x = np.unique(np.array(rows["v"].tolist()), axis=0)
        x /= np.linalg.norm(x, axis=1)[:, None]
        centres = x[rng.choice(len(x), min(len(x), most, math.ceil(math.sqrt(n * len(rows) / len(chosen)))), replace=False)]
        for _ in range(rounds):
            near = (x @ centres.T).argmax(1)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, x)
            length = np.linalg.norm(sums, axis=1)
            centres = np.where(length[:, None] > 0, sums / np.where(length > 0, length, 1)[:, None], centres)
        found[int(dim)] = centres
    return found


def assigned(rows: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """rows with their nearest centre and the angle to it; centre -1 and angle 0 where their length has none."""

    @F.pandas_udf("centre int, angle double")
    def nearest(v: pd.Series, norm: pd.Series, dim: pd.Series) -> pd.DataFrame:
        centre, angle = np.full(len(v), -1, dtype=np.int32), np.zeros(len(v))
        for d in dim.unique():
            at = np.flatnonzero(dim.to_numpy() == d)
            if int(d) in centres:
                all_angles = _angles(np.stack(v.iloc[at].to_list()), norm.to_numpy()[at], centres[int(d)])
                centre[at], angle[at] = all_angles.argmin(1), all_angles.min(1)
        return pd.DataFrame({"centre": centre, "angle": angle})

    near = rows.select("*", nearest("v", "norm", "dim").alias("near"))
    return near.select("row", "vec_id", "label", "dim", "norm", "v", "near.centre", "near.angle")


def dealt(rows: DataFrame, size: int, name: str) -> DataFrame:
    """rows with the column `name`: pieces of about `size` rows, neighbours in (dim, centre) together and a hot centre cut by a hash."""
    counts = rows.groupBy("dim", "centre").agg(F.count(F.lit(1)).alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.orderBy("dim", "centre").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.withColumn("start", before)
    place = (F.pmod(F.xxhash64("row"), F.lit(1 << 20)) / float(1 << 20) * F.col("rows") + F.col("start")) / size
    return rows.join(starts, ["dim", "centre"]).withColumn(name, F.floor(place).cast("long")).drop("rows", "start")


def shard_bounds(shards: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """dim, shard, centre, nearest (the least angle of a member with the centre) and longest (norm); centre -1 stands for none."""

    def run(part: pa.Table) -> pa.Table:
        dim, norm = part["dim"][0].as_py(), part["norm"].to_numpy()
        least = np.zeros(1)
        if dim in centres:
            least = np.concatenate([least, _angles(_matrix(part["v"]), norm, centres[dim]).min(0)])
        n = len(least)
        return pa.table({"dim": pa.array([dim] * n, pa.int32()), "shard": pa.array([part["shard"][0].as_py()] * n, pa.int64()), "centre": pa.array(np.arange(-1, n - 1), pa.int32()), "nearest": least, "longest": np.full(n, norm.max())})

    return materialize(shards.select("dim", "shard", "norm", "v").groupBy("dim", "shard").applyInArrow(run, "dim int, shard long, centre int, nearest double, longest double"), "bounds")


def visits(blocks: DataFrame, bounds: DataFrame) -> DataFrame:
    """dim, block, shard, reach and need for each cluster of a block and each shard: reach bounds a member's scores over its norm."""
    members = blocks.groupBy("dim", "block", "centre").agg(F.max("angle").alias("wide"), F.min(F.when(F.col("norm") > 0, F.col("need") / F.col("norm")).otherwise(float("-inf"))).alias("need"))
    gap = F.greatest(F.col("nearest") - F.col("wide") - _SLACK, F.lit(0.0))
    return members.join(bounds, ["dim", "centre"]).select("dim", "block", "centre", "shard", "need", (F.col("longest") * (F.cos(gap) + _SLACK)).alias("reach"))


class Walk:
    """One block of anchors against one shard: what each (anchor, slot) finds, `k` at most, by certified walks of shared lists."""

    KINDS = pa.schema([("anchor", pa.int64()), ("slot", pa.int32()), ("score", pa.int64()), ("other", pa.int64()), ("other_id", pa.int64())])

    def __init__(self, centres: dict[int, np.ndarray], same: bool, k: int):
        self.centres, self.same, self.k = centres, same, k

    def __call__(self, asked: pa.Table, shard: pa.Table) -> pa.Table:
        if not asked.num_rows or not shard.num_rows:
            return self.KINDS.empty_table()
        shard = shard.sort_by([("vec_id", "ascending"), ("row", "ascending")])
        v, norm = _matrix(shard["v"]), shard["norm"].to_numpy()
        info = {c: shard[c].to_numpy() for c in ("row", "vec_id", "label")}
        centre, out = asked["centre"].to_numpy(), []
        for c in np.unique(centre):
            members = asked.filter(pa.array(centre == c))
            wide = members["angle"].to_numpy().max() + _SLACK
            apart = np.zeros(len(v)) if c < 0 else _angles(v, norm, self.centres[asked["dim"][0].as_py()][c : c + 1])[:, 0]
            bound = norm * (np.cos(np.maximum(apart - wide, 0)) + _SLACK)
            order = np.argsort(-bound, kind="stable")  # the cluster's list, shared by its members
            out += self.members(members, v, bound, order, info)
        parts = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [[]] * 5
        return pa.table([pa.array(p, kind) for p, kind in zip(parts, self.KINDS.types, strict=True)], schema=self.KINDS)

    def members(self, members: pa.Table, v: np.ndarray, bound: np.ndarray, order: np.ndarray, info: dict[str, np.ndarray]) -> list[tuple]:
        rows, labels, own, norm = members["row"].to_numpy(), members["label"].to_numpy(), _matrix(members["v"]), members["norm"].to_numpy()
        slots = max(len(x) for x in members["low"].to_pylist())
        low, high = np.full((len(rows), slots), _MOST), np.full((len(rows), slots), _LEAST)  # an absent slot takes nothing
        for k, (a, b) in enumerate(zip(members["low"].to_pylist(), members["high"].to_pylist(), strict=True)):
            low[k, : len(a)], high[k, : len(b)] = a, b
        best = np.full((len(rows), slots, self.k), _LEAST)
        live, hits = np.arange(len(rows)), []
        exact = np.abs(own).max(initial=0) * np.abs(v).max(initial=0) * own.shape[1] < 2**53
        for at in range(0, len(order), STRIDE):
            # certified: whatever follows in the list scores less than the slot can take
            open_ = (norm[live] * bound[order[at]])[:, None] >= np.maximum(low[live], best[live].min(2))
            live = live[(open_ & (low[live] <= high[live])).any(1)]
            if not len(live):
                break
            near = order[at : at + STRIDE]
            scores = (own[live] @ v[near].T).astype(np.int64) if exact else own[live].astype(np.int64) @ v[near].T.astype(np.int64)
            fits = (labels[live][:, None] == info["label"][near]) == self.same
            fits &= rows[live][:, None] != info["row"][near]
            for slot in range(slots):
                floor = np.maximum(low[live, slot], best[live, slot].min(1))
                ok = fits & (scores >= floor[:, None]) & (scores <= high[live, slot][:, None])
                a, b = np.nonzero(ok)
                if len(a):
                    hits.append((live[a], np.full(len(a), slot), scores[a, b], near[b]))
                    both = np.concatenate([best[live, slot], np.where(ok, scores, _LEAST)], axis=1)
                    best[live, slot] = np.partition(both, both.shape[1] - self.k, axis=1)[:, -self.k :]
        if not hits:
            return []
        who, slot, score, which = (np.concatenate(x) for x in zip(*hits, strict=True))
        kept = score >= best[who, slot].min(1)
        who, slot, score, which = who[kept], slot[kept], score[kept], which[kept]
        sort = np.lexsort((which, -score, slot, who))  # the shard is by vec_id and row
        who, slot, score, which = who[sort], slot[sort], score[sort], which[sort]
        group = np.r_[True, (who[1:] != who[:-1]) | (slot[1:] != slot[:-1])]
        place = np.arange(len(who)) - np.flatnonzero(group)[np.cumsum(group) - 1]
        first = place < self.k
        which = which[first]
        return [(rows[who[first]], slot[first].astype(np.int32), score[first], info["row"][which], info["vec_id"][which])]


def walked(blocks: DataFrame, shards: DataFrame, pairs: DataFrame, walk: Walk) -> DataFrame:
    """What the blocks find in the shards that they visit: anchor, slot, score, other, other_id. One task holds a block and a shard."""
    asked = blocks.select("row", "label", "dim", "norm", "v", "centre", "angle", "low", "high", "block").join(pairs, ["dim", "block"])
    met = shards.select("row", "vec_id", "label", "dim", "norm", "v", "shard").join(pairs, ["dim", "shard"])
    keys = ["dim", "block", "shard"]
    return asked.groupBy(*keys).cogroup(met.groupBy(*keys)).applyInArrow(lambda asked, shard: walk(asked, shard), "anchor long, slot int, score long, other long, other_id long")


def first(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "other_id", "other"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k)


def positives_of(blocks: DataFrame, shards: DataFrame, bounds: DataFrame, centres: dict[int, np.ndarray], k: int = POSITIVES) -> DataFrame:
    """anchor, slot (from 0), score, other, other_id: the k best rows of each anchor's own label.

    Each cluster first walks the shard that may hold its best; the scores found there tell what the other shards must reach.
    """
    walk = Walk(centres, True, k)
    free = blocks.withColumns({"need": F.lit(float("-inf")), "low": F.array(F.lit(_LEAST)), "high": F.array(F.lit(_MOST))})
    best = Window.partitionBy("dim", "block", "centre").orderBy(F.desc("reach"), "shard")
    ahead = materialize(visits(free, bounds).withColumn("place", F.row_number().over(best)).filter("place = 1").select("dim", "block", "shard").distinct(), "ahead")
    seen = materialize(first(walked(free, shards, ahead, walk), k), "seen")
    known = seen.filter(F.col("rank") == k).select(F.col("anchor").alias("row"), F.col("score").alias("least"))
    least = F.coalesce("least", F.lit(_LEAST))
    bounded = materialize(blocks.join(known, "row", "left").withColumns({"need": least.cast("double"), "low": F.array(least), "high": F.array(F.lit(_MOST))}).drop("least"), "bounded")
    rest = visits(bounded, bounds).filter("reach >= need").select("dim", "block", "shard").distinct().join(ahead, ["dim", "block", "shard"], "left_anti")
    found = walked(bounded, shards, materialize(rest, "visits"), walk)
    both = seen.drop("rank").unionByName(found)
    return materialize(first(both, k).withColumn("slot", (F.col("rank") - 1).cast("int")).drop("rank"), "positives")


def mine(vectors: DataFrame, is_anchor: Column, label: Column | None = None, scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its `positives` best rows of
    the same label, the first `negatives` rows of another label whose score is from low to high percent of the positive's.

    Scores are inner products of components times `scale`, rounded down; the higher first, ties to the smaller vec_id, then to the
    row. The walks are exact: a list is left only when its bound is below what can still count. Rows with a null id, label or vector, or a null or
    non-finite component, take no part; zero vectors do, with scores of 0. Equal rows are rows of their own: each is an anchor, each may
    be a positive of the other. Vectors meet only those of their own length. Scores must stay below 2^63, components
    below 2^53. Fewer rows than asked for: all of them. No anchors or an empty table: no rows. Other columns are not read.

    Anchors are dealt into blocks, candidates into shards, both by nearest centre, so a block visits only the shards whose bound reaches
    its scores. Without clusters in the data that is all of them, and a candidate is copied once for each 4096 anchors.
    """
    rows = integers(vectors, F.col("label") if label is None else label, scale)
    anchors = rows.filter(is_anchor)
    centres = centres_of(anchors)
    blocks = materialize(dealt(assigned(anchors, centres), BLOCK, "block"), "blocks")
    shards = materialize(dealt(assigned(rows, centres), SHARD, "shard"), "shards")
    bounds = shard_bounds(shards, centres)
    best = positives_of(blocks, shards, bounds, centres, positives)

    percent = lambda p: (p * F.col("score") - F.pmod(p * F.col("score"), F.lit(100))) / 100  # noqa: E731  rounded down
    band = F.sort_array(F.collect_list(F.struct("slot", (-percent(-low)).cast("long").alias("low"), percent(high).cast("long").alias("high"))))
    bands = best.groupBy(F.col("anchor").alias("row")).agg(band.alias("band"))
    open_ = F.aggregate("band", F.lit(float("inf")), lambda s, b: F.when(b["low"] <= b["high"], F.least(s, b["low"].cast("double"))).otherwise(s))
    asked = materialize(blocks.join(bands, "row").withColumns({"low": F.col("band.low"), "high": F.col("band.high"), "need": open_}).drop("band").filter(F.col("need") < float("inf")), "asked")
    pairs = materialize(visits(asked, bounds).filter("reach >= need").select("dim", "block", "shard").distinct(), "visits")
    found = first(walked(asked, shards, pairs, Walk(centres, False, negatives)), negatives)
    ids = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    pos = best.select("anchor", "slot", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = found.join(pos, ["anchor", "slot"]).join(ids, "anchor")
    return named.select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
