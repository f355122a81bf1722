"""Evaluation statistics: ranks, quantiles, agreement, curves, overlap."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_rank(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Nearest-rank quantiles with half-even index bround(q * (n - 1)), from value counts: no group is listed whole.

    Values are counted first; the running count over distinct values then meets each wanted place.
    """
    counts = df.groupBy(*keys, F.col(value).alias("_x")).agg(F.count(F.lit(1)).alias("_c"))
    order = Window.partitionBy(*keys).orderBy("_x")
    placed = counts.withColumn("_hi", F.sum("_c").over(order)).withColumn("_n", F.sum("_c").over(Window.partitionBy(*keys)))
    at = lambda q: F.bround(F.lit(q) * (F.col("_n") - 1), 0).cast("long") + 1
    return placed.groupBy(*keys).agg(*[F.min(F.when(F.col("_hi") >= at(q), F.col("_x"))).alias(name) for name, q in quantiles.items()])


def average_rank(df: DataFrame, keys: list[str], value: str, name: str, ranges: int = 256) -> DataFrame:
    """df with the average rank of value within keys, ties sharing their mean; null values have no rank.

    Only distinct values with their counts are ordered, in ranges cut at approximate quantiles, whose totals are added up; so a
    key with all rows is spread over tasks, and a value that many rows share is one row.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    cuts = counts.groupBy(*keys).agg(F.percentile_approx(value, [k / ranges for k in range(1, ranges)]).alias("_cuts"))
    cut = counts.join(cuts, keys).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    totals = cut.groupBy(*keys, "_range").agg(F.sum("_c").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range")) - F.col("_n")
    within = F.sum("_c").over(Window.partitionBy(*keys, "_range").orderBy(value)) - F.col("_c")
    placed = cut.join(totals.withColumn("_before", before).drop("_n"), [*keys, "_range"]).withColumn(name, F.col("_before") + within + (F.col("_c") + 1) / 2.0)
    return df.join(placed.select(*keys, value, name), [*keys, value], "left")


def smallest(df: DataFrame, digest: str, n: int) -> DataFrame:
    """The n rows with the smallest values of a hexadecimal digest column; equal digests are all in or all out.

    The first four digits are counted: whole classes below the one that holds the n-th row are taken, and only that class is ordered.
    """
    head = F.substring(digest, 1, 4)
    counts = df.groupBy(head.alias("head")).count()
    upto = counts.withColumn("before", F.sum("count").over(Window.orderBy("head")) - F.col("count")).filter(F.col("before") < n)
    last = upto.orderBy(F.desc("head")).first()
    if last is None:
        return df.limit(0)
    edge = df.filter(head == last["head"]).withColumn("_at", F.rank().over(Window.orderBy(digest))).filter(F.col("_at") <= n - last["before"]).drop("_at")
    return df.filter(head < last["head"]).unionByName(edge)


def auc(scores: DataFrame, keys: list[str]) -> DataFrame:
    """P(positive > negative) + half of the ties, from (score, positive); by counts of each distinct score."""
    counts = scores.groupBy(*keys, "score").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("q"))
    below = F.coalesce(F.sum("q").over(Window.partitionBy(*keys).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = counts.withColumn("win", F.col("p") * (below + F.col("q") / 2.0))
    return parts.groupBy(*keys).agg((F.sum("win") / (F.sum("p") * F.sum("q"))).alias("auc"), F.sum("p").alias("positives"), F.sum("q").alias("negatives"))


def roc(scores: DataFrame) -> DataFrame:
    """threshold, tpr, fpr for each distinct score, from the highest down."""
    counts = scores.groupBy("score").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("q"))
    down = Window.orderBy(F.desc("score"))
    whole = Window.partitionBy()
    return counts.select(
        F.col("score").alias("threshold"), (F.sum("p").over(down) / F.sum("p").over(whole)).alias("tpr"), (F.sum("q").over(down) / F.sum("q").over(whole)).alias("fpr")
    )


def best_threshold(curve: DataFrame, reach: float = 0.0501) -> DataFrame:
    """best_tau, best_margin, plateau_drop of a curve (tau, margin): the largest margin, and what is lost within `reach` of it."""
    best = curve.agg(F.max_by(F.struct("tau", "margin"), F.struct("margin", -F.col("tau"))).alias("b")).select(F.col("b.tau").alias("best_tau"), F.col("b.margin").alias("best_margin"))
    near = curve.join(F.broadcast(best), F.abs(F.col("tau") - F.col("best_tau")) <= reach)
    return near.groupBy("best_tau", "best_margin").agg(F.round(F.max("best_margin") - F.min("margin"), 6).alias("plateau_drop"))


def partial_auc(curve: DataFrame, limit: float = 0.1) -> DataFrame:
    """Trapezoid area under (fpr, tpr) up to the limit, from the origin, the last step interpolated; also tpr at the limit."""
    order = Window.orderBy("fpr", "tpr")
    steps = curve.select("fpr", "tpr", F.coalesce(F.lag("fpr").over(order), F.lit(0.0)).alias("f0"), F.coalesce(F.lag("tpr").over(order), F.lit(0.0)).alias("t0"))
    inside = steps.filter(F.col("f0") < limit)
    cut = F.least("fpr", F.lit(limit))
    share = F.when(F.col("fpr") > F.col("f0"), (cut - F.col("f0")) / (F.col("fpr") - F.col("f0"))).otherwise(1.0)
    top = F.col("t0") + share * (F.col("tpr") - F.col("t0"))
    return inside.agg(F.sum((cut - F.col("f0")) * (top + F.col("t0")) / 2).alias("pauc"), F.max(F.when(F.col("f0") <= limit, top)).alias("tpr_at"))


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def icc2k(ratings: DataFrame) -> DataFrame:
    """ICC(2,k) and the F of the units, from (unit, judge, score), every unit scored by every judge; from sums and group means."""
    whole = ratings.agg(F.avg("score").alias("g"))
    squares = lambda by, name: ratings.groupBy(by).agg(F.avg("score").alias("m"), F.count(F.lit(1)).alias("c")).join(F.broadcast(whole)).agg(F.count(F.lit(1)).alias(f"n{name}"), F.sum(F.col("c") * (F.col("m") - F.col("g")) ** 2).alias(f"s{name}"))
    every = ratings.join(F.broadcast(whole)).agg(F.sum((F.col("score") - F.col("g")) ** 2).alias("st"))
    sums = every.join(F.broadcast(squares("unit", "u"))).join(F.broadcast(squares("judge", "j")))
    n, k = F.col("nu"), F.col("nj")
    msr, msc, mse = F.col("su") / (n - 1), F.col("sj") / (k - 1), (F.col("st") - F.col("su") - F.col("sj")) / ((n - 1) * (k - 1))
    return sums.select(((msr - mse) / (msr + (msc - mse) / n)).alias("icc2k"), (msr / mse).alias("f"))


def krippendorff_ordinal(ratings: DataFrame) -> DataFrame:
    """Ordinal alpha from (unit, score): observed against expected disagreement over pairs of distinct values.

    Only value counts are paired, within a unit and overall; units with one score drop out.
    """
    c = ratings.groupBy("unit", "score").agg(F.count(F.lit(1)).alias("c")).withColumn("m", F.sum("c").over(Window.partitionBy("unit"))).filter("m > 1")
    total = c.groupBy("score").agg(F.sum("c").alias("n"))
    cum = total.withColumn("cum", F.sum("n").over(Window.orderBy("score")))
    a, b = cum.alias("a"), cum.alias("b")
    delta = a.join(b, F.col("a.score") < F.col("b.score")).select(
        F.col("a.score").alias("x"), F.col("b.score").alias("y"), F.col("a.n").alias("nx"), F.col("b.n").alias("ny"),
        ((F.col("b.cum") - F.col("a.cum") + F.col("a.n") - (F.col("a.n") + F.col("b.n")) / 2.0) ** 2).alias("d"),
    )
    p, q = c.alias("p"), c.alias("q")
    seen = p.join(q, (F.col("p.unit") == F.col("q.unit")) & (F.col("p.score") < F.col("q.score"))).select(F.col("p.score").alias("x"), F.col("q.score").alias("y"), (F.col("p.c") * F.col("q.c") / (F.col("p.m") - 1)).alias("o"))
    observed = seen.join(F.broadcast(delta), ["x", "y"]).agg(F.coalesce(F.sum(F.col("o") * F.col("d")), F.lit(0.0)).alias("o"))
    expected = delta.agg(F.sum(F.col("nx") * F.col("ny") * F.col("d")).alias("e"))
    n = total.agg(F.sum("n").alias("n"))
    return observed.join(F.broadcast(expected)).join(F.broadcast(n)).select((1.0 - (F.col("n") - 1) * F.col("o") / F.col("e")).alias("alpha"))


def paired(pairs: DataFrame) -> DataFrame:
    """Paired statistics of (a, b): mean difference, wins, ties, losses, matched rank-biserial r, Cohen's dz."""
    d = pairs.select((F.col("a") - F.col("b")).alias("d"))
    sides = d.filter("d <> 0").select(F.lit(0).alias("g"), F.abs("d").alias("m"), F.signum("d").alias("side"))
    ranked = average_rank(sides, ["g"], "m", "r")
    rb = ranked.agg((F.sum(F.col("side") * F.col("r")) / F.sum("r")).alias("rank_biserial"))
    base = d.agg(
        F.avg("d").alias("mean_diff"), F.count_if(F.col("d") > 0).alias("wins"), F.count_if(F.col("d") == 0).alias("ties"), F.count_if(F.col("d") < 0).alias("losses"),
        (F.avg("d") / F.stddev_samp("d")).alias("dz"),
    )
    return base.join(F.broadcast(rb))


def spearman(pairs: DataFrame) -> DataFrame:
    both = average_rank(average_rank(pairs.select(F.lit(0).alias("g"), "a", "b"), ["g"], "a", "ra"), ["g"], "b", "rb")
    return both.agg(F.corr("ra", "rb").alias("rho"))


def kappa(labels: DataFrame) -> DataFrame:
    """Cohen's kappa and agreement of (a, b) labels, from the confusion counts."""
    c = labels.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))
    n = Window.partitionBy()
    shares = c.withColumn("p", F.col("c") / F.sum("c").over(n))
    rows, cols = shares.groupBy(F.col("a").alias("l")).agg(F.sum("p").alias("pa")), shares.groupBy(F.col("b").alias("l")).agg(F.sum("p").alias("pb"))
    chance = rows.join(cols, "l").agg(F.coalesce(F.sum(F.col("pa") * F.col("pb")), F.lit(0.0)).alias("e"))
    agree = shares.agg(F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("p"))), F.lit(0.0)).alias("agreement"))
    return agree.join(F.broadcast(chance)).select("agreement", F.try_divide(F.col("agreement") - F.col("e"), 1 - F.col("e")).alias("kappa"))


def total_variation(counts: DataFrame) -> DataFrame:
    """Half the sum of absolute differences of the shares of (arm, kind, n), for each pair of arms."""
    p = counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("arm")))
    arms = p.select("arm").distinct()
    pairs = arms.alias("x").join(arms.alias("y"), F.col("x.arm") < F.col("y.arm")).select(F.col("x.arm").alias("a"), F.col("y.arm").alias("b"))
    sides = pairs.join(p.select(F.col("arm").alias("a"), "kind", "p"), "a").select("a", "b", "kind", "p").union(pairs.join(p.select(F.col("arm").alias("b"), "kind", (-F.col("p")).alias("p")), "b").select("a", "b", "kind", "p"))
    return sides.groupBy("a", "b", "kind").agg(F.abs(F.sum("p")).alias("d")).groupBy("a", "b").agg((F.sum("d") / 2).alias("tvd"))


#: Cumulated chances of 0 to 7 in a Poisson distribution of mean 1.
_POISSON = np.cumsum([0.36787944117144233 / math.factorial(k) for k in range(8)])


def draws(h: np.ndarray, resamples: int) -> np.ndarray:
    """How often each of some hashed rows is in each resample: Poisson(1), the same for the same hash on every run."""
    with np.errstate(over="ignore"):
        z = h.view(np.uint64)[:, None] + np.arange(1, resamples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.searchsorted(_POISSON, (z >> np.uint64(11)).astype(np.float64) / 2.0**53, side="right")


class _Wins:
    """Over rows in the order of their scores, for all resamples at once: positive and negative weight, and the weight of the pairs that a
    positive wins, half of the ties; rows of one score may come in several pieces."""

    def __init__(self, resamples: int):
        self.positive, self.negative, self.won = (np.zeros(resamples) for _ in range(3))
        self.score, self.p, self.q = None, np.zeros(resamples), np.zeros(resamples)

    def close(self) -> None:
        self.won += self.p * (self.negative + self.q / 2)
        self.positive, self.negative = self.positive + self.p, self.negative + self.q
        self.p, self.q = np.zeros_like(self.p), np.zeros_like(self.q)

    def add(self, score: np.ndarray, positive: np.ndarray, weight: np.ndarray) -> None:
        starts = np.flatnonzero(np.r_[True, score[1:] != score[:-1]])
        p, q = (np.add.reduceat(np.where(side[:, None], weight, 0), starts, axis=0).astype(np.float64) for side in (positive, ~positive))
        if self.score != score[0]:
            self.close()
        self.p, self.q = self.p + p[0], self.q + q[0]
        self.score = score[-1]
        if len(starts) > 1:
            self.close()
            inner_p, inner_q = p[1:-1], q[1:-1]
            below = self.negative + np.cumsum(inner_q, axis=0) - inner_q
            self.won += (inner_p * (below + inner_q / 2)).sum(0)
            self.positive, self.negative = self.positive + inner_p.sum(0), self.negative + inner_q.sum(0)
            self.p, self.q = p[-1], q[-1]


def resampled_auc(pairs: DataFrame, nodes: bool = True, resamples: int = 2_000, seed: int = 7) -> DataFrame:
    """b, auc: of pairs (a, b, score, positive) in each Poisson resample, from one pass over the pairs sorted by ranges of the score.

    With nodes, nodes are drawn and a pair counts as often as the product of its ends, so that pairs that share a node go together; else
    pairs are drawn, each on its own. A task gives three sums for each resample of its range; those of the ranges are put together in
    the order of the ranges. A resample without positives or negatives has no value. Equal scores are one task's, row by row.
    """
    h = [F.xxhash64(F.lit(seed), c) for c in ("a", "b")] if nodes else [F.xxhash64(F.lit(seed), "a", "b"), F.lit(None).cast("long")]
    rows = pairs.filter("score IS NOT NULL AND positive IS NOT NULL").select(F.col("score").cast("double").alias("score"), "positive", h[0].alias("ha"), h[1].alias("hb"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wins = _Wins(resamples)
        least = None
        for batch in batches:
            for at in range(0, len(batch), 128):
                part = batch.iloc[at : at + 128]
                weight = draws(part["ha"].to_numpy(dtype=np.int64), resamples)
                if nodes:
                    weight = weight * draws(part["hb"].to_numpy(dtype=np.int64), resamples)
                least = part["score"].iloc[0] if least is None else least
                wins.add(part["score"].to_numpy(), part["positive"].to_numpy(dtype=bool), weight)
        if least is not None:
            wins.close()
            yield pd.DataFrame({"least": least, "b": np.arange(resamples), "p": wins.positive, "q": wins.negative, "w": wins.won})

    parts = rows.repartitionByRange("score").sortWithinPartitions("score").mapInPandas(run, "least double, b int, p double, q double, w double")
    before = F.coalesce(F.sum("q").over(Window.partitionBy("b").orderBy("least").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    whole = parts.withColumn("w", F.col("w") + F.col("p") * before).groupBy("b").agg(F.sum("w").alias("w"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    return whole.select("b", F.try_divide(F.col("w"), F.col("p") * F.col("q")).alias("auc"))


def auc_interval(pairs: DataFrame, nodes: bool = True, resamples: int = 2_000, seed: int = 7) -> DataFrame:
    """One row: auc of the pairs, low and high, the percentile interval (2.5, 97.5) of its resamples, by nodes or by pairs."""
    ends = resampled_auc(pairs, nodes, resamples, seed).agg(F.percentile("auc", 0.025).alias("low"), F.percentile("auc", 0.975).alias("high"))
    whole = pairs.filter("score IS NOT NULL AND positive IS NOT NULL").select(F.lit(0).alias("g"), "score", "positive")
    return auc(whole, ["g"]).select("auc", "positives", "negatives").join(F.broadcast(ends))


def resampled_means(df: DataFrame, keys: list[str], id_: str, value: str, resamples: int = 10_000, seed: int = 7) -> DataFrame:
    """keys, b, m: the mean of each Poisson resample b. A row's count in a resample is Poisson(1) of a hash of (seed, resample, id), the
    same on every run. Each task sums all resamples of its rows at once, so rows are never multiplied."""
    table = df.select(*keys, F.xxhash64(F.lit(seed), id_).alias("_h"), F.col(value).cast("double").alias("_x")).filter(F.col("_x").isNotNull())
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for key, part in batch.groupby(keys, dropna=False):
                total = sums.setdefault(tuple(key), np.zeros((2, resamples)))
                for at in range(0, len(part), 256):
                    c = draws(part["_h"].to_numpy()[at : at + 256], resamples)
                    total += np.stack([part["_x"].to_numpy()[at : at + 256] @ c, c.sum(0)])
        for key, (s, n) in sums.items():
            yield pd.DataFrame({**{k: [v] * resamples for k, v in zip(keys, key, strict=True)}, "b": np.arange(resamples), "s": s, "n": n})

    kinds = ", ".join(f"{k} {dict(df.dtypes)[k]}" for k in keys)
    summed = table.mapInPandas(run, f"{kinds}, b int, s double, n double").groupBy(*keys, "b").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return summed.select(*keys, "b", F.try_divide("s", "n").alias("m"))


def bootstrap(df: DataFrame, keys: list[str], id_: str, value: str, resamples: int = 10_000, seed: int = 7) -> DataFrame:
    """Mean and its percentile interval (2.5, 97.5) from Poisson resamples of the rows, the bootstrap that needs no count of rows
    beforehand: each row is drawn Poisson(1) times instead of n rows being drawn with replacement."""
    means = resampled_means(df, keys, id_, value, resamples, seed)
    ends = means.groupBy(*keys).agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
    return df.groupBy(*keys).agg(F.avg(value).alias("mean")).join(ends, keys)
