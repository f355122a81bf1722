"""Exact vector search in blocks, log replay, reconciliation and duplicate pairs."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS, ASKED = 65_536, 1_024


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    whole = column.combine_chunks()
    return whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(whole), -1)


def knn(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "cosine", exclude_self: bool = False) -> DataFrame:
    """query_id, id, ord, score, place: the k best vectors of each query, exactly.

    queries: query_id, embedding; vectors: id, ord, embedding; neither with null vectors. cosine ranks by falling, l2 (squared) by
    rising score, rounded to nine digits, then ord. Blocks of queries meet blocks of vectors as matrix products; a block
    pair gives k rows a query. Both block sizes are bounded, so nothing is gathered or broadcast whole.
    """
    sign = -1.0 if metric == "cosine" else 1.0
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    n, m = vectors.count(), queries.count()
    nb, mb = max(1, math.ceil(n / ROWS), min(cores, math.ceil(n / 4096))), max(1, math.ceil(m / ASKED))
    each = lambda b: F.explode(F.sequence(F.lit(0), F.lit(b - 1)))
    left = vectors.select("id", "ord", "embedding", F.pmod(F.xxhash64("id"), F.lit(nb)).cast("int").alias("vb")).withColumn("qb", each(mb))
    right = queries.select(F.col("query_id").alias("query_id"), F.col("embedding").alias("asked"), F.pmod(F.xxhash64("query_id"), F.lit(mb)).cast("int").alias("qb")).withColumn("vb", each(nb))
    kinds = dict(queries.dtypes)["query_id"]
    schema = f"query_id {kinds}, id string, ord long, score double"

    def best(block: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[pa.Table] = []
        if block.num_rows and asked.num_rows:
            block = block.sort_by("ord")
            x, q, ids = _matrix(block["embedding"]), _matrix(asked["asked"]), block["id"].to_pylist()
            names = asked["query_id"].to_pylist()
            for at in range(0, len(q), 64):
                part = q[at : at + 64]
                if metric == "cosine":
                    size = np.linalg.norm(part, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None]
                    scores = np.where(size > 1e-24, part @ x.T / np.maximum(size, 1e-24), 0.0)
                else:
                    scores = np.maximum((part * part).sum(1)[:, None] - 2 * part @ x.T + (x * x).sum(1)[None], 0.0)
                for name, s in zip(names[at : at + 64], scores, strict=True):
                    key = sign * np.round(s, 9)
                    if exclude_self:
                        key = np.where(np.array(ids) == name, np.inf, key)
                    last = np.partition(key, k - 1)[k - 1] if len(key) > k else np.inf
                    near = np.flatnonzero((key <= last) & (key < np.inf))
                    near = near[np.argsort(key[near], kind="stable")][:k]
                    out.append(pa.table({"query_id": pa.array([name] * len(near), asked.schema.field("query_id").type), "id": [ids[i] for i in near], "ord": block["ord"].take(near), "score": s[near]}))
        empty = pa.schema([("query_id", asked.schema.field("query_id").type), ("id", pa.string()), ("ord", pa.int64()), ("score", pa.float64())])
        return pa.concat_tables([t.cast(empty) for t in out]) if out else empty.empty_table()

    pairs = left.groupBy("vb", "qb").cogroup(right.groupBy("vb", "qb")).applyInArrow(best, schema)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9) * sign, "ord"))
    return pairs.withColumn("place", place).filter(F.col("place") <= k)


def replay(log: DataFrame) -> DataFrame:
    """Current vectors of a change log (id, seq, pos, deleted, ...): the last row of an id, unless that is a tombstone."""
    fields = [c for c in log.columns if c not in ("id", "seq", "pos")]
    last = log.groupBy("id").agg(F.max_by(F.struct(*fields), F.struct("seq", "pos")).alias("r"))
    return last.filter("NOT r.deleted").select("id", *[f"r.{c}" for c in fields if c != "deleted"])


def needs_compaction(shards: int, rows: int, live: int) -> bool:
    """More than 16 shards and twice the live rows, or more than 64 shards."""
    return shards > 16 and (rows >= 2 * live or shards > 64)


def reconcile(desired: DataFrame, stored: DataFrame) -> DataFrame:
    """id, change: added, updated or removed, to bring stored (id, content) to desired (id, content)."""
    d, s = desired.select("id", F.col("content").alias("want"), F.lit(True).alias("d")), stored.select("id", F.col("content").alias("have"), F.lit(True).alias("s"))
    change = F.when(F.col("s").isNull(), "added").when(F.col("d").isNull(), "removed").when(~F.col("want").eqNullSafe(F.col("have")), "updated")
    return d.join(s, "id", "full_outer").select("id", change.alias("change")).filter("change IS NOT NULL")


def accept_embedded(stored: DataFrame, removals: DataFrame, embedded: DataFrame) -> DataFrame:
    """The rows of embedded (id, epoch, ...) that may be written: ids that have no vector by now, and were not removed after the epoch
    in which their embedding began. stored: id. removals: id, epoch; the last removal of an id counts. Of several rows of an id the
    one of the latest epoch is written."""
    last = removals.groupBy("id").agg(F.max("epoch").alias("_removed"))
    fresh = embedded.join(stored.select("id"), "id", "left_anti").join(last, "id", "left").filter(F.coalesce("_removed", F.lit(-1)) <= F.col("epoch")).drop("_removed")
    rest = [c for c in embedded.columns if c != "id"]
    return fresh.groupBy("id").agg(F.max_by(F.struct(*rest), "epoch").alias("r")).select("id", "r.*")


def duplicate_pairs(nodes: DataFrame, vectors: DataFrame, threshold: float = 0.85, least: int = 4) -> DataFrame:
    """a, b, score: pairs of active nodes that aren't things and have `least` characters, at a cosine of the threshold or more.

    Pairs are of classes of equal vectors: copies of one vector are named by their first node, so that no group's pairs are
    written out; join members to the result for the rest. Blocks meet blocks, each unordered pair of blocks once.
    """
    chosen = nodes.filter(~F.col("deprecated") & ~F.col("forgotten") & (F.col("node_type") != "thing") & (F.length(F.regexp_replace("content", r"\s", "")) >= least))
    reps = chosen.select(F.col("node_id").alias("id")).join(vectors, "id").groupBy("embedding").agg(F.min_by("id", "ord").alias("id"), F.min("ord").alias("ord"))
    n = reps.count()
    blocks = max(1, math.ceil(n / 8192), min(4, math.ceil(n / 512)))
    own = reps.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = own.select("id", "ord", "embedding", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own")

    def near(t: pa.Table) -> pa.Table:
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        side = t["own"].to_numpy()
        x, ids, order = _matrix(t["embedding"]), np.array(t["id"].to_pylist()), t["ord"].to_numpy()
        x = x / np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]
        a, b = np.flatnonzero(side == i), np.flatnonzero(side == j)
        out = []
        for at in range(0, len(a), 512):
            s = x[a[at : at + 512]] @ x[b].T
            p, q = np.nonzero((np.round(s, 9) >= threshold) & ((order[a[at : at + 512]][:, None] < order[b][None]) if i == j else True))
            u, v = a[at : at + 512][p], b[q]
            swap = order[u] > order[v]
            out.append((np.where(swap, ids[v], ids[u]), np.where(swap, ids[u], ids[v]), s[p, q]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.array([], dtype=str)] * 2 + [np.array([])]
        return pa.table({"a": pa.array(cols[0].tolist(), pa.string()), "b": pa.array(cols[1].tolist(), pa.string()), "score": pa.array(cols[2], pa.float64())})

    return met.groupBy("i", "j").applyInArrow(near, "a string, b string, score double")
