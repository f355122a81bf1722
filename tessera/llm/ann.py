"""Nearest neighbours by additive quantisation: residual codebooks, beam-search codes, table scoring, exact checks by error bounds."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import uniform
from tessera.session import materialize

STAGES = 24
WORDS = 256
BEAM = 4
SAMPLE = 16_384
SHORTLIST = 160
#: A row goes to each block of queries, a query to each block of rows; with these, 0.01 n queries copy a row n / 6,553,600 times.
CODE_BLOCK = 65_536
QUERY_BLOCK = 65_536
#: Bounds on rounding errors, relative to the squared sum of the two norms: of table scores (32 bits), of inner products (64 bits).
CODE_SLACK, EXACT_SLACK = 1e-4, 1e-13


@dataclass
class Quantiser:
    """books[m] is a codebook of full-dimensional vectors; a vector, moved and scaled, is near the sum of one from each."""

    books: np.ndarray  # stages, words, dimensions
    centre: np.ndarray
    scale: float

    @classmethod
    def fit(cls, sample: np.ndarray, stages: int = STAGES, words: int = WORDS, rounds: int = 6) -> Quantiser:
        """Each codebook is the k-means of what the ones before leave of the sample."""
        centre = sample.mean(0, dtype=np.float64)
        scale = float(np.sqrt(((sample - centre) ** 2).sum(1).mean())) or 1.0
        rng, rest, books = np.random.default_rng(11), ((sample - centre) / scale).astype(np.float32), []
        for _ in range(stages):
            book = rest[rng.choice(len(rest), words, replace=len(rest) < words)].copy()
            for _ in range(rounds):
                near = cls.nearest(rest, book)
                n = np.bincount(near, minlength=words)
                order = np.argsort(near, kind="stable")
                sums = np.zeros_like(book)
                full = np.flatnonzero(n)
                sums[full] = np.add.reduceat(rest[order], np.r_[0, np.cumsum(n[full])[:-1]], axis=0)
                book = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], rest[rng.choice(len(rest), words)])
            books.append(book.astype(np.float32))
            rest = rest - books[-1][cls.nearest(rest, books[-1])]
        return cls(np.stack(books), centre, scale)

    @staticmethod
    def nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
        return ((book * book).sum(1) - 2 * x @ book.T).argmin(1)

    def moved(self, x: np.ndarray) -> np.ndarray:
        """Vectors as the codebooks know them."""
        with np.errstate(over="ignore"):
            return ((x - self.centre) / self.scale).astype(np.float32)

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes (n, stages), squared norms of the sums they stand for, and how far the moved vectors are from these; the beam keeps the
        best partial sums."""
        x, n, rows = self.moved(x), len(x), np.arange(len(x))[:, None]
        rest, codes = x[:, None, :], np.zeros((n, 1, 0), dtype=np.uint8)
        with np.errstate(over="ignore", invalid="ignore"):
            for book in self.books:
                error = ((rest**2).sum(-1)[:, :, None] - 2 * rest @ book.T + (book * book).sum(1)).reshape(n, -1)
                best = np.argpartition(error, min(beam, error.shape[1]) - 1, axis=1)[:, :beam]
                at, word = best // len(book), best % len(book)
                codes = np.concatenate([codes[rows, at], word[:, :, None].astype(np.uint8)], axis=2)
                rest = rest[rows, at] - book[word]
            pick = (rest**2).sum(-1).argmin(1)[:, None]
            left = rest[rows, pick][:, 0]
            return codes[rows, pick][:, 0], ((x - left) ** 2).sum(1), np.sqrt((left.astype(np.float64) ** 2).sum(1)) * (1 + 1e-6)

    def scores(self, queries: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Squared distances of moved queries less the query's own norm: |sum|^2 - 2 <q, sum>, from tables of all inner products."""
        tables = np.einsum("qd,mkd->mqk", queries, self.books)
        out = np.repeat(norms[None, :].astype(np.float32), len(queries), axis=0)
        for table, code in zip(tables, codes.T, strict=True):
            out -= 2 * table[:, code]
        return out

    def squares(self, queries: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Squared distances of the moved queries from what the codes stand for."""
        q = self.moved(queries)
        with np.errstate(over="ignore", invalid="ignore"):
            return np.nan_to_num((q.astype(np.float64) ** 2).sum(1)[:, None] + self.scores(q, codes, norms), nan=np.inf, neginf=np.inf)

    def may_reach(self, squares: np.ndarray, queries: np.ndarray, norms: np.ndarray, errors: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """Which rows may be within a distance of each query: a vector's distance is at least that of its code less its own error."""
        with np.errstate(over="ignore", invalid="ignore"):
            own = np.sqrt((self.moved(queries).astype(np.float64) ** 2).sum(1))
            slack = CODE_SLACK * (own[:, None] + np.sqrt(norms)[None, :]) ** 2
            least = np.sqrt(np.maximum(squares - slack, 0)) - errors
            return ~((least > (reach / self.scale)[:, None] * (1 + 1e-6)) & np.isfinite(squares))  # what can't be told may reach


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding where that is not null, not zero, and without null or non-finite parts."""
    real = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select("vec_id", "embedding").filter(F.col("embedding").isNotNull() & real & F.exists("embedding", lambda x: x != 0))


def fit(good: DataFrame, sample: int = SAMPLE) -> Quantiser | None:
    """A quantiser of about `sample` distinct vectors, chosen by a hash of vec_id."""
    rate = sample / max(good.count(), 1)
    rows = good.filter(uniform(F.col("vec_id")) < rate).select("embedding").toPandas() if rate < 1 else good.select("embedding").toPandas()
    return Quantiser.fit(np.unique(np.array(rows["embedding"].tolist(), dtype=np.float64), axis=0)) if len(rows) else None


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(whole), -1)


def encode(vectors: DataFrame, quantiser: Quantiser, piece: int = 1024) -> DataFrame:
    """vec_id, embedding, codes (binary), norm, error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, piece):
                part = batch.slice(at, piece)
                codes, norms, errors = quantiser.encode(_matrix(part.column(1)))
                columns = [part.column(0), part.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms, pa.float32()), pa.array(errors, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "embedding", "codes", "norm", "error"])

    kind = vectors.schema["embedding"].dataType.simpleString()
    return vectors.select("vec_id", "embedding").mapInArrow(run, f"vec_id long, embedding {kind}, codes binary, norm float, error double")


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, squares added one dimension after the other in double precision."""
    total = np.zeros(len(x))
    for a, b in zip(x.T, y.T, strict=True):
        total += (a - b) * (a - b)
    return np.sqrt(total)


def nearest(ids: np.ndarray, vectors: np.ndarray, coded: tuple[np.ndarray, np.ndarray, np.ndarray], queries: np.ndarray, quantiser: Quantiser, k: int, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its k nearest of some rows, exactly: its place, their ids and distances, ties to smaller ids.

    The codes tell which rows are in doubt once the `size` best have been measured; those are measured by inner products, and what is
    left of them by differences. ids ascend.
    """
    around = vectors - quantiser.centre
    norms = (around * around).sum(1)
    for at in range(0, len(queries), 32):
        asked = queries[at : at + 32]

        squares = quantiser.squares(asked, *coded[:2])
        near = np.argpartition(squares, min(size, len(ids)) - 1, axis=1)[:, :size]
        found = distances(vectors[near.ravel()], np.repeat(asked, near.shape[1], axis=0)).reshape(near.shape)
        reach = np.partition(found, k - 1, axis=1)[:, k - 1] if near.shape[1] >= k else np.full(len(asked), np.inf)
        doubt = quantiser.may_reach(squares, asked, *coded[1:], reach)
        some = np.flatnonzero(doubt.any(0))
        q = asked - quantiser.centre
        own = (q * q).sum(1)
        with np.errstate(over="ignore", invalid="ignore"):
            squares = own[:, None] + norms[some] - 2 * q @ around[some].T
            slack = EXACT_SLACK * (np.sqrt(own)[:, None] + np.sqrt(norms[some])) ** 2
            still = doubt[:, some] & ~(squares - slack > (reach * reach * (1 + 1e-9))[:, None])
        which, row = np.nonzero(still)
        row = some[row]
        found = np.concatenate([distances(vectors[row[i : i + 65_536]], asked[which[i : i + 65_536]]) for i in range(0, max(len(row), 1), 65_536)])
        ends = np.searchsorted(which, np.arange(len(asked) + 1))
        for i in range(len(asked)):
            own_rows, own_found = row[ends[i] : ends[i + 1]], found[ends[i] : ends[i + 1]]
            best = np.argsort(own_found, kind="stable")[:k]  # by id
            yield at + i, ids[own_rows[best]], own_found[best]


def shortlist(codes: DataFrame, queries: DataFrame, quantiser: Quantiser, k: int, size: int = SHORTLIST) -> DataFrame:
    """query_id, vec_id, score: for every query the k nearest rows, ties to the smaller vec_id.

    Blocks of rows meet blocks of queries; a block pair gives its nearest, of which a window keeps the nearest. Groups are
    bounded by the two block sizes.
    """
    n, n_queries, cores = codes.count(), queries.count(), codes.sparkSession.sparkContext.defaultParallelism
    code_blocks = max(math.ceil(n / CODE_BLOCK), min(cores, math.ceil(n / 8192)), 1)
    query_blocks = max(math.ceil(n_queries / QUERY_BLOCK), 1)
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = codes.withColumn("cb", F.pmod(F.xxhash64("vec_id"), F.lit(code_blocks)).cast("int")).withColumn("qb", each(query_blocks))
    right = queries.withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int")).withColumn("cb", each(code_blocks))

    def best(block: pa.Table, asked: pa.Table) -> pa.Table:
        kinds = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not block.num_rows or not asked.num_rows:
            return kinds.empty_table()
        block = block.sort_by("vec_id")
        ids = block["vec_id"].to_numpy()
        coded = np.frombuffer(b"".join(block["codes"].to_pylist()), dtype=np.uint8).reshape(len(ids), -1), block["norm"].to_numpy(), block["error"].to_numpy()
        query_ids, out = asked["vec_id"].to_numpy(), []
        for i, near, found in nearest(ids, _matrix(block["embedding"]), coded, _matrix(asked["embedding"]), quantiser, k, size):
            out.append((np.full(len(near), query_ids[i]), near, found))
        return pa.table([np.concatenate(c) for c in zip(*out, strict=True)], schema=kinds)

    pairs = left.groupBy("cb", "qb").cogroup(right.groupBy("cb", "qb")).applyInArrow(best, "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return pairs.withColumn("place", place).filter(F.col("place") <= k).drop("place")


def search(vectors: DataFrame, is_query: Column, k: int = 10, size: int = SHORTLIST) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row its k nearest of all other rows.

    score is the Euclidean distance of the original vectors in double precision. Equal vectors are searched as one,
    by the smallest ids of each such class (the window drops the others map-side), so copies never crowd a shortlist
    and ties go to the smaller vec_id. vec_ids are taken as unique; unusable vectors (see usable) take no part,
    as candidate or query. Vectors of different lengths have no distance: each length is a search of its own. Other columns
    are not read. No usable vector, no rows.

    Every query is scored against every code: lists by coarse cells were tried and left out, since on vectors without clusters
    a bounded number of lists does not hold 0.9 of the neighbours (README). Codes alone don't tell vectors apart that are nearer to each
    other than to what their codes stand for, so rows are left out by the codes' error bounds only, and the result is exact.
    """
    good = materialize(usable(vectors), "vectors")
    lengths = [r["n"] for r in good.select(F.size("embedding").alias("n")).distinct().orderBy("n").collect()]
    if not lengths:
        return good.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    found = [_search(good if len(lengths) == 1 else good.filter(F.size("embedding") == n), is_query, k, size) for n in lengths]
    return reduce(DataFrame.unionByName, found)


def _search(good: DataFrame, is_query: Column, k: int, size: int) -> DataFrame:
    quantiser = fit(good)
    same = Window.partitionBy("embedding")
    first = good.withColumn("place", F.row_number().over(same.orderBy("vec_id"))).filter(F.col("place") <= k + 1)
    members = materialize(first.withColumn("rep", F.min("vec_id").over(same)), "members")
    reps = members.filter("place = 1").select("vec_id", "embedding")
    queries = good.filter(is_query)
    near = shortlist(materialize(encode(reps, quantiser), "codes"), queries, quantiser, k + 1, max(size, k + 1))
    classes = near.withColumnRenamed("vec_id", "rep")
    rows = classes.join(members.select("rep", "vec_id"), "rep").filter("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
