"""Packing into optimal length buckets: boundaries by dynamic programming over the global histogram, then batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import n_words, running
from tessera.session import materialize

BUCKETS = 16
TOKENS = 65536
EXACT = 4096
FINE = 256
SALT = 1024


def cell(length: Column, exact: int = EXACT, fine: int = FINE) -> Column:
    """Histogram cell of a length: the length itself up to `exact`, then `fine` cells for each doubling.

    The number of cells is bounded whatever the lengths: exact + 64 * fine at most.
    """
    grid = exact + F.floor(F.log2(length / float(exact)) * fine)
    return F.when(length <= exact, length).otherwise(F.greatest(grid, F.lit(exact + 1))).cast("long")


def histogram(lengths: DataFrame) -> DataFrame:
    """cell, top (its largest length), rows and total for a table with the column length; sums run map-side first."""
    return lengths.groupBy(cell(F.col("length")).alias("cell")).agg(
        F.max("length").alias("top"), F.count(F.lit(1)).alias("rows"), F.sum("length").alias("total")
    )


def boundaries(tops: list[int], rows: list[int], totals: list[int], buckets: int = BUCKETS) -> list[int]:
    """Ascending boundaries, the largest top last, for which padding every length to its boundary adds least.

    cost(i, j) = tops[j] * rows(i..j) - totals(i..j) obeys the quadrangle inequality, so the best split of each
    prefix moves one way only and a layer is solved by halving: buckets * n log n steps, in numpy by ranges.
    """
    n = len(tops)
    if n == 0:
        return []
    top = np.asarray(tops, dtype=np.float64)
    count = np.concatenate([[0.0], np.cumsum(np.asarray(rows, dtype=np.float64))])
    total = np.concatenate([[0.0], np.cumsum(np.asarray(totals, dtype=np.float64))])
    best = top * count[1:] - total[1:]
    splits = []
    for _ in range(1, min(buckets, n)):
        new, arg = best.copy(), np.zeros(n, dtype=np.int64)
        todo = [(0, n - 1, 0, n - 1)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            first = np.arange(a, min(b, mid - 1) + 1)  # the cell before which this bucket starts is `first`
            at = a
            if len(first):
                cost = best[first] + top[mid] * (count[mid + 1] - count[first + 1]) - (total[mid + 1] - total[first + 1])
                k = int(np.argmin(cost))
                at = int(first[k])
                if cost[k] < new[mid]:
                    new[mid], arg[mid] = cost[k], at + 1
            todo += [(lo, mid - 1, a, at), (mid + 1, hi, at, b)]
        splits.append(arg)
        best = new
    ends, j = [n - 1], n - 1
    for arg in reversed(splits):
        if arg[j] == 0:
            continue
        j = int(arg[j]) - 1
        ends.append(j)
    return [int(tops[e]) for e in sorted(set(ends))]


def plan(lengths: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Boundaries for a table of lengths. The driver gets the histogram, of a bounded number of cells."""
    rows = sorted((r["top"], r["rows"], r["total"]) for r in histogram(lengths.filter("length > 0")).collect())
    return boundaries(*[list(x) for x in zip(*rows, strict=True)], buckets=buckets) if rows else []


def pack(docs: DataFrame, buckets: int = BUCKETS, tokens: int = TOKENS, length: Column | None = None) -> DataFrame:
    """doc_id, n_tokens, bucket, padded (the bucket's boundary), batch, slot (place in the batch), batch_rows.

    Buckets minimise the padding of all documents (of cell tops, where lengths above 4096 share a cell). Inside a
    bucket documents are dealt by a hash of doc_id into batches of floor(tokens / padded) rows, one row where a document
    is longer than the token budget; only the last batch of a bucket may be short. Batches are numbered per bucket
    from 0. length defaults to the number of words. Null or empty texts have no tokens: bucket 0, padded 0, in one batch
    for each `tokens` rows. Repeated rows are rows of their own. Other columns are not read.
    """
    lengths = materialize(docs.select("doc_id", F.coalesce(length if length is not None else n_words(F.col("text")), F.lit(0)).cast("long").alias("length")), "lengths")
    tops = plan(lengths, buckets)
    bucket, padded = F.lit(len(tops)), F.lit(tops[-1] if tops else 0)
    for k, top in reversed(list(enumerate(tops, 1))):
        bucket, padded = F.when(F.col("length") <= top, k).otherwise(bucket), F.when(F.col("length") <= top, top).otherwise(padded)
    dealt = lengths.select(
        "doc_id",
        "length",
        F.when(F.col("length") == 0, 0).otherwise(bucket).alias("bucket"),
        F.when(F.col("length") == 0, 0).otherwise(padded).cast("long").alias("padded"),
        F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int").alias("salt"),
    )
    totals = dealt.groupBy("bucket", "salt").agg(F.count(F.lit(1)).alias("bucket_total"))
    sizes = totals.groupBy("bucket").agg(F.sum("bucket_total").alias("bucket_rows"))
    room = F.greatest(F.floor(F.lit(tokens) / F.greatest("padded", F.lit(1))), F.lit(1)).cast("long")
    numbered = running(dealt, ["bucket"], "salt", [F.col("doc_id"), F.col("length")], F.lit(1), totals.join(sizes, "bucket"))
    batch = F.floor(F.col("_before") / room)
    return numbered.select(
        "doc_id",
        F.col("length").alias("n_tokens"),
        "bucket",
        "padded",
        batch.alias("batch"),
        (F.col("_before") % room).cast("long").alias("slot"),
        F.least(room, F.col("bucket_rows") - batch * room).cast("long").alias("batch_rows"),
    )
