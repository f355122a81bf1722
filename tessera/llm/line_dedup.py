"""Line dedup: lines within one word edit of an earlier line go, found by a deletion-neighbourhood join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Bloom
from tessera.session import discard, materialize

LEAST = 5
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def signed_hash(words: list[bytes], *more: int) -> int:
    """A signed 64-bit hash of a word sequence and some numbers."""
    h = xxhash.xxh64_intdigest(b"\x1f".join([*words, *[b"%d" % m for m in more]]), len(words))
    return h - (1 << 64) if h >= 1 << 63 else h


def halves(words: list[bytes]) -> list[int]:
    """Keys of which two lines within one edit share at least one.

    Let m be the words of the shorter line. Either the first m // 2 words are untouched or the last m // 2 are. A line
    is the shorter one of its pair (or as long) with m = n, or the longer one with m = n - 1.
    """
    n = len(words)
    return [signed_hash(part, m, side) for m in (n, n - 1) for side, part in enumerate((words[: m // 2], words[n - m // 2 :]))]


def within_one(a: list[bytes], b: list[bytes]) -> bool:
    """Whether at most one word was replaced, inserted or deleted."""
    short, long = sorted((a, b), key=len)
    if len(long) - len(short) > 1:
        return False
    at = next((i for i, (x, y) in enumerate(zip(short, long, strict=False)) if x != y), len(short))
    return short[at + (len(short) == len(long)) :] == long[at + 1 :]


def variants(words: list[bytes]) -> np.ndarray:
    """Signed hashes of the line without each of its words in turn, then of the whole line, in time linear in its words.

    A line's hash is the sum of its words' hashes times BASE to the power of their place, modulo 2^64: without word i
    the words before it keep their places and those after it move by one.
    """
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    with np.errstate(over="ignore"):
        terms = h * np.cumprod(np.full(len(h), BASE, dtype=np.uint64))
        upto = np.cumsum(terms, dtype=np.uint64)
        total = upto[-1:]
        less = upto - terms + (total - upto) * np.uint64(INVERSE)
    return np.concatenate([less, total]).view(np.int64)


def scan(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """row, doc_id, line, hash, n, keys: a row for each line with a word, and one with null line for each document.

    White space never counts. keys is empty below `least` words; n of a document's own row is its number of lines.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]

            def add(*values: object, out: list[list] = out) -> None:
                for column, value in zip(out, values, strict=True):
                    column.append(value)

            for row, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
                lines = text.as_py().split(b"\n") if text.is_valid else []
                add(row, doc, None, None, len(lines), [])
                for at, words in enumerate(map(bytes.split, lines)):
                    if words:
                        add(row, doc, at, signed_hash(words), len(words), halves(words) if len(words) >= least else [])
            kinds = [pa.int64(), batch.schema.field(1).type, pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["row", "doc_id", "line", "hash", "n", "keys"])

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return numbered.mapInArrow(run, f"row long, doc_id {kind}, line int, hash long, n int, keys array<long>")


def contents(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """hash, first, content of the lines whose first occurrence (first.doc_id, first.line) is asked for.

    A second scan hashes the lines again and passes on those that a Bloom filter, sized by the number of lines asked for, may
    hold; the join decides. So the other lines' texts are not shuffled, as long as the filter has room (see Bloom).
    """
    kind, asked = dict(docs.dtypes)["doc_id"], Bloom(firsts.select(F.col("hash").alias("key")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                lines = text.as_py().split(b"\n") if text.is_valid else []
                full = [(at, w) for at, w in enumerate(map(bytes.split, lines)) if w]
                hashes = np.array([signed_hash(w) for _, w in full], dtype=np.int64)
                for k in np.flatnonzero(asked.holds(hashes)).tolist():
                    for column, value in zip(out, (doc, full[k][0], hashes[k], lines[full[k][0]]), strict=True):
                        column.append(value)
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["_doc", "_line", "_hash", "content"])

    found = docs.select("doc_id", "text").mapInArrow(run, f"_doc {kind}, _line int, _hash long, content string")
    place = F.col("_doc").eqNullSafe(F.col("first.doc_id")) & (F.col("_line") == F.col("first.line"))  # keys too: a hot line is dealt by document
    met = found.join(firsts.select("hash", "first"), (F.col("_hash") == F.col("hash")) & place)
    return met.select("hash", "first", "content").dropDuplicates(["hash"])


def deletions(chosen: DataFrame) -> DataFrame:
    """hash, first, less, at, n: for each word of each line the hash of the line without it; at = n is the whole line."""

    @F.pandas_udf("array<long>")
    def every(content: pd.Series) -> pd.Series:
        return content.map(lambda c: variants(c.encode().split()))

    held = chosen.select("hash", "first", every("content").alias("every"))
    return held.select("hash", "first", (F.size("every") - 1).alias("n"), F.posexplode("every").alias("at", "less"))


def earlier(chosen: DataFrame) -> DataFrame:
    """hash, partner: for each line with an earlier line within the bound, the earliest such line.

    Lines without their word at one place share a deletion at it if they differ there alone: the earliest of a group is
    the partner of the rest. A deletion that is a whole line joins the two, either of which may be the earlier. No
    group's pairs are formed: a deletion meets its group's minimum and at most one line.
    """
    emitted = materialize(deletions(chosen), "deletions")  # read four times
    shorter_by_one = emitted.filter("at < n")
    best = F.min(F.struct("first", "hash"))
    groups = shorter_by_one.groupBy("less", "at", "n").agg(best.alias("best"), F.count(F.lit(1)).alias("members")).filter("members > 1").drop("members")
    replaced = shorter_by_one.join(groups, ["less", "at", "n"]).filter("best.hash <> hash").select("hash", F.col("best.first").alias("first"), F.col("best.hash").alias("partner"))
    whole = emitted.filter("at = n").select("less", F.col("hash").alias("whole_hash"), F.col("first").alias("whole_first"))
    met = materialize(shorter_by_one.select("hash", "first", "less").join(whole, "less"), "met")
    shorter = met.filter("whole_first < first").select("hash", F.col("whole_first").alias("first"), F.col("whole_hash").alias("partner"))
    longer = met.filter("first < whole_first").select(F.col("whole_hash").alias("hash"), "first", F.col("hash").alias("partner"))
    linked = replaced.union(shorter).union(longer).groupBy("hash").agg(F.min(F.struct("first", "partner")).alias("to"))
    pairs = linked.select("hash", F.col("to.partner").alias("partner"))

    @F.pandas_udf("boolean")
    def verified(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([within_one(x.encode().split(), y.encode().split()) for x, y in zip(a, b, strict=True)], dtype=bool)

    text = chosen.select("hash", "content")
    both = pairs.join(text, "hash").join(text.select(F.col("hash").alias("partner"), F.col("content").alias("other")), "partner")
    return both.filter(verified("content", "other")).select("hash", "partner")


def line_dedup(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_lines, n_dropped, dropped (ascending line numbers from 0) for every document.

    A line goes if an earlier line has the same words, or the same but for one word replaced, inserted or deleted, both
    having `least` words or more (one edit in five is a similarity of 0.8). Lines of fewer words go only if equal, and a line with two
    edits stays, however long. Lines and deletions are told apart by 64-bit hashes; of a line's partners by hash the earliest is
    verified, so a collision could keep a line, never drop one. Earlier means by doc_id (null last), then by
    line; earlier lines count whether they stay or not, so the result needs no order of work. Blank lines stay. Null
    texts have no lines. Rows repeated with one doc_id are documents of their own. Other columns are not read.
    """
    lines = materialize(scan(docs, least), "lines")
    keyed = lines.select("hash", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("hash").alias("lo"), F.max("hash").alias("hi")).filter("lo < hi").select("key")
    near = keyed.join(shared, "key", "left_semi").select("hash").distinct()
    position: Column = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "line")
    firsts = materialize(lines.filter("line IS NOT NULL").groupBy("hash").agg(F.min(position).alias("first")), "firsts")
    asked = materialize(firsts.join(near, "hash", "left_semi"), "asked")
    chosen = materialize(contents(docs, asked), "chosen")
    discard(asked)
    gone = firsts.join(earlier(chosen), "hash", "left").select("hash", F.col("first.row").alias("first_row"), F.col("first.line").alias("first_line"), F.col("partner").isNotNull().alias("late"))
    gone = materialize(gone, "gone")
    discard(firsts, chosen)
    # gone is written so that both sides of the next join are plain shuffles, which Spark can split at hot lines
    judged = lines.filter("line IS NOT NULL").select("row", "line", "hash").join(gone, "hash")
    out = F.col("late") | (F.col("first_row") != F.col("row")) | (F.col("first_line") != F.col("line"))
    dropped = judged.filter(out).select("row", F.lit(None).cast(dict(docs.dtypes)["doc_id"]).alias("doc_id"), F.col("line").alias("out"), F.lit(None).cast("int").alias("n"))
    return (
        dropped.union(lines.filter("line IS NULL").select("row", "doc_id", "line", "n"))
        .groupBy("row")
        .agg(
            F.first("doc_id", ignorenulls=True).alias("doc_id"),
            F.max("n").cast("long").alias("n_lines"),
            F.count("out").alias("n_dropped"),
            F.sort_array(F.collect_list("out")).alias("dropped"),
        )
        .drop("row")
    )


def drop_lines(docs: DataFrame, verdict: DataFrame) -> DataFrame:
    """docs with the dropped lines taken out of their texts, for tables in which doc_id is unique."""
    joined = docs.join(verdict.select("doc_id", "dropped"), "doc_id", "left")
    lines = F.filter(F.split("text", "\n", -1), lambda line, i: ~F.array_contains(F.coalesce("dropped", F.array().cast("array<int>")), i))
    return joined.withColumn("text", F.array_join(lines, "\n")).select(*docs.columns)
