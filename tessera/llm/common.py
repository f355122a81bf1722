"""Expressions and numbering shared by the operators of this subpackage."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialize

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Words of a text as long; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def frequent(table: DataFrame, count: Column, most: int) -> Column:
    """A condition that holds for the most frequent rows of a table, `most` of them at most, whatever the table.

    Counts fall into 16 classes for each doubling, of which the driver gets a histogram; whole classes are taken from the top.
    """
    level = F.floor(F.log2(count.cast("double")) * 16).cast("int")
    least, held = None, 0
    for r in sorted(table.groupBy(level.alias("level")).count().collect(), key=lambda r: -(r["level"] or 0)):
        held += r["count"]
        if held > most:
            break
        least = r["level"]
    return F.lit(False) if least is None else F.coalesce(level >= least, F.lit(False))


def uniform(*ids: Column) -> Column:
    """A reproducible number in (0, 1) for each id, the same in any engine that has MD5."""
    digest = F.md5(F.concat_ws("|", *[F.coalesce(i.cast("string"), F.lit("null")) for i in ids]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def clear_names(df: DataFrame, names: list[str]) -> DataFrame:
    """Drop input columns that an operator is about to add, so that extra columns never clash."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores before it as it takes to be no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: A filter has 16 bits for each key, in blocks of BLOCK bits, and MOST_BITS (32 MB) at most, however many keys there are.
BLOCK, MOST_BITS = 18, 28


def _probes(h: np.ndarray, blocks: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The block of each 64-bit hash and its three bits there."""
    low = np.uint64((1 << BLOCK) - 1)
    block = (h >> np.uint64(54)).astype(np.int64) % blocks
    return block, [((h >> np.uint64(BLOCK * k)) & low).astype(np.int64) for k in range(3)]


class Bloom:
    """A Bloom filter of the long column `key` of a table.

    keys is read twice, so it is a written table. Every block is built by a task of its own; the driver gathers and broadcasts
    the blocks, of 2^most_bits bits in all at most. Beyond some sixteen million keys the rate of false answers rises (0.005
    before), up to a filter that answers yes to all: callers check what passes by a join, so results never depend on it.
    """

    def __init__(self, keys: DataFrame, most_bits: int = MOST_BITS):
        size = 1 << min(most_bits, max(BLOCK, math.ceil(math.log2(16 * keys.count() + 1))))
        blocks = size >> BLOCK

        def build(part: pa.Table) -> pa.Table:
            bits = np.zeros(1 << BLOCK, dtype=np.uint8)
            for at in _probes(part["key"].to_numpy().view(np.uint64), blocks)[1]:
                bits[at] = 1
            return pa.table({"block": pa.array([part["block"][0].as_py()], pa.int32()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

        dealt = keys.select("key", F.pmod(F.shiftrightunsigned("key", 54), F.lit(blocks)).cast("int").alias("block"))
        whole = np.zeros((blocks, 1 << (BLOCK - 3)), dtype=np.uint8)
        for r in dealt.groupBy("block").applyInArrow(build, "block int, bits binary").collect():
            whole[r["block"]] = np.frombuffer(r["bits"], dtype=np.uint8)
        self.shared = keys.sparkSession.sparkContext.broadcast(whole)

    def holds(self, h: np.ndarray) -> np.ndarray:
        """Whether the filter may hold each 64-bit hash."""
        whole = self.shared.value
        block, bits = _probes(h.view(np.uint64), len(whole))
        found = np.ones(len(h), dtype=bool)
        for at in bits:
            found &= (whole[block, at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return found

    def column(self, h: Column) -> Column:
        @F.pandas_udf("boolean")
        def held(h: pd.Series) -> pd.Series:
            return pd.Series(self.holds(h.to_numpy(dtype=np.int64)))

        return held(h)


def parted(df: DataFrame, keys: DataFrame, on: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """The rows of df that surely meet no row of keys (a written table), and those that may, by the columns `on`.

    Keys are given by name, with their expressions over df. Wide rows of the first part need no shuffle; only the second has to
    be joined. Nulls are keys like any other.
    """
    held = Bloom(keys.select(F.xxhash64(*on).alias("key"))).column(F.xxhash64(*on.values()))
    return df.filter(~held), df.filter(held)


def member_state(first: Bloom, second: Bloom, h: np.ndarray) -> np.ndarray:
    """For each key hash 0 (no member), 1 (a member) or 2 (in doubt), by the filters of Members."""
    held = first.holds(h)
    return held.astype(np.int8) + (held & second.holds(h))


class Members:
    """Exact membership of long keys in ids, for rows that are not to move: two Bloom filters and the few keys in doubt.

    The first filter holds the ids; the second those keys of df that the first takes for ids and that are none. A key in both is in
    doubt. df and ids have the column `on`; ids is a written table of distinct values.
    """

    def __init__(self, df: DataFrame, ids: DataFrame, on: str):
        self.ids, self.on, self.key = ids, on, F.xxhash64(on)
        self.first = Bloom(ids.select(self.key.alias("key")))
        wrong = df.select(on).filter(self.first.column(self.key)).join(ids, on, "left_anti").distinct()
        self.second = Bloom(materialize(wrong.select(self.key.alias("key")), "wrong"))

    @property
    def filters(self) -> tuple[Bloom, Bloom]:
        return self.first, self.second

    def doubtful(self, df: DataFrame) -> DataFrame:
        """The rows of df whose key is in doubt, joined with the ids for the boolean column `member`."""
        rows = df.filter(self.first.column(self.key) & self.second.column(self.key))
        return rows.join(self.ids.select(self.on, F.lit(True).alias("member")), self.on, "left").withColumn("member", F.coalesce("member", F.lit(False)))


def running(df: DataFrame, keys: list[str], bucket: str, order: list[Column], value: Column, totals: DataFrame) -> DataFrame:
    """Adds `_before`: the sum of value over all rows of the same keys that come earlier by (bucket, order).

    totals has keys, bucket, bucket_total and what else is to be added: a bounded number of buckets per key. Each (keys, bucket) is a task's
    own small window and the buckets' prefix sums are added, so a key with a third of all rows is no one task's work.
    Rows that tie in order are alike or the order is completed by the caller.
    """
    by_key = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_offset", F.coalesce(F.sum("bucket_total").over(by_key), F.lit(0))).drop("bucket_total")
    own = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    numbered = df.withColumn("_within", F.coalesce(F.sum(value).over(own), F.lit(0)))
    return numbered.join(offsets, [*keys, bucket]).withColumn("_before", F.col("_offset") + F.col("_within")).drop("_offset", "_within")
