"""Sharding by bytes: minimax contiguous partition of ordered atomic groups, found by binary search on the capacity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import running
from tessera.session import materialize

SHARDS = 40
BLOCK_BITS = 14
SALT = 512

# One row holds all atoms, in order, as an array of (order columns, size); these expressions fold over it.
_FEASIBLE = """
aggregate(atoms, named_struct('n', 1, 'acc', 0L),
  (s, a) -> IF(s.acc + a.size <= (b.lo + b.hi) DIV 2,
    named_struct('n', s.n, 'acc', s.acc + a.size),
    named_struct('n', s.n + 1, 'acc', a.size)),
  s -> s.n <= {shards})
"""
_CAPACITY = """
aggregate(sequence(1, 62), named_struct('lo', least_capacity, 'hi', least_capacity + largest),
  (b, i) -> CASE WHEN b.lo >= b.hi THEN b
    WHEN {feasible} THEN named_struct('lo', b.lo, 'hi', (b.lo + b.hi) DIV 2)
    ELSE named_struct('lo', (b.lo + b.hi) DIV 2 + 1, 'hi', b.hi) END,
  b -> b.lo)
"""
# Greedy from the end: the positions at which what follows, with the atom itself, needs one shard more.
_BREAKS = """
aggregate(sequence(size(atoms), 1, -1), named_struct('acc', 0L, 'at', CAST(array() AS ARRAY<INT>)),
  (s, i) -> IF(s.acc + atoms[i - 1].size <= capacity,
    named_struct('acc', s.acc + atoms[i - 1].size, 'at', s.at),
    named_struct('acc', atoms[i - 1].size, 'at', concat(s.at, array(i)))),
  s -> s.at)
"""
# Forward: close a shard at the capacity, or once it has its part of what is left and the rest still fits.
_CUTS = """
aggregate(sequence(1, size(atoms)), named_struct('j', 0, 'acc', 0L, 'left', total, 'at', CAST(array() AS ARRAY<INT>)),
  (s, i) -> IF(s.acc > 0 AND (s.acc + atoms[i - 1].size > capacity
        OR (s.j < {last} AND s.acc + atoms[i - 1].size / 2.0D > s.left / ({shards}.0D - s.j)
            AND size(filter(breaks, x -> x >= i)) + 1 <= {last} - s.j)),
    named_struct('j', s.j + 1, 'acc', atoms[i - 1].size, 'left', s.left - s.acc, 'at', concat(s.at, array(i))),
    named_struct('j', s.j, 'acc', s.acc + atoms[i - 1].size, 'left', s.left, 'at', s.at)),
  s -> s.at)
"""


def atoms_of(sized: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """Atoms of (block, hash, size) rows: block, heavy, hash, size; fewer than 5/4 of the number of blocks.

    Rows of equal hash are one group, and a block is a range of hashes, so no block cuts a group. Groups larger than
    four mean blocks are atoms of their own (fewer than a quarter of the blocks); what else a block holds is one atom.
    In a small table nearly every group is an atom. Only the rows of blocks that large are grouped by hash.
    """
    blocks = materialize(sized.groupBy("block").agg(F.sum("size").alias("block_size")), "blocks")
    mean = (blocks.agg(F.sum("block_size")).first()[0] or 0) / (1 << block_bits)
    full = F.broadcast(blocks.filter(F.col("block_size") > 4 * mean).select("block"))  # at most a quarter of the blocks
    groups = sized.join(full, "block", "left_semi").groupBy("block", "hash").agg(F.sum("size").alias("size"))
    heavy = materialize(groups.filter(F.col("size") > 4 * mean), "heavy")
    rest = blocks.join(heavy.groupBy("block").agg(F.sum("size").alias("own")), "block", "left").select(
        "block", F.lit(False).alias("heavy"), F.lit(0).cast("long").alias("hash"), (F.col("block_size") - F.coalesce("own", F.lit(0))).alias("size")
    )
    return rest.filter("size > 0").unionByName(heavy.select("block", F.lit(True).alias("heavy"), "hash", "size"))


def partition(atoms: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Atoms with their shard and the capacity: block, heavy, hash, size, shard, capacity.

    The capacity is the smallest for which greedy filling in order needs no more than `shards` shards. Atoms above
    the mean shard come first, so that the shards after a hot group share the rest evenly; the others are in hash order.
    """
    ordered = atoms.agg(F.sum("size").alias("total"), F.max("size").alias("largest"), F.collect_list(F.struct("block", "heavy", "hash", "size")).alias("found"))
    ordered = ordered.filter("total IS NOT NULL").select(
        "total",
        "largest",
        F.expr(f"greatest(largest, CAST(ceil(total / {shards}.0D) AS BIGINT))").alias("least_capacity"),
        F.expr(
            f"array_sort(transform(found, a -> named_struct('front', IF(a.size * {shards}.0D > total, -a.size, 0L), 'block', a.block, 'heavy', a.heavy, 'hash', a.hash, 'size', a.size)))"
        ).alias("atoms"),
    )
    cut = (
        ordered.withColumn("capacity", F.expr(_CAPACITY.format(feasible=_FEASIBLE.format(shards=shards))))
        .withColumn("breaks", F.expr(_BREAKS))
        .withColumn("cuts", F.expr(_CUTS.format(shards=shards, last=shards - 1)))
        .select("atoms", "capacity", "cuts")
    )
    cut = materialize(cut, "cuts")  # one row; else each use would search again
    at = cut.select("capacity", "cuts", F.posexplode("atoms").alias("at", "atom"))
    return at.select("atom.block", "atom.heavy", "atom.hash", "atom.size", F.expr("size(filter(cuts, c -> c <= at + 1))").alias("shard"), "capacity")


def shard(docs: DataFrame, shards: int = SHARDS, block_bits: int = BLOCK_BITS) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null) for every document.

    Size is the text's UTF-8 bytes plus 16. Equal texts share a shard; a null text counts as an empty one (CRC 0).
    Slots number a shard's documents from 0 without gaps: rows are salted by doc_id, numbered within their salt and
    moved by the salts' prefix counts. Repeated rows get slots of their own, even with one doc_id. Other columns are
    not read. An empty table gives an empty result; with fewer groups than shards some shards stay empty.
    """
    text = F.coalesce("text", F.lit(""))
    hash64 = F.xxhash64(text)
    sized = materialize(
        docs.select(
            "doc_id",
            (F.octet_length(text) + F.lit(16)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            hash64.alias("hash"),
            F.shiftrightunsigned(hash64, 64 - block_bits).cast("int").alias("block"),
        ),
        "sized",
    )
    where = partition(atoms_of(sized, block_bits), shards)
    light = F.broadcast(where.filter("NOT heavy").select("block", F.col("shard").alias("light_shard")))
    heavy = F.broadcast(where.filter("heavy").select("block", "hash", F.col("shard").alias("heavy_shard")))
    placed = (
        sized.join(heavy, ["block", "hash"], "left")
        .join(light, "block", "left")
        .select("doc_id", "size", "text_crc32", F.coalesce("heavy_shard", "light_shard").alias("shard"), F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int").alias("salt"))
    )
    totals = placed.groupBy("shard", "salt").agg(F.count(F.lit(1)).alias("bucket_total"))
    return running(placed, ["shard"], "salt", [F.col("doc_id"), F.col("size"), F.col("text_crc32")], F.lit(1), totals).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("_before").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
