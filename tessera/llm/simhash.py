"""SimHash near-dedup: fingerprints of word shingles, linked by BK-trees in shards, grouped by connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import parted
from tessera.llm.components import components
from tessera.session import materialize

SEED = 42
SHARD_ROWS = 100_000
SLICE = 16_384


def shingle_hashes(text: bytes | None, width: int) -> np.ndarray:
    """XXH64 of all word shingles of a UTF-8 text, repeats included: A-Z lower-cased, split at ASCII white space.

    Fewer words than the width give one shingle of all of them; no words, none.
    """
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, SEED)], dtype=np.uint64)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts, view = [0, *ends], memoryview(joined)
    return np.fromiter((digest(view[a : z - 1], SEED) for a, z in zip(starts, ends[width - 1 :], strict=False)), dtype=np.uint64, count=len(words) - width + 1)


def _mixed(h: np.ndarray) -> np.ndarray:
    """The next 64 hash bits of each shingle (the finaliser of splitmix64 over a step by the golden ratio)."""
    with np.errstate(over="ignore"):
        h = h + np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def majority(hashes: np.ndarray, words: int = 1) -> list[int]:
    """64 * words bits, as signed 64-bit integers: a bit is 1 where over half the hashes have it."""
    out = []
    for k in range(words):
        hashes = _mixed(hashes) if k else hashes
        ones = np.zeros(64, dtype=np.int64)
        for at in range(0, len(hashes), 65536):
            part = hashes[at : at + 65536]
            ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0]))
    return out


def fingerprints(docs: DataFrame, width: int = 4, words: int = 1) -> DataFrame:
    """doc_id, text_hash and f0, f1, ... (64 bits each) of every document; a null text is empty and has fingerprint zero."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [majority(shingle_hashes(t.as_py(), width), words) for t in batch.column(2).cast(pa.binary())]
            cols = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * words
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *cols], [*batch.schema.names[:2], *[f"f{k}" for k in range(words)]])

    kind = dict(docs.dtypes)["doc_id"]
    read = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return read.mapInArrow(prints, f"doc_id {kind}, text_hash long, " + ", ".join(f"f{k} long" for k in range(words)))


def lossless_masks(count: int, radius: int = 4) -> list[list[int]]:
    """Masks of which one leaves any two 64-bit fingerprints within the radius equal.

    The bits are cut into b blocks; at most `radius` of them differ, so b - radius agree. b grows with the number of
    fingerprints so that some hundreds of unrelated ones share a key at most.
    """
    blocks = radius + 1
    while blocks < 2 * radius and count / 2 ** (64 * (blocks - radius) / blocks) > 512:
        blocks += 1
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    block = [((1 << (z - a)) - 1) << a for a, z in zip(cuts, cuts[1:], strict=False)]
    return [[sum(c)] for c in combinations(block, blocks - radius)]


def sampled_masks(count: int, words: int, radius: int, least: float = 0.99) -> list[list[int]]:
    """Masks of random bits, for radii at which no lossless choice is small enough.

    Each has about log2(count) - 8 bits, so that some hundreds of unrelated rows share a key however large the table. There
    are as many as find a pair that differs in the whole radius with probability `least`, at any count; so their number grows
    with about the cube root of the rows at 52 of 256 bits. Closer pairs meet in several tables.
    """
    bits = max(10, math.ceil(math.log2(max(count, 2))) - 8)
    meet = math.comb(64 * words - radius, bits) / math.comb(64 * words, bits)
    tables = math.ceil(math.log(1 - least) / math.log(1 - meet))
    rng = np.random.default_rng(7)
    masks = []
    for _ in range(tables):
        chosen = rng.choice(64 * words, bits, replace=False)
        masks.append([sum(1 << int(b % 64) for b in chosen if b // 64 == k) for k in range(words)])
    return masks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


class Forest:
    """BK-trees, one for each bucket, over the rows of one shard; all trees grow and are searched level by level.

    bits: (rows, words) uint64. bucket: a number for each row, equal rows adjacent; within a bucket fingerprints differ.
    parent and edge (the Hamming distance to the parent) are the trees; a parent has one child for each distance.
    """

    def __init__(self, bits: np.ndarray, bucket: np.ndarray):
        self.bits, n = bits, len(bits)
        first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        self.root = np.repeat(first, np.diff(np.r_[first, n]))
        self.parent, self.edge, self.levels = np.arange(n), np.zeros(n, dtype=np.int64), []
        rest = np.flatnonzero(self.root != np.arange(n))
        at = self.root[rest]
        while len(rest):
            code = at * 512 + self.distance(rest, at)
            codes, index, place = np.unique(code, return_index=True, return_inverse=True)
            child = rest[index]  # the first to come by an edge becomes the child; the others go on below it
            self.parent[child], self.edge[child] = at[index], codes % 512
            self.levels.append(child)
            stay = np.ones(len(rest), dtype=bool)
            stay[index] = False
            rest, at = rest[stay], child[place[stay]]
        order = np.flatnonzero(self.parent != np.arange(n))
        self.codes = self.parent[order] * 512 + self.edge[order]
        by = np.argsort(self.codes, kind="stable")
        self.codes, self.children = self.codes[by], order[by]

    def distance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.bits[a] ^ self.bits[b]).sum(axis=1, dtype=np.int64)

    def near(self, query: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """All (query row, tree row) pairs within the radius, following only edges that can lead there."""
        found, node = [(query[:0], query[:0])], self.root[query]
        while len(query):
            d = self.distance(query, node)
            hit = (d <= radius) & (query != node)
            found.append((query[hit], node[hit]))
            lo = np.searchsorted(self.codes, node * 512 + np.maximum(d - radius, 0))
            hi = np.searchsorted(self.codes, node * 512 + np.minimum(d + radius, 511), side="right")
            n = hi - lo
            query, node = np.repeat(query, n), self.children[np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]
        return np.concatenate([q for q, _ in found]), np.concatenate([x for _, x in found])

    def labels(self, radius: int, pairs: int = 200_000) -> np.ndarray:
        """For each row the smallest row that it reaches by links within the radius, in its bucket.

        Links between a child and its parent come free with the tree. Two rows that already share the bucket's largest
        group need no comparison; so only rows outside it are searched for, against the whole tree.
        """
        label = np.arange(len(self.bits))
        for child in self.levels:
            near = child[self.edge[child] <= radius]
            label[near] = label[self.parent[near]]
        sizes = np.bincount(label, minlength=len(label))
        largest = np.zeros(len(label), dtype=np.int64)
        np.maximum.at(largest, self.root, sizes[label])
        main = np.full(len(label), -1)
        top = np.flatnonzero(sizes[label] == largest[self.root])
        main[self.root[top[::-1]]] = label[top[::-1]]
        query = np.flatnonzero(label != main[self.root])
        load = np.cumsum(np.bincount(self.root, minlength=len(label))[self.root[query]])
        cuts = np.searchsorted(load, np.arange(pairs, load[-1] + pairs, pairs)) if len(query) else []
        for a, z in zip(np.r_[0, cuts], np.r_[cuts, len(query)], strict=False):
            q, x = self.near(query[int(a) : int(z)], radius)
            label = _merge(label, q, x)
        return label


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining the groups of a[i] and b[i] for every i."""
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return label
        to = np.arange(len(label))
        np.minimum.at(to, np.maximum(x, y)[differ], np.minimum(x, y)[differ])
        while (to[to] != to).any():
            to = to[to]
        label = to[label]


def links(nodes: DataFrame, masks: list[list[int]], radius: int) -> DataFrame:
    """Edges (u, v) that connect all distinct fingerprints of a bucket which links within the radius connect.

    nodes: node, f0, f1, ... A mask's bits key a bucket; a shard holds many whole buckets and grows their BK-trees. What
    a bucket gives is a star for each group in it, at most a row for each member, never all pairs. Buckets of more than
    SLICE rows are sliced by a hash: each pair of slices meets in one shard, so no task has more of one bucket than two slices.
    """
    spark, words = nodes.sparkSession, sum(c[0] == "f" and c[1:].isdigit() for c in nodes.columns)
    cols = [f"f{k}" for k in range(words)]
    key = [F.xxhash64(F.lit(t), *[F.col(c).bitwiseAND(F.lit(_signed(m))) for c, m in zip(cols, mask, strict=True)]) for t, mask in enumerate(masks)]
    keyed = nodes.select("node", *cols, F.explode(F.array(*key)).alias("key"))
    count = keyed.groupBy("key").count()
    hot = materialize(count.filter(F.col("count") > SLICE).select("key", F.ceil(F.col("count") / SLICE).cast("int").alias("g")), "hot")
    if hot.isEmpty():
        dealt = keyed.withColumn("pair", F.lit(0))
    else:
        own = F.pmod(F.xxhash64("node", F.lit(1)), F.col("g")).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("g"), F.lit(1)) - 1))
        dealt = keyed.join(hot, "key", "left").withColumn("own", F.coalesce(own, F.lit(0))).withColumn("other", other)
        dealt = dealt.select("node", *cols, "key", (F.least("own", "other") * 65536 + F.greatest("own", "other")).alias("pair"))
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(nodes.count() * len(masks) / SHARD_ROWS))

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["key", "pair", "node"], ignore_index=True)
        bucket = part.groupby(["key", "pair"], sort=False).ngroup().to_numpy()
        forest = Forest(part[cols].to_numpy().view(np.uint64), bucket)
        label, node = forest.labels(radius), part["node"].to_numpy()
        at = np.flatnonzero(label != np.arange(len(label)))
        return pd.DataFrame({"u": node[at], "v": node[label[at]]}).drop_duplicates()

    shard = F.pmod(F.xxhash64("key", "pair"), F.lit(shards))
    return dealt.withColumn("shard", shard).groupBy("shard").applyInPandas(grow, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4, words: int = 1) -> DataFrame:
    """doc_id, text_hash, f0.. (fingerprint), component_id (the smallest doc_id reachable) for every document.

    Documents with equal fingerprints are one node, so copies are never compared. With 64 bits and a small radius the search
    is exact; otherwise bucket keys are sampled bits (see sampled_masks). A null doc_id is no candidate for component_id;
    repeated rows are rows of their own. Null and empty texts share fingerprint zero. Other columns are not read.
    """
    cols = [f"f{k}" for k in range(words)]
    node = F.col("f0") if words == 1 else F.xxhash64(*cols)
    prints = materialize(fingerprints(docs, width, words).withColumn("node", node), "prints")
    nodes = materialize(prints.groupBy("node", *cols).agg(F.min("doc_id").alias("rep")), "nodes")
    count = nodes.count()
    masks = lossless_masks(count, radius) if words == 1 and radius <= 8 else sampled_masks(count, words, radius)
    stars = components(materialize(links(nodes, masks, radius), "links"))
    member = stars.select(F.col("u").alias("node"), F.col("v").alias("root")).union(stars.select("v", "v").distinct())
    named = member.join(nodes.select("node", "rep"), "node")
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    group = named.join(least, "root").select("node", "component_id")
    of = nodes.select("node", "rep").join(group, "node", "left").select("node", F.coalesce("component_id", "rep").alias("component_id"))
    of = materialize(of, "groups")  # so that both sides of the last join are plain shuffles, which Spark can split at hot fingerprints
    return prints.join(of, "node").select("doc_id", "text_hash", *cols, "component_id")


def representatives(docs: DataFrame, width: int = 5, words: int = 4, similarity: float = 0.8) -> DataFrame:
    """The documents of which one stays for each near-duplicate group, all columns.

    Similarity is the cosine of shingle counts that the fingerprint estimates: cos(pi * differing bits / bits). At
    0.8 with 256 bits that is 52 bits, 7 standard deviations below what unrelated texts have; one document of each
    group, that with the smallest doc_id, stays. Documents are named by doc_id and a hash of the text: rows that repeat both
    stay or go together, and so do rows of one group that share the smallest doc_id. A row without doc_id goes if its
    group has a row with one. Only rows that may go (see parted) move, to be joined with those that do. Empty input, empty result.
    """
    radius = math.floor(math.acos(similarity) / math.pi * 64 * words)
    gone = near_duplicates(docs, width, radius, words).filter("NOT doc_id <=> component_id").select("doc_id", "text_hash").distinct()
    gone = materialize(gone.withColumnsRenamed({"doc_id": "gone", "text_hash": "gone_hash"}), "gone")
    clean, touched = parted(docs, gone, {"gone": F.col("doc_id"), "gone_hash": F.xxhash64("text")})
    marked = touched.select(F.struct(*docs.columns).alias("document"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    stay = marked.join(gone, F.col("id").eqNullSafe(F.col("gone")) & (F.col("hash") == F.col("gone_hash")), "left_anti")
    return clean.unionByName(stay.select("document.*"))
