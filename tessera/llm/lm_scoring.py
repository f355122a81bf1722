"""LM scoring by cross-entropy difference: matched target and background bigram models over one vocabulary."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Bloom, Members, frequent, member_state
from tessera.session import discard, materialize

WEIGHT = 0.7
ADD = 1.0
#: A pair has a parameter if it occurs so often in the target or in the background, at any size of either.
LEAST = 2
#: So many of the most frequent words, and of pairs, are looked up in a broadcast table; the others meet theirs in a join.
FREQUENT = 1 << 17
#: Words that a task counts before it passes the counts on.
PIECE = 1 << 20
#: Bytes of text whose pairs one shard adds up.
SHARD_BYTES = 12_000_000
PAIR, FOLLOWED, LAST, DOCUMENT = range(4)


def word_hashes(text: bytes | None) -> np.ndarray:
    """XXH64 of every word: A-Z lower-cased, split at ASCII white space. Words are told apart by these 64 bits."""
    words = (text or b"").lower().split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def pair_codes(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return ((v << np.uint64(23)) | (v >> np.uint64(41))) ^ w


def pair_code(v: Column, w: Column) -> Column:
    """pair_codes as a column."""
    return F.shiftleft(v, 23).bitwiseOR(F.shiftrightunsigned(v, 41)).bitwiseXOR(w)


def _texts(column: pa.Array) -> Iterator[bytes | None]:
    for t in column.cast(pa.binary()):
        yield t.as_py()


def counts(corpus: DataFrame, shards: int, members: Members | None = None) -> DataFrame:
    """shard and parallel arrays of words (as v with w = 0) and pairs of adjacent words with their counts, in pieces.

    corpus has text, target and background (whether the text belongs to each), or text and key: then all texts are background, those whose key
    is one of the members are target as well, and those in doubt are left out. A shard is a range of pair codes. A piece of a shard
    comes as one row of bytes: its distinct words; for each pair the places of both words among them and a byte for two counts below
    16; place and counts of pairs with more. So a pair takes about half of what a row of its own would take.
    """
    names, filters = ["shard", "words", "v", "w", "few", "many"], members.filters if members is not None else None

    def packed(v: np.ndarray, w: np.ndarray, n: np.ndarray, code: np.ndarray) -> Iterator[pa.RecordBatch]:
        shard = (code >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)
        starts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]][: len(shard)])
        rows: list[list] = [[] for _ in names]
        for a, z in zip(starts, np.r_[starts[1:], len(code)], strict=True):
            for lo in range(a, z, 1 << 15):
                part = slice(lo, min(z, lo + (1 << 15)))
                words, place = np.unique(np.concatenate([v[part], w[part]]), return_inverse=True)
                place, half = place.astype(np.uint16), part.stop - part.start
                both = np.stack([n[part] >> 32, n[part] & 0xFFFFFFFF])
                more = np.flatnonzero((both > 15).any(0))
                few = both[0] * 16 + both[1]
                few[more] = 0
                given = (words, place[:half], place[half:], few.astype(np.uint8), np.stack([more, *both[:, more]]).astype(np.uint32))
                for column, value in zip(rows, (int(shard[a]), *[x.tobytes() for x in given]), strict=True):
                    column.append(value)
        if len(code):
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *[pa.array(c, pa.binary()) for c in rows[1:]]], names)

    def summed(found: list[np.ndarray], sides: list[int]) -> Iterator[pa.RecordBatch]:
        ids, size = np.concatenate(found), [len(f) for f in found]
        each = np.repeat(np.array(sides, dtype=np.int64), size)
        inner = np.ones(len(ids), dtype=bool)
        inner[np.cumsum(size) - 1] = False  # the last word of each text starts no pair
        yield from packed(*totals(np.zeros(len(ids), dtype=np.uint64), ids, each))
        at = np.flatnonzero(inner)
        yield from packed(*totals(ids[at], ids[at + 1], each[at]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, sides, held = [], [], 0
        for batch in batches:
            given = batch.column(1).to_numpy()
            if filters is not None:
                given = np.array([1, (1 << 32) + 1, 0])[member_state(*filters, given)]
            for text, side in zip(_texts(batch.column(0)), given.tolist(), strict=True):
                ids = word_hashes(text) if side else ()
                if len(ids):
                    found.append(ids)
                    sides.append(side)
                    held += len(ids)
                if held >= PIECE:
                    yield from summed(found, sides)
                    found, sides, held = [], [], 0
        if found:
            yield from summed(found, sides)

    one = lambda c: F.when(F.col(c), 1).otherwise(0).cast("long")
    side = F.col("key") if members is not None else F.shiftleft(one("target"), 32) + one("background")
    flagged = corpus.select("text", side.alias("side"))
    return flagged.mapInArrow(run, "shard int, words binary, v binary, w binary, few binary, many binary")


def totals(v: np.ndarray, w: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct pairs in order of their codes: v, w, the sums of each of counts, and the codes."""
    code = pair_codes(v, w)
    order = np.argsort(code, kind="stable")
    code = code[order]
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]][: len(code)])
    sums = [np.add.reduceat(n[order], first) if len(first) else n[:0] for n in counts]
    return v[order[first]], w[order[first]], *sums, code[first]


def add_up(dealt: DataFrame, least: int) -> DataFrame:
    """v, w, t, b: the counts of every word (v is null) and of the pairs that occur `least` times in one corpus."""

    def run(part: pa.Table) -> pa.Table:
        read = lambda name, kind: [np.frombuffer(x.as_py(), dtype=kind) for x in part[name]]
        words, few = read("words", np.uint64), read("few", np.uint8)
        v, w = (np.concatenate([d[k] for d, k in zip(words, read(c, np.uint16), strict=True)]) for c in "vw")
        counts = np.stack([np.concatenate(few) >> 4, np.concatenate(few) & 15]).astype(np.int64)
        starts = np.r_[0, np.cumsum([len(x) for x in few])]
        for start, more in zip(starts, read("many", np.uint32), strict=False):
            at, *found = more.astype(np.int64).reshape(3, -1)
            counts[:, start + at] = found
        v, w, t, b, _ = totals(v, w, *counts)
        keep = (v == 0) | (np.maximum(t, b) >= least)
        return pa.table({"v": pa.array(v[keep].view(np.int64), mask=v[keep] == 0), "w": w[keep].view(np.int64), "t": t[keep], "b": b[keep]})

    return dealt.groupBy("shard").applyInArrow(run, "v long, w long, t long, b long")


class _Lookup:
    """A table of the most frequent keys: codes, sorted, and a row of values for each."""

    def __init__(self, rows: DataFrame, key: str, values: list[str]):
        found = rows.select(key, *values).toPandas()
        code = found[key].to_numpy(dtype=np.int64).view(np.uint64)
        order = np.argsort(code)
        self.codes, self.values = code[order], found[values].to_numpy(dtype=np.float64).reshape(-1, len(values))[order]

    def find(self, h: np.ndarray) -> np.ndarray:
        """The row of each hash, or -1."""
        if not len(self.codes):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.codes, h), len(self.codes) - 1)
        return np.where(self.codes[at] == h, at, -1)


class Scorer:
    """Both models as tables in the shared folder: words (w, t, b, kt, kb) and pairs (code, t, b, at, ab).

    t, b: counts in target and background; kt, kb: those of the word's pairs that have parameters; at, ab: what the pair adds
    to the loss of its second word. common is a broadcast _Lookup of the most frequent words.
    """

    def __init__(self, words: DataFrame):
        size, t, b = words.agg(F.count(F.lit(1)), F.sum("t"), F.sum("b")).first()
        self.words, self.pairs, self.total, self.size = words, words, {"t": t or 0, "b": b or 0}, size + 1
        self.often = frequent(words, F.col("t") + F.col("b"), FREQUENT)
        table = self.word_losses().filter(self.often)
        self.common = words.sparkSession.sparkContext.broadcast(_Lookup(table, "w", ["ut", "ub", "lt", "lb", "t", "b"]))

    def single(self, side: str) -> Column:
        """P(w), add-one over the vocabulary and one unknown word."""
        return (F.col(side) + ADD) / (self.total[side] + ADD * self.size)

    def left(self, side: str) -> Column:
        """What the pairs of v leave of 1 to the single words."""
        return 1 - WEIGHT * F.coalesce(F.try_divide(F.col(f"k{side}"), F.col(side)), F.lit(0.0))

    def word_losses(self) -> DataFrame:
        """w, t, b and ut, ub: -log P(w); lt, lb: -log left(w)."""
        cost = {f"u{s}": -F.log(self.single(s)) for s in "tb"} | {f"l{s}": -F.log(self.left(s)) for s in "tb"}
        return self.words.select("w", "t", "b", *[c.alias(k) for k, c in cost.items()])

    def price(self, kept: DataFrame) -> DataFrame:
        """code, t, b, at, ab of pairs (v, w, t, b). Pairs of two frequent words are priced where they are read, others by joins."""
        common = self.common

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = common.value
            for batch in batches:
                v, w, *n = (c.to_numpy() for c in batch.columns)
                own = [words.find(x.view(np.uint64)) for x in (v, w)]
                both = (own[0] >= 0) & (own[1] >= 0)
                given, wanted = (words.values[x[both]] for x in own)
                out = []
                for s in range(2):
                    base = given[:, 4 + s] * np.exp(-given[:, 2 + s] - wanted[:, s])
                    price = np.zeros(len(v))
                    price[both] = -np.log1p(np.where(n[s][both] > 0, WEIGHT * n[s][both] / np.maximum(base, 1e-300), 0.0))
                    out.append(pa.array(price, pa.float64(), mask=~both))
                yield pa.RecordBatch.from_arrays([*batch.columns, *out], ["v", "w", "t", "b", "at", "ab"])

        seen = kept.select("v", "w", "t", "b").mapInArrow(run, "v long, w long, t long, b long, at double, ab double")
        given = self.words.select(F.col("w").alias("v"), *[(F.col(s) * self.left(s)).alias(f"v{s}") for s in "tb"])
        wanted = self.words.select("w", *[self.single(s).alias(f"w{s}") for s in "tb"])
        ratio = lambda s: F.coalesce(F.try_divide(WEIGHT * F.col(s), F.col(f"v{s}") * F.col(f"w{s}")), F.lit(0.0))
        joined = seen.filter("at IS NULL").drop("at", "ab").join(given, "v").join(wanted, "w").withColumns({f"a{s}": -F.log1p(ratio(s)) for s in "tb"})
        done = seen.filter("at IS NOT NULL").unionByName(joined.select("v", "w", "t", "b", "at", "ab"))
        return done.select(pair_code(F.col("v"), F.col("w")).alias("code"), "t", "b", *[F.col(f"a{s}").cast("float").alias(f"a{s}") for s in "tb"])


def fit_corpus(corpus: DataFrame, least: int = LEAST, members: Members | None = None) -> Scorer:
    """Matched models of a corpus with text, target and background: one vocabulary, one list of pairs, one smoothing.

    P(w | v) = WEIGHT * c(v, w) / c(v) + left(v) * P(w), where left(v) is what the pairs of v leave of 1. Every word of either
    has a parameter, and every pair that occurs `least` times in one of them, whatever their size; so the tables grow
    with the corpus. They stay tables: no count but totals, histograms of counts and the FREQUENT words passes through the driver.
    Null and empty texts count for nothing; an empty corpus gives models that know no word. With members, corpus has text and their
    key column instead: all texts are background, the members' texts are the target, told apart where they are read.
    """
    size = corpus.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / SHARD_BYTES))
    if members is None:
        dealt = counts(corpus, shards)
    else:
        doubt = members.doubtful(corpus).select("text", F.col("member").alias("target"), F.lit(True).alias("background"))
        doubt = materialize(doubt, "doubt")  # by itself, so that no task needs two Python workers at once
        dealt = counts(corpus.select("text", members.key.alias("key")), shards, members).unionByName(counts(doubt, shards))
    found = materialize(add_up(dealt, least), "counts")
    kept = found.filter("v IS NOT NULL")
    of = kept.groupBy(F.col("v").alias("w")).agg(F.sum("t").alias("kt"), F.sum("b").alias("kb"))
    words = materialize(found.filter("v IS NULL").select("w", "t", "b").join(of, "w", "left").fillna(0, ["kt", "kb"]), "words")
    scorer = Scorer(words)
    scorer.pairs = materialize(scorer.price(kept), "pairs")
    discard(found)
    return scorer


def fit(background: DataFrame, target: DataFrame, least: int = LEAST) -> Scorer:
    """fit_corpus for a background and a target given as tables with text."""
    side = lambda df, own: df.select("text", F.lit(own).alias("target"), F.lit(not own).alias("background"))
    return fit_corpus(side(background, False).unionByName(side(target, True)), least)


def score(docs: DataFrame, scorer: Scorer, parts: int = 2) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score (mean per-token loss difference; lower is nearer the target).

    Every document is scored over its whole text; null, empty and wordless texts have no tokens and null losses. Repeated
    rows are rows of their own; other columns are not read. A text's loss is the sum over its words of -log P(w) and, where a
    word follows, -log left(v), less what its pairs with parameters add. The most frequent words and pairs (FREQUENT of each)
    are summed where the text is read; so no key of the join is frequent. All others are shuffled, as (key, row), to meet their
    losses, but for pairs that a Bloom filter says have none. Sums per document are added map-side before they meet. Documents are
    scored in `parts` by a hash of doc_id, one after the other, so that only a part's shuffle is on disk at once.
    """
    lookups = _lookups(docs, scorer)
    mine = lambda k: docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) == k)
    return reduce(DataFrame.unionByName, [materialize(_score(mine(k), scorer, *lookups), "scores") for k in range(parts)])


def _lookups(docs: DataFrame, scorer: Scorer) -> tuple:
    """The condition for frequent pairs, their broadcast table, and the filter of the other pairs."""
    often = frequent(scorer.pairs, F.col("t") + F.col("b"), FREQUENT)
    top = docs.sparkSession.sparkContext.broadcast(_Lookup(scorer.pairs.filter(often), "code", ["at", "ab"]))
    return often, top, Bloom(scorer.pairs.filter(~often).select(F.col("code").alias("key")))


def _score(docs: DataFrame, scorer: Scorer, often: Column, top, held: Bloom) -> DataFrame:
    kind = dict(docs.dtypes)["doc_id"]
    words, common, rare = scorer.word_losses(), scorer.common, scorer.pairs.filter(~often)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                yield coded(batch.slice(at, 500), common.value, top.value)

    def coded(batch: pa.RecordBatch, words: _Lookup, pairs: _Lookup) -> pa.RecordBatch:
        found = [word_hashes(t) for t in _texts(batch.column(2))]
        size = np.array([len(f) for f in found])
        ids, doc = np.concatenate(found), np.repeat(np.arange(len(found)), size)
        follows = np.zeros(len(ids), dtype=bool)
        follows[:-1] = doc[1:] == doc[:-1]
        first = np.flatnonzero(follows)
        code = pair_codes(ids[first], ids[first + 1])
        own, both = words.find(ids), pairs.find(code)
        held_pair = np.flatnonzero(both < 0)
        held_pair = held_pair[held.holds(code[held_pair])]
        rare, common, met = np.flatnonzero(own < 0), own >= 0, both >= 0
        sums = []
        for s in range(2):
            word_loss = words.values[own[common], s] + words.values[own[common], 2 + s] * follows[common]
            sums.append(np.bincount(doc[common], word_loss, len(found)) + np.bincount(doc[first[met]], pairs.values[both[met], s], len(found)))
        place = np.concatenate([np.arange(len(found)), doc[rare], doc[first[held_pair]]])
        what = np.concatenate([np.full(len(found), DOCUMENT), np.where(follows[rare], FOLLOWED, LAST), np.full(len(held_pair), PAIR)])
        keys = np.concatenate([batch.column(0).to_numpy().view(np.uint64), ids[rare], code[held_pair]]).view(np.int64)
        none = pa.nulls(len(place) - len(found), pa.int64())
        whole = [pa.concat_arrays([x, none.cast(x.type)]) for x in (batch.column(1), pa.array(size, pa.int64()), *[pa.array(x, pa.float64()) for x in sums])]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(place)), pa.array(keys), pa.array(what, pa.int8()), *whole], ["row", "key", "what", "doc_id", "n", "xt", "xb"])

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    found = numbered.mapInArrow(run, f"row long, key long, what byte, doc_id {kind}, n long, xt double, xb double")
    nothing = F.lit(0.0).cast("float")
    known = words.filter(~scorer.often).select(F.col("w").alias("key"), *[F.col(c).cast("float").alias(c) for c in ("ut", "ub", "lt", "lb")])
    known = known.unionByName(rare.select(F.col("code").alias("key"), *[F.col(f"a{s}").cast("float").alias(f"u{s}") for s in "tb"], nothing.alias("lt"), nothing.alias("lb")))

    def cost(s: str) -> Column:
        unknown = F.when(F.col("what") == PAIR, 0.0).otherwise(-F.log(F.lit(ADD / (scorer.total[s] + ADD * scorer.size))))
        own = F.coalesce(F.col(f"u{s}"), unknown) + F.when(F.col("what") == FOLLOWED, F.coalesce(F.col(f"l{s}"), F.lit(0.0))).otherwise(0.0)
        return F.sum(F.when(F.col("what") == DOCUMENT, F.col(f"x{s}")).otherwise(own)).alias(s)

    met = found.join(known, "key", "left").groupBy("row")
    out = met.agg(F.first("doc_id", ignorenulls=True).alias("doc_id"), F.max("n").alias("n"), cost("t"), cost("b"))
    mean = {s: F.try_divide(F.col(s), F.col("n")) for s in "tb"}
    return out.select("doc_id", F.col("n").alias("n_tokens"), mean["t"].alias("target_loss"), mean["b"].alias("background_loss"), (mean["t"] - mean["b"]).alias("score"))
