"""Best-fit packing in bulk-synchronous rounds: range-sorted documents and gaps, successor sweeps, conflicts by rank, new gaps."""

from __future__ import annotations

import re
import string
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import compress, repeat
from operator import is_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialize

CAPACITY = 2048
#: Each round takes up the documents longer than this share of the capacity, longest first.
SHARES = (2, 3, 5, 12)
#: For each of these q, documents longer than capacity / (q + 1) need a sequence for q of them at least.
SHARED = (1, 2, 3, 4, 5, 6, 7, 8, 12, 16, 24, 32, 64)
#: Words that a worker remembers, and their bytes; beyond either it starts anew.
WORDS, WORD_BYTES = 1 << 19, 1 << 26
#: Bytes of a text that are split into words at once.
SECTION = 1 << 23
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_MARKS, _END = string.punctuation, bytes(4)
#: Kinds of bytes: white space 0, letters, the rest of ASCII, and what leaves its word uncut.
_LETTER, _REST, _OPAQUE = 1, 2, 3
_KINDS = np.array([0 if b in b" \t\n\v\f\r" else _OPAQUE if b > 127 or b == ord("'") else _LETTER if chr(b).isalpha() else _REST for b in range(256)], np.uint8)
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


class Words:
    """Token ids of words as little-endian bytes, remembered. Words end at ASCII white space, across which the tokenizer joins nothing.

    A section of texts is cut by array operations and only its different parts are looked up. A word of ASCII and Latin-1 letters, digits and
    ASCII punctuation is cut wherever letters begin or end, and its ASCII letters are lower-cased: the tokenizer surely does both. Other
    words, those with an apostrophe or what may be a special token among them, are looked up as they stand.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.known, self.parts, self.size = Tokenizer.from_file(path), {}, {}, 0
        self.plain = Tokenizer(self.tokenizer.model)  # for lower-case letters between blanks
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(False, use_regex=False)])
        self.ends = {i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")}
        self.stops = np.isin(np.arange(max(self.ends) + 1), [*self.ends])

    def ids(self, texts: list[str | None] | pa.Array) -> Iterator[bytes]:
        """For each whole text its ids, four bytes each, and the id 0 that ends a document. Long texts are taken up in sections, short ones together."""
        column = (pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())).fill_null("")
        _, offsets, values = column.buffers()
        data = np.frombuffer(values or b"", np.uint8)
        bounds = np.frombuffer(offsets or bytes(8), np.int64)[column.offset :][: len(column) + 1]
        row = 0
        while row < len(column):
            at, stop = bounds[row], max(row + 1, int(np.searchsorted(bounds, bounds[row] + SECTION, "right")) - 1)
            if bounds[stop] - at <= SECTION:
                yield from (ids + _END for ids in self.section(data[at : bounds[stop]], bounds[row:stop] - at))
            else:
                yield b"".join([*(self.section(part, np.zeros(1, np.int64))[0] for part in sections(data[at : bounds[stop]])), _END])
            row = stop

    def section(self, data: np.ndarray, starts: np.ndarray) -> list[bytes]:
        """The ids of texts that begin at `starts` in their joint UTF-8."""
        units, letters, first = units_of(data, starts)
        coded = units.dictionary_encode()
        codes = coded.indices.to_numpy()
        plain = np.zeros(len(coded.dictionary), bool)
        plain[codes] = letters
        found = self.settle(coded.dictionary.to_pylist(), plain)
        flat, sizes = np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4
        taken = sizes[codes]
        after = np.concatenate([np.zeros(1, np.int64), np.cumsum(taken)])
        ids = flat[np.repeat((np.cumsum(sizes) - sizes)[codes] - after[:-1], taken) + np.arange(after[-1])].tobytes()
        cuts = (4 * after[[*first, len(taken)]]).tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def settle(self, units: list[bytes], plain: np.ndarray) -> list[bytes]:
        """The ids of different units, of which those in `plain` are letters; only units that are met for the first time take more than a look."""
        found = list(map(self.known.get, units))
        missing = [*compress(range(len(found)), map(is_, found, repeat(None)))]
        if len(self.known) + len(missing) > WORDS or self.size > WORD_BYTES:
            self.known, self.parts, self.size = {}, {}, 0
        isolated = plain[missing].tolist()
        self.enter([units[i] for i in compress(missing, isolated)])
        self.learn({units[i] for i, letters in zip(missing, isolated, strict=True) if not letters})
        for i in missing:
            found[i] = self.known[units[i]]
        return found

    def enter(self, letters: list[bytes]) -> None:
        """Enter units of ASCII and Latin-1 letters, which are one text, since each of them ends with the token that ends a word."""
        text = b" ".join(letters)
        ids = np.array(self.plain.encode_batch_fast([text.decode().lower()], add_special_tokens=False)[0].ids, "<u4")
        flat, stops = ids.tobytes(), (4 * (np.flatnonzero(self.stops[ids]) + 1)).tolist()
        self.known.update(zip(letters, [flat[a:b] for a, b in zip([0, *stops], stops, strict=False)], strict=True))
        self.size += len(text) + len(flat)

    def learn(self, words: set[bytes]) -> None:
        """Enter what is not known and not of such letters only."""
        known, made = self.known, self.parts
        new = [(w, self.split(w.decode())) for w in words]
        fresh = {p for _, parts in new for p in parts if p not in made}
        letters = {p for p in fresh if p.lower().isalpha()}
        made.update(self.encoded([*letters], [*(fresh - letters)]))
        for word, parts in new:
            known[word] = ids = made[parts[0]] if len(parts) == 1 else b"".join([made[p] for p in parts])
            self.size += len(word) + len(ids)

    def encoded(self, letters: list[str], others: list[str]) -> Iterator[tuple[str, bytes]]:
        """Words of letters are one text to the tokenizer, since each of them ends with the token that ends a word."""
        ids = self.tokenizer.encode_batch_fast([" ".join(letters)], add_special_tokens=False)[0].ids
        flat, stops = array("I", ids).tobytes(), [4 * k for k, i in enumerate(ids, 1) if i in self.ends]
        yield from zip(letters, [flat[a:b] for a, b in zip([0, *stops], stops, strict=False)], strict=True)
        for word, found in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False), strict=True):
            yield word, array("I", found.ids).tobytes()

    @staticmethod
    def split(word: str) -> list[str]:
        """The parts of a word that isn't plain ASCII letters."""
        if "'" in word or "<|" in word or word.isalpha():
            return [word]
        core = word.strip(_MARKS)
        if not core or not core[0].isalpha() or not core[-1].lower().isalpha():
            return [word]
        at = word.index(core)
        return [p for p in (word[:at], core.lower() if core.isascii() else core, word[at + len(core) :]) if p]


def sections(data: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in parts that end before white space."""
    at = 0
    while at < len(data):
        cut = _SPACE.search(data, at + SECTION)
        end = cut.start() if cut else len(data)
        yield data[at:end]
        at = end


def units_of(data: np.ndarray, starts: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """What is looked up, in order, whether it is of letters only, and the number of the first of each text that begins at `starts`."""
    kind = _KINDS[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)  # of U+00C0 to U+00FF, letters all but two
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = _LETTER
    cut = np.ones(len(data) + 1, bool)
    np.not_equal(kind[1:] == 0, kind[:-1] == 0, out=cut[1:-1])
    cut[starts] = True
    words = np.flatnonzero(cut)
    opaque = np.concatenate([np.flatnonzero(kind == _OPAQUE), np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))])
    whole = np.zeros(len(words) - 1, bool)
    whole[np.searchsorted(words, opaque, "right") - 1] = True
    whole = np.repeat(whole, np.diff(words))
    kind[whole] = _OPAQUE
    cut[1:-1] |= kind[1:] != kind[:-1]
    bounds = np.flatnonzero(cut)
    held = np.flatnonzero(kind[bounds[:-1]])
    begin = bounds[held]
    offsets = np.concatenate([np.zeros(1, np.int32), np.cumsum(bounds[held + 1] - begin, dtype=np.int32)])
    body = np.where(whole, data, _LOWER[data])[kind > 0]
    units = pa.Array.from_buffers(pa.binary(), len(held), [None, pa.py_buffer(offsets), pa.py_buffer(body)])
    return units, kind[begin] == _LETTER, np.searchsorted(begin, starts)


@lru_cache(1)
def words_of(path: str) -> Words:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Words(path)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """key (a number of its own), doc_id, piece, length, crc: each text's ids in pieces of the capacity, of which the last may be shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(tokenizer)
        for batch in batches:
            row, piece, length, crc = [], [], [], []
            for k, ids in enumerate(words.ids(batch.column(1))):
                for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row.append(k)
                    piece.append(n)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(length, pa.int32()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "length", "crc"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    cut = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, length int, crc long")
    return materialize(cut.select(F.monotonically_increasing_id().alias("key"), "*"), "pieces")


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Best fit within one range of rows (kind 0: gap, 1: document), from long to short, gaps first.

    Each document takes the smallest gap that holds it, and what is left of that is a gap again. Documents without a gap here are ranked
    from the longest, gaps that are still as long as every row of the range from the smallest. The last row (kind 2) sums up: id and size
    are how many documents are left and the longest of them, rank and sequence how many gaps and the smallest.
    """
    part, heaps, sizes, least, left, longest = TaskContext.get().partitionId(), {}, 0, 0, 0, 0
    names = ["part", "kind", "id", "size", "sequence", "rank"]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]

    def rows(kind: int, *columns: list) -> pa.RecordBatch:
        n = len(columns[0])
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(([part] * n, [kind] * n, *columns), kinds, strict=True)], names)

    for batch in batches:
        ids, lengths, found, ranks = [], [], [], []
        for kind, key, size in zip(*[batch.column(c).to_pylist() for c in ("kind", "id", "size")], strict=True):
            least = size
            if kind == 0:
                heaps.setdefault(size, []).append(key)
                sizes |= 1 << size
                continue
            ids.append(key)
            lengths.append(size)
            fit = sizes >> size  # bit n: there are gaps of size + n
            if not fit:
                found.append(None)
                ranks.append(left)
                left, longest = left + 1, longest or size
                continue
            gap = size + (fit & -fit).bit_length() - 1
            sequence = heaps[gap].pop()
            if not heaps[gap]:
                sizes ^= 1 << gap
            if gap > size:
                heaps.setdefault(gap - size, []).append(sequence)
                sizes |= 1 << (gap - size)
            found.append(sequence)
            ranks.append(None)
        yield rows(1, ids, lengths, found, ranks)
    rank = smallest = 0
    for size in sorted(s for s in heaps if heaps[s]):
        n, whole = len(heaps[size]), size >= least
        yield rows(0, heaps[size], [size] * n, [None] * n, range(rank, rank + n) if whole else [None] * n)
        if whole:
            rank, smallest = rank + n, smallest or size
    if left or rank:
        yield rows(2, [left], [longest], [smallest], [rank])


def exchange(ranges: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Which ranks of documents go to which ranks of gaps: (part, from, to, gap part, first gap, documents to a gap).

    ranges has (part, documents left, the longest of them, gaps left, the smallest of them), from long rows to short; documents take the
    nearest gaps of the ranges before, as many to one as surely fit. There are at most two entries a range.
    """
    stack, out = [], []
    for part, docs, longest, gaps, smallest in sorted(ranges):
        at = 0
        while at < docs and stack:
            where, first, n, size = stack.pop()
            each = size // longest
            used = min(n, -(-(docs - at) // each))
            out.append((part, at, min(docs, at + used * each), where, first, each))
            at = min(docs, at + used * each)
            if used < n:
                stack.append((where, first + used, n - used, size))
        if gaps:
            stack.append((part, 0, gaps, smallest))
    return out


def levels(capacity: int) -> list[int]:
    """Lengths for which room is compared with what needs it: four to a doubling."""
    return sorted({int(capacity / 2 ** (k / 4)) for k in range(1, 4 * capacity.bit_length())} | {0})


def must_open(docs: DataFrame, capacity: int, longest: int, room: dict[int, int]) -> int:
    """Sequences that documents need at least besides the gaps, the longest of `longest`, of which those above each level have so much room.

    What is longer than any gap fits into none, and of documents longer than capacity / (q + 1) only q share a sequence. Documents longer than a
    level fit only into longer gaps, so what is more than their room needs new sequences.
    """
    size = F.col("size")
    longer = [F.count_if((size > longest) & (size * (q + 1) > capacity)).alias(f"q{q}") for q in SHARED]
    above = [F.coalesce(F.sum(F.when(size > t, size)), F.lit(0)).alias(f"t{t}") for t in room]
    found = docs.agg(*longer, *above).first()
    return max(*[-(-found[f"q{q}"] // q) for q in SHARED], *[-(-(found[f"t{t}"] - held) // capacity) for t, held in room.items()])


def best_fit(lengths: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """key, size, sequence for a written table of keys and sizes from 1 to capacity; keys are unique and not negative.

    A round has (1) the documents left over and those of the next shorter class, with all gaps, sorted by ranges of size, key; (2) a sweep
    in each range; (3) the exchange between ranges: what is left in each is counted, ranks of documents meet ranks of gaps in a join
    that sums what each gap has taken; (4) new gaps; (5) new sequences, only as many as are needed at least. Every round places
    a document or opens a sequence for one; the rounds are about as many as the classes. The driver holds one row for each range.
    Documents as long as the capacity need no round. The sweep's bit set of sizes is made for capacities up to some ten thousands.
    """
    spark = lengths.sparkSession
    bounds = [*[capacity // s for s in SHARES if capacity // s > 0], 0]
    placed = [lengths.filter(F.col("size") == capacity).select("key", F.col("size").cast("int").alias("size"), (-1 - F.col("key")).alias("sequence"))]
    gaps = spark.createDataFrame([], "id long, size int")
    left = spark.createDataFrame([], "id long, size int")
    upper, opened, n_left, most, room = capacity - 1, 0, 0, 0, dict.fromkeys(levels(capacity), 0)
    while True:
        docs = left
        if bounds:
            lower = bounds.pop(0)
            fresh = lengths.filter((F.col("size") > lower) & (F.col("size") <= upper)).select(F.col("key").alias("id"), F.col("size").cast("int").alias("size"))
            docs, upper = left.unionByName(fresh), lower
        elif not n_left:
            break
        new = must_open(docs, capacity, most, room)
        if new > 0:
            gaps = gaps.unionByName(spark.range(opened, opened + new).select("id", F.lit(capacity).alias("size")))
            opened += new
        rows = gaps.select(F.lit(0).alias("kind"), "id", "size").unionByName(docs.select(F.lit(1).alias("kind"), "id", "size"))
        order = [F.desc("size"), F.asc("kind"), F.asc("id")]
        swept = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(sweep, "part int, kind int, id long, size int, sequence long, rank long"), "swept")
        rest, free = swept.filter("kind = 1 AND sequence IS NULL"), swept.filter("kind = 0")
        deal = exchange([tuple(r) for r in swept.filter("kind = 2").select("part", "id", "size", "rank", "sequence").collect()])
        asked = F.broadcast(spark.createDataFrame(deal, "part int, low long, high long, gap_part int, first long, each int"))
        dealt = rest.join(asked, (rest["part"] == asked["part"]) & (rest["rank"] >= asked["low"]) & (rest["rank"] < asked["high"]), "left")
        dealt = dealt.select(rest["id"], rest["size"], "gap_part", (F.col("first") + F.floor((F.col("rank") - F.col("low")) / F.col("each"))).alias("gap_rank"))
        ranked = free.filter("rank IS NOT NULL").select(F.col("part").alias("gap_part"), F.col("rank").alias("gap_rank"), F.col("id").alias("sequence"), F.col("size").alias("gap"))
        same = Window.partitionBy("gap_part", "gap_rank")
        met = ranked.join(dealt.filter("gap_part IS NOT NULL"), ["gap_part", "gap_rank"], "left")
        rest_of = F.col("gap") - F.coalesce(F.sum("size").over(same), F.lit(0))
        last = F.row_number().over(same.orderBy("id")) == 1
        met = materialize(met.select("id", "size", "sequence", F.when(last, rest_of).cast("int").alias("rest")), "met")
        left = dealt.filter("gap_part IS NULL").select("id", "size")
        placed += [df.select(F.col("id").alias("key"), "size", "sequence") for df in (swept.filter("kind = 1 AND sequence IS NOT NULL"), met.filter("id IS NOT NULL"))]
        gaps = free.filter("rank IS NULL").select("id", "size").unionByName(met.filter("rest > 0").select(F.col("sequence").alias("id"), F.col("rest").alias("size")))
        above = [F.coalesce(F.sum(F.when(F.col("size") > t, F.col("size"))), F.lit(0)) for t in room]
        most, *sums = gaps.agg(F.coalesce(F.max("size"), F.lit(0)), *above).first()
        n_left, room = left.count(), dict(zip(room, sums, strict=True))
    return reduce(DataFrame.unionByName, placed)


def pack_best_fit(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: documents' token ids packed into sequences of `capacity` at most.

    A document is its ids by the tokenizer file, then id 0; only longer ones are cut, into pieces of the capacity. In a sequence pieces
    stand from long to short without gaps. The file is read on every executor. Null and empty texts are the id 0 alone; long texts are read whole,
    in sections; repeated rows are documents of their own; null ids are ids; ties are in order of reading. An empty table gives
    no rows. Other columns are not read.
    """
    cut = pieces(docs, tokenizer, capacity)
    found = best_fit(cut.select("key", F.col("length").alias("size")), capacity)
    before = Window.partitionBy("sequence").orderBy(F.desc("size"), "key").rowsBetween(Window.unboundedPreceding, -1)
    at = found.select("key", "sequence", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("at"))
    whole: Column = F.col("piece").cast("long") * capacity
    return cut.join(at, "key").select(
        "doc_id", "piece", whole.alias("start"), F.col("length").cast("long").alias("length"), F.col("crc").alias("ids_crc32"), F.col("sequence").alias("sequence_id"), F.col("at").cast("long").alias("offset")
    )
