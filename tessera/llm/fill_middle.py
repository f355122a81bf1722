"""Fill-in-middle: a wavelet matrix over character classes counts unit boundaries and finds both cuts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM = 7, 100, 50
#: Character classes; every other character is of class 0. They fill three bits.
CLASSES = {"\n": 1, ".": 2, "!": 3, "?": 4, " ": 5, "\t": 6, ";": 7}
LEVELS = 3
#: The classes whose characters end a unit.
UNITS = {"line": "\n", "sentence": ".!?\n", "clause": ".!?;\n", "word": " \t\n"}
#: Texts share a matrix up to about so many characters; a longer text has one of its own.
CHARS = 1 << 21


class WaveletMatrix:
    """A sequence of small symbols, a bit of each per level, highest first; each level is stably sorted by the bits of those above.

    rank(c, i) is how often c stands before place i, in one look-up a level: packed words of 64 bits and counts before each word.
    All questions are arrays and are answered at once.
    """

    def __init__(self, symbols: np.ndarray, levels: int = LEVELS):
        self.n, self.levels, self.words, self.counts, self.zeros = len(symbols), levels, [], [], []
        for level in reversed(range(levels)):
            bit = (symbols >> level) & 1
            packed = np.packbits(np.pad(bit, (0, 64 - self.n % 64)), bitorder="little").view(np.uint64)
            self.words.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]))
            self.zeros.append(self.n - int(self.counts[-1][-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def _ones(self, k: int, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        below = self.words[k][word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.counts[k][word] + np.bitwise_count(below)

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        start, end = np.zeros_like(at), at
        for k in range(self.levels):
            low, high = self._ones(k, start), self._ones(k, end)
            if (symbol >> (self.levels - 1 - k)) & 1:
                start, end = self.zeros[k] + low, self.zeros[k] + high
            else:
                start, end = start - low, end - high
        return end - start


class Boundaries:
    """Texts laid end to end, with counts of unit ends from ranks of the unit's classes."""

    def __init__(self, texts: list[str], unit: str = "line"):
        table = np.zeros(128, dtype=np.uint8)
        for char, kind in CLASSES.items():
            table[ord(char)] = kind
        code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.kinds = [CLASSES[c] for c in UNITS[unit]]
        symbols = table[np.minimum(code, 127)]
        symbols[code > 127] = 0
        self.matrix = WaveletMatrix(symbols)
        self.ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        self.before = self.count(self.starts)
        self.closed = self.count(self.ends) - self.before
        # what follows the last unit end is a unit too
        self.units = self.closed + ((self.ends > self.starts) & (self.count(self.ends) == self.count(np.maximum(self.ends - 1, self.starts))))

    def count(self, at: np.ndarray) -> np.ndarray:
        """Unit ends before each place, over all texts."""
        return sum(self.matrix.rank(kind, at) for kind in self.kinds)

    def cut(self, units: np.ndarray) -> np.ndarray:
        """For each text the characters of its first so many units: the least length that holds as many unit ends, by bisection."""
        low, high = self.starts.copy(), self.ends.copy()
        want = self.before + np.minimum(units, self.closed)
        while (open_ := low < high).any():
            middle = (low + high) // 2
            enough = self.count(middle) >= want
            high = np.where(open_ & enough, middle, high)
            low = np.where(open_ & ~enough, middle + 1, low)
        return np.where(units >= self.units, self.ends, low) - self.starts


def pieces(texts: list[str], most: int = CHARS) -> Iterator[slice]:
    """Runs of texts of about `most` characters."""
    at = chars = 0
    for k, t in enumerate(texts):
        if k > at and chars + len(t) > most:
            yield slice(at, k)
            at, chars = k, 0
        chars += len(t)
    if texts:
        yield slice(at, len(texts))


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four numbers below 2^32 for each document, from the SHA-256 of seed and id; a null id is the text `null`."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, unit: str = "line", seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars, output.

    The unit is one of UNITS; a unit ends with one of its classes' characters or with the text. Two draws of the id choose the cuts among
    the n + 1 boundaries; a third makes `rate` percent of documents examples, a fourth makes `spm` percent of those begin with the suffix
    (form spm, else psm). Empty texts and texts that hold a mark are plain: output is the text, the lengths are null.

    Null texts are empty. Equal rows are transformed alike, texts of any length whole. An empty table gives no rows. Other columns
    are not read. Texts stay in the JVM but for the look for cuts, in matrices of bounded size.
    """

    @F.pandas_udf("n long, first long, second long")
    def cuts(text: pd.Series, h1: pd.Series, h2: pd.Series) -> pd.DataFrame:
        texts, one, two, found = text.tolist(), h1.to_numpy(), h2.to_numpy(), []
        for part in pieces(texts):
            lines = Boundaries(texts[part], unit)
            a, b = one[part] % (lines.units + 1), two[part] % (lines.units + 1)
            found.append(np.stack([lines.units, lines.cut(np.minimum(a, b)), lines.cut(np.maximum(a, b))]))
        n, first, second = np.concatenate(found, axis=1) if found else np.zeros((3, 0), dtype=np.int64)
        return pd.DataFrame({"n": n, "first": first, "second": second})

    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    read = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), h1.alias("h1"), h2.alias("h2"), h3.alias("h3"), h4.alias("h4"))
    text, first, second = F.col("text"), F.col("cut.first"), F.col("cut.second")
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    plain = (text == "") | marked | (F.col("h3") % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm")
    prefix, middle = F.substring(text, F.lit(1), first.cast("int")), F.substring(text, (first + 1).cast("int"), (second - first).cast("int"))
    suffix = F.substring(text, (second + 1).cast("int"), F.lit(2**31 - 1))
    before, after, between = F.concat(F.lit(PREFIX), prefix), F.concat(F.lit(SUFFIX), suffix), F.concat(F.lit(MIDDLE), middle)
    shaped = read.select("doc_id", "text", form.alias("form"), cuts("text", "h1", "h2").alias("cut"))
    return shaped.select(
        "doc_id",
        F.col("cut.n").alias("n"),
        "form",
        F.when(F.col("form") != "plain", first).alias("prefix_chars"),
        F.when(F.col("form") != "plain", second - first).alias("middle_chars"),
        F.when(F.col("form") == "plain", text).when(F.col("form") == "psm", F.concat(before, after, between)).otherwise(F.concat(after, before, between)).alias("output"),
    )


def restore(output: Column, form: Column) -> Column:
    """The text that fill_in_middle had: the parts between the marks in their first order."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    spm = F.concat(part[2], part[3], part[1])
    return F.when(form == "plain", output).when(form == "psm", F.concat(part[1], part[3], part[2])).otherwise(spm)
