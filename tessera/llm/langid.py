"""Language ID with language-bitmask n-gram filters: one bit-sliced Bloom filter answers for all languages at once."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import clear_names, uniform

ORDERS = (3, 4)
TOP = 3000
SAMPLE = 4000
HASHES = 3
UNKNOWN = "und"
CHUNK = 1 << 20
_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> str:
    """The lower-cased text with one space for all that is no letter, and around it; empty if there is no letter."""
    plain = _OTHER.sub(" ", (text or "").lower()).strip()
    return f" {plain} " if any(c.isalpha() for c in plain) else ""


def grams(plain: str, orders: tuple[int, ...] = ORDERS) -> Iterator[np.ndarray]:
    """64-bit hashes of all character n-grams, in pieces of a bounded size."""
    for at in range(0, len(plain), CHUNK):
        piece = plain[at : at + CHUNK + max(orders) - 1]
        code = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        for n in orders:
            count = min(len(code) - n + 1, CHUNK)
            if count <= 0:
                continue
            h = np.full(count, n, dtype=np.uint64)
            with np.errstate(over="ignore"):
                for k in range(n):
                    h = h * np.uint64(0x100000001B3) + code[k : k + count]
                h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
                h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            yield h ^ (h >> np.uint64(32))


@dataclass
class Filters:
    """slices[p] has bit l set if some n-gram of language l hashes to position p; 64 languages to a lane."""

    langs: list[str]
    slices: np.ndarray
    false_rate: np.ndarray
    orders: tuple[int, ...] = ORDERS

    @classmethod
    def build(cls, members: dict[str, np.ndarray], orders: tuple[int, ...] = ORDERS) -> Filters:
        langs = sorted(members)
        most = max((len(m) for m in members.values()), default=1)
        bits = min(20, max(10, int(np.ceil(np.log2(16 * most + 1)))))
        slices = np.zeros((1 << bits, max(1, -(-len(langs) // 64))), dtype=np.uint64)
        for k, lang in enumerate(langs):
            for p in cls.positions(members[lang], bits):
                np.bitwise_or.at(slices[:, k // 64], p, np.uint64(1 << (k % 64)))
        filled = np.array([((slices[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(langs))])
        return cls(langs, slices.astype(np.uint8) if len(langs) <= 8 else slices, filled**HASHES, orders)

    @staticmethod
    def positions(h: np.ndarray, bits: int) -> list[np.ndarray]:
        return [((h >> np.uint64(k * bits)) & np.uint64((1 << bits) - 1)).astype(np.int64) for k in range(HASHES)]

    def decide(self, text: str | None) -> tuple[str, float]:
        """The language of a whole text and the share of its n-grams that the language's filter holds.

        An n-gram's mask is the AND of its slices. Counts by language lose what false positives add on average:
        (count - n * rate) / (1 - rate). Ties go to the first language by name; no letter or no model gives `und`, 0.
        """
        plain = letters(text)
        if not plain or not self.langs:
            return UNKNOWN, 0.0
        held, n, bits = np.zeros(len(self.langs)), 0, int(np.log2(len(self.slices)))
        for h in grams(plain, self.orders):
            n += len(h)
            mask = None
            for p in self.positions(h, bits):
                mask = self.slices[p] if mask is None else mask & self.slices[p]
            held += self.popcounts(mask)
        right = np.clip((held - n * self.false_rate) / np.maximum(1 - self.false_rate, 1e-9) / max(n, 1), 0, 1)
        best = int(np.argmax(right))
        return self.langs[best], float(right[best])

    def popcounts(self, mask: np.ndarray) -> np.ndarray:
        if mask.dtype == np.uint8:
            seen = np.bincount(mask[:, 0], minlength=256)
            return np.array([seen[(np.arange(256) >> k) & 1 == 1].sum() for k in range(len(self.langs))], dtype=np.float64)
        return np.array([np.count_nonzero(mask[:, k // 64] & np.uint64(1 << (k % 64))) for k in range(len(self.langs))], dtype=np.float64)


def held_out(doc_id: Column) -> Column:
    """The quarter of documents that is never learned from: CRC-32 of doc_id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, top: int = TOP, sample: int = SAMPLE, orders: tuple[int, ...] = ORDERS) -> Filters:
    """Filters of the `top` most frequent n-grams of each lang among about `sample` labelled documents that aren't held out.

    The sample is a hash of doc_id below a rate for each language; whole texts of it are counted on Spark, and the driver gets
    `top` rows for each language.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not sizes:
        return Filters.build({}, orders)
    rate = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, sample / n)))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for h in grams(letters(text.as_py()), orders):
                    pieces.setdefault(lang, []).append(np.unique(h, return_counts=True))
            for lang, parts in pieces.items():
                h, where = np.unique(np.concatenate([h for h, _ in parts]), return_inverse=True)
                n = np.bincount(where, weights=np.concatenate([n for _, n in parts])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h)), pa.array(h.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    chosen = known.filter(uniform(F.col("doc_id")) < rate[F.col("lang")]).select("lang", "text")
    counted = chosen.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    rows = counted.withColumn("place", place).filter(F.col("place") <= top).select("lang", "gram").toPandas()
    return Filters.build({lang: g["gram"].to_numpy().view(np.uint64) for lang, g in rows.groupby("lang")}, orders)


def identify(docs: DataFrame, filters: Filters, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with lang_pred and score, or columns of the given names. Only the text goes to Python; null, empty and letterless texts are `und` with score 0.

    Columns of those names in the input are replaced; ties, repeated rows and empty tables need no care.
    """

    @F.pandas_udf("lang_pred string, score double")
    def decide(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([filters.decide(t) for t in text], columns=["lang_pred", "score"])

    found = docs.select(F.struct(*clear_names(docs, list(names)).columns).alias("document"), decide("text").alias("decided"))
    return found.select("document.*", F.col("decided.lang_pred").alias(names[0]), F.col("decided.score").alias(names[1]))
