"""Best-fit packing against whole texts' ids and against best fit one document at a time."""

from __future__ import annotations

import bisect
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, key string, size string, length string, sequence string"


def whole_ids(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 0]


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def one_by_one(sizes, capacity):
    """Best fit from long to short: how many sequences."""
    gaps, n = [], 0
    for size in sorted(sizes, reverse=True):
        at = bisect.bisect_left(gaps, size)
        gap = gaps.pop(at) if at < len(gaps) else capacity
        n += at == len(gaps) and gap == capacity
        if gap > size:
            bisect.insort(gaps, gap - size)
    return n


def check(rows, capacity):
    """Pieces fill their sequences without gaps; how many sequences there are."""
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_words_are_the_tokenizers():
    from tessera.llm.best_fit import Words

    rng = random.Random(4)
    signs = "aAbÉé́ëͅſİıΣσς'sdreve ll t  \t\n\x0b\x0c\r\x1c\x85\xa0 漢字かな각😀,.!?01٣²½ﬁ<|endoftext|>-_#$"
    texts = ["", None, "it's <|endoftext|>x ***Don't*** x<|endoftext|>", "A" * 3000, "x,y;z " * 1000]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    words = Words(PATH)
    got = list(words.ids(texts))
    assert got == [b"".join(i.to_bytes(4, "little") for i in whole_ids(t)) for t in texts[:5]] + got[5:]
    tokenizer = words.tokenizer
    for text, ids in zip(texts[5:], got[5:], strict=True):
        assert ids == b"".join(i.to_bytes(4, "little") for i in [*tokenizer.encode(text, add_special_tokens=False).ids, 0]), repr(text)


def test_words_are_cut_only_where_the_tokenizer_cuts(monkeypatch):
    import pyarrow as pa

    import tessera.llm.best_fit as b

    rng = random.Random(5)
    signs = ["aAzZ", "éÉÞß×÷ÿÃ", "'’", "<|>", ["<|endoftext|>", "<|ENDOFTEXT|>"], "\u0338\u0301\u0327", "=<>!-*#", " \t\n\x0b\r", "\x1c\x85\xa0\x00\x7f", "09²½", "漢각ᄀ", "İſΣςœµª", "привет", "sdtre"]
    texts = ["É,é×é÷É <|ENDOFTEXT|>A =\u0338A A\u0301, ***É***", " ", None]
    texts += ["".join(rng.choice(rng.choice(signs)) for _ in range(rng.randint(0, 12))) for _ in range(5000)]
    for section in (b.SECTION, 40):
        monkeypatch.setattr(b, "SECTION", section)
        words = b.Words(PATH)
        got = list(words.ids(pa.array(["before", *texts, "after"]).slice(1, len(texts))))
        for text, ids in zip(texts, got, strict=True):
            assert ids == b"".join(i.to_bytes(4, "little") for i in [*words.tokenizer.encode(text or "", add_special_tokens=False).ids, 0]), repr(text)


def test_each_part_of_words_is_looked_up_once():
    from tessera.llm.best_fit import Words

    letters = [a + b + "é" * (b == "x") for a in ("star", "moon", "rain", "wind") for b in "bcdfgx"]
    marks = ["", ",", ".", "***", "&&&", ".%%%"]
    words = Words(PATH)
    assert len(list(words.ids([" ".join(w + m for w in letters) + " " + " ".join(w.upper() + m for w in letters if w.isascii()) for m in marks]))) == len(marks)
    assert len(words.known) == len(letters) + len(marks) - 1


def test_sections_and_forgetting(monkeypatch):
    import tessera.llm.best_fit as b

    texts = [f"word{i % 97} tail{i % 13}! " * (1 + i % 5) for i in range(300)] + ["long text with many words " * 400]
    want = list(b.Words(PATH).ids(texts))
    monkeypatch.setattr(b, "SECTION", 100)
    monkeypatch.setattr(b, "WORDS", 20)
    assert list(b.Words(PATH).ids(texts)) == want


def test_documents(spark):
    from tessera.llm.best_fit import pack_best_fit

    rows = [(1, "The cat sat, on the mat."), (1, "The cat sat, on the mat."), (2, None), (3, ""), (4, " \t\n"), (None, "no id"), (5, "wort " * 6000), (6, "<|endoftext|> 12'34"), (7, "w" * 5000), (8, "wort " * 2047), (9, "wort " * 2048)]
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], DOCS)
    out = pack_best_fit(df, PATH).collect()
    want = sorted(((d is None, d or 0), n, 2048 * n, len(p), crc(p)) for d, t in rows for n, p in enumerate([ids[k : k + 2048] for ids in [whole_ids(t)] for k in range(0, len(ids), 2048)]))
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    assert check(out, 2048) == one_by_one([r["length"] for r in out], 2048)
    assert pack_best_fit(df.filter("doc_id = 99"), PATH).count() == 0


@pytest.mark.parametrize("kind", ["even", "small", "thirds", "skewed"])
def test_about_as_few_sequences_as_one_by_one(spark, kind):
    from tessera.llm.best_fit import best_fit

    rng = random.Random(9)
    draw = {
        "even": lambda: rng.randint(1, 1000),
        "small": lambda: rng.choice([7, 7, 7, rng.randint(1, 20)]),
        "thirds": lambda: rng.choice([333, 334, 335, 600, 399]),
        "skewed": lambda: min(1000, 1 + int(rng.paretovariate(0.7))),
    }[kind]
    sizes = [draw() for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(sizes)), "key long, size int")
    out = best_fit(df, 1000).collect()
    assert sorted((r["key"], r["size"]) for r in out) == list(enumerate(sizes))
    loads = defaultdict(int)
    for r in out:
        loads[r["sequence"]] += r["size"]
    assert max(loads.values()) <= 1000
    assert len(loads) <= one_by_one(sizes, 1000) * 1.01 + 1


def test_exchange_meets_only_gaps_before():
    from tessera.llm.best_fit import exchange

    got = exchange([(0, 0, 0, 3, 900), (1, 2, 800, 2, 500), (2, 9, 200, 0, 0), (3, 40, 100, 0, 0)])
    assert got == [(1, 0, 2, 0, 0, 1), (2, 0, 4, 1, 0, 2), (2, 4, 8, 0, 2, 4)]


def test_query_on_all_documents(spark):
    from tessera.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    out = QUERIES["op11_best_fit"](spark, sf)
    assert dict(out.dtypes) == {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"}
    rows = out.collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("text")).collect()}
    want = sorted((d, n, len(p), crc(p)) for d, t in texts.items() for n, p in enumerate([ids[k : k + 2048] for ids in [whole_ids(t)] for k in range(0, len(ids), 2048)]))
    assert sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in rows) == want
    assert check(rows, 2048) == one_by_one([r["length"] for r in rows], 2048)
