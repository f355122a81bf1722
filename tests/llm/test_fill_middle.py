"""Fill-in-middle against plain splitting, and the wavelet matrix against plain counts."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.harness import compare

DOCS = "doc_id long, text string, n string, form string, output string, cut string"


def test_ranks():
    from tessera.llm.fill_middle import WaveletMatrix

    rng = np.random.default_rng(5)
    for n in (0, 1, 63, 64, 65, 1000):
        symbols = rng.integers(0, 8, n).astype(np.uint8)
        matrix, at = WaveletMatrix(symbols), np.arange(n + 1)
        for c in range(8):
            assert matrix.rank(c, at).tolist() == [int((symbols[:i] == c).sum()) for i in at]


@pytest.mark.parametrize("unit, pattern", [("line", r"[^\n]*\n|[^\n]+"), ("sentence", r"[^.!?\n]*[.!?\n]|[^.!?\n]+"), ("word", r"[^ \t\n]*[ \t\n]|[^ \t\n]+")])
def test_boundaries(unit, pattern):
    from tessera.llm.fill_middle import Boundaries

    texts = ["", "\n", "a", "a\nb", "a\nb\n", "\n\n\n", "ä. 漢字!\n\U0001f600?", "one two.\tthree\n" * 50, ""]
    found = Boundaries(texts, unit)
    units = [re.findall(pattern, t) for t in texts]
    assert found.units.tolist() == [len(u) for u in units]
    for k in range(60):
        want = [len("".join(u[:k])) for u in units]
        assert found.cut(np.full(len(texts), k)).tolist() == want


def rows():
    return [(1, "a\nb\nc\n"), (1, "a\nb\nc\n"), (2, None), (3, ""), (None, "x\ny"), (4, "has <P> in it\nsecond"), (5, "\n" * 9), (6, "Zeile ä\n" * 40_000), (7, "no newline " * 20_000), (8, "a\r\nb c\x85d"), (9, "1\n2\n3\n4"), (10, "<S"), (11, "漢字\nかな\n\U0001f600")]


def plain_form(doc_id, text, rate=100, spm=50):
    h = hashlib.sha256(f"7:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    spm_form = h4 % 100 < spm
    return n, "spm" if spm_form else "psm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}" if spm_form else f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("rate, spm", [(100, 50), (40, 0)])
def test_odd_documents(spark, rate, spm):
    from tessera.llm.fill_middle import fill_in_middle, restore

    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows()], DOCS)
    got = fill_in_middle(df, rate=rate, spm=spm).withColumn("back", restore(F.col("output"), F.col("form"))).collect()
    key = lambda x: (x[0] is None, x[0], x[1])
    want = [(d, *plain_form(d, t, rate, spm), t or "") for d, t in rows()]
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)
    assert fill_in_middle(df.filter("doc_id = 99")).count() == 0


def test_against_sql(spark):
    from tessera.llm.queries import ORACLE, QUERIES

    assert compare(spark, QUERIES["op12_fill_middle"], ORACLE["op12_fill_middle"], "/root/testdata/sf0.01") == 1000
