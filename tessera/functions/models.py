"""Model-backed steps as pluggable columns: any function over batches of texts, and fakes that need no network."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = re.compile(r"\w+")


def hashed_words(texts: list[str], dims: int = 256) -> np.ndarray:
    """Deterministic embeddings: hashed bags of words of unit length; texts without words are zero."""
    out = np.zeros((len(texts), dims), dtype=np.float32)
    for row, text in zip(out, texts, strict=True):
        for w in _WORD.findall(text.lower()):
            row[int.from_bytes(hashlib.blake2b(w.encode(), digest_size=4).digest(), "little") % dims] += 1
        size = np.linalg.norm(row)
        row /= size if size else 1
    return out


def embedder(embed: Callable[[list[str]], np.ndarray] = hashed_words, count: int = 10, chars: int = 20_000, longest: int | None = None) -> Callable[[Column], Column]:
    """A column function: whole texts are embedded in calls of at most `count` texts and `chars` characters (one text may have more).

    longest cuts texts, for endpoints that have such a limit.

    A call that fails with ValueError is halved until it holds one text, which then fails for good. Null texts give null.
    """

    def call(texts: list[str]) -> list[np.ndarray]:
        try:
            return list(embed(texts))
        except ValueError:
            if len(texts) == 1:
                raise
            half = len(texts) // 2
            return call(texts[:half]) + call(texts[half:])

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            out: list = [None] * len(part)
            batch: list[int] = []
            size = 0
            texts = [None if t is None else t[:longest] for t in part]
            for i, t in [*enumerate(texts), (len(texts), "")]:
                if batch and (i == len(texts) or len(batch) >= count or size + len(t or "") > chars):
                    for k, v in zip(batch, call([texts[k] for k in batch]), strict=True):
                        out[k] = v.tolist()
                    batch, size = [], 0
                if i < len(texts) and t is not None:
                    batch.append(i)
                    size += len(t)
            yield pd.Series(out)

    return run


def completer(ask: Callable[[str], str], parse: Callable[[str], object], kind: str, default: object = None, tries: int = 2) -> Callable[[Column], Column]:
    """A column function for a chat model: each prompt is asked, its answer parsed to the given type; an answer that does not parse
    (ValueError) or is None is asked for again, and after `tries` of them the default stands. Null prompts give null."""

    def one(prompt: str) -> object:
        for _ in range(tries):
            try:
                found = parse(ask(prompt))
            except ValueError:
                found = None
            if found is not None:
                return found
        return default

    @F.pandas_udf(kind)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([None if p is None else one(p) for p in part], dtype=object)

    return run


def fitting(write: Callable[[list[str]], str], texts: list[str], chars: int = 2_000, shrink: float = 0.6, least: int = 6, rounds: int = 3) -> str:
    """A model's text over a list of texts within a length: written once more if too long, then over a shrinking head of the list
    (at least `least` of them, at most `rounds` times); what is still too long is cut at a sentence end, else hard."""
    story = write(texts)
    if len(story) > chars:
        story = write(texts)
    for _ in range(rounds):
        keep = max(least, int(len(texts) * shrink))
        if len(story) <= chars or keep >= len(texts):
            break
        texts = texts[:keep]
        story = write(texts)
    if len(story) <= chars:
        return story
    ends = [m.end() for m in re.finditer(r"[。！？；\n.!?;]", story[: chars - 1]) if m.end() >= chars - 200]
    return story[: ends[-1] if ends else chars - 1].rstrip() + "…"


def purpose_text(purposes: Column) -> Column:
    """What a purpose vector is the embedding of."""
    return F.concat_ws(" ", purposes)
