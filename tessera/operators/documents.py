"""The document channel: sentence-aware chunks, neighbours by range join, merging of graph and document hits."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import has_answer_instruction

_END = re.compile(r"[。！？!?；;\n]|\.(?=\s|$)")


def split_text(text: str | None, budget: int) -> list[str]:
    """Pieces of at most `budget` characters: cut after a sentence end in the back half, else after the last white space
    there, else at the budget. A budget of zero or less leaves the text whole; pieces joined give the text."""
    rest, out = text or "", []
    while budget > 0 and len(rest) > budget:
        head, half = rest[:budget], budget // 2
        ends = [m.end() for m in _END.finditer(head) if m.end() >= half]
        spaces = [m.end() for m in re.finditer(r"\s", head) if m.end() >= half]
        at = ends[-1] if ends else spaces[-1] if spaces else budget
        out.append(rest[:at])
        rest = rest[at:]
    return [*out, rest] if rest else out


def text_pieces(text: Column, budget: int) -> Column:
    """The pieces of split_text that aren't blank, as an array: one regular expression takes a text piece by piece, so that texts stay in the JVM.

    Its ways in order: what is left, if it fits; up to the last sentence end in the back half; up to the last white space there; the budget.
    """
    given = F.coalesce(text, F.lit(""))
    if budget <= 0:
        cut = F.array(given)
    else:
        least, blank, ends = max(budget // 2 - 1, 0), f"[{BLANK}]", "。！？!?；;\n"
        ways = [rf".{{1,{budget}}}+\z", rf".{{{budget - 1}}}[{ends}.]"]
        ways += [rf".{{{least},{budget - 2}}}(?:[{ends}]|\.(?={blank}))"] if budget - 2 >= least else []
        ways += [rf".{{{least},{budget - 1}}}{blank}", rf".{{{budget}}}"]
        cut = F.regexp_extract_all(given, F.lit(f"(?s){'|'.join(ways)}"), F.lit(0))
    return F.filter(cut, lambda p: p.rlike(f"[^{BLANK}]"))


def chunks(messages: DataFrame, budget: int = 1800) -> DataFrame:
    """doc_id, chunk_id, idx, total, text: derived chunks of (doc_id, msg_index, content), numbered over the document, without blank ones.

    Messages are cut on their own; the running index and the total come from sums of piece counts by window.
    """
    cut = messages.select("doc_id", "msg_index", text_pieces(F.col("content"), budget).alias("parts")).withColumn("k", F.size("parts"))
    order = Window.partitionBy("doc_id").orderBy("msg_index")
    placed = cut.withColumn("base", F.coalesce(F.sum("k").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("k").over(Window.partitionBy("doc_id")))
    rows = placed.select("doc_id", "base", "total", F.posexplode("parts").alias("p", "text")).withColumn("idx", (F.col("base") + F.col("p")).cast("int"))
    return rows.select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("c"), F.lpad(F.col("idx").cast("string"), 4, "0")).alias("chunk_id"), "idx", F.col("total").cast("int").alias("total"), "text")


def neighbours(hits: DataFrame, index: DataFrame, radius: int = 1) -> DataFrame:
    """query_id, doc_id, idx, place, score: hit chunks with the chunks around them in the same document, hits' score only.

    hits: query_id, doc_id, idx, place, score. Each hit names its 2 * radius + 1 places, so the range join is an equi-join.
    """
    around = hits.withColumn("step", F.explode(F.sequence(F.lit(-radius), F.lit(radius)))).withColumn("at", F.col("idx") + F.col("step"))
    found = around.join(index.select("doc_id", F.col("idx").alias("at")), ["doc_id", "at"])
    first = found.groupBy("query_id", "doc_id", "at").agg(F.min(F.struct("place", "step")).alias("f"), F.max(F.when(F.col("step") == 0, F.col("score"))).alias("score"))
    order = Window.partitionBy("query_id").orderBy("f.place", "f.step", "doc_id", "at")
    return first.withColumn("place", F.row_number().over(order)).select("query_id", "doc_id", F.col("at").alias("idx"), "place", "score")


#: White space of any script.
BLANK = r"\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fixed value: the mark of an option, after white space or a bracket, with white space after it.
OPTION = rf"(?:^|[{BLANK}（(])([A-H])[.、．)）][{BLANK}]"
#: The same where the white space after a mark may be the one before the next, so that no mark is lost behind another.
ADJOINING = rf"(?:^|[{BLANK}（(])([A-H])[.、．)）](?=[{BLANK}])"
#: A block of options is the last A that a B and then a C follow; other labels may stand between.
BLOCK = "^(.*)A.*B.*C"


def without_options(question: Column, mark: str = OPTION) -> Column:
    """The question, trimmed, without its block of options: what stands before the label that begins the block.

    The labels of all marks are one short string, in which a regular expression finds the block; the pieces of text between marks, and
    the marks before it, are put together again.
    """
    text = F.coalesce(question, F.lit(""))
    pieces, marks = F.split(text, mark, -1), F.regexp_extract_all(text, F.lit(mark), F.lit(0))
    labels = F.array_join(F.regexp_extract_all(text, F.lit(mark), F.lit(1)), "")
    first = F.length(F.regexp_extract(labels, BLOCK, 1))  # marks before the block
    before = F.array_join(F.transform(F.slice(pieces, F.lit(1), first + 1), lambda p, k: F.concat(p, F.when(k < first, F.get(marks, k)).otherwise(""))), "")
    opening = F.regexp_extract(F.get(marks, first), "^(.?)[A-H]", 1)
    whole = F.when(labels.rlike(BLOCK), F.concat(before, opening)).otherwise(text)
    return F.regexp_replace(whole, f"^[{BLANK}]+|[{BLANK}]+$", "")


def with_retrieval_text(df: DataFrame, question: str, name: str = "retrieval", mark: str = OPTION) -> DataFrame:
    """df with the text to search for: the question itself, or, if it asks for one exact answer, without its options, unless that
    leaves nothing."""
    own = F.col(question)
    stripped = without_options(own, mark)
    return df.withColumn(name, F.when(has_answer_instruction(own) & (stripped != ""), stripped).otherwise(own))


def salvage(broken: str | None) -> list[str]:
    """The complete JSON objects of a truncated list: braces are matched outside strings."""
    out, depth, start, inside, escaped = [], 0, -1, False, False
    for i, c in enumerate(broken or ""):
        if inside:
            escaped, inside = (c == "\\" and not escaped), not (c == '"' and not escaped)
        elif c == '"':
            inside = True
        elif c == "{":
            start, depth = (i, 1) if depth == 0 else (start, depth + 1)
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                out.append((broken or "")[start : i + 1])
    return out


def apply_text(df: DataFrame, column: str, name: str, function, kind: str) -> DataFrame:
    """df with one of the text functions above applied to a column in Arrow batches."""

    @F.pandas_udf(kind)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(function)

    return df.withColumn(name, run(column))
