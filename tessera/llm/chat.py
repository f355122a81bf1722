"""Chat formatting: typed content parts flattened into a reversible template with a loss mask."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import free_name, n_words

#: One part of a message. units: pixels of an image, milliseconds of audio, pages of a document; text of a text part.
PART = T.StructType(
    [T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("ref", T.StringType()), T.StructField("units", T.LongType())]
)
PART_DDL = "struct<kind:string,text:string,ref:string,units:bigint>"
#: Units that expand to one token.
PER_TOKEN = {"image": 784, "audio": 40, "document": 1}
DOCUMENT_TOKENS = 1024

# Control strings: a turn is "### ", the role, a line end, the content, "</turn>" and a line end; "<|" opens a placeholder.
# A backslash goes before each one inside a text, and before each backslash; a role's line end gets one as well.
CONTROL = r"\\|### |</turn>|<\|"
OPEN, CLOSE = "### ", "</turn>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), CONTROL, r"\\$0")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_parts(text: Column) -> Column:
    """A plain text as the list of its one part."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("units")))


def is_text(part: Column) -> Column:
    """A part of null kind is a text, too."""
    return F.coalesce(part["kind"], F.lit("text")) == "text"


def expanded(part: Column) -> Column:
    """Tokens that a part stands for: words of a text; of an attachment, units by PER_TOKEN, at least one."""
    units = F.coalesce(part["units"], F.lit(0))
    most = F.when(part["kind"] == "image", F.ceil(units / PER_TOKEN["image"]))
    most = most.when(part["kind"] == "audio", F.ceil(units / PER_TOKEN["audio"])).otherwise(units * DOCUMENT_TOKENS)
    return F.when(is_text(part), n_words(part["text"])).otherwise(F.greatest(most, F.lit(1))).cast("long")


def before(counts: Column, first: Column) -> Column:
    """For an array of counts, first plus the sum of those before each place, in one fold."""
    start = F.struct(first.cast("int").alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda s, n: F.struct((s["at"] + n).cast("int").alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
    return F.aggregate(counts, start, step, lambda s: s["out"])


def visit(parts: Column) -> Column:
    """Flattened content, a string for each part: a text is escaped; another part is the placeholder <|kind:k|> with k, its place
    among the message's attachments. A null list is empty.

    No control string can arise from more parts than one: a text that follows a text begins with a backslash. In a kind a
    backslash goes before each character that a placeholder or a turn is told by.
    """
    given = F.coalesce(parts, F.array().cast(f"array<{PART_DDL}>"))
    places = before(F.transform(given, lambda p: F.when(is_text(p), 0).otherwise(1)), F.lit(0))
    kind = lambda p: F.regexp_replace(p["kind"], r"[\\|<>:#\n]", r"\\$0")

    def flat(p: Column, i: Column) -> Column:
        own = escape(p["text"])
        seam = (i > 0) & is_text(F.get(given, i - 1)) & ~own.startswith("\\") & (own != "")
        placeholder = F.concat(F.lit("<|"), kind(p), F.lit(":"), F.get(places, i).cast("string"), F.lit("|>"))
        return F.when(is_text(p), F.concat(F.when(seam, "\\").otherwise(""), own)).otherwise(placeholder)

    return F.transform(given, flat)


def format_turns(messages: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Messages (conv_id, turn, role, parts) with formatted, loss, attachments and tokens.

    formatted is the turn in the template; concatenated by turn the rows of a conversation are its training text. loss lists
    (start, length) ranges of code points of formatted: the text parts of trained roles, without the placeholders.
    attachments lists (place, kind, ref, tokens); tokens counts all parts expanded. Each row is formatted on its own,
    so a conversation of any length is spread over tasks. Null roles are empty; unknown kinds count as documents. Other columns
    pass; those of the four names are replaced. Empty input, empty result.
    """
    role = F.regexp_replace(escape(F.col("role")), "\n", "\\\\\n")
    head, flat = free_name(messages, "head"), free_name(messages, "flat")
    kept = [F.col(c) for c in messages.columns if c.lower() not in ("formatted", "loss", "attachments", "tokens")]
    laid = messages.withColumn(head, F.concat(F.lit(OPEN), role, F.lit("\n"))).withColumn(flat, visit(F.col("parts")))
    starts = before(F.transform(flat, F.length), F.length(head))
    ranges = F.transform(
        F.arrays_zip(starts.alias("start"), F.transform(flat, F.length).alias("length"), F.transform("parts", is_text).alias("own")),
        lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["own"].alias("own")),
    )
    own = F.transform(F.filter(ranges, lambda r: r["own"] & (r["length"] > 0)), lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length")))
    others = F.filter("parts", lambda p: ~is_text(p))
    return laid.select(
        *kept,
        F.concat(head, F.array_join(flat, ""), F.lit(CLOSE)).alias("formatted"),
        F.when(F.coalesce(F.col("role").isin(*trained), F.lit(False)) & F.col("parts").isNotNull(), own).otherwise(F.array().cast("array<struct<start:int,length:int>>")).alias("loss"),
        F.transform(others, lambda p, i: F.struct(i.alias("place"), p["kind"].alias("kind"), p["ref"].alias("ref"), expanded(p).alias("tokens"))).alias("attachments"),
        F.coalesce(F.aggregate(F.transform("parts", expanded), F.lit(0).cast("long"), lambda a, b: a + b), F.lit(0)).alias("tokens"),
    )


def read_turns(formatted: DataFrame) -> DataFrame:
    """Role and text read back from formatted turns, and `learned`, the unescaped text under the loss mask.

    Only the columns formatted and loss are looked at. Placeholders stay in the text as they are; conv_id and turn pass.
    """
    whole = r"(?s)^### ((?:\\.|[^\\\n])*+)\n(.*)</turn>\n$"
    masked = F.array_join(F.transform("loss", lambda r: unescape(F.substring(F.col("formatted"), r["start"] + 1, r["length"]))), "")
    return formatted.select(
        "conv_id",
        "turn",
        unescape(F.regexp_extract("formatted", whole, 1)).alias("role"),
        unescape(F.regexp_extract("formatted", whole, 2)).alias("text"),
        masked.alias("learned"),
        F.length("formatted").cast("long").alias("chars"),
    )


def digests(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A SHA-256 runs through a conversation in order, so its turns meet in one task; they stream through it sorted, with one
    hash state in memory, however long the conversation. Turns with equal numbers go by role and text; null turns and
    null conversations come first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kind, now, out = None, None, []

        def closed() -> list:
            conv, n, turns, loss_n, loss, chars = now
            return [conv, n, turns.hexdigest(), loss_n, loss.hexdigest(), chars]

        for batch in batches:
            kind = batch.schema.field(0).type
            for conv, role, text, learned, chars in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        out.append(closed())
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode())
                now[3] += len(learned)
                now[4].update(learned.encode())
                now[5] += chars
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()], strict=True)], names)
                out = []
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(closed(), [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()], strict=True)], names)

    kind = dict(turns.dtypes)["conv_id"]
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text", "learned", "chars")
    return ordered.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
