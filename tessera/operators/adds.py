"""Where the messages of an add request go: feedback, documents, groups for the graph, and raw text that must not get lost."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import is_feedback
from tessera.operators.documents import BLANK, text_pieces
from tessera.operators.maintenance import next_ids
from tessera.operators.routing import batch_shape, pack_batches
from tessera.session import materialize

#: Messages of one request that go to the graph; the others are stored as documents.
LIMIT = 64
#: Characters of a raw chunk, and chunks of one request that become nodes.
CHUNK, NODES = 500, 256


def route(messages: DataFrame, modes: DataFrame | None = None, limit: int = LIMIT) -> DataFrame:
    """messages (conv_id, turn, role, text; one conv_id is one request) with route and batch.

    Feedback is dropped (route feedback). Of the others the first `limit` are judged by their shape: noise is dropped; a document, and all
    of a conversation in a space whose mode is documents (modes: conv_id, mode), is stored as a document with all that is over the limit;
    a conversation goes to the graph in batches, and what is over the limit is overflow, stored as documents of a conversation.
    """
    marked = messages.withColumn("feedback", is_feedback(F.col("text")))
    place = F.row_number().over(Window.partitionBy("conv_id", "feedback").orderBy("turn"))
    placed = marked.withColumn("over", ~F.col("feedback") & (place > limit))
    first = placed.filter("NOT feedback AND NOT over")
    shapes = batch_shape(first).select("conv_id", "shape")
    if modes is not None:
        shapes = shapes.join(modes, "conv_id", "left").withColumn("shape", F.when((F.col("mode") == "documents") & (F.col("shape") != "noise"), "document").otherwise(F.col("shape"))).drop("mode")
    talk = first.join(shapes.filter("shape = 'conversation'"), "conv_id", "left_semi").select("conv_id", "turn", "text")
    batches = pack_batches(talk).select("conv_id", "turn", "batch")
    joined = placed.join(shapes, "conv_id", "left").join(batches, ["conv_id", "turn"], "left")
    kind = F.when(F.col("feedback"), "feedback").when(F.col("shape") != "conversation", F.col("shape")).when(F.col("over"), "overflow").otherwise("graph")
    return joined.select(*messages.columns, kind.alias("route"), F.when(kind == "graph", F.col("batch")).alias("batch"))


def raw_chunks(messages: DataFrame, size: int = CHUNK) -> DataFrame:
    """conv_id, place (from 0), content: `role: text` of each message that isn't blank, cut at sentence ends (documents.text_pieces), in order; blank pieces go.

    Messages are cut on their own and numbered by the running sum of their pieces.
    """
    blank = f"^[{BLANK}]+|[{BLANK}]+$"
    bare = messages.withColumn("text", F.regexp_replace(F.coalesce("text", F.lit("")), blank, "")).filter("text <> ''")
    cut = bare.select("conv_id", "turn", text_pieces(F.concat(F.coalesce("role", F.lit("")), F.lit(": "), "text"), size).alias("parts"))
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    placed = cut.withColumn("base", F.coalesce(F.sum(F.size("parts")).over(before), F.lit(0)))
    return placed.select("conv_id", "base", F.posexplode("parts").alias("p", "content")).select("conv_id", (F.col("base") + F.col("p")).cast("long").alias("place"), "content")


def store_raw(messages: DataFrame, nodes: DataFrame, size: int = CHUNK, most: int = NODES) -> tuple[DataFrame, DataFrame]:
    """(new nodes, overflow) of raw messages: every chunk becomes a node of type thing, equal or not to what is there, so that none is
    lost to deduplication; chunks of a request after the first `most` are the overflow (conv_id, place, content), to be stored as documents.

    New nodes have node_id, which count on from the largest in use without gaps over all tasks, in the order of (conv_id, place).
    """
    chunks = materialize(raw_chunks(messages, size), "chunks")  # read by the numbering, the nodes and the overflow
    kept = chunks.filter(F.col("place") < most).withColumn("order", F.struct("conv_id", "place"))
    new = next_ids(nodes.select("node_id"), kept, "order").select("node_id", F.lit("thing").alias("node_type"), "content", "conv_id", "place")
    return new, chunks.filter(F.col("place") >= most)
