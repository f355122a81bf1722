"""Conversations and evidence as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import date_of


def conversation(messages: DataFrame) -> DataFrame:
    """conv_id, content: one line per message, [role@date] text, the date only where there is a ts (milliseconds)."""
    at = F.coalesce(F.concat(F.lit("@"), date_of(F.col("ts"))), F.lit("")) if "ts" in messages.columns else F.lit("")
    line = F.concat(F.lit("["), "role", at, F.lit("] "), F.coalesce("text", F.lit("")))
    rows = F.sort_array(F.collect_list(F.struct("turn", line.alias("line"))))
    return messages.groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("content"))


def evidence_node(kind: Column, content: Column, ts: Column) -> Column:
    """[kind] content, with the date before it where the time is known."""
    return F.concat(F.lit("["), kind, F.lit("] "), F.coalesce(F.concat(date_of(ts), F.lit(" ")), F.lit("")), content)


def batch_time(messages: DataFrame) -> DataFrame:
    """conv_id, ts: the last known time of the messages in order."""
    return messages.groupBy("conv_id").agg(F.max_by("ts", F.when(F.col("ts").isNotNull(), F.col("turn"))).alias("ts"))
