"""Intake and bookkeeping: request checks, batches of operations, flush bodies, logs, inventories, knowledge lookups."""

from __future__ import annotations

import difflib
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import truncate
from tessera.functions.vectors import cosine
from tessera.operators.documents import BLANK
from tessera.operators.keyword import MOST, search
from tessera.operators.maintenance import edge_reject_reason, next_ids, resolve_ids
from tessera.operators.ordered import scan
from tessera.session import materialize

#: The largest number of answers that a request may ask for, and that one answer holds.
CONTRACT_TOP_K, ANSWER_TOP_K = 100, 25
#: Characters of a note that an answer shows.
NOTE_CHARS = 1200
#: New nodes whose edges are looked for at once.
LINK_BATCH = 24
#: Rounds that a flush hands on, and empty flushes in a row after which the next ones are skipped.
FLUSH_ROUNDS, EMPTY_FLUSHES = 10, 5
#: Request ids that are remembered.
REQUESTS = 8192


# Fixed value: who may speak.
ROLES = ["user", "assistant"]


def _kind(value: Column) -> Column:
    """The type of a JSON value as text; null where there is none."""
    return F.schema_of_variant(value)


def _field(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "variant")


def _text_reason(value: Column, name: str) -> Column:
    """True where a field is not a text with something in it."""
    field = _field(value, name)
    return ~F.coalesce((_kind(field) == "STRING") & ~F.try_variant_get(field, "$", "string").rlike(f"^[{BLANK}]*$"), F.lit(False))


def _absent(value: Column) -> Column:
    return value.isNull() | F.coalesce(F.is_variant_null(value), F.lit(False))


def search_request(body: Column) -> dict[str, Column]:
    """query, user_id, top_k (capped), options and reject_reason of a JSON search request, by the types of its fields: query and user_id are
    texts and not blank, top_k is a positive whole number below 2^63, options are null or a list of texts. What is no JSON object, or has a name twice, is
    rejected as `body`; rejected requests have no fields."""
    v = F.try_parse_json(body)
    top, options = _field(v, "top_k"), _field(v, "options")
    number = F.when(_kind(top) == "BIGINT", F.try_variant_get(top, "$", "long"))
    listed = F.try_variant_get(options, "$", "array<variant>")
    reason = (
        F.when(~F.coalesce(_kind(v).startswith("OBJECT"), F.lit(False)), "body")
        .when(_text_reason(v, "query"), "query")
        .when(_text_reason(v, "user_id"), "user_id")
        .when(~F.coalesce(number > 0, F.lit(False)), "top_k")
        .when(~_absent(options) & ~F.coalesce(F.forall(listed, lambda o: F.coalesce(_kind(o) == "STRING", F.lit(False))), F.lit(False)), "options")
    )
    good = lambda c: F.when(reason.isNull(), c)
    text = lambda name: good(F.try_variant_get(v, f"$.{name}", "string"))
    return {"query": text("query"), "user_id": text("user_id"), "top_k": good(F.least(number, F.lit(CONTRACT_TOP_K))), "options": good(F.try_variant_get(options, "$", "array<string>")), "reject_reason": reason}


def add_request(body: Column) -> dict[str, Column]:
    """request_id, user_id, session_id, messages (role, content, timestamp) and reject_reason of a JSON add request: the ids are texts and not
    blank, messages a list with something in it, of objects with a known role, a content that is not blank, and no timestamp or a whole number.
    A reason in a message has its place. Rejected requests have no fields."""
    v = F.try_parse_json(body)
    listed = F.try_variant_get(_field(v, "messages"), "$", "array<variant>")

    def wrong(m: Column) -> Column:
        role, stamp = _field(m, "role"), _field(m, "timestamp")
        known = F.coalesce((_kind(role) == "STRING") & F.try_variant_get(role, "$", "string").isin(ROLES), F.lit(False))
        return (
            F.when(~F.coalesce(_kind(m).startswith("OBJECT"), F.lit(False)), "message")
            .when(~known, "role")
            .when(_text_reason(m, "content"), "content")
            .when(~_absent(stamp) & ~F.coalesce(_kind(stamp) == "BIGINT", F.lit(False)), "timestamp")
        )

    faults = F.filter(F.transform(listed, lambda m, k: F.struct(k.alias("k"), wrong(m).alias("why"))), lambda f: f["why"].isNotNull())
    fault = F.get(faults, 0)
    reason = (
        F.when(~F.coalesce(_kind(v).startswith("OBJECT"), F.lit(False)), "body")
        .when(_text_reason(v, "request_id"), "request_id")
        .when(_text_reason(v, "user_id"), "user_id")
        .when(_text_reason(v, "session_id"), "session_id")
        .when(~F.coalesce(F.size(listed) > 0, F.lit(False)), "messages")
        .when(fault.isNotNull(), F.concat(F.lit("messages["), fault["k"].cast("string"), F.lit("]."), fault["why"]))
    )
    good = lambda c: F.when(reason.isNull(), c)
    text = lambda name: good(F.try_variant_get(v, f"$.{name}", "string"))
    messages = F.try_variant_get(_field(v, "messages"), "$", "array<struct<role:string,content:string,timestamp:bigint>>")
    return {"request_id": text("request_id"), "user_id": text("user_id"), "session_id": text("session_id"), "messages": good(messages), "reject_reason": reason}


def graph_name_reason(name: Column) -> Column:
    """Why a name can't be a graph file of the library; null where it can."""
    return (
        F.when(F.coalesce(F.length(name), F.lit(0)) == 0, "empty")
        .when(name.rlike(r"[\\/:\x00-\x1f]"), "path")
        .when(name.startswith("."), "hidden")
        .when(~F.lower(name).rlike(r"\.ya?ml$"), "suffix")
    )


def round_text(ts: Column, text: Column) -> Column:
    """A round with its time of arrival (milliseconds) before it, to the second, in the session's time zone."""
    stamp = F.date_format(F.timestamp_millis(ts), "yyyy-MM-dd HH:mm:ss")
    return F.when(F.coalesce(ts, F.lit(0)) != 0, F.concat(F.lit("["), stamp, F.lit("] "), text)).otherwise(text)


def relevance(a: Column, b: Column, l2: Column) -> Column:
    """The cosine of two vectors; where either is missing or without length, what a distance is worth: 1 - max(0, d) / 2."""
    size = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    real = a.isNotNull() & b.isNotNull() & (F.coalesce(size(a) * size(b), F.lit(0.0)) > 1e-12)
    return F.when(real, cosine(a, b)).otherwise(1 - F.greatest(l2, F.lit(0.0)) / 2)


def fetch(wanted: DataFrame, vectors: DataFrame) -> DataFrame:
    """wanted (place, id) with embedding and dims, null where there is no vector; places stay."""
    return wanted.join(vectors.select("id", "embedding"), "id", "left").select("place", "id", "embedding", F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("dims"))


def knowledge(queries: DataFrame, index: DataFrame, notes: DataFrame, top_k: int = 8, rerank: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """query_id, id, score, place, text, truncated: notes (id, text, observed_at) by keywords, three times as many as asked for; a
    reranker scores those hits alone (query_id, id, score) and gives the order, without those that it leaves out."""
    k = max(1, min(top_k, MOST))
    hits = search(queries, index, notes, min(MOST, 3 * k))
    if rerank is not None:
        hits = materialize(hits, "hits")
        ranked = hits.join(rerank(hits).select("query_id", "id", F.col("score").alias("rerank")), ["query_id", "id"])
        order = Window.partitionBy("query_id").orderBy(F.desc("rerank"), "place")
        hits = ranked.withColumn("place", F.row_number().over(order))
    shown = hits.filter(F.col("place") <= k).join(notes.select("id", "text"), "id")
    return shown.select("query_id", "id", "score", "place", truncate(F.col("text"), NOTE_CHARS).alias("text"), (F.length("text") > NOTE_CHARS).alias("truncated"))


def searchable(notes: DataFrame) -> DataFrame:
    """Notes that belong in the index: active and not blank."""
    return notes.filter(~F.coalesce("deprecated", F.lit(False)) & ~F.coalesce("forgotten", F.lit(False)) & (F.trim(F.coalesce("text", F.lit(""))) != ""))


def apply_batch(nodes: DataFrame, edges: DataFrame, node_ops: DataFrame, edge_ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mapping, judged) of a batch: temp_id, node_id, created for each node operation, and the edge operations with their ids and
    reject_reason. nodes: node_id, node_type, content. node_ops: temp_id, content, node_type, ord. edge_ops: src, dst, rel_type.

    A text that an existing node has, or an earlier operation, makes no new node. Edges go to the nodes that come of it; each is
    judged on its own, so a bad one leaves the rest.
    """
    known = nodes.groupBy("content").agg(F.min("node_id").alias("known"))
    first = F.min(F.struct("ord", "temp_id", "node_type"))
    ops = node_ops.filter(F.trim(F.coalesce("content", F.lit(""))) != "")
    each = ops.groupBy("content").agg(first.alias("f")).join(known, "content", "left")
    new = next_ids(nodes.select("node_id"), each.filter("known IS NULL").select("content", F.col("f.ord").alias("ord"), F.col("f.node_type").alias("node_type")), "ord")
    made = new.select("content", F.col("node_id").alias("made"))
    named = ops.join(each.select("content", F.col("f.temp_id").alias("maker"), "known"), "content").join(made, "content", "left")
    mapping = named.select("temp_id", F.coalesce("known", "made").alias("node_id"), (F.col("known").isNull() & (F.col("temp_id") == F.col("maker"))).alias("created"))
    every = nodes.select("node_id", "node_type").unionByName(new.select("node_id", "node_type"))
    return mapping, edge_reject_reason(resolve_ids(edge_ops, mapping), every, edges)


def edge_reach(edge_ops: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """keys, inner, cross: created edges with both ends among the new nodes (node_id) of their batch, and with one."""
    side = lambda c: new.select(*keys, F.col("node_id").alias(c), F.lit(1).alias(f"new_{c}"))
    met = edge_ops.join(side("src"), [*keys, "src"], "left").join(side("dst"), [*keys, "dst"], "left")
    ends = F.coalesce("new_src", F.lit(0)) + F.coalesce("new_dst", F.lit(0))
    return met.groupBy(*keys).agg(F.count_if(ends == 2).alias("inner"), F.count_if(ends == 1).alias("cross"))


def link_batches(new: DataFrame, key: str, order: str, size: int = LINK_BATCH) -> DataFrame:
    """new with batch, from 0: nodes of a key in their order, `size` at a time."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return new.withColumn("batch", F.floor((place - 1) / size).cast("int"))


def flush_bodies(rounds: DataFrame, flushes: DataFrame, keep: int = FLUSH_ROUNDS) -> DataFrame:
    """conv_id, round, flush, part: the flush that takes each round; its newest `keep` rounds are handed on (batch), older ones are
    stored raw. rounds: conv_id, round. flushes: conv_id, round (the last that each takes)."""
    marks = rounds.select("conv_id", "round").join(flushes.select("conv_id", "round", F.col("round").alias("end")), ["conv_id", "round"], "left")
    ahead = Window.partitionBy("conv_id").orderBy("round").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    taken = marks.withColumn("flush", F.min("end").over(ahead)).filter("flush IS NOT NULL")
    back = F.row_number().over(Window.partitionBy("conv_id", "flush").orderBy(F.desc("round")))
    return taken.select("conv_id", "round", "flush", F.when(back <= keep, "batch").otherwise("raw").alias("part"))


def auto_skips(flushes: DataFrame, threshold: int = EMPTY_FLUSHES) -> DataFrame:
    """flushes (conv_id, round, reason, empty) with skipped: after `threshold` empty ones in a row a flush is not worked on, unless it is
    the session's end or asked for by hand. A skipped flush counts neither way."""

    def step(state: int, row: tuple) -> tuple[int, bool]:
        if row.reason not in ("end", "manual") and state >= threshold:
            return state, True
        return (state + 1 if row.empty else 0), False

    return scan(flushes.select("conv_id", "round", "reason", "empty"), "conv_id", ["round"], lambda: 0, step, "skipped", "boolean")


def remembered_requests(log: DataFrame, most: int = REQUESTS) -> DataFrame:
    """rid, seq of the newest request ids of an append log (seq, rid), each at its last place."""
    return log.filter(F.coalesce("rid", F.lit("")) != "").groupBy("rid").agg(F.max("seq").alias("seq")).orderBy(F.desc("seq")).limit(most)


# What file names of a space ended in before each space had a folder, longest first.
OLD_ENDINGS = [".docs.yaml", ".docs.log", ".docs.index", ".index", ".yaml"]


def space_inventory(files: DataFrame) -> DataFrame:
    """space, files, newest of a listing (path below the data folder, modified): a top folder is a space, and so is what old names
    share before their ending; other top files belong to none."""
    top = F.split("path", "/")
    name, is_folder = F.get(top, 0), F.size(top) > 1
    ending = "(" + "|".join(re.escape(e) for e in OLD_ENDINGS) + ")$"
    space = F.when(name.rlike(ending), F.regexp_replace(name, ending, "")).when(is_folder, name)
    return files.withColumn("space", space).filter("space IS NOT NULL").groupBy("space").agg(F.count(F.lit(1)).alias("files"), F.max("modified").alias("newest"))


def recent_errors(log: DataFrame, most: int = 20) -> DataFrame:
    """The last errors of a request log (ts, event_id, method, error), newest first."""
    return log.filter("error").orderBy(F.desc("ts"), F.desc("event_id")).limit(most)


def latest_time(evidence: DataFrame, key: str) -> DataFrame:
    """key, latest: the latest known time of what a story rests on; times of zero or less are unknown."""
    return evidence.groupBy(key).agg(F.max(F.when(F.col("ts") > 0, F.col("ts"))).alias("latest"))


def story_fallback(nodes: DataFrame, most: int = 40, chars: int = 2000) -> DataFrame:
    """query_id, story, used: the best `most` texts (query_id, score, place, content) joined by spaces and cut, and how many are whole."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "place")
    top = nodes.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    upto = F.sum(F.length("content")).over(Window.partitionBy("query_id").orderBy("rank")) + F.col("rank") - 1
    whole = top.withColumn("whole", upto <= chars)
    texts = F.transform(F.sort_array(F.collect_list(F.struct("rank", "content"))), lambda r: r["content"])
    return whole.groupBy("query_id").agg(F.left(F.array_join(texts, " "), F.lit(chars)).alias("story"), F.count_if("whole").alias("used"))


# The letters that digits stand for, and what else is no part of a plain name.
SPELLED = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
NO_NAME = "[^a-z0-9\u4e00-\u9fff]"


def plain_name(name: Column) -> Column:
    """A name in lower case with letters for digits, without signs and blanks."""
    return F.regexp_replace(F.translate(F.lower(name), "".join(SPELLED), "".join(SPELLED.values())), NO_NAME, "")


def aligned(given: DataFrame, keys: list[str], expected: list[str], least: float = 0.8) -> DataFrame:
    """keys, place, name, given, level: the given names (keys, pos, given) that stand for the expected ones, each used once.

    Level 1 is the same name, 2 the same plain name, of which the first of either side meet, 3 alike by `least` at least: expected names in
    their order take the most alike that is left, the first on ties. Likeness is Python's sequence ratio, taken only of what the first
    two levels leave; a least above 1 leaves level 3 out. Levels 1 and 2 are joins with the expected names.
    """
    spark = given.sparkSession
    wanted = spark.createDataFrame([(k, n) for k, n in enumerate(expected)], "place int, name string").withColumn("plain", plain_name(F.col("name")))
    plain = plain_name(F.col("given"))
    if least > 1 and expected:  # a plain name is no longer than its name; a column without nulls is computed once, not for a filter of nulls too
        shortest = wanted.agg(F.min(F.length("plain"))).first()[0]
        given, plain = given.filter(F.length("given") >= shortest), F.coalesce(plain, F.lit(""))
    rows = given.select(*keys, "pos", "given", plain.alias("plain"))
    near = materialize(rows.join(F.broadcast(wanted.select("plain").distinct()), "plain", "left_semi") if least > 1 else rows, "given")
    exact = near.join(F.broadcast(wanted.drop("plain")), F.col("given") == F.col("name")).groupBy(*keys, "place", "name").agg(F.min_by("given", "pos").alias("given"))
    exact = materialize(exact, "exact")
    spare = near.join(exact.select(*keys, "given"), [*keys, "given"], "left_anti")
    open_ = near.select(*keys).distinct().join(F.broadcast(wanted)).join(exact.select(*keys, "place"), [*keys, "place"], "left_anti")
    first = open_.groupBy(*keys, "plain").agg(F.min(F.struct("place", "name")).alias("e")).join(spare.groupBy(*keys, "plain").agg(F.min_by("given", "pos").alias("given")), [*keys, "plain"])
    plain = first.select(*keys, "e.place", "e.name", "given", F.lit(2).alias("level"))
    found = exact.select(*keys, "place", "name", "given", F.lit(1).alias("level")).unionByName(plain)
    if least > 1:
        return found

    @F.pandas_udf("double")
    def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype=float)

    plain = materialize(plain, "plain")
    rest = open_.join(plain.select(*keys, "place"), [*keys, "place"], "left_anti").withColumnRenamed("plain", "ours")
    pairs = rest.join(spare.join(plain.select(*keys, "given"), [*keys, "given"], "left_anti"), keys)
    alike = pairs.withColumn("unlike", -likeness("ours", "plain")).filter(F.col("unlike") <= -least)
    listed = alike.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("place", "unlike", "pos", "name", "given"))).alias("all"))
    none = F.array().cast("array<struct<place:int,unlike:double,pos:int,name:string,given:string>>")
    free = lambda taken, c: ~F.exists(taken, lambda t: (t["place"] == c["place"]) | (t["given"] == c["given"]))
    taken = F.aggregate("all", none, lambda taken, c: F.when(free(taken, c), F.concat(taken, F.array(c))).otherwise(taken))  # a name each at most
    third = listed.select(*keys, F.explode(taken).alias("t")).select(*keys, "t.place", "t.name", "t.given", F.lit(3).alias("level"))
    return found.unionByName(third)


def label_shares(labels: DataFrame, column: str) -> DataFrame:
    """label, n, share over the rows of lists of labels; a row may have several."""
    whole = labels.agg(F.count(F.lit(1)).alias("_all"))
    counts = labels.select(F.explode(column).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(whole)).select("label", "n", (F.col("n") / F.col("_all")).alias("share"))


def rank_agreement(scores: DataFrame) -> DataFrame:
    """a, b, same_order, same_first for each pair of judges of (judge, name, score): names by falling score, then by name."""
    order = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "name")))
    ranks = scores.groupBy("judge").agg(F.transform(order, lambda r: r["name"]).alias("r"))
    pairs = ranks.alias("x").join(ranks.alias("y"), F.col("x.judge") < F.col("y.judge"))  # judges are few
    return pairs.select(F.col("x.judge").alias("a"), F.col("y.judge").alias("b"), (F.col("x.r") == F.col("y.r")).alias("same_order"), (F.get("x.r", 0) == F.get("y.r", 0)).alias("same_first"))


def retention(scores: DataFrame, base: str) -> DataFrame:
    """grp, arm, n, mean, mean_diff, kept of (grp, arm, unit, score): each arm against the base arm over the units that both have."""
    own = scores.filter(F.col("arm") == base).select("grp", "unit", F.col("score").alias("from"))
    met = scores.filter(F.col("arm") != base).join(own, ["grp", "unit"])
    means = met.groupBy("grp", "arm").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"), F.avg(F.col("score") - F.col("from")).alias("mean_diff"), F.avg("from").alias("base"))
    return means.select("grp", "arm", "n", "mean", "mean_diff", F.try_divide("mean", "base").alias("kept"))

