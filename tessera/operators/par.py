"""Purpose-driven associative retrieval: seeds, weighted hops, purpose filter, peak stop, band, paths; all queries at once."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.vectors import cosine
from tessera.operators.graph import expand, weighted_adjacency
from tessera.operators.paths import counters, multiplier, path_key
from tessera.operators.vectors import knn
from tessera.schema import FRAME_CUES, FRAME_RELATIONS, FRAME_TYPES, RELATION_FLOOR, TYPE_FLOOR
from tessera.session import materialize


@dataclass(frozen=True)
class Params:
    """Defaults of the retrieval; k_sigma switches to the relative threshold mu + k * sigma.

    blind closes the purpose channel: purpose scores are 0, nothing is filtered, and jump weights alone rank and steer.
    anchor is the part of the query's own cosine in a frame's topic score. seed_floor is a cosine that the seeds of both
    channels need, but not those that top them up. first_peak stops at the first marked fall. A frame that has no
    preferences (neutral, or a name that is not known) leaves the types alone.
    """

    seed_k: int = 5
    max_hops: int = 5
    expand_k: int | None = None
    decay: float = 0.85
    jump_coef: float = 0.5
    purpose_coef: float = 0.5
    threshold: float = 0.30
    threshold_decay: float = 0.0
    k_sigma: float | None = None
    patience: int = 2
    min_delta: float = 0.015
    tolerance: float = 0.10
    tolerance_ratio: float = 0.0
    max_nodes: int | None = None
    blind: bool = False
    frame: str | None = None
    frame_weights: tuple[float, float, float] = (0.55, 0.35, 0.10)
    anchor: float = 0.0
    seed_floor: float | None = None
    first_peak: bool = False


def type_affinity(frame: str, node_type: Column) -> Column:
    """floor + (1 - floor) * preference / largest; a frame without preferences gives 1."""
    prefs = FRAME_TYPES.get(frame)
    if not prefs:
        return F.lit(1.0)
    table = F.create_map(*[x for t, p in prefs.items() for x in (F.lit(t), F.lit(p / max(prefs.values())))])
    return TYPE_FLOOR + (1 - TYPE_FLOOR) * F.coalesce(table[node_type], F.lit(0.0))


def relation_affinity(frame: str, rel_type: Column) -> Column:
    """As type_affinity; without preferences the neutral 0.5."""
    prefs = FRAME_RELATIONS.get(frame)
    if not prefs:
        return F.lit(0.5)
    table = F.create_map(*[x for t, p in prefs.items() for x in (F.lit(t), F.lit(p / max(prefs.values())))])
    return RELATION_FLOOR + (1 - RELATION_FLOOR) * F.coalesce(table[rel_type], F.lit(0.0))


def compile_frame(purposes: Column) -> Column:
    """The frame that an array of purpose texts asks for: that whose cue words occur most often, the first declared on ties;
    `neutral` where none occurs."""
    some = "[" + "".join(sorted({w[0] for cues in FRAME_CUES.values() for w in cues.split("|")})) + "]"
    # A lambda's argument is computed once, however often its body names it; texts without a cue's first character have no cue.
    text = F.array_join(F.filter(F.coalesce(purposes, F.array().cast("array<string>")), lambda p: p.rlike(some)), " ")
    hits = lambda t: [F.struct(F.regexp_count(t, F.lit(cues)).alias("n"), F.lit(-k).alias("order"), F.lit(name).alias("name")) for k, (name, cues) in enumerate(FRAME_CUES.items())]
    best = F.transform(F.array(text), lambda t: F.greatest(*hits(t)))
    return F.get(F.transform(best, lambda b: F.when(b["n"] > 0, b["name"]).otherwise(F.lit("neutral"))), 0)


def frame_named(name: Column) -> Column:
    """A preset's name in any case; `neutral` for any other."""
    low = F.lower(name)
    return F.when(low.isin(*FRAME_CUES), low).otherwise(F.lit("neutral"))


def frame_score(topic: Column, frame: str, node_type: Column, rel_type: Column | None, weights: tuple[float, float, float] = (0.55, 0.35, 0.10)) -> Column:
    """Topic times the weighted mean of 1, type and relation affinity; seeds have no relation."""
    e, t, r = weights
    if rel_type is None:
        return topic * (e + t * type_affinity(frame, node_type)) / (e + t)
    return topic * (e + t * type_affinity(frame, node_type) + r * relation_affinity(frame, rel_type)) / (e + t + r)


def seeds(queries: DataFrame, nodes: DataFrame, vectors: DataFrame, p: Params) -> DataFrame:
    """query_id, node_id, pos: half of seed_k by the text vector, then by the purpose vector, then topped up by text, unfloored.

    queries: query_id, text_vec, purpose_vec. Inactive nodes are skipped after the cut of each channel; the first of a
    channel order counts.
    """
    live = nodes.filter(~F.col("deprecated") & ~F.col("forgotten")).select(F.col("node_id").alias("id"))
    text = queries.select("query_id", F.col("text_vec").alias("embedding"))
    top = knn(text, vectors, p.seed_k if p.blind else 2 * p.seed_k)
    high = lambda df: df if p.seed_floor is None else df.filter(F.round("score", 9) >= p.seed_floor)
    channels = (high(top) if p.blind else top).select("query_id", "id", F.lit(2).alias("channel"), "place")
    if not p.blind:
        half = max(1, p.seed_k // 2)
        slots = max(1, p.seed_k - half)
        purpose = knn(queries.select("query_id", F.col("purpose_vec").alias("embedding")), vectors, slots if p.frame is None else 4 * slots)
        purpose = high(purpose)
        if p.frame is not None:  # a wider pool, ranked by the frame
            kinds = nodes.select(F.col("node_id").alias("id"), "node_type")
            pool, topic = purpose.join(kinds, "id"), F.round("score", 9)
            if p.anchor:
                pool = pool.join(vectors.select("id", "embedding"), "id").join(queries.select("query_id", "text_vec"), "query_id")
                topic = F.round((1 - p.anchor) * topic + p.anchor * F.round(cosine(F.col("embedding"), F.col("text_vec")), 9), 9)
            ranked = pool.withColumn("gated", F.round(frame_score(topic, p.frame, F.col("node_type"), None, p.frame_weights), 9))
            ranked = ranked.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("gated"), "ord")))
            purpose = ranked.filter(F.col("place") <= slots)
        channels = channels.union(high(top.filter(F.col("place") <= half)).select("query_id", "id", F.lit(0), "place")).union(purpose.select("query_id", "id", F.lit(1), "place"))
    first = channels.join(live, "id", "left_semi").groupBy("query_id", "id").agg(F.min(F.struct("channel", "place")).alias("at"))
    pos = F.row_number().over(Window.partitionBy("query_id").orderBy("at"))
    return first.withColumn("pos", pos).filter(F.col("pos") <= p.seed_k).select("query_id", F.col("id").alias("node_id"), "pos")


def peak_columns(mu: Column, p: Params) -> dict[str, Column]:
    """peak, prev, declining, count, found of a query after a hop with the mean mu, from the columns of these names before it.

    The peak moves to any mean at or above it. A rise above min_delta clears the decline; the first fall below -min_delta marks
    it without counting; each later mean that doesn't rise counts, and `patience` of them stop the query. With first_peak the
    first such fall stops it. A hop without a mean changes nothing.
    """
    delta, new = mu - F.col("prev"), mu.isNull() | F.col("prev").isNull()
    rise, fall = delta > p.min_delta, delta < -p.min_delta
    declining = F.when(new, F.col("declining")).when(rise, False).when(F.col("declining") | fall, True).otherwise(False)
    count = F.when(new, F.col("count")).when(rise, 0).when(F.col("declining"), F.col("count") + 1).otherwise(F.col("count"))
    return {
        "peak": F.when(mu.isNotNull(), F.greatest("peak", mu)).otherwise(F.col("peak")),
        "prev": F.coalesce(mu, F.col("prev")),
        "declining": declining,
        "count": count,
        "found": F.col("found") | F.coalesce(fall if p.first_peak else count >= p.patience, F.lit(False)),
    }


def threshold(hop: int, p: Params) -> Column:
    """The purpose score that a candidate of this hop must have."""
    if p.blind:
        return F.lit(0.0)
    if p.k_sigma is not None:
        w = Window.partitionBy("query_id")
        return F.avg("ps").over(w) + p.k_sigma * F.stddev_pop("ps").over(w)
    return F.lit(p.threshold * p.threshold_decay**hop if p.threshold_decay > 0 else p.threshold)


def retrieve(queries: DataFrame, nodes: DataFrame, edges: DataFrame, vectors: DataFrame, p: Params = Params(), rows: list[tuple] | None = None) -> tuple[DataFrame, DataFrame]:
    """hops (query_id, hop, node_id, parent, rel_type, is_reverse, weight, ps, combined) and means (query_id, hop, mu)."""
    hops, means, _ = retrieve_all(queries, nodes, edges, vectors, p, rows)
    return hops, means


def retrieve_tracked(queries: DataFrame, nodes: DataFrame, edges: DataFrame, vectors: DataFrame, p: Params, log: DataFrame, session: str, rows: list[tuple] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hops, means, activations) of retrieval under a log (path_key, session_id) of what earlier queries have activated.

    Each step's weight is multiplied by what its path has gained in all sessions and lost in this one (operators.paths); paths that were
    never activated are as they were. activations has query_id, hop, path_key and session_id: every step from the frontier of a hop to a
    node that the hop reaches for the first time, also the steps that lost to a heavier one. Queries that run together do
    not see each other; append activations to the log for the next ones.
    """
    hops, means, _, steps = _retrieve(queries, nodes, edges, vectors, p, rows, counters(log, F.lit(session)))
    return hops, means, steps.withColumn("session_id", F.lit(session))


def retrieve_all(queries: DataFrame, nodes: DataFrame, edges: DataFrame, vectors: DataFrame, p: Params = Params(), rows: list[tuple] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """retrieve() with passes (query_id, hop, n_in, n_out, thr): how many candidates of each hop the purpose filter met and let pass.

    Hop 0 are the seeds. Each hop is one distributed step for all queries; what it met, scored and kept, with each query's peak state after
    it, is written once, to the shared folder. Candidates enter the visited set before inactive or low-scoring ones go. Nodes are written narrow before the first
    hop. The driver only learns whether any query has a frontier left.
    """
    return _retrieve(queries, nodes, edges, vectors, p, rows, None)[:3]


def _retrieve(queries: DataFrame, nodes: DataFrame, edges: DataFrame, vectors: DataFrame, p: Params, rows: list[tuple] | None, counts: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """hops, means and passes, and with counts (path_key, lifetime, session) the activations."""
    nodes = materialize(nodes.select("node_id", "ord", "node_type", (~F.col("deprecated") & ~F.col("forgotten")).alias("active")), "nodes")
    nodes = nodes.select("*", F.lit(False).alias("deprecated"), (~F.col("active")).alias("forgotten"))
    weighted = weighted_adjacency(edges, nodes, rows)
    if counts is not None:
        weighted = weighted.withColumn("path_key", path_key(F.col("node_id"), F.col("nbr"), F.col("rel_type"))).join(counts, "path_key", "left")
        weighted = weighted.withColumn("weight", F.col("weight") * multiplier(F.col("lifetime"), F.col("session"))).drop("lifetime", "session")
    steps = materialize(weighted, "steps")
    asked = queries.select("query_id", "purpose_vec", "text_vec")

    def scored(df: DataFrame) -> DataFrame:
        """df with the columns ps and node_type."""
        if p.blind:
            return df.withColumn("ps", F.lit(0.0))
        near = df.join(vectors.select(F.col("id").alias("node_id"), "embedding"), "node_id", "left").join(asked, "query_id")
        topic = F.round(cosine(F.col("embedding"), F.col("purpose_vec")), 9)
        if p.frame is not None:
            if p.anchor:
                topic = F.round((1 - p.anchor) * topic + p.anchor * F.round(cosine(F.col("embedding"), F.col("text_vec")), 9), 9)
            topic = F.round(frame_score(topic, p.frame, F.col("node_type"), F.col("rel_type") if "rel_type" in df.columns else None, p.frame_weights), 9)
        return near.withColumn("ps", topic).drop("embedding", "purpose_vec", "text_vec")

    live = nodes.filter("active").select("node_id", "ord", "node_type")
    start = scored(seeds(queries, nodes, vectors, p).join(live.select("node_id", "node_type"), "node_id"))
    none = lambda t: F.lit(None).cast(t)
    own = F.lit(0.0) if p.blind else F.col("ps") * p.purpose_coef
    hop0 = materialize(
        start.select("query_id", F.lit(0).alias("hop"), "node_id", none("string").alias("parent"), none("string").alias("rel_type"), none("boolean").alias("is_reverse"), none("double").alias("weight"), "ps", own.alias("combined"), "pos"),
        "hop0",
    )
    hops, means, passes = [hop0], [hop0.groupBy("query_id", "hop").agg(F.avg("ps").alias("mu"))], []
    activated: list[DataFrame] = []
    visited = hop0.select("query_id", "node_id")
    frontier = hop0.select("query_id", "node_id", "pos")
    state = queries.select("query_id", none("double").alias("peak"), none("double").alias("prev"), F.lit(False).alias("declining"), F.lit(0).alias("count"), F.lit(False).alias("found"))
    for hop in range(1, p.max_hops + 1):
        met = expand(frontier, steps).join(visited, ["query_id", "node_id"], "left_anti").join(live, "node_id", "left")
        active = F.col("ord").isNotNull()  # the others are visited from now on, and no more
        found = scored(met).withColumn("ps", F.when(active, F.col("ps"))).withColumn("thr", threshold(hop, p)).withColumn("ok", F.col("ps") >= F.col("thr"))
        combined = F.col("weight") * p.decay**hop * p.jump_coef + (F.lit(0.0) if p.blind else F.col("ps") * p.purpose_coef)
        pos = F.row_number().over(Window.partitionBy("query_id", "ok").orderBy(F.desc(F.round("combined", 9)), "ord"))
        columns = ["query_id", "node_id", "parent", "rel_type", "is_reverse", "weight", "ps", "combined", "pos", "thr", "ok"]
        every = found.withColumn("combined", combined).withColumn("pos", pos).select(*columns).join(state, "query_id")
        mean = F.avg(F.when(F.col("ok"), F.col("weight" if p.blind else "ps"))).over(Window.partitionBy("query_id"))
        peaks = peak_columns(F.col("mu"), p)
        every = every.withColumn("mu", mean).select(*columns, "mu", *[c.alias(n) for n, c in peaks.items()])
        every = materialize(every, f"hop{hop}")
        visited = visited.union(every.select("query_id", "node_id"))
        if counts is not None:
            reached = every.select("query_id", F.col("node_id").alias("nbr"))
            used = frontier.select("query_id", "node_id").join(steps, "node_id").join(reached, ["query_id", "nbr"], "left_semi")
            activated.append(used.select("query_id", F.lit(hop).alias("hop"), "path_key"))
        kept = every.filter("ok").select("query_id", F.lit(hop).alias("hop"), *columns[1:9])
        hops.append(kept)
        means.append(kept.groupBy("query_id").agg(F.avg("weight" if p.blind else "ps").alias("mu")).select("query_id", F.lit(hop).alias("hop"), "mu"))
        counted = every.filter("ok IS NOT NULL").groupBy("query_id").agg(F.count(F.lit(1)).alias("n_in"), F.count_if("ok").alias("n_out"), F.max("thr").alias("thr"))
        passes.append(counted.select("query_id", F.lit(hop).alias("hop"), "n_in", "n_out", "thr"))
        state = every.select("query_id", *peaks).distinct()  # of the queries that have a frontier left
        frontier = every.filter(F.col("ok") & ~F.col("found") & (F.col("pos") <= (p.expand_k or p.seed_k))).select("query_id", "node_id", "pos")
        if frontier.isEmpty():
            break
    together = lambda parts: reduce(DataFrame.unionByName, parts)
    return together(hops), together(means), together(passes), together(activated) if counts is not None else None


def band(hops: DataFrame, means: DataFrame, p: Params = Params()) -> DataFrame:
    """Rows of hop 0 and of hops whose mean is within the tolerance of the peak of hops 1 and later; a tolerance ratio takes
    that part of the way from the lowest to the peak mean. max_nodes caps a query by (combined, node_id)."""
    later = means.filter("hop > 0")
    peak = later.groupBy("query_id").agg(F.max("mu").alias("peak"), F.min("mu").alias("low"))
    slack = p.tolerance_ratio * (F.col("peak") - F.col("low")) if p.tolerance_ratio > 0 else F.lit(p.tolerance)
    inside = later.join(peak, "query_id").filter(F.round(F.col("mu") - F.col("peak") + slack, 9) >= 0).select("query_id", "hop").union(means.filter("hop = 0").select("query_id", "hop"))
    rows = hops.join(inside, ["query_id", "hop"], "left_semi")
    best = rows.groupBy("query_id", "node_id").agg(F.max("combined").alias("score"), F.min("hop").alias("hop"))
    if p.max_nodes:
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "node_id"))
        best = best.withColumn("place", place).filter(F.col("place") <= p.max_nodes).drop("place")
    return best


def band_stats(means: DataFrame, p: Params = Params()) -> DataFrame:
    """query_id, peak, delta (the tolerance), rounds (hops after the seeds), in_band, ratio (of rounds in the band, three places)."""
    later = means.filter("hop > 0")
    peak = later.groupBy("query_id").agg(F.max("mu").alias("peak"), F.min("mu").alias("low"), F.count(F.lit(1)).alias("rounds"))
    slack = p.tolerance_ratio * (F.col("peak") - F.col("low")) if p.tolerance_ratio > 0 else F.lit(p.tolerance)
    peak = peak.withColumn("delta", F.greatest(slack, F.lit(0.0)))
    inside = later.join(peak, "query_id").filter(F.round(F.col("mu") - F.col("peak") + F.col("delta"), 9) >= 0).groupBy("query_id").agg(F.count(F.lit(1)).alias("in_band"))
    return peak.join(inside, "query_id").select("query_id", "peak", "delta", "rounds", "in_band", F.round(F.col("in_band") / F.col("rounds"), 3).alias("ratio"))


def candidate_pool(hops: DataFrame) -> DataFrame:
    """query_id, node_id, tier, score, place: every node that a query met; seeds first, then by the best combined score."""
    best = hops.groupBy("query_id", "node_id").agg(F.min(F.when(F.col("hop") == 0, 1).otherwise(2)).alias("tier"), F.max("combined").alias("score"))
    order = Window.partitionBy("query_id").orderBy("tier", F.desc(F.round("score", 9)), "node_id")
    return best.withColumn("place", F.row_number().over(order))


def visiting_order(hops: DataFrame) -> DataFrame:
    """query_id, step, hop, node_id, parent, rel_type: the whole trace, in the order in which nodes were reached."""
    order = Window.partitionBy("query_id").orderBy("hop", "pos", "node_id")
    return hops.withColumn("step", F.row_number().over(order)).select("query_id", "step", "hop", "node_id", "parent", "rel_type")


def result(hops: DataFrame, means: DataFrame, nodes: DataFrame, p: Params = Params()) -> DataFrame:
    """query_id, node_id, hop, score, rank of the active nodes with text in the band, best first."""
    live = nodes.filter(~F.col("deprecated") & ~F.col("forgotten") & (F.coalesce(F.length("content"), F.lit(0)) > 0)).select("node_id", "ord")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "ord"))
    return band(hops, means, p).join(live, "node_id").withColumn("rank", rank).select("query_id", "node_id", "hop", "score", "rank")


def adaptive_cap(contents: DataFrame) -> DataFrame:
    """query_id, cap: 2000 characters over the mean length of the first 40 contents, within 4 and 40; 24 without any."""
    mean = contents.filter("rank <= 40").groupBy("query_id").agg(F.avg(F.length("content")).alias("m"))
    return mean.select("query_id", F.when(F.col("m") > 0, F.greatest(F.lit(4), F.least(F.lit(40), F.floor(2000 / F.col("m"))))).otherwise(24).cast("long").alias("cap"))


def core_groups(hops: DataFrame, wanted: DataFrame, max_hops: int = 5) -> DataFrame:
    """query_id, root, node_id, depth: the wanted nodes with all ancestors, grouped by the root that their parents lead to."""
    tree = hops.groupBy("query_id", "node_id").agg(F.min_by("parent", "hop").alias("parent"), F.min("hop").alias("depth"))
    at = wanted.select("query_id", "node_id", F.col("node_id").alias("now"))
    rows = at
    for _ in range(max_hops):
        up = tree.select("query_id", F.col("node_id").alias("now"), "parent").filter("parent IS NOT NULL")
        at = at.join(up, ["query_id", "now"]).select("query_id", "node_id", F.col("parent").alias("now"))
        rows = rows.union(at)
    chain = rows.join(tree.select("query_id", F.col("node_id").alias("now"), "depth"), ["query_id", "now"])
    root = chain.groupBy("query_id", "node_id").agg(F.min_by("now", "depth").alias("root"))
    return chain.join(root, ["query_id", "node_id"]).select("query_id", "root", F.col("now").alias("node_id"), "depth").distinct()


def level_order(groups: DataFrame, hops: DataFrame) -> DataFrame:
    """groups with pos: by depth, then the root's place among the seeds, then the place within the hop."""
    place = hops.groupBy("query_id", "node_id").agg(F.min_by("pos", "hop").alias("p"))
    roots = place.select("query_id", F.col("node_id").alias("root"), F.col("p").alias("root_pos"))
    order = Window.partitionBy("query_id").orderBy("depth", "root_pos", "p", "node_id")
    return groups.join(place, ["query_id", "node_id"]).join(roots, ["query_id", "root"]).withColumn("pos", F.row_number().over(order)).drop("p", "root_pos")


def tree_edges(groups: DataFrame, hops: DataFrame) -> DataFrame:
    """The edges that led to the nodes of the groups, in the direction that the graph has them."""
    first = hops.filter("parent IS NOT NULL").groupBy("query_id", "node_id").agg(F.min_by(F.struct("parent", "rel_type", "is_reverse"), "hop").alias("e"))
    inside = groups.select("query_id", "node_id").distinct().join(first, ["query_id", "node_id"])
    flip = lambda a, b: F.when(F.col("e.is_reverse"), b).otherwise(a)
    return inside.select("query_id", flip(F.col("e.parent"), F.col("node_id")).alias("src"), flip(F.col("node_id"), F.col("e.parent")).alias("dst"), F.col("e.rel_type").alias("rel_type"))
