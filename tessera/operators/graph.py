"""Graph operators: loading policies, degrees, statistics, expansion, export, canonical edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.schema import DIRECTIONAL, MUTUAL, NODE_TYPES, RELATIONS, jump_rows


def active(nodes: DataFrame) -> DataFrame:
    return nodes.filter(~F.coalesce("deprecated", F.lit(False)) & ~F.coalesce("forgotten", F.lit(False)))


def parse_type(raw: Column, domain: list[str]) -> Column:
    """An enum value or name in any case; null if it is in no domain."""
    low = F.lower(F.trim(F.element_at(F.split(raw, r"\."), -1)))
    return F.when(low.isin(domain), low)


def load_nodes(rows: DataFrame, policy: str = "skip") -> DataFrame:
    """Nodes of (id, content, type, ...) rows. Unknown types: `skip` the row, `fallback` to thing, or `reject` with a reason.

    Later rows of an id replace earlier ones (column ord) but keep the first one's place.
    """
    kind = parse_type(F.col("type"), NODE_TYPES)
    typed = rows.withColumn("node_type", F.coalesce(kind, F.lit("thing")) if policy == "fallback" else kind)
    if policy == "reject":
        typed = typed.withColumn("reject_reason", F.when(kind.isNull(), F.concat(F.lit("unknown node type: "), F.coalesce("type", F.lit("null")))))
    else:
        typed = typed.filter("node_type IS NOT NULL")
    fields = F.struct("ord", *[c for c in typed.columns if c not in ("id", "ord")])
    last = typed.groupBy(F.col("id").alias("node_id")).agg(F.max_by(fields, "ord").alias("r"), F.min("ord").alias("ord"))
    return last.select("node_id", "ord", *[f"r.{c}" for c in typed.columns if c not in ("id", "ord", "type")])


def load_edges(rows: DataFrame, policy: str = "last_wins") -> DataFrame:
    """One edge per ordered pair from (src, dst, rel_type, bidirectional, ord) rows; unknown relations are skipped.

    A bidirectional row is two edges. last_wins takes the last row of a pair, first_wins the first; reject keeps the first and
    returns the others with a reason as well.
    """
    known = rows.withColumn("rel_type", parse_type(F.col("rel_type"), RELATIONS)).filter("rel_type IS NOT NULL")
    ends = F.when(F.coalesce("bidirectional", F.lit(False)), F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).otherwise(F.array(F.struct("src", "dst")))
    both = known.select(F.posexplode(ends).alias("turn", "e"), "rel_type", "ord").select("e.src", "e.dst", "rel_type", (F.col("ord") * 2 + F.col("turn")).alias("ord"))
    if policy in ("last_wins", "first_wins"):
        pick = F.max_by if policy == "last_wins" else F.min_by
        return both.groupBy("src", "dst").agg(pick("rel_type", "ord").alias("rel_type"), F.min("ord").alias("ord"))
    place = F.row_number().over(Window.partitionBy("src", "dst").orderBy("ord"))
    return both.withColumn("reject_reason", F.when(place > 1, F.lit("pair exists")))


def union_graphs(graphs: list[DataFrame], keys: list[str]) -> DataFrame:
    """First-wins union of node or edge tables, in the order given; the later rows of a key are left out."""
    tagged = [g.withColumn("_at", F.lit(k)) for k, g in enumerate(graphs)]
    whole = tagged[0]
    for g in tagged[1:]:
        whole = whole.unionByName(g)
    rest = [c for c in whole.columns if c not in (*keys, "_at")]
    return whole.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("_at", "ord")).alias("r")).select(*keys, "r.*")


def adjacency(edges: DataFrame) -> DataFrame:
    """node_id, nbr, rel_type, is_reverse, edge_ord: both directions of every edge."""
    out = edges.select(F.col("src").alias("node_id"), F.col("dst").alias("nbr"), "rel_type", F.lit(False).alias("is_reverse"), F.col("dst_ord").alias("edge_ord"))
    back = edges.select(F.col("dst").alias("node_id"), F.col("src").alias("nbr"), "rel_type", F.lit(True).alias("is_reverse"), F.col("src_ord").alias("edge_ord"))
    return out.union(back)


def jump_weight(node_type: Column, rel_type: Column, is_reverse: Column, rows: list[tuple] | None = None) -> Column:
    """The weight of a step as a literal map of 96 entries: no join; unknown types or relations weigh 0."""
    pairs = [x for t, r, rev, w in rows or jump_rows() for x in (F.lit(f"{t}|{r}|{int(rev)}"), F.lit(w))]
    key = F.concat_ws("|", node_type, rel_type, is_reverse.cast("int").cast("string"))
    return F.coalesce(F.create_map(*pairs)[key], F.lit(0.0))


def weighted_adjacency(edges: DataFrame, nodes: DataFrame, rows: list[tuple] | None = None) -> DataFrame:
    """Adjacency with the weight that the source's type gives, without directions of weight 0."""
    typed = adjacency(edges).join(nodes.select("node_id", "node_type"), "node_id")
    return typed.withColumn("weight", jump_weight(F.col("node_type"), F.col("rel_type"), F.col("is_reverse"), rows)).filter("weight > 0").drop("node_type")


def expand(frontier: DataFrame, steps: DataFrame) -> DataFrame:
    """One hop for all queries: query_id, node_id, weight, parent, rel_type, is_reverse.

    frontier has query_id, node_id, pos; steps is weighted_adjacency. Per neighbour outside the frontier the strictly largest
    weight stays; ties go to the earlier frontier place, then forward edges, then edge order.
    """
    met = frontier.join(steps, "node_id")
    first = F.struct((-F.col("weight")).alias("w"), "pos", "is_reverse", "edge_ord", F.col("node_id").alias("parent"), "rel_type")
    best = met.groupBy("query_id", F.col("nbr").alias("node_id")).agg(F.min(first).alias("b"))
    return best.join(frontier.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti").select(
        "query_id", "node_id", (-F.col("b.w")).alias("weight"), "b.parent", "b.rel_type", "b.is_reverse"
    )


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id, in_degree, out_degree for every node, by one sum over both ends of the edges."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("n"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("n"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    sums = ends.groupBy(F.col("e.n").alias("node_id")).agg(F.sum("e.i").alias("i"), F.sum("e.o").alias("o"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return nodes.select("node_id").join(sums, "node_id", "left").select("node_id", zero("i").alias("in_degree"), zero("o").alias("out_degree"))


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: totals, states, orphans among all and among active nodes, density."""
    flags = nodes.join(degrees(nodes, edges).withColumn("d", F.col("in_degree") + F.col("out_degree")), "node_id")
    live = ~F.col("deprecated") & ~F.col("forgotten")
    counted = flags.agg(
        F.count(F.lit(1)).alias("total_nodes"),
        F.count_if("deprecated").alias("deprecated"),
        F.count_if("forgotten").alias("forgotten"),
        F.count_if(live).alias("active"),
        F.count_if(F.col("d") == 0).alias("orphans"),
        F.count_if((F.col("d") == 0) & live).alias("active_orphans"),
        F.sum("out_degree").alias("total_edges"),
    )
    n = F.col("total_nodes").cast("double")
    return counted.withColumn("density", F.round(F.coalesce(F.col("total_edges") / F.when(n > 1, n * (n - 1)), F.lit(0.0)), 6))


def canonical_edges(edges: DataFrame) -> DataFrame:
    """For writing: reciprocal edges of one relation become one row, that seen first, flagged bidirectional."""
    pair = edges.withColumn("a", F.least("src", "dst")).withColumn("b", F.greatest("src", "dst"))
    grouped = pair.groupBy("a", "b", "rel_type").agg(F.min_by(F.struct("src", "dst"), F.struct("src_ord", "dst_ord")).alias("f"), (F.count_distinct("src") > 1).alias("bidirectional"))
    return grouped.select("f.src", "f.dst", "rel_type", "bidirectional")


def export_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Panel rows: label of 50 characters, degrees, radius by type and degree."""
    radius = F.create_map(*[x for t, r in zip(NODE_TYPES, (6, 6, 5, 5, 7, 6), strict=True) for x in (F.lit(t), F.lit(r))])
    label = F.when(F.length("content") > 50, F.concat(F.left("content", F.lit(50)), F.lit("…"))).otherwise(F.coalesce("content", F.lit("")))
    return nodes.join(degrees(nodes, edges), "node_id").select("node_id", "node_type", label.alias("label"), "in_degree", "out_degree", radius[F.col("node_type")].alias("radius"), "deprecated", "forgotten")


def inspect(nodes: DataFrame, edges: DataFrame, node_ids: DataFrame, neighbours: int = 80, text: int = 400) -> DataFrame:
    """1-hop inspection of the given nodes: neighbours out first, in order, capped by the caller's limits, text cut."""
    place = F.row_number().over(Window.partitionBy("node_id").orderBy("is_reverse", "edge_ord"))
    near = adjacency(edges).join(node_ids.select("node_id"), "node_id", "left_semi").withColumn("place", place).filter(F.col("place") <= neighbours)
    content = nodes.select(F.col("node_id").alias("nbr"), "content")
    return near.join(content, "nbr", "left").select("node_id", "place", "nbr", "rel_type", "is_reverse", F.left("content", F.lit(text)).alias("content"), (F.length("content") > text).alias("truncated"))


def mermaid(nodes: DataFrame, edges: DataFrame, top: int = 50) -> DataFrame:
    """Lines of a diagram of the nodes of highest degree and the edges between them."""
    ranked = degrees(nodes, edges).withColumn("d", F.col("in_degree") + F.col("out_degree")).join(nodes.select("node_id", "ord", "node_type"), "node_id").orderBy(F.desc("d"), "ord").limit(top)
    kept = ranked.select("node_id", "node_type", "ord")
    inside = canonical_edges(edges).join(kept.select(F.col("node_id").alias("src")), "src", "left_semi").join(kept.select(F.col("node_id").alias("dst")), "dst", "left_semi")
    arrow = F.when(F.col("bidirectional"), F.lit(" <--> ")).otherwise(F.lit(" --> "))
    return kept.select(F.concat(F.lit("  "), "node_id", F.lit("["), "node_type", F.lit("]")).alias("line")).union(inside.select(F.concat(F.lit("  "), "src", arrow, F.lit("|"), "rel_type", F.lit("| "), "dst")))


def khop(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """query_id, node_id, depth: undirected neighbourhood, the start included, nearest depth first."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    seen = starts.select("query_id", "node_id", F.lit(0).alias("depth"))
    edge = seen
    for k in range(1, hops + 1):
        step = edge.join(both, edge["node_id"] == both["src"]).select("query_id", F.col("dst").alias("node_id")).distinct()
        edge = step.join(seen, ["query_id", "node_id"], "left_anti").withColumn("depth", F.lit(k))
        seen = seen.union(edge)
    return seen


def layer_filter(nodes: DataFrame, edges: DataFrame, types: list[str], relations: list[str], hide_inactive: bool = True, dense: bool = False) -> tuple[DataFrame, DataFrame]:
    """Visible nodes and links: a type mask, states hidden, degree at least the median; links need both ends and relation."""
    shown = nodes.filter(F.col("node_type").isin(types))
    shown = active(shown) if hide_inactive else shown
    if dense:
        d = degrees(nodes, edges).withColumn("d", F.col("in_degree") + F.col("out_degree"))
        median = d.agg(F.percentile("d", 0.5).alias("m"))
        shown = shown.join(d.select("node_id", "d"), "node_id").join(F.broadcast(median), F.col("d") >= F.col("m"), "left_semi").drop("d")
    ids = shown.select("node_id")
    links = edges.filter(F.col("rel_type").isin(relations)).join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    return shown, links


def with_reverse(edges: DataFrame) -> DataFrame:
    """Edges with the reverse of each mutual relation, unless that pair is there already."""
    back = edges.filter(F.col("rel_type").isin(MUTUAL)).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "rel_type")
    return edges.select("src", "dst", "rel_type").union(back.join(edges.select("src", "dst"), ["src", "dst"], "left_anti"))


def augment(path_nodes: DataFrame, covered: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges inside each group that join nodes not yet joined either way: directional first, then ids, within the budget.

    path_nodes: group_id, node_id. covered: group_id, src, dst. The budget is min(clamp(2n, 60, 300), 2n - covered).
    """
    inside = edges.join(path_nodes.select("group_id", F.col("node_id").alias("src")), "src").join(path_nodes.select("group_id", F.col("node_id").alias("dst")), ["group_id", "dst"])
    pair = lambda df: df.withColumn("a", F.least("src", "dst")).withColumn("b", F.greatest("src", "dst"))
    open_ = pair(inside).join(pair(covered).select("group_id", "a", "b"), ["group_id", "a", "b"], "left_anti")
    order = [(~F.col("rel_type").isin(DIRECTIONAL)).cast("int"), F.col("src"), F.col("dst")]
    once = open_.withColumn("turn", F.row_number().over(Window.partitionBy("group_id", "a", "b").orderBy(*order))).filter("turn = 1")
    sizes = path_nodes.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).join(covered.groupBy("group_id").agg(F.count(F.lit(1)).alias("c")), "group_id", "left")
    budget = F.least(F.greatest(F.lit(60), F.least(F.lit(300), 2 * F.col("n"))), 2 * F.col("n") - F.coalesce("c", F.lit(0)))
    place = F.row_number().over(Window.partitionBy("group_id").orderBy(*order))
    return once.withColumn("place", place).join(sizes.withColumn("budget", budget), "group_id").filter(F.col("place") <= F.col("budget")).select("group_id", "src", "dst", "rel_type", "place")
