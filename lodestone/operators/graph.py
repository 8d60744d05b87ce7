"""Graphs: edges, neighbourhoods, closures, roots, trees and DAGs.

Closures run as frontier loops: each round is one join of the frontier with the
edges and one anti-join with what is known, written to shared storage, and only
whether rows are left comes back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from lodestone.session import materialise

#: Rows of a frontier that are broadcast to meet the edges, at most.
SMALL = 100_000


def assemble(*kinds: DataFrame) -> DataFrame:
    """Edges (src, dst, type, origin, anchor) of several kinds as one set; anchors of equal edges become one sorted array."""
    rows = kinds[0]
    for k in kinds[1:]:
        rows = rows.unionByName(k)
    return rows.groupBy("src", "dst", "type", "origin").agg(F.sort_array(F.collect_set("anchor")).alias("anchors"))


def degrees(edges: DataFrame) -> DataFrame:
    """node, n_out, n_in: distinct neighbours either way."""
    pairs = edges.select("src", "dst").distinct()
    out = pairs.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n_out"))
    into = pairs.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n_in"))
    return out.join(into, "node", "full").select("node", F.coalesce("n_out", F.lit(0)).alias("n_out"), F.coalesce("n_in", F.lit(0)).alias("n_in"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")


def reach(edges: DataFrame, seeds: DataFrame, depth: int, undirected: bool = False, keep_root: bool = False) -> DataFrame:
    """node, depth: least distance from the seeds (column node), at most `depth` rounds.

    With keep_root the seeds' column root is carried, so that many closures run at once.
    Repeated edges do no harm; a small frontier is broadcast, so that edges needn't be sorted for it.
    """
    links = edges.select("src", "dst")
    if undirected:
        links = links.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    links = materialise(links, "links")
    by = ["root", "node"] if keep_root else ["node"]
    known = front = materialise(seeds.select(*by, F.lit(0).alias("depth")).distinct(), "reach")
    for step in range(1, depth + 1):
        near = F.broadcast(front) if front.limit(SMALL + 1).count() <= SMALL else front
        ahead = near.join(links, near["node"] == links["src"]).select(*by[:-1], F.col("dst").alias("node"), F.lit(step).alias("depth")).distinct()
        front = materialise(ahead.join(known.select(*by), by, "left_anti"), "reach")
        if front.isEmpty():
            break
        known = known.unionByName(front)
    return known


def roots(pointers: DataFrame) -> DataFrame:
    """node, root: the end of each node's chain of pointers (node -> target, null at an end); null on a cycle.

    Targets that are no nodes of their own are ends. Pointers double their reach
    each round, so as many rounds as the node count has bits follow any chain;
    what has not come to an end by then runs into a cycle.
    """
    known = materialise(pointers.select("node", F.coalesce("target", "node").alias("at")), "roots")
    for _ in range(known.count().bit_length()):
        hop = known.select(F.col("node").alias("at"), F.col("at").alias("next"))
        after = materialise(known.join(hop, "at", "left").select("node", F.coalesce("next", "at").alias("at")), "roots")
        still = after.join(known.withColumnRenamed("at", "was"), "node").where("at <> was").isEmpty()
        known = after
        if still:
            break
    ends = pointers.where("target is null or target = node").select("node")
    outside = pointers.where("target is not null").select(F.col("target").alias("node")).distinct().join(pointers.select("node"), "node", "left_anti")
    good = ends.unionByName(outside).distinct().select(F.col("node").alias("at"), F.lit(True).alias("good"))
    return known.join(good, "at", "left").select("node", F.when(F.col("good"), F.col("at")).alias("root"))


def leaves(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """root, node: what each seed's chain of edges ends in (nodes reached by at most `depth` edges that have none of their own).

    A round holds only what still moves on; what has ended is set aside and not looked at again.
    """
    links = materialise(edges.select(F.col("src").alias("node"), F.col("dst"), F.lit(True).alias("on")), "links")
    front, ends = seeds.select("root", "node").distinct(), []
    for _ in range(depth):
        moved = materialise(front.join(links, "node", "left"), "moved")
        ends.append(moved.where("on is null").select("root", "node"))
        front = moved.where("on").select("root", F.col("dst").alias("node")).distinct()
        if front.isEmpty():
            break
    ends.append(front.join(links.select("node"), "node", "left_anti"))
    return reduce(DataFrame.unionByName, ends).distinct()


def ready(steps: DataFrame, done: DataFrame) -> DataFrame:
    """Steps (step, depends_on array) that are not done and whose dependencies all are."""
    finished = done.select("step").distinct()
    unmet = steps.select("step", F.explode("depends_on").alias("need")).join(finished.withColumnRenamed("step", "need"), "need", "left_anti").select("step").distinct()
    return steps.join(unmet, "step", "left_anti").join(finished, "step", "left_anti")


def dag_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, level: rounds of peeling nodes without unpeeled predecessors; nodes on or behind a cycle get null.

    Each round takes the edges of the nodes peeled last, so as many rounds run as
    the graph is deep, over shrinking rest. Edges from what is no node count for nothing.
    """
    links = edges.select("src", "dst").distinct().join(nodes.select(F.col("node").alias("src")).distinct(), "src", "left_semi")
    links = materialise(links, "links")
    into = links.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("open"))
    rest = materialise(nodes.select("node").distinct().join(into, "node", "left").select("node", F.coalesce("open", F.lit(0)).alias("open")), "dag")
    layers, level = [], 0
    while not rest.where("open = 0").isEmpty():
        free = rest.where("open = 0").select("node")
        layers.append(free.select("node", F.lit(level).alias("level")))
        met = links.join(free.withColumnRenamed("node", "src"), "src", "left_semi").groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("met"))
        rest = materialise(rest.where("open > 0").join(met, "node", "left").select("node", (F.col("open") - F.coalesce("met", F.lit(0))).alias("open")), "dag")
        level += 1
        if len(layers) == 40:  # a plan of few branches
            layers = [materialise(reduce(DataFrame.unionByName, layers), "levels")]
    return reduce(DataFrame.unionByName, layers, rest.select("node", F.lit(None).cast("int").alias("level")))


def minimal_ranges(ranges: DataFrame, anchors: DataFrame) -> DataFrame:
    """Per anchor (doc, at) the smallest range (doc, section, start, end; ends inclusive) that holds it."""
    held = anchors.join(ranges, "doc").where((F.col("start") <= F.col("at")) & (F.col("at") <= F.col("end")))
    order = Window.partitionBy("doc", "at").orderBy(F.col("end") - F.col("start"), "start", "section")
    return held.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def outermost(ranges: DataFrame) -> DataFrame:
    """Ranges of a doc that no earlier-starting or longer range holds."""
    order = Window.partitionBy("doc").orderBy("start", F.col("end").desc(), "section").rowsBetween(Window.unboundedPreceding, -1)
    return ranges.withColumn("cover", F.max("end").over(order)).where("cover is null or end > cover").drop("cover")


def stamps(nodes: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """node, stamp: hash of a node's own attributes and its children's stamps, bottom up, in `depth` rounds.

    nodes: node, own (text). edges: src (parent), dst (child).
    """
    now = nodes.select("node", F.sha2("own", 256).alias("stamp"))
    for _ in range(depth):
        below = edges.join(now, F.col("dst") == F.col("node")).groupBy("src").agg(F.array_join(F.sort_array(F.collect_list("stamp")), "").alias("below"))
        now = materialise(nodes.join(below, F.col("node") == F.col("src"), "left").select("node", F.sha2(F.concat("own", F.coalesce("below", F.lit(""))), 256).alias("stamp")), "stamps")
    return now


def same_root(pairs: DataFrame, root: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Pairs without those that already share a canonical root."""
    left = root.select(F.col("node").alias(a), F.col("root").alias("root_a"))
    right = root.select(F.col("node").alias(b), F.col("root").alias("root_b"))
    return pairs.join(left, a, "left").join(right, b, "left").where(~F.coalesce(F.col("root_a") == F.col("root_b"), F.lit(False))).drop("root_a", "root_b")


def edge_role(type_: Column) -> Column:
    """How a typed edge is read: a need, an exception, a citation, or a relation."""
    return F.when(type_.isin("REQUIRES", "DEPENDS_ON"), "need").when(type_ == "EXCEPTION_OF", "exception").when(type_ == "CITES", "citation").otherwise("relation")


def role_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """role, n_nodes, n_edges: nodes per role, and edges with both ends among the nodes, by the role of their source."""
    inner = induced(edges, nodes).join(nodes.select(F.col("node").alias("src"), "role"), "src").groupBy("role").agg(F.count("*").alias("n_edges"))
    counts = nodes.groupBy("role").agg(F.count("*").alias("n_nodes"))
    return counts.join(inner, "role", "left").select("role", "n_nodes", F.coalesce("n_edges", F.lit(0)).alias("n_edges"))
