"""Graph operators over edge tables (src, dst): closure, components, decayed expansion, statistics.

Loops cut their lineage with tables in the shared folder and stop when a round adds nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.runtime import stage

#: Steps of a propagation between two tables written: fewer writes for a plan still small.
STEPS = 3


def neighbours(edges: DataFrame, node: str, reverse: bool = False) -> DataFrame:
    a, b = ("dst", "src") if reverse else ("src", "dst")
    return edges.where(F.col(a) == node).select(F.col(b).alias("node")).distinct()


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Nodes reached from the seeds (column node) by one edge or more; a seed only if a cycle returns to it."""
    e = stage(edges.where("src is not null and dst is not null").select("src", "dst").distinct(), "edges")
    front = stage(e.join(seeds.select(F.col("node").alias("src")).distinct(), "src").select(F.col("dst").alias("node")).distinct(), "front")
    fronts = [front]
    while not front.isEmpty():
        # Every front is written once; what was seen is their union, never written again.
        step = e.join(front.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node")).distinct()
        front = stage(step.join(reduce(DataFrame.unionByName, fronts), "node", "left_anti"), "front")
        fronts.append(front)
        if len(fronts) > 32:
            fronts = [stage(reduce(DataFrame.unionByName, fronts), "seen")]
    return reduce(DataFrame.unionByName, fronts)


def within(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(node, hop): nodes within a number of hops and the fewest hops to them; seeds are at hop 0."""
    seen = seeds.select("node").distinct().withColumn("hop", F.lit(0))
    front = seen
    for h in range(1, hops + 1):
        step = edges.join(front.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        front = step.join(seen.select("node"), "node", "left_anti").withColumn("hop", F.lit(h))
        seen = seen.unionByName(front)
    return seen


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the undirected graph; a component is named by its least node.

    Alternating large-star and small-star rounds: edges are rewritten towards the least neighbour until none changes,
    which takes a number of rounds logarithmic in the longest path.
    """
    e = edges.where("src is not null and dst is not null")
    both = e.select("src", "dst").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    nodes = stage(both.select(F.col("src").alias("node")).distinct(), "nodes")
    cur = stage(both.where("src != dst").distinct(), "star")
    while True:
        two = cur.select("src", "dst").unionByName(cur.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
        least = two.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("m"))
        large = two.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        large = stage(large.where("src != dst").distinct(), "large")
        down = large.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        low = down.groupBy("src").agg(F.min("dst").alias("m"))
        small = down.join(low, "src").select(F.explode(F.array(F.struct(F.col("dst").alias("a"), F.col("m").alias("b")), F.struct(F.col("src").alias("a"), F.col("m").alias("b")))).alias("x"))
        new = stage(small.select(F.col("x.a").alias("src"), F.col("x.b").alias("dst")).where("src != dst").distinct(), "star")
        if new.join(cur, ["src", "dst"], "left_anti").isEmpty() and cur.join(new, ["src", "dst"], "left_anti").isEmpty():
            break
        cur = new
    root = cur.groupBy("src").agg(F.min("dst").alias("component")).withColumnRenamed("src", "node")
    return nodes.join(root, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def cyclic(edges: DataFrame) -> DataFrame:
    """(node, component) of strongly connected components with more than one node or a loop, named by their least node.

    Nodes without a way in or out are trimmed first; then forward-backward colouring: the least node that reaches a node
    is its colour, and the nodes of a colour that its root is reached from make a component, which is taken out.
    """
    e = stage(edges.where("src is not null and dst is not null").select("src", "dst").distinct(), "edges")
    loops = e.where("src = dst").select(F.col("src").alias("node"))
    found: DataFrame | None = None
    e = stage(e.where("src != dst"), "edges")
    while True:
        while True:
            keep = e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
            keep = stage(keep, "trim")
            n, m = e.count(), keep.count()
            e = keep
            if n == m:
                break
        if m == 0:
            break
        nodes = e.select(F.col("src").alias("node")).distinct()
        colour = stage(nodes.withColumn("c", F.col("node")), "colour")
        while True:
            new = colour
            for _ in range(STEPS):
                told = e.join(new.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("c").alias("t"))
                new = new.join(told, "node", "left").select("node", F.least("c", F.coalesce("t", "c")).alias("c"))
            new = stage(new, "colour")
            if new.join(colour, ["node", "c"], "left_anti").isEmpty():
                break
            colour = new
        same = stage(e.join(colour.select(F.col("node").alias("src"), F.col("c").alias("c")), "src").join(colour.select(F.col("node").alias("dst"), F.col("c").alias("c2")), "dst").where("c = c2").select("src", "dst", "c"), "same")
        back = stage(colour.where("node = c").select("node", "c"), "back")
        while True:
            more = back
            for _ in range(STEPS):
                step = same.join(more.select(F.col("node").alias("dst"), "c"), ["dst", "c"]).select(F.col("src").alias("node"), "c")
                more = more.unionByName(step).distinct()
            more = stage(more, "back")
            if more.count() == back.count():
                break
            back = more
        whole = back.groupBy("c").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("c")
        part = back.join(whole, "c", "left_semi").select("node", F.col("c").alias("component"))
        found = stage(part if found is None else found.unionByName(part), "found")
        gone = back.select("node")
        e = stage(e.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"), "edges")
    own = loops.withColumn("component", F.col("node"))
    return own if found is None else found.unionByName(own.join(found, "node", "left_anti"))


def expand(seeds: DataFrame, edges: DataFrame, depth: int = 2, decay: float = 0.55, k: int = 12) -> DataFrame:
    """Topic search: seeds (node, score) and, over weighted edges (src, dst, weight), s * decay^hop * max(1, weight).

    Every node keeps its greatest value over all ways of at most ``depth`` hops; the ``k`` best are given, ties by node.
    """
    best = seeds.groupBy("node").agg(F.max("score").alias("score"))
    paths = best.select("node", F.col("score").alias("s"), F.col("score").alias("v"))
    for h in range(1, depth + 1):
        paths = paths.join(edges.select(F.col("src").alias("node"), "dst", "weight"), "node").select(
            F.col("dst").alias("node"), "s", (F.col("s") * F.lit(decay**h) * F.greatest(F.lit(1.0), F.col("weight").cast("double"))).alias("v")
        )
        paths = paths.groupBy("node", "s").agg(F.max("v").alias("v"))
        best = best.unionByName(paths.select("node", F.col("v").alias("score")))
    return best.groupBy("node").agg(F.round(F.max("score"), 6).alias("score")).orderBy(F.desc("score"), "node").limit(k)


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree) over both ends."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def valid_links(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links once per (src, dst, type) of which both ends are nodes."""
    ids = nodes.select("node").distinct()
    return links.join(ids.withColumnRenamed("node", "src"), "src", "left_semi").join(ids.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst", "type").distinct()


def adjacency_view(edges: DataFrame, node: str, k: int = 10) -> DataFrame:
    """The first ``k`` neighbours of a node with the number there are."""
    n = neighbours(edges, node)
    return n.orderBy("node").limit(k).join(F.broadcast(n.agg(F.count(F.lit(1)).alias("total"))))
