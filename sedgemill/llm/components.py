"""Consolidating pairwise matches into groups.

Method: seed-tree pruning. In every round each vertex takes the minimum of its neighbourhood and tells it to all neighbours; a
vertex that is nobody's minimum leaves the graph and hangs below the least candidate it heard of; the remaining candidates of
a vertex are linked to that least one. When no edge is left, the ids of the seeds flow down the forest, last round first.

Vertices are numbered in code point order once, so that all rounds move pairs of 64-bit numbers only. Every round is cut by one
table in the shared folder, of the links that stay and the vertices that leave. Hubs are handled by ``lookup`` (their one row is broadcast), minima by
partial aggregation; a round with fewer links than HEAVY_LEAST has no hub and asks for none, which changes the plan and not the rows.

Defined results: pairs with a null or blank end are ignored; repeated and reversed pairs change nothing; a node matched only
with itself is its own group; no pairs give no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgemill.session import HEAVY_LEAST, cut, heavy_keys, lookup, node_key, release, trimmed


def match_pairs(edges: DataFrame, kind: str = "same_symbol_as") -> DataFrame:
    """src and dst of the edges of one type (upper or lower case, blanks around it ignored), as keys."""
    of_kind = edges.filter(F.lower(trimmed(F.col("type"))) == kind)
    return of_kind.select(node_key(F.col("src")).alias("src"), node_key(F.col("dst")).alias("dst")).filter("src <> '' and dst <> ''")


def _both_ways(a: Column, b: Column) -> Column:
    return F.explode(F.array(F.struct(a.alias("a"), b.alias("b")), F.struct(b.alias("a"), a.alias("b"))))


def _links(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Both directions of each pair of different ends, once."""
    return pairs.filter(F.col(a) != F.col(b)).select(_both_ways(F.col(a), F.col(b)).alias("e")).select("e.a", "e.b").distinct()


def seed_forest(links: DataFrame) -> list[tuple[DataFrame, int]]:
    """For each round the vertices that left in it: child, parent (parent < child, and parent leaves later or is a seed), and a bound of their number."""
    forest = []
    while n := links.count():
        least = links.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("c"))
        told = lookup(links, least, "a", heavy_keys(links, "a", total=n)).select(F.col("b").alias("v"), "c")
        heard = told.unionByName(least.select(F.col("a").alias("v"), "c")).distinct()
        large = n >= HEAVY_LEAST
        if large:  # it is counted by its hubs first; a small one is read twice from one shuffle
            heard = cut(heard, "heard")
        best = heard.groupBy("v").agg(F.min("c").alias("best"), F.max(F.col("c") == F.col("v")).alias("stays"))
        linked = lookup(heard, best.select("v", "best"), "v", heavy_keys(heard, "v", total=2 * n if large else n))
        leaving = best.filter(~F.col("stays")).select(F.lit(False).alias("link"), F.col("v").alias("a"), F.col("best").alias("b"))
        step = cut(_links(linked, "c", "best").select(F.lit(True).alias("link"), "a", "b").unionByName(leaving), "round")
        forest.append((step.filter("not link").select(F.col("a").alias("child"), F.col("b").alias("parent")), n))
        if large:
            release(heard)
        links = step.filter("link").select("a", "b")
    return forest


def flow_down(forest: list[tuple[DataFrame, int]]) -> DataFrame | None:
    """child, seed for every vertex that left, from the seeds' side down; each round writes its own vertices once."""
    known = None
    for tree, n in reversed(forest):
        if known is None:
            known = tree.select("child", F.col("parent").alias("seed"))
            continue
        above = lookup(tree, known.select(F.col("child").alias("parent"), "seed"), "parent", heavy_keys(tree, "parent", total=n))
        known = known.unionByName(cut(above.select("child", F.coalesce("seed", "parent").alias("seed")), "known"))
    return known


def groups(pairs: DataFrame) -> DataFrame:
    """node, group_id for every node in ``src`` or ``dst``; group_id is the smallest node of the group in code point order."""
    pairs = cut(pairs.select("src", "dst").distinct(), "pairs")
    n = pairs.count()
    every = pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    nodes = cut(every.sort("node").select("node", F.monotonically_increasing_id().alias("id")), "nodes")
    a = lookup(pairs, nodes.select(F.col("node").alias("src"), F.col("id").alias("x")), "src", heavy_keys(pairs, "src", total=n))
    b = lookup(a, nodes.select(F.col("node").alias("dst"), F.col("id").alias("y")), "dst", heavy_keys(pairs, "dst", total=n))
    known = flow_down(seed_forest(cut(_links(b, "x", "y"), "links")))
    if known is None:
        return nodes.select("node", F.col("node").alias("group_id"))
    grouped = nodes.join(known.withColumnRenamed("child", "id"), "id", "left").select("node", F.coalesce("seed", "id").alias("seed"))
    seeds = nodes.select(F.col("id").alias("seed"), F.col("node").alias("group_id"))
    return lookup(grouped, seeds, "seed", heavy_keys(known, "seed", total=2 * n)).select("node", "group_id")
