"""Graph operators as iterated joins: closures, shortest hops, components, cycles. Every round is cut by a written table.

Components split hubs by ``lookup``. The searches join a frontier to the links of its nodes, which is what they give out for a hub; their
skewed partitions are split by adaptive execution. Rounds move distinct pairs only. Null ends are ignored; no edges give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgemill.session import cut, heavy_keys, lookup, node_key, trimmed


def short_name(c: Column) -> Column:
    """The last part of a node id."""
    return F.element_at(F.split(c, "[./]"), -1)


def typed_edges(edges: DataFrame) -> DataFrame:
    """edge_id, src, dst, type, confidence, repo, seen_at with trimmed keys and types in small letters; edges without an end drop out."""
    return edges.select("edge_id", trimmed(F.col("src")).alias("src"), trimmed(F.col("dst")).alias("dst"), F.lower(trimmed(F.col("type"))).alias("type"), "confidence", "repo", "seen_at").filter(
        "src <> '' and dst <> ''"
    )


def reach(seeds: DataFrame, edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """seed, node, hops: everything that ``seeds`` (seed, node) reach over ``edges`` (src, dst), breadth first, each pair once with its least hops.

    ``rounds`` is the number of hops that the question asks for; without it the search goes on until nothing new is found.
    """
    links = cut(edges.select("src", "dst").distinct(), "links")
    seen = cut(seeds.select("seed", "node", F.lit(0).alias("hops")).distinct(), "seen")
    frontier, hops = seen, 0
    while (rounds is None or hops < rounds) and not frontier.isEmpty():
        hops += 1
        step = frontier.join(links, frontier["node"] == links["src"]).select("seed", F.col("dst").alias("node")).distinct()
        fresh = step.join(seen.select("seed", "node"), ["seed", "node"], "left_anti")
        frontier = cut(fresh.withColumn("hops", F.lit(hops)), "frontier")
        seen = seen.unionByName(frontier)
    return seen


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of the undirected graph, by alternating star contractions (large star, small star)."""
    pairs = edges.select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).filter("a <> b").distinct()
    links, size = cut(pairs, "links"), -1
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: larger neighbours are linked to the least of the neighbourhood
        large = lookup(both, least, "a", heavy_keys(both, "a")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = cut(large, "large")
        # small star: a node and its smaller neighbours are linked to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = lookup(large, low, "a", heavy_keys(large, "a"))
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        new = cut(small, "links")
        n = new.count()
        if n == size and new.join(links, ["a", "b"], "left_anti").isEmpty():
            break
        links, size = new, n
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return nodes.join(links.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def cyclic_core(edges: DataFrame) -> DataFrame:
    """src, dst: what is left when nodes without a way in or out are taken away again and again: the cycles and the paths between them."""
    links, n = cut(edges.select("src", "dst").filter("src <> dst").distinct(), "core"), -1
    while True:
        left = links.count()
        if left in (n, 0):
            return links
        n = left
        inner = links.join(links.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        inner = inner.join(links.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        links = cut(inner.select("src", "dst"), "core")


def strong_components(edges: DataFrame) -> DataFrame:
    """src, dst, component: the edges that lie on cycles, with the smallest node of their strongly connected component.

    Each turn colours every node with the smallest node that reaches it; those of a colour that reach its node are its component and leave.
    """
    rest, found = cyclic_core(edges), None
    while not rest.isEmpty():
        colour = cut(rest.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("colour", F.col("node")), "colour")
        while True:
            passed = rest.join(colour.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("c"))
            new = cut(colour.join(passed, "node", "left").select("node", F.least("colour", "c").alias("colour"), (F.col("c") < F.col("colour")).alias("moved")), "colour")
            colour, moved = new.select("node", "colour"), new.filter("moved")
            if moved.isEmpty():
                break
        ends = rest.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("a")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("b")), "dst")
        inner = cut(ends.filter("a = b").select("src", "dst", F.col("a").alias("component")), "inner")
        roots = colour.filter("node = colour").select(F.col("colour").alias("seed"), "node")
        members = cut(reach(roots, inner.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).select("node"), "members")
        out = inner.join(members.withColumnRenamed("node", "src"), "src", "left_semi").join(members.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst", "component")
        found = out if found is None else found.unionByName(out)
        rest = rest.join(members.withColumnRenamed("node", "src"), "src", "left_anti").join(members.withColumnRenamed("node", "dst"), "dst", "left_anti")
        rest = cyclic_core(rest.select("src", "dst"))
    return rest.withColumn("component", F.col("src")) if found is None else found


def shortest_paths(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """seed, node, hops, path: a shortest path from every seed (seed, node) to all that it reaches; of several the first in the order of their nodes."""
    links = cut(edges.select("src", "dst").distinct(), "links")
    seen = cut(seeds.select("seed", "node").distinct().select("seed", "node", F.lit(0).alias("hops"), F.array("node").alias("path")), "paths")
    frontier, hops = seen, 0
    while not frontier.isEmpty():
        hops += 1
        step = frontier.join(links, frontier["node"] == links["src"]).select("seed", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        fresh = step.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").groupBy("seed", "node").agg(F.min("path").alias("path"))
        frontier = cut(fresh.select("seed", "node", F.lit(hops).alias("hops"), "path"), "paths")
        seen = seen.unionByName(frontier)
    return seen


def nearest_prefix(keys: DataFrame, key: str, declared: DataFrame, prefix: str) -> DataFrame:
    """``keys`` with ``nearest``: the longest declared prefix of each key by path parts, or null."""
    parts = F.split(F.col(key), "/")
    steps = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    exploded = keys.select(key, F.explode(steps).alias(prefix))
    hits = exploded.join(declared.select(prefix).distinct(), prefix, "left_semi")
    best = hits.groupBy(key).agg(F.max_by(prefix, F.length(prefix)).alias("nearest"))
    return keys.join(best, key, "left")


__all__ = ["components", "cyclic_core", "nearest_prefix", "node_key", "reach", "short_name", "shortest_paths", "strong_components", "typed_edges"]
