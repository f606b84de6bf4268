"""Closures without a limit of hops, paths and strongly connected components."""

from sedgemill.operators import graph as G
from sedgemill.plans import graph, recall


def store(spark, d):
    calls = [(i, f"m.f{i + 1}", f"m.f{i}", "calls", None, "r", None) for i in range(20)] + [(20, "m.f3", "m.f5", "calls", None, "r", None)]
    edges = "edge_id long, src string, dst string, type string, confidence string, repo string, seen_at timestamp"
    spark.createDataFrame(calls, edges).write.parquet(f"{d}/edges.parquet")
    spark.createDataFrame([(0, "f0", "m")], "symbol_id long, name string, module string").write.parquet(f"{d}/symbols.parquet")
    return str(d)


def test_callers_at_any_depth(spark, tmp_path):
    d = store(spark, tmp_path)
    assert {r["node"] for r in graph.reg.queries["impact_closure"](spark, d).collect()} == {f"f{i}" for i in range(21)}
    assert list(map(tuple, recall.reg.queries["change_impact_closure"](spark, d).collect())) == [("m.f0", 20, 1)]


def test_paths(spark):
    edges = spark.createDataFrame([("a", "c"), ("a", "b"), ("b", "d"), ("c", "d"), ("d", "a")] + [(f"n{i:02}", f"n{i + 1:02}") for i in range(15)], "src string, dst string")
    seeds = spark.createDataFrame([("a", "a"), ("n00", "n00")], "seed string, node string")
    got = {(r["seed"], r["node"]): (r["hops"], r["path"]) for r in G.shortest_paths(seeds, edges).collect()}
    assert got["a", "d"] == (2, ["a", "b", "d"]) and got["a", "a"] == (0, ["a"]) and got["n00", "n15"][0] == 15 and len(got) == 20


def test_only_cycles(spark):
    edges = [("b", "c"), ("c", "b"), ("c", "p"), ("p", "x"), ("x", "y"), ("y", "z"), ("z", "x"), ("a", "b"), ("z", "end"), ("b", "a2"), ("a2", "b")]
    got = sorted(map(tuple, G.strong_components(spark.createDataFrame(edges, "src string, dst string")).collect()))
    assert got == [("a2", "b", "a2"), ("b", "a2", "a2"), ("b", "c", "a2"), ("c", "b", "a2"), ("x", "y", "x"), ("y", "z", "x"), ("z", "x", "x")]
    assert G.strong_components(spark.createDataFrame([("a", "b"), ("p", "p")], "src string, dst string")).count() == 0
