import random

import pytest
from pyspark.sql import functions as F

from sedgemill.operators import graph as G
from sedgemill.operators import ledger as L
from sedgemill.operators import ranking as R
from sedgemill.operators.segments import heading_segments, packed_segments, sampled_segments

EDGE = "src string, dst string"


def union_find(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_are_those_of_a_model(spark, seed):
    r = random.Random(seed)
    pairs = [(f"n{r.randrange(60):02}", f"n{r.randrange(60):02}") for _ in range(50)] + [(f"c{i:02}", f"c{i + 1:02}") for i in range(20)]
    got = {x["node"]: x["component"] for x in G.components(spark.createDataFrame(pairs, EDGE)).collect()}
    assert got == union_find(pairs)


def test_components_of_nothing(spark):
    assert G.components(spark.createDataFrame([], EDGE)).count() == 0


def test_reach(spark):
    edges = spark.createDataFrame([(f"layer_{i}", f"layer_{i + 1}") for i in range(11)] + [("layer_3", "layer_0")], EDGE)
    seeds = spark.createDataFrame([("layer_0", "layer_0")], "seed string, node string")
    got = {r["node"]: r["hops"] for r in G.reach(seeds, edges).collect()}
    assert got == {f"layer_{i}": i for i in range(12)}
    assert G.reach(seeds, edges, rounds=2).count() == 3


def test_cyclic_core(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("x", "a"), ("c", "y"), ("d", "d")]
    assert sorted(map(tuple, G.cyclic_core(spark.createDataFrame(edges, EDGE)).collect())) == [("a", "b"), ("b", "c"), ("c", "a")]


def test_nearest_prefix(spark):
    keys = spark.createDataFrame([("a/b/c",), ("a/x",), ("q",)], "node string")
    known = spark.createDataFrame([("a",), ("a/b",)], "module string")
    assert dict(map(tuple, G.nearest_prefix(keys, "node", known, "module").collect())) == {"a/b/c": "a/b", "a/x": "a", "q": None}


def test_running_total(spark):
    r = random.Random(3)
    rows = [(r.choice("ab"), r.randrange(4), i, r.randrange(9)) for i in range(80)]
    got = L.running_total(spark.createDataFrame(rows, "k string, day int, i int, v int"), "k", "day", ["i"], "v").collect()
    want, sums = {}, {}
    for k, day, i, v in sorted(rows, key=lambda x: (x[0], x[1], x[2])):
        sums[k] = sums.get(k, 0) + v
        want[i] = sums[k]
    assert {x["i"]: x["total"] for x in got} == want


def test_first_per_key(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 5, "z")], "k string, o int, v string")
    assert sorted((r["k"] or "", r["v"]) for r in L.first_per_key(df, ["k"], ["o"]).collect()) == [("", "z"), ("a", "y")]


def test_facts(spark):
    schema = "id string, date string, summary string, attrs array<string>"
    rows = [("1", "2026-01-10", "We added a redis cache to the api. Then it was removed by the team.", ["Cache is big"]), ("2", None, None, None)]
    got = L.facts(spark.createDataFrame(rows + rows[:1], schema)).collect()
    assert sorted((r["n"], r["kind"]) for r in got) == [(1, "event"), (2, "event"), (3, "attribute")]


def test_bm25_against_a_model(spark):
    import math

    docs = {"d1": ["a", "b", "a"], "d2": ["b"], "d3": ["c", "c"]}
    df = spark.createDataFrame([(k, v) for k, v in docs.items()], "id string, ts array<string>")
    n, mean = R.collection_size(df, F.col("ts"))
    wanted = spark.createDataFrame([("q", "a", 2), ("q", "b", 1)], "query string, term string, n int")
    got = {r["id"]: r["score"] for r in R.bm25(R.postings(df, "id", F.col("ts")), "id", n, mean, wanted, "query").collect()}

    def score(doc):
        s = 0
        for term, times in (("a", 2), ("b", 1)):
            tf, dfr = doc.count(term), sum(term in x for x in docs.values())
            s += times * max(1e-6, math.log(1 + (3 - dfr + 0.5) / (dfr + 0.5))) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(doc) / 2))
        return s

    assert got == pytest.approx({k: score(v) for k, v in docs.items() if score(v)})


def test_segments(spark):
    text = "\n\n".join(["word " * 100] * 5)
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "# A\nx\n\n## B\n\n## C\ny")], "doc_id int, text string")
    packed = packed_segments(docs.filter("doc_id <> 4"), budget=300).collect()
    assert [r["paragraphs"] for r in packed if r["doc_id"] == 1] == [2, 2, 1] and sum(r["doc_id"] == 3 for r in packed) == 1
    sample = {r["segment"] for r in sampled_segments(docs.filter("doc_id = 1"), budget=150, cap=450).collect()}
    assert sample == {1, 3, 5}
    assert [(r["title"], r["body"]) for r in heading_segments(docs.filter("doc_id = 4")).orderBy("n").collect()] == [("A", "x"), ("C", "y")]
