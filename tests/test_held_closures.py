"""Closures whose graph every task holds, against sets and against joins."""

import random

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from sedgemill.operators import closures as C


def moved(spark):
    """Rows of all shuffles and all tables written so far."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() + stages.apply(i).outputRecords() for i in range(stages.size()))


def beyond(links, seed):
    met, front = set(), {seed}
    while front:
        front = {b for a, b in links if a in front} - met
        met |= front
    return met


@pytest.fixture(scope="module")
def crowd(spark, tmp_path_factory):
    """400 names, each called by three others; every one is asked for, and one that nobody calls."""
    d, r = str(tmp_path_factory.mktemp("crowd")), random.Random(3)
    links = {(f"f{i}", f"f{r.randrange(400)}") for i in range(400) for _ in range(3)}
    calls = [(k, f"m.{caller}", f"m.{callee}", "calls", None, "r", None) for k, (callee, caller) in enumerate(sorted(links))]
    spark.createDataFrame(calls, "edge_id long, src string, dst string, type string, confidence string, repo string, seen_at timestamp").write.parquet(f"{d}/edges.parquet")
    spark.createDataFrame([(50 * i, n, "m") for i, n in enumerate([*(f"f{i}" for i in range(400)), "lone"])], "symbol_id long, name string, module string").write.parquet(f"{d}/symbols.parquet")
    return d, links


def test_bits_against_sets():
    r = random.Random(1)
    for n, most in ((1, 1), (9, 12), (150, 170), (150, 600)):
        links = sorted({(r.randrange(n), r.randrange(n)) for _ in range(most)} | ({(i, i + 1) for i in range(60)} if n > 60 else set()))
        graph = C.Graph(pa.array([f"n{i:03}" for i in range(n)]), *np.array(links).T)
        seeds = np.array(r.sample(range(n), min(n, 64)))
        met = graph.beyond(seeds)
        for j, seed in enumerate(seeds.tolist()):
            assert set(np.flatnonzero((met >> np.uint64(j)) & np.uint64(1)).tolist()) == beyond(links, seed)


def test_impact_moves_no_pairs(spark, crowd):
    """About 150,000 pairs of a seed and a name stay in the tasks."""
    d, links = crowd
    want = {n: beyond(links, n) for n in {a for a, _ in links}}
    before = moved(spark)
    got = {r["seed"]: (r["affected"], r["first_affected"]) for r in entry.queries()["impact"](spark, d).collect()}
    assert got == {n: (len(x), min(x)) for n, x in want.items() if x} and sum(map(len, want.values())) > 100_000
    assert moved(spark) - before < 20_000


def test_large_graphs_by_joins(spark, crowd, monkeypatch):
    d, _ = crowd
    held = sorted(map(tuple, entry.queries()["impact"](spark, d).collect()))
    monkeypatch.setattr(C, "LINKS", 0)
    assert sorted(map(tuple, entry.queries()["impact"](spark, d).collect())) == held


def test_nothing(spark):
    none = spark.createDataFrame([], "src string, dst string")
    seeds = spark.createDataFrame([("a",), (None,)], "seed string")
    assert C.count_beyond(seeds, none).count() == 0
    assert C.count_beyond(seeds.limit(0), spark.createDataFrame([("a", "b"), ("b", None)], none.schema)).count() == 0


def test_impact_closure_moves_no_pairs(spark, crowd, monkeypatch):
    """Arrays of seven names, so that most seeds have several."""
    monkeypatch.setattr(C, "NAMES", 7)
    d, links = crowd
    want = {(n, x) for n in [f"f{i}" for i in range(400)] for x in beyond(links, n) | {n}} | {("lone", "lone")}
    before = moved(spark)
    got = list(map(tuple, entry.queries()["impact_closure"](spark, d).collect()))
    assert len(got) == len(want) and set(got) == want
    assert moved(spark) - before < 20_000
