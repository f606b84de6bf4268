import random
from datetime import datetime

import pytest

from sedgemill.operators.orphans import orphan_counts, orphan_references
from sedgemill.session import heavy_keys, lookup

E = "edge_id long, src string, dst string, type string, seen_at timestamp, extra string"
S = "symbol_id long, name string, module string, seen_at timestamp, removed_at timestamp, extra string"
M = "module string, seen_at timestamp, removed_at timestamp, extra string"
B = "key string, lang string"


def t(day):
    return datetime(2025, 1, day) if day else None


def run(spark, edges=(), symbols=(), manifest=(), builtins=(), **kw):
    found = orphan_references(spark.createDataFrame(list(edges), E), spark.createDataFrame(list(symbols), S), spark.createDataFrame(list(manifest), M), spark.createDataFrame(list(builtins), B), **kw)
    return found


def test_states(spark):
    manifest = [("a/b", t(5), t(10), "x"), ("a/b", t(20), None, "x"), ("c", None, None, "x")]
    edges = [
        (1, "s", "a/b", "calls", t(4), ""), (2, "s", " a.b\t", "calls", t(5), ""), (3, "s", "a::b", "calls", t(10), ""), (4, "s", "a/b", "calls", t(21), ""),
        (5, "s", "A/b", "calls", t(6), ""), (6, "s", None, "calls", t(6), ""), (7, "s", "  ", "calls", t(6), ""), (8, "s", "zz", " Depends_On", t(6), ""),
        (9, "s", "c", "calls", t(1), ""), (10, "s", "a/b", "calls", None, ""), (11, "s", "nowhere", None, None, ""), (1, "s", "a/b", "calls", t(4), ""),
        (12, "s", "std/log.emit", "calls", t(1), ""), (13, "s", "m.f", "calls", t(3), ""), (14, "s", "m.f", "calls", t(2), ""),
    ]
    symbols = [(1, "f", "m", t(3), None, ""), (1, "f", "m", t(3), None, ""), (2, "g", None, t(3), None, ""), (3, "h", "a.b", t(6), None, "")]
    got = {(r["ref_table"], r["ref_id"]): r["state"] for r in run(spark, edges, symbols, manifest, [("std/log.emit", None)]).collect()}
    assert got == {("edges", 1): "late", ("edges", 3): "deleted", ("edges", 5): "missing", ("edges", 11): "missing", ("edges", 14): "late", ("symbols", 1): "missing"}


def test_empty_and_counts(spark):
    assert run(spark).count() == 0
    found = run(spark, [(i, "s", "gone", "calls", t(1 + i % 3), "") for i in range(30)])
    assert [(r["ref_table"], r["month"], r["state"], r["n"]) for r in orphan_counts(found).collect()] == [("edges", "2025-01", "missing", 30)]


def test_heavy_keys_give_the_same_rows(spark, monkeypatch):
    import sedgemill.operators.orphans as O

    edges = [(i, "s", "hot" if i % 3 == 0 else f"k{i}", "calls", t(2), "") for i in range(300)]
    manifest = [("hot", t(1), None, ""), ("k1", t(1), None, "")]
    plain = sorted(map(tuple, run(spark, edges, (), manifest).collect()))
    monkeypatch.setattr(O, "heavy_keys", lambda *a: heavy_keys(*a, least=2))
    assert sorted(map(tuple, run(spark, edges, (), manifest, share=0.2).collect())) == plain
    assert len(plain) == 199


def test_lookup_keeps_all_rows(spark):
    facts = spark.createDataFrame([("a", 1)] * 10 + [("b", 2), (None, 3), ("c", 4)], "k string, v int")
    dim = spark.createDataFrame([("a", "x"), ("b", "y")], "k string, d string")
    heavy = heavy_keys(facts, "k", share=0.5, least=2)
    assert [r["k"] for r in heavy.collect()] == ["a"]
    rows = lookup(facts, dim, "k", heavy).collect()
    assert len(rows) == 13 and sum(r["d"] == "x" for r in rows) == 10 and sum(r["d"] is None for r in rows) == 2


@pytest.mark.parametrize("n", [0, 5])
def test_heavy_keys_of_small_tables(spark, n):
    assert heavy_keys(spark.range(n).selectExpr("id as k"), "k").isEmpty()


def brute(edges, manifest):
    """States by looking at every life of the key."""
    out = {}
    for i, _, dst, _, seen, _ in edges:
        lives = [(b or datetime(1, 1, 1), g) for m, b, g, _ in manifest if m == dst]
        if not lives:
            out[i] = "missing"
        elif seen and not any(b <= seen and (g is None or g > seen) for b, g in lives):
            out[i] = "deleted" if any(b <= seen for b, _ in lives) else "late"
    return out


@pytest.mark.parametrize("seed", range(3))
def test_lives_of_all_kinds(spark, seed):
    """Overlapping, repeated, reborn, never living and open lives; references at their very ends, one key with a third of all rows."""
    r = random.Random(seed)
    time = lambda: datetime(2025, r.choice([1, 1, 2]), r.randrange(1, 4), r.randrange(3), r.choice([0, 30])) if r.random() > 0.05 else None
    key = lambda: "hot" if r.random() < 0.33 else f"k{r.randrange(12)}"
    manifest = [(key(), time(), time() if r.random() < 0.7 else None, "") for _ in range(30)]
    manifest += manifest[:8]
    edges = [(i, "s", key(), "calls", time(), "") for i in range(200)] + [(900, "s", "none", "calls", None, "")]
    got = {x["ref_id"]: x["state"] for x in run(spark, edges, (), manifest).collect()}
    assert got == brute(edges, manifest)
