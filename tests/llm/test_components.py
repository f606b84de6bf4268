import random

import pytest

from sedgemill.llm.components import groups, match_pairs

PAIR = "src string, dst string"


def model(pairs):
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


def result(spark, pairs):
    return {r["node"]: r["group_id"] for r in groups(spark.createDataFrame(pairs, PAIR)).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    r = random.Random(seed)
    n = 40 + 30 * seed
    pairs = [(f"n{r.randrange(n):03}", f"n{r.randrange(n):03}") for _ in range(n)]
    assert result(spark, pairs) == model(pairs)


def test_chain_star_self_repeats_and_code_points(spark):
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)]
    star = [("hub", f"s{i}") for i in range(40)]
    rest = [("x", "x"), ("é", "z"), ("Z", "z"), ("a", "b"), ("a", "b"), ("b", "a")]
    random.Random(5).shuffle(chain)
    got = result(spark, chain + star + rest)
    assert got == model(chain + star + rest)
    assert got["x"] == "x" and got["é"] == "Z"


def test_hubs_split(spark, monkeypatch):
    import sedgemill.llm.components as C
    from sedgemill.session import heavy_keys

    monkeypatch.setattr(C, "heavy_keys", lambda df, key, total: heavy_keys(df, key, share=0.1, least=2))
    monkeypatch.setattr(C, "HEAVY_LEAST", 2)
    pairs = [("hub", f"s{i:02}") for i in range(30)] + [("s03", "zz"), ("p", "q")]
    assert result(spark, pairs) == model(pairs)


def test_nothing(spark):
    assert groups(spark.createDataFrame([], PAIR)).count() == 0


def test_pairs_of_edges(spark):
    rows = [("a.b", " c::d\t", " Same_Symbol_As ", 1), ("a", None, "same_symbol_as", 2), ("", "b", "SAME_SYMBOL_AS", 3), ("a", "b", "calls", 4), ("a", "b", None, 5)]
    edges = spark.createDataFrame(rows, "src string, dst string, type string, extra int")
    assert [tuple(r) for r in match_pairs(edges).collect()] == [("a/b", "c/d")]
