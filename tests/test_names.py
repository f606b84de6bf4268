import itertools
import random

import pytest
from pyspark.sql import functions as F

from sedgemill.operators import names as N

D = "/root/testdata/sf0.01"


@pytest.mark.parametrize("a, b, want", [("martha", "marhta", 0.9611), ("dixon", "dicksonx", 0.8133), ("dwayne", "duane", 0.84), ("abc", "abc", 1.0), ("abc", "xyz", 0.0), ("", "a", 0.0), ("", "", 1.0), ("a", "b", 0.0)])
def test_jaro_winkler(a, b, want):
    assert round(N.jaro_winkler(a, b), 4) == want


def groups(spark, names):
    rows = N.similar_names(spark.createDataFrame([(n,) for n in names], "name string")).collect()
    return {r["key"]: r["group_id"] for r in rows}, {r["key"]: (r["names"], r["links"]) for r in rows}


def test_groups(spark):
    found, counts = groups(spark, ["read_rows", "readRows", "read_row", "readrowss", "merge_batch", "item1", "item2", "item_1", "__init__", None, "", "_", "zz"])
    assert found["readrows"] == found["readrow"] == found["readrowss"] == "readrow" and found["item1"] != found["item2"] and found["mergebatch"] == "mergebatch"
    assert "init" not in found and "" not in found and counts["readrows"][0] == 2 and counts["item1"][0] == 2 and counts["zz"] == (1, 0)
    assert groups(spark, []) == ({}, {})


@pytest.mark.parametrize("small, levels", [(64, 6), (5, 3), (2, 0)])
def test_large_buckets_stay_whole(spark, monkeypatch, small, levels):
    """Many names that share nearly all shingles: compared, split by further hashes, or taken by representatives."""
    monkeypatch.setattr(N, "SMALL", small)
    monkeypatch.setattr(N, "LEVELS", levels)
    r = random.Random(2)
    names = ["prepare_the_whole_ledger_" + "".join(r.choice("abcdefghij") for _ in range(2)) for _ in range(60)]
    found, _ = groups(spark, names)
    assert len(set(found.values())) == 1


def test_recall_against_all_pairs(spark):
    """Of all pairs of names that are the same by Jaro-Winkler, over nine in ten are in one group."""
    names = spark.read.parquet(f"{D}/symbols.parquet").select("name")
    rows = N.similar_names(names).collect()
    group = {r["key"]: r["group_id"] for r in rows}
    digits = lambda k: "".join(c for c in k if c.isdigit())
    same = [(a, b) for a, b in itertools.combinations(sorted(group), 2) if digits(a) == digits(b) and N.jaro_winkler(a, b) >= N.SAME]
    assert same and sum(group[a] == group[b] for a, b in same) >= 0.9 * len(same)
    # nothing but chains of such pairs is in one group
    linked = {x: {x} for x in group}
    for a, b in same:
        if linked[a] is not linked[b]:
            linked[a] |= linked[b]
            for x in linked[b]:
                linked[x] = linked[a]
    assert all(g in linked[k] for k, g in group.items())
    assert names.agg(F.count("name")).first()[0] >= sum(r["names"] for r in rows)
