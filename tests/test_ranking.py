import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedgemill.operators import ranking as R


@pytest.mark.parametrize("seed, k, share", [(1, 3, 0.0), (2, 10, 0.0), (3, None, 0.5), (4, 1, 0.0), (5, None, 0.9)])
def test_hot_terms_do_not_change_the_result(spark, seed, k, share):
    r = random.Random(seed)
    terms = [f"t{i}" for i in range(30)]
    worth = {t: (0.1 if i < 4 else r.choice([1.0, 2.5, 2.5])) for i, t in enumerate(terms)}
    docs = {d: {t for i, t in enumerate(terms) if r.random() < (0.9 if i < 4 else 0.1)} for d in range(80)}
    asked = {q: {t for i, t in enumerate(terms) if r.random() < (0.8 if i < 4 else 0.15)} for q in range(15)} | {99: {"t0", "t1"}, 98: {"t9"}, 97: {"none"}}
    x = lambda d, t: 1 + (d * 7 + int(t[1:])) % 3
    parts = spark.createDataFrame([(d, t, float(x(d, t))) for d, ts in docs.items() for t in ts], "doc int, term string, x double")
    wanted = spark.createDataFrame([(q, t, worth.get(t, 1.0), 3 * worth.get(t, 1.0)) for q, ts in asked.items() for t in ts], "q int, term string, w double, most double")
    want = {}
    for q, ts in asked.items():
        scores = {d: round(sum(worth[t] * x(d, t) for t in ts & have), 6) for d, have in docs.items() if ts & have}
        bar = sorted(scores.values(), reverse=True)[:k][-1] if k and scores else share * max(scores.values(), default=0)
        want |= {(q, d): s for d, s in scores.items() if s >= bar - 1e-9}
    for pairs in (1, 200, 10**9):
        got = {(o["q"], o["doc"]): round(o["score"], 6) for o in R.best_sums(parts, wanted, "q", "doc", k, share, pairs).collect()}
        assert want.items() <= got.items()


@pytest.mark.parametrize("block", [3, 1000])
def test_nearest_is_exact(spark, block):
    r = np.random.default_rng(3)
    vectors = [r.normal(size=r.choice([3, 4])).round(1).tolist() for _ in range(60)]
    vectors += vectors[:20] + [[], [0.0, 0.0, 0.0, 0.0]]  # repeated, empty and zero ones
    v = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").repartition(5)
    q = v.filter("vec_id % 7 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))

    def cosine(a, b):
        n = min(len(a), len(b))
        a, b = np.float32(a[:n]).astype(float), np.float32(b[:n]).astype(float)
        norm = np.sqrt(a @ a) * np.sqrt(b @ b) if n else 0
        return round(float(a @ b / norm), 6) if norm else 0.0

    want = {}
    for i in range(0, len(vectors), 7):
        scored = sorted((-cosine(u, vectors[i]), j) for j, u in enumerate(vectors) if j != i)
        want[i] = [(j, -s) for s, j in scored[:5]]
    got = {}
    for o in R.nearest(v, q, 5, block).orderBy("query_id", "rank").collect():
        got.setdefault(o["query_id"], []).append((o["vec_id"], o["score"]))
    assert {k: [(j, round(s, 5) + 0) for j, s in x] for k, x in got.items()} == {k: [(j, round(s, 5) + 0) for j, s in x] for k, x in want.items()}
    bars = q.select("query_id", "q", F.lit(0.8).alias("least"))
    hits = {o["query_id"]: o["hits"] for o in R.similar_counts(v, bars, block).collect()}
    assert hits == {i: sum(cosine(u, vectors[i]) >= 0.8 for j, u in enumerate(vectors) if j != i) for i in want}
    assert R.nearest(v.limit(0), q, 5).count() == 0


def test_contained_words(spark):
    bodies = ["the cart was left", "a car", "", None, "scarf", "é!é", "xyzzy cart cart"]
    words = ["car", "cart", "a", "é!", "zz", "left", "none", "", "the cart was left behind", "xyzzy"]
    rows = spark.createDataFrame(list(enumerate(bodies)), "id int, body string")
    got = sorted(map(tuple, R.contained_words(rows, spark.createDataFrame([(w,) for w in [*words, "car"]], "word string")).collect()))
    assert got == sorted((i, w) for i, b in enumerate(bodies) for w in set(words) if w and b and w in b)
