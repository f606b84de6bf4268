import random

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from sedgemill.operators import blocked as K
from sedgemill.operators import names as N


def example(seed, groups):
    r = random.Random(seed)
    terms = [f"t{i}" for i in range(25)]
    docs = [((g, n) if groups else (g,), [t for i, t in enumerate(terms) if r.random() < (0.9 if i < 4 else 0.15)] * r.randint(1, 2)) for g in range(60) for n in range(r.randint(1, 4) if groups else 1)]
    asked = {q: {t: r.choice([0.5, 1.0, 1.0, 2.5]) for i, t in enumerate(terms) if r.random() < (0.8 if i < 4 else 0.15)} for q in range(20)} | {98: {"none": 1.0}}
    scores = {q: {k: round(sum(w * ts.count(t) for t, w in ws.items()), 6) for k, ts in docs if set(ts) & set(ws)} for q, ws in asked.items()}
    wanted = pa.table({"q": [q for q, ws in asked.items() for _ in ws], "term": [t for ws in asked.values() for t in ws], "w": [w for ws in asked.values() for w in ws.values()]})
    return docs, wanted, scores


def batches(docs, keys, size):
    columns = {c: pa.array([k[i] for k, _ in docs], pa.int64()) for i, c in enumerate(keys)} | {"terms": pa.array([ts for _, ts in docs], pa.list_(pa.string()))}
    return iter(pa.table(columns).to_batches(size))


@pytest.mark.parametrize("seed, k, per", [(1, 3, None), (2, 1, None), (3, 5, 2), (4, 3, 1), (5, 100, None)])
def test_best_against_all_pairs(monkeypatch, seed, k, per):
    monkeypatch.setattr(K, "FIRST", 5)
    docs, wanted, scores = example(seed, bool(per))
    random.Random(seed).shuffle(docs)
    keys = ["doc", "n"] if per else ["doc"]
    schema = pa.schema([("q", pa.int64()), *[(c, pa.int64()) for c in keys], ("score", pa.float64())])
    got = {}
    for batch in K._runner_best(K.Asked(wanted, "q"), keys, k, per, None, schema)(batches(docs, keys, 17)):
        for row in batch.to_pylist():
            got.setdefault(row["q"], []).append((-row["score"], tuple(row[c] for c in keys)))
    assert got == {q: K._first([(-s, key) for key, s in of.items()], k, per) for q, of in scores.items() if of}


@pytest.mark.parametrize("size", [3, 1000])
def test_groups_that_reach_a_bar_count_once(monkeypatch, size):
    monkeypatch.setattr(K, "FIRST", size)
    docs, wanted, scores = example(7, True)
    wanted = wanted.append_column("least", pa.array([2.0] * wanted.num_rows))
    schema = pa.schema([("q", pa.int64()), ("hits", pa.int64()), ("least", pa.float64()), ("most", pa.float64())])
    (batch,) = K._runner_reaching(K.Asked(wanted, "q"), ["doc"], None, schema)(batches(docs, ["doc", "n"], size))
    reached = {q: [(key[0], s) for key, s in of.items() if s >= 2] for q, of in scores.items()}
    want = {q: (len({d for d, _ in x}), min(s for _, s in x), max(s for _, s in x)) for q, x in reached.items() if x}
    assert {o["q"]: (o["hits"], o["least"], o["most"]) for o in batch.to_pylist()} == want


@pytest.fixture(scope="module")
def crowd(spark, tmp_path_factory):
    """300 questions and 1,500 entries, each pair of which shares words."""
    d, r = str(tmp_path_factory.mktemp("crowd")), random.Random(5)
    common, rare = ["ledger", "harbor"], [f"spindle{c}" for c in "abcdefghij"]
    say = lambda: " ".join([*common, *r.sample(rare, 3)])
    spark.createDataFrame([(50 * i, f"The {say()}\n\nA {say()}") for i in range(300)], "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    entries = [(f"e{i}", "2025-01-01", f"Title {say()}", f"We saw {say()} number{i} again.", [r.choice(rare)], [r.choice(common)], ["open ledger"], ["tag"]) for i in range(1500)]
    spark.createDataFrame(entries, "id string, date string, title string, summary string, topics array<string>, entities array<string>, attrs array<string>, tags array<string>").write.parquet(f"{d}/history_manifest.parquet")
    return d


def moved(spark):
    """Rows of all shuffles and all tables written so far."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() + stages.apply(i).outputRecords() for i in range(stages.size()))


@pytest.mark.parametrize("name", "bm25_topk bm25f_topk rank_fusion span_diversity pick_segments two_stage half_of_top lean_shortlist packs score_entries tally_answers timeline_answers manifest_prefilter".split())
def test_pairs_are_never_written(spark, crowd, name):
    """450,000 pairs (180,000 of questions and paragraphs) stay in the tasks."""
    before = moved(spark)
    assert entry.queries()[name](spark, crowd).collect()
    assert moved(spark) - before < 150_000


def test_pairs_of_names_are_never_written(spark):
    """Pairs of names in a bucket are compared in bulk and give what one pair at a time gives."""
    r = random.Random(1)
    names = sorted({"".join(r.choice("abcdé") for _ in range(r.randint(1, 12))) for _ in range(200)} | {"prepared_" + "x" * n for n in (50, 60, 70, 90)})
    assert N.linked([names, names[:40], ["a", "b"]]) == {(b, a) for k, a in enumerate(names) for b in names[k + 1 :] if N.jaro_winkler(b, a) >= N.SAME}
    crowd = [(f"row{a}{b}",) for a in "abcdefghijklmno" for b in "abcdefghijklmno"]
    before = moved(spark)
    N.links_within(spark.createDataFrame([(i, n) for i in range(40) for (n,) in crowd], "bucket int, key string")).count()
    assert moved(spark) - before < 300_000
    assert np.isclose(N.jaro_winkler("martha", "marhta"), 0.9611, atol=1e-4)
