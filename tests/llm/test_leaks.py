import random
import time

import numpy as np
import pytest

from sedgemill.llm import leaks as L


@pytest.mark.parametrize("seed", range(4))
def test_suffix_array(seed):
    r = random.Random(seed)
    s = np.array([r.randrange(3) for _ in range(200)] + [1] * 50)
    assert L.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


@pytest.mark.parametrize("seed", range(3))
def test_index_finds_all_occurrences(seed):
    r = random.Random(seed)
    s = np.array([r.randrange(5) for _ in range(400)])
    index = L.FmIndex(s, 5)
    phrases = np.array([[r.randrange(5) for _ in range(3)] for _ in range(20)])
    low, high = index.search(phrases)
    for p, a, b in zip(phrases.tolist(), low, high):
        want = [i for i in range(398) if s[i : i + 3].tolist() == p]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


WORDS = [f"w{i}" for i in range(400)]


def passage(n, at=0):
    return WORDS[at : at + n]


def leaks(spark, docs, items):
    d = spark.createDataFrame([(i, t, 0) for i, t in enumerate(docs)], "doc_id long, text string, item_id int")
    t = spark.createDataFrame([(i, *x) for i, x in enumerate(items)], "item_id long, question string, lang string, text string")
    return sorted(map(tuple, L.leaking_documents(d, t).collect()))


def test_thresholds(spark):
    item = [("who is it?", "en", " ".join(passage(40)))]
    near = passage(20)
    near[3] = near[9] = near[15] = "zz"
    far = list(near)
    far[18] = "zz"
    docs = [" ".join(passage(12, 5)), " ".join(passage(11, 5)), "x " + " ".join(near) + " y", " ".join(far), "> **" + "_ *".join(passage(12, 8)).upper() + "**\r\n", None, " ", " ".join(passage(12)[::-1])]
    assert leaks(spark, docs, item) == [(0, 0), (2, 0), (4, 0)]


def test_shared_instructions_belong_to_no_item(spark):
    told = "Please answer only from what is written below and never guess any of the dates at all."
    items = [("q one two three?", "en", f"{told} " + " ".join(passage(15, 20 * i)).capitalize()) for i in range(3)]
    assert leaks(spark, [told, told + " " + " ".join(passage(15, 20))], items) == [(1, 1)]


def test_questions_on_one_passage(spark):
    text = " ".join(passage(20)).capitalize() + ". " + " ".join(passage(20, 20)).capitalize() + "."
    assert leaks(spark, ["x " + text + " y"], [(f"q{i} is it so?", "en", text) for i in range(4)]) == [(0, i) for i in range(4)]


def test_short_shared_sentence_inside(spark):
    told = "Answer only from the text."
    texts = [f"{told} " + " ".join(passage(7, 40 * i)).capitalize() + ". Thank you. " + " ".join(passage(8, 40 * i + 20)).capitalize() + "." for i in range(4)]
    docs = [t[len(told) :] for t in texts] + [told]
    assert leaks(spark, docs, [("q one?", "en", t) for t in texts]) == [(i, i) for i in range(4)]


def test_chinese(spark):
    text = "春天的时候罗斯告诉大家那个箱子一共寄出了很多次却从来没有丢过任何印章"
    assert leaks(spark, ["他说：" + text[3:23] + "。", text[3:22], text[:12] + "，\n" + text[12:24]], [("？", "zh", text)]) == [(0, 0), (2, 0)]


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(seed):
    r = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(12)]
    parts = [(i, [r.choice(vocabulary) for _ in range(30)]) for i in range(6)]
    texts = []
    for _ in range(25):
        words = [r.choice(vocabulary + ["q", "u"]) for _ in range(60)]
        for _ in range(2):
            _, p = r.choice(parts)
            n, a, b = r.randrange(6, 28), r.randrange(0, 3), r.randrange(0, 30)
            cut = [w if r.random() > 0.1 else "zz" for w in p[a : a + n]]
            words[b : b + len(cut)] = cut
        texts.append(" ".join(words))
    ids = {}
    p = L.phrases(parts, L.PHRASE, ids)
    got = {(k, i) for k, i, _, _ in L.search_shard(L.Shard(texts, ids, L.WORD), p, L.RUN, L.NEAR, 5)}
    want = set()
    for k, text in enumerate(texts):
        doc = np.array([hash(w) for w in text.split()])
        for i, words in parts:
            item = np.array([hash(w) for w in words])
            if any(L.verified(doc, item, shift, L.RUN, L.NEAR) for shift in range(-len(item) + 1, len(doc))):
                want.add((k, i))
    assert got == want


def test_nothing_and_spans(spark):
    assert leaks(spark, ["a b"], []) == [] and leaks(spark, [], [("q", "en", "t")]) == []
    spans = spark.createDataFrame([(1, 0, 10), (1, 5, 12), (1, 20, 30), (1, 0, 10), (2, 3, 4)], "doc_id long, start_char int, end_char int")
    assert sorted(map(tuple, L.removal_spans(spans).collect())) == [(1, 0, 12), (1, 20, 30), (2, 3, 4)]


def brute(docs, items):
    """Every diagonal of every pair, word by word."""
    out = set()
    for d, doc in enumerate(docs):
        for i, item in enumerate(items):
            for shift in range(1 - len(item), len(doc)):
                if L.verified(np.array(doc), np.array(item), shift, L.RUN, L.NEAR):
                    out.add((d, i))
    return out


def slow_verified(doc, item, shift):
    a, b = max(0, shift), min(len(doc), len(item) + shift)
    same = [doc[k] == item[k - shift] for k in range(a, b)]
    hold = set()
    for x in range(len(same)):
        for y in range(x + 1, len(same) + 1):
            if y - x >= L.RUN and all(same[x:y]) or y - x >= L.NEAR and L.ODD * same[x:y].count(False) <= y - x:
                hold |= set(range(x, y))
    return (a + min(hold), a + max(hold)) if hold else None


def test_verified():
    r = random.Random(5)
    for _ in range(300):
        item = [r.randrange(50) for _ in range(r.randrange(1, 60))]
        doc = [r.randrange(50) for _ in range(r.randrange(5))] + [w if r.random() > 0.15 else 99 for w in item] + [1]
        for shift in (0, 1, 2, 3, 4, -1):
            assert L.verified(np.array(doc), np.array(item), shift, L.RUN, L.NEAR) == slow_verified(doc, item, shift)


@pytest.mark.parametrize("seed", range(6))
def test_common_phrases_lose_nothing(seed, monkeypatch):
    """Stock phrases of all lengths in items and texts, copies of items with replaced words next to them."""
    monkeypatch.setattr(L, "COMMON", 2)
    r = random.Random(seed)
    stock = [[r.randrange(300) for _ in range(n)] for n in (4, 6, 8, 10, 11, 15)]
    make = lambda n: [r.randrange(300) for _ in range(n)]
    items = [make(r.randrange(14)) + r.choice(stock) + make(r.randrange(3, 14)) + r.choice(stock) + make(r.randrange(9)) for _ in range(25)]
    docs = [make(5) + r.choice(stock) + make(9) for _ in range(15)]
    for _ in range(40):
        item = list(r.choice(items))
        at = r.randrange(max(1, len(item) - 20))
        copy = item[at : at + r.choice([11, 12, 19, 20, 24, 30, 40])]
        for k in range(r.randrange(4), len(copy), r.choice([4, 5, 6, 7])):
            copy[k] = 999
        docs.append(make(3) + copy + make(3))
    ids = {}
    p = L.phrases([(i, [f"w{w}" for w in item]) for i, item in enumerate(items)], L.PHRASE, ids)
    code = lambda row: [ids.get(f"w{w}", 0) for w in row]
    shard = L.Shard([" ".join(f"w{w}" for w in doc) for doc in docs], ids, L.WORD)
    got = {(k, i) for k, i, _, _ in L.search_shard(shard, p, L.RUN, L.NEAR, 5)}
    assert got == brute([code(d) for d in docs], [code(i) for i in items])


def test_stock_phrases_take_linear_time():
    took = []
    for n in (500, 2000):
        r = random.Random(1)
        make = lambda k: " ".join(f"w{r.randrange(100_000)}" for _ in range(k))
        stock, ids = make(9), {}
        p = L.phrases([(i, f"{make(15)} {stock} {make(15)}".split()) for i in range(n)], L.PHRASE, ids)
        texts = [f"{make(15)} {stock} {make(15)}" for _ in range(n)]
        began = time.time()
        assert L.search_shard(L.Shard(texts, ids, L.WORD), p, L.RUN, L.NEAR, 5) == []
        took.append(time.time() - began)
    assert took[1] < 9 * took[0] + 0.5


def test_blocks_of_items(spark):
    docs = [" ".join(passage(14, 20 * i)) for i in range(6)] + ["清单已经关闭请先检查所有的队列再继续整理账本今天"]
    items = [("q one two three?", "en", " ".join(passage(20, 20 * i))) for i in range(6)] + [("短问", "zh", "清单已经关闭请先检查所有的队列再继续整理账本")]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    t = spark.createDataFrame([(i, *x) for i, x in enumerate(items)], "item_id long, question string, lang string, text string")
    want = sorted(map(tuple, L.leaked_passages(d, t).collect()))
    assert len(want) == 7 and sorted(map(tuple, L.leaked_passages(d, t, item_chars=100).collect())) == want
