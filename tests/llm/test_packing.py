import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sedgemill.llm.packing import TOKENIZER, Bins, packed, packed_sizes, pieces


class Plain:
    """Best fit by looking at all open containers."""

    def __init__(self, capacity, most):
        self.capacity, self.most, self.open, self.n = capacity, most, {}, 0

    def place(self, size):
        fits = [(free, c) for c, free in self.open.items() if free >= size]
        if fits:
            free, c = min(fits)
        else:
            if len(self.open) >= self.most:
                del self.open[min((free, c) for c, free in self.open.items())[1]]
            c, free = self.n, self.capacity
            self.n += 1
        self.open[c] = free - size
        if not self.open[c]:
            del self.open[c]
        return c


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80), st.integers(1, 6))
def test_bins_are_those_of_a_plain_search(sizes, most):
    a, b = Bins(50, most), Plain(50, most)
    assert [a.place(s) for s in sizes] == [b.place(s) for s in sizes]


def test_pieces():
    assert pieces(10, 4) == [(0, 4), (4, 8), (8, 10)] and pieces(4, 4) == [(0, 4)] and pieces(0, 4) == []


def test_containers(spark):
    r = random.Random(1)
    sizes = [(i, r.choice([r.randrange(1, 900), r.randrange(1, 60), 2048, 5000])) for i in range(600)] + [(1000, 0), (1001, 1), (1001, 1), (None, 7)]
    out = packed_sizes(spark.createDataFrame(sizes, "doc_id long, n_tokens int"), items_per_task=200).collect()
    fill, by_doc = {}, {}
    for x in out:
        if x["container_id"] is not None:
            fill[x["container_id"]] = fill.get(x["container_id"], 0) + x["end_token"] - x["start_token"]
        by_doc.setdefault(x["doc_id"], []).append((x["start_token"], x["end_token"]))
    assert max(fill.values()) <= 2048
    for i, n in sizes[:600]:
        parts = sorted(by_doc[i])
        assert parts[0][0] == 0 and parts[-1][1] == n and all(a[1] == b[0] for a, b in zip(parts, parts[1:])) and (n > 2048 or len(parts) == 1)
    assert len(by_doc[1001]) == 2 and len(by_doc[None]) == 1 and by_doc[1000] == [(0, 0)]
    full = sum(n for _, n in sizes)
    assert len(fill) <= full / 2048 * 1.08 + 4 * 2


@pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer files")
def test_documents(spark):
    docs = spark.createDataFrame([(1, "one two three", 1), (2, None, 1), (3, "", 1), (4, "word " * 3000, 1)], "doc_id long, text string, piece int")
    out = sorted((r["doc_id"], r["piece"], r["end_token"] - r["start_token"], r["container_id"] is None) for r in packed(docs).collect())
    assert out == [(1, 0, 3, False), (2, 0, 0, True), (3, 0, 0, True), (4, 0, 2048, False), (4, 1, 953, False)]
    assert packed(docs.limit(0)).count() == 0
