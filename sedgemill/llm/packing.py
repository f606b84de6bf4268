"""Filling fixed-capacity containers with documents.

Method: bounded-space online best fit. Each task keeps at most OPEN_BINS open containers in a bitset keyed by free space. An item
goes to the fullest container that it fits; if it fits none, a new one is opened, and if all places are taken, the fullest
closes first. Sizes are tokens of a public tokenizer, whose file is a parameter. Only (id, size) pairs are shuffled, never texts.

An item is split only if it exceeds the capacity: into full containers and one rest, which is packed like any item.

Defined results: null and empty texts have no tokens and come out with a null container; repeated rows are items of their own;
ties go to the container that was opened first; no documents give no rows; texts of any length are tokenized whole; extra columns
are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgemill.session import cut, spread

CAPACITY = 2048
OPEN_BINS = 64
#: Items that one task packs; each task leaves at most OPEN_BINS containers that are not full.
ITEMS_PER_TASK = 100_000
#: Ranks of a byte-level vocabulary, one token and its rank a line.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how that vocabulary's texts are cut before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_loaded: dict = {}


def _tokenizer(path: str) -> tiktoken.Encoding:
    if path not in _loaded:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        _loaded[path] = tiktoken.Encoding("sizes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, n_tokens of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _tokenizer(tokenizer).encode_ordinary
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": [len(encode(x)) if x else 0 for x in batch["text"]]})

    return spread(documents.select("doc_id", "text")).mapInPandas(run, "doc_id long, n_tokens int")


class Bins:
    """The open containers of one task."""

    def __init__(self, capacity: int = CAPACITY, most: int = OPEN_BINS) -> None:
        self.capacity, self.most, self.opened, self.held = capacity, most, 0, 0
        self.mask = 0  # bit f: some open container has f free
        self.by_free: dict[int, list[int]] = {}

    def _keep(self, container: int, free: int) -> None:
        if free:
            self.by_free.setdefault(free, []).append(container)
            self.mask |= 1 << free
            self.held += 1

    def _take(self, free: int) -> int:
        rest = self.by_free[free]
        container = min(rest)
        rest.remove(container)
        if not rest:
            self.mask &= ~(1 << free)
        self.held -= 1
        return container

    def place(self, size: int) -> int:
        """The container for an item of 1 to ``capacity``."""
        fits = self.mask >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            container = self._take(free)
        else:
            if self.held >= self.most:
                self._take((self.mask & -self.mask).bit_length() - 1)
            container, free = self.opened, self.capacity
            self.opened += 1
        self._keep(container, free - size)
        return container


def pieces(size: int, capacity: int) -> list[tuple[int, int]]:
    """Token ranges of an item: one, unless it exceeds the capacity."""
    return [(a, min(a + capacity, size)) for a in range(0, size, capacity)]


def packed(documents: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, tokenizer: str = TOKENIZER, items_per_task: int = ITEMS_PER_TASK) -> DataFrame:
    """doc_id, piece, start_token, end_token, container_id: one row per document, or per piece of a longer one."""
    return packed_sizes(cut(token_counts(documents, tokenizer), "sizes"), capacity, open_bins, items_per_task)


def packed_sizes(sizes: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, items_per_task: int = ITEMS_PER_TASK) -> DataFrame:
    """The same from doc_id, n_tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins, first = Bins(capacity, open_bins), TaskContext.get().partitionId() << 33
        for batch in batches:
            rows = []
            for i, n in zip(batch["doc_id"], batch["n_tokens"]):
                for k, (a, b) in enumerate(pieces(n, capacity)):
                    rows.append((i, k, a, b, first + bins.place(b - a)))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start_token", "end_token", "container_id"]).astype({"doc_id": "Int64"})

    full = sizes.filter("n_tokens > 0")
    tasks = max(1, -(-full.count() // items_per_task))
    # the same rows in the same order in each attempt, so that a task run again gives the same containers
    spread = full.repartition(tasks).sortWithinPartitions(F.xxhash64("doc_id", "n_tokens"), "doc_id")
    out = spread.mapInPandas(run, "doc_id long, piece int, start_token int, end_token int, container_id long")
    zero = F.lit(0)
    empty = sizes.filter("n_tokens = 0").select("doc_id", zero.alias("piece"), zero.alias("start_token"), zero.alias("end_token"), F.lit(None).cast("long").alias("container_id"))
    return out.unionByName(empty)


def fill(containers: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """containers, pieces, tokens, unused (share of the capacity)."""
    used = containers.filter("container_id is not null")
    n, t = F.countDistinct("container_id"), F.sum(F.col("end_token") - F.col("start_token")).cast("long")
    return used.agg(n.alias("containers"), F.count("*").alias("pieces"), t.alias("tokens"), F.round(1 - t / (n * capacity), 4).alias("unused"))
