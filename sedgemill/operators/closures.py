"""Closures of many seeds without a table of pairs: every task holds the links and finds what its seeds reach, 64 of them at once, one bit each.

Nothing of a seed and a node is shuffled or written between; disk follows links and seeds, never pairs. A graph of more than LINKS distinct
links is searched by joins (``operators.graph.reach``) instead, with the same rows. All results are exact.

Defined results: null ends and null seeds are ignored; cycles end; seeds that no link names reach nothing; no seeds give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgemill.operators.graph import reach
from sedgemill.session import cut

#: Distinct links up to which a task holds the graph (4 bytes a link, and the names of its nodes).
LINKS = 10_000_000

#: Names in one array of ``reached``.
NAMES = 8_192


class Graph:
    """Nodes by their place in ``names``, which are in order: node i links to ``dst[at[i]:at[i + 1]]``."""

    def __init__(self, names: pa.Array, src: np.ndarray, dst: np.ndarray):
        self.names = names.cast(pa.string())
        self.dst = dst[np.argsort(src, kind="stable")].astype(np.int32)
        self.at = np.concatenate([[0], np.cumsum(np.bincount(src, minlength=len(names)))])

    def beyond(self, seeds: np.ndarray) -> np.ndarray:
        """Of every node which of up to 64 seeds reach it over one link or more: bit j stands for the j-th."""
        met, new = np.zeros(len(self.names), np.uint64), np.zeros(len(self.names), np.uint64)
        np.bitwise_or.at(new, seeds, np.uint64(1) << np.arange(len(seeds), dtype=np.uint64))
        front = np.unique(seeds)
        while len(front):
            bits, n = new[front], self.at[front + 1] - self.at[front]
            new[front] = 0
            to = self.dst[np.arange(n.sum()) + np.repeat(self.at[front] - np.cumsum(n) + n, n)]
            bits = np.repeat(bits, n) & ~met[to]
            to, bits = to[bits != 0], bits[bits != 0]
            np.bitwise_or.at(new, to, bits)
            front = np.unique(to) if len(to) < len(new) // 16 else np.flatnonzero(new)
            met[front] |= new[front]
        return met


def _held(links: DataFrame) -> Graph | None:
    """The graph of ``links`` (distinct src, dst); None if it is too large. Names travel once, links as hashes of them."""
    if links.count() > LINKS:
        return None
    nodes = links.select(F.explode(F.array("src", "dst")).alias("name")).distinct().select("name", F.xxhash64("name").alias("h")).toArrow()
    names = nodes.column("name").combine_chunks()
    order = pc.sort_indices(names)
    hashes = nodes.column("h").to_numpy()[order.to_numpy()]
    by = np.argsort(hashes)
    if (np.diff(hashes[by]) == 0).any():  # two names of one hash
        return None
    ends = links.select(F.xxhash64("src").alias("src"), F.xxhash64("dst").alias("dst")).toArrow()
    src, dst = (by[np.searchsorted(hashes[by], ends.column(c).to_numpy())] if len(by) else np.zeros(0, np.int64) for c in ("src", "dst"))
    return Graph(names.take(order), src, dst)


def _blocks(batches: Iterator[pa.RecordBatch], graph: Graph) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Seeds, 64 at a time, their nodes (-1: none) and what is beyond them."""
    seeds = [x for b in batches for x in b.column(0).to_pylist()]
    nodes = pc.fill_null(pc.index_in(pa.array(seeds, pa.string()), value_set=graph.names), -1).to_numpy(zero_copy_only=False)
    order = np.argsort(nodes, kind="stable")
    known = order[nodes[order] >= 0]
    for block in (known[k : k + 64] for k in range(0, len(known), 64)):
        yield [seeds[i] for i in block], nodes[block], graph.beyond(nodes[block])
    if len(known) < len(seeds):
        rest = order[: len(seeds) - len(known)]
        yield [seeds[i] for i in rest], nodes[rest], np.zeros(0, np.uint64)


def _counter(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = held.value
        for seeds, nodes, met in _blocks(batches, graph):
            hit = np.flatnonzero(met)
            counts, first = np.zeros(len(seeds), np.int64), np.full(len(seeds), -1)
            for part in (hit[k : k + 65_536] for k in range(0, len(hit), 65_536)):
                bits = np.unpackbits(met[part].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, : len(seeds)]
                new = (first < 0) & bits.any(axis=0)
                first[new] = part[bits.argmax(axis=0)[new]]
                counts += bits.sum(axis=0, dtype=np.int64)
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([seeds[j] for j in some], pa.string()), pa.array(counts[some]), graph.names.take(pa.array(first[some]))], ["seed", "affected", "first_affected"])

    return run


def _lister(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = held.value
        for seeds, nodes, met in _blocks(batches, graph):
            for j, (seed, node) in enumerate(zip(seeds, nodes.tolist())):
                if node < 0:
                    yield pa.RecordBatch.from_arrays([pa.array([seed], pa.string()), pa.array([[seed]], pa.list_(pa.string()))], ["seed", "nodes"])
                    continue
                bit = np.uint64(1) << np.uint64(j)
                own = met[node]
                met[node] = own | bit
                hit = np.flatnonzero(met & bit)
                met[node] = own
                at = np.append(np.arange(0, len(hit), NAMES), len(hit)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), graph.names.take(pa.array(hit)))
                yield pa.RecordBatch.from_arrays([pa.array([seed] * len(lists), pa.string()), lists], ["seed", "nodes"])

    return run


def _search(seeds: DataFrame, graph: Graph, runner, schema: str) -> DataFrame:
    sc = seeds.sparkSession.sparkContext
    seeds = cut(seeds, "seeds")
    parts = max(sc.defaultParallelism, min(16 * sc.defaultParallelism, -(-seeds.count() // 64)))
    return seeds.repartition(parts).mapInArrow(runner(sc.broadcast(graph)), schema)


def _given(seeds: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    return seeds.select("seed").filter("seed is not null").distinct(), cut(edges.select("src", "dst").filter("src is not null and dst is not null").distinct(), "links")


def count_beyond(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """seed, affected, first_affected: how many nodes each of ``seeds`` (seed) reaches over one of ``edges`` (src, dst) or more, and the first of them; seeds that reach none do not come out."""
    seeds, links = _given(seeds, edges)
    graph = _held(links)
    if graph is None:
        next_ = seeds.join(links, F.col("seed") == F.col("src")).select("seed", F.col("dst").alias("node"))
        return reach(next_, links).groupBy("seed").agg(F.count("*").alias("affected"), F.min("node").alias("first_affected"))
    return _search(seeds, graph, _counter, "seed string, affected long, first_affected string")


def reached(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """seed, node: each of ``seeds`` (seed) itself and all that it reaches over ``edges`` (src, dst), each pair once."""
    seeds, links = _given(seeds, edges)
    graph = _held(links)
    if graph is None:
        return reach(seeds.select("seed", F.col("seed").alias("node")), links).select("seed", "node")
    return _search(seeds, graph, _lister, "seed string, nodes array<string>").select("seed", F.explode("nodes").alias("node"))
