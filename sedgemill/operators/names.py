"""Names that are nearly the same: MinHash bands find candidates, Jaro-Winkler decides, links make groups.

Names are compared by their key (small letters, no underscores and hyphens, last dotted part); names of one key are copies of each other
and count as one. Names whose digits differ are never the same (``item1``, ``item2``). A bucket of at most SMALL names is compared as it is, so
that a name meets a bounded number of others. A larger one is split by further hashes, in FANS ways at once, so that what is similar
still meets; what stays large after LEVELS of that is nearly identical: there names meet the representative of their bucket only, those that it
does not take meet the next one. Groups are the connected components of the links. No bucket is ever multiplied out or cut.

BANDS and ROWS are chosen for short names: of all pairs that Jaro-Winkler accepts, over 0.9 come into one group (``tests/test_names.py``).

Defined results: null and empty names and those in double underscores are left out; repeated names count in ``names``; no names give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType

from sedgemill.functions import text as T
from sedgemill.operators.graph import components
from sedgemill.session import cut, heavy_keys, lookup, release, spread

BANDS, ROWS = 32, 2
SAME = 0.9
SMALL, FANS, LEVELS = 256, 4, 2


def jaro(a: str, b: str) -> float:
    """Share of characters that match within half the longer length, and of those in order."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach, free, matched = max(len(a), len(b)) // 2 - 1, list(b), []
    for i, c in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(i + reach + 1, len(b))) if free[j] == c), None)
        if j is not None:
            free[j] = ""
            matched.append(c)
    if not matched:
        return 0.0
    m, others = len(matched), [c for c, f in zip(b, free) if not f]
    moved = sum(x != y for x, y in zip(matched, others)) / 2
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    """``jaro``, raised by a tenth of what is missing for each of up to four equal first characters."""
    j = jaro(a, b)
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(4, len(a), len(b)))
    return j + 0.1 * prefix * (1 - j)


def _similarities(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler(x, y) for x, y in zip(a, b)], dtype="float64")


def similarity(a: Column | str, b: Column | str) -> Column:
    """Jaro-Winkler of two texts; null if one is null."""
    return F.pandas_udf(_similarities, DoubleType())(a, b)


def same(a: str, b: str) -> bool:
    """Whether ``jaro_winkler`` reaches SAME; most pairs are refused by how many characters they share at all, which bounds those that match."""
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(4, len(a), len(b)))
    m = sum(min(a.count(c), b.count(c)) for c in set(a))
    bound = (m / len(a) + m / len(b) + 1) / 3 if m else 0.0
    return bound + 0.1 * prefix * (1 - bound) >= SAME and jaro_winkler(a, b) >= SAME


def _same(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([same(x, y) for x, y in zip(a, b)], dtype="bool")


def are_same(a: str, b: str) -> Column:
    return F.pandas_udf(_same, BooleanType())(a, b)


#: Pairs whose characters are counted at once.
PAIRS = 200_000


def _pairs(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs within groups of ``sizes`` that follow each other, some at a time."""
    starts = np.cumsum(np.r_[0, sizes[:-1]])
    for size in np.unique(sizes[sizes > 1]):
        i, j = np.triu_indices(size, 1)
        of = starts[sizes == size]
        step = max(1, PAIRS // len(i))
        for k in range(0, len(of), step):
            part = of[k : k + step, None]
            yield (part + i).ravel(), (part + j).ravel()


#: Longer names are compared one pair at a time.
LONG = 64


def jaro_winklers(a: np.ndarray, b: np.ndarray, n: np.ndarray, o: np.ndarray) -> np.ndarray:
    """``jaro_winkler`` of each row of ``a`` (code points, ``n`` of them, then zeros) with that of ``b``; the rows are not equal."""
    reach = np.maximum(n, o) // 2 - 1
    free, matched = np.ones(b.shape, bool), np.zeros(a.shape, bool)
    most = int(reach.max(initial=-1))
    for i in range(a.shape[1]):
        for j in range(max(0, i - most), min(i + most + 1, b.shape[1])):
            hit = (a[:, i] == b[:, j]) & (a[:, i] > 0) & (abs(i - j) <= reach) & free[:, j] & ~matched[:, i]
            free[:, j] &= ~hit
            matched[:, i] |= hit
    m = matched.sum(1)
    x = np.take_along_axis(a, np.argsort(~matched, axis=1, kind="stable"), 1)
    y = np.take_along_axis(b, np.argsort(free, axis=1, kind="stable"), 1)
    width = min(x.shape[1], y.shape[1])
    moved = ((x[:, :width] != y[:, :width]) & (np.arange(width) < m[:, None])).sum(1) / 2
    some = np.maximum(m, 1)
    j = np.where(m > 0, (m / n + m / o + (m - moved) / some) / 3, 0.0)
    prefix = np.cumprod((a[:, :4] == b[:, :4]) & (a[:, :4] > 0), axis=1).sum(1)
    return j + 0.1 * prefix * (1 - j)


def linked(buckets: list[list[str]]) -> set[tuple[str, str]]:
    """key, rep (the smaller one): the pairs within the buckets that are the same; as ``same`` finds them, with the bounds of all pairs computed together."""
    names, flat = np.unique(np.array([k for b in buckets for k in b], dtype=object), return_inverse=True)
    sizes = np.array([len(b) for b in buckets])
    letters = {c: i for i, c in enumerate(sorted({c for k in names for c in k}))}
    length, codes_of = np.array([len(k) for k in names]), np.zeros((len(names), LONG), np.int32)
    # characters beyond the 63 first ones are counted as if they were one, which only raises the bound
    counts = np.zeros((len(names), min(len(letters), 64)), np.int16)
    for n, k in enumerate(names):
        for c in k:
            counts[n, min(letters[c], 63)] += 1
        codes_of[n, : len(k[:LONG])] = [ord(c) + 1 for c in k[:LONG]]
    head, found = codes_of[:, :4], set()
    for i, j in _pairs(sizes):
        codes = np.unique(np.minimum(flat[i], flat[j]) * len(names) + np.maximum(flat[i], flat[j]))
        i, j = codes // len(names), codes % len(names)
        # even with all characters of the shorter one and a prefix of four
        least, most = np.minimum(length[i], length[j]), np.maximum(length[i], length[j])
        near = (i != j) & ((2 + least / most) / 3 * 0.6 + 0.4 >= SAME - 1e-9)
        i, j, most = i[near], j[near], most[near]
        m = np.minimum(counts[i], counts[j]).sum(1)
        bound = np.where(m > 0, (m / length[i] + m / length[j] + 1) / 3, 0.0)
        prefix = np.cumprod((head[i] == head[j]) & (head[i] > 0), axis=1).sum(1)
        near = bound + 0.1 * prefix * (1 - bound) >= SAME - 1e-9
        i, j = i[near], j[near]
        short = most[near] <= LONG
        kept = np.zeros(len(i), bool)
        for width in range(8, LONG + 1, 8):
            of = np.flatnonzero(short & (most[near] <= width) & (most[near] > width - 8))
            if len(of):
                kept[of] = jaro_winklers(codes_of[j[of], :width], codes_of[i[of], :width], length[j[of]], length[i[of]]) >= SAME
        kept[~short] = [same(names[y], names[x]) for x, y in zip(i[~short], j[~short])]
        found.update((names[y], names[x]) for x, y in zip(i[kept].tolist(), j[kept].tolist()))
    return found


def _links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows sorted by bucket; the last bucket of a batch waits for the next one."""
    last, held = None, []

    def out(buckets: list) -> pd.DataFrame:
        return pd.DataFrame(sorted(linked(buckets)) if buckets else [], columns=["key", "rep"], dtype=object)

    for batch in batches:
        done = []
        for bucket, keys in batch.groupby("bucket", sort=False)["key"]:
            if bucket == last:
                held += keys.tolist()
            else:
                done.append(held)
                last, held = bucket, keys.tolist()
        yield out([b for b in done if len(b) > 1])
    yield out([held] if len(held) > 1 else [])


def links_within(rows: DataFrame) -> DataFrame:
    """key, rep: the pairs of keys of one bucket (bucket, key) that are the same. Pairs live in the tasks only."""
    n = max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.select("bucket", "key").repartition(n, "bucket").sortWithinPartitions("bucket").mapInPandas(_links, "key string, rep string").distinct()


def signature(shingles: Column, n: int = BANDS * ROWS) -> Column:
    """The least hash of all shingles under each of ``n`` seeds."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, i))))


def buckets(keys: DataFrame) -> DataFrame:
    """bucket, key, s (its signature): where each key meets others with the same digits."""
    signed = spread(keys.select("key")).select("key", F.regexp_replace("key", "[^0-9]", "").alias("digits"), signature(T.shingles(F.col("key"))).alias("s"))
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.slice("s", i * ROWS + 1, F.lit(ROWS)), "digits"))
    return signed.select("key", "s", F.explode(F.array_distinct(bands)).alias("bucket"))


def sized(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of buckets of 2 to SMALL keys, and those of larger ones."""
    n = rows.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    few, many = n.filter(F.col("n") <= SMALL).select("bucket"), n.filter(F.col("n") > SMALL).select("bucket")
    return rows.join(few, "bucket", "left_semi"), rows.join(many, "bucket", "left_semi")


def taken_by_first(left: DataFrame) -> list[DataFrame]:
    """key, rep: links to the representatives of buckets (bucket, key) that no hash splits."""
    links = []
    while n := left.count():
        first = left.groupBy("bucket").agg(F.min("key").alias("rep"))
        met = cut(lookup(left, first, "bucket", heavy_keys(left, "bucket", total=n)).filter("key <> rep"), "met")
        taken = cut(met.select("key", "rep").distinct().filter(are_same("key", "rep")), "taken")
        links.append(taken)
        rest = cut(met.join(taken, ["key", "rep"], "left_anti").select("bucket", "key"), "buckets")
        release(left, met)
        left = rest
    return links


def name_links(keys: DataFrame) -> DataFrame:
    """key, rep: pairs of keys that are the same, enough of them to hold their groups together."""
    rows, links = cut(buckets(keys), "buckets"), []
    for level in range(LEVELS + 1):
        few, many = sized(rows)
        links.append(links_within(few))
        if many.isEmpty():
            break
        if level == LEVELS:
            links += taken_by_first(cut(many.select("bucket", "key"), "buckets"))
            break
        fan = lambda j: F.xxhash64("bucket", F.lit(j), F.get("s", F.pmod(F.hash("bucket", F.lit(level * FANS + j)), F.lit(BANDS * ROWS))))  # noqa: B023, E731
        rows = cut(many.select("key", "s", F.explode(F.array_distinct(F.array(*[fan(j) for j in range(FANS)]))).alias("bucket")), "buckets")
    out = links[0]
    for x in links[1:]:
        out = out.unionByName(x)
    return out.distinct()


def similar_names(names: DataFrame) -> DataFrame:
    """key, group_id (the smallest key of its group), names (how many rows have it), links (how many representatives took it or were linked to it)."""
    plain = names.filter("name <> '' and not (name like '\\\\_\\\\_%' and name like '%\\\\_\\\\_')")
    counted = cut(plain.groupBy(T.label_key(F.col("name")).alias("key")).agg(F.count("*").alias("names")).filter("key <> ''"), "names")
    links = cut(name_links(counted), "links")
    grouped = components(links.select(F.col("key").alias("src"), F.col("rep").alias("dst"))).select(F.col("node").alias("key"), F.col("component").alias("group_id"))
    degree = links.select(F.explode(F.array("key", "rep")).alias("key")).groupBy("key").agg(F.count("*").alias("links"))
    joined = counted.join(grouped, "key", "left").join(degree, "key", "left")
    return joined.select("key", F.coalesce("group_id", "key").alias("group_id"), "names", F.coalesce("links", F.lit(0)).alias("links"))
