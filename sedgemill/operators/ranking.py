"""Ranking: weighted overlap, BM25 over candidates, fields with weights, fusion of ranks, vectors, cut-offs.

Searches over whole tables score blocks of questions inside the tasks (``operators.blocked``), so no table of pairs is ever written. ``bm25`` and
``best_sums`` give the pairs themselves, by joins of term tables. Vectors are searched in blocks of queries by matrix products with a running top k.

Defined results: null texts and arrays count as empty; questions without known terms have no hits; repeated entries count once where
the caller takes distinct rows; ties go by id; an empty collection gives no rows; very long texts only lengthen their postings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedgemill.functions import text as T
from sedgemill.operators.blocked import best
from sedgemill.session import cut

K1, B = 1.5, 0.75


def top(scored: DataFrame, by: str, score: str, tie: str, k: int) -> DataFrame:
    """The k best rows per ``by``; ties in the order of ``tie``."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), tie))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


#: A term that joins at least so many pairs of an entry and a question is not multiplied out if the others settle the result.
HOT_PAIRS = 2_000_000


def best_sums(parts: DataFrame, wanted: DataFrame, query: str, doc: str, k: int | None = None, share: float = 0.0, pairs: int = HOT_PAIRS) -> DataFrame:
    """query, doc, score: sums of ``w * x`` over the terms that a question (query, term, w, most) and an entry (doc, term, x) share.

    All entries come out that can be among the ``k`` best of a question, or reach ``share`` of its best one, and each with its whole sum.
    ``most`` bounds ``w * x``. Where the sums of the other terms already give a threshold above what all hot terms can add, an
    entry with hot terms only cannot reach it: the hot terms are then looked up for the candidates, instead of joining their postings.
    Questions without such a threshold are joined as a whole.
    """
    total = F.sum(F.col("w") * F.col("x"))
    asks = wanted.groupBy("term").agg(F.count("*").alias("asks"))
    hot = cut(parts.groupBy("term").agg(F.count("*").alias("df")).join(asks, "term").filter(F.col("df") * F.col("asks") >= pairs).select("term"), "hot")
    if hot.isEmpty():
        return parts.join(wanted, "term").groupBy(query, doc).agg(total.alias("score"))
    of_hot = wanted.join(hot, "term", "left_semi")
    first = cut(parts.join(wanted.join(hot, "term", "left_anti"), "term").groupBy(query, doc).agg(total.alias("s")), "first")
    if k:
        rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("s")))
        bar = first.select(query, "s", rank.alias("r")).filter(F.col("r") <= k).groupBy(query).agg(F.min("s").alias("bar"), F.count("*").alias("n")).filter(F.col("n") == k)
    else:
        bar = first.groupBy(query).agg((F.max("s") * share).alias("bar"))
    bounds = wanted.select(query).distinct().join(of_hot.groupBy(query).agg(F.sum("most").alias("rest")), query, "left").join(bar.select(query, "bar"), query, "left")
    bounds = cut(bounds.select(query, "bar", F.coalesce("rest", F.lit(0.0)).alias("rest")), "bounds")
    settled = (F.col("rest") == 0) | (F.coalesce(F.col("bar"), F.lit(-1.0)) > F.col("rest") + 1e-5)
    # a little is left for sums in another order
    near = first.join(bounds.filter(settled), query).filter(F.col("bar").isNull() | (F.col("s") + F.col("rest") >= F.col("bar") * (1 - 1e-9) - 1e-5)).select(query, doc, "s")
    added = near.select(query, doc).join(parts.join(hot, "term", "left_semi"), doc).join(of_hot, [query, "term"]).groupBy(query, doc).agg(total.alias("h"))
    done = near.join(added, [query, doc], "left").select(query, doc, (F.col("s") + F.coalesce("h", F.lit(0))).alias("score"))
    whole = parts.join(wanted.join(bounds.filter(~settled), query, "left_semi"), "term").groupBy(query, doc).agg(total.alias("score"))
    return done.unionByName(whole)


def whole(rows: DataFrame, doc: str, *others: str) -> DataFrame:
    """doc, terms, dl and copies, total, others: rows of one ``doc`` (doc, terms, dl) as one, with all terms, the length of one of them, their number, their lengths and sets of ``others``."""
    sets = [F.collect_set(c).alias(c) for c in others]
    return rows.groupBy(doc).agg(F.flatten(F.collect_list("terms")).alias("terms"), F.first("dl").alias("dl"), F.count("*").alias("copies"), F.sum("dl").alias("total"), *sets)


def document_counts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """term, df: in how many rows of ``docs`` (terms) each asked term is."""
    return docs.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("df")).join(wanted.select("term").distinct(), "term", "left_semi")


def rarity(n_docs: int) -> Column:
    return F.greatest(F.lit(1e-6), F.log1p((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5)))


def searched(docs: DataFrame, wanted: DataFrame, query: str, k1: float = K1, b: float = B) -> tuple[DataFrame, Callable]:
    """For BM25 over ``docs`` (of ``whole``): query, term, w of ``wanted`` (query, term, n), and how a task weighs counts and lengths."""
    r = docs.agg(F.sum("copies").alias("n"), F.sum("total").alias("total")).first()
    n, mean = r["n"] or 0, (r["total"] or 0) / (r["n"] or 1) or 1.0
    weighted = cut(wanted.join(document_counts(docs, wanted), "term").select(query, "term", (F.col("n") * rarity(n)).alias("w")), "asked")
    return weighted, lambda tf, dl: tf * (k1 + 1) / (tf + k1 * (1 - b + b * (dl / mean)))


def half_bars(docs: DataFrame, weighted: DataFrame, query: str, doc: str, weigh: Callable, share: float = 0.5) -> DataFrame:
    """``weighted`` with ``best``, the best score of each question, and ``least``, that share of it, above 0."""
    tops = best(docs, weighted, query, [doc], 1, weigh=weigh).groupBy(query).agg(F.max("score").alias("best"))
    return cut(weighted.join(tops.select(query, "best", F.round(share * F.col("best"), 6).alias("least")), query), "bars")


def entry_words(entries: DataFrame) -> DataFrame:
    """id, terms, v: the words of each entry and how much each counts: once in title and summary, twice in topics, three times in entities and attributes."""
    none = F.array().cast("array<string>")
    fields = [
        (1.0, F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")))),
        (2.0, F.array_join(F.coalesce("topics", none), " ")),
        (3.0, F.array_join(F.concat(F.coalesce("entities", none), F.coalesce("attrs", none)), " ")),
    ]
    weighted = lambda n, c: F.transform(F.array_distinct(T.content_words(c)), lambda w: F.struct(w.alias("w"), F.lit(n).alias("v")))
    words = F.flatten(F.array(*[weighted(n, c) for n, c in fields]))
    rows = entries.select("id", "title", "summary", "topics", "entities", "attrs").distinct().select("id", words.alias("x"))
    return rows.groupBy("id").agg(F.flatten(F.collect_list("x")).alias("x")).select("id", F.col("x.w").alias("terms"), F.col("x.v").alias("v"))


def asked_words(asked: DataFrame) -> DataFrame:
    """item_id, term, w: the distinct content words of each question."""
    return asked.select("item_id", F.explode(F.array_distinct(T.content_words(F.col("question")))).alias("term")).groupBy("item_id", "term").agg(F.count("*").cast("double").alias("w"))


def entry_scores(entries: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """item_id, id, score: weighted overlap of the words of a question and an entry, of all that can be among the ``k`` best."""
    return best(entry_words(entries), cut(asked_words(asked), "asked"), "item_id", ["id"], k).withColumn("score", F.col("score").cast("long"))


def postings(docs: DataFrame, doc: str, tokens: Column, only: DataFrame | None = None) -> DataFrame:
    """doc, term, tf, dl of every document (``docs`` has one row per ``doc``); with ``only``, of its terms, before anything is shuffled."""
    counted = docs.select(doc, tokens.alias("t")).select(doc, F.size("t").alias("dl"), F.explode("t").alias("term"))
    if only is not None:
        counted = counted.join(only.select("term").distinct(), "term", "left_semi")
    return counted.groupBy(doc, "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def bm25(terms: DataFrame, doc: str, n_docs: int, mean_length: float, wanted: DataFrame, query: str, k: int | None = None, share: float = 0.0, k1: float = K1, b: float = B) -> DataFrame:
    """query, doc, score of the entries that can be among the ``k`` best of a question, or reach ``share`` of its best score (0: all).

    ``wanted``: query, term, n (how often it is asked). Every repetition of an asked term counts. ``terms`` are the postings of the
    asked terms at least; they are written once and read for frequencies and scores.
    """
    wanted = cut(wanted, "wanted")
    asked = cut(terms.join(wanted.select("term").distinct(), "term", "left_semi"), "postings")
    df = asked.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.greatest(F.lit(1e-6), F.log1p((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    norm = k1 * (1 - b + b * (F.col("dl") / F.lit(mean_length)))
    weighted = wanted.join(df.select("term", idf.alias("idf")), "term").select(query, "term", (F.col("n") * F.col("idf")).alias("w"), (F.col("n") * F.col("idf") * (k1 + 1)).alias("most"))
    parts = asked.select(doc, "term", (F.col("tf") * (k1 + 1) / (F.col("tf") + norm)).alias("x"))
    if k is None and not share:
        return parts.join(weighted, "term").groupBy(query, doc).agg(F.sum(F.col("w") * F.col("x")).alias("score"))
    return best_sums(parts, weighted, query, doc, k, share)


def collection_size(docs: DataFrame, tokens: Column) -> tuple[int, float]:
    """Number of documents and their mean length in tokens."""
    r = docs.agg(F.count("*").alias("n"), F.avg(F.size(tokens)).alias("mean")).first()
    return r["n"], r["mean"] or 1.0


def reciprocal_fusion(rankings: list[DataFrame], by: str, doc: str) -> DataFrame:
    """Sum of 1 / rank over several rankings (by, doc, rank)."""
    parts = [r.select(by, doc, (1.0 / F.col("rank")).alias("s")) for r in rankings]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy(by, doc).agg(F.round(F.sum("s"), 6).alias("score"))


#: Queries that are held by each task at once.
QUERY_BLOCK = 4_000


def _units(rows: list) -> np.ndarray:
    m = np.array(rows, np.float64)
    norm = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _cosines(vectors: list, queries: list) -> np.ndarray:
    """Cosine of every vector (rows) with every query (columns) over the shorter length; 0 where a length is 0."""
    out = np.zeros((len(vectors), len(queries)))
    for a in {len(v) for v in vectors}:
        for b in {len(q) for q in queries}:
            i, j, n = [k for k, v in enumerate(vectors) if len(v) == a], [k for k, q in enumerate(queries) if len(q) == b], min(a, b)
            if n:
                out[np.ix_(i, j)] = _units([vectors[k][:n] for k in i]) @ _units([queries[k][:n] for k in j]).T
    return np.round(out, 6)


def _blocks(queries: DataFrame, block: int) -> Iterator[tuple[list, list]]:
    """ids and vectors of the queries, at most about ``block`` at a time."""
    n = max(1, -(-queries.count() // block))
    for k in range(n):
        rows = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(n)) == k).select("query_id", "q").collect()
        yield [r["query_id"] for r in rows], [list(r["q"]) for r in rows]


def nearest(vectors: DataFrame, queries: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, vec_id, score, rank: the ``k`` vectors (vec_id, embedding) most similar to each query (query_id, q) but itself; ties by vec_id.

    Exact. The query set may grow with the data, so it is taken in blocks; each task multiplies its vectors with a block, batch by batch, keeps the k
    best of each query, and only these are shuffled.
    """
    out = None
    for ids, qs in _blocks(queries, block):
        part = vectors.select("vec_id", "embedding").mapInPandas(_search(np.array(ids), qs, k), "query_id long, vec_id long, score double")
        out = part if out is None else out.unionByName(part)
    return top(out, "query_id", "score", "vec_id", k)


def _search(ids: np.ndarray, qs: list, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = [(np.zeros(0), np.zeros(0, np.int64))] * len(ids)
        for batch in batches:
            vec = batch["vec_id"].to_numpy()
            scores = _cosines(list(batch["embedding"]), qs)
            for j, query in enumerate(ids):
                s, kept = scores[:, j], vec != query
                held, names = best[j]
                if len(held) == k:
                    kept &= s >= held[-1]
                s, v = np.r_[held, s[kept]], np.r_[names, vec[kept]]
                order = np.lexsort((v, -s))[:k]
                best[j] = s[order], v[order]
        for query, (s, v) in zip(ids, best):
            if len(s):
                yield pd.DataFrame({"query_id": query, "vec_id": v, "score": s})

    return run


def similar_counts(vectors: DataFrame, queries: DataFrame, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, hits: how many vectors but itself reach the ``least`` score of each query (query_id, q, least). Counted in the tasks."""
    out = None
    n = max(1, -(-queries.count() // block))
    for b in range(n):
        rows = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(n)) == b).select("query_id", "q", "least").collect()
        ids, qs, least = np.array([r["query_id"] for r in rows]), [list(r["q"]) for r in rows], np.array([r["least"] for r in rows])

        def run(batches: Iterator[pd.DataFrame], ids=ids, qs=qs, least=least) -> Iterator[pd.DataFrame]:
            hits = np.zeros(len(ids), np.int64)
            for batch in batches:
                reached = _cosines(list(batch["embedding"]), qs) >= least
                hits += (reached & (batch["vec_id"].to_numpy()[:, None] != ids)).sum(0)
            yield pd.DataFrame({"query_id": ids, "hits": hits})

        part = vectors.select("vec_id", "embedding").mapInPandas(run, "query_id long, hits long")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("query_id").agg(F.sum("hits").alias("hits"))


def _grams(c: Column) -> Column:
    """Distinct substrings of three characters; a shorter text is one."""
    return T.shingles(c, 3)


def contained_words(rows: DataFrame, words: DataFrame) -> DataFrame:
    """id, word: which of the distinct ``words`` (word) occur anywhere in ``body`` of the rows (id, body).

    Every word is looked up by the rarest of its runs of three characters (shorter words by all runs that hold them); only those rows that share it are compared.
    """
    words = cut(words.filter("word <> ''").distinct(), "words")
    rows = rows.select("id", "body").filter("body is not null")
    short = words.filter("length(word) < 3")
    of_words = words.select("word", F.explode(_grams(F.col("word"))).alias("gram"))
    parts = rows.select("id", F.explode(_grams(F.col("body"))).alias("gram"))
    used = of_words.select("gram").distinct()
    held = parts.join(used, "gram", "left_semi")
    if not short.isEmpty():
        # one or two characters: each row lists the runs of that length, too
        runs = lambda n: F.when(F.length("body") >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("body") - (n - 1)), lambda i: F.substring("body", i, F.lit(n))))).otherwise(F.array().cast("array<string>"))
        held = held.unionByName(rows.select("id", F.explode(F.array_union(runs(1), runs(2))).alias("gram")).join(used, "gram", "left_semi")).distinct()
    held = cut(held, "grams")
    df = held.groupBy("gram").agg(F.count("*").alias("df"))
    rarest = of_words.join(df, "gram", "left").groupBy("word").agg(F.min_by("gram", F.struct(F.coalesce("df", F.lit(0)), "gram")).alias("gram"))
    candidates = rarest.join(held, "gram").select("id", "word")
    return candidates.join(rows, "id").filter(F.contains("body", "word")).select("id", "word")
