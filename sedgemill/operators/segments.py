"""Ordered parts of documents: greedy segments under a token budget, even samples of them, headed parts.

Defined results: null texts have no parts; an empty text is one empty segment and no headed part; repeated rows give their parts
again; a document's parts are built within its row or its own group, so memory is bounded by the longest text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedgemill.functions.text import estimated_tokens, slug


def paragraphs(c: Column) -> Column:
    return F.split(F.regexp_replace(c, "\r\n", "\n"), "\n\n+")


def packed_segments(documents: DataFrame, budget: int = 800) -> DataFrame:
    """doc_id, segment, n_tokens, paragraphs: a segment closes when the next paragraph would exceed the budget.

    A paragraph longer than the budget is a segment of its own; null texts have none.
    """
    costs = F.transform(paragraphs(F.col("text")), estimated_tokens)
    start = F.struct(F.array().cast("array<struct<t:bigint,n:bigint>>").alias("done"), F.lit(0).cast("long").alias("t"), F.lit(0).cast("long").alias("n"))

    def step(acc, cost):
        closes = (acc["n"] > 0) & (acc["t"] + cost > budget)
        closed = F.struct(acc["t"].alias("t"), acc["n"].alias("n"))
        done = F.when(closes, F.concat(acc["done"], F.array(closed))).otherwise(acc["done"])
        t = F.when(closes, cost).otherwise(acc["t"] + cost)
        return F.struct(done.alias("done"), t.alias("t"), F.when(closes, F.lit(1).cast("long")).otherwise(acc["n"] + 1).alias("n"))

    last = lambda acc: F.concat(acc["done"], F.array(F.struct(acc["t"].alias("t"), acc["n"].alias("n"))))
    parts = documents.filter("text is not null").select("doc_id", F.posexplode(F.aggregate(costs, start, step, last)).alias("i", "s"))
    return parts.select("doc_id", (F.col("i") + 1).alias("segment"), F.col("s.t").alias("n_tokens"), F.col("s.n").alias("paragraphs"))


def sampled_segments(documents: DataFrame, budget: int = 800, cap: int = 25_000) -> DataFrame:
    """The segments that stay when a document is cut to ``cap`` tokens: first, middle and last, then evenly spaced ones while they fit.

    doc_id, segment, n_tokens, gap (something was left out before it).
    """
    parts = packed_segments(documents, budget)
    doc = Window.partitionBy("doc_id")
    n, at = F.count("*").over(doc), F.col("segment")
    # order of preference: the ends, the middle, then by how evenly a segment halves the rest (bit reversal of its place)
    middle = F.floor(n / 2) + 1
    rank = F.when(at == 1, 0).when(at == n, 1).when(at == middle, 2).otherwise(3 + F.reverse(F.lpad(F.bin(at), 20, "0")).cast("decimal(20,0)"))
    ranked = parts.withColumn("pref", rank)
    used = F.sum("n_tokens").over(doc.orderBy("pref", "segment").rowsBetween(Window.unboundedPreceding, 0))
    kept = ranked.withColumn("used", used).filter((F.col("used") <= cap) | (F.col("pref") == 0))
    before = F.lag("segment").over(doc.orderBy("segment"))
    return kept.select("doc_id", "segment", "n_tokens", (F.coalesce(before, F.lit(0)) + 1 < F.col("segment")).alias("gap"))


def heading_segments(documents: DataFrame) -> DataFrame:
    """doc_id, n, segment_id (``doc#slug``), title, body: parts by heading lines; what comes before the first one is part 0, empty parts drop out."""
    lines = documents.filter("text is not null").select("doc_id", F.posexplode(F.split(F.regexp_replace("text", "\r\n", "\n"), "\n")).alias("at", "line"))
    heading = F.regexp_extract("line", r"^#{1,6}\s+(.*)$", 1)
    marked = lines.withColumn("heading", F.when(F.col("line").rlike(r"^#{1,6}\s+"), heading))
    upto = Window.partitionBy("doc_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    numbered = marked.withColumn("n", F.count("heading").over(upto)).withColumn("title", F.last("heading", ignorenulls=True).over(upto))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("heading").isNull(), F.struct("at", "line")))), lambda x: x["line"]), "\n")
    grouped = numbered.groupBy("doc_id", "n", "title").agg(F.btrim(body, F.lit(" \t\n")).alias("body")).filter("body <> ''")
    return grouped.withColumn("segment_id", F.concat_ws("#", "doc_id", slug(F.coalesce("title", F.lit("start")))))
