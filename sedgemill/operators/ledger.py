"""Dated facts and events: derivation, keyed deduplication, supersession, running values that survive hot keys.

Defined results: null keys form a group of their own in ``first_per_key`` and drop out of the running values (callers filter them);
ties go by the whole order given; repeated rows count again unless the caller takes distinct ones; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedgemill.functions import text as T


def facts(history: DataFrame) -> DataFrame:
    """src, n, date, kind, fact: summary sentences as events, attributes as attributes. Null dates and texts drop out; repeated rows count once."""
    rows = history.select("id", "date", "summary", "attrs").distinct()
    said = F.transform(T.sentences(F.coalesce("summary", F.lit(""))), lambda s: F.struct(F.lit("event").alias("kind"), s.alias("fact")))
    held = F.transform(F.coalesce("attrs", F.array().cast("array<string>")), lambda s: F.struct(F.lit("attribute").alias("kind"), s.alias("fact")))
    parts = rows.select(F.col("id").alias("src"), "date", F.posexplode(F.concat(said, held)).alias("n", "f"))
    return parts.select("src", (F.col("n") + 1).alias("n"), "date", "f.kind", "f.fact").filter("fact is not null")


def first_per_key(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order; combined before the shuffle, so that a hot key sends one row per task."""
    others = [c for c in rows.columns if c not in key]
    best = F.min_by(F.struct(*others), F.struct(*order)).alias("r")
    return rows.groupBy(*key).agg(best).select(*key, "r.*")


def fact_key(fact: Column) -> Column:
    """The first six content words, sorted."""
    return T.sorted_key(T.content_words(fact), 6)


def running_total(rows: DataFrame, key: str, bucket: str, order: list[str], value: str) -> DataFrame:
    """``rows`` with ``total``: the running sum of ``value`` per ``key`` in ``order``.

    Sums per key and bucket (a part of the order, such as the day) are added up first, so that each window holds one bucket of one
    key, or one row per bucket; a key with a third of all rows is spread over its buckets.
    """
    sums = rows.groupBy(key, bucket).agg(F.sum(value).alias("_s"))
    upto = Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(key, bucket, F.coalesce(F.sum("_s").over(upto), F.lit(0)).alias("_before"))
    within = Window.partitionBy(key, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(before, [key, bucket]).withColumn("total", F.col("_before") + F.sum(value).over(within)).drop("_before")


def previous(rows: DataFrame, key: str, bucket: str, order: list[str], columns: list[str]) -> DataFrame:
    """``rows`` with ``prev``: ``columns`` of the row before, per ``key`` in ``order``; spread over buckets like ``running_total``."""
    x = F.struct(*columns)
    last = rows.groupBy(key, bucket).agg(F.max_by(x, F.struct(*order)).alias("_last"))
    carried = last.select(key, bucket, F.lag("_last").over(Window.partitionBy(key).orderBy(bucket)).alias("_carried"))
    within = F.lag(x).over(Window.partitionBy(key, bucket).orderBy(*order))
    return rows.join(carried, [key, bucket]).withColumn("prev", F.coalesce(within, "_carried")).drop("_carried")


def running_best(rows: DataFrame, keys: list[str], bucket: str, order: list[str], value: str) -> DataFrame:
    """``rows`` with ``best``: the greatest ``value`` of all rows before, per ``keys`` in ``order``; spread over buckets like ``running_total``."""
    most = rows.groupBy(*keys, bucket).agg(F.max(value).alias("_m"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    carried = most.select(*keys, bucket, F.max("_m").over(before).alias("_carried"))
    within = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(carried, [*keys, bucket]).withColumn("best", F.greatest(F.max(value).over(within), "_carried")).drop("_carried")
