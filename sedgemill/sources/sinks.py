"""Sinks: unique edges, JSON-lines tables, encrypted files, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgemill.operators.ledger import first_per_key


def unique_edges(edges: DataFrame, order: str) -> DataFrame:
    """One edge per src, dst and type: the first by ``order``."""
    return first_per_key(edges.select("src", "dst", "type", "confidence", order), ["src", "dst", "type"], [order, "confidence"]).drop(order)


def write_jsonl(df: DataFrame, path: str, mode: str = "append") -> None:
    """Append rows as JSON lines; the commit protocol of the writer takes the place of a lock."""
    df.write.mode(mode).json(path)


def stamp(rows: DataFrame, src: str, at: str) -> DataFrame:
    """Rows of a profile or manifest with their source and time where they lack them."""
    return rows.withColumn("src", F.coalesce("src", F.lit(src))).withColumn("at", F.coalesce("at", F.lit(at)) if "at" in rows.columns else F.lit(at))


def encrypted(c: Column, key: str) -> Column:
    """AES-GCM under a 16, 24 or 32 byte key, as base64."""
    return F.base64(F.aes_encrypt(c, F.lit(key), F.lit("GCM")))


def decrypted(c: Column, key: str) -> Column:
    """The text again; null where it was tampered with."""
    return F.try_aes_decrypt(F.unbase64(c), F.lit(key), F.lit("GCM")).cast("string")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both by ``key``; a new row takes the place of an old one, of several new ones the greatest."""
    others = [c for c in old.columns if c != key]
    both = old.withColumn("_new", F.lit(0)).unionByName(new.select(*old.columns).withColumn("_new", F.lit(1)))
    best = F.max_by(F.struct(*others), F.struct("_new", *others)).alias("r")
    return both.groupBy(key).agg(best).select(key, "r.*")


def anti(new: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` whose key is not known yet, once."""
    return new.dropDuplicates([key]).join(known.select(key).distinct(), key, "left_anti")
