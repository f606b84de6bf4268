"""What every job needs from the session: tables, a place to cut lineage, bounded broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Share of all rows from which a key counts as heavy. At most 1 / HEAVY_SHARE keys can reach it, which bounds
#: every broadcast of heavy keys, whatever the size of the data.
HEAVY_SHARE = 1 / 2000

#: A key with fewer rows than this is no burden for any task.
HEAVY_LEAST = 20_000

#: White space that is trimmed from keys.
BLANKS = " \t\r\n\x0b\x0c\xa0 ​　﻿"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The shared folder of the session (``spark.checkpoint.dir``). One of our own only where none is set and all tasks run on this machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        shared = spark.conf.get("sedgemill.work.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="sedgemill-", dir="/tmp")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        shared = f"file://{folder}"
        spark.conf.set("sedgemill.work.dir", shared)
    return shared.rstrip("/")


#: Tables of ``cut`` that have not been removed yet.
_written: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as a table into the shared folder and read it back: lineage ends there and survives lost executors.

    The table is removed by ``release``, or when the driver's interpreter ends.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[out] = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove tables of ``cut`` that nothing reads any more, as those of the round before in a loop; other tables are left alone."""
    for t in tables:
        path = _written.pop(t, None)
        if path:
            _remove(t.sparkSession, path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores, for work that costs much per row.

    A large table has more splits than that and stays where it is; only one that fits in fewer splits is moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone; what lies on this machine can still be removed
        if path.startswith(("file:", "/")):
            shutil.rmtree("/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def node_key(c: Column) -> Column:
    """Keys are equal after trimming, with ``.``, ``/`` and ``::`` as one separator; letter case counts."""
    return F.replace(F.replace(trimmed(c), F.lit("::"), F.lit("/")), F.lit("."), F.lit("/"))


def heavy_keys(df: DataFrame, key: str, share: float = HEAVY_SHARE, weight: str | None = None, least: int = HEAVY_LEAST, total: int | None = None) -> DataFrame:
    """The keys with at least ``share`` of all rows (of the sum of ``weight``, if ``df`` is pre-aggregated), as a local table.

    There are at most 1 / share of them, so the driver may hold them. A key with fewer than ``least`` rows is never heavy. Where the
    caller knows the number of rows, or a bound of it, ``total`` saves counting them, and anything at all if it is below ``least``.
    """
    n = F.sum(weight) if weight else F.count("*")
    if total is None:
        total = df.agg(n.alias("n")).first()["n"] or 0
    rows = []
    if total >= least:
        per_key = df.filter(F.col(key).isNotNull()).groupBy(key).agg(n.alias("_n"))
        rows = per_key.filter(F.col("_n") >= max(float(least), total * share)).select(key).collect()
    return df.sparkSession.createDataFrame(rows, df.select(key).schema) if rows else df.select(key).limit(0)


def lookup(facts: DataFrame, dim: DataFrame, key: str, heavy: DataFrame) -> DataFrame:
    """Left join of ``facts`` to ``dim`` (one row per ``key``), split so that no hot key reaches one task.

    ``heavy`` holds the keys with at least HEAVY_SHARE of the rows of ``facts`` (so at most 1 / HEAVY_SHARE of them): their rows
    of ``dim`` are broadcast, their rows of ``facts`` stay where they are. All others are shuffled on the key. No row is lost:
    a null key matches nothing and comes out with nulls.
    """
    if heavy.isEmpty():
        return facts.join(dim, key, "left")
    hot = dim.join(F.broadcast(heavy.select(key)), key, "left_semi")
    flagged = facts.join(F.broadcast(heavy.select(key, F.lit(True).alias("_hot"))), key, "left")
    wide = flagged.filter("_hot").drop("_hot").join(F.broadcast(hot), key, "left")
    rest = flagged.filter("_hot is null").drop("_hot").join(dim, key, "left")
    return wide.unionByName(rest)
