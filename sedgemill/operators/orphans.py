"""References to records that do not exist: missing, deleted or late targets of ``edges`` and ``symbols``.

Method: skew-aware split.

1. References are pre-aggregated per key and month (number, first and last time), target rows per key (first birth and first death), all
   before anything is shuffled. Both meet once per key and month: references from the first birth on and before the first death are fine,
   and spots that hold no others drop out. The ``suspects`` that are left are far fewer than the references.
2. References meet only the suspects: those of heavy spots by broadcast, the rest after a shuffle. A key without any target row is
   missing, before the first birth a reference is late.
3. What comes after a first death is decided by running sums over the births, deaths and references of one key and hour, which
   start from the sums of the hours before. No group holds more than that, and no array of lives is built. All parts are united.

Defined results
* null or blank references, and edges of type ``depends_on`` / ``requires_env``, are no cases;
* repeated rows (same table and id) give one case;
* a reference without ``seen_at`` is a case only if no row ever carries its key (``missing``): nothing else can be told;
* a target row without ``seen_at`` is taken to exist from the beginning; without ``removed_at``, for ever; one that is removed before
  it is seen never exists, but did before;
* empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedgemill.session import HEAVY_SHARE, cut, heavy_keys, lookup, node_key, trimmed

OUTSIDE = ("depends_on", "requires_env")


def beginning() -> Column:
    """Before all times."""
    return F.timestamp_seconds(F.lit(-60_000_000_000))


def references(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """ref_table, ref_id, key (``e:`` or ``s:`` by kind of target, then the key), seen_at."""
    e = edges.filter(~F.coalesce(F.lower(trimmed(F.col("type"))), F.lit("")).isin(*OUTSIDE)).select(
        F.lit("edges").alias("ref_table"), F.col("edge_id").alias("ref_id"), node_key(F.col("dst")).alias("key"), "seen_at"
    )
    s = symbols.select(
        F.lit("symbols").alias("ref_table"), F.col("symbol_id").alias("ref_id"), node_key(F.col("module")).alias("key"), "seen_at"
    )
    tagged = F.concat(F.when(F.col("ref_table") == "edges", "e:").otherwise("s:"), "key")
    return e.unionByName(s).filter("key <> ''").withColumn("key", tagged)


def lives_of(manifest: DataFrame, symbols: DataFrame, builtins: DataFrame) -> DataFrame:
    """key, born, gone of every target row; born is the ``beginning`` where it is not known."""
    born, gone = F.coalesce("seen_at", beginning()).alias("born"), F.col("removed_at").alias("gone")
    modules = manifest.select(node_key(F.col("module")).alias("key"), born, gone)
    members = symbols.filter("module is not null and name is not null").select(
        node_key(F.concat_ws("/", trimmed(F.col("module")), trimmed(F.col("name")))).alias("key"), born, gone
    )
    always = builtins.select(node_key(F.col("key")).alias("key"), beginning().alias("born"), F.lit(None).cast("timestamp").alias("gone"))
    of_edges = modules.unionByName(members).unionByName(always).withColumn("key", F.concat(F.lit("e:"), "key"))
    return of_edges.unionByName(modules.withColumn("key", F.concat(F.lit("s:"), "key"))).filter("length(key) > 2")


def month_of(at: Column) -> Column:
    return F.coalesce(F.year(at) * 12 + F.month(at), F.lit(-1))


def spot(key: Column, month: Column) -> Column:
    return F.concat(month.cast("string"), F.lit(" "), key)


def suspects(refs: DataFrame, lives: DataFrame) -> DataFrame:
    """spot (month and key), refs, first_born, first_gone of the spots that may hold orphans; first_born is null where no row carries the key."""
    spots = refs.groupBy("key", month_of(F.col("seen_at")).alias("month")).agg(F.count("*").alias("refs"), F.min("seen_at").alias("first"), F.max("seen_at").alias("last"))
    firsts = lives.groupBy("key").agg(F.min("born").alias("first_born"), F.min("gone").alias("first_gone"))
    fine = F.col("first_born").isNotNull() & (F.col("first").isNull() | (F.col("first") >= F.col("first_born")) & (F.col("first_gone").isNull() | (F.col("last") < F.col("first_gone"))))
    return spots.join(firsts, "key", "left").filter(~fine).select(spot(F.col("key"), F.col("month")).alias("spot"), "refs", "first_born", "first_gone")


def states_after_deaths(refs: DataFrame, lives: DataFrame) -> DataFrame:
    """ref_table, ref_id, state, seen_at of references (key, seen_at) after a first birth and death; ``lives`` are all those of their keys."""
    lived = F.col("gone").isNull() | (F.col("gone") > F.col("born"))
    birth = F.struct(F.col("born").alias("at"), F.lit(1).alias("alive"))
    death = F.when(F.col("gone").isNotNull(), F.struct(F.col("gone").alias("at"), F.lit(-1).alias("alive")))
    events = cut(lives.filter(lived).select("key", F.explode(F.filter(F.array(birth, death), lambda x: x.isNotNull())).alias("c")).groupBy("key", "c.at").agg(F.sum("c.alive").alias("alive")), "events")
    hour = lambda c: F.date_trunc("hour", c)
    no = F.lit(0).cast("long")
    rows = refs.select("key", F.col("seen_at").alias("at"), no.alias("alive"), "ref_table", "ref_id").unionByName(
        events.select("key", "at", "alive", F.lit(None).cast("string").alias("ref_table"), F.lit(None).cast("long").alias("ref_id"))
    ).withColumn("hour", hour("at"))
    per_hour = rows.groupBy("key", "hour").agg(F.sum("alive").alias("n"))
    hours = per_hour.select("key", "hour", F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)), no).alias("before"))
    # a birth or death at the very time of a reference comes before it
    upto = Window.partitionBy("key", "hour").orderBy("at", F.col("ref_table").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("alive", F.sum("alive").over(upto)).filter("ref_table is not null").join(hours, ["key", "hour"])
    return found.filter("alive + before <= 0").select("ref_table", "ref_id", F.lit("deleted").alias("state"), F.col("at").alias("seen_at"))


def orphan_references(edges: DataFrame, symbols: DataFrame, manifest: DataFrame, builtins: DataFrame, share: float = HEAVY_SHARE) -> DataFrame:
    """ref_table, ref_id, state, month (of seen_at): one row per reference whose target does not exist at its seen_at."""
    refs, lives = references(edges, symbols), lives_of(manifest, symbols, builtins)
    bad = cut(suspects(refs, lives), "suspects")
    heavy = heavy_keys(bad, "spot", share, "refs")
    placed = refs.withColumn("spot", spot(F.col("key"), month_of(F.col("seen_at"))))
    t = F.col("seen_at")
    state = F.when(F.col("first_born").isNull(), "missing").when(t < F.col("first_born"), "late").when(t >= F.col("first_gone"), "after")
    caught = lookup(placed, bad.select("spot", "first_born", "first_gone", F.lit(True).alias("_bad")), "spot", heavy).filter("_bad")
    caught = cut(caught.select("ref_table", "ref_id", "key", "seen_at", state.alias("state")).filter("state is not null"), "caught")
    after = caught.filter("state = 'after'")
    deleted = states_after_deaths(after, lives.join(after.select("key").distinct(), "key", "left_semi"))
    found = caught.filter("state <> 'after'").select("ref_table", "ref_id", "state", "seen_at").unionByName(deleted)
    return found.groupBy("ref_table", "ref_id").agg(F.min("state").alias("state"), F.min(F.date_format("seen_at", "yyyy-MM")).alias("month"))


def orphan_counts(found: DataFrame) -> DataFrame:
    """Cases per table, month of seen_at and state."""
    return found.groupBy("ref_table", "month", "state").agg(F.count("*").alias("n"))
