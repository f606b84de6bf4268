"""Queries on names that are nearly the same."""

from pyspark.sql import functions as F

from sedgemill.functions import text as T
from sedgemill.operators import names as N
from sedgemill.plans.registry import Registry
from sedgemill.session import table

reg = Registry()


@reg.query("similar_names")
def similar_names(spark, d):
    """Symbols whose names are nearly the same: every key with its group."""
    return N.similar_names(table(spark, d, "symbols").select("name"))


@reg.query("name_similarity")
def name_similarity(spark, d):
    """How similar each symbol's name is to the last part of its module, by Jaro-Winkler over their keys."""
    pairs = table(spark, d, "symbols").select("name", F.element_at(F.split("module", "[./]"), -1).alias("part")).filter("name is not null and part is not null").distinct()
    keyed = pairs.withColumn("a", T.label_key(F.col("name"))).withColumn("b", F.translate(F.lower("part"), "_-", "")).filter("a <> '' and b <> ''")
    return keyed.select("name", "part", F.round(N.similarity("a", "b"), 6).alias("score"))

