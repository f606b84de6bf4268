"""Queries on source files that need a syntax tree (Python only; the rest of the code tier reads the given tables)."""

from pyspark.sql import functions as F

from sedgemill.plans.registry import Registry
from sedgemill.session import table
from sedgemill.sources.extract import python_symbols

reg = Registry()


def _python(spark, d):
    return python_symbols(table(spark, d, "source_files").filter("path like '%.py'"))


@reg.query("python_symbols")
def python_symbols_(spark, d):
    """Functions, methods and classes of Python files with line, signature and first line of the docstring."""
    return _python(spark, d).filter("kind in ('fn', 'method', 'class')").select("module", "kind", "name", "owner", "line", "sig", "brief")


@reg.query("python_calls")
def python_calls(spark, d):
    """Which functions of a module call which names; top-level calls belong to __main__."""
    rows = _python(spark, d).filter("kind in ('fn', 'method', 'main')")
    return rows.select("module", "name", F.explode("names").alias("callee")).groupBy("module", "name").agg(F.array_join(F.array_sort(F.collect_set("callee")), ",").alias("callees"))


@reg.query("symbol_drift")
def symbol_drift(spark, d):
    """Python symbols of the files against the symbols table: only in the files, only in the table, or moved to another line."""
    found = _python(spark, d).filter("kind in ('fn', 'method', 'class')").groupBy("module", "name").agg(F.min("line").alias("line"))
    known = table(spark, d, "symbols").filter("module is not null").join(found.select("module").distinct(), "module", "left_semi").groupBy("module", "name").agg(F.min("line").alias("known"))
    change = F.when(F.col("known").isNull(), "new").when(F.col("line").isNull(), "gone").when(F.col("line") != F.col("known"), "moved").otherwise("same")
    return found.join(known, ["module", "name"], "full").select("module", "name", change.alias("change"))
