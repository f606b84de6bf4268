"""Queries of the operators for training data, with SQL where SQL can say the same."""

from pyspark.sql import functions as F

from sedgemill.llm.components import groups, match_pairs
from sedgemill.llm.docpairs import documented_functions, documented_names
from sedgemill.llm.leaks import leaked_passages, leaking_documents, removal_spans
from sedgemill.llm.packing import packed
from sedgemill.llm.pii import learn, occurrences, redact
from sedgemill.llm.sentences import sentence_units
from sedgemill.llm.syntax import checked_files, rates, unparsable
from sedgemill.plans.registry import Registry
from sedgemill.session import table

reg = Registry()

_KEY = "replace(replace(trim({0}, e' \\t\\r\\n' || chr(160)), '::', '/'), '.', '/')"

#: Label propagation by recursion over the distinct matches.
GROUPS = f"""
with recursive m as (
  select {_KEY.format('src')} a, {_KEY.format('dst')} b from edges where lower(trim(type, e' \\t\\r\\n' || chr(160))) = 'same_symbol_as'
), l as (select a, b from m where a <> '' and b <> '' union select b, a from m where a <> '' and b <> ''),
r(node, other) as (select a, a from l union select r.node, l.b from r join l on l.a = r.other)
"""


@reg.query("p1_found")
def p1_found(spark, d):
    return unparsable(table(spark, d, "source_files"), table(spark, d, "manifest"))


@reg.query("p1_rates")
def p1_rates(spark, d):
    manifest = table(spark, d, "manifest")
    return rates(checked_files(table(spark, d, "source_files"), manifest), manifest)


@reg.query("p2_found")
def p2_found(spark, d):
    history = table(spark, d, "history_manifest")
    return occurrences(history, learn(history, table(spark, d, "name_list")))


@reg.query("p2_redacted")
def p2_redacted(spark, d):
    history = table(spark, d, "history_manifest")
    clean = redact(history, learn(history, table(spark, d, "name_list")))
    return clean.select("id", "title", "summary", F.array_join("entities", "|", "").alias("entities"))


@reg.query("p3_found")
def p3_found(spark, d):
    return documented_names(table(spark, d, "source_files"))


@reg.query("p3_pairs")
def p3_pairs(spark, d):
    return documented_functions(table(spark, d, "source_files"))


@reg.query("p5_found", GROUPS + "select node, min(other) group_id from r group by node")
def p5_found(spark, d):
    return groups(match_pairs(table(spark, d, "edges")))


@reg.query("p8_found")
def p8_found(spark, d):
    return sentence_units(table(spark, d, "documents"))


@reg.query("p6_containers")
def p6_containers(spark, d):
    return packed(table(spark, d, "documents"))


@reg.query("p7_found")
def p7_found(spark, d):
    return leaking_documents(table(spark, d, "documents"), table(spark, d, "test_items"))


@reg.query("p7_spans")
def p7_spans(spark, d):
    return removal_spans(leaked_passages(table(spark, d, "documents"), table(spark, d, "test_items")))
