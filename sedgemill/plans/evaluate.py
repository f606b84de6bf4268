"""Measures over labelled rows: accuracy with errors, roll-ups, set agreement, coverage, what is still open."""

from pyspark.sql import functions as F

from sedgemill.functions import routing as R
from sedgemill.functions import text as T
from sedgemill.plans.registry import Registry
from sedgemill.plans.routing import MEMORY_ROUTE
from sedgemill.plans.text import ESTIMATE, WORDS
from sedgemill.session import table

reg = Registry()

# The route that each type of question should take.
WANTED = {
    "single-session-user": "lookup", "single-session-assistant": "lookup", "single-session-preference": "advice",
    "temporal-reasoning": "timeline", "multi-session": "tally", "knowledge-update": "lookup",
}
LABELS = f"l as (select item_id, question_type, ({MEMORY_ROUTE}) = case question_type " + " ".join(f"when '{k}' then '{v}'" for k, v in WANTED.items()) + " end hit from (select distinct item_id, question_type, lower(question) q from test_items))"


def _labels(spark, d):
    wanted = F.create_map(*[F.lit(x) for kv in WANTED.items() for x in kv])
    q = table(spark, d, "test_items").select("item_id", "question_type", "question").distinct()
    return q.select("item_id", "question_type", (R.memory_kind(F.col("question")) == wanted[F.col("question_type")]).alias("hit"))


@reg.query(
    "micro_macro_se",
    f"with {LABELS}, t as (select question_type, avg(hit::int) a, count(*) n from l where hit is not null group by 1), m as (select sum(a * n) / sum(n) micro, avg(a) macro, sum(n) n from t) select round(micro, 6) as micro, round(macro, 6) as macro, round(sqrt(micro * (1 - micro) / n), 6) as se, cast(n as bigint) as n from m",
)
def micro_macro_se(spark, d):
    """Accuracy of the router over all questions, over types, and its binomial standard error."""
    by = _labels(spark, d).filter("hit is not null").groupBy("question_type").agg(F.avg(F.col("hit").cast("int")).alias("a"), F.count("*").alias("n"))
    m = by.agg((F.sum(F.col("a") * F.col("n")) / F.sum("n")).alias("micro"), F.avg("a").alias("macro"), F.sum("n").alias("n"))
    return m.select(F.round("micro", 6).alias("micro"), F.round("macro", 6).alias("macro"), F.round(F.sqrt(F.col("micro") * (1 - F.col("micro")) / F.col("n")), 6).alias("se"), "n")


@reg.query(
    "metric_rollup",
    f"with d as (select kind, source, {ESTIMATE.format('text')} t from documents where text is not null) select kind, source, count(*) as n, round(avg(t), 4) as mean_tokens, max(t) as most_tokens from d group by grouping sets ((kind, source), (kind), ())",
)
def metric_rollup(spark, d):
    """Number and size of documents per kind and source, per kind, and of all."""
    docs = table(spark, d, "documents").filter("text is not null").select("kind", "source", T.estimated_tokens(F.col("text")).alias("t"))
    return docs.groupingSets([["kind", "source"], ["kind"], []], "kind", "source").agg(F.count("*").alias("n"), F.round(F.avg("t"), 4).alias("mean_tokens"), F.max("t").alias("most_tokens"))


@reg.query(
    "edit_f1",
    """with g as (select distinct module, unnest(symbols) name from manifest where module is not null), h as (select distinct module, name from symbols where module is not null),
c as (select coalesce(g.module, h.module) module, count(*) filter (where g.name is not null and h.name is not null) both_, count(g.name) gold, count(h.name) got from g full join h on g.module = h.module and g.name = h.name group by 1)
select module, round(both_ / nullif(gold, 0), 6) as recall, round(both_ / nullif(got, 0), 6) as precision, round(2.0 * both_ / (gold + got), 6) as f1 from c""",
)
def edit_f1(spark, d):
    """Agreement of the symbols that the manifest declares with those that were found, per module."""
    gold = table(spark, d, "manifest").filter("module is not null").select("module", F.explode("symbols").alias("name")).distinct().withColumn("g", F.lit(1))
    got = table(spark, d, "symbols").filter("module is not null").select("module", "name").distinct().withColumn("h", F.lit(1))
    c = gold.join(got, ["module", "name"], "full").groupBy("module").agg(F.sum(F.col("g") * F.col("h")).alias("both"), F.sum("g").alias("gold"), F.sum("h").alias("got"))
    both, n = F.coalesce("both", F.lit(0)), lambda k: F.coalesce(k, F.lit(0))
    return c.select(
        "module", F.round(both / F.nullif(n("gold"), F.lit(0)), 6).alias("recall"), F.round(both / F.nullif(n("got"), F.lit(0)), 6).alias("precision"),
        F.round(2.0 * both / (n("gold") + n("got")), 6).alias("f1"),
    )


@reg.query(
    "gold_coverage",
    f"""with w as (select item_id, lang, unnest(list_distinct({WORDS.format("text")})) w from (select distinct item_id, lang, text from test_items)),
v as (select distinct unnest({WORDS.format('text')}) w from documents)
select lang, count(*) as words, round(avg((v.w is not null)::int), 6) as covered from w left join v using (w) group by lang""",
)
def gold_coverage(spark, d):
    """Share of the words of test items that occur in any document, per language."""
    words = table(spark, d, "test_items").select("item_id", "lang", F.explode(F.array_distinct(T.content_words(F.col("text")))).alias("w")).distinct()
    seen = table(spark, d, "documents").select(F.explode(T.content_words(F.col("text"))).alias("w")).distinct().withColumn("seen", F.lit(1))
    return words.join(seen, "w", "left").groupBy("lang").agg(F.count("*").alias("words"), F.round(F.avg(F.coalesce("seen", F.lit(0))), 6).alias("covered"))


@reg.query("open_items", f"with w as (select distinct doc_id, unnest({WORDS.format('text')}) w from documents), q as (select distinct item_id, unnest(list_distinct({WORDS.format('question')})) w from test_items), h as (select distinct item_id from q join w using (w)) select distinct item_id, question_type from test_items where item_id not in (select item_id from h)")
def open_items(spark, d):
    """Items none of whose question words occur in any document."""
    words = table(spark, d, "documents").select(F.explode(T.content_words(F.col("text"))).alias("w")).distinct()
    asked = table(spark, d, "test_items").select("item_id", F.explode(F.array_distinct(T.content_words(F.col("question")))).alias("w")).distinct()
    met = asked.join(words, "w", "left_semi").select("item_id").distinct()
    return table(spark, d, "test_items").select("item_id", "question_type").distinct().join(met, "item_id", "left_anti")


@reg.query("store_status", "select source, count(*) as n, count(*) filter (where text is null or trim(text) = '') as blank, count(*) filter (where n_chars is distinct from length(text)) as stale, strftime(max(loaded_at), '%Y-%m-%d') as latest from documents group by source")
def store_status(spark, d):
    """Documents, blank ones, ones with a stale size, and the latest load per source."""
    blank = F.col("text").isNull() | (F.trim("text") == "")
    return table(spark, d, "documents").groupBy("source").agg(
        F.count("*").alias("n"), F.count_if(blank).alias("blank"), F.count_if(~F.equal_null("n_chars", F.length("text").cast("long"))).alias("stale"),
        F.date_format(F.max("loaded_at"), "yyyy-MM-dd").alias("latest"),
    )
