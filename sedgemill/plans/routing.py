"""Queries that route questions, dates and files."""

from pyspark.sql import functions as F

from sedgemill.functions import dates as D
from sedgemill.functions import routing as R
from sedgemill.plans.registry import Registry
from sedgemill.session import table

reg = Registry()

_has = lambda cues: " or ".join(f"contains(q, '{c}')" for c in cues)


#: The route of a question q in small letters, in SQL of its own.
MEMORY_ROUTE = """case
  when regexp_matches(q, 'recommend|suggest|prefer|gift|advice|advise') or q like '%should i%' or q like '%should you%' or q like '%idea for%' or q like '%ideas for%'
    or q like '%what would i%' or q like '%what would you%' or q like '%help me choose%' or q like '%help me pick%' or q like '%help me plan%' then 'advice'
  when q like '%how many%' or q like '%how much%' or q like '%how often%' or q like '%total%' or q like '%all the%' or q like '%all of%' or q like '%all my%' or q like '%list %' or q like '%count%'
    or q like '%which % did i go%' or q like '%which % did i attend%' or q like '%which % did i visit%' or q like '%which % did i buy%' or q like '%what %have i%' then 'tally'
  when list_has_any(regexp_split_to_array(q, '[^a-z0-9_]+'), ['first', 'last', 'before', 'after', 'since']) or q like '%latest%' or q like '%earliest%' or q like '%most recent%' or q like '%right before%' or q like '%right after%'
    or q like '%between % and%' or q like '%when did%' or q like '%how long ago%' or q like '%how long after%' or q like '%how long before%' or q like '%in what order%' or q like '%sequence%' then 'timeline'
  else 'lookup' end"""


def _questions(spark, d):
    return table(spark, d, "test_items").select("item_id", "question", "question_type").distinct()


@reg.query(
    "classify_memory",
    rf"""
select item_id, {MEMORY_ROUTE} as kind
from (select distinct item_id, lower(question) q from test_items)
""",
)
def classify_memory(spark, d):
    return _questions(spark, d).select("item_id", R.memory_kind(F.col("question")).alias("kind"))


@reg.query(
    "classify_history",
    f"""
select item_id, case when {_has(R.HISTORY_CUES['tally'])} then 'tally' when {_has(R.HISTORY_CUES['timeline'])} then 'timeline' when {_has(R.HISTORY_CUES['advice'])} then 'advice' else 'lookup' end as kind
from (select distinct item_id, ' ' || trim(lower(question)) || ' ' q from test_items)
""",
)
def classify_history(spark, d):
    return _questions(spark, d).select("item_id", R.history_kind(F.col("question")).alias("kind"))


@reg.query(
    "document_kinds",
    rf"""
select kind, route, count(*) as n from (select kind, {MEMORY_ROUTE} as route
from (select kind, lower(regexp_extract(text, '^[^\n\r]*', 0)) q from documents where text is not null)) group by all
""",
)
def document_kinds(spark, d):
    """The route that the first line of each document would take, by kind of document."""
    first = F.regexp_extract("text", r"^[^\n\r]*", 0)
    routed = table(spark, d, "documents").filter("text is not null").select("kind", R.memory_kind(first).alias("route"))
    return routed.groupBy("kind", "route").agg(F.count("*").alias("n"))


@reg.query(
    "router_confusion",
    rf"""
with k as (select question_type, lang, {MEMORY_ROUTE} as kind
from (select distinct item_id, question_type, lang, lower(question) q from test_items))
select want, got, n, round(n / sum(n) over (partition by want), 6) as share from (select question_type as want, kind as got, count(*) as n from k group by 1, 2)
""",
)
def router_confusion(spark, d):
    routed = _questions(spark, d).select(F.col("question_type").alias("want"), R.memory_kind(F.col("question")).alias("got"))
    counts = routed.groupBy("want", "got").agg(F.count("*").alias("n"))
    totals = routed.groupBy("want").agg(F.count("*").alias("total"))
    return counts.join(totals, F.equal_null(counts["want"], totals["want"])).select(counts["want"], "got", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


_KINDS = " ".join(f"when regexp_extract(f, '\\.([^.]+)$', 1) in ({', '.join(repr(e) for e in exts)}) then '{k}'" for k, exts in R.FILE_KINDS.items())


@reg.query(
    "route_files",
    f"""
select repo, case when f in ({', '.join(repr(x) for x in R.DATA_NAMES)}) then 'data' {_KINDS} else 'other' end as kind, count(*) as files, cast(sum(n_bytes) as bigint) as bytes
from (select repo, n_bytes, lower(string_split(path, '/')[-1]) f from source_files) group by all
""",
)
def route_files(spark, d):
    routed = table(spark, d, "source_files").select("repo", "n_bytes", R.file_kind(F.col("path")).alias("kind"))
    return routed.groupBy("repo", "kind").agg(F.count("*").alias("files"), F.sum("n_bytes").alias("bytes"))


IGNORES = ["bench/", "**/mod*/**", "*/*_silo.??", "store/*/ledger_*"]


@reg.query(
    "ignore_match",
    r"""select path, cast(list_contains(string_split(path, '/'), 'bench')::int + regexp_matches(path, '^.*/mod[^/]*/.*(/|$)')::int + regexp_matches(path, '^[^/]*/[^/]*_silo[.][^/][^/](/|$)')::int
  + regexp_matches(path, '^store/[^/]*/ledger_[^/]*(/|$)')::int as integer) as rules from (select distinct path from source_files) where rules > 0""",
)
def ignore_match(spark, d):
    """How many of four rules of an ignore file cover each path."""
    hits = [R.ignored(F.col("path"), p).cast("int") for p in IGNORES]
    return table(spark, d, "source_files").select("path").distinct().withColumn("rules", sum(hits[1:], hits[0])).filter("rules > 0")


@reg.query(
    "topic_rows",
    r"select kind, count(*) as n, count(*) filter (where regexp_matches(text, '(?i)^(asked|asking|inquired|discussed|talked|learned|read|chatted) about\b')) as topic_rows from documents where text is not null group by kind",
)
def topic_rows(spark, d):
    topic = F.col("text").rlike(rf"(?i)^(asked|asking|inquired|discussed|talked|learned|read|chatted) about{D.RIGHT}")
    return table(spark, d, "documents").filter("text is not null").groupBy("kind").agg(F.count("*").alias("n"), F.count_if(topic).alias("topic_rows"))


@reg.query(
    "money_rows",
    r"select distinct doc_id, source from documents where regexp_matches(lower(text), '[$€£]\s?\d|\d[\d.,]*\s?(eur|usd|dollars?|euros?|crowns?|cents?)\b')",
)
def money_rows(spark, d):
    priced = F.lower("text").rlike(rf"[$€£]\s?\d|\d[\d.,]*\s?(eur|usd|dollars?|euros?|crowns?|cents?){D.RIGHT}")
    return table(spark, d, "documents").filter(priced).select("doc_id", "source").distinct()


# ---------------------------------------------------------------- calendar
EXPRESSIONS = [
    "yesterday", "last weekend", "last friday", "3 days ago", "a week ago", "two months ago", "last month", "last week", "last year",
    "in march", "during november", "at christmas eve", "on halloween", "no expression",
]

#: The same rules for DuckDB, per expression of the list, over anchor date a.
_WINDOWS = {
    "yesterday": ("yesterday", "a - 1", "a - 1"),
    "last weekend": ("last weekend", "a - (isodow(a) - 1)::int - 2", "a - (isodow(a) - 1)::int - 1"),
    "last friday": ("last friday", "a - ((isodow(a) + 1) % 7 + 1)::int", "a - ((isodow(a) + 1) % 7 + 1)::int"),
    "3 days ago": ("3 days ago", "a - 3", "a - 3"),
    "a week ago": ("a week ago", "a - 10", "a - 4"),
    "two months ago": ("two months ago", "a - 70", "a - 50"),
    "last month": ("last month", "date_trunc('month', a) - interval 1 month", "date_trunc('month', a) - interval 1 day"),
    "last week": ("last week", "a - (isodow(a) - 1)::int - 7", "a - (isodow(a) - 1)::int - 1"),
    "last year": ("last year", "make_date(year(a) - 1, 1, 1)", "make_date(year(a) - 1, 12, 31)"),
    "in march": ("march", "make_date(year(a) - (month(a) < 3)::int, 3, 1)", "make_date(year(a) - (month(a) < 3)::int, 3, 31)"),
    "during november": ("november", "make_date(year(a) - (month(a) < 11)::int, 11, 1)", "make_date(year(a) - (month(a) < 11)::int, 11, 30)"),
    "at christmas eve": ("christmas", "make_date(year(a) - (make_date(year(a), 12, 25) > a)::int, 12, 25)", "make_date(year(a) - (make_date(year(a), 12, 25) > a)::int, 12, 25)"),
    "on halloween": ("halloween", "make_date(year(a) - (make_date(year(a), 10, 31) > a)::int, 10, 31)", "make_date(year(a) - (make_date(year(a), 10, 31) > a)::int, 10, 31)"),
}


@reg.query(
    "resolve_window",
    "with h as (select distinct id, try_cast(date as date) a from history_manifest where length(date) = 10) "
    + " union all ".join(f"select id, '{e}' as expression, '{w[0]}' as label, cast({w[1]} as date) as start_date, cast({w[2]} as date) as end_date from h where a is not null" for e, w in _WINDOWS.items()),
)
def resolve_window(spark, d):
    anchors = table(spark, d, "history_manifest").filter("length(date) = 10").select("id", F.expr("try_cast(date as date)").alias("a")).distinct()
    asked = anchors.select("id", "a", F.explode(F.array(*map(F.lit, EXPRESSIONS))).alias("expression"))
    found = asked.withColumn("w", D.resolve(F.col("expression"), F.col("a"))).filter("w is not null")
    return found.select("id", "expression", "w.label", F.col("w.start").alias("start_date"), F.col("w.end").alias("end_date"))


@reg.query(
    "resolved_summaries",
    r"""
with h as (select distinct id, lower(summary) t, try_cast(date as date) a from history_manifest where length(date) = 10)
select id, 'yesterday' as label, cast(a - 1 as date) as start_date, cast(a - 1 as date) as end_date from h where regexp_matches(t, '\byesterday\b') and a is not null
""",
)
def resolved_summaries(spark, d):
    """What the relative expressions in the summaries themselves resolve to."""
    rows = table(spark, d, "history_manifest").filter("length(date) = 10").select("id", "summary", F.expr("try_cast(date as date)").alias("a")).distinct()
    found = rows.withColumn("w", D.resolve(F.col("summary"), F.col("a"))).filter("w is not null")
    return found.select("id", "w.label", F.col("w.start").alias("start_date"), F.col("w.end").alias("end_date"))


@reg.query(
    "window_rows",
    """
with h as (select distinct id, title, substr(date, 1, 10) d from history_manifest where date is not null),
w as (select cast(max(try_cast(d as date)) as date) a from h where length(d) = 10),
x as (select a, cast(date_trunc('month', a) - interval 1 month as date) s, cast(date_trunc('month', a) - interval 1 day as date) e from w)
select id, d as date, title from h, x where case when length(d) = 7 then d between left(s::varchar, 7) and left(e::varchar, 7) else d between s::varchar and e::varchar end
""",
)
def window_rows(spark, d):
    """Rows of the month before the newest one, with rows of month precision."""
    rows = table(spark, d, "history_manifest").filter("date is not null").select("id", "title", F.substring("date", 1, 10).alias("date")).distinct()
    anchor = rows.filter("length(date) = 10").agg(F.max(F.expr("try_cast(date as date)")).alias("a")).first()["a"]
    window = D.resolve(F.lit("last month"), F.lit(anchor))
    return rows.filter(D.in_window(F.col("date"), window)).select("id", "date", "title")


@reg.query("iso_week", "select strftime(ts, '%G-W%V') as week, count(*) as n, cast(min(isodow(ts)) as integer) as first_day, cast(max(isodow(ts)) as integer) as last_day from events group by 1")
def iso_week(spark, d):
    day = F.col("ts").cast("date")
    return table(spark, d, "events").groupBy(D.iso_week(day).alias("week")).agg(F.count("*").alias("n"), F.min(D.weekday(day)).cast("int").alias("first_day"), F.max(D.weekday(day)).cast("int").alias("last_day"))


@reg.query(
    "months_named",
    "select distinct id, array_to_string(list_filter([" + ", ".join(f"case when contains(lower(summary), '{m}') then {k + 1} end" for k, m in enumerate(D.MONTHS)) + "], lambda x: x is not null), ',') as months from history_manifest where summary is not null",
)
def months_named(spark, d):
    rows = table(spark, d, "history_manifest").filter("summary is not null")
    return rows.select("id", F.array_join(D.months_named(F.col("summary")).cast("array<string>"), ",").alias("months")).distinct()
