"""Queries on dated facts, events and time windows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from sedgemill.functions import text as T
from sedgemill.operators import ledger as L
from sedgemill.plans.registry import Registry
from sedgemill.plans.text import WORDS
from sedgemill.session import table

reg = Registry()

FACTS = """
h as (select distinct id, date, summary, attrs from history_manifest),
sent as (select id, date, list_filter(list_transform(string_split(regexp_replace(regexp_replace(coalesce(summary, ''), '\\s+', ' ', 'g'), '([.!?])\\s+([A-Z"''(])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: trim(s)), lambda s: length(s) > 20) ss, coalesce(attrs, []) attrs from h),
facts as (select id src, generate_subscripts(ss, 1) n, date, 'event' kind, unnest(ss) fact from sent union all select id, len(ss) + generate_subscripts(attrs, 1), date, 'attribute', unnest(attrs) from sent)
"""
KEY6 = f"array_to_string(list_sort({WORDS.format('fact')}[1:6]), ',')"


def _facts(spark, d):
    return L.facts(table(spark, d, "history_manifest"))


@reg.query(
    "fact_dedupe",
    f"with {FACTS}, k as (select *, {KEY6} key from facts where fact is not null), r as (select *, row_number() over (partition by coalesce(date, 'null'), key order by src, n) r from k) select coalesce(date, 'null') as date, key, src, cast(n as integer) as n, fact from r where r = 1",
)
def fact_dedupe(spark, d):
    """One fact per date and sorted first six content words."""
    keyed = _facts(spark, d).select(F.coalesce("date", F.lit("null")).alias("date"), L.fact_key(F.col("fact")).alias("key"), "src", "n", "fact")
    return L.first_per_key(keyed, ["date", "key"], ["src", "n"])


@reg.query(
    "supersede",
    f"""
with {FACTS}, a as (select src, n, date, fact, array_to_string(list_sort({WORDS.format('fact')}[1:1]), ',') subject from facts where kind = 'attribute' and date is not null and fact is not null),
m as (select *, max(date) over (partition by subject) newest, count(*) over (partition by subject) versions from a)
select src, cast(n as integer) as n, date, fact, newest as superseded_by from m where date < newest and subject <> ''
""",
)
def supersede(spark, d):
    """Attribute facts whose subject has a later one, with the date of the last."""
    subject = T.sorted_key(T.content_words(F.col("fact")), 1)
    rows = _facts(spark, d).filter("kind = 'attribute' and date is not null").withColumn("subject", subject).filter("subject <> ''")
    newest = rows.groupBy("subject").agg(F.max("date").alias("superseded_by"))
    return rows.join(newest, "subject").filter("date < superseded_by").select("src", "n", "date", "fact", "superseded_by")


@reg.query(
    "candidate_values",
    f"""
with {FACTS}, a as (select src, date, fact, array_to_string(list_sort({WORDS.format('fact')}[1:1]), ',') subject from facts where kind = 'attribute' and date is not null and fact is not null),
r as (select subject, date, fact, src, row_number() over (partition by subject order by date desc, src desc, fact desc) r, count(*) over (partition by subject) c from a where subject <> '')
select subject, date, fact, src, c as versions, cast(r as integer) as age from r where c >= 2 and r <= 6
""",
)
def candidate_values(spark, d):
    """The last six versions of every subject with at least two dated ones."""
    subject = T.sorted_key(T.content_words(F.col("fact")), 1)
    rows = _facts(spark, d).filter("kind = 'attribute' and date is not null").select(subject.alias("subject"), "date", "fact", "src").filter("subject <> ''")
    versions = rows.groupBy("subject").agg(F.count("*").alias("versions")).filter("versions >= 2")
    age = F.row_number().over(Window.partitionBy("subject").orderBy(F.desc("date"), F.desc("src"), F.desc("fact")))
    return rows.withColumn("age", age).filter("age <= 6").join(versions, "subject")


@reg.query(
    "timeline",
    f"""
with {FACTS}, a as (select src, date, fact, kind, try_cast(date as date) dd from facts where kind = 'attribute' and length(date) = 10 and fact is not null),
s as (select *, array_to_string(list_sort({WORDS.format('fact')}[1:1]), ',') subject from a)
select src, subject, date, fact, cast(dd - lag(dd) over (partition by subject order by dd, src, fact) as integer) as gap_days from s where subject <> ''
""",
)
def timeline(spark, d):
    """Days since the previous dated fact on the same subject."""
    subject = T.sorted_key(T.content_words(F.col("fact")), 1)
    rows = _facts(spark, d).filter("kind = 'attribute' and length(date) = 10").select("src", subject.alias("subject"), "date", "fact").filter("subject <> ''")
    dated = rows.withColumn("_d", F.expr("try_cast(date as date)")).withColumn("_month", F.substring("date", 1, 7))
    seen = L.previous(dated, "subject", "_month", ["_d", "src", "fact"], ["_d"])
    return seen.select("src", "subject", "date", "fact", F.datediff("_d", F.col("prev._d")).alias("gap_days"))


@reg.query(
    "union_events",
    f"""
with {FACTS}, u as (select left(coalesce(date, '9999'), 10) date, fact what, src from facts where kind = 'event' union all select left(coalesce(date, '9999'), 10), title, id from history_manifest where title is not null),
k as (select *, array_to_string(list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(what), '[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: length(w) > 3))), ' ') key from u where what is not null)
select date, key, count(distinct what) as wordings, arg_max(what, struct_pack(a := length(what), b := what)) as what from k where key <> '' group by date, key
""",
)
def union_events(spark, d):
    """Titles and event facts of a day with the same words of more than three letters are one occurrence; the fullest wording stays."""
    history = table(spark, d, "history_manifest")
    said = _facts(spark, d).filter("kind = 'event'").select("date", F.col("fact").alias("what"))
    both = said.unionByName(history.filter("title is not null").select("date", F.col("title").alias("what")))
    norm = F.trim(F.regexp_replace(F.regexp_replace(F.lower("what"), "[^a-z0-9 ]", " "), r"\s+", " "))
    key = F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(norm, " "), lambda w: F.length(w) > 3))), " ")
    keyed = both.select(F.substring(F.coalesce("date", F.lit("9999")), 1, 10).alias("date"), key.alias("key"), "what").filter("key <> ''").distinct()
    return keyed.groupBy("date", "key").agg(F.count("*").alias("wordings"), F.max_by("what", F.struct(F.length("what"), "what")).alias("what"))


@reg.query(
    "event_table",
    "with e as (select user_id, event_type, cast(ts as date) as day_, min(struct_pack(ts := ts, id := event_id)) f, count(*) n from events group by all) select user_id, event_type, strftime(day_, '%Y-%m-%d') as date, n, cast(row_number() over (partition by user_id order by f.ts, f.id) as integer) as no from e",
)
def event_table(spark, d):
    """Numbered occurrences of each user, one per type and day."""
    e = table(spark, d, "events").groupBy("user_id", "event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.min(F.struct("ts", "event_id")).alias("f"))
    no = F.row_number().over(Window.partitionBy("user_id").orderBy("f.ts", "f.event_id"))
    return e.select("user_id", "event_type", F.date_format("day", "yyyy-MM-dd").alias("date"), "n", no.alias("no"))


@reg.query(
    "category_log",
    "with e as (select user_id, event_type, strftime(ts, '%Y-%m-%d') as day_, count(*) c from events group by all), r as (select *, row_number() over (partition by user_id, event_type order by day_) r, sum(c) over (partition by user_id, event_type) n from e) select user_id, event_type, cast(any_value(n) as bigint) as n, string_agg(r || '. ' || day_ || ' x' || c, chr(10) order by r) as log from r where n >= 2 and r <= 40 group by all",
)
def category_log(spark, d):
    """The chronological list of each user and type with at least two rows: days with their counts, the first 40."""
    days = table(spark, d, "events").groupBy("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("c"))
    w = Window.partitionBy("user_id", "event_type")
    ranked = days.withColumn("r", F.row_number().over(w.orderBy("day"))).withColumn("n", F.sum("c").over(w)).filter("n >= 2 and r <= 40")
    line = F.concat(F.col("r").cast("string"), F.lit(". "), "day", F.lit(" x"), F.col("c").cast("string"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", line.alias("l")))), lambda x: x["l"]), "\n")
    return ranked.groupBy("user_id", "event_type").agg(F.first("n").alias("n"), lines.alias("log"))


@reg.query("first_last_span", "select user_id, strftime(min(ts), '%Y-%m-%d') as first_day, strftime(max(ts), '%Y-%m-%d') as last_day, cast(date_diff('day', cast(min(ts) as date), cast(max(ts) as date)) as integer) as days, arg_min(event_type, struct_pack(a := ts, b := event_id)) as first_type from events group by user_id")
def first_last_span(spark, d):
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    e = table(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.min_by("event_type", F.struct("ts", "event_id")).alias("first_type"))
    return e.select("user_id", day("a").alias("first_day"), day("b").alias("last_day"), F.datediff("b", "a").alias("days"), "first_type")


@reg.query("infer_dates", "select doc_id, coalesce(date, strftime(loaded_at, '%Y-%m-%d')) as date, date is null as inferred from documents")
def infer_dates(spark, d):
    """Undated documents take the day on which they were loaded, marked as inferred."""
    return table(spark, d, "documents").select("doc_id", F.coalesce("date", F.date_format("loaded_at", "yyyy-MM-dd")).alias("date"), F.col("date").isNull().alias("inferred"))


@reg.query(
    "union_stores",
    "select origin, kind, count(*) as n, count(distinct id) as ids, min(date) as first_date, max(date) as last_date from (select 'history' origin, type kind, id, date from history_manifest union all select 'documents', kind, doc_id::varchar, date from documents) group by all",
)
def union_stores(spark, d):
    """Entries of several stores with where they come from."""
    a = table(spark, d, "history_manifest").select(F.lit("history").alias("origin"), F.col("type").alias("kind"), "id", "date")
    b = table(spark, d, "documents").select(F.lit("documents").alias("origin"), "kind", F.col("doc_id").cast("string").alias("id"), "date")
    return a.unionByName(b).groupBy("origin", "kind").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@reg.query("content_dedupe", "select left(sha256(text), 16) as hash, count(*) as copies, min(doc_id) as first_id from documents where text is not null group by 1 having count(*) > 1")
def content_dedupe(spark, d):
    """Texts that came again under other ids."""
    docs = table(spark, d, "documents").filter("text is not null").select(F.substring(F.sha2("text", 256), 1, 16).alias("hash"), "doc_id")
    return docs.groupBy("hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).filter("copies > 1")


@reg.query("longest_wins", "select source, date, arg_max(doc_id, struct_pack(a := length(text), b := -doc_id)) as doc_id, cast(max(length(text)) as integer) as n_chars from documents where text is not null and date is not null group by all")
def longest_wins(spark, d):
    """Of the documents of one source and date, the longest; of equals the smallest id."""
    docs = table(spark, d, "documents").filter("text is not null and date is not null").withColumn("n", F.length("text"))
    return docs.groupBy("source", "date").agg(F.max_by("doc_id", F.struct("n", -F.col("doc_id"))).alias("doc_id"), F.max("n").alias("n_chars"))


@reg.query("newest_first", "select source, id, cast(r as integer) as rank from (select source, doc_id id, row_number() over (partition by source order by coalesce(date, '') desc, loaded_at desc, doc_id) r from documents) where r <= 30")
def newest_first(spark, d):
    """The 30 newest documents of each source."""
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc(F.coalesce("date", F.lit(""))), F.desc("loaded_at"), "doc_id"))
    return table(spark, d, "documents").select("source", F.col("doc_id").alias("id"), rank.alias("rank")).filter("rank <= 30")


@reg.query("upsert_daily", "with d as (select date, source, count(*) n, max(loaded_at) l from documents where date is not null group by all), r as (select *, row_number() over (partition by date order by l desc, source desc) r from d) select date, source, n from r where r = 1")
def upsert_daily(spark, d):
    """Daily counters by date; the counter that was loaded last wins."""
    counters = table(spark, d, "documents").filter("date is not null").groupBy("date", "source").agg(F.count("*").alias("n"), F.max("loaded_at").alias("l"))
    return counters.groupBy("date").agg(F.max_by(F.struct("source", "n"), F.struct("l", "source")).alias("x")).select("date", "x.source", "x.n")


@reg.query("estimate_cost", f"select kind, count(*) as docs, count(*) filter (where t < 300) as too_small, cast(sum(least(t, 25000)) as bigint) as input_tokens from (select kind, cast(round((length(text) / 4.0 + len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) * 1.33::double) / 2) as bigint) t from documents where text is not null) group by kind")
def estimate_cost(spark, d):
    """Documents, those too small to convert, and capped input tokens per kind."""
    t = T.estimated_tokens(F.col("text"))
    docs = table(spark, d, "documents").filter("text is not null").select("kind", t.alias("t"))
    return docs.groupBy("kind").agg(F.count("*").alias("docs"), F.count_if(F.col("t") < 300).alias("too_small"), F.sum(F.least("t", F.lit(25000))).alias("input_tokens"))


@reg.query("late_rows", "select date_trunc('month', ts_)::date::varchar as month, count(*) as n, count(*) filter (where h > 24) as late, cast(max(h) as bigint) as most_hours from (select try_cast(date as timestamp) ts_, date_diff('hour', try_cast(date as timestamp), loaded_at) h from documents where length(date) = 10) where ts_ is not null group by 1")
def late_rows(spark, d):
    """Rows that were loaded more than a day after their own date, per month."""
    ts = F.expr("try_cast(date as timestamp)")
    docs = table(spark, d, "documents").filter("length(date) = 10").select(ts.alias("t"), "loaded_at").filter("t is not null")
    hours = F.floor(F.unix_timestamp("loaded_at") / 3600) - F.floor(F.unix_timestamp("t") / 3600)
    rows = docs.select(F.date_format(F.date_trunc("month", "t"), "yyyy-MM-dd").alias("month"), hours.alias("h"))
    return rows.groupBy("month").agg(F.count("*").alias("n"), F.count_if(F.col("h") > 24).alias("late"), F.max("h").alias("most_hours"))


# ---------------------------------------------------------------- windows over the event stream
@reg.query("tumbling", "select event_type, strftime(time_bucket(interval 1 hour, ts), '%Y-%m-%d %H:%M') as start, count(*) as n, round(sum(value), 4) as total from events group by all")
def tumbling(spark, d):
    w = F.window("ts", "1 hour")
    return table(spark, d, "events").groupBy("event_type", w.alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select("event_type", F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "n", "total")


@reg.query("sliding", "select event_type, strftime(time_bucket(interval 30 minute, ts) - k * interval 30 minute, '%Y-%m-%d %H:%M') as start, count(*) as n from events, (values (0), (1)) t(k) group by all")
def sliding(spark, d):
    w = F.window("ts", "1 hour", "30 minutes")
    return table(spark, d, "events").groupBy("event_type", w.alias("w")).agg(F.count("*").alias("n")).select("event_type", F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "n")


@reg.query(
    "sessions",
    "with o as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 12 hour then 0 else 1 end s from events where user_id is not null), g as (select user_id, ts, sum(s) over (partition by user_id order by ts rows unbounded preceding) g from o) select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as n from g group by user_id, g",
)
def sessions(spark, d):
    """Sessions of a user end after twelve hours without an event."""
    e = table(spark, d, "events").filter("user_id is not null")
    # no gap lies within an hour, so a user with a third of all events comes down to one row an hour before anything is shuffled
    hours = e.groupBy("user_id", F.date_trunc("hour", "ts").alias("hour")).agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n"))
    of_user = Window.partitionBy("user_id").orderBy("hour")
    gap = F.col("a") - F.lag("b").over(of_user)
    opened = hours.withColumn("opens", F.when(gap < F.expr("interval 12 hours"), 0).otherwise(1))
    numbered = opened.withColumn("session", F.sum("opens").over(of_user.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("user_id", "session").agg(F.min("a").alias("a"), F.sum("n").alias("n")).select("user_id", F.date_format("a", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@reg.query(
    "cost_bands",
    "with e as (select user_id, ts, event_id, sum(length(props)) over (partition by user_id order by ts, event_id rows unbounded preceding) total, length(props) c from events where user_id is not null) select user_id, event_id, cast(floor(total / 200) as bigint) as band from e where floor(total / 200) > floor((total - c) / 200)",
)
def cost_bands(spark, d):
    """The rows at which a user's running total of characters enters a new band of 200."""
    e = table(spark, d, "events").filter("user_id is not null").select("user_id", "ts", "event_id", F.to_date("ts").alias("day"), F.length("props").alias("c"))
    total = L.running_total(e, "user_id", "day", ["ts", "event_id"], "c")
    return total.filter(F.floor(F.col("total") / 200) > F.floor((F.col("total") - F.col("c")) / 200)).select("user_id", "event_id", F.floor(F.col("total") / 200).alias("band"))


@reg.query("offset_delta", "select event_id, user_id, cast(date_diff('second', lag(date_trunc('second', ts)) over (partition by user_id order by ts, event_id), date_trunc('second', ts)) as bigint) as seconds, round(value - lag(value) over (partition by user_id order by ts, event_id), 6) as delta from events where user_id is not null")
def offset_delta(spark, d):
    """What is new since the user's previous event."""
    e = table(spark, d, "events").filter("user_id is not null").select("event_id", "user_id", "ts", "value", F.to_date("ts").alias("day"))
    p = L.previous(e, "user_id", "day", ["ts", "event_id"], ["ts", "value"])
    seconds = F.unix_timestamp("ts") - F.unix_timestamp("prev.ts")
    return p.select("event_id", "user_id", seconds.alias("seconds"), F.round(F.col("value") - F.col("prev.value"), 6).alias("delta"))


@reg.query("stale_guard", "with e as (select event_id, user_id, value, max(value) over (partition by user_id, event_type order by ts, event_id rows between unbounded preceding and 1 preceding) best from events where user_id is not null and event_type is not null) select event_id, user_id from e where value < 0.8 * best")
def stale_guard(spark, d):
    """Rows that shrink below four fifths of the largest value so far of the user and type."""
    e = table(spark, d, "events").filter("user_id is not null and event_type is not null").select("event_id", "user_id", "event_type", "ts", "value", F.to_date("ts").alias("day"))
    return L.running_best(e, ["user_id", "event_type"], "day", ["ts", "event_id"], "value").filter("value < 0.8d * best").select("event_id", "user_id")
