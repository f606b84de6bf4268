"""Queries on texts: words, tokens, sentences, segments, keys, redaction."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from sedgemill.functions import text as T
from sedgemill.operators.segments import heading_segments, packed_segments, sampled_segments
from sedgemill.plans.registry import Registry
from sedgemill.session import table

reg = Registry()

STOP = ", ".join(f"'{w}'" for w in T.STOP)
#: DuckDB: the content words of a text, the identifier tokens of a name, one stem.
WORDS = "list_filter(regexp_extract_all(lower({0}), '[a-z][a-z''-]{{3,}}'), lambda w: w not in (" + STOP + "))"
TOKENS = (
    "flatten(list_transform(regexp_extract_all({0}, '[A-Za-z0-9]+'), lambda r: list_concat(string_split(lower(regexp_replace(r, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), ' '), [lower(r)])))"
)
STEM = "case " + " ".join(f"when {{0}} like '%{s}' and length({{0}}) > {len(s) + 2} then left({{0}}, length({{0}}) - {len(s)})" for s in T.SUFFIXES) + " else {0} end"
ESTIMATE = "cast(round((length({0}) / 4.0 + len(list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: w <> '')) * 1.33::double) / 2) as bigint)"


@reg.query(
    "top_words",
    f"""
with w as (select doc_id, unnest({WORDS.format('text')}) word, generate_subscripts({WORDS.format('text')}, 1) pos from documents),
g as (select doc_id, word, count(*) n, min(pos) first from w group by all)
select doc_id, word, n, cast(row_number() over (partition by doc_id order by n desc, first) as integer) as rank from g qualify rank <= 10
""",
)
def top_words(spark, d):
    words = table(spark, d, "documents").select("doc_id", F.posexplode(T.content_words(F.col("text"))).alias("pos", "word"))
    counts = words.groupBy("doc_id", "word").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "first"))
    return counts.withColumn("rank", rank).filter("rank <= 10").drop("first")


@reg.query("proper_nouns")
def proper_nouns(spark, d):
    # fixed value: runs of one to three capitalised words, not at the start of a line or sentence
    runs = F.regexp_extract_all("text", F.lit(r"(?m)(?<![.!?]\s)(?<!^)\b([A-Z][a-z]{2,}(?:\s[A-Z][a-z]{2,}){0,2})\b"), 1)
    found = table(spark, d, "documents").select("doc_id", F.posexplode(runs).alias("pos", "noun")).filter(~F.lower("noun").isin(*T.STOP))
    counts = found.groupBy("doc_id", "noun").agg(F.count("*").alias("n"), F.min("pos").alias("first")).filter("n > 1")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "first"))
    return counts.withColumn("rank", rank).filter("rank <= 12").drop("first")


@reg.query("token_count", f"select doc_id, {ESTIMATE.format('text')} as n_tokens, cast(ceil(length(text) / 4.0) as bigint) as n_quarter from documents where text is not null")
def token_count(spark, d):
    docs = table(spark, d, "documents").filter("text is not null")
    return docs.select("doc_id", T.estimated_tokens(F.col("text")).alias("n_tokens"), F.ceil(F.length("text") / 4.0).cast("long").alias("n_quarter"))


@reg.query("ident_tokens", f"select distinct symbol_id, array_to_string({TOKENS.format('name')}, ' ') as tokens from symbols")
def ident_tokens(spark, d):
    return table(spark, d, "symbols").select("symbol_id", F.array_join(T.identifier_tokens(F.col("name")), " ").alias("tokens")).distinct()


@reg.query(
    "stem_tokens",
    f"select distinct symbol_id, array_to_string(list_transform({TOKENS.format('brief')}, lambda w: {STEM.format('w')}), ' ') as tokens from symbols where brief is not null",
)
def stem_tokens(spark, d):
    rows = table(spark, d, "symbols").filter("brief is not null")
    return rows.select("symbol_id", F.array_join(T.stem_tokens(F.col("brief")), " ").alias("tokens")).distinct()


@reg.query(
    "expand_query",
    f"""
with syn(word, other) as (values {", ".join(f"('{k}', '{v}')" for k, vs in T.SYNONYMS.items() for v in vs)}),
s as (select {STEM.format('word')} w, {STEM.format('other')} o from syn),
q as (select distinct item_id, question from test_items),
t as (select item_id, unnest(list_distinct(list_transform({TOKENS.format('question')}, lambda w: {STEM.format('w')}))) term from q)
select item_id, term, count(*) filter (where src = 's') as added from
  (select item_id, term, 'q' src from t union all select item_id, o, 's' from t join s on s.w = t.term) group by item_id, term
""",
)
def expand_query(spark, d):
    rows = [(k, v) for k, vs in T.SYNONYMS.items() for v in vs]
    synonyms = spark.createDataFrame(rows, "word string, other string").select(T.stem(F.col("word")).alias("term"), T.stem(F.col("other")).alias("other"))
    terms = table(spark, d, "test_items").select("item_id", "question").distinct().select("item_id", F.explode(F.array_distinct(T.stem_tokens(F.col("question")))).alias("term"))
    added = terms.join(F.broadcast(synonyms), "term").select("item_id", F.col("other").alias("term"), F.lit(1).alias("a"))
    return terms.withColumn("a", F.lit(0)).unionByName(added).groupBy("item_id", "term").agg(F.sum("a").cast("long").alias("added"))


@reg.query(
    "sentence_split",
    """
with f as (select doc_id, regexp_replace(text, '\\s+', ' ', 'g') t from documents where text is not null),
p as (select doc_id, string_split(regexp_replace(t, '([.!?])\\s+([A-Z"''(])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) ps from f),
l as (select doc_id, list_filter(list_transform(ps, lambda s: trim(s)), lambda s: length(s) > 20) ss from p)
select doc_id, cast(generate_subscripts(ss, 1) as integer) n, unnest(ss) sentence from l
""",
)
def sentence_split(spark, d):
    docs = table(spark, d, "documents").filter("text is not null")
    return docs.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("n", "sentence")).withColumn("n", F.col("n") + 1)


@reg.query(
    "doc_ids",
    "select doc_id, concat_ws('_', kind, replace(date, '-', ''), left(sha256(text), 8)) as id, trim(regexp_replace(lower(left(text, 60)), '[^a-z0-9]+', '-', 'g'), '-') as slug from documents where text is not null",
)
def doc_ids(spark, d):
    docs = table(spark, d, "documents").filter("text is not null")
    return docs.select("doc_id", T.document_id(F.col("kind"), F.col("date"), F.col("text")).alias("id"), T.slug(F.substring("text", 1, 60)).alias("slug"))


@reg.query("last_ident", r"select edge_id, regexp_extract(trim(regexp_extract(dst, '^[^(<!]*', 0)), '([^.:>\-\s]*)$', 1) as name from edges where dst is not null")
def last_ident(spark, d):
    return table(spark, d, "edges").filter("dst is not null").select("edge_id", T.last_identifier(F.col("dst")).alias("name"))


@reg.query("declaration_line", r"select file_id, trim(regexp_extract(code, '^[^\n{]*', 0)) as line from source_files where code is not null")
def declaration_line(spark, d):
    return table(spark, d, "source_files").filter("code is not null").select("file_id", T.declaration_line(F.col("code")).alias("line"))


@reg.query("label_norm", "select translate(lower(name), '_-', '') as label, count(distinct name) as names, count(distinct symbol_id) as n from symbols group by 1")
def label_norm(spark, d):
    return table(spark, d, "symbols").groupBy(T.label_key(F.col("name")).alias("label")).agg(F.countDistinct("name").alias("names"), F.countDistinct("symbol_id").alias("n"))


@reg.query(
    "shingle_frequency",
    "with n as (select distinct name from symbols), s as (select name, unnest(list_distinct(list_transform(range(1, length(name) - 1), lambda i: substr(name, i, 3)))) g from n where length(name) >= 3 union all select name, name from n where length(name) between 1 and 2) select g as shingle, count(*) as names from s group by g",
)
def shingle_frequency(spark, d):
    names = table(spark, d, "symbols").select("name").distinct()
    return names.select(F.explode(T.shingles(F.col("name"))).alias("shingle")).groupBy("shingle").agg(F.count("*").alias("names"))


@reg.query(
    "token_f1",
    f"""
with h as (select distinct id, title, summary from history_manifest where title is not null and summary is not null),
c as (select id, w, count(*) n from (select id, unnest(list_filter(regexp_extract_all(lower(title), '[a-z0-9'']+'), lambda w: w not in ({STOP}))) w from h) group by all),
g as (select id, w, count(*) n from (select id, unnest(list_filter(regexp_extract_all(lower(summary), '[a-z0-9'']+'), lambda w: w not in ({STOP}))) w from h) group by all),
o as (select c.id, sum(least(c.n, g.n)) o from c join g using (id, w) group by 1),
nc as (select id, sum(n) n from c group by 1), ng as (select id, sum(n) n from g group by 1)
select h.id, round(coalesce(2.0 * o.o / (nc.n + ng.n), 0), 6) as f1 from h left join o using (id) left join nc using (id) left join ng using (id)
""",
)
def token_f1(spark, d):
    rows = table(spark, d, "history_manifest").select("id", "title", "summary").distinct().filter("title is not null and summary is not null")
    words = lambda c: F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9']+"), 0), lambda w: ~w.isin(*T.STOP))
    both = rows.select("id", words("title").alias("c"), words("summary").alias("g"))
    shared = F.aggregate(
        F.array_distinct("c"),
        F.lit(0),
        lambda acc, w: acc + F.least(F.size(F.filter("c", lambda x: x == w)), F.size(F.filter("g", lambda x: x == w))),
    )
    f1 = 2.0 * shared / F.nullif(F.size("c") + F.size("g"), F.lit(0))
    return both.select("id", F.round(F.coalesce(f1, F.lit(0.0)), 6).alias("f1"))


@reg.query(
    "tag_candidates",
    r"""
with tags as (select distinct lower(unnest(topics)) tag from history_manifest),
w as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) tag from documents),
s as (select doc_id, tag, count(*) score from w join tags using (tag) group by all)
select doc_id, tag, score, cast(row_number() over (partition by doc_id order by score desc, tag) as integer) as rank from s qualify rank <= 10
""",
)
def tag_candidates(spark, d):
    """Topics of the store that a document holds as whole words, by how often."""
    tags = table(spark, d, "history_manifest").select(F.explode("topics").alias("tag")).select(F.lower("tag").alias("tag")).distinct()
    words = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+"), 0)).alias("tag"))
    scores = words.groupBy("doc_id", "tag").agg(F.count("*").alias("score")).join(tags, "tag", "left_semi")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "tag"))
    return scores.withColumn("rank", rank).filter("rank <= 10")


@reg.query(
    "unwrap",
    r"""
with p as (select doc_id, regexp_split_to_array(replace(text, chr(13) || chr(10), chr(10)), '\n\n+') ps from documents where text is not null)
select doc_id, array_to_string(list_transform(ps, lambda p: case when regexp_matches(p, '(?m)^\s*(?:[-*>#]|\d+[.)])') then p else regexp_replace(p, '\s*\n\s*', ' ', 'g') end), chr(10) || chr(10)) as text from p
""",
)
def unwrap(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", T.unwrapped(F.col("text")).alias("text"))


@reg.query("html_clean")
def html_clean(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", T.without_html(F.col("text")).alias("text"))


@reg.query("redact_secrets")
def redact_secrets(spark, d):
    docs = table(spark, d, "documents").filter("text is not null")
    return docs.select("doc_id", T.redacted(F.col("text")).alias("text"), T.secret_counts(F.col("text")).alias("found"))


@reg.query(
    "card_scrub",
    r"""
with r as (select distinct id, unnest(list_transform(regexp_extract_all(summary, '\d(?:[ -]?\d){12,18}'), lambda x: regexp_replace(x, '[ -]', '', 'g'))) n from history_manifest),
s as (select id, n, list_sum(list_transform(range(0, length(n)), lambda i: case when i % 2 = 1 then (case when substr(n, length(n) - i, 1)::int > 4 then substr(n, length(n) - i, 1)::int * 2 - 9 else substr(n, length(n) - i, 1)::int * 2 end) else substr(n, length(n) - i, 1)::int end)) t from r)
select id, n as digits, t % 10 = 0 as valid from s
""",
)
def card_scrub(spark, d):
    runs = F.transform(F.regexp_extract_all("summary", F.lit(r"\d(?:[ -]?\d){12,18}"), 0), lambda r: F.regexp_replace(r, "[ -]", ""))
    found = table(spark, d, "history_manifest").select("id", F.explode(runs).alias("digits")).distinct()
    return found.select("id", "digits", T.luhn_valid(F.col("digits")).alias("valid"))


@reg.query(
    "rolling_hash",
    "select distinct symbol_id, cast(case when h >= 2147483648 then h - 4294967296 else h end as bigint) as h from (select symbol_id, list_reduce(list_concat([0::hugeint], list_transform(string_split(name, ''), lambda c: unicode(c)::hugeint)), lambda a, x: (a * 31 + x) % 4294967296) h from symbols where name is not null)",
)
def rolling_hash(spark, d):
    return table(spark, d, "symbols").filter("name is not null").select("symbol_id", T.rolling_hash(F.col("name")).alias("h")).distinct()


@reg.query(
    "versions",
    r"""
with v as (select doc_id, unnest(regexp_extract_all(text, 'v(\d+(?:\.\d+)+)', 1)) v from documents),
k as (select doc_id, v, array_to_string(list_transform(string_split(v, '.'), lambda p: lpad(p, 6, '0')), '.') k from v)
select doc_id, arg_max(v, k) as newest, arg_min(v, k) as oldest, count(*) as n from k group by doc_id
""",
)
def versions(spark, d):
    found = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"v(\d+(?:\.\d+)+)"), 1)).alias("v"))
    keyed = found.withColumn("k", T.version_key(F.col("v")))
    return keyed.groupBy("doc_id").agg(F.max_by("v", "k").alias("newest"), F.min_by("v", "k").alias("oldest"), F.count("*").alias("n"))


@reg.query("heading_segments")
def heading_segments_(spark, d):
    """module#slug, title and length of every headed part of a document."""
    return heading_segments(table(spark, d, "documents")).select("doc_id", "n", "segment_id", "title", F.length("body").alias("n_chars"))


@reg.query(
    "segment_pack",
    rf"""
with recursive p as (
  select doc_id, generate_subscripts(ps, 1) n, unnest(ps) para from (select doc_id, regexp_split_to_array(replace(text, chr(13) || chr(10), chr(10)), '\n\n+') ps from documents where text is not null)
), t as (select doc_id, n, {ESTIMATE.format('para')} tok from p),
r as (
  select doc_id, n, tok, tok used, 1 seg from t where n = 1
  union all
  select t.doc_id, t.n, t.tok, case when r.used + t.tok > 200 then t.tok else r.used + t.tok end, case when r.used + t.tok > 200 then r.seg + 1 else r.seg end
  from r join t on t.doc_id = r.doc_id and t.n = r.n + 1
)
select doc_id, cast(seg as integer) as segment, cast(sum(tok) as bigint) as n_tokens, count(*) as paragraphs from r group by doc_id, seg
""",
)
def segment_pack(spark, d):
    return packed_segments(table(spark, d, "documents"), budget=200)


@reg.query("cap_sample")
def cap_sample(spark, d):
    return sampled_segments(table(spark, d, "documents"), budget=200, cap=600)
