"""Ranked search. The stated query set: the first line of every document whose id is divisible by 50."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from sedgemill.functions import text as T
from sedgemill.operators import ranking as R
from sedgemill.operators.blocked import best, reaching
from sedgemill.operators.segments import paragraphs
from sedgemill.plans.registry import Registry
from sedgemill.plans.text import ESTIMATE, STEM, TOKENS, WORDS
from sedgemill.session import cut, table

reg = Registry()

ASKED = "asked as (select doc_id as item_id, regexp_extract(text, '^[^\\n\\r]*', 0) question from documents where doc_id % 50 = 0 and text is not null)"
ENTRIES = """
h as (select distinct id, date, title, summary, topics, entities, attrs, tags from history_manifest),
e as (select id, concat_ws(' ', title, summary, array_to_string(topics, ' '), array_to_string(list_filter(entities, lambda x: x is not null), ' '), array_to_string(tags, ' ')) body from h)
"""
BM25 = f"""
t as (select id, {TOKENS.format('body')} ts from e),
n as (select count(*) n, avg(len(ts)) mean from t),
p as (select id, term, count(*) tf, any_value(dl) dl from (select id, len(ts) dl, unnest(ts) term from t) group by id, term),
w as (select item_id, term, count(*) n from (select item_id, unnest({TOKENS.format('question')}) term from asked) group by all),
df as (select term, count(*) df from p group by term),
s as (select w.item_id, p.id, sum(w.n * greatest(1e-6, ln(1 + (n.n - df + 0.5) / (df + 0.5))) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / n.mean))) score
      from w join df using (term) join p using (term), n group by all)
"""


def asked(spark, d):
    docs = table(spark, d, "documents").filter("doc_id % 50 = 0 and text is not null")
    return docs.select(F.col("doc_id").alias("item_id"), F.regexp_extract("text", r"^[^\n\r]*", 0).alias("question"))


def entries(spark, d):
    return table(spark, d, "history_manifest").select("id", "date", "title", "summary", "topics", "entities", "attrs", "tags").distinct()


def search_text():
    """Title, summary, topics, entities and tags of an entry."""
    return F.concat_ws(" ", "title", "summary", F.array_join("topics", " "), F.array_join("entities", " "), F.array_join("tags", " "))


def _search(spark, d):
    """Entries, weighted terms of the questions, and how counts are weighed."""
    tokens = T.identifier_tokens(search_text())
    docs = cut(R.whole(entries(spark, d).select("id", tokens.alias("terms"), F.size(tokens).alias("dl")), "id"), "entries")
    wanted = asked(spark, d).select("item_id", F.explode(T.identifier_tokens(F.col("question"))).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("n"))
    return docs, *R.searched(docs, cut(wanted, "wanted"), "item_id")


def _bm25(spark, d, k):
    docs, wanted, weigh = _search(spark, d)
    return best(docs, wanted, "item_id", ["id"], k, weigh=weigh)


def paragraph_words(spark, d, only=None):
    """doc_id, n, terms: the distinct content words of every paragraph; ``only``: of these documents (doc_id)."""
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", "text")
    split = lambda x: x.select("doc_id", F.posexplode(paragraphs(F.col("text"))).alias("n", "para")).select("doc_id", (F.col("n") + 1).alias("n"), F.array_distinct(T.content_words(F.col("para"))).alias("terms"))
    parts = split(docs if only is None else docs.join(only, "doc_id", "left_semi"))
    if docs.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return parts
    # paragraphs of one number in rows of one document are one
    return parts.groupBy("doc_id", "n").agg(F.flatten(F.collect_list("terms")).alias("terms")).repartition("doc_id")


@reg.query(
    "score_entries",
    f"""
with {ASKED}, {ENTRIES},
f as (select id, 1 weight, concat_ws(' ', coalesce(title, ''), coalesce(summary, '')) x from h union all select id, 2, array_to_string(topics, ' ') from h
      union all select id, 3, array_to_string(list_filter(list_concat(coalesce(entities, []), coalesce(attrs, [])), lambda x: x is not null), ' ') from h),
words as (select id, weight, unnest(list_distinct({WORDS.format('x')})) w from f),
q as (select item_id, unnest(list_distinct({WORDS.format('question')})) w from asked),
s as (select item_id, id, cast(sum(weight) as bigint) score from words join q using (w) group by all)
select item_id, id, score, cast(row_number() over (partition by item_id order by score desc, id) as integer) as rank from s qualify rank <= 10
""",
)
def score_entries(spark, d):
    """Weighted word overlap: text once, topics twice, names three times; the ten best entries of each question."""
    return R.top(R.entry_scores(entries(spark, d), asked(spark, d), 10), "item_id", "score", "id", 10)


@reg.query(
    "manifest_prefilter",
    f"""
with {ASKED}, {ENTRIES}, q as (select item_id, list_distinct({WORDS.format('question')}) ws from asked),
m as (select item_id, id, len(list_filter(ws, lambda w: contains(lower(body), w))) hits from q, e where len(ws) > 0)
select item_id, count(*) filter (where hits > 0) as kept, max(hits) as most from m group by item_id
""",
)
def manifest_prefilter(spark, d):
    """How many entries hold any content word of the question as a substring."""
    q = asked(spark, d).select("item_id", F.array_distinct(T.content_words(F.col("question"))).alias("ws")).filter("size(ws) > 0")
    words = cut(q.select("item_id", F.explode("ws").alias("term")).groupBy("item_id", "term").agg(F.count("*").cast("double").alias("w")), "asked")
    # a word lies within one run of the characters that words have: the distinct runs are searched, not the texts
    e = entries(spark, d)
    runs = cut(e.select(F.xxhash64(*e.columns).alias("row"), "id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(search_text()), F.lit("[a-z'-]{4,}"), 0))).alias("run")), "runs")
    vocabulary = cut(runs.select("run").distinct(), "vocabulary")
    holds = R.contained_words(vocabulary.select(F.col("run").alias("id"), F.col("run").alias("body")), words.select(F.col("term").alias("word"))).select(F.col("id").alias("run"), "word")
    held = runs.join(holds, "run").groupBy("id", "row").agg(F.collect_set("word").alias("terms"))
    counts = reaching(held, words.withColumn("least", F.lit(1.0)), "item_id", ["id", "row"])
    return q.select("item_id").join(counts, "item_id", "left").select("item_id", F.coalesce("hits", F.lit(0)).alias("kept"), F.coalesce("most", F.lit(0)).cast("long").alias("most"))


@reg.query(
    "bm25_topk",
    f"with {ASKED}, {ENTRIES}, {BM25} select item_id, id, round(score, 6) as score, cast(row_number() over (partition by item_id order by round(score, 6) desc, id) as integer) as rank from s qualify rank <= 5",
)
def bm25_topk(spark, d):
    return R.top(_bm25(spark, d, 5), "item_id", "score", "id", 5)


@reg.query(
    "half_of_top",
    f"with {ASKED}, {ENTRIES}, {BM25}, m as (select *, max(score) over (partition by item_id) top from s) select item_id, count(*) as hits, round(max(score), 6) as best from m where round(score, 6) >= round(0.5 * round(top, 6), 6) group by item_id",
)
def half_of_top(spark, d):
    """How many entries score at least half of the best one."""
    docs, wanted, weigh = _search(spark, d)
    hits = reaching(docs, R.half_bars(docs, wanted, "item_id", "id", weigh), "item_id", ["id"], weigh)
    return hits.select("item_id", "hits", F.col("most").alias("best"))


@reg.query(
    "two_stage",
    f"""
with {ASKED}, {ENTRIES}, {BM25},
c as (select item_id, id, round(score, 6) score, row_number() over (partition by item_id order by round(score, 6) desc, id) r from s qualify r <= 12),
tw as (select id, list_distinct({TOKENS.format("coalesce(title, '')")}) tw from h), qw as (select item_id, list_distinct({TOKENS.format('question')}) qw from asked),
b as (select c.item_id, c.id, round(score + 2.0 * len(list_filter(tw, lambda w: list_contains(qw, w))), 6) score from c join tw using (id) join qw using (item_id))
select item_id, id, score, cast(row_number() over (partition by item_id order by score desc, id) as integer) as rank from b qualify rank <= 5
""",
)
def two_stage(spark, d):
    """The twelve best by BM25, ranked again with two points for every question token in the title."""
    candidates = R.top(_bm25(spark, d, 12), "item_id", "score", "id", 12).drop("rank")
    titles = entries(spark, d).select("id", F.array_distinct(T.identifier_tokens(F.coalesce("title", F.lit("")))).alias("tw"))
    questions = asked(spark, d).select("item_id", F.array_distinct(T.identifier_tokens(F.col("question"))).alias("qw"))
    joined = candidates.join(titles, "id").join(questions, "item_id")
    bonus = joined.select("item_id", "id", F.round(F.col("score") + 2.0 * T.overlap(F.col("tw"), F.col("qw")), 6).alias("score"))
    return R.top(bonus, "item_id", "score", "id", 5)


FIELDS = {"title": 3.0, "topics": 2.5, "entities": 2.0, "tags": 1.5, "summary": 1.0}


@reg.query(
    "bm25f_topk",
    f"""
with {ASKED}, {ENTRIES},
f as ({" union all ".join(f"select id, '{k}' field, {w} weight, " + (f"coalesce({k}, '')" if k in ("title", "summary") else f"coalesce(array_to_string(list_filter({k}, lambda x: x is not null), ' '), '')") + " x from h" for k, w in FIELDS.items())}),
t as (select id, field, weight, list_transform({TOKENS.format('x')}, lambda w: {STEM.format('w')}) ts from f),
m as (select field, avg(len(ts)) mean from t group by field),
n as (select count(distinct id) n from t),
p as (select id, field, weight, term, count(*) tf, any_value(dl) dl from (select id, field, weight, len(ts) dl, unnest(ts) term from t) group by all),
g as (select id, term, sum(weight * tf / (0.25 + 0.75 * dl / mean)) wtf from p join m using (field) group by all),
df as (select term, count(*) df from g group by term),
w as (select distinct item_id, unnest(list_transform({TOKENS.format('question')}, lambda w: {STEM.format('w')})) term from asked),
s as (select item_id, id, round(sum(greatest(1e-6, ln(1 + (n.n - df + 0.5) / (df + 0.5))) * wtf * 2.4 / (wtf + 1.4)), 6) score from w join df using (term) join g using (term), n group by all)
select item_id, id, score, cast(row_number() over (partition by item_id order by score desc, id) as integer) as rank from s qualify rank <= 5
""",
)
def bm25f_topk(spark, d):
    """BM25 over weighted fields with a length norm per field; each distinct question term counts once."""
    none = F.array().cast("array<string>")
    text = lambda k: F.coalesce(k, F.lit("")) if k in ("title", "summary") else F.array_join(F.coalesce(k, none), " ")
    t = cut(entries(spark, d).select("id", *[T.stem_tokens(text(k)).alias(k) for k in FIELDS]), "fields")
    means = t.agg(F.countDistinct("id").alias("n"), *[F.avg(F.size(k)).alias(k) for k in FIELDS]).first()
    share = lambda k, w: F.transform(k, lambda x: F.lit(w) / (0.25 + 0.75 * F.size(k) / F.lit(means[k] or 1.0)))
    rows = t.select("id", F.concat(*FIELDS).alias("terms"), F.concat(*[share(k, w) for k, w in FIELDS.items()]).alias("v"))
    docs = rows.groupBy("id").agg(F.flatten(F.collect_list("terms")).alias("terms"), F.flatten(F.collect_list("v")).alias("v"))
    wanted = cut(asked(spark, d).select("item_id", F.explode(F.array_distinct(T.stem_tokens(F.col("question")))).alias("term")).distinct(), "wanted")
    weighted = cut(wanted.join(R.document_counts(docs, wanted), "term").select("item_id", "term", R.rarity(means["n"]).alias("w")), "asked")
    return R.top(best(docs, weighted, "item_id", ["id"], 5, weigh=lambda wtf, _: wtf * 2.4 / (wtf + 1.4)), "item_id", "score", "id", 5)


@reg.query("adaptive_k", f"select sum(t) as source_tokens, cast(case when sum(t) <= 200000 then 5 else 8 end as integer) as k, kind from (select kind, {ESTIMATE.format('text')} t from documents where text is not null) group by kind")
def adaptive_k(spark, d):
    """How many documents a question may open, by the size of its source."""
    sizes = table(spark, d, "documents").filter("text is not null").groupBy("kind").agg(F.sum(T.estimated_tokens(F.col("text"))).alias("source_tokens"))
    return sizes.withColumn("k", F.when(F.col("source_tokens") <= 200000, 5).otherwise(8))


@reg.query(
    "rank_fusion",
    f"""
with {ASKED}, {ENTRIES}, {BM25},
a as (select item_id, id, row_number() over (partition by item_id order by round(score, 6) desc, id) r from s qualify r <= 15),
f as (select id, 1 weight, concat_ws(' ', coalesce(title, ''), coalesce(summary, '')) x from h union all select id, 2, array_to_string(topics, ' ') from h
      union all select id, 3, array_to_string(list_filter(list_concat(coalesce(entities, []), coalesce(attrs, [])), lambda x: x is not null), ' ') from h),
ow as (select id, weight, unnest(list_distinct({WORDS.format('x')})) w from f), oq as (select item_id, unnest(list_distinct({WORDS.format('question')})) w from asked),
o as (select item_id, id, sum(weight) score from ow join oq using (w) group by all),
b as (select item_id, id, row_number() over (partition by item_id order by score desc, id) r from o qualify r <= 15),
u as (select item_id, id, round(sum(1.0 / r), 6) score from (select * from a union all select * from b) group by all)
select item_id, id, score, cast(row_number() over (partition by item_id order by score desc, id) as integer) as rank from u qualify rank <= 10
""",
)
def rank_fusion(spark, d):
    """Reciprocal ranks of BM25 and of weighted overlap, fifteen of each, summed."""
    lexical = R.top(_bm25(spark, d, 15), "item_id", "score", "id", 15)
    weighted = R.top(R.entry_scores(entries(spark, d), asked(spark, d), 15), "item_id", "score", "id", 15)
    return R.top(R.reciprocal_fusion([lexical, weighted], "item_id", "id"), "item_id", "score", "id", 10)


@reg.query(
    "span_diversity",
    f"""
with {ASKED}, p as (select doc_id, generate_subscripts(ps, 1) n, unnest(ps) para from (select doc_id, regexp_split_to_array(replace(text, chr(13) || chr(10), chr(10)), '\\n\\n+') ps from documents where text is not null)),
w as (select doc_id, n, unnest(list_distinct({WORDS.format('para')})) w from p), q as (select item_id, unnest(list_distinct({WORDS.format('question')})) w from asked),
s as (select item_id, doc_id, n, count(*) score from w join q using (w) group by all),
c as (select *, row_number() over (partition by item_id, doc_id order by score desc, n) r from s qualify r <= 2)
select item_id, doc_id, cast(n as integer) as n, score, cast(row_number() over (partition by item_id order by score desc, doc_id, n) as integer) as rank from c qualify rank <= 5
""",
)
def span_diversity(spark, d):
    """The five best paragraphs of each question, at most two of one document."""
    two = best(paragraph_words(spark, d), cut(R.asked_words(asked(spark, d)), "asked"), "item_id", ["doc_id", "n"], 5, per=2)
    # the two best of a document are in one task, unless its rows are apart
    of_doc = F.row_number().over(Window.partitionBy("item_id", "doc_id").orderBy(F.desc("score"), "n"))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id", "n"))
    return two.withColumn("r", of_doc).filter("r <= 2").drop("r").withColumn("rank", rank).filter("rank <= 5").withColumn("score", F.col("score").cast("long"))


@reg.query(
    "rare_probes",
    f"""
with w as (select doc_id, unnest(list_distinct({WORDS.format('text')})) w from documents),
df as (select w, count(*) df from w group by w having count(*) <= 4),
q as (select distinct item_id, unnest(list_distinct({WORDS.format("question || ' ' || text")})) w from test_items),
s as (select q.item_id, w.doc_id, count(*) probes from q join df using (w) join w using (w) group by all)
select item_id, doc_id, probes, cast(row_number() over (partition by item_id order by probes desc, doc_id) as integer) as rank from s where probes >= 2 qualify rank <= 2
""",
)
def rare_probes(spark, d):
    """Full-text fallback: words in at most four documents, the two documents that hold most of an item's."""
    words = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(T.content_words(F.col("text")))).alias("w"))
    rare = words.groupBy("w").agg(F.count("*").alias("df")).filter("df <= 4").select("w")
    probes = table(spark, d, "test_items").select("item_id", F.explode(F.array_distinct(T.content_words(F.concat_ws(" ", "question", "text")))).alias("w")).distinct()
    asked_rare = probes.join(rare, "w", "left_semi")
    scored = words.join(asked_rare, "w").groupBy("item_id", "doc_id").agg(F.count("*").alias("probes")).filter("probes >= 2")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("probes"), "doc_id"))
    return scored.withColumn("rank", rank).filter("rank <= 2")


# ---------------------------------------------------------------- vectors
_COS = "list_dot_product(q.e, v.e) / nullif(sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e)), 0)"
VECTORS = "v as (select vec_id, label, list_transform(embedding, lambda x: x::double) e from embeddings), q as (select * from v where vec_id % 50 = 0)"


def _vectors(spark, d):
    """All vectors, and as queries every one whose id is divisible by 50."""
    v = table(spark, d, "embeddings").filter("embedding is not null").select("vec_id", "label", "embedding")
    return v, v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


@reg.query(
    "cosine_topk",
    f"with {VECTORS}, s as (select q.vec_id query_id, v.vec_id, round({_COS}, 6) score from q join v on q.vec_id <> v.vec_id) select query_id, vec_id, score, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s where score > 0.25 qualify rank <= 10",
)
def cosine_topk(spark, d):
    """The ten most similar vectors above the floor of 0.25."""
    v, q = _vectors(spark, d)
    return R.nearest(v, q, 10).filter("score > 0.25")


@reg.query(
    "cosine_margin",
    f"with {VECTORS}, s as (select q.vec_id query_id, v.vec_id, round({_COS}, 6) score from q join v on q.vec_id <> v.vec_id), m as (select *, max(score) over (partition by query_id) best from s) select query_id, count(*) as hits, max(score) as best from m where score >= round(0.75 * best, 6) and score > 0.25 group by query_id",
)
def cosine_margin(spark, d):
    """How many vectors reach three quarters of the best similarity."""
    v, q = _vectors(spark, d)
    best = R.nearest(v, q, 1).select("query_id", F.col("score").alias("best")).filter("best > 0.25")
    least = F.greatest(F.round(0.75 * F.col("best"), 6), F.lit(0.250001))  # scores have six digits
    bars = cut(q.join(best, "query_id").select("query_id", "q", "best", least.alias("least")), "bars")
    return R.similar_counts(v, bars).join(bars.select("query_id", "best"), "query_id").select("query_id", "hits", "best")


@reg.query(
    "vector_recall",
    f"with {VECTORS}, s as (select q.vec_id query_id, q.label = v.label same, round({_COS}, 6) score, v.vec_id from q join v on q.vec_id <> v.vec_id), r as (select *, row_number() over (partition by query_id order by score desc, vec_id) r from s) select cast(k as integer) as k, round(avg(hit), 6) as hit_rate from (select query_id, k, max(same::int) hit from r, (values (1), (5), (10)) t(k) where r <= k group by all) group by k",
)
def vector_recall(spark, d):
    """Share of queries with a vector of their own label among the k nearest, for k of 1, 5 and 10."""
    v, q = _vectors(spark, d)
    labels = v.select("vec_id", "label")
    ranked = R.nearest(v, q, 10).join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label")), "query_id")
    at = ranked.select("query_id", F.explode(F.filter(F.array(F.lit(1), F.lit(5), F.lit(10)), lambda k: F.col("rank") <= k)).alias("k"), (F.col("label") == F.col("query_label")).cast("int").alias("same"))
    return at.groupBy("query_id", "k").agg(F.max("same").alias("hit")).groupBy("k").agg(F.round(F.avg("hit"), 6).alias("hit_rate"))


@reg.query("hash_vectors")
def hash_vectors(spark, d):
    """A deterministic vector of each name: bytes of the digests of its words, centred, summed and normalised."""
    words = F.filter(F.split(F.lower(F.regexp_replace("name", "([a-z0-9])([A-Z])", "$1 $2")), "[^a-z0-9]+"), lambda w: w != "")
    names = table(spark, d, "symbols").select("name").distinct().filter("name is not null").select("name", words.alias("ws"))
    byte = lambda w, i: (F.conv(F.substring(F.md5(w), F.pmod(i, F.lit(16)) * 2 + 1, F.lit(2)), 16, 10).cast("double") - 128) / 128
    raw = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.aggregate("ws", F.lit(0.0), lambda s, w: s + byte(w, i)))
    vector = names.select("name", raw.alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return vector.select("name", F.array_join(F.transform("v", lambda x: F.round(F.coalesce(x / F.nullif(norm, F.lit(0.0)), F.lit(0.0)), 5).cast("string")), ",").alias("vector"))
