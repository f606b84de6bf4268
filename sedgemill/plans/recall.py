"""From a question to context rows: tallies, timelines, segments to open, shortlists, sections. Questions are those of ``plans.ranking``."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from sedgemill.functions import text as T
from sedgemill.operators import history as H
from sedgemill.operators import ranking as R
from sedgemill.operators.blocked import best, reaching
from sedgemill.operators.graph import reach, typed_edges
from sedgemill.operators.ledger import facts
from sedgemill.plans.graph import E
from sedgemill.plans.ledger import FACTS
from sedgemill.plans.ranking import ASKED, ENTRIES, asked, entries, paragraph_words
from sedgemill.plans.registry import Registry
from sedgemill.plans.text import ESTIMATE, TOKENS, WORDS
from sedgemill.session import cut, table

reg = Registry()

#: BM25 of the questions over events: every fact of kind event is a document of its own.
FACT_BM25 = f"""
ev as (select src || '#' || n id, coalesce(date, '') date, fact from facts where kind = 'event' and fact is not null and not regexp_matches(lower(fact), '^(asked about|discussed|asked |talked about)')),
t as (select id, {TOKENS.format('fact')} ts from ev), n as (select count(*) n, avg(len(ts)) mean from t),
p as (select id, term, count(*) tf, any_value(dl) dl from (select id, len(ts) dl, unnest(ts) term from t) group by id, term),
w as (select item_id, term, count(*) n from (select item_id, unnest({TOKENS.format('question')}) term from asked) group by all),
df as (select term, count(*) df from p group by term),
s as (select w.item_id, p.id, round(sum(w.n * greatest(1e-6, ln(1 + (n.n - df + 0.5) / (df + 0.5))) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / n.mean))), 6) score
      from w join df using (term) join p using (term), n group by all),
m as (select s.*, ev.date, ev.fact, max(score) over (partition by item_id) top from s join ev using (id))
"""


def _event_rows(spark, d):
    events = facts(table(spark, d, "history_manifest")).filter("kind = 'event'")
    return events.select(F.concat_ws("#", "src", "n").alias("id"), F.coalesce("date", F.lit("")).alias("date"), "fact")


@reg.query(
    "tally_answers",
    f"with {ASKED}, {FACTS}, {FACT_BM25}, u as (select distinct item_id, date, lower(trim(fact)) f from m where score > 0 and score >= round(0.5 * top, 6)) select item_id, count(*) as occurrences from u group by item_id",
)
def tally_answers(spark, d):
    """How often the asked thing happened: events of at least half the best score, once per date and wording; topic rows do not count."""
    return H.tally(_event_rows(spark, d), asked(spark, d))


@reg.query(
    "timeline_answers",
    f"""with {ASKED}, {FACTS}, {FACT_BM25}, k as (select *, row_number() over (partition by item_id order by score desc, id) r from m where score > 0),
hits as (select * from k where r <= 8)
select item_id, min(nullif(date, '')) as first_date, max(date) as last_date, arg_min(date, r) as best_date, cast(date_diff('day', try_cast(min(nullif(date, '')) as date), try_cast(max(date) as date)) as integer) as days from hits group by item_id""",
)
def timeline_answers(spark, d):
    """Earliest, latest and best date of the eight most relevant events of each question, and the days between."""
    return H.timeline(_event_rows(spark, d), asked(spark, d))


@reg.query(
    "pick_segments",
    f"""
with {ASKED}, p as (select doc_id, generate_subscripts(ps, 1) n, unnest(ps) para from (select doc_id, regexp_split_to_array(replace(text, chr(13) || chr(10), chr(10)), '\\n\\n+') ps from documents where text is not null)),
w as (select doc_id, n, unnest(list_distinct({WORDS.format('para')})) w from p), q as (select item_id, unnest(list_distinct({WORDS.format('question')})) w from asked),
s as (select item_id, doc_id, n, count(*) score from w join q using (w) group by all),
b as (select item_id, doc_id, n best, score from (select *, row_number() over (partition by item_id, doc_id order by score desc, n) r from s) where r = 1),
top as (select * from (select *, row_number() over (partition by item_id order by score desc, doc_id) r from b) where r <= 3),
c as (select s.item_id, s.doc_id, s.n, row_number() over (partition by s.item_id, s.doc_id order by case when s.n = best then 1e9 else s.score + case when abs(s.n - best) = 1 then 0.5 else 0 end end desc, s.n) r from s join top using (item_id, doc_id))
select item_id, doc_id, cast(n as integer) as n from c where r <= 2
""",
)
def pick_segments(spark, d):
    """Of the three best documents of each question the best paragraph and one more; a neighbour of the best gains half a point."""
    wanted = cut(R.asked_words(asked(spark, d)), "asked")
    found = best(paragraph_words(spark, d), wanted, "item_id", ["doc_id", "n"], 3, per=1)
    # the best paragraph of each document, and of these the three best
    firsts = found.groupBy("item_id", "doc_id").agg(F.max(F.struct("score", -F.col("n"))).alias("b")).select("item_id", "doc_id", F.col("b.score").alias("s"), (-F.col("b.col2")).alias("best"))
    three = cut(R.top(firsts, "item_id", "s", "doc_id", 3).drop("rank"), "three")
    words = wanted.join(three, "item_id").groupBy("item_id", "doc_id", "best").agg(F.map_from_entries(F.collect_list(F.struct("term", "w"))).alias("ws"))
    parts = paragraph_words(spark, d, three.select("doc_id").distinct())
    score = F.aggregate("terms", F.lit(0.0), lambda s, t: s + F.coalesce(F.col("ws")[t], F.lit(0.0)))
    scored = parts.join(words, "doc_id").select("item_id", "doc_id", "n", "best", score.alias("score")).filter("score > 0")
    near = F.when(F.col("n") == F.col("best"), 1e9).otherwise(F.col("score") + F.when(F.abs(F.col("n") - F.col("best")) == 1, 0.5).otherwise(0.0))
    r = F.row_number().over(Window.partitionBy("item_id", "doc_id").orderBy(near.desc(), "n"))
    return scored.withColumn("r", r).filter("r <= 2").select("item_id", "doc_id", "n")


@reg.query(
    "lean_shortlist",
    f"""
with {ASKED}, {ENTRIES},
f as (select id, 1 weight, concat_ws(' ', coalesce(title, ''), coalesce(summary, '')) x from h union all select id, 2, array_to_string(topics, ' ') from h
      union all select id, 3, array_to_string(list_filter(list_concat(coalesce(entities, []), coalesce(attrs, [])), lambda x: x is not null), ' ') from h),
words as (select id, weight, unnest(list_distinct({WORDS.format('x')})) w from f), q as (select item_id, unnest(list_distinct({WORDS.format('question')})) w from asked),
s as (select item_id, id, cast(sum(weight) as bigint) score from words join q using (w) group by all), r as (select *, row_number() over (partition by item_id order by score desc, id) r from s)
select item_id, count(*) as kept, min(score) as least from r where r <= 12 or score >= 2 group by item_id
""",
)
def lean_shortlist(spark, d):
    """Entries that a full read of the manifest would keep: the twelve best and all with at least two points."""
    docs, wanted = cut(R.entry_words(entries(spark, d)), "entries"), cut(R.asked_words(asked(spark, d)), "asked")
    twelve = R.top(best(docs, wanted, "item_id", ["id"], 12), "item_id", "score", "id", 12).groupBy("item_id").agg(F.count("*").alias("n"), F.min("score").alias("low"))
    two = reaching(docs, wanted.withColumn("least", F.lit(2.0)), "item_id", ["id"]).select("item_id", "hits", F.col("least").alias("lowest"))
    # with twelve of two points or more these are all; else the twelve best hold them
    j = twelve.join(two, "item_id", "left")
    return j.select("item_id", F.greatest("n", "hits").alias("kept"), F.when(F.col("hits") >= F.col("n"), F.col("lowest")).otherwise(F.col("low")).cast("long").alias("least"))


@reg.query(
    "understanding",
    f"""
with s as (select doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '([.!?])\\s+([A-Z"''(])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: trim(s)), lambda s: length(s) > 20) ss, text from documents where text is not null),
w as (select doc_id, unnest({WORDS.format('text')}) word, generate_subscripts({WORDS.format('text')}, 1) pos from s),
g as (select doc_id, word, count(*) n, min(pos) first from w group by all), r as (select *, row_number() over (partition by doc_id order by n desc, first) r from g),
t as (select doc_id, string_agg(word, ',' order by r) topics from r where r <= 8 group by doc_id)
select doc_id, left(array_to_string(ss[1:2], ' '), 300) as summary, coalesce(topics, '') as topics, cast(len(ss) as integer) as sentences from s left join t using (doc_id)
""",
)
def understanding(spark, d):
    """A deterministic summary of each document: its two leading sentences, its eight most frequent content words, its sentences."""
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", T.sentences(F.col("text")).alias("ss"), "text")
    words = docs.select("doc_id", F.posexplode(T.content_words(F.col("text"))).alias("pos", "word")).groupBy("doc_id", "word").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "first"))
    best = words.withColumn("r", rank).filter("r <= 8").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "word"))), lambda x: x["word"]), ",").alias("topics"))
    lead = F.substring(F.array_join(F.slice("ss", 1, 2), " "), 1, 300)
    return docs.join(best, "doc_id", "left").select("doc_id", lead.alias("summary"), F.coalesce("topics", F.lit("")).alias("topics"), F.size("ss").alias("sentences"))


@reg.query(
    "manifest_scan",
    "select distinct id, left(coalesce(summary, ''), 110) as summary, array_to_string(list_filter(coalesce(entities, []), lambda x: x is not null)[1:6], '; ') as entities, coalesce(array_to_string(tags, ' '), '') as tags from history_manifest",
)
def manifest_scan(spark, d):
    """What a reader sees of every entry: the summary cut to 110 characters, six entities, all tags."""
    h = table(spark, d, "history_manifest")
    named = F.filter(F.coalesce("entities", F.array().cast("array<string>")), lambda x: x.isNotNull())
    return h.select("id", F.substring(F.coalesce("summary", F.lit("")), 1, 110).alias("summary"), F.array_join(F.slice(named, 1, 6), "; ").alias("entities"), F.coalesce(F.array_join("tags", " "), F.lit("")).alias("tags")).distinct()


@reg.query(
    "coverage_floor",
    f"with t as (select source, doc_id, text, {ESTIMATE.format('text')} tok from documents where text is not null), s as (select *, sum(tok) over (partition by source) total from t) select source, doc_id, cast(case when total <= 20000 then least(length(text), 600) else 0 end as integer) as shown, case when total <= 20000 then 'lines' when total <= 25000 then 'whole' else 'ranked' end as mode from s",
)
def coverage_floor(spark, d):
    """How each document is read by the size of its source: one cut line each, whole, or only if ranked."""
    docs = table(spark, d, "documents").filter("text is not null").select("source", "doc_id", F.length("text").alias("n"), T.estimated_tokens(F.col("text")).alias("tok"))
    # sums per source first, then a join: a source with a third of all rows is no window of its own
    total = docs.groupBy(F.col("source").alias("s")).agg(F.sum("tok").alias("total"))
    j = docs.join(total, F.equal_null("source", "s"))
    mode = F.when(F.col("total") <= 20000, "lines").when(F.col("total") <= 25000, "whole").otherwise("ranked")
    return j.select("source", "doc_id", F.when(F.col("total") <= 20000, F.least("n", F.lit(600))).otherwise(0).alias("shown"), mode.alias("mode"))


@reg.query(
    "substring_search",
    f"with {ASKED}, q as (select distinct lower(unnest(regexp_extract_all(question, '[A-Z][a-z]{{2,}}'))) w from asked), h as (select distinct id, lower(concat_ws(' ', id, title, summary, array_to_string(topics, ' '), array_to_string(list_filter(entities, lambda x: x is not null), ' '), array_to_string(tags, ' '), array_to_string(attrs, ' '))) body from history_manifest) select w as word, count(*) as entries, min(id) as first_id from q join h on contains(body, w) group by w",
)
def substring_search(spark, d):
    """Entries that hold a capitalised word of the questions anywhere; the distinct words are the query block."""
    words = asked(spark, d).select(F.explode(F.regexp_extract_all("question", F.lit("[A-Z][a-z]{2,}"), 0)).alias("w")).select(F.lower("w").alias("word")).distinct()
    body = F.lower(F.concat_ws(" ", "id", "title", "summary", F.array_join("topics", " "), F.array_join("entities", " "), F.array_join("tags", " "), F.array_join("attrs", " ")))
    rows = table(spark, d, "history_manifest").select("id", body.alias("body")).distinct()
    found = R.contained_words(rows, words)
    return found.groupBy("word").agg(F.count("*").alias("entries"), F.min("id").alias("first_id"))


@reg.query(
    "budget_block",
    "with e as (select source, doc_id, length(text) n, sum(length(text)) over (partition by source order by coalesce(date, '') desc, doc_id rows unbounded preceding) total from documents where text <> '') select source, doc_id, cast(least(n, 8000 - (total - n)) as integer) as shown from e where 8000 - (total - n) > 200",
)
def budget_block(spark, d):
    """The newest texts of each source while more than 200 of 8,000 characters are left; the last one is cut. No text is empty, so 8,000 rows of a source are enough."""
    docs = table(spark, d, "documents").filter("text <> ''").select("source", "doc_id", F.coalesce("date", F.lit("")).alias("date"), F.length("text").cast("long").alias("n"))
    newest = Window.partitionBy("source").orderBy(F.desc("date"), "doc_id")
    few = docs.withColumn("r", F.row_number().over(newest)).filter("r <= 8000")
    left = F.lit(8000) - (F.sum("n").over(newest.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    return few.withColumn("left", left).filter("left > 200").select("source", "doc_id", F.least("n", "left").cast("int").alias("shown"))


@reg.query(
    "nl_code_route",
    r"""
with q as (select doc_id, lower(regexp_extract(text, '^[^\n\r]*', 0)) q from documents where text is not null), n as (select distinct lower(name) name from symbols where name is not null),
t as (select doc_id, generate_subscripts(ts, 1) pos, unnest(ts) w from (select doc_id, regexp_extract_all(q, '[a-z_][a-z0-9_]*') ts from q)),
m as (select doc_id, arg_min(w, pos) first, count(*) mentioned from t join n on n.name = t.w group by doc_id)
select q.doc_id, first as symbol, case when contains(q, 'most') and contains(q, 'import') then 'most_imported' when first is null then 'most_imported'
  when regexp_matches(q, 'parameter|argument|signature|return') then 'signature' when regexp_matches(q, 'raise|exception|throw|error') then 'raises' when regexp_matches(q, 'impact|affect|transitive.*call|call.*transitive') then 'impact'
  when regexp_matches(q, 'usage|used|uses|reference|rename') then 'usages' when contains(q, 'path') and mentioned >= 2 then 'path' when regexp_matches(q, 'transitive|depend') then 'tdeps' when contains(q, 'import') then 'imports'
  when regexp_matches(q, 'define|where') then 'defines' when contains(q, 'call') then case when contains(q, 'does') then 'callees' else 'callers' end else 'defines' end as op
from q left join m using (doc_id)
""",
)
def nl_code_route(spark, d):
    """The graph query that the first line of each document would ask for, by the symbols that it mentions."""
    q = table(spark, d, "documents").filter("text is not null").select("doc_id", F.lower(F.regexp_extract("text", r"^[^\n\r]*", 0)).alias("q"))
    names = table(spark, d, "symbols").filter("name is not null").select(F.lower("name").alias("w")).distinct()
    tokens = q.select("doc_id", F.posexplode(F.regexp_extract_all("q", F.lit("[a-z_][a-z0-9_]*"), 0)).alias("pos", "w"))
    m = tokens.join(names, "w", "left_semi").groupBy("doc_id").agg(F.min_by("w", "pos").alias("symbol"), F.count("*").alias("mentioned"))
    return q.join(m, "doc_id", "left").select("doc_id", "symbol", H.code_operation(F.col("q"), F.col("symbol"), F.col("mentioned")).alias("op"))


@reg.query(
    "export_graph",
    "with m as (select distinct module src, unnest(imports) dst from manifest), g as (select translate(src, '.-/', '___') s, translate(dst, '.-/', '___') d from m where src is not null and dst is not null) select 'mermaid' as format, s || ' --> ' || d as line from g union all select 'graphml', '<edge source=\"' || s || '\" target=\"' || d || '\"/>' from g union all select 'cypher', 'MERGE (a:Module {id: ''' || s || '''}) MERGE (b:Module {id: ''' || d || '''}) MERGE (a)-[:IMPORTS]->(b);' from g",
)
def export_graph(spark, d):
    """The import graph as lines of Mermaid, GraphML and Cypher."""
    m = table(spark, d, "manifest").select(F.col("module").alias("src"), F.explode("imports").alias("dst")).distinct().filter("src is not null and dst is not null")
    s, t = T.safe_id(F.col("src")), T.safe_id(F.col("dst"))
    forms = {"mermaid": "%s --> %s", "graphml": '<edge source="%s" target="%s"/>', "cypher": "MERGE (a:Module {id: '%s'}) MERGE (b:Module {id: '%s'}) MERGE (a)-[:IMPORTS]->(b);"}
    return m.select(F.explode(F.array(*[F.struct(F.lit(k).alias("format"), F.format_string(v, s, t).alias("line")) for k, v in forms.items()])).alias("x")).select("x.*")


@reg.query(
    "change_impact",
    f"""with recursive {E}, u as (select distinct dst node, src user from e where type in ('calls', 'indirect_call', 'references', 'extends', 'imports')),
s as (select distinct module || '.' || name seed from symbols where symbol_id % 50 = 0 and module is not null and name is not null),
r(seed, node, hops) using key (seed, node) as (select seed, seed, 0 from s union select r.seed, u.user, r.hops + 1 from r join u on u.node = r.node left join recurring.r k on k.seed = r.seed and k.node = u.user where k.hops is null)
select b.seed, b.node, cast(b.hops as integer) as hops, min(a.node) as via from r b join u on u.user = b.node join r a on a.seed = b.seed and a.node = u.node and a.hops = b.hops - 1 where b.hops > 0 group by all""",
)
def change_impact(spark, d):
    """Every node that a change of every fiftieth symbol touches, over five kinds of edges and any number of steps, and the node by which it is reached first."""
    uses = cut(typed_edges(table(spark, d, "edges")).filter("type in ('calls', 'indirect_call', 'references', 'extends', 'imports')").select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct(), "uses")
    seeds = table(spark, d, "symbols").filter("symbol_id % 50 = 0 and module is not null and name is not null").select(F.concat_ws(".", "module", "name").alias("seed"))
    found = cut(reach(seeds.select("seed", F.col("seed").alias("node")), uses), "touched")
    before = found.select("seed", F.col("node").alias("src"), (F.col("hops") + 1).alias("hops")).join(uses, "src").select("seed", "hops", F.col("dst").alias("node"), "src")
    return found.filter("hops > 0").join(before, ["seed", "node", "hops"]).groupBy("seed", "node", "hops").agg(F.min("src").alias("via"))


@reg.query(
    "change_impact_closure",
    f"""with recursive {E}, u as (select distinct dst node, src user from e where type in ('calls', 'indirect_call', 'references', 'extends', 'imports')),
s as (select distinct module || '.' || name seed from symbols where symbol_id % 50 = 0 and module is not null and name is not null),
r(seed, node) as (select seed, seed from s union select r.seed, u.user from r join u on u.node = r.node),
d as (select seed, count(distinct user) n from s join u on u.node = s.seed where user <> seed group by seed)
select seed, count(*) as touched, coalesce(any_value(d.n), 0) as direct from r left join d using (seed) where node <> seed group by seed""",
)
def change_impact_closure(spark, d):
    """How many nodes use a symbol, directly and over any number of steps."""
    uses = typed_edges(table(spark, d, "edges")).filter("type in ('calls', 'indirect_call', 'references', 'extends', 'imports')").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    seeds = table(spark, d, "symbols").filter("symbol_id % 50 = 0 and module is not null and name is not null").select(F.concat_ws(".", "module", "name").alias("seed"))
    found = reach(seeds.select("seed", F.col("seed").alias("node")), uses).filter("node <> seed")
    return found.groupBy("seed").agg(F.count("*").alias("touched"), F.count_if(F.col("hops") == 1).alias("direct"))
