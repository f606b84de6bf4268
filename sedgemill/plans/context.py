"""Search documents, packs and context rows of modules, symbols, entries and questions."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from sedgemill.functions import routing as RT
from sedgemill.functions import text as T
from sedgemill.operators import graph as G
from sedgemill.operators import ranking as R
from sedgemill.operators.ledger import facts, previous
from sedgemill.plans.graph import E, SHORT, imports_internal
from sedgemill.plans.ledger import FACTS
from sedgemill.plans.ranking import ASKED, BM25, ENTRIES, _bm25, entries
from sedgemill.plans.registry import Registry
from sedgemill.plans.text import ESTIMATE
from sedgemill.session import cut, table

reg = Registry()


@reg.query("raises", f"with {E} select distinct {SHORT.format('src')} as name, {SHORT.format('dst')} as raised from e where type = 'raises' or (type = 'calls' and (dst like '%Error' or dst like '%Exception' or dst like '%Warning'))")
def raises(spark, d):
    """What a symbol raises: targets of raise edges, and callees whose names say that they are exceptions."""
    e = G.typed_edges(table(spark, d, "edges"))
    hit = e.filter((F.col("type") == "raises") | (F.col("type") == "calls") & F.col("dst").rlike("(Error|Exception|Warning)$"))
    return hit.select(G.short_name(F.col("src")).alias("name"), G.short_name(F.col("dst")).alias("raised")).distinct()


@reg.query("ambiguous_edges", f"with {E} select repo, type, count(*) as n, count(distinct src) as sources from e where upper(trim(confidence)) = 'AMBIGUOUS' group by all")
def ambiguous_edges(spark, d):
    """Edges whose extractor was not sure, by repo and type."""
    unsure = G.typed_edges(table(spark, d, "edges")).filter(F.upper(F.trim("confidence")) == "AMBIGUOUS")
    return unsure.groupBy("repo", "type").agg(F.count("*").alias("n"), F.countDistinct("src").alias("sources"))


@reg.query("digit_projection", "select distinct name, array_to_string(regexp_extract_all(name, '[0-9]'), '') as digits from symbols where name is not null")
def digit_projection(spark, d):
    """The digits of every symbol's name, which near-duplicates must share."""
    return table(spark, d, "symbols").filter("name is not null").select("name", F.regexp_replace("name", "[^0-9]", "").alias("digits")).distinct()


@reg.query(
    "memory_ids",
    r"""with h as (select distinct id, coalesce(title, '') t, coalesce(date, '') d, coalesce(summary, '') s from history_manifest)
select id, coalesce(nullif(left(trim(regexp_replace(lower(t), '[^a-z0-9_]+', '_', 'g'), '_'), 40), ''), 'memory') || '_' || replace(d, '-', '') || '_' || left(sha256(t || '|' || d || '|' || s), 6) as memory_id from h""",
)
def memory_ids(spark, d):
    """An id for each entry by its title, date and a digest of its content."""
    h = table(spark, d, "history_manifest").select("id", *(F.coalesce(c, F.lit("")).alias(c) for c in ("title", "date", "summary"))).distinct()
    slug = F.substring(F.btrim(F.regexp_replace(F.lower("title"), "[^a-z0-9_]+", "_"), F.lit("_")), 1, 40)
    stamp = F.substring(F.sha2(F.concat_ws("|", "title", "date", "summary"), 256), 1, 6)
    return h.select("id", F.concat_ws("_", F.coalesce(F.nullif(slug, F.lit("")), F.lit("memory")), F.replace("date", F.lit("-"), F.lit("")), stamp).alias("memory_id")).distinct()


_WORDS = " union all ".join(f"select {n} ord, '{cat}' cat, unnest([{', '.join(repr(w) for w in words)}]) w" for n, (cat, words) in enumerate(RT.CATEGORIES.items()))
_WEAK = ", ".join(repr(w) for w in RT.WEAK)


@reg.query(
    "event_categories",
    rf"""with v as ({_WORDS}), h as (select distinct id, ' ' || trim(regexp_replace(regexp_replace(lower(coalesce(title, '') || ' ' || coalesce(summary, '')), '[^a-z0-9\s-]', ' ', 'g'), '\s+', ' ', 'g')) || ' ' t from history_manifest),
s as (select id, ord, cat, sum(case when w in ({_WEAK}) then 0.25 when contains(w, ' ') then 3 else 2 end)::double score from h join v on contains(t, ' ' || w || ' ') group by all)
select distinct id, first_value(cat) over (partition by id order by score desc, ord) as category, max(score) over (partition by id) as score from s qualify max(score) over (partition by id) >= 2""",
)
def event_categories(spark, d):
    """The category that the words of each entry name, by weighted vocabularies; the first of equals."""
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")))
    found = table(spark, d, "history_manifest").select("id", RT.category(text).alias("c")).distinct()
    return found.filter("c.score >= 2").select("id", "c.category", "c.score")


@reg.query(
    "asked_on",
    r"select distinct item_id, coalesce(nullif(replace(regexp_extract(question_date, '\d{4}[-/]\d{2}[-/]\d{2}'), '/', '-'), ''), '2023-01-01') as asked_on from test_items",
)
def asked_on(spark, d):
    """The day on which each question was asked, from a slashed or dashed date, or the fixed default."""
    day = F.replace(F.regexp_extract("question_date", r"\d{4}[-/]\d{2}[-/]\d{2}", 0), F.lit("/"), F.lit("-"))
    return table(spark, d, "test_items").select("item_id", F.coalesce(F.nullif(day, F.lit("")), F.lit("2023-01-01")).alias("asked_on")).distinct()


@reg.query(
    "component_hubs",
    """with recursive m as (select distinct module a, unnest(imports) b from manifest), i as (select a, b from m where b in (select module from manifest) and a is not null),
l as (select a, b from i union select b, a from i), r(node, other) as (select a, a from l union select r.node, l.b from r join l on l.a = r.other),
c as (select node, min(other) component from r group by node), g as (select a node, count(*) degree from (select a from i union all select b from i) t(a) group by a)
select component, count(*) as modules, arg_max(node, (degree, node)) as hub, max(degree) as degree from c join g using (node) group by component""",
)
def component_hubs(spark, d):
    """Every component of the import graph with its size and its hub, the module of the highest degree (the last name among equals)."""
    imports = imports_internal(spark, d).select(F.col("module").alias("src"), F.col("imported").alias("dst"))
    degree = imports.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    joined = G.components(imports).join(degree, "node")
    return joined.groupBy("component").agg(F.count("*").alias("modules"), F.max_by("node", F.struct("degree", "node")).alias("hub"), F.max("degree").alias("degree"))


@reg.query("largest_files", "select path, repo, n_bytes from source_files order by n_bytes desc, path limit 400")
def largest_files(spark, d):
    """The 400 largest files."""
    return table(spark, d, "source_files").select("path", "repo", "n_bytes").orderBy(F.desc("n_bytes"), "path").limit(400)


@reg.query("merged_graph", f"with {E} select distinct coalesce(repo, '') || '::' || src as src, coalesce(repo, '') || '::' || dst as dst, type from e")
def merged_graph(spark, d):
    """The graphs of all repos as one: node ids carry the tag of their repo."""
    tag = lambda c: F.concat(F.coalesce("repo", F.lit("")), F.lit("::"), c).alias(c)
    return G.typed_edges(table(spark, d, "edges")).select(tag("src"), tag("dst"), "type").distinct()


LATEST = "m as (select module, arg_max({path: path, lang: lang, summary: summary, symbols: symbols, imports: imports}, (coalesce(seen_at, timestamp '0001-01-01'), path)) x from manifest where module is not null and path is not null group by module)"


def _latest(spark, d):
    """The latest life of every module."""
    m = table(spark, d, "manifest").filter("module is not null and path is not null")
    order = F.struct(F.coalesce("seen_at", F.timestamp_seconds(F.lit(-60_000_000_000))), "path")
    return m.groupBy("module").agg(F.max_by(F.struct("path", "lang", "summary", "symbols", "imports"), order).alias("x")).select("module", "x.*")


@reg.query(
    "module_documents",
    f"with {LATEST} select module, length(concat_ws(' ', module, x.path, x.summary, array_to_string(x.symbols, ' '), array_to_string(x.imports, ' '))) as n_chars, sha256(concat_ws(' ', module, x.path, x.summary, array_to_string(x.symbols, ' '), array_to_string(x.imports, ' '))) as digest from m",
)
def module_documents(spark, d):
    """What a search over modules reads: name, path, summary, symbols and imports; as length and digest."""
    text = F.concat_ws(" ", "module", "path", "summary", F.array_join("symbols", " "), F.array_join("imports", " "))
    return _latest(spark, d).select("module", F.length(text).cast("long").alias("n_chars"), F.sha2(text, 256).alias("digest"))


@reg.query(
    "symbol_documents",
    f"with {LATEST}, s as (select distinct symbol_id, name, kind, module, sig, brief from symbols where name is not null) select symbol_id, name, kind, s.module, sig, brief, x.path as path, x.lang as lang from s left join m using (module)",
)
def symbol_documents(spark, d):
    """What a search over symbols reads: every symbol with the path and language of its module's latest life."""
    s = table(spark, d, "symbols").filter("name is not null").select("symbol_id", "name", "kind", "module", "sig", "brief").distinct()
    return s.join(_latest(spark, d).select("module", "path", "lang"), "module", "left").select("symbol_id", "name", "kind", "module", "sig", "brief", "path", "lang")


@reg.query("repo_counts", "with f as (select repo, count(*) files from source_files group by repo), m as (select repo, count(distinct module) modules from manifest group by repo) select f.repo, files, coalesce(modules, 0) as modules from f left join m using (repo)")
def repo_counts(spark, d):
    """Files of every repo and how many modules its manifest counts."""
    files = table(spark, d, "source_files").groupBy("repo").agg(F.count("*").alias("files"))
    modules = table(spark, d, "manifest").groupBy("repo").agg(F.countDistinct("module").alias("modules"))
    return files.join(modules, "repo", "left").select("repo", "files", F.coalesce("modules", F.lit(0)).alias("modules"))


@reg.query(
    "packs",
    f"""with {ASKED}, {ENTRIES}, {BM25}, k as (select item_id, id, row_number() over (partition by item_id order by round(score, 6) desc, id) r from s qualify r <= 3),
b as (select item_id, r, id || ': ' || concat_ws(' - ', title, summary) block from k join h using (id)), pk as (select item_id, count(*) blocks, string_agg(block, chr(10) order by r) pack from b group by item_id)
select item_id, blocks, {ESTIMATE.format('pack')} as n_tokens, sha256(pack) as digest from pk""",
)
def packs(spark, d):
    """The three best entries of each question as one text, with its size in tokens and its digest."""
    best = R.top(_bm25(spark, d, 3), "item_id", "score", "id", 3)
    block = F.concat_ws(": ", "id", F.concat_ws(" - ", "title", "summary"))
    blocks = best.join(entries(spark, d), "id").select("item_id", F.struct("rank", block.alias("block")).alias("b"))
    # at most three blocks a question
    pack = F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda x: x["block"]), "\n")
    joined = cut(blocks.groupBy("item_id").agg(F.count("*").alias("blocks"), pack.alias("pack")), "packs")
    return joined.select("item_id", "blocks", T.estimated_tokens(F.col("pack")).alias("n_tokens"), F.sha2("pack", 256).alias("digest"))


@reg.query(
    "first_facts",
    "select id, date, title from (select distinct id, date, title from history_manifest where date is not null) order by date, id, title nulls last limit 40",
)
def first_facts(spark, d):
    """The forty earliest entries in the order of their dates: what a reader sees where nothing is ranked."""
    return table(spark, d, "history_manifest").filter("date is not null").select("id", "date", "title").distinct().orderBy("date", "id", F.asc_nulls_last("title")).limit(40)


@reg.query(
    "module_moves",
    """with r as (select distinct module, path, seen_at from manifest where module is not null and path is not null and seen_at is not null), p as (select *, lag(path) over (partition by module order by seen_at, path) before from r)
select module, path, epoch_us(seen_at) as seen_us, case when before is null then 'new' when before = path then 'same' else 'moved' end as status from p""",
)
def module_moves(spark, d):
    """Every life of a module against the one before: new, at the same path, or moved."""
    lives = table(spark, d, "manifest").select("module", "path", "seen_at").filter("module is not null and path is not null and seen_at is not null").distinct()
    seen = previous(lives.withColumn("day", F.to_date("seen_at")), "module", "day", ["seen_at", "path"], ["path"])
    before = F.col("prev.path")
    return seen.select("module", "path", F.unix_micros("seen_at").alias("seen_us"), F.when(before.isNull(), "new").when(before == F.col("path"), "same").otherwise("moved").alias("status"))


@reg.query("extra_attributes", f"with {FACTS} select distinct lower(fact) as fact from facts where kind = 'attribute' and fact is not null and lower(fact) not in (select lower(fact) from facts where kind = 'event' and fact is not null)")
def extra_attributes(spark, d):
    """Attributes whose wording no event has."""
    rows = facts(table(spark, d, "history_manifest")).select("kind", F.lower("fact").alias("fact")).distinct()
    return rows.filter("kind = 'attribute'").select("fact").join(rows.filter("kind = 'event'").select("fact"), "fact", "left_anti")


@reg.query(
    "label_union",
    """with h as (select distinct id, coalesce(topics, []) topics, coalesce(tags, []) tags from history_manifest), u as (select id, list_concat(topics, tags) l, row_number() over () k from h),
x as (select id, k, unnest(l) label, generate_subscripts(l, 1) pos from u), f as (select id, k, label, min(pos) pos from x where label is not null group by all),
g as (select id, k, label, row_number() over (partition by id, k order by pos) r from f)
select distinct u.id, coalesce(s.labels, '') as labels from u left join (select id, k, string_agg(label, ',' order by r) labels from g where r <= 4 group by all) s on s.id = u.id and s.k = u.k""",
)
def label_union(spark, d):
    """The first four of each entry's topics and tags, in their order, each once."""
    none = F.array().cast("array<string>")
    both = F.filter(F.array_distinct(F.concat(F.coalesce("topics", none), F.coalesce("tags", none))), lambda x: x.isNotNull())
    return table(spark, d, "history_manifest").select("id", F.array_join(F.slice(both, 1, 4), ",").alias("labels")).distinct()


@reg.query("event_sequence", "select event_id, user_id, cast(ts as date) as day, row_number() over (partition by user_id, cast(ts as date) order by ts, event_id) as seq from events")
def event_sequence(spark, d):
    """The running number of each event within its user's day."""
    day = F.to_date("ts")
    within = Window.partitionBy("user_id", day).orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", "user_id", day.alias("day"), F.row_number().over(within).cast("long").alias("seq"))


@reg.query("type_references", f"with {E}, k as (select distinct name from symbols where kind in ('class', 'struct') and name is not null) select distinct src, {SHORT.format('dst')} as known_type from e where type = 'references' and {SHORT.format('dst')} in (select name from k)")
def type_references(spark, d):
    """References whose target is the name of a known class or struct."""
    known = table(spark, d, "symbols").filter("kind in ('class', 'struct')").select(F.col("name").alias("known_type")).distinct()
    refs = G.typed_edges(table(spark, d, "edges")).filter("type = 'references'").select("src", G.short_name(F.col("dst")).alias("known_type")).distinct()
    return refs.join(known, "known_type", "left_semi").select("src", "known_type")


@reg.query("inheritance", f"with {E}, k as (select distinct name from symbols where kind in ('class', 'struct') and name is not null), x as (select distinct {SHORT.format('src')} as derived, {SHORT.format('dst')} as base from e where type = 'extends') select derived, base, base in (select name from k) as known from x")
def inheritance(spark, d):
    """What extends what, and whether the base is a class or struct of the store."""
    known = table(spark, d, "symbols").filter("kind in ('class', 'struct') and name is not null").select(F.col("name").alias("base")).distinct().withColumn("known", F.lit(True))
    pairs = G.typed_edges(table(spark, d, "edges")).filter("type = 'extends'").select(G.short_name(F.col("src")).alias("derived"), G.short_name(F.col("dst")).alias("base")).distinct()
    return pairs.join(known, "base", "left").select("derived", "base", F.coalesce("known", F.lit(False)).alias("known"))


@reg.query("indirect_only", f"with {E} select distinct src, dst from e where type = 'indirect_call' except select src, dst from e where type = 'calls'")
def indirect_only(spark, d):
    """Functions that are passed on as arguments and never called directly by the same symbol."""
    e = G.typed_edges(table(spark, d, "edges"))
    pair = lambda kind: e.filter(F.col("type") == kind).select("src", "dst").distinct()
    return pair("indirect_call").join(pair("calls"), ["src", "dst"], "left_anti")


@reg.query("undated_backlog", "select source, count(*) as n, coalesce(sum(length(text)), 0)::bigint as chars, epoch_us(min(loaded_at)) as oldest_us from documents where date is null and text is not null group by source")
def undated_backlog(spark, d):
    """Documents of each source that have no date yet: how many, how long, the oldest load."""
    rows = table(spark, d, "documents").filter("date is null and text is not null")
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("long").alias("chars"), F.unix_micros(F.min("loaded_at")).alias("oldest_us"))


@reg.query(
    "category_log_first",
    rf"""with v as ({_WORDS}), h as (select distinct id, coalesce(date, '') date, lower(trim(coalesce(title, ''))) what, ' ' || trim(regexp_replace(regexp_replace(lower(coalesce(title, '') || ' ' || coalesce(summary, '')), '[^a-z0-9\s-]', ' ', 'g'), '\s+', ' ', 'g')) || ' ' t from history_manifest),
s as (select id, date, what, ord, cat, sum(case when w in ({_WEAK}) then 0.25 when contains(w, ' ') then 3 else 2 end)::double score from h join v on contains(t, ' ' || w || ' ') group by all),
b as (select id, date, what, arg_max(cat, (score, -ord)) category, max(score) score from s group by id, date, what)
select category, date, what, min(id) as first_id from b where score >= 2 group by all""",
)
def category_log_first(spark, d):
    """Entries that name a category, once per category, date and wording."""
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")))
    what = F.lower(F.trim(F.coalesce("title", F.lit(""))))
    rows = table(spark, d, "history_manifest").select("id", F.coalesce("date", F.lit("")).alias("date"), what.alias("what"), RT.category(text).alias("c")).filter("c.score >= 2")
    return rows.groupBy("c.category", "date", "what").agg(F.min("id").alias("first_id"))
