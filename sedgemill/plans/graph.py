"""Queries on the code graph."""

from pyspark.sql import functions as F

from sedgemill.operators import graph as G
from sedgemill.operators.closures import count_beyond, reached
from sedgemill.operators.ledger import first_per_key
from sedgemill.plans.registry import Registry
from sedgemill.session import cut, node_key, table

reg = Registry()

B = "e' \\t\\r\\n' || chr(160)"
E = f"e as (select edge_id, trim(src, {B}) src, trim(dst, {B}) dst, lower(trim(type, {B})) as type, confidence, repo, seen_at from edges where trim(src, {B}) <> '' and trim(dst, {B}) <> '')"
SHORT = "regexp_split_to_array({0}, '[./]')[-1]"
KEY = f"replace(replace(trim({{0}}, {B}), '::', '/'), '.', '/')"


def _edges(spark, d):
    return G.typed_edges(table(spark, d, "edges"))


@reg.query("edge_dedupe", f"with {E}, r as (select *, row_number() over (partition by src, dst, type order by edge_id) r, count(*) over (partition by src, dst, type) n from e) select src, dst, type, edge_id, confidence from r where r = 1")
def edge_dedupe(spark, d):
    """One row per src, dst and type; the first edge id gives the confidence."""
    return first_per_key(_edges(spark, d).select("src", "dst", "type", "edge_id", "confidence"), ["src", "dst", "type"], ["edge_id", "confidence"])


@reg.query("callers", f"with {E} select {SHORT.format('dst')} as name, count(distinct src) as callers, count(*) as calls from e where type = 'calls' group by 1")
def callers(spark, d):
    return _edges(spark, d).filter("type = 'calls'").groupBy(G.short_name(F.col("dst")).alias("name")).agg(F.countDistinct("src").alias("callers"), F.count("*").alias("calls"))


@reg.query("callees", f"with {E} select {SHORT.format('src')} as name, count(distinct dst) as callees, min(dst) as first_callee from e where type = 'calls' group by 1")
def callees(spark, d):
    return _edges(spark, d).filter("type = 'calls'").groupBy(G.short_name(F.col("src")).alias("name")).agg(F.countDistinct("dst").alias("callees"), F.min("dst").alias("first_callee"))


# Fixed value: edges by which a symbol is used.
USES = ("calls", "references", "indirect_call", "method", "imports_from")


@reg.query("usages", f"with {E} select distinct {SHORT.format('dst')} as name, src as used_by from e where type in ('calls', 'references', 'indirect_call', 'method', 'imports_from')")
def usages(spark, d):
    """Everything that uses a name (the last part of the target) by any of five kinds of edges: what a rename touches."""
    return _edges(spark, d).filter(F.col("type").isin(*USES)).select(G.short_name(F.col("dst")).alias("name"), F.col("src").alias("used_by")).distinct()


@reg.query("imports_internal", "with m as (select distinct module, unnest(imports) imported from manifest where module is not null) select module, imported from m where imported in (select module from manifest)")
def imports_internal(spark, d):
    """Imports that are modules of the store."""
    m = table(spark, d, "manifest").filter("module is not null")
    imported = m.select("module", F.explode("imports").alias("imported")).distinct()
    return imported.join(m.select(F.col("module").alias("imported")).distinct(), "imported", "left_semi").select("module", "imported")


@reg.query("in_degree", "with m as (select distinct module, unnest(imports) imported from manifest) select imported, count(*) as n from m where imported is not null group by imported")
def in_degree(spark, d):
    return table(spark, d, "manifest").select("module", F.explode("imports").alias("imported")).distinct().filter("imported is not null").groupBy("imported").agg(F.count("*").alias("n"))


@reg.query("hubs", f"with {E}, n as (select src node from e union all select dst from e) select node, count(*) as degree from n group by node order by degree desc, node limit 20")
def hubs(spark, d):
    """The 20 nodes of the highest degree."""
    e = _edges(spark, d)
    return e.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "node").limit(20)


@reg.query(
    "diagnose",
    f"""with {E}, k as (select src, dst, type, count(*) n from e group by all), p as (select src, dst, count(*) n from k group by all)
select 'edges' as what, count(*) as n from e union all select 'nodes', count(distinct node) from (select src node from e union all select dst from e) union all select 'duplicates', sum(n - 1) from k
union all select 'several_relations', count(*) from p where n > 1 union all select 'self_loops', count(*) from e where src = dst""",
)
def diagnose(spark, d):
    e = _edges(spark, d)
    keys = e.groupBy("src", "dst", "type").agg(F.count("*").alias("n"))
    pairs = keys.groupBy("src", "dst").agg(F.count("*").alias("types"), F.sum("n").alias("n"))
    nodes = e.select(F.explode(F.array("src", "dst")).alias("node")).agg(F.countDistinct("node").cast("long").alias("n")).withColumn("what", F.lit("nodes"))
    sums = pairs.agg(
        F.sum("n").alias("edges"),
        F.sum(F.col("n") - F.col("types")).alias("duplicates"),
        F.count_if(F.col("types") > 1).alias("several_relations"),
        F.sum(F.when(F.col("src") == F.col("dst"), F.col("n")).otherwise(0)).alias("self_loops"),
    )
    return sums.unpivot([], ["edges", "duplicates", "several_relations", "self_loops"], "what", "n").unionByName(nodes)


@reg.query(
    "closure_imports",
    """with recursive m as (select distinct module src, unnest(imports) dst from manifest), i as (select src, dst from m where dst in (select module from manifest)),
s as (select distinct module from symbols where symbol_id % 50 = 0 and module is not null),
r(seed, node) as (select module, module from s union select r.seed, i.dst from r join i on i.src = r.node)
select seed, node from r""",
)
def closure_imports(spark, d):
    """What the modules of every fiftieth symbol import, directly or not."""
    imports = imports_internal(spark, d).select(F.col("module").alias("src"), F.col("imported").alias("dst"))
    seeds = table(spark, d, "symbols").filter("symbol_id % 50 = 0 and module is not null").select(F.col("module").alias("seed"), F.col("module").alias("node"))
    return G.reach(seeds, imports).select("seed", "node")


def _callers_of(spark, d):
    return _edges(spark, d).filter("type = 'calls'").select(G.short_name(F.col("dst")).alias("src"), G.short_name(F.col("src")).alias("dst"))


def _fiftieth(spark, d):
    return table(spark, d, "symbols").filter("symbol_id % 50 = 0 and name is not null").select(F.col("name").alias("seed"))


@reg.query(
    "impact",
    f"""with recursive {E}, c as (select distinct {SHORT.format('dst')} callee, {SHORT.format('src')} caller from e where type = 'calls'),
r(seed, node) as (select name, c.caller from (select distinct name from symbols where symbol_id % 50 = 0 and name is not null) join c on c.callee = name union select r.seed, c.caller from r join c on c.callee = r.node)
select seed, count(*) as affected, min(node) as first_affected from r group by seed""",
)
def impact(spark, d):
    """How many names call every fiftieth symbol, directly or over others, and the first of them."""
    return count_beyond(_fiftieth(spark, d), _callers_of(spark, d))


@reg.query(
    "impact_closure",
    f"""with recursive {E}, c as (select distinct {SHORT.format('dst')} callee, {SHORT.format('src')} caller from e where type = 'calls'),
s as (select distinct name from symbols where symbol_id % 50 = 0 and name is not null),
r(seed, node) as (select name, name from s union select r.seed, c.caller from r join c on c.callee = r.node)
select seed, node from r""",
)
def impact_closure(spark, d):
    """All callers, direct or not, by short names, of every fiftieth symbol, and the symbol itself."""
    return reached(_fiftieth(spark, d), _callers_of(spark, d))


@reg.query(
    "import_paths",
    """with recursive m as (select distinct module src, unnest(imports) dst from manifest), i as (select src, dst from m where dst in (select module from manifest)),
s as (select distinct module from symbols where symbol_id % 50 = 0 and module is not null),
r(seed, node, path) as (select module, module, [module] from s union all select r.seed, i.dst, list_append(r.path, i.dst) from r join i on i.src = r.node where not list_contains(r.path, i.dst))
select seed, node, cast(len(path) - 1 as integer) as hops, array_to_string(path, ' -> ') as path from (select *, row_number() over (partition by seed, node order by len(path), path) k from r) where k = 1""",
)
def import_paths(spark, d):
    """A shortest path of imports from the module of every fiftieth symbol to each module that it reaches."""
    imports = imports_internal(spark, d).select(F.col("module").alias("src"), F.col("imported").alias("dst"))
    seeds = table(spark, d, "symbols").filter("symbol_id % 50 = 0 and module is not null").select(F.col("module").alias("seed"), F.col("module").alias("node"))
    return G.shortest_paths(seeds, imports).withColumn("path", F.array_join("path", " -> "))


@reg.query(
    "shortest_hops",
    f"""with recursive {E}, c as (select distinct src, dst from e where type in ('imports', 'contains')), s as (select distinct module from symbols where symbol_id % 50 = 0 and module is not null),
r(seed, node, hops) using key (seed, node) as (select module, module, 0 from s union select r.seed, c.dst, r.hops + 1 from r join c on c.src = r.node left join recurring.r k on k.seed = r.seed and k.node = c.dst where k.hops is null)
select seed, node, cast(hops as integer) as hops from r""",
)
def shortest_hops(spark, d):
    """Least number of imports and containments from the module of every fiftieth symbol to everything that it reaches."""
    links = _edges(spark, d).filter("type in ('imports', 'contains')").select("src", "dst").distinct()
    seeds = table(spark, d, "symbols").filter("symbol_id % 50 = 0 and module is not null").select(F.col("module").alias("seed"), F.col("module").alias("node"))
    return G.reach(seeds, links)


@reg.query(
    "module_components",
    """with recursive m as (select distinct module a, unnest(imports) b from manifest), i as (select a, b from m where b in (select module from manifest) and a is not null),
l as (select a, b from i union select b, a from i), r(node, other) as (select a, a from l union select r.node, l.b from r join l on l.a = r.other)
select component, count(*) as modules from (select node, min(other) component from r group by node) group by component""",
)
def module_components(spark, d):
    """Modules linked by imports, directly or over others, by their smallest module."""
    imports = imports_internal(spark, d).select(F.col("module").alias("src"), F.col("imported").alias("dst"))
    return G.components(imports).groupBy("component").agg(F.count("*").alias("modules"))


@reg.query("import_cycles")
def import_cycles(spark, d):
    """Imports that lie on cycles, with the smallest module of their strongly connected component."""
    return G.strong_components(imports_internal(spark, d).select(F.col("module").alias("src"), F.col("imported").alias("dst")))


@reg.query(
    "graph_diff",
    """with a as (select distinct module from manifest where seen_at <= timestamptz '2025-06-01 00:00:00+00' and (removed_at is null or removed_at > timestamptz '2025-06-01 00:00:00+00')),
b as (select distinct module from manifest where seen_at <= timestamptz '2025-12-01 00:00:00+00' and (removed_at is null or removed_at > timestamptz '2025-12-01 00:00:00+00'))
select coalesce(a.module, b.module) as module, case when a.module is null then 'added' else 'removed' end as change from a full join b on a.module = b.module where (a.module is null or b.module is null) and coalesce(a.module, b.module) is not null""",
)
def graph_diff(spark, d):
    """Modules that came and went between two days."""
    m = table(spark, d, "manifest").filter("module is not null")
    alive = lambda day: m.filter(f"seen_at <= timestamp'{day} 00:00:00 UTC' and (removed_at is null or removed_at > timestamp'{day} 00:00:00 UTC')").select("module").distinct()
    a, b = alive("2025-06-01").withColumn("a", F.lit(1)), alive("2025-12-01").withColumn("b", F.lit(1))
    return a.join(b, "module", "full").filter("a is null or b is null").select("module", F.when(F.col("a").isNull(), "added").otherwise("removed").alias("change"))


@reg.query("lone_links", f"with {E}, p as (select regexp_replace(src, '\\.[^./]*$', '') a, regexp_replace(dst, '\\.[^./]*$', '') b, edge_id from e where type in ('calls', 'references', 'extends')) select a as src_module, b as dst_module, min(edge_id) as edge_id from p where a <> b group by a, b having count(*) = 1")
def lone_links(spark, d):
    """Pairs of modules that exactly one edge links."""
    module = lambda c: F.regexp_replace(c, r"\.[^./]*$", "")
    pairs = _edges(spark, d).filter("type in ('calls', 'references', 'extends')").select(module("src").alias("src_module"), module("dst").alias("dst_module"), "edge_id").filter("src_module <> dst_module")
    return pairs.groupBy("src_module", "dst_module").agg(F.count("*").alias("n"), F.min("edge_id").alias("edge_id")).filter("n = 1").drop("n")


@reg.query("leaf_contains", f"with {E}, n as (select src node, type from e union all select dst, type from e) select node from n group by node having count(*) = 1 and bool_and(type = 'contains')")
def leaf_contains(spark, d):
    """Nodes that only their container knows."""
    ends = _edges(spark, d).select(F.explode(F.array("src", "dst")).alias("node"), "type")
    return ends.groupBy("node").agg(F.count("*").alias("n"), F.every(F.col("type") == "contains").alias("c")).filter("n = 1 and c").select("node")


@reg.query("single_impl", f"with {E} select dst as base, min(src) as implementer from e where type = 'extends' group by dst having count(distinct src) = 1")
def single_impl(spark, d):
    """Bases with exactly one implementer."""
    return _edges(spark, d).filter("type = 'extends'").groupBy("dst").agg(F.countDistinct("src").alias("n"), F.min("src").alias("implementer")).filter("n = 1").select(F.col("dst").alias("base"), "implementer")


@reg.query("subclasses", f"with {E} select dst as base, count(distinct src) as subclasses, count(distinct repo) as repos from e where type = 'extends' group by dst")
def subclasses(spark, d):
    return _edges(spark, d).filter("type = 'extends'").groupBy(F.col("dst").alias("base")).agg(F.countDistinct("src").alias("subclasses"), F.countDistinct("repo").alias("repos"))


@reg.query(
    "cross_repo",
    "with s as (select distinct name, module, string_split(module, '/')[1] repo from symbols where module is not null and name is not null), g as (select name, min(module) least, count(distinct repo) repos from s group by name having count(distinct repo) > 1) select s.name, s.module, g.least as linked_to, g.repos from s join g using (name) where s.module <> g.least",
)
def cross_repo(spark, d):
    """Symbols of one name in several repositories, each linked to the one in the smallest module: a star instead of all pairs."""
    s = table(spark, d, "symbols").filter("module is not null and name is not null").select("name", "module", F.split_part("module", F.lit("/"), F.lit(1)).alias("repo")).distinct()
    g = s.groupBy("name").agg(F.min("module").alias("linked_to"), F.countDistinct("repo").alias("repos")).filter("repos > 1")
    return s.join(g, "name").filter("module <> linked_to").select("name", "module", "linked_to", "repos")


@reg.query(
    "mentions",
    "with n as (select distinct name from symbols where length(name) >= 4), w as (select distinct doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) name from documents) select name, count(*) as documents, min(doc_id) as first_doc from w join n using (name) group by name",
)
def mentions(spark, d):
    """Documents that name a symbol as a whole word: words joined to names, not names tried on texts."""
    names = table(spark, d, "symbols").filter("length(name) >= 4").select("name").distinct()
    words = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_]+"), 0))).alias("name"))
    return words.join(names, "name", "left_semi").groupBy("name").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_doc"))


@reg.query(
    "resolve_names",
    f"""with {E}, c as (select edge_id, regexp_replace(src, '\\.[^./]*$', '') module, {SHORT.format('dst')} name from e where type = 'calls'),
d as (select distinct name, module from symbols where module is not null and name is not null), g as (select name, count(*) n, min(module) least from d group by name),
i as (select distinct module, unnest(imports) imported from manifest),
v as (select c.edge_id, min(d.module) imported from c join i on i.module = c.module join d on d.name = c.name and d.module = i.imported group by c.edge_id)
select c.edge_id, coalesce(l.module, v.imported, g.least) as target, case when l.module is not null or v.imported is not null then 'EXTRACTED' when g.n = 1 then 'INFERRED' when g.n > 1 then 'AMBIGUOUS' end as confidence
from c left join d l on l.name = c.name and l.module = c.module left join v using (edge_id) left join g on g.name = c.name""",
)
def resolve_names(spark, d):
    """Where a called name is defined: in the caller's module, else in an imported one, else where it is unique, else in the smallest module."""
    calls = _edges(spark, d).filter("type = 'calls'").select("edge_id", F.regexp_replace("src", r"\.[^./]*$", "").alias("module"), G.short_name(F.col("dst")).alias("name"))
    defined = table(spark, d, "symbols").filter("module is not null and name is not null").select("name", "module").distinct()
    everywhere = defined.groupBy("name").agg(F.count("*").alias("n"), F.min("module").alias("least"))
    local = defined.withColumn("local", F.col("module"))
    imports = table(spark, d, "manifest").select("module", F.explode("imports").alias("imported")).distinct()
    via = imports.join(defined.withColumnRenamed("module", "imported"), "imported").groupBy("module", "name").agg(F.min("imported").alias("via"))
    j = calls.join(local, ["module", "name"], "left").join(via, ["module", "name"], "left").join(everywhere, "name", "left")
    sure = F.col("local").isNotNull() | F.col("via").isNotNull()
    confidence = F.when(sure, "EXTRACTED").when(F.col("n") == 1, "INFERRED").when(F.col("n") > 1, "AMBIGUOUS")
    return j.select("edge_id", F.coalesce("local", "via", "least").alias("target"), confidence.alias("confidence"))


@reg.query(
    "incremental_diff",
    """with m as (select module, arg_max(loc, struct_pack(a := seen_at, b := loc)) loc from manifest where module is not null group by module), s as (select module, len(string_split(replace(code, chr(13), ''), chr(10))) - case when code like '%' || chr(10) then 1 else 0 end n from source_files where module is not null and code is not null)
select coalesce(m.module, s.module) as module, case when m.module is null then 'added' when s.module is null then 'removed' when loc is distinct from n then 'changed' else 'same' end as change from m full join s on m.module = s.module""",
)
def incremental_diff(spark, d):
    """Files against the manifest: added, removed, changed (other number of lines) or same."""
    m = table(spark, d, "manifest").filter("module is not null").groupBy("module").agg(F.max_by("loc", F.struct("seen_at", "loc")).alias("loc"))
    lines = F.size(F.split(F.replace("code", F.lit("\r"), F.lit("")), "\n")) - F.when(F.endswith("code", F.lit("\n")), 1).otherwise(0)
    s = table(spark, d, "source_files").filter("module is not null and code is not null").select("module", lines.alias("n"))
    change = F.when(F.col("there").isNull(), "added").when(F.col("n").isNull(), "removed").when(~F.equal_null("loc", "n"), "changed").otherwise("same")
    return m.withColumn("there", F.lit(1)).join(s, "module", "full").select("module", change.alias("change"))


@reg.query(
    "path_rollup",
    "with p as (select string_split(path, '/') ps, n_bytes from source_files), x as (select array_to_string(ps[1:k], '/') prefix, k as depth, n_bytes from p, range(0, 6) t(k) where k < len(ps)) select prefix, cast(depth as integer) as depth, count(*) as files, cast(sum(n_bytes) as bigint) as bytes from x group by all",
)
def path_rollup(spark, d):
    """Files and bytes of every folder, to a depth of five."""
    parts = F.split("path", "/")
    steps = F.transform(F.sequence(F.lit(0), F.least(F.size(parts) - 1, F.lit(5))), lambda k: F.struct(F.array_join(F.slice(parts, F.lit(1), k), "/").alias("prefix"), k.alias("depth")))
    return table(spark, d, "source_files").select(F.explode(steps).alias("x"), "n_bytes").groupBy("x.prefix", "x.depth").agg(F.count("*").alias("files"), F.sum("n_bytes").alias("bytes"))


@reg.query(
    "term_links",
    "with t as (select distinct id, lower(unnest(topics)) term from history_manifest), p as (select a.term x, b.term y from t a join t b on a.id = b.id and a.term < b.term) select x, y, count(*) as entries from p group by x, y having count(*) >= 2",
)
def term_links(spark, d):
    """Topics that entries share, counted per pair of topics: an entry has at most eight, so pairs stay within one row."""
    terms = F.array_sort(F.array_distinct(F.transform(F.filter("topics", lambda t: t.isNotNull()), F.lower)))
    rows = table(spark, d, "history_manifest").select("id", terms.alias("ts")).distinct()
    pairs = F.flatten(F.transform("ts", lambda a: F.transform(F.filter("ts", lambda b: b > a), lambda b: F.struct(a.alias("x"), b.alias("y")))))
    return rows.select("id", F.explode(pairs).alias("p")).distinct().groupBy("p.x", "p.y").agg(F.count("*").alias("entries")).filter("entries >= 2")


@reg.query("export_dot", "with m as (select distinct module src, unnest(imports) dst from manifest) select '  \"' || translate(src, '.-/', '___') || '\" -> \"' || translate(dst, '.-/', '___') || '\";' as line from m where src is not null and dst is not null")
def export_dot(spark, d):
    """The import graph as lines of a DOT file."""
    from sedgemill.functions.text import safe_id

    m = table(spark, d, "manifest").select(F.col("module").alias("src"), F.explode("imports").alias("dst")).distinct().filter("src is not null and dst is not null")
    return m.select(F.format_string('  "%s" -> "%s";', safe_id(F.col("src")), safe_id(F.col("dst"))).alias("line"))


@reg.query(
    "nearest_module",
    f"""with n as (select distinct {KEY.format('dst')} node from edges where {KEY.format('dst')} <> ''), m as (select distinct {KEY.format('module')} module from manifest where module is not null),
p as (select node, array_to_string(string_split(node, '/')[1:k], '/') module from (select node, unnest(range(1, len(string_split(node, '/')) + 1)) k from n))
select n.node, arg_max(m.module, length(m.module)) as nearest from n left join p on p.node = n.node left join m on m.module = p.module group by n.node""",
)
def nearest_module(spark, d):
    """The module that a node belongs to: its longest prefix among the modules of the manifest."""
    nodes = table(spark, d, "edges").select(node_key(F.col("dst")).alias("node")).filter("node <> ''").distinct()
    modules = table(spark, d, "manifest").select(node_key(F.col("module")).alias("module")).filter("module is not null")
    return G.nearest_prefix(cut(nodes, "nodes"), "node", modules, "module")


@reg.query("symbol_lines", "select distinct module, line, kind || ' ' || name || coalesce(sig, '') as text from symbols where module is not null")
def symbol_lines(spark, d):
    """The lines of each module's symbol block, with what they are ordered by."""
    text = F.concat("kind", F.lit(" "), "name", F.coalesce("sig", F.lit("")))
    return table(spark, d, "symbols").filter("module is not null").select("module", "line", text.alias("text")).distinct()


@reg.query("docs_for", f"with {E} select dst as node, count(distinct src) as docs, min(src) as first_doc from e where type = 'rationale_for' group by dst")
def docs_for(spark, d):
    """Documentation nodes of every node."""
    return _edges(spark, d).filter("type = 'rationale_for'").groupBy(F.col("dst").alias("node")).agg(F.countDistinct("src").alias("docs"), F.min("src").alias("first_doc"))


@reg.query("defines", "select distinct s.name, s.kind, s.module, s.line, m.path from (select distinct name, kind, module, line from symbols where name is not null) s left join (select module, min(path) path from manifest where module is not null group by module) m on m.module = s.module")
def defines(spark, d):
    """Where every symbol is defined, with the path of its module."""
    s = table(spark, d, "symbols").filter("name is not null").select("name", "kind", "module", "line").distinct()
    paths = table(spark, d, "manifest").filter("module is not null").groupBy("module").agg(F.min("path").alias("path"))
    return s.join(paths, "module", "left").select("name", "kind", "module", "line", "path")


@reg.query(
    "why",
    f"""with {E}, s as (select src node, 'callees' section, dst other from e where type = 'calls' union all select dst, 'callers', src from e where type = 'calls' union all select dst, 'docs', src from e where type = 'rationale_for' union all select src, 'bases', dst from e where type = 'extends')
select node, section, count(distinct other) as n, min(other) as first from s group by node, section""",
)
def why(spark, d):
    """What explains a node, by section: what it calls, who calls it, its documentation, its bases."""
    sides = [("calls", "callees", "src", "dst"), ("calls", "callers", "dst", "src"), ("rationale_for", "docs", "dst", "src"), ("extends", "bases", "src", "dst")]
    rows = [F.when(F.col("type") == t, F.struct(F.col(a).alias("node"), F.lit(s).alias("section"), F.col(b).alias("other"))) for t, s, a, b in sides]
    x = _edges(spark, d).select(F.explode(F.array_compact(F.array(*rows))).alias("x")).select("x.*")
    return x.groupBy("node", "section").agg(F.countDistinct("other").alias("n"), F.min("other").alias("first"))
