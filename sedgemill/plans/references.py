"""Queries on references between tables."""

from sedgemill.operators.orphans import orphan_counts, orphan_references
from sedgemill.plans.registry import Registry
from sedgemill.session import table

reg = Registry()

_KEY = "replace(replace(trim({0}, e' \\t\\r\\n' || chr(160)), '::', '/'), '.', '/')"

#: The lives of every key and the references, then one state per reference.
ORPHANS = f"""
with e as (
  select 'edges' ref_table, edge_id ref_id, 'e:' || {_KEY.format('dst')} k, seen_at t from edges
  where lower(trim(type, e' \\t\\r\\n' || chr(160))) not in ('depends_on', 'requires_env') or type is null
), s as (
  select 'symbols' ref_table, symbol_id ref_id, 's:' || {_KEY.format('module')} k, seen_at t from symbols
), r as (select distinct * from (select * from e union all select * from s) where length(k) > 2),
g as (
  select 'e:' || {_KEY.format('module')} k, seen_at b, removed_at g from manifest
  union select 's:' || {_KEY.format('module')}, seen_at, removed_at from manifest
  union select 'e:' || {_KEY.format('module')} || '/' || {_KEY.format('name')}, seen_at, removed_at from symbols where module is not null and name is not null
  union select 'e:' || {_KEY.format('key')}, null, null from builtins
), j as (
  select r.*, count(g.k) n, bool_or(g.k is not null and (g.b is null or g.b <= r.t)) before_, bool_or(g.k is not null and (g.b is null or g.b <= r.t) and (g.g is null or g.g > r.t)) alive
  from r left join g on r.k = g.k group by all
), f as (
  select ref_table, ref_id, case when n = 0 then 'missing' when before_ then 'deleted' else 'late' end state, strftime(t, '%Y-%m') as month
  from j where n = 0 or (t is not null and not coalesce(alive, false))
)
"""


def _found(spark, d):
    return orphan_references(*(table(spark, d, t) for t in ("edges", "symbols", "manifest", "builtins")))


@reg.query("p4_found", ORPHANS + "select ref_table, ref_id, state from f")
def p4_found(spark, d):
    return _found(spark, d).drop("month")


@reg.query("p4_rates", ORPHANS + "select ref_table, month, state, count(*) n from f group by all")
def p4_rates(spark, d):
    return orphan_counts(_found(spark, d))
