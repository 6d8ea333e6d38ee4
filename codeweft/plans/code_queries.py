"""Queries over hierarchies and references of a code base, with their SQL."""

from __future__ import annotations

from codeweft.operators import hierarchy, orphans
from codeweft.sources.tables import tables

_ORPHAN_TABLES = ("parsed_classes", "parsed_uses", "eloquent_models", "framework_symbols", "db_tables")


def p1_found(spark, d):
    return hierarchy.symbol_pairs(*tables(spark, d, "parsed_classes"))


def p1_hierarchy(spark, d):
    return hierarchy.symbol_hierarchy(*tables(spark, d, "parsed_classes"))


def p1_descendants(spark, d):
    return hierarchy.symbol_distances(*tables(spark, d, "parsed_classes"))


def p1_loops(spark, d):
    return hierarchy.symbol_loops(*tables(spark, d, "parsed_classes"))


def p3_found(spark, d):
    return orphans.code_orphans(*tables(spark, d, *_ORPHAN_TABLES)).select("ref_table", "ref_id")


def p3_report(spark, d):
    return orphans.orphan_report(*tables(spark, d, *_ORPHAN_TABLES))


QUERIES = {f.__name__: f for f in (p1_found, p1_hierarchy, p1_descendants, p1_loops, p3_found, p3_report)}

_KEY = r"nullif(translate(regexp_replace(regexp_replace(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '^\\', ''), '^\s+|\s+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
_TABLE = r"""nullif(lower(trim(list_extract(string_split(regexp_replace({0}, '[`"''\[\]]', '', 'g'), '.'), -1))), '')"""

_ALIVE = f"""
  held as (select {_KEY.format('fqn')} as k, fqn, extends, implements, traits, removed_at,
             row_number() over (partition by {_KEY.format('fqn')} order by parsed_at desc nulls last, class_id desc) as rn
           from parsed_classes where {_KEY.format('fqn')} is not null),
  alive as (select * from held where rn = 1 and removed_at is null)"""

_PAIRS = f"""with recursive {_ALIVE},
  named as (select k, extends as p from alive union all select k, unnest(implements) from alive union all select k, unnest(traits) from alive),
  edge as (select distinct n.k as a, t.k as b from named n join alive t on t.k = {_KEY.format('n.p')}),
  reach as (select a, b from edge union select r.a, e.b from reach r join edge e on e.a = r.b)"""

_REFS = rf"""with {_ALIVE},
  target as (select k from alive union select {_KEY.format('fqn')} from framework_symbols),
  tables_ as (select repo, k from (select repo, {_TABLE.format('name')} as k, dropped_at,
                row_number() over (partition by repo, {_TABLE.format('name')} order by created_at desc nulls last, table_id desc) as rn from db_tables) where rn = 1 and dropped_at is null),
  refs as (
    select 'parsed_classes' as ref_table, class_id as ref_id, strftime(parsed_at, '%Y-%m') as month, k is null as orphan
      from (select c.*, {_KEY.format('extends')} as r from parsed_classes c where removed_at is null) left join target on k = r where r is not null
    union all select 'parsed_uses', use_id, strftime(parsed_at, '%Y-%m'), k is null
      from (select u.*, {_KEY.format('fqn')} as r from parsed_uses u) left join target on k = r where r is not null
    union all select 'eloquent_models', model_id, strftime(parsed_at, '%Y-%m'), k is null
      from (select m.*, {_TABLE.format('db_table')} as r from eloquent_models m) m left join tables_ t on k = r and t.repo = m.repo where r is not null)"""

SQL = {
    "p1_found": _PAIRS + " select distinct least(x.fqn, y.fqn) as fqn_a, greatest(x.fqn, y.fqn) as fqn_b from reach r join alive x on x.k = r.a join alive y on y.k = r.b",
    "p1_loops": _PAIRS + " select x.fqn from reach r join alive x on x.k = r.a where r.a = r.b",
    "p3_found": _REFS + " select ref_table, ref_id from refs where orphan",
    "p3_report": _REFS + " select ref_table, month, count(*) as n_references, count(*) filter (where orphan) as n_orphans from refs group by 1, 2",
    "p1_descendants": _PAIRS.replace("reach as (select a, b from edge union select r.a, e.b from reach r join edge e on e.a = r.b)", "reach as (select a, b, 1 as d from edge union select r.a, e.b, r.d + 1 from reach r join edge e on e.a = r.b where r.d < 200)")
    + " select y.fqn, x.fqn as descendant, min(d) as distance from reach r join alive x on x.k = r.a join alive y on y.k = r.b group by 1, 2",
    "p1_hierarchy": _PAIRS
    + f""", prio as (select k, extends as p, 0 as o from alive union all select k, unnest(implements), 1 from alive union all select k, unnest(traits), 2 from alive),
      chosen as (select k as a, arg_min(b, (o, b)) as b from (select n.k, t.k as b, o from prio n join alive t on t.k = {_KEY.format('n.p')} where t.k <> n.k) group by 1),
      main as (select a, b from chosen union select m.a, c.b from main m join chosen c on c.a = m.b),
      broken as (select least(m.a, min(n.b)) as a from main m join main n on n.a = m.a where m.a = m.b group by m.a),
      forest as (select * from chosen where a not in (select a from broken)),
      line as (select k, k as top, 0 as depth, [fqn] as path from alive union all select l.k, f.b, l.depth + 1, list_prepend(y.fqn, l.path) from line l join forest f on f.a = l.top join alive y on y.k = f.b),
      whole as (select k, arg_max((top, depth, path), depth) as w from line group by 1),
      below as (select b as k, count(*) as n from reach group by 1),
      tops as (select r.a as k, list(y.fqn) as t from reach r join alive y on y.k = r.b where r.b not in (select a from edge) group by 1)
      select x.fqn, y.fqn as root, w[2] as depth, w[3] as path, coalesce(n, 0) as n_descendants, list_sort(list_distinct(coalesce(t, []) || [y.fqn])) as roots from whole join alive x using (k) join alive y on y.k = w[1] left join below using (k) left join tops using (k)""",
}
