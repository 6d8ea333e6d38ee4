"""Pattern, aggregation, writing and traversal queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeweft.functions.names import class_key
from codeweft.operators import analytics, graph, traverse
from codeweft.operators.symbols import latest, living_symbols
from codeweft.plans.code_queries import _ALIVE, _KEY
from codeweft.plans.pattern import Translator
from codeweft.sources import order_graph as og
from codeweft.sources.tables import table, tables

QUERIES: dict = {}
SQL: dict = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _by_label(spark, d, label):
    return og.nodes(spark, d, label)


# ---- patterns


@_query("select c_name as customer, o_orderkey as order_key, o_totalprice as total from customer join orders on o_custkey = c_custkey where o_totalprice > 300000")
def match_1hop(spark, d):
    x = graph.hop(graph.start(_by_label(spark, d, "Customer"), "c"), og.edges(spark, d, "PLACED"), _by_label(spark, d, "Order").filter("o_totalprice > 300000"), "c_node_id", "o", "PLACED")
    return x.select(F.col("c_name").alias("customer"), F.substring_index("o_node_id", ":", -1).cast("long").alias("order_key"), F.col("o_o_totalprice").alias("total"))


@_query("""select c_mktsegment as segment, p_brand as brand, count(*) as n, cast(round(sum(l_quantity)) as bigint) as quantity
  from customer join orders on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey group by 1, 2""")
def match_2hop(spark, d):
    x = graph.hop(graph.start(_by_label(spark, d, "Customer"), "c"), og.edges(spark, d, "PLACED"), _by_label(spark, d, "Order"), "c_node_id", "o", "PLACED")
    x = graph.hop(x, og.edges(spark, d, "CONTAINS"), _by_label(spark, d, "Part"), "o_node_id", "p", "CONTAINS")
    return x.groupBy(F.col("c_c_mktsegment").alias("segment"), F.col("p_p_brand").alias("brand")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("p_e_l_quantity")).cast("long").alias("quantity"))


@_query("""select n_name as nation, o_orderstatus as status, count(*) as n from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey group by 1, 2""")
def match_mixed_direction(spark, d):
    x = graph.hop(graph.start(_by_label(spark, d, "Order"), "o"), og.edges(spark, d, "PLACED"), _by_label(spark, d, "Customer"), "o_node_id", "c", "PLACED", reverse=True)
    x = graph.hop(x, og.edges(spark, d, "LOCATED_IN"), _by_label(spark, d, "Nation"), "c_node_id", "n", "LOCATED_IN")
    return x.groupBy(F.col("n_name").alias("nation"), F.col("o_o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@_query("""select n_name as nation, (select count(*) from customer where c_nationkey = n_nationkey) as n_customers,
  (select coalesce(list_sort(list(distinct s_name)), []) from supplier where s_nationkey = n_nationkey) as suppliers from nation""")
def optional_fanout(spark, d):
    e = og.edges(spark, d, "LOCATED_IN")
    at = lambda label: e.filter(F.col("src").startswith(f"{label}:"))
    s = at("Supplier").join(_by_label(spark, d, "Supplier"), F.col("src") == F.col("node_id")).select("dst", "name")
    x = graph.optional_sets(_by_label(spark, d, "Nation").select("node_id", "name"), "node_id", customers=at("Customer").select("dst", "src"), suppliers=s)
    return x.select(F.col("name").alias("nation"), F.size("customers").cast("long").alias("n_customers"), "suppliers")


@_query("""select p_partkey as part_key from part where exists (select 1 from lineitem where l_partkey = p_partkey and l_quantity >= 50) or p_size < 3""")
def exists_or(spark, d):
    p = _by_label(spark, d, "Part")
    big = og.edges(spark, d, "CONTAINS").filter("l_quantity >= 50").select(F.col("dst").alias("node_id"))
    return graph.exists_any(p, "node_id", big, p.filter("p_size < 3")).select(F.substring_index("node_id", ":", -1).cast("long").alias("part_key"))


def _dear(spark, d):
    """The customers with an order above 300,000, once for each."""
    dear = _by_label(spark, d, "Order").filter("o_totalprice > 300000").select(F.col("node_id").alias("dst"))
    return og.edges(spark, d, "PLACED").join(dear, "dst").select(F.col("src").alias("node_id"))


@_query("select c_custkey as customer_key from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)")
def not_exists(spark, d):
    x = graph.not_exists(_by_label(spark, d, "Customer"), "node_id", _dear(spark, d))
    return x.select(F.substring_index("node_id", ":", -1).cast("long").alias("customer_key"))


@_query("""select n_name as nation, 'Customer' as label, count(*) as n from customer join nation on n_nationkey = c_nationkey group by 1
  union all select n_name, 'Supplier', count(*) from supplier join nation on n_nationkey = s_nationkey group by 1""")
def any_label_endpoints(spark, d):
    x = graph.hop(graph.start(og.nodes(spark, d, "Customer", "Supplier"), "x"), og.edges(spark, d, "LOCATED_IN", "PLACED"), _by_label(spark, d, "Nation"), "x_node_id", "n", ["LOCATED_IN", "PLACED"])
    return x.groupBy(F.col("n_name").alias("nation"), F.col("x_label").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@_query("""select p_brand as brand, count(*) as n_lines, count(distinct l_orderkey) as n_orders from lineitem join part on p_partkey = l_partkey
  where contains(lower(p_name), 'bolt') and starts_with(p_type, 'E') and p_size in (1, 5, 10, 15, 20, 25) group by 1 order by 2 desc, 1 limit 10""")
def pattern_language(spark, d):
    t = Translator(og.nodes(spark, d, "Order", "Part"), og.edges(spark, d, "CONTAINS"))
    return t.run(
        "MATCH (o:Order)-[e:CONTAINS]->(p:Part) WHERE toLower(p.name) CONTAINS $w AND p.p_type STARTS WITH 'E' AND p.p_size IN [1, 5, 10, 15, 20, 25] "
        "RETURN p.p_brand AS brand, count(e.l_linenumber) AS n_lines, count(DISTINCT o) AS n_orders ORDER BY n_lines DESC, brand LIMIT 10",
        w="bolt",
    )


@_query("select p_name as part from part where p_size < 5 and exists (select 1 from lineitem join orders on o_orderkey = l_orderkey where l_partkey = p_partkey and o_totalprice > 400000) and not exists (select 1 from lineitem where l_partkey = p_partkey and l_quantity < 2)")
def pattern_exists(spark, d):
    t = Translator(og.nodes(spark, d, "Part", "Order"), og.edges(spark, d, "CONTAINS"))
    return t.run("MATCH (p:Part) WHERE p.p_size < $size AND EXISTS {(p)<-[:CONTAINS]-(o:Order) WHERE o.o_totalprice > 400000} AND NOT EXISTS {(p)<-[e:CONTAINS]-(o) WHERE e.l_quantity < 2} RETURN p.name AS part", size=5)


@_query("select c_name as customer, count(*) as n from customer join orders on o_custkey = c_custkey group by c_custkey, c_name having count(*) >= 20")
def pattern_with(spark, d):
    t = Translator(og.nodes(spark, d, "Customer", "Order"), og.edges(spark, d, "PLACED"))
    return t.run("MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c, count(o) AS n WHERE n >= 20 RETURN c.name AS customer, n")


@_query("""select n_name as place, count(*) as n from customer join nation on n_nationkey = c_nationkey group by 1
  union all select r_name, count(*) from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey group by 1""")
def pattern_length(spark, d):
    t = Translator(og.nodes(spark, d, "Customer", "Nation", "Region"), og.edges(spark, d, "LOCATED_IN"))
    return t.run("MATCH (c:Customer)-[:LOCATED_IN*1..2]->(x) RETURN x.name AS place, count(*) AS n")


@_query("select r_name as place from region union select n_name from nation join supplier on s_nationkey = n_nationkey where s_acctbal > 5000")
def pattern_union(spark, d):
    t = Translator(og.nodes(spark, d, "Supplier", "Nation", "Region"), og.edges(spark, d, "LOCATED_IN"))
    return t.run("MATCH (n:Nation)-[:LOCATED_IN]->(r:Region) RETURN r.name AS place UNION MATCH (s:Supplier)-[:LOCATED_IN]->(n:Nation) WHERE s.s_acctbal > 5000 RETURN n.name AS place")


@_query("""select r_name as region, count(n_nationkey) as nations from region left join nation on n_regionkey = r_regionkey and n_name <> 'x' group by 1""")
def pattern_optional(spark, d):
    t = Translator(og.nodes(spark, d, "Region", "Nation"), og.edges(spark, d, "LOCATED_IN"))
    return t.run("MATCH (r:Region) OPTIONAL MATCH (r)<-[:LOCATED_IN]-(n:Nation) RETURN r.name AS region, count(n) AS nations")


@_query("select 'Nation' as label, n_name as name from nation union select 'Region', r_name from region")
def union_distinct(spark, d):
    return _by_label(spark, d, "Nation").select("label", "name").unionByName(_by_label(spark, d, "Region").select("label", "name")).distinct()


@_query(f"""with {_ALIVE},
  m as (select {_KEY.format('c.fqn')} as k, c.class_id, lower(u.m.name) as name, {_KEY.format('c.extends')} as p from parsed_classes c, lateral (select unnest(c.methods) as m) u),
  held_id as (select k, max_by(class_id, (coalesce(parsed_at, timestamp '1900-01-01'), class_id)) as class_id from (select {_KEY.format('fqn')} as k, class_id, parsed_at from parsed_classes) where k is not null group by 1),
  lm as (select distinct m.k, m.name, m.p from m join held_id h on h.class_id = m.class_id join alive a on a.k = m.k)
  select c.k as class_name, c.name as method_name, p.k as parent_name from lm c join lm p on p.k = c.p and p.name = c.name""")
def override_join(spark, d):
    m = living_symbols(table(spark, d, "parsed_classes"), ["extends", "methods"]).select("key", class_key(F.col("extends")).alias("parent"), F.explode("methods").alias("m")).select("key", "parent", F.lower("m.name").alias("name")).distinct()
    p = m.select(F.col("key").alias("parent"), "name")
    return m.join(p, ["parent", "name"]).select(F.col("key").alias("class_name"), F.col("name").alias("method_name"), F.col("parent").alias("parent_name"))


@_query("""with span as (select file_id, line_start, max(line_end) as line_end, min(name) as name from parsed_classes where file_id is not null and line_start is not null group by 1, 2),
  best as (select m.method_id, s.name, s.line_end, m.line_start as site, row_number() over (partition by m.method_id order by s.line_start desc nulls last) as rn
    from methods m left join span s on s.file_id = m.file_id and s.line_start <= m.line_start)
  select method_id, case when line_end >= site then name end as class_name from best where rn = 1""")
def asof_enclosing(spark, d):
    spans = table(spark, d, "parsed_classes").filter("file_id is not null and line_start is not null").groupBy("file_id", "line_start").agg(F.max("line_end").alias("line_end"), F.min("name").alias("name"))
    x = analytics.enclosing(table(spark, d, "methods").select("method_id", "file_id", F.col("line_start").alias("at")), spans, "file_id", "at", "line_start", "line_end")
    return x.select("method_id", F.col("span_name").alias("class_name"))


@_query(f"""with {_ALIVE},
  refs as (select distinct {_KEY.format('fqn')} as k from parsed_uses where {_KEY.format('fqn')} is not null),
  shorts as (select list_extract(string_split(k, '\\'), -1) as s, min(k) as k from alive group by 1)
  select r.k as name, case when a.k is not null then a.k when f.k is not null then f.k else s.k end as target, case when a.k is not null then 0 when f.k is not null then 1 else 2 end as prio
  from refs r left join alive a on a.k = r.k left join (select distinct {_KEY.format('fqn')} as k from framework_symbols) f on f.k = r.k left join shorts s on s.s = list_extract(string_split(r.k, '\\'), -1)
  where a.k is not null or f.k is not null or s.k is not null""")
def ladder_lookup(spark, d):
    classes, uses, frame = tables(spark, d, "parsed_classes", "parsed_uses", "framework_symbols")
    alive = living_symbols(classes).select("key")
    short = F.element_at(F.split("name", r"\\"), -1)
    refs = uses.select(class_key(F.col("fqn")).alias("name")).filter("name is not null").distinct()
    shorts = alive.groupBy(F.element_at(F.split("key", r"\\"), -1).alias("s")).agg(F.min("key").alias("target"))
    found = analytics.first_of(
        [
            (refs.join(alive.select(F.col("key").alias("name")), "name").withColumn("target", F.col("name")), 0),
            (refs.join(frame.select(class_key(F.col("fqn")).alias("name")).distinct(), "name").withColumn("target", F.col("name")), 1),
            (refs.withColumn("s", short).join(shorts, "s").select("name", "target"), 2),
        ],
        "name",
        [F.col("target")],
    )
    return found.select("name", "target", "prio")


@_query("""with names as (select distinct node_id, name, fqn, label from search_results), q(text) as (values ('clinic'), ('method:'), ('Sensor')),
  c as (select q.text, n.node_id, case when n.node_id = q.text then 0 when n.fqn = q.text then 1 when lower(n.name) = lower(q.text) then 2 when contains(lower(n.fqn), lower(q.text)) then 3 end as prio, length(n.fqn) as len from q, names n)
  select text, node_id, prio from (select *, row_number() over (partition by text order by prio, len, node_id) as rn from c where prio is not null) where rn = 1""")
def symbol_resolution(spark, d):
    names = table(spark, d, "search_results").select("node_id", "name", "fqn").distinct()
    out = None
    for q in ("clinic", "method:", "Sensor"):
        prio = F.when(F.col("node_id") == q, 0).when(F.col("fqn") == q, 1).when(F.lower("name") == q.lower(), 2).when(F.lower("fqn").contains(q.lower()), 3)
        best = names.withColumn("prio", prio).filter("prio is not null").orderBy("prio", F.length("fqn"), "node_id").limit(1).select(F.lit(q).alias("text"), "node_id", "prio")
        out = best if out is None else out.unionByName(best)
    return out


# ---- aggregation


@_query("""select 'Region' as label, count(*) as n from region union all select 'Nation', count(*) from nation union all select 'Customer', count(*) from customer
  union all select 'Supplier', count(*) from supplier union all select 'Part', count(*) from part union all select 'Order', count(*) from orders""")
def label_counts(spark, d):
    return graph.label_counts(og.nodes(spark, d))


@_query("""select node_id, cast(sum(o) as bigint) as n_out, cast(sum(i) as bigint) as n_in from (
  select 'Customer:' || o_custkey as node_id, 1 as o, 0 as i from orders union all select 'Order:' || o_orderkey, 0, 1 from orders
  union all select 'Order:' || l_orderkey, 1, 0 from lineitem union all select 'Part:' || l_partkey, 0, 1 from lineitem) group by 1""")
def degrees(spark, d):
    return graph.degrees(og.edges(spark, d, "PLACED", "CONTAINS"))


@_query("""select supplier, n_units, n_layers, case when n_units >= 40 or n_layers >= 4 then 'HIGH' else 'MEDIUM' end as severity from
  (select l_suppkey as supplier, count(distinct l_partkey) as n_units, count(distinct p_type) as n_layers from lineitem join part on p_partkey = l_partkey group by 1) where n_units >= 3 and n_layers >= 2""")
def fan_in(spark, d):
    li, p = tables(spark, d, "lineitem", "part")
    sites = li.select(F.col("l_suppkey").alias("supplier"), F.col("l_partkey").alias("p_partkey")).join(p.select("p_partkey", "p_type"), "p_partkey")
    return graph.fan_in(sites, "supplier", "p_partkey", "p_type", 3, 2, 40, 4)


@_query("""select o_orderpriority as priority, bool_or(o_orderstatus = 'O') as has_open, bool_or(o_orderstatus = 'F') as has_final, bool_or(o_orderstatus = 'O') and bool_or(o_orderstatus = 'F') as conflict from orders group by 1""")
def boundary_flags(spark, d):
    x = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.bool_or(F.col("o_orderstatus") == "O").alias("has_open"), F.bool_or(F.col("o_orderstatus") == "F").alias("has_final"))
    return x.withColumn("conflict", F.col("has_open") & F.col("has_final"))


@_query("""select l_suppkey, l_orderkey, l_linenumber from (select *, row_number() over (partition by l_suppkey order by l_extendedprice desc, l_orderkey, l_linenumber) as rn from lineitem) where rn <= 5""")
def top_n_per_group(spark, d):
    return graph.top_n(table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice"), ["l_suppkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 5).drop("l_extendedprice")


@_query("""select user_id, event_type, n from (select user_id, event_type, count(*) as n, row_number() over (partition by user_id order by count(*) desc, event_type) as rn from events where event_type is not null group by 1, 2) where rn = 1""")
def mode_per_group(spark, d):
    return graph.mode_of(table(spark, d, "events"), ["user_id"], "event_type")


@_query("""select o_orderstatus as status, case when count(*) > 0 then round(100.0 * count(*) filter (where o_totalprice > 200000) / count(*), 1) else 0.0 end as coverage from orders group by 1""")
def coverage_ratio(spark, d):
    x = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.when(F.col("o_totalprice") > 200000, 1)).alias("a"), F.count(F.lit(1)).alias("b"))
    return x.select("status", graph.ratio(F.col("a"), F.col("b")).alias("coverage"))


@_query("""with f as (select distinct l_orderkey as g, l_partkey as i from lineitem), s as (select g from f group by 1 having count(*) >= 2), k as (select f.* from f join s using (g)),
  t as (select i, count(*) as total from k group by 1), p as (select x.i as a, y.i as b, count(*) as co_changes from k x join k y on x.g = y.g and x.i < y.i group by 1, 2)
  select a, b, co_changes, ta.total as total_a, tb.total as total_b, round(co_changes / greatest(ta.total, tb.total), 4) as strength from p join t ta on ta.i = a join t tb on tb.i = b
  where round(co_changes / greatest(ta.total, tb.total), 4) >= 0.05""")
def co_change(spark, d):
    return analytics.co_change(table(spark, d, "lineitem"), "l_orderkey", "l_partkey", 0.05)


@_query("""select l_suppkey as "column", l_returnflag as target, count(*) as n_evidence, round(least(1.0, avg(l_discount) + 0.05 * least(count(*) - 1, 4)), 6) as confidence from lineitem group by 1, 2
  having round(least(1.0, avg(l_discount) + 0.05 * least(count(*) - 1, 4)), 6) >= 0.2""")
def inferred_links(spark, d):
    return analytics.inferred_links(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("column"), F.col("l_returnflag").alias("target"), F.col("l_discount").alias("confidence")))


@_query("""select p_partkey as part_key from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 45) and p_size > 10 and p_brand not in
  (select p_brand from part where p_size = 50 and p_partkey in (select l_partkey from lineitem where l_quantity > 45))""")
def dead_nodes(spark, d):
    p, li = tables(spark, d, "part", "lineitem")
    nodes = p.select(F.col("p_partkey").alias("node_id"), "p_size", "p_brand")
    used = li.filter("l_quantity > 45").select(F.col("l_partkey").alias("node_id"))
    heads = nodes.filter("p_size = 50").select(F.col("node_id").alias("parent_id"), "p_brand")
    over = nodes.select("node_id", "p_brand").join(heads, "p_brand").select("node_id", "parent_id")
    dead, _ = traverse.live_nodes(nodes, [used], over)
    return dead.filter("p_size > 10").select(F.col("node_id").alias("part_key"))


@_query("select o_orderpriority as severity, count(*) as n from orders group by 1")
def severity_order(spark, d):
    """Severities in the order of their letters, as a report that sorts them as text has them."""
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("severity")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("severity"))


# ---- writing


@_query("""select coalesce(a.o_orderkey, b.o_orderkey) as o_orderkey, case when a.o_orderkey is null then 'added' when b.o_orderkey is null then 'removed' else 'changed' end as change
  from (select o_orderkey, o_orderstatus as s from orders where o_orderdate < timestamp '1997-01-01') a
  full join (select o_orderkey, case when o_totalprice > 250000 then 'X' else o_orderstatus end as s from orders where o_orderdate >= timestamp '1994-01-01') b on a.o_orderkey = b.o_orderkey where a.s is distinct from b.s""")
def snapshot_diff(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    old = o.filter("o_orderdate < timestamp_ntz'1997-01-01'")
    new = o.filter("o_orderdate >= timestamp_ntz'1994-01-01'").withColumn("o_orderstatus", F.when(F.col("o_totalprice") > 250000, "X").otherwise(F.col("o_orderstatus")))
    return graph.snapshot_diff(old, new, "o_orderkey", ["o_orderstatus"])


@_query("""select label, count(*) as n, count(*) filter (where name = 'new') as n_new from (select 'Part' as label, case when p_size > 40 then 'new' else p_name end as name from part union all select 'Supplier', s_name from supplier) group by 1""")
def upsert_replace(spark, d):
    n = og.nodes(spark, d, "Part", "Supplier").select("node_id", "label", "name", "p_size")
    new = n.filter("p_size > 40").withColumn("name", F.lit("new"))
    out, _ = graph.upsert_nodes(n, og.edges(spark, d, "SUPPLIED_BY"), new)
    return out.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("name") == "new", 1)).alias("n_new"))


@_query("""select l_suppkey as supplier, count(*) as n from lineitem join part on p_partkey = l_partkey where not (p_size > 40) group by 1""")
def detach_delete(spark, d):
    n = og.nodes(spark, d, "Part", "Supplier")
    _, e = graph.detach_delete(n, og.edges(spark, d, "SUPPLIED_BY"), n.filter("p_size > 40"))
    return e.groupBy(F.substring_index("dst", ":", -1).cast("long").alias("supplier")).agg(F.count(F.lit(1)).alias("n"))


@_query("""select count(*) as n, count(distinct l_partkey || ':' || l_suppkey) as n_single from lineitem""")
def multigraph_or_single(spark, d):
    e = og.edges(spark, d, "SUPPLIED_BY")
    return e.agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(graph.single_edges(e).agg(F.count(F.lit(1)).alias("n_single"))))


@_query("""select count(*) as n from (select distinct p_partkey, l_suppkey from lineitem join part on p_partkey = l_partkey and p_size > 20 join supplier on s_suppkey = l_suppkey)""")
def upsert_edges(spark, d):
    n = og.nodes(spark, d, "Part", "Supplier").filter("label <> 'Part' or p_size > 20")
    legal = spark.createDataFrame([("SUPPLIED_BY", "Part", "Supplier")], "rel string, src_label string, dst_label string")
    e = og.edges(spark, d, "SUPPLIED_BY")
    before = graph.upsert_edges(e.limit(0), e.filter("dst like '%0'"), n, legal)  # a part of them is there already
    return graph.upsert_edges(before, e, n, legal).agg(F.count(F.lit(1)).alias("n"))


@_query("""select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events where user_id is not null) where rn = 1""")
def latest_per_key(spark, d):
    return latest(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], ["event_id", "event_type"])


# ---- traversal


@_query(f"""with recursive {_ALIVE}, edge as (select distinct a.k as src, t.k as dst from alive a join alive t on t.k = {_KEY.format('a.extends')}),
  w as (select k as root, k as node, 0 as depth from alive union select w.root, e.dst, w.depth + 1 from w join edge e on e.src = w.node where w.depth < 5)
  select root, node, min(depth) as depth from w group by 1, 2""")
def bfs_levels(spark, d):
    a = living_symbols(table(spark, d, "parsed_classes"), ["extends"])
    e = a.select(F.col("key").alias("src"), class_key(F.col("extends")).alias("dst")).join(a.select(F.col("key").alias("dst")), "dst", "left_semi")
    return traverse.bfs(e, a.select(F.col("key").alias("root")), 5)


@_query(f"""with recursive {_ALIVE}, named as (select k, extends as p, true as up from alive union all select k, unnest(implements), true from alive union all select k, unnest(traits), false from alive),
  edge as (select distinct case when up then t.k else n.k end as src, case when up then n.k else t.k end as dst from named n join alive t on t.k = {_KEY.format('n.p')}),
  w as (select distinct k as root, k as node, 0 as depth from (select {_KEY.format('fqn')} as k from eloquent_models) where k is not null union select w.root, e.dst, w.depth + 1 from w join edge e on e.src = w.node where w.depth < 3)
  select root, node, min(depth) as depth from w group by 1, 2 having min(depth) > 0""")
def blast_radius(spark, d):
    """Children of what changes, and the traits that it pulls in."""
    from codeweft.operators.hierarchy import symbol_links

    nodes, links = symbol_links(table(spark, d, "parsed_classes"))
    e = links.select(F.col("child").alias("src"), F.col("parent").alias("dst"), "prio").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")
    seeds = table(spark, d, "eloquent_models").select(class_key(F.col("fqn")).alias("root")).filter("root is not null").distinct()
    return traverse.blast_radius(e.filter("prio < 2").select("src", "dst"), e.filter("prio = 2").select("src", "dst"), seeds, 3)


def communities(spark, d):
    e = table(spark, d, "parsed_uses").select("file_id", class_key(F.col("fqn")).alias("dst")).filter("dst is not null and file_id is not null")
    own = table(spark, d, "parsed_classes").select("file_id", class_key(F.col("fqn")).alias("src")).filter("src is not null and file_id is not null").distinct()
    return analytics.communities(own.join(e, "file_id").select("src", "dst"))


QUERIES["communities"] = communities
