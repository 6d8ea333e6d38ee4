import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeweft.operators import analytics, graph, labels, search, traverse
from codeweft.functions import naming

NODE, EDGE = "node_id string, label string, name string", "src string, rel string, dst string, line int"


@pytest.fixture
def small(frame):
    nodes = frame([("a", "A", "x"), ("b", "B", "y"), ("c", "B", None)], NODE)
    edges = frame([("a", "R", "b", 1), ("a", "R", "b", 2), ("a", "S", "c", 3), ("b", "R", "c", 4), ("a", "R", "zz", 5)], EDGE)
    return nodes, edges


def test_hops_and_missing_ends(small):
    nodes, edges = small
    one = graph.hop(graph.start(nodes, "n"), edges, nodes, "n_node_id", "m", "R")
    assert sorted((r["n_node_id"], r["m_node_id"], r["m_e_line"]) for r in one.collect()) == [("a", "b", 1), ("a", "b", 2), ("b", "c", 4)]
    back = graph.hop(graph.start(nodes, "n"), edges, nodes, "n_node_id", "m", ["R", "S"], reverse=True, how="left")
    assert {(r["n_node_id"], r["m_node_id"]) for r in back.collect()} == {("a", None), ("b", "a"), ("c", "a"), ("c", "b")}


def test_upsert_drops_the_edges_of_a_replaced_node(small, frame):
    nodes, edges = small
    n, e = graph.upsert_nodes(nodes, edges, frame([("b", "B", "new"), ("d", "A", "z")], NODE))
    assert {(r["node_id"], r["name"]) for r in n.collect()} == {("a", "x"), ("b", "new"), ("c", None), ("d", "z")}
    assert {(r["src"], r["dst"]) for r in e.collect()} == {("a", "c"), ("a", "zz")}
    ignored = graph.insert_ignore(nodes, frame([("b", "B", "new"), ("d", "A", "z"), ("d", "A", "y")], NODE))
    assert {(r["node_id"], r["name"]) for r in ignored.collect()} == {("a", "x"), ("b", "y"), ("c", None), ("d", "y")}


def test_edges_need_both_ends_and_a_declared_pair(small, frame):
    nodes, edges = small
    legal = frame([("R", "A", "B")], "rel string, src_label string, dst_label string")
    got = graph.upsert_edges(edges.limit(0), edges, nodes, legal)
    assert [(r["src"], r["dst"], r["line"]) for r in got.collect()] == [("a", "b", 1)]
    assert graph.upsert_edges(edges.limit(0), edges, nodes, legal, multi=True).count() == 2
    assert {(r["rel"], r["src_label"]) for r in graph.undeclared_pairs(edges, nodes, legal).collect()} == {("R", "B"), ("S", "A")}


def test_delete_by_file(frame):
    nodes = frame([("a", "f1"), ("b", "f2"), ("c", None)], "node_id string, file_path string")
    n, e = graph.delete_by_file(nodes, frame([("a", "R", "b"), ("b", "R", "c")], "src string, rel string, dst string"), frame([("f1",)], "file_path string"))
    assert {r["node_id"] for r in n.collect()} == {"b", "c"} and e.count() == 1


def test_bfs_is_that_of_brute_force(frame):
    r = random.Random(5)
    links = [(f"n{r.randrange(20)}", f"n{r.randrange(20)}") for _ in range(35)] + [(None, "n1")]
    got = {(x["root"], x["node"]): x["depth"] for x in traverse.bfs(frame(links, "src string, dst string"), frame([("n0",), ("n3",), (None,)], "root string"), 4).collect()}
    want = {}
    for root in ("n0", "n3"):
        front, seen = {root}, {root: 0}
        for d in range(1, 5):
            front = {b for a, b in links if a in front and b not in seen}
            seen.update(dict.fromkeys(front, d))
        want.update({(root, k): v for k, v in seen.items()})
    assert got == want
    levels = traverse.bfs(frame(links, "src string, dst string"), frame([("n0",)], "root string"), 4)
    assert [x["step_order"] for x in traverse.capped(levels, 3).orderBy("step_order").collect()] == [0, 1, 2][: levels.count()]


def test_blast_radius_goes_both_ways_and_chains_step(frame):
    calls, tables = frame([("b", "a"), ("c", "b")], "src string, dst string"), frame([("a", "t")], "src string, dst string")
    got = {(r["node"], r["depth"]) for r in traverse.blast_radius(calls, tables, frame([("a",)], "root string"), 3).collect()}
    assert got == {("b", 1), ("t", 1), ("c", 2)}
    x = traverse.chain(frame([("j1", "m1"), ("j2", "m2")], "src string, dst string"), frame([("m1", "e1"), ("m2", "e2")], "src string, dst string"), frame([("j2", "e1"), ("j1", "e2")], "src string, dst string"), frame([("j1",)], "root string"))
    assert {(r["node"], r["depth"]) for r in x.collect()} == {("j2", 1)}


def test_dead_nodes_and_entry_points(frame):
    c = frame([("a",), ("b",), ("c",), ("d",)], "node_id string")
    dead, live = traverse.live_nodes(c, [frame([("a",)], "node_id string")], frame([("b", "a"), ("c", "d")], "node_id string, parent_id string"))
    assert {r["node_id"] for r in dead.collect()} == {"c", "d"} and {r["node_id"] for r in live.collect()} == {"a", "b"}
    e = traverse.entry_points(("route", c.filter("node_id < 'c'")), ("job", c))
    assert {r["node_id"]: r["entry_type"] for r in e.collect()} == {"a": "route", "b": "route", "c": "job", "d": "job"}


def test_communities_cover_the_graph_and_beat_single_nodes(frame):
    links = [(f"{g}{i}", f"{g}{j}") for g in "xyz" for i in range(5) for j in range(i)] + [("x0", "y0"), ("y1", "z1")]
    e = frame(links, "src string, dst string")
    got = analytics.communities(e)
    assert got.count() == 15
    single = got.select("node", F.col("node").alias("community"))
    assert analytics.modularity(e, got) > 0.4 > analytics.modularity(e, single)
    assert analytics.communities(frame([], "src string, dst string")).count() == 0


def test_communities_follow_their_rule_without_a_job_a_round(spark, frame, monkeypatch):
    r = random.Random(3)
    name = lambda: f"{'aZé😀'[r.randrange(4)]}{r.randrange(12)}"
    links = [(name(), name()) for _ in range(90)] + [("hub", f"a{i}") for i in range(12)] + [("p", "q"), ("q", "p"), ("s", "s"), (None, "p")]
    e = frame(links, "src string, dst string")
    beside = {}
    for a, b in links:
        if a and a != b:
            beside.setdefault(a, []).append(b)
            beside.setdefault(b, []).append(a)
    turns = 60
    hashes = {x["n"]: x["h"] for x in frame([(n,) for n in beside], "n string").select("n", F.array(*[F.xxhash64("n", F.lit(i)) for i in range(turns)]).alias("h")).collect()}
    want, n = {x: x for x in beside}, 0
    while True:
        would = {}
        for x, near in beside.items():
            votes = Counter([*(want[y] for y in near), want[x]])
            to = min(votes, key=lambda c: (-votes[c], c.encode()))
            if to != want[x]:
                would[x] = to
        if not would:
            break
        order = lambda x: (hashes[x][n], x.encode())
        want.update({x: to for x, to in would.items() if all(order(x) < order(y) for y in beside[x] if y in would)})
        n += 1
    assert 2 < n < turns
    steps = []
    whole = analytics.cut
    monkeypatch.setattr(analytics, "cut", lambda df, *a, **k: steps.append(a) or whole(df, *a, **k))
    assert {x["node"]: x["community"] for x in analytics.communities(e).collect()} == want
    assert len(steps) <= 4 < 2 * n
    monkeypatch.setattr(analytics, "TASK_LINKS", 0)
    got = analytics.communities(e).collect()
    assert len(steps) > 8 and len(got) == len(want) and {x["node"]: x["community"] for x in got} == want


def test_parts_of_a_round_change_no_label(monkeypatch):
    r = np.random.default_rng(2)
    a, b = np.unique(np.sort(r.integers(0, 200, (260, 2)), axis=1), axis=0).T
    a, b = a[a < b], b[a < b]
    w, seed = r.integers(1, 4, len(a)), r.integers(-(2**63), 2**63 - 1, 200)
    whole = labels.propagate(a, b, w, seed)
    monkeypatch.setattr(labels, "PART", 7)
    assert (labels.propagate(a, b, w, seed) == whole).all() and 1 < len(set(whole)) < 200


def test_asof_takes_the_nearest_begin_first(frame):
    spans = frame([("f", 1, 100, "outer"), ("f", 10, 20, "inner"), (None, 1, 9, "none")], "file string, a int, z int, name string")
    sites = frame([(1, "f", 5), (2, "f", 15), (3, "f", 30), (4, "g", 5), (5, None, 5), (6, "f", None), (7, "f", 10)], "id int, file string, at int")
    got = {r["id"]: r["span_name"] for r in analytics.enclosing(sites, spans, "file", "at", "a", "z").collect()}
    assert got == {1: "outer", 2: "inner", 3: None, 4: None, 5: None, 6: None, 7: "inner"}


def test_links_from_evidence_and_names(frame):
    ev = frame([("c", "t", 0.5)] * 9 + [("c", "u", 0.1), (None, "t", 1.0)], "column string, target string, confidence double")
    assert [(r["target"], r["n_evidence"], r["confidence"]) for r in analytics.inferred_links(ev).collect()] == [("t", 9, 0.7)]
    cols = frame([("t", "owner_id"), ("t", "owner_type"), ("t", "x_id"), ("u", "owner_type")], "table string, column string")
    assert [tuple(r) for r in analytics.typed_pairs(cols).collect()] == [("t", "owner")]
    m = analytics.longest_match(frame([(1, "order"), (2, "orderline"), (3, "ordinal"), (4, "zzz")], "id int, slug string"), frame([("order",), ("line",), ("orderl",), ("ordinary",)], "token string"), "id", "slug", "token")
    assert {r["id"]: (r["token"], r["match_type"]) for r in m.collect()} == {1: ("order", "exact"), 2: ("orderl", "contains"), 3: ("ordinary", "prefix")}
    t = analytics.test_links(frame([(1, ["/a/b", "/q/r/s"], ["Z"])], "test_id int, uris array<string>, class_refs array<string>"), frame([(10, "/a/b"), (11, "/a"), (12, "/q/r")], "route_id int, uri string"), frame([(5, "Z"), (4, "Z")], "class_id int, name string"))
    assert {(r["target"], r["kind"]) for r in t.collect()} == {(10, "route"), (12, "route"), (4, "class")}


def test_search_pages_and_merges(frame):
    hits = frame([(1, 0.9, "vendor/a.php"), (2, 0.8, "tests/a.php"), (3, 0.5, "app/a.php"), (4, 0.4, None)], "id int, score double, path string")
    b = search.boosted(hits, F.col("path"))
    assert [r["id"] for r in search.page(b, "id", 4).collect()] == [3, 2, 4, 1]
    keep = F.col("path").contains("vendor")
    assert search.page(hits, "id", 1, ~keep).count() == 0 and [r["id"] for r in search.page(hits, "id", 1, ~keep, compat=False).collect()] == [2]
    merged = search.rrf({"bm25": hits.select("id", "score"), "vector": hits.filter("id = 3").select("id", "score")}, "id")
    assert merged.orderBy(F.desc("score")).first()["id"] == 3
    flows = search.grouped_by_flow(hits, frame([(1, "f2"), (1, "f1")], "id int, flow string"), "id")
    assert {(r["flow"], r["n_hits"]) for r in flows.collect()} == {("f1", 1), (None, 3)}
    assert search.bm25(frame([(1, "a b"), (2, None)], "doc_id int, text string"), " ").count() == 0


def test_naming_rules(frame):
    df = frame([("HTTPOrderLine",), ("Category",), ("Day",), ("Box",)], "n string")
    got = df.select(naming.snake(F.col("n")).alias("s"), naming.table_of_class(F.col("n")).alias("t"), naming.plural_plain(naming.snake_plain(F.col("n"))).alias("p")).collect()
    assert [(r["s"], r["t"]) for r in got] == [("http_order_line", "http_order_lines"), ("category", "categories"), ("day", "daies"), ("box", "boxes")]
    assert [r["p"] for r in got][1:] == ["categories", "daies", "boxes"]
    t = frame([("?App\\User|int|null",), ("(A&B)|string",), (None,)], "t string").select(naming.class_types(F.col("t")).alias("x")).collect()
    assert [r["x"] for r in t] == [["App\\User"], ["A", "B"], []]
    assert [r[0] for r in frame([("VARCHAR(20)",), ("tinyint(1)",), ("geometry",), ("BIGINT unsigned",), ("year",), ("mediumblob",), (None,)], "d string").select(naming.db_type(F.col("d"))).collect()] == ["string", "tinyinteger", "geometry", "biginteger", "year", "binary", None]
    k = frame([("select  1",), ("SELECT 1 ",)], "q string").select(naming.sql_key(F.col("q")).alias("k")).distinct()
    assert k.count() == 1
