import datetime as dt
import random

import pytest

from codeweft.operators import hierarchy

CLASSES = "class_id long, fqn string, extends string, implements array<string>, traits array<string>, parsed_at timestamp, removed_at timestamp, key string"
T0 = dt.datetime(2024, 1, 1)


def brute_closure(nodes, links):
    out = {}
    for a, b in links:
        if a in nodes and b in nodes:
            out.setdefault(a, set()).add(b)
    pairs = set()
    for n in nodes:
        seen, todo = set(), list(out.get(n, ()))
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += out.get(x, ())
        pairs |= {(n, x) for x in seen}
    return pairs


def graph(kind, n, r):
    names = [f"n{i:03}" for i in range(n)]
    if kind == "chain":
        return names, [(names[i], names[i + 1], 0) for i in range(n - 1)]
    if kind == "star":
        return names, [(x, names[0], 0) for x in names[1:]]
    if kind == "ring":
        return names, [(names[i], names[(i + 1) % n], 0) for i in range(n)]
    links = [(r.choice(names), r.choice(names), r.randrange(3)) for _ in range(n + n // 2)]
    return names, links + [(names[0], "gone", 0), ("gone", names[1], 1)]


@pytest.mark.parametrize("kind,n", [("chain", 23), ("star", 40), ("ring", 9), ("random", 30), ("random", 31)])
def test_closure_is_that_of_brute_force(frame, kind, n):
    names, links = graph(kind, n, random.Random(n))
    got = hierarchy.closure(frame([(x,) for x in names], "node string"), frame(links, "child string, parent string, prio int"))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == brute_closure(set(names), [(a, b) for a, b, _ in links])


def test_intervals_nest_as_the_forest_does(frame):
    r = random.Random(3)
    names = [f"n{i:03}" for i in range(40)]
    parent = {x: names[r.randrange(i)] for i, x in enumerate(names) if i > 2}
    got = {x["node"]: x for x in hierarchy.euler_intervals(frame([(x,) for x in names], "node string"), frame(list(parent.items()), "child string, parent string")).collect()}

    def above(x):
        out = []
        while x in parent:
            x = parent[x]
            out.append(x)
        return out

    for x in names:
        assert got[x]["depth"] == len(above(x))
        assert got[x]["root"] == (above(x) or [x])[-1]
        for y in names:
            inside = got[x]["root"] == got[y]["root"] and got[y]["entry"] < got[x]["entry"] < got[y]["leave"]
            assert inside == (y in above(x))


def test_cycle_breaks_one_link_a_cycle(frame):
    links = [("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("y", "x"), ("p", "a"), ("q", "p"), ("s", "t")]
    links += [(f"k{i:02}", f"k{i + 1:02}") for i in range(40)]
    assert sorted(r["child"] for r in hierarchy.cycle_breaks(frame(links, "child string, parent string")).collect()) == ["a", "x"]


def symbols(frame, rows):
    return frame([(i, fqn, ext, imp, tr, at, gone, "clash") for i, (fqn, ext, imp, tr, at, gone) in enumerate(rows)], CLASSES)


def test_pairs_follow_the_rules_of_names_and_rows(frame):
    later = T0 + dt.timedelta(days=1)
    rows = [
        ("A\\Base", None, None, None, T0, None), ("\\a\\Child ", " \\A\\BASE", [None, ""], [], T0, None), ("A\\Loop", "a\\loop", [], [], T0, None),
        ("A\\Gone", "A\\Base", [], [], T0, None), ("A\\Gone", "A\\Base", [], [], later, later), ("A\\Twice", "A\\Nobody", [], [], T0, None), ("A\\Twice", "A\\Base", [], [], later, None),
        ("A\\Tie", None, [], ["A\\Child"], None, None), (None, "A\\Base", [], [], T0, None), (" ", "A\\Base", [], [], T0, None), ("A\\Low", "A\\Gone", [], [], T0, None),
    ]
    got = {tuple(r) for r in hierarchy.symbol_pairs(symbols(frame, rows)).collect()}
    child = "\\a\\Child "
    assert got == {tuple(sorted(p)) for p in [("A\\Base", child), ("A\\Loop", "A\\Loop"), ("A\\Base", "A\\Twice"), (child, "A\\Tie"), ("A\\Base", "A\\Tie")]}


def test_no_symbols_no_pairs(frame):
    none = symbols(frame, [])
    assert hierarchy.symbol_pairs(none).count() == 0
    assert hierarchy.symbol_hierarchy(none).count() == 0
    assert hierarchy.symbol_loops(none).count() == 0


def test_hierarchy_gives_path_depth_and_descendants(frame):
    rows = [("R", None, [], [], T0, None), ("M", "R", [], [], T0, None), ("L", "M", ["R"], [], T0, None), ("X", "Y", [], [], T0, None), ("Y", "X", [], [], T0, None)]
    got = {r["fqn"]: r for r in hierarchy.symbol_hierarchy(symbols(frame, rows)).collect()}
    assert got["L"]["path"] == ["R", "M", "L"] and got["L"]["depth"] == 2 and got["L"]["root"] == "R"
    assert got["R"]["n_descendants"] == 2 and got["M"]["n_descendants"] == 1
    assert {got["X"]["depth"], got["Y"]["depth"]} == {0, 1}
    below = {(r["fqn"], r["descendant"], r["distance"]) for r in hierarchy.symbol_descendants(symbols(frame, rows)).collect()}
    assert {("R", "M", 1), ("R", "L", 2), ("M", "L", 1)} <= below


def test_descendants_follow_left_over_links(frame):
    rows = [
        ("I", None, [], [], T0, None), ("U", None, [], [], T0, None), ("B", None, [], [], T0, None), ("C", "B", ["I"], ["U"], T0, None), ("D", "C", [], [], T0, None),
        ("E", "D", ["B"], [], T0, None), ("X", "Y", [], [], T0, None), ("Y", "X", ["I"], [], T0, None),
    ]
    df = symbols(frame, rows)
    below = {(r["fqn"], r["descendant"]): r for r in hierarchy.symbol_descendants(df).collect()}
    want = {("I", x) for x in "CDEXY"} | {("U", x) for x in "CDE"} | {("B", x) for x in "CDE"} | {("C", "D"), ("C", "E"), ("D", "E")} | {(a, b) for a in "XY" for b in "XY"}
    assert set(below) == want
    assert below["U", "E"]["path"] == ["U", "C", "D", "E"] and below["U", "E"]["distance"] == 3
    assert below["B", "E"]["path"] == ["B", "C", "D", "E"] and below["I", "X"]["path"] == ["I", "Y", "X"] and below["X", "X"]["distance"] == 2
    got = {r["fqn"]: r for r in hierarchy.symbol_hierarchy(df).collect()}
    assert {x: got[x]["n_descendants"] for x in got} == {x: sum(a == x for a, _ in want) for x in got}
    assert got["E"]["path"] == ["B", "C", "D", "E"] and got["E"]["roots"] == ["B", "I", "U"] and got["X"]["roots"] == ["I", "X"] and got["I"]["roots"] == ["I"]


def test_ways_are_those_of_brute_force(frame):
    names, links = graph("random", 24, random.Random(24))
    named, df = frame([(x, x) for x in names], "node string, fqn string"), frame(links, "child string, parent string, prio int")
    got = hierarchy.ways(named, df).collect()
    main = {tuple(r) for r in hierarchy.forest_of(named.select("node"), df)[0].select("child", "parent").collect()}
    edges = {(a, b): ((a, b) not in main, 1) for a, b, _ in links if a in names and b in names}
    far = dict(edges)
    for _ in names:
        for (a, b), n in list(far.items()):
            for (c, d), m in edges.items():
                if c == b:
                    far[a, d] = min(far.get((a, d), (99, 99)), (n[0] + m[0], n[1] + m[1]))
    assert {(r["node"], r["reached"]): r["distance"] for r in got} == {p: n for p, (_, n) in far.items()} and len(got) == len(far)
    for r in got:
        way = r["path"]
        assert way[0] == r["reached"] and way[-1] == r["node"] and len(way) == r["distance"] + 1 and all((b, a) in edges for a, b in zip(way, way[1:]))


@pytest.mark.parametrize("seed", [1, 2])
def test_nearest_ways_are_those_of_a_breadth_first_search(frame, seed):
    r = random.Random(seed)
    names = [f"n{i:02}" for i in range(14)]
    links = sorted({(r.choice(names), r.choice(names), r.randrange(3)) for _ in range(20)} | {("n00", "n01", 0), ("n01", "n02", 0), ("n02", "n00", 0), ("n05", "gone", 0)})
    up = {}
    for a, b, p in links:
        if b in names:
            up.setdefault(a, {}).setdefault(b, p)
            up[a][b] = min(up[a][b], p)
    want = {}
    for a in names:
        # (distance, first prio) by rounds; the first link's prio is carried along
        front = {b: (1, p) for b, p in up.get(a, {}).items()}
        best = dict(front)
        while front:
            step = {}
            for b, (d, f) in front.items():
                for c in up.get(b, {}):
                    step[c] = min(step.get(c, (d + 1, f)), (d + 1, f))
            front = {c: v for c, v in step.items() if c not in best or v < best[c]}
            best.update(front)
        want.update({(a, b): v for b, v in best.items()})
    got = hierarchy.nearest_ways(frame([(n,) for n in names], "node string"), frame(links, "child string, parent string, prio int"))
    assert {(x["node"], x["reached"]): (x["distance"], x["first"]) for x in got.collect()} == want
