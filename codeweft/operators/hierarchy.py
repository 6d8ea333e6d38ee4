"""Parent-child rows of unknown depth to full hierarchies.

Leaves are peeled to expose cycles, each cycle loses one link, and the forest that remains is
written as Euler tours whose positions come from parallel list ranking (pointer jumping, a
logarithmic number of rounds). Entry and exit positions then give depth, root, number of
descendants, and - through an equi-join on dyadic position blocks - ancestors and paths.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codeweft.functions.names import class_key
from codeweft.operators.symbols import living_symbols
from codeweft.session import cut, discard, rows, seen
from codeweft.skew import salted_join

#: Siblings are chained within this many buckets of each parent, so no parent is one task.
SIBLING_BUCKETS = 64
#: Rounds of plain peeling, and peels a round, before the rest is decided by pointer jumping.
PEEL_ROUNDS, PEELS = 2, 3
#: Joins with the pointers of the round before in one round of pointer jumping: pointers grow by one more than this.
JUMPS = 2


def cycle_breaks(parents: DataFrame) -> DataFrame:
    """One ``child`` of each cycle in (child, parent) links with at most one parent a child.

    Childless nodes are peeled off round by round; what is left after a few rounds are cycles
    and long chains, and only that rest is followed by pointer doubling: a node on a cycle is
    one that is still pointed at after more steps than nodes are left. The link of the least
    key of a cycle is the one to break. Links to nodes that have no row end there.
    """
    core, n = parents.select("child", "parent"), None
    for _ in range(PEEL_ROUNDS):
        peeled = core
        for _ in range(PEELS):
            peeled = peeled.join(peeled.select(F.col("parent").alias("child")).distinct(), "child", "left_semi")
        smaller = cut(peeled, "core")
        discard(core)
        core, before, n = smaller, n, rows(smaller)
        if n in (0, before):
            break
    if n == 0:
        return core.select("child")
    # jump[v]: the node so many steps above v (no row where a root comes before), least: the least key met on the way
    jump, steps = cut(core.select("child", F.col("parent").alias("up"), F.least("child", "parent").alias("least")), "jump"), 1
    discard(core)
    while steps < rows(jump) + 1:  # no cycle is longer than the rows that are left
        above = jump.select(F.col("child").alias("up"), F.col("up").alias("up2"), F.col("least").alias("least2"))
        further = jump
        for _ in range(JUMPS):
            further = salted_join(further, above, ["up"], most=rows(jump)).select("child", F.col("up2").alias("up"), F.least("least", "least2").alias("least"))
        further = cut(further, "jump")
        discard(jump)
        jump, steps = further, steps * (JUMPS + 1)
    on_cycle = jump.select(F.col("up").alias("child")).distinct()
    return jump.join(on_cycle, "child", "left_semi").groupBy("least").agg(F.min("least").alias("child")).select("child")


def _tour(nodes: DataFrame, forest: DataFrame) -> DataFrame:
    """The successor lists of the Euler tours: (el, nxt, weight, delta) with ``el`` as (node, side).

    Side 0 enters a node, side 1 leaves it; a childless node is one element that does both.
    """
    kids = forest.select("child", "parent", F.pmod(F.xxhash64("child"), F.lit(SIBLING_BUCKETS)).alias("b"))
    by_bucket = W.partitionBy("parent", "b").orderBy("child")
    chained = kids.withColumn("sib", F.lead("child").over(by_bucket))
    ends = kids.groupBy("parent", "b").agg(F.min("child").alias("first"), F.max("child").alias("last"))
    by_parent = W.partitionBy("parent").orderBy("b")  # at most SIBLING_BUCKETS rows
    links = ends.withColumn("sib2", F.lead("first").over(by_parent)).select(F.col("last").alias("child"), "sib2")
    chained = chained.join(links, "child", "left").select("child", "parent", F.coalesce("sib", "sib2").alias("sib"))
    first = ends.groupBy(F.col("parent").alias("node")).agg(F.min_by("first", "b").alias("first_child"))
    full = nodes.join(chained.withColumnRenamed("child", "node"), "node", "left").join(first, "node", "left")
    el = lambda c, side: F.struct(c.alias("node"), F.lit(side).alias("side"))
    node, parent, sib, kid = F.col("node"), F.col("parent"), F.col("sib"), F.col("first_child")
    after = F.when(sib.isNotNull(), el(sib, 0)).when(parent.isNotNull(), el(parent, 1))
    leaf = F.array(F.struct(el(node, 0).alias("el"), after.alias("nxt"), F.lit(2).cast("long").alias("w"), F.lit(0).cast("long").alias("d")))
    inner = F.array(
        F.struct(el(node, 0).alias("el"), el(kid, 0).alias("nxt"), F.lit(1).cast("long").alias("w"), F.lit(1).cast("long").alias("d")),
        F.struct(el(node, 1).alias("el"), after.alias("nxt"), F.lit(1).cast("long").alias("w"), F.lit(-1).cast("long").alias("d")),
    )
    return full.select(F.explode(F.when(kid.isNull(), leaf).otherwise(inner)).alias("x")).select("x.*")


def _ranked(tour: DataFrame) -> DataFrame:
    """List ranking by pointer jumping: for each element the sums of w and d from it to the end, and the end."""
    going = F.count("nxt")
    cur = cut(tour.select("el", "nxt", "w", "d", F.when(F.col("nxt").isNull(), F.col("el.node")).alias("tail")), "rank", going=going)
    while seen(cur, "going"):
        ahead = cur.select(F.col("el").alias("nxt"), F.col("nxt").alias("nxt2"), F.col("w").alias("w2"), F.col("d").alias("d2"), F.col("tail").alias("tail2"))
        moved = cur.filter(F.col("nxt").isNotNull())
        for _ in range(JUMPS):  # an element that has arrived meets nothing and stays as it is
            moved = moved.join(ahead, "nxt", "left").select("el", F.col("nxt2").alias("nxt"), (F.col("w") + F.coalesce("w2", F.lit(0))).alias("w"), (F.col("d") + F.coalesce("d2", F.lit(0))).alias("d"), F.coalesce("tail", "tail2").alias("tail"))
        # those that have arrived before are still pointed at, so they are carried along
        new = cut(moved.unionByName(cur.filter(F.col("nxt").isNull())), "rank", going=going)
        discard(cur)
        cur = new
    return cur


def euler_intervals(nodes: DataFrame, forest: DataFrame) -> DataFrame:
    """(node, root, depth, entry, leave) of a forest of (child, parent) links over ``nodes``.

    A node is below another when its entry lies between the other's entry and leave and the
    roots agree. Positions run upward within each root. Depth of a root is 0.
    """
    r = _ranked(_tour(nodes, forest))
    sides = r.groupBy(F.col("el.node").alias("node")).agg(
        F.max(F.when(F.col("el.side") == 0, F.col("w"))).alias("w0"), F.max(F.when(F.col("el.side") == 0, F.col("d"))).alias("d0"),
        F.max(F.when(F.col("el.side") == 1, F.col("w"))).alias("w1"), F.first("tail").alias("root"),
    )
    total = sides.filter(F.col("node") == F.col("root")).select("root", F.col("w0").alias("total"))
    placed = salted_join(sides, total, ["root"], most=rows(r))  # one root may hold most nodes
    # a leaf's element covers entry and leave, and sees the depth sum behind itself
    return cut(
        placed.select(
            "node", "root",
            (-F.col("d0") + 0).alias("depth"),
            (F.col("total") - F.col("w0")).alias("entry"),
            (F.col("total") - F.coalesce("w1", F.col("w0") - 1)).alias("leave"),
        ),
        "euler", span=F.max(F.col("leave") - F.col("entry")),
    )


def ancestor_pairs(intervals: DataFrame) -> DataFrame:
    """(node, ancestor, ancestor_depth) for every proper ancestor in the forest.

    The positions strictly inside an interval are covered by O(log n) dyadic blocks; a position
    lies in one block a level, so the containment becomes an equi-join on (root, level, block)
    that meets each pair exactly once. Blocks of a huge root are salted.
    """
    levels = max(1, int(seen(intervals, "span") or 1).bit_length())  # a block is no longer than the longest interval
    inner = intervals.filter(F.col("leave") > F.col("entry") + 1).select(F.col("node").alias("ancestor"), F.col("depth").alias("ancestor_depth"), "root", (F.col("entry") + 1).alias("lo"), F.col("leave").alias("hi"))
    # dyadic cover of [lo, hi): on the way up a level, an odd lo takes block lo, an odd hi takes block hi - 1
    blocks = []
    for k in range(levels + 1):
        lo, hi = F.expr(f"shiftright(lo + {(1 << k) - 1}, {k})"), F.expr(f"shiftright(hi, {k})")
        blocks.append(F.when((lo < hi) & (lo % 2 == 1), F.struct(F.lit(k).alias("level"), lo.alias("block"))))
        blocks.append(F.when((lo < hi) & (hi % 2 == 1) & ~((lo % 2 == 1) & (hi - 1 == lo)), F.struct(F.lit(k).alias("level"), (hi - 1).alias("block"))))
    cover = inner.select("ancestor", "ancestor_depth", "root", F.explode(F.filter(F.array(*blocks), lambda x: x.isNotNull())).alias("x")).select("ancestor", "ancestor_depth", "root", "x.*")
    points = intervals.select("node", "root", F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.expr(f"shiftright(entry, {k})").alias("block")) for k in range(levels + 1)])).alias("x")).select("node", "root", "x.*")
    return salted_join(points, cover, ["root", "level", "block"], most=rows(intervals) * (levels + 1)).select("node", "ancestor", "ancestor_depth")


def forest_of(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Splits (child, parent, prio) links into a spanning forest and the links left over.

    Each child keeps its link of least (prio, parent); cycles among those lose the link of their
    least child. Links of a node to itself, and links to or from nodes not in ``nodes``, are never
    in the forest; the first stay among the left-over links, the others are dropped.
    """
    both = links.join(nodes.select(F.col("node").alias("child")), "child", "left_semi").join(nodes.select(F.col("node").alias("parent")), "parent", "left_semi")
    both = cut(both.groupBy("child", "parent").agg(F.min("prio").alias("prio")), "links")
    chosen = cut(both.filter("child <> parent").groupBy("child").agg(F.min(F.struct("prio", "parent")).alias("x")).select("child", "x.parent"), "chosen")
    breaks = cut(cycle_breaks(chosen), "breaks")
    forest = cut(chosen.join(breaks, "child", "left_anti"), "forest")
    rest = cut(both.join(forest, ["child", "parent"], "left_anti").select("child", "parent"), "rest")
    discard(chosen, breaks, both)
    return forest, rest


def closure(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Every (node, reached) over one or more (child, parent, prio) links, once; a node on a loop reaches itself.

    Reaching along the forest comes from the Euler intervals. Each further round takes one
    left-over link and the forest path above it, so the rounds count the left-over links on a
    path, not its length. Only pairs found in the last round are carried on.
    """
    forest, rest = forest_of(nodes, links)
    return _closed(nodes, euler_intervals(nodes, forest), rest)


def _closed(nodes: DataFrame, spans: DataFrame, rest: DataFrame) -> DataFrame:
    """:func:`closure` from the intervals of the forest and the links left over."""
    tree = cut(ancestor_pairs(spans).select("node", F.col("ancestor").alias("reached")), "tree")
    if not rows(rest):
        return tree
    # one left-over link and whatever the forest has above its parent
    hop = cut(rest.select(F.col("child").alias("reached"), F.col("parent").alias("to")).unionByName(
        salted_join(tree.select(F.col("node").alias("parent"), F.col("reached").alias("to")), rest, ["parent"], most=rows(tree)).select(F.col("child").alias("reached"), "to")
    ).distinct(), "hop")
    frontier, most = tree.select("node", "reached").unionByName(nodes.select("node", F.col("node").alias("reached"))), rows(tree) + rows(spans)
    parts = [tree]
    while True:
        found = salted_join(frontier, hop, ["reached"], most=most).select("node", F.col("to").alias("reached")).distinct()
        new = cut(found.join(_union(parts), ["node", "reached"], "left_anti"), "pairs")
        if not rows(new):
            discard(new, hop)
            return _union(parts)
        parts.append(new)
        frontier, most = new, rows(new)


def _union(parts: list[DataFrame]) -> DataFrame:
    """The rows of parts that stay where they were written, their number known."""
    out = reduce(lambda a, b: a.unionByName(b), parts)
    out._codeweft_seen = {"_rows": sum(map(rows, parts))}  # noqa: SLF001
    return out


def _forest_paths(spans: DataFrame, named: DataFrame) -> DataFrame:
    """(node, path) of every node: the names (node, fqn) from its root down to itself."""
    pairs = cut(ancestor_pairs(spans), "above")
    up = salted_join(pairs, named.withColumnRenamed("node", "ancestor"), ["ancestor"], most=rows(pairs))
    above = up.groupBy("node").agg(F.transform(F.sort_array(F.collect_list(F.struct("ancestor_depth", "fqn"))), lambda x: x["fqn"]).alias("above"))
    return named.join(above, "node", "left").select("node", F.concat(F.coalesce("above", F.array().cast("array<string>")), F.array("fqn")).alias("path"))


def ways(named: DataFrame, links: DataFrame) -> DataFrame:
    """(node, reached, distance, path) of every pair of :func:`closure`, with the way of fewest left-over links, of these the shortest.

    ``named`` has (node, fqn); ``path`` has the names from the reached node down to the node. As in
    closure(), a round takes one left-over link and the forest above it, and only pairs found in
    the last round are carried on.
    """
    only = named.select("node")
    forest, rest = forest_of(only, links)
    spans = euler_intervals(only, forest)
    lines = _forest_paths(spans, named)
    steps = F.col("depth") - F.col("ancestor_depth")
    down = ancestor_pairs(spans).join(spans.select("node", "depth"), "node").join(lines, "node")
    tree = cut(down.select("node", F.col("ancestor").alias("reached"), steps.cast("long").alias("distance"), F.slice("path", (F.col("ancestor_depth") + 1).cast("int"), (steps + 1).cast("int")).alias("path")), "tree")
    if not rows(rest):
        return tree
    named_rest = rest.join(named.select(F.col("node").alias("child"), F.col("fqn").alias("child_fqn")), "child")
    one = named_rest.join(named.select(F.col("node").alias("parent"), F.col("fqn").alias("parent_fqn")), "parent")
    above = tree.select(F.col("node").alias("parent"), F.col("reached").alias("to"), "distance", "path")
    hop = one.select(F.col("child").alias("reached"), F.col("parent").alias("to"), F.lit(1).cast("long").alias("far"), F.array("parent_fqn", "child_fqn").alias("way")).unionByName(
        salted_join(above, named_rest, ["parent"], most=rows(tree)).select(F.col("child").alias("reached"), "to", (F.col("distance") + 1).alias("far"), F.concat("path", F.array("child_fqn")).alias("way"))
    )
    hop = cut(hop.groupBy("reached", "to").agg(F.min(F.struct("far", "way")).alias("x")).select("reached", "to", "x.*"), "hop")
    frontier, most = tree.unionByName(named.select("node", F.col("node").alias("reached"), F.lit(0).cast("long").alias("distance"), F.array("fqn").alias("path"))), rows(tree) + rows(spans)
    parts = [tree]
    while True:
        met = salted_join(frontier, hop, ["reached"], most=most).select("node", F.col("to").alias("reached"), (F.col("distance") + F.col("far")).alias("distance"), F.concat("way", F.slice("path", F.lit(2), F.size("path"))).alias("path"))
        found = met.groupBy("node", "reached").agg(F.min(F.struct("distance", "path")).alias("x")).select("node", "reached", "x.*")
        new = cut(found.join(_union(parts).select("node", "reached"), ["node", "reached"], "left_anti"), "pairs")
        if not rows(new):
            discard(new, hop)
            return _union(parts)
        parts.append(new)
        frontier, most = new, rows(new)


def nearest_ways(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, reached, distance, first) of every pair of :func:`closure`: the fewest links between the two, and the least prio of a first link on such a way.

    Within the forest the distance is the difference of depths. Then, as in closure(), a round takes
    one left-over link and the forest above it; pairs that got nearer are carried on, so the
    rounds count left-over links and not generations.
    """
    forest, rest = forest_of(nodes, links)
    spans = euler_intervals(nodes, forest)
    own = links.groupBy("child", "parent").agg(F.min("prio").alias("prio"))
    starts = forest.join(own, ["child", "parent"]).select(F.col("child").alias("node"), F.col("prio").alias("first"))
    down = ancestor_pairs(spans).join(spans.select("node", "depth"), "node").join(starts, "node")
    tree = cut(down.select("node", F.col("ancestor").alias("reached"), (F.col("depth") - F.col("ancestor_depth")).cast("long").alias("distance"), "first"), "tree")
    if not rows(rest):
        return tree
    beside = cut(rest.join(own, ["child", "parent"]), "beside")
    hop = beside.select(F.col("child").alias("reached"), F.col("parent").alias("to"), F.lit(1).cast("long").alias("far"), F.col("prio").alias("link")).unionByName(
        salted_join(tree.select(F.col("node").alias("parent"), F.col("reached").alias("to"), "distance"), beside, ["parent"], most=rows(tree)).select(F.col("child").alias("reached"), "to", (F.col("distance") + 1).alias("far"), F.col("prio").alias("link"))
    )
    hop = cut(hop.groupBy("reached", "to").agg(F.min(F.struct("far", "link")).alias("x")).select("reached", "to", "x.*"), "hop")
    best, front = tree, cut(tree.unionByName(nodes.select("node", F.col("node").alias("reached"), F.lit(0).cast("long").alias("distance"), F.lit(None).cast(tree.schema["first"].dataType).alias("first"))), "front")
    while rows(front):
        met = salted_join(front, hop, ["reached"], most=rows(front)).select("node", F.col("to").alias("reached"), (F.col("distance") + F.col("far")).alias("distance"), F.coalesce("first", "link").alias("first"))
        found = met.groupBy("node", "reached").agg(F.min(F.struct("distance", "first")).alias("x")).select("node", "reached", F.col("x.distance").alias("d2"), F.col("x.first").alias("f2"))
        joined = best.join(found, ["node", "reached"], "full").withColumn("near", F.coalesce(F.col("distance").isNull() | (F.struct("d2", "f2") < F.struct(F.col("distance").alias("d2"), F.col("first").alias("f2"))), F.lit(False)) & F.col("d2").isNotNull())
        merged = cut(joined.select("node", "reached", F.when(F.col("near"), F.col("d2")).otherwise(F.col("distance")).alias("distance"), F.when(F.col("near"), F.col("f2")).otherwise(F.col("first")).alias("first"), "near"), "ways")
        nearer = cut(merged.filter("near").drop("near"), "front")
        discard(front)
        best, front = merged.drop("near"), nearer
    discard(hop, beside, front)
    return best


def symbol_links(parsed_classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, fqn) and links (child, parent, prio) of the living symbols' extends, implements and traits."""
    alive = cut(living_symbols(parsed_classes, ["extends", "implements", "traits"]).withColumnRenamed("key", "node"), "alive")
    empty = F.array().cast("array<string>")
    named = F.concat(
        F.array(F.struct(F.lit(0).alias("prio"), F.col("extends").alias("name"))),
        F.transform(F.coalesce("implements", empty), lambda x: F.struct(F.lit(1).alias("prio"), x.alias("name"))),
        F.transform(F.coalesce("traits", empty), lambda x: F.struct(F.lit(2).alias("prio"), x.alias("name"))),
    )
    links = alive.select(F.col("node").alias("child"), F.explode(named).alias("x")).select("child", class_key(F.col("x.name")).alias("parent"), "x.prio").filter(F.col("parent").isNotNull())
    return alive.select("node", "fqn"), links


def symbol_pairs(parsed_classes: DataFrame) -> DataFrame:
    """(fqn_a, fqn_b): every pair of living symbols one of which is reached from the other, once, the smaller name first.

    Names are compared without ASCII case, outer blanks and a leading separator and written as in
    the row that holds. A symbol on a loop gives a pair with itself. Null, blank and undeclared
    parents, removed symbols and repeated rows add nothing; an empty table gives no pairs.
    """
    nodes, links = symbol_links(parsed_classes)
    pairs = closure(nodes.select("node"), links)
    name = nodes.select("node", "fqn")
    # a base class may be reached from most symbols
    named = salted_join(pairs, name.select(F.col("node").alias("reached"), F.col("fqn").alias("b")), ["reached"], most=rows(pairs)).join(name.withColumnRenamed("fqn", "a"), "node")
    return named.select(F.least("a", "b").alias("fqn_a"), F.greatest("a", "b").alias("fqn_b")).distinct()


def symbol_hierarchy(parsed_classes: DataFrame) -> DataFrame:
    """(fqn, root, depth, path, n_descendants, roots) of every living symbol.

    ``root``, ``depth`` and ``path``, from the root to the symbol, are those of the main line, whose
    parent is the extended class, else the least interface, else the least trait. A circle of
    such parents is cut above its least name, which becomes a root; :func:`symbol_loops` lists the
    symbols on circles. ``n_descendants`` counts the symbols of :func:`symbol_descendants`, and
    ``roots`` has, besides that of the main line, every symbol without parents that is reached over
    any of the links; :func:`symbol_descendants` gives the ways from them.
    """
    nodes, links = symbol_links(parsed_classes)
    only = nodes.select("node")
    forest, rest = forest_of(only, links)
    spans = euler_intervals(only, forest)
    pairs = _closed(only, spans, rest)
    below = pairs.groupBy(F.col("reached").alias("node")).agg(F.count(F.lit(1)).alias("n_descendants"))
    tops = nodes.join(forest.select("child").unionByName(rest.select("child")).select(F.col("child").alias("node")), "node", "left_anti")
    reached = salted_join(pairs, tops.select(F.col("node").alias("reached"), "fqn"), ["reached"], most=rows(pairs)).groupBy("node").agg(F.collect_set("fqn").alias("tops"))
    roots = nodes.select(F.col("node").alias("root"), F.col("fqn").alias("root_fqn"))
    out = salted_join(spans, roots, ["root"], most=rows(spans)).join(nodes, "node").join(_forest_paths(spans, nodes), "node").join(below, "node", "left").join(reached, "node", "left")
    none = F.array().cast("array<string>")
    return out.select(
        "fqn", F.col("root_fqn").alias("root"), "depth", "path",
        F.coalesce("n_descendants", F.lit(0).cast("long")).alias("n_descendants"),
        F.array_sort(F.array_union(F.coalesce("tops", none), F.array("root_fqn"))).alias("roots"),
    )


def symbol_descendants(parsed_classes: DataFrame) -> DataFrame:
    """(fqn, descendant, distance, path) for every symbol and every symbol below it over any mix of its parents.

    ``path`` is a way from the symbol down to the descendant and ``distance`` its number of links: along
    the main line of :func:`symbol_hierarchy` where that holds both, else with the fewest links beside
    main lines and of these the shortest. A symbol on a loop is below itself.
    """
    nodes, links = symbol_links(parsed_classes)
    found = ways(nodes, links)
    return found.select(F.element_at("path", 1).alias("fqn"), F.element_at("path", -1).alias("descendant"), "distance", "path")


def symbol_distances(parsed_classes: DataFrame) -> DataFrame:
    """(fqn, descendant, distance) for every symbol and every symbol below it over any mix of its parents, once, with the fewest links between them.

    A symbol on a loop is below itself, at the length of its shortest loop. :func:`symbol_descendants` gives ways too.
    """
    nodes, links = symbol_links(parsed_classes)
    found = nearest_ways(nodes.select("node"), links)
    named = salted_join(found, nodes.select(F.col("node").alias("reached"), "fqn"), ["reached"]).join(nodes.select("node", F.col("fqn").alias("descendant")), "node")
    return named.select("fqn", "descendant", "distance")


def symbol_loops(parsed_classes: DataFrame) -> DataFrame:
    """(fqn) of every living symbol that reaches itself over any mix of its parents."""
    return symbol_pairs(parsed_classes).filter("fqn_a = fqn_b").select(F.col("fqn_a").alias("fqn"))
