import datetime as dt

import pytest

from codeweft.plans import sqlgate
from codeweft.plans.pattern import PatternError, Translator
from codeweft.streaming import watch


@pytest.mark.parametrize("sql", ["select 'drop table x'", "WITH a AS (SELECT 1) SELECT * FROM a", "show create table t", "explain select 1", "select 1 -- delete"])
def test_reading_statements_pass(sql):
    assert sqlgate.read_only(sql) is None


@pytest.mark.parametrize("sql", ["drop table x", "select 1; select 2", "with a as (select 1) insert into t select * from a", "", "select * from t where 1 = 1 union all delete from t", "set x = 1"])
def test_writing_statements_are_refused(sql):
    assert sqlgate.read_only(sql)


def test_limits_are_added_and_clamped():
    assert sqlgate.limited("select 1", 9999).endswith("LIMIT 500")
    assert sqlgate.limited("select 1", -4).endswith("LIMIT 1")
    assert sqlgate.limited("select 1 limit 7;") == "select 1 LIMIT 7" and sqlgate.limited("select 1 LIMIT 100000 OFFSET 3").endswith("LIMIT 500 OFFSET 3") and sqlgate.limited("select 1 limit all").endswith("LIMIT 500")
    assert sqlgate.limited("select 1 limit 10 * 100").endswith("LIMIT 500")
    assert sqlgate.limited("show tables") == "show tables"


def test_cache_keeps_for_its_time(spark):
    now = [0.0]
    c = sqlgate.ResultCache(10, lambda: now[0])
    a = sqlgate.cached_sql(spark, c, "select 1 as x")
    assert c.get("spark", "SELECT   1 AS x") == a and c.stats() == {"spark": {"live": 1, "expired": 0}}
    now[0] = 11
    assert c.stats() == {"spark": {"live": 0, "expired": 1}} and c.get("spark", "select 1 as x") is None
    c.set("a", "q", [1])
    assert c.invalidate("b") == 0 and c.invalidate("a") == 1 and c.evict() == 0
    with pytest.raises(PermissionError):
        sqlgate.run_sql(spark, "delete from t")
    assert sqlgate.run_sql(spark, "select :v as v", v="a' or 1").first()["v"] == "a' or 1"


@pytest.fixture
def graph(frame):
    n = frame([("u1", "User", "Ann", 30), ("u2", "User", "Bob's", 20), ("p1", "Post", "Hello", None), ("p2", "Post", "World", None)], "node_id string, label string, name string, age int")
    e = frame([("u1", "WROTE", "p1", 1), ("u1", "WROTE", "p2", 2), ("u2", "LIKES", "p1", 3)], "src string, rel string, dst string, line int")
    return Translator(n, e)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_patterns(graph):
    assert rows(graph.run("MATCH (u:User)-[:WROTE]->(p:Post) RETURN u.name AS u, count(p) AS n")) == [("Ann", 2)]
    assert rows(graph.run("MATCH (p:Post {name: 'Hello'})<-[:WROTE|LIKES]-(u) RETURN u.name AS u ORDER BY u DESC")) == [("Bob's",), ("Ann",)]
    assert rows(graph.run("MATCH (u:User) OPTIONAL MATCH (u)-[:LIKES]->(p) RETURN u.name AS u, p.name AS p ORDER BY u")) == [("Ann", None), ("Bob's", "Hello")]
    assert rows(graph.run("MATCH (u:User)-[:WROTE]->(p)<-[l:LIKES]-(v) WHERE v.age < $a AND l.line = 3 RETURN DISTINCT u.name AS u, v.name AS v LIMIT 5", a=25)) == [("Ann", "Bob's")]
    assert rows(graph.run("MATCH (u) WHERE u.name = 'Bob\\'s' RETURN u, labels(u)[0] AS l")) == [("u2", "User")]
    assert rows(graph.run("MATCH (u:User) WHERE u.age IN $ages RETURN u.name AS n", ages=[20])) == [("Bob's",)]
    assert rows(graph.run("MATCH (a)-[r]-(b:Post) RETURN b.name AS b, count(*) AS n ORDER BY b SKIP 1")) == [("World", 1)]


def test_patterns_of_any_length_exists_with_and_union(frame):
    n = frame([(x, "Class_" if x < "d" else "Post", x.upper(), i) for i, x in enumerate("abcde")], "node_id string, label string, name string, age int")
    e = frame([("a", "UP", "b", 1), ("b", "UP", "c", 2), ("c", "UP", "d", 3), ("a", "HAS", "d", 4), ("a", "HAS", "e", 5), ("d", "UP", "a", 6)], "src string, rel string, dst string, line int")
    g = Translator(n, e)
    far = lambda q: sorted(rows(g.run(q)))
    assert far("MATCH (x {name: 'A'})-[:UP*1..2]->(y) RETURN y.name AS y") == [("B",), ("C",)]
    assert far("MATCH (x {name: 'A'})-[:UP*2]->(y) RETURN y.name AS y") == [("C",)] and far("MATCH (x {name: 'C'})<-[:UP*..9]-(y) RETURN y.name AS y") == [("A",), ("B",), ("C",), ("D",)]
    assert far("MATCH (x {name: 'B'})-[:UP*0..1]-(y) RETURN y.name AS y") == [("A",), ("B",), ("C",)] and far("MATCH (x {name: 'A'})-[:UP*]->(y) RETURN count(*) AS n") == [(4,)]
    assert far("MATCH (x:Class) WHERE EXISTS {(x)-[:HAS]->(y) WHERE y.name = 'E'} RETURN x.name AS x") == [("A",)]
    assert far("MATCH (x:Class) WHERE NOT EXISTS { MATCH (x)-[:HAS]->() } AND x.age < 2 RETURN x.name AS x") == [("B",)]
    assert far("MATCH (x)-[:HAS]->(y) WITH x, count(y) AS n WHERE n > 1 MATCH (x)-[:UP]->(z) RETURN x.name AS x, n, z.name AS z") == [("A", 2, "B")]
    assert far("MATCH (x {name: 'A'}) RETURN x.name AS n UNION MATCH (x:Class) WHERE x.name STARTS WITH 'A' OR x.name = 'UNION' RETURN x.name AS n") == [("A",)]
    assert far("MATCH (x {name: 'A'}) RETURN x.name AS n UNION ALL MATCH (x {name: 'A'}) RETURN x.name AS n") == [("A",), ("A",)]
    assert far("MATCH (x {name: 'A'})-[r:HAS]->(y) RETURN *") == [("HAS", "a", "d"), ("HAS", "a", "e")]


@pytest.mark.parametrize("q", ["MATCH (n) SET n.x = 1", "MATCH (n) DETACH DELETE n"])
def test_patterns_only_read(graph, q):
    with pytest.raises(PermissionError):
        graph.run(q)


@pytest.mark.parametrize("q", ["RETURN 1", "MATCH n RETURN n", "MATCH (n)", "MATCH (n) WHERE n.x = $y RETURN n"])
def test_patterns_outside_the_subset(graph, q):
    with pytest.raises(PatternError):
        graph.run(q)
    assert rows(graph.run("MATCH (n) WHERE n.name = 'set' RETURN n")) == []


def test_merge_stream_keeps_the_latest_row(spark, tmp_path):
    schema = "path string, at timestamp, text string"
    t = dt.datetime(2024, 1, 1)
    inbox, seen = tmp_path / "in", []
    for i, batch in enumerate([[("a", t, "1"), ("b", t, "1")], [("a", t + dt.timedelta(1), "2"), ("a", t, "old")]]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(inbox))
        q = watch.merge_stream(watch.changed_files(spark, str(inbox), schema), str(tmp_path / "t"), ["path"], ["at"], str(tmp_path / "c"), after=lambda df: seen.append(df.count()))
        q.awaitTermination(120)
    got = watch.current(spark, str(tmp_path / "t"), schema)
    assert {(r["path"], r["text"]) for r in got.collect()} == {("a", "2"), ("b", "1")} and seen == [2, 2]


def test_steps_and_windows(spark, frame, tmp_path):
    x = watch.steps_for(frame([("app/Models/A.php",), ("x.php",)], "path string"))
    assert watch.steps_for(frame([("routes/a.php",), ("a/b.blade.php",), ("x.css",), ("database/migrations/1.php",)], "path string")).count() == 4
    assert x.filter("path = 'x.php'").count() == len(watch.BASE_STEPS) == 11 and x.filter("step = 'relations'").count() == 1
    schema = "ts timestamp_ntz, event_type string"
    t = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(t, "a"), (t + dt.timedelta(minutes=5), "a"), (t + dt.timedelta(hours=3), "b")], schema).write.parquet(str(tmp_path / "e"))
    q = watch.windowed_counts(watch.changed_files(spark, str(tmp_path / "e"), schema), "ts", "event_type").writeStream.format("memory").queryName("w").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r["event_type"], r["n"]) for r in spark.table("w").collect()} == {("a", 2), ("b", 1)}
