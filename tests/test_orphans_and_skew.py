import datetime as dt

from pyspark.sql import functions as F

from codeweft import skew
from codeweft.operators import orphans

T0, T1 = dt.datetime(2024, 1, 5), dt.datetime(2024, 2, 5)


def tables(frame, classes=(), uses=(), models=(), frame_symbols=(), db=()):
    return (
        frame(list(classes), "class_id long, fqn string, extends string, parsed_at timestamp, removed_at timestamp"), frame(list(uses), "use_id long, fqn string, parsed_at timestamp"),
        frame(list(models), "model_id long, repo string, db_table string, parsed_at timestamp"), frame(list(frame_symbols), "fqn string"), frame(list(db), "table_id long, repo string, name string, created_at timestamp, dropped_at timestamp"),
    )


def test_class_and_table_orphans(frame):
    got = orphans.code_orphans(
        *tables(
            frame,
            [(1, "A\\One", "F\\Base", T0, None), (2, "A\\Two", "a\\ONE", T0, None), (3, "A\\Three", "A\\None", T0, None), (4, "A\\Four", "A\\None", T0, T1), (5, "A\\Five", " ", T0, None), (6, "A\\One", "A\\None", T0 - dt.timedelta(1), None)],
            [(1, "\\A\\One", T0), (2, "A\\Gone", T1), (3, None, T0), (4, "A\\Gone", T1), (5, "A\\Four", None)],
            [(1, "r", "`shop`.`Orders`", T0), (2, "r", "old", T0), (3, "s", "orders", T0), (4, "r", None, T0), (5, "r", "''", T0), (6, None, "orders", T0), (7, "r", "again", T0)],
            [("F\\Base",)],
            [(1, "r", "orders", T0, None), (2, "r", "old", T0, T1), (3, "r", "again", T0, T0), (4, "r", "AGAIN", T1, None)],
        )
    )
    rows = {(r["ref_table"], r["ref_id"]): r["month"] for r in got.collect()}
    assert rows == {("parsed_classes", 3): "2024-01", ("parsed_classes", 6): "2024-01", ("parsed_uses", 2): "2024-02", ("parsed_uses", 4): "2024-02", ("parsed_uses", 5): None, ("eloquent_models", 2): "2024-01", ("eloquent_models", 3): "2024-01", ("eloquent_models", 6): "2024-01"}


def test_empty_tables(frame):
    assert orphans.code_orphans(*tables(frame)).count() == 0
    assert orphans.orphan_report(*tables(frame)).count() == 0
    assert orphans.code_orphans(*tables(frame, uses=[(1, "A", T0), (2, "A", T0)])).count() == 2


def test_report_counts_every_row(frame):
    got = orphans.orphan_report(*tables(frame, uses=[(1, "A", T0), (2, "A", T0), (3, "F", T0)], frame_symbols=[("F",)])).collect()
    assert [tuple(r) for r in got] == [("parsed_uses", "2024-01", 3, 2)]


def test_salted_join_is_a_join(frame):
    left = frame([("hot" if i % 3 == 0 else f"k{i % 7}" if i % 5 else None, i) for i in range(600)], "k string, v int")
    right = frame([("hot", "a"), ("hot", "b"), ("k1", "c"), (None, "d")], "k string, w string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain = sorted(map(str, left.join(right, ["k"], how).collect()))
        assert sorted(map(str, skew.salted_join(left, right, ["k"], how, salts=8, share=0.1, min_rows=10).collect())) == plain
    assert [r["k"] for r in skew.hot_keys(left, ["k"], 0.2, 10).collect()] == ["hot"]


def test_grouped_rank_is_the_row_number(frame):
    rows = [("g" if i % 4 else "h", i, [0.0, 1.0, None, 0.5, (i * 37 % 101) / 101][i % 5]) for i in range(200)]
    got = skew.grouped_rank(frame(rows, "g string, i int, s double"), ["g"], "s", [F.col("i")], "rank", bins=16)
    for g in ("g", "h"):
        want = sorted([r for r in rows if r[0] == g], key=lambda r: (r[2] is None, -(r[2] or 0), r[1]))
        have = {r["i"]: r["rank"] for r in got.filter(F.col("g") == g).collect()}
        assert have == {r[1]: n + 1 for n, r in enumerate(want)}
