import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeweft.llm import docblocks, documentation, splitting
from codeweft.llm.php_outline import line_starts, methods

CODE = """<?php
namespace App;

/** Not this one. */
interface Shape { /** Gives the area in square metres. */ public function area(): float; }

abstract class Box implements Shape
{
    /**
     * Adds up all sides and rounds once.
     *
     * @return int  the sum,
     *              never below zero
     */
    #[Pure(1, ['a' => "]"])]

    public static function sides(array $x = ['}', "{$a['b']}"], ?callable $f = null): int
    {
        $s = '}'; // }
        $t = <<<'TXT'
            public function fake() {
            TXT;
        $o = new class { public function inner() { return 1; } };
        return array_map(fn ($y) => $y, $x);
    }

    /** Lost. */
    // because of this line
    protected function lost() { return function () { }; }

    abstract public function none(): void;

    /** Old. */
    /** {@inheritDoc} */
    public function area(): float { return 1.0; }

    /* Not documentation. */ function plain() {}
    public function open() {
"""


def test_outline():
    got = {m.name: m for m in methods(CODE)}
    assert set(got) == {"area", "sides", "lost", "none", "plain", "open"}
    s = got["sides"]
    text = CODE.split("\n")
    assert "sides" in text[s.line - 1] and text[s.end_line - 1] == "    }" and s.has_body and "rounds once" in s.doc and s.class_fqn == "App\\Box"
    assert CODE[s.start : s.end].startswith("public static function") and CODE[s.start : s.end].endswith("}")
    assert got["lost"].doc is None and got["plain"].doc is None and got["area"].doc == "/** {@inheritDoc} */"
    assert not got["none"].has_body and got["open"].end_line is None
    assert methods("no code function x() {}") == [] and methods("") == []


def test_lines_end_in_three_ways():
    assert line_starts("a\r\nb\rc\nd") == [0, 3, 5, 7]


@pytest.mark.parametrize(
    "doc,said",
    [
        ("/** Adds up all sides. */", True), ("/**\n * @return int the sum\n *    and more\n */", False), ("/** {@inheritDoc} */", False), ("/** TODO: describe this method. */", False), ("/** Send mail. */", False),
        ("/** The send mail method of this class. */", False), ("/**\n * Sends mail to Mailer.\n */", False), ("/**\n * Sends it twice, if the first attempt fails.\n * @throws X\n */", True), ("/**\n * $this->send($x);\n */", False), ("/** - */", False),
        ("/** Description of the method goes here */", False), ("/** Schickt die Nachricht nur einmal am Tag. */", True), ("/**\n *\n */", False), ("/** {@inheritDoc} Never twice a day. */", True), ("/**\n * ```\n * send now please\n * ```\n */", False), ("/** tbd */", False),
    ],
)
def test_prose_of_comments(doc, said):
    assert docblocks.says_something(docblocks.description(doc), "sendMail", "App\\Mailer") == said


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 35), min_size=1, max_size=700), st.integers(20, 90), st.integers(0, 9))
def test_pieces_cover_overlap_and_keep_the_limit(strengths, limit, overlap):
    got = splitting.piece_ranges(strengths, limit, overlap)
    assert got[0][0] == 0 and got[-1][1] == len(strengths) - 1
    assert all(b - a + 1 <= limit for a, b, _ in got)
    assert all(nxt[0] == one[1] + 1 - overlap for one, nxt in zip(got, got[1:]))
    if len(strengths) <= limit:
        assert len(got) == 1


def test_cuts_go_to_boundaries():
    strengths = [0] * 100
    strengths[47] = 31
    assert [x[:2] for x in splitting.piece_ranges(strengths, 80, 8)] == [(0, 47), (40, 99)]


def _long(name, n):
    return f"    public function {name}()\n    {{\n" + "".join(f"        $a{i} = {i};\n" + ("\n" if i % 9 == 0 else "") for i in range(n)) + "    }\n"


def test_long_methods_by_what_the_file_says(spark):
    body = "<?php\nclass A\n{\n" + _long("big", 90) + _long("small", 10) + "}\nclass B\n{\n" + _long("big", 5) + "}\n"
    files = [(1, ".php", body, 0), (2, ".php", None, 0), (3, ".php", body.replace("\n", "\r\n"), 0), (4, ".php", "<?php\n" + _long("big", 99), 0), (5, ".php", body[: len(body) // 2], 0)]
    m = "method_id long, file_id long, name string, fqn string, line_start int, line_end int, n_lines int"
    rows = [(1, 1, "big", "A::big", 4, 5, 0), (2, 1, "BIG", "\\b::big", 200, 999, 0), (3, 1, "small", "A::small", 110, 300, 0), (4, 3, "big", None, 4, None, 0), (5, None, "big", None, 4, 999, 0), (6, 2, "big", None, 4, 999, 0), (7, 1, "big", "A::big", 4, 5, 0), (8, 5, "big", "A::big", 4, 200, 0)]
    methods_, src = spark.createDataFrame(rows, m), spark.createDataFrame(files, "file_id long, extension string, content string, class_key int")
    assert sorted(r["method_id"] for r in splitting.long_methods(methods_, src).collect()) == [1, 4, 7]
    p = splitting.method_pieces(methods_, src).filter("method_id = 1").orderBy("piece").collect()
    assert p[0]["n_pieces"] == len(p) == 2 and p[0]["strength"] == 31 and p[1]["first_line"] == p[0]["last_line"] - 7
    lines = body.split("\n")
    assert all(x["text"].removesuffix("\n").split("\n") == lines[x["first_line"] - 1 : x["last_line"]] for x in p)
    assert splitting.long_methods(methods_.limit(0), src).count() == 0 and splitting.long_methods(methods_, src.limit(0)).count() == 0


def test_documentation_is_handed_down(spark):
    code = {
        1: "<?php\nnamespace A;\nclass Base { /** Walks the rows once. */ function run() {} /** Never alone. */ function top() {} }", 2: "<?php\nnamespace A;\nclass Mid extends Base { function run() {} function own() {} }",
        3: "<?php\nnamespace A;\nclass Low extends Mid implements I { /** {@inheritDoc} */ function Run() {} function go() {} function own() {} }", 4: "<?php\nnamespace A;\ninterface I { /** Starts when all is ready. */ function go(); }",
        5: "<?php\nnamespace A;\nclass Loop extends Loop { function spin() {} }",
    }
    meth = "array<struct<name: string, line_start: int>>"
    t = dt.datetime(2024, 1, 1)
    rows = [(1, 1, "A\\Base", None, None, None, [("run", 3), ("top", 3)], t, None), (2, 2, "A\\Mid", "A\\Base", [], [], [("run", 3), ("own", 3)], t, None), (3, 3, "\\a\\low", "a\\MID", ["A\\I", None], [], [("run", 3), ("go", 3), ("own", 3), ("absent", 9), (None, 1)], t, None),
            (4, 4, "A\\I", None, None, None, [("go", 3)], t, None), (5, 5, "A\\Loop", "A\\Loop", [], [], [("spin", 3)], t, None), (6, None, "A\\NoFile", None, None, None, [("x", 1)], t, None), (7, 1, "A\\Gone", None, None, None, [("run", 3)], t, t)]
    classes = spark.createDataFrame(rows, f"class_id long, file_id long, fqn string, extends string, implements array<string>, traits array<string>, methods {meth}, parsed_at timestamp, removed_at timestamp")
    src = spark.createDataFrame([(k, ".php", v) for k, v in code.items()], "file_id long, extension string, content string")
    assert sorted(tuple(r) for r in documentation.prose_methods(classes, src).collect()) == [("A\\Base", "run"), ("A\\Base", "top")]
    got = {(r["fqn"], r["method_name"]): (r["description"], r["inherited_from"]) for r in documentation.documented_methods(classes, src).collect()}
    assert got == {("A\\Base", "run"): ("Walks the rows once.", None), ("A\\Base", "top"): ("Never alone.", None), ("A\\Mid", "run"): ("Walks the rows once.", "A\\Base"), ("\\a\\low", "run"): ("Walks the rows once.", "A\\Base"), ("\\a\\low", "go"): ("Starts when all is ready.", "A\\I")}
    assert documentation.documented_methods(classes.limit(0), src).count() == 0


def test_a_later_boundary_within_the_limit_is_taken_before_a_bare_cut():
    strengths = [0] * 140
    strengths[59], strengths[71] = 30, 10
    assert splitting.piece_ranges(strengths, 80, 8) == [(0, 71, 10), (64, 139, 0)]
    far = [0] * 150
    far[39] = far[79] = 5
    assert [x[2] for x in splitting.piece_ranges(far, 80, 8)] == [5, 0]
    three = [0] * 140
    three[39] = three[99] = 5  # no two pieces with a boundary between
    assert splitting.piece_ranges(three, 80, 8) == [(0, 39, 5), (32, 99, 5), (92, 139, 0)]
