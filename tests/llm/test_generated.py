import pytest

from codeweft.llm import generated

LIB = "<?php\n{head}\nnamespace Tinlib\\Io;\n\nclass Pool\n{{\n" + "".join(f"    public function step{i}($a) {{{{ return $a + {i}; }}}}\n" for i in range(12)) + "}}\n"
OWN = "<?php\nnamespace App{n};\n\nclass Thing{n}\n{{\n    public function go{n}() {{ return 'a quite ordinary method of the house {n}'; }}\n}}\n"


@pytest.mark.parametrize(
    "ext,text,why",
    [
        (".js", "function a(b,c){return b?c:1}" * 40, "minified"), (".js", "export const icon = 'M" + "1.5 2.5L" * 200 + "';\n" + "function draw(a) {\n    return a + 1;\n}\n" * 60, None), (".php", "<?php return array (\n  'a' => \n  array (\n    0 => 1,\n  ),\n);", "cache"),
        (".php", "<?php return array(\n    'a' => 1,\n);", None), (".php", "<?php\nreturn [\n" + "    [1.25, -3.5, 88.125, 4.75],\n" * 60 + "];\n", "data"), (".php", "<?php\nclass F { const D = '" + "aGVsbG8gd29ybGQx" * 80 + "'; }\n", "data"),
        (".json", '{"version": 3, "sources": ["a"], "names": [], "mappings": "AAAA"}', "source map"), (".json", '{"content-hash": "x", "packages": []}', "lock file"), (".json", '{"name": "x", "packages": {}}', None), (".php", "", None), (".php", "<?php $__v->open(); ?><b>x</b>", "compiled template"),
        (".php", "<?php\nnamespace A {\n/**\n" + " * @method static \\A\\B|null find($x)\n" * 8 + " */\nclass B {}\n}\n", "stubs"),
    ],
)
def test_layouts(ext, text, why):
    assert generated.layout(ext, text) == why


@pytest.mark.parametrize(
    "text,marked",
    [
        ("<?php\n// This file is auto-generated. Do not edit.\nclass A {}", True), ("<?php\nclass A { function f() { return '}'; } }\n// Code generated from the schema; DO NOT EDIT.\n", True), ("<?php\nclass A { const H = <<<T\n  // @generated by x\n  T; }", False),
        ("<?php\nclass A { /* @generated rows are skipped */ }", False), ("<?php\n// Reports are generated nightly. Do not edit totals by hand.\nclass A {}", False), ("<?php\n$x = '// @generated';", False), ("<?php\n# Erzeugt vom Baukasten\n", True),
    ],
)
def test_markers_count_in_comments_outside_code(text, marked):
    assert generated._marked(text) == marked


def test_vendored_copies_and_paths(spark):
    rows = [
        (1, "r1", "vendor/tinlib/core/Pool.php", ".php", LIB.format(head="")), (2, "r2", "app/Support/Pool.php", ".php", LIB.format(head="/** Tinlib 2.1 copied */").replace("\n", "\r\n")), (3, "r3", "app/Other.php", ".php", LIB.format(head="").replace("step1(", "stride(").replace("class Pool", "class Pond")),
        (4, "r1", "app/A.php", ".php", OWN.format(n=1)), (5, "r2", "app/B.php", ".php", OWN.format(n=2)), (6, "r3", "app/C.php", ".php", OWN.format(n=3)), (7, "r1", "app/empty.php", ".php", "<?php\n"), (8, "r2", "app/empty.php", ".php", "<?php\n"),
        (9, "r1", "composer.lock", ".lock", None), (10, "r1", None, ".php", "<?php\nclass X {}"), (11, None, "app/D.php", None, "x"), (12, "r3", "app/Vendor/Mine.php", ".php", OWN.format(n=4)), (13, "r2", "node_modules/wheel/index.js", ".js", "export const a = 1;\n"), (14, "r3", "resources/js/wheel.js", ".js", "export const b = 2;\n"),
        (15, "r3", "app/E.php", ".php", OWN.format(n=3).replace("Thing", "Other")), (16, "r3", "app/F.php", ".php", OWN.format(n=3).replace("Thing", "Third")),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "file_id long, repo string, path string, extension string, content string, reason string")
    got = {r["file_id"]: r["reason"] for r in generated.file_origins(df).collect()}
    assert got[1] == "tool directory" and got[2] == "copy in other repositories" and got[3] == "name of a library" and got[9] == "tool file name" and got[13] == "tool directory" and got[14] == "name of a library"
    assert {k for k, v in got.items() if v is None} == {4, 5, 6, 7, 8, 10, 11, 12, 15, 16}
    assert sorted(r["file_id"] for r in generated.hand_written_files(df).collect()) == [4, 5, 6, 7, 8, 10, 11, 12, 15, 16]
    assert generated.file_origins(df.limit(0)).count() == 0


def test_equal_trees_have_equal_hashes(spark):
    rows = [("a", "x/p/1.php", "h1", 9), ("a", "x/p/2.php", "h2", 9), ("a", "x/q/3.php", "h3", 9), ("b", "deep/y/p/2.php", "h2", 9), ("b", "deep/y/p/1.php", "h1", 9), ("b", "deep/y/q/3.php", "h3", 9), ("c", "x/p/1.php", "h1", 9), ("c", "x/q/2.php", "h2", 9), ("c", "x/q/3.php", "h3", 9)]
    t = {(r["repo"], r["dir"]): (r["hash"], r["n_files"]) for r in generated.merkle_tree(spark.createDataFrame(rows, "repo string, path string, leaf string, n_chars long")).collect()}
    assert t["a", "x"] == t["b", "deep/y"] and t["a", "x/p"] == t["b", "deep/y/p"] and t["a", "x"][0] != t["c", "x"][0] and t["b", "deep"][1] == 3


def test_comments_are_taken_off_by_the_rules_of_each_language():
    assert generated.bare(".js", "class A { #n = 1; run() { f('//x', \"/*y*/\", `z//`); } } // end\n/* a */") == "classA{#n=1;run(){f('//x',\"/*y*/\",`z//`);}}"
    assert generated.bare(".js", "class A { #n = 1; run() {} }") != generated.bare(".js", "class A { #n = 999; go() { evil(); } }")
    assert generated.bare(".php", "<?php # a\n$x = 'http://y#z'; #[Attr]\n/* b */ $y = <<<T\n// kept\nT;\n") == "<?php$x='http://y#z';#[Attr]$y=<<<T//keptT;"
    assert generated.bare(".blade.php", "{{-- a --}}<p> <!-- b -->x</p>") == "<p>x</p>" and generated.bare(".json", '{"a": "//b"}') == '{"a":"//b"}'


def test_names_are_part_of_a_tree_and_banners_of_any_length_count(spark):
    t = {r["repo"]: r["hash"] for r in generated.merkle_tree(spark.createDataFrame([("a", "p/1.php", "h1", 9), ("b", "p/2.php", "h1", 9), ("c", "p/1.php", "h1", 9)], "repo string, path string, leaf string, n_chars long")).collect()}
    assert t["a"] == t["c"] != t["b"]
    assert generated._banner("<?php\n/*! " + "x " * 2000 + "v1.2.3 released under the MIT licence */") and not generated._banner("<?php\n/* a */ $v = '1.2.3 released under'; /* b */")
    assert generated.layout(".json", '{"mappings": "' + "A" * 900 + '", "sources": [], "version": 3}') == "source map"
