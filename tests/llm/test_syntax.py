import pytest

from codeweft.llm import blade_syntax, js_syntax, php_syntax, syntax

GOOD_PHP = [
    "<?php\n", "<?php echo 1 ?>", "text <?= $x ?> more", "<?php if ($a): ?>x<?php elseif ($b): ?>y<?php else: ?>z<?php endif; ?>",
    "<?php $x = $a ? $b : ($c ?: $d); $y = $a ?? $b ?? 1; $z = !$a instanceof B;", "<?php abstract class A extends B implements C, D { use E, F { E::x insteadof F; F::x as protected y; } const int X = 1, Y = 2; public function __construct(private readonly ?int $a = 1, public A|B $b) {} abstract protected static function f(int ...$x): static; }",
    "<?php enum S: string implements T { case A = 'a'; const B = self::A; public static function f(): self { return self::A; } }", "<?php $f = static fn (int &$x, ...$y): ?int => $x + 1; $g = function () use (&$f): void {};",
    "<?php match (true) { $a, $b => 1, default => throw new E() };", "<?php foreach ($a as $k => [$b, 'x' => $c]) { continue; } for (;;) { break 2; }", "<?php try { f(); } catch (A | B) { } finally { }",
    "<?php $s = <<<'X'\n  } ' \" {\n  X; $t = \"a {$b['c'][\"d\"]} $e[0] \\\" {\";", "<?php #[Attr(1, x: 2)]\nfunction &f(#[P] $x = [1, 2,]) { yield $k => $v; return yield from g(); }", "<?php namespace A\\B; use C\\{D, E as F}; use function G\\h; goto end; end: echo `ls`;",
    "<?php $x = new class(1) extends Y { public $z { get => 1; set { $this->a = $value; } } }; $x?->y()::z[1]->{'a' . 1} = 2; [$a, , $b] = list($c) = $d; $e = strlen(...); static $n = 0; list('a' => $q) = $r;",
    "<?php declare(strict_types=1); switch ($x) { case 1: case 2; f(); default: } while ($a): endwhile; do { } while (0);", "<?php /* } */ // { ?>\n<?php # don't\n$x = 'it\\'s';\n// end", "<?php interface I { public const A = 1; public function class(): array; } echo I::class, $a::$b, A::{$c}();",
    "<?php $a = &$b; $c = &new_f(); $x = -$y ** 2; print $z and f(); isset($a['b'], $c) || exit; return;", "<?php readonly class P { final public const X = 1; } function f(): int|(A&B)|null {}", "#!/usr/bin/php\n<?php echo 1;", "<?php\nreturn array (\n  0 => \n  array (\n  ),\n);",
]
BAD_PHP = [
    "no tag", "", "<?php class A { public function f() { }", "<?php f(;", "<?php $a = [1, 2;", "<?php if ($a) { } }", "<?php $a = 1 $b = 2;", "<?php function f( { }", "<?php 'open", "<?php class A { f() {} }", "<?php $a = ;", "<?php $a == $b == $c;",
    "<?php $a ? 1 : 2 ? 3 : 4;", "<?php 1 = $a;", "<?php f() = 1;", "<?php foreach ($a in $b) {}", "<?php try { }", "<?php class { }", "<?php echo 1 echo 2;", "<?php /* open", "<?php $x = <<<A\n text", "<?php def f(x): return x", "<?php function f(a, b) { return a; }",
    "<?php if ($a): echo 1;", "<?php match ($a) { 1 2 };", "<?php\n<<<<<<< HEAD\n$a = 1;\n=======\n$a = 2;\n>>>>>>> b\n", "<?php while (true { }", "<?php $x = fn ($y) { return 1; };", "<?php use A\\B function;", "<?php $a->;",
]
GOOD_JS = [
    "", "const a = 1, { b, ...c } = d, [e = 2, , f] = g;", "import x, { y as z, default as w } from './m'; import * as q from 'q'; import 'side'; export { x as default }; export * from 'r';", "export default class A extends B { #p = 1; static x; get y() { return this.#p } async *[z]() { yield* f() } static { g() } }",
    "const f = async (a, { b }, ...c) => ({ a, b: 1, [c]: 2, d() {}, get e() { return 1 } });", "for (const [k, v] of m) { continue } for (let i = 0, n = a.length; i < n; i++); for (x in y) {}", "if (a) b(); else if (c) { d() } else e()", "a = b / c / d; r = /[/}'\"]+$/g.test(s); x = y ? /a/ : `t ${ `n ${1}` } {`;",
    "label: while (1) { break label } do x(); while (0) switch (a) { case 1: default: f() }", "let async = 1; async = async + of; var get, set, from", "a\n++b\nreturnValue\n(function () {})()", "await f(); x?.y?.[0]?.(1) ?? z; a ||= b; c **= 2; new A; new B.C(1).d; new.x" if False else "await f(); x?.y?.[0]?.(1) ?? z; a ||= b; c **= 2; new A; new B.C(1).d;",
    "try { f() } catch { g() } finally { h() }", "function h0(n,t){return t.w?n.map(function(e){return e.w*15}):\"x\"===t?4:null}var h={z:!0,q:694e3};", "tag`a${b}c`; x = a => b => c; y = function* () {}; (a, b); typeof a === 'u' && void 0", "if (x) /re/.test(y);", "const a = { 'b-c': 1, 2: 3, async d() {}, async: 1, get: 2 };",
]
BAD_JS = [
    "function f() {", "a = [1, 2;", "const a;", "f(;", "let x = 'open", "x = `open", "if (a { }", "return }", "a b", "<?php echo 1;", "<!DOCTYPE html>", "{ a: 1, b: 2 }", "var = 1", "class A { x( }", "1 = a", "import { a from 'b'", "function (a) {}", "for (let i = 0; i < 1 { }", "x = { a 1 }", "a => ",
    "with (a) {}", "/* open", "f() = 1; g()", "const x = 1;\n<<<<<<< HEAD\nconst y = 2;\n", "def f(x):\n    return x", "try {}", "let re = /[/; x",
]
GOOD_BLADE = [
    "", "plain <b>text</b> a@b.c", "@extends('a')\n@section('t', 'x')\n@section('c')\n@if ($a === ')')\n{{ $b ?? 'c' }}{!! d($e) !!}\n@elseif ($f) @else @endif\n@foreach ($a as $b => $c) @continue($b) @endforeach\n@forelse ($a as $b) @empty @endforelse\n@endsection",
    "{{-- @if ( {{ --}}", "@verbatim {{ x @if @endverbatim", "@@if @{{ raw }} mail@@x.y", "@php($a = 1) @php $b = [1]; @endphp", "@can('u', $p) @endcan @switch($a) @case(1) @break @default @endswitch", "@empty($a) x @endempty @isset($a) @endisset @unless ($x) @endunless",
    "@push('s')<script>if (a) { b }</script>@endpush @include('x', ['a' => [1, ')']]) <x-a :b=\"$c\" />", "@for ($i = 0; $i < 3; $i++) @endfor @while (true) @endwhile", "<?php echo 1 ?> @media (x) {} @import 'y'", "@section('a') x @show @yield('b', 'c')",
]
BAD_BLADE = [
    "@if ($a) x", "@endif", "@if ($a) @endforeach", "{{ $a", "{{ $a }", "{{ $a-> }}", "@foreach ($a) @endforeach", "@if ($a", "@section('a')", "{{-- open", "@verbatim x", "@php $a = ; @endphp", "@else", "@foreech ($a as $b) @endforeach", "@if () @endif" if False else "@if @endif", "<?php if ( ?>",
    "@include('a' 'b')", "@section('c')\n<<<<<<< HEAD\na\n=======\nb\n>>>>>>> x\n@endsection", "@forelse ($a as $b) @endforeach",
]


@pytest.mark.parametrize("text", GOOD_PHP)
def test_php_that_parses(text):
    assert php_syntax.errors(text) == []


@pytest.mark.parametrize("text", BAD_PHP)
def test_php_that_does_not(text):
    assert syntax.check("php", text)


@pytest.mark.parametrize("text", GOOD_JS)
def test_modules_that_parse(text):
    assert js_syntax.errors(text) == []


@pytest.mark.parametrize("text", BAD_JS)
def test_modules_that_do_not(text):
    assert syntax.check("js", text)


@pytest.mark.parametrize("text", GOOD_BLADE)
def test_templates_that_parse(text):
    assert blade_syntax.errors(text) == []


@pytest.mark.parametrize("text", BAD_BLADE)
def test_templates_that_do_not(text):
    assert syntax.check("blade", text)


@pytest.mark.parametrize("text,ok", [('{"a": [1, 2.5e3, null, "\\u00e4"]}', True), ("[1,]", False), ("", False), ("{'a': 1}", False), ("NaN", False), ('{"a": 1} // x', False), ("<?php", False), ('"x', False), ("﻿[]", True)])
def test_json(text, ok):
    assert (syntax.check("json", text) == []) == ok


def test_json_in_a_script_is_of_another_language():
    assert syntax.check("js", '[{"a": 1}]') and not syntax.check("js", "[1].map(f)")


def test_recovery_keeps_all_errors_and_their_places():
    text = "<?php\n$a = ;\n$b = 1;\n$c = [;\n$d = 2;\n"
    found = php_syntax.errors(text)
    assert [text.count("\n", 0, at) + 1 for at, _ in found] == [2, 4]


def test_remembered_statements_do_not_hide_errors():
    good = "<?php class A { function f() { $x = g(1); } }"
    assert php_syntax.errors(good) == []
    assert php_syntax.errors("<?php $x = g(1); $x = g(1; ")
    assert php_syntax.errors(good) == []


def test_conflicts_inside_texts_are_none():
    assert not syntax.check("php", "<?php $x = <<<T\n    <<<<<<< ours\n    =======\n    >>>>>>> theirs\n    T;\n")


def test_deep_nesting_does_not_crash():
    syntax.check("php", "<?php $a = " + "[" * 5000 + "]" * 5000 + ";")
    syntax.check("js", "(" * 5000)
    syntax.check("json", "[" * 100_000)


def test_operator_over_a_table(spark):
    rows = [(1, "r", ".php", "<?php", "x"), (2, "r", ".PHP", "<?php }", "x"), (3, "r", ".php", None, "x"), (4, None, ".js", "a b", "x"), (5, "r", ".lock", "{", "x"), (6, "r", ".json", "", "x"), (2, "r", ".php", "<?php }", "x")]
    df = spark.createDataFrame(rows, "file_id long, repo string, extension string, content string, errors string")
    assert sorted(r["file_id"] for r in syntax.broken_files(df).collect()) == [2, 2, 4, 6]
    first = {r["file_id"]: r["first_error"] for r in syntax.file_errors(df).collect()}
    assert first[1] is None and first[2].startswith("line 1:")
    rates = {(r["repo"], r["language"]): (r["n_files"], r["n_broken"], r["rate"]) for r in syntax.error_rates(df).collect()}
    assert rates[("r", "php")] == (3, 2, 0.666667) and rates[(None, "js")] == (1, 1, 1.0)
    assert syntax.file_errors(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [100, 400, 10_000])
def test_open_brackets_are_flagged_at_any_depth_and_closed_ones_are_not(n):
    for language, head, opened, closed, tail in (("php", "<?php $a = ", "(", ")", ";"), ("php", "<?php $a = ", "[", "]", ";"), ("js", "a = ", "(", ")", ";"), ("js", "a = ", "[", "]", ";"), ("json", "", "[", "]", "")):
        assert syntax.check(language, head + opened * n + "1" + tail)
        assert syntax.check(language, head + opened * n + "1" + closed * n + tail) == []


def test_json_goes_on_after_an_error():
    assert len(syntax.check("json", '{"a":1,, "b":2,, }')) == 2
    assert len(syntax.check("json", "[1 2, 3 4]")) == 2
    assert [w for _, w in syntax.check("json", '{"a" 1, b: 2}')] == ["expected :", "a stray character"]
    for bad in ("", " ", "{", "[1,]", '{"a":1,}', "01", "1.", "NaN", '"\t"', '"\\x"', "[1}", "1 2", "]", "'a'", "tru", '{"a":}', "﻿", "//c\n1"):
        assert syntax.check("json", bad), bad
    for good in ("1", " null ", '﻿{"a": [1, -2.5e+3, "x\\u00e9\\n", {}], "": []}', "[]", '"a"'):
        assert syntax.check("json", good) == [], good


def test_half_a_merge_is_flagged_in_templates():
    assert syntax.check("blade", "<p>a</p>\n<<<<<<< branch\n<p>b</p>\n")
    assert syntax.check("blade", "<p>a</p>\r\n>>>>>>> main\r\n")
    assert syntax.check("blade", "<p>a</p>\n=======\n") == []
    assert syntax.check("blade", "<p>a <<<<<<< b</p>\n") == []
