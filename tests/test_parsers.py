"""Units, imports and calls."""

import pytest

from strataloom.operators import graph
from strataloom.parsers import ecma, references, units


def short(rows):
    return [(kind, name, first, last) for kind, name, _, first, last in rows]


def test_python_units_with_decorators_nesting_and_unicode():
    source = 'from __future__ import annotations\nimport os, sys as s\n\n@one\n@two("é")\nasync def outer(ü):\n    """é"""\n    def inner(): pass\n    return inner\n\nclass C:\n    @property\n    def m(self): return 1\n'
    found = units.python_units(source)
    assert short(found) == [
        ("import", None, 1, 1), ("import", None, 2, 2), ("function", "outer", 4, 9), ("function", "inner", 8, 8), ("class", "C", 11, 13), ("function", "m", 12, 13),
    ]
    assert found[2][2].startswith('@one\n@two("é")') and found[2][2].endswith("return inner")
    assert found[5][2] == "@property\n    def m(self): return 1"


def test_python_units_keep_crlf_and_fail_whole():
    assert short(units.python_units("def f():\r\n    pass\r\n")) == [("function", "f", 1, 2)]
    with pytest.raises(units.UnparsableFile):
        units.python_units("def ok(): pass\ndef bad(:\n")


def test_ecma_spans_of_exports_and_declarators():
    source = "export const a = () => 1, b = 2;\nexport const c = function () {};\nconst d = () => 1;\nlet e = () => 1, f = function* () {};\nexport default async function g() {}\nexport class H { i() {} static #j() {} ['k']() {} 'l'() {} get m() { return 1 } }\n"
    got = {name: piece for _, name, piece, _, _ in units.ecma_units(source, False, False)}
    assert got["a"] == "a = () => 1"
    assert got["c"].startswith("export const c") and got["d"] == "const d = () => 1;"
    assert got["e"] == "e = () => 1" and got["f"] == "f = function* () {}"
    assert got["g"].startswith("export default async") and got["H"].startswith("export class H")
    assert got["i"] == "i() {}" and "#j" in got and "m" in got and "'l'" not in got and "k" not in got


def test_typescript_ambient_and_overloads_are_no_units():
    source = "declare function a(): void;\ndeclare module 'm' { export function b(): void; }\nfunction c(x: string): void;\nfunction c(x: any) { return x }\nabstract class D { abstract e(): void; f(): number { return 1 } }\n"
    assert [n for _, n, *_ in units.ecma_units(source, True, False)] == ["c", "D", "f"]


VALID = {
    "js": ["a = b ? (c) : d => e", "for (const [k, v] of m) ;", "x = y / 2 / 3; z = /[/]/g", "`a${`b${c}`}`", "class A { static { this.x } #y = 1 }", "({a, b: [c = 1]} = d)", "label: for (;;) break label", "a?.b?.[c]?.(d)", "import.meta.url"],
    "ts": ["let x = <T>y", "type A = { readonly [K in keyof B]?: B[K] }", "function f(this: X, ...a: any[]): asserts a is string {}", "let t: [a: string, b?: number] = c as const", "enum E { A = 1 }", "f<string>(a); g < h > (i)", "abstract class A<T> extends B<T> implements C { private x!: number }"],
    "jsx": ["x = <a b='c' {...d}>Don't {e}<f.g/></a>", "y = <></>"],
}
INVALID = {
    "js": ["a b", "(a => b", "({a = 1})", "let x: number", "'abc", "if (a", "class { }", "a ?? b || c", "return 1", "x = <a/>", "@@ -1 +1 @@", "<<<<<<< HEAD", "1 = 2", "import a from b"],
    "ts": ["interface A { a: }", "type X =", "x = <div>a</div>", "enum E { A B }", "function f(a: string {}"],
    "jsx": ["x = <a></b>", "x = <a>", "x = <a b=c/>"],
}
OPTIONS = {"js": {}, "ts": {"types": True}, "jsx": {"jsx": True}}


@pytest.mark.parametrize(("kind", "code"), [(k, c) for k, cs in VALID.items() for c in cs])
def test_valid_code(kind, code):
    ecma.parse(code, **OPTIONS[kind])


@pytest.mark.parametrize(("kind", "code"), [(k, c) for k, cs in INVALID.items() for c in cs])
def test_invalid_code(kind, code):
    with pytest.raises(ecma.SyntaxFault):
        ecma.parse(code, **OPTIONS[kind])


def test_parser_time_does_not_explode():
    for text in ("(a = " * 40 + "1" + ")" * 40, "[" * 60, "f(" * 60, "a?(" * 40 + "b" + "):c" * 40):
        ecma.is_valid(text)
        ecma.is_valid(text, types=True)


def resolved(spark, refs, paths):
    r = spark.createDataFrame([("r", *x) for x in refs], "repository_id string, source_path string, language string, module string")
    f = spark.createDataFrame([("r", p) for p in paths], "repository_id string, path string")
    return {(x.source_path, x.module): x.target_path for x in graph.resolve_modules(r, f).collect()}


def test_python_imports(spark):
    paths = ["a.py", "pkg/__init__.py", "pkg/m.py", "pkg/sub/__init__.py", "pkg/sub/n.py", "bare/x.py", "both.py", "both/__init__.py", "json.py", "pkg/o.py"]
    refs = [("a.py", "python", m) for m in ("pkg", "pkg.m", "pkg.sub.n", "bare.x", "both", "json", "missing", "pkg.m.x")]
    refs += [("pkg/m.py", "python", m) for m in (".", ".o", ".sub.n", "..x", "...y")] + [("bare/x.py", "python", ".y"), ("pkg/sub/n.py", "python", "..m")]
    got = resolved(spark, refs, paths)
    assert got == {
        ("a.py", "pkg"): "pkg/__init__.py", ("a.py", "pkg.m"): "pkg/m.py", ("a.py", "pkg.sub.n"): "pkg/sub/n.py",
        ("pkg/m.py", "."): "pkg/__init__.py", ("pkg/m.py", ".o"): "pkg/o.py", ("pkg/m.py", ".sub.n"): "pkg/sub/n.py", ("pkg/sub/n.py", "..m"): "pkg/m.py",
    }


def test_ecma_imports(spark):
    paths = ["src/a.js", "src/b.js", "src/c.ts", "src/c.jsx", "src/d/index.ts", "src/e.json", "root.js", "index.js"]
    mods = ["./b", "./b.js", "./c", "./c.ts", "./d", "./d/", "./e.json", "../root", "../../root", "b", "./b?x", "../", "./missing"]
    got = resolved(spark, [("src/a.js", "javascript", m) for m in mods], paths)
    assert got == {
        ("src/a.js", "./b"): "src/b.js", ("src/a.js", "./b.js"): "src/b.js", ("src/a.js", "./c.ts"): "src/c.ts", ("src/a.js", "./d"): "src/d/index.ts",
        ("src/a.js", "./d/"): "src/d/index.ts", ("src/a.js", "../root"): "root.js", ("src/a.js", "../"): "index.js",
    }


def test_import_modules_of_units(spark):
    rows = [("python", "import a.b as c, d"), ("python", "from ..m import (x,\n y)"), ("python", "from . import z"), ("javascript", "import a, {b} from './c';"), ("javascript", 'import "side"'), ("typescript", "import x from 'a\\n'")]
    df = spark.createDataFrame([("r", "p", k, "import", c) for k, c in rows], "repository_id string, path string, language string, kind string, content string")
    assert sorted(r.module for r in references.import_modules(df).collect()) == sorted(["a.b", "d", "..m", ".", "./c", "side"])


CASES = {
    "plain": ("def g(): pass\ndef f(): g()\n", [("f", "g", None)]),
    "recursion": ("def f(): f()\n", [("f", "f", None)]),
    "module": ("import m\ndef f(): m.g()\n", [("f", "m", "g")]),
    "alias": ("from m import a as b\ndef f(): b()\n", [("f", "b", None)]),
    "parameter shadows": ("def g(): pass\ndef f(g): g()\n", []),
    "assignment shadows": ("def g(): pass\ndef f():\n    g()\n    g = 1\n", []),
    "rebound at the top": ("def g(): pass\ng = 1\ndef f(): g()\n", []),
    "defined twice": ("def g(): pass\ndef g(): pass\ndef f(): g()\n", []),
    "comprehension": ("def g(): pass\ndef f(): return [g() for x in y]\n", []),
    "with": ("def g(): pass\ndef f():\n    with x: g()\n", []),
    "global": ("def g(): pass\ndef h():\n    global g\ndef f(): g()\n", []),
    "walrus default": ("def g(): pass\ndef f(a=(g := 1)): g()\n", []),
    "wildcard": ("from m import *\ndef g(): pass\ndef f(): g()\n", []),
    "nested scope": ("def g(): pass\ndef f():\n    def h(): g()\n", []),
    "syntax error": ("def g(): pass\ndef f(: g()\n", []),
    "attribute set": ("import m\nm.x = 1\ndef f(): m.g()\n", []),
    "caught": ("def g(): pass\ndef f():\n    try: g()\n    except E as g: pass\n", []),
}


@pytest.mark.parametrize("name", CASES)
def test_call_hints(name):
    source, want = CASES[name]
    known = {"g", "f", "m", "b"}
    assert [(c[0], c[3], c[4]) for c in references.analyse_python(source)[2] if c[3] in known] == want


def test_call_edges_across_files(spark):
    files = {"pkg/__init__.py": "", "pkg/a.py": "def g():\n    pass\n", "pkg/b.py": "from .a import g\nfrom . import a\ndef f():\n    g()\n    a.g()\n    f()\n"}
    df = spark.createDataFrame([(p, "r", p, c, "python") for p, c in files.items()], "file_id string, repository_id string, path string, content string, language string")
    stored = units.parse_files(df).selectExpr("concat(path, ':', symbol_name) as code_unit_id", "file_id", "kind", "symbol_name", "start_line", "end_line")
    analysis = references.analyse_calls(df)
    ends = references.endpoints_with_units(analysis, stored)
    edges = graph.resolve_calls(references.call_rows(analysis, ends), references.binding_rows(analysis), ends, df)
    assert {(r.source_unit_id, r.target_unit_id) for r in edges.collect()} == {("pkg/b.py:f", "pkg/a.py:g"), ("pkg/b.py:f", "pkg/b.py:f")}


ECMA_CASES = {
    "plain": ("function g() {}\nfunction f() { g() }\n", [("f", "g", None)]),
    "const arrow and member": ("import * as m from './m';\nexport const f = () => m.g();\n", [("f", "m", "g")]),
    "alias": ("import { a as b } from './m';\nconst f = function () { return b(1) };\n", [("f", "b", None)]),
    "recursion": ("export default function f() { f() }\n", [("f", "f", None)]),
    "parameter shadows": ("function g() {}\nfunction f({ a: [g] }) { g() }\n", []),
    "declaration shadows": ("function g() {}\nfunction f() { g(); const g = 1 }\n", []),
    "assigned in a closure": ("function g() {}\nfunction f() { g() }\nfunction h() { () => { g = 1 } }\n", []),
    "member set": ("import * as m from './m';\nm.x = 1;\nfunction f() { m.g() }\n", []),
    "twice": ("function g() {}\nfunction g() {}\nfunction f() { g() }\n", []),
    "let": ("let g = () => 1;\nfunction f() { g() }\n", []),
    "inner scope": ("function g() {}\nfunction f() { [].map(() => g()) }\n", []),
    "arguments": ("function f() { arguments(); this.g(); new g() }\n", []),
    "chain": ("import m from './m';\nfunction f() { m.g.h(); m[g](); m.b() }\n", [("f", "m", "b")]),
    "updated": ("function g() {}\ng++;\nfunction f() { g() }\n", []),
    "class": ("class g {}\nfunction f() { g() }\n", []),
    "syntax error": ("function g() {}\nfunction f( { g() }\n", []),
}


@pytest.mark.parametrize("name", ECMA_CASES)
def test_ecma_call_hints(name):
    source, want = ECMA_CASES[name]
    assert [(c[0], c[3], c[4]) for c in references.analyse_ecma(source, False, False)[2]] == want


def test_typescript_type_imports_bind_nothing_callable():
    source = "import { type g, h } from './m';\nfunction f(x: g): void { g(); h() }\n"
    assert [c[3] for c in references.analyse_ecma(source, True, False)[2]] == ["h"]


def test_ecma_call_edges_across_files(spark):
    files = {"a.ts": "export function g(): void {}\nexport default () => 1;\nexport const k = () => 2;\n", "b.js": "import d, { g, k as kk } from './a';\nimport * as n from './a';\nfunction f() { g(); kk(); n.g(); d(); f() }\n"}
    df = spark.createDataFrame([(p, "r", p, c, "typescript" if p.endswith("ts") else "javascript") for p, c in files.items()], "file_id string, repository_id string, path string, content string, language string")
    stored = units.parse_files(df).selectExpr("concat(path, ':', symbol_name) as code_unit_id", "file_id", "kind", "symbol_name", "start_line", "end_line")
    analysis = references.analyse_calls(df)
    ends = references.endpoints_with_units(analysis, stored)
    edges = graph.resolve_calls(references.call_rows(analysis, ends), references.binding_rows(analysis), ends, df)
    assert {(r.source_unit_id, r.target_unit_id) for r in edges.collect()} == {("b.js:f", "a.ts:g"), ("b.js:f", "a.ts:k"), ("b.js:f", "b.js:f")}
