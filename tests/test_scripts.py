"""Facts of scripts against tables written by hand, and masks of other languages."""

import pytest

from sylvagraph.parsing.facts import pattern_facts, script_facts
from sylvagraph.parsing.lexer import masked, tokens

I, E, X, V, C = "imports", "entities", "exports", "variables", "calls"


def classes(*names):
    return [("class", n) for n in names]


def functions(*names):
    return [("function", n) for n in names]


def imports(*pairs):
    return [{"path": p, "imported_entities": list(n)} for p, n in pairs]


#: A source, and what is in it of each kind; kinds that aren't named are empty.
CASES = [
    ("import a, { b as c, type D } from './m'; import * as ns from \"n\"; import 'side';", {I: imports(("./m", ["default", "b", "D"]), ("n", ["*"]), ("side", [])), V: ["a"]}),
    ("import type { T } from 't'; import type U from 'u'; import { v } from 't';", {I: imports(("t", ["T", "v"]), ("u", ["default"])), V: ["U"]}),
    ("import fs = require('fs'); export import p = require('path');", {I: imports(("fs", ["fs"]), ("path", ["p"]))}),
    ("export { a as b, c } from './x'; export * from './y'; export * as z from './z';", {I: imports(("./x", ["a", "c"]), ("./y", ["*"]), ("./z", ["*"])), X: [("b", "a", False), ("c", "c", False)]}),
    ("const a = 1; export { a, a as default, type T };", {V: ["a"], X: [("a", "a", False), ("default", "a", False), ("T", "T", False)]}),
    ("export default function main() {}", {E: functions("main"), X: [("main", "main", True), ("default", "main", True)]}),
    ("export default class { run() {} }", {E: functions("run")}),
    ("const x = 1\nexport default x\nfoo()", {V: ["x"], X: [("default", "x", True)], C: ["foo"]}),
    ("export default { data() { return call(1) } }", {E: functions("data"), X: [("default", None, True)], C: ["call"]}),
    ("export = Thing;", {X: [("default", "Thing", True)]}),
    ("export const f = async (a: number): Promise<void> => { g(a) }, h = x => x, k = 3;", {E: functions("f", "h"), V: ["f", "h", "k"], X: [("f", "f", False), ("h", "h", False), ("k", "k", False)], C: ["g"]}),
    ("let a: Map<string, number> = new Map<string, Foo>(), b = function () { return c() };", {E: functions("b"), V: ["a", "b"], C: ["c"]}),
    ("const { a, b: { c } } = load(), [d] = e;", {V: ["{ a, b: { c } }", "[d]"], C: ["load"]}),
    ("for (const x of list()) { use(x) }\nfor (let i = 0; i < n; i++) step(i)", {V: ["x", "i"], C: ["list", "use", "step"]}),
    ("try { a() } catch (err) { b(err) } finally { c() }", {V: ["err"], C: ["a", "b", "c"]}),
    ("class A extends mix(B) implements C { x = 1; static y: string; #z = f(); constructor(private q: number) { super(); this.go() } go() {} get v() { return 1 } set v(n) {} static async *gen() {} }",
     {E: classes("A") + functions("go", "v", "gen"), V: ["x", "y", "#z"], C: ["mix", "f", "go"]}),
    ("abstract class A { abstract run(): void\n  protected name?: string\n  private items: Array<() => void> = []\n  handler = (e: Event) => { this.fire(e) }\n  [key]() {}\n  [k: string]: any\n}",
     {E: classes("A") + functions("run", "[key]"), V: ["name", "items", "handler"], C: ["fire"]}),
    ("@Component({ selector: make() })\nexport class W { @Input() size: number; @Output('x') out = new Emitter(); }", {E: classes("W"), X: [("W", "W", False)], V: ["size", "out"], C: ["Component", "make", "Input", "Output"]}),
    ("interface P { a: string; run(x: number): void; readonly b?: () => void\n  stop?(): void\n new (x: string): P }", {E: classes("P") + functions("run", "stop")}),
    ("export interface Q<T> extends R<T> { [k: string]: T }\nexport type Z = { m(): void } | string; type Y<T> = T[];", {E: classes("Q", "Z") + functions("m") + classes("Y"), X: [("Q", "Q", False), ("Z", "Z", False)]}),
    ("export enum Color { Red = 1, Green = calc() }\nconst enum Q { A }\ndeclare enum R { B }", {E: classes("Color", "Q", "R"), X: [("Color", "Color", False)], C: ["calc"]}),
    ("declare function d(a: string): void;\nexport declare const v: number;\nexport async function* g() {}", {E: functions("d", "g"), V: ["v"], X: [("v", "v", False), ("g", "g", False)]}),
    ("namespace N.M { export function inner() {} }\ndeclare module 'x' { function deep(): void }", {E: functions("inner", "deep"), X: [("inner", "inner", False)]}),
    ("const o = { a() {}, get b() { return 1 }, async c() {}, *d() {}, 'e-f'() {}, g: function () {}, h: () => i(), ...rest(), [k]: 1, j }", {E: functions("a", "b", "c", "d", "e-f"), V: ["o"], C: ["i", "rest"]}),
    ("a.b.c(1); a?.d(); e?.(); f['g'](); h[i + 1](); (0, j)(); k()(); new L(); new m.N(); new (o())();", {C: ["c", "d", "e", "'g'", "i + 1", "k", "o"]}),
    ("const x = await import('./lazy'); const y = require('./sync'), z = require(name); type T = import('./types').T; let w: typeof import('./q');",
     {I: imports(("./lazy", ["*"]), ("./sync", []), ("./types", ["type"]), ("./q", ["type"])), E: classes("T"), V: ["x", "y", "z", "w"], C: ["require"]}),
    ("const s = `a ${f(`b ${g({ k: `}` })} c`)} d`; after()", {V: ["s"], C: ["f", "g", "after"]}),
    ("const t = `${ (() => { const inner = `x${1}`; return h(inner) })() }`", {V: ["t", "inner"], C: ["h"]}),
    ("// import x from 'no'\n/* function no() {} */ const s = \"class No { a() {} }\"; const r = /function no\\(\\) {}['\"`]/g; yes()", {V: ["s", "r"], C: ["yes"]}),
    ("const q = a / b / c(); if (x) /re'g/.test(y); const z = x++ / 2; return_(/[/'\"]/)", {V: ["q", "z"], C: ["c", "test", "return_"]}),
    ("switch (v) { case 'a': { one(); break } case f(2): two(); default: { three() } }", {C: ["one", "f", "two", "three"]}),
    ("const c = cond ? { a() {} } : d(), e = cond ? import('x') : null", {E: functions("a"), V: ["c", "e"], C: ["d"], I: imports(("x", ["*"]))}),
    ("const v = <T,>(a: T) => a; const w = <T extends U>(a: T): a is V => use(a); cast(x as Y, <Z>z, q!)", {E: functions("v", "w"), V: ["v", "w"], C: ["use", "cast"]}),
    ("outer: for (;;) { if (a) continue outer; else do { go() } while (b()) }", {C: ["go", "b"]}),
    ("function over(a: string): void\nfunction over(a: number): void\nfunction over(a: any) { return typeof (a) }", {E: functions("over")}),
    ("export const enum K { A }\nexport abstract class B {}\nexport default abstract class D {}", {E: classes("K", "B", "D"), X: [("K", "K", False), ("B", "B", False), ("D", "D", True), ("default", "D", True)]}),
    ("const fn = function named() { inner() }\nconst k = class Hidden { m() {} }\n(function iife() {})()", {E: functions("fn", "m"), V: ["fn", "k"], C: ["inner"]}),
    ("const a = b\n  .map(x => x.y())\n  .filter(Boolean)\nconst c = 1\nlet d\nvar e = f\n(g)", {V: ["a", "c", "d", "e"], C: ["map", "y", "filter", "f"]}),
    ("export function A<T>({ a = f(), b }: P, cb: (x: number) => void): Map<string, () => T> { return g<T>(a) }", {E: functions("A"), X: [("A", "A", False)], C: ["f", "g"]}),
    ("class Empty {}\nclass S { static { init() } declare x: number; override async y?(): Promise<void> { await z() } static get = 1; async = 2; get() {} }", {E: classes("Empty", "S") + functions("y", "get"), V: ["x", "get", "async"], C: ["init", "z"]}),
]

#: The same with markup.
MARKUP = [
    ("export const App = () => <div className=\"a'b\" onClick={() => go(1)}>it's {items.map(i => <li key={i}>don't {f(i)}</li>)} <br/> </div>; after()", {E: functions("App"), V: ["App"], X: [("App", "App", False)], C: ["go", "map", "f", "after"]}),
    ("function V() { return (<><A.B x={`t${g()}`} {...rest()} />text with function no() and class X</>) }\nconst z = a < b && c > d(1)", {E: functions("V"), V: ["z"], C: ["g", "rest", "d"]}),
    ("const el = cond ? <p>{/* don't */}</p> : null\nconst n = <T,>(x: T) => h(x)", {E: functions("n"), V: ["el", "n"], C: ["h"]}),
]


def distinct(values):
    return list(dict.fromkeys(values))


@pytest.mark.parametrize(("source", "expected", "markup"), [(s, e, False) for s, e in CASES] + [(s, e, True) for s, e in MARKUP])
def test_facts_of_scripts(source, expected, markup):
    found = script_facts(source, markup)
    assert {k: (found[k] if k == I else distinct(found[k])) for k in (I, E, X, V, C)} == {I: [], E: [], X: [], V: [], C: []} | expected


def test_markup_changes_nothing_where_there_is_none():
    for source, expected in CASES[:32]:
        assert script_facts(source, True) == script_facts(source, False), source


def test_broken_and_long_sources_end():
    for source in ("`${", "class {", "((((", "}}}}", "const", "export", "import {", "<", "a = /x", "'", "@", "x = {", "export default", "\\"):
        script_facts(source), script_facts(source, True)
    import time

    began = time.time()
    long = "const a = { b: [1, 2, `x${c(d)}`] };\n" * 8000
    assert len(script_facts(long)["calls"]) == 8000 and time.time() - began < 20
    assert [t.text for t in tokens("a /* x */ = 'b' // c")] == ["a", "=", "'b'"]


def test_masks_keep_places():
    go = 'package m\n// func no() {}\nimport "fmt" /* type No */\nvar s = `func\nno() {` + "class {"\nfunc yes(a int) { call(\'"\') }\n'
    code, plain = masked(go, "go")
    assert len(code) == len(go) == len(plain) and '"fmt"' in code and "no()" not in code.replace("`func\nno() {`", "") and "no()" not in plain
    found = pattern_facts(go, "go")
    assert found["entities"] == [("function", "yes")] and [i["path"] for i in found["imports"]] == ["fmt"]
    rust = "fn life<'a>(x: &'a str) -> char { let c = '{'; /* struct No { */ \"fn no() {\"; 'x' }\nstruct Real {}"
    assert pattern_facts(rust, "rust")["entities"] == [("class", "Real"), ("function", "life")]
    java = 'class A { String s = "class B { void no() {"; /* class C */ public void run() { go(); } }'
    assert pattern_facts(java, "java")["entities"][0] == ("class", "A") and ("class", "B") not in pattern_facts(java, "java")["entities"]
    ruby = "# class No\nclass Yes\n  def go?\n    call('def no')\n  end\nend"
    assert pattern_facts(ruby, "ruby")["entities"] == [("class", "Yes"), ("function", "go?")]
