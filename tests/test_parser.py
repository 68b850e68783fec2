"""Facts of Java snippets."""

import pytest

from codeflow.javafacts.extract import facts_of
from codeflow.javafacts.lexer import Positions, tokens


def facts(source):
    return facts_of("app", "file:///A.java", "A.java", source)


def calls(body, members=""):
    f = facts("class A { int n; %s void m(String p, int[] q) { %s } }" % (members, body))
    return [c for c in f["invocations"] if c["enclosing_symbol_id"].endswith("%3Avoid")]


@pytest.mark.parametrize("expression,type_", [
    ('"a"', "String"), ('"""\n x"""', "String"), ("'c'", "char"), ("1", "int"), ("1_000L", "long"), ("0x1F", "int"), ("0b1", "int"), ("1.5", "double"), ("1e3", "double"), ("2f", "float"), ("true", "boolean"),
    ("null", "null"), ("-3", "int"), ("!p", "String"), ("(1)", "int"), ("(Foo) p", "Foo"), ("(int) x.y()", "int"), ("new Foo(1)", "Foo"), ("new Foo<A, B>(1)", "Foo<A,B>"), ("new int[3]", "int"), ("p", "String"), ("q", "int[]"),
    ("n", "int"), ("this.n", "int"), ("a.b.n", "int"), ("1 + 2", None), ("x.y()", None), ("unknown", None), ("a ? b : c", None), ("() -> 1", None), ("A::b", None), ("i++", None), ("q[0]", None),
])
def test_argument_types(expression, type_):
    (c,) = [c for c in calls(f"f({expression});") if c["member_name"] == "f"]
    assert c["argument_count"] == 1 and c["argument_types"] == [type_] and c["argument_expressions"] == [expression]


@pytest.mark.parametrize("body,receiver,root,path", [
    ("x.f();", "x", None, None), ("this.x.f();", "this.x", "this", ["x"]), ("a.b.c.f();", "a.b.c", "a", ["b", "c"]), ("g().f();", "g()", None, None), ("g().h.f();", "g().h", "g()", ["h"]), ("new X<Y>(1).f();", "new X<Y>(1)", None, None),
    ("(a + b).f();", "(a + b)", None, None), ("q[1].f();", "q[1]", None, None), ('"s".f();', '"s"', None, None), ("super.f();", "super", None, None), ("a.<T>f();", "a", None, None), ("f();", None, None, None), ("x.g(1, h(2)).f();", "x.g(1, h(2))", None, None),
    ("return a && b.f();", "b", None, None), ("if (x) y.f();", "y", None, None), ("List<A> z = y.f();", "y", None, None),
])
def test_receivers(body, receiver, root, path):
    (c,) = [c for c in calls(body) if c["member_name"] == "f"]
    assert (c["receiver_expression"], c["receiver_root_expression"], c["receiver_member_path"]) == (receiver, root, path)


def test_locals_are_looked_up_before_the_use():
    got = {c["member_name"]: c["receiver_type"] for c in calls("x.a(); Foo x = new Foo(); x.b(); { Bar x = null; x.c(); } x.d(); for (Baz y : ys) { y.e(); } try (Res r = open()) { r.g(); } catch (E1 | E2 e) { e.h(); } final var v = 1; v.i(); int k = 1, l = 2; l.j();")}
    assert got == {"a": None, "Foo": None, "b": "Foo", "c": "Bar", "d": "Bar", "e": "Baz", "open": None, "g": "Res", "h": "E1|E2", "i": "var", "j": "int"}


def test_declarations():
    f = facts("""package p.q; import static a.B.*; import c.D;
@X(v = {1, 2}, name = "n, m") public abstract class A<T extends C<T>> extends B<T> implements I, J<K, L> {
  static { s(); } int a = f(), b[]; A(int x, String... y) {} <U> U g(@N U u) throws E { return null; } abstract void h();
  enum E { ONE(1) { void k() { z(); } }, TWO; E() {} } interface I2 { int C = 1; default void d() {} } record R(int x) { R { c(x); } } @interface Z { int v() default 1; }
}""")
    by = {}
    for s in f["symbols"]:
        by.setdefault(s["kind"], []).append(s["symbol"]["signature"])
    assert sorted(by["type"]) == ["type:p.q.A", "type:p.q.A.E", "type:p.q.A.I2", "type:p.q.A.R", "type:p.q.A.Z"]
    assert sorted(by["field"]) == ["p.q.A#field:a:int", "p.q.A#field:b:int[]", "p.q.A.I2#field:C:int"]
    assert sorted(by["constructor"]) == ["p.q.A#constructor(int,String...)", "p.q.A.E#constructor()"]
    assert {"p.q.A#method:g(U):U", "p.q.A#method:h():void", "p.q.A.I2#method:d():void"} <= set(by["method"])
    (a,) = [s for s in f["symbols"] if s["symbol"]["signature"] == "type:p.q.A"]
    assert a["super_types"] == ["B<T>", "I", "J<K,L>"] and a["modifiers"] == ["public", "abstract"]
    assert [(x["name"], x["expression"]) for x in a["annotations"][0]["arguments"]] == [("v", "{1, 2}"), ("name", '"n, m"')]
    assert [(i["qualified_name"], i["is_static"], i["is_wildcard"]) for i in f["imports"]] == [("a.B", True, True), ("c.D", False, False)]
    assert {c["member_name"] for c in f["invocations"]} == {"s", "f", "z", "c"} and not f["diagnostics"]


def test_behaviours():
    f = facts("class A { int a; A(int a) { this.a = a; } A(String s) { f(); } int getA() { return a; } int other() { return 1; } void setA(int v) { a = v; } A withA(int a) { this.a = a; return this; } void no(int a) { a = a; } }")
    got = {s["symbol"]["name"] + str(s["symbol"]["signature"].count("String")): s["method_behavior"] for s in f["symbols"] if s["kind"] in ("method", "constructor")}
    assert got == {"A0": "trivialConstructor", "A1": None, "getA0": "trivialGetter", "other0": None, "setA0": "trivialSetter", "withA0": "trivialFluentSetter", "no0": None}


def test_implicit_and_super_constructors():
    f = facts("class A extends B<C> { void m() { } } class D { D() { super(1); } D(int i) { this(); } } interface I {}")
    assert [(s["symbol"]["signature"], s["implicit"]) for s in f["symbols"] if s["kind"] == "constructor"] == [("A#constructor()", True), ("D#constructor()", None), ("D#constructor(int)", None)]
    assert [(c["kind"], c["member_name"], c["argument_types"]) for c in f["invocations"]] == [("constructor", "Object", ["int"])]


def test_lombok():
    f = facts("import lombok.*; @Data @AllArgsConstructor class A { private final int id; @Setter(AccessLevel.NONE) String name; static int s; boolean isOk; String getName() { return name; } }")
    got = {s["symbol"]["signature"] for s in f["symbols"] if s["generated_by"] and s["kind"] != "parameter"}
    assert got == {"A#method:getId():int", "A#method:isOk():boolean", "A#method:setOk(boolean):void", "A#constructor(int,String,boolean)"}
    f = facts("import other.Data; import lombok.*; @Data class A { int id; }")
    assert not [s for s in f["symbols"] if s["generated_by"]]
    f = facts("import lombok.Builder; @Builder class A { int id; }")
    made = {s["symbol"]["signature"]: s for s in f["symbols"] if s["generated_by"] and s["kind"] != "parameter"}
    assert set(made) == {"A#constructor(int)", "type:A.ABuilder", "A#method:builder():A.ABuilder", "A.ABuilder#method:id(int):A.ABuilder", "A.ABuilder#method:build():A"}
    assert {s["generated_by"] for s in made.values()} == {"lombok"} and made["A#constructor(int)"]["modifiers"] == [] and made["A#method:builder():A.ABuilder"]["modifiers"] == ["public", "static"]
    assert {s["method_behavior"] for s in made.values() if s["kind"] == "method"} == {"trivialBuilder"}
    generated = lambda source: {s["symbol"]["signature"] for s in facts(source)["symbols"] if s["generated_by"] and s["kind"] != "parameter"}
    assert generated("import lombok.*; @Data class A { final int id = 1; }") == {"A#method:getId():int"}
    assert generated("import lombok.*; @Value @RequiredArgsConstructor class A { int id; }") == {"A#method:getId():int"}
    assert generated("import lombok.*; @AllArgsConstructor @NoArgsConstructor class A { final int id = 1; static int n; }") == {"A#constructor()", "A#constructor(int)"}
    assert generated("import lombok.*; @Builder @NoArgsConstructor class A { }") == {"A#constructor()", "type:A.ABuilder", "A#method:builder():A.ABuilder", "A.ABuilder#method:build():A"}
    assert generated("import lombok.*; @Slf4j class A { }") == {"A#field:log:org.slf4j.Logger"} == generated("import lombok.extern.slf4j.Slf4j; @Slf4j class A { }")
    assert generated("import lombok.*; @Data @Getter(AccessLevel . NONE) class A { int id; }") == {"A#method:getId():int", "A#method:setId(int):void"}
    assert generated("import lombok.*; @Getter(AccessLevel.NONE) class A { @Getter int id; String NONEs; }") == {"A#method:getId():int"}


def test_deep_nesting_keeps_all_facts():
    f = facts("class A { int a = " + "(" * 3000 + "1" + ")" * 3000 + "; void m() { " + "f(" * 2000 + ")" * 2000 + "; } void n() { g(); } }")
    assert {"a", "m", "n"} <= {s["symbol"]["name"] for s in f["symbols"]} and {"f", "g"} <= {c["member_name"] for c in f["invocations"]} and not f["diagnostics"]


def test_faults_are_reported_and_skipped():
    f = facts("class A { int = 5; void a() { b(; } void c() { d(); } ")
    assert f["diagnostics"] and {"a", "c"} <= {s["symbol"]["name"] for s in f["symbols"]} and "d" in {c["member_name"] for c in f["invocations"]}
    for source in ("", "class", "}}}", "class A {", '"unclosed', "/* open", "@", "class A { @ }", "<<<<", "class A { void m() { new } }", "\x00é", "import", "package"):
        assert facts(source)["symbols"] is not None


def test_columns_are_utf16():
    source = "class A { /* \U0001f600 */ int a; }\n\U0001f600x"
    p = Positions(source)
    assert p.at(source.index("int")) == {"line": 0, "column": source.index("int") + 1} and p.at(len(source) - 1) == {"line": 1, "column": 2}
    assert [t.text for t in tokens("a->b::c...")] == ["a", "->", "b", "::", "c", "..."]
