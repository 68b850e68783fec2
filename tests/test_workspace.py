"""A small workspace from files to endpoint graphs."""

import pytest
from pyspark.sql import functions as F

from codeflow.plans import workspace as W
from codeflow.plans.discovery import Request
from codeflow.sources import files as S
from codeflow.sources.snapshots import SnapshotStore

ROOT = "file:///ws"
SRC = f"{ROOT}/shop/src/main/java/com/acme"
FILES = {
    f"{ROOT}/shop/pom.xml": "<project/>",
    f"{SRC}/App.java": """package com.acme;
import org.springframework.boot.autoconfigure.SpringBootApplication;
@SpringBootApplication
public class App { public static void main(String[] args) { } }
""",
    f"{SRC}/web/OrderController.java": """package com.acme.web;
import com.acme.service.*;
import com.acme.service.OrderService;
import org.springframework.web.bind.annotation.*;
@RestController
@RequestMapping({"/api", "/v2"})
public class OrderController {
  private final OrderService service;
  public OrderController(OrderService service) { this.service = service; }
  @GetMapping("/orders/{id}")
  public Order find(long id) { return service.find(id).normalise(); }
  @RequestMapping(value = "/orders", method = {RequestMethod.POST, RequestMethod.PUT})
  public void save(Order order) { check(order); service.save(order, 1); java.util.Objects.requireNonNull(order); missing.call(); }
  private void check(Order order) { order.getName(); LOG.info("x"); }
}
""",
    f"{SRC}/service/OrderService.java": "package com.acme.service;\npublic interface OrderService { Order find(long id); void save(Order o, int n); void save(Order o, String n); }\n",
    f"{SRC}/service/OrderServiceImpl.java": """package com.acme.service;
import org.springframework.stereotype.Service;
@Service
public class OrderServiceImpl implements OrderService {
  private OrderRepository repository;
  public Order find(long id) { return repository.load(id); }
  public void save(Order o, int n) { if (n > 0) { save(o, n - 1); } repository.store(o); }
  public void save(Order o, String n) { }
}
""",
    f"{SRC}/service/OrderRepository.java": "package com.acme.service;\nimport org.springframework.stereotype.Repository;\n@Repository\npublic class OrderRepository { Order load(long id) { return new Order(\"a\"); } void store(Order o) { } }\n",
    f"{SRC}/service/Order.java": """package com.acme.service;
import lombok.Data;
import jakarta.persistence.*;
@Data
@Entity
@Table(name = "orders", schema = "shop")
public class Order {
  private String name;
  private boolean isOpen;
  public Order(String name) { this.name = name; }
  Order normalise() { return this; }
}
""",
    f"{SRC}/broken/Broken.java": "package com.acme.broken;\nclass Broken { void a() { x(; }\n int = 5;\n void b() { a(); }\n}\n",
}


@pytest.fixture(scope="module")
def request_():
    return Request(ROOT)


@pytest.fixture(scope="module")
def analysis(spark, request_):
    return W.analyze(S.from_memory(spark, FILES.items()), request_)


def named(index):
    return {r["id"]: r["signature"] for r in index.nodes.select("id", "symbol.signature").collect()}


def calls(index):
    names = named(index)
    return {(names[r["source"]].split("#", 1)[-1], names[r["target"]], r["confidence"]): r["occurrence_count"] for r in index.edges.collect()}


def test_discovery(analysis):
    (app,) = analysis.discovery.applications.collect()
    assert app["name"] == "App" and app["source_namespaces"] == ["com.acme"] and app["root_uri"] == f"{ROOT}/shop"
    assert app["source_roots"] == [f"{ROOT}/shop/src/main/java"] and analysis.discovery.diagnostics.count() == 0
    assert (analysis.indexed, analysis.reused) == (7, 0)


def test_endpoints(analysis):
    got = {(tuple(r["http_methods"]), tuple(r["paths"])) for r in analysis.index.endpoints.collect()}
    assert got == {(("GET",), ("/api/orders/{id}", "/v2/orders/{id}")), (("POST", "PUT"), ("/api/orders", "/v2/orders"))}


def test_edges(analysis):
    got = calls(analysis.index)
    impl, repo = "com.acme.service.OrderServiceImpl", "com.acme.service.OrderRepository"
    assert got["method:find(long):Order", f"{impl}#method:find(long):Order", "inferred"] == 1
    assert got["method:find(long):Order", "com.acme.service.Order#method:normalise():Order", "inferred"] == 1
    assert got["method:save(Order):void", f"{impl}#method:save(Order,int):void", "inferred"] == 1  # the overload by its argument
    assert got["method:save(Order):void", "com.acme.web.OrderController#method:check(Order):void", "exact"] == 1
    for second in ("int", "String"):  # nothing shows the type of n - 1
        assert got["method:save(Order,int):void", f"{impl}#method:save(Order,{second}):void", "ambiguous"] == 1
    assert got["method:find(long):Order", f"{repo}#method:load(long):Order", "inferred"] == 1
    assert got["method:load(long):Order", "com.acme.service.Order#constructor(String)", "exact"] == 1
    assert got["method:check(Order):void", "com.acme.service.Order#method:getName():String", "inferred"] == 1  # generated
    assert got["method:check(Order):void", "LOG#method:info(String):", "inferred"] == 1  # a bare static owner
    assert got["method:save(Order):void", "unknown#call#method:call():", "unresolved"] == 1


def test_nodes(analysis):
    rows = {r["symbol"]["signature"]: r for r in analysis.index.nodes.collect()}
    assert rows["type:com.acme.web.OrderController"]["role"] == "controller" and rows["type:com.acme.service.OrderServiceImpl"]["role"] == "service"
    order = rows["type:com.acme.service.Order"]
    assert order["role"] == "entity" and order["metadata"]["entity_tables"] == ["shop.orders"]
    assert rows["com.acme.service.Order#method:getName():String"]["filter_ids"] == ["entity", "trivial"]
    assert "com.acme.service.Order#method:isOpen():boolean" in rows and "com.acme.service.Order#method:setOpen(boolean):void" in rows
    assert rows["com.acme.web.OrderController#method:find(long):Order"]["metadata"]["endpoint_base_paths"] == ["/api", "/v2"]
    assert rows["LOG"]["role"] == "ambiguous" and rows["unknown#call"]["unresolved"]
    assert rows["com.acme.broken.Broken#method:b():void"]["role"] == "helper"
    assert {r["code"] for r in analysis.index.diagnostics.collect()} == {"java.syntaxError"}


def test_endpoint_graph(analysis):
    (find,) = [r for r in analysis.index.endpoints.collect() if r["http_methods"] == ["GET"]]
    nodes, edges = W.endpoint_graph(analysis.index, find["id"])
    depth = {r["symbol"]["qualified_name"]: r["depth"] for r in nodes.collect()}
    assert depth["com.acme.service.OrderServiceImpl#find"] == 1 and depth["com.acme.service.OrderRepository#load"] == 2 and depth["com.acme.service.Order#<init>"] == 3
    few, _ = W.endpoint_graph(analysis.index, find["id"], filters=["controller", "service"])
    assert {r["symbol"]["qualified_name"] for r in few.collect()} == {"com.acme.web.OrderController#find", "com.acme.service.OrderServiceImpl#find"}
    none, _ = W.endpoint_graph(analysis.index, find["id"], confidences=["exact"])
    assert none.count() == 1
    with pytest.raises(ValueError):
        W.endpoint_graph(analysis.index, "nothing")


def test_incremental_is_cold(spark, request_, analysis):
    changed = dict(FILES)
    changed[f"{SRC}/service/OrderRepository.java"] = changed[f"{SRC}/service/OrderRepository.java"].replace("void store(Order o) { }", "void store(Order o) { o.getName(); }")
    del changed[f"{SRC}/broken/Broken.java"]
    files = S.from_memory(spark, changed.items())
    warm, cold = W.analyze(files, request_, previous=analysis.facts), W.analyze(files, request_)
    assert (warm.indexed, warm.reused) == (1, 5)
    assert calls(warm.index) == calls(cold.index) and named(warm.index) == named(cold.index)
    again = W.analyze(files, request_, previous=warm.facts)
    assert (again.indexed, again.reused) == (0, 6)


def same(warm, cold):
    rows = lambda df: sorted(str(r) for r in df.collect())
    for name in ("endpoints", "nodes", "edges", "diagnostics"):
        assert rows(getattr(warm.index, name)) == rows(getattr(cold.index, name)), name
    assert rows(warm.discovery.applications) == rows(cold.discovery.applications)
    for name in ("symbols", "notes", "routes", "calls"):
        assert rows(getattr(warm.index.tables, name).select(sorted(getattr(warm.index.tables, name).columns))) == rows(getattr(cold.index.tables, name).select(sorted(getattr(cold.index.tables, name).columns))), name


def test_updates_are_cold(spark, request_, analysis, monkeypatch):
    """Each update follows the one before: a body, a signature, an annotation, a deletion, a new file that makes a call
    ambiguous, a new application; by events and by digests."""
    repo, web, impl = f"{SRC}/service/OrderRepository.java", f"{SRC}/web/OrderController.java", f"{SRC}/service/OrderServiceImpl.java"
    steps = [
        ({repo: ("void store(Order o) { }", "void store(Order o) { o.getName(); }")}, 1),
        ({repo: ("Order load(long id)", "Order load(Long id, int... more)")}, 1),
        ({web: ('"/orders/{id}"', '"/orders/{key}"'), impl: ("@Service", '@Service("other")')}, 2),
        ({f"{SRC}/broken/Broken.java": None}, 0),
        ({f"{SRC}/service/Second.java": "package com.acme.service;\npublic class Second implements OrderService { public Order find(long id) { return null; } }\n"}, 1),
        ({impl: ("implements OrderService", "")}, 1),
        ({f"{SRC}/service/Second.java": None, f"{ROOT}/shop/notes.txt": "x"}, 0),
    ]
    monkeypatch.setattr(W, "MERGE_AFTER", 3)
    found = W.discover
    monkeypatch.setattr(W, "discover", lambda *a: pytest.fail("discovery was repeated"))
    now, warm = dict(FILES), analysis
    for k, (edits, indexed) in enumerate(steps):
        for uri, edit in edits.items():
            if edit is None:
                del now[uri]
            else:
                now[uri] = now[uri].replace(*edit) if isinstance(edit, tuple) else edit
        files = S.from_memory(spark, now.items())
        events = spark.createDataFrame([(u, e is None) for u, e in edits.items()], "uri string, deleted boolean")
        given = files.join(events.filter("not deleted"), "uri", "left_semi") if k % 2 else files  # unchanged files are not needed
        warm = W.analyze(given, request_, previous=warm, changes=events if k % 2 else None)
        assert (warm.indexed, warm.indexed + warm.reused) == (indexed, sum(u.endswith(".java") for u in now)), k
        with monkeypatch.context() as m:
            m.setattr(W, "discover", found)
            same(warm, W.analyze(files, request_))
    monkeypatch.setattr(W, "discover", found)
    now[f"{SRC}/App.java"] = now[f"{SRC}/App.java"].replace("@SpringBootApplication", '@SpringBootApplication(scanBasePackages = "com.acme.service")')
    files = S.from_memory(spark, now.items())
    warm = W.analyze(files, request_, previous=warm)
    assert warm.indexed == 1
    same(warm, W.analyze(files, request_))


def test_update_from_store(spark, request_, analysis, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/store")
    W.publish(store, request_, analysis)
    before = W.previous_analysis(store, request_)
    now = dict(FILES) | {f"{SRC}/web/Extra.java": "package com.acme.web;\nclass Extra { void go(OrderController c) { c.find(1L); } }\n"}
    files = S.from_memory(spark, now.items())
    warm = W.analyze(files, request_, previous=before)
    assert (warm.indexed, warm.reused) == (1, 7) and W.previous_analysis(store, Request(ROOT, include_generated=True)) is None
    same(warm, W.analyze(files, request_))


def test_exclusion(spark, request_):
    a = W.analyze(S.from_memory(spark, FILES.items()), request_, excluded=["java.util.*", "LOG"])
    assert not any(s.startswith(("java.util", "LOG")) for s in named(a.index).values())


def test_publication(spark, request_, analysis, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/store")
    assert store.load() is None and W.previous_facts(store, request_) is None
    assert W.publish(store, request_, analysis) == 1 and W.publish(store, request_, analysis) == 2
    assert store.load()["edges"].count() == analysis.index.edges.count()
    assert W.previous_facts(store, request_).count() == 7
    assert W.previous_facts(store, Request(ROOT, include_generated=True)) is None
    for p in (tmp_path / "store" / "pointer" / "2").glob("*.json"):
        p.write_text("{broken")
    assert store.load()["nodes"].count() == analysis.index.nodes.count()  # the last good version
    store.clear()
    assert store.load() is None


def test_no_application(spark):
    a = W.analyze(S.from_memory(spark, [(f"{ROOT}/x/A.java", "class A {}")]), Request(ROOT))
    assert {r["code"] for r in a.discovery.diagnostics.collect()} == {"spring.discovery.mavenPomNotFound", "spring.discovery.gradleBuildNotFound"}
    assert a.index.nodes.count() == 0 and a.index.edges.count() == 0


def test_gradle_modules(spark):
    from codeflow.plans.discovery import find_modules

    settings = 'rootProject.name = "x"\n// include "gone"\ninclude(":billing", ":api:http")\ninclude "orders"\nproject(":api:http").projectDir = file("services/http-api")\n'
    rows = find_modules(S.from_memory(spark, [(f"{ROOT}/settings.gradle.kts", settings), (f"{ROOT}/orders/pom.xml", "")]), ROOT).collect()
    assert {(r["module"], r["build"]) for r in rows} == {(ROOT, "gradle"), (f"{ROOT}/billing", "gradle"), (f"{ROOT}/services/http-api", "gradle"), (f"{ROOT}/orders", "gradle")}


def test_files_from_disk(spark, tmp_path):
    (tmp_path / "a b").mkdir()
    (tmp_path / "a b" / "X.java").write_text("class X {}\n")
    (tmp_path / "pom.xml").write_text("<project/>")
    (tmp_path / "no.txt").write_text("x")
    rows = S.from_path(spark, f"file://{tmp_path}").collect()
    assert {r["uri"].rsplit("/", 1)[-1] for r in rows} == {"X.java", "pom.xml"}
    files = S.from_path(spark, f"file://{tmp_path}")
    assert S.matching(files, f"file://{tmp_path}", "**/*.java").select("relative_uri").first()[0] == "a b/X.java"
    assert S.matching(files, f"file://{tmp_path}", "**/*.java", ["a*/**"]).count() == 0 and S.markers(files).count() == 1


def test_report(analysis):
    text = S.report(analysis.index.nodes, analysis.index.endpoints)
    assert "controller:" in text and "GET /api/orders/{id}, /v2/orders/{id}" in text
    assert S.as_json(analysis.index.endpoints.select("id", "paths")).filter(F.contains("json", F.lit('"paths"'))).count() == 2


def test_session(spark, tmp_path):
    from codeflow.plans import session as X

    s = X.Session(spark, SnapshotStore(spark, f"file://{tmp_path}/s"), Request(ROOT))
    files = S.from_memory(spark, FILES.items())
    assert X.choose(files).name == W.PARSER_ID and X.choose(files, "other").name == W.PARSER_ID
    first = s.analyze(files)
    assert first.indexed == 7 and s.analyze(files).reused == 7 and s.timings["total_ms"] > 0
    (find,) = [r for r in s.last.index.endpoints.collect() if r["http_methods"] == ["GET"]]
    said, graph = s.refresh(find["id"])
    assert said == "updated" and graph[0].count() > 3 and s.refresh("gone") == ("endpointUnavailable", None)
    assert s.location(find["handler_symbol_id"])["uri"].endswith("OrderController.java") and s.location("gone") is None
    assert {r["code"] for r in s.diagnostics().collect()} == {"java.syntaxError"}

    def overtaken(*a, **k):
        s._begin()
        return first

    X.REGISTRY[W.PARSER_ID].analyze = overtaken
    try:
        with pytest.raises(X.Cancelled):
            s.analyze(files)
    finally:
        X.REGISTRY[W.PARSER_ID].analyze = W.analyze
    assert s.last is not None and s.store.load() is not None  # the last good result stays
    s.clear()
    assert s.store.load() is None


def analysed(spark, java, **request):
    head = "package a;\nimport org.springframework.boot.autoconfigure.SpringBootApplication;\n@SpringBootApplication public class App {}\n"
    files = [(f"{ROOT}/pom.xml", "<project/>"), (f"{ROOT}/src/main/java/a/App.java", head)]
    files += [(f"{ROOT}/src/main/java/a/{n}.java", "package a;\n" + t) for n, t in java.items()]
    return W.analyze(S.from_memory(spark, files), Request(ROOT, **request))


def calls_of(a):
    names = a.index.nodes.selectExpr("id", "symbol.signature as s")
    e = a.index.edges.join(names.toDF("source", "caller"), "source").join(names.toDF("target", "callee"), "target")
    return sorted((r["caller"].split("#")[1], r["callee"], r["confidence"]) for r in e.select("caller", "callee", "confidence").collect())


def test_overloads(spark):
    a = analysed(spark, {
        "Job": "public class Job extends Base implements Runnable { }",
        "Base": "import java.util.function.Supplier; public abstract class Base implements Supplier<String> { }",
        "T": """public class T {
          void run(Runnable r) { } void run(String s) { }
          void f(Object o) { } void f(String s) { }
          void g(Comparable c) { } void g(Object o) { }
          void h(Serializable s) { } void h(Comparable c) { }
          void k(Object o) { } void k(Supplier s) { }
          void n(long l) { } void n(Integer i) { } void n(double d) { }
          void z(int i) { } void z(String s) { } void z(Object o) { }
          void m1() { run(new Job()); }
          void m2() { f(1); }
          void m3() { g("x"); }
          void m4() { h("x"); }
          void m5() { k(new Job()); }
          void m6() { n(1); }
          void m7(Integer i) { n(i); }
          void m8() { z(null); }
        }""",
    })
    got = [(c, t.split("#")[1], k) for c, t, k in calls_of(a) if c.startswith("method:m") and "constructor" not in t]
    by = {c.split("(")[0][7:]: sorted(t[7:] for d, t, _ in got if d == c) for c, _, _ in got}
    assert by == {
        "m1": ["run(Runnable):void"],  # a declared supertype counts by its name
        "m2": ["f(Object):void", "f(String):void"],  # a primitive is widened or boxed, nothing else: neither fits
        "m3": ["g(Comparable):void"],  # third of the supertypes of String, Object the fourth
        "m4": ["h(Serializable):void"], "m5": ["k(Supplier):void"], "m6": ["n(long):void"], "m7": ["n(Integer):void"],
        "m8": ["z(String):void"],  # null: no primitive, and rather not Object
    }
    assert {k for c, _, k in got if c.startswith("method:m2")} == {"ambiguous"} and {k for c, _, k in got if c.startswith("method:m1")} == {"exact"}


def test_java_lang_names():
    from codeflow.plans.resolve import JAVA_LANG, SUPERTYPES

    assert len(JAVA_LANG) == 109 and {"Compiler", "IO", "StableValue"} <= JAVA_LANG
    assert SUPERTYPES["String"] == ["CharSequence", "Serializable", "Comparable", "Object"] and len(SUPERTYPES) == 9


def test_discovery_diagnostics(spark):
    codes = lambda a: sorted(r["code"].rsplit(".", 1)[-1] for r in a.discovery.diagnostics.collect())
    a = analysed(spark, {}, source_roots=["src/main/java", "../else", "file:///other/src", "src/none"])
    assert codes(a) == ["fileSearchFailed", "invalidSourceRoot", "invalidSourceRoot"] and a.discovery.applications.count() == 1
    files = [(f"{ROOT}/pom.xml", "<project/>"), (f"{ROOT}/src/main/java/a/A.java", None)]
    assert codes(W.analyze(S.from_memory(spark, files), Request(ROOT))) == ["fileReadFailed", "noApplications"]
    assert codes(W.analyze(S.from_memory(spark, files[:1]), Request("no uri"))) == ["invalidWorkspaceUri"]


NEEDY = {
    f"{ROOT}/pom.xml": "<project/>",
    f"{ROOT}/src/main/java/a/App.java": "package a;\nimport org.springframework.boot.autoconfigure.SpringBootApplication;\n@SpringBootApplication\npublic class App { }\n",
    f"{ROOT}/src/main/java/a/Base.java": "package a;\npublic abstract class Base extends Root { protected Gate gate; Leaf leaf() { return null; } }\n",
    f"{ROOT}/src/main/java/a/Root.java": "package a;\npublic class Root extends Unknown { void top(Gate g) { } void top(Object o) { } class Inner { void in() { } } }\n",
    f"{ROOT}/src/main/java/a/Gate.java": "package a;\npublic interface Gate { Leaf pass(); }\n",
    f"{ROOT}/src/main/java/a/Half.java": "package a;\npublic abstract class Half implements Gate { void half() { } }\n",
    f"{ROOT}/src/main/java/a/Full.java": "package a;\npublic class Full extends Half { public Leaf pass() { half(); return new Leaf(1); } }\n",
    f"{ROOT}/src/main/java/a/Leaf.java": "package a;\npublic class Leaf { Leaf(int n) { } Leaf next() { return this; } b.Far far; }\n",
    f"{ROOT}/src/main/java/b/Far.java": "package b;\nimport a.*;\npublic class Far { Leaf back() { return null; } static void go(Full f) { } }\n",
    f"{ROOT}/src/main/java/a/User.java": """package a;
import b.Far;
public class User extends Base {
  void use(Full full) { gate.pass().next().next(); leaf().next(); top(full); top(gate); Far.go(full); new Inner(); new Leaf(2); }
  void more(String s) { Elsewhere.run(s); full.x(); gate.pass(); super.leaf(); this.top(null); Twin.twin(); }
}
""",
    f"{ROOT}/src/main/java/c/Twin.java": "package c;\npublic class Twin { static void twin() { } }\n",
    f"{ROOT}/src/main/java/d/Twin.java": "package d;\npublic class Twin { static void twin() { } }\n",
}


@pytest.mark.parametrize("made", ["written", "tables"])
def test_calls_that_ask_for_symbols(spark, monkeypatch, made):
    """Groups that ask for the symbols they need resolve calls as those that get all, and don't get all."""
    from codeflow.plans import resolve, synthetic
    from codeflow.plans.discovery import discover
    from codeflow.plans.framework import in_scope

    root, size = ROOT, 4
    if made == "tables":
        root, size = synthetic.ROOT, 40
        nation = spark.createDataFrame([(n, n % 3) for n in range(6)], "n_nationkey long, n_regionkey long")
        files = synthetic.of_tables(nation, spark.range(3).toDF("r_regionkey"), spark.range(60).selectExpr("id as s_suppkey", "id % 6 as s_nationkey"))
    else:
        files = S.from_memory(spark, (FILES | NEEDY).items())
    request = Request(root)
    found = discover(files, request)
    everything = found.applications.withColumn("source_namespaces", F.array(F.lit("")))
    facts = in_scope(W.X.extract(W.pending_files(files, everything, request)), everything).cache()
    rows = lambda df: sorted(map(repr, df.select("uri", "ord", "source_id", "target_id", "confidence", "reason", "candidates", "fallback_owner", "kind", "member_name", "argument_types", "loc").collect()))
    whole = rows(resolve.resolve_whole(facts))
    monkeypatch.setattr(resolve, "ASKING_CALLS", size)
    got, had = resolve.resolve_asking(facts)
    assert rows(got) == whole and len(whole) > 5
    monkeypatch.setattr(resolve, "WHOLE_SYMBOLS", 0)
    one = facts.filter(F.col("uri") == facts.agg(F.max("uri")).first()[0]).select("application_id", "uri")
    assert rows(resolve.resolve_calls(facts, one)) == rows(resolve.resolve_whole(facts, one))
    if made == "tables":
        assert max(r["count"] for r in had.groupBy("g").count().collect()) < facts.count() / 2


def test_symbols_of_one_id(spark):
    """The last of the symbols with one id counts, and rows are dealt by key for none of the others."""
    from codeflow.operators.lookup import ranked_first
    from codeflow.plans.framework import last_symbols

    rows = [(a, f"s{i}", f"f{i % 7}", i, f"{a}{i}") for a in "ab" for i in range(300)]
    rows += [("a", "s5", "f9", 1, "later file"), ("a", "s5", "f9", 0, "same file"), ("b", "s6", "f0", 999, "earlier file"), ("a", "s7", "f0", 7_000, "later place")]
    symbols = spark.createDataFrame(rows, "application_id string, id string, uri string, ord int, what string")
    found = last_symbols(symbols)
    want = ranked_first(symbols, ["application_id", "id"], [F.col("uri").desc(), F.col("ord").desc()])
    assert sorted(found.collect()) == sorted(want.collect()) and found.count() == 600
    assert {(r["application_id"], r["id"]): r["what"] for r in found.collect() if r["id"] in ("s5", "s6", "s7")} == {("a", "s5"): "later file", ("a", "s6"): "a6", ("a", "s7"): "later place", ("b", "s5"): "b5", ("b", "s6"): "b6", ("b", "s7"): "b7"}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Window" not in plan


def test_parsing_is_dealt_by_files(spark, request_, analysis, monkeypatch):
    """Small sources make large facts: tasks get so many files each, however small these are."""
    monkeypatch.setattr(W, "TASK_FILES", 1)
    found = W.analyze(S.from_memory(spark, FILES.items()), request_)
    assert len(found.facts.inputFiles()) > 2 >= len(analysis.facts.inputFiles())
    assert found.facts.exceptAll(analysis.facts).isEmpty() and found.facts.count() == analysis.facts.count()
