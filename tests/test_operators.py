"""Operators on small frames: functions, lookups, graphs, validation, projections, increments, streams."""

import random
import time

import pytest
from pyspark.sql import functions as F

from codeflow.functions import text as T
from codeflow.operators import graph as G, incremental as I, lookup as L, project as P, validate as V
from codeflow.streaming.changes import EVENTS, bursts, on_changes


def value(spark, column, **given):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in given.items()), F.lit(1).alias("one"))
    return row.select(column.alias("v")).first()["v"]


CASES = [
    (T.normalize_relative_uri, "a\\.\\b//c/../d", "a/b/d"), (T.normalize_relative_uri, "../../a/..", "../.."), (T.normalize_relative_uri, "", ""),
    (T.encode_component, "a b/c!~*'()é", "a%20b%2Fc!~*'()%C3%A9"), (T.plain_type_name, "Map<String, List<X>>[]...", "Map"), (T.erased_type, "? extends a.b.C<D>...", "C[]"),
    (T.default_bean_name, "URLReader", "URLReader"), (T.default_bean_name, "Foo", "foo"), (T.default_bean_name, "A", "a"), (T.simple_name, "a.b.C$D", "D"), (T.owner_name, "a.B#c", "a.B"),
    (T.without_space, " a < b > ", "a<b>"), (T.or_unknown, "", "unknown"), (T.display_path, "", "/"), (T.nfc, "é", "é"), (T.project_directory, ":a:b", "a/b"), (T.directory_uri, "x//", "x/"),
    (T.without_comments, "a /* b\n */ c // d\nurl 'http://x'", "a  c \nurl 'http://x'"), (T.string_literals, 'f("a\\n\\"b", "c")', ['a\n"b', "c"]), (T.request_methods, "{RequestMethod.GET, RequestMethod.FOO}", ["GET"]),
]


@pytest.mark.parametrize("f,given,want", CASES)
def test_functions(spark, f, given, want):
    assert value(spark, f("x"), x=given) == want


def test_paths(spark):
    assert value(spark, T.join_http_path("a", "b"), a="/api/", b="/x/") == "/api/x" and value(spark, T.join_http_path("a", "b"), a="", b="") == "/"
    assert value(spark, T.relative_uri_within("a", "b"), a="file:///r", b="file:///r/x%20y/../z+1?q#f") == "z+1"
    assert value(spark, T.relative_uri_within("a", "b"), a="file:///r", b="file:///root/x") is None
    assert value(spark, T.append_url_path("a", "b"), a="http://h/", b="x") == "http://h/x" and value(spark, T.append_url_path("a", "b"), a="http://h/", b="") == "http://h"
    assert value(spark, T.accessor_stem("a", F.lit(True)), a="isOpen") == "Open" and value(spark, T.endpoint_label(F.array().cast("array<string>"), F.array().cast("array<string>"))) == "ANY /"


def random_graph(spark, seed):
    r = random.Random(seed)
    ids = [f"n{i}" for i in range(r.randint(2, 25))]
    nodes = [(i, r.choice("abc"), [r.choice("xyz")]) for i in ids]
    edges = list({(r.choice([*ids, "gone"]), r.choice([*ids, "gone"]), r.choice(["exact", "inferred"])) for _ in range(r.randint(1, 60))})
    return nodes, edges, spark.createDataFrame(nodes, "id string, role string, filter_ids array<string>"), spark.createDataFrame(edges, "source string, target string, confidence string")


def brute_reach(nodes, edges, root, roles="abc", confidences=("exact", "inferred")):
    role = {i: r for i, r, _ in nodes}
    depth, front = {root: 0}, [root]
    while front:
        new = []
        for x in front:
            for s, t, c in edges:
                if s == x and t in role and t not in depth and role[t] in roles and c in confidences:
                    depth[t] = depth[x] + 1
                    new.append(t)
        front = new
    return depth


@pytest.mark.parametrize("seed", range(4))
def test_reachability(spark, seed):
    nodes, edges, n, e = random_graph(spark, seed)
    roots = spark.createDataFrame([("n0",)], "id string")
    for strategy in ("local", "distributed"):
        got = {r["id"]: r["depth"] for r in G.reachable(n, e, roots, strategy=strategy).collect()}
        assert got == brute_reach(nodes, edges, "n0")
        pruned = G.reachable(n, e, roots, F.col("role").isin("a", "b"), F.col("confidence") == "exact", strategy)
        assert {r["id"]: r["depth"] for r in pruned.collect()} == brute_reach(nodes, edges, "n0", "ab", ("exact",))
    down = brute_reach(nodes, edges, "n0")
    up = brute_reach(nodes, [(t, s, c) for s, t, c in edges], "n0")
    assert {r["id"] for r in G.focus(n, e, roots).collect()} == set(down) | set(up)
    inside = {(s, t, c) for s, t, c in edges if s in down and t in down}
    assert {tuple(r) for r in G.induced(e, G.reachable(n, e, roots)).select("source", "target", "confidence").collect()} == inside


def test_long_chain(spark):
    n = 3000
    nodes = spark.range(n).select(F.concat(F.lit("n"), "id").alias("id"))
    edges = spark.range(n - 1).select(F.concat(F.lit("n"), "id").alias("source"), F.concat(F.lit("n"), F.col("id") + 1).alias("target"))
    row = G.reachable(nodes, edges, nodes.filter("id = 'n0'")).agg(F.max("depth"), F.count("*")).first()
    assert tuple(row) == (n - 1, n)


def test_tiers_keep_ties_and_block(spark):
    probe = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, name string")
    first = spark.createDataFrame([("a", "x"), ("a", "y")], "name string, hit string")
    second = spark.createDataFrame([("a", "z"), ("b", "z")], "name string, hit string")
    got = {(r["k"], r["hit"], r["tier"]) for r in L.tiered_lookup(probe, ["k"], [first, second], [["name"], ["name"]]).collect()}
    assert got == {(1, "x", 1), (1, "y", 1), (2, "z", 2)}
    blocker = spark.createDataFrame([("a", None), ("b", "own")], "name string, hit string")
    got = {(r["k"], r["hit"]) for r in L.blocking_lookup(probe, ["k"], blocker, ["name"], "hit", spark.createDataFrame([("a", "z"), ("c", "z")], "name string, hit string"), ["name"]).collect()}
    assert got == {(2, "own"), (3, "z")}


def test_closure_of_cycles(spark):
    edges = spark.createDataFrame([("a", "b", 0), ("b", "c", 0), ("c", "a", 0), ("a", "d", 1)], "child string, parent string, ord int")
    got = {(r["node"], r["ancestor"]) for r in L.closure(edges, "child", "parent").collect()}
    assert got == {("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("b", "a"), ("b", "d"), ("c", "a"), ("c", "b"), ("c", "d")}


def test_longest_prefix(spark):
    items = spark.createDataFrame([("a/b/c",), ("a/bc",), ("x",)], "uri string")
    prefixes = spark.createDataFrame([("a",), ("a/b",), ("a/b",), ("a/b/c/d",)], "module string")
    assert {(r["uri"], r["module"]) for r in L.longest_prefix(items, "uri", prefixes, "module").collect()} == {("a/b/c", "a/b"), ("a/bc", "a")}


LOC = "struct<uri:string,start:struct<line:int,column:int>,end:struct<line:int,column:int>>"


def graph(spark, node=None, edge=None):
    ok = ("f", (1, 0), (2, 0))
    nodes = [{"ord": 0, "id": "a", "requires_source_location": True, "unresolved": False, "loc": ok}, {"ord": 1, "id": "b", "requires_source_location": False, "unresolved": False, "loc": None}]
    edges = [{"ord": 0, "id": "e", "source": "a", "target": "b", "confidence": "exact", "occurrence_count": 1, "evidence": [("r", 1, ok)]}]
    nodes[0] |= node or {}
    edges[0] |= edge or {}
    return (spark.createDataFrame([tuple(n.values()) for n in nodes], f"ord int, id string, requires_source_location boolean, unresolved boolean, loc {LOC}"),
            spark.createDataFrame([tuple(e.values()) for e in edges], f"ord int, id string, source string, target string, confidence string, occurrence_count long, evidence array<struct<reason:string,candidate_count:int,loc:{LOC}>>"))


BAD = ("f", (3, 0), (2, 0))
ISSUES = [
    ({}, {}, set()), ({"id": "b"}, {"source": "b"}, {"duplicateNodeId"}), ({"loc": None}, {}, {"missingSourceLocation"}), ({"loc": BAD}, {}, {"invalidSourceLocation"}), ({"loc": ("", (0, 0), (0, 1))}, {}, {"invalidSourceLocation"}),
    ({"unresolved": True}, {}, {"unresolvedNodeHasOutgoingEdge"}), ({}, {"target": "zz"}, {"danglingTarget", "inconsistentUnresolvedTarget"}), ({}, {"source": "zz"}, {"danglingSource"}),
    ({}, {"occurrence_count": 2}, {"invalidOccurrenceCount"}), ({}, {"occurrence_count": 0, "evidence": []}, {"invalidOccurrenceCount"}), ({}, {"evidence": [("r", 2, None)]}, {"inconsistentCandidateCount"}),
    ({}, {"confidence": "ambiguous", "evidence": [("r", 2, BAD)]}, {"invalidSourceLocation"}), ({}, {"confidence": "unresolved", "evidence": [("r", 0, None)]}, {"inconsistentUnresolvedTarget"}),
]


@pytest.mark.parametrize("node,edge,codes", ISSUES)
def test_validation(spark, node, edge, codes):
    issues = V.validate_graph(*graph(spark, node, edge))
    assert {r["code"] for r in issues.collect()} == codes
    if codes:
        with pytest.raises(ValueError, match=sorted(codes)[0]):
            V.raise_if_invalid(issues)


def test_messages(spark):
    f = lambda a, b, c, d: value(spark, V.validate_message(F.lit(a), F.lit(b), F.array(*map(F.lit, c)), F.array(*(F.array(*map(F.lit, x)) for x in d))))
    assert f("a", "a", ["x"], [["x"]]) is None and f("a", "b", ["x"], [["x"]]) and f("a", "a", ["x", "x"], [["x"]]) and f("a", "a", ["x"], [["y"]])


def test_visibility_prunes_groups(spark):
    groups = spark.createDataFrame([(1, ["controller"]), (2, ["helper"]), (3, ["controller"])], "g int, filter_ids array<string>")
    methods = spark.createDataFrame([("a", 1, ["controller"]), ("b", 1, ["trivial"]), ("c", 2, []), ("d", 3, ["trivial"])], "id string, g int, filter_ids array<string>")
    g, m = P.visible(groups, methods, "g", ["controller", "helper"], ["trivial"], ["controller"])
    assert {r["g"] for r in g.collect()} == {1} and {r["id"] for r in m.collect()} == {"a"}


def test_group_graph(spark):
    nodes = spark.createDataFrame([("t", "A", None, True, ["x"]), ("m", "A#m", "t", False, ["y"]), ("lone", "B", None, True, [])], "id string, qualified_name string, owner_symbol_id string, group_node boolean, filter_ids array<string>")
    edges = spark.createDataFrame([("m", "t"), ("m", "lone")], "source string, target string")
    groups, kept, ends = P.group_graph(nodes, edges, "m")
    assert [(r["methods"], r["is_root"]) for r in groups.collect()] == [(["m"], True)]
    assert {r["id"] for r in kept.collect()} == {"t", "m"} and ends.count() == 1
    boxes = P.layout_boxes(kept, groups).first()
    assert boxes["rows"] == 1 and boxes["height"] > boxes["rows"]


def test_cursor():
    assert [P.next_match(2, 1, 3), P.next_match(0, -1, 3), P.next_match(-1, 1, 3), P.next_match(0, 1, 0)] == [0, 2, 0, -1]


def test_plan_and_changes(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "uri string, v int")
    new = spark.createDataFrame([("a", 1), ("b", 2), ("d", 1)], "uri string, v int")
    assert {tuple(r) for r in I.plan(old, new, "uri", "v").collect()} == {("a", "reuse"), ("b", "index"), ("c", "delete"), ("d", "index")}
    events = spark.createDataFrame([("a", False, 1), ("b", False, 2), ("b", True, 3)], "uri string, deleted boolean, seq int")
    assert {tuple(r) for r in I.change_set(events, "uri", ["seq"], "deleted").collect()} == {("a", False), ("b", True)}
    none = spark.createDataFrame([], "uri string, discovery_candidate boolean")
    assert I.discovery_reusable(events, ["pom.xml"], none, none)
    assert not I.discovery_reusable(events, ["pom.xml"], spark.createDataFrame([("a", True)], none.schema), none)
    assert not I.discovery_reusable(spark.createDataFrame([("x/pom.xml",)], "uri string"), ["pom.xml"], none, none)


def test_change_stream(spark, tmp_path):
    source = tmp_path / "events"
    source.mkdir()
    (source / "1.json").write_text("\n".join(['{"uri":"a","deleted":false,"seq":1,"ts":"2024-01-01T00:00:00Z"}', '{"uri":"b","deleted":false,"seq":2,"ts":"2024-01-01T00:00:00.1Z"}', '{"uri":"b","deleted":true,"seq":3,"ts":"2024-01-01T00:00:00.2Z"}']))
    seen = []
    q = on_changes(spark.readStream.schema(EVENTS).json(str(source)), lambda df, n: seen.append([tuple(r) for r in df.collect()]), str(tmp_path / "cp"))
    deadline = time.time() + 60
    while not seen and time.time() < deadline:
        time.sleep(0.2)
    q.stop()
    assert seen == [[("a", False), ("b", True)]]
    batch = spark.read.schema(EVENTS).json(str(source))
    assert {(r["uri"], r["deleted"]) for r in bursts(batch, "1 second").collect()} == {("a", False), ("b", True)}
