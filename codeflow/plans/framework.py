"""The framework index: roles, endpoints, nodes and edges of all applications as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..javafacts import extract as X
from ..operators import graph as G
from ..operators.lookup import ranked_first
from ..sources.snapshots import cut
from .resolve import ROLES, SUPPORTED, resolve_calls

_W = "org.springframework.web.bind.annotation."
# Mapping annotations and their HTTP method.
FIXED_METHODS = {_W + "DeleteMapping": "DELETE", _W + "GetMapping": "GET", _W + "PatchMapping": "PATCH", _W + "PostMapping": "POST", _W + "PutMapping": "PUT"}
REQUEST_MAPPING, RESPONSE_BODY = _W + "RequestMapping", _W + "ResponseBody"
CONTROLLERS = (_W + "RestController", "org.springframework.stereotype.Controller")
ENTITY_TABLES = ("jakarta.persistence.Table", "javax.persistence.Table")
FEIGN_CLIENT = "org.springframework.cloud.openfeign.FeignClient"

# Filters of a graph view: (id, label, section, target, selected by default), in order.
NODE_FILTERS = [
    ("controller", "Controller", "Classes", "group", True), ("service", "Service", "Classes", "group", True), ("repository", "Repository", "Classes", "group", True),
    ("httpClient", "HTTP client", "Classes", "group", True), ("component", "Component", "Classes", "group", False), ("helper", "Helper", "Classes", "group", False),
    ("entity", "Entity", "Classes", "group", False), ("external", "External", "Classes", "group", False), ("ambiguous", "Ambiguous", "Others", "group", False),
    ("unresolved", "Unresolved", "Others", "group", False), ("trivial", "Trivials", "Methods", "node", False),
]


@dataclass
class FileTables:
    """Tables that each file makes by itself; calls need the other files of their application too."""

    symbols: DataFrame
    notes: DataFrame
    routes: DataFrame
    calls: DataFrame | None = None


@dataclass
class FrameworkIndex:
    """B12."""

    endpoints: DataFrame
    nodes: DataFrame
    edges: DataFrame
    diagnostics: DataFrame
    tables: FileTables | None = None


def node_filters(spark) -> DataFrame:
    rows = [(*f, i) for i, f in enumerate(NODE_FILTERS)]
    return spark.createDataFrame(rows, "id string, label string, section string, target string, default_selected boolean, ord int")


def in_scope(facts: DataFrame, applications: DataFrame) -> DataFrame:
    """Facts of known applications in one of their namespaces or below ('' takes all)."""
    a = applications.select(F.col("id").alias("application_id"), "source_namespaces")
    ns = F.coalesce("namespace_name", F.lit(""))
    inside = F.exists("source_namespaces", lambda n: (n == "") | (ns == n) | F.startswith(ns, F.concat(n, F.lit("."))))
    return facts.join(a, "application_id").filter(inside).drop("source_namespaces")


def qualified_annotations(symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """(application_id, uri, id, pos, qualified, arguments) of every annotation of every symbol."""
    rows = symbols.select("application_id", "uri", "namespace_name", "id", F.posexplode("annotations").alias("pos", "a")).select("application_id", "uri", "namespace_name", "id", "pos", F.col("a.name").alias("written"), F.col("a.arguments").alias("arguments"))
    plain = imports.filter("not is_static and not is_wildcard").select("application_id", "uri", "ord", F.substring_index("qualified_name", ".", -1).alias("written"), F.col("qualified_name").alias("explicit"))
    plain = ranked_first(plain, ["application_id", "uri", "written"], ["ord"]).drop("ord")
    known = F.array(*map(F.lit, sorted(SUPPORTED)))
    wild = imports.filter("not is_static and is_wildcard").select("application_id", "uri", "ord", F.explode(known).alias("wild"), "qualified_name")
    wild = wild.filter(F.regexp_replace("wild", r"\.[^.]+$", "") == F.col("qualified_name")).withColumn("written", F.substring_index("wild", ".", -1)).drop("qualified_name")
    wild = ranked_first(wild, ["application_id", "uri", "written"], ["ord"]).drop("ord")
    keys = ["application_id", "uri", "written"]
    full = F.when(F.contains("written", F.lit(".")), F.col("written")).otherwise(F.coalesce("explicit", "wild", F.concat_ws(".", "namespace_name", "written")))
    return rows.join(plain, keys, "left").join(wild, keys, "left").select("application_id", "uri", "id", "pos", full.alias("qualified"), "arguments")


def type_roles(symbols: DataFrame, notes: DataFrame) -> DataFrame:
    """X11: the role of each type from its first annotation that has one, else helper."""
    role = F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv))
    found = notes.withColumn("role", F.try_element_at(role, F.col("qualified"))).filter("role is not null").groupBy("application_id", "id").agg(F.min_by("role", "pos").alias("role"))
    return symbols.filter("kind = 'type'").select("application_id", "id").join(found, ["application_id", "id"], "left").withColumn("role", F.coalesce("role", F.lit("helper")))


def mappings(notes: DataFrame) -> DataFrame:
    """(application_id, id, methods, paths) of every mapping annotation."""
    fixed = F.create_map(*(F.lit(x) for kv in FIXED_METHODS.items() for x in kv))
    rows = notes.filter(F.col("qualified").isin([*FIXED_METHODS, REQUEST_MAPPING]))
    method = F.try_element_at(F.filter("arguments", lambda a: a["name"] == "method"), F.lit(1))["expression"]
    asked = F.coalesce(T.request_methods(method), F.array().cast("array<string>"))
    paths = T.unique_sorted(T.named_argument_literals("arguments", ["path", "value", None]))
    return rows.select(
        "application_id", "id",
        F.when(F.col("qualified") != REQUEST_MAPPING, F.array(F.try_element_at(fixed, F.col("qualified")))).when(F.size(asked) == 0, F.array(F.lit("ANY"))).otherwise(T.unique_sorted(asked)).alias("methods"),
        F.when(F.size(paths) == 0, F.array(F.lit(""))).otherwise(paths).alias("paths"),
    )


def build_endpoints(symbols: DataFrame, notes: DataFrame, roles: DataFrame) -> DataFrame:
    """Endpoints with all class paths before all method paths."""
    key = ["application_id", "handler"]
    found = mappings(notes)
    methods = symbols.filter("kind = 'method'").select("application_id", F.col("id").alias("handler"), F.col("owner_symbol_id").alias("controller"), "loc")
    methods = methods.join(roles.filter("role = 'controller'").select("application_id", F.col("id").alias("controller")), ["application_id", "controller"])
    body = notes.filter(F.col("qualified") == RESPONSE_BODY).select("application_id", F.col("id").alias("handler")).distinct().withColumn("own_body", F.lit(True))
    shown = notes.filter(F.col("qualified").isin([*CONTROLLERS, RESPONSE_BODY])).select("application_id", F.col("id").alias("controller")).distinct().withColumn("shown", F.lit(True))
    methods = methods.join(body, key, "left").join(shown, ["application_id", "controller"], "left").filter("own_body or shown")
    own = found.select("application_id", F.col("id").alias("handler"), F.col("methods").alias("own_methods"), F.col("paths").alias("own_paths"))
    above = found.select("application_id", F.col("id").alias("controller"), F.col("methods").alias("class_methods"), F.col("paths").alias("class_paths"))
    j = methods.join(own, key).join(above, ["application_id", "controller"], "left")
    j = j.withColumn("class_methods", F.coalesce("class_methods", F.array(F.lit("ANY")))).withColumn("class_paths", F.coalesce("class_paths", F.array(F.lit(""))))
    limited = F.filter("class_methods", lambda m: m != "ANY")
    combined = F.when(F.array_contains("own_methods", "ANY") & (F.size(limited) > 0), limited).otherwise(F.col("own_methods"))
    paths = F.flatten(F.transform("class_paths", lambda c: F.transform("own_paths", lambda p: T.join_http_path(c, p))))
    g = j.groupBy("application_id", "controller", "handler").agg(F.first("loc").alias("loc"), T.unique_sorted(F.flatten(F.collect_list(combined))).alias("http_methods"), T.unique_sorted(F.flatten(F.collect_list(paths))).alias("paths"), T.unique_sorted(F.flatten(F.collect_list("class_paths"))).alias("base_paths"), T.unique_sorted(F.flatten(F.collect_list("own_paths"))).alias("method_paths"))
    return g.select(T.stable_id("codeflow:endpoint", F.col("handler")).alias("id"), "application_id", F.col("controller").alias("controller_symbol_id"), F.col("handler").alias("handler_symbol_id"), "http_methods", "paths", "base_paths", "method_paths", "loc")


def _table_names(notes: DataFrame) -> DataFrame:
    """Tables of entities: names, or each schema with each name."""
    rows = notes.filter(F.col("qualified").isin(list(ENTITY_TABLES)))
    names, schemas = T.named_argument_literals("arguments", ["name"]), T.named_argument_literals("arguments", ["schema"])
    product = F.when(F.size(schemas) == 0, names).otherwise(F.flatten(F.transform(schemas, lambda s: F.transform(names, lambda n: F.concat_ws(".", s, n)))))
    return rows.groupBy("application_id", "id").agg(T.unique_sorted(F.flatten(F.collect_list(product))).alias("entity_tables"))


def _client_urls(notes: DataFrame) -> DataFrame:
    """Addresses of HTTP clients, each URL with each path."""
    rows = notes.filter(F.col("qualified") == FEIGN_CLIENT)
    urls, paths = T.named_argument_literals("arguments", ["url"]), T.named_argument_literals("arguments", ["path"])
    product = F.when(F.size(paths) == 0, urls).otherwise(F.flatten(F.transform(urls, lambda u: F.transform(paths, lambda p: T.append_url_path(u, p)))))
    return rows.groupBy("application_id", "id").agg(T.unique_sorted(F.flatten(F.collect_list(product))).alias("http_client_urls"))


def build_nodes(symbols: DataFrame, notes: DataFrame, roles: DataFrame, endpoints: DataFrame) -> DataFrame:
    """A node for each type, method and constructor."""
    given = symbols.filter("kind = 'parameter'").groupBy("application_id", F.col("owner_symbol_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("param_index", F.col("symbol.name").alias("name"), F.col("declared_type").alias("type")))), lambda p: F.struct(p["name"].alias("name"), p["type"].alias("type"))).alias("parameters"))
    rows = symbols.filter("kind in ('type', 'method', 'constructor')").withColumn("type_id", F.when(F.col("kind") == "type", F.col("id")).otherwise(F.col("owner_symbol_id")))
    key = ["application_id", "id"]
    routes = endpoints.select("application_id", F.col("handler_symbol_id").alias("id"), F.col("base_paths").alias("endpoint_base_paths"), F.col("method_paths").alias("endpoint_method_paths"))
    calls = mappings(notes).groupBy("application_id", "id").agg(T.unique_sorted(F.flatten(F.collect_list("methods"))).alias("client_methods"), T.unique_sorted(F.flatten(F.collect_list("paths"))).alias("client_paths"))
    j = rows.join(roles.select("application_id", F.col("id").alias("type_id"), "role"), ["application_id", "type_id"], "left")
    for side in (given, routes, _table_names(notes), _client_urls(notes), calls):
        j = j.join(side, key, "left")
    client = F.col("role") == "httpClient"
    low = F.col("method_behavior").isNotNull()
    return j.select(
        "id", F.coalesce("role", F.lit("helper")).alias("role"), F.array_compact(F.array(F.coalesce("role", F.lit("helper")), F.when(low, "trivial"))).alias("filter_ids"), (F.col("kind") == "type").alias("group_node"),
        F.lit(True).alias("requires_source_location"), F.lit(False).alias("unresolved"), "symbol", "loc",
        F.struct(
            "application_id", "declared_type", "owner_symbol_id", "namespace_name", F.col("kind").alias("symbol_kind"), F.coalesce("parameters", F.array().cast("array<struct<name:string,type:string>>")).alias("parameters"), "endpoint_base_paths", "endpoint_method_paths",
            F.when(F.col("role") == "entity", F.col("entity_tables")).alias("entity_tables"), F.when(client, F.col("http_client_urls")).alias("http_client_urls"), F.when(client, F.col("client_methods")).alias("http_client_http_methods"), F.when(client, F.col("client_paths")).alias("http_client_paths"),
            F.when(low, "low").alias("graph_signal"), F.col("method_behavior").alias("simplification_reason"), "implicit", "generated_by",
        ).alias("metadata"),
    )


def fallback_nodes(calls: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """B2: (calls with the id of a stand-in as target, nodes of the stand-ins): an owner and a member for each call
    without a candidate; external under a dotted owner, ambiguous under a bare one, unresolved without any."""
    open_ = calls.filter("target_id is null")
    owner = F.coalesce("fallback_owner", F.concat(F.lit("unknown#"), "member_name"))
    role = F.when(F.col("fallback_owner").isNull(), "unresolved").when(F.contains("fallback_owner", F.lit(".")), "external").otherwise("ambiguous")
    made = F.col("kind") == "constructor"
    types = F.transform("argument_types", lambda t: F.coalesce(t, F.lit("unknown")))
    rows = open_.withColumns({"owner": owner, "role": role}).withColumn("place", F.concat(F.lit("<"), "role", F.lit(">"))).withColumn("types", types)
    rows = rows.withColumn("signature", F.concat("owner", F.when(made, F.lit("#constructor(")).otherwise(F.concat(F.lit("#method:"), "member_name", F.lit("("))), F.array_join("types", ","), F.when(made, F.lit(")")).otherwise(F.lit("):"))))
    rows = rows.withColumn("owner_id", T.stable_id("codeflow:symbol", F.col("application_id"), F.col("place"), F.col("owner"))).withColumn("target_id", T.stable_id("codeflow:symbol", F.col("application_id"), F.col("place"), F.col("signature")))
    namespace = F.when(F.contains("owner", F.lit(".")), F.regexp_replace("owner", r"\.[^.]*$", ""))
    empty = nodes.select("metadata").schema["metadata"].dataType
    blank = {f.name: F.lit(None).cast(f.dataType) for f in empty.fields}

    def node(id_: str, group: bool, name, qualified, signature, **meta):
        m = F.struct(*(v.alias(k) for k, v in (blank | {"application_id": F.col("application_id"), "namespace_name": namespace} | meta).items()))
        return rows.select(F.col(id_).alias("id"), "role", F.array("role").alias("filter_ids"), F.lit(group).alias("group_node"), F.lit(False).alias("requires_source_location"), (F.col("role") == "unresolved").alias("unresolved"), F.struct(name.alias("name"), qualified.alias("qualified_name"), signature.alias("signature")).alias("symbol"), F.lit(None).cast(nodes.schema["loc"].dataType).alias("loc"), m.alias("metadata"))

    no_parameters = F.array().cast(empty["parameters"].dataType)
    given = F.transform("types", lambda t, i: F.struct(F.concat(F.lit("arg"), i).alias("name"), t.alias("type")))
    owners = node("owner_id", True, T.simple_name("owner"), F.col("owner"), F.col("owner"), symbol_kind=F.lit("type"), parameters=no_parameters)
    members = node("target_id", False, F.when(made, T.simple_name("owner")).otherwise(F.col("member_name")), F.concat("owner", F.lit("#"), F.when(made, "<init>").otherwise(F.col("member_name"))), F.col("signature"), symbol_kind=F.col("kind"), parameters=given, owner_symbol_id=F.col("owner_id"), declared_type=F.when(made, F.col("owner")))
    kept = rows.select(*calls.columns, "role")
    return kept, ranked_first(owners.unionByName(members), ["id"], ["symbol.signature"])


def build_edges(calls: DataFrame, stand_ins: DataFrame) -> DataFrame:
    """Calls aggregated by source, target and confidence, with their evidence in order."""
    known = calls.filter("target_id is not null").select("application_id", "source_id", "target_id", "confidence", "reason", F.col("candidates").alias("candidate_count"), "uri", "ord", "loc")
    unresolved = F.col("role") == "unresolved"
    rest = stand_ins.select("application_id", "source_id", "target_id", F.when(unresolved, "unresolved").otherwise("inferred").alias("confidence"), "reason", F.when(unresolved, 0).otherwise(1).alias("candidate_count"), "uri", "ord", "loc")
    e = G.aggregate_edges(known.unionByName(rest), ["source_id", "target_id", "confidence"], ["uri", "ord", "reason", "candidate_count", "loc"])
    evidence = F.transform("evidence", lambda x: F.struct(x["reason"].alias("reason"), x["candidate_count"].alias("candidate_count"), x["loc"].alias("loc")))
    return e.select(T.stable_id("codeflow:edge", F.col("source_id"), F.col("target_id"), F.col("confidence")).alias("id"), F.col("source_id").alias("source"), F.col("target_id").alias("target"), "confidence", "occurrence_count", evidence.alias("evidence"))


def exclude(nodes: DataFrame, edges: DataFrame, packages: list[str]) -> tuple[DataFrame, DataFrame]:
    """Without classes named exactly or below 'x.*', and without their edges."""
    if not packages:
        return nodes, edges
    owner = T.owner_name("symbol.qualified_name")
    out = F.lit(False)
    for p in packages:
        out = out | (F.startswith(owner, F.lit(p[:-1])) if p.endswith(".*") else owner == p)
    kept = nodes.filter(~out)
    return kept, G.induced(edges, kept.select("id"))


def last_symbols(symbols: DataFrame) -> DataFrame:
    """Of the symbols of an application with one id the last. Only the ids that occur again are dealt by key (hashes tell
    which can), and whole rows stay where they are."""
    key, at = ["application_id", "id"], F.struct("uri", "ord")
    places = symbols.select(*key, "uri", "ord", F.xxhash64(*key).alias("h"))
    shared = cut(places.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"))
    last = cut(places.join(shared, "h", "left_semi").groupBy(*key).agg(F.max(at).alias("last"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    return symbols.join(last, key, "left").filter(F.col("last").isNull() | (F.col("last") == at)).select(*symbols.columns)


def file_tables(facts: DataFrame) -> FileTables:
    """Symbols, annotations and endpoints of facts in scope."""
    symbols = cut(last_symbols(X.symbols(facts)))
    notes = cut(qualified_annotations(symbols, X.imports(facts)))
    return FileTables(symbols, notes, cut(build_endpoints(symbols, notes, type_roles(symbols, notes))))


def assemble(tables: FileTables, diagnostics: DataFrame, excluded: list[str] | None) -> FrameworkIndex:
    roles = type_roles(tables.symbols, tables.notes)
    nodes = build_nodes(tables.symbols, tables.notes, roles, tables.routes)
    stand_ins, more = fallback_nodes(tables.calls, nodes)
    edges = build_edges(tables.calls, stand_ins)
    nodes, edges = exclude(nodes.unionByName(more), edges, excluded or [])
    return FrameworkIndex(tables.routes.drop("base_paths", "method_paths"), nodes, edges, diagnostics, tables)


def build_index(facts: DataFrame, applications: DataFrame, excluded: list[str] | None = None) -> FrameworkIndex:
    """The index of the facts in scope of their applications."""
    facts = in_scope(facts, applications)
    tables = file_tables(facts)
    tables.calls = cut(resolve_calls(facts).join(tables.symbols.select(F.col("id").alias("source_id")), "source_id", "left_semi"))
    return assemble(tables, X.diagnostics(facts), excluded)


def update_index(old: FileTables, facts: DataFrame, parsed: DataFrame, gone: DataFrame, stale: DataFrame, applications: DataFrame, excluded: list[str] | None = None) -> FrameworkIndex:
    """The index of ``facts``, of which ``parsed`` are new, made from the tables of the index before: rows of the files
    ``gone`` (application_id, uri: changed or deleted) are replaced, and calls are resolved again in the new files and in
    the ``stale`` applications. The applications must be those of the index before."""
    facts, parsed = in_scope(facts, applications), in_scope(parsed, applications)
    new, key = file_tables(parsed), ["application_id", "uri"]
    keep = lambda before, after: before.join(gone, key, "left_anti").unionByName(after).select(*before.columns)
    place = lambda df: df.withColumn("uri", F.col("loc.uri"))
    asked = parsed.select(key).unionByName(facts.select(key).join(stale, "application_id", "left_semi")).distinct()
    calls = cut(resolve_calls(facts, asked))
    kept = old.calls.join(gone, key, "left_anti").join(stale, "application_id", "left_anti").select(*old.calls.columns)
    tables = FileTables(keep(old.symbols, new.symbols), keep(old.notes, new.notes), keep(place(old.routes), place(new.routes)).drop("uri"), kept.unionByName(calls))
    return assemble(tables, X.diagnostics(facts), excluded)


__all__ = ["NODE_FILTERS", "FileTables", "FrameworkIndex", "assemble", "build_index", "in_scope", "node_filters", "update_index"]
