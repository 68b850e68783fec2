"""Workspace analysis, cold or from a change set (I3-I9), and endpoint graphs over its index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..javafacts import extract as X
from ..operators import graph as G
from ..operators import incremental as I
from ..operators import validate as V
from ..sources.files import BUILD_MARKERS
from ..sources.snapshots import SnapshotStore, cut
from .discovery import Discovery, Request, discover
from .framework import FileTables, FrameworkIndex, assemble, build_index, in_scope, update_index

PARSER_ID = "spring-java"
#: Updates after which the tables are written anew, so that plans stay short.
MERGE_AFTER = 8
#: Files that one task parses.
TASK_FILES = 500


@dataclass
class Analysis:
    discovery: Discovery
    facts: DataFrame
    index: FrameworkIndex
    indexed: int
    reused: int
    request: Request | None = None
    inputs: DataFrame | None = None
    updates: int = 0


def read_inputs(files: DataFrame) -> DataFrame:
    """(uri, content_version, discovery_candidate) of files; an unreadable one is a candidate, since discovery reports it."""
    candidate = F.coalesce(F.contains("content", F.lit("SpringBootApplication")), F.lit(True))
    return files.select("uri", T.content_version("content").alias("content_version"), candidate.alias("discovery_candidate"))


def pending_files(files: DataFrame, applications: DataFrame, request: Request) -> DataFrame:
    """A row for each file and application whose source roots hold it."""
    roots = applications.select(F.col("id").alias("application_id"), F.explode("source_roots").alias("root"))
    parts = F.split("uri", "/")
    java = files.filter(F.endswith("uri", F.lit(".java")))
    heads = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    held = java.withColumn("root", F.explode(heads)).join(roots, "root").dropDuplicates(["application_id", "uri"])
    return held.select("application_id", "uri", T.relative_uri_within(F.lit(request.workspace_uri), "uri").alias("relative_uri"), "content")


def parse(pending: DataFrame, files: int) -> DataFrame:
    """Facts of pending files, dealt out by their number: sources are small beside their facts, so a task's share is not
    left to the size of the sources."""
    dealt = pending.repartition(max(1, -(-files // TASK_FILES)), "uri")
    return cut(X.extract(dealt).withColumn("shape", X.shape()))


def analyze(files: DataFrame, request: Request, previous: Analysis | DataFrame | None = None, excluded: list[str] | None = None, changes: DataFrame | None = None) -> Analysis:
    """A workspace analysis. With a ``previous`` one of the same request, only changed files are parsed, discovery is
    repeated only where a change can concern it, and the index is brought up to date from its tables; with facts alone
    the unchanged (application, file, content) rows are kept and the index is built anew.

    ``changes`` (uri, deleted), a row for each file that may have changed, spares reading the other files; without it all
    contents are compared by their digests."""
    if isinstance(previous, Analysis):
        if previous.request == request and previous.index.tables is not None:
            return update(files, request, previous, excluded, changes)
        previous = previous.facts if previous.request == request else None
    inputs = cut(read_inputs(files))
    found = discover(files, request)
    pending = pending_files(files, found.applications, request)
    if previous is None:
        facts = parse(pending, inputs.count())
        return Analysis(found, facts, build_index(facts, found.applications, excluded), facts.count(), 0, request, inputs)
    pending = pending.withColumn("content_version", T.content_version("content"))
    kept, new = I.split_reuse(previous, pending, ["application_id", "uri", "content_version"])
    kept, parsed = cut(kept.select(*previous.columns)), parse(new.drop("content_version"), inputs.count())
    facts = kept.unionByName(parsed)
    return Analysis(found, facts, build_index(facts, found.applications, excluded), parsed.count(), kept.count(), request, inputs)


def update(files: DataFrame, request: Request, before: Analysis, excluded: list[str] | None = None, changes: DataFrame | None = None) -> Analysis:
    """The analysis of changed files by the tables of the one before."""
    if changes is None:
        seen = cut(read_inputs(files))
        changes = I.plan(before.inputs, seen, "uri", "content_version").filter("action <> 'reuse'").select("uri", (F.col("action") == "delete").alias("deleted"))
    changes = cut(changes.select("uri", "deleted").distinct())
    present = files.join(changes.filter("not deleted"), "uri", "left_semi")
    now = cut(read_inputs(present))
    inputs = before.inputs.join(changes, "uri", "left_anti").unionByName(now)
    moved = changes.join(before.inputs.select("uri", F.lit(True).alias("was")), "uri", "left").filter("deleted or was is null")
    if not I.discovery_reusable(changes, BUILD_MARKERS, before.inputs, now) or (request.source_roots and not moved.isEmpty()):
        return analyze(files, request, before.facts, excluded)
    found, key = before.discovery, ["application_id", "uri"]
    pending = pending_files(present, found.applications, request)
    versions = before.facts.select(*key, "content_version", "shape").join(changes.select("uri"), "uri", "left_semi")
    new = pending.withColumn("content_version", T.content_version("content")).join(versions, [*key, "content_version"], "left_anti").drop("content_version")
    parsed = cut(X.extract(new).withColumn("shape", X.shape()))
    deleted = versions.join(changes.filter("deleted"), "uri", "left_semi").select(key)
    gone = cut(parsed.select(key).unionByName(deleted).distinct())
    left = before.facts.join(gone, key, "left_anti").select(*before.facts.columns)
    same = parsed.join(versions, [*key, "shape"], "left_semi").select(key)
    stale = cut(gone.join(same, key, "left_anti").select("application_id").distinct())
    facts = left.unionByName(parsed)
    index = update_index(before.index.tables, facts, parsed, gone, stale, found.applications, excluded)
    indexed = parsed.count()
    out = Analysis(found, facts, index, indexed, facts.count() - indexed, request, inputs, before.updates + 1)
    return merged(out, excluded) if out.updates >= MERGE_AFTER else out


def merged(a: Analysis, excluded: list[str] | None = None) -> Analysis:
    """The same analysis with its tables written anew."""
    t = a.index.tables
    tables, facts = FileTables(cut(t.symbols), cut(t.notes), cut(t.routes), cut(t.calls)), cut(a.facts)
    index = assemble(tables, X.diagnostics(in_scope(facts, a.discovery.applications)), excluded)
    return Analysis(a.discovery, facts, index, a.indexed, a.reused, a.request, cut(a.inputs))


def publish(store: SnapshotStore, request: Request, analysis: Analysis) -> int:
    """Everything of an analysis becomes visible at once."""
    spark = analysis.facts.sparkSession
    state = spark.createDataFrame([(PARSER_ID, request.fingerprint())], "parser_id string, request_fingerprint string")
    i, d = analysis.index, analysis.discovery
    tables = {"state": state, "facts": analysis.facts, "applications": d.applications, "endpoints": i.endpoints, "nodes": i.nodes, "edges": i.edges, "diagnostics": i.diagnostics}
    if i.tables is not None and analysis.inputs is not None:
        tables |= {"inputs": analysis.inputs, "modules": d.modules, "discovery_diagnostics": d.diagnostics, "symbols": i.tables.symbols, "notes": i.tables.notes, "routes": i.tables.routes, "calls": i.tables.calls}
    return store.publish(tables)


def _published(store: SnapshotStore, request: Request) -> dict[str, DataFrame] | None:
    tables = store.load()
    if tables is None:
        return None
    state = tables["state"].first()
    return tables if (state["parser_id"], state["request_fingerprint"]) == (PARSER_ID, request.fingerprint()) else None


def previous_facts(store: SnapshotStore, request: Request) -> DataFrame | None:
    """Facts of the last published analysis, if it was made for the same request by the same parser."""
    tables = _published(store, request)
    return tables and tables["facts"]


def previous_analysis(store: SnapshotStore, request: Request, excluded: list[str] | None = None) -> Analysis | None:
    """The last published analysis with all that an update needs."""
    t = _published(store, request)
    if t is None or "calls" not in t:
        return None
    found = Discovery(t["applications"], t["modules"], t["discovery_diagnostics"])
    index = assemble(FileTables(t["symbols"], t["notes"], t["routes"], t["calls"]), t["diagnostics"], excluded)
    return Analysis(found, t["facts"], index, 0, t["facts"].count(), request, t["inputs"])


def endpoint_graph(index: FrameworkIndex, endpoint_id: str, filters: list[str] | None = None, confidences: list[str] | None = None, validate: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes with depth, edges) below an endpoint's handler."""
    found = index.endpoints.filter(F.col("id") == endpoint_id).take(1)
    if not found:
        raise ValueError(f"no endpoint {endpoint_id}")
    nodes, edges = G.endpoint_graph(index.nodes, index.edges, found[0]["handler_symbol_id"], filters or [], confidences or [], application="metadata.application_id")
    nodes, edges = cut(nodes), cut(edges)
    if validate:
        V.raise_if_invalid(V.validate_graph(nodes.withColumn("ord", F.monotonically_increasing_id()), edges.withColumn("ord", F.monotonically_increasing_id())))
    return nodes, edges
