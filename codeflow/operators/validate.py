"""Data-quality checks of graphs: every check gives rows of (code, message, path, related_ids)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lookup import union_all


def _issue(df: DataFrame, code: str, message: str, path: Column, *related: Column) -> DataFrame:
    return df.select(F.lit(code).alias("code"), F.lit(message).alias("message"), path.cast("string").alias("path"), F.array(*(r.cast("string") for r in related)).alias("related_ids"))


def repeated(df: DataFrame, key: str, order: str) -> DataFrame:
    """V1, V5: every row of a key after the first."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("__n > 1").drop("__n")


def invalid_range(loc: str) -> Column:
    """V3: whether a location (uri, start, end as zero-based line and column) is invalid; structs compare in order."""
    c = F.col(loc)
    bad = (F.coalesce(c["uri"], F.lit("")) == "") | (c["end"] < c["start"])
    for end in ("start", "end"):
        for part in ("line", "column"):
            bad = bad | c[end][part].isNull() | (c[end][part] < 0)
    return c.isNotNull() & bad


def count_mismatch(count: str, evidence: str) -> Column:
    """V7: a count that is not positive or not the number of pieces of evidence, or no evidence."""
    return F.col(count).isNull() | (F.col(count) <= 0) | (F.col(count) != F.size(evidence)) | (F.size(evidence) <= 0)


def candidate_mismatch(confidence: Column, candidates: Column) -> Column:
    """V8: ambiguous needs two candidates or more, exact and inferred one, unresolved none."""
    return F.when(confidence == "ambiguous", candidates < 2).when(confidence.isin("exact", "inferred"), candidates != 1).when(confidence == "unresolved", candidates != 0).otherwise(F.lit(True))


def validate_graph(nodes: DataFrame, edges: DataFrame, diagnostics: DataFrame | None = None) -> DataFrame:
    """V1-V9 as one frame of issues. nodes: ord, id, requires_source_location, unresolved, loc; edges: ord, id, source,
    target, confidence, occurrence_count, evidence (array of structs with candidate_count and loc)."""
    node = lambda *p: F.concat(F.lit("nodes["), F.col("ord"), F.lit("]"), *map(F.lit, p))
    edge = lambda *p: F.concat(F.lit("edges["), F.col("ord"), F.lit("]"), *map(F.lit, p))
    found = [
        _issue(repeated(nodes, "id", "ord"), "duplicateNodeId", "node id occurs before", node(".id"), F.col("id")),
        _issue(nodes.filter("requires_source_location and loc is null"), "missingSourceLocation", "node needs a source location", node(".loc"), F.col("id")),
        _issue(nodes.filter(invalid_range("loc")), "invalidSourceLocation", "source location is invalid", node(".loc"), F.col("id")),
        _issue(nodes.filter("unresolved").join(edges.select(F.col("source").alias("id")).distinct(), "id", "left_semi"), "unresolvedNodeHasOutgoingEdge", "unresolved node has an outgoing edge", node(), F.col("id")),
        _issue(repeated(edges, "id", "ord"), "duplicateEdgeId", "edge id occurs before", edge(".id"), F.col("id")),
    ]
    for end in ("source", "target"):
        missing = edges.join(nodes.select(F.col("id").alias(end)), end, "left_anti")
        found.append(_issue(missing, f"dangling{end.capitalize()}", f"{end} node does not exist", edge("." + end), F.col("id"), F.col(end)))
    found.append(_issue(edges.filter(count_mismatch("occurrence_count", "evidence")), "invalidOccurrenceCount", "count and evidence differ", edge(".occurrenceCount"), F.col("id")))
    each = edges.select("ord", "id", "confidence", F.posexplode("evidence").alias("i", "e"))
    piece = lambda p: F.concat(edge(".evidence["), F.col("i"), F.lit("]" + p))
    found.append(_issue(each.filter(candidate_mismatch(F.col("confidence"), F.col("e")["candidate_count"])), "inconsistentCandidateCount", "candidate count does not fit the confidence", piece(".candidateCount"), F.col("id")))
    found.append(_issue(each.select("ord", "id", "i", F.col("e")["loc"].alias("loc")).filter(invalid_range("loc")), "invalidSourceLocation", "source location is invalid", piece(".loc"), F.col("id")))
    ends = edges.join(nodes.groupBy("id").agg(F.bool_or("unresolved").alias("end_unresolved")).withColumnRenamed("id", "target"), "target", "left")
    found.append(_issue(ends.filter(~(F.col("confidence") == "unresolved").eqNullSafe(F.col("end_unresolved"))), "inconsistentUnresolvedTarget", "confidence and target differ about being unresolved", edge(), F.col("id"), F.col("target")))
    if diagnostics is not None:
        rows = diagnostics.filter(invalid_range("loc"))
        found.append(_issue(rows, "invalidSourceLocation", "source location is invalid", F.concat(F.lit("diagnostics["), F.col("ord"), F.lit("].loc"))))
    return union_all(found)


def raise_if_invalid(issues: DataFrame, most: int = 50) -> None:
    """An error that lists the first issues."""
    rows = issues.limit(most).collect()
    if rows:
        raise ValueError("invalid graph: " + "; ".join(f"{r['code']} at {r['path']} ({', '.join(x or '' for x in r['related_ids'])})" for r in rows))


def validate_message(endpoint_id: Column, graph_endpoint_id: Column, filters: Column, node_filters: Column) -> Column:
    """The first fault of a graph message, or null: ids agree, filter ids are unique, nodes use known filters."""
    return (
        F.when(~endpoint_id.eqNullSafe(graph_endpoint_id), "endpoint ids differ")
        .when(F.size(F.array_distinct(filters)) != F.size(filters), "filter ids repeat")
        .when(F.size(F.array_except(F.flatten(node_filters), filters)) > 0, "unknown filter id")
    )
