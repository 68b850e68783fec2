"""Reachability, induced graphs and edge aggregation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.snapshots import cut

#: Edges that one worker may hold for a traversal in memory; larger graphs are traversed level by level.
LOCAL_EDGES = 2_000_000


def aggregate_edges(calls: DataFrame, key: Sequence[str], evidence: Sequence[str]) -> DataFrame:
    """Of each key the number of calls and their evidence in order of the evidence columns."""
    return calls.groupBy(*key).agg(F.count(F.lit(1)).alias("occurrence_count"), F.array_sort(F.collect_list(F.struct(*evidence))).alias("evidence"))


def allowed_edges(nodes: DataFrame, edges: DataFrame, node_allowed: Column | None, edge_allowed: Column | None) -> DataFrame:
    """The edges (source, target) that a traversal may take: allowed themselves and into an allowed node."""
    ends = nodes if node_allowed is None else nodes.filter(node_allowed)
    taken = edges if edge_allowed is None else edges.filter(edge_allowed)
    return taken.join(ends.select(F.col("id").alias("target")), "target", "left_semi").select("source", "target")


def _levels(edges: pa.Table, roots: pa.Table) -> pa.Table:
    """Depths of all nodes reached, by whole levels over an adjacency in compressed rows."""
    m = edges.num_rows
    back, names = pd.factorize(np.concatenate([edges.column("s").to_numpy(), edges.column("t").to_numpy(), roots.column("h").to_numpy()]))
    source, target = back[:m], back[m : 2 * m]
    order = np.argsort(source, kind="stable")
    target, first = target[order], np.searchsorted(source[order], np.arange(len(names) + 1))
    depth = np.full(len(names), -1, np.int32)
    front = np.unique(back[2 * m :])
    depth[front] = level = 0
    while len(front):
        level += 1
        n = first[front + 1] - first[front]
        at = np.repeat(first[front] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        front = np.unique(target[at])
        front = front[depth[front] < 0]
        depth[front] = level
    seen = np.flatnonzero(depth >= 0)
    return pa.table([pa.array(names[seen], pa.int64()), pa.array(depth[seen], pa.int32())], names=["h", "depth"])


def reachable_local(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, depth) from the roots by one worker over hashed ids; any depth. For graphs of LOCAL_EDGES edges at most, so
    that two ids with one 64-bit hash need not be feared."""
    e = edges.select(F.xxhash64("source").alias("s"), F.xxhash64("target").alias("t"), F.lit(0).alias("g"))
    r = roots.select(F.xxhash64("id").alias("h"), F.lit(0).alias("g"))
    found = e.groupBy("g").cogroup(r.groupBy("g")).applyInArrow(_levels, "h long, depth int")
    return nodes.select("id", F.xxhash64("id").alias("h")).distinct().join(found, "h").select("id", "depth")


def reachable_distributed(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, depth) from the roots, a join for each level; levels are written to the shared folder."""
    seen = front = cut(roots.select("id").distinct().withColumn("depth", F.lit(0)))
    level = 0
    while not front.isEmpty():
        level += 1
        new = edges.join(front.select(F.col("id").alias("source")), "source", "left_semi").select(F.col("target").alias("id")).distinct()
        front = cut(new.join(seen, "id", "left_anti").withColumn("depth", F.lit(level)))
        seen = seen.unionByName(front)
    return seen


def reachable(nodes: DataFrame, edges: DataFrame, roots: DataFrame, node_allowed: Column | None = None, edge_allowed: Column | None = None, strategy: str | None = None) -> DataFrame:
    """(id, depth) of everything reached from the roots. Predicates hold inside the traversal: what a pruned node
    leads to is not reached through it; roots are exempt. Nodes without a row are never entered."""
    taken = cut(allowed_edges(nodes, edges, node_allowed, edge_allowed))
    roots = roots.select("id").join(nodes.select("id"), "id", "left_semi")
    if strategy is None:
        strategy = "local" if taken.count() <= LOCAL_EDGES else "distributed"
    return reachable_local(nodes, taken, roots) if strategy == "local" else reachable_distributed(taken, roots)


def induced(edges: DataFrame, reached: DataFrame, edge_allowed: Column | None = None) -> DataFrame:
    """All allowed edges between reached nodes, back edges included."""
    out = edges if edge_allowed is None else edges.filter(edge_allowed)
    for end in ("source", "target"):
        out = out.join(reached.select(F.col("id").alias(end)).distinct(), end, "left_semi")
    return out


def focus(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, strategy: str | None = None) -> DataFrame:
    """Q3: ids of the seeds, their ancestors and their descendants."""
    back = edges.select(F.col("target").alias("source"), F.col("source").alias("target"))
    return reachable(nodes, edges, seeds, strategy=strategy).select("id").union(reachable(nodes, back, seeds, strategy=strategy).select("id")).distinct()


def endpoint_graph(nodes: DataFrame, edges: DataFrame, root_id: str, filters: Sequence[str] = (), confidences: Sequence[str] = (), application: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the graph below a root. An empty list of filters or confidences filters nothing; a node
    passes if all its filter ids are selected. Scoped to the application where the root has one."""
    root = nodes.filter(F.col("id") == root_id).take(1)
    if not root:
        raise ValueError(f"no node {root_id}")
    value = None
    if application:
        value = root[0]
        for part in application.split("."):
            value = value[part]
    if value is not None:
        nodes = nodes.filter(F.col(application) == value)
    edge_ok = F.col("confidence").isin(list(confidences)) if confidences else None
    node_ok = F.size(F.array_except("filter_ids", F.array(*map(F.lit, filters)))) == 0 if filters else None
    reached = cut(reachable(nodes, edges, nodes.sparkSession.createDataFrame([(root_id,)], "id string"), node_ok, edge_ok))
    return nodes.join(reached, "id").orderBy("id"), induced(edges, reached, edge_ok).orderBy("id") if "id" in edges.columns else induced(edges, reached, edge_ok)
