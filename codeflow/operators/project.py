"""Projections of a result graph: grouping, visibility, search, counts, catalog, order, layout model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def group_members(rows: DataFrame, key: Sequence[str], member: str, order: Sequence[str], filters: str | None = None, root: str | None = None) -> DataFrame:
    """A4: groups with their members in order, the union of filter ids and whether the root is among them; groups
    without members fall out."""
    aggs = [F.array_sort(F.collect_list(F.when(F.col(member).isNotNull(), F.struct(*order, member)))).alias("members")]
    if filters:
        aggs.append(F.array_sort(F.array_distinct(F.flatten(F.collect_list(filters)))).alias("filter_ids"))
    if root:
        aggs.append(F.bool_or(root).alias("is_root"))
    return rows.groupBy(*key).agg(*aggs).filter(F.size("members") > 0)


def group_graph(nodes: DataFrame, edges: DataFrame, root_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Q1: (groups, nodes, edges) by owning type; groups without methods go, and their nodes and edges with them.
    nodes: id, qualified_name, owner_symbol_id, group_node, filter_ids."""
    owner = F.coalesce("owner_symbol_id", F.when(F.contains("qualified_name", F.lit("#")), T.owner_name("qualified_name")), F.when(F.col("group_node"), F.col("id")), F.col("id"))
    keyed = nodes.withColumn("group_id", T.stable_id("group", owner)).withColumn("is_root", F.col("id") == root_id)
    methods = keyed.filter("not group_node")
    groups = methods.groupBy("group_id").agg(F.array_sort(F.collect_list("id")).alias("methods"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("filter_ids")))).alias("filter_ids"), F.bool_or("is_root").alias("is_root"))
    kept = keyed.join(groups.select("group_id"), "group_id", "left_semi")
    ends = edges
    for end in ("source", "target"):
        ends = ends.join(kept.select(F.col("id").alias(end)), end, "left_semi")
    return groups, kept, ends


def _selected(filter_ids: Column, targets: Sequence[str], selected: Sequence[str]) -> Column:
    own = F.array_intersect(filter_ids, F.array(*map(F.lit, targets)).cast("array<string>"))
    return F.size(F.array_except(own, F.array(*map(F.lit, selected)).cast("array<string>"))) == 0


def visible(groups: DataFrame, methods: DataFrame, key: str, group_filters: Sequence[str], node_filters: Sequence[str], selected: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Q2: a group shows if all its group filters are selected, a method if all its node filters are and its group
    shows; a group without a visible method does not show. The root is not exempt."""
    shown = groups.filter(_selected(F.col("filter_ids"), group_filters, selected))
    left = methods.filter(_selected(F.col("filter_ids"), node_filters, selected)).join(shown.select(key), key, "left_semi")
    return shown.join(left.select(key).distinct(), key, "left_semi"), left


def filter_counts(rows: DataFrame, filters: str) -> DataFrame:
    """A3: how many rows carry each filter id."""
    return rows.select(F.explode(filters).alias("filter_id")).groupBy("filter_id").agg(F.count(F.lit(1)).alias("n"))


def histogram(rows: DataFrame, column: str) -> DataFrame:
    """A5."""
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def search(rows: DataFrame, name: str, query: str, order: Sequence[str] = ()) -> DataFrame:
    """Q4: rows whose name holds the query, regardless of case and outer blanks; an empty query finds nothing."""
    q = query.strip().lower()
    found = rows.filter(F.contains(F.lower(name), F.lit(q))) if q else rows.limit(0)
    return found.orderBy(*order) if order else found


def next_match(current: int, step: int, n: int) -> int:
    """Q5: the cursor moves in a circle."""
    return -1 if n <= 0 else (current + step) % n if current >= 0 else (0 if step > 0 else n - 1)


def default_filters(filters: DataFrame) -> DataFrame:
    """Q6: by section the number of filters and of those selected by default."""
    return filters.groupBy("section").agg(F.count(F.lit(1)).alias("n"), F.count_if("default_selected").alias("selected"))


def distinct_values(rows: DataFrame, key: str, values: str) -> DataFrame:
    """Q7: the distinct sorted values of each group."""
    return rows.groupBy(key).agg(T.unique_sorted(F.flatten(F.collect_list(values))).alias(values))


def dimmed(rows: DataFrame, active: DataFrame, key: str = "id") -> DataFrame:
    """Q8: a flag for rows outside of the active ids (none active: nothing is dimmed)."""
    marked = rows.join(active.select(key).distinct().withColumn("__on", F.lit(True)), key, "left")
    return marked.withColumn("dimmed", F.col("__on").isNull()).drop("__on") if not active.isEmpty() else rows.withColumn("dimmed", F.lit(False))


def method_order(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The place of each row in its group."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(*(F.asc_nulls_last(c) for c in order))))


def catalog(applications: DataFrame, controllers: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Application -> controller -> endpoint with counts; applications without endpoints stay.
    applications: app_id, app_name; controllers: controller_id, controller_name; endpoints: app_id, controller_id, label."""
    c = endpoints.join(controllers, "controller_id", "left").withColumn("controller_name", F.coalesce("controller_name", F.col("controller_id").cast("string")))
    c = c.groupBy("app_id", "controller_id", "controller_name").agg(F.array_sort(F.collect_list("label")).alias("endpoints"))
    a = c.groupBy("app_id").agg(F.array_sort(F.collect_list(F.struct("controller_name", "controller_id", "endpoints"))).alias("controllers"), F.sum(F.size("endpoints")).alias("endpoint_count"))
    return applications.join(a, "app_id", "left").select("app_id", "app_name", F.coalesce("controllers", F.array()).alias("controllers"), F.coalesce("endpoint_count", F.lit(0)).alias("endpoint_count"))


def layout_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """L1, L3: edges between the shown boxes (a type's node stands for its group), with label and class."""
    box = nodes.select("id", F.when(F.col("group_node"), F.col("group_id")).otherwise(F.col("id")).alias("box"))
    s, t = box.select(F.col("id").alias("source"), F.col("box").alias("source_box")), box.select(F.col("id").alias("target"), F.col("box").alias("target_box"))
    return edges.join(s, "source").join(t, "target").withColumn("label", F.when(F.col("occurrence_count") > 1, F.concat(F.lit("×"), F.col("occurrence_count"))).otherwise(F.lit(""))).withColumn("class", F.concat(F.lit("edge-"), F.col("confidence")))


def layout_boxes(nodes: DataFrame, groups: DataFrame, width: int = 260, row: int = 28, head: int = 44) -> DataFrame:
    """L1: a box for each group with its size and children."""
    return groups.select("group_id", F.size("methods").alias("rows"), F.lit(width).alias("width"), (F.lit(head) + F.size("methods") * row).alias("height"), "methods")


def colour_index(filter_ids: Column, ordered_filters: Sequence[str], colours: int = 10) -> Column:
    """L4: the place of the first known filter in the list of filters, modulo the number of colours."""
    places = F.transform(F.filter(filter_ids, lambda f: f.isin(list(ordered_filters))), lambda f: F.array_position(F.array(*map(F.lit, ordered_filters)), f))
    return F.when(F.size(places) > 0, F.pmod(F.array_min(places) - 1, F.lit(colours))).otherwise(F.lit(0)).cast("int")


def polyline_midpoint(points: DataFrame, key: str, order: str, x: str, y: str) -> DataFrame:
    """The point half-way along each polyline."""
    w = Window.partitionBy(key).orderBy(order)
    seg = points.withColumn("px", F.lag(x).over(w)).withColumn("py", F.lag(y).over(w)).withColumn("len", F.coalesce(F.hypot(F.col(x) - F.col("px"), F.col(y) - F.col("py")), F.lit(0.0)))
    seg = seg.withColumn("done", F.sum("len").over(w)).withColumn("total", F.sum("len").over(Window.partitionBy(key)))
    hit = seg.filter("px is not null and done >= total / 2").withColumn("n", F.row_number().over(w)).filter("n = 1")
    share = F.when(F.col("len") > 0, 1 - (F.col("done") - F.col("total") / 2) / F.col("len")).otherwise(F.lit(0.0))
    return hit.select(key, (F.col("px") + (F.col(x) - F.col("px")) * share).alias("mid_x"), (F.col("py") + (F.col(y) - F.col("py")) * share).alias("mid_y"))
