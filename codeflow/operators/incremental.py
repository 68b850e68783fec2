"""Incremental plans and change streams in batch form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lookup import ranked_first


def plan(previous: DataFrame, current: DataFrame, key: str, version: str) -> DataFrame:
    """(key, action) with action reuse, index or delete, from a full outer join on the key."""
    p = previous.select(key, F.col(version).alias("__old"), F.lit(True).alias("__was"))
    c = current.select(key, F.col(version).alias("__new"), F.lit(True).alias("__is"))
    action = F.when(F.col("__is").isNull(), "delete").when(F.col("__was") & F.col("__old").eqNullSafe(F.col("__new")), "reuse").otherwise("index")
    return p.join(c, key, "full").select(key, action.alias("action"))


def split_reuse(previous: DataFrame, current: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(facts of ``previous`` that stay valid, rows of ``current`` to index): valid where all keys agree."""
    return previous.join(current.select(*keys).distinct(), list(keys), "left_semi"), current.join(previous.select(*keys).distinct(), list(keys), "left_anti")


def change_set(events: DataFrame, key: str, order: Sequence[str], deleted: str) -> DataFrame:
    """The last event of each key decides between changed and deleted."""
    return ranked_first(events, [key], [F.col(c).desc() for c in order]).select(key, deleted)


def debounce(events: DataFrame, key: Sequence[str], ts: str, gap_seconds: int) -> DataFrame:
    """Bursts of events: an event ``gap_seconds`` or more after the last one of its key opens a new burst."""
    w = Window.partitionBy(*key).orderBy(ts)
    apart = F.col(ts) - F.lag(ts).over(w) >= F.expr(f"make_dt_interval(0, 0, 0, {gap_seconds})")
    numbered = events.withColumn("burst", F.sum(F.when(apart, 1).otherwise(0)).over(w.rangeBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*key, "burst").agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("n"))


def updated_keys(previous: DataFrame, deleted: DataFrame, created: DataFrame, key: str) -> DataFrame:
    """(previous - deleted) with created."""
    return previous.select(key).join(deleted.select(key), key, "left_anti").union(created.select(key)).distinct()


def merge_diagnostics(analysis: DataFrame, operational: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The new analysis set and the operational ones, once per code, message and place."""
    return analysis.unionByName(operational).dropDuplicates(list(keys))


def discovery_reusable(changes: DataFrame, descriptors: Sequence[str], before: DataFrame, after: DataFrame, key: str = "uri") -> bool:
    """I4: no build descriptor among the changes, and no changed file is or was an application candidate."""
    name = F.element_at(F.split(key, "/"), -1)
    if not changes.filter(name.isin(list(descriptors))).isEmpty():
        return False
    both = before.filter("discovery_candidate").select(key).union(after.filter("discovery_candidate").select(key))
    return changes.join(both, key, "left_semi").isEmpty()
