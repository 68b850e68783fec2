"""Lookups with precedence: tiers, last and first matches, guards, prefixes, closures."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.snapshots import cut


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows, by column names."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def first_tier(candidates: DataFrame, key: Sequence[str], tier: str = "tier") -> DataFrame:
    """Of each key all rows of its lowest tier, so that ties survive."""
    best = F.min(tier).over(Window.partitionBy(*key))
    return candidates.withColumn("__best", best).filter(F.col(tier) == F.col("__best")).drop("__best")


def tiered_lookup(probe: DataFrame, key: Sequence[str], tiers: Sequence[DataFrame], on: Sequence[Sequence[str]]) -> DataFrame:
    """The probe joined with each tier on its columns; of each probe key the rows of the first tier with a hit."""
    hits = [probe.join(side, list(cols)).withColumn("tier", F.lit(i + 1)) for i, (side, cols) in enumerate(zip(tiers, on, strict=True))]
    return first_tier(union_all(hits), key)


def blocking_lookup(probe: DataFrame, key: Sequence[str], blocker: DataFrame, blocked_on: Sequence[str], found: str, fallback: DataFrame, fall_on: Sequence[str]) -> DataFrame:
    """J1d: a match in ``blocker`` decides, even if its ``found`` column is null; else the fallback is asked."""
    first = probe.join(blocker.withColumn("__hit", F.lit(True)), list(blocked_on), "left")
    decided = first.filter("__hit").filter(F.col(found).isNotNull()).drop("__hit")
    open_ = first.filter("__hit is null").select(*probe.columns).join(fallback, list(fall_on))
    return union_all([decided.withColumn("tier", F.lit(1)), open_.withColumn("tier", F.lit(2))])


def ranked_first(df: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("__n", n).filter("__n = 1").drop("__n")


def last_write_wins(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key that was written last."""
    return ranked_first(df, key, [F.col(c).desc() for c in order])


def first_match(df: DataFrame, key: Sequence[str], value: str, order: str, name: str = "first") -> DataFrame:
    """Of each key the value with the least order."""
    return df.groupBy(*key).agg(F.min_by(value, order).alias(name))


def exactly_one(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key occurs once."""
    return df.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*key))).filter("__n = 1").drop("__n")


def longest_prefix(items: DataFrame, text: str, prefixes: DataFrame, prefix: str, separator: str = "/") -> DataFrame:
    """Each item with the longest prefix that ends at a separator (or is the whole text).

    The prefixes of an item are the texts before its separators, so this is an equi-join on them: no nested loop,
    whatever the number of prefixes."""
    parts = F.split(F.col(text), F.lit(f"\\Q{separator}\\E"))
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), separator))
    probes = items.select(*items.columns, F.explode(F.array_distinct(heads)).alias(prefix))
    return ranked_first(probes.join(prefixes.select(prefix).distinct(), prefix), items.columns, [F.length(prefix).desc()])


def grouped_values(df: DataFrame, key: Sequence[str], order: Sequence[str], name: str = "items") -> DataFrame:
    """A multimap that keeps the order."""
    return df.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*order))).alias(name))


def closure(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """Every (node, ancestor, path) with the least depth; cycles end. ``path`` lists the ordinals walked, so the
    smallest path is the first in depth-first order. Each level is a join; levels are written to the shared folder."""
    edges = edges.select(F.col(child).alias("node"), F.col(parent).alias("ancestor"), *( ["ord"] if "ord" in edges.columns else [F.lit(0).alias("ord")]))
    known = cut(edges.groupBy("node", "ancestor").agg(F.min(F.array("ord")).alias("path")))
    level = known
    step = edges.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("further"), "ord")
    while True:
        new = level.join(step, "ancestor").select("node", F.col("further").alias("ancestor"), F.concat("path", F.array("ord")).alias("path"))
        new = new.filter("node != ancestor").groupBy("node", "ancestor").agg(F.min("path").alias("path"))
        level = cut(new.join(known.select("node", "ancestor"), ["node", "ancestor"], "left_anti"))
        if level.isEmpty():
            return known
        known = cut(known.unionByName(level))


def nearest_along(df: DataFrame, key: Sequence[str], path: str) -> DataFrame:
    """Of each key the row with the smallest path."""
    return ranked_first(df, key, [F.col(path)])


def semi_restrict(df: DataFrame, kept: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """Rows whose columns all refer to kept keys."""
    for c in columns:
        df = df.join(kept.select(F.col(key).alias(c)).distinct(), c, "left_semi")
    return df


def dangling(df: DataFrame, column: str, there: DataFrame, key: str) -> DataFrame:
    """Rows whose reference has no row."""
    return df.join(there.select(F.col(key).alias(column)), column, "left_anti")


def contained_calls(outer: DataFrame, inner: DataFrame, key: Sequence[str], start: str, end: str) -> DataFrame:
    """Pairs of one key in which the inner range lies in the outer one (and is not the same range)."""
    o = outer.select(*key, F.col(start).alias("outer_start"), F.col(end).alias("outer_end"))
    i = inner.select(*key, F.col(start).alias("inner_start"), F.col(end).alias("inner_end"))
    inside = "inner_start >= outer_start and inner_end <= outer_end and not (inner_start = outer_start and inner_end = outer_end)"
    return o.join(i, list(key)).filter(inside)


def latest_before(df: DataFrame, key: Sequence[str], order: Sequence[str], is_source: Column, value: str, name: str) -> DataFrame:
    """For each row the value of the last source row before it in its key."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.last(F.when(is_source, F.col(value)), ignorenulls=True).over(w))


def unique_or_default(df: DataFrame, key: Sequence[str], value: str, default: Column, name: str) -> DataFrame:
    """Of each key its only value, else the default; with a reason."""
    g = df.groupBy(*key).agg(F.count(value).alias("candidates"), F.min(value).alias("__only"))
    return g.select(*key, F.when(F.col("candidates") == 1, F.col("__only")).otherwise(default).alias(name), F.when(F.col("candidates") == 1, "single implementation").when(F.col("candidates") == 0, "no implementation").otherwise("several implementations").alias("reason"), "candidates")


def best_scores(scored: DataFrame, key: Sequence[str], score: str) -> DataFrame:
    """Of each key all rows with the least score; a key whose rows are all rejected (null score) keeps them all."""
    w = Window.partitionBy(*key)
    return scored.withColumn("__best", F.min(score).over(w)).filter(F.col("__best").isNull() | (F.col(score) == F.col("__best"))).drop("__best")


def confidence_class(count: Column, strategy: Column) -> Column:
    """Ambiguous for several candidates, the strategy's confidence for one, unresolved for none."""
    return F.when(count > 1, "ambiguous").when(count == 1, strategy).otherwise("unresolved")
