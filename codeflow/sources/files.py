"""Source files as a DataFrame (uri, content), from any path that Spark reads or from memory."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: Folders of generated or built sources.
GENERATED = ("build", "generated", "generated-sources", "out", "target")
BUILD_MARKERS = ("pom.xml", "build.gradle", "build.gradle.kts", "settings.gradle", "settings.gradle.kts")


def glob_regex(glob: str) -> str:
    """A path glob as a regular expression: ** any folders, * and ? inside of a segment, {a,b} a choice."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
            continue
        if glob.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if c == "{" and (end := glob.find("}", i)) > 0:
            out.append("(?:" + "|".join(glob_regex(x) for x in glob[i + 1 : end].split(",")) + ")")
            i = end + 1
            continue
        out.append("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c))
        i += 1
    return "".join(out)


def from_memory(spark: SparkSession, files: Iterable[tuple[str, str]]) -> DataFrame:
    """S5."""
    return spark.createDataFrame(list(files), "uri string, content string")


def from_path(spark: SparkSession, root: str, names: Iterable[str] = ("*.java", *BUILD_MARKERS)) -> DataFrame:
    """All files below a folder whose names match."""
    pattern = "{" + ",".join(names) + "}"
    rows = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    return rows.select(F.regexp_replace(T.decode_component(F.col("_metadata.file_path")), "^file:/+", "file:///").alias("uri"), F.col("value").alias("content"))


def matching(files: DataFrame, root: str, include: str, exclude: Iterable[str] = ()) -> DataFrame:
    """Files below the root that match the glob and none of the others; each uri once."""
    relative = T.relative_uri_within(F.lit(root), "uri")
    out = files.withColumn("relative_uri", relative).filter(F.rlike("relative_uri", F.lit(f"^{glob_regex(include)}$")))
    for e in exclude:
        out = out.filter(~F.rlike("relative_uri", F.lit(f"^{glob_regex(e)}$")))
    return out.dropDuplicates(["uri"])


def markers(files: DataFrame) -> DataFrame:
    """Build descriptors."""
    return files.filter(F.element_at(F.split("uri", "/"), -1).isin(list(BUILD_MARKERS)))


def report(nodes: DataFrame, endpoints: DataFrame) -> str:
    """Roles and endpoints of an index as text."""
    lines = [f"{r['role']}: {r['n']}" for r in nodes.groupBy("role").agg(F.count(F.lit(1)).alias("n")).orderBy("role").collect()]
    lines += [r["label"] for r in endpoints.select(T.endpoint_label("http_methods", "paths").alias("label")).orderBy("label").collect()]
    return "\n".join(lines)


def as_json(df: DataFrame) -> DataFrame:
    """A JSON text for each row; null optional keys are left out."""
    return df.select(F.to_json(F.struct("*")).alias("json"))
