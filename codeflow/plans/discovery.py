"""Modules, source roots and applications of a workspace."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..javafacts import extract as X
from ..operators.lookup import longest_prefix, ranked_first, union_all
from ..sources.files import GENERATED, markers
from ..sources.snapshots import cut
from .framework import qualified_annotations

BOOT = "org.springframework.boot.autoconfigure.SpringBootApplication"
SCAN = "org.springframework.context.annotation.ComponentScan"
# Codes of the diagnostics of discovery, with their severity and message.
_C = "spring.discovery."
CODES = {
    "invalidWorkspaceUri": ("error", "The workspace URI is not a valid absolute URI."), "fileSearchFailed": ("warning", "A source root holds no readable files."),
    "fileReadFailed": ("warning", "A Java source file could not be read or parsed during discovery."), "invalidSourceRoot": ("warning", "A configured source root is outside the workspace."),
    "noApplications": ("information", "No application entry point was found."), "mavenPomNotFound": ("information", "No pom.xml was found in the workspace."), "gradleBuildNotFound": ("information", "No Gradle build was found in the workspace."),
}


@dataclass
class Request:
    """what a workspace analysis was asked for."""

    workspace_uri: str
    source_roots: list[str] = field(default_factory=list)
    exclude_globs: list[str] = field(default_factory=list)
    include_generated: bool = False

    def fingerprint(self) -> str:
        import json

        return json.dumps([self.workspace_uri, self.source_roots, self.exclude_globs, self.include_generated])


@dataclass
class Discovery:
    applications: DataFrame
    modules: DataFrame
    diagnostics: DataFrame


def gradle_includes(settings: DataFrame, root: str) -> DataFrame:
    """(module, priority) of the projects that settings scripts include, by their projectDir where one is set."""
    clean = settings.withColumn("content", T.without_comments("content")).withColumn("base", F.regexp_replace("uri", "/[^/]+$", ""))
    statements = F.regexp_extract_all("content", F.lit(r"""(?s)\binclude\s*\(?\s*((?:['"][^'"]+['"]\s*,?\s*)+)"""), F.lit(1))
    projects = clean.select("base", "content", F.explode(F.flatten(F.transform(statements, T.quoted_values))).alias("project"))
    moved = clean.select("base", F.explode(F.regexp_extract_all("content", F.lit(r"""(project\(\s*['"][^'"]+['"]\s*\)\.projectDir\s*=\s*[^\n]+)"""), F.lit(1))).alias("line"))
    moved = moved.select("base", F.regexp_extract("line", r"""project\(\s*['"]([^'"]+)['"]""", 1).alias("project"), F.element_at(T.quoted_values(F.regexp_extract("line", r"projectDir\s*=\s*(.*)$", 1)), -1).alias("dir"))
    moved = moved.withColumn("project", F.regexp_replace("project", "^:", ""))
    out = projects.withColumn("project", F.regexp_replace("project", "^:", "")).join(moved, ["base", "project"], "left")
    module = F.concat(F.lit(root), F.lit("/"), T.normalize_relative_uri(F.concat(T.relative_uri_within(F.lit(root), F.concat("base", F.lit("/."))), F.lit("/"), F.coalesce("dir", T.project_directory("project")))))
    return out.select(module.alias("module")).filter(~F.contains("module", F.lit("/../"))).distinct()


def find_modules(files: DataFrame, root: str) -> DataFrame:
    """(module, build): folders of build descriptors and included projects, each once; Gradle goes first."""
    root = root.rstrip("/")
    found = markers(files).withColumn("name", F.element_at(F.split("uri", "/"), -1)).withColumn("module", F.regexp_replace("uri", "/[^/]+$", ""))
    marked = found.select("module", F.when(F.col("name") == "pom.xml", "maven").otherwise("gradle").alias("build"))
    settings = found.filter(F.startswith("name", F.lit("settings.gradle")))
    included = gradle_includes(settings.select("uri", "content"), root).withColumn("build", F.lit("gradle"))
    return ranked_first(marked.unionByName(included), ["module"], ["build"])


def configured_roots(request: Request) -> tuple[list[str], list[str]]:
    """The configured source roots inside of the workspace as URIs, and those outside of it as given."""
    base, inside, outside = request.workspace_uri.rstrip("/"), [], []
    for given in request.source_roots:
        root, parts = given.replace("\\", "/"), []
        absolute = "://" in root
        if absolute and root.rstrip("/") != base and not root.startswith(f"{base}/"):
            outside.append(given)
            continue
        for part in (root[len(base) :] if absolute else root).split("/"):
            if part == ".." and not parts:
                outside.append(given)
                break
            if part == "..":
                parts.pop()
            elif part not in ("", "."):
                parts.append(part)
        else:
            inside.append("/".join([base, *parts]))
    return inside, outside


def source_files(files: DataFrame, modules: DataFrame, request: Request) -> DataFrame:
    """Java files under a source root with their nearest module and source root."""
    java = files.filter(F.endswith("uri", F.lit(".java")))
    for g in request.exclude_globs:
        from ..sources.files import glob_regex

        java = java.filter(~F.rlike(F.coalesce(T.relative_uri_within(F.lit(request.workspace_uri), "uri"), F.lit("")), F.lit(f"^{glob_regex(g)}$")))
    if not request.include_generated:
        inner = F.coalesce(T.relative_uri_within(F.lit(request.workspace_uri), "uri"), F.lit(""))
        java = java.filter(~F.arrays_overlap(F.split(inner, "/"), F.array(*map(F.lit, GENERATED))))
    placed = longest_prefix(java.select("uri"), "uri", modules.select("module"), "module")
    if request.source_roots:
        roots = java.sparkSession.createDataFrame([(r,) for r in configured_roots(request)[0]], "source_root string")
        placed = longest_prefix(placed, "uri", roots, "source_root")
    else:
        placed = placed.withColumn("source_root", F.concat("module", F.lit("/src/main/java"))).filter(F.startswith("uri", F.concat("source_root", F.lit("/"))))
    return java.join(placed, "uri").select("uri", "content", "module", "source_root")


def find_applications(sources: DataFrame, request: Request) -> tuple[DataFrame, DataFrame]:
    """(applications, diagnostics) from the files that name the application annotation at all."""
    candidates = sources.filter(F.contains("content", F.lit("SpringBootApplication")))
    relative = T.relative_uri_within(F.lit(request.workspace_uri), "uri")
    facts = cut(X.extract(candidates.select(F.lit("").alias("application_id"), "uri", relative.alias("relative_uri"), "content")))
    types = X.symbols(facts).filter("kind = 'type' and owner_symbol_id is null")
    notes = qualified_annotations(types, X.imports(facts))
    boot = notes.filter(F.col("qualified") == BOOT).groupBy("id").agg(F.flatten(F.collect_list(T.named_argument_literals("arguments", ["scanBasePackages"]))).alias("boot"))
    scan = notes.filter(F.col("qualified") == SCAN).groupBy("id").agg(F.flatten(F.collect_list(T.named_argument_literals("arguments", ["value", "basePackages", None]))).alias("scan"))
    found = types.join(boot, "id").join(scan, "id", "left").join(sources.select("uri", "module", "source_root"), "uri")
    packages = F.array_distinct(F.concat("boot", F.coalesce("scan", F.array().cast("array<string>"))))
    inner = F.coalesce(F.nullif(T.relative_uri_within(F.lit(request.workspace_uri), F.concat("module", F.lit("/."))), F.lit("")), F.lit("."))
    apps = found.select(
        T.stable_id("codeflow:application", inner, F.col("symbol.qualified_name")).alias("id"), F.col("symbol.name").alias("name"), F.col("module").alias("root_uri"), F.array("source_root").alias("source_roots"),
        F.when(F.size(packages) == 0, F.array(F.coalesce("namespace_name", F.lit("")))).otherwise(packages).alias("source_namespaces"), F.col("symbol").alias("entry_point"), F.col("loc").alias("source_location"),
    )
    return ranked_first(apps, ["id"], ["root_uri"]), X.diagnostics(facts).drop("application_id")


def discover(files: DataFrame, request: Request) -> Discovery:
    """Modules and applications of a workspace, with diagnostics where something is missing."""
    modules = cut(find_modules(files, request.workspace_uri))
    sources = source_files(files, modules, request)
    applications, issues = find_applications(sources, request)
    applications = cut(applications)
    zero, spark = {"line": 0, "column": 0}, files.sparkSession
    said = [("invalidSourceRoot", r) for r in configured_roots(request)[1]]
    if not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", request.workspace_uri):
        said.append(("invalidWorkspaceUri", None))
    elif modules.isEmpty():
        said += [("mavenPomNotFound", None), ("gradleBuildNotFound", None)]
    elif applications.isEmpty():
        said.append(("noApplications", None))
    if request.source_roots:
        used = {r[0] for r in sources.select("source_root").distinct().collect()}  # as many as were configured, at most
        said += [("fileSearchFailed", r) for r in configured_roots(request)[0] if r not in used]
    own = spark.createDataFrame([(_C + c, *CODES[c], uri and {"uri": uri, "start": zero, "end": zero}) for c, uri in said], f"code string, severity string, message string, loc {X.LOC}")
    at = F.struct(F.col("uri").alias("uri"), *(F.struct(F.lit(0).alias("line"), F.lit(0).alias("column")).alias(e) for e in ("start", "end")))
    unread = sources.filter("content is null").select(*(F.lit(x).alias(n) for n, x in zip(("code", "severity", "message"), (_C + "fileReadFailed", *CODES["fileReadFailed"]), strict=True)), at.cast(X.LOC).alias("loc"))
    broken = F.col("code") == "java.parseFailed"
    issues = issues.withColumns({"message": F.when(broken, CODES["fileReadFailed"][1]).otherwise(F.col("message")), "severity": F.when(broken, "warning").otherwise(F.col("severity")), "code": F.when(broken, _C + "fileReadFailed").otherwise(F.col("code"))})
    return Discovery(applications, modules, union_all([own, issues, unread]).dropDuplicates(["code", "message", "loc"]))
