"""Sessions over a workspace: technologies, generations that cancel each other, publication, operational diagnostics."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.incremental import merge_diagnostics
from ..sources.files import BUILD_MARKERS
from ..sources.snapshots import SnapshotStore
from . import workspace as W
from .discovery import Discovery, Request
from .framework import FrameworkIndex


class Discoverer(Protocol):
    """Finds the applications of a workspace."""

    def __call__(self, files: DataFrame, request: Request) -> Discovery: ...


class FactIndexer(Protocol):
    """Makes file_facts of files (application_id, uri, relative_uri, content)."""

    def __call__(self, files: DataFrame) -> DataFrame: ...


class FrameworkAdapter(Protocol):
    """Builds the index from facts and applications."""

    def __call__(self, facts: DataFrame, applications: DataFrame, excluded: list[str] | None = None) -> FrameworkIndex: ...


@dataclass
class Technology:
    """What a language needs: a name, descriptors that show a workspace of it, column predicates, an analysis."""

    name: str
    markers: tuple[str, ...]
    is_source: Callable[[Column], Column]
    analyze: Callable[..., W.Analysis] = W.analyze


REGISTRY: dict[str, Technology] = {}


def register(technology: Technology) -> None:
    REGISTRY[technology.name] = technology


register(Technology(W.PARSER_ID, BUILD_MARKERS, lambda uri: F.endswith(uri, F.lit(".java"))))


def choose(files: DataFrame, previous: str | None = None) -> Technology:
    """The technology of the last analysis, else the first whose descriptors exist, else the first registered."""
    if previous in REGISTRY:
        return REGISTRY[previous]
    name = F.element_at(F.split("uri", "/"), -1)
    for t in REGISTRY.values():
        if not files.filter(name.isin(list(t.markers))).isEmpty():
            return t
    return next(iter(REGISTRY.values()))


class Cancelled(Exception):
    """A later request has taken over."""


@dataclass
class Session:
    """Every request is a generation; a new one interrupts the jobs of the one before, a late result is dropped,
    and what is published stays until a later generation has succeeded as a whole."""

    spark: SparkSession
    store: SnapshotStore
    request: Request
    excluded: list[str] = field(default_factory=list)
    generation: int = 0
    last: W.Analysis | None = None
    timings: dict[str, float] = field(default_factory=dict)
    _lock: threading.Lock = field(default_factory=threading.Lock)
    _saving: threading.Lock = field(default_factory=threading.Lock)

    def _begin(self) -> int:
        with self._lock:
            if self.generation:
                self.spark.interruptTag(f"codeflow-{self.generation}")
            self.generation += 1
            return self.generation

    def analyze(self, files: DataFrame, cold: bool = False) -> W.Analysis:
        """Analyse and publish; raises ``Cancelled`` if a later call began meanwhile."""
        mine, tag, began = self._begin(), None, time.time()
        tag = f"codeflow-{mine}"
        self.spark.addTag(tag)
        try:
            before = None if cold else W.previous_analysis(self.store, self.request, self.excluded)
            result = choose(files).analyze(files, self.request, previous=before, excluded=self.excluded)
            self.timings = {"analyze_ms": (time.time() - began) * 1000}
            with self._saving:  # saves happen in the order of their generations
                if mine != self.generation:
                    raise Cancelled
                W.publish(self.store, self.request, result)
                self.last = result
            self.timings["total_ms"] = (time.time() - began) * 1000
            return result
        except Exception as e:
            if mine != self.generation and not isinstance(e, Cancelled):
                raise Cancelled from e
            raise
        finally:
            self.spark.removeTag(tag)

    def clear(self) -> None:
        with self._saving:
            self.store.clear()

    def refresh(self, endpoint_id: str) -> tuple[str, tuple[DataFrame, DataFrame] | None]:
        """('updated', graph) or ('endpointUnavailable', None) of an endpoint that is being shown."""
        if self.last is None or self.last.index.endpoints.filter(F.col("id") == endpoint_id).isEmpty():
            return "endpointUnavailable", None
        return "updated", W.endpoint_graph(self.last.index, endpoint_id)

    def location(self, node_id: str):
        """Q9: where a node of the published index stands, or None."""
        row = self.last.index.nodes.filter(F.col("id") == node_id).select("loc").first() if self.last else None
        return row["loc"] if row else None

    def diagnostics(self, operational: DataFrame | None = None) -> DataFrame:
        """Those of the last analysis with operational ones, each once."""
        own = self.last.index.diagnostics.select("code", "severity", "message", "loc").unionByName(self.last.discovery.diagnostics.select("code", "severity", "message", "loc"))
        extra = operational if operational is not None else own.limit(0)
        both = own.unionByName(extra).withColumns({"uri": F.col("loc.uri"), "start": F.col("loc.start")})
        return merge_diagnostics(both, both.limit(0), ["code", "message", "uri", "start"]).drop("uri", "start")
