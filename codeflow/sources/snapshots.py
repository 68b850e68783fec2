"""Versioned Parquet snapshots with a pointer that flips last, and cutting of lineage in the shared folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

ENGINE_VERSION = "2"


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where none is set, a local master gets a temporary one, and any other is
    an error: executors of several machines don't share a local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="codeflow-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = f"file://{own}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back, so that loops keep short plans and lost executors cost little."""
    path = f"{shared_folder(df.sparkSession)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class SnapshotStore:
    """Named tables in versions of a folder; readers see the version that the pointer names.

    A version is complete before the pointer (a one-row table written under a new name, the highest readable one counts)
    refers to it, so a failed publication leaves the last good version in place. Any Hadoop file system will do."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        at = self._path(f"{self.root}/pointer")
        if not self._fs.exists(at):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return sorted(int(n) for n in names if n.isdigit())

    def publish(self, tables: dict[str, DataFrame]) -> int:
        """Write all tables as the next version, then flip the pointer by a rename."""
        version = (self._versions() or [0])[-1] + 1
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.root}/v{version}/{name}")
        draft = f"{self.root}/draft-{uuid.uuid4().hex}"
        info = self.spark.createDataFrame([(ENGINE_VERSION, version, sorted(tables))], "engine_version string, version int, tables array<string>")
        info.coalesce(1).write.json(draft)
        self._fs.mkdirs(self._path(f"{self.root}/pointer"))
        if not self._fs.rename(self._path(draft), self._path(f"{self.root}/pointer/{version}")):
            raise OSError(f"version {version} could not be published")
        return version

    def load(self) -> dict[str, DataFrame] | None:
        """The tables of the newest readable version of this engine, else None (a cold start)."""
        for version in reversed(self._versions()):
            try:
                info = self.spark.read.schema("engine_version string, version int, tables array<string>").json(f"{self.root}/pointer/{version}").first()
                if info is None or info["engine_version"] != ENGINE_VERSION:
                    continue
                return {t: self.spark.read.parquet(f"{self.root}/v{info['version']}/{t}") for t in info["tables"]}
            except (AnalysisException, Py4JJavaError):
                continue  # unreadable: the version before it, or a cold start
        return None

    def clear(self) -> None:
        self._fs.delete(self._path(self.root), True)
