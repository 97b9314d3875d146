"""Incremental state: what changed between snapshots, upserts, purges, projects.

Plain Parquet has no MERGE.  A state is a folder of numbered versions; a write
makes the next one and a reader takes the highest that is complete, so a query
sees one version and a failed write leaves the last.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): added, changed or removed between two (path, sha256) snapshots."""
    a = old.select(F.col("path").alias("p"), F.col("sha256").alias("before"))
    met = new.join(a, F.col("path") == F.col("p"), "full_outer")
    kind = F.when(F.col("p").isNull(), "added").when(F.col("path").isNull(), "removed").when(~F.col("sha256").eqNullSafe(F.col("before")), "changed")
    return met.select(F.coalesce("path", "p").alias("path"), kind.alias("change")).filter("change is not null")


def dirty(old: DataFrame, new: DataFrame) -> DataFrame:
    return changed(old, new).filter("change in ('added', 'changed')").select("path")


def stale(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.join(new.select(F.col("path").alias("p")), F.col("path") == F.col("p"), "left_anti").select("path")


def upsert(state: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """The state with these rows in place of those of the same key."""
    kept = state.join(rows.select(F.col(key).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left_anti")
    return kept.unionByName(rows)


def delete_ids(state: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    """The state without the rows of these keys."""
    return state.join(gone.select(F.col(key).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left_anti")


def replace_files(state: DataFrame, rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The state with the rows of these files replaced and those of the gone paths dropped."""
    out = rows.select(F.col("file_path").alias("_p")).unionAll(gone.select(F.col("path"))).distinct()
    return state.join(out, F.col("file_path") == F.col("_p"), "left_anti").unionByName(rows)


def reindex(state: DataFrame, old: DataFrame, new: DataFrame, fresh: DataFrame) -> DataFrame:
    """The state after a change of files; ``fresh`` are the entities of the new snapshot, of which only dirty files are read."""
    wanted = dirty(old, new).select(F.col("path").alias("_d"))
    rows = fresh.join(wanted, F.col("file_path") == F.col("_d"), "left_semi")
    return replace_files(state, rows, changed(old, new).filter("change <> 'added'").select("path"))


class Store:
    """Versions of a project's tables under one folder, in any file system that Spark reads.

    A version is complete, and seen by readers, once its mark is written, which
    comes last; readers that hold a version keep it.  One writer per project.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _folder(self, project: str) -> str:
        clean = re.sub("[^a-z0-9_]", "_", project.lower()).lstrip("_")[:60]
        return f"{self.root}/project={clean}"

    def _path(self, name: str) -> tuple:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _list(self, folder: str) -> list[str]:
        fs, path = self._path(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _mark(self, name: str, text: str = "") -> None:
        fs, path = self._path(name)
        stream = fs.create(path, True)
        stream.write(bytearray(text.encode()))
        stream.close()

    def versions(self, project: str) -> list[int]:
        folder = self._folder(project)
        found = [int(n.removeprefix("v")) for n in self._list(folder) if n.startswith("v")]
        return [v for v in found if "COMPLETE" in self._list(f"{folder}/v{v:08d}")]

    def write(self, project: str, rows: DataFrame | dict[str, DataFrame]) -> int:
        """The next version: one table, ``entities``, or several by name."""
        tables = rows if isinstance(rows, dict) else {"entities": rows}
        version = max(self.versions(project), default=0) + 1
        at = f"{self._folder(project)}/v{version:08d}"
        for name, table in tables.items():
            table.write.mode("overwrite").parquet(f"{at}/{name}")
        self._mark(f"{at}/COMPLETE")
        return version

    def read(self, project: str, version: int | None = None, table: str = "entities") -> DataFrame | None:
        """A table of one version, the latest unless named; None if there is none."""
        known = self.versions(project)
        if not known:
            return None
        return self.spark.read.parquet(f"{self._folder(project)}/v{version or max(known):08d}/{table}")

    def projects(self) -> list[str]:
        return [n.removeprefix("project=") for n in self._list(self.root) if n.startswith("project=")]

    def drop(self, project: str) -> None:
        fs, path = self._path(self._folder(project))
        fs.delete(path, True)

    def reset(self, project: str) -> None:
        """An empty project of that name, whatever it held."""
        self.drop(project)
        fs, path = self._path(self._folder(project))
        fs.mkdirs(path)

    def vacuum(self, project: str, keep: int = 2) -> None:
        """Drop all but the latest versions, and what failed writes left before them."""
        known = self.versions(project)[-keep:]
        for name in self._list(self._folder(project)):
            if known and name.startswith("v") and int(name[1:]) < known[0]:
                fs, path = self._path(f"{self._folder(project)}/{name}")
                fs.delete(path, True)

    def switch(self, project: str) -> None:
        """Make this the current project."""
        self._mark(f"{self.root}/CURRENT", self._folder(project).rsplit("=", 1)[-1])

    def current(self) -> str | None:
        fs, path = self._path(f"{self.root}/CURRENT")
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def purge(self, project: str) -> None:
        """Drop all versions and ask for a full index next time."""
        self.reset(project)
        self._mark(f"{self._folder(project)}/FULL")

    def take_full(self, project: str) -> bool:
        """Whether a full index was asked for; asks no more."""
        fs, path = self._path(f"{self._folder(project)}/FULL")
        return bool(fs.exists(path) and fs.delete(path, False))


def startup_project(counts: DataFrame, default: str) -> DataFrame:
    """The default project if present, else the largest that is no test collection.  counts: (project, n)."""
    rows = counts.filter((F.col("project") == default) | ~names.is_test_collection("project"))
    return rows.orderBy((F.col("project") == default).desc(), F.desc("n"), "project").limit(1)
