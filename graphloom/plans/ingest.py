"""Ingest as one job: files to entities, texts, vocabulary and vectors, kept as versions of a project.

A full index takes all files; a refresh compares their digests with the stored
ones, parses only new and changed files, drops the rows of gone ones, and writes
the next version, or none if nothing changed.  Readers pin a version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import embedding, retrieval, stats
from ..schema import conform, indexable
from ..sources import extract, scan
from ..storage import settle
from ..streaming import incremental

ERROR = "file_path string, error string"


class Workspace:
    """Projects in one store, with the current one."""

    def __init__(self, spark: SparkSession, root: str, encoder: embedding.Encoder | None = None, **how: float) -> None:
        self.spark, self.store, self.encoder, self.how = spark, incremental.Store(spark, root), encoder, how

    def files(self, roots: list[str], **rules: scan.IgnoreRules) -> DataFrame:
        """The indexed files of source trees: (path, language, content, sha256)."""
        return scan.scan(self.spark, roots, **rules).filter("skip is null").select("path", "language", "content", "sha256")

    def index(self, project: str, files: DataFrame) -> dict[str, int]:
        """All files anew."""
        return self._write(project, settle(files), None)

    def refresh(self, project: str, files: DataFrame) -> dict[str, int]:
        """Only what changed since the stored version; all files if there is none, or if a full index was asked for."""
        files = settle(files)  # one look at the tree: digests and contents agree
        before = None if self.store.take_full(project) else self.store.read(project, table="files")
        if before is None:
            return self._write(project, files, None)
        changes = settle(incremental.changed(before, files.select("path", "sha256")))
        if not changes.limit(1).count():
            return self._acks(project, 0, 0, 0)
        return self._write(project, files, changes)

    def _write(self, project: str, files: DataFrame, changes: DataFrame | None) -> dict[str, int]:
        fresh, gone = files, None
        if changes is not None:
            wanted = changes.filter("change <> 'removed'").select(F.col("path").alias("_d"))
            fresh = files.join(wanted, F.col("path") == F.col("_d"), "left_semi")
            gone = changes.filter("change <> 'added'").select("path")
        found = settle(extract.extract(fresh))
        failed = found.filter("error is not null").select("file_path", "error")
        rows = indexable(conform(found.filter("error is null").drop("error")))
        old = self.store.read(project) if changes is not None else None
        rows = settle(rows.dropDuplicates(["id"]) if old is None else incremental.replace_files(old, rows.dropDuplicates(["id"]), gone))
        if changes is not None:
            kept = incremental.replace_files(self.store.read(project, table="errors"), failed, gone)
            failed = kept
        texts = rows.select("id", text.embedding_text().alias("embed"), text.keyword_text().alias("keywords"))
        frequencies = settle(retrieval.term_frequencies(texts, "embed"))
        vocabulary = settle(retrieval.vocabulary(frequencies, texts.count()))
        if self.encoder is None:
            vectors = embedding.hashed(texts, vocabulary, "embed").withColumn("way", F.lit("tfidf"))
        else:
            vectors = embedding.embed(texts, self.encoder, vocabulary, "embed", **self.how)
        keywords = retrieval.sparse(retrieval.weights(retrieval.term_frequencies(texts, "keywords"), vocabulary))
        self.store.write(project, {"files": files.select("path", "sha256"), "entities": rows, "errors": failed, "vocabulary": vocabulary, "vectors": vectors, "keywords": keywords})
        return self._acks(project, fresh.count(), 0 if changes is None else changes.filter("change = 'removed'").count(), found.filter("error is not null").count())

    def _acks(self, project: str, parsed: int, removed: int, failed: int) -> dict[str, int]:
        """What a run did: a failed file counts as parsed, with no chunk."""
        version = max(self.store.versions(project), default=0)
        chunks = self.store.read(project).count() if version else 0
        return {"parsed": parsed, "removed": removed, "failed": failed, "chunks": chunks, "version": version}

    def switch(self, project: str) -> DataFrame | None:
        """The project becomes current; its entities, if it has any."""
        self.store.switch(project)
        return self.store.read(project)

    def startup(self, default: str) -> str | None:
        """The current project; else the default if present, else the largest that is no test collection, which becomes current."""
        if (now := self.store.current()) is not None:
            return now
        row = incremental.startup_project(self.listing(), default).first()
        if row is not None:
            self.store.switch(row["project"])
        return row["project"] if row is not None else None

    def listing(self) -> DataFrame:
        """(project, n): all projects with their chunks."""
        rows = self.spark.createDataFrame([], "project string, n long")
        for project in self.store.projects():
            found = self.store.read(project)
            one = self.spark.range(1).select(F.lit(project).alias("project"), F.lit(0).cast("long").alias("n")) if found is None else found.agg(F.lit(project).alias("project"), F.count("*").alias("n"))
            rows = rows.unionByName(one)
        return rows

    def health(self, project: str) -> DataFrame:
        found = self.store.read(project)
        rows = conform(self.spark.createDataFrame([], "name string")) if found is None else found
        return stats.health(rows, project, max(self.store.versions(project), default=0), len(self.store.projects()))
