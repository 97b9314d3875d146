"""Source trees as DataFrames: files, why others are skipped, ignore rules, project settings."""

from __future__ import annotations

import json
import re
import tomllib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..storage import scratch

#: Folders that are never indexed.
IGNORED = [
    "node_modules", ".next", "dist", "build", ".expo", ".turbo", "coverage", "__generated__", ".cache", "vendor", "_build", "deps", ".elixir_ls", ".git",
    ".svn", ".hg", "target", ".venv", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox", "out",
]
#: Files that are never indexed.
IGNORED_FILES = ["*.min.js", "*.min.css", "*.map", "*.lock", "*.d.ts"]
#: Folders in which projects keep their sources.
SOURCE_FOLDERS = [
    "lib", "src", "app", "pages", "components", "utils", "packages", "services", "infrastructure", "repositories", "core", "hooks", "api", "modules",
    "controllers", "models", "views", "cmd", "internal", "pkg",
]
#: The project's own ignore file, and the one of git.
OWN_RULES, GIT_RULES = ".indexignore", ".gitignore"


@dataclass
class IgnoreRules:
    """Folder names, path prefixes and file globs of one ignore file."""

    folders: list[str] = field(default_factory=list)
    prefixes: list[str] = field(default_factory=list)
    globs: list[str] = field(default_factory=list)


def parse_ignore(text: str | None) -> IgnoreRules:
    """Lines of an ignore file; comments, negations and blank lines are dropped."""
    rules = IgnoreRules()
    for line in (text or "").splitlines():
        line = line.strip()
        if not line or line[0] in "#!":
            continue
        rooted, line = line.startswith("/"), line.strip("/")
        if any(c in line for c in "*?["):
            rules.globs.append(line)
        elif "/" in line or rooted:
            rules.prefixes.append(line)
        elif line:
            rules.folders.append(line)
    return rules


def _any(path: Column, prefixes: list[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | (path == p) | path.startswith(p + "/")
    return out


def _globbed(path: Column, globs: list[str]) -> Column:
    out = F.lit(False)
    for g in globs:
        out = out | path.rlike(names.glob_regex(g if "/" in g else f"**/{g}"))
    return out


def _folder_reason(folder: Column, name: Column, own: IgnoreRules, git: IgnoreRules) -> Column:
    """Why a folder is pruned, or null: its path relative to the root, and its name."""
    dotted = name.startswith(".") & (F.length(name) > 1)
    reason = F.when(_any(folder, own.prefixes) | name.isin(own.folders), "project_ignore").when(_any(folder, git.prefixes) | name.isin(git.folders), "gitignore")
    return reason.when(name.isin(IGNORED), "default").when(dotted, "dot_folder")


def classify(path: Column, own: IgnoreRules | None = None, git: IgnoreRules | None = None) -> Column:
    """struct(reason, pruned): why a relative path is skipped, and the folder that was pruned, if one was; nulls if it is indexed.

    Folders are asked from the root down, the first that is ignored decides;
    then the file itself.
    """
    own, git = own or IgnoreRules(), git or IgnoreRules()
    parts = F.split(path, "/")
    depth = F.size(parts) - 1

    def folder(i: Column) -> Column:
        whole = F.array_join(F.slice(parts, F.lit(1), i), "/")
        return F.struct(_folder_reason(whole, F.get(parts, i - 1), own, git).alias("reason"), whole.alias("pruned"))

    folders = F.filter(F.transform(F.when(depth > 0, F.sequence(F.lit(1), F.greatest(depth, F.lit(1)))).otherwise(F.array().cast("array<int>")), folder), lambda x: x["reason"].isNotNull())
    reason = F.when(_any(path, own.prefixes) | _globbed(path, own.globs), "project_ignore").when(_any(path, git.prefixes) | _globbed(path, git.globs), "gitignore")
    reason = reason.when(_globbed(path, IGNORED_FILES), "default").when(names.language(path).isNull(), "extension")
    return F.coalesce(F.get(folders, 0), F.struct(reason.alias("reason"), F.lit(None).cast("string").alias("pruned")))


def _file_system(spark: SparkSession, folder: str) -> tuple:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file, such as settings or ignore rules, on the driver; None if there is none."""
    fs, where = _file_system(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8", "replace")
    finally:
        stream.close()


def load_rules(spark: SparkSession, root: str) -> tuple[IgnoreRules, IgnoreRules]:
    """The ignore rules that lie in a root: the project's own and git's."""
    return tuple(parse_ignore(read_text(spark, f"{root.rstrip('/')}/{name}")) for name in (OWN_RULES, GIT_RULES))


def source_roots(spark: SparkSession, base: str, *, curated: bool = False) -> list[str]:
    """Where to scan: the folder itself, or, curated, its source folders, else those one level below, else itself."""
    if not curated:
        return [base]
    fs, path = _file_system(spark, base)
    below = sorted(x.getPath().getName() for x in fs.listStatus(path) if x.isDirectory()) if fs.exists(path) else []

    def present(at: str, folders: list[str]) -> list[str]:
        return [f"{at}/{name}" for name in SOURCE_FOLDERS if name in folders]

    if found := present(base.rstrip("/"), below):
        return found
    for child in below:
        if not child.startswith("."):
            at = f"{base.rstrip('/')}/{child}"
            found += present(at, [x.getPath().getName() for x in fs.listStatus(_file_system(spark, at)[1]) if x.isDirectory()])
    return found or [base]


#: Bytes of files with a hidden name that the driver holds at once.
HIDDEN_BYTES = 64 << 20
SCHEME = r"^[a-z][a-z0-9+.-]*:/*"


def _plain(path: str) -> str:
    """A qualified path without its scheme."""
    return re.sub(SCHEME, "/", path)


def _hidden(spark: SparkSession, root: str, rules: tuple[IgnoreRules, IgnoreRules]) -> DataFrame | None:
    """(path, raw): what Spark's own listing leaves out (all of .git but): files in folders of a hidden name, and files of one.

    The former are opened by path; the latter no Spark reader opens, so the
    driver copies those that are indexed into the shared folder, some
    ``HIDDEN_BYTES`` at a time.  Bytes of skipped files are not read.
    """
    fs, where = _file_system(spark, root)
    base = fs.makeQualified(where).toString().rstrip("/") + "/"
    files, listed = fs.listFiles(where, True), []
    while files.hasNext():
        found = files.next()
        name = found.getPath().toString()
        parts = name.removeprefix(base).split("/")
        if ".git" not in parts and any(x[0] in "._" for x in parts):
            listed.append((name, name.removeprefix(base), parts[-1][0] in "._"))
    if not listed:
        return None
    known = spark.createDataFrame(listed, "path string, relative string, hidden boolean").withColumn("skip", classify(F.col("relative"), *rules)["reason"])
    asked = known.filter("skip is null").select("path", "hidden").collect()
    out = known.filter("skip is not null").select("path", F.lit(None).cast("binary").alias("raw"))
    if open_ := [r["path"] for r in asked if not r["hidden"]]:
        out = out.unionByName(spark.read.format("binaryFile").load(open_).select("path", F.col("content").alias("raw")))
    folder, held, size = scratch(spark, "hidden"), [], 0
    for nth, path in enumerate(copied := [r["path"] for r in asked if r["hidden"]]):
        stream = fs.open(spark._jvm.org.apache.hadoop.fs.Path(path))
        held.append((path, bytearray(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))))
        stream.close()
        size += len(held[-1][1])
        if size >= HIDDEN_BYTES or nth == len(copied) - 1:
            spark.createDataFrame(held, "path string, raw binary").write.mode("append").parquet(folder)
            held, size = [], 0
    return out.unionByName(spark.read.parquet(folder)) if copied else out


def scan(spark: SparkSession, roots: list[str], own: IgnoreRules | None = None, git: IgnoreRules | None = None) -> DataFrame:
    """(root, path, content, sha256, language, skip, pruned): each file under the roots once; skipped ones without content.

    Paths are relative to the root; of several roots, absolute.  A root within
    another one is part of it.  Without rules, those that lie in a root hold
    for it.  Why a file is skipped follows from its path, so it is a condition
    on the listing: only indexed files are opened.
    """
    fixed = None if own is None and git is None else (own or IgnoreRules(), git or IgnoreRules())
    qualified = {}
    for root in roots:
        fs, where = _file_system(spark, root)
        qualified[fs.makeQualified(where).toString().rstrip("/")] = root
    tops = [q for q in qualified if not any(q != x and q.startswith(x + "/") for x in qualified)]
    rows = None
    for top in tops:
        rules, size = fixed or load_rules(spark, top), len(_plain(top)) + 2

        def relative(path: Column, size: int = size) -> Column:
            return F.substr(F.regexp_replace(path, SCHEME, "/"), F.lit(size))

        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(top)
        listed = relative(F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))))
        indexed = classify(listed, *rules)["reason"].isNull()
        found = files.filter(indexed).select("path", F.col("content").alias("raw")).unionByName(files.filter(~indexed).select("path", F.lit(None).cast("binary").alias("raw")))
        hidden = _hidden(spark, top, rules)
        found = found if hidden is None else found.unionByName(hidden)
        found = found.select(F.lit(qualified[top]).alias("root"), relative(F.col("path")).alias("path"), "raw").withColumn("why", classify(F.col("path"), *rules))
        found = found.withColumn("path", F.concat(F.lit(_plain(top) + "/"), "path")) if len(tops) > 1 else found
        rows = found if rows is None else rows.unionByName(found)
    if rows is None:
        return spark.createDataFrame([], "root string, path string, content string, sha256 string, language string, skip string, pruned string")
    text = F.make_valid_utf8(F.col("raw").cast("string"))
    return rows.select("root", "path", text.alias("content"), F.upper(F.sha2("raw", 256)).alias("sha256"), names.language("path").alias("language"), F.col("why.reason").alias("skip"), F.col("why.pruned").alias("pruned"))


def skip_counts(scanned: DataFrame) -> DataFrame:
    """Files per reason, or indexed, over all roots; and entries, where a pruned folder is one."""
    entry = F.struct("root", F.coalesce("pruned", "path"))
    return scanned.groupBy(F.coalesce("skip", F.lit("indexed")).alias("reason")).agg(F.count("*").alias("n"), F.count_distinct(entry).alias("entries"))


@dataclass
class Project:
    entry_points: list[str] = field(default_factory=list)
    layers: dict[str, str] = field(default_factory=dict)


def parse_project(text: str | None) -> Project:
    """Settings as TOML; anything unreadable is no setting."""
    try:
        data = tomllib.loads(text or "")
    except tomllib.TOMLDecodeError:
        return Project()
    include = data.get("entry_points", {}) if isinstance(data.get("entry_points"), dict) else {}
    layers = data.get("layers", {}) if isinstance(data.get("layers"), dict) else {}
    globs = include.get("include", [])
    return Project([g for g in globs if isinstance(g, str)] if isinstance(globs, list) else [], {k: v for k, v in layers.items() if isinstance(v, str)})


def is_entry_point(path: Column, project: Project) -> Column:
    out = F.lit(False)
    for glob in project.entry_points:
        out = out | path.rlike(names.glob_regex(glob))
    return out


def parse_aliases(text: str | None) -> dict[str, list[str]]:
    """compilerOptions.paths of a tsconfig, pattern to targets; anything unreadable is none."""
    try:
        paths = json.loads(text or "{}").get("compilerOptions", {}).get("paths", {})
    except (json.JSONDecodeError, AttributeError):
        return {}
    return {k: [v for v in some if isinstance(v, str)] for k, some in paths.items() if isinstance(some, list)} if isinstance(paths, dict) else {}


def expand_alias(target: str, aliases: dict[str, list[str]]) -> list[str]:
    """What an import path may mean under the aliases, itself if under none."""
    out = []
    for pattern, some in aliases.items():
        prefix = pattern.removesuffix("*")
        if pattern.endswith("/*") and target.startswith(prefix):
            out += [v.replace("*", target[len(prefix) :]).removeprefix("./") for v in some]
        elif target == pattern:
            out += [v.removeprefix("./") for v in some]
    return out or [target]
