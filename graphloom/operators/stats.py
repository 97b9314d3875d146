"""Counts and rankings over the entity table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from .edges import ORDER
from .graph import critical_files, dead_code


def counts(entities: DataFrame, by: str) -> DataFrame:
    return entities.groupBy(F.coalesce(by, F.lit("unknown")).alias(by)).agg(F.count("*").alias("n"))


def count(entities: DataFrame, where: Column | None = None) -> DataFrame:
    """One row: how many there are, of those a condition admits."""
    return entities.agg((F.count("*") if where is None else F.count_if(where)).alias("n"))


def shares(entities: DataFrame, by: str) -> DataFrame:
    """Counts by a column and their rounded percent of all, as bar widths."""
    n = counts(entities, by)
    total = entities.agg(F.count("*").alias("total"))
    return n.join(F.broadcast(total), F.lit(True)).select(by, "n", names.percent("n", "total").alias("percent"))


def edge_totals(entities: DataFrame) -> DataFrame:
    sums = [F.sum(F.size(k)).alias(k) for k in ("calls", "is_a", "contains")]
    return entities.agg(*sums).selectExpr("stack(3, 'calls', calls, 'is_a', is_a, 'contains', contains) AS (kind, n)")


def fan_in(entities: DataFrame, top: int = 15) -> DataFrame:
    """Calls by last segment, without case."""
    return entities.select(F.explode("calls").alias("c")).groupBy(names.last_segment("c").alias("callee")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "callee").limit(top)


def fan_in_exact(entities: DataFrame, top: int = 15) -> DataFrame:
    """Calls by the whole string, case kept."""
    return entities.select(F.explode("calls").alias("callee")).groupBy("callee").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "callee").limit(top)


def fan_out(entities: DataFrame, top: int = 15) -> DataFrame:
    return entities.select("id", "name", F.size("calls").cast("long").alias("n")).orderBy(F.desc("n"), "name", "id").limit(top)


def top_connected(entities: DataFrame, top: int = 10) -> DataFrame:
    """Names by calls + contains + fan-in of the full name among last segments; one row per name."""
    fan = entities.select(F.explode("calls").alias("c")).groupBy(names.last_segment("c").alias("callee")).agg(F.count("*").alias("fan"))
    own = entities.filter(~names.is_noise("name") & (F.length("name") > 2)).groupBy("name").agg(F.max(F.size("calls") + F.size("contains")).alias("own"))  # sizes meet the fan-in, lists don't
    rows = own.join(fan, F.lower("name") == F.col("callee"), "left")
    degree = (F.col("own") + F.coalesce("fan", F.lit(0))).cast("long")
    return rows.groupBy("name").agg(F.max(degree).alias("degree")).orderBy(F.desc("degree"), "name").limit(top)


def layers(entities: DataFrame, root: str = "", globs: dict[str, str] | None = None) -> DataFrame:
    """Entities per layer; none if all are in no known one."""
    path = names.relative("file_path", root) if root else F.col("file_path")
    rows = entities.groupBy(names.layer(path, globs).alias("layer")).agg(F.count("*").alias("n"))
    kinds = rows.agg(F.count("*").alias("k"), F.max("layer").alias("any"))
    return rows.join(F.broadcast(kinds), F.lit(True)).filter("k > 1 or any <> 'other'").select("layer", "n")


def modules(entities: DataFrame, top: int = 20) -> DataFrame:
    n = (F.size("calls") + F.size("contains")).cast("long")
    return entities.filter("entity_type = 'module'").select("name", "file_path", F.size("calls").cast("long").alias("n_calls"), F.size("contains").cast("long").alias("n_children"), n.alias("n")).orderBy(F.desc("n"), "name", "file_path").limit(top)


def by_id(entities: DataFrame, id_: str) -> DataFrame:
    """The row of an id."""
    return entities.filter(F.col("id") == id_)


def page(entities: DataFrame, after: str | None, size: int) -> DataFrame:
    """The next rows by id: keyset pagination."""
    rows = entities if after is None else entities.filter(F.col("id") > after)
    return rows.orderBy("id").limit(size)


def compact(entities: DataFrame) -> DataFrame:
    """A reply row as JSON: no content, the first ten calls."""
    return entities.select("id", F.to_json(F.struct("name", "file_path", "entity_type", "start_line", F.slice("calls", 1, 10).alias("calls"))).alias("json"))


def latency_histogram(rows: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """Rows per bucket; bucket k holds values up to bounds[k], the last one the rest."""
    bucket = F.lit(len(bounds))
    for k in range(len(bounds) - 1, -1, -1):
        bucket = F.when(F.col(value) <= bounds[k], k).otherwise(bucket)
    return rows.groupBy(bucket.cast("int").alias("bucket")).agg(F.count("*").alias("n"))


def nearest_rank(rows: DataFrame, value: str, group: str, shares: list[float]) -> DataFrame:
    """Percentiles by nearest rank per group, from counts per distinct value.

    Values are counted first, so the window runs over distinct values; ranks
    are their running totals.
    """
    counted = rows.groupBy(group, value).agg(F.count("*").alias("n"))
    run = Window.partitionBy(group).orderBy(value)
    all_ = Window.partitionBy(group)
    counted = counted.select(group, value, F.sum("n").over(run).alias("upto"), F.sum("n").over(all_).alias("total"))
    out = [F.min(F.when(F.col("upto") >= F.ceil(F.lit(s) * F.col("total")), F.col(value))).alias(f"p{int(100 * s)}") for s in shares]
    return counted.groupBy(group).agg(*out)


def first_per_group(rows: DataFrame, key: str, top: int) -> DataFrame:
    order = Window.partitionBy(key).orderBy(*ORDER)
    return rows.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= top)


def status(entities: DataFrame) -> DataFrame:
    """One row: chunks, files, languages and whether anything is indexed."""
    return entities.agg(F.count("*").alias("chunks"), F.countDistinct("file_path").alias("files"), F.countDistinct("language").alias("languages"), (F.count("*") > 0).alias("ready"))


def graph_stats(entities: DataFrame, root: str = "", globs: dict[str, str] | None = None) -> DataFrame:
    """(section, name, n): all statistics of the graph as one result."""
    parts = {
        "total": entities.agg(F.lit("entities").alias("name"), F.count("*").alias("n")), "type": counts(entities, "entity_type"), "language": counts(entities, "language"),
        "edges": edge_totals(entities), "connected": top_connected(entities), "layer": layers(entities, root, globs), "critical": critical_files(entities),
    }
    out = None
    for section, rows in parts.items():
        name, n = rows.columns
        rows = rows.select(F.lit(section).alias("section"), F.col(name).alias("name"), F.col(n).cast("long").alias("n"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _table(rows: DataFrame, title: str, name: str) -> DataFrame:
    """A two-column table as one line of text, most first.  rows: a name and its count, few of them."""
    key, n = rows.columns
    lines = F.transform(F.sort_array(F.collect_list(F.struct((-F.col(n)).alias("k"), F.col(key).alias("v")))), lambda x: F.concat(F.lit("| "), x["v"], F.lit(" | "), (-x["k"]).cast("string"), F.lit(" |")))
    return rows.agg(F.concat(F.lit(f"## {title}\n\n| {name} | Count |\n|---|---|\n"), F.array_join(lines, "\n")).alias("body"))


def documents(entities: DataFrame, project: str) -> DataFrame:
    """(document, body): overview, architecture and hotspots as text."""
    head = entities.agg(F.concat(F.lit(f"# Project Overview\n\n**Project:** {project}\n**Files indexed:** "), F.count_distinct("file_path").cast("string"), F.lit("\n**Total chunks:** "), F.count("*").cast("string")).alias("body"))
    sections = {
        "overview": [head, _table(counts(entities, "language"), "Language Breakdown", "Language"), _table(counts(entities, "entity_type"), "Entity Types", "Type")],
        "architecture": [_table(modules(entities).select("name", "n"), "Modules", "Module"), _table(layers(entities), "Layers", "Layer")],
        "hotspots": [_table(fan_in_exact(entities), "Fan-in", "Callee"), _table(fan_out(entities).groupBy("name").agg(F.max("n").alias("n")), "Fan-out", "Entity"), _table(dead_code(entities).groupBy("file_path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "file_path").limit(15), "Dead code", "File")],
    }
    out = None
    for name, parts in sections.items():
        for nth, part in enumerate(parts):
            row = part.select(F.lit(name).alias("document"), F.lit(nth).alias("nth"), "body")
            out = row if out is None else out.unionByName(row)
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", "body"))), lambda x: x["body"]), "\n\n")
    return out.groupBy("document").agg(body.alias("body"))


def metrics_text(rows: DataFrame, metric: str, value: str, group: str, bounds: list[float]) -> DataFrame:
    """(line): a latency distribution as exported metrics: cumulative buckets, sum and count per group."""
    name = metric.replace(".", "_")

    def label(bound: str) -> Column:
        return F.concat(F.lit(f'{name}_bucket{{{group}="'), F.col(group), F.lit(f'",le="{bound}"}} '))

    sums = [F.count_if(F.col(value) <= b).alias(f"b{k}") for k, b in enumerate(bounds)]
    one = rows.groupBy(group).agg(*sums, F.count("*").alias("n"), F.sum(F.col(value).cast("decimal(18,2)")).alias("s"))
    own = F.concat(F.lit(f'{{{group}="'), F.col(group), F.lit('"} '))
    lines = [F.concat(label(str(b)), F.col(f"b{k}").cast("string")) for k, b in enumerate(bounds)]
    lines += [F.concat(label("+Inf"), F.col("n").cast("string")), F.concat(F.lit(f"{name}_sum"), own, F.col("s").cast("string")), F.concat(F.lit(f"{name}_count"), own, F.col("n").cast("string"))]
    return one.select(F.explode(F.array(*lines)).alias("line"))


def health(entities: DataFrame, project: str, version: int, projects: int) -> DataFrame:
    """One row: what is indexed, at which version, and whether that is usable."""
    row = status(entities)
    return row.select(F.lit(project).alias("project"), F.lit(version).cast("long").alias("version"), F.lit(projects).cast("long").alias("projects"), "chunks", "files", "languages", F.when(F.col("ready"), "healthy").otherwise("degraded").alias("state"))
