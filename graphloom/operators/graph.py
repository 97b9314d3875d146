"""Questions to the code graph: callers, callees, impact, coupling, hierarchy, dead code, centrality, the view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from ..storage import settle
from .edges import ORDER, best, edges, near, probed, references_to, referring, resolve_calls

#: Names that web frameworks call by convention.
EXPORTS = [
    "GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS", "default", "generateStaticParams", "generateMetadata", "loader", "action", "headers", "links", "handle",
]
#: Beginnings of names that the test runner calls.
GO_TESTS = ["Test", "Benchmark", "Fuzz", "Example"]
#: Names that frameworks call back.
CALLBACKS = [
    "init", "terminate", "code_change", "child_spec", "start_link", "handle_call", "handle_cast", "handle_info", "handle_continue", "handle_demand",
    "handle_subscribe", "handle_cancel", "handle_events", "handle_notify", "handle_message", "handle_batch", "handle_failed", "mount", "render", "update",
    "handle_params", "handle_event", "handle_async", "on_mount",
]
#: Files whose exports the router calls.
FILES = ["page", "layout", "loading", "error", "not-found", "template", "route", "global-error", "global-not-found", "sitemap", "robots", "manifest", "default"]
WEB = ["javascript", "typescript", "tsx"]
FUNCTIONS = ["function", "method"]
PORTS = ["interface", "struct"]


def conventional() -> Column:
    """Entities that tests, routers or frameworks call without a call in the code."""
    name, path, lang = F.coalesce("name", F.lit("")), F.coalesce("file_path", F.lit("")), F.coalesce("language", F.lit(""))
    base = F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]+$", "")
    by_file = base.isin(FILES) & ((name == base) | name.rlike("^[A-Z]|^(get|fetch|load|generate)[A-Z]"))
    go = F.lit(False)
    for prefix in GO_TESTS:
        go = go | name.startswith(prefix)
    elixir = path.endswith("_controller.ex") | name.isin(CALLBACKS)
    return names.is_test_file(path) | ((lang == "elixir") & elixir) | ((lang == "go") & go) | (lang.isin(WEB) & (name.isin(EXPORTS) | by_file | path.contains("/components/ui/")))


def find(entities: DataFrame, name: str) -> DataFrame:
    """The one entity a text means: dotted match, else file stem, else substring either way; first by place."""
    low = name.lower()
    key = F.lit(low)
    stemmed = F.lit(low.replace("-", "").replace("_", ""))
    within = (F.lower("name") != "") & (key != "") & (F.lower("name").contains(key) | F.contains(key, F.lower("name")))
    strategy = F.when(names.matches("name", F.lit(name)), 1).when((stemmed != "") & (names.stem("file_path") == stemmed), 2).when(within, 3)
    return entities.withColumn("strategy", strategy).filter("strategy is not null").orderBy("strategy", *ORDER).limit(1)


def _referring(entities: DataFrame, kind: str, name: str) -> DataFrame:
    return entities.filter(F.exists(kind, lambda x: names.matches(x, F.lit(name))))


def refined(callers: DataFrame, functions: DataFrame, on: list[str]) -> DataFrame:
    """Callers that are no functions become the function of their file that makes the call, in their lines first.

    callers: s_ columns and ``on``; functions: f_id, f_name, f_type, f_start,
    f_end and ``on``, which has the file.  Both are about one or more targets.
    """
    outer = callers.filter(~F.coalesce("s_type", F.lit("")).isin(FUNCTIONS) & F.col("s_file").isNotNull())
    within = ((F.col("s_end") > F.col("s_start")) & (F.col("f_start") >= F.col("s_start")) & (F.col("f_end") <= F.col("s_end"))).cast("int")
    keys = ["s_id", *[c for c in on if c != "s_file"]]
    one = best(outer.join(functions, on), keys, [F.desc(within), "f_start", "f_id"]).select(*keys, "f_id", "f_name", "f_type")
    rows = callers.join(one, keys, "left")
    return rows.withColumn("n_id", F.coalesce("f_id", "s_id")).withColumn("n_name", F.coalesce("f_name", "s_name")).withColumn("n_type", F.coalesce("f_type", "s_type")).drop("f_id", "f_name", "f_type")


def _as_functions(rows: DataFrame, *more: str) -> DataFrame:
    """Functions among callers, as ``refined`` wants them."""
    return rows.filter(F.col("s_type").isin(FUNCTIONS)).select(*more, "s_file", *(F.col(f"s_{c}").alias(f"f_{c}") for c in ("id", "name", "type", "start", "end"))).distinct()


def callers(entities: DataFrame, name: str, limit: int = 20) -> DataFrame:
    """Who calls ``name`` (dotted match) or imports it (substring of is_a), callers first.

    The limit comes before callers are refined to functions, so fewer rows can
    come back; a module goes when a function of its file is there.
    """
    own = [F.col(c).alias(f"s_{a}") for c, a in (("id", "id"), ("name", "name"), ("file_path", "file"), ("entity_type", "type"), ("start_line", "start"), ("end_line", "end"))]
    calling = _referring(entities, "calls", name)
    both = calling.withColumn("rank", F.lit(1)).unionByName(importers(entities, name).withColumn("rank", F.lit(2)))
    both = settle(best(both, ["id"], ["rank"]).orderBy("rank", *ORDER).limit(limit).select(*own, "rank"))
    functions = _as_functions(calling.select(*own).join(F.broadcast(both.select("s_file").distinct()), "s_file", "left_semi"))
    rows = refined(both, functions, ["s_file"]).select(F.col("n_id").alias("id"), F.col("n_name").alias("name"), F.col("s_file").alias("file_path"), F.col("n_type").alias("kind"), "rank")
    rows = settle(best(rows, ["id"], ["rank", "name"]))
    taken = rows.filter(F.col("kind").isin(FUNCTIONS)).select(F.col("file_path").alias("_f")).distinct()
    return rows.join(taken, (F.col("kind") == "module") & (F.col("file_path") == F.col("_f")), "left_anti")


def importers(entities: DataFrame, name: str) -> DataFrame:
    return entities.filter(F.exists("is_a", lambda x: F.contains(F.lower(x), F.lit(name.lower()))))


def callees(entities: DataFrame, name: str, limit: int = 20) -> DataFrame:
    """The first calls of the entity a text means, in order, each with its target or unresolved."""
    one = find(entities, name).withColumn("calls", F.slice("calls", 1, limit))
    rows = resolve_calls(entities, sources=settle(one))
    return rows.select("pos", "target", "dst_id", "dst_name", "dst_file", F.col("dst_id").isNotNull().alias("resolved"))


def _key(column: str) -> Column:
    return F.concat_ws("|", F.coalesce(column, F.lit("")), F.coalesce("s_file", F.lit("")))


def _dependents(entities: DataFrame, wanted: DataFrame, index: DataFrame | None) -> DataFrame:
    """Callers of each name of ``wanted`` (``at``), once by name and file, refined to functions."""
    met = settle(references_to(entities, wanted) if index is None else referring(index, wanted))
    first = best(met, ["at", "s_name", "s_file"], ["s_start", "s_id"]).drop("kind")
    return refined(first, _as_functions(met.filter("kind = 'calls'"), "at"), ["at", "s_file"])


def _start(entities: DataFrame, name: str) -> DataFrame:
    return entities.sparkSession.createDataFrame([(name, [])], "at string, path array<string>")


def _step(level: DataFrame, nodes: DataFrame) -> DataFrame:
    """The paths of one more node."""
    step = level.join(nodes, "at").filter(~F.array_contains("path", _key("s_name")))
    return settle(step.select(F.col("n_name").alias("at"), F.array_append("path", _key("n_name")).alias("path"), F.col("s_file").alias("file_path")))


def impact(entities: DataFrame, name: str, depth: int = 3, index: DataFrame | None = None) -> DataFrame:
    """All bounded paths of dependents of ``name``: (depth, path, name, file_path).

    Each level meets the entities, or the reverse index (``index``, if one is
    stored), by the names it has reached.  Callers count once by name and file;
    those already on the path are left out; then they are refined to functions,
    under whose names the next level goes on.  Other paths may visit a node
    again; the root is not part of a path.
    """
    level, out = _start(entities, name), None
    for d in range(1, depth + 1):
        step = _step(level, _dependents(entities, level.select("at").distinct(), index))
        rows = step.select(F.lit(d).alias("depth"), F.array_join("path", " > ").alias("path"), F.col("at").alias("name"), "file_path")
        out = rows if out is None else out.unionByName(rows)
        level = step.select("at", "path")
    if out is None:
        return entities.sparkSession.createDataFrame([], "depth int, path string, name string, file_path string")
    return out


def affected_files(entities: DataFrame, name: str, depth: int = 3, index: DataFrame | None = None) -> DataFrame:
    """(file_path, n_paths, nearest): how many of ``impact``'s paths end in a file, and the least depth.

    Paths of a level are counted from those of the level before: all
    continuations, less those that are on the path.  So the last level, by far
    the largest, is never made.
    """
    level, out = _start(entities, name), None
    for d in range(1, depth + 1):
        nodes = settle(_dependents(entities, level.select("at").distinct(), index))
        every = level.groupBy("at").agg(F.count("*").alias("n")).join(nodes.groupBy("at", "s_file").agg(F.count("*").alias("m")), "at").select("s_file", (F.col("n") * F.col("m")).alias("n"))
        again = level.select("at", F.explode(F.array_distinct("path")).alias("_key")).groupBy("at", "_key").agg(F.count("*").alias("n"))
        again = again.join(nodes.select("at", _key("s_name").alias("_key"), "s_file"), ["at", "_key"]).select("s_file", (-F.col("n")).alias("n"))
        rows = every.unionByName(again).groupBy(F.col("s_file").alias("file_path")).agg(F.sum("n").alias("n")).filter("n > 0").withColumn("depth", F.lit(d))
        out = rows if out is None else out.unionByName(rows)
        if d < depth:
            level = _step(level, nodes).select("at", "path")
    if out is None:
        return entities.sparkSession.createDataFrame([], "file_path string, n_paths long, nearest int")
    return out.groupBy("file_path").agg(F.sum("n").alias("n_paths"), F.min("depth").alias("nearest"))


def _imports(column: str) -> Column:
    return F.filter(F.transform(column, names.import_stem), lambda x: x.isNotNull())


def connections(entities: DataFrame, file: str) -> DataFrame:
    """(file_path, from_name, to_name, direction, counts): what couples other files to ``file``.

    ``incoming``: they call one of its names; ``outgoing``: it calls theirs, calls
    within it left out; ``imports`` and ``imported_by``: import paths that name a
    file, one row per direction.  Relations of binding patterns don't count.
    """
    own = settle(entities.filter(F.col("file_path") == file).select("id", "name", "start_line", "calls", "is_a"))
    others = entities.filter(F.col("file_path") != file)
    own_names = own.select(F.col("name").alias("own_name")).filter("own_name is not null").distinct()
    made = others.select("file_path", F.coalesce("name", F.lit("")).alias("name"), F.explode(F.array_distinct("calls")).alias("call"))
    incoming = probed(own_names, "own_name", made, "call").groupBy("file_path", "name", "call").agg(F.min("own_name").alias("to_name"))
    incoming = incoming.select("file_path", F.col("name").alias("from_name"), "to_name", F.lit("incoming").alias("direction")).distinct()
    calls = own.select(F.col("name").alias("caller"), "start_line", "id", F.explode("calls").alias("call"))
    within = probed(own_names, "own_name", calls.select("call").distinct(), "call").select(F.col("call").alias("_c")).distinct()
    calls = calls.join(within, F.col("call") == F.col("_c"), "left").withColumn("outside", F.col("_c").isNull()).drop("_c")
    named = others.select("file_path", F.coalesce("name", F.lit("")).alias("name")).distinct()
    outgoing = probed(calls, "call", named, "name").groupBy("file_path", "name").agg(F.max("outside").alias("outside"), F.min_by("caller", F.struct("start_line", "id")).alias("from_name"))
    outgoing = outgoing.filter("outside").select("file_path", F.coalesce("from_name", F.lit("unknown")).alias("from_name"), F.col("name").alias("to_name"), F.lit("outgoing").alias("direction"))
    base, stem = file.rsplit("/", 1)[-1], names.without_extension(F.lit(file))
    first = [F.min(F.coalesce("name", F.lit(""))).alias("name")]
    imports = others.filter(F.exists(_imports("is_a"), lambda x: F.endswith(stem, x))).groupBy("file_path").agg(*first)
    imports = imports.select("file_path", F.col("name").alias("from_name"), F.lit(base).alias("to_name"), F.lit("imports").alias("direction"))
    asked = near(own.select(F.explode(_imports("is_a")).alias("asked")).distinct())
    ends = others.select("file_path").distinct().select("file_path", F.explode(names.endings(names.without_extension("file_path"))).alias("asked"))
    reached = near(ends.join(asked, "asked").select(F.col("file_path").alias("_f")).distinct())
    imported = others.join(reached, F.col("file_path") == F.col("_f"), "left_semi").groupBy("file_path").agg(*first)
    imported = imported.select("file_path", F.lit(base).alias("from_name"), F.col("name").alias("to_name"), F.lit("imported_by").alias("direction"))
    rows = incoming.unionByName(outgoing).withColumn("counts", ~names.is_binding("from_name") & ~names.is_binding("to_name"))
    return rows.unionByName(imports.unionByName(imported).withColumn("counts", F.lit(True)))


def community(entities: DataFrame, file: str, limit: int = 10) -> DataFrame:
    """Files coupled to ``file``, with the number of distinct relations."""
    score = F.sum(F.col("counts").cast("long")).alias("coupling_score")
    kinds = F.count_distinct(F.when(F.col("counts"), F.col("direction"))).alias("n_directions")
    return connections(entities, file).groupBy("file_path").agg(score, kinds).orderBy(F.desc("coupling_score"), "file_path").limit(limit)


def grouped_connections(rows: DataFrame, shown: int = 3) -> DataFrame:
    """Connections by file and direction: the first few as text, and how many more there are."""
    order = Window.partitionBy("file_path", "direction").orderBy("from_name", "to_name")
    rows = rows.filter("counts").withColumn("_n", F.row_number().over(order))
    text = F.concat_ws(" -> ", "from_name", "to_name")
    first = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("_n") <= shown, F.struct("_n", text.alias("t"))))), lambda x: x["t"]), "; ")
    return rows.groupBy("file_path", "direction").agg(first.alias("shown"), F.greatest(F.count("*") - shown, F.lit(0)).alias("more"))


def nested(entities: DataFrame) -> DataFrame:
    """(parent_id, child_id): declarations within the lines of another one of their file."""
    a = entities.select(F.col("id").alias("parent_id"), F.col("file_path").alias("f"), F.col("start_line").alias("s"), F.col("end_line").alias("e"), F.col("name").alias("n"))
    b = entities.select(F.col("id").alias("child_id"), "file_path", "start_line", "end_line", F.col("name").alias("child"))
    return a.join(b, (F.col("f") == F.col("file_path")) & (F.col("start_line") > F.col("s")) & (F.col("end_line") <= F.col("e")) & (F.col("child") != F.col("n"))).select("parent_id", "child_id")


def _expanded(ref: str, aliases: dict[str, list[str]]) -> Column:
    """What an import path may mean under path aliases, as they stand in project settings, and last itself."""
    out = []
    for pattern, targets in aliases.items():
        for target in targets:
            if pattern.endswith("/*"):
                prefix = pattern.removesuffix("*")
                text = F.regexp_replace(F.replace(F.lit(target), F.lit("*"), F.substr(F.col(ref), F.lit(len(prefix) + 1))), r"^\./", "")
                out.append(F.when(F.col(ref).startswith(prefix), text))
            else:
                out.append(F.when(F.col(ref) == pattern, F.regexp_replace(F.lit(target), r"^\./", "")))
    return F.filter(F.array(*out, F.col(ref)), lambda x: x.isNotNull())


def resolve_names(listed: DataFrame, entities: DataFrame, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """listed: distinct ``ref``.  (ref, name, file_path, entity_type, way): the entity each one means.

    Way 1: a dotted match.  For import paths (from @, ~, ./ or ../) that have
    none, way 2: the first of their meanings under ``aliases`` that a file path
    ends with; way 3: a file of that base name.  Null: unresolved.
    """
    known = entities.select("name", "file_path", "entity_type", "start_line", "id")
    way1 = settle(best(probed(listed, "ref", known, "name"), ["ref"], ORDER).withColumn("way", F.lit(1)))
    rest = settle(listed.join(way1.select("ref"), "ref", "left_anti").filter(F.col("ref").rlike(r"^[@~].*/|^\.\.?/")))
    paths = rest.select("ref", F.posexplode(_expanded("ref", aliases or {})).alias("nth", "path")).select("ref", "nth", names.import_stem("path").alias("asked")).filter("asked is not null")
    ends = known.select("file_path").distinct().select(F.col("file_path").alias("_f"), F.explode(names.endings(names.without_extension("file_path"))).alias("asked"))
    hits = near(ends.join(near(paths), "asked").select("ref", "nth", "_f"))
    way2 = settle(best(known.join(hits, F.col("file_path") == F.col("_f")), ["ref"], ["nth", *ORDER]).drop("nth", "_f").withColumn("way", F.lit(2)))
    last = near(rest.join(way2.select("ref"), "ref", "left_anti").select("ref", F.lower(F.regexp_replace(F.substring_index("ref", "/", -1), "[-_]", "")).alias("_s")).filter("_s <> ''"))
    way3 = best(known.join(last, names.stem("file_path") == F.col("_s")), ["ref"], ORDER).drop("_s").withColumn("way", F.lit(3))
    found = way1.unionByName(way2).unionByName(way3)
    return listed.join(found, "ref", "left").select("ref", "name", "file_path", "entity_type", "way", F.col("id").alias("dst_id"))


def parents(entities: DataFrame, name: str, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """What the entity is_a, described."""
    return resolve_names(settle(find(entities, name).select(F.explode("is_a").alias("ref")).distinct()), entities, aliases)


def children(entities: DataFrame, name: str, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """(name, file_path, resolved) of what the entity contains, unresolved under its own name.

    For a function or method also the entities its capitalised dotless calls
    mean, and functions declared within its lines; by (name, file).
    """
    one = settle(find(entities, name))
    listed = one.select("entity_type", F.explode("contains").alias("ref"), F.lit(False).alias("tag"))
    tags = one.filter(F.col("entity_type").isin(FUNCTIONS)).select("entity_type", F.explode(F.filter("calls", lambda c: c.rlike("^[A-Z][^.]*$"))).alias("ref"), F.lit(True).alias("tag"))
    listed = settle(listed.unionByName(tags))
    means = resolve_names(listed.select("ref").distinct(), entities, aliases).withColumnRenamed("entity_type", "_t")
    rows = listed.join(means, "ref").filter(~F.col("tag") | F.col("way").isNotNull())
    rows = rows.select(F.coalesce("name", "ref").alias("name"), F.coalesce("file_path", F.lit("")).alias("file_path"), F.col("way").isNotNull().alias("resolved"))
    place = F.broadcast(one.filter(F.col("entity_type").isin(FUNCTIONS) & (F.col("end_line") > F.col("start_line"))).select(F.col("file_path").alias("f"), F.col("start_line").alias("s"), F.col("end_line").alias("e"), F.col("name").alias("n")))
    inner = entities.filter(F.col("entity_type").isin(FUNCTIONS)).join(place, (F.col("file_path") == F.col("f")) & (F.col("start_line") > F.col("s")) & (F.col("end_line") <= F.col("e")) & (F.col("name") != F.col("n")))
    return rows.unionByName(inner.select("name", "file_path", F.lit(True).alias("resolved"))).dropDuplicates(["name", "file_path"])


def implementors(entities: DataFrame, name: str | None = None) -> DataFrame:
    """(port, name, file_path) of everything that is_a an interface or struct, by name without case; of one port, if named."""
    ports = (entities if name is None else find(entities, name)).filter(F.col("entity_type").isin(PORTS)).select(F.col("name").alias("port")).distinct()
    rows = entities.select("name", "file_path", F.explode("is_a").alias("super"))
    return rows.join(ports, F.lower("super") == F.lower("port")).select("port", "name", "file_path").distinct()


def is_public_function() -> Column:
    return F.col("entity_type").isin(FUNCTIONS) & (F.coalesce("visibility", F.lit("public")) == "public")


def dead_code(entities: DataFrame, prefix: str | None = None, *, by_suffix: bool = False, entry_point: Column | None = None) -> DataFrame:
    """Public functions and methods, or of no stated visibility, that nobody calls.

    Strict: no call equals the name without case, nor does any call's last
    segment.  ``by_suffix`` also spares names whose own last segment is called.
    Conventions, tests, entry points of the project's settings (a condition on
    the path) and what is_a an interface or struct are spared.
    """
    public = entities.filter(is_public_function() & ~conventional())
    if entry_point is not None:
        public = public.filter(~entry_point)
    if prefix:
        public = public.filter(F.col("file_path").startswith(prefix))
    calls = entities.select(F.explode("calls").alias("c")).select(F.lower("c").alias("c")).distinct()
    used = calls.select(F.col("c").alias("used")).unionByName(calls.select(names.last_segment("c").alias("used"))).distinct()
    rows = public.join(used, F.lower("name") == F.col("used"), "left_anti")
    if by_suffix:
        rows = rows.join(used, names.last_segment("name") == F.col("used"), "left_anti")
    ports = entities.filter(F.col("entity_type").isin(PORTS)).select(F.lower("name").alias("port")).distinct()
    mine = rows.select(F.col("id").alias("_id"), F.explode("is_a").alias("s")).join(ports, F.lower("s") == F.col("port"), "left_semi").select("_id").distinct()
    return rows.join(mine, F.col("id") == F.col("_id"), "left_anti")


def dead_summary(entities: DataFrame, prefix: str | None = None, entry_point: Column | None = None) -> DataFrame:
    """One row: dead functions under the prefix, public ones anywhere, and whether web code makes the list unsure."""
    public = entities.agg(F.count_if(is_public_function()).alias("total_public"), F.coalesce(F.bool_or(F.col("language").isin(WEB)), F.lit(False)).alias("unsure"))
    return dead_code(entities, prefix, entry_point=entry_point).agg(F.count("*").alias("dead_count")).join(F.broadcast(public), F.lit(True))


def hotspot_dead(entities: DataFrame) -> DataFrame:
    """The looser, case-sensitive rule: functions whose name, and whose last segment, no call is literally."""
    calls = entities.select(F.explode("calls").alias("c")).distinct()
    rows = entities.filter(F.col("entity_type").isin(FUNCTIONS))
    rows = rows.join(calls, F.col("name") == F.col("c"), "left_anti")
    return rows.join(calls, F.substring_index("name", ".", -1) == F.col("c"), "left_anti")


def view_nodes(nodes: DataFrame, top: int = 500) -> DataFrame:
    """The nodes of most incoming references, without noise; nodes are entities with their degrees."""
    return nodes.filter(~names.is_view_noise("name")).orderBy(F.desc("incoming_count"), *ORDER).limit(top)


def view_links(nodes: DataFrame, shown: DataFrame) -> DataFrame:
    """(src_id, dst_id, kind): links among the shown nodes.

    Calls mean every node of exactly that name without case; a dotted call
    without one means those of its last segment in the package of the segment
    before, else the only one of its last segment anywhere.  Imports go by exact
    name, contained names by their own or as ``parent.child``.  A node doesn't
    call itself.  Only nodes of a name that is asked for are looked at.
    """
    shown = settle(shown.select("id", "name", "calls", "is_a", "contains"))
    refs = edges(shown.withColumn("file_path", F.lit(None).cast("string"))).select("src_id", "kind", F.lower("target").alias("t"))
    parent = shown.select(F.col("id").alias("_p"), F.lower("name").alias("_name"))
    whole = refs.filter("kind = 'contains'").join(F.broadcast(parent), F.col("src_id") == F.col("_p")).select("src_id", "kind", F.concat("_name", F.lit("."), "t").alias("t"))
    refs = settle(refs.unionByName(whole).distinct())
    keys = refs.select("t").unionAll(refs.filter("kind = 'calls'").select(names.last_segment("t"))).distinct()
    known = nodes.select(F.col("id").alias("dst_id"), F.lower("name").alias("t"), names.package("file_path").alias("package"))
    known = settle(known.join(near(keys), "t", "left_semi"))
    exact = refs.join(known.select("t", "dst_id"), "t")
    asked = refs.filter("kind = 'calls' and contains(t, '.')").select("t").distinct().join(known.select("t").distinct(), "t", "left_anti")
    asked = asked.select(F.col("t").alias("call"), names.last_segment("t").alias("t"), F.substring_index(F.substring_index("t", ".", -2), ".", 1).alias("before"))
    bare = asked.join(known, "t").withColumn("same", F.col("package") == F.col("before"))
    some = bare.groupBy("call").agg(F.bool_or("same").alias("any_same"), F.count("*").alias("n"))
    bare = bare.join(some, "call").filter(F.when(F.col("any_same"), F.col("same")).otherwise(F.col("n") == 1)).select(F.col("call").alias("t"), "dst_id")
    rows = exact.unionByName(refs.filter("kind = 'calls'").join(bare, "t")).join(F.broadcast(shown.select(F.col("id").alias("dst_id"))), "dst_id", "left_semi")
    return rows.filter("kind <> 'calls' or src_id <> dst_id").select("src_id", "dst_id", "kind").distinct()


def view_filter(shown: DataFrame, links: DataFrame, kind: str | None = None, least: int = 0, hidden: list[str] | None = None, package: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes with enough connections and of no hidden type, and links of a kind between them; or those of one package."""
    degree = F.col("incoming_count") + F.size("calls")
    keep = shown.filter((degree >= least) & ~F.coalesce("entity_type", F.lit("unknown")).isin(hidden or []))
    ids = F.broadcast(keep.select(F.col("id").alias("_i")))
    rows = links if kind is None else links.filter(F.col("kind") == kind)
    rows = rows.join(ids, F.col("src_id") == F.col("_i"), "left_semi").join(ids, F.col("dst_id") == F.col("_i"), "left_semi")
    if package is None:
        return keep, rows
    inside = F.broadcast(keep.filter(names.folder_group("file_path") == package).select(F.col("id").alias("_i")))
    rows = rows.join(inside, (F.col("src_id") == F.col("_i")) | (F.col("dst_id") == F.col("_i")), "left_semi")  # at most the shown nodes
    return keep.filter(names.folder_group("file_path") == package), rows


#: Edges between nodes that a task may hold for centrality; they are three numbers each.
HELD = 1 << 22


def critical_files(entities: DataFrame, top: int = 10) -> DataFrame:
    """Files by sampled shortest-path centrality.

    Adjacency is by lower-cased name, the last of a name winning.  From the
    sources of most calls a breadth-first tree grows level by level; a node's
    parent is the first in (parent's order, call position).  A node's score is
    its number of proper descendants in each tree, summed.  Nodes are chosen
    without their calls, and only calls that are nodes are kept.  Up to ``HELD``
    of these, each task walks the whole graph from its sources and no tree is
    stored; beyond, trees grow by joins.
    """
    named = entities.select(F.lower("name").alias("node"), "file_path", "start_line", "id", F.size("calls").alias("n_calls"))
    nodes = settle(best(named, ["node"], [F.desc("file_path"), F.desc("start_line"), F.desc("id")]))
    count = nodes.count()
    if count < 3:
        return entities.sparkSession.createDataFrame([], "file_path string, score long")
    take = min(max(50, count // 10), count)
    made = entities.select("id", F.lower("name").alias("a"), "file_path", "start_line", F.posexplode("calls").alias("pos", "b")).withColumn("b", F.lower("b"))
    callable_ = entities.select(F.explode("calls").alias("b")).distinct().select(F.lower("b").alias("b")).distinct().join(nodes.select(F.col("node").alias("k")), F.col("b") == F.col("k"), "left_semi").select(F.col("b").alias("k"))
    out = settle(made.join(near(callable_), F.col("b") == F.col("k"), "left_semi"))
    chosen = nodes.join(out.select("a").distinct(), F.col("node") == F.col("a"), "left_semi").select("node", *(F.col(c).alias(f"_{c}") for c in ORDER))
    same = F.lit(True)
    for c in ORDER:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    out = out.join(near(chosen), (F.col("a") == F.col("node")) & same, "left_semi")
    out = settle(out.groupBy("a", "b").agg(F.min("pos").alias("pos")))
    sources = nodes.orderBy(F.desc("n_calls"), "node").limit(take).select(F.col("node").alias("source"))
    sources = settle(sources.join(out.select(F.col("a").alias("source")).distinct(), "source", "left_semi"))  # the tree of any other is itself
    per = (_walked if out.count() <= HELD else _grown)(out, sources).withColumnRenamed("node", "k")
    return nodes.join(per, F.col("node") == F.col("k")).groupBy("file_path").agg(F.sum("n").alias("score")).filter("score > 0").orderBy(F.desc("score"), "file_path").limit(top)


def _numbered(rows: DataFrame) -> DataFrame:
    """rows, kept, with ``number``: from 0 without gaps."""
    rows = settle(rows.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    sizes = dict(rows.groupBy("_part").count().collect())
    first, offsets = 0, []
    for part in range(max(sizes, default=-1) + 1):
        offsets.append(first)
        first += sizes.get(part, 0)
    at = F.get(F.array(*map(F.lit, offsets)), F.col("_part")) if offsets else F.lit(0)
    return rows.withColumn("number", (at + F.col("_row")).cast("int")).drop("_part", "_row")


def _walked(out: DataFrame, sources: DataFrame) -> DataFrame:
    """(node, n): descendants in the trees of all sources, by walking the graph in memory."""
    import numpy as np
    import pyarrow as pa

    spark = out.sparkSession
    ids = _numbered(out.select(F.col("a").alias("node")).unionByName(out.select(F.col("b").alias("node"))).distinct())
    a, b = (ids.select(F.col("node").alias(x), F.col("number").alias(f"{x}_n")) for x in "ab")
    edges_ = out.join(a, "a").join(b, "b").select("a_n", "pos", "b_n").toArrow()
    froms, at, to = (edges_.column(c).to_numpy() for c in ("a_n", "pos", "b_n"))
    n = ids.count()
    to = to[np.lexsort((at, froms))].astype(np.int32)
    starts = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(froms, minlength=n), out=starts[1:])
    held = spark.sparkContext.broadcast((starts, to))
    del edges_, froms, at

    def walk(batches):
        starts, to = held.value
        n = len(starts) - 1
        seen, score, below, place = np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for batch in batches:
            for source in batch.column(0).to_pylist():
                seen[source] = True
                front, levels = np.array([source]), []
                while len(front):
                    sizes = starts[front + 1] - starts[front]
                    ends = np.cumsum(sizes)
                    nodes = to[np.arange(ends[-1]) + np.repeat(starts[front] - ends + sizes, sizes)]
                    new = ~seen[nodes]
                    nodes, parents = nodes[new], np.repeat(front, sizes)[new]
                    place[nodes[::-1]] = np.arange(len(nodes))[::-1]  # the first of a node stays
                    first = place[nodes] == np.arange(len(nodes))
                    front, parents = nodes[first], parents[first]
                    seen[front] = True
                    levels.append((front, parents))
                for nodes, parents in reversed(levels):  # deepest first: each node hands its descendants and itself to its parent
                    score[nodes] += below[nodes]
                    np.add.at(below, parents, below[nodes] + 1)
                for nodes, _ in levels:
                    seen[nodes], below[nodes] = False, 0
                seen[source], below[source] = False, 0
        hit = np.flatnonzero(score)
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(score[hit])], ["number", "n"])

    starts_at = sources.join(ids, F.col("source") == F.col("node")).select("number")
    scores = starts_at.repartition(4 * spark.sparkContext.defaultParallelism).mapInArrow(walk, "number int, n long").groupBy("number").agg(F.sum("n").alias("n"))
    return settle(scores.join(ids, "number").select("node", "n"))


def _grown(out: DataFrame, sources: DataFrame) -> DataFrame:
    """The same by joins.  Each level is one join and one ranked choice, kept in the shared checkpoint folder."""
    tree = settle(sources.select("source", F.col("source").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("level"), F.lit(1).cast("long").alias("nth")))
    front, levels = tree, 0
    while True:
        levels += 1
        step = front.select("source", F.col("node").alias("parent"), "nth").join(out, F.col("parent") == F.col("a")).select("source", F.col("b").alias("node"), "parent", "nth", "pos")
        step = step.join(tree.select(F.col("source").alias("s"), F.col("node").alias("n")), (F.col("source") == F.col("s")) & (F.col("node") == F.col("n")), "left_anti")
        step = best(step, ["source", "node"], ["nth", "pos"])
        order = Window.partitionBy("source").orderBy("nth", "pos")
        front = settle(step.select("source", "node", "parent", F.lit(levels).alias("level"), F.row_number().over(order).cast("long").alias("nth")))
        if not front.limit(1).count():
            break
        tree = tree.unionByName(front)
    below = tree.select("source", "node", "parent", "level", F.lit(0).cast("long").alias("n"))
    score = None
    for level in range(levels - 1, 0, -1):  # deepest first: each node hands its descendants and itself to its parent
        here = below.filter(F.col("level") == level)
        up = here.groupBy(F.col("source").alias("us"), F.col("parent").alias("up")).agg(F.sum(F.col("n") + 1).alias("more"))
        rows = here.select("node", "n")
        score = rows if score is None else score.unionByName(rows)
        above = below.filter(F.col("level") == level - 1).join(up, (F.col("source") == F.col("us")) & (F.col("node") == F.col("up")), "left")
        above = above.select("source", "node", "parent", "level", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"))
        below = settle(below.filter(F.col("level") < level - 1).unionByName(above))
    if score is None:
        return out.sparkSession.createDataFrame([], "node string, n long")
    return score.groupBy("node").agg(F.sum("n").alias("n"))
