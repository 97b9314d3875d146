"""The driver's tables as entities, texts, vectors and file versions.

Every line item is a call and every succession of events one, too.  Arrays are
bounded by how many line items a supplier or a customer has and how many events
a user has, whatever the size of the tables.  Files that the tables can't give
(tests, routes, components, packages, temporary files, ...) come from
``TEMPLATES``, once per nation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import edges as ed
from ..schema import conform
from ..storage import scratch, tidy

#: Suppliers of a nation that share a module.
GROUP = 10
#: Path aliases and entry points as project settings give them.
ALIASES = {"@/*": ["./src/*"]}
ENTRY_POINTS = ["src/jobs/**"]

#: Entities per nation: path, type, name, content, first and last line, visibility, calls, is_a, contains, language.
#: {n} is the nation's name, {l} the same in lower case, {long} a long text; lists are joined by |; an empty visibility is none.
TEMPLATES = [
    ("src/web/app/{n}/page.tsx", "module", "page", "", 1, 90, "public", "render|Card_{n}", "@/components/ui/{n}|./route|../../../lib/format_{n}|react", "Page_{n}|helper_{n}|gone_{n}", "tsx"),
    ("src/web/app/{n}/page.tsx", "function", "Page_{n}", "export default function Page_{n}() { return <Card_{n}/> }", 5, 20, "public", "Card_{n}|format_{n}|lib.format_{n}|Missing|user_1", "Layout", "", "tsx"),
    ("src/web/app/{n}/page.tsx", "function", "helper_{n}", "function helper_{n}() { } // within the page", 8, 12, "public", "Events.user_2|Loader_{n}", "", "", "tsx"),
    ("src/web/app/{n}/page.tsx", "function", "getRates", "function getRates() { return fetchAll() } // by convention", 30, 40, "public", "format_{n}|{n}", "", "", "tsx"),
    ("src/web/app/{n}/route.ts", "function", "GET", "export async function GET() { return db.read() }", 1, 9, "public", "db.read|helper_{n}", "", "", "typescript"),
    ("src/web/app/{n}/route.ts", "function", "Loader_{n}", "export const Loader_{n} = () => [open, setOpen]", 20, 30, "public", "GET|page", "./page", "", "typescript"),
    ("src/components/ui/{n}.tsx", "function", "Card_{n}", "export function Card_{n}(props) { return null }", 1, 9, "public", "cn|cx", "", "", "tsx"),
    ("src/lib/format_{n}.ts", "function", "format_{n}", "export function format_{n}(x) { return String(x) }", 1, 5, "public", "", "Formatter", "", "typescript"),
    ("src/lib/format_{n}.ts", "variable", "{ open_{n}, close }", "const { open_{n}, close } = useState() // a pattern", 7, 7, "public", "Page_{n}|format_{n}", "", "", "typescript"),
    ("src/lib/{n}.test.ts", "function", "check_{n}", "it('works', () => format_{n}(1)) // in a test file", 1, 3, "public", "format_{n}", "", "", "typescript"),
    ("src/web/{n}_controller.ex", "function", "show_{n}", "def show_{n}(conn, _), do: render(conn, :show)", 2, 6, "public", "render", "", "", "elixir"),
    ("src/web/{n}_server.ex", "function", "handle_call", "def handle_call(msg, from, state), do: reply(state)", 2, 6, "public", "reply", "", "", "elixir"),
    ("src/web/{n}_server.ex", "function", "lonely_{n}", "def lonely_{n}(a), do: a # nobody calls this one", 8, 9, "", "", "", "", "elixir"),
    ("src/web/{n}_server.ex", "macro", "with_{n}", "defmacro with_{n}(a), do: a # nobody calls this one", 11, 12, "public", "", "", "", "elixir"),
    ("src/pkg/{l}/main.go", "function", "Start", "func Start() { return } // the same name in each package", 1, 4, "public", "Setup_{n}|fmt.Println", "fmt", "", "go"),
    ("src/pkg/{l}/setup.go", "function", "Setup_{n}", "func Setup_{n}() { } // calls across packages", 1, 4, "public", "{l}.Start|other.Setup_{n}|other.Start", "Store_{n}", "", "go"),
    ("src/pkg/{l}/main_test.go", "function", "TestStart_{n}", "func TestStart_{n}(t *testing.T) { Start() }", 1, 4, "public", "Start", "", "", "go"),
    ("src/pkg/{l}/bench.go", "function", "BenchmarkStart_{n}", "func BenchmarkStart_{n}(b *testing.B) { Start() }", 1, 4, "public", "Start", "", "", "go"),
    ("src/pkg/{l}/store.go", "struct", "Store_{n}", "type Store_{n} struct { key string } // with a method", 1, 9, "public", "", "", "Put|key|Start", "go"),
    ("src/pkg/{l}/store.go", "method", "Store_{n}.Put", "func (s *Store_{n}) Put(k string) { s.key = k }", 11, 14, "public", "fmt.Println", "", "", "go"),
    ("src/adapters/{l}.ts", "function", "make_{n}", "export function make_{n}(): Store_{n} { return store }", 1, 5, "public", "", "Store_{n}", "", "typescript"),
    ("src/jobs/{l}.py", "function", "nightly_{n}", "def nightly_{n}(): run() # an entry point of the settings", 1, 3, "public", "Events.user_3", "", "", "python"),
    ("src/odd/{l}.js", "function", "Unknown", "function () { return 'a name that nobody knows' }", 1, 3, "public", "", "", "", "javascript"),
    ("src/odd/{l}.js", "function", "tiny_{n}", "x", 5, 5, "private", "", "", "", "javascript"),
    ("/tmp/{l}.py", "function", "scratch_{n}", "def scratch_{n}(): pass  # in a temporary folder", 1, 2, "public", "", "", "", "python"),
    ("src/long/{l}.py", "function", "long_{n}", "{long}", 1, 2, "public", "", "", "", "python"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def successions(events: DataFrame) -> DataFrame:
    """(user_id, callee, count): how often each user's event is followed by another user's.

    The order of events is cut by hour, with the first event of the next hour
    that has one as the last one's successor, so no window holds the table.
    """
    rows = events.select("event_id", "user_id", "ts", F.date_trunc("hour", "ts").alias("hour"))
    within = Window.partitionBy("hour").orderBy("ts", "event_id")
    firsts = rows.groupBy("hour").agg(F.min_by("user_id", F.struct("ts", "event_id")).alias("first"))
    firsts = firsts.select(F.col("hour").alias("h"), F.lead("first").over(Window.orderBy("hour")).alias("next_first"))  # one row per hour
    pairs = rows.withColumn("n", F.lead("user_id").over(within)).join(firsts, F.col("hour") == F.col("h"))
    pairs = pairs.select("user_id", F.coalesce("n", "next_first").alias("callee")).filter(F.col("callee").isNotNull() & (F.col("callee") != F.col("user_id")))
    return pairs.groupBy("user_id", "callee").count()


_STORED: dict[tuple[str, str, str], DataFrame] = {}


def _stored(spark: SparkSession, sf_dir: str, name: str, *parts: Callable[[], DataFrame]) -> DataFrame:
    """A table of the application, written once in the shared folder and read from there, so filters reach its files.

    Its parts are written one after the other, and what one has shuffled goes before the next.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        folder = scratch(spark, name)
        for part in parts:
            part().write.mode("append").option("compression", "zstd").parquet(folder)
            tidy(spark)
        _STORED[key] = spark.read.parquet(folder)
    return _STORED[key]


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entity table of a folder; each file is sorted by place."""
    return _stored(spark, sf_dir, "entities", *(lambda f=f: conform(f(spark, sf_dir)).sortWithinPartitions("file_path", "start_line", "id") for f in (_core, _services, _others)))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entities with their degrees: the graph as it is stored after ingest."""
    return _stored(spark, sf_dir, "nodes", lambda: ed.degrees(entities(spark, sf_dir)).repartitionByRange("name").sortWithinPartitions("name"))


def _no_names() -> Column:
    return F.array().cast("array<string>")


def _templates(spark: SparkSession, homes: DataFrame) -> DataFrame:
    """``TEMPLATES`` for each nation."""
    fields = "t_path string, t_type string, t_name string, t_content string, start_line long, end_line long, t_visibility string, t_calls string, t_is_a string, t_contains string, language string"
    names = [f.split()[0] for f in fields.split(", ")]
    rows = F.array(*[F.struct(*[F.lit(v).cast("long" if isinstance(v, int) else "string").alias(n) for n, v in zip(names, t, strict=True)]) for t in TEMPLATES])
    rows = homes.select("n_name", F.explode(rows).alias("t")).select("n_name", "t.*")

    def filled(column: str) -> Column:
        text = F.replace(F.replace(F.col(column), F.lit("{n}"), F.col("n_name")), F.lit("{l}"), F.lower("n_name"))
        return F.replace(text, F.lit("{long}"), F.repeat(F.lit("ü"), 2500))

    def listed(column: str) -> Column:
        return F.when(F.col(column) == "", _no_names()).otherwise(F.split(filled(column), "[|]"))

    return rows.select(
        filled("t_path").alias("file_path"), F.col("t_type").alias("entity_type"), filled("t_name").alias("name"), filled("t_content").alias("content"), "start_line", "end_line",
        F.nullif("t_visibility", F.lit("")).alias("visibility"), listed("t_calls").alias("calls"), listed("t_is_a").alias("is_a"), listed("t_contains").alias("contains"), "language",
    )


def _homes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")


def _sellers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with their module and its path."""
    module = F.concat_ws("_", "n_name", F.floor(F.col("s_suppkey") / GROUP).cast("string"))
    sellers = table(spark, sf_dir, "supplier").join(_homes(spark, sf_dir), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", "n_name", "r_name", module.alias("module"))
    return sellers.withColumn("path", F.concat(F.lit("src/core/"), F.col("r_name"), F.lit("/"), F.col("module"), F.lit(".ex")))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.translate("p_name", " ", "_"), F.lit("_"), F.floor(F.col("p_partkey") / 10).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("name"), "p_brand", "p_type", "p_size")


def _core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of a nation's suppliers as modules, suppliers as methods.

    Line items meet the names of their parts and go to the group of their
    supplier, where both kinds of entities are made: names move once.
    """
    group = F.floor(F.col("s_suppkey") / GROUP)
    sellers = _sellers(spark, sf_dir).withColumn("g", group).groupBy("g").agg(F.collect_list(F.struct("s_suppkey", "s_name", "n_name", "r_name", "module", "path")).alias("sellers"))
    items = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_suppkey").alias("s_suppkey"))
    calls = items.join(_parts(spark, sf_dir).select("p_partkey", "name").hint("shuffle_hash"), F.col("l_partkey") == F.col("p_partkey")).select(group.alias("k"), "s_suppkey", F.concat(F.lit("Lib."), F.col("name")).alias("call"))
    sells = calls.repartition("k").distinct().groupBy("k", "s_suppkey").agg(F.sort_array(F.collect_list("call")).alias("calls"))
    sells = sells.groupBy("k").agg(F.collect_list(F.struct("s_suppkey", "calls")).alias("sells"))
    rows = sellers.join(sells, F.col("g") == F.col("k"), "left").withColumn("sells", F.coalesce("sells", F.array().cast(sells.schema["sells"].dataType)))

    def sold(s: Column) -> Column:
        return F.get(F.filter("sells", lambda x: x["s_suppkey"] == s["s_suppkey"]), F.lit(0))["calls"]

    def entity(path: Column, kind: Column, name: Column, content: Column, start: Column, end: Column, visibility: Column, calls: Column, is_a: Column, contains: Column) -> Column:
        values = {"file_path": path, "entity_type": kind, "name": name, "content": content, "start_line": start.cast("long"), "end_line": end.cast("long"), "visibility": visibility, "calls": F.coalesce(calls, _no_names()), "is_a": is_a, "contains": contains, "language": F.lit("elixir")}
        return F.struct(*(v.alias(k) for k, v in values.items()))

    def method(s: Column) -> Column:
        key = s["s_suppkey"]
        content = F.concat(F.lit("method "), s["s_name"], F.lit(" of "), s["n_name"])
        return entity(s["path"], F.when(key % 11 == 0, "macro").otherwise(F.lit("method")), s["s_name"], content, key * 10 + 2, key * 10 + 10, F.when(key % 7 != 0, "public"), sold(s), _no_names(), _no_names())

    def module(h: Column) -> Column:
        used = F.flatten(F.transform(F.filter("sellers", lambda s: s["module"] == h["module"]), lambda s: F.coalesce(sold(s), _no_names())))
        own = F.transform(F.filter("sellers", lambda s: (s["path"] == h["path"]) & s["s_name"].isNotNull()), lambda s: s["s_name"])
        content = F.concat(F.lit("module "), h["module"], F.lit(" of "), h["r_name"])
        return entity(h["path"], F.lit("module"), h["module"], content, F.lit(1), F.lit(1_000_000_000), F.lit("public"), F.sort_array(F.array_distinct(used)), F.array(h["r_name"]), F.sort_array(F.array_distinct(own)))

    heads = F.array_distinct(F.transform("sellers", lambda s: F.struct(s["path"].alias("path"), s["module"].alias("module"), s["r_name"].alias("r_name"))))
    return rows.select(F.explode(F.concat(F.transform(heads, module), F.transform("sellers", method))).alias("e")).select("e.*")


def _services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as functions, which call the suppliers that they bought from; keys move, not names."""
    customer, orders, lineitem = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    buys = lineitem.select("l_orderkey", "l_suppkey").join(orders.select("o_orderkey", "o_custkey").hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_suppkey")
    sellers = ed.near(_sellers(spark, sf_dir).select("s_suppkey", F.concat_ws(".", "module", "s_name").alias("call")))
    buys = buys.repartition("o_custkey").distinct().join(sellers, F.col("l_suppkey") == F.col("s_suppkey"))
    buys = buys.groupBy("o_custkey").agg(F.array_distinct(F.sort_array(F.collect_list("call"))).alias("calls"))
    functions = customer.join(_homes(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey")).join(buys, F.col("c_custkey") == F.col("o_custkey"), "left")
    return functions.select(
        F.concat(F.lit("src/services/"), F.lower("c_mktsegment"), F.lit("/"), F.col("n_name"), F.lit(".py")).alias("file_path"), F.lit("function").alias("entity_type"), F.concat("n_name", F.lit("."), "c_name").alias("name"),
        F.concat(F.lit("def "), F.col("c_name"), F.lit("(): # "), F.col("c_mktsegment")).alias("content"), (F.col("c_custkey") * 10 + 1).alias("start_line"), (F.col("c_custkey") * 10 + 9).alias("end_line"),
        F.when(F.col("c_acctbal") < 0, "private").otherwise("public").alias("visibility"), F.array(F.lower("c_mktsegment")).alias("parameters"), "calls",
        F.when(F.col("c_custkey") % 5 == 0, F.array("n_name", "r_name")).otherwise(F.array("n_name")).alias("is_a"), F.lit("python").alias("language"),
    )


def _others(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as interfaces, parts as variables, users as functions, and templates."""
    region, events = table(spark, sf_dir, "region"), table(spark, sf_dir, "events")
    ports = region.select(
        F.concat(F.lit("src/ports/"), F.col("r_name"), F.lit(".go")).alias("file_path"), F.lit("interface").alias("entity_type"), F.col("r_name").alias("name"), F.concat(F.lit("interface "), F.col("r_name"), F.lit(" of all nations")).alias("content"),
        F.lit(1).alias("start_line"), F.lit(9).alias("end_line"), F.lit("public").alias("visibility"), F.lit("go").alias("language"),
    )
    variables = _parts(spark, sf_dir).select(
        F.concat(F.lit("src/lib/"), F.translate("p_brand", "#", "_"), F.lit("/"), F.lower("p_type"), F.lit(".js")).alias("file_path"), F.lit("variable").alias("entity_type"), "name",
        F.concat(F.lit("const "), F.col("name"), F.lit(" = make('"), F.col("p_type"), F.lit("', "), F.col("p_size").cast("string"), F.lit(")")).alias("content"), (F.col("p_partkey") + 1).alias("start_line"), (F.col("p_partkey") + 1).alias("end_line"),
        F.lit("public").alias("visibility"), F.lit("javascript").alias("language"),
    )
    callee = F.concat(F.when(F.col("callee") % 2 == 0, "user_").otherwise("Events.user_"), F.col("callee").cast("string"))
    called = successions(events).groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("k"), "callee", callee.alias("call")))), lambda x: x["call"]).alias("calls"))
    users = events.select("user_id").distinct().join(called.withColumnRenamed("user_id", "u"), F.col("user_id") == F.col("u"), "left")
    number = F.col("user_id").cast("string")
    users = users.select(
        F.concat(F.lit("src/web/handlers/group_"), (F.col("user_id") % 10).cast("string"), F.lit(".rb")).alias("file_path"), F.lit("function").alias("entity_type"), F.concat(F.lit("Events.user_"), number).alias("name"),
        F.concat(F.lit("def user_"), number, F.lit(" -- handles the events of one user")).alias("content"), (F.col("user_id") * 10 + 1).alias("start_line"), (F.col("user_id") * 10 + 8).alias("end_line"), F.lit("public").alias("visibility"), "calls", F.lit("ruby").alias("language"),
    )
    out = conform(ports)
    for rows in (variables, users, _templates(spark, _homes(spark, sf_dir))):
        out = out.unionByName(conform(rows))
    return out


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as (id, name, file_path, entity_type, content); some bear names of entities, some none, some are temporary."""
    docs = table(spark, sf_dir, "documents")
    number = F.col("doc_id").cast("string")
    name = F.when(F.col("doc_id") % 13 == 0, "Unknown").when(F.col("doc_id") % 4 == 0, F.concat(F.lit("Events.user_"), (1 + F.col("doc_id") % 40).cast("string"))).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("format_NATION_"), (F.col("doc_id") % 25).cast("string")))
    kind = F.when(F.col("doc_id") % 5 == 0, "variable").when(F.col("doc_id") % 5 == 1, "constant").otherwise("function")
    path = F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("/tmp/"), number)).otherwise(F.concat(F.col("source"), F.lit("/"), number))
    return docs.select(F.col("doc_id").alias("id"), name.otherwise(F.concat(F.lit("doc_"), number)).alias("name"), path.alias("file_path"), kind.alias("entity_type"), F.col("text").alias("content"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("semantic"), "label")


def file_versions(spark: SparkSession, sf_dir: str, before: str | None) -> DataFrame:
    """(path, sha256): a user's events, up to a moment, as a file; its digest is of sums over the digests of its lines.

    The sums don't depend on an order, so no user's events are gathered.
    """
    events = table(spark, sf_dir, "events")
    if before:
        events = events.filter(F.col("ts") < F.lit(before).cast("timestamp_ntz"))
    line = F.md5(F.concat_ws(":", F.col("event_id").cast("string"), "event_type").cast("binary"))
    halves = [F.sum(F.conv(F.substring(line, a, 12), 16, 10).cast("decimal(38,0)")).cast("string") for a in (1, 13)]
    body = F.concat_ws(":", F.count("*").cast("string"), *halves)
    return events.groupBy("user_id").agg(body.alias("body")).select(F.concat(F.lit("users/"), F.col("user_id").cast("string")).alias("path"), F.upper(F.sha2("body", 256)).alias("sha256"))
