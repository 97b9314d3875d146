"""The five-row graph, with results worked out by hand, and brute-force twins on random names."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions import names
from graphloom.operators import edges as ed
from graphloom.operators import graph, stats
from graphloom.schema import conform, indexable

ROWS = [
    ("chunk_1", "/app/lib/server.ex", "module", "Server", 1, 60, ["GenServer.start_link", "handle_call"], ["GenServer"], ["Server.handle_call", "Server.init"]),
    ("chunk_2", "/app/lib/server.ex", "function", "Server.handle_call", 5, 20, ["Logger.info"], [], []),
    ("chunk_3", "/app/lib/client.ex", "function", "Client.call_server", 1, 10, ["Server.handle_call"], [], []),
    ("chunk_4", "/app/lib/router.ex", "function", "Router.dispatch", 1, 10, ["Client.call_server"], [], []),
    ("chunk_5", "/app/lib/utils.ex", "function", "Utils.format", 1, 10, [], [], []),
]
COLUMNS = "id string, file_path string, entity_type string, name string, start_line long, end_line long, calls array<string>, is_a array<string>, contains array<string>"


@pytest.fixture(scope="module")
def five(spark):
    rows = spark.createDataFrame(ROWS, COLUMNS).withColumn("visibility", F.lit("public")).withColumn("language", F.lit("elixir")).withColumn("content", F.col("name"))
    return conform(rows).cache()


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_impact(five):
    assert values(graph.impact(five, "Server.handle_call", 1), "name") == [("Client.call_server",), ("Server",)]
    files = {r[0] for r in graph.affected_files(five, "Server.handle_call", 3).select("file_path").collect()}
    assert {"/app/lib/client.ex", "/app/lib/router.ex"} <= files
    assert graph.impact(five, "Router.dispatch", 3).count() == 0
    assert graph.impact(five, "Server.handle_call", 0).count() == 0


def test_impact_grows_with_depth(five):
    paths = [set(values(graph.impact(five, "Server.handle_call", d), "path")) for d in (1, 2, 3)]
    assert paths[0] <= paths[1] <= paths[2]


def test_impact_in_a_cycle(spark):
    rows = spark.createDataFrame([(f"f{i}", f"/f{i}", [f"f{(i + 1) % 3}"]) for i in range(3)], "name string, file_path string, calls array<string>")
    e = conform(rows.withColumn("entity_type", F.lit("function")))
    # the root isn't part of a path, so it comes back once
    assert values(graph.impact(e, "f0", 5), "depth", "name") == [(1, "f2"), (2, "f1"), (3, "f0")]


def test_callers_and_callees(five):
    assert values(graph.callers(five, "Client.call_server"), "name") == [("Router.dispatch",)]
    assert values(graph.callers(five, "GenServer"), "name") == [("Server",)]
    found = values(graph.callees(five, "Client.call_server"), "target", "dst_name", "resolved")
    assert found == [("Server.handle_call", "Server.handle_call", True)]
    assert values(graph.callees(five, "Server.handle_call"), "target", "resolved") == [("Logger.info", False)]


def test_degrees(five):
    got = {r["name"]: (r["incoming_count"], r["outgoing_degree"]) for r in ed.degrees(five).collect()}
    assert got["Server"] == (0, 5) or got["Server"] == (1, 5)
    assert got["Server.handle_call"][0] == 3  # contains, the module's bare call, the client's
    assert got["Client.call_server"] == (1, 1)
    assert got["Utils.format"] == (0, 0)


def test_hierarchy(five):
    assert values(graph.children(five, "Server"), "name") == [("Server.handle_call",), ("Server.init",)]
    assert values(graph.parents(five, "Server"), "ref", "dst_id") == [("GenServer", None)]


def test_community(five):
    assert values(graph.community(five, "/app/lib/client.ex"), "file_path", "coupling_score") == [("/app/lib/router.ex", 1), ("/app/lib/server.ex", 1)]


def test_dead_code(five):
    assert values(graph.dead_code(five), "name") == [("Router.dispatch",), ("Utils.format",)]


def test_find_by_strategy(five):
    assert graph.find(five, "call_server").first()["strategy"] == 1
    assert graph.find(five, "utils").first()["strategy"] == 2
    assert graph.find(five, "rmat").first()["strategy"] == 3
    assert graph.find(five, "nothing at all").count() == 0


def test_suffix_join_is_the_pairwise_match(spark):
    rng = random.Random(5)
    some = lambda: ".".join(rng.choice(["a", "b", "Ab", "", "c"]) for _ in range(rng.randint(1, 4)))
    left, right = sorted({some() for _ in range(60)}), sorted({some() for _ in range(60)})
    a, b = spark.createDataFrame([(x,) for x in left], "l string"), spark.createDataFrame([(x,) for x in right], "r string")
    met = ed.matched(a, "l", b, "r")
    got = sorted(tuple(r) for r in met.select("l", "r").collect())
    x = lambda s: s.lower()
    want = sorted((p, q) for p in left for q in right if x(p) == x(q) or x(p).endswith("." + x(q)) or x(q).endswith("." + x(p)))
    assert got == want
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_centrality_is_path_walking(spark):
    rng = random.Random(9)
    n = 12
    calls = {i: rng.sample(range(n), rng.randint(0, 3)) for i in range(n)}
    rows = [(f"n{i:02}", f"/file{i % 4}", [f"N{j:02}" for j in calls[i]]) for i in range(n)]
    e = conform(spark.createDataFrame(rows, "name string, file_path string, calls array<string>").withColumn("entity_type", F.lit("function")))
    score = dict.fromkeys(range(n), 0)
    for s in range(n):
        parent, order = {s: None}, [s]
        for x in order:
            for y in calls[x]:
                if y not in parent:
                    parent[y] = x
                    order.append(y)
        for x in order[1:]:
            p = parent[x]
            while p is not None and p != s:
                score[p] += 1
                p = parent[p]
    want = {}
    for i in range(n):
        want[f"/file{i % 4}"] = want.get(f"/file{i % 4}", 0) + score[i]
    assert {r["file_path"]: r["score"] for r in graph.critical_files(e).collect()} == {k: v for k, v in want.items() if v}


def test_small_graphs_have_no_centre(spark, five):
    assert graph.critical_files(five.limit(2)).count() == 0


def test_short_content_is_not_indexed(five):
    assert values(indexable(five), "name") == [("Server",)]


@pytest.mark.parametrize(("a", "b", "same"), [("a.render", "render", True), ("render", "A.Render", True), ("", "render", False), ("a.", "", True), ("prerender", "render", False)])
def test_matches(spark, a, b, same):
    assert spark.range(1).select(names.matches(F.lit(a), F.lit(b))).first()[0] is same


def test_predicates(spark):
    rows = spark.createDataFrame([("{ a, b }",), ("Foo",), ("Foobar",), (None,)], "name string")
    assert [r[0] for r in rows.select(names.is_noise("name")).collect()] == [True, True, False, True]
    paths = spark.createDataFrame([("src/core/x.ex",), ("lib/core/y.go",), ("a/b.rs",), ("x_test.go",)], "p string")
    assert [r[0] for r in paths.select(names.layer("p")).collect()] == ["domain", "domain", "other", "other"]
    assert [r[0] for r in paths.select(names.is_test_file("p")).collect()] == [False, False, False, True]
    assert [r[0] for r in paths.select(names.layer("p", {"native": "a/*.rs"})).collect()][2] == "native"
    assert spark.range(1).select(names.as_int(F.lit("12abc"), 5), names.as_int(F.lit("x"), 5)).first() == (12, 5)


def test_stats(five):
    assert values(stats.edge_totals(five), "kind", "n") == [("calls", 5), ("contains", 2), ("is_a", 1)]
    assert stats.layers(five).count() == 1
    assert stats.status(five).first()["files"] == 4


def entity_rows(spark, rows):
    """(path, type, name, start, end, calls, is_a, contains, visibility, language)."""
    columns = "file_path string, entity_type string, name string, start_line long, end_line long, calls array<string>, is_a array<string>, contains array<string>, visibility string, language string"
    return conform(spark.createDataFrame(rows, columns)).cache()


def test_impact_goes_on_under_the_refined_name(spark):
    e = entity_rows(spark, [
        ("/a", "module", "A", 1, 50, ["Base.run"], [], [], None, None), ("/a", "function", "A.early", 60, 70, ["run"], [], [], None, None), ("/a", "function", "A.inner", 5, 9, ["Base.run"], [], [], None, None),
        ("/b", "function", "B.use", 1, 5, ["inner"], [], [], None, None), ("/c", "module", "C", 1, 9, [], ["Base.run"], [], None, None), ("/a", "macro", "A.twice", 10, 12, ["Base.run"], [], [], None, None),
    ])
    got = values(graph.impact(e, "Base.run", 2), "depth", "path", "name")
    # the module becomes the function in its lines, the macro, which holds none, the first of its file; both stay beside that function itself
    assert [r for r in got if r[0] == 1] == [(1, "A.early|/a", "A.early")] + [(1, "A.inner|/a", "A.inner")] * 3 + [(1, "C|/c", "C")]
    assert [r[2] for r in got if r[0] == 2] == ["B.use"] * 3
    stored = ed.reference_index(e).cache()
    assert values(graph.impact(e, "Base.run", 2, stored), "depth", "path", "name") == got
    assert values(graph.callers(e, "Base.run"), "name", "kind") == [("A.early", "function"), ("A.inner", "function"), ("C", "module")]


def test_children_of_functions_and_others(spark):
    e = entity_rows(spark, [
        ("/p/page.tsx", "function", "Page", 1, 50, ["Card", "Nothing", "Lib.Thing"], [], ["kept"], None, None), ("/p/page.tsx", "function", "within", 5, 9, [], [], [], None, None), ("/p/page.tsx", "variable", "plain", 6, 7, [], [], [], None, None),
        ("/u/card.tsx", "function", "Card", 1, 5, [], [], [], None, None), ("/s.go", "struct", "Store", 1, 50, ["Card"], [], ["Put", "gone"], None, None), ("/s.go", "method", "Store.Put", 10, 20, [], [], [], None, None),
    ])
    assert values(graph.children(e, "Page"), "name", "resolved") == [("Card", True), ("kept", False), ("within", True)]
    assert values(graph.children(e, "Store"), "name", "resolved") == [("Store.Put", True), ("gone", False)]


def test_names_by_alias_path_and_base(spark):
    e = entity_rows(spark, [(f"/r/{p}", "function", n, 1, 2, [], [], [], None, None) for p, n in (("src/ui/button.tsx", "Button"), ("src/route.ts", "GET"), ("lib/my-card.js", "x"), ("src/ui/other.tsx", "Y"))])
    listed = spark.createDataFrame([(r,) for r in ("get", "@/ui/button", "#x/y", "./route", "../deep/My_Card", "~/no/where", "ui")], "ref string")
    got = {r["ref"]: (r["name"], r["way"]) for r in graph.resolve_names(listed, e, {"@/*": ["./src/*"]}).collect()}
    assert got == {"get": ("GET", 1), "@/ui/button": ("Button", 2), "#x/y": (None, None), "./route": ("GET", 2), "../deep/My_Card": ("x", 3), "~/no/where": (None, None), "ui": (None, None)}


def test_imports_couple_files(spark):
    e = entity_rows(spark, [
        ("/app/page.tsx", "function", "Page", 1, 9, ["format", "local"], ["@/lib/format", "react"], [], None, None), ("/app/page.tsx", "function", "local", 10, 12, [], [], [], None, None),
        ("/lib/format.ts", "function", "format", 1, 9, ["{ a, b }"], [], [], None, None), ("/lib/format.ts", "function", "other", 10, 19, ["x.local"], ["./page"], [], None, None), ("/z.ts", "function", "zed", 1, 2, [], ["pkg"], [], None, None),
        ("/y.ts", "function", "{ local, q }", 1, 2, ["local"], [], [], None, None),
    ])
    rows = values(graph.connections(e, "/app/page.tsx"), "file_path", "from_name", "to_name", "direction", "counts")
    assert rows == sorted([("/lib/format.ts", "other", "local", "incoming", True), ("/lib/format.ts", "other", "page.tsx", "imports", True), ("/lib/format.ts", "Page", "format", "outgoing", True), ("/lib/format.ts", "page.tsx", "format", "imported_by", True), ("/y.ts", "{ local, q }", "local", "incoming", False)])
    assert values(graph.community(e, "/app/page.tsx"), "file_path", "coupling_score") == [("/lib/format.ts", 4), ("/y.ts", 0)]


def test_dead_code_spares_ports_entry_points_and_conventions(spark):
    rows = [
        ("/a.ts", "function", "alone", None, "typescript"), ("/a.ts", "macro", "macro", "public", "elixir"), ("/a.ts", "function", "hidden", "private", "typescript"), ("/jobs/x.py", "function", "job", "public", "python"),
        ("/x.test.ts", "function", "tested", "public", "typescript"), ("/p/page.tsx", "function", "Home", "public", "tsx"), ("/components/ui/b.tsx", "function", "B", "public", "tsx"), ("/x.ex", "function", "mount", "public", "elixir"), ("/a.go", "function", "TestX", "public", "go"),
    ]
    e = entity_rows(spark, [(p, t, n, 1, 2, [], [], [], v, lang) for p, t, n, v, lang in rows] + [("/b.ts", "function", "made", 1, 2, [], ["Port"], [], "public", "typescript"), ("/p.go", "struct", "port", 1, 2, [], [], [], "public", "go")])
    assert values(graph.dead_code(e, entry_point=F.col("file_path").startswith("/jobs/")), "name") == [("alone",)]
    row = graph.dead_summary(e).first()
    assert (row["dead_count"], row["total_public"], row["unsure"]) == (2, 8, True)


def test_resolution_is_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    some = lambda: ".".join(rng.choice(["a", "b", "New", "c"]) for _ in range(rng.randint(1, 3)))
    rows = [(f"/f{rng.randrange(4)}", "function", some(), i, i, [some() for _ in range(rng.randrange(6))], [], [], None, None) for i in range(60)]
    e = entity_rows(spark, rows)
    known = sorted((r["file_path"], r["start_line"], r["id"], r["name"]) for r in e.collect())

    def match(a, b):
        a, b = a.lower(), b.lower()
        return a == b or a.endswith("." + b) or b.endswith("." + a)

    want = []
    for r in e.collect():
        for pos, target in enumerate(r["calls"]):
            way, found = 1, [k for k in known if match(target, k[3])]
            if not found:
                way, found = 2, [k for k in known if match(target.split(".")[-1], k[3])]
            own = [k for k in found if k[0] == r["file_path"]]
            want.append((r["id"], pos, target, (own or found)[0][2] if found else None, way if found else None))
    for hot in (1, 1 << 16):
        monkeypatch.setattr(ed.met_by_key, "__defaults__", (hot,))
        got = [tuple(x) for x in ed.resolve_calls(e).select("src_id", "pos", "target", "dst_id", "strategy").collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_view_links_by_package(spark):
    e = entity_rows(spark, [
        ("src/one/a.go", "function", "Start", 1, 2, [], [], [], None, None), ("src/two/a.go", "function", "Start", 1, 2, [], [], [], None, None), ("src/two/b.go", "function", "Single", 1, 2, [], [], [], None, None),
        ("src/c.go", "function", "Caller", 1, 9, ["two.Start", "x.Single", "none.Start", "caller"], ["Store"], [], None, None), ("src/s.go", "struct", "Store", 1, 9, [], [], ["Put", "single"], None, None), ("src/s.go", "method", "Store.Put", 10, 12, [], [], [], None, None),
    ])
    nodes = ed.degrees(e).cache()
    name = {r["id"]: (r["name"], r["file_path"]) for r in nodes.collect()}
    got = {(name[r["src_id"]][0], *name[r["dst_id"]], r["kind"]) for r in graph.view_links(nodes, graph.view_nodes(nodes)).collect()}
    assert got == {("Caller", "Start", "src/two/a.go", "calls"), ("Caller", "Single", "src/two/b.go", "calls"), ("Caller", "Store", "src/s.go", "is_a"), ("Store", "Store.Put", "src/s.go", "contains"), ("Store", "Single", "src/two/b.go", "contains")}
    shown = graph.view_nodes(nodes)
    keep, links = graph.view_filter(shown, graph.view_links(nodes, shown), None, 1, ["struct"], "src/two")
    assert {name[r["id"]] for r in keep.collect()} == {("Single", "src/two/b.go")} and links.count() == 1  # references count for the first Start


def test_scans_push_their_filters(spark, tmp_path):
    from graphloom.plans import adapters, queries

    plan = queries.QUERIES["path_prefix"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(file_path" in plan and "InMemoryTableScan" not in plan and "content" not in plan.split("ReadSchema")[-1]
    assert "EqualTo(id" in queries.QUERIES["point_lookup"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert adapters.entities(spark, "/root/testdata/sf0.001").count() == adapters.nodes(spark, "/root/testdata/sf0.001").count()


def test_words_percents_and_endings(spark):
    row = spark.createDataFrame([("call(a.b) ab_c", "a.b", 3, 0)], "t string, n string, x int, zero int").select(names.references("t", "n"), names.references("t", F.lit("b_c")), names.percent("x", F.lit(2)), names.percent("x", "zero"), names.endings(F.lit("ab"))).first()
    assert tuple(row) == (True, False, 100, 0, ["ab", "b", ""])
