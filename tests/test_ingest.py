import pytest
from pyspark.sql import functions as F

from graphloom.plans.ingest import Workspace
from graphloom.sources import extract, scan
from graphloom.streaming import incremental, streams

SOURCES = {
    "python": ("a/shop.py", "import os\nfrom x import y\n\nclass Shop(Base):\n    def sell(self, n):\n        return os.path.join(y(n))\n\ndef _hide():\n    pass\n", {("class", "Shop"), ("method", "Shop.sell"), ("function", "_hide"), ("module", "shop")}),
    "elixir": ("a.ex", "defmodule A.B do\n  use GenServer\n  def run(x) do\n    go(x)\n  end\n  defp hide(y) do\n    y\n  end\nend\n", {("module", "A.B"), ("function", "run"), ("function", "hide")}),
    "go": ("a.go", 'package a\nimport "fmt"\ntype Store struct {\n}\nfunc (s *Store) Put(k string) {\n\tfmt.Println(k)\n}\nfunc help() {\n}\n', {("struct", "Store"), ("method", "Store.Put"), ("function", "help"), ("module", "a")}),
    "rust": ("a.rs", "use std::fmt;\npub struct P {\n}\nimpl P {\n    pub fn new() -> P {\n        vec![1]; make()\n    }\n}\npub trait T {\n}\n", {("struct", "P"), ("method", "P.new"), ("interface", "T"), ("module", "a")}),
    "java": ("A.java", "import java.util.List;\npublic class A extends B implements C {\n    private int f(int x) {\n        return g(new D());\n    }\n}\n", {("class", "A"), ("method", "A.f"), ("module", "A")}),
    "javascript": ("web/index.js", "import x from './x'\nexport class V extends W {\n  draw(a) {\n    return <Box/>\n  }\n}\nconst helper = (q) => {\n  go(q)\n}\n", {("class", "V"), ("method", "draw"), ("function", "helper"), ("module", "web")}),
    "ruby": ("a.rb", "require 'json'\nclass A < B\n  def run(x)\n    go(x)\n  end\nend\n", {("class", "A"), ("function", "run"), ("module", "a")}),
    "kotlin": ("a.kt", "import a.b\nclass A : B() {\n  fun run(x: Int) {\n    go(x)\n  }\n}\n", {("class", "A"), ("function", "run"), ("module", "a")}),
    "swift": ("a.swift", "import UIKit\nstruct S: P {\n  func run(x: Int) {\n    go(x)\n  }\n}\n", {("struct", "S"), ("function", "run"), ("module", "a")}),
}


@pytest.mark.parametrize("language", SOURCES)
def test_extractors(language):
    path, source, want = SOURCES[language]
    rows = extract.parse(path, language, source)
    assert {(r["entity_type"], r["name"]) for r in rows} == want
    assert all(r["error"] is None for r in rows)


def test_python_edges():
    rows = {r["name"]: r for r in extract.parse(*[SOURCES["python"][0], "python", SOURCES["python"][1]])}
    assert rows["Shop.sell"]["calls"] == ["os.path.join", "x.y"]
    assert rows["Shop"]["is_a"] == ["Base"] and rows["Shop"]["contains"] == ["sell"]
    assert rows["_hide"]["visibility"] == "private" and rows["shop"]["is_a"] == ["os", "x"]


def test_unreadable_source_is_reported(spark):
    files = spark.createDataFrame([("a.py", "python", "def ("), ("b.py", "python", "def f(): pass"), ("c", None, "x")], "path string, language string, content string")
    rows = extract.extract(files).collect()
    assert sum(r["error"] is not None for r in rows) == 1
    assert {r["name"] for r in extract.entities(files).collect()} == {"f", "b"}


def test_scan_and_skips(spark, tmp_path):
    for p in ("src/a.py", "node_modules/x.js", ".hidden/b.py", "src/notes.txt", "gen/c.py", "src/skip_me.py", "src/__init__.py"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("def f(): pass\n")
    found = scan.scan(spark, [str(tmp_path)], scan.parse_ignore("# no\n!x\nskip_*.py\n"), scan.parse_ignore("/gen/\n"))
    skip = {r["path"]: r["skip"] for r in found.collect()}
    assert skip == {"src/a.py": None, "node_modules/x.js": "default", ".hidden/b.py": "dot_folder", "src/notes.txt": "extension", "gen/c.py": "gitignore", "src/skip_me.py": "project_ignore", "src/__init__.py": None}
    assert {r["reason"]: r["n"] for r in scan.skip_counts(found).collect()}["indexed"] == 2


def test_project_settings():
    p = scan.parse_project('[entry_points]\ninclude = ["bin/*"]\n[layers]\nedge = "src/edge/**"\n')
    assert p.entry_points == ["bin/*"] and p.layers == {"edge": "src/edge/**"}
    assert scan.parse_project("not = [toml") == scan.Project()
    assert scan.expand_alias("@/a/b", scan.parse_aliases('{"compilerOptions": {"paths": {"@/*": ["src/*"]}}}')) == ["src/a/b"]


def test_incremental_equals_rebuild(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, sha256 string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "path string, sha256 string")
    assert {tuple(r) for r in incremental.changed(old, new).collect()} == {("b", "changed"), ("c", "removed"), ("d", "added")}
    state = spark.createDataFrame([("a", "a1"), ("b", "b1"), ("b", "b2"), ("c", "c1")], "file_path string, id string")
    fresh = spark.createDataFrame([("a", "a1"), ("b", "b3"), ("d", "d1")], "file_path string, id string")
    assert sorted(map(tuple, incremental.reindex(state, old, new, fresh).collect())) == sorted(map(tuple, fresh.collect()))


def test_store_versions(spark, tmp_path):
    store = incremental.Store(spark, f"file://{tmp_path}/store")
    assert store.read("My Project") is None
    rows = spark.createDataFrame([(1, "a")], "id long, name string")
    store.write("My Project", rows)
    store.write("My Project", incremental.upsert(store.read("My Project"), spark.createDataFrame([(1, "b"), (2, "c")], "id long, name string")))
    assert sorted(map(tuple, store.read("My Project").collect())) == [(1, "b"), (2, "c")]
    assert sorted(map(tuple, store.read("My Project", 1).collect())) == [(1, "a")]
    assert store.projects() == ["my_project"]
    store.drop("My Project")
    assert store.versions("My Project") == []


def test_stream_equals_batch(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    got = streams.drain(streams.first_seen(streams.event_stream(spark, sf), ["user_id"]))
    assert got.count() == spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id")).distinct().count()


def tree(base, files):
    for name, body in files.items():
        (base / name).parent.mkdir(parents=True, exist_ok=True)
        (base / name).write_text(body)


def test_roots_keep_files_of_one_name(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scan, "HIDDEN_BYTES", 10)  # blocks, not a bound
    tree(tmp_path, {f"{r}/{f}": f"{r}{f}" for r in ("r1", "r2") for f in ("src/main.py", "src/__init__.py", "_x/y.py", "a b+%41.py")} | {"r1/src/deep/_z.py": "z"})
    roots = [str(tmp_path / x) for x in ("r1", "r2", "r1/src", "r2")]
    found = {(r["path"], r["content"]) for r in scan.scan(spark, roots).collect()}
    assert found == {(str(tmp_path / r / f), f"{r}{f}") for r in ("r1", "r2") for f in ("src/main.py", "src/__init__.py", "_x/y.py", "a b+%41.py")} | {(str(tmp_path / "r1/src/deep/_z.py"), "z")}
    assert {r["path"] for r in scan.scan(spark, roots[:1]).collect()} == {"src/main.py", "src/__init__.py", "_x/y.py", "a b+%41.py", "src/deep/_z.py"}
    assert scan.scan(spark, []).count() == 0


def test_rules_of_a_root(spark, tmp_path):
    files = ["a.min.js", "a.js", "x.d.ts", "yarn.lock", "own/b.py", "gen/c.py", "docs/internal/d.py", "docs/e.py", "node_modules/gen/f.py", "k_skip.py"]
    tree(tmp_path, dict.fromkeys(files, "x = 1") | {".gitignore": "gen/\n!a.js\n*_skip.py", ".indexignore": "own\ndocs/internal/\n"})
    rows = {r["path"]: (r["skip"], r["pruned"]) for r in scan.scan(spark, [str(tmp_path)]).collect()}
    want = {"a.min.js": "default", "a.js": None, "x.d.ts": "default", "yarn.lock": "default", "own/b.py": "project_ignore", "gen/c.py": "gitignore", "docs/internal/d.py": "project_ignore", "docs/e.py": None, "node_modules/gen/f.py": "default", "k_skip.py": "gitignore"}
    assert {k: rows[k][0] for k in want} == want and rows["node_modules/gen/f.py"][1] == "node_modules" and rows["docs/internal/d.py"][1] == "docs/internal"


def test_only_indexed_files_are_opened(spark, tmp_path):
    tree(tmp_path, {f"node_modules/{i}.js": "x" for i in range(9)} | {"a.py": "x = 1", "b.txt": "no"})
    (tmp_path / "node_modules/0.js").chmod(0)
    found = scan.scan(spark, [str(tmp_path)])
    assert found.filter("content is not null").count() == 1
    files = found.select("content")._jdf.queryExecution()
    files.toRdd().count()
    scans = [x for x in files.executedPlan().toString().split("\n") if "FileScan binaryFile" in x]
    assert any("content" in x.split("ReadSchema")[-1] for x in scans) and any("content" not in x.split("ReadSchema")[-1] for x in scans)


def test_source_roots(spark, tmp_path):
    tree(tmp_path, {"web/src/a.ts": "", "api/x.py": "", "mono/one/lib/b.rb": "", "mono/two/cmd/c.go": "", "flat/d.py": ""})
    base = str(tmp_path)
    assert scan.source_roots(spark, base) == [base]
    assert scan.source_roots(spark, base, curated=True) == [f"{base}/api"]
    assert scan.source_roots(spark, f"{base}/mono", curated=True) == [f"{base}/mono/one/lib", f"{base}/mono/two/cmd"]
    assert scan.source_roots(spark, f"{base}/flat", curated=True) == [f"{base}/flat"]


def test_aliases_are_patterns():
    aliases = scan.parse_aliases('{"compilerOptions": {"paths": {"@/*": ["./src/*", "lib/*"], "config": ["./cfg"]}}}')
    assert scan.expand_alias("@/a", aliases) == ["src/a", "lib/a"] and scan.expand_alias("config", aliases) == ["cfg"] and scan.expand_alias("configs", aliases) == ["configs"]


def test_calls_from_imports_literals_and_types():
    source = "import fetchAll, {\n  one as two,\n  type Three\n} from './api'\nimport * as ns from 'ns'\nexport function load(x: Other): Port {\n  return two + ns\n}\nexport const item: Item = make()\nconst go = (a: A): Repo<B> => { run(a) }\n"
    rows = {r["name"]: r for r in extract.parse("a.ts", "typescript", source)}
    assert rows["load"]["calls"] == ["two", "ns"] and rows["load"]["is_a"] == ["Port"] and rows["item"]["is_a"] == ["Item"] and rows["go"]["is_a"] == ["Repo"]
    go = "package a\nfunc New() *Server {\n\tif x {\n\t}\n\tm := map[Key]Peer{}\n\treturn &Server{opts: pkg.Opts{}, list: []Item{}}\n}\n"
    assert {"Server", "Opts", "Item", "Peer", "Key"} <= set({r["name"]: r for r in extract.parse("a.go", "go", go)}["New"]["calls"])
    python = "from db import read, write as put\nimport os\ndef f(x):\n    handler = read\n    return os, put_all\ndef g():\n    return put\n"
    rows = {r["name"]: r["calls"] for r in extract.parse("a.py", "python", python)}
    assert rows["f"] == ["db.read"] and rows["g"] == ["db.write"]


def test_refresh_equals_a_full_index(spark, tmp_path):
    def files(some):
        rows = spark.createDataFrame([(p, "python", c) for p, c in some.items()], "path string, language string, content string")
        return rows.withColumn("sha256", F.upper(F.sha2("content", 256)))

    body = "def {0}(value):\n    return value + other_{0}(value)\n"
    first = {f"{n}.py": body.format(n) for n in "abc"}
    second = {"a.py": first["a.py"], "b.py": body.format("changed"), "d.py": body.format("d"), "e.py": "def ("}
    one, two = (Workspace(spark, f"file://{tmp_path}/{x}") for x in ("one", "two"))
    assert one.refresh("p", files(first)) == {"parsed": 3, "removed": 0, "failed": 0, "chunks": 6, "version": 1}
    assert one.refresh("p", files(second)) == {"parsed": 3, "removed": 1, "failed": 1, "chunks": 6, "version": 2}
    assert one.refresh("p", files(second))["version"] == 2
    two.index("p", files(second))
    for table in ("files", "entities", "errors", "vocabulary", "vectors", "keywords"):
        assert sorted(map(repr, one.store.read("p", table=table).collect())) == sorted(map(repr, two.store.read("p", table=table).collect())), table
    assert one.health("p").first()["state"] == "healthy" and one.health("none").first()["state"] == "degraded"
    one.store.vacuum("p", 1)
    assert one.store.versions("p") == [2]
    one.store.purge("p")
    assert one.store.read("p") is None and one.refresh("p", files(second))["parsed"] == 4 and not one.store.take_full("p")
    assert one.startup("p") == "p" and one.switch("p").count() == 6 and one.store.current() == "p"


def test_late_rows_are_dropped(spark):
    from graphloom.plans.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    got = sum(r["n"] for r in QUERIES["late_data"](spark, sf).collect())
    assert 0 < got < 2 * spark.read.parquet(f"{sf}/events.parquet").filter("event_type = 'error'").count()
