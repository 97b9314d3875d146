"""What large tables need: nothing moves or is stored that a question doesn't ask for."""

import random

from pyspark.sql import functions as F

from graphloom.operators import edges as ed
from graphloom.operators import graph
from graphloom.schema import conform


def random_graph(spark, n=40, most=5, seed=3):
    rng = random.Random(seed)
    some = lambda: ".".join(rng.choice("abcd") for _ in range(rng.randint(1, 3)))
    rows = [(f"/f{rng.randrange(5)}", rng.choice(["function", "module", "macro"]), some(), i, i + rng.randrange(9), [some() for _ in range(rng.randrange(most))], [some() for _ in range(rng.randrange(2))]) for i in range(n)]
    return conform(spark.createDataFrame(rows, "file_path string, entity_type string, name string, start_line long, end_line long, calls array<string>, is_a array<string>")).cache()


def written(spark, monkeypatch):
    """The row counts of all that is checkpointed from now on."""
    counts = []
    for module in (ed, graph):
        monkeypatch.setattr(module, "settle", lambda df, f=module.settle: (out := f(df), counts.append(out.count()))[0])
    return counts


def test_impact_stores_only_what_matches(spark, monkeypatch):
    e = conform(spark.createDataFrame([(f"n{i}", f"/f{i}", ["a.root" if i < 2 else f"x.y{i}.z{k}" for k in range(50)]) for i in range(40)], "name string, file_path string, calls array<string>")).cache()
    counts = written(spark, monkeypatch)
    assert sorted(r["name"] for r in graph.impact(e, "root", 1).collect()) == ["n0", "n1"]
    assert max(counts) <= 100  # the index had 6000 rows


def test_references_are_those_of_the_index(spark):
    e = random_graph(spark)
    wanted = spark.createDataFrame([(x,) for x in ("a", "b.c", "A.B.C", "d.", "nobody")], "at string")
    found = {tuple(r) for r in ed.references_to(e, wanted).select("at", "s_id", "kind").collect()}
    assert found == {tuple(r) for r in ed.referring(ed.reference_index(e), wanted).select("at", "s_id", "kind").collect()} and len(found) > 20


def test_the_tables_entities_move_keys_not_arrays(spark):
    """No exchange has the finished entities in it, as a range by place had."""
    from graphloom.plans import adapters

    for part in (adapters._core, adapters._services):
        plan = conform(part(spark, "/root/testdata/sf0.001")).sortWithinPartitions("file_path")._jdf.queryExecution().executedPlan().toString()
        assert "rangepartitioning" not in plan and plan.count("Exchange hashpartitioning") <= 6


def test_affected_files_count_the_paths_of_impact(spark, monkeypatch):
    e = random_graph(spark, 24)
    paths = graph.impact(e, "a.b", 3)
    want = sorted((r["file_path"], r["n"], r["d"]) for r in paths.groupBy("file_path").agg(F.count("*").alias("n"), F.min("depth").alias("d")).collect())
    last = paths.filter("depth = 3").count()
    counts = written(spark, monkeypatch)
    assert sorted(tuple(r) for r in graph.affected_files(e, "a.b", 3).collect()) == want
    assert max(counts) < last
    assert graph.affected_files(e, "a.b", 0).count() == 0


def test_centrality_stores_no_tree(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(f"N{i}", f"/f{i % 7}", [f"n{rng.randrange(60)}" for _ in range(rng.randrange(6))] + ["Lib.unknown"] * 20) for i in range(60)]
    e = conform(spark.createDataFrame(rows, "name string, file_path string, calls array<string>")).cache()
    monkeypatch.setattr(graph, "HELD", 0)
    grown = graph.critical_files(e).collect()
    monkeypatch.undo()
    counts = written(spark, monkeypatch)
    assert graph.critical_files(e).collect() == grown and len(grown) == 7
    assert max(counts) < 400  # at most an edge each, where trees of 50 sources have some thousands of nodes


def test_entities_choose_nodes_without_their_calls(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(graph, "settle", lambda df, f=graph.settle: (kept.append(df.dtypes), f(df))[1])
    graph.critical_files(random_graph(spark, 30)).collect()
    assert kept and not any(kind.startswith("array") for types in kept for _, kind in types)


def test_top_connected_moves_no_lists(spark):
    from graphloom.operators import stats

    plan = stats.top_connected(random_graph(spark).select("*"))._jdf.queryExecution().optimizedPlan().toString()
    joined = plan.split("Join LeftOuter")[1].split("Generate")[0]
    assert "size(calls" in joined  # counted below the join


def test_resolution_moves_edges_of_rare_targets_only(spark, monkeypatch):
    e = conform(spark.createDataFrame([(f"n{i}", f"/f{i % 3}", [f"n{i % 2}", f"x.n{i}"]) for i in range(60)], "name string, file_path string, calls array<string>")).cache()
    want = sorted(map(tuple, ed.resolve_calls(e).collect()))
    monkeypatch.setattr(ed.met_by_key, "__defaults__", (1,))
    monkeypatch.setattr(ed, "BROADCAST", 5)
    assert sorted(map(tuple, ed.resolve_calls(e).collect())) == want
    monkeypatch.undo()
    monkeypatch.setattr(ed.met_by_key, "__defaults__", (1,))
    plan = ed.resolve_calls(e)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan  # all targets fit a broadcast, so no edge moves
