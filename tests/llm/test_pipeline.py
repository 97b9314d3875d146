import random

import corpus_pipeline as p
import pytest
from graphloom.llm import decontaminate, pii, quality, queries, simhash

SF = "/root/testdata/sf0.001"
RNG = random.Random(3)


def test_stages_compose_and_take_effect(spark):
    docs = queries.table(spark, SF, "documents")
    columns = docs.columns
    kept = p.quality_rules(spark, docs, SF).cache()
    assert kept.columns == columns
    verdict = quality.annotate(docs, quality.train(docs, queries.table(spark, SF, "labels"))).filter("kept")
    assert {r[0] for r in kept.select("doc_id").collect()} == {r[0] for r in verdict.select("doc_id").collect()}
    one = p.near_dedup(spark, kept, SF).cache()
    assert one.columns == columns
    assert one.count() == simhash.annotate(kept).select("component_id").distinct().count()
    clean = p.decontamination(spark, one, SF).cache()
    assert clean.columns == columns
    assert decontaminate.annotate(clean, queries.table(spark, SF, "benchmark")).filter("contaminated").count() == 0
    private = p.personal_data(spark, clean, SF)
    assert private.columns == columns and private.count() == clean.count()
    out = p.byte_bpe(spark, private, SF)
    want = {r["doc_id"]: r["ids_sha256"] for r in out.collect()}
    got = {r["doc_id"]: r["ids_sha256"] for r in p.run(spark, SF).collect()}
    assert got == want


def test_stage_names():
    assert [n for n, _ in p.STAGES] == ["quality_rules", "near_dedup", "decontamination", "personal_data", "byte_bpe"]


def words(n):
    return " ".join(f"{RNG.choice(['alpha', 'beta', 'über', 'tree'])}{RNG.randrange(400)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Nulls in any column, empty and very long texts, ties and repeated rows, extra columns with clashing names."""
    text = words(80)
    rows = [(1, text), (1, text), (2, text), (3, None), (4, ""), (5, " \n "), (6, words(60_000)), (None, words(70)), (7, words(70) + " Mr. Adam Smith a@b.com"), (8, words(90)), (9, words(12))]
    docs = spark.createDataFrame([(i, t, None, None, None, "x", 7, "y", "z") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string, mark int, _gone string, count string")
    folder = f"file://{tmp_path_factory.mktemp('odd')}"
    docs.write.parquet(f"{folder}/documents.parquet")
    item = rows[9][1].split()
    spark.createDataFrame([(1, " ".join(item[20:50])), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(1, 1, None), (3, 0, 0), (None, 1, 1), (99, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages_on_odd_rows(spark, odd):
    docs = queries.table(spark, odd, "documents")

    def ids(df):
        assert df.columns == docs.columns
        return sorted(df.select("doc_id").collect(), key=repr)

    def key(*some):
        return sorted(((i,) for i in some), key=repr)

    assert ids(p.quality_rules(spark, docs, odd)) == key(1, 1, 2, 6, None, 7, 8)
    assert ids(p.near_dedup(spark, docs, odd)) == key(1, 3, 6, None, 7, 8, 9)
    assert ids(p.decontamination(spark, docs, odd)) == key(1, 1, 2, 3, 4, 5, 6, None, 7, 9)
    private = p.personal_data(spark, docs, odd)
    assert ids(private) == ids(docs)
    seven = private.filter("doc_id = 7").first()
    assert "Smith" not in seven["text"] and "a@b.com" not in seven["text"] and "Mr. " in seven["text"] and seven["n_chars"] == len(seven["text"])
    assert private.filter("doc_id = 3").first()["text"] is None
    tokens = {r["doc_id"]: r["n_tokens"] for r in p.byte_bpe(spark, docs, odd).collect()}
    assert tokens[3] == tokens[4] == 0 and tokens[6] > 60_000
    assert sorted((r[0] for r in p.run(spark, odd).select("doc_id").collect()), key=repr) == sorted((1, 6, None, 7), key=repr)


def test_stages_on_empty_tables(spark, tmp_path):
    for t in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"file://{tmp_path}/{t}.parquet")
    assert p.run(spark, f"file://{tmp_path}").count() == 0


def test_stages_without_labels_and_items(spark, tmp_path):
    for t in ("benchmark", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"file://{tmp_path}/{t}.parquet")
    docs, none = queries.table(spark, SF, "documents"), f"file://{tmp_path}"
    assert p.quality_rules(spark, docs, none).count() == quality.annotate(docs, quality.Model()).filter("not base_failed").count()
    assert p.decontamination(spark, docs, none).count() == docs.count()


def test_the_key_is_kept(spark):
    docs = spark.createDataFrame([(1, "Mr. Adam Smith")], "doc_id long, text string")
    assert p.personal_data(spark, docs, SF).first()["text"] == pii.redact(docs, key=pii.key_of(spark)).first()["text"]


def test_stages_give_back_the_heap(spark, odd):
    """Each has the executors (here the driver, too) collected in full before its rows are written; only then does a collector return memory."""
    docs = queries.table(spark, odd, "documents")

    def full():
        return sum(b.getCollectionCount() for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in b.getName())

    for name, stage in p.STAGES:
        before = full()
        stage(spark, docs, odd)
        assert full() > before, name
