import math

from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.operators import embedding
from graphloom.operators import retrieval as r


def docs(spark, texts):
    rows = [(i, f"d{i}", f"f/{i}", "function", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "id long, name string, file_path string, entity_type string, content string")


def test_tfidf_formula(spark):
    d = docs(spark, ["Alpha beta beta", "beta x", None, ""])
    tf = r.term_frequencies(d)
    assert {tuple(x) for x in tf.collect()} == {(0, "alpha", 1), (0, "beta", 2), (1, "beta", 1)}
    idf = {x["term"]: x["idf"] for x in r.vocabulary(tf, 4).collect()}
    assert idf == {"alpha": round(math.log(5 / 2) + 1, 6), "beta": round(math.log(5 / 3) + 1, 6)}


def test_dense_hash_is_a_unit_vector(spark):
    d = docs(spark, ["one two three two", "four"])
    tf = r.term_frequencies(d)
    rows = r.dense_hash(r.weights(tf, r.vocabulary(tf, 2))).groupBy("id").agg(F.sum(F.col("x") * F.col("x")).alias("n")).collect()
    assert all(abs(x["n"] - 1) < 1e-4 for x in rows) and len(rows) == 2


def test_hybrid_falls_back_to_keywords(spark):
    d = docs(spark, ["some words here", "more words"])
    nodes = spark.createDataFrame([], "name string, incoming_count long, calls array<string>")
    v = spark.createDataFrame([], "id long, semantic array<float>, label int")
    assert [x["name"] for x in r.hybrid_search(d, v, nodes, "e", None, 5).collect()] == ["d0", "d1"]
    assert [x["name"] for x in r.hybrid_search(d, v, nodes, "some", None, 5).collect()] == ["d0"]


def test_fusion_and_dedup(spark):
    a = spark.createDataFrame([(1, 0.9), (2, 0.8)], "id long, score double")
    b = spark.createDataFrame([(2, 3.0), (3, 1.0)], "id long, score double")
    got = {x["id"]: x["score"] for x in r.fuse(a, b).collect()}
    assert got == {1: round(1 / 61, 6), 2: round(1 / 62 + 1 / 61, 6), 3: round(1 / 62, 6)}
    hits = spark.createDataFrame([(1, "n", "t", 0.1), (2, "n", "t", 0.3), (3, "n", "u", 0.2)], "id long, name string, entity_type string, score double")
    assert sorted(x["id"] for x in r.deduplicate(hits).collect()) == [2, 3]


def test_graph_boost(spark):
    hits = spark.createDataFrame([(i, f"n{i}", 1.0 - i / 10) for i in range(8)], "id long, name string, score double")
    nodes = spark.createDataFrame([("n5", 3, []), ("n6", 0, ["n0", "n1"]), ("n7", 50, [])], "name string, incoming_count long, calls array<string>")
    boost = {x["name"]: x["boost"] for x in r.graph_boost(hits, nodes).collect()}
    assert boost == {**{f"n{i}": 0.1 for i in range(5)}, "n5": 0.06, "n6": 0.06, "n7": 0.1}


def test_truncation_keeps_characters_whole(spark):
    assert spark.range(1).select(text.truncate_bytes(F.lit("aé" * 3), 5)).first()[0] == "aéa"


def test_sparse_top_is_the_formula(spark):
    texts = ["alpha beta beta gamma", "beta alpha", None, "Alpha alpha ALPHA x", "nothing of it", "gamma_beta beta"]
    asked = r.query_terms("alpha Beta missing")
    assert asked == {"alpha": 3, "beta": 3, "missing": 3}
    tokens = [[t for t in __import__("re").split("[^a-z0-9_]+", (x or "").lower()) if len(t) > 1] for x in texts]
    df = {t: sum(t in k for k in tokens) for t in asked}
    idf = {t: round(math.log((len(texts) + 1) / (n + 1)) + 1, 6) if n else 1.0 for t, n in df.items()}
    want = []
    for i, k in enumerate(tokens):
        buckets = {}
        for t in asked:
            q = buckets.setdefault(text.bucket_of(t), [0.0, 0.0])
            q[1] += round((1 + math.log(3)) * idf[t], 6)
            q[0] += round((1 + math.log(k.count(t))) * idf[t], 6) if t in k else 0.0
        if any(t in k for t in asked):
            want.append((round(sum(round(a * b, 6) for a, b in buckets.values()), 4), i))
    got = [(x["score"], x["id"]) for x in r.sparse_top(docs(spark, texts), "alpha Beta missing", 10).collect()]
    assert got == sorted(want, key=lambda x: (-x[0], x[1]))
    assert r.sparse_top(docs(spark, texts), "? !", 10).count() == 0


def test_one_arm_answers_alone(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [0.6, 0.8], 1)], "id long, semantic array<float>, label int")
    broken = docs(spark, ["a b", "c d"]).drop("content")
    assert [tuple(x) for x in r.arms(broken, v, "some", [1.0, 0.0], 5).collect()] == [(0, 1.0), (1, 0.6)]
    assert r.arms(docs(spark, ["some", "more"]), v, "some", None, 5).count() == 1


def test_hybrid_leaves_out_unnamed_and_temporary_hits(spark):
    rows = [(0, "Unknown", "f", "function", "word word"), (1, "t", "/tmp/f", "function", "word"), (2, "a", "f", "variable", "word"), (3, "a", "g", "variable", "word other"), (4, "b", "f", "function", "word here")]
    d = spark.createDataFrame(rows, "id long, name string, file_path string, entity_type string, content string")
    nodes = spark.createDataFrame([("b", 4, [])], "name string, incoming_count long, calls array<string>")
    v = spark.createDataFrame([], "id long, semantic array<float>, label int")
    got = [(x["id"], x["name"]) for x in r.hybrid_search(d, v, nodes, "word", None, 5).collect()]
    assert got == [(2, "a"), (4, "b")]


def flaky_encoder():
    def flaky():  # by value: workers can't import the tests
        tries = []

        def encode(texts):
            tries.append(1)
            if "slow" in texts[0] and len(tries) < 3:
                raise TimeoutError
            if "bad" in texts[0]:
                raise ValueError("no")
            return [] if "short" in texts[0] else [[1.0, 0.0]] * len(texts)

        return encode

    return flaky


def test_encoder_retries_and_falls_back(spark):
    flaky = flaky_encoder()
    d = docs(spark, ["slow one", "bad two words", "short three", None, ""])
    terms = r.vocabulary(r.term_frequencies(d), 5)
    got = {x["id"]: x for x in embedding.embed(d, flaky, terms, batch=1, pause=0.01).collect()}
    assert [got[i]["way"] for i in range(5)] == ["model", "tfidf", "tfidf", "model", "model"] and len(got[1]["semantic"]) == text.DIMENSIONS
    assert abs(sum(x * x for x in got[1]["semantic"]) - 1) < 1e-4
    assert embedding.embed(d.coalesce(1), flaky, terms, batch=5, tries=1, pause=0.01).filter("way = 'tfidf'").count() == 5
    assert embedding.query_vector("slow", flaky, terms, pause=0.01)[1] == "model"
    vector, way = embedding.query_vector("bad two", flaky, terms, pause=0.01)
    assert way == "tfidf" and abs(sum(x * x for x in vector) - 1) < 1e-9
    assert embedding.query_vector("!", None, terms)[1] == "zeros"
