"""Hybrid retrieval: TF-IDF, dense vectors, rank fusion, boosts and the keyword fallback."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names, text
from ..storage import settle
from .edges import near

#: Rank fusion constant of Cormack et al. (2009), ranks from 1.
FUSION = 60
SEEDS, SEED_BOOST, TYPE_BOOST = 5, 0.1, 1.15
DIGITS = 6


def term_frequencies(docs: DataFrame, text_column: str = "content", id_column: str = "id") -> DataFrame:
    """(id, term, n): occurrences per document."""
    return docs.select(F.col(id_column).alias("id"), F.explode(text.tokens(text_column)).alias("term")).groupBy("id", "term").agg(F.count("*").alias("n"))


def vocabulary(frequencies: DataFrame, total: int) -> DataFrame:
    """(term, df, idf): idf = ln((N + 1) / (df + 1)) + 1."""
    return frequencies.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", F.round(F.ln((F.lit(total) + 1) / (F.col("df") + 1)) + 1, DIGITS))


def weights(frequencies: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, term, w): (1 + ln n) * idf, idf 1 for unknown terms."""
    known = terms.select(F.col("term").alias("_t"), "idf")
    met = frequencies.join(known, F.col("term") == F.col("_t"), "left")
    return met.select("id", "term", F.round((1 + F.ln("n")) * F.coalesce("idf", F.lit(1.0)), DIGITS).alias("w"))


def sparse(weighted: DataFrame) -> DataFrame:
    """(id, bucket, w): weights of colliding terms summed."""
    return weighted.groupBy("id", text.bucket("term").alias("bucket")).agg(F.round(F.sum("w"), DIGITS).alias("w"))


def dense_hash(weighted: DataFrame) -> DataFrame:
    """(id, bucket, x): signed feature hashing, unit length per document."""
    signed = weighted.groupBy("id", text.bucket("term").alias("bucket")).agg(F.round(F.sum(F.col("w") * text.sign("term")), DIGITS).alias("s"))
    norm = signed.groupBy("id").agg(F.sqrt(F.sum(F.round(F.col("s") * F.col("s"), DIGITS))).alias("norm")).withColumnRenamed("id", "_id")
    met = signed.join(norm, F.col("id") == F.col("_id"))
    return met.select("id", "bucket", F.when(F.col("norm") > 0, F.col("s") / F.col("norm")).otherwise(0.0).alias("x"))


def query_terms(query: str) -> dict[str, int]:
    """The tokens of the tripled query with their counts."""
    return dict(Counter(t for t in re.split("[^a-z0-9_]+", text.boosted_query(query).lower()) if len(t) >= 2))


def sparse_top(docs: DataFrame, query: str, k: int, text_column: str = "content") -> DataFrame:
    """(id, score): sparse dot product with the tripled query, best k, ties by id.

    A row's counts of the query's terms are taken within the row, so the texts
    are read once and nothing but document frequencies and the best k is
    shuffled.
    """
    asked = query_terms(query)
    terms = sorted(asked)
    if not terms:
        return docs.select("id", F.lit(0.0).alias("score")).limit(0)

    def counts(own: Column) -> Column:
        return F.array(*[F.size(F.filter(own, _equals(term))) for term in terms])

    own = F.filter(text.tokens(text_column), lambda t: t.isin(terms))
    hit = docs.select("id", F.transform(F.array(own), counts)[0].alias("n")).filter(F.exists("n", lambda n: n > 0))
    hit = settle(hit)
    total = docs.count()
    idf, weight = [], []
    for i, term in enumerate(terms):
        df = F.count_if(F.col("n")[i] > 0)
        known = F.when(df > 0, F.round(F.ln(F.lit(total + 1) / (df + 1)) + 1, DIGITS)).otherwise(1.0)
        idf.append(known.alias(f"i{i}"))
        weight.append(F.round((1 + F.ln(F.lit(asked[term]))) * known, DIGITS).alias(f"w{i}"))
    row = hit.agg(*idf, *weight).first()
    buckets: dict[int, list[int]] = {}
    for i, term in enumerate(terms):
        buckets.setdefault(text.bucket_of(term), []).append(i)
    score = F.lit(0.0)
    for some in buckets.values():
        w = F.lit(0.0)
        for i in some:
            n = F.col("n")[i]
            w = w + F.when(n > 0, F.round((1 + F.ln(n)) * row[f"i{i}"], DIGITS)).otherwise(0.0)
        score = score + F.round(w * sum(row[f"w{i}"] for i in some), DIGITS)
    return hit.select("id", F.round(score, 4).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def _equals(term: str) -> Callable[[Column], Column]:
    return lambda t: t == term


def dense_top(vectors: DataFrame, query: list[float], k: int, where: F.Column | None = None) -> DataFrame:
    """(id, score): exact cosine scan, best k, ties by id; a filter goes before it."""
    rows = vectors if where is None else vectors.filter(where)
    q = F.array(*[F.lit(float(x)) for x in query])
    return rows.select("id", F.round(text.cosine("semantic", q), DIGITS).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def ranked(arm: DataFrame) -> DataFrame:
    """(id, rank) of a top-k arm, which holds at most k rows."""
    return arm.select("id", F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("rank"))


def fuse(a: DataFrame, b: DataFrame, k: int = FUSION) -> DataFrame:
    """(id, score): reciprocal rank fusion of two arms."""
    both = ranked(a).unionByName(ranked(b))
    return both.groupBy("id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), DIGITS).alias("score"))


def deduplicate(hits: DataFrame) -> DataFrame:
    """The best row per (name, type), ties by id."""
    order = Window.partitionBy("name", "entity_type").orderBy(F.desc("score"), "id")
    return hits.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def _nodes_of(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes that hits name: only these are grouped."""
    asked = near(hits.select(F.col("name").alias("_asked")).distinct())
    return nodes.join(asked, F.col("name") == F.col("_asked"), "left_semi")


def graph_boost(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """Additive boost: +0.1 for names of the five best; else by incoming references; else by calls to these names.

    hits: id, name, score, ...  nodes: name, incoming_count, calls.
    """
    seeds = hits.orderBy(F.desc("score"), "id").limit(SEEDS).select("name").distinct().agg(F.collect_set("name").alias("seeds"))
    node = _nodes_of(hits, nodes).groupBy(F.col("name").alias("_n")).agg(F.max("incoming_count").alias("incoming"), F.max_by("calls", F.struct(F.size("calls"), "calls")).alias("_calls"))
    rows = hits.join(F.broadcast(seeds), F.lit(True))  # one row of at most five names
    rows = rows.join(node, F.col("name") == F.col("_n"), "left")
    touching = F.size(F.filter(F.coalesce("_calls", F.array().cast("array<string>")), lambda c: F.array_contains("seeds", c)))
    boost = F.when(F.array_contains("seeds", F.col("name")), SEED_BOOST).when(F.coalesce("incoming", F.lit(0)) > 0, F.least(0.02 * F.col("incoming"), F.lit(0.1))).otherwise(F.least(0.03 * touching, F.lit(0.1)))
    return rows.withColumn("boost", F.round(boost, DIGITS)).withColumn("score", F.round(F.col("score") + F.col("boost"), DIGITS)).drop("seeds", "_n", "_calls", "incoming")


def type_boost(hits: DataFrame) -> DataFrame:
    return hits.withColumn("score", F.round(F.when(F.col("entity_type").isin("variable", "constant"), F.col("score") * TYPE_BOOST).otherwise(F.col("score")), DIGITS))


def relationship_rank(hits: DataFrame, nodes: DataFrame, keywords: list[str]) -> DataFrame:
    """Multiplicative re-rank: score * (1 + 0.3 * min(rel / 10, 1)), rel = 100 for named keywords else 5 * matched calls + 2 * incoming."""
    low = [k.lower() for k in keywords]
    node = _nodes_of(hits, nodes).groupBy(F.col("name").alias("_n")).agg(F.max("incoming_count").alias("incoming"), F.max_by("calls", F.struct(F.size("calls"), "calls")).alias("_calls"))
    matched = F.size(F.filter(F.coalesce("_calls", F.array().cast("array<string>")), lambda c: names.last_segment(c).isin(low)))
    rel = F.when(names.last_segment("name").isin(low), 100).otherwise(5 * matched + 2 * F.coalesce("incoming", F.lit(0)))
    rows = hits.join(node, F.col("name") == F.col("_n"), "left").withColumn("relevance", rel.cast("long"))
    return rows.withColumn("score", F.round(F.col("score") * (1 + 0.3 * F.least(F.col("relevance") / 10.0, F.lit(1.0))), DIGITS)).drop("_n", "_calls", "incoming")


def keyword_search(docs: DataFrame, query: str, limit: int) -> DataFrame:
    """Name or content contains the query without case; first by place, score 1."""
    hit = F.contains(F.lower("name"), F.lit(query.lower())) | F.contains(F.lower(F.coalesce("content", F.lit(""))), F.lit(query.lower()))
    return docs.filter(hit & ~names.is_temporary("file_path")).orderBy("file_path", "id").limit(limit).withColumn("score", F.lit(1.0))


def explain_rank(hits: DataFrame) -> DataFrame:
    """What a re-ranked hit owes its place to: being named, its references and calls, or its text alone."""
    return hits.withColumn("reason", F.when(F.col("relevance") >= 100, "named").when(F.col("relevance") > 0, "related").otherwise("text"))


def arms(docs: DataFrame, vectors: DataFrame, query: str, vector: list[float] | None, fetch: int) -> DataFrame:
    """(id, score) of both arms fused; of the one arm there is, if the other has no vector or can't be searched.

    Without the keyword arm the scores are the cosines themselves.
    """
    try:
        lexical = settle(sparse_top(docs, query, fetch))
    except PySparkException:
        if vector is None:
            raise
        return dense_top(vectors, vector, fetch)
    return fuse(lexical, dense_top(vectors, vector, fetch)) if vector is not None else fuse(lexical, lexical.limit(0))


def hybrid_search(docs: DataFrame, vectors: DataFrame, nodes: DataFrame, query: str, vector: list[float] | None, limit: int = 10) -> DataFrame:
    """Both arms over-fetch nine times, are fused, cut to three times the limit, deduplicated, boosted and cut.

    Unnamed hits go before, temporary files after the boost.  Without any hit
    left, keyword search.  Without a query vector only the keyword arm runs.
    """
    fused = arms(docs, vectors, query, vector, 9 * limit).orderBy(F.desc("score"), "id").limit(3 * limit).withColumnRenamed("id", "_id")
    hits = docs.select("id", "name", "file_path", "entity_type").join(F.broadcast(fused), F.col("id") == F.col("_id")).drop("_id")
    hits = settle(deduplicate(hits.filter(F.col("name") != "Unknown")))  # a few rows, which the boosts and the fallback look at again
    boosted = type_boost(graph_boost(hits, nodes).filter(~names.is_temporary("file_path"))).select("id", "name", "file_path", "entity_type", "score")
    found = settle(boosted.orderBy(F.desc("score"), "id").limit(limit))
    if found.limit(1).count():
        return found
    found = deduplicate(keyword_search(docs, query, limit).select("id", "name", "file_path", "entity_type", "score"))
    return found.orderBy(F.desc("score"), "id").limit(limit)
