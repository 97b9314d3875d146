"""The queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..storage import slim
from . import bpe, decontaminate, html, langid, pii, quality, secrets, simhash, tokencounts, toxicity

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(spark: SparkSession) -> tuple[bytes, str]:
    import public_tokenizers

    return bpe.load_ranks(spark, public_tokenizers.path(VOCABULARY)), public_tokenizers.PATTERN


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.annotate(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.annotate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokencounts.lengths(table(spark, sf_dir, "documents"), *_tokenizer(spark))
    return tokencounts.histogram(simhash.settle(counted.groupBy("n_tokens").sum("n_docs").toDF("n_tokens", "n_docs")))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = html.extract(table(spark, sf_dir, "pages"))
    slim(spark)  # the heap that sizing the hosts and earlier work grew
    return texts


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.annotate(table(spark, sf_dir, "documents"), *_tokenizer(spark))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.annotate(docs, langid.train(docs))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.annotate(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.annotate(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.annotate(table(spark, sf_dir, "documents"), key=pii.key_of(spark))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.annotate(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_secret_scan, op2_decontamination, op3_token_counts, op4_html_extraction, op5_byte_bpe, op6_language_id, op7_simhash_dedup, op8_quality_rules, op9_pii_surrogates, op10_toxicity)
}

#: Where SQL can say it.  The window of ten words is a parameter of the operator, too.
ORACLE_SQL: dict[str, str] = {
    "op2_decontamination": """
WITH item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, array_to_string(w, ' ') AS passage, i AS j, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS k
  FROM item_words, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS t(i) WHERE len(w) > 0),
doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM documents),
places AS (
  SELECT doc_id, w, n, i FROM doc_words, (SELECT DISTINCT n FROM windows), unnest(range(1, len(w) - n + 2)) AS t(i)),
found AS (
  SELECT doc_id, p.n, i, j, item_id, passage FROM places p JOIN windows x ON p.n = x.n AND array_to_string(w[i:i + p.n - 1], ' ') = x.k),
hits AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT DISTINCT doc_id, n, i FROM found), unnest(range(i, i + n)) AS t(place) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id),
diagonals AS (
  SELECT *, i - row_number() OVER (PARTITION BY doc_id, passage, i - j ORDER BY i) AS stretch FROM (SELECT DISTINCT doc_id, passage, n, i, j FROM found)),
longest AS (
  SELECT doc_id, count(*) + min(n) - 1 AS longest_match, min(i) - 1 AS longest_start FROM diagonals GROUP BY doc_id, passage, i - j, stretch
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY longest_match DESC, longest_start) = 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  CAST(coalesce(longest_match, 0) AS BIGINT) AS longest_match, CAST(coalesce(longest_start, -1) AS BIGINT) AS longest_start
FROM doc_words d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN longest USING (doc_id)
"""
}
