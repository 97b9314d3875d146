"""A corpus from raw documents: quality, near-duplicates, contamination, personal data, tokens.

Each stage gets what its predecessor kept, as it was written and read again, and
all but the last return the columns of documents, extra ones included.  Whole
texts count, however long.  A null text is an empty one; an empty table gives an
empty table; repeated rows are judged one by one, but for ``near_dedup``.

Before its rows are written a stage lets the executors give back the heap that
earlier work grew (``storage.slim``), so its memory is its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import bpe, decontaminate, pii, quality, simhash
from graphloom.llm.queries import _tokenizer, table
from graphloom.storage import remove, scratch, slim


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep; the model is trained on the labelled rows among them.

    A null or empty text has fewer than fifty words and goes.  Without labels of
    both classes the base rules decide alone; a label whose id no document has
    counts for nothing.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    slim(spark)
    return quality.keep(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of the least id.

    Texts without words are one group.  Of several rows of the least id the least
    by content stays; a null id stays only where its group has no other.
    """
    slim(spark)
    kept = simhash.keep_one(docs)
    slim(spark)
    return kept


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark; a null or empty text has none, nor has a null item."""
    clean = decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))
    slim(spark)
    return clean


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates in their texts; a null text stays null, and n_chars follows the text.

    The key is the session's (``pii.KEY``).
    """
    slim(spark)
    return pii.redact(docs, key=pii.key_of(spark))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the documents that are left, one row each; a null text has no tokens."""
    slim(spark)
    return bpe.annotate(docs, *_tokenizer(spark))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("byte_bpe", byte_bpe),
]

#: The trained rules, components and merges are not for SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again.

    A stage's folder goes once its successor is written, the last one with the
    application.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(folder := scratch(spark, f"pipeline-{name}"))
        docs = spark.read.parquet(folder)
        if before:
            remove(spark, before)
        before = folder
    return STAGES[-1][1](spark, docs, sf_dir)
