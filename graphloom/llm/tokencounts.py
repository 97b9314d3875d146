"""Exact histogram of encoded lengths, and what it answers for every context limit.

Documents are encoded with the tiktoken library by a rank file and counted per
length.  Suffix sums over the histogram then give, for each length L that
occurs, as a context limit: documents and tokens at most L, documents longer,
tokens that remain when every document is cut to L, and the share of documents
that fit.  The sums run in two levels, within blocks of ``BLOCK`` lengths and
over the blocks' totals, so no window holds the whole histogram.

Defined edge cases: a null text is empty and has length 0; an empty table gives
an empty histogram; repeated rows all count; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import arrowtext as at

BLOCK = 1024


def lengths(docs: DataFrame, ranks: bytes, pattern: str, *, text_column: str = "text") -> DataFrame:
    """n_tokens of every row, pre-counted per batch: (n_tokens, n_docs)."""
    content = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.value.splitlines() if line.strip())}
        encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
        for batch in batches:
            texts = at.as_bytes(batch.column("text"))
            sizes = np.fromiter((len(encode(t.as_py().decode("utf-8", "replace"))) for t in texts), np.int64, len(texts))
            values, counts = np.unique(sizes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts.astype(np.int64))], ["n_tokens", "n_docs"])

    return docs.select(F.col(text_column).alias("text")).mapInArrow(run, "n_tokens long, n_docs long")


def histogram(counted: DataFrame) -> DataFrame:
    """(n_tokens, n_docs) in any number of rows -> one row per length with the sums."""
    block = F.floor(F.col("n_tokens") / BLOCK)
    one = counted.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs")).withColumn("block", block).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    per = counted.groupBy(block.alias("b")).agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_tokens") * F.col("n_docs")).alias("t"))
    all_ = Window.orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("b", F.coalesce(F.sum("d").over(all_), F.lit(0)).alias("docs_past"), F.coalesce(F.sum("t").over(all_), F.lit(0)).alias("tokens_past"), F.sum("d").over(Window.partitionBy()).alias("docs"), F.sum("t").over(Window.partitionBy()).alias("tokens_all"))
    own = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    met = one.join(per, F.col("block") == F.col("b"))
    longer = F.coalesce(F.sum("n_docs").over(own), F.lit(0)) + F.col("docs_past")
    past = F.coalesce(F.sum("tokens").over(own), F.lit(0)) + F.col("tokens_past")
    met = met.select("n_tokens", "n_docs", "docs", "tokens_all", longer.alias("docs_longer"), past.alias("past"))
    return met.select(
        "n_tokens", "n_docs", (F.col("docs") - F.col("docs_longer")).alias("docs_fitting"), "docs_longer", (F.col("tokens_all") - F.col("past")).alias("tokens_fitting"),
        (F.col("tokens_all") - F.col("past") + F.col("n_tokens") * F.col("docs_longer")).alias("tokens_truncated"), F.round((F.col("docs") - F.col("docs_longer")) / F.col("docs"), 9).alias("quantile"),
    )


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the least length that at least this share of the documents fits in."""
    shares_ = sums.sparkSession.createDataFrame([(float(s),) for s in shares], "share double")
    return sums.join(F.broadcast(shares_), F.col("docs_fitting") >= F.col("share") * (F.col("docs_fitting") + F.col("docs_longer"))).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
