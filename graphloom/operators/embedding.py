"""Dense vectors from a pluggable encoder, with feature hashing where it fails.

An encoder is a function that makes encoders: called once per task, it gives a
function from a list of texts to a list of vectors.  It may raise; a timeout or
a refused connection is tried again with growing pauses.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import retrieval

Encoder = Callable[[], Callable[[list[str]], list[list[float]]]]
#: Texts of a request, tries, and seconds of the first pause.
BATCH, TRIES, PAUSE = 96, 3, 0.5
TRANSIENT = (TimeoutError, ConnectionError)


def call(encode: Callable[[list[str]], list[list[float]]], texts: list[str], tries: int = TRIES, pause: float = PAUSE) -> list[list[float]] | None:
    """The vectors of the texts; None if the encoder fails for good or gives other than one vector each."""
    for attempt in range(tries):
        try:
            made = encode(texts)
            return made if len(made) == len(texts) else None
        except TRANSIENT:
            if attempt + 1 < tries:
                time.sleep(pause * 2**attempt)
        except Exception:  # noqa: BLE001  whatever a foreign encoder raises, its texts are hashed instead
            return None
    return None


def encoded(docs: DataFrame, encoder: Encoder, text_column: str = "content", *, batch: int = BATCH, tries: int = TRIES, pause: float = PAUSE) -> DataFrame:
    """(id, semantic): vectors by the encoder, null where it failed."""
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                texts = [t or "" for t in part.column("_text").to_pylist()]
                made = call(encode, texts, tries, pause)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(made or [None] * len(texts), pa.list_(pa.float32()))], ["id", "semantic"])

    return docs.select("id", F.col(text_column).alias("_text")).mapInArrow(run, f"id {id_type}, semantic array<float>")


def hashed(docs: DataFrame, terms: DataFrame, text_column: str = "content") -> DataFrame:
    """(id, semantic): feature hashing of each text to a unit vector; zeros without tokens.

    terms: the vocabulary (term, idf).  A text has at most ``DIMENSIONS`` buckets.
    """
    rows = retrieval.dense_hash(retrieval.weights(retrieval.term_frequencies(docs, text_column), terms))
    held = rows.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("bucket").cast("int"), "x"))).alias("m")).withColumnRenamed("id", "_id")
    value = F.transform(F.sequence(F.lit(0), F.lit(text.DIMENSIONS - 1)), lambda b: F.coalesce(F.try_element_at("m", b), F.lit(0.0)).cast("float"))
    return docs.select("id").join(held, F.col("id") == F.col("_id"), "left").select("id", value.alias("semantic"))


def embed(docs: DataFrame, encoder: Encoder, terms: DataFrame, text_column: str = "content", **how: float) -> DataFrame:
    """(id, semantic, way): by the encoder (``model``), or by feature hashing (``tfidf``) where that failed."""
    rows = encoded(docs, encoder, text_column, **how)
    left = docs.join(rows.filter("semantic is null").select(F.col("id").alias("_f")), F.col("id") == F.col("_f"), "left_semi")
    return rows.filter("semantic is not null").withColumn("way", F.lit("model")).unionByName(hashed(left, terms, text_column).withColumn("way", F.lit("tfidf")))


def query_vector(query: str, encoder: Encoder | None = None, terms: DataFrame | None = None, *, tries: int = TRIES, pause: float = PAUSE) -> tuple[list[float], str]:
    """The vector of a query and how it was made: by the encoder, else by feature hashing, else zeros."""
    if encoder is not None and (made := call(encoder(), [query], tries, pause)):
        return [float(x) for x in made[0]], "model"
    zeros = [0.0] * text.DIMENSIONS
    counts = retrieval.query_terms(query)
    if not counts:
        return zeros, "zeros"
    known = {r["term"]: r["idf"] for r in terms.filter(F.col("term").isin(list(counts))).select("term", "idf").collect()} if terms is not None else {}
    for term, n in counts.items():
        zeros[text.bucket_of(term)] += (1 + math.log(n / 3)) * known.get(term, 1.0) * text.sign_of(term)
    norm = math.sqrt(sum(x * x for x in zeros))
    return ([x / norm for x in zeros], "tfidf") if norm else (zeros, "zeros")
