"""Tokens, keyword and embedding texts, hash buckets and vector arithmetic."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSIONS = 768
EMBED_BYTES = 4000


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens(text: Column | str) -> Column:
    """Lower-cased runs of letters, digits and _ of two characters or more."""
    return F.filter(F.split(F.lower(F.coalesce(_c(text), F.lit(""))), "[^a-z0-9_]+"), lambda x: F.length(x) >= 2)


def _md5_number(text: Column, first: int) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), first, 8), 16, 10).cast("long")


def bucket(term: Column | str) -> Column:
    return _md5_number(_c(term), 1) % DIMENSIONS


def bucket_of(term: str) -> int:
    """The bucket of a term at hand."""
    return int(hashlib.md5(term.encode(), usedforsecurity=False).hexdigest()[:8], 16) % DIMENSIONS


def sign_of(term: str) -> float:
    return 1.0 if int(hashlib.md5(term.encode(), usedforsecurity=False).hexdigest()[8:16], 16) % 2 == 0 else -1.0


def sign(term: Column | str) -> Column:
    return F.when(_md5_number(_c(term), 9) % 2 == 0, 1.0).otherwise(-1.0)


def truncate_bytes(text: Column | str, n: int = EMBED_BYTES) -> Column:
    """The first n bytes; a cut character is dropped."""
    cut = F.substring(_c(text).cast("binary"), 1, n)
    whole = F.make_valid_utf8(cut.cast("string"))
    return F.when(F.octet_length(_c(text)) <= n, _c(text)).otherwise(F.regexp_replace(whole, "�+$", ""))


def embedding_text() -> Column:
    """Header of file, type and name, then the content, cut to bytes."""
    head = F.concat(F.lit("File: "), F.col("file_path"), F.lit("\nType: "), F.col("entity_type"), F.lit("\nName: "), F.col("name"), F.lit("\n"))
    return truncate_bytes(F.concat(head, F.coalesce("content", F.lit(""))))


def keyword_text() -> Column:
    """The name three times, parameters, calls and content."""
    return F.concat_ws(" ", F.col("name"), F.col("name"), F.col("name"), F.array_join("parameters", " "), F.array_join("calls", " "), F.col("content"))


def boosted_query(query: str) -> str:
    return " ".join([query] * 3)


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def normalized(v: Column | str) -> Column:
    """Unit length; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(_c(v), lambda x: x.cast("double") / norm)).otherwise(_c(v).cast("array<double>"))
