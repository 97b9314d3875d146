"""The entity table: one row per function, class, module, ... with its edges as name arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NAMES = T.ArrayType(T.StringType())

ENTITY = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("entity_type", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("start_line", T.LongType()),
        T.StructField("end_line", T.LongType()),
        T.StructField("docstring", T.StringType()),
        T.StructField("module_path", T.StringType()),
        T.StructField("visibility", T.StringType()),
        T.StructField("parameters", _NAMES),
        T.StructField("calls", _NAMES),
        T.StructField("is_a", _NAMES),
        T.StructField("contains", _NAMES),
        T.StructField("language", T.StringType()),
    ]
)
LISTS = ["parameters", "calls", "is_a", "contains"]
EDGE_KINDS = ["calls", "is_a", "contains"]
#: Entities of less content than this many bytes are not indexed; modules are exempt.
LEAST_BYTES = 30


def chunk_id() -> F.Column:
    """Lower-case hex SHA-256 of path, type, name and first line."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("file_path", "entity_type", "name", "start_line")]
    return F.sha2(F.concat_ws(":", *parts), 256)


def conform(rows: DataFrame) -> DataFrame:
    """Any subset of the entity columns -> all of them; lists are never null; ids are derived where absent."""
    have = set(rows.columns)
    out = []
    for f in ENTITY.fields:
        value = (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType)
        out.append((F.coalesce(value, F.array().cast(_NAMES)) if f.name in LISTS else value).alias(f.name))
    full = rows.select(*out)
    return full if "id" in have else full.withColumn("id", chunk_id())


def indexable(entities: DataFrame) -> DataFrame:
    return entities.filter((F.coalesce(F.octet_length("content"), F.lit(0)) >= LEAST_BYTES) | (F.col("entity_type") == "module"))
