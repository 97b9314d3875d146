"""What the driver and every executor share: a folder, and values."""

from __future__ import annotations

import pickle
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import SparkSession

from ..storage import settle as settle


def ship(spark: SparkSession, value: object) -> Callable[[], object]:
    """A function that gives ``value`` on executors, unpacked once per task.

    The broadcast holds plain bytes in which classes of this package are written
    out, so executors need no copy of it.
    """
    packed, held = spark.sparkContext.broadcast(cloudpickle.dumps(value)), []

    def get() -> object:
        if not held:
            held.append(pickle.loads(packed.value))
        return held[0]

    return get


def fresh(taken: list[str], base: str) -> str:
    """A column name that no column has, whatever its case."""
    known = {x.lower() for x in taken}
    while base.lower() in known:
        base += "_"
    return base
