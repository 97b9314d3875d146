"""Where intermediate tables go: the folder that the driver and all executors share."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of the warehouse where it is unset."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"


def _file_system(spark: SparkSession, folder: str) -> tuple:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, which goes when the application ends."""
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    fs, path = _file_system(spark, folder)
    fs.deleteOnExit(path)
    return folder


def remove(spark: SparkSession, folder: str) -> None:
    fs, path = _file_system(spark, folder)
    fs.delete(path, True)


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch(df.sparkSession, "checkpoints"))
    return df.checkpoint(eager=True)


def tidy(spark: SparkSession) -> None:
    """Let shuffle files and checkpoints that nothing refers to any more go now: Spark drops them when the driver's garbage is collected."""
    gc.collect()
    spark._jvm.System.gc()


def slim(spark: SparkSession) -> None:
    """Let executors give back the heap that earlier work grew, which they do after a full collection only: one in each free slot, as far as tasks reach."""
    slots = spark.sparkContext.defaultParallelism
    spark.range(0, slots, 1, slots).select(F.expr("java_method('java.lang.System', 'gc')")).collect()


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage by a compressed table in the shared folder, which takes a part of a checkpoint's room."""
    df.write.option("compression", "zstd").parquet(folder := scratch(df.sparkSession, "stored"))
    tidy(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
