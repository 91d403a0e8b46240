"""Intermediate tables that survive lost executors.

A table is written as Parquet in the shared folder that the session names in ``spark.checkpoint.dir`` and read back, which
cuts the lineage and keeps columns prunable. Only a local session without that setting gets a folder of its own.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_made: list[str] = []


def folder(spark: SparkSession) -> str:
    """The shared folder; a temporary one only if the setting is missing and the master is local."""
    root = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_KEY} to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set(_KEY, root)
    return root.rstrip("/")


def save(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` once and return it read back from the shared folder; without ``compression`` as the session has it."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let executors delete the shuffle files of plans that are saved and forgotten.

    Spark deletes them when the driver happens to collect its garbage, by default every half hour; this asks it to do so now.
    """
    gc.collect()
    spark._jvm.System.gc()


def clear(spark: SparkSession) -> int:
    """Delete the tables that this process has saved, once no result that reads them is needed; how many there were."""
    n = len(_made)
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n
