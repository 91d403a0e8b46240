"""Intermediate tables in the folder that a session names in ``spark.checkpoint.dir``, which all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


def folder(spark: SparkSession) -> str:
    """The shared folder; a temporary one only if the setting is missing and the master is local."""
    root = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_KEY} to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set(_KEY, root)
    return root.rstrip("/")


def keep(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written once and read back, which cuts their lineage and survives lost executors."""
    path = f"{folder(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
