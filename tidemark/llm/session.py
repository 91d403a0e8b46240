"""Settings of a session that the operators with Python tasks rely on."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def settle(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches by bytes, unless the session does, as texts differ in length by orders of magnitude; and tell
    Python workers of a local session where the driver found this package."""
    if spark.conf.get(_BYTES, None) is None:
        spark.conf.set(_BYTES, str(8 << 20))
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).parents[2]))
    return spark


@contextmanager
def batches_of(spark: SparkSession, limit: int) -> Iterator[None]:
    """Bound the Arrow batches of what runs inside by ``limit`` bytes; the session has its own bound again afterwards."""
    before = spark.conf.get(_BYTES, None)
    spark.conf.set(_BYTES, str(limit))
    try:
        yield
    finally:
        spark.conf.unset(_BYTES) if before is None else spark.conf.set(_BYTES, before)
