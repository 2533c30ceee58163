"""Keeps the memory of Python workers small: they live on between tasks, and their hosts have a fixed size."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows and bytes of a batch that goes to or from a Python worker, where the session does not say.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2048", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def small_batches(df: DataFrame) -> None:
    """Texts may be long: what a batch holds of them is bounded, in the worker and in Spark's buffers."""
    for key, value in BATCH.items():
        if df.sparkSession.conf.get(key, None) is None:
            df.sparkSession.conf.set(key, value)


def release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return
