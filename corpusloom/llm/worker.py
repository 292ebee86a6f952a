"""Python workers that give memory back: they outlive a task, and what they keep counts against their executor."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

from corpusloom.shipping import ship_package

#: Rows and bytes of an Arrow batch at most: texts are long.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20

Batches = Iterator[pa.RecordBatch]


def trim() -> None:
    """Returns freed memory to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def frugal(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """run, with Arrow's memory taken from the system and freed memory returned to it when a task ends."""

    def wrapped(batches: Batches) -> Batches:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def prepare(spark: SparkSession) -> None:
    """Ships the package and bounds the session's Arrow batches, which it may have bounded lower itself."""
    ship_package(spark)
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(name, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))
