"""Arrow functions inside tasks, in memory that does not grow with the rows of a task."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: The most bytes of a batch that a Python worker gets, and of the part of it that is worked on at once.
MOST, PART = 1 << 22, 1 << 19

Batches = Iterator[pa.RecordBatch]


def parted(batch: pa.RecordBatch, octets: int = PART) -> Batches:
    """A batch as slices of at most so many bytes, or of one row, in order; an empty one is none."""
    if batch.num_rows > 1 and batch.nbytes > octets:
        half = batch.num_rows // 2
        yield from parted(batch.slice(0, half), octets)
        yield from parted(batch.slice(half), octets)
    elif batch.num_rows:
        yield batch


def mapped(rows: DataFrame, work: Callable[[Batches], Batches], schema: StructType | str, octets: int = PART) -> DataFrame:
    """rows.mapInArrow(work, schema), where work gets batches of at most octets, and the worker gives freed memory back at a task's end, as it
    lives on into later ones."""
    conf = rows.sparkSession.conf
    if rows.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf.get(BATCH_BYTES)) > MOST:
        conf.set(BATCH_BYTES, str(MOST))

    def run(batches: Batches) -> Batches:
        yield from work(part for batch in batches for part in parted(batch, octets))
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return rows.mapInArrow(run, schema)
