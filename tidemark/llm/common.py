"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import resource
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_ROWS = 256
BATCH_ROWS = 1_000
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def columns(df: DataFrame, *but: str) -> list[Column]:
    """The columns of ``df``, whatever signs their names hold, without those named in ``but``."""
    return [F.col("`" + c.replace("`", "``") + "`").alias(c) for c in df.columns if c not in but]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def width(spark: SparkSession) -> int:
    """How many shuffle partitions the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Small pieces of the incoming batches, so that a task holds few texts at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def lean(spark: SparkSession) -> None:
    """Send workers at most ``BATCH_ROWS`` rows at once from here on: rows with whole texts are large."""
    now = int(spark.conf.get(BATCH_SETTING))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(BATCH_SETTING, BATCH_ROWS)


def release() -> None:
    """Hand back the memory that Arrow and the allocator keep for later; a worker outlives its tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        # Only some C libraries have it.
        return


def resident_mb() -> float:
    """Memory of this process in MB, or 0 where the system does not tell."""
    try:
        with open("/proc/self/statm") as file:
            return int(file.read().split()[1]) * resource.getpagesize() / 1e6
    except OSError:
        return 0.0
