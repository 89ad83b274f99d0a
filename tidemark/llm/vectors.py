"""Tables of vectors: which rows take part, and rows of one key laid out in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import width

BLOCK = "key long, block long, low double, high double, ids binary, far binary, vectors binary"
BLOCK_ROWS = 2_048
BLOCK_BYTES = 32 << 20


def usable(table: DataFrame, name: str = "embedding") -> tuple[DataFrame, int]:
    """``vec_id`` and ``vector`` (doubles) of the rows that take part, and the dimension.

    Left out are null ids and vectors, and vectors with null or non-finite
    components. The longest vector gives the dimension; components that a shorter
    one lacks, or all those of an empty one, are zero, which changes neither a
    product nor a norm.
    """
    fine = F.forall(F.col(name), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table.filter(F.col("vec_id").isNotNull() & fine)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(name).cast("array<double>").alias("vector"))
    longest = rows.agg(F.max(F.size("vector")).alias("d")).first()["d"]
    if longest is None:
        return rows, 0
    size = max(longest, 1)
    filled = F.concat("vector", F.array_repeat(F.lit(0.0), F.lit(size) - F.size("vector")))
    return rows.withColumn("vector", F.when(F.size("vector") == size, F.col("vector")).otherwise(filled)), size


def block_rows(size: int, most: int | None = None) -> int:
    """Rows of a block of vectors of this dimension: at most ``most``, and ``BLOCK_BYTES``."""
    return max(1, min(most or BLOCK_ROWS, BLOCK_BYTES // (8 * max(size, 1))))


def is_query(every: int = 50) -> Column:
    return F.col("vec_id") % every == 0


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """Vectors of one length as a matrix of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, max(size, 1))


def sample(rows: DataFrame, most: int, size: int) -> np.ndarray:
    """At most ``most`` vectors, one for each id, chosen by a hash of their ids."""
    spots = rows.select(F.xxhash64("vec_id").alias("h"), "vec_id").distinct().orderBy("h", "vec_id").limit(most)
    last = spots.agg(F.max(F.struct("h", "vec_id")).alias("last")).first()["last"]
    if last is None:
        return np.empty((0, max(size, 1)))
    among = F.struct(F.xxhash64("vec_id").alias("h"), "vec_id") <= F.struct(F.lit(last["h"]).alias("h"), F.lit(last["vec_id"]).alias("vec_id"))
    picked = rows.filter(among).groupBy("vec_id").agg(F.min("vector").alias("vector")).orderBy(F.xxhash64("vec_id"), "vec_id").collect()
    return np.array([r["vector"] for r in picked], np.float64).reshape(-1, max(size, 1))


def in_blocks(rows: DataFrame, most: int) -> DataFrame:
    """Blocks of rows (key, far, vec_id, vector) of one key in order of ``far``.

    Rows are range partitioned by (key, far, vec_id), so a key that holds a
    large share of them spreads over partitions. ``vector`` is binary. Repeats of
    a whole row meet in one partition, side by side, and count once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held, before = TaskContext.get().partitionId(), 0, [], None

        def flush() -> pa.RecordBatch:
            nonlocal made, held
            keys, far, ids, vectors = held[0][0], np.array([h[1] for h in held]), np.array([h[2] for h in held], np.int64), b"".join(h[3] for h in held)
            row = (keys, part << 32 | made, far[0], far[-1], ids.tobytes(), far.tobytes(), vectors)
            made, held = made + 1, []
            types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=["key", "block", "low", "high", "ids", "far", "vectors"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "far", "vec_id", "vector"))):
                if row == before:
                    continue
                before = row
                if held and (row[0] != held[0][0] or len(held) == most):
                    yield flush()
                held.append(row)
        if held:
            yield flush()

    spread = rows.select("key", "far", "vec_id", "vector").repartitionByRange(width(rows.sparkSession), "key", "far", "vec_id")
    return spread.sortWithinPartitions("key", "far", "vec_id", "vector").mapInArrow(run, BLOCK)


def best(scores: np.ndarray, ids: np.ndarray, count: int) -> np.ndarray:
    """Places of the ``count`` highest scores of different ids, highest first, ties to smaller ids."""
    if len(scores) > count:
        limit = np.partition(scores, len(scores) - count)[len(scores) - count]
        places = np.flatnonzero(scores >= limit)
    else:
        places = np.arange(len(scores))
    if len(np.unique(ids[places])) < len(places):
        order = np.lexsort((ids, -scores))
        return order[np.sort(np.unique(ids[order], return_index=True)[1])][:count]
    return places[np.lexsort((ids[places], -scores[places]))][:count]
