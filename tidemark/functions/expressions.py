"""Column expressions shared by several operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F


def pearson(x: Column, y: Column) -> Column:
    """Pairwise-complete correlation; NULL, not an error, when a side is constant."""
    xs, ys = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    # The product of the roots, not the root of the product, which can underflow.
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(xs) * F.stddev_pop(ys))


def hash_uniform(*parts: Column) -> Column:
    """Uniform number in [0, 1) from the parts' text, the same under any partitioning."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def as_vector(columns: Sequence[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in columns])


def is_not(column: str, value) -> Column:
    """True when the value differs or is missing."""
    return ~F.col(column).eqNullSafe(F.lit(value))


def mean_vector(column: str) -> Column:
    """Aggregate: the mean of an array column, dimension by dimension."""
    return vector_to_array(Summarizer.mean(array_to_vector(F.col(column).cast("array<double>"))))


def vector_spread(column: str) -> Column:
    """Aggregate: the population variance of an array column, summed over its dimensions."""
    n = F.count(column)
    parts = vector_to_array(Summarizer.variance(array_to_vector(F.col(column).cast("array<double>"))))
    return F.aggregate(parts, F.lit(0.0), lambda s, v: s + v) * (n - 1) / n
