"""Joins of feeds on their time column."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_on(
    left: DataFrame,
    right: DataFrame,
    on: str | list[str] = "string",
    how: str = "left",
    suffixes: tuple[str | None, str | None] = ("_d", "_msw"),
    match_missing: bool = False,
) -> DataFrame:
    """Equi-join with suffixes for names both sides use.

    No hint is set: Spark broadcasts a side it knows to be small, sorts and
    merges otherwise, and splits skewed keys at run time.
    """
    keys = [on] if isinstance(on, str) else list(on)
    clash = (set(left.columns) & set(right.columns)) - set(keys)
    ls, rs = (s or "" for s in suffixes)
    if clash and not (ls or rs):
        raise ValueError(f"columns overlap and no suffix is given: {sorted(clash)}")
    a = left.select(*[F.col(c).alias(c + ls if c in clash else c) for c in left.columns])
    b = right.select(*[F.col(c).alias(c + rs if c in clash else c) for c in right.columns])
    if not match_missing:
        return a.join(b, keys, how)
    b = b.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return a.join(b, match, how).drop(*[f"_r_{k}" for k in keys])


def join_feeds(daily: DataFrame, warming: DataFrame, centred: DataFrame, on: str = "string") -> DataFrame:
    """Daily rows with their warming flag and, where present, event diagnostics."""
    first = join_on(daily, warming, on, "left", (None, "_msw"))
    return join_on(first, centred, on, "left", ("_d", "_cen"))


def append_labels(df: DataFrame, labels: Mapping[str, DataFrame], row_id: str) -> DataFrame:
    """Add one column per label table ``(row_id, label)``."""
    for name, table in labels.items():
        df = df.join(table.select(row_id, F.col("label").alias(name)), row_id, "left")
    return df


def residual(df: DataFrame, column: str, fitted: DataFrame, out: str, keys: list[str], value: str = "value") -> DataFrame:
    """``column`` minus a fitted series joined on ``keys``."""
    fit = fitted.select(*keys, F.col(value).alias("_fit"))
    return df.join(fit, keys, "left").withColumn(out, F.col(column) - F.col("_fit")).drop("_fit")
