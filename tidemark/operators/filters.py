"""Season, date range and threshold filters. All push down to the scan."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINTER = (12, 1, 2, 3)


def season(df: DataFrame, time: str, months: Sequence[int] = WINTER) -> DataFrame:
    return df.filter(F.month(time).isin(*months))


def between(df: DataFrame, time: str, start=None, end=None, closed: bool = True) -> DataFrame:
    """Keep rows from ``start`` to ``end``; either may be open."""
    t = F.col(time)
    if start is not None:
        low = F.lit(start).cast("timestamp_ntz")
        df = df.filter(t >= low if closed else t > low)
    if end is not None:
        high = F.lit(end).cast("timestamp_ntz")
        df = df.filter(t <= high if closed else t < high)
    return df


def clip_range(df: DataFrame, time: str, start: datetime | None = None, end: datetime | None = None):
    """Filter to the asked range cut to the data's own; also return what was done.

    The report holds ``start``, ``end``, ``clipped``, and the number of
    distinct times when the range had to be cut (NULL otherwise).
    """
    have = df.agg(F.min(time).alias("low"), F.max(time).alias("high")).first()
    if have["low"] is None:
        return df, {"start": start, "end": end, "clipped": False, "distinct": None}
    lo, hi = start or have["low"], end or have["high"]
    early, late = lo.date() < have["low"].date(), hi > have["high"]
    lo, hi = (have["low"] if early else lo), (have["high"] if late else hi)
    clipped = early or late
    distinct = df.select(time).filter(F.col(time).isNotNull()).distinct().count() if clipped else None
    return between(df, time, lo, hi), {"start": lo, "end": hi, "clipped": clipped, "distinct": distinct}


def exclude(df: DataFrame, condition: Column) -> DataFrame:
    """Drop rows where the condition holds; rows where it is unknown stay."""
    return df.filter(~F.coalesce(condition, F.lit(False)))


def in_dates(df: DataFrame, time: str, dates: DataFrame | Iterable) -> DataFrame:
    """Rows whose time is in a set of dates (a list, or a one-column table)."""
    if isinstance(dates, DataFrame):
        wanted = dates.select(F.col(dates.columns[0]).alias("_date"))
        return df.join(wanted, F.col(time) == F.col("_date"), "left_semi")
    return df.filter(F.col(time).isin(*[F.lit(d).cast("timestamp_ntz") for d in dates]))


def around(df: DataFrame, time: str, anchors: DataFrame, before: int = 0, after: int = 0) -> DataFrame:
    """Rows within whole days of anchor times: ``(anchor, offset, *row)``.

    Each anchor is expanded to its few target times, so this is an equi-join.
    """
    if before < 0 or after < 0:
        raise ValueError("before and after count days and cannot be negative")
    t = anchors.columns[0]
    targets = anchors.select(
        F.col(t).alias("anchor"), F.explode(F.sequence(F.lit(-before), F.lit(after))).alias("offset")
    )
    # 86400 s per day; interval arithmetic keeps the time of day.
    moved = targets.withColumn("_t", F.col("anchor") + F.make_dt_interval(days=F.col("offset")))
    return moved.join(df, moved["_t"] == df[time], "inner").drop("_t")
