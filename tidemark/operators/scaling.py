"""Standard, min-max and robust scaling with statistics from one pass."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.cleaning import numeric_columns, parse_time
from tidemark.operators.filters import clip_range, season
from tidemark.operators.ordering import quantiles

Scaler = str | Callable[[DataFrame, Sequence[str]], DataFrame] | None
SCALERS = ("standard", "minmax", "robust")


def centre_and_spread(df: DataFrame, columns: Sequence[str], scaler: str) -> dict[str, tuple[float, float]]:
    """``{column: (centre, spread)}``; a spread of 0 becomes 1, so constants scale to 0."""
    if scaler == "robust":
        rows = quantiles(df, columns, [0.25, 0.5, 0.75]).collect()  # one row per column
        found = {r["feature"]: (r["q"][1], r["q"][2] - r["q"][0]) for r in rows}
    elif scaler in ("standard", "minmax"):
        low, high = (F.avg, F.stddev_pop) if scaler == "standard" else (F.min, F.max)
        exprs = [f(F.col(c).cast("double")).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("a", low), ("b", high))]
        row = df.agg(*exprs).first()
        found = {c: (row[f"a{i}"], row[f"b{i}"]) for i, c in enumerate(columns)}
        if scaler == "minmax":
            found = {c: (a, None if a is None else b - a) for c, (a, b) in found.items()}
    else:
        raise ValueError(f"unknown scaler {scaler!r}; use one of {SCALERS} or None")
    # Rounding in the mean of equal values leaves a spread of a few ulps; that is 0 too.
    def usable(a: float | None, b: float | None) -> tuple[float, float]:
        if a is None or b is None:
            return 0.0, 1.0
        return a, b if abs(b) > 1e-14 * max(1.0, abs(a)) else 1.0

    return {c: usable(*found.get(c, (None, None))) for c in columns}


def scale(
    df: DataFrame, columns: Sequence[str], scaler: Scaler = "standard", prefix: str = "scaled_"
) -> DataFrame:
    """Add ``prefix + column`` for every column (replace it when the prefix is empty)."""
    if scaler is None:
        return df.withColumns({prefix + c: F.col(c).cast("double") for c in columns})
    if callable(scaler):
        done = scaler(df, columns)
        if not prefix:
            return done
        raise ValueError("a scaler function replaces columns; give an empty prefix")
    facts = centre_and_spread(df, columns, scaler)
    return df.withColumns(
        {prefix + c: (F.col(c).cast("double") - F.lit(a)) / F.lit(b) for c, (a, b) in facts.items()}
    )


def prepare(
    df: DataFrame,
    time: str,
    fmt: str = "mixed",
    start=None,
    end=None,
    months: Sequence[int] = (),
    scaler: str | None = "standard",
):
    """Parse times, clip the range, keep months, scale every numeric column.

    Returns the table and the clip report. The time column is kept next to the
    scaled values.
    """
    df = parse_time(df, time, fmt, fallback=True)
    df, report = clip_range(df, time, start, end)
    if months:
        df = season(df, time, months)
    if scaler is not None:
        df = scale(df.select(time, *numeric_columns(df)), numeric_columns(df), scaler, prefix="")
    return df, report
