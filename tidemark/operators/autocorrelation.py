"""Autocorrelation of long series from per-bucket lag sums."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.expressions import pearson
from tidemark.operators.cleaning import numeric_columns
from tidemark.operators.ordering import BUCKET, attach, bucket_rows, keyed, ordinal, with_halo, with_lag

# Durbin-Watson band without first-order autocorrelation, and
# the reference lines drawn around an autocorrelation function.
DW_LOW, DW_HIGH = 1.5, 2.5


def grouped_schema(df: DataFrame, keys: Sequence[str], *more: tuple[str, str]) -> T.StructType:
    fields = [T.StructField(k, df.schema[k].dataType) for k in keys]
    return T.StructType(fields + [T.StructField(n, T.DataType.fromDDL(t)) for n, t in more])

#: Multiplications per point and level that a transform stands for when it is weighed against direct sums.
_FFT_STEPS = 4


def key_frame(keys: Sequence[str], pdf: pd.DataFrame, columns: dict) -> pd.DataFrame:
    out = pd.DataFrame(columns)
    for at, k in enumerate(keys):
        out.insert(at, k, pdf[k].iloc[0])
    return out


def centred(df: DataFrame, column: str, series: Sequence[str]) -> DataFrame:
    """Adds ``_n``, ``_mean`` and ``_x``, the value less its series mean."""
    facts = df.groupBy(*series).agg(F.count(F.lit(1)).alias("_n"), F.avg(column).alias("_mean"))
    out = attach(df, facts, series)
    return out.withColumn("_x", F.col(column).cast("double") - F.col("_mean"))


def shifted_products(x: np.ndarray, own: int, lags: int) -> np.ndarray:
    """Sums of ``x[t] * x[t + lag]`` over ``t < own``, for lag 0..lags as far as ``x`` reaches.

    Products with shifted values are a correlation, so a fast Fourier transform
    gives all lags at once; ``x`` holds the rows behind the ``own`` ones, and the
    padding keeps the ends apart (overlap-save). Few lags are summed directly.
    """
    top = min(lags, len(x) - 1)
    n = 1 << int(len(x) + own - 1).bit_length()
    if own * (top + 1) <= _FFT_STEPS * n * n.bit_length():
        return np.array([np.dot(x[: min(own, len(x) - k)], x[k : k + own]) for k in range(top + 1)])
    return np.fft.irfft(np.conj(np.fft.rfft(x[:own], n)) * np.fft.rfft(x, n), n)[: top + 1]


def lag_sums(
    df: DataFrame, lags: int, keys: Sequence[str], idx: str = "idx", size: int | None = None
) -> DataFrame:
    """``(*keys, lag, _sum)``: sum of ``_x[t] * _x[t + lag]`` for lag 0..lags.

    Each bucket sees ``lags`` rows past its end, becomes one array, and sends
    ``lags + 1`` numbers; Spark adds them up, so no series is in one task. Many
    lags of a bucket come from one transform (see :func:`shifted_products`).
    Tasks take many buckets per batch, which keeps short series cheap.
    """
    size = bucket_rows(lags, size)
    ordered = F.array_sort(F.collect_list(F.struct(F.col(idx).alias("i"), F.col("_x").alias("x"))))
    spread = with_halo(df.select(*keys, idx, "_x"), size, after=lags, idx=idx)
    arrays = spread.groupBy(*keys, BUCKET).agg(
        F.transform(ordered, lambda s: s["x"]).alias("_xs"), F.count_if("_own").alias("_owned")
    )
    names = list(keys)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sums = []
            for x, own in zip(pdf["_xs"], pdf["_owned"]):
                sums.append(shifted_products(np.asarray(x, float), own, lags).tolist())
            yield pdf[names].assign(_sums=sums)

    schema = grouped_schema(df, keys, ("_sums", "array<double>"))
    sums = arrays.mapInPandas(partial, schema).select(*keys, F.posexplode("_sums").alias("lag", "_sum"))
    return sums.groupBy(*keys, "lag").agg(F.sum("_sum").alias("_sum"))


def acf(
    df: DataFrame, column: str, lags: int = 500, series: Sequence[str] = (), idx: str = "idx", size: int | None = None
) -> DataFrame:
    """``(*series, lag, acf)``: mean removed, divided by n, 1 at lag 0.

    Lags beyond the series are left out; a constant series gives NULL.
    """
    data, keys = keyed(centred(df, column, series), series)
    # lags + 1 rows per series at most, so a window per series is small
    zero = F.max(F.when(F.col("lag") == 0, F.col("_sum"))).over(Window.partitionBy(*keys))
    return lag_sums(data, lags, keys, idx, size).select(*series, "lag", F.try_divide("_sum", zero).alias("acf"))


def pacf(
    df: DataFrame, column: str, lags: int = 500, series: Sequence[str] = (), idx: str = "idx", size: int | None = None
) -> DataFrame:
    """``(*series, lag, pacf)`` by the Durbin-Levinson recursion on the biased autocorrelation."""
    data, keys = keyed(df, series)
    r = acf(data, column, lags, keys if series else (), idx, size)
    r, keys = keyed(r, series)

    def levinson(pdf: pd.DataFrame) -> pd.DataFrame:
        rho = pdf.sort_values("lag")["acf"].to_numpy(float)
        out, phi, error = np.ones(len(rho)), np.zeros(0), 1.0
        for k in range(1, len(rho)):
            last = (rho[k] - phi @ rho[k - 1 : 0 : -1]) / error
            phi = np.append(phi - last * phi[::-1], last)
            error *= 1 - last * last
            out[k] = last
        return key_frame(keys, pdf, {"lag": np.arange(len(rho)), "pacf": out})

    schema = grouped_schema(r, keys, ("lag", "int"), ("pacf", "double"))
    return r.groupBy(*keys).applyInPandas(levinson, schema).select(*series, "lag", "pacf")


def lag_correlation(
    df: DataFrame, columns: Sequence[str] | None = None, lag: int = 1, series: Sequence[str] = (), idx: str = "idx"
) -> DataFrame:
    """``(*series, feature, autocorrelation)``: Pearson of each column with itself ``lag`` rows ago."""
    cols = list(columns) if columns is not None else numeric_columns(df, [*series, idx])
    shifted = with_lag(df, {f"_lag_{c}": (c, lag) for c in cols}, series, idx)
    number = lambda c: F.col(c).cast("double")
    wide = shifted.groupBy(*series).agg(*[pearson(number(c), number(f"_lag_{c}")).alias(f"r{i}") for i, c in enumerate(cols)])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"r{i}").alias("autocorrelation")) for i, c in enumerate(cols)])
    return wide.select(*series, F.inline(rows))


def durbin_watson(
    df: DataFrame, columns: Sequence[str], series: Sequence[str] = (), idx: str = "idx"
) -> DataFrame:
    """``(*series, feature, durbin_watson, seasonal)``; ``seasonal`` outside the usual band."""
    shifted = with_lag(df, {f"_lag_{c}": (c, 1) for c in columns}, series, idx)
    aggs = []
    for i, c in enumerate(columns):
        step = F.col(c) - F.col(f"_lag_{c}")
        aggs += [F.sum(step * step).alias(f"d{i}"), F.sum(F.col(c) * F.col(c)).alias(f"s{i}")]
    rows = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.try_divide(F.col(f"d{i}"), F.col(f"s{i}")).alias("durbin_watson"))
        for i, c in enumerate(columns)
    ])
    dw = F.col("durbin_watson")
    long = shifted.groupBy(*series).agg(*aggs).select(*series, F.inline(rows))
    return long.withColumn("seasonal", (dw < DW_LOW) | (dw > DW_HIGH))


def regression_residuals(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add ``resid_<c>``: each column regressed on the others, no intercept.

    All regressions share one pass over the products of columns; only the
    d x d sums reach the driver.
    """
    cols = list(columns)
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    sums = df.agg(*[F.sum(F.col(cols[i]) * F.col(cols[j])).alias(f"s{i}_{j}") for i, j in pairs]).first()
    gram = np.zeros((len(cols), len(cols)))
    for i, j in pairs:
        gram[i, j] = gram[j, i] = sums[f"s{i}_{j}"]
    out = {}
    for i, c in enumerate(cols):
        rest = [j for j in range(len(cols)) if j != i]
        beta = np.linalg.lstsq(gram[np.ix_(rest, rest)], gram[rest, i], rcond=None)[0]
        fitted = F.lit(0.0)
        for b, j in zip(beta, rest):
            fitted = fitted + F.lit(float(b)) * F.col(cols[j])
        out[f"resid_{c}"] = F.col(c) - fitted
    return df.withColumns(out)


def seasonality_check(df: DataFrame, columns: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Durbin-Watson of every column's regression residual: ``(feature, durbin_watson, seasonal)``.

    Rows with a missing value are left out before rows are numbered by
    ``order``. Without ``order`` the table has ``idx`` and no missing value.
    """
    complete = df
    if order:
        complete = ordinal(df.select(*order, *columns).na.drop(subset=list(columns)), list(order))
    fitted = regression_residuals(complete, columns)
    found = durbin_watson(fitted, [f"resid_{c}" for c in columns])
    return found.withColumn("feature", F.substring("feature", len("resid_") + 1, 10_000))
