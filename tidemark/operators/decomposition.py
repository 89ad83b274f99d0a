"""Singular-spectrum and extended-EOF decomposition of long series.

The delay matrix (all length-M windows) is never built for a decomposition.
Its M x M moment matrix follows from M lag sums and the first and last M
values, because moving a window one step drops one product and adds another.
Reconstruction convolves each bucket, which sees M - 1 rows on either side,
with the eigenvectors of its series.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.aggregate import climatology
from tidemark.operators.autocorrelation import grouped_schema, key_frame, lag_sums
from tidemark.operators.ordering import BUCKET, attach, bucket_rows, keyed, ordinal, with_halo
from tidemark.session import checkpoint

SSA_WINDOW = 120
EEOF_WINDOW = 400


def _ready(df: DataFrame, column: str, window: int, series: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Check the series and add ``_n``, ``_mean`` and the centred ``_x``."""
    if isinstance(window, bool) or not isinstance(window, int):
        raise TypeError("the window length must be an integer")
    if window < 1:
        raise ValueError("the window length must be positive")
    facts = df.groupBy(*series).agg(
        F.count(F.lit(1)).alias("_n"), F.avg(column).alias("_mean"), F.count(column).alias("_have")
    )
    if series:
        facts = checkpoint(facts)
        worst = facts.agg(F.min("_n").alias("n"), F.max(F.col("_n") - F.col("_have")).alias("missing")).first()
        out = attach(df, facts.drop("_have"), series)
    else:
        row = facts.first()
        worst = {"n": row["_n"], "missing": row["_n"] - row["_have"]}
        out = df.withColumns({"_n": F.lit(row["_n"]).cast("long"), "_mean": F.lit(row["_mean"]).cast("double")})
    if worst["n"] is None or worst["n"] < window:
        raise ValueError("a series must be at least as long as the window")
    if worst["missing"]:
        raise ValueError(f"{column} has missing values; fill or drop them first")
    return keyed(out.withColumn("_x", F.col(column).cast("double") - F.col("_mean")), series)


def delay_windows(
    df: DataFrame, column: str, window: int, series: Sequence[str] = (), idx: str = "idx", size: int | None = None
) -> DataFrame:
    """All length-``window`` windows as ``(*series, idx, values)``; ``idx`` is the first row."""
    size = bucket_rows(window, size)
    spread = with_halo(df.select(*series, idx, column), size, after=window - 1, idx=idx)
    ahead = Window.partitionBy(*series, BUCKET).orderBy(idx).rowsBetween(0, window - 1)
    values = F.collect_list(F.col(column).cast("double")).over(ahead)
    full = spread.withColumn("values", values).filter(F.col("_own") & (F.size("values") == window))
    return full.select(*series, idx, "values")


def _eigen(
    df: DataFrame, column: str, window: int, keys: list[str], subtract_mean: bool, components: int | None,
    idx: str, size: int | None,
) -> DataFrame:
    """``(*keys, _len, _shift, component, eigenvalue, ratio, vector, _means)`` per series.

    ``_shift`` was taken off the signal first; ``_means`` are the column means of
    the delay matrix after that (0 without ``subtract_mean``).
    """
    m = window
    moved = df if subtract_mean else df.withColumn("_x", F.col(column).cast("double")).withColumn("_mean", F.lit(0.0))
    # 3 M rows per series, whatever its length; the first M also carry its length and shift.
    ends = moved.filter((F.col(idx) < m) | (F.col(idx) >= F.col("_n") - m))
    near_head = F.when(F.col(idx) < m, F.struct(F.lit("head").alias("_kind"), F.col(idx).alias("_at")))
    near_tail = F.when(
        F.col(idx) >= F.col("_n") - m, F.struct(F.lit("tail").alias("_kind"), (F.col(idx) - F.col("_n") + m).alias("_at"))
    )
    ends = ends.withColumn("_e", F.explode(F.array_compact(F.array(near_head, near_tail)))).select(
        *keys, "_e._kind", "_e._at", F.col("_x").alias("_v"), F.col("_n").alias("_len"), F.col("_mean").alias("_shift")
    )
    lags = lag_sums(moved, m - 1, keys, idx, size).select(
        *keys, F.lit("lag").alias("_kind"), F.col("lag").cast("long").alias("_at"), F.col("_sum").alias("_v")
    )
    parts = ends.unionByName(lags, allowMissingColumns=True)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        n, shift = int(pdf["_len"].max()), float(pdf["_shift"].max())
        first, last, sums = (
            pdf[pdf["_kind"] == k].sort_values("_at")["_v"].to_numpy(float) for k in ("head", "tail", "lag")
        )
        count = n - m + 1
        moment = np.empty((m, m))
        # Row 0 sums over window starts only; the last M - 1 starts have no full window.
        moment[0] = [sums[j] - np.dot(last[1 : m - j], last[1 + j :]) for j in range(m)]
        moment[:, 0] = moment[0]
        for i in range(m - 1):
            moment[i + 1, 1:] = moment[i, :-1] - first[i] * first[:-1] + last[i + 1] * last[1:]
        means = np.zeros(m)
        if subtract_mean:
            column_sum = np.empty(m)
            column_sum[0] = -last[1:].sum()  # the centred series sums to 0
            for j in range(m - 1):
                column_sum[j + 1] = column_sum[j] - first[j] + last[j + 1]
            means = column_sum / count
            moment = (moment - count * np.outer(means, means)) / max(count - 1, 1)
        values, vectors = np.linalg.eigh((moment + moment.T) / 2)
        values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1].T
        keep = m if components is None else min(components, m)
        lead = np.argmax(np.abs(vectors) >= np.abs(vectors).max(axis=1, keepdims=True) * (1 - 1e-9), axis=1)
        vectors = vectors * np.where(vectors[np.arange(m), lead] < 0, -1.0, 1.0)[:, None]
        whole = values.sum()
        return key_frame(keys, pdf, {
            "_len": [n] * keep, "_shift": [shift] * keep, "component": np.arange(keep), "eigenvalue": values[:keep],
            "ratio": values[:keep] / whole if whole > 0 else np.zeros(keep),
            "vector": list(vectors[:keep]), "_means": [means] * keep,
        })

    schema = grouped_schema(
        df, keys, ("_len", "long"), ("_shift", "double"), ("component", "int"), ("eigenvalue", "double"),
        ("ratio", "double"), ("vector", "array<double>"), ("_means", "array<double>"),
    )
    return parts.groupBy(*keys).applyInPandas(solve, schema)


def _apply(df: DataFrame, column: str, spectra: DataFrame, keys: list[str], window: int, idx: str, size: int | None, compute, *more):
    """Run ``compute(signal, start, own_from, own_to, spectrum) -> columns`` on every bucket."""
    size = bucket_rows(window, size)
    rows = with_halo(df.select(*keys, idx, F.col(column).cast("double").alias("_v")), size, window - 1, window - 1, idx)
    to_bucket = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_len - 1) div {size}"))).alias(BUCKET)
    spectra = spectra.select("*", to_bucket)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left.sort_values(idx), right.sort_values("component")
        own = left[idx][left["_own"]]
        if own.empty:  # copies past the end of the series
            return pd.DataFrame(columns=schema.names)
        start = int(left[idx].iloc[0])
        columns = compute(left["_v"].to_numpy(float), start, int(own.iloc[0]), int(own.iloc[-1]) + 1, right)
        if not len(columns[idx]):  # no window starts here
            return pd.DataFrame(columns=schema.names)
        return key_frame(keys, left, columns)

    schema = grouped_schema(df, keys, (idx, "long"), *more)
    group = [*keys, BUCKET]
    return rows.groupBy(*group).cogroup(spectra.groupBy(*group)).applyInPandas(run, schema)


def ssa_spectrum(
    df: DataFrame, column: str, window: int = SSA_WINDOW, series: Sequence[str] = (), idx: str = "idx", size: int | None = None
) -> DataFrame:
    """``(*series, component, eigenvalue, ratio, vector)`` of the uncentred lag covariance."""
    data, keys = _ready(df, column, window, series)
    return _eigen(data, column, window, keys, False, None, idx, size).select(
        *series, "component", "eigenvalue", "ratio", "vector"
    )


def ssa(
    df: DataFrame,
    column: str,
    window: int = SSA_WINDOW,
    components: int | None = None,
    series: Sequence[str] = (),
    idx: str = "idx",
    size: int | None = None,
    together: bool = False,
) -> DataFrame:
    """Reconstructed series ``(*series, idx, component, value)`` by diagonal averaging.

    All ``window`` components sum to the signal. With ``together`` the first
    ``components`` are summed where they are computed: ``(*series, idx, value)``.
    """
    data, keys = _ready(df, column, window, series)
    spectra = _eigen(data, column, window, keys, False, components, idx, size)

    def rebuild(x, start, lo, hi, spectrum):
        n = int(spectrum["_len"].iloc[0])
        at = np.arange(lo, hi)
        divisor = np.minimum(np.minimum(at + 1, n - at), min(window, n - window + 1))
        parts = []
        for vector in spectrum["vector"]:
            v = np.asarray(vector, float)
            scores = np.correlate(x, v, "valid")
            parts.append(np.convolve(scores, v)[lo - start : hi - start] / divisor)
        if together:
            return {idx: at, "value": np.sum(parts, axis=0)}
        return {
            idx: np.tile(at, len(parts)), "component": np.repeat(spectrum["component"].to_numpy(), len(at)),
            "value": np.concatenate(parts),
        }

    more = [("value", "double")] if together else [("component", "int"), ("value", "double")]
    out = _apply(data, column, spectra, keys, window, idx, size, rebuild, *more)
    return out.select(*series, idx, *[n for n, _ in more])


def ssa_deseasonalise(
    df: DataFrame, column: str, window: int = SSA_WINDOW, components: int = 4, series: Sequence[str] = (),
    idx: str = "idx", out: str | None = None, size: int | None = None,
) -> DataFrame:
    """Add ``ssa_<column>``: the signal less its leading components."""
    fit = ssa(df, column, window, components, series, idx, size, together=True).withColumnRenamed("value", "_fit")
    joined = df.join(fit, [*series, idx], "left")
    return joined.withColumn(out or f"ssa_{column}", F.col(column) - F.col("_fit")).drop("_fit")


def eeof_spectrum(
    df: DataFrame, column: str, window: int = EEOF_WINDOW, components: int | None = 9, series: Sequence[str] = (),
    idx: str = "idx", size: int | None = None,
) -> DataFrame:
    """``(*series, component, eigenvalue, ratio, vector)``: variance, its share, and the pattern by lag."""
    data, keys = _ready(df, column, window, series)
    return _eigen(data, column, window, keys, True, components, idx, size).select(
        *series, "component", "eigenvalue", "ratio", "vector"
    )


def _scores(x: np.ndarray, spectrum: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores of every window inside ``x`` (components x windows), vectors, means."""
    vectors = np.stack([np.asarray(v, float) for v in spectrum["vector"]])
    means = np.asarray(spectrum["_means"].iloc[0], float)
    shifted = x - float(spectrum["_shift"].iloc[0])
    return np.stack([np.correlate(shifted, v, "valid") - v @ means for v in vectors]), vectors, means


def eeof_scores(
    df: DataFrame, column: str, window: int = EEOF_WINDOW, components: int = 9, series: Sequence[str] = (),
    idx: str = "idx", size: int | None = None,
) -> DataFrame:
    """``(*series, idx, scores)``: one score per component for the window that starts at ``idx``."""
    data, keys = _ready(df, column, window, series)
    spectra = _eigen(data, column, window, keys, True, components, idx, size)

    def project(x, start, lo, hi, spectrum):
        hi = min(hi, int(spectrum["_len"].iloc[0]) - window + 1)
        scores = _scores(x, spectrum)[0][:, lo - start : max(hi, lo) - start]
        return {idx: np.arange(lo, max(hi, lo)), "scores": list(scores.T)}

    return _apply(data, column, spectra, keys, window, idx, size, project, ("scores", "array<double>")).select(
        *series, idx, "scores"
    )


def eeof_reconstruction(
    df: DataFrame, column: str, window: int = EEOF_WINDOW, components: int = 9, series: Sequence[str] = (),
    idx: str = "idx", size: int | None = None,
) -> DataFrame:
    """``(*series, idx, values)``: the rebuilt window that ends at ``idx``; NULL for the first M - 1 rows."""
    data, keys = _ready(df, column, window, series)
    spectra = _eigen(data, column, window, keys, True, components, idx, size)

    def rebuild(x, start, lo, hi, spectrum):
        scores, vectors, means = _scores(x, spectrum)
        base = means + float(spectrum["_shift"].iloc[0])
        at = np.arange(lo, hi)
        return {idx: at, "values": [None if t < window - 1 else base + scores[:, t - window + 1 - start] @ vectors for t in at]}

    return _apply(data, column, spectra, keys, window, idx, size, rebuild, ("values", "array<double>")).select(
        *series, idx, "values"
    )


def eeof_deseasonalise(
    df: DataFrame, column: str, window: int = EEOF_WINDOW, components: int = 4, series: Sequence[str] = (),
    idx: str = "idx", out: str | None = None, size: int | None = None,
) -> DataFrame:
    """Add ``eeof_<column>``: the signal less its rebuilt value.

    Row t is read from the window that starts at t, at lag 0; the last rows,
    where no window starts, from the last window at the matching lag.
    """
    data, keys = _ready(df, column, window, series)
    spectra = _eigen(data, column, window, keys, True, components, idx, size)

    def rebuild(x, start, lo, hi, spectrum):
        scores, vectors, means = _scores(x, spectrum)
        at = np.arange(lo, hi)
        first = np.minimum(at, int(spectrum["_len"].iloc[0]) - window)
        lag = at - first
        fit = means[lag] + np.einsum("ct,ct->t", scores[:, first - start], vectors[:, lag])
        return {idx: at, "_fit": fit + float(spectrum["_shift"].iloc[0])}

    fit = _apply(data, column, spectra, keys, window, idx, size, rebuild, ("_fit", "double")).select(*series, idx, "_fit")
    joined = df.join(fit, [*series, idx], "left")
    return joined.withColumn(out or f"eeof_{column}", F.col(column) - F.col("_fit")).drop("_fit")


def seasonal_cycle(
    df: DataFrame, time: str, columns: Sequence[str], per: str = "year", window: int | None = None, components: int = 4
) -> DataFrame:
    """Climatology with its slow part: ``(idx, date, feature, mean, trend, rebuilt)``.

    ``trend`` is the leading singular-spectrum component, ``rebuilt`` the sum
    of the first ``components`` (all of them if there are fewer).
    """
    window = window or (10 if per == "year" else 90)
    means = climatology(df, time, columns, per).filter("date IS NOT NULL")
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("mean")) for c in columns])
    long = ordinal(means.select("date", F.inline(rows)), ["date"], ["feature"])
    parts = ssa(long, "mean", window, min(components, window), ["feature"])
    fit = parts.groupBy("feature", "idx").agg(
        F.max(F.when(F.col("component") == 0, F.col("value"))).alias("trend"), F.sum("value").alias("rebuilt")
    )
    return long.join(fit, ["feature", "idx"]).select("idx", "date", "feature", "mean", "trend", "rebuilt")


def eigen_spectrum(
    df: DataFrame, column: str, window: int = EEOF_WINDOW, components: int = 9, series: Sequence[str] = (), idx: str = "idx"
) -> DataFrame:
    """Tables behind an eigen-spectrum figure as ``(*series, panel, component, at, value)``.

    Panels: ``percent`` (``at`` is the rank from 1), ``eeof`` (first two
    patterns by lag) and ``epc`` (first two scores by window).
    """
    spectra = eeof_spectrum(df, column, window, components, series, idx)
    percent = spectra.select(
        *series, F.lit("percent").alias("panel"), "component", (F.col("component") + 1).cast("long").alias("at"),
        (F.col("ratio") * 100).alias("value"),
    )
    patterns = spectra.filter("component < 2").select(
        *series, F.lit("eeof").alias("panel"), "component", F.posexplode("vector").alias("at", "value")
    )
    scores = eeof_scores(df, column, window, min(components, 2), series, idx).select(
        *series, F.lit("epc").alias("panel"), F.posexplode("scores").alias("component", "value"), F.col(idx).alias("at")
    )
    patterns = patterns.withColumn("at", F.col("at").cast("long"))
    return percent.unionByName(patterns).unionByName(scores)
