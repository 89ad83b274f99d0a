"""Aggregates, class profiles, crosstabs, correlation, histograms and densities."""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.cleaning import numeric_columns
from tidemark.operators.ordering import BROADCAST_ROWS, quantiles
from tidemark.operators.scaling import Scaler, scale
from tidemark.session import checkpoint

_KERNEL_ROWS = 10_000

AggFunc = str | Callable[[Column], Column]

def _skew(c: Column) -> Column:
    """Sample skewness; NULL below three values."""
    n = F.count(c).cast("double")
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def _kurt(c: Column) -> Column:
    """Sample excess kurtosis; NULL below four values."""
    n = F.count(c).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6))


AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg,
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "count": F.count,
    "nunique": F.count_distinct,
    "std": F.stddev_samp,
    "var": F.var_samp,
    "sem": lambda c: F.stddev_samp(c) / F.sqrt(F.count(c).cast("double")),
    "skew": _skew,
    "kurt": _kurt,
    "kurtosis": _kurt,
    "prod": F.product,
    "product": F.product,
    "size": lambda c: F.count(F.lit(1)),
}


def _resolve(func: AggFunc | None) -> Callable[[Column], Column]:
    if callable(func):
        return func
    if isinstance(func, str) and func in AGGREGATES:
        return AGGREGATES[func]
    raise ValueError(f"invalid aggregate {func!r}; use 'median', one of {sorted(AGGREGATES)}, or a function")


def aggregate(
    df: DataFrame,
    func: AggFunc | None,
    by: Sequence[str] = (),
    columns: Sequence[str] | None = None,
    order: Sequence[str] = (),
) -> DataFrame:
    """One aggregate over every column, whole table or per group.

    ``func`` is a name or a ``Column -> Column`` function. The median is exact
    and distributed, see :func:`tidemark.operators.ordering.quantiles`. The mode
    is the most frequent value, the smallest of several. ``first`` and ``last``
    are the first and last value present and need an ``order``. A group without
    values stays, with NULL.
    """
    cols = list(columns) if columns is not None else [c for c in numeric_columns(df, by) if c not in order]
    if func in ("first", "last"):
        if not order:
            raise ValueError(f"{func!r} needs an order")
        pick = F.min_by if func == "first" else F.max_by
        return df.groupBy(*by).agg(*[pick(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in cols])
    if func == "mode":
        return _modes(df, cols, list(by))
    if func != "median":
        fold = _resolve(func)
        return df.groupBy(*by).agg(*[fold(F.col(c)).alias(c) for c in cols])
    found = quantiles(df, cols, [0.5], by)
    spread = [F.max(F.when(F.col("feature") == c, F.col("q")[0])).alias(c) for c in cols]
    return _every_group(df, found.groupBy(*by).agg(*spread), list(by), cols)


def _every_group(df: DataFrame, found: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """Give groups that ``found`` lacks a row of NULLs."""
    if not by:
        return found
    named = found.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], *cols)
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    return df.select(*by).distinct().join(named, same, "left").select(*by, *cols)


def _modes(df: DataFrame, cols: list[str], by: list[str]) -> DataFrame:
    """Counts of values first, so no task holds the values of a group."""
    out = None
    for c in cols:
        counts = df.filter(F.col(c).isNotNull()).groupBy(*by, c).agg(F.count(F.lit(1)).alias("_n"))
        best = counts.groupBy(*by).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(c).alias("v"))).alias("_m"))
        best = best.select(*by, F.lit(c).alias("_c"), F.col("_m.v").cast("double").alias("_v"))
        out = best if out is None else out.unionByName(best)
    wide = out.groupBy(*by).agg(*[F.max(F.when(F.col("_c") == c, F.col("_v"))).cast(df.schema[c].dataType).alias(c) for c in cols])
    return _every_group(df, wide, by, cols)


def class_profile(df: DataFrame, label: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Long table ``(label, feature, min, max, mean)``."""
    cols = list(columns) if columns is not None else numeric_columns(df, [label])
    aggs = [f(F.col(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(cols)
            for n, f in (("lo", F.min), ("hi", F.max), ("mu", F.avg))]
    wide = df.groupBy(label).agg(*aggs)
    rows = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"),
                 F.col(f"mu{i}").alias("mean"))
        for i, c in enumerate(cols)
    ])
    return wide.select(label, F.inline(rows))


def class_sizes(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).count()


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).filter(F.col(column).isNotNull()).distinct()


def crosstab(df: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """``(row, column, n, percent)`` with ``All`` margins, in percent of all rows.

    Counts non-missing ``value``. Every combination of the classes that occur
    is present, with 0 where no row has it.
    """
    counts = (
        df.groupBy(F.col(row).cast("string").alias(row), F.col(column).cast("string").alias(column))
        .agg(F.count(value).alias("n"), F.count(F.lit(1)).alias("_rows"))
    )
    # A row per pair of classes; all that follows reads this table.
    counts = checkpoint(counts)
    total = counts.agg(F.sum("_rows")).first()[0] or 0
    known = counts.filter(F.col(row).isNotNull() & F.col(column).isNotNull())
    margin = lambda c: F.explode(F.array(F.col(c), F.lit("All")))
    cells = known.withColumn(row, margin(row)).withColumn(column, margin(column))
    # Only classes met together with a known partner form a row or a column.
    wide = cells.groupBy(row).pivot(column).agg(F.sum("n"))
    classes = [c for c in wide.columns if c != row]
    if not classes:
        return cells.select(row, column, "n", F.lit(0.0).alias("percent"))
    pairs = F.array(*[F.struct(F.lit(c).alias(column), F.coalesce(wide[_quoted(c)], F.lit(0)).alias("n")) for c in classes])
    long = wide.select(F.col(row), F.inline(pairs))
    return long.select(row, column, "n", (F.col("n") / F.lit(total) * 100).alias("percent"))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def moments(df: DataFrame, vector: bool = False) -> DataFrame:
    """``(i, j, n, x, y, xx, yy, xy)``: sums over the rows where columns i and j both have a value.

    The columns are those of ``df``, or the dimensions of its one array column.
    One scan; a task returns a row per pair of columns.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in frames:
            if pdf.empty:
                continue
            x = np.stack(pdf.iloc[:, 0].to_numpy()).astype(float) if vector else pdf.to_numpy(float)
            there = ~np.isnan(x)
            x, mask = np.where(there, x, 0.0), there.astype(float)
            part = np.stack([mask.T @ mask, x.T @ mask, mask.T @ x, (x * x).T @ mask, mask.T @ (x * x), x.T @ x])
            total = part if total is None else total + part
        if total is not None:
            i, j = np.triu_indices(total.shape[1])
            yield pd.DataFrame({"i": i, "j": j} | {k: total[at][i, j] for at, k in enumerate(("n", "x", "y", "xx", "yy", "xy"))})

    parts = df.mapInPandas(run, "i int, j int, n double, x double, y double, xx double, yy double, xy double")
    return parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])


def correlation(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame | None:
    """Pearson matrix of numeric columns as ``(feature, *columns)``, pairwise complete."""
    if not df.columns:
        warnings.warn("the table is empty; no correlation", stacklevel=2)
        return None
    cols = list(columns) if columns is not None else numeric_columns(df)
    num = [F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)]
    means = df.agg(F.count(F.lit(1)).alias("rows"), *[F.avg(F.when(~F.isnan(c), c)).alias(f"m{i}") for i, c in enumerate(F.col(n).cast("double") for n in cols)]).first()
    rows = means["rows"]
    # Products of deviations from the means, so that large values cost no digits.
    centred = df.select(*num).select(*[(F.col(f"c{i}") - F.lit(means[f"m{i}"] or 0.0)).alias(f"c{i}") for i in range(len(cols))])
    values: dict[tuple[int, int], float | None] = {}
    for r in moments(centred).collect() if rows and cols else ():
        xx, yy = r["xx"] - r["x"] ** 2 / max(r["n"], 1), r["yy"] - r["y"] ** 2 / max(r["n"], 1)
        flat = xx <= 1e-14 * max(r["xx"], 1e-300) or yy <= 1e-14 * max(r["yy"], 1e-300)
        values[r["i"], r["j"]] = None if r["n"] < 2 or flat else max(-1.0, min(1.0, (r["xy"] - r["x"] * r["y"] / r["n"]) / math.sqrt(xx * yy)))
    if not rows:
        warnings.warn("the table is empty; no correlation", stacklevel=2)
        return None
    out = [(c, *[values[min(i, j), max(i, j)] for j in range(len(cols))]) for i, c in enumerate(cols)]
    schema = "feature string, " + ", ".join(f"`{c}` double" for c in cols)
    return df.sparkSession.createDataFrame(out, schema)


def climatology(df: DataFrame, time: str, columns: Sequence[str], per: str = "year") -> DataFrame:
    """Mean per year, or per calendar day over all years, dated for plotting.

    ``date`` is 1 January of the year, or the day in the leap year 2000.
    """
    means = [F.avg(c).alias(c) for c in columns]
    if per == "year":
        return df.groupBy(F.make_date(F.year(time), F.lit(1), F.lit(1)).alias("date")).agg(*means)
    if per == "day":
        day = F.make_date(F.lit(2000), F.month(time), F.dayofmonth(time))
        return df.groupBy(day.alias("date")).agg(*means)
    raise ValueError("per is 'year' or 'day'")


def bin_edges(df: DataFrame, feature: str) -> tuple[float, float, int]:
    """Pooled (low, high, bins): the finer of the Sturges and Freedman-Diaconis rules."""
    row = df.agg(F.min(feature).alias("lo"), F.max(feature).alias("hi"), F.count(feature).alias("n")).first()
    lo, hi, n = row["lo"], row["hi"], row["n"]
    if not n:
        raise ValueError(f"{feature} has no values")
    lo, hi = float(lo), float(hi)
    if lo == hi:
        return lo - 0.5, hi + 0.5, 1
    q = quantiles(df, [feature], [0.25, 0.75]).first()["q"]
    sturges = (hi - lo) / (math.log2(n) + 1)
    spread = 2 * (q[1] - q[0]) / n ** (1 / 3)
    return lo, hi, math.ceil((hi - lo) / (min(sturges, spread) if spread > 0 else sturges))


def class_histogram(df: DataFrame, feature: str, label: str, bins: int | None = None) -> DataFrame:
    """``(label, bin, low, high, n, percent, class_mean)`` over shared edges.

    ``percent`` is within the class. Bins are numbered from 0; the last one
    includes its upper edge. Bins a class does not reach are left out.
    """
    data = df.select(F.col(label).alias("label"), F.col(feature).cast("double").alias("x")).na.drop()
    lo, hi, count = bin_edges(data, "x")
    if bins is not None:
        count = bins
    slot = F.least(F.floor((F.col("x") - F.lit(lo)) * F.lit(count) / F.lit(hi - lo)), F.lit(count - 1)).cast("int")
    cells = data.groupBy("label", slot.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"))
    per_class = cells.groupBy("label").agg(F.sum("n").alias("_n"), (F.sum("s") / F.sum("n")).alias("class_mean"))
    step = (hi - lo) / count
    return cells.join(per_class, "label").select(
        "label", "bin",
        (F.lit(lo) + F.col("bin") * step).alias("low"),
        (F.lit(lo) + (F.col("bin") + 1) * step).alias("high"),
        "n", (F.col("n") / F.col("_n") * 100).alias("percent"), "class_mean",
    )


def class_density(df: DataFrame, feature: str, label: str, points: int = 200, shared: bool = True) -> DataFrame:
    """Gaussian kernel density per class: ``(label, point, x, density, class_mean)``.

    Scott bandwidth per class. The grid spans the pooled range (``shared``) or
    each class's own. A task adds the kernels of its rows into one vector per
    class, and only these vectors are shuffled.
    """
    if points < 2:
        raise ValueError("a density needs at least two points")
    return _densities(df, [feature], label, points, shared).drop("feature")


def _densities(df: DataFrame, features: Sequence[str], label: str, points: int, shared: bool) -> DataFrame:
    """``(feature, label, point, x, density, class_mean)`` of all features in one scan for facts and one for sums."""
    names = [f"v{i}" for i in range(len(features))]
    data = df.select(F.col(label).alias("label"), *[F.col(c).cast("double").alias(v) for c, v in zip(features, names)])
    data = data.filter(F.col("label").isNotNull()).select("label", *[F.when(~F.isnan(v), F.col(v)).alias(v) for v in names])
    wide = data.groupBy("label").agg(*[
        F.struct(F.count(v).alias("n"), F.stddev_samp(v).alias("s"), F.avg(v).alias("mean"), F.min(v).alias("lo"), F.max(v).alias("hi")).alias(v)
        for v in names
    ])
    wide = checkpoint(wide)
    if shared:
        pooled = wide.agg(*[f(F.col(f"{v}.{k}")).alias(f"{v}{k}") for v in names for k, f in (("lo", F.min), ("hi", F.max))]).first()
        wide = wide.select("label", *[
            F.col(v).withField("lo", F.lit(pooled[f"{v}lo"])).withField("hi", F.lit(pooled[f"{v}hi"])).alias(v) for v in names
        ])
    facts = wide.select("label", F.inline(F.array(*[F.struct(F.lit(i).alias("f"), F.col(v).alias("a")) for i, v in enumerate(names)])))
    facts = facts.select("label", "f", "a.*").withColumn("h", F.col("s") * F.pow(F.col("n"), F.lit(-0.2))).filter("n > 1 AND s > 0")
    per_label = facts.groupBy("label").agg(F.collect_list(F.struct("f", "lo", "hi", "h")).alias("facts"))
    few = wide.count() <= BROADCAST_ROWS
    spread = data.join(F.broadcast(per_label) if few else per_label, "label")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}

        def out() -> pd.DataFrame:
            keys = list(sums)
            return pd.DataFrame({"label": [k[0] for k in keys], "f": [k[1] for k in keys], "sums": [sums[k] for k in keys]})

        for pdf in frames:
            for name, group in pdf.groupby("label"):
                for fact in group["facts"].iloc[0]:
                    f, lo, hi, h = fact["f"], fact["lo"], fact["hi"], fact["h"]
                    x = lo + (hi - lo) * np.arange(points) / (points - 1)
                    v = group[f"v{f}"].to_numpy(float)
                    v = v[~np.isnan(v)]
                    total = sums.setdefault((name, f), np.zeros(points))
                    for at in range(0, len(v), _KERNEL_ROWS):
                        total += np.exp(-0.5 * ((x[:, None] - v[at : at + _KERNEL_ROWS]) / h) ** 2).sum(axis=1)
            if len(sums) > _KERNEL_ROWS:
                yield out()
                sums = {}
        if sums:
            yield out()

    schema = T.StructType().add("label", data.schema["label"].dataType).add("f", "integer").add("sums", T.ArrayType(T.DoubleType()))
    parts = spread.mapInPandas(run, schema).select("label", "f", F.posexplode("sums").alias("point", "part"))
    kernel = parts.groupBy("label", "f", "point").agg(F.sum("part").alias("part"))
    x = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("point") / F.lit(points - 1)
    name = F.element_at(F.array(*[F.lit(c) for c in features]), F.col("f") + 1)
    return kernel.join(facts, ["label", "f"]).select(
        name.alias("feature"), "label", "point", x.alias("x"),
        (F.col("part") / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi))).alias("density"), F.col("mean").alias("class_mean"),
    )


def class_distributions(
    df: DataFrame,
    label: str,
    features: Sequence[str] | None = None,
    n_features: int | None = 6,
    scaler: Scaler = "minmax",
    points: int = 100,
) -> DataFrame:
    """Scaled densities of selected features per class (the table behind a violin plot)."""
    from tidemark.operators.pca import select_features

    if label not in df.columns:
        raise KeyError(f"no column {label}")
    numeric = numeric_columns(df, [label])
    if len(numeric) < len(df.columns) - 1:
        raise TypeError("every column but the label must be numeric")
    chosen = select_features(df.select(*numeric), n_features, features)
    scaled = scale(df, chosen, scaler, prefix="") if scaler is not None else df
    return _densities(scaled, chosen, label, points, shared=False)


def class_radar(
    df: DataFrame,
    label: str,
    features: Sequence[str] | None = None,
    n_features: int | None = 6,
    agg_func: AggFunc = "mean",
    scaler: str | None = "standard",
) -> DataFrame:
    """``(label, feature, value, scaled, is_min, is_max)`` for each class.

    Scaling runs over the class rows, not over the data.
    """
    from tidemark.operators.pca import select_features

    if label not in df.columns:
        raise KeyError(f"no column {label}")
    chosen = select_features(df.select(*numeric_columns(df, [label])), n_features, features)
    wide = aggregate(df, agg_func, [label], chosen)
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in chosen])
    long = wide.select(F.col(label).alias("label"), F.inline(rows))
    facts = long.groupBy("feature").agg(
        F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"),
        F.min("value").alias("_lo"), F.max("value").alias("_hi"),
        F.min(F.struct("value", "label")).alias("_first"),
        F.min(F.struct((-F.col("value")).alias("value"), "label")).alias("_last"),
    )
    value = F.col("value")
    if scaler == "standard":
        small = F.col("_s") <= F.greatest(F.abs("_m"), F.lit(1.0)) * 1e-14
        scaled = F.when(small, F.lit(0.0)).otherwise(F.try_divide(value - F.col("_m"), F.col("_s")))
    elif scaler == "minmax":
        scaled = F.coalesce(F.try_divide(value - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))
    elif scaler == "robust":
        # facts has one row per chosen feature, and so has this table
        q = quantiles(long, ["value"], [0.25, 0.5, 0.75], ["feature"], name="_column")
        facts = facts.join(q.select("feature", "q"), "feature")
        spread = F.col("q")[2] - F.col("q")[0]
        scaled = (value - F.col("q")[1]) / F.when(spread == 0, F.lit(1.0)).otherwise(spread)
    elif scaler is None:
        scaled = value
    else:
        raise ValueError(f"unknown scaler {scaler!r}")
    return long.join(facts, "feature").select(
        "label", "feature", "value", scaled.alias("scaled"),
        (F.col("label") == F.col("_first.label")).alias("is_min"),
        (F.col("label") == F.col("_last.label")).alias("is_max"),
    )


def weighted_mean(df: DataFrame, value: str, weight: str | None = None) -> DataFrame:
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return df.agg(F.try_divide(F.sum(w * F.col(value)), F.sum(F.when(F.col(value).isNotNull(), w))).alias("mean"))


def arg_max(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``(feature, key)`` of the largest value per column; ties go to the smallest key."""
    best = df.agg(*[
        F.min(F.when(F.col(c).isNotNull(), F.struct((-F.col(c).cast("double")).alias("v"), F.col(key).alias("k")))).alias(f"b{i}")
        for i, c in enumerate(columns)
    ])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"b{i}.k").alias(key)) for i, c in enumerate(columns)])
    return best.select(F.inline(rows))


def any_flag(df: DataFrame, flags: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Whether any row (of a group) has each flag set above 0."""
    return df.groupBy(*by).agg(*[F.coalesce(F.bool_or(F.col(c) > 0), F.lit(False)).alias(c) for c in flags])
