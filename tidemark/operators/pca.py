"""Principal components: scores, loadings, feature choice, biplot tables.

The covariance is summed on the executors; only d x d numbers reach the
driver. Each component is turned so that its largest loading by size is
positive (first feature wins a tie).
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.aggregate import moments
from tidemark.operators.cleaning import numeric_columns
from tidemark.operators.scaling import Scaler, centre_and_spread
from tidemark.sources.feeds import write_csv

_NARROW = 16


@dataclass
class PCAResult:
    """``scores``: input rows plus array ``score``. The rest is d x d or smaller."""

    scores: DataFrame
    features: list[str]
    components: np.ndarray
    explained_variance: np.ndarray
    explained_ratio: np.ndarray

    def loadings(self, n_components: int = 4) -> DataFrame:
        """``(row_name, PC0, PC1, ...)``: one row per feature plus two variance rows."""
        d = len(self.features)
        if n_components > d:
            warnings.warn(f"only {d} components exist; using {d}", UserWarning, stacklevel=2)
            n_components = d
        names = [f"PC{i}" for i in range(n_components)]
        rows = [(f, *map(float, self.components[:n_components, j])) for j, f in enumerate(self.features)]
        rows.append(("Expl_var", *map(float, self.explained_variance[:n_components])))
        rows.append(("Expl_var_ratio", *map(float, self.explained_ratio[:n_components])))
        schema = "row_name string, " + ", ".join(f"{n} double" for n in names)
        return self.scores.sparkSession.createDataFrame(rows, schema)


def _turned(components: np.ndarray) -> np.ndarray:
    """Signs that make the largest loading by size positive; near ties count as ties."""
    size = np.abs(components)
    lead = np.argmax(size >= size.max(axis=1, keepdims=True) * (1 - 1e-9), axis=1)
    return np.where(components[np.arange(len(components)), lead] < 0, -1.0, 1.0)


def _covariance(rows: DataFrame, d: int, vector: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Means and sample covariance of columns, or of one array column, from one scan."""
    mean, cov, counts = np.zeros(d), np.zeros((d, d)), set()
    for r in moments(rows, vector).collect():  # a row per pair of features
        i, j, n = r["i"], r["j"], r["n"]
        counts.add(n)
        cov[i, j] = cov[j, i] = (r["xy"] - r["x"] * r["y"] / max(n, 1)) / max(n - 1, 1)
        if i == j:
            mean[i] = r["x"] / max(n, 1)
    if len(counts) > 1:
        raise ValueError("features have missing values; fill or drop them first")
    return mean, cov


def _components(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values, kind="stable")[::-1]
    components = vectors[:, order].T
    return components * _turned(components)[:, None], np.maximum(values[order], 0.0)


def _projected(vector: Column, components: np.ndarray) -> Column:
    """All scores of a row; narrow tables stay in generated code, wide ones go in batches."""
    d = len(components)
    if d <= _NARROW:
        at = [F.get(vector, F.lit(i)) for i in range(d)]
        return F.array(*[sum((a * float(c) for a, c in zip(at[1:], row[1:])), at[0] * float(row[0])) for row in components])

    @F.pandas_udf("array<double>")
    def project(rows: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(rows.to_numpy()).astype(float) @ components.T)) if len(rows) else rows

    return project(vector)


def pca(
    df: DataFrame,
    features: Sequence[str] | None = None,
    scaler: Scaler = "standard",
    save_csv: str | None = None,
    n_components: int = 4,
) -> PCAResult:
    """Full PCA of numeric columns; a column called ``label`` is left out.

    ``score`` holds all components of a row, computed where the row is.
    """
    names = list(features) if features is not None else numeric_columns(df, ["label"])
    texts = [c for c in df.columns if features is None and c != "label" and c not in names]
    if texts:
        raise TypeError(f"every column must be numeric, these are not: {texts}")
    done = scaler(df, names) if callable(scaler) else df
    plain = scaler is None or callable(scaler)
    facts = centre_and_spread(done, names, "standard" if plain else scaler)
    spread = np.array([1.0 if plain else facts[c][1] for c in names])
    shifted = [F.col(c).cast("double") - F.lit(facts[c][0]) for c in names]
    mean, cov = _covariance(done.select(*[v.alias(f"c{i}") for i, v in enumerate(shifted)]), len(names))
    components, variance = _components(cov / np.outer(spread, spread))
    centred = [((v - F.lit(float(m))) / F.lit(float(b))).alias(c) for v, m, b, c in zip(shifted, mean, spread, names)]
    keep = [c for c in df.columns if c not in names]
    scores = done.select(*keep, *centred).withColumn("score", _projected(F.array(*[F.col(c) for c in names]), components))
    result = PCAResult(scores, names, components, variance, variance / (variance.sum() or 1.0))
    if save_csv:
        write_csv(result.loadings(n_components), save_csv)
    return result


def pca_array(df: DataFrame, column: str) -> PCAResult:
    """PCA of an array column, centred but not scaled (embeddings and the like)."""
    as_double = F.col(column).cast("array<double>")
    top = df.filter(F.col(column).isNotNull()).select(as_double.alias("v")).first()["v"]
    d, shift = len(top), F.array(*[F.lit(float(v or 0.0)) for v in top])
    # Any row serves as a shift that keeps the digits of the sums.
    mean, cov = _covariance(df.select(F.zip_with(as_double, shift, lambda v, m: v - m).alias("x")), d, vector=True)
    components, variance = _components(cov)
    centre = F.array(*[F.lit(float(v or 0.0) + float(m)) for v, m in zip(top, mean)])
    score = _projected(F.zip_with(as_double, centre, lambda v, m: v - m), components)
    return PCAResult(df.withColumn("score", score), [f"x{i}" for i in range(d)], components, variance, variance / (variance.sum() or 1.0))


def select_features(
    df: DataFrame, n_features: int | None = None, features: Sequence[str] | None = None
) -> list[str]:
    """The given features, or ``n_features`` leaders of the first components.

    A component's leader is the feature with the largest signed loading, so
    the choice follows the sign rule above. Components are added until exactly
    ``n_features`` distinct leaders are found.
    """
    if not features and n_features is None:
        raise ValueError("give n_features or features")
    if n_features is not None and (not isinstance(n_features, int) or n_features <= 0):
        raise ValueError("n_features must be a positive integer")
    if features:
        return list(features)
    if n_features == len(df.columns):
        return list(df.columns)
    if n_features > len(df.columns):
        raise ValueError(f"cannot choose {n_features} of {len(df.columns)} features")
    fitted = pca(df)
    leaders: list[str] = []
    for row in fitted.components:
        name = fitted.features[int(np.argmax(row))]
        if name not in leaders:
            leaders.append(name)
        if len(leaders) == n_features:
            return leaders
    raise ValueError(f"the components lead to {len(leaders)} distinct features, not {n_features}")


def top_features(result: PCAResult, n: int, components: int = 2) -> list[str]:
    """The ``n`` features with the longest loading vectors, longest last."""
    length = (result.components[:components] ** 2).sum(axis=0)
    return [result.features[i] for i in np.argsort(length, kind="stable")[-n:]]


def biplot(result: PCAResult, keep: Sequence[str] = (), dims: int = 2, n_arrows: int = 4):
    """Scaled scores ``(*keep, x0, x1, ...)`` and arrows ``(feature, x0, x1, ...)``."""
    if dims not in (2, 3):
        raise ValueError("dims is 2 or 3")
    d = len(result.features)
    if d < 2:
        raise ValueError("a biplot needs at least two components")
    if d < dims:
        warnings.warn("three components are needed for 3 dimensions; using 2", UserWarning, stacklevel=2)
        dims = 2
    score = [F.col("score")[i] for i in range(dims)]
    facts = result.scores.agg(
        *[f(s).alias(f"{n}{i}") for i, s in enumerate(score) for n, f in (("lo", F.min), ("hi", F.max))]
    ).first()
    spans = [(facts[f"hi{i}"] - facts[f"lo{i}"]) or 1.0 for i in range(dims)]
    points = result.scores.select(*keep, *[(s / F.lit(spans[i])).alias(f"x{i}") for i, s in enumerate(score)])
    names = top_features(result, min(n_arrows, d), dims)
    part = result.components[:dims, [result.features.index(f) for f in names]].T
    length = np.abs(part).sum(axis=0)
    reach = np.array([max(abs(facts[f"lo{i}"]), abs(facts[f"hi{i}"])) / spans[i] for i in range(dims)])
    arrows = part / np.where(length == 0, 1.0, length) * reach
    rows = [(f, *map(float, arrows[j])) for j, f in enumerate(names)]
    schema = "feature string, " + ", ".join(f"x{i} double" for i in range(dims))
    return points, result.scores.sparkSession.createDataFrame(rows, schema)
