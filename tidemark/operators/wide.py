"""Leading principal components of tables with thousands of features.

The d x d covariance is never built. A block of ``n_components + oversample``
directions is multiplied by the covariance in one scan per round (each task adds
its rows into d x l sums), made orthogonal on the driver, and turned to the
best directions inside it. The rounds end once every wanted direction is an
eigenvector up to the tolerance, and the residuals say how near they came: an
eigenvalue of the covariance lies within ``residual`` of each variance.

Only d x l numbers, bounded by the parameters, reach the driver. Task sums are
added in two levels, so no group holds those of all tasks. Vectors travel to
workers in batches bounded by bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.pca import _turned

#: Features whose sums travel in one row.
CHUNK = 512
#: Groups that task sums are added in before the last addition.
SLOTS = 64
BATCH_BYTES = 16 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


@dataclass
class WideResult:
    """``scores``: input rows plus array ``score``. ``residual`` bounds the error of each variance."""

    scores: DataFrame
    mean: np.ndarray
    components: np.ndarray
    explained_variance: np.ndarray
    explained_ratio: np.ndarray
    residual: np.ndarray
    rounds: int


@contextmanager
def _batches(spark: SparkSession, d: int) -> Iterator[None]:
    """Arrow batches of at most ``BATCH_BYTES`` for vectors of this length."""
    before = spark.conf.get(_BATCH_SETTING)
    most = max(1, BATCH_BYTES // (8 * d))
    if not 0 < int(before) <= most:
        spark.conf.set(_BATCH_SETTING, most)
    try:
        yield
    finally:
        spark.conf.set(_BATCH_SETTING, before)


def _added(keys: tuple[str, ...]):
    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v) for v in group.column("sums").to_pylist())
        columns = [pa.array([group.column(k)[0].as_py()], pa.int64()) for k in keys]
        return pa.table([*columns, pa.array([total.tobytes()], pa.binary())], names=[*keys, "sums"])

    return add


def _product(rows: DataFrame, mean: np.ndarray, basis: np.ndarray | None) -> tuple[np.ndarray, float]:
    """Sum over rows of x (x . basis) for x = v - mean, d x l, and of x . x; without a basis the sum of x, d x 1."""
    d = len(mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, square = np.zeros((d, 1 if basis is None else basis.shape[1])), 0.0
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d) - mean
            total += x.sum(axis=0)[:, None] if basis is None else x.T @ (x @ basis)
            square += float((x * x).sum())
        part = TaskContext.get().partitionId() % SLOTS
        chunks = [(i // CHUNK, total[i : i + CHUNK].tobytes()) for i in range(0, d, CHUNK)] + [(-1, np.array([square]).tobytes())]
        columns = [pa.array([c[0] for c in chunks], pa.int64()), pa.array([part] * len(chunks), pa.int64()), pa.array([c[1] for c in chunks], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["chunk", "slot", "sums"])

    sums = rows.mapInArrow(run, "chunk long, slot long, sums binary")
    sums = sums.groupBy("chunk", "slot").applyInArrow(_added(("chunk", "slot")), "chunk long, slot long, sums binary")
    sums = sums.groupBy("chunk").applyInArrow(_added(("chunk",)), "chunk long, sums binary")
    found = {r["chunk"]: np.frombuffer(r["sums"]) for r in sums.collect()}
    square = float(found.pop(-1)[0])
    return np.concatenate([found[c] for c in sorted(found)]).reshape(d, -1), square


def pca_wide(
    df: DataFrame,
    column: str,
    n_components: int = 8,
    oversample: int = 8,
    rounds: int = 50,
    tolerance: float = 1e-9,
    seed: int = 7,
) -> WideResult:
    """The ``n_components`` leading components of an array column, centred but not scaled.

    Rounds end when all residuals are at most ``tolerance`` times the largest
    variance, or after ``rounds`` of them; ``residual`` tells which. Rows whose
    vector is null get a null score. Vectors with missing components or of
    several lengths raise.
    """
    if n_components < 1 or oversample < 0 or rounds < 1:
        raise ValueError("n_components and rounds are 1 at least, oversample is 0 at least")
    spark = df.sparkSession
    rows = df.filter(F.col(column).isNotNull()).select(F.col(column).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x))
    facts = rows.agg(
        F.count(F.lit(1)).alias("n"), F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("d"), F.bool_or(bad).alias("bad")
    ).first()
    n, d = facts["n"], facts["d"]
    if not n or not d:
        raise ValueError("no vectors to decompose")
    if facts["least"] != d:
        raise ValueError("vectors have several lengths")
    if facts["bad"]:
        raise ValueError("features have missing values; fill or drop them first")
    k, l = min(n_components, d), min(n_components + oversample, d)
    with _batches(spark, d):
        mean = _product(rows, np.zeros(d), None)[0][:, 0] / n
        # What rounding left of the mean, so that large means do not cost digits.
        mean = mean + _product(rows, mean, None)[0][:, 0] / n
        basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, l)))[0]
        for done in range(1, rounds + 1):
            moved, square = _product(rows, mean, basis)
            moved = moved / max(n - 1, 1)
            small = basis.T @ moved
            values, turn = np.linalg.eigh((small + small.T) / 2)
            order = np.argsort(values, kind="stable")[::-1][:k]
            values, turn = values[order], turn[:, order]
            components = (basis @ turn).T
            residual = np.linalg.norm(moved @ turn - components.T * values, axis=0)
            if residual.max() <= tolerance * max(values[0], 0.0):
                break
            basis = np.linalg.qr(moved)[0]
    components = components * _turned(components)[:, None]
    variance = np.maximum(values, 0.0)
    whole = square / max(n - 1, 1)
    score = F.when(F.col(column).isNotNull(), _scores(mean, components)(F.col(column).cast("array<double>")))
    return WideResult(df.withColumn("score", score), mean, components, variance, variance / (whole or 1.0), residual, done)


def _scores(mean: np.ndarray, components: np.ndarray):
    @F.pandas_udf("array<double>")
    def project(vectors: pd.Series) -> pd.Series:
        # One row after the other: a batch may hold more vectors than should be copied at once.
        return pd.Series([None if v is None else components @ (np.asarray(v, float) - mean) for v in vectors], dtype=object)

    return project
