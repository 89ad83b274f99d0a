"""Leading components of wide tables against a full eigen-decomposition."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import wide


def decaying(seed=3, n=240, d=90, offset=0.0):
    random = np.random.default_rng(seed)
    turn = np.linalg.qr(random.normal(size=(d, d)))[0]
    return random.normal(size=(n, d)) * 0.7 ** np.arange(d) @ turn + offset


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(3)


@pytest.mark.parametrize("chunk,slots", [(512, 64), (7, 2)])
def test_leading_components(spark, monkeypatch, chunk, slots):
    monkeypatch.setattr(wide, "CHUNK", chunk)
    monkeypatch.setattr(wide, "SLOTS", slots)
    x = decaying(offset=1e4)
    got = wide.pca_wide(frame(spark, x), "v", 5)
    values, vectors = np.linalg.eigh(np.cov(x.T))
    values, vectors = values[::-1], vectors[:, ::-1]
    assert np.allclose(got.explained_variance, values[:5], rtol=1e-8)
    assert np.allclose(np.abs(np.sum(got.components * vectors[:, :5].T, axis=1)), 1, atol=1e-8)
    assert np.allclose(got.explained_ratio, values[:5] / values.sum(), rtol=1e-7)
    assert (got.components[np.arange(5), np.abs(got.components).argmax(axis=1)] > 0).all()
    rows = got.scores.orderBy("id").toPandas()
    assert np.allclose(np.stack(rows.score), (x - x.mean(axis=0)) @ got.components.T, atol=1e-6)


def test_residuals_bound_the_error_of_few_rounds(spark):
    x = decaying(seed=8)
    values = np.linalg.eigvalsh(np.cov(x.T))
    got = wide.pca_wide(frame(spark, x), "v", 6, oversample=1, rounds=2, tolerance=0.0)
    assert got.rounds == 2 and got.residual.max() > 1e-6
    for variance, bound in zip(got.explained_variance, got.residual):
        assert np.abs(values - variance).min() <= bound + 1e-12


def test_odd_tables(spark):
    x = decaying(n=6, d=4)
    df = frame(spark, x).unionByName(spark.createDataFrame([(9, None)], "id long, v array<double>"))
    got = wide.pca_wide(df, "v", 10)
    assert len(got.explained_variance) == 4 and np.allclose(got.explained_ratio.sum(), 1)
    assert {r.id: r.score is None for r in got.scores.collect()} == {**{i: False for i in range(6)}, 9: True}
    same = wide.pca_wide(frame(spark, np.ones((5, 3))), "v", 2)
    assert np.allclose(same.explained_variance, 0) and np.allclose(same.explained_ratio, 0)
    for wrong in (df.limit(0), df.filter("id = 9"), df.withColumn("v", F.slice("v", 1, F.col("id").cast("int") % 2 + 1)), df.withColumn("v", F.concat("v", F.array(F.lit(None).cast("double"))))):
        with pytest.raises(ValueError):
            wide.pca_wide(wrong, "v")
    with pytest.raises(ValueError):
        wide.pca_wide(df, "v", 0)
