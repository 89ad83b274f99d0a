import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import pca

F5 = [f"feature_{i}" for i in range(5)]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(42)
    x = rng.uniform(size=(100, 5)) @ rng.normal(size=(5, 5))
    return x, spark.createDataFrame(pd.DataFrame(x, columns=F5)).cache()


@pytest.mark.parametrize("scaler", ["standard", "minmax", "robust", None])
def test_pca_matches_an_eigendecomposition(data, scaler):
    x, df = data
    got = pca.pca(df, scaler=scaler)
    q = np.quantile(x, [0.25, 0.5, 0.75], axis=0)
    z = {"standard": (x - x.mean(0)) / x.std(0), "minmax": (x - x.min(0)) / (x.max(0) - x.min(0)),
         "robust": (x - q[1]) / (q[2] - q[0]), None: x}[scaler]
    values = np.linalg.eigvalsh(np.cov(z.T))[::-1]
    assert np.allclose(got.explained_variance, values) and np.allclose(got.explained_ratio.sum(), 1)
    scores = np.stack(got.scores.toPandas().score)
    assert np.allclose(np.cov(scores.T), np.diag(values), atol=1e-9) and np.allclose(scores.mean(0), 0, atol=1e-9)
    lead = np.abs(got.components).argmax(axis=1)
    assert (got.components[np.arange(5), lead] > 0).all()


def test_loadings_table(data, tmp_path):
    _, df = data
    got = pca.pca(df.withColumn("label", F.lit("x")), save_csv=str(tmp_path / "out"))
    table = got.loadings(4).toPandas()
    assert table.row_name.tolist() == [*F5, "Expl_var", "Expl_var_ratio"] and table.shape == (7, 5)
    assert df.sparkSession.read.option("header", True).csv(str(tmp_path / "out")).count() == 7
    with pytest.warns(UserWarning):
        assert got.loadings(9).columns[-1] == "PC4"
    with pytest.raises(TypeError):
        pca.pca(df.withColumn("text", F.lit("x")))


def test_select_features(data):
    _, df = data
    assert pca.select_features(df, features=["a", "b"]) == ["a", "b"]
    assert pca.select_features(df, 5) == F5
    chosen = pca.select_features(df, 2)
    lead = [F5[i] for i in pca.pca(df).components.argmax(axis=1)]
    assert chosen == list(dict.fromkeys(lead))[:2]
    for bad in (None, 0, 2.5, 9):
        with pytest.raises(ValueError):
            pca.select_features(df, bad)


def test_biplot(data):
    _, df = data
    found = pca.pca(df)
    points, arrows = pca.biplot(found, dims=3, n_arrows=9)
    scores = np.stack(found.scores.toPandas().score)[:, :3]
    spans = scores.max(0) - scores.min(0)
    assert np.allclose(np.ptp(points.toPandas()[["x0", "x1", "x2"]].to_numpy(), axis=0), 1)
    arrows = arrows.toPandas().set_index("feature")
    part = found.components[:3].T
    want = part / np.abs(part).sum(0) * np.abs(scores).max(0) / spans
    assert np.allclose(arrows.loc[F5].to_numpy(), want)
    two = pca.pca(df.select(F5[:2]))
    with pytest.warns(UserWarning):
        assert pca.biplot(two, dims=3)[1].columns == ["feature", "x0", "x1"]
    with pytest.raises(ValueError):
        pca.biplot(found, dims=4)


def test_array_column(spark, data):
    x, _ = data
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, e array<double>")
    got = pca.pca_array(df, "e")
    assert np.allclose(got.explained_variance, np.linalg.eigvalsh(np.cov(x.T))[::-1])
