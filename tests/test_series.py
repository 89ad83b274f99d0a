import numpy as np
import pandas as pd
import pytest

from tidemark.operators import autocorrelation as ac
from tidemark.operators import decomposition as dc
from tidemark.operators import ordering

M = 30


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    xs = {s: 10 + np.sin(np.arange(400 + s) / 9) * 3 + rng.normal(size=400 + s) for s in range(2)}
    pdf = pd.concat([pd.DataFrame({"s": s, "t": np.arange(len(x)), "v": x}) for s, x in xs.items()])
    df = ordering.ordinal(spark.createDataFrame(pdf.sample(frac=1, random_state=0)), ["t"], ["s"]).cache()
    return xs, df, df.filter("s = 1").drop("s").cache()


def direct_acf(x, lags):
    x = x - x.mean()
    return np.array([x[: len(x) - k] @ x[k:] for k in range(lags + 1)]) / (x @ x)


def windows(x):
    return np.lib.stride_tricks.sliding_window_view(x, M)


def test_acf(data):
    xs, df, one = data
    got = ac.acf(df, "v", 40, ["s"], size=64).toPandas().sort_values(["s", "lag"])
    for s, x in xs.items():
        assert np.allclose(got[got.s == s].acf, direct_acf(x, 40))
    got = ac.acf(one, "v", 600, size=1000).toPandas().sort_values("lag")
    assert len(got) == 401 and np.allclose(got.acf, direct_acf(xs[1], 400))


def test_pacf_solves_yule_walker(data):
    xs, _, one = data
    got = ac.pacf(one, "v", 15, size=50).toPandas().sort_values("lag").pacf.to_numpy()
    r = direct_acf(xs[1], 15)
    for k in (1, 2, 7, 15):
        system = np.array([[r[abs(i - j)] for j in range(k)] for i in range(k)])
        assert np.isclose(np.linalg.solve(system, r[1 : k + 1])[-1], got[k])
    assert got[0] == 1


def test_lag_correlation_and_durbin_watson(data):
    xs, df, _ = data
    lag = ac.lag_correlation(df, ["v"], 3, ["s"]).toPandas().set_index("s").autocorrelation
    dw = ac.durbin_watson(df, ["v"], ["s"]).toPandas().set_index("s").durbin_watson
    for s, x in xs.items():
        assert np.isclose(lag[s], np.corrcoef(x[3:], x[:-3])[0, 1])
        assert np.isclose(dw[s], (np.diff(x) ** 2).sum() / (x**2).sum())


def test_seasonality_check(spark, rng):
    x = pd.DataFrame(rng.normal(size=(300, 3)).cumsum(0), columns=list("abc"))
    got = ac.seasonality_check(spark.createDataFrame(x.assign(t=range(300))), list("abc"), ["t"]).toPandas().set_index("feature")
    for c in "abc":
        z = x.drop(columns=c).to_numpy()
        e = x[c].to_numpy() - z @ np.linalg.lstsq(z, x[c].to_numpy(), rcond=None)[0]
        assert np.isclose(got.durbin_watson[c], (np.diff(e) ** 2).sum() / (e**2).sum())
        assert got.seasonal[c]


def test_delay_windows(data):
    xs, _, one = data
    got = dc.delay_windows(one, "v", M, size=50).toPandas().sort_values("idx")
    assert np.allclose(np.stack(got["values"]), windows(xs[1]))


def test_ssa_components(data):
    xs, df, _ = data
    got = dc.ssa(df, "v", M, None, ["s"], size=64).toPandas()
    for s, x in xs.items():
        mine = got[got.s == s]
        assert np.allclose(mine.groupby("idx").value.sum().sort_index(), x)
        t = windows(x).T
        vectors = np.linalg.eigh(t @ t.T)[1][:, ::-1]
        for j in (0, 2, 5):
            part = np.outer(vectors[:, j], vectors[:, j]) @ t
            want = [np.mean([part[i, q - i] for i in range(M) if 0 <= q - i < t.shape[1]]) for q in range(len(x))]
            assert np.allclose(mine[mine.component == j].sort_values("idx").value, want, atol=1e-6)


def test_ssa_deseasonalise_and_buckets(data):
    _, _, one = data
    a = dc.ssa_deseasonalise(one, "v", M, 3, size=40).toPandas().sort_values("idx").ssa_v
    b = dc.ssa_deseasonalise(one, "v", M, 3, size=5000).toPandas().sort_values("idx").ssa_v
    assert len(a) == 401 and np.allclose(a, b)


def test_eeof(data):
    xs, _, one = data
    x = xs[1]
    d = windows(x)
    mean, (values, vectors) = d.mean(0), np.linalg.eigh(np.cov(d.T))
    values, vectors = values[::-1], vectors[:, ::-1][:, :4]
    spectrum = dc.eeof_spectrum(one, "v", M, 4, size=64).toPandas().sort_values("component")
    assert np.allclose(spectrum.eigenvalue, values[:4]) and np.allclose(spectrum.ratio, values[:4] / values.sum())
    rebuilt = (d - mean) @ vectors @ vectors.T + mean
    got = dc.eeof_reconstruction(one, "v", M, 4, size=64).toPandas().sort_values("idx")["values"].tolist()
    assert all(v is None for v in got[: M - 1]) and np.allclose(np.stack(got[M - 1 :]), rebuilt)
    scores = dc.eeof_scores(one, "v", M, 4, size=64).toPandas().sort_values("idx")
    assert np.allclose(np.abs(np.stack(scores.scores)), np.abs((d - mean) @ vectors), atol=1e-6)
    left = dc.eeof_deseasonalise(one, "v", M, 4, size=64).toPandas().sort_values("idx").eeof_v
    first = np.minimum(np.arange(len(x)), len(d) - 1)
    assert np.allclose(left, x - rebuilt[first, np.arange(len(x)) - first])


def test_window_checks(data, spark):
    _, _, one = data
    for bad, error in ((500, ValueError), (0, ValueError), (2.5, TypeError)):
        with pytest.raises(error):
            dc.eeof_spectrum(one, "v", bad)
    holes = spark.createDataFrame([(0, 1.0), (1, None)], "idx long, v double")
    with pytest.raises(ValueError):
        dc.ssa(holes, "v", 2)


def test_window_as_long_as_the_series(data):
    xs, _, one = data
    got = dc.ssa(one, "v", 401, None, together=True).toPandas().sort_values("idx")
    assert np.allclose(got.value, xs[1])


def test_seasonal_cycle(spark):
    days = pd.date_range("2000-01-01", "2004-12-31")
    pdf = pd.DataFrame({"string": days, "a": np.sin(days.dayofyear / 58) + days.year})
    got = dc.seasonal_cycle(spark.createDataFrame(pdf), "string", ["a"], "day", 30, 30).toPandas().sort_values("idx")
    assert len(got) == 366 and np.allclose(got["mean"], got.rebuilt)
    yearly = dc.seasonal_cycle(spark.createDataFrame(pdf), "string", ["a"], "year", 3, 9).toPandas().sort_values("idx")
    assert len(yearly) == 5 and np.allclose(yearly["mean"], yearly.rebuilt)


@pytest.mark.parametrize("n,own,lags", [(1, 1, 5), (40, 40, 39), (5_000, 5_000, 1_500), (5_000, 3_500, 1_500), (5_000, 3_500, 9_000), (3_000, 1, 1_500), (70_000, 65_536, 2)])
def test_shifted_products(rng, n, own, lags):
    x = rng.normal(size=n)
    want = [float(np.dot(x[: min(own, n - k)], x[k : k + own])) for k in range(min(lags, n - 1) + 1)]
    assert np.allclose(ac.shifted_products(x, own, lags), want, atol=1e-9)


def test_many_lags_across_buckets(spark, rng):
    x = rng.normal(size=4_000).cumsum() + 1e5
    df = spark.createDataFrame(pd.DataFrame({"idx": range(len(x)), "v": x}))
    got = ac.acf(df, "v", 1_500, size=1_600).toPandas().sort_values("lag")["acf"].to_numpy()
    m = x - x.mean()
    assert np.allclose(got, [m[: len(m) - k] @ m[k:] / (m @ m) for k in range(1_501)], atol=1e-9)
