import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.operators import aggregate, scaling, scores


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame([(1, 10), (2, 20), (3, 30), (4, 40)], ["A", "B"])


@pytest.fixture(scope="module")
def mixed(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame(rng.normal(size=(200, 3)), columns=list("abc"))
    pdf["c"] = pdf["c"].where(rng.random(200) > 0.1)
    pdf["label"] = np.where(pdf.a > 0.3, "A", "B")
    return pdf, spark.createDataFrame(pdf).withColumn("c", F.when(~F.isnan("c"), F.col("c"))).cache()


@pytest.mark.parametrize("func", ["mean", "median", "sum", "min", "max", "std"])
def test_named_aggregates(small, func):
    want = getattr(small.toPandas(), func)()
    assert np.allclose(list(aggregate.aggregate(small, func).first()), want)


def test_function_and_bad_aggregates(small):
    assert list(aggregate.aggregate(small, lambda c: F.max(c) - F.min(c)).first()) == [3, 30]
    for bad in ("nothing", None, 3):
        with pytest.raises(ValueError):
            aggregate.aggregate(small, bad)


def test_grouped_median(mixed):
    pdf, df = mixed
    got = aggregate.aggregate(df, "median", ["label"]).toPandas().set_index("label")
    assert np.allclose(got.loc[["A", "B"], list("abc")], pdf.groupby("label").median().loc[["A", "B"]])


def test_correlation(mixed, spark):
    pdf, df = mixed
    got = aggregate.correlation(df.withColumn("k", F.lit(1.0))).toPandas().set_index("feature")
    want = pdf[list("abc")].corr()
    assert np.allclose(got.loc[list("abc"), list("abc")].to_numpy(float), want)
    assert got["k"].isna().all()
    with pytest.warns(UserWarning):
        assert aggregate.correlation(df.limit(0)) is None


def test_correlation_of_large_values(mixed):
    pdf, df = mixed
    moved = df.select(*[(F.col(c) + 1e9).alias(c) for c in "abc"]).repartition(5)
    got = aggregate.correlation(moved).toPandas().set_index("feature")
    assert np.allclose(got.to_numpy(float), (pdf[list("abc")] + 1e9).corr(), atol=1e-6)


@pytest.mark.parametrize("func", ["skew", "kurt", "sem", "prod", "size", "mode"])
def test_frame_method_names(spark, func):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 60), "v": rng.integers(1, 5, 60).astype(float), "w": rng.normal(size=60)})
    pdf.loc[rng.random(60) < 0.2, "w"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("w", F.when(~F.isnan("w"), F.col("w"))).repartition(3)
    got = aggregate.aggregate(df, func, ["g"], ["v", "w"]).toPandas().set_index("g").sort_index().astype(float)
    for g, group in pdf.groupby("g"):
        for c in "vw":
            want = {"mode": lambda x: x.mode().iloc[0], "size": len}.get(func, lambda x: getattr(x, func)())(group[c])
            assert np.isclose(got.loc[g, c], want)


def test_groups_without_values_stay(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 9.0), ("b", 1, None), (None, 3, 2.0), (None, 4, None)], "g string, t int, v double")
    want = {"median": {"a": 7.0, "b": None, None: 2.0}, "mode": {"a": 5.0, "b": None, None: 2.0}, "first": {"a": 5.0, "b": None, None: 2.0},
            "last": {"a": 9.0, "b": None, None: 2.0}, "skew": {"a": None, "b": None, None: None}}
    for func, values in want.items():
        got = aggregate.aggregate(df, func, ["g"], ["v"], ["t"] if func in ("first", "last") else ())
        assert {r.g: r.v for r in got.collect()} == values
    with pytest.raises(ValueError):
        aggregate.aggregate(df, "first", ["g"], ["v"])


def test_density_shuffles_no_values(mixed):
    _, df = mixed
    plan = aggregate.class_density(df, "a", "label", 20)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and not any("v0" in line.split("Exchange", 1)[1].split("]")[0] for line in exchanges)


def test_class_tables(mixed):
    pdf, df = mixed
    prof = aggregate.class_profile(df, "label").toPandas().set_index(["label", "feature"])
    want = pdf.groupby("label")[list("abc")].agg(["min", "max", "mean"])
    for label in "AB":
        for f in "abc":
            assert np.allclose(prof.loc[(label, f)], want.loc[label, f])
    assert {r.label: r["count"] for r in aggregate.class_sizes(df, "label").collect()} == pdf.label.value_counts().to_dict()


def test_crosstab_matches_pandas(mixed):
    pdf, df = mixed
    pdf = pdf.assign(g=np.where(pdf.b > 0, "p", "q"))
    got = aggregate.crosstab(df.withColumn("g", F.when(F.col("b") > 0, "p").otherwise("q")), "label", "g", "c").toPandas()
    want = pd.pivot_table(pdf[["label", "g", "c"]], values="c", index="label", columns="g", aggfunc="count", margins=True).fillna(0)
    assert len(got) == want.size
    for r in got.itertuples():
        assert r.n == want.loc[r.label, r.g] and np.isclose(r.percent, want.loc[r.label, r.g] / len(pdf) * 100)


def test_histogram_edges_match_numpy(mixed):
    pdf, df = mixed
    got = aggregate.class_histogram(df, "a", "label").toPandas()
    edges = np.histogram_bin_edges(pdf.a, "auto")
    lo, hi, bins = aggregate.bin_edges(df, "a")
    assert bins == len(edges) - 1 and np.isclose(lo, edges[0]) and np.isclose(hi, edges[-1])
    for label, part in pdf.groupby("label"):
        want, _ = np.histogram(part.a, edges)
        mine = got[got.label == label].set_index("bin").n.reindex(range(bins), fill_value=0)
        assert mine.tolist() == want.tolist()


def test_density(mixed):
    pdf, df = mixed
    got = aggregate.class_density(df, "a", "label", 50).toPandas()
    grid = np.linspace(pdf.a.min(), pdf.a.max(), 50)
    for label, part in pdf.groupby("label"):
        x = part.a.to_numpy()
        h = x.std(ddof=1) * len(x) ** -0.2
        want = np.exp(-0.5 * ((grid[:, None] - x) / h) ** 2).sum(1) / (len(x) * h * np.sqrt(2 * np.pi))
        assert np.allclose(got[got.label == label].sort_values("point").density, want)


def test_radar(mixed):
    pdf, df = mixed
    for scaler in ("standard", "minmax", "robust", None):
        got = aggregate.class_radar(df.select("a", "b", "label"), "label", ["a", "b"], scaler=scaler).toPandas()
        want = pdf.groupby("label")[["a", "b"]].mean()
        for r in got.itertuples():
            col = want[r.feature]
            assert np.isclose(r.value, col[r.label])
            assert r.is_min == (col.idxmin() == r.label) and r.is_max == (col.idxmax() == r.label)
            if scaler == "standard":
                assert np.isclose(r.scaled, (r.value - col.mean()) / col.std(ddof=0))
    with pytest.raises(KeyError):
        aggregate.class_radar(df, "nope")
    with pytest.raises(TypeError):
        aggregate.class_distributions(df.withColumn("text", F.lit("x")), "label")


def test_small_helpers(small):
    assert aggregate.weighted_mean(small, "A", "B").first()[0] == 3.0
    assert {r.feature: r.A for r in aggregate.arg_max(small, "A", ["B"]).collect()} == {"B": 4}
    assert tuple(aggregate.any_flag(small, ["A"]).first()) == (True,)


@pytest.mark.parametrize("scaler", ["standard", "minmax", "robust"])
def test_scalers(mixed, scaler):
    pdf, df = mixed
    got = scaling.scale(df.withColumn("k", F.lit(2.5)), ["a", "c", "k"], scaler).toPandas()
    for c in "ac":
        x = pdf[c]
        want = {"standard": (x - x.mean()) / x.std(ddof=0), "minmax": (x - x.min()) / (x.max() - x.min()),
                "robust": (x - x.median()) / (x.quantile(0.75) - x.quantile(0.25))}[scaler]
        assert np.allclose(np.sort(got["scaled_" + c].dropna()), np.sort(want.dropna()))
    assert (got.scaled_k == 0).all()


def test_scaler_choices(small):
    with pytest.raises(ValueError):
        scaling.scale(small, ["A"], "other")
    assert scaling.scale(small, ["A"], None).first()["scaled_A"] == 1.0
    twice = scaling.scale(small, ["A"], lambda d, cols: d.withColumns({c: F.col(c) * 2 for c in cols}), prefix="")
    assert [r.A for r in twice.collect()] == [2, 4, 6, 8]


def test_agreement(spark):
    rows = [("S", "S", 1), ("S", "D", 1), ("D", "S", 1), ("D", "D", 1), (None, "S", 1), (None, None, 1)]
    df = spark.createDataFrame(rows, "y string, t string, string int")
    got = scores.agreement(df, "t", ["y"]).first()
    assert (got.tp, got.fp, got.fn, got.tn) == (1, 1, 2, 2)
    assert got.precision == 0.5 and np.isclose(got.recall, 1 / 3) and got.accuracy == 0.5
    with pytest.raises(KeyError):
        scores.agreement(df, "t", ["nope"])
    with pytest.raises(PySparkException, match="does not occur"):
        scores.agreement(df, "t", ["y"], predicted_value="X").collect()
    with pytest.raises(PySparkException, match="does not occur"):
        scores.agreement(df, "t", ["y"], true_value="X").collect()


def test_agreement_of_a_class_that_was_never_predicted(spark):
    """With many orders a day no daily mean is below a limit; the counts and the other ratios are still there."""
    rows = [("D", "S", "S", 1), ("D", "D", "S", 1), (None, "S", "D", 1)]
    df = spark.createDataFrame(rows, "y string, t string, z string, string int")
    never, wrong = scores.agreement(df, "t", ["y", "z"], absent="count").collect()
    assert (never.prediction, never.tp, never.fp, never.fn, never.tn) == ("y", 0, 0, 2, 1)
    assert never.precision is None and never.recall == 0 and never.f1 == 0 and np.isclose(never.accuracy, 1 / 3)
    assert (wrong.tp, wrong.fp, wrong.fn, wrong.tn) == (1, 1, 1, 0) and wrong.f1 == 0.5
    missed = df.filter("z = 'D' OR t = 'D'")
    assert scores.agreement(missed, "t", ["z"]).first().f1 == 0
    none = scores.agreement(df, "t", ["z"], true_value="X", absent="count").first()
    assert (none.tp, none.fn, none.recall) == (0, 0, None)
    with pytest.raises(ValueError):
        scores.agreement(df, "t", ["y"], absent="drop")


def test_agreement_scores_when_no_day_is_below_the_limit(spark, tmp_path):
    """The query gives the counts of its SQL although no daily mean price is under the limit."""
    from check_oracles import connect, same

    from tidemark.plans.catalog import QUERIES, SQL

    lines = "l_shipdate timestamp_ntz, l_extendedprice double, l_quantity double, l_discount double, l_returnflag string"
    days = pd.to_datetime(["2020-01-01", "2020-01-02"])
    items = pd.DataFrame([(d, p, 3.0, 0.1, f) for d, f in zip(days, "RN") for p in (1.0, 9.0)], columns=lines.replace(",", "").split()[::2])
    orders = pd.DataFrame([(d, 900000.0, "1-URGENT") for d in days], columns=["o_orderdate", "o_totalprice", "o_orderpriority"])
    spark.createDataFrame(items, lines).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(orders, "o_orderdate timestamp_ntz, o_totalprice double, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    got = QUERIES["agreement_scores"](spark, str(tmp_path)).toPandas()
    con = connect("/nonexistent")
    for name in ("lineitem", "orders"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    assert same(got, con.execute(SQL["agreement_scores"]).df()) is None
    assert got.set_index("prediction").loc["y_u", ["tp", "fp", "fn", "tn"]].tolist() == [0, 0, 1, 1]
