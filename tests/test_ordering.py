import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import ordering


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("t"), (F.col("id") % 3).alias("s")).cache()


def test_ordinal_counts_in_order(numbers):
    got = ordering.ordinal(numbers, ["t"]).toPandas().sort_values("t")
    assert got.idx.tolist() == list(range(1000))


def test_ordinal_per_series_with_one_dominant_series(spark):
    # two thirds of all rows in one series, spread over all partitions
    df = spark.range(3000).select(F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id") % 5 + 1).alias("s"), F.col("id").alias("t"))
    got = ordering.ordinal(df, ["t"], ["s"]).toPandas().sort_values(["s", "t"])
    for _, part in got.groupby("s"):
        assert part.idx.tolist() == list(range(len(part)))


def test_order_does_not_depend_on_partitions(numbers):
    first = ordering.ordinal(numbers.repartition(1), ["t"]).toPandas().sort_values("t").idx.tolist()
    assert first == ordering.ordinal(numbers.repartition(13), ["t"]).toPandas().sort_values("t").idx.tolist()


def test_running_max(numbers):
    laid = ordering.lay_out(numbers, ["t"])
    got = ordering.running(laid, ["t"], {"m": ((F.col("t") * 37) % 101, "max")}).toPandas().sort_values("t")
    assert got.m.tolist() == np.maximum.accumulate(got.t.to_numpy() * 37 % 101).tolist()


@pytest.mark.parametrize("by", [[], ["s"]])
@pytest.mark.parametrize("small", [10**6, 0])
def test_quantiles(numbers, by, small, monkeypatch):
    monkeypatch.setattr(ordering, "SMALL_GROUP", small)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    data = numbers.withColumn("z", F.when(F.col("t") > 600, 600).otherwise(F.col("t")) * 1.5)
    got = ordering.quantiles(data, ["t", "z"], probs, by).toPandas()
    pdf = data.toPandas()
    for _, row in got.iterrows():
        part = pdf[pdf.s == row.s] if by else pdf
        assert np.allclose(row.q, np.quantile(part[row.feature], probs))
    assert len(got) == (6 if by else 2)


def test_with_lag_crosses_buckets(numbers):
    got = ordering.with_lag(ordering.ordinal(numbers, ["t"]), {"p": ("t", 2), "n": ("t", -1)}, size=100)
    got = got.toPandas().sort_values("idx")
    assert len(got) == 1000
    assert got.p.tolist()[2:] == got.t.tolist()[:-2] and got.p.isna().sum() == 2
    assert got.n.tolist()[:-1] == got.t.tolist()[1:]


@pytest.mark.parametrize("groups", [1, 4, 7, 1000, 5000])
def test_time_groups(numbers, groups):
    got = ordering.time_groups(ordering.ordinal(numbers, ["t"]), groups).toPandas().sort_values("idx")
    want = np.concatenate([[i + 1] * len(p) for i, p in enumerate(np.array_split(np.arange(1000), min(groups, 1000)))])
    assert got.part.tolist() == want.tolist()
    assert np.allclose(got.position, np.linspace(0, 1, 1000))


def test_slice_rows(numbers):
    ordered = ordering.ordinal(numbers, ["t"], ["s"])
    got = ordering.slice_rows(ordered, 2, -5, ["s"]).toPandas()
    whole = numbers.toPandas().groupby("s").size()
    assert got.groupby("s").size().tolist() == (whole - 7).tolist()
    assert ordering.slice_rows(ordered, 0, 10).count() == 30


def test_bucket_must_hold_the_reach():
    with pytest.raises(ValueError):
        ordering.bucket_rows(500, 100)


def test_attach_with_many_series(spark, monkeypatch):
    monkeypatch.setattr(ordering, "BROADCAST_ROWS", 1)
    df = spark.createDataFrame(pd.DataFrame({"s": [1, 1, 2], "v": [1.0, 3.0, 5.0]}))
    got = ordering.attach(df, df.groupBy("s").agg(F.avg("v").alias("m")), ["s"]).toPandas()
    assert sorted(got.m) == [2.0, 2.0, 5.0]


@pytest.mark.parametrize("weight", [None, "w"])
def test_join_skewed_keeps_all_rows(spark, monkeypatch, weight):
    monkeypatch.setattr(ordering, "HOT_ROWS", 50)
    df = spark.range(300).select(F.when(F.col("id") < 100, 0).otherwise(F.col("id") % 7 + 1).alias("k"), "id")
    table = df.groupBy("k").agg(F.count(F.lit(1)).alias("w")).withColumn("v", F.col("k") * 10)
    got = ordering.join_skewed(df, table, ["k"], weight).toPandas()
    assert len(got) == 300 and (got.v == got.k * 10).all() and got.columns.tolist() == ["k", "id", "w", "v"]
