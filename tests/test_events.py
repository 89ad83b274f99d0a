import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import events


def runs(flags, days):
    out, i = [], 0
    while i < len(flags):
        j = i
        while j < len(flags) and flags[j]:
            j += 1
        if j - i >= max(days, 1):
            out.append((i, j))
        i = max(j, i + 1)
    return out


def brute(part, days, mark, spacing=30):
    labels, times = ["undisturbed"] * len(part), list(part.string)
    found = [(times[a], kind, b, a) for kind, flags in (("displaced", part.latcent.to_numpy() <= 66), ("split", part.ar.to_numpy() >= 2.4))
             for a, b in runs(flags, days)]
    last = None
    for start, kind, b, a in sorted(found):
        if last is None or start - last >= dt.timedelta(days=spacing):
            at = {"all": range(a, b), "first": [a], "last": [b - 1]}[mark]
            for i in at:
                labels[i] = kind
            last = times[b - 1]
    return labels


@pytest.fixture(scope="module")
def two_series(spark):
    random.seed(3)
    rows = []
    for s in range(2):
        state = 0
        for i in range(900):
            if random.random() < 0.12:
                state = random.choice([0, 0, 1, 2, 3])
            day = dt.datetime(2000, 1, 1) + dt.timedelta(days=i + (i // 150) * 245)
            rows.append((s, day, 2.5 if state & 1 else 2.0, 60.0 if state & 2 else 70.0))
    pdf = pd.DataFrame(rows, columns=["s", "string", "ar", "latcent"])
    df = spark.createDataFrame(pdf.sample(frac=1, random_state=1)).withColumn("string", F.col("string").cast("timestamp_ntz"))
    return pdf, df.cache()


@pytest.mark.parametrize("mark", ["all", "first", "last"])
def test_labels_match_a_sequential_scan(two_series, mark):
    pdf, df = two_series
    got = events.label_events(df, mark=mark, days=4, series=["s"]).toPandas().sort_values(["s", "idx"])
    assert got.regime.tolist() == sum((brute(p, 4, mark) for _, p in pdf.groupby("s")), [])


@pytest.mark.parametrize("fold", [1, 6])
def test_long_series_by_segments_and_pointer_doubling(two_series, monkeypatch, fold):
    pdf, df = two_series
    monkeypatch.setattr(events, "FOLD_EVENTS", fold)
    got = events.label_events(df, days=2, series=["s"]).toPandas().sort_values(["s", "idx"])
    assert got.regime.tolist() == sum((brute(p, 2, "all") for _, p in pdf.groupby("s")), [])


def test_small_buckets_split_runs(two_series, monkeypatch):
    pdf, df = two_series
    monkeypatch.setattr(events, "BUCKET_ROWS", 3)
    one = df.filter("s = 0").drop("s")
    got = events.label_events(one, days=4).toPandas().sort_values("idx")
    assert got.regime.tolist() == brute(pdf[pdf.s == 0], 4, "all")


def series(spark, flags, gaps=()):
    day, rows = dt.datetime(2000, 1, 1), []
    for i, f in enumerate(flags):
        day += dt.timedelta(days=1 + (20 if i in gaps else 0))
        rows.append((day, f))
    return spark.createDataFrame(rows, "t timestamp_ntz, f boolean")


def test_run_lengths_and_ends(spark):
    flags = [True] * 6 + [False] + [True] * 7 + [None] + [True] * 7
    got = events.flag_runs(series(spark, flags), "f", "t").toPandas().sort_values("start")
    assert got[["start", "end"]].to_numpy().tolist() == [[7, 14], [15, 22]]


def test_calendar_gap(spark):
    df = series(spark, [True] * 10, gaps={5})
    assert events.flag_runs(df, "f", "t").toPandas()[["start", "end"]].to_numpy().tolist() == [[0, 10]]
    got = events.flag_runs(df, "f", "t", 5, by_calendar=True).toPandas().sort_values("start")
    assert got[["start", "end"]].to_numpy().tolist() == [[0, 5], [5, 10]]


@pytest.mark.parametrize("apart,both", [(29, False), (30, True)])
def test_spacing_counts_whole_days(spark, apart, both):
    times = [dt.datetime(2000, 1, 1) + dt.timedelta(days=i) for i in range(7 + apart - 1 + 7)]
    rows = [(t, 2.5 if i < 7 or i >= 7 + apart - 1 else 1.0, 80.0) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "string timestamp_ntz, ar double, latcent double")
    got = events.label_events(df).toPandas().sort_values("idx").regime
    assert (got == "split").sum() == (14 if both else 7)


def test_same_start_goes_displaced(spark):
    rows = [(dt.datetime(2000, 1, 1) + dt.timedelta(days=i), 3.0, 50.0) for i in range(8)]
    df = spark.createDataFrame(rows, "string timestamp_ntz, ar double, latcent double")
    assert set(events.label_events(df).toPandas().regime) == {"displaced"}
    with pytest.raises(AttributeError):
        events.label_events(df, mark="some")


def test_no_events(spark):
    df = spark.createDataFrame([(dt.datetime(2000, 1, 1), 1.0, 80.0)], "string timestamp_ntz, ar double, latcent double")
    assert events.label_events(df).toPandas().regime.tolist() == ["undisturbed"]


def test_one_run_over_the_whole_series(spark):
    df = spark.range(5000).select(
        (F.lit("2000-01-01").cast("timestamp_ntz") + F.make_dt_interval(days=F.col("id").cast("int"))).alias("string"),
        F.lit(3.0).alias("ar"), F.lit(80.0).alias("latcent"),
    )
    got = events.label_events(df).toPandas()
    assert (got.regime == "split").all() and np.array_equal(np.sort(got.idx), np.arange(5000))
