import datetime as dt

import numpy as np
import pandas as pd

from tidemark.operators import scores, selection
from tidemark.plans import winter


def feeds(spark):
    rng = np.random.default_rng(2)
    days = pd.date_range("1990-11-01", "1997-04-30")
    n = len(days)
    cls = rng.choice(3, n, p=[0.7, 0.1, 0.2])
    daily = pd.DataFrame({
        "string": days, "area": rng.normal(25e6, 1e6, n), "ar": 1.5 + (cls == 1) * 2 + rng.normal(size=n) * 0.1,
        "latcent": 80 - (cls == 2) * 15 + rng.normal(size=n), "form": np.where(cls == 1, "S", "D"), "n": 1,
    })
    msw = pd.DataFrame({"string": days, "u": 20 + 10 * np.sin(np.arange(n) / 19) + rng.normal(size=n), "n": 2})
    ntz = lambda p: spark.createDataFrame(p).selectExpr("cast(string as timestamp_ntz) as string", *[c for c in p if c != "string"])
    return ntz(daily), ntz(msw)


def test_regimes_are_found_again(spark):
    daily, msw = feeds(spark)
    rows, checks, k = winter.regime_analysis(daily, msw, ssa_window=60, eeof_window=100)
    assert k == 3 and checks.count() == 4
    pdf = rows.toPandas()
    assert set(pdf.string.dt.month) == {12, 1, 2, 3} and pdf.eeof_scaled_u.std() < pdf.scaled_u.std()
    split = pdf[pdf.form == 1].y.mode()[0]
    got = scores.agreement(rows, "form", ["y"], "string", int(split), 1).first()
    assert got.f1 > 0.95


def test_winter_events(spark):
    rows = [(dt.datetime(2000, 1, 1) + dt.timedelta(days=i), 1.0 + i % 3, 3.0 if i < 9 else 1.0, 80.0, "S" if i < 9 else "D") for i in range(60)]
    daily = spark.createDataFrame(rows, "string timestamp_ntz, area double, ar double, latcent double, form string")
    msw = daily.select("string", "area")
    got = winter.event_scores(winter.winter_events(daily, msw)).first()
    assert (got.tp, got.fp, got.fn, got.tn) == (9, 0, 0, 51)
    assert selection.LINKAGES[0] == "complete"
