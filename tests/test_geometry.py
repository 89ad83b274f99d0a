import math

import numpy as np
import pytest
from pyspark.errors import PySparkException

from tidemark.operators import geometry as geo

SCHEMA = "area double, ar double, theta double, loncent double, latcent double"


def one(spark, *row):
    return spark.createDataFrame([row], SCHEMA)


def test_ellipse_is_centred_open_and_has_its_area(spark):
    got = geo.ellipses(one(spark, 1e6, 2.0, 30.0, 0.0, 85.0), [], 360, degrees=True).toPandas().sort_values("vertex")
    x, y = got.x.to_numpy(), got.y.to_numpy()
    assert abs(x.mean()) < 1e-3 and len(got) == 360 and not np.allclose([x[0], y[0]], [x[-1], y[-1]])
    polygon = abs(np.dot(x, np.roll(y, 1)) - np.dot(y, np.roll(x, 1))) / 2
    assert np.isclose(polygon, 1e12, rtol=1e-3)
    r = np.hypot(x - x.mean(), y - y.mean())
    assert np.isclose(r.max() / r.min(), 2, rtol=1e-3)
    turn = math.degrees(math.atan2(*(np.array([y - y.mean(), x - x.mean()])[:, r.argmax()]))) % 180
    assert np.isclose(turn, 120, atol=1)


def test_true_scale_at_sixty(spark):
    # at the latitude of true scale the map radius is that of the parallel
    got = geo.ellipses(one(spark, 1.0, 1.0, 0.0, 90.0, 60.0), [], 2).toPandas()
    e2 = geo.FLATTENING * (2 - geo.FLATTENING)
    radius = geo.EARTH_RADIUS * math.cos(math.pi / 3) / math.sqrt(1 - e2 * math.sin(math.pi / 3) ** 2)
    assert np.isclose(got.x.mean(), radius) and abs(got.y.mean()) < 1e-6


@pytest.mark.parametrize("row", [(0.0, 2.0, 0.0, 0.0, 85.0), (1e6, -1.0, 0.0, 0.0, 85.0), (1e6, 2.0, 0.0, 181.0, 85.0),
                                 (1e6, 2.0, 0.0, 0.0, 91.0), (None, 2.0, 0.0, 0.0, 85.0)])
def test_faulty_rows(spark, row):
    df = one(spark, *row)
    with pytest.raises(PySparkException):
        geo.ellipses(df, []).collect()
    assert geo.ellipses(df, [], on_fault="skip").count() == 0
    assert geo.ellipse_rejects(df).count() == 1
    with pytest.raises(ValueError):
        geo.ellipses(df, [], 0)


def test_split_rows_add_their_daughters(spark):
    extra = ", ".join(f"{c}{n} double" for n in (1, 2) for c in geo.SHAPE)
    base = (1e6, 2.0, 0.0, 0.0, 85.0)
    d1, none, zero = (4e5, 1.0, 0.0, 10.0, 80.0), (None,) * 5, (0.0,) * 5
    rows = [(1, 1, *base, *d1, *d1), (2, 1, *base, *d1, *zero), (3, 0, *base, *d1, *d1), (4, 1, *base, *none, *none)]
    df = spark.createDataFrame(rows, f"id int, form int, {SCHEMA}, {extra}")
    got = geo.split_shapes(df, ["id"]).groupBy("id").count().toPandas().set_index("id")["count"].to_dict()
    assert got == {1: 3, 2: 2, 3: 1, 4: 1}


def test_aggregate_and_timeline(spark):
    rows = [(f"2000-01-0{i}", 1e6 * i, 2.0, 0.1, 0.0, 80.0) for i in range(1, 6)]
    df = spark.createDataFrame(rows, f"t string, {SCHEMA}")
    assert geo.aggregate_shape(df.drop("t"), "mean", 8).count() == 8
    got = geo.shape_timeline(df, "t", max_groups=2, num_points=4).toPandas()
    assert len(got) == 20 and got.groupby("idx").part.first().tolist() == [1, 1, 1, 2, 2]
    with pytest.raises(KeyError):
        geo.shape_timeline(df.drop("area"), "t")
