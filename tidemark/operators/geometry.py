"""Ellipses on a polar stereographic map.

Projection: forward polar stereographic on an ellipsoid, Snyder (1987),
"Map Projections: A Working Manual", equations 15-9, 21-33 and 21-34, north
pole, central meridian 0, true scale at 60 degrees north.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.aggregate import AggFunc, aggregate
from tidemark.operators.ordering import ordinal, time_groups

# The WGS84 ellipsoid and the latitude of true scale.
EARTH_RADIUS = 6378137.0
FLATTENING = 1 / 298.257223563
TRUE_SCALE = 60.0

_E = math.sqrt(FLATTENING * (2 - FLATTENING))
SHAPE = ("area", "ar", "theta", "loncent", "latcent")


def _pole_distance(phi: Column) -> Column:
    es = F.sin(phi) * _E
    return F.tan(F.lit(math.pi / 4) - phi / 2) / F.pow((1 - es) / (1 + es), F.lit(_E / 2))


def project(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Degrees to map metres."""
    true = math.radians(TRUE_SCALE)
    es = _E * math.sin(true)
    m = math.cos(true) / math.sqrt(1 - es * es)
    t = math.tan(math.pi / 4 - true / 2) / ((1 - es) / (1 + es)) ** (_E / 2)
    rho = _pole_distance(F.radians(lat)) * (EARTH_RADIUS * m / t)
    return rho * F.sin(F.radians(lon)), -rho * F.cos(F.radians(lon))


def shape_fault(columns: Sequence[str] = SHAPE) -> Column:
    """Why a row has no ellipse, or NULL if it has one."""
    area, ar, theta, lon, lat = (F.col(c) for c in columns)
    missing = F.lit(False)
    for c in (area, ar, theta, lon, lat):
        missing = missing | c.isNull() | F.isnan(c.cast("double"))
    return (
        F.when(missing, F.lit("a shape value is missing"))
        .when(area <= 0, F.lit("area must be positive"))
        .when(ar <= 0, F.lit("aspect ratio must be positive"))
        .when((lon < -180) | (lon > 180), F.lit("longitude must be within -180 and 180"))
        .when((lat < -90) | (lat > 90), F.lit("latitude must be within -90 and 90"))
    )


def ellipses(
    df: DataFrame,
    keep: Sequence[str],
    num_points: int = 200,
    columns: Sequence[str] = SHAPE,
    degrees: bool = False,
    on_fault: str = "raise",
) -> DataFrame:
    """Perimeter points ``(*keep, vertex, x, y)`` in metres, ``num_points`` per row.

    ``theta`` is in radians unless ``degrees``. Faulty rows raise, or are left
    out with ``on_fault="skip"``; :func:`ellipse_rejects` lists them.
    """
    if num_points <= 0:
        raise ValueError("the number of points must be positive")
    if on_fault not in ("raise", "skip"):
        raise ValueError("on_fault is 'raise' or 'skip'")
    area, ar, theta, lon, lat = (F.col(c).cast("double") for c in columns)
    fault = shape_fault(columns)
    if on_fault == "skip":
        df = df.filter(fault.isNull())
    else:
        area = F.when(fault.isNull(), area).otherwise(F.raise_error(fault).cast("double"))
    turn = (F.radians(theta) if degrees else theta) + F.lit(math.pi / 2)
    # Raw inputs first: under a lazily evaluated fault the trigonometry must not fail before it.
    minor = F.sqrt(area / (ar * math.pi))
    x0, y0 = project(lon, lat)
    shapes = df.select(
        *keep, (minor * ar).alias("_a"), minor.alias("_b"), F.cos(turn).alias("_c"), F.sin(turn).alias("_s"),
        x0.alias("_x"), y0.alias("_y"), F.explode(F.sequence(F.lit(0), F.lit(num_points - 1))).alias("vertex"),
    )
    angle = F.col("vertex") * F.lit(2 * math.pi / num_points)
    u, v = F.col("_a") * F.cos(angle), F.col("_b") * F.sin(angle)
    return shapes.select(
        *keep, "vertex",
        (F.col("_x") + (u * F.col("_c") - v * F.col("_s")) * 1000).alias("x"),
        (F.col("_y") + (u * F.col("_s") + v * F.col("_c")) * 1000).alias("y"),
    )


def ellipse_rejects(df: DataFrame, columns: Sequence[str] = SHAPE) -> DataFrame:
    """Rows without an ellipse, with the ``fault``."""
    return df.withColumn("fault", shape_fault(columns)).filter("fault IS NOT NULL")


def split_shapes(df: DataFrame, keep: Sequence[str], split_column: str = "form", split=1) -> DataFrame:
    """One row per shape: ``(*keep, slot, area, ar, theta, loncent, latcent)``.

    Slot 0 is the whole vortex. Rows of the split class add slots 1 and 2,
    read from ``area1`` .. ``ar2``, where those hold a positive area.
    """
    slots = [F.struct(F.lit(0).alias("slot"), *[F.col(c).cast("double").alias(c) for c in SHAPE])]
    is_split = F.lit(False)
    if split_column in df.columns:
        is_split = F.coalesce(F.col(split_column) == F.lit(split), F.lit(False))
    for n in (1, 2):
        if f"area{n}" in df.columns:
            parts = F.struct(F.lit(n).alias("slot"), *[F.col(f"{c}{n}").cast("double").alias(c) for c in SHAPE])
            slots.append(F.when(is_split & (F.col(f"area{n}") > 0), parts))
    return df.select(*keep, F.inline(F.array_compact(F.array(*slots))))


def aggregate_shape(df: DataFrame, agg_func: AggFunc = "mean", num_points: int = 200) -> DataFrame:
    """The ellipse of the aggregated shape parameters."""
    return ellipses(aggregate(df, agg_func, (), SHAPE), [], num_points)


def shape_timeline(
    df: DataFrame,
    time: str,
    tie: Sequence[str] = (),
    max_groups: int = 4,
    num_points: int = 200,
    split_column: str = "form",
    split=1,
) -> DataFrame:
    """Perimeter points of all shapes in time order.

    ``(idx, time, part, position, slot, vertex, x, y)``: ``idx`` is the frame,
    ``part`` one of ``max_groups`` contiguous groups, ``position`` runs from 0
    to 1 over the whole table.
    """
    missing = [c for c in (*SHAPE, time) if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {missing}")
    ordered = time_groups(ordinal(df, [time, *tie]), max_groups)
    keep = ["idx", time, "part", "position"]
    shapes = split_shapes(ordered, keep, split_column, split)
    return ellipses(shapes, [*keep, "slot"], num_points)
