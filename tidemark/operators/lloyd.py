"""Lloyd's iteration for many groups and cluster counts at once.

A step is one job for every group and every k: each row finds its nearest
centre in all lists of centres of its group, and the rows of a centre are
averaged, in the map tasks first. Groups are never told apart on the driver; it
reads one number per step, the largest move of a centre. The centres are a table
with one row per group, joined to the rows: broadcast while the coordinates of all
centres are few, and otherwise joined apart for groups that hold many rows.

Centres start as in k-means++ (Arthur and Vassilvitskii 2007): the next is drawn
with a chance in proportion to the squared distance from those there are. The
draw is a race: the row with the least ``-log(u) / distance**2`` wins, with ``u``
hashed from the seed and the row id, so a draw is one aggregate for all groups and
does not depend on the partitioning. The first k centres start the fit for k.

A group with fewer distinct rows than k gets as many clusters as it has. A row as
near to two centres goes to the earlier one; a centre without rows stays where it
is. Labels number the clusters 0, 1, ... by their smallest row id. Rows without a
group key take no part.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expressions import as_vector, hash_uniform, mean_vector
from tidemark.operators.ordering import attach, join_skewed, keyed
from tidemark.session import checkpoint

#: Coordinates of all centres that may be broadcast.
BROADCAST_CELLS = 2_000_000


@dataclass(frozen=True)
class Lloyd:
    """A clusterer for :func:`tidemark.operators.selection.cluster_labels` and all that build on it."""

    seed: int = 0
    steps: int = 20
    tolerance: float = 1e-6


def _apart(x: Column, centre: Column) -> Column:
    return F.aggregate(F.zip_with(x, centre, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)


def _with(points: DataFrame, table: DataFrame, keys: Sequence[str], few: bool) -> DataFrame:
    """Rows with their group's centres."""
    return points.join(F.broadcast(table), list(keys)) if few else join_skewed(points, table, keys)


def _start(points: DataFrame, keys: list[str], few: bool, row_id: str, most: int, seed: int) -> DataFrame:
    """``(*keys, cs)``: up to ``most`` starting centres per group, in the order of their draws."""
    centres = None
    for at in range(most):
        luck = -F.log(F.lit(1.0) - hash_uniform(F.lit(seed), F.lit(at), F.col(row_id)))
        if centres is None:
            raced = points.withColumn("_race", luck)
        else:
            near = F.array_min(F.transform("cs", lambda c: _apart(F.col("_x"), c)))
            raced = _with(points, centres, keys, few).withColumn("_d", near).filter("_d > 0").withColumn("_race", luck / F.col("_d"))
        drawn = raced.groupBy(*keys).agg(F.min(F.struct("_race", row_id, "_x"))["_x"].alias("_new"))
        if centres is None:
            centres = checkpoint(drawn.select(*keys, F.array("_new").alias("cs")))
        else:
            more = F.when(F.col("_new").isNull(), F.col("cs")).otherwise(F.array_append("cs", F.col("_new")))
            centres = checkpoint(centres.join(drawn, keys, "left").select(*keys, more.alias("cs")))
    return centres


def _assigned(points: DataFrame, lists: DataFrame, keys: list[str], few: bool) -> DataFrame:
    """A row per row and k: ``(*points, k, at)`` with ``at`` the place of the nearest centre."""
    found = _with(points, lists, keys, few)
    distances = F.transform(F.col("_one.cs"), lambda c: _apart(F.col("_x"), c))
    each = found.select(*points.columns, F.explode("lists").alias("_one")).withColumn("_d", distances)
    at = F.array_position("_d", F.array_min("_d")).cast("int") - 1
    return each.select(*points.columns, F.col("_one.k").alias("k"), at.alias("at"))


def lloyd_labels(
    df: DataFrame, features: Sequence[str] | str, row_id: str, ks: Sequence[int], by: Sequence[str] = (), model: Lloyd = Lloyd()
) -> DataFrame:
    """``(*by, row_id, k, label)`` for every cluster count."""
    ks = sorted(set(ks))
    if not ks or ks[0] < 1:
        raise ValueError("cluster counts start at 1")
    vector = F.col(features).cast("array<double>") if isinstance(features, str) else as_vector(features)
    data, keys = keyed(df.select(*by, row_id, vector.alias("_x")), by)
    points = checkpoint(data.select(*keys, row_id, "_x"))
    if points.filter(F.col("_x").isNull() | F.exists("_x", lambda v: v.isNull() | F.isnan(v))).limit(1).count():
        raise ValueError("features have missing values; fill or drop them first")
    groups, dims = points.agg(F.count_distinct(*keys), F.max(F.size("_x"))).first()
    few = groups * (dims or 0) * sum(ks) <= BROADCAST_CELLS
    centres = _start(points, keys, few, row_id, ks[-1], model.seed)
    each = F.array(*[F.struct(F.lit(k).alias("k"), F.slice("cs", 1, k).alias("cs")) for k in ks])
    lists = checkpoint(centres.select(*keys, each.alias("lists")))
    for _ in range(model.steps):
        means = _assigned(points, lists, keys, few).groupBy(*keys, "k", "at").agg(mean_vector("_x").alias("_m"))
        places = lists.select(*keys, F.inline("lists")).select(*keys, "k", F.posexplode("cs").alias("at", "_c"))
        moved = places.join(means, [*keys, "k", "at"], "left").withColumn("_m", F.coalesce("_m", "_c"))
        moved = checkpoint(moved.withColumn("_by", _apart(F.col("_m"), F.col("_c"))))
        one = F.transform(F.array_sort(F.collect_list(F.struct("at", "_m"))), lambda s: s["_m"])
        again = moved.groupBy(*keys, "k").agg(one.alias("cs")).groupBy(*keys)
        lists = checkpoint(again.agg(F.array_sort(F.collect_list(F.struct("k", "cs"))).alias("lists")))
        if (moved.agg(F.max("_by")).first()[0] or 0.0) <= model.tolerance**2:
            break
    rows = checkpoint(_assigned(points, lists, keys, few).select(*keys, row_id, "k", "at"))
    first = rows.groupBy(*keys, "k", "at").agg(F.min(row_id).alias("_first"))
    label = F.row_number().over(Window.partitionBy(*keys, "k").orderBy("_first")) - 1
    names = first.select(*keys, "k", "at", label.alias("label"))
    return attach(rows, names, [*keys, "k", "at"]).select(*by, row_id, "k", F.col("label").cast("int").alias("label"))
