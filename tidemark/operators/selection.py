"""Cluster dispersion, gap statistic, elbow, silhouette and representatives."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expressions import as_vector, hash_uniform, mean_vector, vector_spread
from tidemark.operators.autocorrelation import grouped_schema
from tidemark.operators.blocks import BLOCK_ROWS, distances, meet, pack, panel_rows, tiles, unpack
from tidemark.operators.hierarchy import LINKAGES, cut, linkage
from tidemark.operators.lloyd import Lloyd, lloyd_labels
from tidemark.operators.ordering import BROADCAST_ROWS, ordinal
from tidemark.session import checkpoint

Features = Sequence[str] | str
CLASSES_PER_PASS = 1_000


def vector_of(features: Features) -> Column:
    return F.col(features).cast("array<double>") if isinstance(features, str) else as_vector(features)


def check_model(model) -> None:
    """A model is a linkage name, a :class:`Lloyd`, or an unfitted estimator with a ``k`` parameter."""
    if isinstance(model, Lloyd):
        return
    if isinstance(model, str):
        if model not in LINKAGES:
            raise ValueError(f"unknown linkage {model!r}; use one of {LINKAGES}")
        return
    if isinstance(model, Model):
        raise ValueError("the model is fitted already")
    if not hasattr(model, "fit"):
        raise AttributeError("the model needs a fit method")
    if not getattr(model, "hasParam", lambda _: False)("k"):
        raise TypeError("the model needs a parameter k")


def cluster_labels(
    df: DataFrame, features: Features, row_id: str, ks: Sequence[int], model="complete", by: Sequence[str] = (), **options
) -> DataFrame:
    """``(*by, row_id, k, label)`` for every cluster count.

    A linkage builds one tree per group and cuts it for every ``k``. A
    :class:`Lloyd` takes all groups and counts through each step together. Any
    other estimator is fitted once per group and ``k``, one after the other.
    """
    check_model(model)
    if isinstance(model, Lloyd):
        return lloyd_labels(df, features, row_id, ks, by, model)
    if isinstance(model, str):
        return cut(linkage(df, features, row_id, model, by, **options), ks)
    data = df.select(*by, row_id, array_to_vector(vector_of(features)).alias("_v"))
    groups = [r.asDict() for r in data.select(*by).distinct().collect()] if by else [{}]
    out = None
    for group in groups:
        part = data
        for c, v in group.items():
            part = part.filter(F.col(c).eqNullSafe(F.lit(v)))
        part = checkpoint(part)
        for k in ks:
            if k == 1:
                labelled = part.withColumn("label", F.lit(0))
            else:
                settings = {model.getParam("k"): k, model.getParam("featuresCol"): "_v", model.getParam("predictionCol"): "label"}
                labelled = model.copy(settings).fit(part).transform(part)
            rows = labelled.select(*by, row_id, F.lit(k).alias("k"), F.col("label").cast("int").alias("label"))
            out = rows if out is None else out.unionByName(rows)
    return out


def squared_error(df: DataFrame, features: Features, keys: Sequence[str]) -> DataFrame:
    """``(*keys, n, sse)``: squared distances to the group mean, summed.

    The sum over all pairs of a group is ``n * sse``, so no pair is formed.
    """
    n = F.count(F.lit(1))
    if not isinstance(features, str):
        total = F.lit(0.0)
        for c in features:
            total = total + F.var_pop(F.col(c).cast("double"))
        return df.groupBy(*keys).agg(n.alias("n"), (total * n).alias("sse"))
    held = df.filter(F.col(features).isNotNull())
    return held.groupBy(*keys).agg(n.alias("n"), (vector_spread(features) * n).alias("sse"))


def dispersion(df: DataFrame, features: Features, label: str, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, dispersion)``: per cluster, squared pair distances over twice its size, summed."""
    return squared_error(df, features, [*by, label]).groupBy(*by).agg((F.sum("sse") / 2).alias("dispersion"))


def reference_sample(
    df: DataFrame, features: Sequence[str], row_id: str, replicates: int = 1, seed: int = 0
) -> DataFrame:
    """``(rep, row_id, *features)``: uniform draws in the bounding box, as many as rows, per replicate.

    Draws hash (seed, replicate, row, dimension), so they do not depend on how
    the table is partitioned.
    """
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    if any(kinds[c] in ("string", "boolean", "timestamp", "timestamp_ntz", "date") for c in features):
        raise ValueError("features must be numeric")
    bounds = df.agg(*[f(F.col(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(features) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    copies = df.select(F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep"), row_id)
    draws = []
    for i, c in enumerate(features):
        lo, hi = bounds[f"lo{i}"], bounds[f"hi{i}"]
        u = hash_uniform(F.lit(seed), F.col("rep"), F.col(row_id), F.lit(i))
        draws.append((F.lit(lo) + F.lit(hi - lo) * u).alias(c))
    return copies.select("rep", row_id, *draws)


def gap_statistic(
    df: DataFrame, features: Sequence[str], row_id: str, k_max: int, replicates: int = 20, model="complete",
    seed: int = 0, **options,
) -> DataFrame:
    """``(k, gap, s)`` for k = 1..k_max.

    Replicates are drawn once and used for every ``k``; data and replicates
    are clustered side by side, one tree each.
    """
    check_model(model)
    if k_max <= 0 or replicates <= 0:
        raise ValueError("k_max and replicates must be positive")
    features = list(features)
    real = df.select(F.lit(-1).alias("rep"), row_id, *[F.col(c).cast("double").alias(c) for c in features])
    every = checkpoint(real.unionByName(reference_sample(df, features, row_id, replicates, seed)))
    labels = cluster_labels(every, features, row_id, range(1, k_max + 1), model, ["rep"], **options)
    labelled = labels.join(every, ["rep", row_id])
    w = F.col("dispersion")
    logs = dispersion(labelled, features, "label", ["rep", "k"]).select(
        "rep", "k", F.when(w > 0, F.log(w)).otherwise(F.lit(float("-inf"))).alias("w")
    )
    star = F.when(F.col("rep") >= 0, F.col("w"))
    own = F.max(F.when(F.col("rep") < 0, F.col("w")))
    return logs.groupBy("k").agg(
        (F.avg(star) - own).alias("gap"), (F.stddev_pop(star) * (1 + 1 / replicates) ** 0.5).alias("s")
    )


def gap_choice(gaps: DataFrame, start_k: int = 1) -> DataFrame:
    """``(k)``: the first k whose gap reaches the next one less its error; NULL if none does."""
    ahead = gaps.select((F.col("k") - 1).alias("k"), F.col("gap").alias("_gap"), F.col("s").alias("_s"))
    good = (F.col("gap") >= F.col("_gap") - F.col("_s")) & (F.col("k") >= start_k)
    return gaps.join(ahead, "k").agg(F.min(F.when(good, F.col("k"))).alias("k"))


def elbow(
    df: DataFrame, features: Features, row_id: str, k_max: int, model="complete", weight: str | None = None,
    labels: DataFrame | None = None, **options,
) -> DataFrame:
    """``(k, distortion, inertia)``: weighted mean and sum of squared distances to the cluster mean."""
    if k_max <= 0:
        raise ValueError("k_max must be positive")
    if labels is None:
        labels = cluster_labels(df, features, row_id, range(1, k_max + 1), model, **options)
    if weight is None:
        found = squared_error(labels.join(df.select(row_id, vector_of(features).alias("_x")), row_id), "_x", ["k", "label"])
        return found.groupBy("k").agg((F.sum("sse") / F.sum("n")).alias("distortion"), F.sum("sse").alias("inertia"))
    w = F.col(weight).cast("double")
    data = df.select(row_id, vector_of(features).alias("_x"), w.alias("_w"))
    rows = checkpoint(labels.join(data, row_id).select("k", "label", "_x", "_w"))
    centres = checkpoint(rows.groupBy("k", "label").agg(mean_vector("_x").alias("_c")))
    few = centres.count() <= BROADCAST_ROWS
    near = rows.join(F.broadcast(centres) if few else centres, ["k", "label"])
    d2 = F.aggregate(F.zip_with("_x", "_c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    return near.withColumn("_d", d2).groupBy("k").agg(
        (F.sum(F.col("_w") * F.col("_d")) / F.sum("_w")).alias("distortion"), F.sum("_d").alias("inertia")
    )


def silhouette(
    df: DataFrame, features: Features, row_id: str, labels: DataFrame, block: int = BLOCK_ROWS
) -> DataFrame:
    """``(k, silhouette)``: exact mean Euclidean silhouette of given labels ``(row_id, k, label)``.

    Distances are computed once for all ``k``: a task sums them per row, ``k``
    and label, whatever the labels of different ``k`` have in common. A cluster
    of one scores 0; with a single cluster the score is NULL.
    """
    ks = sorted(r["k"] for r in labels.select("k").distinct().collect())
    pick = [F.max(F.when(F.col("k") == k, F.col("label"))).cast("string") for k in ks]
    combos = labels.groupBy(row_id).agg(F.concat_ws("|", *pick).alias("_class"))
    data = df.select(row_id, vector_of(features).alias("_x")).join(combos, row_id)
    # Equal rows with equal labels share all distances.
    points = data.groupBy("_class", "_x").agg(F.min(row_id).cast("long").alias("_id"), F.count(F.lit(1)).alias("_w"))
    points = checkpoint(points.withColumn("_all", F.lit(0)))

    def work(left, right, same) -> dict:
        sides = [left] if same else [left, right]
        x = [unpack(side) for side in sides]
        mine = [np.array([c.split("|") for c in side["_class"]], dtype=np.int64).reshape(len(v), len(ks)) for side, v in zip(sides, x)]
        w = [np.asarray(side["_w"], float) for side in sides]
        names, shares, sums = [], [], []
        for label, weight in zip(mine, w):
            found = [np.unique(label[:, at], return_inverse=True) for at in range(len(ks))]
            names.append([n for n, _ in found])
            # One column for each k and label: the weights of its rows.
            bounds = np.r_[0, np.cumsum([len(n) for n, _ in found])]
            share = np.zeros((len(label), bounds[-1]))
            for at, (_, place) in enumerate(found):
                share[np.arange(len(label)), bounds[at] + place] = weight
            shares.append((share, bounds))
        me, them = 0, len(sides) - 1
        sums = [np.zeros((len(x[i]), shares[them - i][0].shape[1])) for i in range(len(sides))]
        for one in tiles(len(x[me]), block):
            for two in tiles(len(x[them]), block):
                d = distances(x[me][one], x[them][two])
                sums[me][one] += d @ shares[them][0][two]
                if not same:
                    sums[them][two] += d.T @ shares[me][0][one]
        out = {"_id": [], "_w": [], "k": [], "mine": [], "other": [], "_sum": []}
        for i, side in enumerate(sides):
            far = them - i
            for at, k in enumerate(ks):
                lo, hi = shares[far][1][at : at + 2]
                out["_id"] += list(side["_id"])
                out["_w"] += list(side["_w"])
                out["k"] += [k] * len(x[i])
                out["mine"] += mine[i][:, at].tolist()
                out["other"] += [names[far][at].tolist()] * len(x[i])
                out["_sum"] += sums[i][:, lo:hi].tolist()
        return out

    packed = pack(points, ["_id", "_class", "_w"], "_x", ["_class", "_id"], ["_all"], panel_rows(points, "_x", ["_all"], block))
    schema = grouped_schema(
        points, ["_all"], ("_id", "long"), ("_w", "long"), ("k", "int"), ("mine", "int"), ("other", "array<int>"), ("_sum", "array<double>")
    )
    sums = meet(packed, ["_all"], [], schema, work)
    by_label = sums.select("_id", "_w", "k", "mine", F.inline(F.arrays_zip("other", "_sum"))).groupBy("_id", "_w", "k", "mine", "other")
    by_label = by_label.agg(F.sum("_sum").alias("_sum"))
    sizes = checkpoint(labels.groupBy("k", F.col("label").alias("other")).agg(F.count(F.lit(1)).alias("_n")))
    few = sizes.count() <= BROADCAST_ROWS
    scored = by_label.join(F.broadcast(sizes) if few else sizes, ["k", "other"])
    home = F.col("mine") == F.col("other")
    per_row = scored.groupBy("_id", "_w", "k").agg(
        F.max(F.when(home, F.col("_n"))).alias("_n"),
        F.max(F.when(home, F.col("_sum") / F.greatest(F.col("_n") - 1, F.lit(1)))).alias("a"),
        F.min(F.when(~home, F.col("_sum") / F.col("_n"))).alias("b"),
    )
    score = F.when(F.col("_n") == 1, F.when(F.col("b").isNotNull(), F.lit(0.0))).otherwise(
        F.when(F.col("b").isNotNull(), F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    )
    return per_row.withColumn("_s", score).groupBy("k").agg((F.sum(F.col("_w") * F.col("_s")) / F.sum("_w")).alias("silhouette"))


def squared_silhouette(df: DataFrame, features: Features, row_id: str, labels: DataFrame) -> DataFrame:
    """``(k, silhouette)`` with squared Euclidean distances, exact, without a pair of rows.

    The mean squared distance of a row to a class is ``|x|^2 - 2 x m + s`` with
    the mean ``m`` and the mean square ``s`` of the class, so a row needs one
    step per class. Values are taken from the mean of all rows first, which keeps
    the difference of squares small. Cases are those of :func:`silhouette`.
    """
    given = df.select(row_id, vector_of(features).alias("_x")).filter("_x IS NOT NULL")
    middle = given.agg(mean_vector("_x").alias("m")).first()["m"]
    if middle is None:
        return labels.select("k", F.lit(None).cast("double").alias("silhouette")).distinct()
    centred = F.zip_with("_x", F.array(*map(F.lit, middle)), lambda a, b: a - b)
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda s, a: s + a * a)
    data = given.select(row_id, centred.alias("_x")).withColumn("_q", square(F.col("_x")))
    rows = checkpoint(labels.select(row_id, "k", "label").join(data, row_id).select("k", "label", "_x", "_q"))
    classes = rows.groupBy("k", "label").agg(F.count(F.lit(1)).alias("n"), mean_vector("_x").alias("m"), F.avg("_q").alias("s"))
    classes = checkpoint(classes)
    few = classes.count() <= BROADCAST_ROWS
    lists = classes.groupBy("k").agg(F.collect_list(F.struct("label", "n", "m", "s")).alias("_c"))
    near = rows.join(F.broadcast(lists) if few else lists, "k")

    def apart(c: Column) -> Column:
        product = F.aggregate(F.zip_with("_x", c["m"], lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        return F.greatest(F.col("_q") - 2 * product + c["s"], F.lit(0.0))

    home = F.filter("_c", lambda c: c["label"] == F.col("label"))[0]
    others = F.transform(F.filter("_c", lambda c: c["label"] != F.col("label")), apart)
    found = near.select("k", home["n"].alias("_n"), apart(home).alias("_own"), F.array_min(others).alias("b"))
    found = found.withColumn("a", F.col("_own") * F.col("_n") / F.greatest(F.col("_n") - 1, F.lit(1)))
    ratio = F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
    score = F.when(F.col("b").isNotNull(), F.when(F.col("_n") == 1, F.lit(0.0)).otherwise(ratio))
    return found.groupBy("k").agg(F.avg(score).alias("silhouette"))


def silhouette_method(
    df: DataFrame, features: Features, row_id: str, k_max: int, model="complete", labels: DataFrame | None = None,
    block: int = BLOCK_ROWS, **options,
) -> DataFrame:
    """``(k, silhouette)`` for k = 2..k_max; ``labels`` replaces the clustering."""
    if k_max < 2:
        raise ValueError("k_max must be at least 2")
    if labels is None:
        labels = checkpoint(cluster_labels(df, features, row_id, range(2, k_max + 1), model, **options))
    return silhouette(df, features, row_id, labels.filter(F.col("k").between(2, k_max)), block)


def silhouette_choice(scores: DataFrame) -> DataFrame:
    """``(k)`` with the highest score; the smaller k wins a tie."""
    ranked = F.struct((-F.col("silhouette")).alias("s"), F.col("k"))
    return scores.filter("silhouette IS NOT NULL").agg(F.min(ranked).alias("m")).select(F.col("m.k").alias("k"))


def cluster_sets(
    df: DataFrame, sets: Mapping[str, tuple[Sequence[str], int]], row_id: str, model="complete", **options
) -> DataFrame:
    """Add one label column per ``{name: (features, k)}``."""
    found = None
    for name, (features, k) in sets.items():
        one = cluster_labels(df, features, row_id, [k], model, **options).select(row_id, F.lit(name).alias("_set"), "label")
        found = one if found is None else found.unionByName(one)
    if found is None:
        return df
    wide = found.groupBy(row_id).agg(*[F.max(F.when(F.col("_set") == n, F.col("label"))).alias(n) for n in sets])
    return df.join(wide, row_id, "left")


def representatives(
    df: DataFrame, features: Features, label: str, row_id: str, within_class: bool = False
) -> DataFrame:
    """``(label, row_id, distance)``: the row nearest to each class mean; ties to the smallest id.

    All rows compete unless ``within_class``. Each task keeps its best row per
    class; means go to the tasks in portions of fixed size, one pass each.
    """
    data = df.select(F.col(label).alias("label"), F.col(row_id).alias("row_id"), vector_of(features).alias("_x"))
    known = data.filter("label IS NOT NULL")
    means = checkpoint(ordinal(known.groupBy("label").agg(mean_vector("_x").alias("m")), ["label"], name="_at"))
    schema = grouped_schema(data, ["label", "row_id"], ("distance", "double"))
    out = None
    for first in range(0, means.count(), CLASSES_PER_PASS):
        part = means.filter(F.col("_at").between(first, first + CLASSES_PER_PASS - 1)).collect()
        names, centres = [r["label"] for r in part], np.array([r["m"] for r in part], float)

        def nearest(batches: Iterator[pd.DataFrame], names=names, centres=centres) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if pdf.empty:
                    continue
                pdf = pdf.sort_values("row_id")
                d = distances(np.stack(pdf["_x"].to_numpy()).astype(float), centres)
                if within_class:
                    d[np.not_equal.outer(pdf["label"].to_numpy(), np.asarray(names))] = np.inf
                at = d.argmin(axis=0)
                found = pd.DataFrame({"label": names, "row_id": pdf["row_id"].to_numpy()[at], "distance": d[at, range(len(names))]})
                yield found[np.isfinite(found["distance"])]

        best = data.mapInPandas(nearest, schema).groupBy("label").agg(F.min(F.struct("distance", "row_id")).alias("m"))
        best = best.select("label", F.col("m.row_id").alias("row_id"), F.col("m.distance").alias("distance"))
        out = best if out is None else out.unionByName(best)
    return out
