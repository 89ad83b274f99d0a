"""Agreement of predicted classes with a reference class."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expressions import is_not


def agreement(
    df: DataFrame,
    truth: str,
    predictions: Sequence[str],
    value: str = "string",
    predicted_value="S",
    true_value="S",
    absent: str = "raise",
) -> DataFrame:
    """``(prediction, tp, fp, fn, tn, accuracy, precision, recall, f1)`` in one pass.

    A missing class counts as different. A ratio with nothing below the line
    is NULL. A class value that never occurs raises when the table is read;
    with ``absent="count"`` it counts as 0, so a class that was never predicted
    has no precision and an F1 of 0.
    """
    if absent not in ("raise", "count"):
        raise ValueError(f"absent must be 'raise' or 'count', not {absent!r}")
    for c in (truth, value, *predictions):
        if c not in df.columns:
            raise KeyError(f"no column {c}")
    aggs = [F.count_if(F.col(truth) == F.lit(true_value)).alias("_true")]
    for i, p in enumerate(predictions):
        hit, real = F.col(p).eqNullSafe(F.lit(predicted_value)), F.col(truth).eqNullSafe(F.lit(true_value))
        off, unreal = is_not(p, predicted_value), is_not(truth, true_value)
        aggs += [
            F.count_if(hit & real).alias(f"tp{i}"), F.count_if(hit & unreal).alias(f"fp{i}"),
            F.count_if(off & real).alias(f"fn{i}"), F.count_if(off & unreal).alias(f"tn{i}"),
        ]
    counts = df.agg(*aggs)
    rows = F.array(*[
        F.struct(F.lit(p).alias("prediction"), *[F.col(f"{n}{i}").alias(n) for n in ("tp", "fp", "fn", "tn")])
        for i, p in enumerate(predictions)
    ])
    long = counts.select("_true", F.inline(rows))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    if absent == "raise":
        none = F.when(F.col("_true") == 0, F.raise_error(F.lit(f"{true_value!r} does not occur in {truth}"))).when(
            tp + fp == 0, F.raise_error(F.concat(F.lit(f"{predicted_value!r} does not occur in "), F.col("prediction")))
        )
        long = long.withColumn("tp", F.coalesce(none.cast("bigint"), tp))
    return long.drop("_true").withColumns({
        "accuracy": F.try_divide(tp + tn, tp + fp + fn + tn),
        "precision": F.try_divide(tp, tp + fp),
        "recall": F.try_divide(tp, tp + fn),
        "f1": F.try_divide(2 * tp, 2 * tp + fp + fn),
    })
