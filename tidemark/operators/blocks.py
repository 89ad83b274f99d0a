"""Work over all pairs of rows without producing pairs.

Rows are packed into blocks of bounded size, every block meets every other
block once, and a task returns reductions (sums, nearest neighbours), never
the pairs. Blocks that all meet each other are panels of several tiles
(:func:`panel_rows`): a task takes two panels, goes through their tiles, and
returns one reduction for both. Without groups, panels meet in a Cartesian
product, which reads both sides where they lie; the disk holds each row once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from math import ceil, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.autocorrelation import grouped_schema, key_frame
from tidemark.operators.ordering import attach, ordinal, side_by_side
from tidemark.session import checkpoint

BLOCK_ROWS = 2_048
TILE_ROWS = 1_024
#: Panels that a table is cut into at least, if it has the rows, and bytes of vectors in one of them at most.
PANELS = 16
PANEL_BYTES = 32 << 20
_PRODUCT_FORM = 16
_CURVE_FEATURES = 16


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of rows of ``a`` to rows of ``b``."""
    if a.shape[1] <= _PRODUCT_FORM:
        total = np.zeros((len(a), len(b)))
        for j in range(a.shape[1]):
            total += np.subtract.outer(a[:, j], b[:, j]) ** 2
    else:
        middle = b.mean(axis=0)
        a, b = a - middle, b - middle
        total = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :]
        both = a @ b.T
        both *= 2
        total -= both
        np.maximum(total, 0.0, out=total)
    return total


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows of ``a`` to rows of ``b``."""
    total = squares(a, b)
    return np.sqrt(total, out=total)


def tiles(rows: int, block: int) -> list[slice]:
    """Slices of at most ``block`` rows; small enough that a tile's distances stay near the processor."""
    size = min(block, TILE_ROWS)
    return [slice(at, min(at + size, rows)) for at in range(0, rows, size)]


def pack(
    df: DataFrame, columns: Sequence[str], vector: str, order: Sequence[str], keys: Sequence[str], rows: int
) -> DataFrame:
    """One row per block: ``(*keys, block, vectors, *columns)`` with columns as arrays."""
    indexed = ordinal(df.select(*keys, *columns, vector), order, keys, name="_at")
    indexed = indexed.withColumn("block", F.expr(f"_at div {rows}"))
    names = list(columns)

    def join_up(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_at")
        flat = np.stack(pdf[vector].to_numpy()).astype(float)
        out = {"block": [int(pdf["block"].iloc[0])], "dims": [flat.shape[1]], "vectors": [flat.tobytes()]}
        return key_frame(keys, pdf, out | {c: [pdf[c].tolist()] for c in names})

    more = [(c, f"array<{df.schema[c].dataType.simpleString()}>") for c in names]
    schema = grouped_schema(df, keys, ("block", "long"), ("dims", "int"), ("vectors", "binary"), *more)
    return checkpoint(indexed.groupBy(*keys, "block").applyInPandas(join_up, schema))


def panel_rows(df: DataFrame, vector: str, keys: Sequence[str], block: int) -> int:
    """Rows of a panel: whole tiles of ``block`` rows, few panels, but enough pairs of them for all cores."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vector)).alias("dims"))
    most = sizes.agg(F.max("n").alias("n"), F.max("dims").alias("dims")).first()
    wanted = max(PANELS, ceil(sqrt(8 * df.sparkSession.sparkContext.defaultParallelism)))
    held = max(1, PANEL_BYTES // (8 * max(most["dims"] or 1, 1) * block))
    return block * max(1, min(ceil((most["n"] or 0) / (wanted * block)), held))


def unpack(row: pd.Series) -> np.ndarray:
    return np.frombuffer(row["vectors"], float).reshape(-1, row["dims"])


def along_curve(df: DataFrame, vector: str) -> DataFrame:
    """Adds ``_z``, the place of a vector on a Z-order curve through the box of all vectors.

    The widest features, at most ``_CURVE_FEATURES``, share the bits of the key.
    """
    wide = df.select(F.posexplode(vector).alias("_j", "_v")).groupBy("_j").agg(F.min("_v").alias("low"), F.max("_v").alias("high"))
    wide = wide.filter("high > low").orderBy(F.desc(F.col("high") - F.col("low")), "_j").limit(_CURVE_FEATURES).collect()
    if not wide:
        return df.withColumn("_z", F.lit(0).cast("long"))
    bits = min(31, 62 // len(wide))
    cells = float((1 << bits) - 1)
    cell = lambda r: ((F.get(vector, F.lit(r["_j"])) - F.lit(r["low"])) / F.lit(r["high"] - r["low"]) * cells).cast("long")
    at = df.withColumn("_cells", F.array(*[cell(r) for r in wide]))
    bit = lambda b, j: F.shiftleft(F.shiftright(F.get("_cells", F.lit(j)), b).bitwiseAND(F.lit(1).cast("long")), b * len(wide) + j)
    key = F.lit(0).cast("long")
    for b in range(bits):
        for j in range(len(wide)):
            key = key + bit(b, j)
    return at.withColumn("_z", key).drop("_cells")


def box_pairs(packed: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """``(*keys, _lo, _hi, near, far)``: bounds of the distances between two blocks, from their boxes.

    Only boxes are paired; the vectors stay where they are.
    """

    def box(pdf: pd.DataFrame) -> pd.DataFrame:
        x = unpack(pdf.iloc[0])
        return key_frame(keys, pdf, {"block": pdf["block"].tolist(), "low": [x.min(axis=0).tolist()], "high": [x.max(axis=0).tolist()]})

    schema = grouped_schema(packed, keys, ("block", "long"), ("low", "array<double>"), ("high", "array<double>"))
    boxes = checkpoint(packed.groupBy(*keys, "block").applyInPandas(box, schema))
    last = checkpoint(boxes.groupBy(*by).agg(F.max("block").alias("_last")))
    left = attach(boxes, last, by).filter("block < _last").select(
        *keys, F.col("block").alias("_lo"), F.col("low").alias("_l"), F.col("high").alias("_h"), F.explode(F.expr("sequence(block + 1, _last)")).alias("_hi")
    )
    both = left.join(boxes.withColumnRenamed("block", "_hi"), [*keys, "_hi"])
    square = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, v: a + v * v))
    minus = lambda a, b: F.zip_with(a, b, lambda x, y: x - y)
    gap = F.zip_with(minus("low", "_h"), minus("_l", "high"), lambda a, b: F.greatest(a, b, F.lit(0.0)))
    reach = F.zip_with(minus("high", "_l"), minus("_h", "low"), lambda a, b: F.greatest(a, b))
    return checkpoint(both.select(*keys, "_lo", "_hi", square(gap).alias("near"), square(reach).alias("far")))


def meet_some(
    packed: DataFrame,
    keys: Sequence[str],
    pairs: DataFrame,
    schema: T.StructType,
    work: Callable[[pd.Series, pd.Series, bool], dict],
) -> DataFrame:
    """Run ``work`` on the pairs of blocks ``(*keys, _lo, _hi)``; only their vectors move."""
    block = F.explode(F.array_distinct(F.array("_lo", "_hi"))).alias("block")
    copies = pairs.select(*keys, "_lo", "_hi", block).join(packed, [*keys, "block"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        return key_frame(keys, pdf, work(pdf.iloc[0], pdf.iloc[-1], len(pdf) == 1))

    group = [*keys, "_lo", "_hi"]
    return side_by_side(copies, group, max(pairs.count(), 1)).groupBy(*group).applyInPandas(run, schema)


def meet(
    packed: DataFrame,
    keys: Sequence[str],
    by: Sequence[str],
    schema: T.StructType,
    work: Callable[[pd.Series, pd.Series, bool], dict],
) -> DataFrame:
    """Run ``work(left, right, same)`` on every unordered pair of blocks of a group."""
    if not by:
        return meet_all(packed, keys, schema, work)
    last = checkpoint(packed.groupBy(*by).agg(F.max("block").alias("_last")))
    pairs = last.agg(F.sum(F.expr("(_last + 1) * (_last + 2) div 2"))).first()[0]
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"))).alias("_other")
    copies = attach(packed, last, by).select(*packed.columns, other)
    copies = copies.withColumns({"_lo": F.least("block", "_other"), "_hi": F.greatest("block", "_other")})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        left, right = pdf.iloc[0], pdf.iloc[-1]
        return key_frame(keys, pdf, work(left, right, len(pdf) == 1))

    group = [*keys, "_lo", "_hi"]
    return side_by_side(copies, group, int(pairs or 1)).groupBy(*group).applyInPandas(run, schema)


def meet_all(
    packed: DataFrame,
    keys: Sequence[str],
    schema: T.StructType,
    work: Callable[[pd.Series, pd.Series, bool], dict],
    first: int | None = None,
) -> DataFrame:
    """Run ``work(left, right, same)`` on every unordered pair of blocks, all of one group.

    ``first`` leaves only pairs with one of the first so many blocks. The blocks
    are dealt out once, one to a partition, and a task of the product reads one
    partition of either side.
    """
    names = list(packed.columns)
    dealt = packed.repartitionByRange(max(packed.count(), 1), "block")
    side = lambda name: dealt.select(*[F.col(c).alias(f"_{name}_{c}") for c in names])
    begun = side("lo") if first is None else side("lo").filter(F.col("_lo_block") < first)
    paired = begun.join(side("hi").hint("shuffle_replicate_nl"), F.col("_lo_block") <= F.col("_hi_block"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(len(pdf)):
                row = pdf.iloc[at]
                lo, hi = (pd.Series({c: row[f"_{side}_{c}"] for c in names}) for side in ("lo", "hi"))
                yield key_frame(keys, lo.to_frame().T, work(lo, hi, bool(lo["block"] == hi["block"])))

    return paired.mapInPandas(run, schema)
