"""Exact top-k inner products by a pivot-distance index.

A component sqrt(M^2 - |c|^2) added to each vector, with M the largest norm,
gives all the same length, so the largest inner products are the nearest
neighbours. Vectors are keyed by their nearest pivot and their distance to it
and lie in blocks sorted by that distance: annuli around the pivot. A query
first meets its own block, which bounds its k-th best score and so the radius
in which better ones can lie. It then expands only into the blocks and, inside
them, the runs of rows whose distance to the pivot differs from its own by no
more than that radius: nothing else can be nearer, by the triangle inequality.

Scores are exact integers. Queries travel in groups, one per run of home
blocks; the join of groups and blocks is by pivot with the bound as a
condition, and a busy pivot is split by salt. Pivots come from a bounded sample.

Cases: see :func:`vectors.usable` for rows that take no part. Rows that share a
query's vec_id are its own and never its candidates; repeated rows are asked
and returned once, and rows that share any other vec_id are one candidate, by the
better score. An empty table gives an empty result. Scores beyond a long wrap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import vectors
from tidemark.session import checkpoint

SCALE = 256
PIVOTS = 64
SAMPLE = 2_048
QUERY_ROWS = 512
_SALTS = 16
_EXACT = float(1 << 53)
_GROUP = "group long, qids binary, queries binary, reach binary, least binary, far binary"


def _integers(values: np.ndarray, scale: int) -> np.ndarray:
    return np.floor(np.clip(values * scale, -(2.0**62), 2.0**62)).astype(np.int64)


def _pivots(points: np.ndarray, count: int) -> np.ndarray:
    """Greedy choice of points far from each other."""
    chosen, gap = [0], np.linalg.norm(points - points[0], axis=1)
    while len(chosen) < min(count, len(points)):
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, np.linalg.norm(points - points[chosen[-1]], axis=1))
    return points[chosen]


def _lifted(whole: np.ndarray, longest: float) -> np.ndarray:
    squares = (whole.astype(np.float64) ** 2).sum(axis=1)
    return np.c_[whole, np.sqrt(np.maximum(longest**2 - squares, 0.0))]


def _distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((points**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1) - 2 * points @ pivots.T, 0.0))


def _products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    if not len(rows) or not len(queries):
        return np.zeros((len(queries), len(rows)), np.int64)
    bound = float(np.abs(queries).max()) * float(np.abs(rows).max()) * rows.shape[1]
    if bound < _EXACT:
        return (queries.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    return queries @ rows.T


def _slack(longest: float) -> float:
    return 1e-6 * longest + 1e-6


def _seed(index: DataFrame, size: int, pivots: np.ndarray, longest: float, k: int, every: int) -> DataFrame:
    """Queries by home block: their distances to the pivots, the k-th score at home and the radius it leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for block, ids, rows in zip(*(batch.column(c).to_pylist() for c in ("block", "ids", "vectors"))):
                ids, rows = np.frombuffer(ids, np.int64), np.frombuffer(rows, np.int64).reshape(-1, size)
                asked = np.flatnonzero(ids % every == 0)
                if not len(asked):
                    continue
                least = np.full(len(asked), np.iinfo(np.int64).min)
                scores = _products(rows[asked], rows)
                for i, q in enumerate(asked):
                    others = np.flatnonzero(ids != ids[q])
                    top = vectors.best(scores[i][others], ids[others], k)
                    if len(top) == k:
                        least[i] = scores[i][others[top[-1]]]
                queries = rows[asked].astype(np.float64)
                far = _distances(np.c_[queries, np.zeros(len(queries))], pivots)
                known = least > np.iinfo(np.int64).min
                square = (queries**2).sum(axis=1) + longest**2 - 2.0 * np.where(known, least, 0)
                reach = np.where(known, np.sqrt(np.maximum(square, 0.0)) * (1 + 1e-9) + _slack(longest), np.inf)
                out.append((block, ids[asked].tobytes(), rows[asked].tobytes(), reach.tobytes(), least.tobytes(), far.tobytes()))
            if out:
                types = (pa.int64(), *[pa.binary()] * 5)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), types)], names=["group", "qids", "queries", "reach", "least", "far"])

    return index.select("block", "ids", "vectors").mapInArrow(run, _GROUP)


def _grouped(seeds: DataFrame, size: int, pivots: int, rows: int) -> DataFrame:
    """Query groups of up to ``rows`` from the home blocks of a task, with bounds per pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def flush() -> pa.RecordBatch:
            nonlocal held, count
            parts = [b"".join(h[i] for h in held) for i in range(1, 6)]
            far = np.frombuffer(parts[4]).reshape(-1, pivots)
            reach = np.frombuffer(parts[2])
            row = (held[0][0], *parts, far.min(axis=0).tolist(), far.max(axis=0).tolist(), float(reach.max()))
            held, count = [], 0
            types = (pa.int64(), *[pa.binary()] * 5, pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64())
            names = ["group", "qids", "queries", "reach", "least", "far", "nearest", "farthest", "radius"]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=names)

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6))):
                size_here = len(row[1]) // 8
                if held and count + size_here > rows:
                    yield flush()
                held.append(row)
                count += size_here
        if held:
            yield flush()

    return seeds.mapInArrow(run, _GROUP + ", nearest array<double>, farthest array<double>, radius double")


def _search(pairs: DataFrame, size: int, pivots: int, k: int) -> DataFrame:
    """The best of each block for each query of a group that can still gain from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            columns = (batch.column(c) for c in ("key", "ids", "far", "vectors", "qids", "queries", "reach", "least", "qfar"))
            for key, *binary in zip(*(c.to_pylist() for c in columns)):
                ids, far, rows = np.frombuffer(binary[0], np.int64), np.frombuffer(binary[1]), np.frombuffer(binary[2], np.int64).reshape(-1, size)
                qids, queries = np.frombuffer(binary[3], np.int64), np.frombuffer(binary[4], np.int64).reshape(-1, size)
                reach, least = np.frombuffer(binary[5]), np.frombuffer(binary[6], np.int64)
                own = np.frombuffer(binary[7]).reshape(-1, pivots)[:, key]
                first, last = np.searchsorted(far, own - reach), np.searchsorted(far, own + reach, side="right")
                live = np.flatnonzero(last > first)
                if not len(live):
                    continue
                low, high = first[live].min(), last[live].max()
                scores = _products(queries[live], rows[low:high])
                useful = np.flatnonzero(scores.max(axis=1) >= least[live])
                for i in useful:
                    q = live[i]
                    span = slice(first[q] - low, last[q] - low)
                    there, score = ids[low:high][span], scores[i][span]
                    kept = np.flatnonzero((there != qids[q]) & (score >= least[q]))
                    kept = kept[vectors.best(score[kept], there[kept], k)]
                    found.append((np.full(len(kept), qids[q]), there[kept], score[kept]))
            if found:
                arrays = [pa.array(np.concatenate([f[i] for f in found])) for i in range(3)]
                yield pa.RecordBatch.from_arrays(arrays, names=["query_id", "vec_id", "score"])

    return pairs.mapInArrow(run, "query_id long, vec_id long, score long")


def top_products(table: DataFrame, k: int = 5, every: int = 50, scale: int = SCALE, pivots: int = PIVOTS, name: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score: the ``k`` largest integer inner products of each query row."""
    spark = table.sparkSession
    rows, size = vectors.usable(table, name)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not size:
        return empty
    floors = F.aggregate("vector", F.lit(0.0), lambda a, x: a + F.floor(x * scale).cast("double") ** 2)
    longest = float(np.sqrt(rows.agg(F.max(floors)).first()[0])) + 1.0
    centres = _pivots(_lifted(_integers(vectors.sample(rows, SAMPLE, size), scale), longest), pivots)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = _integers(vectors.matrix(batch.column(1), size), scale)
            gaps = _distances(_lifted(whole, longest), centres)
            nearest = gaps.argmin(axis=1)
            columns = [pa.array(nearest.astype(np.int64)), pa.array(gaps[np.arange(len(gaps)), nearest]), batch.column(0), pa.array([r.tobytes() for r in whole], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "far", "vec_id", "vector"])

    index = checkpoint(vectors.in_blocks(rows.select("vec_id", "vector").mapInArrow(key, "key long, far double, vec_id long, vector binary"), vectors.block_rows(size)))
    groups = checkpoint(_grouped(_seed(index, size, centres, longest, k, every), size, len(centres), vectors.block_rows(size, QUERY_ROWS)))
    salt = F.pmod(F.xxhash64("group"), F.lit(_SALTS))
    bounds = F.posexplode(F.arrays_zip("nearest", "farthest")).alias("key", "span")
    sides = groups.select("group", "radius", salt.alias("salt"), bounds).select(
        "group", "radius", "salt", F.col("key").cast("long").alias("key"), F.col("span.nearest").alias("nearest"), F.col("span.farthest").alias("farthest")
    )
    annuli = index.select("key", "block", "low", "high").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long"))))
    gap = F.greatest(F.col("low") - F.col("farthest"), F.col("nearest") - F.col("high"))
    pairs = sides.join(annuli, ["key", "salt"]).filter(gap <= F.col("radius")).select("group", "block")
    asked = pairs.join(groups.select("group", "qids", "queries", "reach", "least", F.col("far").alias("qfar")), "group")
    found = _search(asked.join(index.select("block", "key", "ids", "far", "vectors"), "block"), size, len(centres), k)
    return ranked(found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")
