"""Approximate nearest neighbours by a forest of random-projection trees.

Every tree halves a bounded sample by planes midway between two random points.
Each row goes down every tree; a leaf's rows lie in blocks, and a leaf that
holds many rows, such as copies of one vector, has many blocks. A query walks
all trees through one priority queue, nearest plane first, and takes leaves
until they hold the wanted share of all rows, as estimated from the leaves'
sizes. The leaves' rows are then reranked by their exact cosine.

The share is the price of recall: vectors without any structure, as random
ones, have neighbours everywhere and need a large one.

Cases: see :func:`vectors.usable` for rows that take no part; zero vectors take
none either. Rows that share a query's vec_id are its own; rows that share any
other vec_id are one candidate, by the better score. At every size a query reads
the share of the rows or ``AT_LEAST`` of them, whichever is more, so that the
nearest ``k`` exist among them. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import vectors
from tidemark.llm.topk import ranked
from tidemark.session import checkpoint

TREES = 20
DEPTH = 7
SAMPLE = 8_192
SHARE = 0.5
AT_LEAST = 200
QUERY_ROWS = 512


@dataclass
class Forest:
    """Planes by tree and node; the children of node i are 2i + 1 and 2i + 2."""

    normals: np.ndarray
    offsets: np.ndarray
    depth: int

    @property
    def leaves(self) -> int:
        return 1 << self.depth

    def leaf(self, units: np.ndarray, tree: int) -> np.ndarray:
        node = np.zeros(len(units), np.int64)
        side = units @ self.normals[tree].T > self.offsets[tree]
        for _ in range(self.depth):
            node = 2 * node + 1 + side[np.arange(len(units)), node]
        return node - self.leaves + 1


def grow(units: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 7) -> Forest:
    random = np.random.default_rng(seed)
    size, nodes = units.shape[1], (1 << depth) - 1
    normals, offsets = np.zeros((trees, nodes, size)), np.zeros((trees, nodes))
    for t in range(trees):
        held = {0: np.arange(len(units))}
        for node in range(nodes):
            rows = held.pop(node)
            direction = random.normal(size=size)
            if len(rows) > 1:
                a, b = units[random.choice(rows, 2, replace=False)]
                if not np.array_equal(a, b):
                    direction = a - b
            direction /= np.linalg.norm(direction)
            where = units[rows] @ direction
            middle = float(np.median(where)) if len(rows) else 0.0
            normals[t, node], offsets[t, node] = direction, middle
            held[2 * node + 1], held[2 * node + 2] = rows[where <= middle], rows[where > middle]
    return Forest(normals, offsets, depth)


def choose(forest: Forest, unit: np.ndarray, counts: np.ndarray, share: float) -> list[tuple[int, int]]:
    """(tree, leaf) in the order of the shared queue until they hold ``share`` of all rows.

    ``counts`` are rows by tree and leaf. Trees count as independent; a tree
    that was read whole has everything.
    """
    total = counts[0].sum()
    margin = forest.normals @ unit - forest.offsets
    queue = [(0.0, t, 0) for t in range(len(margin))]
    inner, held, out = forest.leaves - 1, np.zeros(len(margin)), []
    while queue and held.max() < total and (share >= 1 or 1 - np.prod(1 - held / total) < share):
        bound, t, node = heapq.heappop(queue)
        if node >= inner:
            leaf = node - inner
            if counts[t, leaf] > 0:
                out.append((t, leaf))
                held[t] += counts[t, leaf]
            continue
        m = margin[t, node]
        near = 2 * node + 1 + (m > 0)
        heapq.heappush(queue, (bound, t, near))
        heapq.heappush(queue, (max(bound, abs(m)), t, 4 * node + 3 - near))
    return out


def _precision(table: DataFrame, name: str) -> type:
    """Vectors of floats travel as floats, all others as doubles; cosines are computed in doubles."""
    return np.float32 if table.schema[name].dataType.elementType.typeName() == "float" else np.float64


def _rerank(pairs: DataFrame, size: int, k: int, kind: type) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for binary in zip(*(batch.column(c).to_pylist() for c in ("ids", "vectors", "qids", "queries"))):
                ids, rows = np.frombuffer(binary[0], np.int64), np.frombuffer(binary[1], kind).reshape(-1, size).astype(np.float64)
                qids, queries = np.frombuffer(binary[2], np.int64), np.frombuffer(binary[3], kind).reshape(-1, size).astype(np.float64)
                lengths = np.sqrt((rows * rows).sum(axis=1))
                qlengths = np.sqrt((queries * queries).sum(axis=1))
                rough = (queries / qlengths[:, None]) @ (rows / lengths[:, None]).T
                for i, q in enumerate(qids):
                    others = np.flatnonzero(ids != q)
                    if not len(others):
                        continue
                    near = rough[i][others]
                    top = vectors.best(near, ids[others], k)
                    limit = near[top[-1]] if len(top) == k else -np.inf
                    others = others[near >= limit - 1e-9]
                    # One order of summation for every pair, so that equal vectors score alike.
                    exact = (rows[others] * queries[i]).sum(axis=1) / (lengths[others] * qlengths[i])
                    kept = vectors.best(exact, ids[others], k)
                    found.append((np.full(len(kept), q), ids[others][kept], exact[kept]))
            if found:
                arrays = [pa.array(np.concatenate([f[i] for f in found])) for i in range(3)]
                yield pa.RecordBatch.from_arrays(arrays, names=["query_id", "vec_id", "score"])

    return pairs.mapInArrow(run, "query_id long, vec_id long, score double")


def nearest(
    table: DataFrame,
    k: int = 5,
    every: int = 50,
    trees: int = TREES,
    depth: int = DEPTH,
    share: float = SHARE,
    name: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id and score (cosine) of the ``k`` nearest rows found for each query row."""
    spark = table.sparkSession
    kind = _precision(table, name)
    rows, size = vectors.usable(table, name)
    rows = rows.filter(F.exists("vector", lambda x: x != 0))
    picked = vectors.sample(rows, SAMPLE, size)
    if not len(picked):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    forest = grow(picked / np.linalg.norm(picked, axis=1, keepdims=True), trees, depth)
    shared = spark.sparkContext.broadcast(forest)

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = shared.value
        for batch in batches:
            points = vectors.matrix(batch.column(1), size)
            units = points / np.linalg.norm(points, axis=1, keepdims=True)
            binary = pa.array([p.tobytes() for p in points.astype(kind)], pa.binary())
            for t in range(trees):
                key = pa.array(planes.leaf(units, t) + t * planes.leaves)
                yield pa.RecordBatch.from_arrays([key, pa.array(np.zeros(len(points))), batch.column(0), binary], names=["key", "far", "vec_id", "vector"])

    placed = rows.select("vec_id", "vector").mapInArrow(descend, "key long, far double, vec_id long, vector binary")
    index = checkpoint(vectors.in_blocks(placed, vectors.block_rows(size)))
    sizes = index.groupBy("key").agg(F.sum(F.length("ids") / 8).alias("n")).collect()
    counts = np.zeros(trees * forest.leaves)
    for row in sizes:
        counts[row["key"]] = row["n"]
    counts = counts.reshape(trees, -1)
    wanted = min(1.0, max(share, AT_LEAST / counts[0].sum()))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = shared.value
        for batch in batches:
            points = vectors.matrix(batch.column(1), size)
            keys, ids, out = [], [], []
            for q, point in zip(batch.column(0).to_pylist(), points):
                for t, leaf in choose(planes, point / np.linalg.norm(point), counts, wanted):
                    keys.append(t * planes.leaves + leaf)
                    ids.append(q)
                    out.append(point.astype(kind).tobytes())
            columns = [pa.array(keys, pa.int64()), pa.array(np.zeros(len(keys))), pa.array(ids, pa.int64()), pa.array(out, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "far", "vec_id", "vector"])

    asked = rows.filter(vectors.is_query(every)).dropDuplicates(["vec_id", "vector"])
    visits = vectors.in_blocks(asked.select("vec_id", "vector").mapInArrow(walk, "key long, far double, vec_id long, vector binary"), vectors.block_rows(size, QUERY_ROWS))
    visits = checkpoint(visits).select("key", F.col("ids").alias("qids"), F.col("vectors").alias("queries"))
    found = _rerank(visits.join(index.select("key", "ids", "vectors"), "key"), size, k, kind)
    return ranked(found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), k)
