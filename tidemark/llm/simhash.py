"""Near-duplicates by SimHash and a hierarchical index in Gray order.

Fingerprints are collapsed to distinct values first, so copies cost one row
each. Codes that share their first bits are neighbours in Gray order; such a
group is an upper node of the index, and its masked bit pattern is compared
once for all its members. A fingerprint visits only the nodes whose pattern
differs from its own by what the distance still allows. A node with too many
members is split by further bits, so the upper part of the tree is as deep as
the data ask for. Inside a node, numpy walks the lower levels and drops whole
subtrees by accumulated differences. A node returns links of a spanning forest,
never all pairs, and components follow by contraction in Spark.

Cases: null, empty and wordless texts have fingerprint zero and link like any
other. Texts of one or two words hash their whole word sequence. Repeated rows
and equal texts share a fingerprint and so a component. A null doc_id takes
part, but never names a component unless all its ids are null. Only the named
columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import columns, release, slices, width
from tidemark.session import checkpoint

SHINGLE = 3
DISTANCE = 2
#: Members of an index node that one task searches.
NODE_ROWS = 4_096
#: Bits by which a node with more than eight times as many members is split.
SPLIT_BITS = 6
_STEP = 8
_BLOCK = 4_096
_COUNTED = 65_536


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    size = min(shingle, len(words))
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    ones, total = np.zeros(64, dtype=np.int64), len(words) - size + 1
    for at in range(0, total, _COUNTED):
        upto = min(at + _COUNTED, total)
        spans = zip(starts[at:upto].tolist(), ends[at + size - 1 : upto + size - 1].tolist())
        hashes = np.array([digest(joined[s:e], 42) for s, e in spans], dtype=">u8")
        bits = np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``fp``, the fingerprint's 64 bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            codes = np.array([fingerprint(t, shingle) for t in batch.column("_text").to_pylist()], dtype=np.uint64)
            arrays = [*[batch.column(c) for c in keep], pa.array(codes.view(np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "fp"])
        release()

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, docs.select(*keep).schema.add("fp", "long"))


def _masks(bits: int, most: int) -> list[tuple[int, int]]:
    """Bit patterns with at most ``most`` ones, and their number of ones."""
    found = [(0, 0)]
    for _ in range(most):
        found += [(m | 1 << b, n + 1) for m, n in found for b in range(bits) if m < 1 << b]
    return sorted(set(found))


def _route(rows: DataFrame, depth: int, bits: int, distance: int) -> DataFrame:
    """Send each row on to the children, ``bits`` deeper, that it may still match.

    ``node`` is the bit pattern of the first ``depth`` bits of the target and
    ``left`` the differences still allowed. A pair meets once, in the node
    whose pattern is the larger.
    """
    own = F.shiftrightunsigned("fp", 64 - depth - bits)
    steps = F.array(*[F.struct(F.lit(m).cast("long").alias("m"), F.lit(n).alias("d")) for m, n in _masks(bits, distance)])
    tail = own.bitwiseAND(F.lit((1 << bits) - 1))
    child = F.shiftleft("node", bits).bitwiseOR(tail.bitwiseXOR(F.col("_s.m")))
    return (
        rows.withColumn("_s", F.explode(steps))
        .filter(F.col("_s.d") <= F.col("left"))
        .select("fp", child.alias("node"), (F.col("left") - F.col("_s.d")).alias("left"), own.alias("_own"))
        .filter("node >= _own")
        .select("fp", F.lit(depth + bits).alias("depth"), "node", "left", (F.col("node") == F.col("_own")).alias("member"))
    )


def _gray_rank(codes: np.ndarray) -> np.ndarray:
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _levels(members: np.ndarray, depth: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Lower levels over Gray-sorted members: first row of each node, its pattern, its shift."""
    out = []
    while depth < 64:
        depth = min(64, depth + _STEP)
        shift = 64 - depth
        pattern = members >> np.uint64(shift)
        first = np.flatnonzero(np.r_[True, pattern[1:] != pattern[:-1]])
        out.append((first, pattern[first], shift))
    return out


def _matches(members: np.ndarray, depth: int, codes: np.ndarray, left: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of ``codes`` and of ``members`` within reach, block by block of visitors."""
    levels = _levels(members, depth)
    for at in range(0, len(codes), _BLOCK):
        code, rest = codes[at : at + _BLOCK], left[at : at + _BLOCK]
        who = np.arange(len(code))
        begin, end = np.zeros(len(code), np.int64), np.full(len(code), len(members), np.int64)
        above = depth
        for first, pattern, shift in levels:
            low, high = np.searchsorted(first, begin), np.searchsorted(first, end)
            many = high - low
            who = np.repeat(who, many)
            node = np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
            tail = np.uint64((1 << (64 - shift - above)) - 1)
            apart = np.bitwise_count(((code[who] >> np.uint64(shift)) ^ pattern[node]) & tail).astype(np.int64)
            spare = np.repeat(rest if above == depth else allowed, many) - apart
            near = spare >= 0
            who, node, allowed = who[near], node[near], spare[near]
            begin = first[node]
            end = np.r_[first, len(members)][node + 1]
            above = 64 - shift
        yield at + who, begin


class _Forest:
    def __init__(self, size: int):
        self.parent = list(range(size))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def _search(group: pa.Table) -> pa.Table:
    depth = group.column("depth")[0].as_py()
    codes = group.column("fp").to_numpy().view(np.uint64)
    left, inside = group.column("left").to_numpy(), group.column("member").to_numpy(zero_copy_only=False)
    members = codes[inside]
    members = members[np.argsort(_gray_rank(members))]
    # Members come first, so that a link between two of them is known by place.
    codes = np.r_[members, codes[~inside]]
    left = np.r_[np.full(len(members), left[inside].max() if inside.any() else 0), left[~inside]]
    forest, links = _Forest(len(codes)), []
    for a, b in _matches(members, depth, codes, left) if len(members) else ():
        for x, y in zip(a.tolist(), b.tolist()):
            if x != y and forest.join(x, y):
                links.append((x, y))
    pairs = np.array(links, dtype=np.int64).reshape(-1, 2)
    signed = codes.view(np.int64)
    return pa.table({"a": signed[pairs[:, 0]], "b": signed[pairs[:, 1]]})


def links(codes: DataFrame, distance: int = DISTANCE, node_rows: int = NODE_ROWS) -> DataFrame:
    """Links (a, b) that connect what lies within ``distance`` bits; ``codes.fp`` is distinct."""
    spark, total = codes.sparkSession, codes.count()
    depth = max(0, (max(total, 1) // node_rows).bit_length())
    rows = codes.select("fp", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("node"), F.lit(distance).alias("left"), F.lit(True).alias("member"))
    ready = []
    bits = depth
    depth = 0
    while True:
        if bits:
            rows, depth = _route(rows, depth, bits, distance), depth + bits
        bits = SPLIT_BITS
        if depth + bits >= 64:
            break
        sizes = rows.filter("member").groupBy("node").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 8 * node_rows)
        large = checkpoint(sizes.select("node"))
        if not large.count():
            break
        ready.append(rows.join(large, "node", "left_anti"))
        rows = rows.join(large, "node", "left_semi").select("fp", "depth", "node", "left", "member")
    out = None
    for part in [*ready, rows]:
        part = part.select("fp", "depth", "node", "left", "member")
        out = part if out is None else out.unionByName(part)
    spread = out.repartition(max(width(spark), 2 * (total // node_rows)), "depth", "node")
    return spread.groupBy("depth", "node").applyInArrow(_search, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``fp`` and ``root`` for every end of an edge, by repeated contraction.

    Each round points a node at its least neighbour, follows the pointers to
    their ends by doubling, and keeps the edges between different ends. Only
    groupings with partial sums and joins are used.
    """
    edges = checkpoint(edges.select("a", "b").distinct())
    maps = []
    while edges.count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = checkpoint(both.groupBy(F.col("a").alias("fp")).agg(F.min("b").alias("_m")).select("fp", F.least("fp", "_m").alias("root")))
        while True:
            over = up.select(F.col("fp").alias("root"), F.col("root").alias("_next"))
            jumped = checkpoint(up.join(over, "root").select("fp", F.col("_next").alias("root"), (F.col("root") != F.col("_next")).alias("_moved")))
            up = jumped.select("fp", "root")
            if not jumped.filter("_moved").limit(1).count():
                break
        maps.append(up)
        ends = edges
        for side in ("a", "b"):
            ends = ends.join(up.select(F.col("fp").alias(side), F.col("root").alias(f"_{side}")), side)
        ends = ends.filter("_a <> _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct()
        edges = checkpoint(ends)
    if not maps:
        return edges.select(F.col("a").alias("fp"), F.col("b").alias("root"))
    out = maps[0]
    for up in maps[1:]:
        over = up.select(F.col("fp").alias("root"), F.col("root").alias("_next"))
        out = out.join(over, "root", "left").select("fp", F.coalesce("_next", "root").alias("root"))
    return out


def _labels(found: DataFrame, distance: int, node_rows: int) -> DataFrame:
    """``fp`` and ``component_id`` for every fingerprint."""
    codes = checkpoint(found.groupBy("fp").agg(F.min("doc_id").alias("_first")))
    roots = components(links(codes, distance, node_rows))
    named = checkpoint(codes.join(roots, "fp", "left").select("fp", "_first", F.coalesce("root", "fp").alias("root")))
    least = named.groupBy("root").agg(F.min("_first").alias("component_id"))
    return checkpoint(named.select("fp", "root").join(least, "root").select("fp", "root", "component_id"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, node_rows: int = NODE_ROWS) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id``, the smallest doc_id reachable over links."""
    found = checkpoint(fingerprints(docs, shingle))
    return found.join(_labels(found, distance, node_rows), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, node_rows: int = NODE_ROWS) -> DataFrame:
    """One row of ``docs`` per component: the smallest doc_id, and then the smallest digest of the text."""
    # The row travels as one struct, so no column of it can clash with ours.
    key = F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("_key")
    keyed = docs.select(F.struct(*columns(docs)).alias("_row"), F.col("doc_id").alias("_doc"), key)
    found = checkpoint(fingerprints(docs.select("doc_id", "text", key), shingle, ("doc_id", "_key")))
    labels = _labels(found, distance, node_rows).select("fp", "root")
    # Nulls last: a row without an id stays only where its whole component has none.
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_key").alias("key"))
    first = found.groupBy("fp").agg(F.min(place).alias("_place"))
    stay = first.join(labels, "fp").groupBy("root").agg(F.min("_place").alias("_place"))
    stay = stay.select(F.col("_place.id").alias("_id"), F.col("_place.key").alias("_of"))
    out = keyed.join(stay, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_of")), "left_semi")
    repeated = found.groupBy("doc_id", "_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if repeated.limit(1).count():
        out = out.dropDuplicates(["_doc", "_key"])
    return out.select("_row.*")


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
