"""Pack tokenised documents into fixed-length sequences, shortest pack first.

Each document is cut into pieces of at most the sequence length. Only the
histogram of piece lengths, which has at most that many bins, reaches the
driver. There lengths are placed longest first, each into the pattern with the
most free space, and patterns carry counts, so the work depends on the number
of bins and not on the number of documents. Pieces then find their place in a
pattern by their rank among the pieces of equal length. Ranks come from
counters per task and a running sum of the tasks' counts, so neither a frequent
length nor a large table is sorted in one task.

With ``by``, a column of strings such as a language, a sequence holds rows of one
value only (null is a value); each value has a histogram and patterns of its own.

Cases: a null or empty text is a document of the end id alone. Texts of any
length are cut; no piece is dropped. Repeated rows are packed once each. An
empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.bpe import worker
from tidemark.llm.common import release, resident_mb, slices
from tidemark.session import checkpoint

LENGTH = 4_096
END = 2
#: A worker larger than this at the end of a task forgets the words it has encoded.
KEEP_MB = 340

#: How many sequences have a pattern, and the lengths in it, longest first.
Pattern = tuple[int, tuple[int, ...]]


def shortest_pack_first(histogram: Mapping[int, int], size: int = LENGTH) -> list[Pattern]:
    """Patterns that hold every piece of the histogram exactly once."""
    by_space: dict[int, list[Pattern]] = {}
    spaces: list[int] = []

    def put(count: int, lengths: tuple[int, ...]) -> None:
        space = size - sum(lengths)
        if not by_space.get(space):
            by_space[space] = []
            heapq.heappush(spaces, -space)
        by_space[space].append((count, lengths))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while spaces and not by_space[-spaces[0]]:
                heapq.heappop(spaces)
            if not spaces or -spaces[0] < length:
                put(left, (length,))
                break
            packs, lengths = by_space[-spaces[0]].pop()
            # Several pieces of this length may go into one pack at once.
            taken = min(packs, left)
            if taken < packs:
                by_space[-spaces[0]].append((packs - taken, lengths))
            put(taken, (*lengths, length))
            left -= taken
    return [pattern for space in sorted(by_space) for pattern in by_space[space]]


def pieces(docs: DataFrame, path: str, size: int = LENGTH, end: int = END, ids: bool = False, by: str | None = None) -> DataFrame:
    """Tokenise and cut: doc_id, start, length, ids_crc32, doc_tokens, and the place within a task (``by``: and value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen, part = worker(path).encoder, Counter(), TaskContext.get().partitionId()
        last = np.array([end], "<u4").tobytes()
        for batch in slices(batches):
            owner, rows, binaries = [], [], []
            group = batch.column(2).to_pylist() if by else [None] * batch.num_rows
            for i, text in enumerate(batch.column(1).to_pylist()):
                binary = encoder.binary(text) + last
                total = len(binary) // 4
                for start in range(0, total, size):
                    cut = binary[4 * start : 4 * (start + size)]
                    length = len(cut) // 4
                    owner.append(i)
                    rows.append((start, length, zlib.crc32(cut), total, part, seen[group[i], length]))
                    seen[group[i], length] += 1
                    if ids:
                        binaries.append(np.frombuffer(cut, "<u4").astype(np.int32))
            columns = [batch.column(0).take(pa.array(owner, pa.int64()))]
            columns += [pa.array(list(c), pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 6
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "_part", "_nth"]
            if ids:
                columns.append(pa.array(binaries, pa.list_(pa.int32())))
                names.append("ids")
            if by:
                columns.append(batch.column(2).take(pa.array(owner, pa.int64())))
                names.append("_by")
            yield pa.RecordBatch.from_arrays(columns, names=names)
        release()
        if resident_mb() > KEEP_MB:
            encoder.forget()

    schema = docs.select("doc_id").schema
    for name in ("start", "length", "ids_crc32", "doc_tokens", "_part", "_nth"):
        schema = schema.add(name, "long")
    if ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))
    if by:
        schema = schema.add("_by", T.StringType())
    return docs.select("doc_id", "text", *([F.col(by).cast("string")] if by else [])).mapInArrow(run, schema)


def _slots(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """For each run of ranks of a length: its first sequence, the pieces per sequence, their first offset."""
    used, base, rows = Counter(), 0, []
    for count, lengths in patterns:
        offset = 0
        for length, many in sorted(Counter(lengths).items(), reverse=True):
            rows.append((length, used[length], base, many, offset))
            used[length] += count * many
            offset += many * length
        base += count
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "base", "many", "offset"), table.T))


_RANKS = 1 << 48


def assign(cut: DataFrame, patterns: Mapping[str | None, list[Pattern]]) -> DataFrame:
    """Add sequence_id and offset to pieces that carry ``length``, ``_rank`` and, unless all are of value None, ``_by``."""
    places, number, base = [], {}, 0
    for value, of_value in patterns.items():
        slots = _slots(of_value)
        number[value] = len(places)
        places.append((slots["length"] * _RANKS + slots["rank"], slots, base))
        base += sum(count for count, _ in of_value)
    shared = cut.sparkSession.sparkContext.broadcast((number, places))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, places = shared.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "_rank"))
            values = batch.column("_by").to_pylist() if "_by" in batch.schema.names else [None] * batch.num_rows
            group = np.fromiter(map(number.__getitem__, values), dtype=np.int64, count=batch.num_rows)
            sequence, offset = np.zeros_like(length), np.zeros_like(length)
            for g in np.unique(group).tolist():
                mine = np.flatnonzero(group == g)
                keys, slot, base = places[g]
                at = np.searchsorted(keys, length[mine] * _RANKS + rank[mine], side="right") - 1
                within = rank[mine] - slot["rank"][at]
                sequence[mine] = base + slot["base"][at] + within // slot["many"][at]
                offset[mine] = slot["offset"][at] + within % slot["many"][at] * length[mine]
            kept = [c for c in batch.schema.names if c not in ("_rank", "_by")]
            columns = [batch.column(c) for c in kept] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "sequence_id", "offset"])

    schema = cut.drop("_rank", "_by").schema.add("sequence_id", "long").add("offset", "long")
    return cut.mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, size: int = LENGTH, end: int = END, ids: bool = False, by: str | None = None) -> DataFrame:
    """One row per piece with its sequence and its offset there; ``ids`` adds the ids themselves.

    ``by`` names a column whose values never share a sequence.
    """
    cut = checkpoint(pieces(docs, path, size, end, ids, by))
    value = ["_by"] if by else []
    counts = checkpoint(cut.groupBy("_part", *value, "length").agg(F.count(F.lit(1)).alias("_n")))
    histograms: dict[str | None, dict[int, int]] = {}
    for row in counts.groupBy(*value, "length").agg(F.sum("_n").alias("_n")).collect():
        histograms.setdefault(row["_by"] if by else None, {})[row["length"]] = row["_n"]
    ordered = sorted(histograms, key=lambda v: (v is not None, v or ""))
    patterns = {v: shortest_pack_first(histograms[v], size) for v in ordered}
    earlier = Window.partitionBy(*value, "length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first")
    first = counts.select(F.col("_part").alias("_in"), F.col("length").alias("_long"), *[F.col(c).alias("_of") for c in value], first)
    same = (F.col("_part") == F.col("_in")) & (F.col("length") == F.col("_long"))
    if by:
        same &= F.col("_by").eqNullSafe(F.col("_of"))
    ranked = cut.join(first, same).withColumn("_rank", F.col("_first") + F.col("_nth"))
    return assign(ranked.select(*[c for c in cut.columns if c not in ("_part", "_nth")], "_rank"), patterns)
