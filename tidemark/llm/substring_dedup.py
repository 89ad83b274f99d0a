"""Exact removal of repeated passages by fixed-block anchors.

A window of ``window`` words always contains one of its document's aligned,
non-overlapping blocks of half that length. So two equal windows meet at an
anchor: a block of one equals a rolling window of block length in the other.

1. Documents are put into batches, written once, compressed.
2. Index and probe: every batch sends the fingerprints of its blocks and of its
   rolling windows, each content once, to buckets by fingerprint. A bucket
   says which contents are a block elsewhere. These are short fingerprints, so
   some hits are false, a share that does not grow with the data.
3. Extend: the windows around a hit, taken whole, go to buckets under 80 bits
   of their hash (128 in large corpora), again once per batch and content, with
   their first place. The bucket finds the first place overall. Windows that
   follow each other make up the maximal repeats; every word that a later window
   covers is removed.

Window hashes combine cryptographic hashes of the words, so no wording makes two
unlike windows collide; chance alone could. All bits decide at every step.

A passage that a third of all documents share costs one entry per batch, not
per document, and no pairs are made. Batches meet their answers by a join on the
batch id, and both joins read one shuffle of the compressed texts; hashes are
computed anew rather than moved. Buckets are as many as the data need.

Cases: null and empty texts have no words and stay as they are. Documents
shorter than a window lose nothing. Rows that repeat a doc_id and start at the
same word are equally early, so neither removes the other. A null doc_id counts
as the smallest. Other columns are carried inside a struct, so names cannot
clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import columns, release, slices, width
from tidemark.session import checkpoint

WINDOW = 20
#: Bytes of text in a batch; a longer document is a batch of its own.
BATCH_BYTES = 2 << 20
#: Contents per bucket that the number of buckets aims at.
BUCKET_WORDS = 1 << 20
_SEGMENT = 1 << 18
#: Words in the corpus up to which 80 bits tell windows apart.
_MANY_WORDS = 1 << 33
_FILL = 65_535
_LOWEST = np.iinfo(np.int64).min


# Hashes of word windows --------------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values; a fixed bijection."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class _Family:
    """A polynomial over word hashes modulo 2^64, rolled over windows of words."""

    def __init__(self, seed: int):
        base = int(np.random.default_rng(seed).integers(1, 1 << 62)) * 2 + 1
        steps = np.full(_SEGMENT + 1, base, np.uint64)
        back = np.full(_SEGMENT + 1, pow(base, -1, 1 << 64), np.uint64)
        steps[0] = back[0] = 1
        self.power, self.inverse = np.cumprod(steps), np.cumprod(back)

    def windows(self, words: np.ndarray, size: int) -> np.ndarray:
        """Hash of the window of ``size`` words that begins at each word; fewer words at the end."""
        n = len(words)
        out = np.zeros(n, np.uint64)
        step = len(self.power) - 1 - size
        for low in range(0, n, step):
            part = words[low : low + step + size]
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part * self.power[: len(part)], out=total[1:])
            start = np.arange(min(step, n - low))
            end = np.minimum(start + size, len(part))
            out[low : low + step] = (total[end] - total[start]) * self.inverse[start]
        return _mixed(out)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Two independent 64-bit hashes for each word; each different word is hashed once."""
    table = dict.fromkeys(words, b"")
    for word in table:
        table[word] = hashlib.blake2b(word, digest_size=16).digest()
    return np.frombuffer(b"".join(map(table.__getitem__, words)), "<u8").reshape(-1, 2).T


_families: dict[int, _Family] = {}


def _family(seed: int) -> _Family:
    if seed not in _families:
        _families[seed] = _Family(seed)
    return _families[seed]


# Batches -----------------------------------------------------------------------------


def batches(docs: DataFrame) -> DataFrame:
    """Rows of (batch, texts, sizes, rows): compressed texts in order of doc_id, their bytes, all other columns."""

    def pack(part: int, nth: int, held: list[tuple]) -> dict:
        held.sort(key=lambda h: (h[0] is not None, h[0]))
        raw = b"".join(h[1] or b"" for h in held)
        return {
            "batch": part << 32 | nth,
            "texts": pa.compress(raw, codec="zstd", asbytes=True),
            "ids": [h[0] for h in held],
            "sizes": [-1 if h[1] is None else len(h[1]) for h in held],
            "words": sum(len(h[1].split()) for h in held if h[1]),
            "rows": [h[2] for h in held],
        }

    docs = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").alias("text"), F.struct(*columns(docs, "text")).alias("row"))
    row_type = docs.select("row").schema[0].dataType
    target = (
        T.StructType().add("batch", "long").add("texts", "binary").add("ids", T.ArrayType(T.LongType())).add("sizes", T.ArrayType(T.LongType())).add("words", "long")
    ).add("rows", T.ArrayType(row_type))

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        part, nth, held, size = TaskContext.get().partitionId(), 0, [], 0
        arrow = to_arrow_schema(target)
        for batch in slices(incoming):
            texts = [None if t is None else t.encode() for t in batch.column(1).to_pylist()]
            for item in zip(batch.column(0).to_pylist(), texts, batch.column(2).to_pylist()):
                length = len(item[1] or b"")
                if held and size + length > BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist([pack(part, nth, held)], arrow)
                    nth, held, size = nth + 1, [], 0
                held.append(item)
                size += length
        if held:
            yield pa.RecordBatch.from_pylist([pack(part, nth, held)], arrow)
        release()

    return docs.mapInArrow(run, target)


class _Batch:
    """The words of a batch, one after the other, as hashes; ``keep`` holds on to the words themselves."""

    def __init__(self, texts: bytes, ids: list[int | None], sizes: list[int], window: int, keep: bool = False):
        raw = pa.decompress(texts, decompressed_size=sum(s for s in sizes if s > 0), codec="zstd", asbytes=True)
        self.raw, at, self.words = [], 0, []
        for size in sizes:
            self.raw.append(None if size < 0 else raw[at : at + size])
            at += max(size, 0)
            self.words.append(self.raw[-1].split() if size > 0 else [])
        self.hashes = word_hashes([w for words in self.words for w in words])
        self.counts = np.array([len(w) for w in self.words], np.int64)
        if not keep:
            self.raw = self.words = None
        self.n, self.window, self.block = int(self.counts.sum()), window, window // 2
        first = np.cumsum(self.counts) - self.counts
        self.start = np.arange(self.n) - np.repeat(first, self.counts)
        self.left = np.repeat(self.counts, self.counts) - self.start
        self.id = np.repeat(np.array([_LOWEST if i is None else i for i in ids], np.int64), self.counts)

    def anchors(self, buckets: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bucketed fingerprint of the rolling window at each word, which are whole, which are blocks."""
        hashed = _family(1).windows(self.hashes[0], self.block)
        whole = self.left >= self.block
        return _bucketed(hashed, buckets, span), whole, whole & (self.start % self.block == 0)

    def entries(self, at: np.ndarray, entry: np.dtype) -> np.ndarray:
        """The identities of the whole windows at these words."""
        out = np.empty(len(at), entry)
        out["high"] = _family(1).windows(self.hashes[0], self.window)[at]
        out["low"] = _family(2).windows(self.hashes[1], self.window)[at].astype(entry["low"])
        return out


def _bucketed(hashed: np.ndarray, buckets: int, span: int) -> np.ndarray:
    count = np.uint64(buckets)
    return (hashed % count) * np.uint64(span) + (hashed // count) % np.uint64(span)


def _read(batch: pa.RecordBatch, window: int, keep: bool = False) -> Iterator[tuple[int, _Batch]]:
    for i in range(batch.num_rows):
        get = lambda name: batch.column(name)[i].as_py()
        yield get("batch"), _Batch(get("texts"), get("ids"), get("sizes"), window, keep)


# Short fingerprints on the wire ------------------------------------------------------


def _pack_sorted(values: np.ndarray) -> bytes:
    """Ascending numbers as 16-bit gaps with fillers for wide ones, or plainly if that is shorter."""
    gaps = np.diff(values, prepend=np.uint64(0))
    fill = (gaps // np.uint64(_FILL)).astype(np.int64)
    if fill.sum() > 2 * len(values):
        return b"\x01" + values.astype("<u8").tobytes()
    out = np.full(len(values) + int(fill.sum()), _FILL, "<u2")
    out[np.cumsum(fill + 1) - 1] = gaps % np.uint64(_FILL)
    return b"\x00" + out.tobytes()


def _unpack_sorted(binary: bytes) -> np.ndarray:
    if binary[:1] == b"\x01":
        return np.frombuffer(binary, "<u8", offset=1)
    gaps = np.frombuffer(binary, "<u2", offset=1)
    return np.cumsum(gaps, dtype=np.uint64)[gaps != _FILL]


def _anchor_requests(table: DataFrame, window: int, buckets: int, span: int) -> DataFrame:
    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in incoming:
            for name, batch in _read(held, window):
                place, whole, aligned = batch.anchors(buckets, span)
                marked = np.sort(place[whole] * np.uint64(2) + aligned[whole])
                if not len(marked):
                    continue
                key = marked >> np.uint64(1)
                head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                many = np.diff(np.r_[head, len(key)]) > 1
                blocks = np.add.reduceat((marked & np.uint64(1)).astype(np.int64), head)
                codes = (np.minimum(blocks, 2) + 4 * many).astype(np.uint8)
                key = key[head]
                bucket = key // np.uint64(span)
                edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
                rows = [(int(bucket[a]), name, _pack_sorted(key[a:b] % np.uint64(span)), codes[a:b].tobytes()) for a, b in zip(edge[:-1], edge[1:])]
                arrays = [pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["bucket", "batch", "contents", "codes"])

    return table.select("batch", "texts", "ids", "sizes").mapInArrow(run, "bucket long, batch long, contents binary, codes binary")


def _anchor_answers(group: pa.Table) -> pa.Table:
    """Per batch, the contents that are a block exactly once or more often, where that matters to it."""
    contents = [_unpack_sorted(c) for c in group.column("contents").to_pylist()]
    codes = [np.frombuffer(c, np.uint8) for c in group.column("codes").to_pylist()]
    every, blocks = np.concatenate(contents), np.concatenate(codes) & 3
    is_block = blocks > 0
    value, at = np.unique(every[is_block], return_inverse=True)
    total = np.bincount(at, weights=blocks[is_block], minlength=len(value)).astype(np.int64)
    bucket, out = group.column("bucket")[0].as_py(), []
    for name, mine, code in zip(group.column("batch").to_pylist(), contents, codes):
        spot = np.minimum(np.searchsorted(value, mine), max(len(value) - 1, 0))
        count = np.where(value[spot] == mine, total[spot], 0) if len(value) else np.zeros(len(mine), np.int64)
        once = (count == 1) & ((code & 3 == 0) | (code & 4 > 0))
        if once.any() or (count > 1).any():
            out.append((name, bucket, _pack_sorted(mine[once]), _pack_sorted(mine[count > 1])))
    names, types = ("batch", "bucket", "once", "often"), (pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.table({n: pa.array([o[i] for o in out], t) for i, (n, t) in enumerate(zip(names, types))})


# Whole windows -----------------------------------------------------------------------


def _among(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Whether each value is in ``wanted``, which is sorted."""
    if not len(wanted):
        return np.zeros(len(values), bool)
    return wanted[np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)] == values


def _answered(answers: list[dict] | None, name: str, span: int) -> np.ndarray:
    parts = [_unpack_sorted(a[name]) + np.uint64(a["bucket"] * span) for a in answers or []]
    return np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def _entry(words: int) -> np.dtype:
    """Identity of a window: more bits where more windows could meet by chance."""
    return np.dtype([("high", "<u8"), ("low", "<u2" if words <= _MANY_WORDS else "<u8")])


def _window_requests(table: DataFrame, window: int, buckets: int, span: int, finals: int, kind: np.dtype) -> DataFrame:
    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in incoming:
            for (name, batch), answers in zip(_read(held, window), held.column("answers").to_pylist()):
                place, whole, aligned = batch.anchors(buckets, span)
                hit = _among(place, _answered(answers, "often", span)) | (_among(place, _answered(answers, "once", span)) & ~aligned)
                upto = np.r_[0, np.cumsum(hit & whole)]
                at = np.flatnonzero(batch.left >= window)
                at = at[upto[at + window - batch.block + 1] > upto[at]]
                if not len(at):
                    continue
                entry = batch.entries(at, kind)
                # Words are in order of (doc_id, start), so a stable sort puts the first place first.
                order = np.lexsort((np.arange(len(at)), entry["low"], entry["high"]))
                ranked = entry[order]
                first = np.sort(order[np.r_[True, ranked[1:] != ranked[:-1]]])
                entry, at = entry[first], at[first]
                bucket = (entry["high"] % np.uint64(finals)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                edge = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0, True])
                rows = []
                for a, b in zip(edge[:-1], edge[1:]):
                    some = order[a:b]
                    ids, starts = batch.id[at[some]], batch.start[at[some]]
                    rows.append((int(bucket[some[0]]), name, entry[some].tobytes(), np.diff(ids, prepend=0).astype("<i8").tobytes(), starts.astype("<u4").tobytes()))
                arrays = [pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["bucket", "batch", "entries", "ids", "starts"])
        release()

    return table.mapInArrow(run, "bucket long, batch long, entries binary, ids binary, starts binary")


def _window_answers(kind: np.dtype, group: pa.Table) -> pa.Table:
    """Per batch, the windows whose first place lies before its own."""
    entries = [np.frombuffer(e, kind) for e in group.column("entries").to_pylist()]
    owner = np.repeat(np.arange(len(entries)), [len(e) for e in entries])
    entry = np.concatenate(entries)
    ids = np.concatenate([np.cumsum(np.frombuffer(i, "<i8")) for i in group.column("ids").to_pylist()])
    starts = np.concatenate([np.frombuffer(s, "<u4") for s in group.column("starts").to_pylist()])
    order = np.lexsort((starts, ids, entry["low"], entry["high"]))
    entry, ids, starts, owner = entry[order], ids[order], starts[order], owner[order]
    head = np.r_[True, entry[1:] != entry[:-1]]
    first = np.flatnonzero(head)[np.cumsum(head) - 1]
    late = (ids != ids[first]) | (starts != starts[first])
    owner, entry = owner[late], entry[late]
    order = np.argsort(owner, kind="stable")
    owner, entry = owner[order], entry[order]
    edge = np.searchsorted(owner, np.arange(len(entries) + 1))
    names = group.column("batch").to_pylist()
    kept = [(names[k], entry[a:b].tobytes()) for k, (a, b) in enumerate(zip(edge[:-1], edge[1:])) if b > a]
    return pa.table({"batch": pa.array([k[0] for k in kept], pa.int64()), "late": pa.array([k[1] for k in kept], pa.binary())})


def _covered(batch: _Batch, late: np.ndarray) -> np.ndarray:
    """Which words lie in a window that starts earlier somewhere; ``late`` are those that other batches have first."""
    window = batch.window
    at = np.flatnonzero(batch.left >= window)
    mark = np.zeros(batch.n + 1, np.int64)
    if len(at):
        entry = np.concatenate([batch.entries(at, late.dtype), late])
        # The sort is stable, so the first of equal windows is the earliest of this batch.
        order = np.lexsort((entry["low"], entry["high"]))
        entry = entry[order]
        head = np.r_[True, entry[1:] != entry[:-1]]
        group = np.cumsum(head) - 1
        answered = np.bincount(group, weights=order >= len(at)) > 0
        mine = order < len(at)
        # A group of answers alone has no window here.
        first = at[np.minimum(order[head], len(at) - 1)][group[mine]]
        place = at[order[mine]]
        gone = place[answered[group[mine]] | (batch.id[place] != batch.id[first]) | (batch.start[place] != batch.start[first])]
        mark[gone] += 1
        mark[gone + window] -= 1
    return np.cumsum(mark)[:-1] > 0


def _rewrite(table: DataFrame, window: int, row_type: T.DataType, whole: bool, kind: np.dtype) -> DataFrame:
    schema = T.StructType().add("row", row_type).add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string").add("text", "string")

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for held in incoming:
            for i, (_, batch) in enumerate(_read(held, window, keep=True)):
                parts = [np.frombuffer(p, kind) for p in held.column("late")[i].as_py() or []]
                covered = _covered(batch, np.concatenate(parts) if parts else np.zeros(0, kind))
                out, at = [], 0
                for raw, words in zip(batch.raw, batch.words):
                    mine = covered[at : at + len(words)]
                    at += len(words)
                    removed = int(mine.sum())
                    kept = b" ".join(compress(words, (~mine).tolist()) if removed else words)
                    text = None
                    if whole:
                        text = kept if removed else raw
                    out.append((len(words), removed, hashlib.sha256(kept).hexdigest(), None if text is None else text.decode()))
                rows = held.column("rows")[i].values
                arrays = [rows, *[pa.array([o[k] for o in out], arrow.field(k + 1).type) for k in range(4)]]
                yield pa.RecordBatch.from_arrays(arrays, schema=pa.schema([pa.field("row", rows.type), *list(arrow)[1:]]))
        release()

    return table.mapInArrow(run, schema)


REPORT = ("n_words", "n_removed", "kept_sha256")


def deduplicate(docs: DataFrame, window: int = WINDOW, whole: bool = True, report: bool = True) -> DataFrame:
    """Columns of ``docs`` with ``text`` cleaned, then n_words, n_removed and kept_sha256.

    A text that loses nothing stays as written; another becomes its kept words
    joined by one space. ``whole=False`` leaves the text null. The report
    replaces input columns of its names; ``report=False`` leaves it out.
    """
    if window < 2:
        raise ValueError("a window needs two words at least")
    table = checkpoint(batches(docs))
    row_type = table.schema["rows"].dataType.elementType
    size = table.agg(F.sum("words"), F.count(F.lit(1))).first()
    total, count = size[0] or 0, max(size[1], 1)
    buckets = max(4 * width(docs.sparkSession), total // BUCKET_WORDS)
    # Wide enough that one false hit comes with 512 windows at most, and for 16-bit gaps.
    blocks = total // (window // 2) // buckets + 1
    span = 1 << max(512 * blocks, (1 << 14) * (total // (buckets * count) + 1)).bit_length()
    asked = _anchor_requests(table, window, buckets, span)
    answers = asked.groupBy("bucket").applyInArrow(_anchor_answers, "batch long, bucket long, once binary, often binary")
    by_batch = answers.groupBy("batch").agg(F.collect_list(F.struct("bucket", "once", "often")).alias("answers"))
    # Both joins are left joins over all columns, so that Spark reuses one exchange of the texts.
    probed = table.join(by_batch, "batch", "left")
    finals = max(2 * width(docs.sparkSession), total // (4 * BUCKET_WORDS))
    kind = _entry(total)
    asked = _window_requests(probed, window, buckets, span, finals, kind)
    late = asked.groupBy("bucket").applyInArrow(lambda group: _window_answers(kind, group), "batch long, late binary")
    late = late.groupBy("batch").agg(F.collect_list("late").alias("late"))
    out = _rewrite(table.join(late, "batch", "left"), window, row_type, whole, kind)
    own = REPORT if report else ()
    kept = [F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c not in own]
    return out.select(*kept, *own)
