"""Find collocations by dynamic itemset counting over cyclic scans of shards.

The corpus is written once in shards, which are scanned in a cycle, one shard a
step. Words are counted from the first step on. A longer phrase becomes active
in the step after both its subphrases (without the last and without the first
word) have reached the threshold, and is counted until it has met every shard
once. So lengths interleave: while words are in their first cycle, pairs of
those known to be frequent are counted along, and so on. The scan ends when no
phrase is left that has not met all shards.

Which phrases have reached the threshold goes to the tasks as two bitmaps of
fixed size, however many phrases there are: all such phrases, and those of the
last cycle. A phrase is counted in a step if both its subphrases are in the
first and one is in the second. A false hit costs a row and no error: a phrase
of an infrequent subphrase stays below the threshold itself, and a count carries
the shards it comes from, so no shard counts twice. Bits are only ever added, so
whatever turns a phrase active stays until its cycle is full. A phrase reaches
the threshold once, so a scan of ``SHARDS`` shards ends after four cycles at most.

Counts live in a table, merged with those of a step by one aggregation that sums
in the map tasks first; a frequent word is a row per task. Phrases below the
threshold leave at the end of their cycle, so the table shrinks as it goes.

Words are told apart exactly: a task numbers the words of a slice of texts by
their bytes and phrases by pairs of numbers; only the bitmaps use hashes.

Cases: a null text has no words, a null language is ``und``. Equal and repeated
rows all count. A text may be of any length; a task holds one slice of texts, or
one text that is longer. Columns other than the named ones are not read. Without
a word there is no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import release
from tidemark.session import scratch_path

LONGEST = 4
THRESHOLD = 30
SHARDS = 2
#: Size of each of the two bitmaps. More frequent phrases than an eighth of it make false hits common, not results wrong.
BITS = 1 << 26
SLICE_BYTES = 8 << 20
#: Rows that a worker sends at once.
SENT_ROWS = 1 << 15
UNKNOWN = "und"

_GAP, _BREAK = 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[ord(c) for c in " \t"]] = _GAP
_KIND[[ord(c) for c in ".,;:!?\n\v\f\r"]] = _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_STEP, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1

# A state is one number, so that merging handles a key and two numbers a row: the count, a bit for each
# shard that it comes from, the step of the first count, and one more than the step that reached the threshold.
_STATE = "key string, state long"
# Steps take 5 bits, as there are four cycles at most, shards 6, and the count the 47 that are left.
_COUNT, _SHARD, _BEGUN = 1 << 16, 1 << 10, 1 << 5
MOST_SHARDS = 6


def _seed(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode())


def _positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    mixed = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(_MIX)
    return (mixed >> np.uint64(64 - (bits.bit_length() - 1))).astype(np.int64)


def phrase_positions(langs: list[str], phrases: list[str], bits: int) -> np.ndarray:
    """Bits of given phrases, as the scan computes them from its word numbers."""
    hashes, seeds = [], {lang: _seed(lang) for lang in set(langs)}
    for lang, phrase in zip(langs, phrases):
        total = 0
        for word in phrase.split(" "):
            total = (total * _STEP + xxhash.xxh64_intdigest(word.encode(), seeds[lang])) & _MASK
        hashes.append(total)
    return _positions(np.array(hashes, np.uint64), bits)


class Reached:
    """Bitmaps of the phrases that have reached the threshold: ever, and in the last cycle."""

    def __init__(self, bits: int = BITS, shards: int = SHARDS):
        self.bits, self.shards = bits, shards
        self.steps: list[np.ndarray | None] = []
        self.ever = np.zeros(bits // 8, np.uint8)

    def add(self, cells: np.ndarray, values: np.ndarray) -> None:
        """Note the phrases of one step, as 64-bit cells of the bitmap."""
        new = None
        if len(cells):
            new = np.zeros(self.bits // 64, np.uint64)
            new[cells] = values.view(np.uint64)
            new = new.view(np.uint8)
            self.ever |= new
        self.steps = [*self.steps, new][-self.shards :]

    def late(self) -> np.ndarray | None:
        held = [s for s in self.steps if s is not None]
        return np.bitwise_or.reduce(held) if held else None


def _has(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def split_words(texts: pa.Array) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """Distinct words, the number of each word in order, and the piece that it stands in."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    held = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    letters = _LOWER[held]
    kind = _KIND[letters]
    inside = kind == 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(held)]
    first[heads] = inside[heads]
    starts = np.flatnonzero(first)
    if not len(starts):
        return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    # A piece ends at a break or at the end of a text.
    ends = np.zeros(len(held), np.int8)
    ends[kind == _BREAK] = 1
    piece = np.cumsum(ends, dtype=np.int64)[starts] + np.searchsorted(offsets, starts, side="right")
    upto = np.cumsum(inside, dtype=np.int32)
    bounds = np.empty(len(starts) + 1, np.int32)
    bounds[:-1] = upto[starts] - 1
    bounds[-1] = upto[-1]
    packed = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(letters[inside]))
    coded = packed.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), piece


def count_slice(
    texts: pa.Array, lang: str, words_too: bool, ever: np.ndarray | None, late: np.ndarray | None, bits: int
) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """``(phrases, counts)`` of what is counted in this step; the empty phrase counts all words."""
    names, ids, piece = split_words(texts)
    if not len(ids):
        return
    if words_too:
        yield pa.array([""]), np.array([len(ids)])
        counts = np.bincount(ids, minlength=len(names))
        for at in range(0, len(names), SENT_ROWS):
            yield names.slice(at, SENT_ROWS), counts[at : at + SENT_ROWS]
    if ever is None or late is None:
        return
    seed = _seed(lang)
    word_hash = np.array([xxhash.xxh64_intdigest(w, seed) for w in names.cast(pa.binary()).to_pylist()], np.uint64)
    at = _positions(word_hash, bits)
    frequent, recent = _has(ever, at), _has(late, at)
    # For every place: the phrase that starts there; for every phrase: its words and its hash.
    spots, here = np.arange(len(ids)), ids
    members, hashes = np.arange(len(names), dtype=np.int32)[:, None], word_hash
    for k in range(2, LONGEST + 1):
        # Neighbouring places whose phrases are both frequent make a phrase one word longer.
        good = frequent[here]
        pair = np.flatnonzero(good[:-1] & good[1:] & (spots[1:] == spots[:-1] + 1))
        pair = pair[piece[spots[pair]] == piece[spots[pair] + k - 1]]
        if not len(pair):
            return
        last = ids[spots[pair] + k - 1]
        key = here[pair] << 32 | last
        _, where, number, counts = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        prefix, suffix, tail = here[pair[where]], here[pair[where] + 1], last[where]
        members = np.column_stack([members[prefix], tail.astype(np.int32)])
        active = np.flatnonzero(recent[prefix] | recent[suffix])
        for first in range(0, len(active), SENT_ROWS):
            sent = active[first : first + SENT_ROWS]
            parts = [names.take(pa.array(members[sent, j])) for j in range(k)]
            yield pc.binary_join_element_wise(*parts, " "), counts[sent]
        if k == LONGEST:
            return
        hashes = hashes[prefix] * np.uint64(_STEP) + word_hash[tail]
        at = _positions(hashes, bits)
        frequent, recent = _has(ever, at), _has(late, at)
        spots, here = spots[pair], number


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array]]:
    """Texts of one language, about ``SLICE_BYTES`` at a time."""
    for batch in batches:
        for lang in pc.unique(batch.column(0)).to_pylist():
            texts = batch.column(1).filter(pc.equal(batch.column(0), lang))
            ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < len(texts):
                done = ends[at - 1] if at else 0
                upto = max(at + 1, int(np.searchsorted(ends, done + SLICE_BYTES, side="right")))
                yield lang, texts.slice(at, upto - at)
                at = upto


def _scan(shard: DataFrame, reached: Reached, step: int) -> DataFrame:
    """Counts of the phrases active in this step: ``(lang, phrase, k, c)``, a row per slice of texts."""
    words_too, bits, late = step < reached.shards, reached.bits, reached.late()
    maps = shard.sparkSession.sparkContext.broadcast((reached.ever, late) if late is not None else (None, None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in _slices(batches):
            for phrases, counts in count_slice(texts, lang, words_too, *maps.value, bits):
                keys = pc.binary_join_element_wise(lang, phrases.cast(pa.string()), "\t")
                yield pa.RecordBatch.from_arrays([keys, pa.array(counts.astype(np.int64))], names=["key", "c"])
        release()

    return shard.mapInArrow(run, "key string, c long")


def _spaces() -> Column:
    """Spaces in the phrase of a key; the language may have some of its own."""
    phrase = F.substring_index("key", "\t", -1)
    return F.length(phrase) - F.length(F.translate(phrase, " ", ""))


def _part(modulus: int, unit: int) -> Column:
    return F.expr(f"cast(state % {modulus} div {unit} as int)")


def _merge(state: DataFrame | None, found: DataFrame, step: int, shards: int, threshold: int) -> DataFrame:
    """The state after a step, without the phrases that have met every shard and stayed below the threshold."""
    rows = found.select("key", F.lit(None).cast("long").alias("state"), "c")
    if state is not None:
        rows = rows.unionByName(state.withColumn("c", F.lit(None).cast("long")))
    held = rows.groupBy("key").agg(F.max("state").alias("state"), F.sum("c").alias("c"))
    # A word, and the total of all, begin with the scan, wherever they are met first.
    single, total = _spaces() == 0, F.substring_index("key", "\t", -1) == ""
    begun = F.when(single, 0).otherwise(F.coalesce(_part(_SHARD, _BEGUN), F.lit(step)))
    met = F.coalesce(_part(_COUNT, _SHARD), F.lit(0))
    fresh = F.col("c").isNotNull() & (met.bitwiseAND(1 << (step % shards)) == 0)
    count = F.coalesce(F.expr(f"state div {_COUNT}"), F.lit(0)) + F.when(fresh, F.col("c")).otherwise(0)
    shown = held.select(
        "key", count.alias("count"), (met + F.when(fresh, 1 << (step % shards)).otherwise(0)).alias("met"), begun.alias("begun"),
        F.coalesce(_part(_BEGUN, 1), F.lit(0)).alias("old"), total.alias("total"),
    )
    reached = F.when(F.col("old") > 0, F.col("old")).when((F.col("count") >= threshold) & ~F.col("total"), F.lit(step + 1)).otherwise(0)
    now = shown.withColumn("reached", reached)
    # Frequent phrases stay, so that a false hit cannot let one begin anew.
    now = now.filter((F.col("begun") + (shards - 1) > step) | (F.col("reached") > 0) | F.col("total"))
    packed = F.col("count") * _COUNT + F.col("met") * _SHARD + F.col("begun") * _BEGUN + F.col("reached")
    return now.select("key", packed.alias("state"))


def _newly_reached(state: DataFrame, step: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmap cells of the phrases that reached the threshold in this step and may grow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [key.rsplit("\t", 1) for key in batch.column(0).to_pylist()]
            at = phrase_positions([p[0] for p in pairs], [p[1] for p in pairs], bits)
            yield pa.RecordBatch.from_arrays([pa.array(at)], names=["at"])

    new = state.filter(_part(_BEGUN, 1) == step + 1).filter(_spaces() < LONGEST - 1).select("key")
    cells = new.mapInArrow(run, "at long").groupBy(F.expr("at div 64").alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("v"))
    found = cells.toPandas()
    return found["cell"].to_numpy(np.int64), found["v"].to_numpy(np.int64)


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def frequent_phrases(
    docs: DataFrame, threshold: int = THRESHOLD, shards: int = SHARDS, bits: int = BITS, text: str = "text", lang: str = "lang"
) -> DataFrame:
    """``(lang, phrase, k, count)`` of all phrases of at most four words that occur ``threshold`` times.

    ``k`` is the number of words; the row with ``k`` 0 counts all words of the language.
    """
    if threshold < 1:
        raise ValueError("a phrase occurs once at least")
    if not 1 <= shards <= MOST_SHARDS:
        raise ValueError(f"from 1 to {MOST_SHARDS} shards")
    spark = docs.sparkSession
    corpus = scratch_path(spark, "shards")
    kept = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).alias("text"))
    kept.filter("text IS NOT NULL").withColumn("shard", F.spark_partition_id() % shards).write.partitionBy("shard").parquet(corpus)
    stored = spark.read.schema("lang string, text string, shard int").parquet(corpus)
    reached, state, path, step = Reached(bits, shards), None, None, 0
    while step < shards or reached.late() is not None:
        shard = stored.filter(F.col("shard") == step % shards).select("lang", "text")
        before, path = path, scratch_path(spark, "phrases")
        _merge(state, _scan(shard, reached, step), step, shards, threshold).write.parquet(path)
        state = spark.read.schema(_STATE).parquet(path)
        reached.add(*_newly_reached(state, step, bits))
        if before:
            # Its rows are in the new table.
            _remove(spark, before)
        step += 1
    _remove(spark, corpus)
    # Nothing is active any more, so phrases met late have been counted everywhere too.
    phrase = F.substring_index("key", "\t", -1)
    lang = F.expr("left(key, length(key) - length(substring_index(key, '\t', -1)) - 1)")
    k = F.when(phrase == "", 0).otherwise(_spaces() + 1)
    kept = state.select(lang.alias("lang"), phrase.alias("phrase"), k.alias("k"), F.expr(f"state div {_COUNT}").alias("count"), _part(_BEGUN, 1).alias("_r"))
    return kept.filter("_r > 0 OR k = 0").drop("_r")


def _words(phrase: Column, first: int | Column, count: int | Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), first, count), " ")


def collocations(
    docs: DataFrame, threshold: int = THRESHOLD, best: int = 2_000, hidden: int = 80, scale: int = 2_000_000, **options
) -> DataFrame:
    """The ``best`` phrases of each language: ``(lang, rank, phrase, a, l, r, n, score)``.

    The score is ``scale * a / (l + r)``, rounded down, at the cut where it is
    lowest. Phrases of which ``hidden`` per cent or more lie inside one longer
    phrase are left out.
    """
    counted = frequent_phrases(docs, threshold, **options)
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    known = counted.filter("k > 0").select("lang", F.col("phrase").alias("_part"), F.col("count").alias("_f"))
    found = counted.filter("k > 1").select("lang", "phrase", "k", F.col("count").alias("a"))
    # Every part of a frequent phrase is frequent, so the joins keep all cuts.
    cuts = found.select("lang", "phrase", "k", "a", F.explode(F.expr("sequence(1, k - 1)")).alias("cut"))
    sides = cuts.withColumns({"_left": _words(F.col("phrase"), F.lit(1), F.col("cut")), "_right": _words(F.col("phrase"), F.col("cut") + 1, F.col("k"))})
    for side, name in (("_left", "l"), ("_right", "r")):
        sides = sides.join(known.withColumnsRenamed({"_part": side, "_f": name}), ["lang", side])
    sides = sides.withColumn("_score", F.expr(f"(cast({scale} as decimal(10,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    lowest = sides.groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct(F.col("_score").alias("score"), "cut", "l", "r")).alias("m"))
    # The commonest longer phrase around each shorter one.
    spans = F.explode(F.expr("flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), s -> named_struct('s', s, 'm', m))))"))
    inner = found.filter("k > 2").select("lang", "phrase", "a", spans.alias("_at"))
    inner = inner.select("lang", _words(F.col("phrase"), F.col("_at.s"), F.col("_at.m")).alias("phrase"), "a")
    around = inner.groupBy("lang", "phrase").agg(F.max("a").alias("_around"))
    open_ = lowest.join(around, ["lang", "phrase"], "left")
    open_ = open_.filter(F.col("_around").isNull() | (exact("_around") * 100 < exact("a") * hidden))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    flat = open_.select("lang", "phrase", "a", "m.l", "m.r", "m.score")
    first = flat.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)
    totals = counted.filter("k = 0").select("lang", F.col("count").alias("n"))
    out = first.join(totals, "lang")
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
