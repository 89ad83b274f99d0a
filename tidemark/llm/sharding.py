"""Deal rows into shards that all hold the same mixture of sources.

Rows of a source are put in a seeded shuffled order and ranked; rank ``r`` of
``n`` rows has the fractional rank ``(r + 1/2) / n``. Sorted by it, the sources
interleave in proportion to their sizes all along the table, so any stretch of
it holds the mixture. The order is cut into stretches whose row counts differ by
one at most (the law ``rows``), and a row's slot is its place in its stretch.

Both sorts are range partitions by a key without ties that ends in the row's
number, so a source with a third of all rows, or a row repeated a million times,
spreads over all tasks. Ranks and positions are counts per partition plus the
rows written before; no source is gathered in one task. Only the columns asked
for travel.

With ``n`` rows of a source in a table of ``N``, a shard of ``m`` rows holds
``m * n / N`` of them, give or take one for every source that shares the cut.

Cases: a null source is a source. A null key or text is allowed. Repeated rows
are dealt one by one. Fewer rows than shards leave some shards empty; an empty
table gives an empty result. Equal texts may go to different shards: a group of
copies can be larger than a shard, so the law ``rows`` and whole groups exclude
each other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import columns
from tidemark.operators.ordering import attach, ordinal
from tidemark.session import checkpoint

SHARDS = 24
SEED = 20_000


def deal(
    rows: DataFrame,
    source: str = "source",
    key: str = "doc_id",
    carry: Sequence[str] = (),
    shards: int = SHARDS,
    seed: int = SEED,
) -> DataFrame:
    """``(key, *carry, shard, slot)`` for every row; ``seed`` chooses the order inside a source."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    taken = [key, *[c for c in carry if c != key]]
    named = {c: column for c, column in zip(rows.columns, columns(rows))}
    inner = [f"c{i}" for i in range(len(taken))]
    slim = rows.select(named[source].alias("_source"), *[named[c].alias(i) for c, i in zip(taken, inner)])
    slim = slim.withColumn("_luck", F.md5(F.concat_ws(":", F.lit(seed), "c0").cast("binary")))
    # Written once: the row numbers that settle all ties must not change when a task runs again.
    numbered = checkpoint(slim.withColumn("_row", F.monotonically_increasing_id()))
    ranked = ordinal(numbered, ["_luck", "_row"], ["_source"], name="_rank")
    sizes = numbered.groupBy("_source").agg(F.count(F.lit(1)).alias("_n"))
    # A null source has to find its size as well.
    known = ranked.withColumn("_s", F.struct("_source")).drop("_source")
    found = attach(known, sizes.select(F.struct("_source").alias("_s"), "_n"), ["_s"])
    placed = found.withColumn("_at", (F.col("_rank") + 0.5) / F.col("_n"))
    ordered = ordinal(placed.select(*inner, "_at", "_luck", "_row"), ["_at", "_luck", "_row"], name="_place")
    total = numbered.count()
    return ordered.select(
        *[F.col(i).alias(c) for c, i in zip(taken, inner)],
        F.expr(f"cast(_place * {shards} div {max(total, 1)} as int)").alias("shard"),
        # A shard begins at the first place that falls to it: its number times the rows, over the shards, rounded up.
        F.expr(f"_place - ((_place * {shards} div {max(total, 1)}) * {total} + {shards - 1}) div {shards}").alias("slot"),
    )


def write(dealt: DataFrame, path: str) -> None:
    """One folder per shard, its files in slot order; a large shard is written by several tasks."""
    ordered = dealt.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.write.partitionBy("shard").parquet(path)
