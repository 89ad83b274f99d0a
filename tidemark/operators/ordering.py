"""Row order at scale: positions, running totals, neighbouring rows.

Nothing here sorts a whole series in one task. Rows are range partitioned by
(series, order key), so a single long series spreads over all partitions, and
totals of earlier partitions are carried over as one small row per partition.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import checkpoint

PART = "_part"
SPOT = "_spot"
BUCKET = "_bucket"
BUCKET_ROWS = 65_536
BROADCAST_ROWS = 100_000
SMALL_GROUP = 1_000_000
HOT_ROWS = 1_000_000

_FOLDS = {"sum": F.sum, "max": F.max, "min": F.min}


def lay_out(df: DataFrame, order: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """Range partition by (within, order) and record the partition as a column.

    ``order`` must be unique inside ``within``. The table written here pins the
    layout: a recomputed range sample could move rows between partitions. Rows
    are numbered inside their partition as they are written, see :func:`ordinal`.
    """
    by = [F.col(c) for c in (*within, *order)]
    ranged = df.repartitionByRange(*by).sortWithinPartitions(*by)
    spot = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return checkpoint(ranged.withColumns({PART: F.spark_partition_id(), SPOT: spot}))


def unique_order(laid: DataFrame, order: Sequence[str], within: Sequence[str] = (), day: str | None = None) -> DataFrame:
    """Raise where two rows of a series share their place in ``order``, or the date of ``day``.

    Rows with equal keys lie in one partition, so each is compared with the row
    before it there. The check sits in the partition column, which every
    position is made of.
    """
    scan = Window.partitionBy(*within, PART).orderBy(*order)
    here = F.struct(*order)
    bad = F.when(F.lag(here).over(scan).eqNullSafe(here), F.raise_error(F.lit(f"rows share {', '.join(order)}; name more columns to order them")))
    if day is not None:
        date = F.col(day).cast("date")
        bad = F.coalesce(bad, F.when(F.lag(date).over(scan) == date, F.raise_error(F.lit(f"two rows on one day of {day}"))))
    return laid.withColumn(PART, F.coalesce(bad.cast("int"), F.col(PART)))


def running(
    laid: DataFrame,
    order: Sequence[str],
    totals: Mapping[str, tuple[Column, str]],
    within: Sequence[str] = (),
) -> DataFrame:
    """Add inclusive running totals ``{name: (value, "sum"|"max"|"min")}``.

    ``laid`` comes from :func:`lay_out`. Each partition is scanned on its own;
    a (series, partition) pair needs a carry only if the series began in an
    earlier partition, so the carry table has fewer rows than partitions.
    """
    scan = (
        Window.partitionBy(*within, PART)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = laid.withColumns(
        {name: _FOLDS[kind](value).over(scan) for name, (value, kind) in totals.items()}
    )
    earlier = (
        Window.partitionBy(*within or [F.lit(0)])
        .orderBy(PART)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = laid.groupBy(*within, PART).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[_FOLDS[kind](value).alias(f"_c_{name}") for name, (value, kind) in totals.items()],
    )
    carry = carry.select(
        *[F.col(c).alias(f"_w_{c}") for c in within],
        F.col(PART).alias("_w_part"),
        F.sum("_rows").over(earlier).alias("_rows"),
        *[
            _FOLDS[kind](f"_c_{name}").over(earlier).alias(f"_c_{name}")
            for name, (_, kind) in totals.items()
        ],
    ).filter(F.col("_rows").isNotNull())
    match = F.col(PART) == F.col("_w_part")
    for c in within:
        match = match & F.col(c).eqNullSafe(F.col(f"_w_{c}"))
    out = local.join(F.broadcast(carry), match, "left")
    for name, (_, kind) in totals.items():
        here, before = F.col(name), F.col(f"_c_{name}")
        if kind == "sum":
            both = F.coalesce(here, F.lit(0)) + F.coalesce(before, F.lit(0))
        else:
            both = (F.greatest if kind == "max" else F.least)(here, before)
        out = out.withColumn(name, both)
    return out.select(*[c for c in laid.columns if c != SPOT], *totals)


def ordinal(
    df: DataFrame, order: Sequence[str], within: Sequence[str] = (), name: str = "idx"
) -> DataFrame:
    """Sort by ``order`` and number rows 0, 1, ... inside each ``within`` group."""
    laid = lay_out(df, order, within)
    # A (series, partition) pair is a run of rows numbered as they were written,
    # so only the rows ahead of the run are missing: no second shuffle.
    runs = laid.groupBy(*within, PART).agg(F.min(SPOT).alias("_top"), F.count(F.lit(1)).alias("_rows"))
    earlier = (
        Window.partitionBy(*within or [F.lit(0)])
        .orderBy(PART)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = runs.select(
        *[F.col(c).alias(f"_w_{c}") for c in within],
        F.col(PART).alias("_w_part"),
        (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_top")).alias("_add"),
    )
    match = F.col(PART) == F.col("_w_part")
    for c in within:
        match = match & F.col(c).eqNullSafe(F.col(f"_w_{c}"))
    few = checkpoint(carry)
    few = F.broadcast(few) if few.count() <= BROADCAST_ROWS else few
    return laid.join(few, match).withColumn(name, F.col(SPOT) + F.col("_add")).select(*df.columns, name)


def keyed(df: DataFrame, series: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Give a table without a series key one constant key column."""
    if series:
        return df, list(series)
    return df.withColumn("_all", F.lit(0)), ["_all"]


def attach(df: DataFrame, facts: DataFrame, series: Sequence[str]) -> DataFrame:
    """Add one row of facts per series to every row of that series.

    Without a series key the single row becomes literals. Otherwise the facts
    are broadcast when a count shows them to be few; larger fact tables take
    :func:`join_skewed`.
    """
    if not series:
        row = facts.first()
        fields = {f.name: f.dataType for f in facts.schema.fields}
        return df.withColumns({n: F.lit(row[n]).cast(t) for n, t in fields.items()})
    facts = checkpoint(facts)
    if facts.count() <= BROADCAST_ROWS:
        return df.join(F.broadcast(facts), list(series), "inner")
    return join_skewed(df, facts, series)


def join_skewed(df: DataFrame, table: DataFrame, on: Sequence[str], weight: str | None = None) -> DataFrame:
    """Inner join with a table of unique keys when a few keys may hold most of ``df``.

    Keys with more than ``HOT_ROWS`` rows are few, so their part of the table
    is broadcast (behind a count) and their rows stay where they are; all other
    rows are shuffled. ``weight`` names a column of ``table`` with the number
    of rows per key, if it is known.
    """
    keys = list(on)
    extra = [c for c in table.columns if c not in keys]
    if weight:
        hot = table.filter(F.col(weight) > HOT_ROWS)
    else:
        many = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_many")).filter(F.col("_many") > HOT_ROWS)
        hot = table.join(many.select(*keys), keys, "left_semi")
    hot = checkpoint(hot)
    found = hot.count()
    if not 0 < found <= BROADCAST_ROWS:
        return df.join(table, keys)
    out = [*df.columns, *extra]
    tagged = df.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), keys, "left")
    cold = tagged.filter("_hot IS NULL").select(*df.columns).join(table, keys).select(*out)
    return tagged.filter("_hot").select(*out).unionByName(cold)


def side_by_side(df: DataFrame, keys: Sequence[str], groups: int) -> DataFrame:
    """Partition by group ahead of costly work on each group.

    Adaptive execution sizes tasks by bytes and would put many small but slow
    groups into one; a stated number of partitions is left alone.
    """
    spark = df.sparkSession
    most = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(max(1, min(4 * groups, most)), *keys)


def bucket_rows(reach: int, size: int | None = None) -> int:
    """Bucket length for windows that look ``reach`` rows away."""
    size = size or max(BUCKET_ROWS, 8 * reach)
    if reach > size:
        raise ValueError(f"a bucket of {size} rows cannot see {reach} rows away")
    return size


def with_halo(
    df: DataFrame, size: int, before: int = 0, after: int = 0, idx: str = "idx"
) -> DataFrame:
    """Split a series into buckets of ``size`` rows plus copies of their neighbours.

    A bucket also receives the ``before`` rows ahead of it and the ``after``
    rows behind it, so windows of that reach never cross a bucket. ``_own`` is
    false on copies.
    """
    home = F.expr(f"{idx} div {size}")
    offset = F.expr(f"{idx} % {size}")
    targets = [home]
    if before:
        targets.append(F.when(offset >= size - before, home + 1))
    if after:
        targets.append(F.when((offset < after) & (home > 0), home - 1))
    out = df.withColumn(BUCKET, F.explode(F.array_compact(F.array(*targets))))
    return out.withColumn("_own", F.col(BUCKET) == home)


def with_lag(
    df: DataFrame,
    columns: Mapping[str, tuple[str, int]],
    series: Sequence[str] = (),
    idx: str = "idx",
    size: int | None = None,
) -> DataFrame:
    """Add earlier (k > 0) or later (k < 0) values: ``{out: (column, k)}``."""
    before = max([k for _, k in columns.values()] + [0])
    after = max([-k for _, k in columns.values()] + [0])
    size = bucket_rows(max(before, after), size)
    spread = with_halo(df, size, before, after, idx)
    window = Window.partitionBy(*series, BUCKET).orderBy(idx)
    lagged = spread.withColumns(
        {out: F.lag(c, k).over(window) for out, (c, k) in columns.items()}
    )
    return lagged.filter("_own").drop("_own", BUCKET)


def time_groups(
    df: DataFrame, groups: int, series: Sequence[str] = (), idx: str = "idx"
) -> DataFrame:
    """Add ``part`` (contiguous near-equal groups, larger ones first) and ``position`` in 0..1.

    Uses ``min(rows, groups)`` groups. Both follow from the row position, so
    no sort is needed beyond the one that made ``idx``.
    """
    if groups < 1:
        raise ValueError("groups must be positive")
    n = F.col("_n")
    facts = df.groupBy(*series).agg(F.count(F.lit(1)).alias("_n"))
    df = attach(df, facts, series).withColumn("_g", F.least(n, F.lit(groups)))
    cut = F.expr("(_n % _g) * (_n div _g + 1)")
    part = F.when(F.col(idx) < cut, F.expr(f"{idx} div (_n div _g + 1)")).otherwise(
        F.expr("_n % _g") + F.expr(f"({idx} - (_n % _g) * (_n div _g + 1)) div (_n div _g)")
    )
    position = F.when(n > 1, F.col(idx) / (n - 1)).otherwise(F.lit(0.0))
    return df.withColumns({"part": part + 1, "position": position}).drop("_n", "_g")


def slice_rows(
    df: DataFrame,
    start: int = 0,
    stop: int | None = None,
    series: Sequence[str] = (),
    idx: str = "idx",
) -> DataFrame:
    """Positional slice ``[start:stop]``; a negative ``stop`` drops rows at the end."""
    kept = df.filter(F.col(idx) >= start)
    if stop is None:
        return kept
    if stop >= 0:
        return kept.filter(F.col(idx) < stop)
    facts = df.groupBy(*series).agg(F.count(F.lit(1)).alias("_n"))
    return attach(kept, facts, series).filter(F.col(idx) < F.col("_n") + stop).drop("_n")


def quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    name: str = "feature",
    small_group: int = SMALL_GROUP,
) -> DataFrame:
    """Exact interpolated quantiles as ``(*by, feature, q)`` with ``q`` an array.

    The built-in exact percentile keeps the distinct values of a group in one
    task, so it serves only while a count shows every group to have at most
    ``small_group`` rows.
    Otherwise equal values are counted first, then ranked with a running
    total, and neither a hot value nor a hot group ends up in one task.
    """
    largest = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0]
    if (largest or 0) <= small_group:
        wanted = [float(p) for p in probs]
        wide = df.groupBy(*by).agg(*[F.percentile(F.col(c).cast("double"), wanted).alias(f"_q{i}") for i, c in enumerate(columns)])
        rows = F.array(*[F.struct(F.lit(c).alias(name), F.col(f"_q{i}").alias("q")) for i, c in enumerate(columns)])
        return wide.select(*by, F.inline(rows)).filter("q IS NOT NULL")
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).cast("double").alias("v")) for c in columns])
    )
    long = df.select(*by, pairs.alias("_p")).select(*by, F.col("_p.f").alias(name), F.col("_p.v").alias("v"))
    keys = [*by, name]
    counts = long.filter("v IS NOT NULL").groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("w"))
    laid = lay_out(counts, ["v"], keys)
    ranked = running(laid, ["v"], {"upto": (F.col("w"), "sum")}, keys)
    totals = laid.groupBy(*keys).agg(F.sum("w").alias("n"))
    ranked = attach(ranked, totals, keys)
    wanted = F.array(*[F.lit(float(p)) for p in probs])
    spot = F.posexplode(wanted).alias("i", "p")
    picked = ranked.select(*keys, "v", "w", "upto", "n", spot).withColumn("r", F.col("p") * (F.col("n") - 1))
    first, last = F.col("upto") - F.col("w"), F.col("upto") - 1
    low = (F.floor("r") >= first) & (F.floor("r") <= last)
    high = (F.ceil("r") >= first) & (F.ceil("r") <= last)
    found = picked.filter(low | high).groupBy(*keys, "i", "r").agg(
        F.max(F.when(low, F.col("v"))).alias("lo"), F.max(F.when(high, F.col("v"))).alias("hi")
    )
    value = F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("r") - F.floor("r"))
    return found.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", value.alias("q")))), lambda s: s["q"]).alias("q")
    )
