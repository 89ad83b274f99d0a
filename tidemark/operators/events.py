"""Runs of flagged rows and threshold events with a minimum spacing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordering import (
    BUCKET_ROWS,
    PART,
    keyed,
    lay_out,
    ordinal,
    running,
    unique_order,
)
from tidemark.session import checkpoint

FOLD_EVENTS = 10_000


def _mark_runs(
    df: DataFrame, flags: dict[str, Column], time: str, keys: Sequence[str], order: Sequence[str], by_calendar: bool
) -> DataFrame:
    """Add ``idx`` and, per flag, ``run_<name>``: equal inside one run, NULL outside.

    Inside a run the position minus the count of flagged rows so far is
    constant; both are running totals. With ``by_calendar`` a gap of more than
    a day also moves that number on, because whole missing days are added to
    the position.
    """
    laid = lay_out(df, order, keys)
    laid = laid.withColumns({f"_on_{n}": F.coalesce(c, F.lit(False)) for n, c in flags.items()})
    totals = {"idx": (F.lit(1), "sum")}
    totals |= {f"_sofar_{n}": (F.col(f"_on_{n}").cast("long"), "sum") for n in flags}
    out = running(unique_order(laid, order, keys, time if by_calendar else None), order, totals, keys)
    out = out.withColumn("idx", (F.col("idx") - 1).cast("long"))
    place = F.col("idx")
    if by_calendar:
        place = F.datediff(F.col(time).cast("date"), F.lit("1800-01-01").cast("date"))
    runs = {f"run_{n}": F.when(F.col(f"_on_{n}"), (place - F.col(f"_sofar_{n}")).cast("long")) for n in flags}
    return out.withColumns(runs).drop(PART, *[f"_on_{n}" for n in flags], *[f"_sofar_{n}" for n in flags])


def _long_runs(marked: DataFrame, names: Sequence[str], time: str, keys: Sequence[str], days: int) -> DataFrame:
    """``(*keys, kind, run, start, end, start_time, last_time)``; ``end`` is exclusive.

    Grouping folds min, max and count before the shuffle, so a run as long as
    the series costs one row per task.
    """
    kinds = F.array(*[F.struct(F.lit(n).alias("kind"), F.col(f"run_{n}").alias("run")) for n in names])
    flagged = marked.select(*keys, "idx", F.col(time).alias("_t"), F.inline(kinds)).filter("run IS NOT NULL")
    return (
        flagged.groupBy(*keys, "kind", "run")
        .agg(
            F.min("idx").alias("start"), (F.max("idx") + 1).alias("end"),
            F.min("_t").alias("start_time"), F.max("_t").alias("last_time"),
        )
        .filter(F.col("end") - F.col("start") >= days)
    )


def flag_runs(
    df: DataFrame,
    flag: Column | str,
    time: str,
    days: int = 7,
    series: Sequence[str] = (),
    tie: Sequence[str] = (),
    by_calendar: bool = False,
) -> DataFrame:
    """Maximal runs of at least ``days`` true flags as ``(*series, start, end, start_time, last_time)``.

    Positions count from 0 in time order; ``end`` is exclusive; a missing flag
    is false. Runs are runs of rows, as they lie; ``by_calendar`` also breaks
    them where a day is missing, and two rows on one day raise. So do rows that
    ``time`` and ``tie`` leave in no order.
    """
    flag = F.col(flag) if isinstance(flag, str) else flag
    data, keys = keyed(df, series)
    marked = _mark_runs(data, {"flag": flag}, time, keys, [time, *tie], by_calendar)
    return _long_runs(marked, ["flag"], time, keys, days).select(
        *series, "start", "end", "start_time", "last_time"
    )


def spaced_events(events: DataFrame, keys: Sequence[str], spacing: int = 30, fold: int = FOLD_EVENTS) -> DataFrame:
    """Greedily accept events that start ``spacing`` whole days after the last accepted one ended.

    ``events`` has ``run``, ``start``, ``end``, ``kind``, ``start_time`` and
    ``last_time``. Series with at most ``fold`` events are folded in
    place. In longer ones an event that starts late enough after everything
    before it is accepted whatever happened earlier, so it opens an independent
    segment to fold. Segments that are still too long are resolved by pointer
    doubling. No step holds an unbounded group in one task.
    """
    order = ["start_time", "kind", "end", "start"]
    events = checkpoint(events)
    largest = events.groupBy(*keys).count().agg(F.max("count")).first()[0]
    if (largest or 0) <= fold:
        return _folded(events, keys, order, spacing).select(*keys, *order, "run", "last_time")
    laid = lay_out(events, order, keys)
    # Greatest last_time up to and including each event; the one before it decides.
    seen = running(laid, order, {"_rank": (F.lit(1), "sum"), "_latest": (F.col("last_time"), "max")}, keys)
    seen = checkpoint(seen)
    previous = seen.select(*keys, (F.col("_rank") + 1).alias("_rank"), F.col("_latest").alias("_before"))
    linked = seen.join(previous, [*keys, "_rank"], "left")
    opens = F.col("_before").isNull() | _apart(F.col("_before"), F.col("start_time"), spacing)
    linked = linked.withColumn("_opens", opens.cast("long"))
    segmented = running(linked, order, {"_segment": (F.col("_opens"), "sum")}, keys)
    segmented = checkpoint(segmented.drop(PART, "_opens", "_before", "_latest"))

    sizes = segmented.groupBy(*keys, "_segment").agg(F.count(F.lit(1)).alias("_size"))
    rows = segmented.join(sizes, [*keys, "_segment"])
    short = rows.filter(F.col("_size") <= fold)
    accepted = _folded(short, [*keys, "_segment"], order, spacing).select(*keys, *order, "run", "last_time")
    many = rows.filter(F.col("_size") > fold)
    if many.limit(1).count():
        accepted = accepted.unionByName(
            _doubling(many.drop("_size"), [*keys, "_segment"], order, spacing).select(*accepted.columns)
        )
    return accepted


def _folded(events: DataFrame, keys: list[str], order: list[str], spacing: int) -> DataFrame:
    """Accepted events of groups whose size the caller bounds, scanned as one sorted array."""
    found = F.array_sort(F.collect_list(F.struct(*order, "run", "last_time")))
    grouped = events.groupBy(*keys).agg(found.alias("_events"))

    def step(accepted, e):
        far = _apart(F.element_at(accepted, -1)["last_time"], e["start_time"], spacing)
        return F.when(far, F.concat(accepted, F.array(e))).otherwise(accepted)

    # The first event is always accepted, so the fold never sees an empty array.
    every = F.col("_events")
    return grouped.select(*keys, F.inline(F.aggregate(F.slice(every, 2, F.size(every)), F.slice(every, 1, 1), step)))


def _apart(earlier: Column, later: Column, days: int) -> Column:
    return later - earlier >= F.make_dt_interval(days=F.lit(days))


def _doubling(events: DataFrame, keys: list[str], order: list[str], spacing: int) -> DataFrame:
    """Accepted events of long segments by doubling the 'next accepted' pointer."""
    ranked = checkpoint(ordinal(events, order, keys, name="e"))
    # The successor of an event is the first one starting at or after its limit:
    # put limits and starts on one time line and look for the next start.
    limit = F.col("last_time") + F.make_dt_interval(days=F.lit(spacing))
    starts = ranked.select(*keys, F.col("start_time").alias("at"), F.lit(1).alias("side"), "e")
    limits = ranked.select(*keys, limit.alias("at"), F.lit(0).alias("side"), "e")
    line = lay_out(starts.unionByName(limits), ["at", "side", "e"], keys)
    counted = running(line, ["at", "side", "e"], {"before": (F.col("side").cast("long"), "sum")}, keys)
    # Starts are ranked in time order, so the count of starts so far is the rank of the next one.
    jump = counted.filter("side = 0").select(*keys, "e", F.col("before").alias("to"))
    jump = checkpoint(jump)
    reached = checkpoint(ranked.filter("e = 0").select(*keys, "e"))
    while True:
        ahead = reached.join(jump, [*keys, "e"]).select(*keys, F.col("to").alias("e"))
        ahead = ahead.join(ranked.select(*keys, "e"), [*keys, "e"], "left_semi")
        grown = checkpoint(reached.unionByName(ahead).distinct())
        if grown.count() == reached.count():
            return ranked.join(reached, [*keys, "e"], "left_semi")
        reached = grown
        hop = jump.select(*keys, F.col("e").alias("to"), F.col("to").alias("beyond"))
        jump = checkpoint(
            jump.join(hop, [*keys, "to"], "left").select(
                *keys, "e", F.coalesce("beyond", "to").alias("to")
            )
        )


def label_events(
    df: DataFrame,
    time: str = "string",
    ar: str = "ar",
    latitude: str = "latcent",
    ar_limit: float = 2.4,
    latitude_limit: float = 66,
    days: int = 7,
    spacing: int = 30,
    mark: str = "all",
    series: Sequence[str] = (),
    tie: Sequence[str] = (),
    by_calendar: bool = False,
    out: str = "regime",
    fold: int = FOLD_EVENTS,
) -> DataFrame:
    """Label rows ``displaced``, ``split`` or ``undisturbed``; adds ``idx`` and ``out``.

    Displaced: latitude at or below its limit for ``days`` rows; split: aspect
    ratio at or above its limit. ``mark`` labels all rows of an accepted event,
    its first, or its last. Events that start together go displaced first. Series
    with more than ``fold`` events are not folded in one array.
    """
    if mark not in ("all", "first", "last"):
        raise AttributeError(f"mark must be 'all', 'first' or 'last', got {mark!r}")
    data, keys = keyed(df, series)
    flags = {"displaced": F.col(latitude) <= latitude_limit, "split": F.col(ar) >= ar_limit}
    marked = checkpoint(_mark_runs(data, flags, time, keys, [time, *tie], by_calendar))
    events = _long_runs(marked, list(flags), time, keys, days)
    accepted = checkpoint(spaced_events(events, keys, spacing, fold))
    if mark == "all":
        first, last = F.col("start"), F.col("end") - 1
    else:
        first = last = F.col("start") if mark == "first" else F.col("end") - 1
    # A run is cut at bucket bounds, so even one that spans the whole series joins evenly.
    size = BUCKET_ROWS
    buckets = F.explode(F.sequence(F.floor(first / size), F.floor(last / size)))
    pieces = accepted.select(*keys, "kind", "run", first.alias("_from"), last.alias("_to"), buckets.alias("_b"))
    rows = marked.withColumn("_b", F.floor(F.col("idx") / size))
    for name in flags:
        # Rows outside a run get a number of their own instead of a shared NULL.
        rows = rows.withColumn("run", F.coalesce(F.col(f"run_{name}"), F.lit(-(2**62)) - F.col("idx")))
        mine = pieces.filter(F.col("kind") == name).select(
            *keys, "_b", "run", F.col("_from").alias(f"_f_{name}"), F.col("_to").alias(f"_t_{name}")
        )
        rows = rows.join(mine, [*keys, "_b", "run"], "left")
    label = F.lit("undisturbed")
    for name in flags:
        inside = F.col("idx").between(F.col(f"_f_{name}"), F.col(f"_t_{name}"))
        label = F.when(inside, F.lit(name)).otherwise(label)
    return rows.select(*df.columns, "idx", label.alias(out))
