"""End-to-end flows: event scores on winter days, and the full regime analysis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.autocorrelation import seasonality_check
from tidemark.operators.cleaning import encode_labels
from tidemark.operators.decomposition import eeof_deseasonalise, ssa_deseasonalise
from tidemark.operators.events import label_events
from tidemark.operators.filters import WINTER, season
from tidemark.operators.hierarchy import cut, linkage
from tidemark.operators.joins import join_on
from tidemark.operators.ordering import ordinal
from tidemark.operators.scaling import scale
from tidemark.operators.scores import agreement
from tidemark.operators.selection import gap_choice, gap_statistic
from tidemark.session import checkpoint


def winter_events(
    daily: DataFrame,
    warming: DataFrame,
    time: str = "string",
    ar_limit: float = 2.4,
    latitude_limit: float = 66,
    days: int = 7,
    features: Sequence[str] = ("area", "ar", "latcent"),
) -> DataFrame:
    """Winter rows with scaled features and threshold events: the smallest useful flow."""
    both = join_on(daily, warming, time, "left", (None, "_msw"))
    scaled = scale(checkpoint(season(both, time)), features)
    return label_events(scaled, time, ar_limit=ar_limit, latitude_limit=latitude_limit, days=days)


def event_scores(
    events: DataFrame, regime: str = "split", truth: str = "form", true_value="S", time: str = "string"
) -> DataFrame:
    """Scores of the rows of one regime against a flag column."""
    return agreement(events, truth, ["regime"], time, regime, true_value)


def regime_analysis(
    daily: DataFrame,
    warming: DataFrame,
    time: str = "string",
    wind: str = "u",
    truth: str = "form",
    months: Sequence[int] = WINTER,
    ssa_window: int = 120,
    eeof_window: int = 400,
    components: int = 4,
    k: int | None = 3,
    k_max: int = 10,
    replicates: int = 10,
    method: str = "complete",
):
    """Join, season, scale, check, deseasonalise the wind, choose k, cluster, score.

    Returns ``(rows, checks, k)``: winter rows with raw, scaled and filtered
    columns and their label; the seasonality table; the cluster count. Rows
    with a missing measurement stay, without a label. The series that is
    scaled, decomposed and clustered has only complete rows, so the rows on
    either side of a gap are neighbours there.
    """
    both = join_on(daily, warming, time, "left", ("_d", "_msw"))
    every = checkpoint(season(encode_labels(both, truth), time, months))
    raw = ["area", "ar", "latcent", wind]
    scaled = checkpoint(scale(ordinal(every.na.drop(subset=raw), [time]), raw))
    checks = seasonality_check(scaled, [f"scaled_{c}" for c in raw])
    filtered = ssa_deseasonalise(scaled, f"scaled_{wind}", ssa_window, components)
    filtered = checkpoint(eeof_deseasonalise(filtered, f"scaled_{wind}", eeof_window, components))
    chosen = ["scaled_ar", "scaled_latcent", f"eeof_scaled_{wind}"]
    if k is None:
        k = gap_choice(gap_statistic(filtered, chosen, "idx", k_max, replicates, method), start_k=2).first()["k"]
        if k is None:
            raise ValueError("the gap statistic settles on no cluster count")
    labels = cut(linkage(filtered, chosen, "idx", method), [k])
    labelled = filtered.join(labels.select("idx", F.col("label").alias("y")), "idx")
    found = labelled.select(time, *[c for c in labelled.columns if c not in every.columns])
    return every.join(found, time, "left"), checks, k
