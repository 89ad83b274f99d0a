"""The grouped Lloyd iteration and the squared silhouette against numpy."""

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import lloyd, selection
from tidemark.operators.lloyd import Lloyd, lloyd_labels

ABC = list("abc")


def settled(x, labels):
    """Whether every row is nearest to the mean of its own cluster."""
    names = np.unique(labels)
    means = np.stack([x[labels == n].mean(0) for n in names])
    d = ((x[:, None] - means[None]) ** 2).sum(-1)
    return np.allclose(d[np.arange(len(x)), np.searchsorted(names, labels)], d.min(1), atol=1e-9)


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(7)
    parts = []
    # One group holds most rows; one has a single distinct row, one only two rows.
    for group, n in (("hot", 400), ("b", 60), ("c", 2), ("same", 5)):
        x = rng.normal(size=(n, 3)) * 0.1 + rng.integers(0, 3, size=(n, 1)) * 10 if group != "same" else np.ones((n, 3))
        parts.append(pd.DataFrame(x, columns=ABC).assign(g=group))
    pdf = pd.concat(parts, ignore_index=True).assign(id=lambda d: range(len(d)))
    return pdf, spark.createDataFrame(pdf).repartition(5).cache()


def test_all_groups_and_counts_together(blobs):
    pdf, df = blobs
    got = lloyd_labels(df, ABC, "id", [1, 2, 3, 5], ["g"], Lloyd(seed=3, steps=50)).toPandas()
    assert len(got) == 4 * len(pdf)
    for (group, k), part in got.groupby(["g", "k"]):
        mine = pdf[pdf.g == group].sort_values("id")
        labels = part.sort_values("id")["label"].to_numpy()
        distinct = len(mine[ABC].drop_duplicates())
        assert len(set(labels)) == min(k, distinct)
        # Clusters are numbered by their first row.
        assert list(dict.fromkeys(labels)) == sorted(set(labels))
        assert settled(mine[ABC].to_numpy(), labels)
        if k == 3 and len(mine) > 50:
            island = np.round(mine["a"].to_numpy() / 10)
            assert len(set(zip(island, labels))) == 3


def test_centres_too_many_to_broadcast(blobs, monkeypatch):
    _, df = blobs
    few = lloyd_labels(df, ABC, "id", [2, 3], ["g"]).toPandas().sort_values(["k", "id"])["label"].tolist()
    monkeypatch.setattr(lloyd, "BROADCAST_CELLS", 0)
    assert lloyd_labels(df, ABC, "id", [2, 3], ["g"]).toPandas().sort_values(["k", "id"])["label"].tolist() == few


def test_the_partitioning_does_not_matter(blobs):
    _, df = blobs
    one, two = (lloyd_labels(d, ABC, "id", [3], ["g"]).toPandas().sort_values("id")["label"].tolist() for d in (df, df.coalesce(1)))
    assert one == two


def test_without_groups_and_in_the_gap_statistic(blobs):
    pdf, df = blobs
    plain = lloyd_labels(df, ABC, "id", [3]).toPandas().sort_values("id")
    assert settled(pdf[ABC].to_numpy(), plain["label"].to_numpy())
    gaps = selection.gap_statistic(df.filter("g = 'b'"), ABC, "id", 4, 3, Lloyd(seed=1)).toPandas().sort_values("k")
    assert gaps["gap"].idxmax() == gaps.index[2]


def test_refusals(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None)], "id int, a double")
    with pytest.raises(ValueError, match="missing"):
        lloyd_labels(df, ["a"], "id", [1])
    with pytest.raises(ValueError, match="start at 1"):
        lloyd_labels(df, ["a"], "id", [0])


def plain_silhouette(x, labels):
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    scores = []
    for i, label in enumerate(labels):
        own = labels == label
        if own.sum() == 1:
            scores.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, labels == o].mean() for o in set(labels) - {label})
        scores.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return np.mean(scores)


def test_squared_silhouette(spark, rng):
    # Far from zero, where the difference of squares would lose its digits.
    x = rng.normal(size=(120, 3)) + 1e6
    labels = {k: np.r_[np.arange(k), rng.integers(0, k, 120 - k)] for k in (1, 2, 4)}
    labels[3] = np.r_[2, rng.integers(0, 2, 119)]
    x[5] = x[6]
    df = spark.createDataFrame(pd.DataFrame(x, columns=ABC).assign(id=range(120)))
    rows = [(i, k, int(l)) for k, all_ in labels.items() for i, l in enumerate(all_)]
    got = {r.k: r.silhouette for r in selection.squared_silhouette(df, ABC, "id", spark.createDataFrame(rows, "id long, k int, label int")).collect()}
    assert got[1] is None
    for k in (2, 3, 4):
        assert got[k] == pytest.approx(plain_silhouette(x - 1e6, labels[k]), abs=1e-6)
