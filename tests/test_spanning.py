import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from test_clustering import ABC, frame, greedy
from tidemark.operators import blocks, hierarchy, ordering, spanning


@pytest.mark.parametrize("block,limit", [(2048, 200_000), (5, 2)])
def test_cuts_equal_greedy(spark, rng, block, limit):
    x = rng.normal(size=(36, 3))
    heights, parts = greedy(x, "single")
    tree = spanning.spanning_tree(frame(spark, x), ABC, "id", block=block, limit=limit)
    assert np.allclose(np.sort([r.d for r in tree.edges.collect()]), heights)
    labels = spanning.cut(tree, [1, 3, 6]).toPandas()
    for k in (1, 3, 6):
        assert labels[labels.k == k].sort_values("id").label.tolist() == parts[k].tolist()
    line = float(np.mean(heights[-4:-2]))
    names = spanning.cut_height(tree, line).toPandas().sort_values("id").cluster
    assert pd.factorize(names)[0].tolist() == parts[4 if heights[-4] <= line < heights[-3] else 0].tolist()


def test_chain_of_growing_gaps_takes_few_rounds(spark):
    """Nearest neighbours merge one pair a round on such a chain; spanning rounds halve the components."""
    x = (np.cumsum(1.0 + np.arange(200) / 50))[:, None]
    tree = spanning.spanning_tree(frame(spark, x), ["a"], "id", block=16)
    assert len(tree.met) <= 8
    got = sorted((r.a, r.b) for r in tree.edges.collect())
    assert got == [(i, i + 1) for i in range(199)]


def test_far_blocks_never_meet(spark, rng):
    # Sixteen tight groups far apart: pairs of distant groups are left out by their boxes.
    centres = np.array([(i, j) for i in range(4) for j in range(4)]) * 1000.0
    x = (centres[:, None] + rng.normal(size=(16, 40, 2))).reshape(-1, 2)
    tree = spanning.spanning_tree(frame(spark, x), ["a", "b"], "id", block=20)
    pairs = tree.met[0][1]
    assert pairs == 32 * 31 // 2
    assert all(met < pairs / 2 for met, _ in tree.met) and tree.met[0][0] < pairs / 8
    want = hierarchy.cut(hierarchy.linkage(frame(spark, x), ["a", "b"], "id", "single"), [16, 5])
    got = spanning.cut(tree, [16, 5])
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_groups_ties_copies_and_single_rows(spark):
    rows = [("u", i, float(v)) for i, v in enumerate([0, 1, 2, 3, 10, 10, 11, 30])] + [("v", 100, 5.0), ("w", 7, 1.0), ("w", 8, 1.0)]
    df = spark.createDataFrame(rows, "g string, id long, a double")
    tree = spanning.spanning_tree(df, ["a"], "id", by=["g"], block=3, limit=2)
    got = spanning.cut(tree, [2, 3])
    want = hierarchy.cut(hierarchy.linkage(df, ["a"], "id", "single", by=["g"]), [2, 3])
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    names = {r.id: r.cluster for r in spanning.cut_height(tree, 1.0).collect()}
    assert names == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 4, 6: 4, 7: 7, 100: 100, 7: 7, 8: 7}


def test_missing_and_empty_raise(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None)], "id long, a double")
    with pytest.raises(ValueError):
        spanning.spanning_tree(df, ["a"], "id")
    with pytest.raises(ValueError):
        spanning.spanning_tree(df.limit(0), ["a"], "id")


def test_box_bounds_hold(spark, rng):
    x = rng.normal(size=(90, 3))
    points = frame(spark, x).select(F.lit(0).alias("g"), "id", F.array(*ABC).alias("_x"))
    packed = blocks.pack(blocks.along_curve(points, "_x"), ["id"], "_x", ["_z", "id"], ["g"], 16)
    held = {r.block: x[r.id] for r in packed.collect()}
    pairs = blocks.box_pairs(packed, ["g"], []).collect()
    assert len(pairs) == 15
    for r in pairs:
        d = np.linalg.norm(held[r._lo][:, None] - held[r._hi][None], axis=2)
        assert r.near <= d.min() + 1e-9 and d.max() <= r.far + 1e-9


def test_one_feature_is_a_sort(spark, rng, monkeypatch):
    """No two blocks meet; edges lead from each value to the next one, and a cut by height leaves gaps and islands."""
    for name in ("meet_some", "pack"):
        monkeypatch.setattr(spanning, name, None)
    monkeypatch.setattr(ordering, "BUCKET_ROWS", 16)
    pdf = pd.DataFrame({"id": rng.permutation(90), "g": np.arange(90) % 2, "a": rng.integers(0, 60, 90) / 4.0})
    tree = spanning.spanning_tree(spark.createDataFrame(pdf), ["a"], "id", ["g"], block=4, limit=3)
    edges, islands = [], []
    for g, part in pdf.sort_values(["a", "id"]).groupby("g"):
        leaves = part.groupby("a").id.min()
        names = leaves.to_numpy()
        ends = np.sort(np.c_[names[:-1], names[1:]], axis=1)
        edges += [(g, a, b, d) for (a, b), d in zip(ends.tolist(), np.diff(leaves.index).tolist())]
        names = part.groupby((part.a.diff() > 0.25).cumsum()).id.transform("min")
        islands += list(zip([g] * len(part), part.id, names))
    assert sorted(map(tuple, tree.edges.select("g", "a", "b", "d").collect())) == sorted(edges)
    assert sorted(map(tuple, spanning.cut_height(tree, 0.25).collect())) == sorted(islands)
