import numpy as np
import pandas as pd
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.sql import functions as F

from tidemark.operators import blocks, hierarchy, selection

ABC = list("abc")


def greedy(x, method):
    """Merge the closest pair first; partitions number clusters by smallest row."""
    n, clusters = len(x), {i: [i] for i in range(len(x))}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))

    def apart(a, b):
        if method == "ward":
            na, nb = len(a), len(b)
            return np.sqrt(2 * na * nb / (na + nb)) * np.linalg.norm(x[a].mean(0) - x[b].mean(0))
        cells = d[np.ix_(a, b)]
        return {"complete": cells.max, "average": cells.mean, "single": cells.min}[method]()

    heights, parts = [], {}
    while True:
        labels = np.empty(n, int)
        for j, k in enumerate(sorted(clusters, key=lambda k: min(clusters[k]))):
            labels[clusters[k]] = j
        parts[len(clusters)] = labels
        if len(clusters) == 1:
            return heights, parts
        height, a, b = min((apart(clusters[a], clusters[b]), a, b) for a in clusters for b in clusters if a < b)
        clusters[a] = clusters[a] + clusters.pop(b)
        heights.append(height)


def frame(spark, x):
    return spark.createDataFrame(pd.DataFrame(x, columns=ABC[: x.shape[1]]).assign(id=range(len(x)))).cache()


@pytest.mark.parametrize("method,finish,block", [
    ("complete", 3000, 2048), ("average", 3000, 2048), ("single", 3000, 2048), ("ward", 3000, 2048),
    ("complete", 12, 7), ("average", 20, 7), ("single", 30, 16), ("ward", 20, 16),
])
def test_tree_equals_greedy(spark, rng, method, finish, block):
    x = rng.normal(size=(36, 3))
    heights, parts = greedy(x, method)
    tree = hierarchy.linkage(frame(spark, x), ABC, "id", method, finish=finish, block=block)
    assert (tree.rounds > 0) == (finish < 36)
    assert np.allclose(np.sort([r.height for r in tree.merges.collect()]), heights)
    labels = hierarchy.cut(tree, [1, 3, 6]).toPandas()
    for k in (1, 3, 6):
        assert labels[labels.k == k].sort_values("id").label.tolist() == parts[k].tolist()
    table = hierarchy.merge_table(tree).toPandas().sort_values("step")
    sizes = {i: 1 for i in range(36)}
    for r in table.itertuples():
        sizes[36 + r.step] = sizes.pop(r.left) + sizes.pop(r.right)
        assert sizes[36 + r.step] == r.size
    assert list(sizes.values()) == [36] and (np.diff(table.height) >= 0).all()
    line = np.mean(heights[-4:-2])
    below = hierarchy.cut_height(tree, line).toPandas().sort_values("id").cluster
    want = parts[36 - sum(h <= line for h in heights)]
    assert below.tolist() == [int(np.flatnonzero(want == c)[0]) for c in want]
    top = hierarchy.tree_levels(hierarchy.merge_table(tree), 1).toPandas()
    assert top[top.depth == 0].step.tolist() == [34] and len(top) <= 3


@pytest.mark.parametrize("method,finish", [("average", 3000), ("ward", 3000), ("complete", 20)])
def test_copies_and_groups(spark, rng, method, finish):
    x = rng.normal(size=(25, 3))
    x = np.vstack([x, x, np.repeat(x[:1], 20, axis=0)])
    y = rng.normal(size=(1, 3))
    pdf = pd.concat([pd.DataFrame(v, columns=ABC).assign(id=range(len(v)), g=g) for g, v in (("x", x), ("y", y))])
    tree = hierarchy.linkage(spark.createDataFrame(pdf), ABC, "id", method, ["g"], finish=finish, block=8)
    labels = hierarchy.cut(tree, [4]).toPandas()
    assert labels[labels.g == "x"].sort_values("id").label.tolist() == greedy(x, method)[1][4].tolist()
    assert labels[labels.g == "y"].label.tolist() == [0]


def test_linkage_checks(spark):
    df = spark.createDataFrame([(0, 1.0), (1, None)], "id long, a double")
    with pytest.raises(ValueError):
        hierarchy.linkage(df, ["a"], "id")
    with pytest.raises(ValueError):
        hierarchy.linkage(df.na.drop(), ["a"], "id", "median")
    with pytest.raises(ValueError):
        hierarchy.cut(hierarchy.linkage(df.na.drop(), ["a"], "id"), [0])


def test_distances(rng):
    for d in (3, 40):
        a, b = rng.normal(size=(20, d)), rng.normal(size=(11, d))
        assert np.allclose(blocks.distances(a, b), np.linalg.norm(a[:, None] - b[None], axis=-1))


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(5)
    x = rng.uniform(-10, 10, size=(3, 3))[rng.integers(0, 3, 120)] + rng.normal(size=(120, 3)) * 0.7
    x[10] = x[3]
    df = frame(spark, x)
    labels = hierarchy.cut(hierarchy.linkage(df, ABC, "id"), range(1, 6)).toPandas().sort_values("id")
    return x, df, {k: labels[labels.k == k].label.to_numpy() for k in range(1, 6)}


def sse(x, labels):
    return sum(((x[labels == c] - x[labels == c].mean(0)) ** 2).sum() for c in set(labels))


def test_dispersion(spark, blobs):
    x, df, labels = blobs
    d2 = ((x[:, None] - x[None]) ** 2).sum(-1)
    want = sum(d2[np.ix_(labels[3] == c, labels[3] == c)].sum() / 2 / (2 * (labels[3] == c).sum()) for c in range(3))
    df = df.join(spark.createDataFrame(pd.DataFrame({"id": range(120), "y": labels[3]})), "id")
    assert np.isclose(selection.dispersion(df, ABC, "y").first()[0], want)
    packed = df.select(F.array(*ABC).alias("v"), "y")
    assert np.isclose(selection.dispersion(packed, "v", "y").first()[0], want)
    same = spark.createDataFrame([(1.0, 2.0, 0)] * 4, "a double, b double, y int")
    assert selection.dispersion(same, ["a", "b"], "y").first()[0] == 0


def test_reference_sample(spark, blobs):
    x, df, _ = blobs
    got = selection.reference_sample(df, ABC, "id", 2, 3).toPandas()
    again = selection.reference_sample(df.repartition(7), ABC, "id", 2, 3).toPandas()
    assert len(got) == 240 and not got.duplicated(ABC).any()
    assert (got[ABC] >= x.min(0)).all().all() and (got[ABC] <= x.max(0)).all().all()
    key = ["rep", "id"]
    assert np.array_equal(got.sort_values(key).to_numpy(), again.sort_values(key).to_numpy())
    with pytest.raises(ValueError):
        selection.reference_sample(spark.createDataFrame([("x", 1)], "t string, id int"), ["t"], "id")


def test_gap(blobs):
    x, df, labels = blobs
    gaps = selection.gap_statistic(df, ABC, "id", 5, 4)
    got = gaps.toPandas().sort_values("k")
    ref = selection.reference_sample(df, ABC, "id", 4).toPandas()
    logs = {k: [] for k in range(1, 6)}
    for _, part in ref.groupby("rep"):
        points = part.sort_values("id")[ABC].to_numpy()
        parts = greedy(points, "complete")[1]
        for k in logs:
            logs[k].append(np.log(sse(points, parts[k]) / 2))
    for r in got.itertuples():
        assert np.isclose(r.gap, np.mean(logs[r.k]) - np.log(sse(x, labels[r.k]) / 2))
        assert np.isclose(r.s, np.std(logs[r.k]) * np.sqrt(1.25))
    assert selection.gap_choice(gaps).first()["k"] == 3
    for bad in ((0, 4), (3, 0)):
        with pytest.raises(ValueError):
            selection.gap_statistic(df, ABC, "id", *bad)


def test_gap_choice_rules(spark):
    gaps = spark.createDataFrame([(1, 3.0, 0.1), (2, 1.0, 0.1), (3, 2.0, 0.1), (4, 2.05, 0.1)], "k int, gap double, s double")
    assert selection.gap_choice(gaps).first()["k"] == 1
    assert selection.gap_choice(gaps, start_k=2).first()["k"] == 3
    assert selection.gap_choice(gaps.filter("k BETWEEN 2 AND 3")).first()["k"] is None


def test_elbow(spark, blobs):
    x, df, labels = blobs
    got = selection.elbow(df, ABC, "id", 4).toPandas().set_index("k")
    for k in range(1, 5):
        assert np.isclose(got.inertia[k], sse(x, labels[k])) and np.isclose(got.distortion[k], sse(x, labels[k]) / 120)
    weighted = selection.elbow(df.withColumn("w", F.col("id")), ABC, "id", 2, weight="w").toPandas().set_index("k")
    d2 = np.zeros(120)
    for c in (0, 1):
        d2[labels[2] == c] = ((x[labels[2] == c] - x[labels[2] == c].mean(0)) ** 2).sum(1)
    assert np.isclose(weighted.distortion[2], np.average(d2, weights=range(120)))
    other = selection.elbow(df, ABC, "id", 3, KMeans(seed=1)).toPandas().set_index("k")
    assert np.isclose(other.inertia[1], got.inertia[1]) and other.inertia[3] <= got.inertia[1]
    with pytest.raises(ValueError):
        selection.elbow(df, ABC, "id", 0)


def silhouette(x, labels):
    d, out = np.linalg.norm(x[:, None] - x[None], axis=-1), []
    for i, mine in enumerate(labels):
        home = labels == mine
        if home.sum() == 1:
            out.append(0.0)
            continue
        a = d[i][home].sum() / (home.sum() - 1)
        b = min(d[i][labels == c].mean() for c in set(labels) if c != mine)
        out.append((b - a) / max(a, b))
    return np.mean(out)


@pytest.mark.parametrize("block", [2048, 17])
def test_silhouette(blobs, block):
    x, df, labels = blobs
    scores = selection.silhouette_method(df, ABC, "id", 5, block=block)
    got = scores.toPandas().set_index("k").silhouette
    for k in range(2, 6):
        assert np.isclose(got[k], silhouette(x, labels[k]))
    assert selection.silhouette_choice(scores).first()["k"] == 3


def test_silhouette_of_given_labels(spark, blobs):
    x, df, _ = blobs
    odd = np.where(np.arange(120) == 5, 9, np.arange(120) % 2)
    labels = spark.createDataFrame(pd.DataFrame({"id": range(120), "k": 2, "label": odd}))
    got = selection.silhouette_method(df, ABC, "id", 2, labels=labels).first()
    assert np.isclose(got.silhouette, silhouette(x, odd))
    with pytest.raises(ValueError):
        selection.silhouette_method(df, ABC, "id", 1)


@pytest.mark.parametrize("portion", [1000, 2])
def test_representatives(spark, blobs, portion, monkeypatch):
    x, df, labels = blobs
    monkeypatch.setattr(selection, "CLASSES_PER_PASS", portion)
    df = df.join(spark.createDataFrame(pd.DataFrame({"id": range(120), "y": labels[3]})), "id")
    got = selection.representatives(df, ABC, "y", "id").toPandas().set_index("label").row_id
    for c in range(3):
        assert got[c] == np.argmin(((x - x[labels[3] == c].mean(0)) ** 2).sum(1))
    inside = selection.representatives(df, ABC, "y", "id", within_class=True).toPandas()
    assert all(labels[3][r.row_id] == r.label for r in inside.itertuples())


def test_several_feature_sets(blobs):
    _, df, _ = blobs
    got = selection.cluster_sets(df, {"y1": (["a"], 2), "y2": (ABC, 3)}, "id").toPandas()
    assert set(got.y1) == {0, 1} and set(got.y2) == {0, 1, 2} and len(got) == 120


def test_model_contract(blobs):
    x, df, _ = blobs
    selection.check_model(KMeans())
    with pytest.raises(ValueError):
        selection.check_model("centroid")
    with pytest.raises(AttributeError):
        selection.check_model(object())
    with pytest.raises(TypeError):
        selection.check_model(type("NoK", (), {"fit": None})())
    with pytest.raises(ValueError):
        selection.check_model(KMeans(k=2).fit(df.select(selection.array_to_vector(selection.vector_of(ABC)).alias("features"))))


@pytest.mark.parametrize("method", ["complete", "average", "single", "ward"])
def test_ties_do_not_depend_on_finish(spark, method):
    x = np.random.default_rng(3).integers(0, 4, size=(40, 2)).astype(float)
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]).assign(id=range(40)))
    found = []
    for finish, block in ((3000, 2048), (5, 6)):
        tree = hierarchy.linkage(df, ["a", "b"], "id", method, finish=finish, block=block)
        labels = hierarchy.cut(tree, range(1, 9)).toPandas().sort_values(["k", "id"])
        steps = hierarchy.merge_table(tree).toPandas().sort_values("step")
        found.append((labels.label.tolist(), steps[["left", "right", "size"]].to_numpy().tolist(), steps.height.round(6).tolist()))
    assert found[0] == found[1]


def test_blocks_meet_without_copies(spark, rng):
    """Every pair of blocks meets once, in a product of two small tables; no block is written once for each other."""
    x = rng.normal(size=(45, 2))
    points = frame(spark, x).select(F.lit(0).alias("g"), "id", F.array("a", "b").alias("_x"))
    packed = blocks.pack(points, ["id"], "_x", ["id"], ["g"], 5)
    schema = blocks.grouped_schema(points, ["g"], ("lo", "long"), ("hi", "long"), ("same", "boolean"))
    work = lambda a, b, same: {"lo": [int(a["block"])], "hi": [int(b["block"])], "same": [same]}
    met = blocks.meet(packed, ["g"], [], schema, work)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan
    assert sorted((r.lo, r.hi, r.same) for r in met.collect()) == [(i, j, i == j) for i in range(9) for j in range(i, 9)]
    some = blocks.meet_all(packed, ["g"], schema, work, 2)
    assert sorted((r.lo, r.hi) for r in some.collect()) == [(i, j) for i in range(2) for j in range(i, 9)]


def test_panels_are_few(spark):
    """What a row sends to the other panels does not grow with the table, until panels reach their size in bytes."""
    for rows in (10_000, 100_000, 300_000):
        df = spark.range(rows).select(F.array(F.col("id").cast("double")).alias("_x"), F.lit(0).alias("g"))
        size = blocks.panel_rows(df, "_x", ["g"], 2048)
        assert size % 2048 == 0 and -(-rows // size) <= 16
    wide = spark.range(100).select(F.array_repeat(F.lit(1.0), 1000).alias("_x"), F.lit(0).alias("g"))
    assert blocks.panel_rows(wide.crossJoin(spark.range(1000)), "_x", ["g"], 2048) * 8000 <= blocks.PANEL_BYTES


def test_only_clusters_without_a_neighbour_search_again(spark, monkeypatch):
    """A chain of growing gaps merges one pair a round: all others keep the neighbour they have."""
    x = (np.cumsum(1.0 + np.arange(24) / 50))[:, None]
    met = []

    def meet_all(packed, keys, schema, work, first=None):
        met.append((first, packed.count()))
        return blocks.meet_all(packed, keys, schema, work, first)

    monkeypatch.setattr(hierarchy, "meet_all", meet_all)
    tree = hierarchy.linkage(frame(spark, x), ["a"], "id", "single", finish=20, block=1)
    assert tree.rounds == 4 and len(met) == 3
    # Two rows to a panel; the chain and its next row lie in the first ones.
    assert all(first <= 4 and every == 12 for first, every in met)
    assert np.allclose(np.sort([r.height for r in tree.merges.collect()]), np.diff(x[:, 0]))
