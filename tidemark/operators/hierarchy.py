"""Exact agglomerative clustering for complete, average, single and Ward linkage.

All four linkages are reducible: merging every pair of clusters that are each
other's nearest neighbour gives the same tree as merging the closest pair
first (Bruynooghe 1977, Murtagh 1983). A round finds all nearest neighbours by
blocks, merges all mutual pairs and cuts lineage; once at most ``FINISH``
clusters are left the same rounds go on in one bounded task per group. Equal
rows form one weighted leaf, so copies cost nothing.

A cluster is named by its smallest leaf, a leaf by its smallest row id. Ties
have one order in both places, so labels do not depend on ``FINISH``:
neighbours rank by (distance, smaller name, larger name), where distances count
as equal when they agree in single precision, and merges rank by (height,
round, name of the right side).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expressions import as_vector
from tidemark.operators.autocorrelation import grouped_schema, key_frame
from tidemark.operators.blocks import BLOCK_ROWS, TILE_ROWS, distances, meet, meet_all, pack, panel_rows, squares, tiles, unpack
from tidemark.operators.ordering import attach, join_skewed, keyed, ordinal, side_by_side
from tidemark.session import checkpoint

LINKAGES = ("complete", "average", "single", "ward")
FINISH = 3_000

_MERGE = (
    ("level", "long"), ("left", "long"), ("right", "long"), ("left_born", "long"), ("right_born", "long"),
    ("height", "double"), ("size", "long"),
)


@dataclass
class Tree:
    """A merge tree per group.

    ``points``: ``(*keys, leaf, w, _x)``, one row per distinct vector.
    ``merges``: one row per merge; ``left`` and ``right`` name the clusters,
    ``*_born`` the level that made them (-1 for a leaf). ``rows`` maps every
    input row to its leaf; ``copies`` says whether a leaf has several rows.
    Merges below level ``rounds`` come from rounds.
    """

    points: DataFrame
    merges: DataFrame
    rows: DataFrame
    keys: list[str]
    by: list[str]
    row_id: str
    rounds: int
    copies: bool


def leaves_of(df: DataFrame, features: Sequence[str] | str, row_id: str, by: Sequence[str]):
    """Distinct vectors ``(*keys, leaf, w, _x)``, the leaf of every row, the keys, and counts over all groups."""
    vector = F.col(features).cast("array<double>") if isinstance(features, str) else as_vector(features)
    data, keys = keyed(df.select(*by, F.col(row_id).cast("long").alias(row_id), vector.alias("_x")), by)
    points = data.groupBy(*keys, "_x").agg(F.min(row_id).alias("leaf"), F.count(F.lit(1)).alias("w"))
    points = checkpoint(points.select(*keys, "leaf", "w", "_x"))
    missing = F.exists("_x", lambda v: v.isNull() | F.isnan(v))
    facts = points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.max("w").alias("w"), F.bool_or(missing).alias("missing")
    ).agg(F.max("n").alias("n"), F.max("w").alias("w"), F.bool_or("missing").alias("missing"), F.count(F.lit(1)).alias("groups")).first()
    if facts["n"] is None:
        raise ValueError("no rows to cluster")
    if facts["missing"]:
        raise ValueError("features have missing values; fill or drop them first")
    rows = data.select(*keys, row_id, F.col(row_id).alias("leaf"))
    if facts["w"] > 1:
        rows = join_skewed(data, points, [*keys, "_x"], "w").select(*keys, row_id, "leaf")
    return points, rows, keys, facts


def linkage(
    df: DataFrame,
    features: Sequence[str] | str,
    row_id: str,
    method: str = "complete",
    by: Sequence[str] = (),
    finish: int = FINISH,
    block: int = BLOCK_ROWS,
) -> Tree:
    """Build the tree over ``features`` (columns, or one array column), per group ``by``."""
    if method not in LINKAGES:
        raise ValueError(f"unknown linkage {method!r}; use one of {LINKAGES}")
    points, rows, keys, facts = leaves_of(df, features, row_id, by)
    if facts["n"] <= finish:
        merges, rounds = _finish_points(side_by_side(points, keys, facts["groups"]), keys, method), 0
    else:
        merges, rounds = _rounds(points, keys, list(by), method, finish, block)
    return Tree(points, checkpoint(merges), rows, keys, list(by), row_id, rounds, facts["w"] > 1)


def _ward_factor(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(2 * np.multiply.outer(a, b) / np.add.outer(a, b))


def _combine(method: str, da, db, dab: float, na: float, nb: float, n: np.ndarray):
    """Distance of a merged cluster to the others (Lance and Williams 1967)."""
    if method == "complete":
        return np.maximum(da, db)
    if method == "single":
        return np.minimum(da, db)
    if method == "average":
        return (na * da + nb * db) / (na + nb)
    return np.sqrt(((na + n) * da**2 + (nb + n) * db**2 - n * dab**2) / (na + nb + n))


def merge_all(
    d: np.ndarray, names: np.ndarray, size: np.ndarray, born: np.ndarray, method: str, level: int, height: np.ndarray | None = None
) -> dict:
    """All merges of clusters with distance matrix ``d``, round by round.

    ``names`` ascend, and a merged cluster stays in the lower slot, so a slot
    always carries the name of its smallest leaf and the first minimum of a row
    is the neighbour that ranks first. ``level`` is the number of the first
    round. After a round only rows that lost their neighbour look for a new one.
    """
    n = len(names)
    size, born = size.astype(float), born.astype(np.int64)
    floor = np.zeros(n) if height is None else height.astype(float)
    np.fill_diagonal(d, np.inf)
    rank = d.astype(np.float32)
    alive, near = np.ones(n, bool), rank.argmin(axis=1)
    out = []
    for at in range(level, level + n):
        slots = np.flatnonzero(alive)
        if len(slots) < 2:
            break
        left = slots[(near[near[slots]] == slots) & (slots < near[slots])]
        right = near[left]
        for i, j in zip(left.tolist(), right.tolist()):
            top = max(float(d[i, j]), floor[i], floor[j])
            out.append((at, names[i], names[j], int(born[i]), int(born[j]), top, int(size[i] + size[j])))
            with np.errstate(invalid="ignore"):
                row = _combine(method, d[i], d[j], float(d[i, j]), size[i], size[j], size)
            alive[j] = False
            row[~alive] = np.inf
            row[i] = np.inf
            d[i], d[:, i] = row, row
            d[j], d[:, j] = np.inf, np.inf
            rank[i] = rank[:, i] = row
            rank[j] = rank[:, j] = np.inf
            size[i] += size[j]
            born[i], floor[i] = at, top
        slots = np.flatnonzero(alive)
        lost = np.isin(near[slots], np.r_[left, right]) | np.isin(slots, left)
        kept = slots[~lost]
        for i in left.tolist():
            closer = rank[kept, i] < rank[kept, near[kept]]
            closer |= (rank[kept, i] == rank[kept, near[kept]]) & (i < near[kept])
            near[kept[closer]] = i
        again = slots[lost]
        for part in range(0, len(again), 512):
            near[again[part : part + 512]] = rank[again[part : part + 512]].argmin(axis=1)
    return {c: [r[at] for r in out] for at, (c, _) in enumerate(_MERGE)}


def _finish_points(points: DataFrame, keys: list[str], method: str) -> DataFrame:
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("leaf")
        x = np.stack(pdf["_x"].to_numpy()).astype(float)
        w = pdf["w"].to_numpy(float)
        d = distances(x, x)
        if method == "ward":
            d *= _ward_factor(w, w)
        return key_frame(keys, pdf, merge_all(d, pdf["leaf"].to_numpy(), w, np.full(len(w), -1), method, 0))

    return points.groupBy(*keys).applyInPandas(build, grouped_schema(points, keys, *_MERGE))


def _rounds(points: DataFrame, keys: list[str], by: list[str], method: str, finish: int, block: int):
    """Merge mutual nearest neighbours until every group has at most ``finish`` clusters."""
    clusters = points.select(
        *keys, F.col("leaf").alias("cid"), F.col("w").alias("size"), F.lit(-1).cast("long").alias("born"),
        F.lit(0.0).alias("height"),
    )
    members = points.select(*keys, "leaf", F.col("leaf").alias("cid"), "w", F.col("w").alias("size"), "_x")
    merges, level, known, lost = None, 0, None, None
    while clusters.groupBy(*keys).count().agg(F.max("count")).first()[0] > finish:
        near = _nearest(members, keys, by, method, block, known, lost)
        pairs = near.groupBy(*keys, F.least("cid", "other").alias("left"), F.greatest("cid", "other").alias("right")).agg(
            F.count(F.lit(1)).alias("_both"), F.min("d").alias("_d")
        )
        part = lambda side: clusters.select(
            *keys, F.col("cid").alias(side), F.col("size").alias(f"{side}_size"), F.col("born").alias(f"{side}_born"),
            F.col("height").alias(f"{side}_height"),
        )
        joined = pairs.filter("_both = 2").join(part("left"), [*keys, "left"]).join(part("right"), [*keys, "right"])
        new = checkpoint(joined.select(
            *keys, F.lit(level).cast("long").alias("level"), "left", "right", "left_born", "right_born",
            F.greatest("_d", "left_height", "right_height").alias("height"),
            (F.col("left_size") + F.col("right_size")).alias("size"),
        ))
        merges = new if merges is None else merges.unionByName(new)
        members, clusters = _absorb(members, clusters, new, keys, method, level)
        known, lost = (None, None) if by else _settled(near, new, keys)
        level += 1
    top = _finish_clusters(members, clusters, keys, by, method, block, level)
    return (top if merges is None else merges.unionByName(top)), level


def _settled(near: DataFrame, new: DataFrame, keys: list[str]):
    """The neighbours that a round of merges leaves in place, and the clusters that have to look for new ones.

    A merged cluster is no closer than the nearer of its parts, so a neighbour that did
    not merge stays the nearest; merged clusters themselves meet all others again.
    """
    left, right = (new.select(*keys, F.col(side).alias("cid")) for side in ("left", "right"))
    merged = left.unionByName(right)
    parted = near.join(merged.withColumnRenamed("cid", "other"), [*keys, "other"], "left_semi").select(*keys, "cid")
    lost = checkpoint(parted.unionByName(left).distinct().join(right, [*keys, "cid"], "left_anti"))
    if new.isEmpty():
        return None, None
    return checkpoint(near.join(lost.unionByName(right), [*keys, "cid"], "left_anti")), lost


def _absorb(members: DataFrame, clusters: DataFrame, new: DataFrame, keys: list[str], method: str, level: int):
    """Apply one round of merges to the membership and cluster tables."""
    gone = new.select(*keys, F.col("right").alias("cid"), F.col("left").alias("_to"))
    grown = new.select(*keys, F.col("left").alias("cid"), F.col("size").alias("_size"), F.col("height").alias("_height"))
    kept = clusters.join(gone, [*keys, "cid"], "left_anti").join(grown, [*keys, "cid"], "left")
    now = checkpoint(kept.select(
        *keys, "cid", F.coalesce("_size", "size").alias("size"),
        F.when(F.col("_size").isNotNull(), F.lit(level).cast("long")).otherwise(F.col("born")).alias("born"),
        F.coalesce("_height", "height").alias("height"),
    ))
    if method != "ward":
        # Old name to new name and new size: one join, in which a cluster may hold most rows.
        place = clusters.select(*keys, "cid", F.col("size").alias("_had")).join(gone, [*keys, "cid"], "left")
        place = place.withColumn("_now", F.coalesce("_to", "cid")).drop("_to")
        sizes = now.select(*keys, F.col("cid").alias("_now"), F.col("size").alias("_size"))
        moved = join_skewed(members.drop("size"), place.join(sizes, [*keys, "_now"]), [*keys, "cid"], "_had")
        return checkpoint(moved.select(*keys, "leaf", F.col("_now").alias("cid"), "w", F.col("_size").alias("size"), "_x")), now
    # Ward needs one centre of mass per cluster only.
    side = lambda c: members.select(*keys, F.col("cid").alias(c), F.col("size").alias(f"_n_{c}"), F.col("_x").alias(f"_x_{c}"))
    both = new.select(*keys, "left", "right").join(side("left"), [*keys, "left"]).join(side("right"), [*keys, "right"])
    n1, n2 = F.col("_n_left"), F.col("_n_right")
    centre = F.zip_with("_x_left", "_x_right", lambda a, b: (a * n1 + b * n2) / (n1 + n2))
    fresh = both.select(*keys, F.col("left").alias("cid"), (n1 + n2).alias("size"), centre.alias("_x"))
    old = members.join(gone, [*keys, "cid"], "left_anti").join(grown.select(*keys, "cid"), [*keys, "cid"], "left_anti")
    every = old.select(*keys, "cid", "size", "_x").unionByName(fresh)
    return checkpoint(every.select(*keys, F.col("cid").alias("leaf"), "cid", F.col("size").alias("w"), "size", "_x")), now


class _Panel:
    """The parts of clusters that a panel holds, by cluster name: names, total sizes and whole-cluster flags.

    ``strips`` are runs of clusters with at most a tile of rows together, or one larger cluster.
    """

    def __init__(self, row: pd.Series, block: int):
        cid, leaf, w, size = (np.asarray(row[c]) for c in ("cid", "leaf", "w", "size"))
        order = np.lexsort((leaf, cid))
        cid, w, size = cid[order], w[order], size[order]
        self.x, self.w, self.block = unpack(row)[order], w.astype(float), block
        self.starts = np.flatnonzero(np.r_[True, cid[1:] != cid[:-1]])
        self.ends = np.r_[self.starts[1:], len(cid)]
        self.names, self.size = cid[self.starts], size[self.starts].astype(float)
        self.whole = np.add.reduceat(w, self.starts) == size[self.starts]
        self.lost = np.asarray(row["_late"])[order][self.starts] == 0 if "_late" in row else np.ones(len(self.starts), bool)
        self.strips, first, most = [], 0, min(block, TILE_ROWS)
        while first < len(self.starts):
            last = max(first + 1, int(np.searchsorted(self.ends, self.starts[first] + most, side="right")))
            self.strips.append(slice(first, last))
            first = last

    def pieces(self, strip: slice):
        """Vectors, weights and cluster starts of a strip, in tiles; only a cluster of its own has several."""
        lo, hi = int(self.starts[strip.start]), int(self.ends[strip.stop - 1])
        for tile in tiles(hi - lo, self.block):
            rows = slice(lo + tile.start, lo + tile.stop)
            alone = strip.stop - strip.start == 1
            yield self.x[rows], self.w[rows], np.zeros(1, int) if alone else self.starts[strip] - lo


def _cells(left: _Panel, one: slice, right: _Panel, two: slice, method: str) -> np.ndarray:
    """Distances between the clusters of two strips, as far as the panels hold them."""
    if method == "ward":
        parts = [[_ward_factor(wa, wb) * distances(xa, xb) for xb, wb, _ in right.pieces(two)] for xa, wa, _ in left.pieces(one)]
        return np.block(parts)
    fold = {"complete": np.maximum, "single": np.minimum, "average": np.add}[method]
    cells = None
    for xa, wa, ia in left.pieces(one):
        for xb, wb, ib in right.pieces(two):
            if method == "average":
                d = distances(xa, xb)
                if (wa != 1).any() or (wb != 1).any():
                    d *= np.multiply.outer(wa, wb)
            else:
                d = squares(xa, xb)
            if len(ib) < d.shape[1]:
                d = fold.reduceat(d, ib, axis=1)
            if len(ia) < d.shape[0]:
                d = fold.reduceat(d, ia, axis=0)
            cells = d if cells is None else fold(cells, d)
    if method == "average":
        return cells / np.multiply.outer(left.size[one], right.size[two])
    return np.sqrt(cells)


_FOLD_PARTS = {"complete": F.max, "single": F.min, "average": F.sum, "ward": F.min}


def _members_packed(members: DataFrame, keys: list[str], block: int, first: Sequence[str] = ()) -> DataFrame:
    rows = panel_rows(members, "_x", keys, block)
    return pack(members, ["cid", "leaf", "w", "size", *first], "_x", [*first, "cid", "leaf"], keys, rows)


def _nearest(
    members: DataFrame, keys: list[str], by: list[str], method: str, block: int, known: DataFrame | None = None,
    lost: DataFrame | None = None,
) -> DataFrame:
    """``(*keys, cid, other, d)``: the nearest neighbour of every cluster; ties by names.

    A task reports one candidate per whole cluster. Distances that involve a
    cluster cut by a panel bound are reported as parts and put together first;
    at most one cluster per bound is cut. With ``known``, the neighbours of the
    other clusters, only the clusters ``lost`` meet all clusters.
    """

    def work(left, right, same) -> dict:
        a = _Panel(left, block)
        b = a if same else _Panel(right, block)
        out = {"cid": [], "other": [], "d": [], "part": []}
        found = {side: (np.full(len(side.names), np.inf, np.float32), np.zeros(len(side.names), np.int64), np.zeros(len(side.names))) for side in {a, b}}

        def best(side, strip, full, exact, others):
            # names ascend, so the first minimum is the one with the smallest name
            rank, other, d = (v[strip] for v in found[side])
            low = full.min(axis=1)
            better = np.flatnonzero(low < rank)
            pick = full[better].argmin(axis=1)
            rank[better], other[better], d[better] = low[better], others[pick], exact[better, pick]

        for at, one in enumerate(a.strips):
            for two in b.strips[at:] if same else b.strips:
                exact = _cells(a, one, b, two, method)
                full, diagonal = exact.astype(np.float32), same and two == one
                na, nb, fa, fb = a.names[one], b.names[two], a.whole[one], b.whole[two]
                if diagonal:
                    np.fill_diagonal(full, np.inf)
                if not (fa.all() and fb.all()):
                    full[~fa], full[:, ~fb] = np.inf, np.inf
                    # Inside one strip each pair shows up twice; report it once.
                    cut = ~np.logical_and.outer(fa, fb) & ~np.equal.outer(na, nb) & (np.less.outer(na, nb) if diagonal else True)
                    # All parts of a pair come together only if one of the two meets every panel.
                    cut &= np.logical_or.outer(a.lost[one], b.lost[two])
                    i, j = np.nonzero(cut)
                    for name, values in zip(out, (na[i], nb[j], exact[i, j], [True] * len(i))):
                        out[name] += list(values)
                best(a, one, full, exact, nb)
                if not diagonal:
                    best(b, two, full.T, exact.T, na)
        for side, (rank, other, d) in found.items():
            ok = np.isfinite(rank)
            for name, values in zip(out, (side.names[ok], other[ok], d[ok], [False] * int(ok.sum()))):
                out[name] += list(values)
        return out

    schema = grouped_schema(members, keys, ("cid", "long"), ("other", "long"), ("d", "double"), ("part", "boolean"))
    if known is None:
        found = checkpoint(meet(_members_packed(members, keys, block), keys, by, schema, work))
    else:
        at = members.join(lost.withColumn("_late", F.lit(0)), [*keys, "cid"], "left").withColumn("_late", F.coalesce("_late", F.lit(1)))
        packed = _members_packed(at, keys, block, ["_late"])
        first = packed.filter(F.array_contains("_late", 0)).count()
        found = checkpoint(meet_all(packed, keys, schema, work, first))
    low, high = F.least("cid", "other").alias("_a"), F.greatest("cid", "other").alias("_b")
    parts = found.filter("part").groupBy(*keys, low, high).agg(_FOLD_PARTS[method]("d").alias("d"))
    ends = F.inline(F.array(
        F.struct(F.col("_a").alias("cid"), F.col("_b").alias("other")),
        F.struct(F.col("_b").alias("cid"), F.col("_a").alias("other")),
    ))
    every = found.filter("NOT part").select(*keys, "cid", "other", "d").unionByName(parts.select(*keys, ends, "d"))
    if known is not None:
        every = every.unionByName(known)
    rank = F.struct(F.col("d").cast("float").alias("rank"), F.least("cid", "other").alias("a"), F.greatest("cid", "other").alias("b"), "d")
    near = every.groupBy(*keys, "cid").agg(F.min(rank).alias("m"))
    other = F.when(F.col("cid") == F.col("m.a"), F.col("m.b")).otherwise(F.col("m.a"))
    return checkpoint(near.select(*keys, "cid", other.alias("other"), F.col("m.d").alias("d")))


def _finish_clusters(
    members: DataFrame, clusters: DataFrame, keys: list[str], by: list[str], method: str, block: int, level: int
) -> DataFrame:
    """Build the top of the tree from at most ``finish`` clusters per group.

    Tasks send matrices over whole clusters, once per pair of blocks; cells of
    cut clusters are folded by Spark first. So the last task holds the
    distance matrix of the remaining clusters and no more.
    """

    def work(left, right, same) -> dict:
        a = _Panel(left, block)
        b = a if same else _Panel(right, block)
        out = {"rows": [], "cols": [], "cells": [], "cid": [], "other": [], "d": []}

        def add(rows, cols, cells, cid, other, value):
            for c, v in zip(out, (rows, cols, cells, cid, other, value)):
                out[c].append(v)

        for at, one in enumerate(a.strips):
            for two in b.strips[at:] if same else b.strips:
                d = _cells(a, one, b, two, method)
                na, nb, fa, fb = a.names[one], b.names[two], a.whole[one], b.whole[two]
                add(na[fa].tolist(), nb[fb].tolist(), d[np.ix_(fa, fb)].tobytes(), None, None, None)
                cut = ~np.logical_and.outer(fa, fb) & ~np.equal.outer(na, nb)
                if same and two == one:
                    cut &= np.less.outer(na, nb)
                for i, j in zip(*np.nonzero(cut)):
                    add(None, None, None, int(min(na[i], nb[j])), int(max(na[i], nb[j])), float(d[i, j]))
        return out

    schema = grouped_schema(
        members, keys, ("rows", "array<long>"), ("cols", "array<long>"), ("cells", "binary"), ("cid", "long"),
        ("other", "long"), ("d", "double"),
    )
    found = checkpoint(meet(_members_packed(members, keys, block), keys, by, schema, work))
    blocks = found.filter("cells IS NOT NULL")
    parts = found.filter("cid IS NOT NULL").groupBy(*keys, "cid", "other").agg(_FOLD_PARTS[method]("d").alias("d"))
    none = lambda c: F.lit(None).cast(found.schema[c].dataType).alias(c)
    parts = parts.select(*keys, none("rows"), none("cols"), none("cells"), "cid", "other", "d")

    def build(cells: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        state = state.sort_values("cid")
        names = state["cid"].to_numpy()
        d = np.full((len(names), len(names)), np.inf)
        for row in cells[cells["cells"].notna()].itertuples():
            r, c = np.searchsorted(names, row.rows), np.searchsorted(names, row.cols)
            if len(r) and len(c):
                m = np.frombuffer(row.cells, float).reshape(len(r), len(c))
                d[np.ix_(r, c)] = m
                d[np.ix_(c, r)] = m.T
        single = cells[cells["cid"].notna()]
        r = np.searchsorted(names, single["cid"].to_numpy(dtype=np.int64))
        c = np.searchsorted(names, single["other"].to_numpy(dtype=np.int64))
        d[r, c] = d[c, r] = single["d"].to_numpy(float)
        merged = merge_all(d, names, state["size"].to_numpy(), state["born"].to_numpy(), method, level, state["height"].to_numpy())
        return key_frame(keys, state, merged)

    group = blocks.unionByName(parts).groupBy(*keys).cogroup(clusters.groupBy(*keys))
    return group.applyInPandas(build, grouped_schema(members, keys, *_MERGE))


def _spread(tree: Tree, own: DataFrame, width: int) -> DataFrame:
    """Carry values from the root down: ``(*keys, leaf, values)``.

    ``own`` is the merge table with ``own``: what the right child becomes in
    each of ``width`` cuts, -1 where it stays with its parent. A cluster keeps
    its name as the left child, so every leaf but the root's is a right child
    exactly once, and joins on the parent's name have unique keys on one side
    and one row per merge on the other.
    """
    keys = tree.keys
    root = tree.points.groupBy(*keys).agg(F.min("leaf").alias("leaf"))
    root = root.withColumn("values", F.array_repeat(F.lit(0).cast("long"), width))

    def down(merges: pd.DataFrame, top: pd.DataFrame) -> pd.DataFrame:
        start = int(top["leaf"].iloc[0])
        value = {start: np.asarray(top["values"].iloc[0])}
        ordered = merges.sort_values("level", ascending=False)
        for left, right, mine in zip(ordered["left"], ordered["right"], ordered["own"]):
            mine = np.asarray(mine)
            value[right] = np.where(mine >= 0, mine, value[left])
        return key_frame(keys, top, {"leaf": list(value), "values": [v.tolist() for v in value.values()]})

    if tree.rounds:
        own = checkpoint(own)
    schema = grouped_schema(tree.points, keys, ("leaf", "long"), ("values", "array<long>"))
    upper = own.filter(F.col("level") >= tree.rounds).groupBy(*keys).cogroup(root.groupBy(*keys))
    known = upper.applyInPandas(down, schema)
    for level in range(tree.rounds - 1, -1, -1):
        known = checkpoint(known)
        step = own.filter(F.col("level") == level).join(known.withColumnRenamed("leaf", "left"), [*keys, "left"])
        value = F.zip_with("own", "values", lambda o, p: F.when(o >= 0, o).otherwise(p))
        known = known.unionByName(step.select(*keys, F.col("right").alias("leaf"), value.alias("values")))
    return known


def to_rows(tree: Tree, leaves: DataFrame) -> DataFrame:
    if not tree.copies:
        return tree.rows.join(leaves, [*tree.keys, "leaf"])
    weighted = leaves.join(tree.points.select(*tree.keys, "leaf", "w"), [*tree.keys, "leaf"])
    return join_skewed(tree.rows, weighted, [*tree.keys, "leaf"], "w").drop("w")


def cut(tree: Tree, ks: Sequence[int]) -> DataFrame:
    """Labels at several cluster counts: ``(*by, row_id, k, label)``.

    Labels number the clusters 0..k-1 by their smallest row id. A group with
    fewer distinct rows than ``k`` gets as many clusters as it has.
    """
    ks = sorted(set(ks))
    if not ks or ks[0] < 1:
        raise ValueError("cluster counts start at 1")
    keys = tree.keys
    # Undoing the k - 1 highest merges leaves k clusters. Only max(ks) - 1 rows per group pass.
    last = [F.desc("height"), F.desc("level"), F.desc("right")]
    if tree.by:
        order = Window.partitionBy(*keys).orderBy(*last)
        top = tree.merges.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") < ks[-1]).drop("_rn")
    else:
        top = tree.merges.orderBy(*last).limit(ks[-1] - 1)

    def codes(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["height", "level", "right"], ascending=False)
        rank, names = np.arange(1, len(pdf) + 1), pdf["right"].to_numpy()
        own = np.full((len(pdf), len(ks)), -1)
        for at, k in enumerate(ks):
            roots = np.flatnonzero(rank < k)
            own[roots[np.argsort(names[roots])], at] = np.arange(1, len(roots) + 1)
        return key_frame(keys, pdf, {"level": pdf["level"].to_numpy(), "right": names, "own": list(own)})

    schema = grouped_schema(tree.merges, keys, ("level", "long"), ("right", "long"), ("own", "array<long>"))
    high = top.groupBy(*keys).applyInPandas(codes, schema)
    stay = F.array_repeat(F.lit(-1).cast("long"), len(ks))
    own = tree.merges.join(high, [*keys, "level", "right"], "left").withColumn("own", F.coalesce("own", stay))
    rows = to_rows(tree, _spread(tree, own, len(ks)))
    kth = F.posexplode(F.arrays_zip(F.array(*map(F.lit, ks)).alias("k"), F.col("values").alias("label")))
    return rows.select(*tree.by, tree.row_id, kth.alias("_at", "_c")).select(
        *tree.by, tree.row_id, F.col("_c.k").alias("k"), F.col("_c.label").cast("int").alias("label")
    )


def cut_height(tree: Tree, height: float) -> DataFrame:
    """Clusters below a height line: ``(*by, row_id, cluster)``, named by smallest row id."""
    keys = tree.keys
    high = F.col("height") > F.lit(float(height))
    # 0 is the root's value in _spread, so names move up by one on the way down.
    base = tree.points.groupBy(*keys).agg(F.min("leaf").alias("_root"))
    own = tree.merges.join(base, keys).withColumn(
        "own", F.array(F.when(high, F.col("right") - F.col("_root")).otherwise(F.lit(-1).cast("long")))
    )
    rows = to_rows(tree, _spread(tree, own.drop("_root"), 1)).join(base, keys)
    return rows.select(*tree.by, tree.row_id, (F.col("values")[0] + F.col("_root")).alias("cluster"))


def merge_table(tree: Tree) -> DataFrame:
    """``(*by, step, left, right, height, size)`` with node numbers.

    Leaves count from 0 in row-id order, merge ``s`` makes node ``leaves + s``.
    ``size`` counts rows; without equal rows it counts leaves.
    """
    keys = tree.keys
    steps = ordinal(tree.merges, ["height", "level", "right"], keys, name="step")
    leaves = ordinal(tree.points.select(*keys, "leaf"), ["leaf"], keys, name="_node")
    counts = tree.points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_leaves"))
    steps = checkpoint(attach(steps, counts.drop("_all") if not tree.by else counts, tree.by))
    inner = steps.select(*keys, F.col("level").alias("born"), F.col("left").alias("name"), (F.col("_leaves") + F.col("step")).alias("_node"))
    nodes = inner.unionByName(leaves.select(*keys, F.lit(-1).cast("long").alias("born"), F.col("leaf").alias("name"), "_node"))
    child = lambda side: nodes.select(
        *keys, F.col("born").alias(f"{side}_born"), F.col("name").alias(side), F.col("_node").alias(f"_{side}")
    )
    out = steps
    for side in ("left", "right"):
        out = out.join(child(side), [*keys, f"{side}_born", side])
    a, b = F.col("_left"), F.col("_right")
    return out.select(*tree.by, "step", F.least(a, b).alias("left"), F.greatest(a, b).alias("right"), "height", "size")


def tree_levels(table: DataFrame, levels: int = 4, by: Sequence[str] = ()) -> DataFrame:
    """Merges at most ``levels`` steps below the root, with their ``depth``.

    ``table`` comes from :func:`merge_table`. The frontier doubles at most per
    level, so this reads a handful of rows per step.
    """
    table, keys = keyed(checkpoint(table), by)
    last = table.groupBy(*keys).agg(F.max("step").alias("_last"))
    front = table.join(last, keys).filter(F.col("step") == F.col("_last")).drop("_last").withColumn("depth", F.lit(0))
    out = front
    # n leaves need n - 1 merges, so node - n is the step that made an inner node.
    numbered = table.join(last, keys).withColumn("_made", F.col("step") + F.col("_last") + 2).drop("_last")
    for depth in range(1, levels + 1):
        wanted = front.select(*keys, F.explode(F.array("left", "right")).alias("_made"))
        front = checkpoint(numbered.join(wanted, [*keys, "_made"]).select(*table.columns).withColumn("depth", F.lit(depth)))
        out = out.unionByName(front)
    return out.select(*by, "depth", "step", "left", "right", "height", "size")
