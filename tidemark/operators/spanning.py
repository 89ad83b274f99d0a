"""Single linkage of any size by a minimum spanning tree.

Single-linkage clusters are what is left of the minimum spanning tree without
its longest edges (Gower and Ross 1969). The tree grows in rounds (Boruvka 1926): every
component finds its shortest edge to another one, all these edges are taken,
and the components they join become one. Components at least halve, so a chain
of ever growing gaps, which merges one pair at a time, needs log2(n) rounds too.

Rows lie in blocks along a space-filling curve, with bounding boxes. A round
searches every block by itself first; a pair of blocks meets only if its boxes
are no further apart than the shortest edge known for some component in them, and
never again once both lie in one component. Edges rank by (distance, smaller
leaf, larger leaf), so no cycle can close and equal distances have one order.

Points on a line, that is one feature column, need no rounds: the tree is the
path from each value to the next one, as any other edge is longer than those it
spans. So it takes a sort, and the parts that are left of it without some edges
are runs, numbered by running totals.

Cases: equal rows are one leaf. Missing features and empty tables raise, as in
:func:`tidemark.operators.hierarchy.linkage`. A group of one row has no edge.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.autocorrelation import grouped_schema, key_frame
from tidemark.operators.blocks import BLOCK_ROWS, along_curve, box_pairs, distances, meet_some, pack, unpack
from tidemark.operators.hierarchy import leaves_of, to_rows
from tidemark.operators.ordering import join_skewed, lay_out, ordinal, running, with_lag
from tidemark.session import checkpoint

#: Components that one task may join up; above it pointers are doubled in Spark.
LIMIT = 200_000


@dataclass
class SpanningTree:
    """A minimum spanning tree per group: ``edges`` is ``(*keys, a, b, d)`` between leaves, ``a < b``.

    ``met`` has, for every round, the pairs of blocks that met and all pairs there are.
    ``line``, of a tree over one feature column: ``(*keys, leaf, idx, a, b, d)`` in order of
    the values, each leaf with its edge to the one before.
    """

    points: DataFrame
    edges: DataFrame
    rows: DataFrame
    keys: list[str]
    by: list[str]
    row_id: str
    copies: bool
    limit: int
    met: list[tuple[int, int]]
    line: DataFrame | None = None


def _shortest(left: pd.Series, right: pd.Series, same: bool) -> dict:
    """The shortest edge to another component, for every component of either block."""

    def side(row):
        leaf = np.asarray(row["leaf"])
        order = np.argsort(leaf)
        return unpack(row)[order], leaf[order], np.asarray(row["cids"])[order]

    (xa, la, ca), (xb, lb, cb) = side(left), side(right)
    d = distances(xa, xb)
    if same:
        d = np.minimum(d, d.T)
    d[np.equal.outer(ca, cb)] = np.inf
    # Leaves ascend, so the first minimum of a row is the edge that ranks first.
    found = [(ca, la, cb, lb, d)] if same else [(ca, la, cb, lb, d), (cb, lb, ca, la, d.T)]
    out = {c: [] for c in ("cid", "other", "d", "a", "b")}
    for mine, names, others, ends, m in found:
        pick = m.argmin(axis=1)
        low = m[np.arange(len(m)), pick]
        a, b = np.minimum(names, ends[pick]), np.maximum(names, ends[pick])
        order = np.lexsort((b, a, low, mine))
        order = order[np.isfinite(low[order])]
        first = order[np.flatnonzero(np.r_[True, mine[order][1:] != mine[order][:-1]])] if len(order) else order
        for name, values in zip(out, (mine, others[pick], low, a, b)):
            out[name] += values[first].tolist()
    return out


def _roots(parent: dict) -> dict:
    """Follow parents up to the node that is its own parent."""
    root = {}
    for node in parent:
        path = []
        while node not in root and parent[node] != node:
            path.append(node)
            node = parent[node]
        top = root.get(node, node)
        root[node] = top
        root.update(dict.fromkeys(path, top))
    return root


def _contract(best: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """``(*keys, cid, root)``: what each component becomes when it joins the one its best edge leads to.

    Each edge is the best of one component or of both its ends; of two such ends
    the smaller is the root, and every chain of best edges ends in one.
    """
    both = F.count(F.lit(1)).over(Window.partitionBy(*keys, "a", "b")) == 2
    parent = F.when(both & (F.col("cid") < F.col("other")), F.col("cid")).otherwise(F.col("other"))
    step = checkpoint(best.select(*keys, "cid", parent.alias("root")))
    if (step.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) <= limit:

        def up(pdf: pd.DataFrame) -> pd.DataFrame:
            root = _roots(dict(zip(pdf["cid"].tolist(), pdf["root"].tolist())))
            return key_frame(keys, pdf, {"cid": list(root), "root": list(root.values())})

        return checkpoint(step.groupBy(*keys).applyInPandas(up, grouped_schema(step, keys, ("cid", "long"), ("root", "long"))))
    while True:
        above = step.select(*keys, F.col("cid").alias("root"), F.col("root").alias("_up"))
        step = checkpoint(step.join(above, [*keys, "root"]).select(*keys, "cid", F.col("_up").alias("root"), (F.col("_up") != F.col("root")).alias("_moved")))
        if step.filter("_moved").isEmpty():
            return step.drop("_moved")
        step = step.drop("_moved")


def _bounds(labels: DataFrame, own: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, block, bound)``: no component in the block has its shortest edge beyond ``bound``."""
    upper = own.groupBy(*keys, "cid").agg(F.min("d").alias("_upper"))
    inside = labels.select(*keys, "block", F.explode(F.array_distinct("cids")).alias("cid")).join(upper, [*keys, "cid"], "left")
    far = F.lit(float("inf"))
    inside = inside.groupBy(*keys, "block").agg(F.max(F.coalesce("_upper", far)).alias("_inside"))
    # Somewhere in the other block lies another component: surely if it has several, or if each has one.
    ends = F.inline(F.array(
        F.struct(F.col("_lo").alias("block"), F.when(F.isnull("_one_hi") | F.isnotnull("_one_lo"), F.col("far")).alias("_far")),
        F.struct(F.col("_hi").alias("block"), F.when(F.isnull("_one_lo") | F.isnotnull("_one_hi"), F.col("far")).alias("_far")),
    ))
    outside = pairs.select(*keys, ends).groupBy(*keys, "block").agg(F.min("_far").alias("_outside"))
    bound = F.least("_inside", F.coalesce("_outside", far)).alias("bound")
    return inside.join(outside, [*keys, "block"], "left").select(*keys, "block", bound)


def _along_line(points: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, leaf, idx, a, b, d)``: leaves in order of their only component, with the edge to the one before."""
    line = ordinal(points.select(*keys, "leaf", F.get("_x", F.lit(0)).alias("_v")), ["_v"], keys)
    line = with_lag(line, {"_leaf": ("leaf", 1), "_u": ("_v", 1)}, keys)
    gap, there = F.col("_v") - F.col("_u"), F.col("_leaf").isNotNull()
    a, b = F.when(there, F.least("leaf", "_leaf")), F.when(there, F.greatest("leaf", "_leaf"))
    return checkpoint(line.select(*keys, "leaf", "idx", a.alias("a"), b.alias("b"), F.sqrt(gap * gap).alias("d")))


def _runs(line: DataFrame, keys: list[str], gone: Column) -> DataFrame:
    """``(*keys, leaf, root)``: the run of every leaf on the line when the edges that are ``gone`` are taken out."""
    gone = F.coalesce(gone | ~_finite(), F.lit(False)).cast("long")
    laid = lay_out(line.select(*keys, "leaf", "idx", gone.alias("_gone")), ["idx"], keys)
    return checkpoint(running(laid, ["idx"], {"root": (F.col("_gone"), "sum")}, keys).select(*keys, "leaf", "root"))


def _finite() -> Column:
    return F.col("d") < F.lit(float("inf"))


def spanning_tree(
    df: DataFrame,
    features: Sequence[str] | str,
    row_id: str,
    by: Sequence[str] = (),
    block: int = BLOCK_ROWS,
    limit: int = LIMIT,
) -> SpanningTree:
    """The minimum spanning tree over ``features`` (columns, or one array column), per group ``by``."""
    points, rows, keys, facts = leaves_of(df, features, row_id, by)
    by = list(by)
    if not isinstance(features, str) and len(features) == 1:
        line = _along_line(points, keys)
        edges = line.filter(_finite()).select(*keys, "a", "b", "d")
        return SpanningTree(points, edges, rows, keys, by, row_id, facts["w"] > 1, limit, [], line)
    packed = pack(along_curve(points, "_x").select(*keys, "leaf", "_x", "_z"), ["leaf"], "_x", ["_z", "leaf"], keys, block)
    pairs = box_pairs(packed, keys, by)
    labels = checkpoint(packed.select(*keys, "block", F.col("leaf").alias("cids")))
    schema = grouped_schema(points, keys, ("cid", "long"), ("other", "long"), ("d", "double"), ("a", "long"), ("b", "long"))
    edges, met, total = None, [], None
    one = lambda side: labels.select(
        *keys, F.col("block").alias(f"_{side}"), F.when(F.array_min("cids") == F.array_max("cids"), F.array_min("cids")).alias(f"_one_{side}")
    )
    while True:
        total = pairs.count() if total is None else total
        several = F.array_min("cids") != F.array_max("cids")
        alone = labels.filter(several).select(*keys, F.col("block").alias("_lo"), F.col("block").alias("_hi"))
        full = packed.join(labels, [*keys, "block"])
        own = checkpoint(meet_some(full, keys, alone, schema, _shortest))
        # Blocks of one and the same component are through with each other for good.
        marked = pairs.drop("_one_lo", "_one_hi").join(one("lo"), [*keys, "_lo"]).join(one("hi"), [*keys, "_hi"])
        pairs = checkpoint(marked.filter(~F.coalesce(F.col("_one_lo") == F.col("_one_hi"), F.lit(False))))
        bounds = checkpoint(_bounds(labels, own, pairs, keys))
        bound = lambda side: bounds.select(*keys, F.col("block").alias(f"_{side}"), F.col("bound").alias(f"_bound_{side}"))
        # A margin for distances and boxes that were rounded in different orders.
        reach = F.col("near") - 1e-6 * F.col("far") <= F.greatest("_bound_lo", "_bound_hi")
        wanted = checkpoint(pairs.join(bound("lo"), [*keys, "_lo"]).join(bound("hi"), [*keys, "_hi"]).filter(reach).select(*keys, "_lo", "_hi"))
        met.append((wanted.count(), total))
        found = own.unionByName(meet_some(full, keys, wanted, schema, _shortest))
        best = found.groupBy(*keys, "cid").agg(F.min(F.struct("d", "a", "b", "other")).alias("_m"))
        best = checkpoint(best.select(*keys, "cid", "_m.*"))
        if best.isEmpty():
            met.pop()
            break
        new = checkpoint(best.select(*keys, "a", "b", "d").distinct())
        edges = new if edges is None else edges.unionByName(new)
        place = labels.select(*keys, "block", F.explode(F.array_distinct("cids")).alias("cid")).join(_contract(best, keys, limit), [*keys, "cid"], "left")
        place = place.groupBy(*keys, "block").agg(F.map_from_entries(F.collect_list(F.struct("cid", F.coalesce("root", "cid")))).alias("_to"))
        moved = F.transform("cids", lambda c: F.element_at(F.col("_to"), c)).alias("cids")
        labels = checkpoint(labels.join(place, [*keys, "block"]).select(*keys, "block", moved))
    if edges is None:
        edges = best.select(*keys, "a", "b", "d")
    return SpanningTree(points, edges, rows, keys, by, row_id, facts["w"] > 1, limit, met)


def _forest(tree: SpanningTree, edges: DataFrame) -> DataFrame:
    """``(*keys, leaf, root)``: the component of every leaf when only ``edges`` are kept."""
    keys = tree.keys
    at = checkpoint(tree.points.select(*keys, "leaf", F.col("leaf").alias("root")))
    live = checkpoint(edges.select(*keys, F.col("a").alias("p"), F.col("b").alias("q"), "d", "a", "b"))
    while not live.isEmpty():
        ends = F.inline(F.array(
            F.struct(F.col("p").alias("cid"), F.col("q").alias("other")), F.struct(F.col("q").alias("cid"), F.col("p").alias("other"))
        ))
        every = live.select(*keys, "d", "a", "b", ends)
        best = every.groupBy(*keys, "cid").agg(F.min(F.struct("d", "a", "b", "other")).alias("_m")).select(*keys, "cid", "_m.*")
        step = _contract(best, keys, tree.limit)
        to = lambda name: step.select(*keys, F.col("cid").alias(name), F.col("root").alias(f"_{name}"))
        sizes = at.groupBy(*keys, "root").agg(F.count(F.lit(1)).alias("_n"))
        grown = sizes.join(to("root"), [*keys, "root"], "left").withColumn("_root", F.coalesce("_root", "root"))
        at = checkpoint(join_skewed(at, grown, [*keys, "root"], "_n").select(*keys, "leaf", F.col("_root").alias("root")))
        # Every end of a live edge has a best edge, so both joins find their row.
        moved = live.join(to("p"), [*keys, "p"]).join(to("q"), [*keys, "q"]).filter("_p <> _q")
        live = checkpoint(moved.select(*keys, F.col("_p").alias("p"), F.col("_q").alias("q"), "d", "a", "b"))
    return at


def cut(tree: SpanningTree, ks: Sequence[int]) -> DataFrame:
    """Labels at several cluster counts: ``(*by, row_id, k, label)``, as :func:`hierarchy.cut` gives them."""
    ks = sorted(set(ks))
    if not ks or ks[0] < 1:
        raise ValueError("cluster counts start at 1")
    keys = tree.keys
    last = [F.desc("d"), F.desc("a"), F.desc("b")]
    if tree.by:
        order = Window.partitionBy(*keys).orderBy(*last)
        top = tree.edges.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") < ks[-1]).drop("_rn")
    else:
        top = tree.edges.orderBy(*last).limit(ks[-1] - 1)
    top = checkpoint(top)
    if tree.line is None:
        at = _forest(tree, tree.edges.join(top, [*keys, "a", "b"], "left_anti"))
    else:
        taken = top.select(*keys, "a", "b", F.lit(True).alias("_top"))
        at = _runs(tree.line.join(taken, [*keys, "a", "b"], "left"), keys, F.coalesce("_top", F.lit(False)))
    parts = checkpoint(at.groupBy(*keys, "root").agg(F.min("leaf").alias("leaf"), F.count(F.lit(1)).alias("_n")))
    end = lambda name: at.select(*keys, F.col("leaf").alias(name), F.col("root").alias(f"_{name}"))
    between = top.join(end("a"), [*keys, "a"]).join(end("b"), [*keys, "b"])

    def number(edges: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        # At most max(ks) components, and one edge fewer, per group.
        parts = parts.sort_values("leaf")
        edges = edges.sort_values(["d", "a", "b"])
        slot = {root: i for i, root in enumerate(parts["root"].tolist())}
        values = np.zeros((len(parts), len(ks)), int)
        for at_k, k in enumerate(ks):
            label = np.arange(len(parts))
            for p, q in zip(edges["_a"].tolist()[: max(len(parts) - k, 0)], edges["_b"].tolist()):
                low, high = sorted((label[slot[p]], label[slot[q]]))
                label[label == high] = low
            values[:, at_k] = np.unique(label, return_inverse=True)[1]
        return key_frame(keys, parts, {"root": parts["root"].tolist(), "values": values.tolist(), "_n": parts["_n"].tolist()})

    schema = grouped_schema(tree.points, keys, ("root", "long"), ("values", "array<long>"), ("_n", "long"))
    named = checkpoint(between.groupBy(*keys).cogroup(parts.groupBy(*keys)).applyInPandas(number, schema))
    rows = to_rows(tree, join_skewed(at, named, [*keys, "root"], "_n").select(*keys, "leaf", "values"))
    kth = F.posexplode(F.arrays_zip(F.array(*map(F.lit, ks)).alias("k"), F.col("values").alias("label")))
    return rows.select(*tree.by, tree.row_id, kth.alias("_at", "_c")).select(
        *tree.by, tree.row_id, F.col("_c.k").alias("k"), F.col("_c.label").cast("int").alias("label")
    )


def cut_height(tree: SpanningTree, height: float) -> DataFrame:
    """Clusters below a height line: ``(*by, row_id, cluster)``, named by smallest row id."""
    keys = tree.keys
    kept = F.col("d") <= F.lit(float(height))
    at = _forest(tree, tree.edges.filter(kept)) if tree.line is None else _runs(tree.line, keys, ~kept)
    names = at.groupBy(*keys, "root").agg(F.min("leaf").alias("cluster"), F.count(F.lit(1)).alias("_n"))
    leaves = join_skewed(at, names, [*keys, "root"], "_n").select(*keys, "leaf", "cluster")
    return to_rows(tree, leaves).select(*tree.by, tree.row_id, "cluster")
