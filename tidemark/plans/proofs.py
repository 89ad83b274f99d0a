"""Queries on inputs for which SQL can state the answer of an iterative operator.

One feature under single linkage is gaps and islands; a window of two lags has
vectors in closed form; a short table allows a greedy merge as a recursion.
The ``_rounds`` queries send the same table through the distributed rounds of
the tree, with the same SQL.
"""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.sql import functions as F

from tidemark.functions.expressions import hash_uniform
from tidemark.operators import aggregate, autocorrelation, cleaning, decomposition, events, filters, hierarchy, ordering, pca, selection, spanning, wide
from tidemark.operators.lloyd import Lloyd
from tidemark.plans import winter
from tidemark.plans.catalog import _DRAWS, QUERIES, SQL, indexed, query
from tidemark.plans.tables import DAILY, INDEXED, daily, day, r6, table
from tidemark.session import scratch_path
from tidemark.sources import feeds

__all__ = ["QUERIES", "SQL"]


# Series


@query(f"""WITH RECURSIVE {INDEXED}, m AS (SELECT idx, latcent - avg(latcent) OVER () AS x FROM idx), l AS (SELECT range AS lag FROM range(31)),
r AS (SELECT list(acf ORDER BY lag) AS rho FROM (SELECT lag, sum(a.x * b.x) / (SELECT sum(x * x) FROM m) AS acf FROM l JOIN m a ON TRUE JOIN m b ON b.idx = a.idx + lag GROUP BY lag)),
d(k, phi, e, last) AS (SELECT 0, []::DOUBLE[], 1.0::DOUBLE, 1.0::DOUBLE UNION ALL
  SELECT k + 1, list_append([phi[i] - last * phi[k + 1 - i] for i in range(1, k + 1)], last), e * (1 - last * last), last
  FROM (SELECT k, phi, e, (rho[k + 2] - coalesce(list_sum([phi[i] * rho[k + 2 - i] for i in range(1, k + 1)]), 0)) / e AS last FROM d, r WHERE k < 30))
SELECT k::INT AS lag, round(last, 6) + 0.0 AS pacf FROM d""")
def partial_autocorrelation(spark, folder):
    return autocorrelation.pacf(indexed(spark, folder), "latcent", 30).select("lag", r6("pacf").alias("pacf"))


@query(f"""WITH {INDEXED}, m AS (SELECT idx, latcent - avg(latcent) OVER () AS x FROM idx), t AS (SELECT sum(x * x) AS v, count(*) AS n FROM m)
SELECT lag::INT AS lag, round((SELECT sum(a.x * b.x) FROM m a JOIN m b ON b.idx = a.idx + lag) / v, 6) + 0.0 AS acf
FROM t, (SELECT unnest(range(1501)) AS lag) WHERE lag < n""")
def long_autocorrelation(spark, folder):
    """As many lags as an analysis of several years asks for."""
    return autocorrelation.acf(indexed(spark, folder), "latcent", 1_500).select("lag", r6("acf").alias("acf"))


def _two_lags(centre: bool) -> str:
    """``w``: windows of two lags of x(g, idx, v); ``u``: their leading vector per g."""
    p, q = ("(p - mp)", "(q - mq)") if centre else ("p", "q")
    return f"""w AS (SELECT a.g, a.idx, a.v AS p, b.v AS q FROM x a JOIN x b ON b.g = a.g AND b.idx = a.idx + 1),
mu AS (SELECT g, avg(p) AS mp, avg(q) AS mq, max(idx) AS top FROM w GROUP BY g),
mo AS (SELECT g, sum({p} * {p}) AS a, sum({q} * {q}) AS b, sum({p} * {q}) AS c FROM w JOIN mu USING (g) GROUP BY g),
ev AS (SELECT g, c, (a + b) / 2 + sqrt((a - b) * (a - b) / 4 + c * c) - a AS t FROM mo),
u AS (SELECT g, c / sqrt(c * c + t * t) AS v1, t / sqrt(c * c + t * t) AS v2, mp, mq, top FROM ev JOIN mu USING (g)),
z AS (SELECT g, idx, v1 * {p} + v2 * {q} AS s FROM w JOIN u USING (g))"""


_SSA_FIT = """fit AS (SELECT x.g, x.idx, x.v, (coalesce(v1 * f.s, 0) + coalesce(v2 * b.s, 0)) / ((f.s IS NOT NULL)::INT + (b.s IS NOT NULL)::INT) AS value
FROM x JOIN u USING (g) LEFT JOIN z f ON f.g = x.g AND f.idx = x.idx LEFT JOIN z b ON b.g = x.g AND b.idx = x.idx - 1)"""


@query(f"""WITH {INDEXED}, x AS (SELECT 0 AS g, idx, latcent AS v FROM idx), {_two_lags(False)}, {_SSA_FIT}
SELECT idx, round(value, 6) + 0.0 AS leading, round(v - value, 6) + 0.0 AS ssa_latcent FROM fit""")
def ssa_two_lags(spark, folder):
    """The leading component of two lags, and the series without it."""
    i = indexed(spark, folder).select("idx", "latcent")
    leading = decomposition.ssa(i, "latcent", 2, 1).filter("component = 0").select("idx", r6("value").alias("leading"))
    rest = decomposition.ssa_deseasonalise(i, "latcent", 2, 1).select("idx", r6("ssa_latcent").alias("ssa_latcent"))
    return leading.join(rest, "idx")


@query(f"""WITH {INDEXED}, x AS (SELECT 0 AS g, idx, latcent AS v FROM idx), {_two_lags(True)}
SELECT x.idx, round(CASE WHEN x.idx <= top THEN x.v - mp - v1 * f.s ELSE x.v - mq - v2 * l.s END, 6) + 0.0 AS eeof_latcent
FROM x JOIN u USING (g) LEFT JOIN z f ON f.idx = x.idx LEFT JOIN z l ON l.idx = top""")
def eeof_two_lags(spark, folder):
    out = decomposition.eeof_deseasonalise(indexed(spark, folder), "latcent", 2, 1)
    return out.select("idx", r6("eeof_latcent").alias("eeof_latcent"))


@query(f"""WITH {INDEXED}, x AS (SELECT 0 AS g, idx, latcent AS v FROM idx), {_two_lags(True)},
l AS (SELECT (a + b) / 2 AS h, sqrt((a - b) * (a - b) / 4 + c * c) AS d FROM mo)
SELECT 'percent' AS panel, 0 AS component, 1::BIGINT AS at, round((h + d) / (2 * h) * 100, 6) + 0.0 AS size FROM l UNION ALL
SELECT 'percent', 1, 2, round((h - d) / (2 * h) * 100, 6) + 0.0 FROM l UNION ALL
SELECT 'eeof', 0, 0, round(abs(v1), 6) + 0.0 FROM u UNION ALL SELECT 'eeof', 0, 1, round(abs(v2), 6) + 0.0 FROM u UNION ALL
SELECT 'eeof', 1, 0, round(abs(v2), 6) + 0.0 FROM u UNION ALL SELECT 'eeof', 1, 1, round(abs(v1), 6) + 0.0 FROM u UNION ALL
SELECT 'epc', 0, idx, round(abs(s), 6) + 0.0 FROM z UNION ALL
SELECT 'epc', 1, w.idx, round(abs(v2 * (p - u.mp) - v1 * (q - u.mq)), 6) + 0.0 FROM w JOIN u USING (g)""")
def eigen_spectrum_two_lags(spark, folder):
    out = decomposition.eigen_spectrum(indexed(spark, folder), "latcent", 2, 2)
    return out.select("panel", "component", "at", r6(F.abs("value")).alias("size"))


@query(f"""WITH {DAILY}, c AS (SELECT make_date(2000, month(string), day(string)) AS date, avg(area) AS area, avg(ar) AS ar FROM daily GROUP BY ALL),
x AS (SELECT g, date, v, row_number() OVER (PARTITION BY g ORDER BY date) - 1 AS idx FROM (SELECT date, unnest(['area', 'ar']) AS g, unnest([area, ar]) AS v FROM c)),
{_two_lags(False)}, {_SSA_FIT}
SELECT fit.g AS feature, strftime(date, '%Y-%m-%d') AS date, round(fit.v, 6) + 0.0 AS mean, round(value, 6) + 0.0 AS trend, round(value, 6) + 0.0 AS rebuilt FROM fit JOIN x ON x.g = fit.g AND x.idx = fit.idx""")
def yearly_cycle_two_lags(spark, folder):
    out = decomposition.seasonal_cycle(daily(spark, folder), "string", ["area", "ar"], "day", 2, 1)
    return out.select("feature", day("date").alias("date"), *[r6(c).alias(c) for c in ("mean", "trend", "rebuilt")])


# Trees of a short table, merged greedily

_NATIONS = """pts AS (SELECT c_nationkey::BIGINT AS id, round(avg(c_acctbal) / 1000, 6)::DOUBLE AS x, (count(*) / 5)::DOUBLE AS y FROM customer GROUP BY c_nationkey),
dist AS (SELECT a.id AS a, b.id AS b, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM pts a JOIN pts b ON a.id <> b.id)"""
_APART = {
    "complete": "max(d)", "average": "avg(d)", "single": "min(d)",
    "ward": "sqrt(2.0 * any_value(a.n) * any_value(b.n) / (any_value(a.n) + any_value(b.n))) * sqrt((any_value(a.mx) - any_value(b.mx)) * (any_value(a.mx) - any_value(b.mx)) + (any_value(a.my) - any_value(b.my)) * (any_value(a.my) - any_value(b.my)))",
}


def _greedy(method: str) -> str:
    """r_<method>(step, id, cl, node, h): clusters after each merge, named by their smallest row."""
    return f"""r_{method}(step, id, cl, node, h) AS (SELECT 0, id, id, (SELECT count(*) FROM pts p WHERE p.id < pts.id), NULL::DOUBLE FROM pts UNION ALL
 SELECT step + 1, r.id, CASE WHEN cl = hi THEN lo ELSE cl END, CASE WHEN cl IN (lo, hi) THEN (SELECT count(*) FROM pts) + step ELSE node END, t.h
 FROM r_{method} r, (SELECT a.cl AS lo, b.cl AS hi, {_APART[method]} AS h
  FROM (SELECT q.id, q.cl, count(*) OVER (PARTITION BY q.cl) AS n, avg(x) OVER (PARTITION BY q.cl) AS mx, avg(y) OVER (PARTITION BY q.cl) AS my FROM r_{method} q JOIN pts ON pts.id = q.id) a
  JOIN (SELECT q.id, q.cl, count(*) OVER (PARTITION BY q.cl) AS n, avg(x) OVER (PARTITION BY q.cl) AS mx, avg(y) OVER (PARTITION BY q.cl) AS my FROM r_{method} q JOIN pts ON pts.id = q.id) b ON a.cl < b.cl
  JOIN dist ON dist.a = a.id AND dist.b = b.id GROUP BY a.cl, b.cl ORDER BY h::FLOAT, lo, hi LIMIT 1) t)"""


def _cuts_sql(methods) -> str:
    parts = " UNION ALL ".join(f"SELECT '{m}' AS method, * FROM r_{m}" for m in methods)
    return f"""WITH RECURSIVE {_NATIONS}, {", ".join(map(_greedy, methods))}, e AS ({parts}), n AS (SELECT count(*) AS n FROM pts)
SELECT method, id AS row_id, (n - step)::INT AS k, (dense_rank() OVER (PARTITION BY method, step ORDER BY cl) - 1)::INT AS label FROM e, n WHERE n - step BETWEEN 2 AND 6"""


def _nations(spark, folder):
    c = table(spark, folder, "customer").groupBy(F.col("c_nationkey").cast("long").alias("id"))
    return c.agg(F.round(F.avg("c_acctbal") / 1000, 6).alias("x"), (F.count(F.lit(1)) / 5).alias("y"))


def _nation_cuts(spark, folder, methods, **options):
    points, out = _nations(spark, folder), None
    for method in methods:
        labels = hierarchy.cut(hierarchy.linkage(points, ["x", "y"], "id", method, **options), range(2, 7))
        labels = labels.select(F.lit(method).alias("method"), F.col("id").alias("row_id"), "k", "label")
        out = labels if out is None else out.unionByName(labels)
    return out


@query(_cuts_sql(hierarchy.LINKAGES))
def nation_trees(spark, folder):
    return _nation_cuts(spark, folder, hierarchy.LINKAGES)


@query(_cuts_sql(("complete", "average")))
def nation_trees_rounds(spark, folder):
    return _nation_cuts(spark, folder, ("complete", "average"), finish=9, block=7)


@query(_cuts_sql(("single", "ward")))
def nation_trees_more_rounds(spark, folder):
    return _nation_cuts(spark, folder, ("single", "ward"), finish=9, block=7)


_MERGES = f"""WITH RECURSIVE {_NATIONS}, {_greedy("complete")}, n AS (SELECT count(*) AS n FROM pts),
m AS (SELECT a.step, min(a.node) AS l, max(a.node) AS r, any_value(b.h) AS h, count(*) AS size FROM r_complete a JOIN r_complete b ON b.step = a.step + 1 AND b.id = a.id AND b.node <> a.node GROUP BY a.step)"""
_MERGE_ROWS = f"""{_MERGES} SELECT step::BIGINT AS step, l AS "left", r AS "right", round(h, 6) + 0.0 AS height, size FROM m"""


@query(_MERGE_ROWS)
def nation_merges(spark, folder):
    tree = hierarchy.linkage(_nations(spark, folder), ["x", "y"], "id", "complete")
    return hierarchy.merge_table(tree).withColumn("height", r6("height"))


@query(_MERGE_ROWS)
def nation_merges_rounds(spark, folder):
    tree = hierarchy.linkage(_nations(spark, folder), ["x", "y"], "id", "complete", finish=9, block=7)
    return hierarchy.merge_table(tree).withColumn("height", r6("height"))


@query(f"""{_MERGES}, t(depth, step) AS (SELECT 0, max(step) FROM m UNION ALL SELECT depth + 1, c - n FROM t JOIN m USING (step), n, unnest([l, r]) k(c) WHERE depth < 3 AND c >= n)
SELECT depth, m.step::BIGINT AS step, l AS "left", r AS "right", round(h, 6) + 0.0 AS height, size FROM t JOIN m USING (step)""")
def nation_tree_top(spark, folder):
    tree = hierarchy.linkage(_nations(spark, folder), ["x", "y"], "id", "complete")
    return hierarchy.tree_levels(hierarchy.merge_table(tree), 3).withColumn("height", r6("height"))


# One feature under single linkage


def _islands(k_max: int, source: str = "src") -> str:
    """lab(rep, idx, v, k, c): clusters c of ``source``(rep, idx, v) between the k - 1 widest gaps."""
    return f"""ga AS (SELECT rep, idx, v, v - lag(v) OVER (PARTITION BY rep ORDER BY v, idx) AS gap FROM {source}),
gr AS (SELECT *, CASE WHEN gap IS NOT NULL THEN row_number() OVER (PARTITION BY rep, gap IS NULL ORDER BY gap DESC) END AS r FROM ga),
lab AS (SELECT rep, idx, v, k, coalesce(sum((r < k)::INT) OVER (PARTITION BY rep, k ORDER BY v, idx), 0) AS c FROM gr, range(1, {k_max + 1}) t(k))"""


_AREA = "src AS (SELECT -1 AS rep, idx, area AS v FROM idx)"


@query(f"""WITH {INDEXED}, {_AREA}, s AS (SELECT idx, v, CASE WHEN v - lag(v) OVER (ORDER BY v, idx) > 0.004 THEN 1 ELSE 0 END AS b FROM src),
i AS (SELECT idx, sum(b) OVER (ORDER BY v, idx) AS c FROM s) SELECT idx, min(idx) OVER (PARTITION BY c) AS cluster FROM i""")
def single_linkage_line(spark, folder):
    """Cut by height: gaps and islands."""
    return hierarchy.cut_height(hierarchy.linkage(indexed(spark, folder), ["area"], "idx", "single"), 0.004)


@query(f"""WITH {INDEXED}, {_AREA}, {_islands(6)}, f AS (SELECT *, min(idx) OVER (PARTITION BY k, c) AS first FROM lab)
SELECT idx, k::INT AS k, (dense_rank() OVER (PARTITION BY k ORDER BY first) - 1)::INT AS label FROM f WHERE k IN (2, 4, 6)""")
def single_linkage_islands(spark, folder):
    return hierarchy.cut(hierarchy.linkage(indexed(spark, folder), ["area"], "idx", "single"), [2, 4, 6])


@query(f"""WITH {INDEXED}, {_AREA}, {_islands(6)}, f AS (SELECT *, min(idx) OVER (PARTITION BY k, c) AS first FROM lab)
SELECT idx, k::INT AS k, (dense_rank() OVER (PARTITION BY k ORDER BY first) - 1)::INT AS label FROM f WHERE k IN (2, 4, 6)""")
def spanning_islands(spark, folder):
    """The cuts of ``single_linkage_islands`` from a minimum spanning tree."""
    return spanning.cut(spanning.spanning_tree(indexed(spark, folder), ["area"], "idx", block=256), [2, 4, 6])


@query("""WITH g AS (SELECT *, CASE WHEN o_totalprice - lag(o_totalprice) OVER w > 5.005 THEN 1 ELSE 0 END AS n FROM orders
  WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey)),
r AS (SELECT *, sum(n) OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS c FROM g)
SELECT o_orderpriority, o_orderkey, min(o_orderkey) OVER (PARTITION BY o_orderpriority, c) AS cluster FROM r""")
def order_price_islands(spark, folder):
    """Orders of a priority whose prices are linked by steps of at most 5.005, over the whole table."""
    tree = spanning.spanning_tree(table(spark, folder, "orders"), ["o_totalprice"], "o_orderkey", ["o_orderpriority"])
    return spanning.cut_height(tree, 5.005)


@query(f"""WITH {INDEXED}, a AS (SELECT -1 AS rep, idx, area AS v FROM idx), b AS (SELECT -1 AS rep, idx, ar AS v FROM idx), {_islands(3, "a")},
x AS (SELECT idx, dense_rank() OVER (ORDER BY first) - 1 AS y FROM (SELECT idx, min(idx) OVER (PARTITION BY c) AS first FROM lab WHERE k = 3)),
{_islands(4, "b").replace("ga AS", "gb AS").replace("FROM ga", "FROM gb").replace("gr AS", "gs AS").replace("FROM gr", "FROM gs").replace("lab AS", "lac AS")},
z AS (SELECT idx, dense_rank() OVER (ORDER BY first) - 1 AS y FROM (SELECT idx, min(idx) OVER (PARTITION BY c) AS first FROM lac WHERE k = 4))
SELECT idx, x.y::INT AS y_area, z.y::INT AS y_ar FROM x JOIN z USING (idx)""")
def single_feature_sets(spark, folder):
    out = selection.cluster_sets(indexed(spark, folder), {"y_area": (["area"], 3), "y_ar": (["ar"], 4)}, "idx", "single")
    return out.select("idx", "y_area", "y_ar")


_GAPS = f"""WITH {INDEXED}, {_DRAWS}, src AS (SELECT -1 AS rep, idx, ar AS v FROM idx UNION ALL SELECT rep, idx, ar FROM draw), {_islands(5)},
wk AS (SELECT rep, k, ln(sum(s)) AS w FROM (SELECT rep, k, c, count(*) * var_pop(v) / 2 AS s FROM lab GROUP BY rep, k, c) GROUP BY rep, k),
gaps AS (SELECT k, avg(w) FILTER (rep >= 0) - max(w) FILTER (rep < 0) AS gap, stddev_pop(w) FILTER (rep >= 0) * sqrt(1 + 1.0 / 3) AS s FROM wk GROUP BY k)"""


@query(f"""{_GAPS} SELECT k::INT AS k, round(gap, 6) + 0.0 AS gap, round(s, 6) + 0.0 AS s FROM gaps""")
def gap_of_islands(spark, folder):
    out = selection.gap_statistic(indexed(spark, folder), ["ar"], "idx", 5, 3, "single", seed=7)
    return out.select("k", r6("gap").alias("gap"), r6("s").alias("s"))


@query(f"""{_GAPS} SELECT min(a.k)::INT AS k FROM gaps a JOIN gaps b ON b.k = a.k + 1 WHERE a.gap >= b.gap - b.s""")
def gap_choice_of_islands(spark, folder):
    return selection.gap_choice(selection.gap_statistic(indexed(spark, folder), ["ar"], "idx", 5, 3, "single", seed=7))


@query(f"""WITH {INDEXED}, {_AREA}, {_islands(5)}, s AS (SELECT k, sum(d) AS inertia FROM (SELECT k, c, count(*) * var_pop(v) AS d FROM lab GROUP BY k, c) GROUP BY k)
SELECT k::INT AS k, round(inertia / (SELECT count(*) FROM src), 6) + 0.0 AS distortion, round(inertia, 6) + 0.0 AS inertia FROM s""")
def elbow_of_islands(spark, folder):
    out = selection.elbow(indexed(spark, folder), ["area"], "idx", 5, "single")
    return out.select("k", r6("distortion").alias("distortion"), r6("inertia").alias("inertia"))


_SILHOUETTES = f"""WITH {INDEXED}, {_AREA}, {_islands(4)}, pd AS (SELECT a.k, a.idx, a.c, b.c AS o, avg(abs(a.v - b.v)) AS d FROM lab a JOIN lab b ON a.k = b.k AND a.idx <> b.idx WHERE a.k > 1 GROUP BY ALL),
sl AS (SELECT k, idx, coalesce(max(d) FILTER (c = o), 0) AS i, min(d) FILTER (c <> o) AS e, bool_or(c = o) AS many FROM pd GROUP BY k, idx),
sc AS (SELECT k, avg(CASE WHEN many AND greatest(e, i) > 0 THEN (e - i) / greatest(e, i) ELSE 0 END) AS s FROM sl GROUP BY k)"""


@query(f"""{_SILHOUETTES} SELECT k::INT AS k, round(s, 6) + 0.0 AS silhouette FROM sc""")
def silhouette_of_islands(spark, folder):
    out = selection.silhouette_method(indexed(spark, folder), ["area"], "idx", 4, "single")
    return out.select("k", r6("silhouette").alias("silhouette"))


@query(f"""{_SILHOUETTES} SELECT first(k ORDER BY s DESC, k)::INT AS k FROM sc""")
def silhouette_choice_of_islands(spark, folder):
    return selection.silhouette_choice(selection.silhouette_method(indexed(spark, folder), ["area"], "idx", 4, "single"))


@query(f"""WITH {DAILY}, v AS (SELECT CASE WHEN form = 'S' THEN 3.0 ELSE 1.0 END AS v FROM daily)
SELECT 1 AS k, round(var_pop(v), 6) + 0.0 AS distortion, round(count(*) * var_pop(v), 6) + 0.0 AS inertia FROM v UNION ALL SELECT 2, 0.0, 0.0""")
def kmeans_of_two_values(spark, folder):
    """An estimator in place of a linkage, on a feature with two values."""
    d = indexed(spark, folder).select("idx", F.when(F.col("form") == "S", 3.0).otherwise(1.0).alias("v"))
    out = selection.elbow(d, ["v"], "idx", 2, KMeans(seed=1, maxIter=10))
    return out.select("k", r6("distortion").alias("distortion"), r6("inertia").alias("inertia"))


@query(SQL["kmeans_of_two_values"])
def lloyd_of_two_values(spark, folder):
    """The grouped iteration on a feature with two values."""
    d = indexed(spark, folder).select("idx", F.when(F.col("form") == "S", 3.0).otherwise(1.0).alias("v"))
    out = selection.elbow(d, ["v"], "idx", 2, Lloyd(seed=1))
    return out.select("k", r6("distortion").alias("distortion"), r6("inertia").alias("inertia"))


_ISLANDS = "1000.0 * (o_custkey % 3) + o_totalprice / 1000000"


@query(f"""WITH o AS (SELECT o_orderpriority, o_orderkey, {_ISLANDS} AS v, 2 * (o_custkey % 3) + o_totalprice / 1000000 AS z, o_custkey % 3 AS island FROM orders),
g AS (SELECT o_orderpriority, island, min(o_orderkey) AS f, count(*) AS n, count(*) * (var_pop(v) + var_pop(z)) AS sse FROM o GROUP BY ALL)
SELECT o_orderpriority, (row_number() OVER (PARTITION BY o_orderpriority ORDER BY f) - 1)::INT AS label, n, round(sse, 4) + 0.0 AS sse FROM g""")
def lloyd_per_priority(spark, folder):
    """Three far islands per group: all groups are fitted together, and every island is one cluster."""
    third, price = F.col("o_custkey") % 3, F.col("o_totalprice") / 1000000
    o = table(spark, folder, "orders").select("o_orderpriority", "o_orderkey", (third * 1000.0 + price).alias("v"), (third * 2 + price).alias("z"))
    labels = selection.cluster_labels(o, ["v", "z"], "o_orderkey", [3], Lloyd(seed=5), ["o_orderpriority"])
    rows = labels.join(o, ["o_orderpriority", "o_orderkey"])
    out = selection.squared_error(rows, ["v", "z"], ["o_orderpriority", "label"])
    return out.select("o_orderpriority", "label", "n", F.round("sse", 4).alias("sse"))


@query("""WITH p AS (SELECT a.vec_id, a.label, b.label AS other, sum(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) ** 2) AS d, count(*) AS n
  FROM embeddings a JOIN embeddings b ON TRUE GROUP BY ALL),
r AS (SELECT vec_id, max(CASE WHEN label = other THEN d / greatest(n - 1, 1) END) AS a, max(CASE WHEN label = other THEN n END) AS n,
  min(CASE WHEN label <> other THEN d / n END) AS b FROM p GROUP BY vec_id)
SELECT 10 AS k, round(avg(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) + 0.0 AS silhouette FROM r""")
def label_squared_silhouette(spark, folder):
    e = table(spark, folder, "embeddings")
    out = selection.squared_silhouette(e, "embedding", "vec_id", e.select("vec_id", F.lit(10).alias("k"), "label"))
    return out.select("k", r6("silhouette").alias("silhouette"))


# Feeds and aggregates


@query(f"""WITH {DAILY} SELECT 'f' || (n % 2) AS part, strftime(string, '%Y-%m-%d') AS day, area, ar AS "ar,x", CASE WHEN form = 'S' THEN 'é' ELSE 'ü' END AS form FROM daily""")
def feed_folder(spark, folder):
    """A folder of latin-1 files whose headers are quoted and order the columns differently."""
    path = scratch_path(spark, "feeds")
    rows = daily(spark, folder).select(
        F.lit("D").alias("D"), F.concat(F.lit("f"), F.col("n") % 2).alias("part"), F.date_format("string", "yyyy-MM-dd").alias("day"),
        "area", F.col("ar").alias("ar,x"), F.when(F.col("form") == "S", "é").otherwise("ü").alias("form"),
    )
    writer = {"header": True, "encoding": "ISO-8859-1", "quoteAll": False}
    rows.filter("part = 'f0'").write.options(**writer).csv(f"{path}/a")
    rows.filter("part = 'f1'").select("D", "form", "`ar,x`", "area", "day", "part").write.options(**writer).csv(f"{path}/b")
    feed = feeds.read_feed(spark, [f"{path}/a", f"{path}/b"], "latin-1")
    return feed.select("part", "day", "area", "`ar,x`", "form")


_KURT = "CASE WHEN count(v) > 3 THEN kurtosis(v) END"


@query(f"""WITH s AS (SELECT l_suppkey, CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE l_quantity END AS v FROM lineitem),
c AS (SELECT l_suppkey, v, count(*) AS n FROM s WHERE v IS NOT NULL GROUP BY ALL), m AS (SELECT l_suppkey, first(v ORDER BY n DESC, v) AS m FROM c GROUP BY l_suppkey)
SELECT l_suppkey, round(median(v), 6) + 0.0 AS median, round(CASE WHEN count(v) > 2 THEN skewness(v) END, 6) + 0.0 AS skew, round({_KURT}, 6) + 0.0 AS kurt,
 round(stddev_samp(v) / sqrt(count(v)), 6) + 0.0 AS sem, count(*) AS size, round(any_value(m), 6) + 0.0 AS mode FROM s LEFT JOIN m USING (l_suppkey) GROUP BY l_suppkey""")
def frame_methods(spark, folder):
    """Groups without a value stay; sample skewness and kurtosis."""
    v = F.when(F.col("l_suppkey") % 9 != 0, F.col("l_quantity"))
    s, out = table(spark, folder, "lineitem").select("l_suppkey", v.alias("v")), None
    for func in ("median", "skew", "kurt", "sem", "size", "mode"):
        one = aggregate.aggregate(s, func, ["l_suppkey"], ["v"])
        one = one.select("l_suppkey", ("v" if func == "size" else r6("v").alias("v"))).withColumnRenamed("v", func)
        out = one if out is None else out.join(one, "l_suppkey")
    return out


@query("""SELECT o_custkey, first(o_totalprice ORDER BY o_orderdate, o_orderkey) AS first, last(o_totalprice ORDER BY o_orderdate, o_orderkey) AS last FROM orders GROUP BY o_custkey""")
def first_and_last(spark, folder):
    o = table(spark, folder, "orders")
    order = ["o_orderdate", "o_orderkey"]
    part = lambda f: aggregate.aggregate(o, f, ["o_custkey"], ["o_totalprice"], order).withColumnRenamed("o_totalprice", f)
    return part("first").join(part("last"), "o_custkey")


@query("""SELECT event_id, strftime(date_trunc('second', ts) + to_microseconds(event_id % 1000 * 1000), '%Y-%m-%d %H:%M:%S.%f') AS at FROM events""")
def iso_times(spark, folder):
    """ISO date-times with a fraction, half of them with a zone."""
    e = table(spark, folder, "events")
    fraction = F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0")
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), fraction, F.when(F.col("event_id") % 2 == 0, F.lit("Z")).otherwise(F.lit("")))
    parsed = cleaning.parse_time(e.select("event_id", text.alias("at")), "at")
    return parsed.select("event_id", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"))


# Components


# Eigenvectors of the symmetric matrix s(a, b, c; d, e, f) = [[a, d, e], [d, b, f], [e, f, c]] by the trigonometric solution.
_THREE = """m AS (SELECT *, (a + b + c) / 3 AS q FROM s),
n AS (SELECT *, sqrt(((a - q) * (a - q) + (b - q) * (b - q) + (c - q) * (c - q) + 2 * (d * d + e * e + f * f)) / 6) AS p FROM m),
o AS (SELECT *, ((a - q) * ((b - q) * (c - q) - f * f) - d * (d * (c - q) - e * f) + e * (d * f - e * (b - q))) / (2 * p * p * p) AS r FROM n),
h AS (SELECT *, acos(greatest(-1.0, least(1.0, r))) / 3 AS t FROM o),
l AS (SELECT i, a, b, c, d, e, f, CASE i WHEN 0 THEN q + 2 * p * cos(t) WHEN 2 THEN q + 2 * p * cos(t + 2 * pi() / 3)
  ELSE q - 2 * p * cos(t) - 2 * p * cos(t + 2 * pi() / 3) END AS v FROM h, range(3) AS k(i)),
x AS (SELECT i, v, d * f - e * (b - v) AS x, e * d - (a - v) * f AS y, (a - v) * (b - v) - d * d AS z FROM l),
g AS (SELECT i, v, sqrt(x * x + y * y + z * z) * CASE WHEN abs(x) >= greatest(abs(y), abs(z)) THEN sign(x) WHEN abs(y) >= abs(z) THEN sign(y) ELSE sign(z) END AS w, x, y, z FROM x),
u AS (SELECT i, v, x / w AS x, y / w AS y, z / w AS z FROM g),
load AS (SELECT i, v, 'ar' AS feature, x AS loading FROM u UNION ALL SELECT i, v, 'latcent', y FROM u UNION ALL SELECT i, v, 'area', z FROM u)"""


@query(f"""WITH {DAILY}, s AS (SELECT 1.0::DOUBLE AS a, 1.0::DOUBLE AS b, 1.0::DOUBLE AS c, corr(ar, latcent) AS d, corr(ar, area) AS e, corr(latcent, area) AS f FROM daily), {_THREE},
lead AS (SELECT feature, min(i) AS i FROM (SELECT i, arg_max(feature, loading) AS feature FROM load GROUP BY i) GROUP BY feature),
far AS (SELECT feature, row_number() OVER (ORDER BY sum(loading * loading) DESC) AS place FROM load WHERE i < 2 GROUP BY feature)
SELECT 'leader' AS kind, (row_number() OVER (ORDER BY i) - 1)::INT AS rank, feature FROM lead QUALIFY row_number() OVER (ORDER BY i) <= 2
UNION ALL SELECT 'longest', (2 - place)::INT, feature FROM far WHERE place <= 2""")
def component_leaders(spark, folder):
    """Leaders of the components and longest loadings of three features, whose components have a closed form."""
    d = daily(spark, folder).select("ar", "latcent", "area")
    rows = [("leader", i, f) for i, f in enumerate(pca.select_features(d, 2))]
    rows += [("longest", i, f) for i, f in enumerate(pca.top_features(pca.pca(d), 2))]
    return spark.createDataFrame(rows, "kind string, rank int, feature string")


@query(f"""WITH {DAILY}, w AS (SELECT ar * 3 AS ar, latcent / 2 AS latcent, area FROM daily),
s AS (SELECT var_samp(ar) AS a, var_samp(latcent) AS b, var_samp(area) AS c, covar_samp(ar, latcent) AS d, covar_samp(ar, area) AS e, covar_samp(latcent, area) AS f FROM w), {_THREE},
r AS (SELECT feature AS row_name, i, loading AS value FROM load UNION ALL SELECT 'Expl_var', i, v FROM u UNION ALL SELECT 'Expl_var_ratio', i, v / sum(v) OVER () FROM u)
SELECT row_name, round(max(value) FILTER (i = 0), 6) + 0.0 AS pc0, round(max(value) FILTER (i = 1), 6) + 0.0 AS pc1 FROM r GROUP BY row_name""")
def own_scaler_loadings(spark, folder):
    """Loadings after a scaler that is a function of the table and its columns."""
    factors = {"ar": 3.0, "latcent": 0.5, "area": 1.0}
    found = pca.pca(daily(spark, folder).select(*factors), scaler=lambda df, names: df.withColumns({c: F.col(c) * factors[c] for c in names}))
    return found.loadings(2).select("row_name", r6("PC0").alias("pc0"), r6("PC1").alias("pc1"))


@query(f"""WITH {DAILY}, s AS (SELECT var_samp(ar) AS a, var_samp(latcent) AS b, covar_samp(ar, latcent) AS c FROM daily),
l AS (SELECT i, a, b, c, (a + b) / 2 + CASE i WHEN 0 THEN 1 ELSE -1 END * sqrt((a - b) * (a - b) / 4 + c * c) AS v FROM s, range(2) AS k(i)),
g AS (SELECT i, v, a + b AS total, c AS x, v - a AS y, sqrt(c * c + (v - a) * (v - a)) * CASE WHEN abs(c) >= abs(v - a) THEN sign(c) ELSE sign(v - a) END AS w FROM l)
SELECT i::INT AS component, round(v, 6) + 0.0 AS variance, round(v / total, 6) + 0.0 AS ratio, round(x / w, 6) + 0.0 AS ar, round(y / w, 6) + 0.0 AS latcent FROM g""")
def wide_components(spark, folder):
    """Components of 4,000 features, of which two values of a day are the source."""
    half = 2_000
    spread = lambda c: F.array_repeat(F.col(c) / half**0.5, half)
    days = daily(spark, folder).select(F.concat(spread("ar"), spread("latcent")).alias("v"))
    found = wide.pca_wide(days, "v", 2)
    parts = zip(range(2), found.explained_variance, found.explained_ratio, found.components[:, 0] * half**0.5, found.components[:, -1] * half**0.5)
    rows = [(i, *map(float, rest)) for i, *rest in parts]
    out = spark.createDataFrame(rows, "component int, variance double, ratio double, ar double, latcent double")
    return out.select("component", *[r6(c).alias(c) for c in ("variance", "ratio", "ar", "latcent")])


@query(f"""WITH {DAILY} SELECT strftime(string, '%Y-%m-%d') AS string, round(ar, 6) + 0.0 AS ar, round(latcent, 6) + 0.0 AS latcent FROM daily""")
def positional_feed(spark, folder):
    """A feed whose columns go by position only."""
    path = scratch_path(spark, "positional")
    rows = daily(spark, folder).select(day().alias("a"), "ar", "latcent")
    rows.write.csv(path)
    named = feeds.name_columns(spark.read.csv(path, inferSchema=True))
    return named.select(day().alias("string"), r6("ar").alias("ar"), r6("latcent").alias("latcent"))


# The same work by the paths for large groups


@query(SQL["threshold_events"])
def threshold_events_unfolded(spark, folder):
    """More events than one array may hold: segments, and pointer doubling in long ones."""
    out = events.label_events(daily(spark, folder), ar_limit=1.9, latitude_limit=65, days=4, fold=1)
    return out.select(day().alias("day"), "idx", "regime")


@query("""SELECT l_returnflag, round(quantile_cont(l_quantity, 0.25), 6) + 0.0 AS low, round(median(l_quantity), 6) + 0.0 AS mid, round(quantile_cont(l_quantity, 0.75), 6) + 0.0 AS high FROM lineitem GROUP BY l_returnflag""")
def ranked_quantiles(spark, folder):
    """Quantiles from running totals over value counts."""
    out = ordering.quantiles(table(spark, folder, "lineitem"), ["l_quantity"], [0.25, 0.5, 0.75], ["l_returnflag"], small_group=0)
    return out.select("l_returnflag", *[r6(F.col("q")[i]).alias(c) for i, c in enumerate(("low", "mid", "high"))])


@query("""SELECT p_type, dense_rank() OVER (ORDER BY p_type) - 1 AS code FROM (SELECT DISTINCT p_type FROM part)""")
def indexed_codes(spark, folder):
    """Codes of more classes than the driver may sort."""
    return cleaning.label_codes(table(spark, folder, "part"), "p_type", few=3)


# The whole flow


@query(f"""WITH {DAILY}, w AS (SELECT * FROM daily WHERE month(string) IN (12, 1, 2, 3) AND n IS NOT NULL)
SELECT 2 AS k, (CASE WHEN form = 'S' THEN 1 ELSE 0 END)::INT AS form, count(*) AS rows, true AS one_class FROM w GROUP BY form""")
def regime_choice(spark, folder):
    """From feed files to a chosen k on two far regimes: each form must be one class."""
    path = scratch_path(spark, "flow")
    far = F.when(F.col("form") == "S", 100.0).otherwise(0.0)
    noise = lambda i: hash_uniform(F.lit(i), F.col("string"))
    rows = daily(spark, folder).select(
        F.lit("D").alias("D"), F.date_format("string", "dd.MM.yyyy-HH:mm:ss").alias("string"), (far + noise(0)).alias("area"),
        (far + noise(1) + 1).alias("ar"), (far / 10 + noise(2) / 10 + 60).alias("latcent"), "form",
    )
    # A wind that rises evenly over the winter rows has nothing left once its leading components are gone.
    line = ordering.ordinal(filters.season(daily(spark, folder).select("string"), "string"), ["string"])
    wind = line.select(F.lit("D").alias("D"), F.date_format("string", "dd.MM.yyyy-HH:mm").alias("string"), (F.col("idx") / 8).alias("u"))
    rows.write.option("header", True).csv(f"{path}/d")
    wind.write.option("header", True).csv(f"{path}/msw")
    day_feed = cleaning.parse_time(cleaning.clean_names(feeds.read_feed(spark, f"{path}/d")), "string", "dd.MM.yyyy-HH:mm:ss")
    wind_feed = cleaning.parse_time(cleaning.clean_names(feeds.read_feed(spark, f"{path}/msw")), "string", "dd.MM.yyyy-HH:mm")
    found, _, k = winter.regime_analysis(day_feed, wind_feed, ssa_window=8, eeof_window=8, components=2, k=None, k_max=3, replicates=3)
    classes = found.groupBy("form").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("y").alias("n"))
    return classes.select(F.lit(k).cast("int").alias("k"), F.col("form").cast("int").alias("form"), "rows", (F.col("n") == 1).alias("one_class"))
