"""Queries over the driver's tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.clustering import KMeans
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import (
    aggregate,
    autocorrelation,
    cleaning,
    decomposition,
    events,
    filters,
    geometry,
    hierarchy,
    joins,
    ordering,
    pca,
    scaling,
    scores,
    selection,
)
from tidemark.plans import winter
from tidemark.plans.tables import (
    CEN,
    DAILY,
    INDEXED,
    JOINED,
    MSW,
    SHAPES,
    SHIFT,
    USER_DAYS,
    cen,
    daily,
    day,
    joined,
    msw,
    r6,
    shapes,
    table,
    user_days,
)
from tidemark.session import scratch_path
from tidemark.sources import feeds

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
# Spark and DuckDB round a value midway between two results differently when
# its last bit differs. Both sides add the same SHIFT before they round to six
# digits, so that short binary fractions are no longer midway.
FEATURES = ["area", "ar", "latcent", "edge"]


def query(sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql.replace(", 6) + 0.0", f" + {SHIFT}, 6) + 0.0")
        return fn

    return add


def or_minus(name: str):
    """-1 for a missing count, so integer columns stay integers on both sides."""
    return F.coalesce(F.col(name), F.lit(-1).cast("long"))


def indexed(spark: SparkSession, folder: str) -> DataFrame:
    return ordering.ordinal(daily(spark, folder), ["string"])


# Sources and sinks


@query(f"""WITH {DAILY} SELECT strftime(string, '%Y-%m-%d') AS day, area, ar, n, form FROM daily""")
def feed_scan(spark, folder):
    """Daily rows written as a prefixed feed among other lines, then read and cleaned."""
    kinds = F.explode(F.array(F.lit("# note"), F.lit("D"), F.lit("X")))
    lines = daily(spark, folder).select(
        kinds.alias("D"), F.date_format("string", "dd.MM.yyyy-HH:mm:ss").alias(" string"), F.col("area").alias(" area"),
        F.col("ar").alias(" ar"), F.col("n").alias(" n"), F.concat(F.lit("  "), "form").alias(" form"),
    )
    path = scratch_path(spark, "feed")
    blanks = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    lines.write.options(header=True, **blanks).csv(path)
    feed = cleaning.clean_names(feeds.read_feed(spark, path))
    feed = cleaning.parse_time(feed, "string", "dd.MM.yyyy-HH:mm:ss")
    return feed.select(day().alias("day"), "area", "ar", "n", "form")


@query(f"""WITH {DAILY} SELECT form, count(*) AS rows, round(avg(ar), 6) + 0.0 AS ar FROM daily GROUP BY form""")
def csv_sink(spark, folder):
    path = scratch_path(spark, "result")
    feeds.write_csv(daily(spark, folder).groupBy("form").agg(F.count(F.lit(1)).alias("rows"), r6(F.avg("ar")).alias("ar")), path)
    return spark.read.schema("form string, rows long, ar double").option("header", True).csv(path)


# Cleaning and recoding


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders""")
def parse_times(spark, folder):
    """Two written layouts in one column; the named one first, the rest by fallback."""
    o = table(spark, folder, "orders")
    text = F.when(F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "dd.MM.yyyy-HH:mm")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    parsed = cleaning.parse_time(o.withColumn("text", text), "text", "dd.MM.yyyy-HH:mm", fallback=True)
    return parsed.select("o_orderkey", day("text").alias("day"))


@query("""SELECT l_returnflag, count(x) AS numbers, round(sum(x), 6) + 0.0 AS total FROM (
  SELECT l_returnflag, TRY_CAST(CASE WHEN l_linestatus = 'O' THEN CAST(l_quantity AS VARCHAR) ELSE l_returnflag END AS DOUBLE) AS x
  FROM lineitem) GROUP BY l_returnflag""")
def numeric_coercion(spark, folder):
    li = table(spark, folder, "lineitem")
    text = F.when(F.col("l_linestatus") == "O", F.col("l_quantity").cast("string")).otherwise(F.col("l_returnflag"))
    return cleaning.to_numeric(li.select("l_returnflag", text.alias("x")), ["x"]).groupBy("l_returnflag").agg(
        F.count("x").alias("numbers"), r6(F.sum("x")).alias("total")
    )


@query(f"""WITH {JOINED} SELECT strftime(string, '%Y-%m-%d') AS day, coalesce(u, 0) + 0.0 AS u FROM joined""")
def fill_missing(spark, folder):
    return cleaning.fill_missing(joined(spark, folder), 0, ["u"]).select(day().alias("day"), "u")


@query(f"""WITH {JOINED} SELECT strftime(string, '%Y-%m-%d') AS day, area, ar, latcent, edge, n, u FROM joined WHERE u IS NOT NULL""")
def numeric_selection(spark, folder):
    picked = cleaning.select_numeric(cleaning.drop_missing(joined(spark, folder), ["u"]), ["string"])
    return picked.withColumn("day", day()).drop("string")


@query(f"""WITH {JOINED}, fc AS (SELECT form, dense_rank() OVER (ORDER BY form) - 1 AS c FROM (SELECT DISTINCT form FROM daily)),
mc AS (SELECT "MW", dense_rank() OVER (ORDER BY "MW") - 1 AS c FROM (SELECT DISTINCT "MW" FROM msw))
SELECT strftime(string, '%Y-%m-%d') AS day, fc.c::BIGINT AS form, coalesce(mc.c, -1)::BIGINT AS "MW", joined."MW" AS flag
FROM joined JOIN fc USING (form) LEFT JOIN mc ON joined."MW" = mc."MW" """)
def label_encoding(spark, folder):
    """Encode two columns and look one of them up again."""
    j = joined(spark, folder)
    codes = cleaning.label_codes(j, "MW")
    out = cleaning.encode_labels(cleaning.encode_labels(j, "form"), "MW", codes=codes)
    out = cleaning.decode_labels(out, "MW", codes, "flag")
    return out.select(day().alias("day"), "form", or_minus("MW").alias("MW"), "flag")


@query(f"""WITH {DAILY} SELECT CASE WHEN form = 'S' THEN 'split' ELSE form END AS form, count(*) AS n FROM daily GROUP BY 1""")
def recode_values(spark, folder):
    return cleaning.recode(daily(spark, folder), "form", {"S": "split", "U": "undisturbed"}).groupBy("form").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {INDEXED} SELECT idx, CASE WHEN idx <= 309 THEN round(area / 1000, 6) + 0.0 ELSE round(ar * 1000, 6) + 0.0 END AS value FROM idx""")
def position_assignment(spark, folder):
    out = cleaning.assign_by_position(indexed(spark, folder), "value", 309, r6(F.col("area") / 1000), r6(F.col("ar") * 1000))
    return out.select("idx", "value")


@query(f"""WITH {DAILY}, c AS (SELECT month(string) AS m, day(string) AS d, avg(area) AS a FROM daily GROUP BY ALL)
SELECT strftime(string, '%Y-%m-%d') AS day, round(area - a, 6) + 0.0 AS residual FROM daily JOIN c ON month(string) = m AND day(string) = d""")
def residual_of_climatology(spark, folder):
    d = daily(spark, folder).withColumn("date", F.make_date(F.lit(2000), F.month("string"), F.dayofmonth("string")))
    fit = aggregate.climatology(d, "string", ["area"], "day").withColumnRenamed("area", "value")
    return joins.residual(d, "area", fit, "residual", ["date"]).select(day().alias("day"), r6("residual").alias("residual"))


@query(f"""WITH {JOINED} SELECT * FROM (
  SELECT 0 AS position, 'string' AS "column", 'timestamp_ntz' AS dtype, count(string) AS non_null FROM joined UNION ALL
  SELECT 1, 'area', 'double', count(area) FROM joined UNION ALL SELECT 2, 'ar', 'double', count(ar) FROM joined UNION ALL
  SELECT 3, 'latcent', 'double', count(latcent) FROM joined UNION ALL SELECT 4, 'edge', 'double', count(edge) FROM joined UNION ALL
  SELECT 5, 'n', 'bigint', count(n) FROM joined UNION ALL SELECT 6, 'form', 'string', count(form) FROM joined UNION ALL
  SELECT 7, 'u', 'double', count(u) FROM joined UNION ALL SELECT 8, 'MW', 'string', count("MW") FROM joined)""")
def column_overview(spark, folder):
    return cleaning.column_overview(joined(spark, folder))


# Filters


@query(f"""WITH {DAILY} SELECT strftime(string, '%Y-%m-%d') AS day, area FROM daily WHERE month(string) IN (12, 1, 2, 3)""")
def season_filter(spark, folder):
    return filters.season(daily(spark, folder), "string").select(day().alias("day"), "area")


@query(f"""WITH {DAILY} SELECT strftime(string, '%Y-%m-%d') AS day, area FROM daily
WHERE string > TIMESTAMP '1996-03-01' AND string < TIMESTAMP '1998-02-01'""")
def date_range(spark, folder):
    return filters.between(daily(spark, folder), "string", "1996-03-01", "1998-02-01", closed=False).select(day().alias("day"), "area")


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders, (SELECT max(o_orderdate) AS hi FROM orders)
WHERE o_orderdate >= TIMESTAMP '2000-01-01' AND o_orderdate <= hi""")
def clipped_range(spark, folder):
    from datetime import datetime

    kept, _ = filters.clip_range(table(spark, folder, "orders"), "o_orderdate", datetime(2000, 1, 1), datetime(2030, 1, 1))
    return kept.select("o_orderkey", day("o_orderdate").alias("day"))


@query(f"""WITH {INDEXED} SELECT idx, area FROM idx WHERE idx >= 100 AND idx < (SELECT count(*) FROM daily) - 399""")
def row_slice(spark, folder):
    return ordering.slice_rows(indexed(spark, folder), 100, -399).select("idx", "area")


@query(f"""WITH {DAILY} SELECT strftime(string, '%Y-%m-%d') AS day, ar FROM daily WHERE NOT (ar > 2.1 OR area > 1.5)""")
def extreme_exclusion(spark, folder):
    return filters.exclude(daily(spark, folder), (F.col("ar") > 2.1) | (F.col("area") > 1.5)).select(day().alias("day"), "ar")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem
WHERE l_shipdate IN (SELECT o_orderdate FROM orders WHERE o_totalprice > 480000)""")
def date_membership(spark, folder):
    dates = table(spark, folder, "orders").filter("o_totalprice > 480000").select("o_orderdate")
    return filters.in_dates(table(spark, folder, "lineitem"), "l_shipdate", dates).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query(f"""WITH {JOINED} SELECT DISTINCT "MW" FROM joined WHERE "MW" IS NOT NULL""")
def distinct_flags(spark, folder):
    return aggregate.distinct_values(joined(spark, folder), "MW")


# Joins


@query(f"""WITH {DAILY}, {MSW} SELECT strftime(string, '%Y-%m-%d') AS day, daily.n AS n_d, coalesce(msw.n, -1) AS n_msw, u, "MW" FROM daily LEFT JOIN msw USING (string)""")
def left_join_suffixes(spark, folder):
    out = joins.join_on(daily(spark, folder), msw(spark, folder), "string")
    return out.select(day().alias("day"), "n_d", or_minus("n_msw").alias("n_msw"), "u", "MW")


@query(f"""WITH {DAILY}, {MSW}, {CEN} SELECT strftime(string, '%Y-%m-%d') AS day, daily.n AS n_d, coalesce(msw.n, -1) AS n_msw, coalesce(cen.n, -1) AS n_cen, coalesce(intensity, 0) AS intensity
FROM daily LEFT JOIN msw USING (string) LEFT JOIN cen USING (string)""")
def three_feed_join(spark, folder):
    out = joins.join_feeds(daily(spark, folder), msw(spark, folder), cen(spark, folder))
    out = cleaning.fill_missing(cleaning.fill_missing(out, 0, ["intensity"]), -1, ["n_msw", "n_cen"])
    return out.select(day().alias("day"), "n_d", "n_msw", "n_cen", "intensity")


@query(f"""WITH {DAILY}, {MSW} SELECT strftime(string, '%Y-%m-%d') AS day, area, u FROM daily JOIN msw USING (string)""")
def inner_join(spark, folder):
    out = joins.join_on(daily(spark, folder), msw(spark, folder).select("string", "u"), "string", "inner")
    return out.select(day().alias("day"), "area", "u")


@query("""SELECT d.doc_id, d.n_chars, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, -1) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)""")
def label_append(spark, folder):
    found = table(spark, folder, "labels")
    tables = {c: found.select("doc_id", F.col(c).alias("label")) for c in ("quality", "toxic")}
    out = joins.append_labels(table(spark, folder, "documents").select("doc_id", "n_chars"), tables, "doc_id")
    return cleaning.fill_missing(out, -1, ["quality", "toxic"])


# Aggregates


@query(f"""WITH {DAILY} SELECT * FROM (
  SELECT 'mean' AS f, round(avg(area), 6) + 0.0 AS area, round(avg(ar), 6) + 0.0 AS ar, round(avg(latcent), 6) + 0.0 AS latcent FROM daily UNION ALL
  SELECT 'median', round(median(area), 6) + 0.0, round(median(ar), 6) + 0.0, round(median(latcent), 6) + 0.0 FROM daily UNION ALL
  SELECT 'std', round(stddev_samp(area), 6) + 0.0, round(stddev_samp(ar), 6) + 0.0, round(stddev_samp(latcent), 6) + 0.0 FROM daily UNION ALL
  SELECT 'range', round(max(area) - min(area), 6) + 0.0, round(max(ar) - min(ar), 6) + 0.0, round(max(latcent) - min(latcent), 6) + 0.0 FROM daily)""")
def column_aggregates(spark, folder):
    d = daily(spark, folder)
    funcs = {"mean": "mean", "median": "median", "std": "std", "range": lambda c: F.max(c) - F.min(c)}
    out = None
    for name, func in funcs.items():
        row = aggregate.aggregate(d, func, columns=FEATURES[:3]).select(F.lit(name).alias("f"), *[r6(c).alias(c) for c in FEATURES[:3]])
        out = row if out is None else out.unionByName(row)
    return out


@query("""SELECT l_suppkey, round(median(l_quantity), 6) + 0.0 AS l_quantity, round(median(l_extendedprice), 6) + 0.0 AS l_extendedprice FROM lineitem GROUP BY l_suppkey""")
def grouped_median(spark, folder):
    out = aggregate.aggregate(table(spark, folder, "lineitem"), "median", ["l_suppkey"], ["l_quantity", "l_extendedprice"])
    return out.select("l_suppkey", r6("l_quantity").alias("l_quantity"), r6("l_extendedprice").alias("l_extendedprice"))


@query("""SELECT o_orderpriority, round(sum(o_totalprice), 2) + 0.0 AS o_totalprice FROM orders GROUP BY o_orderpriority""")
def grouped_sum(spark, folder):
    out = aggregate.aggregate(table(spark, folder, "orders"), "sum", ["o_orderpriority"], ["o_totalprice"])
    return out.select("o_orderpriority", (F.round("o_totalprice", 2) + 0.0).alias("o_totalprice"))


@query(f"""WITH {JOINED} SELECT form, feature, round(min(v), 6) + 0.0 AS min, round(max(v), 6) + 0.0 AS max, round(avg(v), 6) + 0.0 AS mean FROM (
  SELECT form, unnest(['area', 'ar', 'latcent', 'edge', 'n', 'u']) AS feature, unnest([area, ar, latcent, edge, n::DOUBLE, u]) AS v FROM joined)
GROUP BY form, feature""")
def class_profile(spark, folder):
    out = aggregate.class_profile(joined(spark, folder), "form")
    return out.select("form", "feature", *[r6(c).alias(c) for c in ("min", "max", "mean")])


@query("""SELECT label, count(*) AS count FROM embeddings GROUP BY label""")
def class_sizes(spark, folder):
    return aggregate.class_sizes(table(spark, folder, "embeddings"), "label")


@query(f"""WITH {JOINED}, t AS (SELECT count(*) AS total FROM joined), k AS (SELECT * FROM joined WHERE "MW" IS NOT NULL),
m AS (SELECT DISTINCT "MW" FROM k UNION ALL SELECT 'All'), f AS (SELECT DISTINCT form FROM k UNION ALL SELECT 'All'),
g AS (SELECT coalesce(form, 'All') AS form, coalesce("MW", 'All') AS "MW", count(u) AS n FROM k GROUP BY CUBE (form, "MW"))
SELECT f.form, m."MW", coalesce(g.n, 0)::BIGINT AS n, round(coalesce(g.n, 0) / total * 100, 6) + 0.0 AS percent
FROM f CROSS JOIN m CROSS JOIN t LEFT JOIN g ON f.form = g.form AND m."MW" = g."MW" """)
def crosstab(spark, folder):
    return aggregate.crosstab(joined(spark, folder), "form", "MW", "u").withColumn("percent", r6("percent"))


@query(f"""WITH {JOINED}, p AS (SELECT unnest(['y_ar', 'y_u']) AS prediction, unnest([CASE WHEN ar >= 1.8 THEN 'S' ELSE 'D' END, CASE WHEN u < 240 THEN 'S' WHEN u >= 240 THEN 'D' END]) AS y, form FROM joined),
c AS (SELECT prediction, count(*) FILTER (y = 'S' AND form = 'S') AS tp, count(*) FILTER (y = 'S' AND form <> 'S') AS fp,
 count(*) FILTER (y IS DISTINCT FROM 'S' AND form = 'S') AS fn, count(*) FILTER (y IS DISTINCT FROM 'S' AND form <> 'S') AS tn FROM p GROUP BY prediction)
SELECT prediction, tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) + 0.0 AS accuracy, round(tp / (tp + fp), 6) + 0.0 AS precision,
 round(tp / (tp + fn), 6) + 0.0 AS recall, round((2 * tp) / (2 * tp + fp + fn), 6) + 0.0 AS f1 FROM c""")
def agreement_scores(spark, folder):
    """Scores of two rules; over many orders a day no mean price may be under the limit of ``y_u``."""
    j = joined(spark, folder).withColumns({
        "y_ar": F.when(F.col("ar") >= 1.8, "S").otherwise("D"),
        "y_u": F.when(F.col("u") < 240, "S").when(F.col("u") >= 240, "D"),
    })
    out = scores.agreement(j, "form", ["y_ar", "y_u"], absent="count")
    return out.select("prediction", "tp", "fp", "fn", "tn", *[r6(c).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@query(f"""WITH {JOINED} SELECT feature, round(corr(v, area), 6) + 0.0 AS area, round(corr(v, ar), 6) + 0.0 AS ar, round(corr(v, latcent), 6) + 0.0 AS latcent, round(corr(v, u), 6) + 0.0 AS u
FROM (SELECT unnest(['area', 'ar', 'latcent', 'u']) AS feature, unnest([area, ar, latcent, u]) AS v, area, ar, latcent, u FROM joined) GROUP BY feature""")
def correlation_matrix(spark, folder):
    cols = ["area", "ar", "latcent", "u"]
    return aggregate.correlation(joined(spark, folder), cols).select("feature", *[r6(c).alias(c) for c in cols])


@query(f"""WITH {DAILY} SELECT strftime(make_date(year(string), 1, 1), '%Y-%m-%d') AS date, round(avg(area), 6) + 0.0 AS area, round(avg(ar), 6) + 0.0 AS ar FROM daily GROUP BY year(string)""")
def yearly_means(spark, folder):
    out = aggregate.climatology(daily(spark, folder), "string", ["area", "ar"])
    return out.select(day("date").alias("date"), r6("area").alias("area"), r6("ar").alias("ar"))


@query(f"""WITH {DAILY} SELECT strftime(make_date(2000, month(string), day(string)), '%Y-%m-%d') AS date, round(avg(area), 6) + 0.0 AS area, round(avg(ar), 6) + 0.0 AS ar FROM daily GROUP BY month(string), day(string)""")
def calendar_day_means(spark, folder):
    out = aggregate.climatology(daily(spark, folder), "string", ["area", "ar"], "day")
    return out.select(day("date").alias("date"), r6("area").alias("area"), r6("ar").alias("ar"))


_AUTO_BINS = """a AS (SELECT min(x) AS lo, max(x) AS hi, count(x) AS n, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr FROM d),
e AS (SELECT lo, hi, ceil((hi - lo) / least((hi - lo) / (log2(n) + 1), 2 * iqr / pow(n, 1.0 / 3)))::INT AS bins FROM a)"""


@query(f"""WITH d AS (SELECT lang AS label, n_chars::DOUBLE AS x FROM documents), {_AUTO_BINS},
b AS (SELECT label, least(floor((x - lo) * bins / (hi - lo)), bins - 1)::INT AS bin, count(*) AS n FROM d, e GROUP BY ALL),
c AS (SELECT label, count(*) AS total, avg(x) AS m FROM d GROUP BY label)
SELECT label, bin, round(lo + bin * ((hi - lo) / bins), 6) + 0.0 AS low, round(lo + (bin + 1) * ((hi - lo) / bins), 6) + 0.0 AS high, n,
 round(n / total * 100, 6) + 0.0 AS percent, round(m, 6) + 0.0 AS class_mean FROM b JOIN c USING (label), e""")
def class_histogram(spark, folder):
    out = aggregate.class_histogram(table(spark, folder, "documents"), "n_chars", "lang")
    return out.select("label", "bin", "n", *[r6(c).alias(c) for c in ("low", "high", "percent", "class_mean")])


@query(f"""WITH {DAILY}, d AS (SELECT form AS label, area AS v FROM daily), p AS (SELECT min(v) AS lo, max(v) AS hi FROM d),
f AS (SELECT label, count(*) AS n, stddev_samp(v) * pow(count(*), -0.2) AS h, avg(v) AS m FROM d GROUP BY label),
g AS (SELECT i AS point, lo + (hi - lo) * i / 199 AS x FROM p, range(200) t(i))
SELECT d.label, point::INT AS point, round(any_value(x), 6) + 0.0 AS x,
 round(sum(exp(-0.5 * pow((x - v) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 6) + 0.0 AS density, round(any_value(m), 6) + 0.0 AS class_mean
FROM d JOIN f USING (label) CROSS JOIN g GROUP BY d.label, point""")
def class_density(spark, folder):
    out = aggregate.class_density(daily(spark, folder), "area", "form")
    return out.select("label", "point", r6("x").alias("x"), r6("density").alias("density"), r6("class_mean").alias("class_mean"))


@query(f"""WITH {DAILY}, s AS (SELECT form AS label, (ar - min(ar) OVER ()) / (max(ar) OVER () - min(ar) OVER ()) AS ar,
 (latcent - min(latcent) OVER ()) / (max(latcent) OVER () - min(latcent) OVER ()) AS latcent FROM daily),
d AS (SELECT label, unnest(['ar', 'latcent']) AS feature, unnest([ar, latcent]) AS v FROM s),
f AS (SELECT label, feature, count(*) AS n, stddev_samp(v) * pow(count(*), -0.2) AS h, avg(v) AS m, min(v) AS lo, max(v) AS hi FROM d GROUP BY label, feature),
g AS (SELECT label, feature, n, h, m, i AS point, lo + (hi - lo) * i / 99 AS x FROM f, range(100) t(i))
SELECT label, feature, point::INT AS point, round(any_value(x), 6) + 0.0 AS x,
 round(sum(exp(-0.5 * pow((x - v) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 6) + 0.0 AS density, round(any_value(m), 6) + 0.0 AS class_mean
FROM d JOIN g USING (label, feature) GROUP BY label, feature, point""")
def violin_table(spark, folder):
    d = daily(spark, folder).select("form", *FEATURES)
    out = aggregate.class_distributions(d, "form", ["ar", "latcent"])
    return out.select("label", "feature", "point", *[r6(c).alias(c) for c in ("x", "density", "class_mean")])


@query("""WITH g AS (SELECT o_orderpriority AS label, unnest(['o_totalprice', 'o_custkey']) AS feature, unnest([avg(o_totalprice), avg(o_custkey)]) AS value FROM orders GROUP BY o_orderpriority),
f AS (SELECT feature, avg(value) AS m, stddev_pop(value) AS s, min(value) AS lo, max(value) AS hi FROM g GROUP BY feature)
SELECT label, feature, round(value, 6) + 0.0 AS value, round((value - m) / s, 6) + 0.0 AS scaled, value = lo AS is_min, value = hi AS is_max FROM g JOIN f USING (feature)""")
def class_radar(spark, folder):
    o = table(spark, folder, "orders").select("o_orderpriority", "o_totalprice", "o_custkey")
    out = aggregate.class_radar(o, "o_orderpriority", ["o_totalprice", "o_custkey"])
    return out.select("label", "feature", r6("value").alias("value"), r6("scaled").alias("scaled"), "is_min", "is_max")


@query("""SELECT round(sum(l_quantity * l_discount) / sum(l_quantity), 6) + 0.0 AS mean FROM lineitem""")
def weighted_mean(spark, folder):
    return aggregate.weighted_mean(table(spark, folder, "lineitem"), "l_discount", "l_quantity").select(r6("mean").alias("mean"))


@query(f"""WITH {DAILY} SELECT 'area' AS feature, strftime(first(string ORDER BY area DESC, string), '%Y-%m-%d') AS day FROM daily UNION ALL
SELECT 'ar', strftime(first(string ORDER BY ar DESC, string), '%Y-%m-%d') FROM daily""")
def arg_max(spark, folder):
    out = aggregate.arg_max(daily(spark, folder), "string", ["area", "ar"])
    return out.select("feature", day().alias("day"))


@query(f"""WITH {JOINED}, {CEN}, w AS (SELECT cen.string AS anchor, joined.* FROM cen JOIN joined ON joined.string BETWEEN cen.string - INTERVAL 1 DAY AND cen.string + INTERVAL 1 DAY)
SELECT strftime(anchor, '%Y-%m-%d') AS anchor, bool_or(form = 'S') AS split, coalesce(bool_or("MW" = 'Y'), FALSE) AS warming, count(*) AS days FROM w GROUP BY anchor""")
def anchor_windows(spark, folder):
    """Whether a split or a warming falls within a day of each large-order date."""
    j = joined(spark, folder).withColumns({"split": (F.col("form") == "S").cast("int"), "warming": (F.col("MW") == "Y").cast("int"), "days": F.lit(1)})
    near = filters.around(j, "string", cen(spark, folder).select("string").withColumnRenamed("string", "t"), 1, 1)
    flags = aggregate.any_flag(near, ["split", "warming"], ["anchor"])
    return flags.join(aggregate.class_sizes(near, "anchor").withColumnRenamed("count", "days"), "anchor").withColumn("anchor", day("anchor"))


# Order and events


@query(f"""WITH {INDEXED} SELECT strftime(string, '%Y-%m-%d') AS day, idx FROM idx""")
def row_order(spark, folder):
    return indexed(spark, folder).select(day().alias("day"), "idx")


@query("""SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM events""")
def row_order_per_series(spark, folder):
    return ordering.ordinal(table(spark, folder, "events"), ["ts", "event_id"], ["user_id"]).select("event_id", "user_id", "idx")


@query(f"""WITH {INDEXED} SELECT idx, ntile(7) OVER (ORDER BY idx) AS part, round(idx / (count(*) OVER () - 1), 6) + 0.0 AS position FROM idx""")
def contiguous_groups(spark, folder):
    return ordering.time_groups(indexed(spark, folder), 7).select("idx", "part", r6("position").alias("position"))


@query(f"""WITH {INDEXED}, f AS (SELECT string, idx, idx - row_number() OVER (ORDER BY idx) AS run FROM idx WHERE latcent <= 64.5)
SELECT min(idx) AS start, max(idx) + 1 AS "end", strftime(min(string), '%Y-%m-%d') AS first_day, strftime(max(string), '%Y-%m-%d') AS last_day
FROM f GROUP BY run HAVING count(*) >= 3""")
def low_latitude_runs(spark, folder):
    runs = events.flag_runs(daily(spark, folder), F.col("latcent") <= 64.5, "string", 3)
    return runs.select("start", "end", day("start_time").alias("first_day"), day("last_time").alias("last_day"))


@query(f"""WITH {USER_DAYS}, i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) - 1 AS idx FROM user_days),
f AS (SELECT user_id, day, idx, datediff('day', DATE '1800-01-01', day::DATE) - row_number() OVER (PARTITION BY user_id ORDER BY day) AS run FROM i WHERE value > 50)
SELECT user_id, min(idx) AS start, max(idx) + 1 AS "end" FROM f GROUP BY user_id, run HAVING count(*) >= 2""")
def user_day_runs(spark, folder):
    """Runs of consecutive calendar days, in many series at once."""
    runs = events.flag_runs(user_days(spark, folder), F.col("value") > 50, "day", 2, ["user_id"], by_calendar=True)
    return runs.select("user_id", "start", "end")


def _events_sql(source: str, series: str, ar: str, lat: str, time: str, days: int, spacing: int) -> str:
    """Islands, then a recursive walk from each accepted event to the next start late enough."""
    return f"""i AS (SELECT *, row_number() OVER (PARTITION BY {series} ORDER BY {time}) - 1 AS idx FROM {source}),
r AS (SELECT {series} AS k, 'displaced' AS kind, min(idx) AS s, max(idx) AS e, min({time}) AS t0, max({time}) AS t1 FROM
  (SELECT *, idx - row_number() OVER (PARTITION BY {series} ORDER BY idx) AS run FROM i WHERE {lat}) GROUP BY {series}, run HAVING count(*) >= {days}
 UNION ALL SELECT {series}, 'split', min(idx), max(idx), min({time}), max({time}) FROM
  (SELECT *, idx - row_number() OVER (PARTITION BY {series} ORDER BY idx) AS run FROM i WHERE {ar}) GROUP BY {series}, run HAVING count(*) >= {days}),
o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t0, kind, e, s) AS q FROM r),
w AS (SELECT k, q, t1, kind, s, e FROM o WHERE q = 1 UNION ALL
 SELECT n.k, n.q, n.t1, n.kind, n.s, n.e FROM (
  SELECT o.*, row_number() OVER (PARTITION BY o.k, w.q ORDER BY o.q) AS pick FROM w JOIN o ON o.k = w.k AND o.q > w.q AND o.t0 - w.t1 >= INTERVAL {spacing} DAY) n WHERE pick = 1)"""


@query(f"""WITH RECURSIVE {DAILY}, z AS (SELECT *, 0 AS zero FROM daily), {_events_sql("z", "zero", "ar >= 1.9", "latcent <= 65", "string", 4, 30)}
SELECT strftime(string, '%Y-%m-%d') AS day, idx, coalesce(w.kind, 'undisturbed') AS regime FROM i LEFT JOIN w ON i.idx BETWEEN w.s AND w.e""")
def threshold_events(spark, folder):
    out = events.label_events(daily(spark, folder), ar_limit=1.9, latitude_limit=65, days=4)
    return out.select(day().alias("day"), "idx", "regime")


@query(f"""WITH RECURSIVE {USER_DAYS}, {_events_sql("user_days", "user_id", "n >= 2", "value <= 60", "day", 2, 5)}
SELECT user_id, strftime(day, '%Y-%m-%d') AS day, idx, coalesce(w.kind, 'undisturbed') AS regime FROM i LEFT JOIN w ON i.user_id = w.k AND i.idx = w.e""")
def threshold_events_per_series(spark, folder):
    """The last row of accepted events in many series."""
    out = events.label_events(user_days(spark, folder), "day", "n", "value", 2, 60, 2, 5, "last", ["user_id"])
    return out.select("user_id", day("day").alias("day"), "idx", "regime")


@query(f"""WITH RECURSIVE {DAILY}, z AS (SELECT *, 0 AS zero FROM daily WHERE month(string) IN (12, 1, 2, 3)), {_events_sql("z", "zero", "ar >= 2.4", "latcent <= 66", "string", 3, 30)},
l AS (SELECT form, coalesce(w.kind, 'undisturbed') AS y FROM i LEFT JOIN w ON i.idx BETWEEN w.s AND w.e),
c AS (SELECT count(*) FILTER (y = 'displaced' AND form = 'S') AS tp, count(*) FILTER (y = 'displaced' AND form <> 'S') AS fp,
 count(*) FILTER (y <> 'displaced' AND form = 'S') AS fn, count(*) FILTER (y <> 'displaced' AND form <> 'S') AS tn FROM l)
SELECT 'regime' AS prediction, tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) + 0.0 AS accuracy, round(tp / (tp + fp), 6) + 0.0 AS precision,
 round(tp / (tp + fn), 6) + 0.0 AS recall, round((2 * tp) / (2 * tp + fp + fn), 6) + 0.0 AS f1 FROM c""")
def winter_event_scores(spark, folder):
    """The flagship: join, season, scale, label events, score them against a flag."""
    labelled = winter.winter_events(daily(spark, folder), msw(spark, folder), days=3)
    out = winter.event_scores(labelled, "displaced")
    return out.select("prediction", "tp", "fp", "fn", "tn", *[r6(c).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


# Autocorrelation


@query(f"""WITH {INDEXED}, p AS (SELECT unnest(['area', 'ar', 'latcent']) AS feature, unnest([a.area, a.ar, a.latcent]) AS x, unnest([b.area, b.ar, b.latcent]) AS y FROM idx a JOIN idx b ON a.idx = b.idx + 3)
SELECT feature, round(corr(x, y), 6) + 0.0 AS autocorrelation FROM p GROUP BY feature""")
def lag_correlation(spark, folder):
    out = autocorrelation.lag_correlation(indexed(spark, folder), ["area", "ar", "latcent"], 3)
    return out.select("feature", r6("autocorrelation").alias("autocorrelation"))


@query(f"""WITH {INDEXED}, m AS (SELECT idx, latcent - avg(latcent) OVER () AS x FROM idx), l AS (SELECT range AS lag FROM range(31))
SELECT lag::INT AS lag, round(sum(a.x * b.x) / (SELECT sum(x * x) FROM m), 6) + 0.0 AS acf FROM l JOIN m a ON TRUE JOIN m b ON b.idx = a.idx + lag GROUP BY lag""")
def autocorrelation_function(spark, folder):
    return autocorrelation.acf(indexed(spark, folder), "latcent", 30).select("lag", r6("acf").alias("acf"))


@query("""WITH i AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM events),
m AS (SELECT user_id, idx, value - avg(value) OVER (PARTITION BY user_id) AS x FROM i), z AS (SELECT user_id, sum(x * x) AS s, count(*) AS n FROM m GROUP BY user_id),
l AS (SELECT range AS lag FROM range(4))
SELECT user_id, lag::INT AS lag, CASE WHEN any_value(s) > 0.000000001 THEN round(sum(a.x * b.x) / any_value(s), 5) + 0.0 END AS acf
FROM z JOIN l ON lag < n JOIN m a USING (user_id) JOIN m b ON b.user_id = a.user_id AND b.idx = a.idx + lag GROUP BY user_id, lag""")
def autocorrelation_per_series(spark, folder):
    i = ordering.ordinal(table(spark, folder, "events").select("user_id", "ts", "event_id", "value"), ["ts", "event_id"], ["user_id"])
    return autocorrelation.acf(i, "value", 3, ["user_id"]).select("user_id", "lag", (F.round("acf", 5) + 0.0).alias("acf"))


@query(f"""WITH {INDEXED}, p AS (SELECT a.ar, b.ar AS ar0, a.latcent, b.latcent AS lat0 FROM idx a LEFT JOIN idx b ON a.idx = b.idx + 1)
SELECT 'ar' AS feature, round(sum((ar - ar0) * (ar - ar0)) / sum(ar * ar), 6) + 0.0 AS durbin_watson, TRUE AS seasonal FROM p UNION ALL
SELECT 'latcent', round(sum((latcent - lat0) * (latcent - lat0)) / sum(latcent * latcent), 6) + 0.0, TRUE FROM p""")
def durbin_watson(spark, folder):
    out = autocorrelation.durbin_watson(indexed(spark, folder), ["ar", "latcent"])
    return out.select("feature", r6("durbin_watson").alias("durbin_watson"), "seasonal")


def _dw_sql(name: str, y: str, a: str, b: str) -> str:
    return f"""SELECT '{name}' AS feature, sum((r - r0) * (r - r0)) / sum(r * r) AS dw FROM (
 SELECT r, lag(r) OVER (ORDER BY idx) AS r0 FROM (SELECT idx, {y} - (s.{y}{a} * s.{b}{b} - s.{y}{b} * s.{a}{b}) / (s.{a}{a} * s.{b}{b} - s.{a}{b} * s.{a}{b}) * {a}
  - (s.{y}{b} * s.{a}{a} - s.{y}{a} * s.{a}{b}) / (s.{a}{a} * s.{b}{b} - s.{a}{b} * s.{a}{b}) * {b} AS r FROM z, s))"""


@query(f"""WITH {INDEXED}, z AS (SELECT idx, (area - avg(area) OVER ()) / stddev_pop(area) OVER () AS p, (ar - avg(ar) OVER ()) / stddev_pop(ar) OVER () AS q,
 (latcent - avg(latcent) OVER ()) / stddev_pop(latcent) OVER () AS r FROM idx),
s AS (SELECT sum(p * p) AS pp, sum(q * q) AS qq, sum(r * r) AS rr, sum(p * q) AS pq, sum(p * q) AS qp, sum(p * r) AS pr, sum(p * r) AS rp, sum(q * r) AS qr, sum(q * r) AS rq FROM z)
SELECT feature, round(dw, 6) + 0.0 AS durbin_watson, dw < 1.5 OR dw > 2.5 AS seasonal FROM ({_dw_sql("scaled_area", "p", "q", "r")} UNION ALL {_dw_sql("scaled_ar", "q", "p", "r")} UNION ALL {_dw_sql("scaled_latcent", "r", "p", "q")})""")
def seasonality_check(spark, folder):
    cols = FEATURES[:3]
    out = autocorrelation.seasonality_check(scaling.scale(daily(spark, folder), cols), [f"scaled_{c}" for c in cols], ["string"])
    return out.select("feature", r6("durbin_watson").alias("durbin_watson"), "seasonal")


# Decomposition


@query(f"""WITH {INDEXED} SELECT a.idx, (b.idx - a.idx)::INT AS lag, b.latcent AS value FROM idx a JOIN idx b ON b.idx BETWEEN a.idx AND a.idx + 9
WHERE a.idx <= (SELECT max(idx) FROM idx) - 9""")
def delay_windows(spark, folder):
    out = decomposition.delay_windows(indexed(spark, folder), "latcent", 10)
    return out.select("idx", F.posexplode("values").alias("lag", "value"))


@query(f"""WITH {INDEXED} SELECT idx, round(latcent, 6) + 0.0 AS rebuilt FROM idx""")
def ssa_all_components(spark, folder):
    """The sum of all components is the signal."""
    out = decomposition.ssa(indexed(spark, folder), "latcent", 40, None, together=True)
    return out.select("idx", r6("value").alias("rebuilt"))


@query(f"""WITH {INDEXED}, w AS (SELECT a.idx, sum(b.latcent * b.latcent) AS s FROM idx a JOIN idx b ON b.idx BETWEEN a.idx AND a.idx + 39
 WHERE a.idx <= (SELECT max(idx) FROM idx) - 39 GROUP BY a.idx) SELECT round(sum(s) / 1000000, 6) + 0.0 AS trace, 40::BIGINT AS components FROM w""")
def ssa_trace(spark, folder):
    """Eigenvalues add up to the squared values over all windows."""
    out = decomposition.ssa_spectrum(indexed(spark, folder), "latcent", 40)
    return out.agg(r6(F.sum("eigenvalue") / 1000000).alias("trace"), F.count(F.lit(1)).alias("components"))


@query()
def ssa_leading_components(spark, folder):
    out = decomposition.ssa(indexed(spark, folder), "latcent", 120, 4)
    return out.select("idx", "component", r6("value").alias("value"))


@query()
def ssa_deseasonalised(spark, folder):
    out = decomposition.ssa_deseasonalise(indexed(spark, folder), "latcent", 120, 4)
    return out.select("idx", "latcent", r6("ssa_latcent").alias("ssa_latcent"))


@query(f"""WITH {INDEXED}, n AS (SELECT max(idx) + 1 AS n FROM idx)
SELECT a.idx, (b.idx - a.idx + 19)::INT AS lag, round(b.latcent, 6) + 0.0 AS value FROM idx a JOIN idx b ON b.idx BETWEEN a.idx - 19 AND a.idx WHERE a.idx >= 19""")
def eeof_full_rebuild(spark, folder):
    """With as many components as lags every window comes back."""
    out = decomposition.eeof_reconstruction(indexed(spark, folder), "latcent", 20, 20)
    return out.select("idx", F.posexplode("values").alias("lag", "value")).withColumn("value", r6("value"))


@query(f"""WITH {INDEXED}, w AS (SELECT a.idx, b.idx - a.idx AS lag, b.latcent AS v FROM idx a JOIN idx b ON b.idx BETWEEN a.idx AND a.idx + 19
 WHERE a.idx <= (SELECT max(idx) FROM idx) - 19) SELECT round(sum(s), 6) + 0.0 AS variance, 1.0::DOUBLE AS share FROM (SELECT lag, var_samp(v) AS s FROM w GROUP BY lag)""")
def eeof_variance(spark, folder):
    """Eigenvalues add up to the variance over all lags."""
    out = decomposition.eeof_spectrum(indexed(spark, folder), "latcent", 20, None)
    return out.agg(r6(F.sum("eigenvalue")).alias("variance"), r6(F.sum("ratio")).alias("share"))


@query(f"""WITH {INDEXED}, w AS (SELECT a.idx, b.idx - a.idx AS lag, b.latcent AS v FROM idx a JOIN idx b ON b.idx BETWEEN a.idx AND a.idx + 19
 WHERE a.idx <= (SELECT max(idx) FROM idx) - 19), m AS (SELECT idx, v - avg(v) OVER (PARTITION BY lag) AS d FROM w)
SELECT idx, round(sum(d * d), 6) + 0.0 AS length FROM m GROUP BY idx""")
def eeof_score_length(spark, folder):
    """Scores on all components keep the length of every centred window."""
    out = decomposition.eeof_scores(indexed(spark, folder), "latcent", 20, 20)
    return out.select("idx", r6(F.aggregate("scores", F.lit(0.0), lambda s, v: s + v * v)).alias("length"))


@query()
def eeof_deseasonalised(spark, folder):
    out = decomposition.eeof_deseasonalise(indexed(spark, folder), "latcent", 400, 4)
    return out.select("idx", "latcent", r6("eeof_latcent").alias("eeof_latcent"))


@query()
def eigen_spectrum(spark, folder):
    out = decomposition.eigen_spectrum(indexed(spark, folder), "latcent", 400, 9)
    return out.select("panel", "component", "at", r6(F.abs("value")).alias("size"))


@query(f"""WITH {DAILY}, c AS (SELECT make_date(2000, month(string), day(string)) AS date, avg(area) AS area, avg(ar) AS ar FROM daily GROUP BY ALL)
SELECT feature, row_number() OVER (PARTITION BY feature ORDER BY date) - 1 AS idx, strftime(date, '%Y-%m-%d') AS date, round(v, 5) + 0.0 AS mean, round(v, 5) + 0.0 AS rebuilt
FROM (SELECT date, unnest(['area', 'ar']) AS feature, unnest([area, ar]) AS v FROM c)""")
def yearly_cycle_all_components(spark, folder):
    out = decomposition.seasonal_cycle(daily(spark, folder), "string", ["area", "ar"], "day", 90, 90)
    return out.select("feature", "idx", day("date").alias("date"), (F.round("mean", 5) + 0.0).alias("mean"), (F.round("rebuilt", 5) + 0.0).alias("rebuilt"))


@query()
def yearly_cycle(spark, folder):
    out = decomposition.seasonal_cycle(daily(spark, folder), "string", ["area", "ar", "latcent"], "day")
    return out.select("feature", "idx", day("date").alias("date"), r6("mean").alias("mean"), r6("trend").alias("trend"), r6("rebuilt").alias("rebuilt"))


# Scaling and components


def _scaled_sql(kind: dict[str, str]) -> str:
    cols = ", ".join(f"round({e}, 6) + 0.0 AS {c}" for c, e in kind.items())
    return f"""WITH {DAILY} SELECT strftime(string, '%Y-%m-%d') AS day, {cols} FROM daily"""


@query(_scaled_sql({c: f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()" for c in FEATURES}))
def standard_scaling(spark, folder):
    out = scaling.scale(daily(spark, folder), FEATURES, "standard", "")
    return out.select(day().alias("day"), *[r6(c).alias(c) for c in FEATURES])


@query(_scaled_sql({c: f"({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ())" for c in FEATURES}))
def minmax_scaling(spark, folder):
    out = scaling.scale(daily(spark, folder), FEATURES, "minmax", "")
    return out.select(day().alias("day"), *[r6(c).alias(c) for c in FEATURES])


@query(f"""WITH {DAILY}, q AS (SELECT {", ".join(f"median({c}) AS m_{c}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS q_{c}" for c in FEATURES)} FROM daily)
SELECT strftime(string, '%Y-%m-%d') AS day, {", ".join(f"round(({c} - m_{c}) / q_{c}, 6) + 0.0 AS {c}" for c in FEATURES)} FROM daily, q""")
def robust_scaling(spark, folder):
    out = scaling.scale(daily(spark, folder), FEATURES, "robust", "")
    return out.select(day().alias("day"), *[r6(c).alias(c) for c in FEATURES])


@query("""WITH p AS (SELECT o_orderkey, o_totalprice, o_custkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND month(o_orderdate) IN (12, 1, 2, 3))
SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, round((o_totalprice - min(o_totalprice) OVER ()) / (max(o_totalprice) OVER () - min(o_totalprice) OVER ()), 6) + 0.0 AS o_totalprice,
 round((o_custkey - min(o_custkey) OVER ())::DOUBLE / (max(o_custkey) OVER () - min(o_custkey) OVER ()), 6) + 0.0 AS o_custkey FROM p""")
def preparation(spark, folder):
    """Parse written times, clip the range, keep winter months, scale."""
    from datetime import datetime

    o = table(spark, folder, "orders").select(F.date_format("o_orderdate", "dd.MM.yyyy-HH:mm:ss").alias("time"), "o_totalprice", "o_custkey")
    out, _ = scaling.prepare(o, "time", "dd.MM.yyyy-HH:mm:ss", datetime(1996, 1, 1), datetime(2040, 1, 1), filters.WINTER, "minmax")
    return out.select(day("time").alias("day"), r6("o_totalprice").alias("o_totalprice"), r6("o_custkey").alias("o_custkey"))


_TWO = """z AS (SELECT string, (ar - avg(ar) OVER ()) / stddev_pop(ar) OVER () AS a, (latcent - avg(latcent) OVER ()) / stddev_pop(latcent) OVER () AS b FROM daily),
c AS (SELECT corr(a, b) AS r, count(*) AS n FROM z), g AS (SELECT r, n, sqrt(0.5) AS h, CASE WHEN r >= 0 THEN 1 ELSE -1 END AS s FROM c)"""


@query(f"""WITH {DAILY}, {_TWO} SELECT 'ar' AS row_name, round(h, 6) + 0.0 AS "PC0", round(h, 6) + 0.0 AS "PC1" FROM g UNION ALL
SELECT 'latcent', round(s * h, 6) + 0.0, round(-s * h, 6) + 0.0 FROM g UNION ALL
SELECT 'Expl_var', round((1 + abs(r)) * n / (n - 1), 6) + 0.0, round((1 - abs(r)) * n / (n - 1), 6) + 0.0 FROM g UNION ALL
SELECT 'Expl_var_ratio', round((1 + abs(r)) / 2, 6) + 0.0, round((1 - abs(r)) / 2, 6) + 0.0 FROM g""")
def pca_loadings(spark, folder):
    """Two standardised features have components in closed form."""
    out = pca.pca(daily(spark, folder).select("ar", "latcent")).loadings(2)
    return out.select("row_name", r6("PC0").alias("PC0"), r6("PC1").alias("PC1"))


@query(f"""WITH {DAILY}, {_TWO} SELECT strftime(string, '%Y-%m-%d') AS day, round(h * (a + s * b), 6) + 0.0 AS "PC0", round(h * (a - s * b), 6) + 0.0 AS "PC1" FROM z, g""")
def pca_scores(spark, folder):
    out = pca.pca(daily(spark, folder).select("string", "ar", "latcent"), ["ar", "latcent"]).scores
    return out.select(day().alias("day"), r6(F.col("score")[0]).alias("PC0"), r6(F.col("score")[1]).alias("PC1"))


@query(f"""WITH {DAILY}, {_TWO}, p AS (SELECT string, h * (a + s * b) AS x, h * (a - s * b) AS y FROM z, g)
SELECT strftime(string, '%Y-%m-%d') AS day, round(x / (max(x) OVER () - min(x) OVER ()), 6) + 0.0 AS x0, round(y / (max(y) OVER () - min(y) OVER ()), 6) + 0.0 AS x1 FROM p""")
def biplot_points(spark, folder):
    found = pca.pca(daily(spark, folder).select("string", "ar", "latcent"), ["ar", "latcent"])
    return pca.biplot(found, ["string"])[0].select(day().alias("day"), r6("x0").alias("x0"), r6("x1").alias("x1"))


@query(f"""WITH {DAILY}, {_TWO}, p AS (SELECT h * (a + s * b) AS x, h * (a - s * b) AS y FROM z, g),
e AS (SELECT max(abs(x)) / (max(x) - min(x)) AS x, max(abs(y)) / (max(y) - min(y)) AS y FROM p)
SELECT 'ar' AS feature, round(x / 2, 6) + 0.0 AS x0, round(y / 2, 6) + 0.0 AS x1 FROM e UNION ALL SELECT 'latcent', round(s * x / 2, 6) + 0.0, round(-s * y / 2, 6) + 0.0 FROM e, g""")
def biplot_arrows(spark, folder):
    found = pca.pca(daily(spark, folder).select("ar", "latcent"))
    return pca.biplot(found)[1].select("feature", r6("x0").alias("x0"), r6("x1").alias("x1"))


@query("""WITH l AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS i FROM embeddings), m AS (SELECT vec_id, v - avg(v) OVER (PARTITION BY i) AS d FROM l)
SELECT vec_id, round(sum(d * d), 6) + 0.0 AS length FROM m GROUP BY vec_id""")
def embedding_score_length(spark, folder):
    """Scores on all 64 components keep the length of every centred vector."""
    found = pca.pca_array(table(spark, folder, "embeddings"), "embedding")
    return found.scores.select("vec_id", r6(F.aggregate("score", F.lit(0.0), lambda s, v: s + v * v)).alias("length"))


@query()
def feature_choice(spark, folder):
    """Leaders of the first components, and the features with the longest loadings."""
    d = joined(spark, folder).select("area", "ar", "latcent", "edge", "u").na.drop()
    leaders = pca.select_features(d, 3)
    longest = pca.top_features(pca.pca(d), 3)
    rows = [("leader", i, f) for i, f in enumerate(leaders)] + [("longest", i, f) for i, f in enumerate(longest)]
    return spark.createDataFrame(rows, "kind string, rank int, feature string")


# Clustering


@query("""WITH l AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS i FROM embeddings), s AS (SELECT DISTINCT embedding FROM embeddings)
SELECT round(sum(d), 6) + 0.0 AS total, (SELECT count(*) FROM s) - 1 AS merges FROM (SELECT count(*) * var_pop(v) AS d FROM l GROUP BY i)""")
def ward_heights(spark, folder):
    """Half the squared Ward heights add up to the squared error of all rows."""
    tree = hierarchy.linkage(table(spark, folder, "embeddings"), "embedding", "vec_id", "ward")
    return tree.merges.agg(r6(F.sum(F.col("height") * F.col("height")) / 2).alias("total"), F.count(F.lit(1)).alias("merges"))


def _linked(spark, folder, method):
    d = scaling.scale(indexed(spark, folder), ["ar", "latcent", "area"], "standard")
    return hierarchy.linkage(d, ["scaled_ar", "scaled_latcent", "scaled_area"], "idx", method)


@query()
def complete_linkage_labels(spark, folder):
    return hierarchy.cut(_linked(spark, folder, "complete"), [2, 3, 5])


@query()
def average_linkage_labels(spark, folder):
    return hierarchy.cut(_linked(spark, folder, "average"), [3])


@query()
def single_linkage_heights(spark, folder):
    return hierarchy.cut_height(_linked(spark, folder, "single"), 0.5)


@query()
def merge_table(spark, folder):
    return hierarchy.merge_table(_linked(spark, folder, "complete")).withColumn("height", r6("height"))


@query()
def tree_top(spark, folder):
    out = hierarchy.tree_levels(hierarchy.merge_table(_linked(spark, folder, "complete")), 4)
    return out.withColumn("height", r6("height"))


_PAIRS = """p AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label AS la, b.label AS lb, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)"""


@query(f"""WITH {_PAIRS}, n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)
SELECT round(sum(s / (2 * n)), 6) + 0.0 AS dispersion FROM (SELECT la AS label, sum(d * d) / 2 AS s FROM p WHERE la = lb GROUP BY la) JOIN n USING (label)""")
def cluster_dispersion(spark, folder):
    return selection.dispersion(table(spark, folder, "embeddings"), "embedding", "label").select(r6("dispersion").alias("dispersion"))


@query(f"""WITH {_PAIRS}, m AS (SELECT a, la, lb, avg(d) AS d FROM p GROUP BY a, la, lb), s AS (SELECT a, coalesce(max(d) FILTER (la = lb), 0) AS i, min(d) FILTER (la <> lb) AS o, bool_or(la = lb) AS many FROM m GROUP BY a)
SELECT 10 AS k, round(avg(CASE WHEN many THEN (o - i) / greatest(o, i) ELSE 0 END), 6) + 0.0 AS silhouette FROM s""")
def label_silhouette(spark, folder):
    e = table(spark, folder, "embeddings")
    out = selection.silhouette(e, "embedding", "vec_id", e.select("vec_id", F.lit(10).alias("k"), "label"))
    return out.select("k", r6("silhouette").alias("silhouette"))


@query("""WITH l AS (SELECT label, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS i FROM embeddings), s AS (SELECT sum(d) AS inertia FROM (SELECT count(*) * var_pop(v) AS d FROM l GROUP BY label, i))
SELECT 10 AS k, round(inertia / (SELECT count(*) FROM embeddings), 6) + 0.0 AS distortion, round(inertia, 6) + 0.0 AS inertia FROM s""")
def label_elbow(spark, folder):
    e = table(spark, folder, "embeddings")
    out = selection.elbow(e, "embedding", "vec_id", 10, labels=e.select("vec_id", F.lit(10).alias("k"), "label"))
    return out.select("k", r6("distortion").alias("distortion"), r6("inertia").alias("inertia"))


_DRAWS = """b AS (SELECT min(ar) AS l0, max(ar) AS h0, min(latcent) AS l1, max(latcent) AS h1 FROM idx),
draw AS (SELECT rep, idx, l0 + (h0 - l0) * ('0x' || substr(md5('7|' || rep || '|' || idx || '|0'), 1, 8))::BIGINT / 4294967296 AS ar,
 l1 + (h1 - l1) * ('0x' || substr(md5('7|' || rep || '|' || idx || '|1'), 1, 8))::BIGINT / 4294967296 AS latcent FROM idx, b, range(3) t(rep))"""


@query(f"""WITH {INDEXED}, {_DRAWS} SELECT rep::INT AS rep, idx, round(ar, 6) + 0.0 AS ar, round(latcent, 6) + 0.0 AS latcent FROM draw""")
def reference_draws(spark, folder):
    out = selection.reference_sample(indexed(spark, folder), ["ar", "latcent"], "idx", 3, seed=7)
    return out.select("rep", "idx", r6("ar").alias("ar"), r6("latcent").alias("latcent"))


@query(f"""WITH {INDEXED}, {_DRAWS}, w AS (SELECT rep, ln(count(*) * (var_pop(ar) + var_pop(latcent)) / 2) AS w FROM draw GROUP BY rep),
o AS (SELECT ln(count(*) * (var_pop(ar) + var_pop(latcent)) / 2) AS w FROM idx)
SELECT 1 AS k, round(avg(w.w) - any_value(o.w), 6) + 0.0 AS gap, round(stddev_pop(w.w) * sqrt(1 + 1.0 / 3), 6) + 0.0 AS s FROM w, o""")
def gap_of_one_cluster(spark, folder):
    out = selection.gap_statistic(indexed(spark, folder), ["ar", "latcent"], "idx", 1, 3, seed=7)
    return out.select("k", r6("gap").alias("gap"), r6("s").alias("s"))


@query()
def gap_curve(spark, folder):
    d = scaling.scale(indexed(spark, folder), ["ar", "latcent"], "standard")
    out = selection.gap_statistic(d, ["scaled_ar", "scaled_latcent"], "idx", 6, 4)
    return out.select("k", r6("gap").alias("gap"), r6("s").alias("s"))


@query()
def gap_choice(spark, folder):
    d = scaling.scale(indexed(spark, folder), ["ar", "latcent"], "standard")
    return selection.gap_choice(selection.gap_statistic(d, ["scaled_ar", "scaled_latcent"], "idx", 6, 4))


@query()
def elbow_curve(spark, folder):
    out = selection.elbow(table(spark, folder, "embeddings"), "embedding", "vec_id", 5)
    return out.select("k", r6("distortion").alias("distortion"), r6("inertia").alias("inertia"))


@query()
def kmeans_elbow(spark, folder):
    """An estimator in place of a linkage."""
    out = selection.elbow(table(spark, folder, "embeddings"), "embedding", "vec_id", 3, KMeans(seed=1, maxIter=10))
    return out.select("k", r6("distortion").alias("distortion"), r6("inertia").alias("inertia"))


@query()
def silhouette_curve(spark, folder):
    out = selection.silhouette_method(table(spark, folder, "embeddings"), "embedding", "vec_id", 5, "ward")
    return out.select("k", r6("silhouette").alias("silhouette"))


@query()
def silhouette_choice(spark, folder):
    return selection.silhouette_choice(selection.silhouette_method(table(spark, folder, "embeddings"), "embedding", "vec_id", 5, "average"))


@query()
def several_feature_sets(spark, folder):
    d = scaling.scale(indexed(spark, folder), ["ar", "latcent", "area"], "standard")
    sets = {"y_ar_latcent": (["scaled_ar", "scaled_latcent"], 3), "y_area": (["scaled_ar", "scaled_latcent", "scaled_area"], 4)}
    return selection.cluster_sets(d, sets, "idx").select("idx", "y_ar_latcent", "y_area")


@query("""WITH l AS (SELECT label, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS i FROM embeddings),
c AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(v) AS m FROM l GROUP BY label, i) GROUP BY label),
d AS (SELECT c.label, vec_id, list_distance(embedding::DOUBLE[], c) AS d FROM embeddings, c)
SELECT label, first(vec_id ORDER BY d, vec_id) AS row_id, round(min(d), 6) + 0.0 AS distance FROM d GROUP BY label""")
def class_representatives(spark, folder):
    out = selection.representatives(table(spark, folder, "embeddings"), "embedding", "label", "vec_id")
    return out.withColumn("distance", r6("distance"))


# Geometry

_E = "0.0818191908426215"
_T = "tan(pi() / 4 - radians({0}) / 2) / pow((1 - {e} * sin(radians({0}))) / (1 + {e} * sin(radians({0}))), {e} / 2)"
_RHO = f"6378137.0 * cos(radians(60)) / sqrt(1 - {_E} * {_E} * sin(radians(60)) * sin(radians(60))) * ({_T.format('latcent', e=_E)}) / ({_T.format('60', e=_E)})"
_POINTS = f"""c AS (SELECT *, {_RHO} AS rho, sqrt(area / (pi() * ar)) AS minor, theta + pi() / 2 AS turn FROM s),
v AS (SELECT *, rho * sin(radians(loncent)) AS x0, -rho * cos(radians(loncent)) AS y0, i AS vertex,
 minor * ar * cos(2 * pi() * i / 12) AS p, minor * sin(2 * pi() * i / 12) AS q FROM c, range(12) t(i)),
o AS (SELECT *, round(x0 + 1000 * (p * cos(turn) - q * sin(turn)), 3) + 0.0 AS x, round(y0 + 1000 * (p * sin(turn) + q * cos(turn)), 3) + 0.0 AS y FROM v)"""


@query(f"""WITH {DAILY}, {SHAPES}, s AS (SELECT * FROM shapes), {_POINTS} SELECT strftime(string, '%Y-%m-%d') AS day, vertex::INT AS vertex, x, y FROM o""")
def ellipse_points(spark, folder):
    out = geometry.ellipses(shapes(daily(spark, folder)), ["string"], 12)
    return out.select(day().alias("day"), "vertex", (F.round("x", 3) + 0.0).alias("x"), (F.round("y", 3) + 0.0).alias("y"))


_SLOTS = """s AS (SELECT string, 0 AS slot, area, ar, theta, loncent, latcent FROM shapes UNION ALL
 SELECT string, 1, area1, ar, theta + 1, loncent, latcent - 1 FROM shapes WHERE form = 1 AND area1 > 0 UNION ALL
 SELECT string, 2, area2, ar, theta + 2, loncent, latcent - 2 FROM shapes WHERE form = 1 AND area2 > 0)"""


@query(f"""WITH {DAILY}, {SHAPES}, {_SLOTS} SELECT strftime(string, '%Y-%m-%d') AS day, slot, round(area, 4) + 0.0 AS area, round(theta, 6) + 0.0 AS theta, round(latcent, 6) + 0.0 AS latcent FROM s""")
def split_shapes(spark, folder):
    out = geometry.split_shapes(shapes(daily(spark, folder)), ["string"])
    return out.select(day().alias("day"), "slot", (F.round("area", 4) + 0.0).alias("area"), r6("theta").alias("theta"), r6("latcent").alias("latcent"))


@query(f"""WITH {DAILY}, {SHAPES}, s AS (SELECT avg(area) AS area, avg(ar) AS ar, avg(theta) AS theta, avg(loncent) AS loncent, avg(latcent) AS latcent FROM shapes), {_POINTS} SELECT vertex::INT AS vertex, x, y FROM o""")
def mean_shape(spark, folder):
    out = geometry.aggregate_shape(shapes(daily(spark, folder)), "mean", 12)
    return out.select("vertex", (F.round("x", 3) + 0.0).alias("x"), (F.round("y", 3) + 0.0).alias("y"))


@query(f"""WITH {DAILY}, {SHAPES}, {_SLOTS}, {_POINTS}, f AS (SELECT string, row_number() OVER (ORDER BY string) - 1 AS idx, ntile(4) OVER (ORDER BY string) AS part, percent_rank() OVER (ORDER BY string) AS position FROM daily)
SELECT idx, part, round(position, 6) + 0.0 AS position, slot, vertex::INT AS vertex, x, y FROM o JOIN f USING (string)""")
def shape_timeline(spark, folder):
    out = geometry.shape_timeline(shapes(daily(spark, folder)), "string", num_points=12)
    return out.select("idx", "part", r6("position").alias("position"), "slot", "vertex", (F.round("x", 3) + 0.0).alias("x"), (F.round("y", 3) + 0.0).alias("y"))


# Whole flows


@query()
def regime_scores(spark, folder):
    """From feeds to scored clusters: the flow of the demonstration script."""
    rows, _, _ = winter.regime_analysis(daily(spark, folder), msw(spark, folder), eeof_window=200)
    return scores.agreement(rows, "form", ["y"], "string", 1, 1).select(
        "prediction", "tp", "fp", "fn", "tn", *[r6(c).alias(c) for c in ("accuracy", "precision", "recall", "f1")]
    )


@query()
def regime_profile(spark, folder):
    """Class means of the clustered features."""
    rows, _, _ = winter.regime_analysis(daily(spark, folder), msw(spark, folder), eeof_window=200)
    out = aggregate.class_profile(rows, "y", ["scaled_ar", "scaled_latcent", "eeof_scaled_u"])
    return out.select("y", "feature", *[r6(c).alias(c) for c in ("min", "max", "mean")])
