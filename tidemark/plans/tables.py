"""Daily series derived from the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def daily(spark: SparkSession, folder: str) -> DataFrame:
    """One row per ship date: geometric stand-ins and a two-class ``form``."""
    price = F.col("l_extendedprice")
    returned = F.count_if(F.col("l_returnflag") == "R")
    return (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_shipdate").alias("string"))
        .agg(
            (F.round(F.sum(price), 2) / 1000000).alias("area"),
            (F.max(price) * F.count(F.lit(1)) / F.round(F.sum(price), 2)).alias("ar"),
            (F.sum("l_quantity") / F.count(F.lit(1)) + 40).alias("latcent"),
            F.round(F.sum("l_discount"), 2).alias("edge"),
            F.count(F.lit(1)).alias("n"),
            F.when(returned * 3 > F.count(F.lit(1)), F.lit("S")).otherwise(F.lit("D")).alias("form"),
        )
    )


def msw(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order date: a wind stand-in and a warming flag."""
    urgent = F.count_if(F.col("o_orderpriority") == "1-URGENT")
    return (
        table(spark, folder, "orders")
        .groupBy(F.col("o_orderdate").alias("string"))
        .agg(
            (F.round(F.sum("o_totalprice"), 2) / F.count(F.lit(1)) / 1000).alias("u"),
            F.when(urgent * 4 >= F.count(F.lit(1)), F.lit("Y")).otherwise(F.lit("N")).alias("MW"),
            F.count(F.lit(1)).alias("n"),
        )
    )


def cen(spark: SparkSession, folder: str) -> DataFrame:
    """Sparse event diagnostics: dates with a large order."""
    return (
        table(spark, folder, "orders")
        .filter("o_totalprice > 480000")
        .groupBy(F.col("o_orderdate").alias("string"))
        .agg(F.max("o_totalprice").alias("intensity"), F.count(F.lit(1)).alias("n"))
    )


def joined(spark: SparkSession, folder: str) -> DataFrame:
    return daily(spark, folder).join(msw(spark, folder).drop("n"), "string", "left")


def user_days(spark: SparkSession, folder: str) -> DataFrame:
    """Many short series: events per user and day."""
    return (
        table(spark, folder, "events")
        .groupBy("user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"))
        .agg(F.round(F.sum("value"), 2).alias("value"), F.count(F.lit(1)).alias("n"))
    )


def shapes(df: DataFrame) -> DataFrame:
    """Valid ellipse parameters from daily values, with two daughters on split days."""
    out = df.select(
        "string",
        ((F.col("area") + 1) * 1000000).alias("area"),
        "ar",
        (F.col("edge") * 3).alias("theta"),
        (F.col("n") * 7 % 360 - 180).cast("double").alias("loncent"),
        "latcent",
        F.when(F.col("form") == "S", 1).otherwise(0).alias("form"),
    )
    for n, share in ((1, 0.6), (2, 0.4)):
        there = F.lit(True) if n == 1 else F.col("latcent") > 65
        out = out.withColumns({
            f"area{n}": F.when(there, F.col("area") * share), f"ar{n}": F.col("ar"), f"theta{n}": F.col("theta") + n,
            f"loncent{n}": F.col("loncent"), f"latcent{n}": F.col("latcent") - n,
        })
    return out


SHIFT = "0.0000001234567"


def r6(c: Column | str) -> Column:
    """Six digits, and no negative zero."""
    return F.round((F.col(c) if isinstance(c, str) else c) + float(SHIFT), 6) + 0.0


def day(c: str = "string") -> Column:
    return F.date_format(c, "yyyy-MM-dd")


DAILY = """daily AS (
  SELECT l_shipdate AS string, round(sum(l_extendedprice), 2) / 1000000 AS area,
         max(l_extendedprice) * count(*) / round(sum(l_extendedprice), 2) AS ar,
         sum(l_quantity) / count(*) + 40 AS latcent, round(sum(l_discount), 2) AS edge,
         count(*) AS n,
         CASE WHEN sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) * 3 > count(*) THEN 'S' ELSE 'D' END AS form
  FROM lineitem GROUP BY l_shipdate)"""
MSW = """msw AS (
  SELECT o_orderdate AS string, round(sum(o_totalprice), 2) / count(*) / 1000 AS u,
         CASE WHEN sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) * 4 >= count(*) THEN 'Y' ELSE 'N' END AS "MW",
         count(*) AS n
  FROM orders GROUP BY o_orderdate)"""
CEN = """cen AS (
  SELECT o_orderdate AS string, max(o_totalprice) AS intensity, count(*) AS n
  FROM orders WHERE o_totalprice > 480000 GROUP BY o_orderdate)"""
JOINED = f"""{DAILY}, {MSW}, joined AS (SELECT daily.*, u, "MW" FROM daily LEFT JOIN msw USING (string))"""
INDEXED = f"""{DAILY}, idx AS (SELECT *, row_number() OVER (ORDER BY string) - 1 AS idx FROM daily)"""
USER_DAYS = """user_days AS (
  SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS day, round(sum(value), 2) AS value, count(*) AS n
  FROM events GROUP BY ALL)"""
SHAPES = """base AS (
  SELECT string, (area + 1) * 1000000 AS area, ar, edge * 3 AS theta, (n * 7 % 360 - 180)::DOUBLE AS loncent, latcent,
         CASE WHEN form = 'S' THEN 1 ELSE 0 END AS form FROM daily),
shapes AS (SELECT *, area * 0.6 AS area1, CASE WHEN latcent > 65 THEN area * 0.4 END AS area2 FROM base)"""
