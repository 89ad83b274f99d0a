"""Prefixed CSV feeds in, result tables out."""

from __future__ import annotations

import codecs
import csv
import warnings
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.ordering import BROADCAST_ROWS
from tidemark.session import checkpoint

# Texts a CSV reader treats as missing.
MISSING_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

_RAGGED = "_ragged"
#: Column orders that the files of one folder may have.
MAX_HEADERS = 1_000


# Charsets Spark's CSV reader decodes by itself.
SPARK_CHARSETS = {
    "ascii": "us-ascii", "iso8859-1": "iso-8859-1", "utf-16": "utf-16", "utf-16-be": "utf-16be",
    "utf-16-le": "utf-16le", "utf-32": "utf-32",
}


def _lines(spark: SparkSession, path: str | Sequence[str], encoding: str) -> DataFrame:
    """``value``, ``file`` and ``block``, where in its file the line's split begins."""
    paths = [path] if isinstance(path, str) else list(path)
    codec = codecs.lookup(encoding).name
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    if codec == "utf-8":
        return spark.read.text(paths).select("value", *place)
    if codec in SPARK_CHARSETS:
        # The text source is UTF-8 only; a CSV read with a single column decodes these.
        reader = spark.read.schema("value STRING").option("encoding", SPARK_CHARSETS[codec])
        reader = reader.option("sep", "\u0001").option("quote", "")
        # Line ends of the wide charsets are not single bytes, so each such file is streamed as a whole.
        return reader.option("multiLine", codec.startswith(("utf-16", "utf-32"))).csv(paths).select("value", *place)

    @F.pandas_udf("string")
    def decode(raw: pd.Series) -> pd.Series:
        return raw.str.decode(codec)

    # The text source passes bytes through, so any code page that keeps ASCII line ends works.
    return spark.read.text(paths).select(decode(F.col("value").cast("binary")).alias("value"), *place)


def _present(text: Column) -> Column:
    trimmed = F.trim(text)
    return F.when(~trimmed.isin(MISSING_TEXTS), text)


def read_feed(
    spark: SparkSession,
    path: str | Sequence[str],
    encoding: str = "utf-8",
    schema: T.StructType | str | None = None,
    prefix: str = "D",
) -> DataFrame:
    """Read comma-separated lines that start with ``prefix``; the rest are dropped.

    The first kept line of each file is its header, read by the CSV rules: names
    may be quoted, a repeated name gets a number, an empty one its position.
    Files may order their columns differently, but must have the same ones. The
    file that sorts first gives the order of the result. Give ``schema`` (types
    in that order) to spare the pass that finds the column types; that pass
    reads all rows, so a late text value is never lost to a type guessed from
    early ones.
    """
    kept = _lines(spark, path, encoding).withColumn("line", F.monotonically_increasing_id())
    kept = kept.filter(F.col("value").startswith(prefix)).withColumn("value", F.regexp_replace("value", r"\r$", ""))
    # Written once: line numbers follow the partitions of a plan, and another plan may number them otherwise.
    kept = checkpoint(kept)
    # Lines of one split are numbered in order, and splits of a file by where they begin.
    place = F.struct("block", "line")
    files = checkpoint(kept.groupBy("file").agg(F.min(place).alias("_at"), F.min_by("value", place).alias("header")))
    distinct = files.groupBy("header").agg(F.min("file").alias("file")).orderBy("file").limit(MAX_HEADERS + 1).collect()
    if not distinct:
        raise ValueError(f"no line starts with {prefix!r} in {path}")
    if len(distinct) > MAX_HEADERS:
        raise ValueError(f"the files of {path} have more than {MAX_HEADERS} different headers")
    headers = [_names(row["header"]) for row in distinct]
    names = headers[0]
    for row, found in zip(distinct, headers):
        if sorted(found) != sorted(names):
            raise ValueError(f"{row['file']} has the columns {found}, {distinct[0]['file']} has {names}")
    fields = [f"c{i}" for i in range(len(names))]
    raw_schema = ", ".join(f"{f} STRING" for f in [*fields, _RAGGED])
    options = {"sep": ",", "escape": '"', "columnNameOfCorruptRecord": _RAGGED}
    number = F.coalesce(*[F.when(F.col("header") == row["header"], F.lit(i)) for i, row in enumerate(distinct)])
    tops = files.select("file", "_at", number.alias("_header"))
    tops = F.broadcast(tops) if files.count() <= BROADCAST_ROWS else tops
    # A header has no value, so a check on parsed values that Spark moves ahead of the filter passes it.
    lines = kept.join(tops, "file").withColumn("value", F.when(place != F.col("_at"), F.col("value"))).filter("value IS NOT NULL")
    cells = lines.select(F.from_csv("value", raw_schema, options).alias("r"), "value", "_header")
    too_many = F.col(f"r.{_RAGGED}").isNotNull() & (F.size(F.split("value", ",")) > len(names))
    checked = F.when(
        too_many, F.raise_error(F.concat(F.lit("line has more fields than the header: "), F.col("value")))
    )

    def cell(name: str) -> Column:
        spots = [found.index(name) for found in headers]
        if len(set(spots)) == 1:
            return F.col(f"r.c{spots[0]}")
        return F.coalesce(*[F.when(F.col("_header") == i, F.col(f"r.c{at}")) for i, at in enumerate(spots)])

    # The check sits in the first column so no projection can skip it silently.
    cells = cells.select(*[(F.coalesce(checked, cell(n)) if i == 0 else cell(n)).alias(f"c{i}") for i, n in enumerate(names)])
    cells = cells.select(*[_present(F.col(f)).alias(f) for f in fields])
    if schema is None:
        types = _infer(cells, fields)
    else:
        parsed = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        types = [f.dataType for f in parsed.fields]
        if len(types) != len(names):
            raise ValueError(f"schema has {len(types)} columns, the header {len(names)}")
    return cells.select(*[F.trim(f).cast(t).alias(n) if not isinstance(t, T.StringType) else F.col(f).alias(n)
                          for f, t, n in zip(fields, types, names)])


def _names(header: str) -> list[str]:
    """Column names of a header line; repeated ones are numbered."""
    out: list[str] = []
    for i, name in enumerate(next(csv.reader([header]))):
        name, again = name or f"Unnamed: {i}", 0
        unique = name
        while unique in out:
            again += 1
            unique = f"{name}.{again}"
        out.append(unique)
    return out


def _infer(cells: DataFrame, fields: Sequence[str]) -> list[T.DataType]:
    """Narrowest type that holds every value: long, double, boolean, else string."""
    checks = []
    for f in fields:
        text = F.trim(f)
        whole = text.rlike(r"^[+-]?\d+$") & text.try_cast("bigint").isNotNull()
        checks += [
            F.count(f).alias(f"n_{f}"),
            F.count_if(whole).alias(f"l_{f}"),
            F.count_if(text.try_cast("double").isNotNull() & ~text.rlike("[dDfF]$")).alias(f"d_{f}"),
            F.count_if(text.isin("True", "False", "TRUE", "FALSE", "true", "false")).alias(f"b_{f}"),
        ]
    seen = cells.agg(F.count(F.lit(1)).alias("rows"), *checks).first()
    types: list[T.DataType] = []
    for f in fields:
        n = seen[f"n_{f}"]
        if n == 0:
            types.append(T.DoubleType())
        elif seen[f"l_{f}"] == n == seen["rows"]:
            types.append(T.LongType())
        elif seen[f"d_{f}"] == n:
            types.append(T.DoubleType())
        elif seen[f"b_{f}"] == n == seen["rows"]:
            types.append(T.BooleanType())
        else:
            types.append(T.StringType())
    return types


def name_columns(df: DataFrame, names: Sequence[str] = ("string", "ar", "latcent")) -> DataFrame:
    """Name unnamed positional columns, warning that their order is assumed."""
    warnings.warn(f"columns are taken to be in the order {', '.join(names)}", UserWarning, stacklevel=2)
    return df.toDF(*names)


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """Write a result table as CSV with a header, one file per partition."""
    df.write.mode(mode).option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "error") -> None:
    """Land a table for repeated use; later filters and columns reach the scan."""
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)
