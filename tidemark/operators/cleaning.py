"""Names, types, missing values and codes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Timestamp layouts tried in turn when none is named.
MIXED_FORMATS = [
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd",
    "dd.MM.yyyy-HH:mm:ss", "dd.MM.yyyy-HH:mm", "dd.MM.yyyy", "MMMM d, yyyy", "MMM d, yyyy",
    "M/d/yyyy", "d/M/yyyy", "M/d/yyyy HH:mm:ss", "d/M/yyyy HH:mm:ss", "yyyy/MM/dd", "yyyyMMdd",
]


_ISO = r"^\d{4}-\d{1,2}-\d{1,2}[T ]\d{1,2}:\d{1,2}"
FEW_CLASSES = 1_000


def clean_names(df: DataFrame, sep: str = " ") -> DataFrame:
    """Keep the last ``sep``-separated token of each name and trim text values."""
    names = [c.split(sep)[-1] for c in df.columns]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"column names clash after cleaning: {twice}")
    out = df.toDF(*names)
    texts = [f.name for f in out.schema.fields if isinstance(f.dataType, T.StringType)]
    # \s also covers tabs and other blanks, which F.trim leaves in place.
    return out.withColumns({c: F.regexp_replace(F.col(c), r"^\s+|\s+$", "") for c in texts})


def mixed_timestamp(text: Column, formats: Sequence[str] = MIXED_FORMATS) -> Column:
    """First layout that parses; NULL when none does.

    ISO date-times come first, with or without a fraction of a second. One with
    a zone is the instant it names, shown in the session's time zone.
    """
    iso = F.when(text.rlike(_ISO), text.try_cast("timestamp"))
    return F.coalesce(iso, *[F.try_to_timestamp(text, F.lit(f)) for f in formats]).cast("timestamp_ntz")


def parse_time(df: DataFrame, column: str, fmt: str = "mixed", fallback: bool = False) -> DataFrame:
    """Turn text into timestamps; a value that does not parse raises.

    ``fmt`` is a Spark datetime pattern or ``"mixed"``. With ``fallback`` a
    value the pattern rejects is tried against the mixed layouts first.
    """
    if not isinstance(df.schema[column].dataType, T.StringType):
        return df.withColumn(column, F.col(column).cast("timestamp_ntz"))
    text = F.trim(column)
    if fmt == "mixed":
        parsed = mixed_timestamp(text)
    else:
        parsed = F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz")
        if fallback:
            parsed = F.coalesce(parsed, mixed_timestamp(text))
    bad = F.raise_error(F.concat(F.lit(f"cannot read a time in {column}: "), text)).cast("timestamp_ntz")
    return df.withColumn(column, F.coalesce(parsed, F.when(text.isNotNull(), bad)))


def to_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Read columns as numbers; text that is no number, and NaN, become NULL."""
    number = {c: F.col(c).try_cast("double") for c in columns}
    return df.withColumns({c: F.when(~F.isnan(v), v) for c, v in number.items()})


def fill_missing(df: DataFrame, value: float | str = 0, columns: Sequence[str] | None = None) -> DataFrame:
    return df.na.fill(value, subset=list(columns) if columns is not None else None)


def drop_missing(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop(subset=list(columns) if columns is not None else None)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [
        f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in exclude
    ]


def select_numeric(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, *numeric_columns(df, keep))


def label_codes(df: DataFrame, column: str, few: int = FEW_CLASSES) -> DataFrame:
    """The code table ``(column, code)``: distinct values in order, from 0.

    Up to ``few`` classes are sorted on the driver; beyond that the
    ordinal index numbers them without one task holding all of them.
    """
    from tidemark.operators.ordering import ordinal

    distinct = df.select(column).filter(F.col(column).isNotNull()).distinct()
    found = distinct.limit(few + 1).collect()
    if len(found) > few:
        return ordinal(distinct, [column], name="code")
    rows = [(v, i) for i, v in enumerate(sorted(r[0] for r in found))]
    kind = T.StructType([df.schema[column], T.StructField("code", T.LongType())])
    return df.sparkSession.createDataFrame(rows, kind)


def encode_labels(df: DataFrame, column: str, out: str | None = None, codes: DataFrame | None = None) -> DataFrame:
    """Replace text classes by their alphabetical rank."""
    out = out or column
    codes = label_codes(df, column) if codes is None else codes
    named = codes.select(F.col(column).alias("_value"), F.col("code").alias("_code"))
    joined = df.join(named, F.col(column) == F.col("_value"), "left")
    return joined.withColumn(out, F.col("_code")).drop("_value", "_code")


def decode_labels(df: DataFrame, column: str, codes: DataFrame, out: str) -> DataFrame:
    """Look the class text up again; ``codes`` is the table from :func:`label_codes`."""
    (text,) = [c for c in codes.columns if c != "code"]
    named = codes.select(F.col("code").alias("_code"), F.col(text).alias(out))
    return df.join(named, F.col(column) == F.col("_code"), "left").drop("_code")


def recode(df: DataFrame, column: str, mapping: Mapping, out: str | None = None) -> DataFrame:
    """Replace values by ``mapping``; values it does not name stay as they are.

    As soon as one new value is text the whole column is text.
    """
    target = "string" if any(isinstance(v, str) for v in mapping.values()) else df.schema[column].dataType
    case = F.col(column).cast(target)
    for old, new in mapping.items():
        case = F.when(F.col(column) == F.lit(old), F.lit(new).cast(target)).otherwise(case)
    return df.withColumn(out or column, case)


def assign_by_position(df: DataFrame, column: str, last: int, head: Column, tail: Column, idx: str = "idx") -> DataFrame:
    """Fill a column with ``head`` up to row ``last`` (inclusive) and ``tail`` after it."""
    return df.withColumn(column, F.when(F.col(idx) <= last, head).otherwise(tail))


def column_overview(df: DataFrame) -> DataFrame:
    """One row per column: ``(position, column, dtype, non_null)``."""
    fields = df.schema.fields
    counted = df.agg(*[F.count(F.col(f"`{f.name}`")).alias(f"n{i}") for i, f in enumerate(fields)])
    rows = F.array(*[
        F.struct(
            F.lit(i).alias("position"), F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("dtype"), F.col(f"n{i}").alias("non_null"),
        )
        for i, f in enumerate(fields)
    ])
    return counted.select(F.inline(rows))
