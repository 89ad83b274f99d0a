from datetime import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.operators import cleaning, filters, joins
from tidemark.sources import feeds


def write(tmp_path, text, name="feed.csv", encoding="utf-8"):
    path = tmp_path / name
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_only_prefixed_lines_are_read(spark, tmp_path):
    path = write(tmp_path, "# comment\nDate,A,B\nA,9,9\nD,1,2\nX,0,0\nD,4,5\n")
    got = feeds.read_feed(spark, path)
    assert got.columns == ["Date", "A", "B"]
    assert sorted(tuple(r) for r in got.collect()) == [("D", 1, 2), ("D", 4, 5)]


def test_types_hold_every_value(spark, tmp_path):
    late = "".join(f"D,{i},{i}.5,{i},True,\n" for i in range(500)) + "D,7,1e3,oops,False,\n"
    got = feeds.read_feed(spark, write(tmp_path, "D,i,f,s,b,e\n" + late))
    assert [t for _, t in got.dtypes] == ["string", "bigint", "double", "string", "boolean", "double"]
    assert got.filter("s = 'oops'").count() == 1 and got.count() == 501


def test_missing_texts_and_short_lines(spark, tmp_path):
    got = feeds.read_feed(spark, write(tmp_path, "D,a,b\nD,NaN,1\nD,2,\nD,3\n")).orderBy("a").collect()
    assert [tuple(r) for r in got] == [("D", None, 1.0), ("D", 2.0, None), ("D", 3.0, None)]


def test_line_with_too_many_fields_raises(spark, tmp_path):
    with pytest.raises(PySparkException, match="more fields"):
        feeds.read_feed(spark, write(tmp_path, "D,a\nD,1\nD,2,3\n"), schema="d string, a long").collect()


def test_folder_with_a_header_per_file_and_a_schema(spark, tmp_path):
    write(tmp_path, "x\nD, v\r\nD, 1\r\n", "a.csv")
    write(tmp_path, "D, v\r\nD, 2\r\n", "b.csv")
    got = cleaning.clean_names(feeds.read_feed(spark, str(tmp_path), schema="d string, v double"))
    assert sorted(r.v for r in got.collect()) == [1.0, 2.0]
    with pytest.raises(ValueError):
        feeds.read_feed(spark, str(tmp_path), schema="d string")


def test_files_may_order_their_columns_differently(spark, tmp_path):
    write(tmp_path, "x\nD,x,y\nD,1,2\nD,x,y\n", "a.csv")
    write(tmp_path, "D,y,x\nD,20,10\n", "b.csv")
    got = feeds.read_feed(spark, str(tmp_path))
    assert got.columns == ["D", "x", "y"]
    assert sorted((r.x, r.y) for r in got.collect()) == [("1", "2"), ("10", "20"), ("x", "y")]
    write(tmp_path, "D,x,z\nD,1,2\n", "c.csv")
    with pytest.raises(ValueError, match="c.csv"):
        feeds.read_feed(spark, str(tmp_path))


def test_header_names_follow_the_csv_rules(spark, tmp_path):
    got = feeds.read_feed(spark, write(tmp_path, 'D,"x,1",y,y,\nD,1,2,3,4\n'))
    assert got.columns == ["D", "x,1", "y", "y.1", "Unnamed: 4"] and tuple(got.first()) == ("D", 1, 2, 3, 4)


@pytest.mark.parametrize("encoding", ["latin-1", "cp1252", "utf-16"])
def test_encodings(spark, tmp_path, encoding):
    got = feeds.read_feed(spark, write(tmp_path, "D,n\nD,é\n", encoding=encoding), encoding)
    assert got.first()["n"] == "é"


def test_no_kept_line_raises(spark, tmp_path):
    with pytest.raises(ValueError):
        feeds.read_feed(spark, write(tmp_path, "a\nb\n"))


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    feeds.write_csv(df, str(tmp_path / "out"))
    back = spark.read.option("header", True).schema(df.schema).csv(str(tmp_path / "out"))
    assert sorted(back.collect()) == sorted(df.collect())
    feeds.write_parquet(df, str(tmp_path / "pq"), ["k"])
    assert spark.read.parquet(str(tmp_path / "pq")).filter("k = 2").count() == 1


def test_positional_names_warn(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)])
    with pytest.warns(UserWarning):
        assert feeds.name_columns(df).columns == ["string", "ar", "latcent"]


def test_clean_names_and_trim(spark):
    df = spark.createDataFrame([("   foo", 1, None), ("\tbar ", 2, "x")], ["  A", "the B", "C"])
    got = cleaning.clean_names(df)
    assert got.columns == ["A", "B", "C"]
    assert [tuple(r) for r in got.collect()] == [("foo", 1, None), ("bar", 2, "x")]
    with pytest.raises(ValueError):
        cleaning.clean_names(df.toDF("x a", "y a", "c"))


def test_parse_time(spark):
    df = spark.createDataFrame([("2020-01-01",), ("May 10, 2021",), ("31/12/2022",), (None,)], ["t"])
    got = [r.t for r in cleaning.parse_time(df, "t").collect()]
    assert got == [datetime(2020, 1, 1), datetime(2021, 5, 10), datetime(2022, 12, 31), None]
    bad = spark.createDataFrame([("invalid-date",)], ["t"])
    for fmt, fallback in (("yyyy-MM-dd", False), ("mixed", False), ("yyyy-MM-dd", True)):
        with pytest.raises(PySparkException, match="invalid-date"):
            cleaning.parse_time(bad, "t", fmt, fallback).collect()
    some = spark.createDataFrame([("01.02.2003-04:05",), ("2003-02-01",)], ["t"])
    assert cleaning.parse_time(some, "t", "dd.MM.yyyy-HH:mm", fallback=True).count() == 2


def test_numbers_and_missing(spark):
    df = spark.createDataFrame([("1.5",), ("x",), ("NaN",), (None,)], ["v"])
    got = cleaning.to_numeric(df, ["v"])
    assert [r.v for r in got.collect()] == [1.5, None, None, None]
    assert [r.v for r in cleaning.fill_missing(got, 0, ["v"]).collect()] == [1.5, 0, 0, 0]
    assert cleaning.drop_missing(got).count() == 1


@pytest.mark.parametrize("few", [1000, 1])
def test_labels_round_trip(spark, few, monkeypatch):
    monkeypatch.setattr(cleaning, "FEW_CLASSES", few)
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",), ("a",)], ["w"])
    codes = cleaning.label_codes(df, "w")
    coded = cleaning.encode_labels(df, "w", "n", codes)
    assert sorted((r.w or "", r.n) for r in coded.collect() if r.w) == [("a", 0), ("a", 0), ("b", 1), ("c", 2)]
    back = cleaning.decode_labels(coded.drop("w"), "n", codes, "w")
    assert sorted(r.w for r in back.collect() if r.w) == ["a", "a", "b", "c"] and back.count() == 5


def test_recode_keeps_other_values(spark):
    df = spark.createDataFrame([(0,), (1,), (2,)], "c int")
    assert [r.c for r in cleaning.recode(df, "c", {0: "S", 1: "D"}).collect()] == ["S", "D", "2"]
    assert [r.c for r in cleaning.recode(df, "c", {0: 1, 1: 0}).collect()] == [1, 0, 2]


def test_filters(spark):
    days = spark.sql("SELECT explode(sequence(timestamp_ntz'2000-01-01', timestamp_ntz'2001-12-31', interval 1 day)) AS t")
    assert filters.season(days, "t").count() == 2 * (31 * 3) + 29 + 28
    assert filters.between(days, "t", "2000-02-01", "2000-02-10").count() == 10
    assert filters.between(days, "t", "2000-02-01", "2000-02-10", closed=False).count() == 8
    kept, report = filters.clip_range(days, "t", datetime(1990, 1, 1), datetime(2000, 1, 31))
    assert kept.count() == 31 and report["clipped"] and report["distinct"] == 731
    kept, report = filters.clip_range(days, "t", datetime(2001, 1, 1), None)
    assert kept.count() == 365 and not report["clipped"]
    assert filters.in_dates(days, "t", [datetime(2000, 1, 1), datetime(1999, 1, 1)]).count() == 1
    anchors = filters.between(days, "t", "2000-01-01", "2000-01-02")
    assert filters.around(days, "t", anchors, 1, 2).count() == 3 + 4
    odd = spark.createDataFrame([(1.0,), (None,), (9.0,)], ["v"])
    assert filters.exclude(odd, F.col("v") > 5).count() == 2


def test_join_suffixes_and_missing_keys(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "string int, v string")
    b = spark.createDataFrame([(1, "p"), (None, "q")], "string int, v string")
    got = joins.join_on(a, b)
    assert got.columns == ["string", "v_d", "v_msw"]
    assert sorted((r.v_d, r.v_msw) for r in got.collect()) == [("x", "p"), ("y", None), ("z", None)]
    got = joins.join_on(a, b, match_missing=True)
    assert sorted((r.v_d, r.v_msw or "") for r in got.collect()) == [("x", "p"), ("y", ""), ("z", "q")]
    with pytest.raises(ValueError):
        joins.join_on(a, b, suffixes=(None, None))


def test_iso_times_with_fraction_or_zone(spark):
    texts = ["2020-01-02T03:04:05.123", "2020-01-02T03:04:05Z", "2020-01-02T03:04:05+02:00", "2020-01-02 03:04:05.5", "May 10, 2021", "31/12/2022"]
    got = cleaning.parse_time(spark.createDataFrame([(t,) for t in texts], "t string"), "t")
    assert [r.t for r in got.collect()] == [
        datetime(2020, 1, 2, 3, 4, 5, 123_000), datetime(2020, 1, 2, 3, 4, 5), datetime(2020, 1, 2, 1, 4, 5),
        datetime(2020, 1, 2, 3, 4, 5, 500_000), datetime(2021, 5, 10), datetime(2022, 12, 31),
    ]
    with pytest.raises(PySparkException):
        cleaning.parse_time(spark.createDataFrame([("03:04:05",)], "t string"), "t").collect()
