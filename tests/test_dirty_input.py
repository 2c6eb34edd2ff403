"""Dirty and repeated input: one row in, one row out."""

import pytest

from bidlens.operators.budget import in_hours
from bidlens.operators.features import label_index, labels_of
from bidlens.operators.prep import map_codes, map_dictionary
from bidlens.sources.logs import landscape_cells, read_dictionary, read_log
from pyspark.sql import functions as F


def test_dictionary_with_a_code_twice_and_dirty_codes(spark):
    names = spark.createDataFrame([(1, "a"), (1, "b"), (2, "unknown"), (None, "c")], "code int, name string")
    df = spark.createDataFrame([(i, c) for i, c in enumerate(["1", "1.0", "x", None, "2", "9"])], "i int, City string")
    got = {r.i: r.City for r in map_dictionary(df, "City", names).collect()}
    assert got == {0: "b", 1: "b", 2: "NA", 3: "NA", 4: "NA", 5: "NA"}


def test_codes_that_are_no_numbers(spark):
    df = spark.createDataFrame([("3.0",), ("x",), (None,)], "c string")
    assert [r[0] for r in df.select(map_codes(F.col("c"), {3: "three"})).collect()] == ["three", None, None]


def test_landscape_cell_twice(spark):
    row = ("A", "monday", 1, 5, 60.0, 3.0, 0.1)
    names = "Advertiser string, Weekday string, Hour int, Impressions long, muPrice double, sigmaPrice double, CTR double"
    assert landscape_cells(spark.createDataFrame([row, row[:4] + (70.0, 3.0, 0.1)], names)).count() == 1


def test_other_header_and_malformed_dictionary(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("y,x\n1,2\n")
    with pytest.raises(Exception):
        read_log(spark, str(tmp_path / "*.csv"), columns=["x", "y"]).collect()
    (tmp_path / "names.txt").write_text("one\ta\n")
    with pytest.raises(Exception):
        read_dictionary(spark, str(tmp_path / "names.txt")).collect()


def test_labels_with_null_and_na_in_training(spark):
    df = spark.createDataFrame([("NA",), (None,), (None,), ("a",), ("a",), ("b",)], "s string")
    labels = labels_of(df, "s")
    assert {r.label: r["index"] for r in labels.collect()} == {"NA": 0.0, "a": 1.0, "b": 2.0}
    assert label_index(df, "s", labels).count() == 6
    new = df.union(spark.createDataFrame([("z",)], "s string"))
    got = {(r.s, r["index"]) for r in label_index(new, "s", labels, "keep").collect()}
    assert got == {("a", 0.0), ("b", 1.0), ("NA", 2.0)}


def test_hours_of_no_campaign_and_of_many(spark, monkeypatch):
    rows = spark.sql("select timestamp_ntz '2024-01-01 00:30:00' + make_interval(0,0,0,0,id) as ts, id from range(5)")
    rows = rows.withColumn("hour_ts", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    assert in_hours(rows, rows.filter("false")).count() == 0
    monkeypatch.setattr("bidlens.operators.budget.LISTED_HOURS", 1)
    few = in_hours(rows, rows.filter("id < 3"))
    assert few.columns == rows.columns and few.count() == 3
