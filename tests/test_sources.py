import datetime as dt

import pytest
from pyspark.sql import functions as F

from bidlens.operators.landscape import hourly_landscape, lognormal, mix, win_probability, with_landscape
from bidlens.operators.prep import (
    AD_EXCHANGES,
    cast_schema,
    map_codes,
    map_dictionary,
    prediction_of,
    rename_tags,
    sample_log,
    split_log,
)
from bidlens.operators.strategies import bid_of
from bidlens.session import fresh_path, shared_dir
from bidlens.sources.logs import read_landscape, read_log, read_requests
from bidlens.sources.sinks import append_kpis, write_log
from bidlens.suite import tables as t


def test_shared_folder_is_the_one_of_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert fresh_path(spark, "x") != fresh_path(spark, "x")


def test_csv_nulls_and_modes(spark):
    path = fresh_path(spark, "t")
    df = spark.createDataFrame([("a", None), (None, "2")], "x string, y string")
    write_log(df, path)
    assert sorted(open_lines(spark, path)) == ["NA,2", "a,NA"]
    assert read_log(spark, path).filter("x is null and y = '2'").count() == 1
    with pytest.raises(Exception, match="already exists"):
        write_log(df, path)
    write_log(df, path, mode="overwrite")
    assert read_log(spark, path, columns=["x", "y"]).count() == 2


def open_lines(spark, path):
    return [r.value for r in spark.read.text(path).collect() if r.value != "x,y"]


def test_append_collects_runs(spark):
    path = fresh_path(spark, "k")
    for _ in range(2):
        append_kpis(spark.range(3), path)
    assert spark.read.parquet(path).count() == 6


def test_malformed_request_is_an_error(spark):
    path = fresh_path(spark, "bad")
    spark.createDataFrame([("header\nonly,three,fields",)], "value string").write.text(path)
    with pytest.raises(Exception):
        read_requests(spark, path).collect()


def test_landscape_file_lookup_with_default(spark, data):
    path = fresh_path(spark, "l")
    write_log(hourly_landscape(t.impression_log(t.bid_log(spark, data))), path)
    cells = read_landscape(spark, path)
    assert cells.filter("weekday <> upper(weekday)").count() == 0
    wanted = spark.createDataFrame([("nobody", "MONDAY", 3)], "advertiser string, weekday string, hour int")
    row = with_landscape(wanted, cells).first()
    assert (row.rate, row.mu, row.sigma, row.ctr) == (0.0, 75.0, 50.0, 8e-4)


def test_lognormal_and_zero_spread(spark):
    df = lognormal(spark.createDataFrame([(50.0, 0.0, 0.1), (50.0, 20.0, 0.0)], "mu double, sigma double, ctr double"))
    at = lambda b: [r[0] for r in df.select(win_probability(F.lit(b), F.col("location"), F.col("scale"))).collect()]
    assert at(0.0) == [0.0, 0.0] and at(49.0)[0] == 0.0 and at(51.0)[0] == 1.0
    assert [r.cpc for r in df.collect()] == [500.0, None]


def test_mix_needs_wins(spark):
    columns = "rate double, mu double, sigma double, ctr double, prev_rate double, prev_wins bigint, prev_mu double, prev_sigma double, prev_ctr double"
    rows = [(10.0, 50.0, 5.0, 0.1, 10.0, 3, 100.0, 7.0, 0.5), (10.0, 50.0, 5.0, 0.1, 10.0, 0, 0.0, 1.0, None), (0.0, 75.0, 50.0, 8e-4, 2.0, 1, 9.0, 1.0, 0.0)]
    first, second, third = mix(spark.createDataFrame(rows, columns)).collect()
    assert first.rate == pytest.approx(10.0) and first.mu == pytest.approx(60.0) and first.ctr == pytest.approx(0.18)
    assert (second.mu, third.mu) == (50.0, 75.0)


def test_prep_rules(spark):
    assert rename_tags(spark.createDataFrame([(1, 2)], "`10006` int, x int")).columns == ["UT_10006", "x"]
    df = cast_schema(spark.createDataFrame([("3.0", "x", "true", "k")], "a string, b string, c string, d string"), {"a": "int", "b": "double", "c": "boolean"})
    assert df.first()[:] == (3, None, 1.0, "k")
    codes = spark.createDataFrame([(1,), (None,)], "c int")
    assert [r[0] for r in codes.select(map_codes(F.col("c"), AD_EXCHANGES)).collect()] == ["DoubleClick", None]
    with pytest.raises(Exception, match="unknown code"):
        spark.createDataFrame([(9,)], "c int").select(map_codes(F.col("c"), AD_EXCHANGES)).collect()
    names = spark.createDataFrame([(1, "x"), (2, "unknown")], "code int, name string")
    mapped = map_dictionary(spark.createDataFrame([(1,), (2,), (3,), (None,)], "City int"), "City", names)
    assert sorted(r.City for r in mapped.collect()) == ["NA", "NA", "NA", "x"]


def test_unknown_names_are_errors(spark):
    with pytest.raises(ValueError, match="not a valid bidder"):
        bid_of("Nobody")
    raw = spark.createDataFrame([("Nobody", 1.0, 1.0, 1.0, 1.0, 1.0)], "Advertiser string, GBRT_prediction_Oil double, GBRT_prediction_Software double, GBRT_prediction_Tire double, GBRT_prediction_Chinese_vertical_eCommerce double, GBRT_prediction_International_eCommerce double")
    with pytest.raises(Exception, match="no such advertiser"):
        raw.select(prediction_of(F.col("Advertiser"))).collect()


def test_samples_and_splits(spark):
    df = spark.range(20000).withColumnRenamed("id", "bid_id")
    kept = sample_log(df, 0.1, 1, "bid_id")
    assert abs(kept.count() - 2000) < 200
    assert kept.exceptAll(sample_log(df.repartition(3), 0.1, 1, "bid_id")).count() == 0
    train, none, test, zero = split_log(df, [0.7, 0.0, 0.3, 0.0], 42, "bid_id")
    assert (none.count(), zero.count()) == (0, 0)
    assert train.count() + test.count() == 20000 and abs(train.count() - 14000) < 300
    assert train.join(test, "bid_id").count() == 0
