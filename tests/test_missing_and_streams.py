"""Missing numbers, stored runs, mixed headers, bucketed joins and streams that lose no row."""

import datetime as dt

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from bidlens.operators.features import feature_pipeline, fill_categories
from bidlens.operators.missing import FillMissing
from bidlens.operators.models import fit_price_model, optimality
from bidlens.operators.prep import join_prices, map_dictionary, store_bucketed, whole_number
from bidlens.session import fresh_path
from bidlens.sources.logs import landscape_cells, read_log, read_mixed_logs
from bidlens.sources.sinks import append_kpis, append_row_counts, read_kpis
from bidlens.streaming.streams import run_available
from bidlens.streaming.windows import end_marks, stream_windows
from bidlens.suite.model_queries import featured, training_log


def test_missing_values_are_learned_and_stored(spark, tmp_path):
    nan = float("nan")
    train = spark.createDataFrame([(1.0, None, 1), (3.0, nan, None), (nan, None, 0), (None, None, 1)], "a double, b double, c int")
    fitted = Pipeline(stages=[FillMissing(inputCols=["a", "b"]), FillMissing(inputCols=["c"], strategy="zero")]).fit(train)
    fitted.write().overwrite().save(str(tmp_path / "fill"))
    new = spark.createDataFrame([(None, nan, None), (5.0, 6.0, 7)], "a double, b double, c int")
    for model in (fitted, PipelineModel.load(str(tmp_path / "fill"))):
        assert [tuple(r) for r in model.transform(new).collect()] == [(2.0, 0.0, 0.0), (5.0, 6.0, 7.0)]
    assert FillMissing(inputCols=["a"]).fit(train.where("false")).transform(new).first().a == 0.0
    with pytest.raises(ValueError):
        FillMissing(inputCols=["a"], strategy="other").fit(train)


def test_a_missing_number_does_not_stop_the_features(spark, data, tmp_path):
    log = fill_categories(training_log(spark, data))
    first = log.agg(F.min("Bid_id")).first()[0]
    broken = log.withColumns({c: F.when(F.col("Bid_id") != first, F.col(c)) for c in ("City_Lat", "AdSlotW", "UT_10006")})
    model = feature_pipeline().fit(broken)
    model.write().overwrite().save(str(tmp_path / "features"))
    row = PipelineModel.load(str(tmp_path / "features")).transform(broken).filter(F.col("Bid_id") == first).first()
    mean = broken.agg(F.avg("City_Lat")).first()[0]
    assert row.FT_num[1] == pytest.approx(mean) and row.FT_ut[0] == 0.0
    assert not any(v != v for v in row.features.toArray())


def test_optimality_tells_a_fitted_model_from_another(spark, data):
    _, train, _ = featured(spark, data)
    model = fit_price_model(train)
    assert optimality(model, train.select("features", "PayingPrice")).agg(F.max("gap")).first()[0] < 1e-3
    other = train.select("features", (F.col("PayingPrice") + F.rand(1) * 50).alias("PayingPrice"))
    assert optimality(model, other).agg(F.max("gap")).first()[0] > 2e-3


def test_runs_written_twice_count_once(spark, tmp_path):
    path = str(tmp_path / "kpis")
    run = lambda name, n: spark.createDataFrame([("2024-01-01", name, i, 1.5) for i in range(n)], "sysdate string, dataset string, id int, x double")
    for name, n in (("a", 3), ("b", 2), ("a", 4), ("b", 2)):
        append_kpis(run(name, n), path)
    back = read_kpis(spark, path, run("a", 1))
    assert back.columns == ["sysdate", "dataset", "id", "x"] and dict(back.dtypes)["sysdate"] == "string"
    assert sorted((r.dataset, r.id) for r in back.collect()) == [("a", 0), ("a", 1), ("a", 2), ("a", 3), ("b", 0), ("b", 1)]
    counts = spark.createDataFrame([("f", 3)], "file_name string, nrow long")
    for name in ("x", "y", "x"):
        append_row_counts(counts, str(tmp_path / "counts"), name)
    assert read_log(spark, str(tmp_path / "counts"), sep="\t").count() == 2


def test_files_with_other_headers_are_united_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n1,2\n"3\n4",NA\n')
    (tmp_path / "b.csv").write_text("y,x\n20,10\n")
    (tmp_path / "c.csv").write_text('x,"odd, name",y\n5,o,6\n')
    (tmp_path / "d.csv").write_text("")
    (tmp_path / "e.csv").write_text("x,y\n")
    log, report = read_mixed_logs(spark, f"{tmp_path}/*.csv", expected=["x", "y", "z"])
    assert log.columns == ["x", "y", "z", "odd, name"]
    assert sorted((r.x, r.y, r.z, r["odd, name"]) for r in log.filter("x not like '3%' and x <> '4\"'").collect()) == [("1", "2", None, None), ("10", "20", None, None), ("5", "6", None, "o")]
    assert sorted(map(tuple, report.collect())) == [("odd, name", 1, False), ("x", 4, True), ("y", 4, True), ("z", 0, True)]
    (tmp_path / "f.csv").write_text("x,x\n1,2\n")
    with pytest.raises(ValueError):
        read_mixed_logs(spark, f"{tmp_path}/*.csv")
    assert read_mixed_logs(spark, f"{tmp_path}/d.csv", expected=["x"])[0].count() == 0


def test_bucketed_tables_join_without_an_exchange(spark, tmp_path):
    main = spark.range(5000).select(F.col("id").cast("string").alias("Bid_id"), "id")
    prices = spark.range(0, 9000, 3).select(F.col("id").cast("string").alias("Bid_id"), F.lit(1.0).alias("BidPrice"), F.col("id").cast("double").alias("PayingPrice"))
    a = store_bucketed(main, "Bid_id", "main_t", str(tmp_path / "a"), 8)
    b = store_bucketed(prices, "Bid_id", "price_t", str(tmp_path / "b"), 8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = join_prices(a, b.withColumnRenamed("Bid_id", "b_id"))
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        assert joined.count() == join_prices(main, prices.withColumnRenamed("Bid_id", "b_id")).count() == 1667
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("drop table main_t")
        spark.sql("drop table price_t")


def test_codes_and_names_with_ties(spark):
    codes = spark.createDataFrame([("3",), ("3.0",), ("3.7",), ("x",), (None,)], "c string")
    assert [r[0] for r in codes.select(whole_number(F.col("c"))).collect()] == [3, 3, None, None, None]
    names = spark.createDataFrame([(1, "beijing"), (1, "unknown"), (2, "unknown"), (3, "a"), (3, "b")], "code int, name string")
    rows = map_dictionary(spark.createDataFrame([("1",), ("2",), ("3",), ("9",)], "c string"), "c", names).collect()
    assert sorted(r.c for r in rows) == ["NA", "NA", "b", "beijing"]
    cells = spark.createDataFrame([("a", "Monday", 1, n, m, s, 0.01) for n, m, s in ((None, None, None), (10, 80.0, 20.0), (5, 70.0, None))], "Advertiser string, Weekday string, Hour int, Impressions long, muPrice double, sigmaPrice double, CTR double")
    (row,) = landscape_cells(cells).collect()
    assert (row.rate, row.mu, row.sigma, row.ctr) == (10.0, 80.0, 20.0, 0.01)


LOG = "advertiser string, ts timestamp_ntz, impression int, click int, paying_price double"


def test_a_stream_counts_late_rows_and_closes_its_hours(spark):
    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    source, out, marks, state = (fresh_path(spark, f"w-{n}") for n in ("source", "out", "marks", "state"))
    parts = [
        [("a", at(1), 1, 1, 2.0), ("a", at(1, 5), 1, 0, 4.0), ("a", at(4), 0, 1, 9.0), ("b", at(1), 1, 0, None), ("b", None, 1, 1, 1.0)],
        # Hour 1 of a is closed (clock 4:00), hour 3 is not; b is at 1:00 still. A null advertiser is one of its own.
        [("a", at(1, 30), 1, 1, 7.0), ("a", at(3), 1, 1, 5.0), ("b", at(1, 10), 1, 1, 3.0), (None, at(2), 1, 0, 1.0)],
    ]
    end_marks(spark.createDataFrame([], "advertiser string"), marks)
    log = None
    for part in parts:
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(source)
        log = log or spark.readStream.schema(LOG).parquet(source)
        windows = stream_windows(log, spark.readStream.schema("advertiser string").parquet(marks))
        run_available(windows, out, state)
    end_marks(spark.createDataFrame([("a",), ("b",), (None,)], "advertiser string"), marks)
    run_available(windows, out, state)
    run_available(windows, out, state)
    rows = sorted(spark.read.parquet(out).collect(), key=str)
    found = sorted(((r.kind, r.advertiser, r.hour_ts.hour, r.requests, r.impressions, r.clicks, r.spending, r.mu, r.sigma) for r in rows), key=str)
    expected = [
        ("late", "a", 1, 1, 1, 1, None, None, None),
        ("window", "a", 1, 2, 2, 1, 6.0, 3.0, pytest.approx(2**0.5)),
        ("window", "a", 3, 1, 1, 1, 5.0, 5.0, None),
        ("window", "a", 4, 1, 0, 0, None, None, None),
        ("window", "b", 1, 2, 2, 1, 3.0, 3.0, None),
        ("window", None, 2, 1, 1, 0, 1.0, 1.0, None),
    ]
    assert found == sorted(expected, key=lambda r: str(tuple(x if not hasattr(x, "expected") else x.expected for x in r)))
