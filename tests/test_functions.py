import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from bidlens.functions.normal import cdf_array, norm_cdf
from bidlens.functions.pricing import ectr, expected_kpi, round_bid, share_le, unit_hash
from bidlens.functions.timeparts import day_hour, hour_spine, hours_between, parse_ts, shift_cell, shift_hour, time_of_day
from bidlens.operators.ort import ort_array


def ort_bid(kpi, lam, loc, scl, cap):
    """The bid by plain bisection, with the exact error function."""
    low, high, bid = 0.0, cap, cap / 2
    for step in range(20):
        x = (math.log(bid) - loc) / scl
        density = math.exp(-x * x / 2) / math.sqrt(2 * math.pi)
        gap = lam * 0.5 * math.erfc(-x / math.sqrt(2)) - (kpi - lam * bid) / (scl * bid) * density
        if step and abs(gap) <= 1e-10 * lam:
            break
        low, high = (bid, high) if gap < 0 else (low, bid)
        bid = (low + high) / 2
    return bid


def test_parse_ts(spark):
    texts = [("20130613000000001",), ("20130613235959",), ("201306130102035",), (None,)]
    rows = spark.createDataFrame(texts, "x string").select(parse_ts(F.col("x")).alias("ts")).collect()
    assert [r.ts for r in rows] == [
        dt.datetime(2013, 6, 13, 0, 0, 0, 1000),
        dt.datetime(2013, 6, 13, 23, 59, 59),
        dt.datetime(2013, 6, 13, 1, 2, 3, 5000),
        None,
    ]


def test_hours_wrap_at_midnight_and_sunday(spark):
    df = spark.createDataFrame([(dt.datetime(2013, 6, 16, 23, 30),), (dt.datetime(2013, 6, 17, 0, 0),)], "ts timestamp_ntz")
    ts = F.col("ts")
    day, hour = day_hour(ts)
    found = df.select(day, hour, *shift_hour(ts, 1), *shift_hour(ts, -1), *shift_cell(day, hour, 1), *shift_cell(day, hour, -1))
    assert [tuple(r) for r in found.collect()] == [
        ("SUNDAY", 23, "MONDAY", 0, "SUNDAY", 22, "MONDAY", 0, "SUNDAY", 22),
        ("MONDAY", 0, "MONDAY", 1, "SUNDAY", 23, "MONDAY", 1, "SUNDAY", 23),
    ]


def test_hour_spine_counts_full_hours(spark):
    times = [(dt.datetime(2024, 1, 1, 10, 30), dt.datetime(2024, 1, 1, 12, 15)), (dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 1))]
    df = spark.createDataFrame(times, "a timestamp_ntz, b timestamp_ntz")
    assert [(r.weekday, r.hour) for r in hour_spine(df, "a", "b").collect()] == [("MONDAY", 10), ("MONDAY", 11)]
    assert df.select(hours_between(F.col("a"), F.col("b"))).first()[0] == 2


def test_time_of_day(spark):
    df = spark.range(24).select(time_of_day(F.col("id")).alias("t"))
    assert [r.t for r in df.collect()] == ["evening"] + ["night"] * 6 + ["morning"] * 6 + ["afternoon"] * 6 + ["evening"] * 5


def test_value_expressions(spark):
    df = spark.createDataFrame([(0.0, 2.0), (1.0, 2.0), (9.0, 2.0)], "p double, f double")
    assert [r[0] for r in df.select(ectr(F.col("p"), F.col("f"))).collect()] == [0.0, 0.5, 1.0]
    one = spark.range(1)
    assert one.select(expected_kpi("Surplus", F.lit(5.0), F.lit(2.0))).first()[0] == 3.0
    assert one.select(expected_kpi("ROI", F.lit(5.0), F.lit(2.0))).first()[0] == 0.5
    assert one.select(expected_kpi("ROI", F.lit(5.0), F.lit(0.0))).first()[0] is None
    with pytest.raises(ValueError):
        expected_kpi("Margin", F.lit(1.0), F.lit(1.0))
    assert [r[0] for r in one.select(F.explode(F.array(*[round_bid(F.lit(x)) for x in (1.005, 2.344, 0.004)]))).collect()] == [1.01, 2.34, 0.0]
    assert one.select(share_le(F.lit(25.0), 25), share_le(F.lit(25.1), 25)).first()[:] == (1.0, 0.0)


def test_normal_distribution(spark):
    xs = np.linspace(-8, 8, 401)
    exact = np.array([0.5 * math.erfc(-x / math.sqrt(2)) for x in xs])
    assert np.abs(cdf_array(xs) - exact).max() < 1e-12
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    found = np.array([r[0] for r in df.select(norm_cdf(F.col("x"))).collect()])
    assert np.abs(found - exact).max() < 1e-12 and (np.diff(found) >= 0).all()


def test_optimal_bid_matches_scalar_search():
    rng = np.random.default_rng(1)
    k, l, m, s = rng.random(300), rng.uniform(1e-4, 0.05, 300), rng.uniform(3, 5, 300), rng.uniform(0.3, 1, 300)
    found = ort_array(k, l, m, s, np.full(300, 310.0))
    exact = [ort_bid(*args, 310.0) for args in zip(k, l, m, s)]
    assert np.abs(found - exact).max() < 1e-3 and np.median(np.abs(found - exact)) < 1e-9


def test_hash_draw_is_uniform_and_stable(spark):
    df = spark.range(20000).select(unit_hash(F.col("id"), 3).alias("u"))
    low, high, mean = df.agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 <= low and high < 1 and abs(mean - 0.5) < 0.01
    assert df.repartition(5).agg(F.sum("u")).first()[0] == pytest.approx(df.agg(F.sum("u")).first()[0])
