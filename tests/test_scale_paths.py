"""Global ranks, mergeable moments, split routing and dispatch by strategy."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from bidlens.operators.auction import route, route_split
from bidlens.operators.features import label_index, labels_of
from bidlens.operators.landscape import merge_moments, moments, won_by_hour, won_overall, won_sigma
from bidlens.operators.ranking import with_rank
from bidlens.plans import replay
from bidlens.plans.replay import gated_offers, offers, won_hours
from bidlens.session import materialize
from bidlens.suite import tables as t


def plan_of(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_rank_of_a_million_labels(spark):
    n = 1_000_000
    # Labels 0 to 9 twice, so most are tied; ties go by name.
    ids = spark.range(n + 10, numPartitions=8).select((F.col("id") % n).cast("string").alias("x"))
    labels = labels_of(ids, "x")
    assert "Window" not in plan_of(labels)
    found = labels.select("label", "index")
    by_name = sorted(map(str, range(10))) + sorted(map(str, range(10, n)))
    expected = {0: by_name[0], 9: by_name[9], 10: by_name[10], 543_210: by_name[543_210], n - 1: by_name[-1]}
    rows = {int(r["index"]): r["label"] for r in found.where(F.col("index").isin(list(map(float, expected)))).collect()}
    assert rows == expected
    assert found.agg(F.count("*"), F.countDistinct("index"), F.min("index"), F.max("index")).first() == (n, n, 0.0, n - 1.0)
    assert label_index(spark.createDataFrame([(by_name[77],), ("none",)], "x string"), "x", labels, "skip").first()["index"] == 77.0


def test_rank_of_few_and_no_rows(spark):
    df = spark.createDataFrame([("b", 1), ("a", 1), (None, 1), ("c", 2)], "x string, n int")
    assert [(r.x, r["rank"]) for r in with_rank(df, [F.desc("n"), "x"]).orderBy("rank").collect()] == [("c", 0), (None, 1), ("a", 2), ("b", 3)]
    assert with_rank(df.where("false"), ["x"]).count() == 0


def test_merged_moments_equal_those_of_the_union(spark):
    rows = [(k, h, h % 3 > 0, h % 2 == 0, float(h * h % 17) if h % 3 else 0.0, dt.datetime(2024, 1, 1, h % 24)) for k in "ab" for h in range(60)]
    rows += [("c", 0, False, False, 0.0, dt.datetime(2024, 1, 1)), ("d", 1, True, False, 5.0, dt.datetime(2024, 1, 1))]
    seen = spark.createDataFrame(rows, "k string, part int, won boolean, click boolean, pay double, ts timestamp_ntz")
    seen = seen.withColumn("part", F.col("part") % 7)
    once = {r.k: r for r in moments(seen, ["k"]).withColumn("sigma", won_sigma()).collect()}
    merged = {r.k: r for r in merge_moments(moments(seen, ["k", "part"]), ["k"]).withColumn("sigma", won_sigma()).collect()}
    assert once.keys() == merged.keys()
    for k, r in once.items():
        for c in ("requests", "wins", "clicks", "spend", "first_ts", "last_ts"):
            assert r[c] == merged[k][c]
        for c in ("mu", "sigma"):
            assert r[c] == (None if merged[k][c] is None else pytest.approx(merged[k][c], rel=1e-12))


@pytest.mark.parametrize("until", [False, True])
@pytest.mark.parametrize("small", [True, False])
def test_hours_of_campaigns_equal_the_rows_they_saw(spark, data, monkeypatch, until, small):
    if not small:
        monkeypatch.setattr(replay, "is_small", lambda df: False)
    camp = t.campaigns(spark, data, ["TrueValue"])
    rows = materialize(offers(t.requests(spark, data), camp, t.landscape(spark, data), ["TrueValue"]))
    now = F.col("start_ts") + F.expr("interval 10 hours")
    seen = gated_offers(rows, camp).filter("open and seen")
    if until:
        seen = seen.filter(F.col("ts") <= now)
    keys = ["campaign_id", "advertiser", "hour_ts"]
    exact = {tuple(r[k] for k in keys): r for r in moments(seen, keys).collect()}
    found = won_hours(rows, camp, now if until else None, sorted_wins=3)
    assert "campaign_id" in found.columns and found.count() == len(exact)
    for r in found.collect():
        e = exact[tuple(r[k] for k in keys)]
        assert (r.requests, r.wins, r.clicks, r.spend, r.first_ts, r.last_ts) == (e.requests, e.wins, e.clicks, e.spend, e.first_ts, e.last_ts)
        assert r.mu == (None if e.mu is None else pytest.approx(e.mu)) and (r.squares or 0) == pytest.approx(e.squares or 0)
    assert won_by_hour(found, ["campaign_id"]).count() == len(exact)
    assert won_overall(found, ["campaign_id"], F.lit(t.START).cast("timestamp_ntz")).count() == len({k[0] for k in exact})


def test_won_hours_read_no_row_per_request_and_campaign(spark, data):
    camp = t.campaigns(spark, data, ["TrueValue"])
    rows = offers(t.requests(spark, data), camp, t.landscape(spark, data), ["TrueValue"])
    # The budgets (8 per advertiser) meet hours, and requests only of the hours in which one ends.
    assert won_hours(rows, camp).count() < 8 * rows.count()


def test_split_routing_of_a_hot_advertiser(spark):
    asked = spark.range(6_000).select(F.col("id").alias("bid_id"), F.when(F.col("id") % 100 < 1, "hot").otherwise("cold").alias("advertiser"))
    lanes = spark.range(100_100).select(F.col("id").alias("lane_id"), F.when(F.col("id") < 100_000, "hot").otherwise("cold").alias("advertiser"), F.lit(1.0).alias("bid_level"))
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        routed = route_split(asked, lanes, cell_offers=5_000)
        per_task = sorted(r["count"] for r in routed.groupBy(F.spark_partition_id().alias("p")).count().collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])
    assert sum(per_task) == 60 * 100_000 + 5_940 * 100
    assert per_task[-1] <= 3 * per_task[len(per_task) // 2] and len(per_task) == 64
    sums = [F.sum("bid_id"), F.sum("lane_id"), F.sum(F.col("bid_id") * F.col("lane_id")), F.countDistinct("bid_id", "lane_id")]
    few = lanes.where("lane_id % 1000 = 0 or lane_id >= 100000")
    assert route_split(asked, few, cell_offers=700).agg(*sums).first() == route(asked, few).agg(*sums).first()
    assert set(route_split(asked, few).columns) == set(route(asked, few).columns)
    assert route_split(asked.where("false"), few).count() == 0


def test_large_campaign_tables_are_offered_the_same(spark, data, monkeypatch):
    names = ["TrueValue", "ConstantAvgValue"]
    camp = t.campaigns(spark, data, names)
    kept = ["bid_id", "lane_id", "bid", "won", "pay", "strategy"]
    small = offers(t.requests(spark, data), camp, t.landscape(spark, data), names).select(kept)
    monkeypatch.setattr(replay, "is_small", lambda df: False)
    large = offers(t.requests(spark, data), camp, t.landscape(spark, data), names).select(kept)
    assert small.count() == large.count() and small.exceptAll(large).isEmpty()


def test_only_rows_of_batched_strategies_leave_the_jvm(spark, data):
    names = ["TrueValue", "ORTB"]
    camp = materialize(t.campaigns(spark, data, names, lam=0.01).filter("budget_factor = 1"))
    requests, cells = t.requests(spark, data), t.landscape(spark, data)
    mixed = offers(requests, camp, cells, names)
    plan = plan_of(mixed)
    assert plan.count("ArrowEvalPython") and "Union" in plan
    whole = mixed.select("bid_id", "strategy", "bid")
    for name in names:
        alone = offers(requests, materialize(camp.filter(F.col("strategy") == name)), cells, [name])
        assert ("ArrowEvalPython" in plan_of(alone)) == (name == "ORTB")
        alone = alone.select("bid_id", "strategy", "bid")
        part = whole.filter(F.col("strategy") == name)
        assert part.count() == alone.count() and part.exceptAll(alone).isEmpty()
    with pytest.raises(Exception, match="not a valid bidder"):
        offers(requests, camp, cells, ["TrueValue"]).collect()
