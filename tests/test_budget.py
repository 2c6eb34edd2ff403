import datetime as dt

import pytest
from pyspark.sql import functions as F

from bidlens.operators.auction import out_of_order, with_auction
from bidlens.operators.budget import budget_cuts, budget_gate, crossing_hours, narrow, tie, with_hour
from bidlens.operators.kpis import campaign_kpis, kpi_text
from bidlens.plans.replay import campaign_counters, campaign_table, gated_offers, offers
from bidlens.session import materialize
from bidlens.suite import tables as t

T0 = dt.datetime(2024, 1, 22, 5)


@pytest.mark.parametrize(
    "bid, price, floor, won, pay",
    [(50, 50, 0, True, 50), (50, 40, 50, True, 40), (50, 40, 60, True, 50), (49.99, 50, 0, False, 0), (0, 0, 0, False, 0)],
)
def test_auction_boundaries(spark, bid, price, floor, won, pay):
    row = (T0, float(bid), float(price), float(floor), True, False, T0 - dt.timedelta(days=1), T0 + dt.timedelta(days=1))
    df = spark.createDataFrame(
        [row],
        "ts timestamp_ntz, bid double, winning_price double, floor_price double, is_click boolean, "
        "is_conversion boolean, start_ts timestamp_ntz, end_ts timestamp_ntz",
    )
    r = with_auction(df).first()
    assert (r.won, float(r.pay), r.click, r.conversion) == (won, pay, won, False)


def wins(spark, rows):
    schema = "lane_id string, ts timestamp_ntz, bid_id bigint, pay decimal(18,6)"
    return spark.createDataFrame([("a", ts, i, pay) for ts, i, pay in rows], schema)


def brute(spark, rows, budget):
    """Sequential cut with the order of ties taken from Spark's own digest."""
    df = wins(spark, rows).select("ts", "bid_id", "pay", tie(F.col("bid_id")).alias("tie"))
    total = 0
    for r in sorted(df.collect(), key=lambda r: (r.ts, r.tie, r.bid_id)):
        total += r.pay
        if total >= budget:
            return r.bid_id, total
    return None


@pytest.mark.parametrize("sorted_wins", [200_000, 40, 1])
def test_cut_equals_sequential_sum_at_every_level(spark, sorted_wins):
    from decimal import Decimal as D

    # A third of all wins at one instant, the rest spread over seconds and hours.
    rows = [(T0 + dt.timedelta(seconds=37 * i % 9000, microseconds=i), i, D(i % 7 + 1)) for i in range(400)]
    rows += [(T0 + dt.timedelta(seconds=4000), 1000 + i, D(3)) for i in range(200)]
    budgets = {f"c{b}": D(b) for b in (1, 10, 500, 900, 1100, 1300, 1500, 99999)}
    camp = spark.createDataFrame([(k, "a", b) for k, b in budgets.items()], "campaign_id string, lane_id string, budget decimal(18,6)")
    won = with_hour(wins(spark, rows))
    by_hour = won.groupBy("lane_id", "hour_ts").agg(F.sum("pay").alias("spend"), F.count("*").alias("n"))
    hours = materialize(crossing_hours(camp, by_hour))
    found = {r.campaign_id: (r.cut_bid, r.spent) for r in narrow(won, hours, sorted_wins=sorted_wins).collect()}
    expected = {k: brute(spark, rows, b) for k, b in budgets.items()}
    assert found == {k: v for k, v in expected.items() if v}


def test_budget_hit_exactly_and_gate(spark):
    from decimal import Decimal as D

    rows = [(T0 + dt.timedelta(minutes=i), i, D(10)) for i in range(10)]
    camp = spark.createDataFrame([("x", "a", D(30)), ("y", "a", D(31))], "campaign_id string, lane_id string, budget decimal(18,6)")
    cuts = budget_cuts(wins(spark, rows), camp)
    offered = wins(spark, rows).join(camp, ["lane_id"])
    seen = budget_gate(offered, cuts).filter("seen").groupBy("campaign_id").count().collect()
    assert {r.campaign_id: r["count"] for r in seen} == {"x": 3, "y": 4}


@pytest.fixture(scope="module")
def replayed(spark, data):
    names = ["TrueValue", "ConstantAvgValue"]
    camp = t.campaigns(spark, data, names)
    rows = offers(t.requests(spark, data), camp, t.landscape(spark, data), names)
    return rows, camp


def test_counters_equal_row_counts(replayed):
    rows, camp = replayed
    counted = {r.campaign_id: r for r in campaign_counters(rows, camp).collect()}
    by_row = gated_offers(rows, camp).groupBy("campaign_id").pivot("outcome", ["won", "lost", "passed", "missed"]).count().na.fill(0)
    for r in by_row.collect():
        c = counted[r.campaign_id]
        assert (c.impressions, c.lost, c.passed, c.missed) == (r.won, r.lost, r.passed, r.missed)
        assert c.requests == r.won + r.lost + r.passed + r.missed
        assert c.spend < c.budget + 500


def test_levels_of_one_strategy_do_not_mix(spark, data):
    """A union of runs with other parameters counts what the runs count alone."""
    name = ["ShadedValueBidder"]
    runs = [t.campaigns(spark, data, name, factors=[1.0, 0.05], shading=s) for s in (0.0, 0.7)]
    requests, cells = materialize(t.requests(spark, data)), t.landscape(spark, data)

    def counted(camp, **options):
        rows = campaign_counters(offers(requests, camp, cells, name), camp, **options)
        return sorted((r.campaign_id, r.requests, r.impressions, r.missed, r.spend, r.cut_ts) for r in rows.collect())

    together = materialize(runs[0].union(runs[1]))
    alone = sorted(counted(runs[0]) + counted(runs[1]))
    assert counted(together) == alone and len({r[2] for r in alone}) > 1
    assert counted(together, sorted_wins=1) == alone
    with pytest.raises(ValueError, match="not unique"):
        counted(materialize(runs[0].union(runs[0])))


def test_smaller_budget_never_wins_more(replayed):
    rows, camp = replayed
    kpis = campaign_kpis(campaign_counters(rows, camp)).collect()
    for advertiser, strategy in {(k.advertiser, k.strategy) for k in kpis}:
        line = sorted((k.budgetFactor, k.impressions) for k in kpis if (k.advertiser, k.strategy) == (advertiser, strategy))
        assert [n for _, n in line] == sorted(n for _, n in line)


def test_report_prints_every_campaign(replayed):
    rows, camp = replayed
    text = [r.report for r in kpi_text(campaign_kpis(campaign_counters(rows, camp))).collect()]
    assert len(text) == camp.count() and all("Actual ROI: " in x for x in text)


def test_budget_must_be_positive(spark):
    given = spark.createDataFrame([("a", 0.0, 1.0, 1.0, 1.0, T0, T0)], "advertiser string, full_budget double, click_value double, base_ctr double, ectr_factor double, start_ts timestamp_ntz, end_ts timestamp_ntz")
    with pytest.raises(Exception, match="positive budget"):
        campaign_table(given, ["TrueValue"], [1.0]).collect()


def test_out_of_order(spark):
    rows = [("a", T0 + dt.timedelta(seconds=s), p) for p, s in enumerate([1, 2, 2, 1, 3])] + [("a", T0, 70_000), ("b", T0, 5)]
    df = spark.createDataFrame(rows, "advertiser string, ts timestamp_ntz, position bigint")
    assert sorted(r.position for r in out_of_order(df, "position").collect()) == [3, 70_000]
