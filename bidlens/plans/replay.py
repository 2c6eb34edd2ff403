"""Replay of logged requests against campaigns whose bids do not depend on their own state."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidlens.functions.pricing import MONEY
from bidlens.functions.timeparts import day_hour, format_ts, hour_start
from bidlens.operators.auction import outcome, route, route_split, with_auction, with_value
from bidlens.operators.budget import (
    LANE,
    SORTED_WINS,
    budget_cuts,
    budget_gate,
    crossing_hours,
    in_hours,
    narrow,
    with_hour,
    within,
)
from bidlens.operators.kpis import COUNTERS, COUNTER_TYPES, count_requests
from bidlens.operators.landscape import lognormal, moments, with_landscape
from bidlens.operators.strategies import ARROW_STRATEGIES, bid_by_strategy
from bidlens.session import broadcast_if_small, is_small, materialize

# The shares of the full budget that a run compares.
BUDGET_FACTORS = [1, 0.5, 0.33, 0.25, 0.125, 0.1, 0.05, 0.01]

LANE_COLUMNS = [
    "advertiser",
    "strategy",
    "click_value",
    "ectr_factor",
    "start_ts",
    "end_ts",
    "bid_level",
    "baseline",
    "shading",
    "lambda",
]

ADVERTISER_SCHEMA = """
    advertiser string, full_budget double, click_value double, base_ctr double, ectr_factor double,
    start_ts timestamp_ntz, end_ts timestamp_ntz
"""


def advertiser_table(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    """Advertisers of a run, given by the driver: name, full budget, click value, usual click
    rate, calibration factor, start and end."""
    return spark.createDataFrame(list(rows), ADVERTISER_SCHEMA)


def iso(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


def campaign_table(
    advertisers: DataFrame,
    strategies: Sequence[str],
    factors: Sequence[float] = BUDGET_FACTORS,
    shading: float = 0.0,
    lam: float = 5.2e-7,
) -> DataFrame:
    """One campaign per advertiser, strategy and budget factor. Runs with other parameters can be
    united: the id names the parameter that the strategy uses."""
    spark = advertisers.sparkSession
    runs = spark.createDataFrame(
        [(s, float(f)) for s in strategies for f in factors], "strategy string, budget_factor double"
    )
    level = F.col("click_value") * F.col("base_ctr")
    budget = (F.col("budget_factor") * F.col("full_budget")).cast(MONEY)
    # NULL, and so no part of the id, where the strategy uses neither.
    level_name = F.when(F.col("strategy") == "ShadedValueBidder", F.lit(str(float(shading)))).when(
        F.col("strategy") == "ORTB", F.lit(str(float(lam)))
    )
    no_budget = F.raise_error(F.lit("a campaign needs a positive budget")).cast(MONEY)
    return advertisers.crossJoin(F.broadcast(runs)).select(
        F.concat_ws("_", "advertiser", F.col("budget_factor").cast("string"), "strategy", level_name).alias("campaign_id"),
        "advertiser",
        "strategy",
        "budget_factor",
        F.when(budget > 0, budget).otherwise(no_budget).alias("budget"),
        "click_value",
        "ectr_factor",
        "start_ts",
        "end_ts",
        level.alias("bid_level"),
        level.alias("baseline"),
        F.lit(float(shading)).alias("shading"),
        F.lit(float(lam)).alias("lambda"),
    )


def with_lane(campaigns: DataFrame) -> DataFrame:
    """Name the lane of every campaign by a digest of all that decides its bids."""
    return campaigns.withColumn("lane_id", F.md5(F.to_json(F.struct(*LANE_COLUMNS))))


def lanes(campaigns: DataFrame) -> DataFrame:
    """Campaigns without their budgets: what decides the bids."""
    return with_lane(campaigns.select(*LANE_COLUMNS).distinct())


def distinct_campaigns(campaigns: DataFrame) -> DataFrame:
    """Campaigns with their lanes; an id that two of them share is an error."""
    twice = campaigns.groupBy("campaign_id").count().filter("count > 1").first()
    if twice:
        raise ValueError(f"campaign_id is not unique: {twice.campaign_id}")
    return with_lane(campaigns)


def offers(requests: DataFrame, campaigns: DataFrame, landscape: DataFrame, strategies: Sequence[str]) -> DataFrame:
    """Bid and auction result of every request in every lane of its advertiser. Campaigns and
    landscape are counted, so pass stored ones.

    Lanes whose strategy bids in Arrow batches are routed apart from the others, so only their rows leave the JVM.
    """
    lane_table, small = lanes(campaigns), is_small(campaigns)
    cells = broadcast_if_small(landscape)
    batched = [s for s in strategies if s in ARROW_STRATEGIES]
    plain = [s for s in strategies if s not in ARROW_STRATEGIES]
    if not (batched and plain):
        return _offered(requests, lane_table, small, cells, list(strategies))
    # A strategy that is not named at all goes with the plain ones, where it is an error.
    known = F.col("strategy").isin(batched)
    return _offered(requests, lane_table.filter(~known), small, cells, plain).unionByName(
        _offered(requests, lane_table.filter(known), small, cells, batched)
    )


def _offered(requests: DataFrame, lane_table: DataFrame, small: bool, landscape: DataFrame, strategies: list[str]) -> DataFrame:
    routed = route(requests, F.broadcast(lane_table)) if small else route_split(requests, materialize(lane_table))
    valued = with_value(routed)
    weekday, hour = day_hour(F.col("ts"))
    cells = lognormal(with_landscape(valued.withColumn("weekday", weekday).withColumn("hour", hour), landscape))
    bids = cells.withColumn("remaining", F.lit(None).cast(MONEY)).withColumn("bid", bid_by_strategy(strategies))
    return with_hour(with_auction(bids))


def gated_offers(offered: DataFrame, campaigns: DataFrame) -> DataFrame:
    """One row per request and campaign with what the campaign sees of it."""
    campaigns, small = distinct_campaigns(campaigns), is_small(campaigns)
    cuts = budget_cuts(offered.filter("won"), campaigns)
    budgets = campaigns.select("campaign_id", *LANE, "budget_factor", "budget")
    fanned = offered.join(F.broadcast(budgets) if small else budgets, LANE)
    return budget_gate(fanned, cuts, small).withColumn("outcome", outcome())


# Column names of the detailed event log, in its order.
EVENT_COLUMNS = [
    "dataset",
    "budgetFactor",
    "campaign",
    "b_id",
    "timestamp",
    "privateValue",
    "eCTR",
    "eWP",
    "bid",
    "impression",
    "click",
    "conversion",
    "payingPrice",
]


def bid_events(gated: DataFrame, dataset: str) -> DataFrame:
    """The bids a campaign made, in the form of the detailed event log."""
    return gated.filter(F.col("outcome").isin("won", "lost")).select(
        F.lit(dataset).alias("dataset"),
        F.col("budget_factor").alias("budgetFactor"),
        F.col("campaign_id").alias("campaign"),
        F.col("bid_id").alias("b_id"),
        format_ts(F.col("ts")).alias("timestamp"),
        F.col("private_value").alias("privateValue"),
        F.col("ectr").alias("eCTR"),
        F.col("wp_prediction").alias("eWP"),
        "bid",
        F.col("won").alias("impression"),
        "click",
        "conversion",
        F.col("pay").cast("double").alias("payingPrice"),
    )


def campaign_counters(offered: DataFrame, campaigns: DataFrame, sorted_wins: int = SORTED_WINS) -> DataFrame:
    """Counters of every campaign up to its end, without a row per request and campaign.

    Hours are counted once per lane. Budgets then apply to the hourly counts, and only the
    hours in which a campaign runs out are read again.
    """
    campaigns, small = distinct_campaigns(campaigns), is_small(campaigns)
    by_hour = materialize(count_requests(offered, [*LANE, "hour_ts"]))
    hours = materialize(crossing_hours(campaigns, by_hour.withColumn("n", F.col("impressions"))))
    cut_hours = in_hours(offered, hours)
    cuts = narrow(cut_hours.filter("won"), hours, LANE, small, sorted_wins)

    ends = hours.select("campaign_id", F.col("hour_ts").alias("cut_hour"))
    per_hour = campaigns.join(ends, "campaign_id", "left").join(by_hour, LANE)
    per_hour = per_hour.filter("cut_hour is null or hour_ts <> cut_hour").withColumn(
        "seen", F.col("cut_hour").isNull() | (F.col("hour_ts") < F.col("cut_hour"))
    )
    cut = hours.select("campaign_id", *LANE, "hour_ts").join(cuts, "campaign_id")
    edge = cut_hours.join(F.broadcast(cut) if small else cut, [*LANE, "hour_ts"])
    edge = edge.withColumn("seen", within(F.col("ts"), F.col("bid_id")))
    parts = per_hour.select("campaign_id", "seen", *COUNTERS).unionByName(
        count_requests(edge, ["campaign_id", "seen"])
    )

    def total(name: str):
        # Requests that came after the budget was gone count as missed and as nothing else.
        unseen = F.col("requests") if name in ("requests", "missed") else F.lit(0).cast(COUNTER_TYPES[name])
        return F.sum(F.when(F.col("seen"), F.col(name)).otherwise(unseen)).alias(name)

    totals = parts.groupBy("campaign_id").agg(*[total(name) for name in COUNTERS])
    stops = cuts.select("campaign_id", "cut_ts")
    counted = campaigns.join(totals, "campaign_id", "left").join(stops, "campaign_id", "left")
    zero = {name: F.coalesce(F.col(name), F.lit(0)) for name in COUNTERS}
    return counted.withColumns(zero).withColumn("actual_end_ts", F.coalesce("cut_ts", "end_ts"))


def won_hours(
    offered: DataFrame,
    campaigns: DataFrame,
    until: Column | None = None,
    sorted_wins: int = SORTED_WINS,
) -> DataFrame:
    """Moments of what every campaign saw while it ran and had budget, per campaign and hour, without a row per
    request and campaign.

    Hours are counted once per lane; a campaign takes its lane's hours up to the one in which its budget ends, and
    only such hours are read again. With ``until``, a column of the campaigns, later requests do not count; the
    hour it falls into is read again too.
    """
    campaigns, small = distinct_campaigns(campaigns), is_small(campaigns)
    if until is not None:
        campaigns = campaigns.withColumn("until_ts", until)
    else:
        campaigns = campaigns.withColumn("until_ts", F.lit(None).cast("timestamp_ntz"))
    seen = offered.filter("open")
    by_hour = materialize(moments(seen, [*LANE, "hour_ts"]))
    hours = materialize(crossing_hours(campaigns, by_hour.withColumn("n", F.col("wins"))))
    cuts = narrow(in_hours(seen, hours).filter("won"), hours, LANE, small, sorted_wins)

    ends = hours.select("campaign_id", F.col("hour_ts").alias("cut_hour"))
    limits = campaigns.withColumn("until_hour", hour_start(F.col("until_ts"))).join(ends, "campaign_id", "left")
    # The first hour that a campaign does not take whole.
    limits = materialize(limits.withColumn("edge_hour", F.least("cut_hour", "until_hour")))
    columns = ["requests", "wins", "clicks", "spend", "mu", "squares", "first_ts", "last_ts"]
    whole = limits.join(by_hour, LANE).filter("edge_hour is null or hour_ts < edge_hour")
    edges = limits.filter("edge_hour is not null").join(cuts.select("campaign_id", "cut_ts", "cut_tie", "cut_bid"), "campaign_id", "left")
    edges = edges.select("campaign_id", "advertiser", *LANE, F.col("edge_hour").alias("hour_ts"), "until_ts", "cut_ts", "cut_tie", "cut_bid")
    again = in_hours(seen, edges.select("hour_ts").distinct()).drop("advertiser")
    rows = again.join(F.broadcast(edges) if small else edges, [*LANE, "hour_ts"])
    rows = rows.filter(within(F.col("ts"), F.col("bid_id")) & (F.col("until_ts").isNull() | (F.col("ts") <= F.col("until_ts"))))
    keys = ["campaign_id", "advertiser", "hour_ts"]
    return whole.select(*keys, *columns).unionByName(moments(rows, keys).select(*keys, *columns))
