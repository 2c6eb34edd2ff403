"""Budget gate: a campaign sees requests only until its wins have used up the budget.

A running sum over a whole campaign would put a large part of the log into one task. The gate
looks instead for the win that exhausts the budget, by narrowing: spend per hour, then per
second of the hour in question, then per instant, and so on. Each level is an aggregate,
combined map-side, over one cell per campaign, so no level sorts or shuffles the log. Prices
must not be negative.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidlens.functions.pricing import TOTAL
from bidlens.functions.timeparts import hour_start
from bidlens.session import broadcast_if_small, is_small, materialize

# Campaigns that differ only in their budget share a lane: the same bids, so the same wins. The id of
# a lane stands for everything that decides its bids.
LANE = ["lane_id"]


def tie(bid_id: Column) -> Column:
    """Order of requests of the same instant: by digest, then id. A prefix of the digest splits
    any number of requests evenly."""
    return F.md5(bid_id.cast("string"))


# A cell with no more wins than this is put in order as it is; a larger one is narrowed first.
SORTED_WINS = 200_000

# Levels of narrowing. A cell has a bounded number of cells of the next level: 3600 seconds,
# 10^6 instants, 16^5 prefixes.
LEVELS = {
    "second_ts": lambda: F.date_trunc("second", F.col("ts")).cast("timestamp_ntz"),
    "ts": lambda: F.col("ts"),
    "tie_part": lambda: F.substring(tie(F.col("bid_id")), 1, 5),
}


def with_hour(df: DataFrame) -> DataFrame:
    return df if "hour_ts" in df.columns else df.withColumn("hour_ts", hour_start(F.col("ts")))


def crossing(reached_by: DataFrame, cells: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The cell of each campaign in which its spend reaches the budget.

    ``reached_by`` has the campaigns with ``budget`` and the spend ``before`` these cells.
    """
    so_far = Window.partitionBy("campaign_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = reached_by.join(cells, list(keys)).withColumn(
        "reached", F.col("before") + F.sum("spend").over(so_far)
    )
    start = F.col("reached") - F.col("spend")
    return summed.filter((start < F.col("budget")) & (F.col("reached") >= F.col("budget"))).withColumn(
        "before", start
    )


def crossing_hours(campaigns: DataFrame, by_hour: DataFrame, lane: Sequence[str] = LANE) -> DataFrame:
    """Hour in which each campaign runs out, from ``spend`` and number of wins ``n`` per lane and
    hour."""
    start = campaigns.select("campaign_id", *lane, "budget", F.lit(0).cast(TOTAL).alias("before"))
    cells = by_hour.filter("spend > 0").select(*lane, "hour_ts", "spend", "n")
    return crossing(start, cells, lane, [F.col("hour_ts")]).select(
        "campaign_id", *lane, "hour_ts", "budget", "before", "n"
    )


# More hours than this are not listed in a plan but joined.
LISTED_HOURS = 1000


def in_hours(rows: DataFrame, hours: DataFrame) -> DataFrame:
    """Rows of the hours in a small table, as a list in the plan. Unlike a join it reaches the
    scan: it prunes partitions, skips files by ``ts``, and goes before any bid is computed. More than
    ``LISTED_HOURS`` hours are joined; no hours give no rows."""
    listed = [r[0] for r in hours.select("hour_ts").distinct().limit(LISTED_HOURS + 1).collect()]
    if not listed:
        return rows.filter(F.lit(False))
    if len(listed) > LISTED_HOURS:
        return rows.join(broadcast_if_small(hours.select("hour_ts").distinct()), "hour_ts", "left_semi").select(*rows.columns)

    def at(hour: dt.datetime) -> Column:
        return F.lit(hour).cast("timestamp_ntz")

    until = max(listed) + dt.timedelta(hours=1)
    in_range = (F.col("ts") >= at(min(listed))) & (F.col("ts") < at(until))
    return rows.filter(in_range & F.col("hour_ts").isin([at(h) for h in listed]))


def narrow(
    won: DataFrame,
    hours: DataFrame,
    lane: Sequence[str] = LANE,
    small: bool = True,
    sorted_wins: int = SORTED_WINS,
    store: bool = True,
) -> DataFrame:
    """From the hour in which a campaign runs out to the win that does it.

    ``won`` has one row per win of a lane with ``ts``, ``bid_id`` and ``pay``. With ``small``
    (no more campaigns than a broadcast may hold) the wanted cells, at most one per campaign,
    are broadcast. Every level is stored, one row per campaign, so that the next one is a plain
    scan with a filter. Copies of one bid id at one instant count as one win.
    """
    rows = with_hour(won).select(*lane, "hour_ts", "ts", "bid_id", "pay")
    open_cells, keys = hours, [*lane, "hour_ts"]

    def inside(*more: str) -> DataFrame:
        wanted = open_cells.select(*keys).distinct()
        names = [k for k in [*keys, *more] if k not in rows.columns]
        keyed = rows.withColumns({k: LEVELS[k]() for k in names}) if names else rows
        return keyed.join(F.broadcast(wanted) if small else wanted, keys)

    for level in LEVELS:
        if open_cells.filter(F.col("n") > sorted_wins).isEmpty():
            break
        cells = inside(level).groupBy(*keys, level).agg(F.sum("pay").alias("spend"), F.count("*").alias("n"))
        found = crossing(open_cells.drop("n"), cells, keys, [F.col(level)])
        keys = [*keys, level]
        open_cells = materialize(found.select("campaign_id", "budget", "before", "n", *keys))

    wins = inside().groupBy(*dict.fromkeys([*keys, "ts", "bid_id"])).agg(F.sum("pay").alias("spend"))
    in_order = [F.col("ts"), tie(F.col("bid_id")), F.col("bid_id")]
    cuts = crossing(open_cells, wins, keys, in_order).select(
        "campaign_id",
        F.col("ts").alias("cut_ts"),
        tie(F.col("bid_id")).alias("cut_tie"),
        F.col("bid_id").alias("cut_bid"),
        F.col("reached").alias("spent"),
    )
    return materialize(cuts) if store else cuts


def budget_cuts(
    won: DataFrame, campaigns: DataFrame, lane: Sequence[str] = LANE, sorted_wins: int = SORTED_WINS
) -> DataFrame:
    """One row per campaign that runs out of budget: the win that exhausts it.

    The spend per hour is stored, so that finding the cut reads the log only in those hours.
    """
    won = with_hour(won)
    by_hour = materialize(won.groupBy(*lane, "hour_ts").agg(F.sum("pay").alias("spend"), F.count("*").alias("n")))
    hours = materialize(crossing_hours(campaigns, by_hour, lane))
    return narrow(in_hours(won, hours), hours, lane, is_small(campaigns), sorted_wins)


def within(ts: Column, bid_id: Column) -> Column:
    """Whether a request is not after the cut of its campaign; the digest is only computed for
    requests of the very instant."""
    at_cut = (tie(bid_id) < F.col("cut_tie")) | (
        (tie(bid_id) == F.col("cut_tie")) & (bid_id <= F.col("cut_bid"))
    )
    return F.col("cut_ts").isNull() | (ts < F.col("cut_ts")) | ((ts == F.col("cut_ts")) & at_cut)


def budget_gate(offered: DataFrame, cuts: DataFrame, small: bool = True) -> DataFrame:
    """Mark what each campaign sees. The win that exhausts the budget is still seen, and may
    overshoot it."""
    at = cuts.select("campaign_id", "cut_ts", "cut_tie", "cut_bid")
    joined = offered.join(F.broadcast(at) if small else at, "campaign_id", "left")
    return joined.withColumn("seen", within(F.col("ts"), F.col("bid_id"))).drop("cut_ts", "cut_tie", "cut_bid")
