"""Requests offered to campaigns, auctions and their outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidlens.functions.pricing import ectr, expected_kpi, money, private_value
from bidlens.session import broadcast_if_small, materialize


def route(requests: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Offer every request to all campaigns of its advertiser.

    The campaign table is made by the driver; give it through ``broadcast_if_small`` so that
    the log is not shuffled on its few advertisers.
    """
    return requests.join(campaigns, "advertiser")


# Offers that one cell of a split advertiser makes, about.
CELL_OFFERS = 1_000_000


def route_split(requests: DataFrame, campaigns: DataFrame, cell_offers: int = CELL_OFFERS) -> DataFrame:
    """``route`` for campaigns that are too many to broadcast, with no task for a whole advertiser.

    Requests and campaigns are counted per advertiser. Its offers are dealt to a grid of cells: requests to rows
    by a hash of their id, campaigns to columns, and each is copied along the other side, so that a cell makes
    about ``cell_offers`` offers. The grid has the proportions of the two sides, which copies the least.
    """
    asked = requests.groupBy("advertiser").agg(F.count("*").alias("_asked"))
    offering = campaigns.groupBy("advertiser").agg(F.count("*").alias("_offering"))
    cells = F.ceil(F.col("_asked") * F.col("_offering").cast("double") / cell_offers)
    rows = F.least(F.greatest(F.round(F.sqrt(cells * F.col("_asked") / F.col("_offering"))), F.lit(1.0)), cells.cast("double"))
    grid = asked.join(offering, "advertiser").select(
        "advertiser", rows.cast("int").alias("_rows"), F.ceil(cells / rows).cast("int").alias("_columns")
    )
    grid = broadcast_if_small(materialize(grid))

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    own = requests.join(grid, "advertiser").withColumn("_row", F.pmod(F.xxhash64("bid_id"), F.col("_rows")).cast("int"))
    own = own.withColumn("_column", every("_columns")).drop("_rows", "_columns")
    sides = [c for c in campaigns.columns if c != "advertiser"]
    theirs = campaigns.join(grid, "advertiser").withColumn("_column", F.pmod(F.xxhash64(*sides), F.col("_columns")).cast("int"))
    theirs = theirs.withColumn("_row", every("_rows")).drop("_rows", "_columns")
    return own.join(theirs, ["advertiser", "_row", "_column"]).drop("_row", "_column")


Layers = list[dict[str, Column]]


def add_layers(df: DataFrame, layers: Layers) -> DataFrame:
    """Add columns in layers; a layer may use the columns of those before. A loop over many
    inputs builds its layers once."""
    for layer in layers:
        df = df.withColumns(layer)
    return df


def value_layers() -> Layers:
    probability = ectr(F.col("ctr_prediction"), F.col("ectr_factor"))
    return [{"ectr": probability}, {"private_value": private_value(F.col("ectr"), F.col("click_value"))}]


def with_value(routed: DataFrame) -> DataFrame:
    return add_layers(routed, value_layers())


def with_expected_kpis(valued: DataFrame) -> DataFrame:
    value, price = F.col("private_value"), F.col("wp_prediction")
    return valued.withColumns(
        {"surplus": expected_kpi("Surplus", value, price), "roi": expected_kpi("ROI", value, price)}
    )


def is_won(bid: Column, price: Column) -> Column:
    return bid >= price


def payment(bid: Column, price: Column, floor: Column) -> Column:
    """Second price; the own bid where that is below the floor; nothing when lost."""
    return F.when((bid >= price) & (bid >= floor), price).when(bid >= price, bid).otherwise(F.lit(0.0))


def has_started(ts: Column) -> Column:
    return ts > F.col("start_ts")


def has_ended(ts: Column) -> Column:
    return ts > F.col("end_ts")


def auction_layers() -> Layers:
    bid, price, floor = F.col("bid"), F.col("winning_price"), F.col("floor_price")
    runs = has_started(F.col("ts")) & ~has_ended(F.col("ts"))
    bidding = runs & (bid > 0)
    won = bidding & F.coalesce(is_won(bid, price), F.lit(False))
    paid = F.when(F.col("won"), payment(bid, price, floor)).otherwise(F.lit(0.0))
    result = {
        "click": F.col("won") & F.coalesce("is_click", F.lit(False)),
        "conversion": F.col("won") & F.coalesce("is_conversion", F.lit(False)),
        "pay": money(paid),
    }
    return [{"open": runs, "bids": bidding, "won": won}, result]


def with_auction(bids: DataFrame) -> DataFrame:
    """Resolve the auction of every row with a ``bid``.

    ``open`` tells whether the campaign runs by its schedule, ``won`` and ``pay`` what the bid
    brings while the budget lasts.
    """
    return add_layers(bids, auction_layers())


def outcome() -> Column:
    """Class of a request: missed (campaign not running), passed (no bid), lost or won."""
    return (
        F.when(~(F.col("open") & F.col("seen")), "missed")
        .when(~F.col("bids"), "passed")
        .when(F.col("won"), "won")
        .otherwise("lost")
    )


def out_of_order(requests: DataFrame, position: str) -> DataFrame:
    """Requests earlier than an earlier one of their advertiser, by position in the log.

    Exact without one sort per advertiser: blocks of the position are sorted on their own, and
    the latest time of all blocks before is added from a table of one row per block.
    """
    # Fixed value: positions per block.
    size = 1 << 16
    blocks = requests.withColumn("_block", F.floor(F.col(position) / size))
    tops = blocks.groupBy("advertiser", "_block").agg(F.max("ts").alias("_top"))
    earlier = Window.partitionBy("advertiser").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("advertiser", "_block", F.max("_top").over(earlier).alias("_before"))
    inside = (
        Window.partitionBy("advertiser", "_block").orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    )
    latest = F.greatest(F.max("ts").over(inside), F.col("_before"))
    marked = blocks.join(tops, ["advertiser", "_block"]).withColumn("_latest", latest)
    return marked.filter(F.col("ts") < F.col("_latest")).drop("_block", "_before", "_latest")
