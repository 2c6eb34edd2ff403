"""Bidding strategies: a strategy is a column expression over routed requests.

A new one is any function without arguments that returns a Column over the columns ``ectr``,
``private_value``, ``wp_prediction``, ``bid_id`` and those of the campaign table.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from bidlens.functions.pricing import expected_kpi, round_bid, unit_hash
from bidlens.operators.ort import MAX_BID, ort


def constant(level: Column) -> Column:
    return level


def true_value() -> Column:
    return F.col("private_value")


def threshold(kpi: str, limit: float) -> Column:
    """The value where an expected KPI reaches the limit, else no bid."""
    reached = expected_kpi(kpi, F.col("private_value"), F.col("wp_prediction")) >= limit
    return F.when(reached, F.col("private_value")).otherwise(F.lit(0.0))


def linear(baseline: Column, landscape_ctr: Column) -> Column:
    return F.try_divide(baseline * F.col("ectr"), landscape_ctr)


def uniform(low: Column, high: Column, seed: int) -> Column:
    """Uniform between two bounds, which may differ by row; drawn from the bid id."""
    return low + (high - low) * unit_hash(F.col("bid_id"), seed)


def shaded(shading: Column) -> Column:
    return F.col("private_value") / (shading + 1.0)


def optimal(lam: Column, loc: Column, scl: Column, remaining: Column) -> Column:
    cap = F.least(F.lit(MAX_BID), remaining.cast("double"))
    return ort(F.col("ectr"), lam, loc, scl, cap)


# Strategies by name, over the campaign columns bid_level, baseline, shading and lambda and the
# landscape columns ctr, location and scale.
STRATEGIES: dict[str, Callable[[], Column]] = {
    "OriginalBidding": lambda: constant(F.lit(1000.0)),
    "ConstantAvgValue": lambda: constant(F.col("bid_level")),
    "TrueValue": true_value,
    "ThresholdSurplus": lambda: threshold("Surplus", 0.0),
    "RandomInRange": lambda: uniform(F.lit(0.0), F.lit(MAX_BID), 42),
    "RandomUpToTrueValue": lambda: uniform(F.lit(0.0), F.col("private_value"), 42),
    "LinearBidder": lambda: linear(F.col("baseline"), F.col("ctr")),
    "LinearWithPacingPastCPM": lambda: linear(F.col("baseline"), F.col("ctr")),
    "ShadedValueBidder": lambda: shaded(F.col("shading")),
    "ORTB": lambda: optimal(F.col("lambda"), F.col("location"), F.col("scale"), F.col("remaining")),
}


# Strategies whose bid is computed in Arrow batches.
ARROW_STRATEGIES = {"ORTB"}


def bid_of(name: str, strategies: Mapping[str, Callable[[], Column]] = STRATEGIES) -> Column:
    """Rounded bid of a named strategy; an unknown name is an error."""
    if name not in strategies:
        raise ValueError(f"{name} is not a valid bidder")
    return round_bid(strategies[name]())


def bid_by_strategy(names: list[str], strategies: Mapping[str, Callable[[], Column]] = STRATEGIES) -> Column:
    """Rounded bid where the column ``strategy`` names one of ``names``."""
    bids = F
    for name in names:
        bids = bids.when(F.col("strategy") == name, bid_of(name, strategies))
    unknown = F.raise_error(F.concat(F.col("strategy"), F.lit(" is not a valid bidder"))).cast("double")
    return bids.otherwise(unknown)
