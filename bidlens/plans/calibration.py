"""Tuning of strategies against the spend expected in the hours left.

The functions work on arrays with one entry per campaign, so all campaigns are tuned at once;
``calibrate_*`` apply them to tables of campaigns in Arrow batches. Rows need ``budget``,
``spend``, ``impressions``, ``clicks``, ``click_value`` and the hours left as the arrays
``rates``, ``locations`` and ``scales``.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidlens.functions.normal import cdf_array
from bidlens.functions.timeparts import hour_spine
from bidlens.operators.landscape import DEFAULT_CTR, lognormal, with_landscape
from bidlens.operators.ort import MAX_BID, ort_array

# The functions below travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Search ranges and numbers of steps, tolerances of spend for budgets of tens of
# millions, and the part of the mean click value that stands for the average bid.
LINEAR_RANGE, SHADING_RANGE, LAMBDA_RANGE = (0.0, MAX_BID), (0.0, 10.0), (1e-10, 1e-3)
SPEND_STEPS, LAMBDA_STEPS = 20, 21
LINEAR_TOLERANCE, SHADING_TOLERANCE, LAMBDA_TOLERANCE = 1e3, 1e2, 1e2
AVERAGE_BID_SHARE = 0.3


def with_future(df: DataFrame, landscape: DataFrame, now: str, end: str, keys: list[str]) -> DataFrame:
    """Add the cells of the hours from ``now`` to ``end``, in order. The length of the arrays is
    the number of hours a campaign has left: none for a campaign past its end, which stays."""
    columns = dict.fromkeys([*keys, "advertiser", now, end])
    hours = lognormal(with_landscape(hour_spine(df.select(*columns), now, end), landscape))
    cell = F.struct("step_ts", "rate", "location", "scale")
    cells = hours.groupBy(*keys).agg(F.sort_array(F.collect_list(cell)).alias("cells"))
    none = F.array().cast("array<double>")
    arrays = {f"{name}s": F.coalesce(F.col(f"cells.{name}"), none) for name in ("rate", "location", "scale")}
    return df.join(cells, keys, "left").withColumns(arrays).drop("cells")


def win_probability_array(bid: np.ndarray, loc: np.ndarray, scl: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        log_bid = np.log(np.maximum(bid, 1e-300))
        spread = cdf_array(np.where(scl > 0, (log_bid - loc) / scl, 0.0))
    return np.where(bid <= 0, 0.0, np.where(scl > 0, spread, (log_bid >= loc).astype(float)))


def padded(rows: pd.Series) -> np.ndarray:
    """Arrays of different lengths as a matrix; missing hours are zero."""
    width = max((len(r) for r in rows), default=0)
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def spend_function(c: pd.DataFrame) -> Callable[[np.ndarray], np.ndarray]:
    """Spend a bid level is expected to cause over the hours left, at the own price per win."""
    rates, locs, scls = padded(c["rates"]), padded(c["locations"]), padded(c["scales"])
    cost = numbers(c, "spend") / np.maximum(numbers(c, "impressions"), 1)
    return lambda level: (rates * win_probability_array(level[:, None], locs, scls)).sum(axis=1) * cost


def numbers(c: pd.DataFrame, name: str) -> np.ndarray:
    return c[name].astype(float).to_numpy()


def bisect(
    start: np.ndarray,
    limits: tuple[float, float],
    spend: Callable[[np.ndarray], np.ndarray],
    target: np.ndarray,
    rises: bool,
    steps: int,
    tolerance: float,
) -> np.ndarray:
    """Halve the range of a parameter until the spend is within the tolerance of the target.

    ``rises`` tells whether spend grows with the parameter. At least one step is made.
    """
    x, low, high = start, np.full(len(start), limits[0]), np.full(len(start), limits[1])
    short = spend(x) - target
    more = np.ones(len(start), bool)
    for _ in range(steps):
        up = (short < 0) == rises
        low, high = np.where(more & up, x, low), np.where(more & ~up, x, high)
        x = np.where(more, (low + high) / 2, x)
        short = np.where(more, spend(x) - target, short)
        more &= np.abs(short) > tolerance
        if not more.any():
            break
    return x


def money_left(c: pd.DataFrame) -> np.ndarray:
    return numbers(c, "budget") - numbers(c, "spend")


def usual_ctr(c: pd.DataFrame) -> np.ndarray:
    rate = numbers(c, "clicks") / np.maximum(numbers(c, "impressions"), 1)
    return np.where(rate > 0, rate, DEFAULT_CTR)


def after_wins(c: pd.DataFrame, tuned: np.ndarray, blind: np.ndarray, now: np.ndarray, compat: bool) -> np.ndarray:
    """A campaign without a win has no price per win. It keeps its parameter, or, with
    ``compat_nan_tune``, makes the one step that an undefined spend leads to. A campaign without
    hours left keeps its parameter."""
    changed = np.where(numbers(c, "impressions") > 0, tuned, blind if compat else now)
    return np.where([len(r) > 0 for r in c["rates"]], changed, now)


def tuned_baseline(c: pd.DataFrame, tolerance: float = LINEAR_TOLERANCE, compat_nan_tune: bool = False) -> np.ndarray:
    now = numbers(c, "baseline")
    tuned = bisect(now, LINEAR_RANGE, spend_function(c), money_left(c), True, SPEND_STEPS, tolerance)
    return after_wins(c, tuned, now / 2, now, compat_nan_tune)


def tuned_shading(c: pd.DataFrame, tolerance: float = SHADING_TOLERANCE, compat_nan_tune: bool = False) -> np.ndarray:
    now, spend = numbers(c, "shading"), spend_function(c)
    mean_bid = numbers(c, "click_value") * AVERAGE_BID_SHARE * usual_ctr(c)
    tuned = bisect(
        now, SHADING_RANGE, lambda x: spend(mean_bid / (x + 1)), money_left(c), False, SPEND_STEPS, tolerance
    )
    return after_wins(c, tuned, (now + SHADING_RANGE[1]) / 2, now, compat_nan_tune)


def lambda_past_cpc(c: pd.DataFrame) -> np.ndarray:
    """Clicks per money spent so far."""
    clicks, spent = numbers(c, "clicks"), numbers(c, "spend")
    return np.where((clicks > 0) & (spent > 0), clicks / np.where(spent > 0, spent, 1), numbers(c, "lambda"))


def lambda_dual(c: pd.DataFrame, tolerance: float = LAMBDA_TOLERANCE, compat_nan_tune: bool = False) -> np.ndarray:
    """Lambda at which the bid for the usual click rate spends the budget evenly by hour. Needs
    ``won_mu`` and ``won_sigma``, the moments of the prices won so far."""
    now, spend = numbers(c, "lambda"), spend_function(c)
    hours = np.maximum([len(r) for r in c["rates"]], 1).astype(float)
    wins, won_sigma = numbers(c, "impressions"), np.nan_to_num(numbers(c, "won_sigma"))
    sigma = np.where((wins < 2) | (won_sigma == 0), 1.0, won_sigma)
    mu = np.where(wins > 0, numbers(c, "won_mu"), 1.0)
    spread = 1 + (sigma / mu) ** 2
    loc, scl = np.log(mu / np.sqrt(spread)), np.sqrt(np.log(spread))
    cap, ctr = np.minimum(MAX_BID, money_left(c)), usual_ctr(c)
    tuned = bisect(
        now,
        LAMBDA_RANGE,
        lambda lam: spend(ort_array(ctr, lam, loc, scl, cap)) / hours,
        money_left(c) / hours,
        False,
        LAMBDA_STEPS,
        tolerance,
    )
    return after_wins(c, tuned, (now + LAMBDA_RANGE[1]) / 2, now, compat_nan_tune)


def tuned_lambda(c: pd.DataFrame, mode: str, **options) -> np.ndarray:
    """Modes: ``static`` (lambda stays), ``past_cpc`` and ``dual``."""
    if mode == "static":
        return numbers(c, "lambda")
    if mode == "past_cpc":
        return lambda_past_cpc(c)
    if mode == "dual":
        return lambda_dual(c, **options)
    raise ValueError(f"no such mode: {mode}")


def calibrated(campaigns: DataFrame, parameter: str, tune: Callable[[pd.DataFrame], np.ndarray]) -> DataFrame:
    """Replace a parameter of every campaign; campaigns are independent of each other."""

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                yield part.assign(**{parameter: tune(part)})

    return campaigns.mapInPandas(batches, campaigns.schema)


def calibrate_linear(campaigns: DataFrame, **options) -> DataFrame:
    return calibrated(campaigns, "baseline", lambda c: tuned_baseline(c, **options))


def calibrate_shading(campaigns: DataFrame, **options) -> DataFrame:
    return calibrated(campaigns, "shading", lambda c: tuned_shading(c, **options))


def calibrate_ort(campaigns: DataFrame, mode: str, **options) -> DataFrame:
    return calibrated(campaigns, "lambda", lambda c: tuned_lambda(c, mode, **options))
