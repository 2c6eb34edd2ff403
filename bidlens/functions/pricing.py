"""Value, price and rounding expressions of a bid request."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Money that is cumulated is kept exact, so sums do not depend on the order of the rows.
MONEY, TOTAL = "decimal(18,6)", "decimal(28,6)"


def share_le(price: Column, limit: float) -> Column:
    return (price <= F.lit(float(limit))).cast("double")


def ectr(prediction: Column, factor: Column) -> Column:
    """Calibrated click probability in [0, 1]."""
    return F.when(prediction > 0, F.least(prediction / factor, F.lit(1.0))).otherwise(F.lit(0.0))


def private_value(click_probability: Column, click_value: Column) -> Column:
    return click_probability * click_value


def expected_kpi(name: str, value: Column, predicted_price: Column) -> Column:
    """Expected ``Surplus`` or ``ROI`` of a request; NULL where the ratio is undefined."""
    surplus = value - predicted_price
    if name == "Surplus":
        return surplus
    if name == "ROI":
        return F.try_divide(surplus, predicted_price) - 1.0
    raise ValueError(f"no such KPI: {name}")


def round_bid(bid: Column) -> Column:
    """Bids have two decimals, half up; an undefined bid is no bid."""
    return F.coalesce(F.round(bid, 2), F.lit(0.0))


def money(c: Column) -> Column:
    return c.cast(MONEY)


def unit_hash(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends only on the key, so a recomputed task draws it again."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(2**48))


def bucket(name: str, value: Column, n: int) -> Column:
    """Bucket in [0, n) of a column's name joined with its value."""
    digest = F.md5(F.concat(F.lit(name), F.coalesce(value.cast("string"), F.lit("NA"))))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(n)).cast("int")
