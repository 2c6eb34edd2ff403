"""Campaign counters and key figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidlens.functions.pricing import TOTAL

# Additive counters of a set of requests of one lane while the budget lasts.
COUNTERS = {
    "requests": lambda: F.count("*"),
    "impressions": lambda: F.count_if(F.col("won")),
    "lost": lambda: F.count_if(F.col("bids") & ~F.col("won")),
    "passed": lambda: F.count_if(F.col("open") & ~F.col("bids")),
    "missed": lambda: F.count_if(~F.col("open")),
    "clicks": lambda: F.count_if(F.col("click")),
    "conversions": lambda: F.count_if(F.col("conversion")),
    "e_clicks": lambda: F.sum(F.when(F.col("won"), F.col("ectr")).otherwise(F.lit(0.0))),
    "a_priori_value": lambda: F.sum(F.when(F.col("won"), F.col("private_value")).otherwise(F.lit(0.0))),
    "spend": lambda: F.sum("pay"),
}

COUNTER_TYPES = {name: "bigint" for name in COUNTERS} | {
    "e_clicks": "double",
    "a_priori_value": "double",
    "spend": TOTAL,
}


def count_requests(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(*[f().alias(name) for name, f in COUNTERS.items()])


def campaign_kpis(counted: DataFrame, parameters: Sequence[str] = ()) -> DataFrame:
    """Key figures of campaigns from their counters, ``budget``, ``click_value`` and
    ``actual_end_ts``, after the ``parameters`` that tell runs apart. Ratios without a base are NULL."""

    def ratio(a: Column, b: Column) -> Column:
        return F.try_divide(a, b)

    c = F.col
    wins, clicks, bids = c("impressions"), c("clicks"), c("impressions") + c("lost")
    spent = c("spend").cast("double")
    value = clicks * c("click_value")
    return counted.select(
        *parameters,
        c("budget_factor").alias("budgetFactor"),
        "advertiser",
        "strategy",
        c("start_ts").alias("start"),
        c("end_ts").alias("scheduledEnd"),
        c("actual_end_ts").alias("end"),
        "requests",
        "impressions",
        "lost",
        "passed",
        "missed",
        "clicks",
        "conversions",
        c("budget").cast("double").alias("budget"),
        spent.alias("spent"),
        (c("budget") - c("spend")).cast("double").alias("remaining"),
        ratio(bids, c("requests") - c("missed")).alias("bidRateSeen"),
        ratio(bids, c("requests")).alias("bidRateTotal"),
        ratio(wins, bids).alias("winRate"),
        ratio(clicks, wins).alias("ctr"),
        ratio(c("conversions"), clicks).alias("cvr"),
        ratio(spent, wins).alias("cpi"),
        ratio(spent, clicks * 1000).alias("cpc"),
        value.alias("actualValue"),
        (value - spent).alias("actualSurplus"),
        ratio(value - spent, spent).alias("actualROI"),
        c("e_clicks").alias("eClicks"),
        ratio(c("e_clicks"), wins).alias("eCTR"),
        c("a_priori_value").alias("aPrioriValue"),
        (c("a_priori_value") - spent).alias("aPrioriSurplus"),
        ratio(c("a_priori_value") - spent, spent).alias("aPrioriROI"),
    )


def kpi_lines(kpis: DataFrame, sysdate: str, dataset: str) -> DataFrame:
    """KPI rows of a run with the three columns that tell runs apart in a common table."""
    return kpis.select(
        F.lit(sysdate).alias("sysdate"),
        F.lit(dataset).alias("dataset"),
        F.col("strategy").alias("biddertype"),
        "*",
    )


# Layout of the readable report, as label, column and number format.
REPORT = [
    ("Advertiser: %s", "advertiser"),
    ("Start Time: %s", "start"),
    ("Scheduled End Time: %s", "scheduledEnd"),
    ("Actual End Time: %s\n", "end"),
    ("Total Requests: %d", "requests"),
    ("Impressions Won: %d", "impressions"),
    ("Impressions Lost: %d", "lost"),
    ("Requests passed on: %d", "passed"),
    ("Requests Missed: %d", "missed"),
    ("Clicks: %d", "clicks"),
    ("Conversions: %d\n", "conversions"),
    ("a priori exp. clicks: %.2f", "eClicks"),
    ("a priori eCTR: %.5f\n", "eCTR"),
    ("Original Budget: %.0f", "budget"),
    ("Budget Spent: %.1f", "spent"),
    ("Remaining budget: %.1f\n", "remaining"),
    ("--- Metrics: ---\n", None),
    ("BidRate (Seen): %.3f", "bidRateSeen"),
    ("BidRate (Total): %.3f", "bidRateTotal"),
    ("winRate: %.3f\n", "winRate"),
    ("CTR: %.5f", "ctr"),
    ("CVR: %.5f", "cvr"),
    ("CPM: %.2f", "cpi"),
    ("CPC: %.2f\n", "cpc"),
    ("a priori value: %.1f", "aPrioriValue"),
    ("actual value: %.1f", "actualValue"),
    ("a priori Surplus: %.1f", "aPrioriSurplus"),
    ("actual Surplus: %.1f", "actualSurplus"),
    ("a priori ROI: %.3f", "aPrioriROI"),
    ("Actual ROI: %.3f\n", "actualROI"),
]


def kpi_text(kpis: DataFrame) -> DataFrame:
    """Readable report of every campaign as one text column; a missing ratio prints as NaN. Campaigns are named by
    ``campaign_id`` if the key figures have it among their parameters."""
    types = dict(kpis.dtypes)

    def shown(column: str) -> Column:
        if types[column] == "double":
            return F.coalesce(F.col(column), F.lit(float("nan")))
        return F.col(column) if types[column] == "bigint" else F.col(column).cast("string")

    # The id names all that tells campaigns apart, the level of a parameter included.
    named = F.concat_ws("_", "advertiser", F.col("budgetFactor").cast("string"), "strategy")
    campaign = F.col("campaign_id") if "campaign_id" in types else named
    layout = "Campaign Status\n%s\n\nBidder: %s\n\n" + "\n".join(label for label, _ in REPORT)
    columns = [shown(column) for _, column in REPORT if column]
    return kpis.select(
        campaign.alias("campaign"),
        F.format_string(layout, campaign, F.col("strategy"), *columns).alias("report"),
    )
