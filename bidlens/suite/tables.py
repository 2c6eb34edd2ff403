"""Auction tables derived from the driver's tables, as DataFrames over a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidlens.functions.pricing import MONEY
from bidlens.functions.timeparts import format_ts, weekday_name
from bidlens.operators.landscape import hourly_landscape
from bidlens.operators.prep import ADVERTISERS, PREDICTION_COLUMNS, USER_TAGS
from bidlens.plans.replay import advertiser_table, campaign_table, iso
from bidlens.session import materialize
from bidlens.sources.logs import landscape_cells

# End of the training part, and the schedule of the campaigns.
TRAIN_END = "2024-01-22 00:00:00"
START = "2024-01-22 00:00:00.001"
END = "2024-01-24 23:59:59.999"
END_SOFTWARE = "2024-01-24 13:59:59.999"
# Click value, usual click rate and calibration factors, in advertiser order.
CLICK_VALUE, BASE_CTR = 100.0, 0.5
ECTR_FACTORS = [0.8, 0.9, 1.0, 1.1, 1.2]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def advertiser_of(user_id):
    return F.elt((user_id % 5 + 1).cast("int"), *[F.lit(a) for a in ADVERTISERS])


def bid_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table read as an auction log."""
    return log_view(table(spark, sf_dir, "events"))


def log_view(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    return events.select(
        F.col("event_id").alias("bid_id"),
        "ts",
        advertiser_of(F.col("user_id")).alias("advertiser"),
        (kind != "error").cast("int").alias("impression"),
        kind.isin("click", "purchase").cast("int").alias("click"),
        (kind == "purchase").cast("int").alias("conversion"),
        (F.col("user_id") % 100).cast("double").alias("floor_price"),
        F.col("value").alias("paying_price"),
        (k / F.lit(100.0)).alias("prediction"),
        (F.lit(25.0) + k / F.lit(2.0)).alias("wp_prediction"),
        "user_id",
    )


def raw_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with the 16 columns of a replay input file."""
    p = F.col("prediction")
    # Prediction columns with the share added to the base prediction.
    factors = {"Oil": 0.0, "Software": 0.1, "Tire": 0.2, "Chinese_vertical_eCommerce": 0.3}
    own = {name: (p * (1 + share)).alias(f"GBRT_prediction_{name}") for name, share in factors.items()}
    return bid_log(spark, sf_dir).select(
        F.col("bid_id").cast("string").alias("Bid_id"),
        format_ts(F.col("ts")).alias("Timestamp"),
        F.col("impression").cast("double").alias("Impression"),
        F.col("click").cast("double").alias("Click"),
        F.col("conversion").cast("double").alias("Conversion"),
        F.col("advertiser").alias("Advertiser"),
        F.col("floor_price").alias("AdSlotFloorPrice"),
        p.alias("prediction"),
        (p * (1 + 0.4)).alias("GBRT_prediction_International_eCommerce"),
        own["Oil"],
        own["Software"],
        own["Tire"],
        own["Chinese_vertical_eCommerce"],
        (F.col("paying_price") * 1.2).alias("BidPrice"),
        F.col("paying_price").alias("PayingPrice"),
        F.col("wp_prediction").alias("WpPrediction"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole log as bid requests with one click prediction each."""
    return request_view(bid_log(spark, sf_dir))


def request_view(log: DataFrame) -> DataFrame:
    return log.select(
        "bid_id",
        "ts",
        "advertiser",
        (F.col("click") > 0).alias("is_click"),
        (F.col("conversion") > 0).alias("is_conversion"),
        "floor_price",
        F.col("paying_price").alias("winning_price"),
        F.col("prediction").alias("ctr_prediction"),
        "wp_prediction",
    )


def advertisers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advertiser settings; the full budget is what the log paid during the campaign days."""
    settings = [
        (a, None, CLICK_VALUE, BASE_CTR, f, iso(START), iso(END_SOFTWARE if a == "Software" else END))
        for a, f in zip(ADVERTISERS, ECTR_FACTORS)
    ]
    paid = (
        bid_log(spark, sf_dir)
        .filter(F.col("ts") >= F.lit(TRAIN_END).cast("timestamp_ntz"))
        .filter(F.col("ts") < F.lit("2024-01-25 00:00:00").cast("timestamp_ntz"))
        .groupBy("advertiser")
        .agg(F.sum(F.col("paying_price").cast(MONEY)).cast("double").alias("full_budget"))
    )
    given = advertiser_table(spark, settings).drop("full_budget")
    return materialize(paid.join(F.broadcast(given), "advertiser").select(
        "advertiser", "full_budget", "click_value", "base_ctr", "ectr_factor", "start_ts", "end_ts"
    ))


def campaigns(spark: SparkSession, sf_dir: str, strategies: list[str], **options) -> DataFrame:
    return materialize(campaign_table(advertisers(spark, sf_dir), strategies, **options))


def impression_log(log: DataFrame) -> DataFrame:
    """Columns of the hourly landscape."""
    return log.select(
        F.col("advertiser").alias("Advertiser"),
        F.initcap(weekday_name(F.col("ts"))).alias("Weekday"),
        F.hour("ts").alias("Hour"),
        F.col("impression").cast("double").alias("Impression"),
        F.col("click").cast("double").alias("Click"),
        F.col("paying_price").alias("PayingPrice"),
    )


def training_part(log: DataFrame) -> DataFrame:
    return log.filter(F.col("ts") < F.lit(TRAIN_END).cast("timestamp_ntz"))


def landscape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookup cells from the training part, stored once."""
    part = training_part(bid_log(spark, sf_dir))
    return materialize(landscape_cells(hourly_landscape(impression_log(part))))


# Categories of the training log that may hold unseen values, by modulus.
AGENT_COLUMNS = {
    "UA_os_ver": 7,
    "UA_br_fam": 6,
    "UA_br_ver": 9,
    "UA_dev_fam": 4,
    "UA_dev_brand": 5,
    "UA_dev_mod": 11,
}


def coded_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with codes for city, region and ad slot, user agent columns and numeric features."""
    people = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"), "c_nationkey", "c_acctbal", "c_mktsegment"
    )
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    log = bid_log(spark, sf_dir).withColumn("k", F.round(F.col("prediction") * 100).cast("int"))
    log = log.join(people, "user_id", "left").join(nations, "c_nationkey", "left")
    u = F.col("user_id")
    formats, views = F.array(*map(F.lit, [0, 1, 2, 5])), F.array(*map(F.lit, [0, 1, 2, 3, 4, 5, 6, 255]))
    return log.select(
        F.col("bid_id").cast("string").alias("Bid_id"),
        format_ts(F.col("ts")).alias("Timestamp"),
        "ts",
        F.col("advertiser").alias("Advertiser"),
        F.initcap(weekday_name(F.col("ts"))).alias("Weekday"),
        F.hour("ts").alias("Hour"),
        F.month("ts").alias("Month"),
        F.year("ts").alias("Year"),
        F.col("impression").cast("double").alias("Impression"),
        F.col("click").cast("double").alias("Click"),
        F.col("conversion").cast("double").alias("Conversion"),
        F.col("c_nationkey").alias("City"),
        F.col("n_regionkey").alias("Region"),
        (u % 5 + 1).cast("int").alias("AdEx"),
        F.get(formats, (u % 4).cast("int")).alias("AdSlotFormat"),
        F.get(views, (u % 8).cast("int")).alias("AdSlotVis"),
        F.elt((u % 3 + 1).cast("int"), F.lit("desktop"), F.lit("mobile"), F.lit("tablet")).alias("UA_os_type"),
        F.col("c_mktsegment").alias("UA_os_fam"),
        *[F.concat(F.lit("v"), (u % m).cast("string")).alias(name) for name, m in AGENT_COLUMNS.items()],
        (u % 50).cast("int").alias("City_Pop"),
        F.col("c_acctbal").alias("City_Lat"),
        F.col("k").cast("double").alias("City_Long"),
        (u % 50).cast("int").alias("AdSlotW"),
        F.col("k").alias("AdSlotH"),
        (u % 50 * F.col("k")).cast("int").alias("AdSlotSize"),
        F.col("floor_price").alias("AdSlotFloorPrice"),
        F.concat(F.lit("/p/"), (F.col("bid_id") % 5000).cast("string")).alias("Site_URL"),
        F.concat(F.lit("d"), (u % 37).cast("string")).alias("Site_Dom"),
        *[((u + j) % 2).cast("double").alias(f"UT_{tag}") for j, tag in enumerate(USER_TAGS)],
        "prediction",
        *[(F.col("prediction") * (1 + 0.1 * i)).alias(c) for i, c in enumerate(PREDICTION_COLUMNS)],
        (F.col("paying_price") * 1.2).alias("BidPrice"),
        F.col("paying_price").alias("PayingPrice"),
        F.col("wp_prediction").alias("WpPrediction"),
    )


def raw_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coded log as it comes from text: all strings, tags named by number, extra columns."""
    coded = coded_log(spark, sf_dir).drop("ts", "WpPrediction")
    text = coded.select([F.col(f"`{c}`").cast("string").alias(c.removeprefix("UT_")) for c in coded.columns])
    return text.withColumns({"index": F.lit("0"), "u_id": F.lit("u"), "AdSlotID": F.lit("s")})


def dictionaries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """City and region names by code: one city has no entry, and one of each is unknown."""
    cities = table(spark, sf_dir, "nation").filter("n_nationkey <> 7").select(
        F.col("n_nationkey").alias("code"),
        F.when(F.col("n_nationkey") == 3, "unknown").otherwise(F.col("n_name")).alias("name"),
    )
    regions = table(spark, sf_dir, "region").select(
        F.col("r_regionkey").alias("code"),
        F.when(F.col("r_regionkey") == 2, "unknown").otherwise(F.col("r_name")).alias("name"),
    )
    return cities, regions


def price_side_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        bid_log(spark, sf_dir)
        .filter("impression = 1")
        .select(
            F.col("bid_id").alias("b_id"),
            (F.col("paying_price") * 1.2).alias("BidPrice"),
            F.col("paying_price").alias("PayingPrice"),
        )
    )


