"""Cleaning of raw logs: names, types, code dictionaries, filters and samples."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidlens.functions.pricing import unit_hash
from bidlens.functions.timeparts import parse_ts

# User tags with a flag column each.
USER_TAGS = [
    "10006", "10024", "10031", "10048", "10052", "10057", "10059", "10063", "10067",
    "10074", "10075", "10076", "10077", "10079", "10083", "10093", "10102", "10110",
    "10111", "10684", "11092", "11278", "11379", "11423", "11512", "11576", "11632",
    "11680", "11724", "11944", "13042", "13403", "13496", "13678", "13776", "13800",
    "13866", "13874", "14273", "16593", "16617", "16661", "16706",
]
TAG_COLUMNS = [f"UT_{tag}" for tag in USER_TAGS]

# Advertisers with a click prediction column each.
ADVERTISERS = [
    "Oil",
    "Software",
    "Tire",
    "Chinese vertical e-commerce",
    "International e-commerce",
]
PREDICTION_COLUMNS = [f"GBRT_prediction_{a}" for a in ADVERTISERS]

# Columns of the training log by type; all others stay strings.
INT_COLUMNS = ["Hour", "Month", "Year", "City_Pop", "AdSlotW", "AdSlotH", "AdSlotSize"]
DOUBLE_COLUMNS = (
    ["Impression", "Click", "Conversion", "City_Lat", "City_Long", "AdSlotFloorPrice"]
    + TAG_COLUMNS
    + ["prediction"]
    + PREDICTION_COLUMNS
    + ["BidPrice", "PayingPrice"]
)
TRAINING_TYPES = {c: "int" for c in INT_COLUMNS} | {c: "double" for c in DOUBLE_COLUMNS}

# Raw columns that no later step uses.
UNUSED_COLUMNS = [
    "_c0",
    "index",
    "u_id",
    "UA",
    "AdS",
    "CreativeID",
    "f_timestamp",
    "UserTags",
    "is_cl",
    "is_cv",
    "f_time_diff",
    "AdSlotID",
    "AdvertiserID",
]

# Code dictionaries of the ad slot.
AD_EXCHANGES = {1: "DoubleClick", 2: "TANX", 3: "Baidu", 4: "Youku", 5: "Tencent"}
SLOT_FORMATS = {0: "Fixed", 1: "Pop", 2: "Background", 5: "Float"}
SLOT_VISIBILITIES = {
    0: "NA",
    1: "First View",
    2: "Second View",
    3: "Third View",
    4: "Fourth View",
    5: "Fifth View",
    6: "Sixth View",
    255: "Other View",
}


def rename_tags(df: DataFrame) -> DataFrame:
    """Tag columns are named by number; prefix them so that they are plain identifiers."""
    return df.withColumnsRenamed({c: f"UT_{c}" for c in df.columns if c.startswith("1")})


def drop_columns(df: DataFrame, names: list[str]) -> DataFrame:
    return df.drop(*names)


def cast_schema(df: DataFrame, types: Mapping[str, str] = TRAINING_TYPES) -> DataFrame:
    """Cast the named columns in one projection. Text that is no number becomes null, and a
    ``boolean`` column becomes 0 or 1 as a double."""

    def typed(name: str) -> Column:
        c = F.col(f"`{name}`")
        kind = types.get(name)
        if kind is None:
            return c
        if kind == "boolean":
            return c.try_cast("boolean").cast("double").alias(name)
        if kind == "int":
            # By way of double, so that "3.0" counts as 3.
            return c.try_cast("double").try_cast("int").alias(name)
        return c.try_cast(kind).alias(name)

    return df.select([typed(c) for c in df.columns])


def whole_number(code: Column) -> Column:
    """A code read as text, ``3`` or ``3.0``; a fraction and other text are null."""
    value = code.try_cast("double")
    return F.when(value == F.floor(value), value).try_cast("int")


def map_codes(code: Column, names: Mapping[int, str]) -> Column:
    """Name of a code from a fixed list; null and text that is no number stay null, a number not in the
    list is an error."""
    listed = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    key = whole_number(code)
    unknown = F.raise_error(F.concat(F.lit("unknown code: "), key.cast("string")))
    return F.when(key.isNotNull(), F.coalesce(F.try_element_at(listed, key), unknown))


def map_dictionary(df: DataFrame, column: str, dictionary: DataFrame) -> DataFrame:
    """Replace a code column by its dictionary name; unlisted, null, ``unknown`` and text that is no
    number give ``NA``. A code listed twice has the last of its known names by alphabet, as a file has no order of
    lines that survives a parallel read; no row is doubled.

    No hint: the dictionary is read from a file, so the planner knows its size and broadcasts
    it below the session's threshold.
    """
    known = F.nullif(F.col("name"), F.lit("unknown"))
    names = dictionary.groupBy(F.col("code").alias("_code")).agg(F.max(known).alias("_name"))
    joined = df.join(names, whole_number(F.col(f"`{column}`")) == F.col("_code"), "left")
    name = F.coalesce(F.col("_name"), F.lit("NA"))
    return joined.withColumn(column, name).drop("_code", "_name")


def map_slot_columns(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "AdEx": map_codes(F.col("AdEx"), AD_EXCHANGES),
            "AdSlotFormat": map_codes(F.col("AdSlotFormat"), SLOT_FORMATS),
            "AdSlotVis": map_codes(F.col("AdSlotVis"), SLOT_VISIBILITIES),
        }
    )


def prep_all(df: DataFrame, cities: DataFrame, regions: DataFrame) -> DataFrame:
    """Raw log to training log: tag names, types, code names, unused columns dropped."""
    df = cast_schema(drop_columns(rename_tags(df), UNUSED_COLUMNS))
    df = map_dictionary(df, "City", cities)
    df = map_dictionary(df, "Region", regions)
    return map_slot_columns(df)


def impressions(df: DataFrame) -> DataFrame:
    return df.filter(F.col("Impression") == 1.0)


def sample_log(df: DataFrame, fraction: float, seed: int, key: str | None = None) -> DataFrame:
    """Bernoulli sample without replacement. With a key column the choice depends only on the
    key, so it is the same for any partitioning and after a lost task."""
    if key is None:
        return df.sample(False, fraction, seed)
    return df.filter(unit_hash(F.col(key), seed) < fraction)


def split_log(df: DataFrame, weights: list[float], seed: int, key: str) -> list[DataFrame]:
    """Random split by a hash of the key into parts of the given relative sizes."""
    total = float(sum(weights))
    draw = unit_hash(F.col(key), seed)
    parts, low = [], 0.0
    for i, weight in enumerate(weights):
        high = 1.0 if i == len(weights) - 1 else low + weight / total
        parts.append(df.filter((draw >= low) & (draw < high)))
        low = high
    return parts


def prediction_of(advertiser: Column) -> Column:
    """Click prediction made for the advertiser; an advertiser without one is an error."""
    # Advertiser names and the request columns that hold their predictions.
    columns = {
        "Oil": "GBRT_prediction_Oil",
        "Software": "GBRT_prediction_Software",
        "Tire": "GBRT_prediction_Tire",
        "Chinese vertical e-commerce": "GBRT_prediction_Chinese_vertical_eCommerce",
        "International e-commerce": "GBRT_prediction_International_eCommerce",
    }
    picked = F
    for name, column in columns.items():
        picked = picked.when(advertiser == name, F.col(column))
    return picked.otherwise(
        F.raise_error(F.concat(F.lit("no such advertiser: "), F.coalesce(advertiser, F.lit("null")))).cast("double")
    )


def to_bid_requests(raw: DataFrame) -> DataFrame:
    """Replay input rows in the form a campaign sees them."""
    return raw.select(
        F.col("Bid_id").alias("bid_id"),
        parse_ts(F.col("Timestamp")).alias("ts"),
        F.col("Advertiser").alias("advertiser"),
        (F.col("Click") > 0).alias("is_click"),
        (F.col("Conversion") > 0).alias("is_conversion"),
        F.col("AdSlotFloorPrice").alias("floor_price"),
        F.col("PayingPrice").alias("winning_price"),
        prediction_of(F.col("Advertiser")).alias("ctr_prediction"),
        F.col("WpPrediction").alias("wp_prediction"),
    )


def store_bucketed(df: DataFrame, key: str, table: str, path: str, buckets: int) -> DataFrame:
    """``df`` as a table of ``buckets`` buckets of its key, each sorted by it; two such tables join without an exchange."""
    spark = df.sparkSession
    df.write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
    return spark.table(table)


def join_prices(df: DataFrame, extra: DataFrame) -> DataFrame:
    """Attach bid and paying price from a side table by bid id.

    Both sides may be large, so there is no hint: AQE picks the strategy and splits a hot id.
    """
    prices = extra.select(F.col("b_id").alias("Bid_id"), "BidPrice", "PayingPrice")
    return df.join(prices, "Bid_id")
