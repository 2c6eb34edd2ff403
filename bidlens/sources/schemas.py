"""Read schemas of the auction files."""

from __future__ import annotations

from pyspark.sql import types as T

# The 16 positional columns of a replay input file.
REQUEST_TEXT = ["Bid_id", "Timestamp", "Advertiser"]
REQUEST_COLUMNS = [
    "Bid_id",
    "Timestamp",
    "Impression",
    "Click",
    "Conversion",
    "Advertiser",
    "AdSlotFloorPrice",
    "prediction",
    "GBRT_prediction_International_eCommerce",
    "GBRT_prediction_Oil",
    "GBRT_prediction_Software",
    "GBRT_prediction_Tire",
    "GBRT_prediction_Chinese_vertical_eCommerce",
    "BidPrice",
    "PayingPrice",
    "WpPrediction",
]

REQUEST = T.StructType(
    [
        T.StructField(name, T.StringType() if name in REQUEST_TEXT else T.DoubleType())
        for name in REQUEST_COLUMNS
    ]
)

# Price thresholds of the hourly landscape.
THRESHOLDS = [250, 200, 150, 125, 100, 75, 50, 25]

LANDSCAPE = T.StructType(
    [
        T.StructField("Advertiser", T.StringType()),
        T.StructField("Weekday", T.StringType()),
        T.StructField("Hour", T.IntegerType()),
        T.StructField("Impressions", T.LongType()),
    ]
    + [
        T.StructField(name, T.DoubleType())
        for name in ["Clicks", "Spending", "muPrice", "sigmaPrice", "varPrice", "maxPrice", "minPrice"]
        + [f"shareLess{t}" for t in THRESHOLDS]
        + ["ImpsPerHour", "CTR", "CPC", "CPM"]
    ]
)

DICTIONARY = T.StructType(
    [T.StructField("code", T.IntegerType()), T.StructField("name", T.StringType())]
)
