"""Registered queries of the winning-price model, tuning and streams."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidlens.functions.pricing import MONEY
from bidlens.operators.features import (
    assemble_prefix,
    feature_pipeline,
    fill_categories,
    indexer,
    label_index,
    label_names,
    labels_of,
)
from bidlens.operators.landscape import merge_moments, won_sigma
from bidlens.operators.models import error_table, fit_price_model, model_report, optimality, score_requests
from bidlens.operators.prep import map_dictionary, map_slot_columns, split_log
from bidlens.operators.strategies import linear
from bidlens.plans.calibration import calibrate_linear, calibrate_ort, calibrate_shading, with_future
from bidlens.plans.replay import lanes, offers, with_lane, won_hours
from bidlens.session import broadcast_if_small, fresh_path, materialize, stored
from bidlens.sources.logs import read_requests
from bidlens.sources.sinks import write_log
from bidlens.streaming.streams import run_available, stream_auctions
from bidlens.streaming.windows import end_marks, stream_windows
from bidlens.suite import tables as t
from bidlens.suite.queries import offered, rounded

# --- label indices


def agent_log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The training part without one market segment, and the whole log."""
    log = t.coded_log(spark, sf_dir).select("Bid_id", "ts", F.col("UA_os_fam").alias("segment"), "UA_os_ver")
    return t.training_part(log).filter("segment <> 'MACHINERY'"), log.drop("ts")


def label_index_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, log = agent_log(spark, sf_dir)
    return label_index(log, "UA_os_ver", labels_of(log, "UA_os_ver")).select("Bid_id", "UA_os_ver", "index")


def label_index_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, log = agent_log(spark, sf_dir)
    return label_index(log, "segment", labels_of(train, "segment"), "keep").select("Bid_id", "segment", "index")


def label_index_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, log = agent_log(spark, sf_dir)
    return label_index(log, "segment", labels_of(train, "segment"), "skip").select("Bid_id", "segment", "index")


def index_to_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexer fitted, stored, loaded, applied and undone."""
    train, log = agent_log(spark, sf_dir)
    path = fresh_path(spark, "indexer")
    indexer(["segment"], "skip").fit(train).write().overwrite().save(path)
    from pyspark.ml.feature import StringIndexerModel

    model = StringIndexerModel.load(path)
    back = label_names("ID_segment", model.labelsArray[0], "name").transform(model.transform(log))
    return back.select("Bid_id", "segment", F.col("ID_segment").alias("index"), "name")


# --- winning-price model


def training_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = t.coded_log(spark, sf_dir).drop("WpPrediction")
    for column, dictionary in zip(["City", "Region"], t.dictionaries(spark, sf_dir)):
        log = map_dictionary(log, column, dictionary)
    return map_slot_columns(log)


def featured(spark: SparkSession, sf_dir: str) -> tuple[PipelineModel, DataFrame, DataFrame]:
    """Fitted features, and train and test parts of the impressions."""
    log = fill_categories(training_log(spark, sf_dir))
    paid = log.filter("Impression = 1.0")
    features = feature_pipeline().fit(paid)
    train, _, test, _ = split_log(paid, [0.7, 0.0, 0.3, 0.0], 42, "Bid_id")
    columns = ["Timestamp", "Bid_id", "PayingPrice", "features"]
    return features, *[features.transform(part).select(*columns) for part in (train, test)]


def winning_price_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and sums of all feature vectors, also assembled by prefix."""
    log = fill_categories(training_log(spark, sf_dir))
    model = feature_pipeline().fit(log)
    again = assemble_prefix(model.transform(log).drop("features"))
    vector = vector_to_array("features")
    return rounded(
        again.select(
            "Bid_id",
            F.size(vector).alias("size"),
            F.size(F.filter(vector, lambda x: x != 0)).alias("nonzero"),
            F.aggregate(vector, F.lit(0.0), lambda a, x: a + x).alias("total"),
        )
    )


def winning_price_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, train, test = featured(spark, sf_dir)
    return model_report(spark, fit_price_model(train), test)


def winning_price_optimality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the fitted elastic net fulfils the conditions of its optimum, for coefficients that are zero and others."""
    _, train, _ = featured(spark, sf_dir)
    train = train.select("features", "PayingPrice")
    conditions = optimality(fit_price_model(train), train)
    kind = F.when(F.col("index") < 0, "intercept").when(F.col("coefficient") == 0, "zero").otherwise("nonzero")
    holds = F.max("gap") <= OPTIMAL_WITHIN
    return conditions.groupBy(kind.alias("kind")).agg(holds.alias("holds")).withColumn("rows", F.lit(train.count()))


# Gaps of optimality allowed, in deviations of the price: what the solver's own tolerance leaves.
OPTIMAL_WITHIN = 5e-4


def price_errors(kind: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        _, train, test = featured(spark, sf_dir)
        if kind == "gbt":
            # Boosting reads its rows several times, and making their features takes longer than reading them.
            train = stored(train, "price-train")
        model = fit_price_model(train, kind)
        scored = [
            model.transform(part).withColumn("part", F.lit(name)) for name, part in (("train", train), ("test", test))
        ]
        return error_table(scored[0].unionByName(scored[1]), ["part"])

    return query


def score_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features and model stored and loaded, the whole log scored, written and read as requests.

    The price itself is the model's, so the query tells for every request whether it has a finite one.
    """
    features, train, _ = featured(spark, sf_dir)
    model = fit_price_model(train)
    at, path = fresh_path(spark, "features"), fresh_path(spark, "scored")
    features.write().overwrite().save(at)
    write_log(score_requests(PipelineModel.load(at), model, training_log(spark, sf_dir)), path, mode="overwrite")
    price = F.col("WpPrediction")
    scored = (price.isNotNull() & ~F.isnan(price) & (F.abs(price) < float("inf"))).alias("scored")
    back = read_requests(spark, path)
    return rounded(back.select(*[c for c in back.columns if c != "WpPrediction"], scored))


# --- tuning

def running_campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All campaigns of the true value bidder ten hours after their start, with their totals until
    then and the hours left."""
    now = F.col("start_ts") + F.expr("interval 10 hours")
    names = ["TrueValue"]
    rows, first = offered(spark, sf_dir, names)
    parts = won_hours(rows, first, now)
    totals = merge_moments(parts, ["campaign_id"]).select(
        "campaign_id",
        "spend",
        F.col("wins").alias("impressions"),
        "clicks",
        F.col("mu").alias("won_mu"),
        won_sigma().alias("won_sigma"),
    )
    camp = t.campaigns(spark, sf_dir, names, shading=0.5, lam=0.001)
    counted = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("spend", "impressions", "clicks")}
    rows = camp.join(totals, "campaign_id", "left").withColumns(counted | {"now": now})
    return with_future(materialize(rows), broadcast_if_small(t.landscape(spark, sf_dir)), "now", "end_ts", ["campaign_id"])


def calibrate_linear_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(calibrate_linear(running_campaigns(spark, sf_dir), tolerance=10.0).select("campaign_id", "baseline"))


def calibrate_shading_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(calibrate_shading(running_campaigns(spark, sf_dir), tolerance=1.0).select("campaign_id", "shading"))


def calibrate_ort_query(mode: str, **options):
    """Lambda, times a million for comparison at six decimals."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        tuned = calibrate_ort(running_campaigns(spark, sf_dir), mode, **options)
        return rounded(tuned.select("campaign_id", (F.col("lambda") * 1e6).alias(mode)))

    return query


def bid_pacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bids of the pacing bidder for what is left of each campaign, at the baseline tuned to its money and hours left.

    Two engines may round a bid that lies between two cents either way, so the bid before rounding is compared, and
    whether the one made is within half a cent of it.
    """
    tuned = calibrate_linear(running_campaigns(spark, sf_dir), tolerance=10.0)
    name = "LinearWithPacingPastCPM"
    going = tuned.withColumns({"strategy": F.lit(name), "start_ts": F.col("now"), "budget": (F.col("budget") - F.col("spend")).cast(MONEY)})
    going = materialize(going.drop("rates", "locations", "scales"))
    rows = offers(t.requests(spark, sf_dir), going, t.landscape(spark, sf_dir), [name]).filter("open")
    ids = broadcast_if_small(materialize(with_lane(going).select("campaign_id", "lane_id")))
    exact = F.coalesce(linear(F.col("baseline"), F.col("ctr")), F.lit(0.0))
    near = F.abs(F.col("bid") - exact) <= 0.005 + 1e-9
    return rounded(rows.join(ids, "lane_id").select("campaign_id", "bid_id", exact.alias("exact"), near.alias("near")))


# --- streams


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = t.table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return t.log_view(events)


def marks_stream(spark: SparkSession, path: str) -> DataFrame:
    end_marks(spark.createDataFrame([], "advertiser string"), path)
    return spark.readStream.schema("advertiser string").parquet(path)


def stream_hourly_landscape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hour of the log as a stream gives it out; at its end marks close the last hours."""
    path, marks, state = (fresh_path(spark, f"stream-{n}") for n in ("landscape", "marks", "state"))
    windows = stream_windows(event_stream(spark, sf_dir), marks_stream(spark, marks))
    run_available(windows, path, state)
    end_marks(t.bid_log(spark, sf_dir).select("advertiser").distinct(), marks)
    run_available(windows, path, state)
    return rounded(spark.read.parquet(path).filter("kind = 'window'").drop("kind"))


def stream_late_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of which one request in 97 arrives after all others: hours, and counts of the requests too late for theirs.

    The stream is stopped between the two parts and goes on from its checkpoint.
    """
    log, part = t.bid_log(spark, sf_dir), F.col("bid_id") % 97 == 0
    source, path, marks, state = (fresh_path(spark, f"late-{n}") for n in ("source", "windows", "marks", "state"))
    log.filter(~part).write.parquet(source)
    stream = spark.readStream.schema(log.schema).parquet(source)
    windows = stream_windows(stream, marks_stream(spark, marks))
    run_available(windows, path, state)
    log.filter(part).write.mode("append").parquet(source)
    run_available(windows, path, state)
    end_marks(log.select("advertiser").distinct(), marks)
    run_available(windows, path, state)
    return rounded(spark.read.parquet(path))


def stream_auction_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["TrueValue", "ConstantAvgValue"]
    table = broadcast_if_small(materialize(lanes(t.campaigns(spark, sf_dir, names))))
    path = fresh_path(spark, "stream-auctions")
    stream = stream_auctions(t.request_view(event_stream(spark, sf_dir)), table, names)
    columns = ["bid_id", "strategy", "bid", "outcome", F.col("pay").cast("double").alias("pay")]
    run_available(stream.select(*columns), path, fresh_path(spark, "stream-state"))
    return spark.read.parquet(path)


MODEL_QUERIES = {
    "label_index": label_index_query,
    "label_index_unseen": label_index_unseen,
    "label_index_skip": label_index_skip,
    "index_to_label": index_to_label,
    "winning_price_features": winning_price_features,
    "winning_price_model": winning_price_model,
    "winning_price_optimality": winning_price_optimality,
    "winning_price_rmse": price_errors("linear"),
    "winning_price_gbt": price_errors("gbt"),
    "winning_price_forest": price_errors("rf"),
    "score_requests": score_log,
    "calibrate_linear": calibrate_linear_query,
    "bid_pacing": bid_pacing,
    "calibrate_shading": calibrate_shading_query,
    "calibrate_ort": calibrate_ort_query("dual", tolerance=1.0),
    "calibrate_ort_past_cpc": calibrate_ort_query("past_cpc"),
    "stream_hourly_landscape": stream_hourly_landscape,
    "stream_late_requests": stream_late_requests,
    "stream_auction_outcome": stream_auction_outcome,
}
