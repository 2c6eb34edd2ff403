"""Registered queries over the driver's tables. Doubles are rounded to six decimals, so that
two engines that sum in a different order still compare equal."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidlens.functions.pricing import bucket
from bidlens.functions.timeparts import (
    day_hour,
    format_ts,
    hour_spine,
    hours_between,
    parse_ts,
    shift_cell,
    shift_hour,
    time_of_day,
)
from bidlens.operators.auction import (
    has_ended,
    has_started,
    out_of_order,
    route,
    with_auction,
    with_expected_kpis,
    with_value,
)
from bidlens.operators.kpis import campaign_kpis, kpi_lines, kpi_text
from bidlens.operators.landscape import (
    expected_spend,
    future_cells,
    hourly_landscape,
    lognormal,
    mix,
    sort_landscape,
    win_probability,
    with_landscape,
    won_by_hour,
    won_overall,
)
from bidlens.operators.prep import (
    ADVERTISERS,
    cast_schema,
    impressions,
    join_prices,
    map_dictionary,
    map_slot_columns,
    prep_all,
    sample_log,
    split_log,
    store_bucketed,
    to_bid_requests,
)
from bidlens.operators.strategies import bid_of, round_bid, threshold, uniform
from bidlens.plans.replay import bid_events, campaign_counters, gated_offers, lanes, offers, won_hours
from bidlens.session import broadcast_if_small, fresh_path, is_small, materialize
from bidlens.sources.logs import (
    read_dictionary,
    read_landscape,
    read_log,
    read_mixed_logs,
    read_requests,
    rows_per_file,
    with_file_name,
)
from bidlens.sources.sinks import (
    append_kpis,
    read_kpis,
    stage_requests,
    write_events,
    write_log,
    write_report,
    write_row_counts,
)
from bidlens.suite import tables as t

ALL_FACTORS = [1.0, 0.5, 0.33, 0.25, 0.125, 0.1, 0.05, 0.01]


def rounded(df: DataFrame) -> DataFrame:
    # A little more than half, so that an exact tie rounds up whichever way its last bit falls.
    def near(c: str):
        return F.floor(F.col(f"`{c}`") * 1e6 + 0.5001) / 1e6

    return df.withColumns({c: near(c) for c, kind in df.dtypes if kind == "double"})


# --- sources and sinks


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log written and read as comma and as tab separated text, with nulls as NA."""
    log = t.bid_log(spark, sf_dir).select(
        "bid_id",
        format_ts(F.col("ts")).alias("ts"),
        "advertiser",
        F.when(F.col("impression") == 1, F.col("paying_price")).alias("price"),
    )
    comma, tabbed = fresh_path(spark, "log-csv"), fresh_path(spark, "log-tsv")
    write_log(log, comma)
    write_log(read_log(spark, comma), tabbed, mode="overwrite", sep="\t")
    return read_log(spark, tabbed, sep="\t")


def typed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "requests")
    write_log(t.raw_requests(spark, sf_dir), path)
    return rounded(read_requests(spark, path))


def files_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as one text folder per day, read back by glob with the day of every row."""
    path = fresh_path(spark, "days")
    log = t.bid_log(spark, sf_dir).withColumn("day", F.to_date("ts")).drop("ts")
    log.hint("rebalance", "day").write.partitionBy("day").option("header", True).csv(path)
    log = read_log(spark, f"{path}/day=*/*.csv")
    return with_file_name(log).withColumn(
        "file_name", F.regexp_extract(F.col("_metadata.file_path"), "day=([0-9-]+)", 1)
    )


def mixed_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of logs whose files name their columns in another order, or have one more, united by name."""
    root = fresh_path(spark, "mixed")
    log = t.bid_log(spark, sf_dir).select("bid_id", "advertiser", F.col("impression").cast("string").alias("impression"), "user_id")
    layouts = [["bid_id", "advertiser", "impression"], ["impression", "bid_id", "advertiser"], ["advertiser", "user_id", "bid_id", "impression"]]
    for i, columns in enumerate(layouts):
        write_log(log.filter(F.col("bid_id") % 3 == i).select(columns), f"{root}/part={i}")
    found, report = read_mixed_logs(spark, f"{root}/part=*/*.csv", expected=["bid_id", "advertiser", "impression"])
    extra = report.filter("not expected").select("column").collect()
    return found.withColumn("unknown_columns", F.lit(",".join(r[0] for r in extra)))


def count_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = rows_per_file(files_by_day(spark, sf_dir))
    path = fresh_path(spark, "counts")
    write_row_counts(counts, path)
    return read_log(spark, path, sep="\t").select(
        F.col("file").alias("file_name"), F.col("nrow").cast("bigint").alias("nrow")
    )


# --- projection, filters, mappings


def cast_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = t.coded_log(spark, sf_dir).select(
        "Bid_id",
        F.col("Hour").cast("string").alias("Hour"),
        F.concat(F.col("AdSlotW").cast("string"), F.lit(".0")).alias("AdSlotW"),
        F.when(F.col("UA_os_type") != "mobile", F.col("PayingPrice").cast("string")).otherwise(F.lit("n/a")).alias("PayingPrice"),
        (F.col("Click") > 0).cast("string").alias("clicked"),
        F.col("Site_Dom"),
    )
    types = {"Hour": "int", "AdSlotW": "int", "PayingPrice": "double", "clicked": "boolean"}
    return rounded(cast_schema(text, types))


def prep_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(prep_all(t.raw_log(spark, sf_dir), *t.dictionaries(spark, sf_dir)))


def bid_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(to_bid_requests(t.raw_requests(spark, sf_dir)))


def impressions_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impressions(t.impression_log(t.bid_log(spark, sf_dir)))


def sample_impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impressions in two independent samples of the log, chosen by bid id."""
    log = t.bid_log(spark, sf_dir).filter("impression = 1")
    parts = [
        sample_log(log, fraction, seed, "bid_id").select(F.lit(fraction).alias("fraction"), "bid_id")
        for fraction, seed in ((0.008, 7), (0.004, 8))
    ]
    return parts[0].unionByName(parts[1])


def train_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _, test, _ = split_log(t.bid_log(spark, sf_dir), [0.7, 0.0, 0.3, 0.0], 42, "bid_id")
    return train.select("bid_id", F.lit("train").alias("part")).unionByName(
        test.select("bid_id", F.lit("test").alias("part"))
    )


def map_city_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionaries pass through tab separated files, as they are delivered."""
    coded = t.coded_log(spark, sf_dir).select("Bid_id", "City", "Region")
    for column, dictionary in zip(["City", "Region"], t.dictionaries(spark, sf_dir)):
        path = fresh_path(spark, "dictionary")
        dictionary.write.option("sep", "\t").csv(path)
        coded = map_dictionary(coded, column, read_dictionary(spark, path))
    return coded


def map_slot_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_slot_columns(t.coded_log(spark, sf_dir).select("Bid_id", "AdEx", "AdSlotFormat", "AdSlotVis"))


def join_side_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    main = t.bid_log(spark, sf_dir).select(F.col("bid_id").alias("Bid_id"), "advertiser", "prediction")
    return rounded(join_prices(main, t.price_side_table(spark, sf_dir)))


def join_bucketed_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price join over tables that are stored in buckets of the bid id: no exchange."""
    main = t.bid_log(spark, sf_dir).select(F.col("bid_id").alias("Bid_id"), "advertiser", "prediction")
    prices = t.price_side_table(spark, sf_dir).withColumnRenamed("b_id", "Bid_id")
    name = f"prices_{uuid.uuid4().hex}"
    stored = [store_bucketed(df, "Bid_id", f"{name}_{i}", fresh_path(spark, "bucketed"), 8) for i, df in enumerate((main, prices))]
    return rounded(join_prices(stored[0], stored[1].withColumnRenamed("Bid_id", "b_id")))


# --- time


def parse_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = t.bid_log(spark, sf_dir).select("bid_id", format_ts(F.col("ts")).alias("text"))
    return text.select(
        "bid_id",
        parse_ts(F.col("text")).alias("ts_millis"),
        parse_ts(F.substring("text", 1, 14)).alias("ts_seconds"),
    )


def day_hour_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    weekday, hour = day_hour(F.col("ts"))
    return t.bid_log(spark, sf_dir).select("bid_id", weekday.alias("weekday"), hour.alias("hour"))


def adjacent_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts")
    weekday, hour = day_hour(ts)
    columns = []
    for name, pair in {
        "next": shift_hour(ts, 1),
        "prev": shift_hour(ts, -1),
        "next_cell": shift_cell(weekday, hour, 1),
        "prev_cell": shift_cell(weekday, hour, -1),
    }.items():
        columns += [pair[0].alias(f"{name}_weekday"), pair[1].alias(f"{name}_hour")]
    return t.bid_log(spark, sf_dir).select("bid_id", *columns)


def hour_spine_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hour buckets from every request of the campaign days to the end of its campaign."""
    offered = route(t.requests(spark, sf_dir), broadcast_if_small(t.advertisers(spark, sf_dir)))
    per_hour = offered.groupBy("advertiser", "start_ts", "end_ts", F.date_trunc("hour", "ts").alias("h")).agg(
        F.min("ts").alias("now")
    )
    spine = hour_spine(per_hour.filter(has_started(F.col("now"))), "now", "end_ts")
    return spine.select("advertiser", "now", "weekday", "hour").groupBy("advertiser", "now", "weekday", "hour").count()


def time_of_day_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.bid_log(spark, sf_dir).select("bid_id", time_of_day(F.hour("ts")).alias("time_of_day"))


def campaign_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts")
    offered = route(t.requests(spark, sf_dir), broadcast_if_small(t.advertisers(spark, sf_dir)))
    return offered.select(
        "bid_id",
        has_started(ts).alias("has_started"),
        has_ended(ts).alias("has_ended"),
        (has_started(ts) & ~has_ended(ts)).alias("is_active"),
        hours_between(ts, F.col("end_ts")).alias("hours_remaining"),
        hours_between(F.col("start_ts"), ts).alias("hours_evolved"),
    ).withColumns(
        {
            "hours_remaining": F.when(F.col("is_active"), F.col("hours_remaining")),
            "hours_evolved": F.when(F.col("is_active"), F.col("hours_evolved")),
        }
    )


def hash_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = t.coded_log(spark, sf_dir)
    hashed = coded.select(
        F.explode(F.array(*[bucket(c, F.col(c), 1000) for c in ("Site_URL", "Site_Dom")])).alias("bucket")
    )
    return hashed.groupBy("bucket").count()


# --- landscape


def hourly_landscape_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sort_landscape(hourly_landscape(t.impression_log(t.bid_log(spark, sf_dir)))))


def landscape_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a stored landscape for every request, with the default where there is none."""
    path = fresh_path(spark, "landscape")
    part = t.training_part(t.bid_log(spark, sf_dir))
    write_log(hourly_landscape(t.impression_log(part)), path, mode="overwrite")
    cells = broadcast_if_small(read_landscape(spark, path))
    weekday, hour = day_hour(F.col("ts"))
    wanted = t.bid_log(spark, sf_dir).select("bid_id", "advertiser", weekday.alias("weekday"), hour.alias("hour"))
    return rounded(with_landscape(wanted, cells))


def landscape_lognormal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lognormal(t.landscape(spark, sf_dir)))


def win_probability_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chance of the predicted price to win, by the cell of the request."""
    cells = broadcast_if_small(t.landscape(spark, sf_dir))
    weekday, hour = day_hour(F.col("ts"))
    wanted = t.requests(spark, sf_dir).withColumn("weekday", weekday).withColumn("hour", hour)
    found = lognormal(with_landscape(wanted, cells))
    p = win_probability(F.col("wp_prediction"), F.col("location"), F.col("scale"))
    return rounded(found.select("bid_id", p.alias("win_probability")))


def seen_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments per campaign and hour of what the true value bidder saw under every budget."""
    return won_hours(*offered(spark, sf_dir, ["TrueValue"]))


def won_landscape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Campaign-wide won landscape of the true value bidder for every budget."""
    return rounded(won_overall(seen_hours(spark, sf_dir), ["campaign_id"], F.lit(t.START).cast("timestamp_ntz")))


def won_landscape_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(won_by_hour(seen_hours(spark, sf_dir), ["campaign_id"]))


def landscape_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training cell of every campaign hour mixed with the won landscape of the hour before."""
    hours = won_by_hour(seen_hours(spark, sf_dir), ["advertiser", "campaign_id"])
    weekday, hour = day_hour(F.col("hour_ts"))
    hours = hours.select(
        "advertiser",
        "campaign_id",
        "hour_ts",
        weekday.alias("weekday"),
        hour.alias("hour"),
        *[f"prev_{c}" for c in ["rate", "wins", "mu", "sigma", "ctr"]],
    )
    mixed = mix(with_landscape(hours, broadcast_if_small(t.landscape(spark, sf_dir))))
    return rounded(mixed.select("campaign_id", "hour_ts", "rate", "mu", "sigma", "ctr"))


def expected_spend_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spend expected at campaign start for the average-value bid, by both cost rules."""
    camp = t.campaigns(spark, sf_dir, ["ConstantAvgValue"])
    cells = future_cells(camp, broadcast_if_small(t.landscape(spark, sf_dir)), "start_ts", "end_ts")
    own = expected_spend(cells, ["campaign_id"], F.col("bid_level"), F.lit(40.0))
    market = expected_spend(cells, ["campaign_id"], F.col("bid_level"), F.col("mu"))
    return rounded(
        own.join(market.withColumnRenamed("expected_spend", "expected_spend_market"), "campaign_id")
    )


# --- bids, auctions, budgets


def valued_requests(spark: SparkSession, sf_dir: str, strategy: str = "TrueValue", **options) -> DataFrame:
    lane_table = lanes(t.campaigns(spark, sf_dir, [strategy], factors=[1.0], **options))
    return with_value(route(t.requests(spark, sf_dir), broadcast_if_small(lane_table)))


def request_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    valued = with_expected_kpis(valued_requests(spark, sf_dir))
    return rounded(valued.select("bid_id", "ectr", "private_value", "surplus", "roi"))


def bids_of(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        valued = valued_requests(spark, sf_dir, name, shading=0.7)
        return valued.select("bid_id", bid_of(name).alias("bid"))

    return query


def bid_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    valued = valued_requests(spark, sf_dir)
    return valued.select(
        "bid_id", bid_of("OriginalBidding").alias("bid"), bid_of("ConstantAvgValue").alias("bid_average")
    )


def bid_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valued_requests(spark, sf_dir).select(
        "bid_id",
        round_bid(threshold("Surplus", 10.0)).alias("bid_surplus"),
        round_bid(threshold("ROI", -0.5)).alias("bid_roi"),
    )


def bid_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strategies that bid by a threshold and at random in a fixed range, by name."""
    valued = valued_requests(spark, sf_dir)
    return valued.select("bid_id", bid_of("ThresholdSurplus").alias("bid_surplus"), bid_of("RandomInRange").alias("bid_random"))


def bid_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.requests(spark, sf_dir).select(
        "bid_id", round_bid(uniform(F.lit(10.0), F.lit(110.0), 42)).alias("bid")
    )


def offered(spark: SparkSession, sf_dir: str, names: list[str], **options) -> tuple[DataFrame, DataFrame]:
    camp = t.campaigns(spark, sf_dir, names, **options)
    return offers(t.requests(spark, sf_dir), camp, t.landscape(spark, sf_dir), names), camp


def bid_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = offered(spark, sf_dir, ["LinearBidder"], factors=[1.0])
    return rows.select("bid_id", "bid")


def bid_ort(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = offered(spark, sf_dir, ["ORTB"], factors=[1.0], lam=0.01)
    return rows.select("bid_id", "bid")


def auction_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Auctions at the true value, over the whole log and with no schedule."""
    always = valued_requests(spark, sf_dir).withColumns(
        {
            "start_ts": F.lit("1970-01-01").cast("timestamp_ntz"),
            "end_ts": F.lit("9999-01-01").cast("timestamp_ntz"),
            "bid": round_bid(F.col("private_value")),
        }
    )
    result = with_auction(always)
    return rounded(
        result.select("bid_id", "bid", "won", "click", "conversion", F.col("pay").cast("double").alias("pay"))
    )


def route_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    camp = broadcast_if_small(t.campaigns(spark, sf_dir, ["TrueValue"]))
    return route(t.requests(spark, sf_dir), camp).select("bid_id", "campaign_id", F.col("budget").cast("double").alias("budget"))


def gated(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> DataFrame:
    return gated_offers(*offered(spark, sf_dir, names or ["TrueValue"]))


def request_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gated(spark, sf_dir).select("bid_id", "campaign_id", "outcome")


def budget_gate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wins that each budget pays for."""
    rows = gated(spark, sf_dir, ["TrueValue", "ConstantAvgValue"]).filter("won and seen")
    return rows.select("campaign_id", "bid_id", F.col("pay").cast("double").alias("pay"))


def bid_event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "events")
    write_events(bid_events(gated(spark, sf_dir), "whole log"), path)
    back = read_log(spark, path)
    doubles = ["budgetFactor", "privateValue", "eCTR", "eWP", "bid", "payingPrice"]
    return rounded(cast_schema(back, {c: "double" for c in doubles}))


def out_of_order_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log laid out by its hour within the day is out of order; its own order is not."""
    log = t.requests(spark, sf_dir)
    shuffled = log.withColumn("position", F.hour("ts").cast("bigint") * 10_000_000 + F.col("bid_id"))
    return out_of_order(log, "bid_id").select("bid_id", F.lit("log").alias("layout")).unionByName(
        out_of_order(shuffled, "position").select("bid_id", F.lit("by hour").alias("layout"))
    )


KPI_STRATEGIES = ["OriginalBidding", "ConstantAvgValue", "TrueValue", "RandomUpToTrueValue", "LinearBidder"]


def kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, camp = offered(spark, sf_dir, KPI_STRATEGIES)
    return campaign_kpis(campaign_counters(rows, camp))


def campaign_kpis_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(kpis(spark, sf_dir))


def campaign_kpis_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One strategy at three levels of its parameter, replayed together."""
    names = ["ShadedValueBidder"]
    runs = [t.campaigns(spark, sf_dir, names, shading=x) for x in (0.0, 0.3, 0.7)]
    camp = materialize(runs[0].union(runs[1]).union(runs[2]))
    rows = offers(t.requests(spark, sf_dir), camp, t.landscape(spark, sf_dir), names)
    return rounded(campaign_kpis(campaign_counters(rows, camp), ["shading"]))


def kpi_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs in one table, of which the second is written twice."""
    path = fresh_path(spark, "kpis")
    for run, names in (("run 1", ["TrueValue"]), ("run 2", ["ConstantAvgValue"]), ("run 2", ["ConstantAvgValue"])):
        rows, camp = offered(spark, sf_dir, names)
        lines = kpi_lines(campaign_kpis(campaign_counters(rows, camp)), "2024-02-01", run)
        append_kpis(lines, path)
    return rounded(read_kpis(spark, path, lines))


def campaign_report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, camp = offered(spark, sf_dir, KPI_STRATEGIES)
    text = kpi_text(campaign_kpis(campaign_counters(rows, camp), ["campaign_id"]))
    path = fresh_path(spark, "report")
    write_report(text, path)
    return spark.read.option("lineSep", "\n").text(path).groupBy("value").count()


def staged_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters over requests stored by hour, so that cuts read only the hours they are in."""
    names = ["TrueValue"]
    staged = stage_requests(
        t.requests(spark, sf_dir).withColumn("hour_ts", F.date_trunc("hour", "ts").cast("timestamp_ntz")),
        fresh_path(spark, "staged"),
    )
    camp = t.campaigns(spark, sf_dir, names)
    rows = offers(staged, camp, t.landscape(spark, sf_dir), names)
    return rounded(campaign_kpis(campaign_counters(rows, camp)))


QUERIES = {
    "csv_roundtrip": csv_roundtrip,
    "typed_requests": typed_requests,
    "rows_per_file": count_by_file,
    "cast_schema": cast_columns,
    "prep_all": prep_log,
    "bid_requests": bid_requests,
    "impressions_only": impressions_only,
    "sample_impressions": sample_impressions,
    "train_test_split": train_test_split,
    "map_city_region": map_city_region,
    "map_slot_codes": map_slot_codes,
    "join_prices": join_side_prices,
    "join_prices_bucketed": join_bucketed_prices,
    "mixed_headers": mixed_headers,
    "parse_timestamps": parse_timestamps,
    "day_hour": day_hour_query,
    "adjacent_hours": adjacent_hours,
    "hour_spine": hour_spine_query,
    "time_of_day": time_of_day_query,
    "campaign_status": campaign_status,
    "hash_buckets": hash_buckets,
    "hourly_landscape": hourly_landscape_query,
    "landscape_lookup": landscape_lookup,
    "landscape_lognormal": landscape_lognormal,
    "win_probability": win_probability_query,
    "won_landscape": won_landscape,
    "won_landscape_hours": won_landscape_hours,
    "landscape_mix": landscape_mix,
    "expected_spend": expected_spend_query,
    "request_value": request_value,
    "bid_constant": bid_constant,
    "bid_value": bids_of("TrueValue"),
    "bid_threshold": bid_threshold,
    "bid_linear": bid_linear,
    "bid_named": bid_named,
    "bid_random": bid_random,
    "bid_random_value": bids_of("RandomUpToTrueValue"),
    "bid_shaded": bids_of("ShadedValueBidder"),
    "bid_ort": bid_ort,
    "auction_outcome": auction_outcome,
    "route_requests": route_requests,
    "request_outcomes": request_outcomes,
    "budget_gate": budget_gate_query,
    "bid_event_log": bid_event_log,
    "out_of_order_requests": out_of_order_requests,
    "campaign_kpis": campaign_kpis_query,
    "campaign_kpis_sweep": campaign_kpis_sweep,
    "campaign_kpis_staged": staged_gate,
    "kpi_append": kpi_append,
    "campaign_report_text": campaign_report_text,
}
