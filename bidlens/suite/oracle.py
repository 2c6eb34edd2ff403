"""DuckDB SQL with the results of the registered queries, over the same tables."""

from __future__ import annotations

from functools import reduce

from bidlens.functions.normal import DENOMINATOR, NUMERATOR, ROOT_TWO_PI, TAIL
from bidlens.operators.ort import MAX_BID, STEPS, TOLERANCE
from bidlens.operators.prep import (
    AD_EXCHANGES,
    ADVERTISERS,
    PREDICTION_COLUMNS,
    SLOT_FORMATS,
    SLOT_VISIBILITIES,
    TAG_COLUMNS,
)
from bidlens.plans.replay import BUDGET_FACTORS
from bidlens.sources.schemas import THRESHOLDS
from bidlens.suite.tables import (
    AGENT_COLUMNS,
    BASE_CTR,
    CLICK_VALUE,
    ECTR_FACTORS,
    END,
    END_SOFTWARE,
    START,
    TRAIN_END,
)

BID_LOG = f"""bid_log as (
  select event_id as bid_id, ts, user_id,
    case user_id % 5 {" ".join(f"when {i} then '{a}'" for i, a in enumerate(ADVERTISERS))} end as advertiser,
    case when event_type <> 'error' then 1 else 0 end as impression,
    case when event_type in ('click', 'purchase') then 1 else 0 end as click,
    case when event_type = 'purchase' then 1 else 0 end as conversion,
    cast(user_id % 100 as double) as floor_price,
    value as paying_price,
    cast(json_extract_string(props, '$.k') as int) as k,
    cast(json_extract_string(props, '$.k') as int) / cast(100 as double) as prediction,
    25 + cast(json_extract_string(props, '$.k') as int) / cast(2 as double) as wp_prediction
  from events)"""

REQUESTS = """requests as (
  select bid_id, ts, advertiser, click > 0 as is_click, conversion > 0 as is_conversion, floor_price,
    paying_price as winning_price, prediction as ctr_prediction, wp_prediction,
    upper(dayname(ts)) as weekday, hour(ts)::int as hour
  from bid_log)"""

ADVERTISER = f"""advertisers as (
  select s.advertiser, b.full_budget, {CLICK_VALUE}::double as click_value, {BASE_CTR}::double as base_ctr,
    s.ectr_factor::double as ectr_factor, timestamp '{START}' as start_ts, s.end_ts
  from (values {", ".join(
      f"('{a}', {f}, timestamp '{END_SOFTWARE if a == 'Software' else END}')"
      for a, f in zip(ADVERTISERS, ECTR_FACTORS))}) s(advertiser, ectr_factor, end_ts)
  join (select advertiser, cast(sum(cast(paying_price as decimal(18,6))) as double) as full_budget
        from bid_log where ts >= timestamp '{TRAIN_END}' and ts < timestamp '2024-01-25' group by 1) b
  using (advertiser))"""

LANDSCAPE = f"""landscape as (
  select advertiser, upper(dayname(ts)) as weekday, hour(ts)::int as hour, count(*)::double as rate,
    avg(paying_price) as mu, stddev_samp(paying_price) as sigma, avg(click::double) as ctr
  from bid_log where impression = 1 and ts < timestamp '{TRAIN_END}' group by all)"""


def r(expression: str, name: str) -> str:
    return f'floor(({expression}) * 1e6::double + 0.5001::double) / 1e6::double as "{name}"'


def campaigns(strategies: list[str], shading: float | list[float] = 0.0, lam: float = 5.2e-7) -> str:
    levels = shading if isinstance(shading, list) else [shading]
    runs = ", ".join(f"('{s}', {float(f)}::double, {x}::double)" for s in strategies for f in BUDGET_FACTORS for x in levels)
    level = " || '_' || shading::varchar" if isinstance(shading, list) else ""
    return f"""campaigns as (
  select advertiser || '_' || budget_factor::varchar || '_' || strategy{level} as campaign_id, advertiser, strategy,
    budget_factor, cast(budget_factor * full_budget as decimal(18,6)) as budget, click_value, ectr_factor,
    start_ts, end_ts, click_value * base_ctr as bid_level, shading, {lam}::double as lam
  from advertisers, (values {runs}) f(strategy, budget_factor, shading)),
lanes as (select distinct advertiser, strategy, click_value, ectr_factor, start_ts, end_ts, bid_level, shading, lam
  from campaigns)"""


VALUED = """valued as (
  select r.*, l.strategy, l.click_value, l.start_ts, l.end_ts, l.bid_level, l.shading, l.lam,
    case when ctr_prediction > 0 then least(ctr_prediction / ectr_factor, 1.0::double) else 0.0::double end as ectr,
    (case when ctr_prediction > 0 then least(ctr_prediction / ectr_factor, 1.0::double) else 0.0::double end)
      * click_value as private_value
  from requests r join lanes l using (advertiser))"""

DEFAULTED = """
    case when l.mu is not null and l.sigma is not null then l.rate else 0.0::double end as rate,
    case when l.mu is not null and l.sigma is not null then l.mu else 75.0::double end as mu,
    case when l.mu is not null and l.sigma is not null then l.sigma else 50.0::double end as sigma,
    case when l.mu is not null and l.sigma is not null then coalesce(l.ctr, 0.0::double) else 8e-4 end as ctr"""

CELLS = f"""cells as (
  select v.*, {DEFAULTED}
  from valued v left join landscape l using (advertiser, weekday, hour))"""


def unit(key: str, seed: int) -> str:
    return f"(('0x' || substr(md5('{seed}:' || {key}::varchar), 1, 12))::bigint / {float(2**48)}::double)"


BIDS = {
    "OriginalBidding": "1000.0::double",
    "ConstantAvgValue": "bid_level",
    "TrueValue": "private_value",
    "RandomUpToTrueValue": f"private_value * {unit('bid_id', 42)}",
    "LinearBidder": "bid_level * ectr / nullif(ctr, 0)",
    "ShadedValueBidder": "private_value / (shading + 1.0::double)",
}


def offers(strategies: list[str]) -> str:
    bids = " ".join(f"when '{s}' then {BIDS[s]}" for s in strategies)
    return f"""bids as (
  select *, coalesce(round(case strategy {bids} end, 2), 0) as bid,
    ts > start_ts and ts <= end_ts as open
  from cells),
offers as (
  select *, open and bid > 0 as bidding, open and bid > 0 and bid >= winning_price as won,
    cast(case when not (open and bid > 0) then 0 when bid >= winning_price and bid >= floor_price then winning_price
      when bid >= winning_price then bid else 0 end as decimal(18,6)) as pay
  from bids),
gate as (
  select o.*, c.campaign_id, c.budget, c.budget_factor,
    coalesce(sum(o.pay) over (partition by c.campaign_id order by o.ts, md5(o.bid_id::varchar), o.bid_id
      rows between unbounded preceding and 1 preceding), 0) < c.budget as seen
  from offers o join campaigns c using (advertiser, strategy, shading)),
outcomes as (
  select *, case when not (open and seen) then 'missed' when not bidding then 'passed' when won then 'won'
      else 'lost' end as outcome
  from gate)"""


def replay(strategies: list[str], **options) -> str:
    return ",\n".join(
        [BID_LOG, REQUESTS, ADVERTISER, LANDSCAPE, campaigns(strategies, **options), VALUED, CELLS, offers(strategies)]
    )


def horner(x: str, coefficients: list[float]) -> str:
    return reduce(lambda acc, c: f"({acc} * {x} + {c!r}::double)", coefficients[1:], f"{coefficients[0]!r}::double")


def cdf(x: str) -> str:
    a = f"least(abs({x}), {TAIL}::double)"
    tail = f"(case when abs({x}) >= {TAIL} then 0 else exp(-0.5::double * {a} * {a}) * {horner(a, NUMERATOR)} / {horner(a, DENOMINATOR)} end)"
    return f"(case when {x} > 0 then 1 - {tail} else {tail} end)"


def pdf(x: str) -> str:
    return f"(exp(-0.5::double * {x} * {x}) / {ROOT_TWO_PI!r}::double)"


LOCATION = "ln(mu / sqrt(1 + sigma * sigma / (mu * mu)))"
SCALE = "sqrt(ln(1 + sigma * sigma / (mu * mu)))"


def win(level: str, loc: str = "location", scl: str = "scale") -> str:
    """Win probability; the argument of the distribution is inlined, so pass plain columns."""
    z = f"((ln({level}) - {loc}) / {scl})"
    return (
        f"(case when {level} <= 0 then 0 when {scl} > 0 then {cdf(z)} "
        f"else (case when ln({level}) >= {loc} then 1 else 0 end) end)"
    )


CODED = f"""coded as (
  select b.*, c.c_nationkey as city_code, n.n_regionkey as region_code, c.c_acctbal, c.c_mktsegment
  from bid_log b left join customer c on b.user_id = c.c_custkey left join nation n on c.c_nationkey = n.n_nationkey),
named as (
  select coded.*,
    case when city_code is null or city_code in (7, 3) then 'NA' else n.n_name end as city,
    case when region_code is null or region_code = 2 then 'NA' else r_name end as region
  from coded left join nation n on city_code = n.n_nationkey left join region on region_code = r_regionkey)"""


def listed(code: str, names: dict[int, str]) -> str:
    return f"case {code} {' '.join(f'when {k} then {chr(39)}{v}{chr(39)}' for k, v in names.items())} end"


AD_EX = listed("1 + user_id % 5", AD_EXCHANGES)
FORMAT = listed("([0, 1, 2, 5])[user_id % 4 + 1]", SLOT_FORMATS)
VIEW = listed("([0, 1, 2, 3, 4, 5, 6, 255])[user_id % 8 + 1]", SLOT_VISIBILITIES)

COUNTERS = """
    count(*) as requests,
    count(*) filter (outcome = 'won') as impressions,
    count(*) filter (outcome = 'lost') as lost,
    count(*) filter (outcome = 'passed') as passed,
    count(*) filter (outcome = 'missed') as missed,
    count(*) filter (outcome = 'won' and is_click) as clicks,
    count(*) filter (outcome = 'won' and is_conversion) as conversions,
    coalesce(sum(ectr) filter (outcome = 'won'), 0) as e_clicks,
    coalesce(sum(private_value) filter (outcome = 'won'), 0) as a_priori,
    coalesce(sum(pay) filter (outcome = 'won'), 0) as spend,
    max(ts) filter (outcome = 'won') as last_win"""

KPI_COLUMNS = f"""budget_factor as "budgetFactor", advertiser, strategy, start_ts as start, end_ts as "scheduledEnd",
  case when spend >= budget then last_win else end_ts end as "end",
  requests, impressions, lost, passed, missed, clicks, conversions, {r("budget::double", "budget")},
  {r("spend::double", "spent")}, {r("(budget - spend)::double", "remaining")},
  {r("(impressions + lost) / nullif(requests - missed, 0)::double", "bidRateSeen")},
  {r("(impressions + lost) / requests::double", "bidRateTotal")},
  {r("impressions / nullif(impressions + lost, 0)::double", "winRate")},
  {r("clicks / nullif(impressions, 0)::double", "ctr")},
  {r("conversions / nullif(clicks, 0)::double", "cvr")},
  {r("spend::double / nullif(impressions, 0)", "cpi")},
  {r("spend::double / nullif(clicks * 1000, 0)", "cpc")},
  {r("clicks * click_value", "actualValue")}, {r("clicks * click_value - spend::double", "actualSurplus")},
  {r("(clicks * click_value - spend::double) / nullif(spend::double, 0)", "actualROI")},
  {r("e_clicks", "eClicks")}, {r("e_clicks / nullif(impressions, 0)", "eCTR")},
  {r("a_priori", "aPrioriValue")}, {r("a_priori - spend::double", "aPrioriSurplus")},
  {r("(a_priori - spend::double) / nullif(spend::double, 0)", "aPrioriROI")}"""


def kpis(strategies: list[str], prefix: str = "", **options) -> str:
    return f"""with {replay(strategies, **options)},
counted as (
  select campaign_id, advertiser, strategy, shading, budget_factor, budget, click_value, start_ts, end_ts, {COUNTERS}
  from outcomes group by all)
select {prefix} {KPI_COLUMNS} from counted"""


WON = """seen_rows as (select * from outcomes where outcome <> 'missed'),
hours as (
  select campaign_id, advertiser, date_trunc('hour', ts) as hour_ts, count(*)::double as rate,
    count(*) filter (outcome = 'won') as wins,
    coalesce(avg(pay::double) filter (outcome = 'won'), 0) as mu,
    case when count(*) filter (outcome = 'won') < 2
      or coalesce(stddev_samp(pay::double) filter (outcome = 'won'), 0) = 0 then 1.0::double
      else stddev_samp(pay::double) filter (outcome = 'won') end as sigma,
    count(*) filter (outcome = 'won' and is_click) / nullif(count(*) filter (outcome = 'won'), 0)::double as ctr
  from seen_rows group by all),
lagged as (
  select *, lag(rate) over w as prev_rate, lag(wins) over w as prev_wins, lag(mu) over w as prev_mu,
    lag(sigma) over w as prev_sigma, lag(ctr) over w as prev_ctr
  from hours window w as (partition by campaign_id order by hour_ts))"""

TRUE_VALUE = replay(["TrueValue"])

ORACLE = {
    "csv_roundtrip": f"""with {BID_LOG}
select bid_id::varchar as bid_id, strftime(ts, '%Y%m%d%H%M%S%g') as ts, advertiser,
  case when impression = 1 then paying_price::varchar end as price from bid_log""",
    "typed_requests": f"""with {BID_LOG}
select bid_id::varchar as "Bid_id", strftime(ts, '%Y%m%d%H%M%S%g') as "Timestamp",
  impression::double as "Impression", click::double as "Click", conversion::double as "Conversion",
  advertiser as "Advertiser", floor_price as "AdSlotFloorPrice", {r("prediction", "prediction")},
  {r("prediction * 1.4::double", "GBRT_prediction_International_eCommerce")},
  {r("prediction", "GBRT_prediction_Oil")}, {r("prediction * 1.1::double", "GBRT_prediction_Software")},
  {r("prediction * 1.2::double", "GBRT_prediction_Tire")},
  {r("prediction * 1.3::double", "GBRT_prediction_Chinese_vertical_eCommerce")},
  {r("paying_price * 1.2::double", "BidPrice")}, paying_price as "PayingPrice", wp_prediction as "WpPrediction"
from bid_log""",
    "rows_per_file": f"""with {BID_LOG}
select strftime(ts, '%Y-%m-%d') as file_name, count(*) as nrow from bid_log group by 1""",
    "cast_schema": f"""with {BID_LOG}
select bid_id::varchar as "Bid_id", hour(ts)::int as "Hour", (user_id % 50)::int as "AdSlotW",
  case when user_id % 3 <> 1 then paying_price end as "PayingPrice", click::double as clicked,
  'd' || (user_id % 37)::varchar as "Site_Dom" from bid_log""",
    "prep_all": f"""with {BID_LOG}, {CODED}
select bid_id::varchar as "Bid_id", strftime(ts, '%Y%m%d%H%M%S%g') as "Timestamp", advertiser as "Advertiser",
  dayname(ts) as "Weekday", hour(ts)::int as "Hour", month(ts)::int as "Month", year(ts)::int as "Year",
  impression::double as "Impression", click::double as "Click", conversion::double as "Conversion",
  city as "City", region as "Region", {AD_EX} as "AdEx", {FORMAT} as "AdSlotFormat", {VIEW} as "AdSlotVis",
  (['desktop', 'mobile', 'tablet'])[user_id % 3 + 1] as "UA_os_type", c_mktsegment as "UA_os_fam",
  {", ".join(f"'v' || (user_id % {m})::varchar as " + chr(34) + name + chr(34) for name, m in AGENT_COLUMNS.items())},
  (user_id % 50)::int as "City_Pop", {r("c_acctbal", "City_Lat")}, k::double as "City_Long",
  (user_id % 50)::int as "AdSlotW", k as "AdSlotH", (user_id % 50 * k)::int as "AdSlotSize",
  floor_price as "AdSlotFloorPrice", '/p/' || (bid_id % 5000)::varchar as "Site_URL",
  'd' || (user_id % 37)::varchar as "Site_Dom",
  {", ".join(f"((user_id + {j}) % 2)::double as " + chr(34) + c + chr(34) for j, c in enumerate(TAG_COLUMNS))},
  {r("prediction", "prediction")},
  {", ".join(r(f"prediction * {1 + 0.1 * i!r}::double", c) for i, c in enumerate(PREDICTION_COLUMNS))},
  {r("paying_price * 1.2::double", "BidPrice")}, {r("paying_price", "PayingPrice")}
from named""",
    "bid_requests": f"""with {BID_LOG}
select bid_id::varchar as bid_id, date_trunc('millisecond', ts) as ts, advertiser, click > 0 as is_click,
  conversion > 0 as is_conversion, floor_price, paying_price as winning_price,
  {r("prediction * (case user_id % 5 when 0 then 1.0::double when 1 then 1.1::double when 2 then 1.2::double "
     "when 3 then 1.3::double else 1.4::double end)", "ctr_prediction")}, wp_prediction
from bid_log""",
    "impressions_only": f"""with {BID_LOG}
select advertiser as "Advertiser", dayname(ts) as "Weekday", hour(ts)::int as "Hour",
  impression::double as "Impression", click::double as "Click", paying_price as "PayingPrice"
from bid_log where impression = 1""",
    "sample_impressions": f"""with {BID_LOG}
select 0.008::double as fraction, bid_id from bid_log where impression = 1 and {unit("bid_id", 7)} < 0.008::double
union all
select 0.004::double, bid_id from bid_log where impression = 1 and {unit("bid_id", 8)} < 0.004::double""",
    "train_test_split": f"""with {BID_LOG}
select bid_id, case when {unit("bid_id", 42)} < 0.7::double then 'train' else 'test' end as part from bid_log""",
    "map_city_region": f"""with {BID_LOG}, {CODED}
select bid_id::varchar as "Bid_id", city as "City", region as "Region" from named""",
    "map_slot_codes": f"""with {BID_LOG}
select bid_id::varchar as "Bid_id", {AD_EX} as "AdEx", {FORMAT} as "AdSlotFormat", {VIEW} as "AdSlotVis"
from bid_log""",
    "join_prices": f"""with {BID_LOG}
select m.bid_id as "Bid_id", m.advertiser, {r("m.prediction", "prediction")},
  {r("s.paying_price * 1.2::double", "BidPrice")}, s.paying_price as "PayingPrice"
from bid_log m join (select bid_id, paying_price from bid_log where impression = 1) s using (bid_id)""",
    "parse_timestamps": f"""with {BID_LOG}
select bid_id, date_trunc('millisecond', ts) as ts_millis, date_trunc('second', ts) as ts_seconds from bid_log""",
    "day_hour": f"""with {BID_LOG}
select bid_id, upper(dayname(ts)) as weekday, hour(ts)::int as hour from bid_log""",
    "adjacent_hours": f"""with {BID_LOG}
select bid_id, upper(dayname(n)) as next_weekday, hour(n)::int as next_hour,
  upper(dayname(p)) as prev_weekday, hour(p)::int as prev_hour,
  upper(dayname(n)) as next_cell_weekday, hour(n)::int as next_cell_hour,
  upper(dayname(p)) as prev_cell_weekday, hour(p)::int as prev_cell_hour
from (select bid_id, ts + interval 1 hour as n, ts - interval 1 hour as p from bid_log)""",
    "hour_spine": f"""with {BID_LOG}, {ADVERTISER}, firsts as (
  select advertiser, start_ts, end_ts, min(ts) as now from bid_log join advertisers using (advertiser)
  group by advertiser, start_ts, end_ts, date_trunc('hour', ts)),
steps as (select advertiser, now, unnest(generate_series(now, end_ts, interval 1 hour)) as step
  from firsts where now > start_ts and now <= end_ts)
select advertiser, now, upper(dayname(step)) as weekday, hour(step)::int as hour, count(*) as count
from steps group by all""",
    "time_of_day": f"""with {BID_LOG}
select bid_id, case when hour(ts) between 1 and 6 then 'night' when hour(ts) between 7 and 12 then 'morning'
  when hour(ts) between 13 and 18 then 'afternoon' else 'evening' end as time_of_day from bid_log""",
    "campaign_status": f"""with {BID_LOG}, {ADVERTISER}
select bid_id, ts > start_ts as has_started, ts > end_ts as has_ended, ts > start_ts and ts <= end_ts as is_active,
  case when ts > start_ts and ts <= end_ts then date_sub('hour', ts, end_ts) + 1 end as hours_remaining,
  case when ts > start_ts and ts <= end_ts then date_sub('hour', start_ts, ts) + 1 end as hours_evolved
from bid_log join advertisers using (advertiser)""",
    "hash_buckets": f"""with {BID_LOG}, words as (
  select 'Site_URL' || '/p/' || (bid_id % 5000)::varchar as word from bid_log
  union all select 'Site_Dom' || 'd' || (user_id % 37)::varchar from bid_log)
select (('0x' || substr(md5(word), 1, 8))::bigint % 1000)::int as bucket, count(*) as count from words group by 1""",
    "hourly_landscape": f"""with {BID_LOG}
select advertiser as "Advertiser", dayname(ts) as "Weekday", hour(ts)::int as "Hour", count(*) as "Impressions",
  sum(click)::double as "Clicks", {r("sum(paying_price)", "Spending")}, {r("avg(paying_price)", "muPrice")},
  {r("stddev_samp(paying_price)", "sigmaPrice")}, {r("var_samp(paying_price)", "varPrice")},
  max(paying_price) as "maxPrice", min(paying_price) as "minPrice",
  {", ".join(r(f"avg(case when paying_price <= {x} then 1.0::double else 0.0::double end)", f"shareLess{x}") for x in THRESHOLDS)},
  {r("count(*) / 6::double", "ImpsPerHour")}, {r("sum(click) / count(*)::double", "CTR")},
  {r("sum(paying_price) / nullif(sum(click), 0)", "CPC")}, {r("sum(paying_price) / count(*)", "CPM")}
from bid_log where impression = 1 group by 1, 2, 3""",
    "landscape_lookup": f"""with {BID_LOG}, {REQUESTS}, {LANDSCAPE}, found as (
  select r.bid_id, r.advertiser, r.weekday, r.hour, {DEFAULTED}
  from requests r left join landscape l using (advertiser, weekday, hour))
select bid_id, advertiser, weekday, hour, rate, {r("mu", "mu")}, {r("sigma", "sigma")}, {r("ctr", "ctr")} from found""",
    "landscape_lognormal": f"""with {BID_LOG}, {LANDSCAPE}
select advertiser, weekday, hour, rate, {r("mu", "mu")}, {r("sigma", "sigma")}, {r("ctr", "ctr")},
  {r(LOCATION, "location")}, {r(SCALE, "scale")}, {r("mu", "cpm")}, {r("mu / nullif(ctr, 0)", "cpc")}
from landscape""",
    "win_probability": f"""with {BID_LOG}, {REQUESTS}, {LANDSCAPE}, found as (
  select r.bid_id, r.wp_prediction, {DEFAULTED}
  from requests r left join landscape l using (advertiser, weekday, hour)),
shaped as (select bid_id, wp_prediction, {LOCATION} as location, {SCALE} as scale from found)
select bid_id, {r(win("wp_prediction"), "win_probability")} from shaped""",
    "won_landscape": f"""with {TRUE_VALUE}, {WON}, total as (
  select campaign_id, count(*) as requests, max(ts) as last_ts, count(*) filter (outcome = 'won') as wins,
    avg(pay::double) filter (outcome = 'won') as mu, stddev_samp(pay::double) filter (outcome = 'won') as sd,
    count(*) filter (outcome = 'won' and is_click) as clicks
  from seen_rows group by 1)
select campaign_id, wins, {r(f"requests / (date_sub('hour', timestamp '{START}', last_ts) + 1)::double", "rate")},
  {r("mu", "mu")},
  {r("case when wins < 2 or coalesce(sd, 0) = 0 then 1.0::double else sd end", "sigma")},
  {r("clicks / nullif(wins, 0)::double", "ctr")},
  {r("coalesce(nullif(clicks / nullif(wins, 0)::double, 0), 8e-4)", "ctr_or_guess")}
from total""",
    "won_landscape_hours": f"""with {TRUE_VALUE}, {WON}
select campaign_id, hour_ts, rate, wins, {r("mu", "mu")}, {r("sigma", "sigma")}, {r("ctr", "ctr")}, prev_rate,
  prev_wins, {r("prev_mu", "prev_mu")}, {r("prev_sigma", "prev_sigma")}, {r("prev_ctr", "prev_ctr")} from lagged""",
    "landscape_mix": f"""with {TRUE_VALUE}, {WON}, pairs as (
  select g.campaign_id, g.hour_ts, g.prev_wins, g.prev_rate, g.prev_mu, g.prev_sigma, g.prev_ctr, {DEFAULTED}
  from lagged g left join landscape l on l.advertiser = g.advertiser and l.weekday = upper(dayname(g.hour_ts))
    and l.hour = hour(g.hour_ts)),
weights as (select *, 0.8::double * rate as n1, (1 - 0.8::double) * prev_rate as n2 from pairs),
means as (select *, n1 + n2 as n, (n1 * mu + n2 * prev_mu) / nullif(n1 + n2, 0) as m from weights),
pooled as (select *, coalesce(prev_wins > 0 and n > 1, false) as usable from means)
select campaign_id, hour_ts, {r("case when usable then n else rate end", "rate")},
  {r("case when usable then m else mu end", "mu")},
  {r('''case when usable then sqrt((n1 * sigma * sigma + n2 * prev_sigma * prev_sigma + n1 * (mu - m) * (mu - m)
      + n2 * (prev_mu - m) * (prev_mu - m)) / nullif(n - 1, 0)) else sigma end''', "sigma")},
  {r("case when usable then (n1 * ctr + n2 * prev_ctr) / n else ctr end", "ctr")}
from pooled""",
    "expected_spend": f"""with {BID_LOG}, {ADVERTISER}, {LANDSCAPE}, {campaigns(["ConstantAvgValue"])}, steps as (
  select campaign_id, advertiser, bid_level, unnest(generate_series(start_ts, end_ts, interval 1 hour)) as step
  from campaigns),
cells as (
  select s.campaign_id, s.bid_level, {DEFAULTED} from steps s left join landscape l
    on l.advertiser = s.advertiser and l.weekday = upper(dayname(s.step)) and l.hour = hour(s.step)),
shaped as (select *, {LOCATION} as location, {SCALE} as scale from cells)
select campaign_id, {r(f"sum(rate * {win('bid_level')} * 40)", "expected_spend")},
  {r(f"sum(rate * {win('bid_level')} * mu)", "expected_spend_market")}
from shaped group by 1""",
    "request_value": f"""with {BID_LOG}, {REQUESTS}, {ADVERTISER}, {campaigns(["TrueValue"])}, {VALUED}
select bid_id, {r("ectr", "ectr")}, {r("private_value", "private_value")},
  {r("private_value - wp_prediction", "surplus")},
  {r("(private_value - wp_prediction) / nullif(wp_prediction, 0) - 1", "roi")} from valued""",
    "bid_constant": f"""with {BID_LOG}, {REQUESTS}, {ADVERTISER}, {campaigns(["TrueValue"])}, {VALUED}
select bid_id, 1000.0::double as bid, round(bid_level, 2) as bid_average from valued""",
    "bid_threshold": f"""with {BID_LOG}, {REQUESTS}, {ADVERTISER}, {campaigns(["TrueValue"])}, {VALUED}
select bid_id, round(case when private_value - wp_prediction >= 10 then private_value else 0 end, 2) as bid_surplus,
  round(case when (private_value - wp_prediction) / nullif(wp_prediction, 0) - 1 >= -0.5::double
    then private_value else 0 end, 2) as bid_roi from valued""",
    "bid_random": f"""with {BID_LOG}
select bid_id, round(10.0::double + 100.0::double * {unit("bid_id", 42)}, 2) as bid from bid_log""",
    "auction_outcome": f"""with {BID_LOG}, {REQUESTS}, {ADVERTISER}, {campaigns(["TrueValue"])}, {VALUED}, priced as (
  select *, round(private_value, 2) as bid from valued)
select bid_id, bid, bid > 0 and bid >= winning_price as won,
  bid > 0 and bid >= winning_price and is_click as click,
  bid > 0 and bid >= winning_price and is_conversion as conversion,
  case when not (bid > 0 and bid >= winning_price) then 0.0::double when bid >= floor_price then winning_price
    else bid end as pay
from priced""",
    "route_requests": f"""with {BID_LOG}, {REQUESTS}, {ADVERTISER}, {campaigns(["TrueValue"])}
select bid_id, campaign_id, budget::double as budget from requests join campaigns using (advertiser)""",
    "request_outcomes": f"with {TRUE_VALUE} select bid_id, campaign_id, outcome from outcomes",
    "budget_gate": f"""with {replay(["TrueValue", "ConstantAvgValue"])}
select campaign_id, bid_id, pay::double as pay from outcomes where outcome = 'won'""",
    "bid_event_log": f"""with {TRUE_VALUE}
select 'whole log' as dataset, budget_factor as "budgetFactor", campaign_id as campaign, bid_id::varchar as b_id,
  strftime(ts, '%Y%m%d%H%M%S%g') as timestamp, {r("private_value", "privateValue")}, {r("ectr", "eCTR")},
  wp_prediction as "eWP", bid, won::varchar as impression, (won and is_click)::varchar as click,
  (won and is_conversion)::varchar as conversion, pay::double as "payingPrice"
from outcomes where outcome in ('won', 'lost')""",
    "out_of_order_requests": f"""with {BID_LOG}, layouts as (
  select bid_id, ts, advertiser, bid_id as position, 'log' as layout from bid_log
  union all select bid_id, ts, advertiser, hour(ts) * 10000000 + bid_id, 'by hour' from bid_log)
select bid_id, layout from (select *, max(ts) over (partition by layout, advertiser order by position
  rows between unbounded preceding and 1 preceding) as latest from layouts) where ts < latest""",
    "campaign_kpis": kpis(["OriginalBidding", "ConstantAvgValue", "TrueValue", "RandomUpToTrueValue", "LinearBidder"]),
    "campaign_kpis_sweep": kpis(["ShadedValueBidder"], "shading,", shading=[0.0, 0.3, 0.7]),
    "campaign_kpis_staged": kpis(["TrueValue"]),
    "kpi_append": "({}) union all by name ({})".format(
        kpis(["TrueValue"], "'2024-02-01' as sysdate, 'run 1' as dataset, strategy as biddertype,"),
        kpis(["ConstantAvgValue"], "'2024-02-01' as sysdate, 'run 2' as dataset, strategy as biddertype,"),
    ),
}

ORACLE["join_prices_bucketed"] = ORACLE["join_prices"]
ORACLE["mixed_headers"] = f"""with {BID_LOG}
select bid_id::varchar as bid_id, advertiser, impression::varchar as impression,
  case when bid_id % 3 = 2 then user_id::varchar end as user_id, 'user_id' as unknown_columns from bid_log"""
ORACLE["bid_named"] = f"""with {replay(["TrueValue"])}
select bid_id, case when private_value - wp_prediction >= 0 then round(private_value, 2) else 0 end as bid_surplus,
  round(310.0::double * {unit("bid_id", 42)}, 2) as bid_random from valued"""

for _name, _key in {
    "TrueValue": "bid_value",
    "RandomUpToTrueValue": "bid_random_value",
    "ShadedValueBidder": "bid_shaded",
    "LinearBidder": "bid_linear",
}.items():
    ORACLE[_key] = f"with {replay([_name], shading=0.7)} select bid_id, bid from bids"


def ort_steps(source: str, steps: int = STEPS) -> str:
    """Bisection over the rows of ``source`` (id, kpi, lambda, location, scale, cap)."""
    gap = f"lam * {cdf('x')} - (kpi - lam * bid) / (scl * bid) * {pdf('x')}"
    return f"""steps as (
  select id, kpi, lam, loc, scl, 0.0::double as low, cap as high, cap / 2 as bid, true as running, 0 as i from {source}
  union all
  select id, kpi, lam, loc, scl, case when go and gap < 0 then bid else low end,
    case when go and not gap < 0 then bid else high end,
    case when not go then bid when gap < 0 then (bid + high) / 2 else (low + bid) / 2 end, go, i + 1
  from (select *, running and (i = 0 or abs(gap) > {TOLERANCE!r}::double * lam) as go
    from (select *, {gap} as gap from (select *, (ln(bid) - loc) / scl as x from steps where i < {steps}))))"""


ORACLE["bid_ort"] = f"""with recursive {replay(["TrueValue"], lam=0.01)}, inputs as (
  select bid_id as id, ectr as kpi, lam, {LOCATION} as loc, {SCALE} as scl, {MAX_BID}::double as cap
  from cells),
{ort_steps("inputs")}
select id as bid_id, round(case when scl > 0 then bid else 0 end, 2) as bid from steps where i = {STEPS}"""
