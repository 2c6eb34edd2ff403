"""DuckDB SQL for the queries of labels, tuning and streams."""

from __future__ import annotations

from bidlens.plans.calibration import AVERAGE_BID_SHARE, LINEAR_RANGE, SHADING_RANGE, SPEND_STEPS
from bidlens.suite.oracle import (
    BID_LOG,
    CODED,
    DEFAULTED,
    LOCATION,
    ORACLE,
    SCALE,
    WON,
    r,
    replay,
    unit,
    win,
)
from bidlens.suite.tables import TRAIN_END

SEGMENTS = f"""with {BID_LOG}, {CODED}, labels as (
  select c_mktsegment as segment, row_number() over (order by count(*) desc, c_mktsegment) - 1 as index
  from coded where ts < timestamp '{TRAIN_END}' and c_mktsegment <> 'MACHINERY' group by 1)"""


def running() -> str:
    """Campaigns of the true value bidder after ten hours, and their hours left as a list."""
    return f"""{replay(["TrueValue"], shading=0.5, lam=0.001)}, {WON}, totals as (
  select campaign_id, sum(pay)::double as spend, count(*) filter (won) as wins,
    count(*) filter (won and is_click) as clicks
  from seen_rows where ts <= start_ts + interval 10 hour group by 1),
going as (
  select c.*, coalesce(t.spend, 0::double) as spend, coalesce(t.wins, 0) as wins, coalesce(t.clicks, 0) as clicks,
    c.start_ts + interval 10 hour as now
  from campaigns c left join totals t using (campaign_id)),
left_hours as (select campaign_id, advertiser, unnest(generate_series(now, end_ts, interval 1 hour)) as step from going),
left_cells as (
  select h.campaign_id, h.step, {DEFAULTED} from left_hours h left join landscape l
    on l.advertiser = h.advertiser and l.weekday = upper(dayname(h.step)) and l.hour = hour(h.step)),
lists as (
  select campaign_id, list(struct_pack(rate := rate, location := {LOCATION}, scale := {SCALE}) order by step) as cells
  from left_cells group by 1),
source as (
  select campaign_id, cells, spend / nullif(wins, 0) as cost, budget::double - spend as target, bid_level, shading, lam,
    click_value * {AVERAGE_BID_SHARE}::double * coalesce(nullif(clicks / nullif(wins, 0)::double, 0), 8e-4) as mean_bid,
    case when clicks > 0 and spend > 0 then clicks / spend else lam end as past_cpc
  from going join lists using (campaign_id))"""


def bisection(start: str, level: str, limits: tuple[float, float], rises: bool, tolerance: float) -> str:
    win_sum = f"list_sum(list_transform(cells, lambda c: c.rate * {win('lvl', 'c.location', 'c.scale')})) * cost"
    columns = "campaign_id, cells, cost, target, mean_bid"
    return f"""steps as (
  select {columns}, x, {limits[0]}::double as low, {limits[1]}::double as high, {win_sum} as spend, 0 as i
  from (select *, {level} as lvl from (select *, {start} as x from source))
  union all
  select {columns}, x, low, high, {win_sum}, i + 1
  from (select *, {level} as lvl from (
    select {columns}, i, low, high, (low + high) / 2 as x from (
      select {columns}, i, case when up then x else low end as low, case when up then high else x end as high from (
        select *, {'' if rises else 'not'} (spend < target) as up from steps
        where i < {SPEND_STEPS} and cost is not null and (i = 0 or abs(spend - target) > {tolerance})))))
)"""


STREAMED = replay(["TrueValue", "ConstantAvgValue"])

HOURLY = f"""date_trunc('hour', ts) as hour_ts, advertiser, count(*) as requests, sum(impression)::bigint as impressions,
  coalesce(sum(click) filter (impression = 1), 0)::bigint as clicks,
  {r("sum(paying_price) filter (impression = 1)", "spending")}, {r("avg(paying_price) filter (impression = 1)", "mu")},
  {r("stddev_samp(paying_price) filter (impression = 1)", "sigma")}"""

MODEL_ORACLE = {
    "label_index": f"""with {BID_LOG}, words as (
  select bid_id::varchar as "Bid_id", 'v' || (user_id % 7)::varchar as "UA_os_ver" from bid_log),
labels as (select "UA_os_ver", (row_number() over (order by count(*) desc, "UA_os_ver") - 1)::double as index
  from words group by 1)
select "Bid_id", "UA_os_ver", index from words join labels using ("UA_os_ver")""",
    "label_index_unseen": f"""{SEGMENTS}
select bid_id::varchar as "Bid_id", coalesce(l.segment, 'NA') as segment,
  coalesce(l.index, (select count(*) from labels))::double as index
from coded left join labels l on c_mktsegment = l.segment""",
    "label_index_skip": f"""{SEGMENTS}
select bid_id::varchar as "Bid_id", segment, index::double as index
from coded join labels on c_mktsegment = segment""",
    "index_to_label": f"""{SEGMENTS}
select bid_id::varchar as "Bid_id", segment, index::double as index, segment as name
from coded join labels on c_mktsegment = segment""",
    "score_requests": ORACLE["typed_requests"].replace('wp_prediction as "WpPrediction"', "true as scored"),
    "calibrate_linear": f"""with recursive {running()},
{bisection("bid_level", "x", LINEAR_RANGE, True, 10.0)}
select campaign_id, {r("arg_max(x, i)", "baseline")} from steps group by 1""",
    "bid_pacing": f"""with recursive {running()},
{bisection("bid_level", "x", LINEAR_RANGE, True, 10.0)},
tuned as (select campaign_id, arg_max(x, i) as baseline from steps group by 1),
asked as (
  select g.campaign_id, q.bid_id, baseline,
    case when ctr_prediction > 0 then least(ctr_prediction / ectr_factor, 1.0::double) else 0.0::double end as ectr,
    case when l.mu is not null and l.sigma is not null then coalesce(l.ctr, 0.0::double) else 8e-4 end as ctr
  from going g join tuned using (campaign_id)
  join requests q on q.advertiser = g.advertiser and q.ts > g.now and q.ts <= g.end_ts
  left join landscape l on l.advertiser = q.advertiser and l.weekday = q.weekday and l.hour = q.hour)
select campaign_id, bid_id, {r("coalesce(baseline * ectr / nullif(ctr, 0), 0)", "exact")}, true as near from asked""",
    "winning_price_optimality": f"""with {BID_LOG}, train as (
  select count(*) as n from bid_log where impression = 1 and {unit("bid_id", 42)} < 0.7::double)
select kind, true as holds, n::bigint as rows from train, (values ('intercept'), ('zero'), ('nonzero')) k(kind)""",
    "calibrate_shading": f"""with recursive {running()},
{bisection("shading", "(mean_bid / (x + 1))", SHADING_RANGE, False, 1.0)}
select campaign_id, {r("arg_max(x, i)", "shading")} from steps group by 1""",
    "calibrate_ort_past_cpc": f"""with {running()}
select campaign_id, {r("past_cpc * 1e6", "past_cpc")} from source""",
    "stream_hourly_landscape": f"""with {BID_LOG}
select {HOURLY}
from bid_log group by 1, 2""",
    "stream_late_requests": f"""with {BID_LOG},
clocks as (select advertiser, max(ts) as clock from bid_log where bid_id % 97 <> 0 group by 1),
marked as (
  select b.*, bid_id % 97 = 0 and date_trunc('hour', ts) + interval 2 hour <= clock as late
  from bid_log b join clocks using (advertiser))
select 'window' as kind, {HOURLY}
from marked where not late group by 2, 3
union all
select 'late', date_trunc('hour', ts), advertiser, count(*), sum(impression)::bigint,
  coalesce(sum(click) filter (impression = 1), 0)::bigint, null, null, null
from marked where late group by 2, 3""",
    "stream_auction_outcome": f"""with {STREAMED}
select bid_id, strategy, bid, pay::double as pay,
  case when not open then 'missed' when not bidding then 'passed' when won then 'won' else 'lost' end as outcome
from offers""",
}
