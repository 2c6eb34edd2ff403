import math

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries

TABLES = ["region", "nation", "customer", "events"]
CHECKED = """hourly_landscape landscape_lookup landscape_lognormal win_probability parse_timestamps adjacent_hours
    hour_spine campaign_status map_slot_codes bid_requests request_value bid_linear bid_ort bid_random
    auction_outcome budget_gate campaign_kpis campaign_kpis_sweep landscape_mix expected_spend calibrate_linear calibrate_shading calibrate_ort_past_cpc
    stream_hourly_landscape stream_auction_outcome label_index_unseen""".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{data}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return str(value)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, data, duck, name):
    df = queries()[name](spark, data)
    columns = sorted(df.columns)
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    found = duck.execute(oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    theirs = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert ours == theirs


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
