"""Hourly statistics of a request stream that lose no row: late ones are counted, and open hours can be closed."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# The functions below travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

HOUR = 3_600_000_000
# A time after all others: its mark closes every hour.
END_OF_STREAM = 2**62
EPOCH = "1970-01-01"

PARTIAL = "advertiser string, hour long, latest long, requests long, impressions long, clicks long, priced long, spending double, mu double, squares double"
STATE = "clock long, hours string"
RESULT = "kind string, advertiser string, hour long, requests long, impressions long, clicks long, spending double, mu double, sigma double"
COUNTS = ["requests", "impressions", "clicks"]


def _merged(a: list[float] | None, b: list[float]) -> list[float]:
    """Counts (the last: known prices), spending, mean price and squared distances from it, of two disjoint sets of requests."""
    if a is None:
        return list(b)
    n = a[3] + b[3]
    sums = [x + y for x, y in zip(a[:5], b[:5])]
    if not (a[3] and b[3]):
        return sums + (a[5:] if a[3] else b[5:])
    apart = b[5] - a[5]
    return [*sums, a[5] + apart * b[3] / n, a[6] + b[6] + apart * apart * a[3] * b[3] / n]


def _partials(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Requests of a batch by advertiser and hour, so that a hot advertiser sends few rows to its state."""
    for batch in batches:
        won = batch["impression"] == 1
        price = batch["paying_price"].where(won)
        click = batch["click"].where(won, 0)
        made = pd.DataFrame({"advertiser": batch["advertiser"], "hour": batch["us"] // HOUR * HOUR, "us": batch["us"], "won": won, "click": click, "price": price})
        groups = made.groupby(["advertiser", "hour"], dropna=False, sort=True)
        out = groups.agg(latest=("us", "max"), requests=("us", "size"), impressions=("won", "sum"), clicks=("click", "sum"), priced=("price", "count"), spending=("price", "sum"), mu=("price", "mean"), spread=("price", lambda x: x.var(ddof=0))).reset_index()
        out["squares"] = (out["spread"] * out["priced"]).fillna(0.0)
        yield out.fillna({"mu": 0.0}).drop(columns="spread").astype({"impressions": "int64", "clicks": "int64"})


def _advance(lateness: int):
    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        clock, text = state.get if state.exists else (None, "{}")
        hours = {int(h): v for h, v in json.loads(text).items()}
        closed = None if clock is None else clock - lateness
        late: dict[int, list[int]] = {}
        for batch in batches:
            for row in batch.itertuples(index=False):
                clock = row.latest if clock is None else max(clock, row.latest)
                if not row.requests:
                    continue
                values = [int(row.requests), int(row.impressions), int(row.clicks), int(row.priced), float(row.spending), float(row.mu), float(row.squares)]
                if closed is not None and row.hour + HOUR <= closed:
                    late[row.hour] = [a + b for a, b in zip(late.get(row.hour, [0, 0, 0]), values[:3])]
                else:
                    hours[row.hour] = _merged(hours.get(row.hour), values)
        rows = [("late", key[0], h, *late[h], None, None, None) for h in sorted(late)]
        for h in sorted(hours):
            if h + HOUR <= clock - lateness:
                requests, won, clicks, priced, spending, mu, squares = hours.pop(h)
                sigma = float(np.sqrt(squares / (priced - 1))) if priced > 1 else None
                rows.append(("window", key[0], h, requests, won, clicks, spending if priced else None, mu if priced else None, sigma))
        state.update((int(clock), json.dumps(hours)))
        names = [c.split()[0] for c in RESULT.split(", ")]
        made = pd.DataFrame(rows, columns=names)
        yield made.astype({"spending": "float64", "mu": "float64", "sigma": "float64"})

    return advance


def stream_windows(log: DataFrame, marks: DataFrame | None = None, lateness_hours: int = 1) -> DataFrame:
    """Statistics per advertiser and hour of a stream of ``log`` rows, as rows of two kinds.

    ``window``: an hour that is closed, given out once. An hour closes when its advertiser's clock, its latest request
    so far, is ``lateness_hours`` past the hour's end. ``late``: how many requests came after their hour was closed, per
    batch of the stream; they are in no window. So every request is in exactly one row once all hours are closed, which a
    mark (advertiser) in the stream ``marks`` does for its advertiser: see ``end_marks``. Requests without time are
    left out. The state of an advertiser is its clock and its open hours, a few numbers each.
    """
    since = F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'{EPOCH}', ts)")
    rows = log.filter("ts is not null").select("advertiser", since.alias("us"), "impression", "click", F.col("paying_price").cast("double").alias("paying_price"))
    parts = rows.mapInPandas(_partials, PARTIAL)
    if marks is not None:
        zero = [F.lit(0).cast(t).alias(n) for n, t in (c.split() for c in PARTIAL.split(", ")[3:])]
        parts = parts.unionByName(marks.select("advertiser", F.lit(0).cast("long").alias("hour"), F.lit(END_OF_STREAM).alias("latest"), *zero))
    found = parts.groupBy("advertiser").applyInPandasWithState(
        _advance(lateness_hours * HOUR), RESULT, STATE, "append", GroupStateTimeout.NoTimeout
    )
    hour = F.expr(f"timestampadd(MICROSECOND, hour, timestamp_ntz'{EPOCH}')")
    return found.select("kind", "advertiser", hour.alias("hour_ts"), *COUNTS, "spending", "mu", "sigma")


def end_marks(advertisers: DataFrame, path: str) -> None:
    """Put a mark for every advertiser into the folder that the stream ``marks`` reads; none with an empty table."""
    advertisers.select("advertiser").write.mode("append").parquet(path)
