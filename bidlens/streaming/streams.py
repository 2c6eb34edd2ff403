"""The stateless auction on a stream of requests, and how streams are run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bidlens.operators.auction import outcome, route, with_auction, with_value
from bidlens.operators.strategies import bid_by_strategy


def stream_auctions(requests: DataFrame, campaigns: DataFrame, strategies: list[str]) -> DataFrame:
    """Bid and auction outcome of every request of a stream, before any budget.

    The campaigns are a static table; give them through ``broadcast_if_small``.
    """
    valued = with_value(route(requests, campaigns))
    bids = with_auction(valued.withColumn("bid", bid_by_strategy(strategies)))
    return bids.withColumn("seen", F.lit(True)).withColumn("outcome", outcome())


def run_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what is there, append it to files exactly once, and stop. Started again with the
    same paths it goes on where it stopped."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()
    return query
