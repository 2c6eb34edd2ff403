"""A global rank without one task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidlens.session import materialize

# Bits of a generated row number below the number of its partition.
ROW_BITS = 33


def with_rank(df: DataFrame, order: Sequence[Column | str], name: str = "rank") -> DataFrame:
    """``df`` with the position of every row, from 0, in a total order of its rows.

    A range sort deals rows to ordered partitions; a row's position is its number in its partition plus the rows of
    all partitions before, which are counted with one row per partition. The order must leave no ties, or a
    repeated task could number them otherwise.
    """
    numbered = materialize(df.orderBy(*order).withColumn("_row", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_row", ROW_BITS)
    sizes = sorted(numbered.groupBy(part.alias("part")).count().collect())
    starts, before = [], 0
    for p, n in sizes:
        starts.append((p, before))
        before += n
    offsets = df.sparkSession.createDataFrame(starts, "_part long, _before long")
    inside = F.col("_row").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    # One row per partition of the sort, so small at any size of the table.
    placed = numbered.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return placed.withColumn(name, F.col("_before") + inside).drop("_part", "_before", "_row")
