"""Writers. Every writer keeps the partitions of its input: no single-task output."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_log(df: DataFrame, path: str, mode: str = "errorifexists", sep: str = ",") -> None:
    """Headered text with null written as ``NA``; by default an existing path is an error."""
    df.write.mode(mode).option("header", True).option("nullValue", "NA").option("sep", sep).csv(path)


# Columns that name a run in a table of all runs.
RUN = ["sysdate", "dataset"]


def append_kpis(kpis: DataFrame, path: str, run: Sequence[str] = RUN) -> None:
    """Add the KPI rows of a run to a table that collects all runs, in a folder of its own.

    A run written again, after a failure or by mistake, replaces its own rows and no others: only the partitions
    that the rows have are overwritten. Rows that name no run have nothing to tell a repetition by, and are
    plainly appended.
    """
    run = [c for c in run if c in kpis.columns]
    if not run:
        kpis.write.mode("append").parquet(path)
        return
    kpis.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*run).parquet(path)


def read_kpis(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table of all runs, with columns in the order and of the types of ``like``."""
    return spark.read.schema(like.schema).parquet(path).select(*like.columns)


def write_events(events: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Detailed bid events, one folder per campaign.

    REBALANCE gathers each campaign's rows into few files and splits a campaign that is too
    big for one task.
    """
    events.hint("rebalance", "campaign").write.mode(mode).partitionBy("campaign").option(
        "header", True
    ).option("nullValue", "NA").csv(path)


def write_row_counts(counts: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """``file<TAB>nrow`` lines with a header."""
    lines = counts.selectExpr("file_name as file", "nrow")
    write_log(lines, path, mode, sep="\t")


def append_row_counts(counts: DataFrame, path: str, run: str) -> None:
    """Row counts of a run next to those of others; the same run written again replaces its own lines."""
    lines = counts.selectExpr("file_name as file", "nrow").withColumn("run", F.lit(run))
    lines.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").option("header", True).option(
        "nullValue", "NA"
    ).option("sep", "\t").csv(path)


def write_report(text: DataFrame, path: str, mode: str = "errorifexists") -> None:
    text.select("report").write.mode(mode).text(path)


def stage_requests(requests: DataFrame, path: str) -> DataFrame:
    """Store requests partitioned by the hour of ``ts`` and read them back.

    Jobs that join on ``hour_ts`` then prune to the hours they need. A hot hour is split over
    several tasks and files.
    """
    spark = requests.sparkSession
    requests.hint("rebalance", "hour_ts").write.partitionBy("hour_ts").parquet(path)
    return spark.read.schema(requests.schema).parquet(path)
