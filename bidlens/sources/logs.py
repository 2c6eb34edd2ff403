"""Readers for auction logs, replay inputs, landscapes and code dictionaries."""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from bidlens.sources.schemas import DICTIONARY, LANDSCAPE, REQUEST


def read_log(spark: SparkSession, path: str | list[str], sep: str = ",", columns: list[str] | None = None) -> DataFrame:
    """Headered text log, every column a string, ``NA`` read as null; path may be a glob.

    With ``columns`` (the header, in file order) no file is opened before the job runs. A file with
    another header is an error.
    """
    reader = spark.read.option("header", True).option("nullValue", "NA").option("sep", sep).option("enforceSchema", False)
    if columns:
        reader = reader.schema(StructType([StructField(c, StringType()) for c in columns]))
    return reader.csv(path)


def file_headers(spark: SparkSession, path: str | list[str], sep: str = ",") -> DataFrame:
    """(file, line) of every file that has a header line, read in one job.

    The first line of a file is the first row of its first block; other blocks pass nothing on.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row"),
    )
    first = lines.filter("start = 0").groupBy("file").agg(F.min_by("value", "row").alias("line"))
    return first.filter("line <> ''").select("file", "line")


def read_mixed_logs(
    spark: SparkSession, path: str | list[str], sep: str = ",", expected: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Headered text logs whose files may differ in their columns, united by name, and a report of columns.

    Files with one header line are one read; a column that a file lacks is null there. Columns come in the order of
    ``expected``, then others by name. The report has (column, files, expected): in how many files each column is,
    and whether it was expected (null if nothing was); expected columns of no file are listed with 0 files. The
    driver holds one line per file, as a reader of a list of files does.
    """
    found: dict[str, list[str]] = {}
    for r in file_headers(spark, path, sep).collect():
        found.setdefault(r["line"], []).append(r["file"])
    parts, counts = [], {}
    for line in sorted(found):
        # The header option names the columns; a repeated name would be renamed, so it is an error.
        part = spark.read.option("header", True).option("sep", sep).option("nullValue", "NA").csv(sorted(found[line]))
        names = next(csv.reader([line], delimiter=sep))
        if len(set(names)) < len(names):
            raise ValueError(f"a column is named twice: {line}")
        for n in names:
            counts[n] = counts.get(n, 0) + len(found[line])
        parts.append(part.select(*[F.col(f"`{n}`").cast("string").alias(n) for n in names]))
    order = list(dict.fromkeys([*(expected or []), *sorted(counts)]))
    rows = [(n, counts.get(n, 0), None if expected is None else n in expected) for n in order]
    report = spark.createDataFrame(rows, "column string, files long, expected boolean")
    if not parts:
        return spark.createDataFrame([], StructType([StructField(n, StringType()) for n in order])), report
    log = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    missing = {n: F.lit(None).cast("string") for n in order if n not in counts}
    return log.withColumns(missing).select(*[F.col(f"`{n}`") for n in order]), report


def read_requests(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The 16 positional, typed columns of replay input; a malformed row is an error."""
    return (
        spark.read.schema(REQUEST)
        .option("header", True)
        .option("enforceSchema", True)
        .option("mode", "FAILFAST")
        .option("nullValue", "NA")
        .csv(path)
    )


def read_landscape(spark: SparkSession, path: str) -> DataFrame:
    """A stored hourly landscape in the form the lookups use; a malformed row is an error."""
    stored = spark.read.schema(LANDSCAPE).option("header", True).option("mode", "FAILFAST").option("nullValue", "NA").csv(path)
    return landscape_cells(stored)


def landscape_cells(hourly: DataFrame) -> DataFrame:
    """The seven lookup columns of an hourly landscape, weekday in upper case.

    A cell listed twice counts once: rows with mean and deviation go before others, then the least by value.
    """
    cells = hourly.select(
        F.col("Advertiser").alias("advertiser"),
        F.upper("Weekday").alias("weekday"),
        F.col("Hour").cast("int").alias("hour"),
        F.col("Impressions").cast("double").alias("rate"),
        F.col("muPrice").alias("mu"),
        F.col("sigmaPrice").alias("sigma"),
        F.col("CTR").alias("ctr"),
    )
    unknown = (F.col("mu").isNull() | F.col("sigma").isNull()).alias("unknown")
    one = cells.groupBy("advertiser", "weekday", "hour").agg(F.min(F.struct(unknown, "rate", "mu", "sigma", "ctr")).alias("cell"))
    return one.select("advertiser", "weekday", "hour", *[F.col(f"cell.{c}") for c in ("rate", "mu", "sigma", "ctr")])


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Code and name, tab separated, no header; a malformed row is an error."""
    return spark.read.schema(DICTIONARY).option("sep", "\t").option("mode", "FAILFAST").csv(path)


def with_file_name(df: DataFrame) -> DataFrame:
    """Add the source file of every row; replaces a loop over the files of a folder."""
    return df.withColumn("file_name", F.col("_metadata.file_name"))


def rows_per_file(df: DataFrame) -> DataFrame:
    return df.groupBy("file_name").agg(F.count("*").alias("nrow"))
