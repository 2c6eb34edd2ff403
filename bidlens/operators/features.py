"""Features of the winning-price model, and label indices as plain tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import FeatureHasher, IndexToString, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidlens.operators.missing import FillMissing
from bidlens.operators.prep import TAG_COLUMNS
from bidlens.operators.ranking import with_rank
from bidlens.session import broadcast_if_small, materialize

# Columns of the training log by kind of feature. No new value may appear in a
# safe category after training; in an unsafe one it counts as NA.
NUMERIC = ["City_Pop", "City_Lat", "City_Long", "AdSlotW", "AdSlotH", "AdSlotSize", "AdSlotFloorPrice"]
SAFE = ["Weekday", "Hour", "AdEx", "AdSlotVis", "AdSlotFormat", "Advertiser", "UA_os_type"]
UNSAFE = [
    "UA_os_fam",
    "UA_os_ver",
    "UA_br_fam",
    "UA_br_ver",
    "UA_dev_fam",
    "UA_dev_brand",
    "UA_dev_mod",
    "Region",
    "City",
]
HASHED, BUCKETS = ["Site_URL", "Site_Dom"], 1000


def fill_categories(
    df: DataFrame,
    safe: Sequence[str] = SAFE,
    unsafe: Sequence[str] = UNSAFE,
    hashed: Sequence[str] = HASHED,
) -> DataFrame:
    """Categories as strings. A missing one is the label NA where it is safe or hashed. Where it
    is unsafe, NA becomes null, which the indexer leaves out of its labels and puts last."""
    named = {c: F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in [*safe, *hashed]}
    return df.withColumns(named | {c: F.nullif(F.col(c).cast("string"), F.lit("NA")) for c in unsafe})


def indexer(columns: Sequence[str], unseen: str) -> StringIndexer:
    """Index by falling frequency for several columns in one job. ``unseen`` is error, skip or
    keep; keep gives unseen and missing labels the last index."""
    return StringIndexer(
        inputCols=list(columns),
        outputCols=[f"ID_{c}" for c in columns],
        handleInvalid=unseen,
        stringOrderType="frequencyDesc",
    )


def feature_pipeline(
    numeric: Sequence[str] = NUMERIC,
    safe: Sequence[str] = SAFE,
    unsafe: Sequence[str] = UNSAFE,
    hashed: Sequence[str] = HASHED,
    tags: Sequence[str] = TAG_COLUMNS,
    buckets: int = BUCKETS,
) -> Pipeline:
    """Numeric, hashed, indexed and one-hot encoded columns and tags, as one vector. The input
    has passed ``fill_categories``. A missing number is its mean in training, a missing tag is not set."""
    coded = [*safe, *unsafe]
    parts = ["FT_num", "FT_hashed", *[f"FT_{c}" for c in coded], "FT_ut"]
    return Pipeline(
        stages=[
            FillMissing(inputCols=list(numeric)),
            FillMissing(inputCols=list(tags), strategy="zero"),
            VectorAssembler(inputCols=list(numeric), outputCol="FT_num"),
            FeatureHasher(inputCols=list(hashed), outputCol="FT_hashed", numFeatures=buckets),
            indexer(safe, "error"),
            indexer(unsafe, "keep"),
            OneHotEncoder(inputCols=[f"ID_{c}" for c in coded], outputCols=[f"FT_{c}" for c in coded]),
            VectorAssembler(inputCols=list(tags), outputCol="FT_ut"),
            VectorAssembler(inputCols=parts, outputCol="features"),
        ]
    )


def assemble_prefix(df: DataFrame, prefix: str = "FT_", output: str = "features") -> DataFrame:
    """All columns with a prefix as one vector; an existing output column is an error."""
    if output in df.columns:
        raise ValueError(f"output column {output} already exists")
    parts = [c for c in df.columns if c.startswith(prefix)]
    return VectorAssembler(inputCols=parts, outputCol=output).transform(df)


def labels_of(df: DataFrame, column: str) -> DataFrame:
    """Labels by falling frequency, ties by name, with their index from 0; null counts as ``NA``."""
    counts = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("NA")).alias("label")).count()
    ranked = with_rank(counts, [F.desc("count"), "label"], "index")
    return ranked.select("label", "count", F.col("index").cast("double").alias("index"))


def label_index(df: DataFrame, column: str, labels: DataFrame, unseen: str = "error") -> DataFrame:
    """Index of every row's label. A label that is not listed is an error, is skipped, or is
    rewritten to NA and given the last index (``keep``, where a trained NA has the last index too)."""
    labels = labels.select("label", "index")
    if unseen == "keep":
        missing = labels.filter("label = 'NA'").agg(F.max("index").alias("_missing"))
        known = labels.filter("label <> 'NA'").join(F.broadcast(missing))
        after = F.coalesce((F.col("index") > F.col("_missing")).cast("double"), F.lit(0.0))
        labels = known.select("label", (F.col("index") - after).alias("index"))
    labels = broadcast_if_small(materialize(labels))
    text = F.coalesce(F.col(column).cast("string"), F.lit("NA"))
    keyed = df.withColumn("_label", text)
    how = "inner" if unseen == "skip" else "left"
    joined = keyed.join(labels.withColumnRenamed("label", "_label"), "_label", how)
    if unseen == "keep":
        last = labels.agg(F.count("*").cast("double").alias("_last"))
        joined = joined.join(F.broadcast(last)).withColumn(
            column, F.when(F.col("index").isNull(), F.lit("NA")).otherwise(F.col("_label"))
        )
        joined = joined.withColumn("index", F.coalesce("index", "_last")).drop("_last")
    elif unseen == "error":
        unknown = F.raise_error(F.concat(F.lit("unseen label: "), F.col("_label"))).cast("double")
        joined = joined.withColumn("index", F.coalesce("index", unknown))
    return joined.drop("_label")


def label_names(index_column: str, labels: list[str], output: str) -> IndexToString:
    """Back from an index to its label; an index without a label is an error."""
    return IndexToString(inputCol=index_column, outputCol=output, labels=labels)
