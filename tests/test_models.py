import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from bidlens.operators.features import (
    assemble_prefix,
    feature_pipeline,
    fill_categories,
    label_index,
    labels_of,
)
from bidlens.operators import models
from bidlens.operators.models import fit_price_model, regressor, rmse
from bidlens.session import fresh_path
from bidlens.suite.model_queries import training_log


def test_labels_by_frequency_then_name(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",)], "x string")
    labels = labels_of(df, "x")
    assert [(r.label, r["index"]) for r in labels.orderBy("index").collect()] == [("c", 0.0), ("a", 1.0), ("b", 2.0)]
    new = spark.createDataFrame([("c",), ("z",), (None,)], "x string")
    assert sorted((r.x, r["index"]) for r in label_index(new, "x", labels, "keep").collect()) == [("NA", 3.0), ("NA", 3.0), ("c", 0.0)]
    assert label_index(new, "x", labels, "skip").count() == 1
    with pytest.raises(Exception, match="unseen label"):
        label_index(new, "x", labels).collect()


@pytest.fixture(scope="module")
def fitted(spark, data):
    log = fill_categories(training_log(spark, data))
    return log, feature_pipeline().fit(log)


def test_feature_vector_parts(spark, fitted):
    log, model = fitted
    row = model.transform(log).select("FT_num", "FT_hashed", "FT_ut", "FT_Weekday", "FT_City", "features").first()
    assert (row.FT_num.size, row.FT_hashed.size, row.FT_ut.size, row.FT_Weekday.size) == (7, 1000, 43, 6)
    assert row.features.size > 1000 + 43 + 7
    with pytest.raises(ValueError):
        assemble_prefix(model.transform(log))


def test_unseen_category_has_an_empty_code(spark, fitted):
    log, model = fitted
    odd = model.transform(log.limit(1).withColumn("City", F.lit("Atlantis"))).first()
    assert odd.FT_City.numNonzeros() == 0


def test_stored_pipeline_gives_the_same(spark, fitted):
    log, model = fitted
    path = fresh_path(spark, "pipe")
    model.write().overwrite().save(path)
    a, b = (m.transform(log).select("Bid_id", "features").orderBy("Bid_id").limit(20).collect() for m in (model, PipelineModel.load(path)))
    assert a == b


def test_linear_model_learns(spark, fitted):
    log, features = fitted
    train = features.transform(log.withColumn("PayingPrice", F.col("AdSlotFloorPrice") * 2)).select("features", "PayingPrice")
    model = fit_price_model(train)
    assert rmse(model.transform(train)) < 10 and model.coefficients.numNonzeros() > 0
    with pytest.raises(ValueError):
        regressor("net")


class Counting:
    """A learner that tells the rows of each partition it is given."""

    def fit(self, train):
        return sorted(r[1] for r in train.groupBy(F.spark_partition_id()).agg(F.count("*")).collect())


@pytest.mark.parametrize("kind", ["gbt", "rf"])
def test_trees_get_partitions_of_bounded_size(spark, monkeypatch, kind):
    monkeypatch.setattr(models, "regressor", lambda kind: Counting())
    rows = [(Vectors.sparse(1000, [i % 1000], [1.0]), float(i % 7)) for i in range(1200)]
    train = spark.createDataFrame(rows, ["features", "PayingPrice"]).coalesce(1)
    # All rows fit one partition, and stay in it.
    assert fit_price_model(train, kind) == [1200]
    # Binned, a row takes four bytes for each of 1000 features: 100 rows a partition.
    monkeypatch.setattr(models, "PART_BYTES", 400_000)
    sizes = fit_price_model(train, kind)
    assert sum(sizes) == 1200 and 90 <= sizes[0] and sizes[-1] <= 110


@pytest.mark.parametrize("kind", ["gbt", "rf"])
def test_trees_learn_over_several_partitions(spark, monkeypatch, kind):
    rows = [(Vectors.dense([float(i % 10), float(i % 3)]), float(i % 10)) for i in range(300)]
    train = spark.createDataFrame(rows, ["features", "PayingPrice"]).coalesce(1)
    monkeypatch.setattr(models, "PART_BYTES", 800)
    assert rmse(fit_price_model(train, kind).transform(train)) < 1.5
