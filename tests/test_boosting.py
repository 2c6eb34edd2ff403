import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import functions as F

from bidlens.operators import boosting, models
from bidlens.operators.models import fit_price_model
from bidlens.session import fresh_path


def made(spark, n=600, seed=5):
    """Rows of 60 features, most of them zero: whole and negative numbers, flags, one that is constant, sparse and dense vectors."""
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 3, (n, 60)) * (rng.random((n, 60)) < 0.1)
    x[:, 0], x[:, 1], x[:, 2] = rng.integers(-40, 40, n), rng.integers(0, 25, n), 3
    y = x[:, 0] + 5 * (x[:, 1] > 12) + 20 * (x[:, 7] > 0) + rng.integers(0, 1000, n) / 100
    sparse = [Vectors.sparse(60, np.flatnonzero(r).tolist(), r[r != 0].astype(float).tolist()) for r in x]
    rows = [(Vectors.dense(v.toArray()) if i % 3 == 0 else v, float(p)) for i, (v, p) in enumerate(zip(sparse, y))]
    return spark.createDataFrame(rows, ["features", "PayingPrice"]).repartition(3)


def test_sparse_trees_are_those_of_spark(spark, monkeypatch):
    train = made(spark)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 64)
    monkeypatch.setattr(boosting, "PIECE_ROWS", 16)
    monkeypatch.setattr(GBTRegressor, "_fit_java", lambda *_: pytest.fail("rows were given to the learner that keeps a number per feature"), raising=False)
    monkeypatch.setattr(models, "PART_BYTES", 1000)
    model = fit_price_model(train, "gbt")
    monkeypatch.undo()
    want = GBTRegressor(maxIter=10, seed=42, featuresCol="features", labelCol="PayingPrice", predictionCol="WpPrediction").fit(train)
    assert model.getNumTrees == want.getNumTrees == 10 and model.treeWeights == want.treeWeights and model.numFeatures == 60
    both = model.transform(train).withColumnRenamed("WpPrediction", "found")
    apart = want.transform(both).select(F.max(F.abs(F.col("found") - F.col("WpPrediction")))).first()[0]
    assert apart < 1e-6
    # Of splits that part the rows of a node alike either learner may take another.
    assert np.allclose(model.featureImportances.toArray(), want.featureImportances.toArray(), atol=5e-3)
    path = fresh_path(spark, "boosted")
    model.write().overwrite().save(path)
    assert GBTRegressionModel.load(path).transform(train).select("WpPrediction").collect() == model.transform(train).select("WpPrediction").collect()


def test_blocks_hold_few_rows_and_only_entries_that_are_not_zero(spark, monkeypatch):
    train = made(spark)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 64)
    monkeypatch.setattr(boosting, "PIECE_ROWS", 16)
    bins = boosting.fitted_bins(train, 60, 600, set(), 32, 42)
    blocks = boosting.stored_blocks(train, bins).select((F.length("labels") / 8).alias("n"), (F.length("rows") / 2).alias("entries")).collect()
    assert sum(b.n for b in blocks) == 600 and max(b.n for b in blocks) <= 64
    # A tenth of 57 features, two that are seldom zero, and none of the one that is constant.
    assert sum(b.entries for b in blocks) < 10 * 600


def test_rows_without_entries_and_labels_that_do_not_differ(spark, monkeypatch):
    monkeypatch.setattr(models, "PART_BYTES", 0)
    same = [(Vectors.sparse(3, [1], [2.0]), float(i)) for i in range(9)]
    alike = [(Vectors.dense([float(i), 0.0, 1.0]), 4.0) for i in range(9)]
    for rows in (same, alike):
        train = spark.createDataFrame(rows, ["features", "PayingPrice"]).coalesce(1)
        assert {r.WpPrediction for r in fit_price_model(train, "gbt").transform(train).collect()} == {4.0}


def test_pairs_have_one_threshold_and_rows_must_be_whole(spark):
    train = made(spark, 40)
    bins = boosting.fitted_bins(train, 60, 40, {9}, 32, 42)
    assert bins.thresholds[bins.starts[9] : bins.starts[10]].tolist() == [0.5]
    lost = train.withColumn("PayingPrice", F.when(F.col("PayingPrice") > 0, F.col("PayingPrice")))
    with pytest.raises(Exception, match="must not be null"):
        boosting.stored_blocks(lost.union(spark.createDataFrame([(Vectors.dense([0.0] * 60), None)], lost.schema)), bins)
    # Many values: thresholds part them evenly, zeros among them.
    found = boosting.thresholds(np.arange(1.0, 901.0), np.ones(900), 1000, 9)
    assert len(found) == 9 and found[0] == 0.5 and 95 < np.diff(found).min() <= np.diff(found).max() < 105
