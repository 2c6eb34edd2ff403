"""Models of the winning price."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Model, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.regression import LinearRegression, LinearRegressionModel, RandomForestRegressor
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidlens.operators.boosting import SparseGBT
from bidlens.operators.features import fill_categories
from bidlens.sources.schemas import REQUEST_COLUMNS

LABEL, PREDICTION = "PayingPrice", "WpPrediction"
# Tree learners keep four bytes per feature and row; a partition holds at most about so many bytes of them.
PART_BYTES = 64 * 2**20


def regressor(kind: str):
    """Linear regression, boosted trees or a random forest, with the settings of the study."""
    columns = {"featuresCol": "features", "labelCol": LABEL, "predictionCol": PREDICTION}
    # Iterations and regularisation.
    if kind == "linear":
        return LinearRegression(maxIter=100, regParam=1.0, elasticNetParam=0.1, **columns)
    if kind == "gbt":
        learner = SparseGBT(maxIter=10, seed=42, **columns)
        learner.part_bytes = PART_BYTES
        return learner
    if kind == "rf":
        return RandomForestRegressor(seed=42, **columns)
    raise ValueError(f"no such model: {kind}")


def in_parts(train: DataFrame) -> DataFrame:
    """``train`` dealt evenly to so many partitions that each holds at most about ``PART_BYTES`` when its features are binned.

    A column file of few bytes is one partition, but tree learners keep each row as one number per feature, empty ones too,
    and read a partition of them in one task for every level of a tree. Rows that fit one partition stay as they are.
    """
    first = train.select("features").first()
    size = max(1, first["features"].size) if first else 1
    parts = -(-4 * size * train.count() // PART_BYTES)
    return train.repartition(parts) if parts > 1 else train


def fit_price_model(featured: DataFrame, kind: str = "linear") -> Model:
    train, learner = featured.select("features", LABEL), regressor(kind)
    # Linear regression reads rows as they are, and sparse boosting packs them itself.
    return learner.fit(train if isinstance(learner, LinearRegression | SparseGBT) else in_parts(train))


def rmse(scored: DataFrame) -> float:
    return RegressionEvaluator(labelCol=LABEL, predictionCol=PREDICTION, metricName="rmse").evaluate(scored)


def error_table(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Root mean squared error and number of rows per group, as one aggregate."""
    miss = F.col(PREDICTION) - F.col(LABEL)
    return scored.groupBy(*keys).agg(F.count("*").alias("rows"), F.sqrt(F.avg(miss * miss)).alias("rmse"))


def model_report(spark: SparkSession, model: Model, test: DataFrame) -> DataFrame:
    """Number of features, steps of the objective, errors and non-zero coefficients."""
    summary = model.summary
    rows = [
        ("features", float(model.numFeatures)),
        ("nonzero_coefficients", float(model.coefficients.numNonzeros())),
        ("train_rmse", float(summary.rootMeanSquaredError)),
        ("test_rmse", float(rmse(model.transform(test)))),
        ("iterations", float(summary.totalIterations)),
    ] + [(f"objective_{i:03d}", float(v)) for i, v in enumerate(summary.objectiveHistory)]
    return spark.createDataFrame(rows, "name string, value double")


def score_requests(features: PipelineModel, model: Model, log: DataFrame) -> DataFrame:
    """Score a whole log and give it the 16 columns of replay input."""
    scored = model.transform(features.transform(fill_categories(log)))
    # Click predictions whose name in the log is not that in replay input.
    renamed = {
        "GBRT_prediction_International_eCommerce": "GBRT_prediction_International e-commerce",
        "GBRT_prediction_Chinese_vertical_eCommerce": "GBRT_prediction_Chinese vertical e-commerce",
    }
    return scored.select([F.col(f"`{renamed.get(c, c)}`").alias(c) for c in REQUEST_COLUMNS])


def optimality(model: LinearRegressionModel, featured: DataFrame) -> DataFrame:
    """How far each coefficient of an elastic net, and its intercept, is from being optimal on its training rows.

    Rows (index, coefficient, gap), index -1 for the intercept. On centred columns of deviation 1 the objective is half the
    mean squared error plus ``l1 * |w| + l2 / 2 * w ** 2`` per coefficient w. At its minimum the gradient of the smooth part is
    ``-l1 * sign(w)`` where w is not 0, and within ``l1`` of 0 where it is; the gap is the distance to that. Products of
    residuals and features are summed in one aggregate, positive and negative residuals apart as weights.
    """
    n_features = model.numFeatures
    miss = F.col(LABEL) - F.col(PREDICTION)
    rows = model.transform(featured.select("features", F.col(LABEL).cast("double").alias(LABEL)))
    every = Summarizer.metrics("count", "mean", "variance")
    above, below = (Summarizer.metrics("sum").summary(F.col("features"), F.greatest(x, F.lit(0.0))) for x in (miss, -miss))
    found = rows.agg(every.summary(F.col("features")).alias("x"), above.alias("above"), below.alias("below"), F.sum(miss).alias("miss"), F.var_pop(LABEL).alias("spread"), F.avg(LABEL).alias("level")).first()
    n = found["x"]["count"]
    # The direct solver scales by population deviations, the iterative one, for many features, by those of a sample.
    direct = n_features <= 4096
    scale = np.sqrt(found["x"]["variance"].toArray() * ((n - 1) / n if direct else 1.0))
    label_scale = np.sqrt(found["spread"] * (1.0 if direct else n / (n - 1)))
    products = found["above"]["sum"].toArray() - found["below"]["sum"].toArray() - found["x"]["mean"].toArray() * found["miss"]
    used = scale > 0
    w = model.coefficients.toArray() * scale / label_scale
    strength = model.getOrDefault(model.regParam) / label_scale
    l1, l2 = strength * model.getOrDefault(model.elasticNetParam), strength * (1 - model.getOrDefault(model.elasticNetParam))
    slope = -products / np.where(used, scale, 1.0) / label_scale / n + l2 * w
    gap = np.where(w != 0, np.abs(slope + l1 * np.sign(w)), np.maximum(np.abs(slope) - l1, 0.0))
    gap = np.where(used, gap, np.abs(model.coefficients.toArray()))
    rows = [(-1, float(model.intercept), float(abs(found["miss"]) / n / label_scale))]
    rows += [(i, float(c), float(g)) for i, (c, g) in enumerate(zip(model.coefficients.toArray(), gap))]
    return featured.sparkSession.createDataFrame(rows, "index int, coefficient double, gap double")
