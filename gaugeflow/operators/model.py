"""Regression forests on the model frame."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import error_summary
from ..functions.series import SITE

KEYS = (SITE, "water_year")
BUCKETS = 1_000_000
FITS_AT_ONCE = 4


def drivers_of(frame: DataFrame, label: str = "q5_norm") -> list[str]:
    """Driver columns of a model frame: all but the keys and the response."""
    return [c for c in frame.columns if c not in (*KEYS, label)]


def _vectors(frame: DataFrame, drivers: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(drivers), outputCol="features").transform(frame)


def forest_fit(
    frame: DataFrame,
    trees: int = 400,
    seed: int = 123,
    max_depth: int = 20,
    min_node: int = 5,
    max_bins: int = 64,
    label: str = "q5_norm",
) -> RandomForestRegressionModel:
    """Regression forest with a third of the drivers tried at each split.

    ``frame`` is passed over once per tree level: hand in a stored table or one that went through
    ``cut_lineage``.
    """
    forest = RandomForestRegressor(
        featuresCol="features",
        labelCol=label,
        numTrees=trees,
        featureSubsetStrategy="onethird",
        maxDepth=max_depth,
        minInstancesPerNode=min_node,
        maxBins=max_bins,
        maxMemoryInMB=512,
        seed=seed,
    )
    return forest.fit(_vectors(frame, drivers_of(frame, label)))


def forest_importance(model: RandomForestRegressionModel, frame: DataFrame, label: str = "q5_norm") -> DataFrame:
    """Importance of each driver: one row per driver of the fitted model."""
    rows = list(zip(drivers_of(frame, label), [float(v) for v in model.featureImportances.toArray()]))
    return frame.sparkSession.createDataFrame(rows, "feature string, importance double")


def predict(model: RandomForestRegressionModel, frame: DataFrame, label: str = "q5_norm") -> DataFrame:
    """Keys, response, prediction and residual."""
    scored = model.transform(_vectors(frame, drivers_of(frame, label)))
    return scored.select(*KEYS, label, F.col("prediction").alias("pred"), (F.col(label) - F.col("prediction")).alias("residual"))


def hash_fraction(seed: int) -> Column:
    """Number in [0, 1) that depends on the row's keys and the seed only, so reruns agree."""
    return F.pmod(F.xxhash64(*KEYS, F.lit(seed)), F.lit(BUCKETS)) / BUCKETS


def forest_residuals(frame: DataFrame, folds: int = 10, trees: int = 400, seed: int = 123, **settings) -> DataFrame:
    """Held-out prediction and residual of every row, from ``folds`` fits.

    Each row is predicted by a forest that has not seen its fold. Folds are a hash of the keys;
    the number of fits does not grow with the data. Hand in a stored table: every fit reads it.
    """
    marked = frame.withColumn("_fold", F.floor(hash_fraction(seed) * folds))

    def held_out(fold: int) -> DataFrame:
        model = forest_fit(marked.where(F.col("_fold") != fold).drop("_fold"), trees, seed, **settings)
        return predict(model, marked.where(F.col("_fold") == fold).drop("_fold")).withColumn("fold", F.lit(fold))

    # The fits are jobs of their own that do not wait for each other.
    with ThreadPool(min(folds, FITS_AT_ONCE)) as pool:
        return reduce(DataFrame.unionByName, pool.map(held_out, range(folds)))


def residual_summary(residuals: DataFrame, label: str = "q5_norm") -> DataFrame:
    """RMSE, RMSE over the mean and R squared over all rows."""
    return residuals.agg(*error_summary(label, "pred"))


def train_test_eval(frame: DataFrame, frac: float = 0.7, seed: int = 123, trees: int = 400, **settings) -> DataFrame:
    """Error summary of one fit on its training rows and on the rows held out by hash."""
    train, test = (frame.where(c) for c in (hash_fraction(seed) < frac, hash_fraction(seed) >= frac))
    model = forest_fit(train, trees, seed, **settings)
    both = predict(model, train).withColumn("part", F.lit("train")).unionByName(predict(model, test).withColumn("part", F.lit("test")))
    return both.groupBy("part").agg(*error_summary("q5_norm", "pred"))
