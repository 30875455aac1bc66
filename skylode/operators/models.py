"""Models trained here on Spark: Mahalanobis distance, ridge regression, cross-validated logistic regression."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def moments(vectors: DataFrame, column: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, mean and covariance of array vectors. Each task adds up one d × d grid of products; the driver gets one
    grid, however many vectors there are."""
    x = vectors.select(F.col(column).cast("array<double>").alias("x")).where("x IS NOT NULL")

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            if len(batch):
                m = np.column_stack([np.ones(len(batch)), np.stack(batch["x"].to_numpy())])
                total = m.T @ m if total is None else total + m.T @ m
        if total is not None:
            yield pd.DataFrame({"g": [total.ravel()]})

    # One grid per task; its first row holds the number and the sums of the vectors.
    cells = x.mapInPandas(sums, "g array<double>").select(F.posexplode("g").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    side = math.isqrt(len(cells))
    grid = np.array([r["v"] for r in cells]).reshape(side, side)
    n, mean = int(round(grid[0, 0])), grid[0, 1:] / grid[0, 0]
    return n, mean, grid[1:, 1:] / grid[0, 0] - np.outer(mean, mean)


def ledoit_wolf(vectors: DataFrame, column: str, n: int, mean: np.ndarray, cov: np.ndarray) -> float:
    """The Ledoit-Wolf share of the mean variance in the shrunk covariance, from the moments and one more sum over all
    vectors, that of the fourth powers of their distances from the mean."""
    centred = F.zip_with(F.col(column).cast("array<double>"), F.array(*map(F.lit, map(float, mean))), lambda a, b: a - b)
    square = F.aggregate(centred, F.lit(0.0), lambda a, x: a + x * x)
    fourth = vectors.where(F.col(column).isNotNull()).agg(F.sum(square * square)).first()[0]
    p, norm = len(mean), float((cov * cov).sum())
    away = (norm - np.trace(cov) ** 2 / p) / p
    noise = min((fourth / n - norm) / (n * p), away)
    return max(0.0, noise / away) if away > 0 else 0.0


def mahalanobis(vectors: DataFrame, column: str, reference: DataFrame, shrink: float | None = None) -> DataFrame:
    """vectors with `distance` from the reference's mean, by its covariance shrunk towards its mean variance, by the
    coefficient of Ledoit and Wolf unless one is given."""
    n, mean, cov = moments(reference, column)
    shrink = ledoit_wolf(reference, column, n, mean, cov) if shrink is None else shrink
    target = np.eye(len(mean)) * np.trace(cov) / len(mean)
    root = np.linalg.cholesky(np.linalg.inv((1 - shrink) * cov + shrink * target))

    # Mean and root travel with the function, not in the plan: d × d numbers, whatever the number of vectors.
    @F.pandas_udf("double")
    def distance(v: pd.Series) -> pd.Series:
        out = np.full(len(v), np.nan)
        if len(known := np.flatnonzero(v.notna())):
            out[known] = np.linalg.norm((np.stack(v.to_numpy()[known]) - mean) @ root, axis=1)
        return pd.Series(out)

    column_ = F.col(column).cast("array<double>")
    return vectors.withColumn("distance", F.when(column_.isNotNull(), distance(column_)))


def ridge(rows: DataFrame, features: str, label: str, penalty: float) -> LinearRegression:
    """Ridge regression by normal equations; rows without a vector or label don't count."""
    known = rows.where(F.col(features).isNotNull() & F.col(label).isNotNull())
    fit = known.select(array_to_vector(F.col(features).cast("array<double>")).alias("features"), F.col(label).cast("double").alias("label"))
    return LinearRegression(solver="normal", regParam=penalty, elasticNetParam=0.0).fit(fit)


def cross_validated_auc(rows: DataFrame, features: str, label: str, folds: int = 5, key: str | None = None) -> float:
    """Mean area under the ROC curve of logistic regression over the folds; a row's fold is a hash of its key (of its
    features, unless one is named), so that the folds don't depend on partitions. Rows without a vector or label don't
    count."""
    fold = F.pmod(F.xxhash64(F.col(key or features)), F.lit(folds)).cast("int")
    known = rows.where(F.col(features).isNotNull() & F.col(label).isNotNull())
    fit = known.select(array_to_vector(F.col(features).cast("array<double>")).alias("features"), F.col(label).cast("double").alias("label"), fold.alias("fold"))
    cv = CrossValidator(
        estimator=LogisticRegression(maxIter=50), estimatorParamMaps=ParamGridBuilder().build(), evaluator=BinaryClassificationEvaluator(), numFolds=folds, foldCol="fold", parallelism=folds
    )
    return float(cv.fit(fit).avgMetrics[0])
