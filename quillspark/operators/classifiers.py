"""Text classifiers chosen by grid search, with Spark's own learners: every fold and setting is fitted as Spark jobs."""

from __future__ import annotations

import itertools

from pyspark.ml.classification import GBTClassifier, NaiveBayes
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import HashingTF
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The grids that are searched.
ALPHAS = (0.001, 0.01, 0.1, 1.0, 1.3, 1.4, 1.7, 2.0, 2.4, 2.5, 10.0)
DEPTHS, RATES, TREES = (3, 5), (0.01, 0.1), (50, 100)


def hashed_terms(df: DataFrame, words: Column, label: str, size: int = 1 << 18) -> DataFrame:
    """(features, label): counts of the words' hash buckets, in the JVM. Rows without words or label are dropped."""
    rows = df.select(F.coalesce(words, F.array().cast("array<string>")).alias("_words"), F.col(label).cast("double").alias("label")).where(F.col("label").isNotNull() & (F.size("_words") > 0))
    return HashingTF(numFeatures=size, inputCol="_words", outputCol="features").transform(rows).select("features", "label")


def _search(learner, grid: list, rows: DataFrame, folds: int, seed: int) -> CrossValidatorModel:
    evaluator = MulticlassClassificationEvaluator(metricName="accuracy")
    return CrossValidator(estimator=learner, estimatorParamMaps=grid, evaluator=evaluator, numFolds=folds, seed=seed).fit(rows)


def _best(found: CrossValidatorModel) -> tuple[float, dict[str, float]]:
    score, settings = max(zip(found.avgMetrics, found.getEstimatorParamMaps(), strict=True), key=lambda x: x[0])
    return score, {p.name: v for p, v in settings.items()}


def naive_bayes_search(rows: DataFrame, alphas: tuple[float, ...] = ALPHAS, folds: int = 10, seed: int = 7):
    """Multinomial naive Bayes over hashed_terms(): the best of all smoothings, with the classes' own shares as prior or equal
    ones (by weights). Gives the model, its settings and its accuracy over the folds. The rows are kept in memory or on disk
    of the executors meanwhile, and read again from their source where one is lost."""
    shares = rows.groupBy("label").count()  # a row per class
    weighted = rows.join(F.broadcast(shares), "label").withColumn("weight", 1 / F.col("count")).drop("count").persist()
    found = []
    try:
        for equal in (False, True):
            learner = NaiveBayes(**({"weightCol": "weight"} if equal else {}))
            model = _search(learner, ParamGridBuilder().addGrid(learner.smoothing, list(alphas)).build(), weighted, folds, seed)
            score, settings = _best(model)
            found.append((score, settings | {"equal_priors": equal}, model.bestModel))
    finally:
        weighted.unpersist()
    score, settings, model = max(found, key=lambda x: x[0])
    return model, settings, score


def boosted_trees_search(
    rows: DataFrame, depths: tuple[int, ...] = DEPTHS, rates: tuple[float, ...] = RATES, trees: tuple[int, ...] = TREES, folds: int = 5, seed: int = 7,
):
    """Gradient-boosted trees over (features, label 0 or 1): the best of all depths, rates and numbers of trees. Gives the
    model, its settings and its accuracy over the folds."""
    learner = GBTClassifier(seed=seed)
    grid = [{learner.maxDepth: d, learner.stepSize: r, learner.maxIter: n} for d, r, n in itertools.product(depths, rates, trees)]
    model = _search(learner, grid, rows, folds, seed)
    score, settings = _best(model)
    return model.bestModel, settings, score
