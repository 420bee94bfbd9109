"""Classifiers from Spark ML, fitted over folds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Named classifiers: each a function of a seed that gives an estimator over features and label.
MODELS: dict[str, Callable] = {
    "logistic": lambda seed: LogisticRegression(maxIter=50, regParam=1e-3),
    "naive_bayes": lambda seed: NaiveBayes(modelType="gaussian"),
    "tree": lambda seed: DecisionTreeClassifier(seed=seed),
    "forest": lambda seed: RandomForestClassifier(seed=seed, numTrees=30),
}


def _scaled(features: list[str]) -> list:
    return [VectorAssembler(inputCols=features, outputCol="raw_"), StandardScaler(inputCol="raw_", outputCol="features", withMean=True)]


def pipeline(features: list[str], model: str = "logistic", seed: int = 1) -> Pipeline:
    return Pipeline(stages=[*_scaled(features), MODELS[model](seed)])


def side_by_side(train: DataFrame, test: DataFrame, features: list[str], models: list[str], seed: int = 1) -> DataFrame:
    """test with each named model's prediction, in a column of its name, after fitting on train (features and label).

    The models share one scaling, which is fitted once, and the test rows are read once for all of them.
    """
    scaling = Pipeline(stages=_scaled(features)).fit(train)
    known, out = scaling.transform(train), scaling.transform(test)
    for name in models:
        model = MODELS[name](seed).setPredictionCol(name).setRawPredictionCol(f"raw_{name}").setProbabilityCol("")
        out = model.fit(known).transform(out)
    return out.select(*test.columns, *models)


def out_of_fold(df: DataFrame, features: list[str], label: str, fold: str, folds: int, model: str = "logistic", seed: int = 1) -> DataFrame:
    """Each row's prediction by a model that was fitted on the other folds."""
    out = None
    for k in range(folds):
        fitted = pipeline(features, model, seed).fit(df.filter(F.col(fold) != k).withColumnRenamed(label, "label"))
        part = fitted.transform(df.filter(F.col(fold) == k)).select(*df.columns, "prediction", "probability")
        out = part if out is None else out.unionByName(part)
    return out
