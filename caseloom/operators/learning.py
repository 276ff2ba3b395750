"""Learners of MLlib behind the same guards: screening, fits, scoring. Values are not those of other libraries."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encode import drift_scores


def guard(train: DataFrame, validation: DataFrame, features: list[str]) -> None:
    """No target among the features, both classes in train, and all of train's weeks before validation's."""
    if {"target", "score", "prediction", "predicted_target"} & set(features):
        raise ValueError("the features hold the target")
    last, classes = train.agg(F.max("WEEK_NUM"), F.count_distinct("target")).first()
    first = validation.agg(F.min("WEEK_NUM")).first()[0]
    if classes != 2:
        raise ValueError("training rows need both classes")
    if first is not None and last >= first:
        raise ValueError("training weeks reach into validation")


def _prepared(features: list[str], scale: bool) -> list:
    filled = [f"{f}__filled" for f in features]
    steps = [Imputer(strategy="median", inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="raw", handleInvalid="keep")]
    return [*steps, StandardScaler(inputCol="raw", outputCol="features", withMean=True)] if scale else steps


def fit_logistic(train: DataFrame, features: list[str], regularisation: float = 1e-4) -> PipelineModel:
    learner = LogisticRegression(labelCol="target", featuresCol="features", regParam=regularisation, maxIter=50)
    return Pipeline(stages=[*_prepared(features, True), learner]).fit(train)


def fit_trees(train: DataFrame, features: list[str], rounds: int = 20, depth: int = 4, seed: int = 42, validation: DataFrame | None = None) -> PipelineModel:
    """With validation, boosting ends early where it no longer helps there."""
    learner = GBTClassifier(labelCol="target", featuresCol="raw", maxIter=rounds, maxDepth=depth, seed=seed, stepSize=0.1)
    rows = train
    if validation is not None:
        learner = learner.setValidationIndicatorCol("held")
        rows = train.withColumn("held", F.lit(False)).unionByName(validation.withColumn("held", F.lit(True)), allowMissingColumns=True)
    return Pipeline(stages=[*_prepared(features, False), learner]).fit(rows)


def score(model: PipelineModel, rows: DataFrame, keep: list[str]) -> DataFrame:
    return model.transform(rows).select(*keep, vector_to_array("probability")[1].alias("prediction"))


def score_ensemble(models: dict[str, PipelineModel], weights: dict[str, float], rows: DataFrame, keep: list[str]) -> DataFrame:
    """Weighted mean of the models' probabilities, in one pass over rows; weights are positive and sum to 1."""
    if {*models} != {*weights} or any(w <= 0 for w in weights.values()) or abs(sum(weights.values()) - 1) > 1e-12:
        raise ValueError("each model needs a positive weight, and weights sum to 1")
    total, scored = F.lit(0.0), rows
    for name, model in models.items():
        extra = model.transform(scored.select(*rows.columns, *[c for c in scored.columns if c.startswith("of__")]))
        scored = extra.withColumn(f"of__{name}", vector_to_array("probability")[1])
        total += F.col(f"of__{name}") * weights[name]
    return scored.select(*keep, total.alias("prediction"))


def save(model: PipelineModel, path: str) -> None:
    """An existing path is refused."""
    model.write().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def check_reload(model: PipelineModel, rows: DataFrame, key: str, path: str) -> PipelineModel:
    """The model saved at path and read again, which must score every row alike."""
    save(model, path)
    again = load(path)
    a, b = score(model, rows, [key]), score(again, rows, [key]).withColumnRenamed("prediction", "again")
    if a.join(b, key).where(~F.col("prediction").eqNullSafe(F.col("again"))).head(1):
        raise ValueError("the stored model scores otherwise")
    return again


def gain_screen(train: DataFrame, validation: DataFrame, features: list[str], seed: int = 42, rounds: int = 10) -> DataFrame:
    """name, target_gain, drift_gain, score: importance for the target, less that for telling train from validation."""
    guard(train, validation, features)
    target = fit_trees(train, features, rounds, seed=seed).stages[-1].featureImportances
    both = train.withColumn("target", F.lit(0)).unionByName(validation.withColumn("target", F.lit(1)), allowMissingColumns=True)
    drift = fit_trees(both, features, rounds, seed=seed).stages[-1].featureImportances
    rows = [(f, float(target[i]), float(drift[i])) for i, f in enumerate(features)]
    return drift_scores(train.sparkSession.createDataFrame(rows, "name string, target_gain double, drift_gain double"))


def median_rounds(best: list[int]) -> int:
    """The frozen number of rounds: the median of the folds' best."""
    if not best:
        raise ValueError("no folds")
    return sorted(best)[len(best) // 2] if len(best) % 2 else sum(sorted(best)[len(best) // 2 - 1 : len(best) // 2 + 1]) // 2


def without_blocks(features: list[str], excluded: set[str]) -> list[str]:
    """Features whose block ({family}__d{depth}) is not excluded."""
    return [f for f in features if "__".join(f.split("__")[:2]) not in excluded]
