"""Blends of aligned predictions: candidates, ranking, prequential choice, ablation."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .metrics import auc, average_precision, gini, losses, penalties, probability_metrics, stability

# What candidates are ranked by, in this order, and the leader's percentages in its blends.
RANKING = ["mean_stability DESC", "worst_stability DESC", "mean_gini DESC", "slope DESC", "residual_std ASC", "brier ASC"]
LEADER_PERCENT = (50, 75, 90)

#: A blend: its name, and its members with their weights.
Blend = tuple[str, tuple[tuple[str, float], ...]]


def declared_blends(models: list[str], leader: str, control: str) -> list[Blend]:
    """Each model alone, the leader with each other one, and equal shares of all and of all but the control."""
    if len({*models}) < len(models) or not {leader, control} <= {*models}:
        raise ValueError("leader and control must be among the distinct models")
    equal = lambda members: tuple((m, 1 / len(members)) for m in members)
    pairs = product([m for m in models if m != leader], LEADER_PERCENT)
    return [
        *((m, ((m, 1.0),)) for m in models),
        *((f"{leader}_{percent}_{m}", ((leader, percent / 100), (m, 1 - percent / 100))) for m, percent in pairs),
        ("equal_all", equal(models)),
        ("equal_without_control", equal([m for m in models if m != control])),
    ]


def check_blends(blends: list[Blend], models: list[str]) -> None:
    for name, members in blends:
        if {m for m, _ in members} - {*models}:
            raise ValueError(f"{name} names an unknown model")
        if any(not 0 < w <= 1 for _, w in members) or abs(sum(w for _, w in members) - 1) > 1e-12:
            raise ValueError(f"the weights of {name} must be in (0, 1] and sum to 1")


def blend(predictions: DataFrame, blends: list[Blend], models: list[str]) -> DataFrame:
    """Weighted sums by candidate and case. predictions: model, case_id, fold, WEEK_NUM, target, prediction.

    A case's scores come together in one row first; blends are expressions over it, and multiply rows after the shuffle.
    """
    check_blends(blends, models)
    wide = predictions.groupBy("case_id", "fold", "WEEK_NUM", "target").agg(*[F.max(F.when(F.col("model") == m, F.col("prediction"))).alias(f"of_{i}") for i, m in enumerate(models)])
    score = lambda members: sum((F.col(f"of_{models.index(m)}") * w for m, w in members), F.lit(0.0))
    made = F.explode(F.array(*[F.struct(F.lit(name).alias("candidate"), score(members).alias("prediction")) for name, members in blends]))
    return wide.select("case_id", "fold", "WEEK_NUM", "target", made.alias("b")).select("b.candidate", "case_id", "fold", "WEEK_NUM", "target", "b.prediction")


def evaluate(blended: DataFrame) -> DataFrame:
    """Per candidate and fold: stability parts and Brier score."""
    keys = ["candidate", "fold"]
    return stability(gini(blended, [*keys, "WEEK_NUM"]), keys).join(losses(blended, keys), keys)


def pooled(blended: DataFrame) -> DataFrame:
    """Per candidate, over all folds at once: AUC, average precision, Brier score and log loss."""
    keys = ["candidate"]
    return auc(blended, keys).join(average_precision(blended, keys), keys).join(losses(blended, keys), keys)


def _summary(over: WindowSpec | None = None) -> dict[str, Column]:
    """What candidates are ranked by, from rows of folds; of a window's rows if one is given."""
    of = lambda c: c if over is None else c.over(over)
    return {
        "mean_stability": of(F.avg("stability")),
        "worst_stability": of(F.min("stability")),
        "std_stability": of(F.stddev_pop("stability")),
        "mean_gini": of(F.avg("mean_gini")),
        "slope": of(F.avg("slope")),
        "residual_std": of(F.avg("residual_std")),
        "brier": of(F.avg("brier")),
    }


def _best_first(incumbent: str) -> list[Column]:
    """By RANKING, the incumbent first among equals, then by name."""
    order = [F.col(c).desc() if way == "DESC" else F.col(c).asc() for c, way in (x.split() for x in RANKING)]
    return [*order, (F.col("candidate") != incumbent).cast("int"), F.col("candidate")]


def summarise_folds(folds: DataFrame, key: str = "candidate") -> DataFrame:
    return folds.groupBy(key).agg(*[c.alias(n) for n, c in _summary().items()])


def rank(summary: DataFrame, incumbent: str) -> DataFrame:
    """Places 1.. of candidates, of which one row each enters the window."""
    return summary.withColumn("place", F.row_number().over(W.orderBy(*_best_first(incumbent))))


def prequential(folds: DataFrame, incumbent: str) -> DataFrame:
    """For each fold but the first, the best candidate by the folds before it, and what it then reached."""
    before = W.partitionBy("candidate").orderBy("fold").rowsBetween(W.unboundedPreceding, -1)
    past = folds.select("candidate", "fold", F.col("stability").alias("reached"), *[c.alias(n) for n, c in _summary(before).items()]).where("mean_stability IS NOT NULL")
    order = W.partitionBy("fold").orderBy(*_best_first(incumbent))
    first = past.withColumn("k", F.row_number().over(order)).where("k = 1")
    return first.select("fold", "candidate", F.col("mean_stability").alias("past_mean"), F.col("reached").alias("stability"))


def ablation(rows: DataFrame, control: str) -> DataFrame:
    """Metrics of each condition by fold and pooled (fold 0), and their difference to the control's."""
    pooled = rows.withColumn("fold", F.lit(0))
    found = probability_metrics(rows.unionByName(pooled.select(*rows.columns)), ["condition", "fold"])
    base = found.where(F.col("condition") == control).select("fold", F.col("stability").alias("control_stability"), F.col("auc").alias("control_auc"))
    met = found.join(F.broadcast(base), "fold")
    return met.select("condition", "fold", "stability", "auc", (F.col("stability") - F.col("control_stability")).alias("delta_stability"), (F.col("auc") - F.col("control_auc")).alias("delta_auc"))


def evidence(weekly: DataFrame) -> DataFrame:
    """Per model: the weakest fold and how its score is made up. weekly: model, fold, WEEK_NUM, gini."""
    parts = penalties(weekly, ["model", "fold"])
    first = W.partitionBy("model").orderBy("stability", "fold")
    return parts.withColumn("k", F.row_number().over(first)).where("k = 1").select("model", "fold", "mean_gini", "trend_penalty", "residual_penalty", "stability")


def pivot_scores(predictions: DataFrame, models: list[str]) -> DataFrame:
    """One row a case, one column a model."""
    return predictions.groupBy("case_id").pivot("model", models).agg(F.first("prediction"))
