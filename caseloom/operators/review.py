"""Reviews of published numbers as joins: linear identities between them, policies they must meet, and recomputation.

Published numbers are one long table, VALUES: what they are of (scope and subject), which metric, and the value.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import compare, penalties

VALUES = ["scope", "subject", "metric", "value"]
NAMED = ["scope", "subject", "metric"]


def long_values(df: DataFrame, scope: str, subject: Column, metrics: Sequence[str]) -> DataFrame:
    """VALUES of wide rows."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]))
    return df.select(F.lit(scope).alias("scope"), subject.cast("string").alias("subject"), pairs.alias("r")).select("scope", "subject", "r.*")


def term(rows: DataFrame, identity: Column, scope: str | Column, subject: Column, metric: str | Column, weight: Column | float) -> DataFrame:
    """One term of an identity for each row: identity, scope, subject, metric, weight."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return rows.select(identity.alias("identity"), as_column(scope).alias("scope"), subject.cast("string").alias("subject"), as_column(metric).alias("metric"), as_column(weight).cast("double").alias("weight"))


def constraints(*terms: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionAll, terms)


def residuals(values: DataFrame, terms: DataFrame, tolerance: float = 1e-10) -> DataFrame:
    """(identity, residual, missing, holds): an identity's weighted values must sum to 0, none missing or stated twice."""
    met = terms.join(values, NAMED, "left")
    stated = met.groupBy("identity", *NAMED, "weight").agg(F.sum("value").alias("value"), F.count("value").alias("times"))
    wrong = F.count_if(F.col("times") != 1)
    size = F.greatest(F.lit(1.0), F.max(F.abs(F.col("weight") * F.col("value"))))
    found = stated.groupBy("identity").agg(F.sum(F.col("weight") * F.col("value")).alias("residual"), wrong.alias("missing"), size.alias("size"))
    return found.select("identity", "residual", "missing", F.coalesce((F.col("missing") == 0) & (F.abs("residual") <= tolerance * F.col("size")), F.lit(False)).alias("holds"))


def fold_identities(folds: DataFrame, metrics: Sequence[str], counts: Sequence[str]) -> DataFrame:
    """Terms that tie a model to its folds: means of metrics, sums of counts. folds: model, fold."""
    pairs = folds.select("model", "fold").distinct()
    n = pairs.groupBy("model").agg(F.count(F.lit(1)).alias("n"))
    sized = pairs.join(n, "model")
    made = []
    for names, weight, kind in ((metrics, 1 / F.col("n"), "mean of folds"), (counts, F.lit(1.0), "sum of folds")):
        for m in names:
            name = F.concat_ws(": ", "model", F.lit(f"{m} is the {kind}"))
            made += [term(n, name, "model", F.col("model"), m, -1.0), term(sized, name, "fold", F.concat_ws("/", "model", "fold"), m, weight)]
    return constraints(*made)


def delta_identities(subjects: DataFrame, control: str, metric: str, delta: str) -> DataFrame:
    """Terms of delta = metric - the control's metric. subjects: subject."""
    name = F.concat_ws(": ", "subject", F.lit(f"{delta} is against {control}"))
    return constraints(term(subjects, name, "model", F.col("subject"), delta, -1.0), term(subjects.where(F.col("subject") != control), name, "model", F.col("subject"), metric, 1.0), term(subjects.where(F.col("subject") != control), name, "model", F.lit(control), metric, -1.0))


def score_identities(subjects: DataFrame, scope: str) -> DataFrame:
    """Terms of stability = mean_gini + trend_penalty + residual_penalty. subjects: subject."""
    name = F.concat_ws(": ", "subject", F.lit("stability adds up"))
    return constraints(*[term(subjects, name, scope, F.col("subject"), m, w) for m, w in (("stability", -1.0), ("mean_gini", 1.0), ("trend_penalty", 1.0), ("residual_penalty", 1.0))])


def policy(values: DataFrame, rules: DataFrame) -> DataFrame:
    """(check, passed, value): each rule, and ``verdict``, which passes if all do.

    rules: check, scope, subject, metric, least, most (null: open) and tolerance. A value that is missing, stated twice or
    not finite fails.
    """
    met = rules.join(values, NAMED, "left").groupBy("check", "least", "most", "tolerance").agg(F.count("value").alias("times"), F.max("value").alias("value"))
    v = F.col("value")
    inside = (v >= F.coalesce(F.col("least") - F.col("tolerance"), v)) & (v <= F.coalesce(F.col("most") + F.col("tolerance"), v))
    passed = F.coalesce((F.col("times") == 1) & ~F.isnan(v) & (F.abs(v) < float("inf")) & inside, F.lit(False))
    checked = met.select("check", passed.alias("passed"), "value")
    return checked.unionAll(checked.agg(F.lit("verdict"), F.coalesce(F.every("passed"), F.lit(False)), F.count_if("passed").cast("double")))


def policy_rules(spark, rules: Mapping[str, tuple[str, str, str, float | None, float | None, float]]) -> DataFrame:
    """rules: check -> scope, subject, metric, least, most, tolerance."""
    return spark.createDataFrame([(k, *r) for k, r in rules.items()], "check string, scope string, subject string, metric string, least double, most double, tolerance double")


def evidence_faults(weekly: DataFrame, folds: DataFrame, models: DataFrame, relative: float = 1e-8, absolute: float = 1e-10) -> DataFrame:
    """(model, fold, metric, actual, expected) of recorded numbers that weekly ones do not give; fold 0 is the whole.

    weekly: model, fold, WEEK_NUM, n_rows, positives, gini. folds and models: recorded n_rows, positives, mean_gini,
    slope, residual_std, stability. Weeks whose population differs from another model's are named as metric population.
    """
    names = ["n_rows", "positives", "mean_gini", "slope", "residual_std", "stability"]
    both = weekly.unionByName(weekly.withColumn("fold", F.lit(0).cast(weekly.schema["fold"].dataType)))
    sums = both.groupBy("model", "fold").agg(F.sum("n_rows").alias("n_rows"), F.sum("positives").alias("positives"))
    actual = sums.join(penalties(both, ["model", "fold"]), ["model", "fold"])
    recorded = folds.select("model", "fold", *names).unionAll(models.select("model", F.lit(0).alias("fold"), *names))
    off = compare(actual, recorded, ["model", "fold"], names, relative, absolute)
    per_week = weekly.groupBy("WEEK_NUM").agg(F.count_distinct("n_rows", "positives").alias("kinds"), F.count(F.lit(1)).alias("rows"), F.count_distinct("model").alias("models"))
    n_models = weekly.agg(F.count_distinct("model").alias("all_models"))
    odd = per_week.crossJoin(F.broadcast(n_models)).where("kinds > 1 OR rows != models OR models != all_models")  # one row
    weeks = odd.select(F.lit(None).cast("string").alias("model"), F.col("WEEK_NUM").cast("int").alias("fold"), F.lit("population").alias("metric"), F.col("models").cast("double").alias("actual"), F.col("all_models").cast("double").alias("expected"))
    return off.select("model", F.col("fold").cast("int").alias("fold"), "metric", "actual", "expected").unionAll(weeks)
