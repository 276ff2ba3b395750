"""Weeks, folds and holdouts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FRACTIONS = (0.15, 0.20, 0.25, 0.30)


def week_profile(base: DataFrame) -> DataFrame:
    """Per week: rows, classes, rate, first and last day, and whether both classes are there."""
    return base.groupBy("WEEK_NUM").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("target").cast("long").alias("positives"),
        F.sum(1 - F.col("target")).cast("long").alias("negatives"),
        F.avg("target").alias("positive_rate"),
        F.min("date_decision").alias("date_min"),
        F.max("date_decision").alias("date_max"),
        (F.count_distinct("target") == 2).alias("eligible"),
    )


def base_summary(base: DataFrame) -> DataFrame:
    return base.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("case_id").alias("cases"),
        F.min("WEEK_NUM").alias("week_min"),
        F.max("WEEK_NUM").alias("week_max"),
        F.count_distinct("WEEK_NUM").alias("weeks"),
        F.date_format(F.min("date_decision"), "yyyy-MM-dd").alias("date_min"),
        F.date_format(F.max("date_decision"), "yyyy-MM-dd").alias("date_max"),
        F.avg("target").alias("positive_rate"),
    )


def date_reversals(profile: DataFrame, field: str = "date_min") -> DataFrame:
    """Number of weeks that begin before the week before them. One row a week goes into the window."""
    before = F.lag(field).over(W.orderBy("WEEK_NUM"))
    return profile.select((F.col(field) < before).alias("back")).agg(F.count_if("back").alias("reversals"))


def base_violations(base: DataFrame, target: bool = True) -> DataFrame:
    """(check, violations) of a base: numbers, whole weeks, dates, unique ids, a binary target."""
    counts = [
        ("empty", F.when(F.count(F.lit(1)) == 0, 1).otherwise(0)),
        ("case_id_null", F.count_if(F.col("case_id").isNull())),
        ("case_id_repeated", F.count("case_id") - F.count_distinct("case_id")),
        ("week_not_whole", F.count_if(F.col("WEEK_NUM").isNull() | (F.col("WEEK_NUM") != F.floor("WEEK_NUM")))),
        ("date_invalid", F.count_if(F.col("date_decision").try_cast("date").isNull())),
    ]
    if target:
        counts.append(("target_not_binary", F.count_if(~F.coalesce(F.col("target").isin(0, 1), F.lit(False)))))
    one = base.agg(*[c.cast("long").alias(k) for k, c in counts])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.col(k).alias("violations")) for k, _ in counts]))
    return one.select(rows.alias("r")).select("r.*")


def temporal_integrity(train: DataFrame, test: DataFrame, profile: DataFrame) -> DataFrame:
    """overlap (cases in both), reversals by first and by last day, and whether all of train precedes test."""
    overlap = train.select("case_id").distinct().join(test.select("case_id"), "case_id", "left_semi").agg(F.count(F.lit(1)).alias("overlap"))
    ends = train.agg(F.max("date_decision").alias("a"))
    starts = test.agg(F.min("date_decision").alias("b"))
    by_max = date_reversals(profile, "date_max").withColumnRenamed("reversals", "reversals_max")
    one = overlap.crossJoin(date_reversals(profile)).crossJoin(by_max).crossJoin(ends).crossJoin(starts)  # five one-row results
    return one.select("overlap", "reversals", "reversals_max", (F.col("a") < F.col("b")).alias("ordered"))


def holdout_candidates(profile: DataFrame, fractions: tuple[float, ...] = FRACTIONS, min_train_weeks: int = 20, min_metric_weeks: int = 8) -> DataFrame:
    """For each fraction, the last ceil(fraction * weeks) weeks as holdout; equal sizes once, at the smallest fraction."""
    spark = profile.sparkSession
    ranked = profile.withColumn("from_end", F.row_number().over(W.orderBy(F.desc("WEEK_NUM")))).withColumn("weeks", F.count(F.lit(1)).over(W.partitionBy()))
    wanted = spark.createDataFrame([(f,) for f in fractions], "fraction double")
    met = ranked.crossJoin(F.broadcast(wanted))  # a handful of fractions by one row a week
    size = F.ceil(F.round(F.col("fraction") * F.col("weeks"), 9))
    held = F.col("from_end") <= size
    made = met.groupBy("fraction").agg(
        F.max(size).alias("holdout_weeks"),
        F.min(F.when(held, F.col("WEEK_NUM"))).alias("holdout_start"),
        F.sum(F.when(~held, F.col("n_rows")).otherwise(0)).alias("train_rows"),
        F.sum(F.when(held, F.col("n_rows")).otherwise(0)).alias("holdout_rows"),
        F.count_if(~held).alias("train_weeks"),
        F.count_if(held & F.col("eligible")).alias("metric_weeks"),
    )
    once = made.withColumn("k", F.row_number().over(W.partitionBy("holdout_weeks").orderBy("fraction"))).where("k = 1").drop("k")
    return once.withColumn("eligible", (F.col("train_weeks") >= min_train_weeks) & (F.col("metric_weeks") >= min_metric_weeks))


@dataclass(frozen=True)
class Fold:
    fold: int
    train_min: int
    train_max: int
    validation_min: int
    validation_max: int


def expanding_folds(week_min: int, week_max: int, splits: int = 5, window: int = 8, min_train: int = 20) -> list[Fold]:
    """Validation windows at the end, each trained on all weeks before it."""
    if splits < 1 or window < 1:
        raise ValueError("splits and window must be positive")
    first = week_max - splits * window + 1
    if first - week_min < min_train:
        raise ValueError("too few weeks before the first validation window")
    folds = [Fold(k + 1, week_min, first + k * window - 1, first + k * window, first + (k + 1) * window - 1) for k in range(splits)]
    check_folds(folds, week_min, week_max)
    return folds


def check_folds(folds: list[Fold], week_min: int, week_max: int) -> None:
    """Contiguous, in order, without overlap, ending at the last week."""
    if not folds or folds[-1].validation_max != week_max:
        raise ValueError("folds must end at the last week")
    for k, f in enumerate(folds):
        if f.fold != k + 1 or f.train_min != week_min or f.train_max + 1 != f.validation_min or f.validation_max < f.validation_min:
            raise ValueError(f"fold {f.fold} is broken")
        if k and f.validation_min != folds[k - 1].validation_max + 1:
            raise ValueError(f"fold {f.fold} does not follow the one before")


def folds_frame(spark: SparkSession, folds: list[Fold]) -> DataFrame:
    return spark.createDataFrame([(f.fold, f.train_min, f.train_max, f.validation_min, f.validation_max) for f in folds], "fold int, train_min int, train_max int, validation_min int, validation_max int")


def assign_folds(rows: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows whose week is in a validation window, with the fold: a range join to a handful of rows."""
    window = F.broadcast(folds.select("fold", "validation_min", "validation_max"))
    return rows.join(window, F.col("WEEK_NUM").between(F.col("validation_min"), F.col("validation_max"))).drop("validation_min", "validation_max")


def week_range(rows: DataFrame, low: int, high: int) -> DataFrame:
    return rows.where(F.col("WEEK_NUM").between(low, high))
