"""The star-schema tables in the roles of the case-history model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.operators.temporal import Fold, assign_folds, expanding_folds, folds_frame
from caseloom.sources.scan import meanings, normalise

FIRST_DAY = "1995-01-01"
WEEK_MAX = 339
#: Multiplier, weight of the target: four models' scores are made of them.
MODELS = {"m1": (7919, 0.20), "m2": (104729, 0.15), "m3": (1299709, 0.10), "m4": (15485863, 0.05)}
LEADER, CONTROL = "m1", "m2"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cases."""
    o = table(spark, sf_dir, "orders")
    day = F.col("o_orderdate").cast("date")
    return o.select(
        F.col("o_orderkey").alias("case_id"),
        day.alias("date_decision"),
        F.floor(F.datediff(day, F.lit(FIRST_DAY).cast("date")) / 7).cast("int").alias("WEEK_NUM"),
        (F.year(day) * 100 + F.month(day)).cast("int").alias("MONTH"),
        (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("target"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as raw history of depth one; nulls are put in to exercise them."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("case_id"),
        (F.col("l_linenumber") - 1).cast("long").alias("num_group1"),
        F.when(F.col("l_linenumber") % 4 != 0, F.col("l_quantity")).alias("quantityA"),
        F.col("l_extendedprice").alias("priceA"),
        F.when(F.col("l_discount") <= 0.08, F.col("l_discount")).alias("discountP"),
        F.nullif(F.col("l_returnflag"), F.lit("N")).alias("flagM"),
        F.col("l_linestatus").alias("statusL"),
        F.col("l_shipdate").alias("shippedD"),
    )


NUMERIC, CATEGORICAL, DATES = ["quantityA", "priceA", "discountP"], ["flagM", "statusL"], ["shippedD"]


def history(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """Normalised: dates as days from the decision, rows of known cases alone. parts: how many the cases are dealt to, which stay apart."""
    raw, cases = lines(spark, sf_dir), base(spark, sf_dir).select("case_id", "date_decision")
    return normalise(raw, meanings([raw]), cases.repartition(parts, "case_id") if parts else cases)


def folds() -> list[Fold]:
    return expanding_folds(0, WEEK_MAX, 5, 8, 20)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model, case_id, WEEK_NUM, target, prediction, fold: four closed-form models over the validation weeks."""
    rows = assign_folds(base(spark, sf_dir), folds_frame(spark, folds()))
    made = [F.struct(F.lit(m).alias("model"), F.round(F.pmod(F.col("case_id") * a, F.lit(997)) / 1250.0 + F.lit(c) * F.col("target"), 6).alias("prediction")) for m, (a, c) in MODELS.items()]
    return rows.select("case_id", "WEEK_NUM", "target", "fold", F.explode(F.array(*made)).alias("m")).select("m.model", "case_id", "WEEK_NUM", "target", "fold", "m.prediction")


def mean_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id, WEEK_NUM, target, fold, prediction: one row a case, the mean of the models' scores."""
    return predictions(spark, sf_dir).groupBy("case_id", "WEEK_NUM", "target", "fold").agg(F.round(F.avg("prediction"), 9).alias("prediction"))
