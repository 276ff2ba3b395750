"""Feature blocks of one row a case: calendar, static and history, and their assembly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caseloom.functions.columns import calendar, decision_date, null_share, sample_hash
from caseloom.functions.schema import assert_no_leak, feature_name

from .joins import one_to_one
from .ranks import below, parts_for


def base_block(base: DataFrame) -> DataFrame:
    """case_id, calendar features of the decision date, and the target where there is one."""
    date = decision_date(F.col("date_decision"), base.schema["date_decision"].dataType)
    parts = {feature_name("base", 0, "date_decision", k): v for k, v in calendar(date).items()}
    kept = [c for c in ("WEEK_NUM", "MONTH", "target") if c in base.columns]
    return base.select(F.col("case_id").cast("long").alias("case_id"), *[F.col(c) for c in kept], *[v.alias(k) for k, v in parts.items()])


def decision_frame(base: DataFrame) -> DataFrame:
    return base.select(F.col("case_id").cast("long").alias("case_id"), decision_date(F.col("date_decision"), base.schema["date_decision"].dataType).alias("date_decision"))


def keep_first(frame: DataFrame, key: str, order: Sequence[str], strict: bool = False) -> DataFrame:
    """The first row of each key by order; strict refuses repeated keys."""
    if strict and frame.groupBy(key).count().where("count > 1").head(1):
        raise ValueError(f"{key} repeats in a static table")
    rank = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return frame.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def static_block(frame: DataFrame, family: str, predictors: Sequence[str], order: Sequence[str], strict: bool = False) -> DataFrame:
    """One row a case with the values themselves, missing_count and missing_fraction."""
    assert_no_leak(predictors, family)
    first = keep_first(frame, "case_id", order, strict)
    missing = sum((F.col(c).isNull().cast("int") for c in predictors), F.lit(0))
    return first.select(
        "case_id",
        *[F.col(c).alias(feature_name(family, 0, c, "value")) for c in predictors],
        missing.alias(feature_name(family, 0, "row", "missing_count")),
        null_share([F.col(c) for c in predictors]).cast("float").alias(feature_name(family, 0, "row", "missing_fraction")),
    )


def assemble(base: DataFrame, blocks: list[DataFrame], check: bool | str = True) -> DataFrame:
    return one_to_one(base, blocks, ["case_id"], check)


def block_contract(block: DataFrame, is_base: bool) -> DataFrame:
    """(check, passed): case_id first, non-null and unique; target in the base alone."""
    counts = block.agg(F.count(F.lit(1)).alias("n"), F.count("case_id").alias("known"), F.count_distinct("case_id").alias("kinds"))
    checks = [
        ("case_id_first", F.lit(block.columns[0] == "case_id")),
        ("case_id_not_null", F.col("n") == F.col("known")),
        ("case_id_unique", F.col("known") == F.col("kinds")),
        ("target_only_in_base", F.lit(is_base or "target" not in block.columns)),
    ]
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("check"), v.alias("passed")) for k, v in checks]))
    return counts.select(rows.alias("r")).select("r.*")


def deterministic_sample(frame: DataFrame, n: int, seed: int, key: str = "case_id") -> DataFrame:
    return frame.orderBy(sample_hash(F.col(key), seed), key).limit(n)


def case_partitions(base: DataFrame, rows: int, key: str = "case_id") -> DataFrame:
    """Disjoint ranges of at most rows ids: number, least and greatest id, count. Null ids are in none.

    Ids are ranked within buckets of their order, more the more rows there are, and shifted by the buckets' sizes, so no
    task sees all.
    """
    ids = base.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_n", F.lit(1))
    part = F.floor(F.col("below__n") / F.lit(rows)).alias("part")
    return below(ids, [], key, ["_n"], parts=parts_for(base.count())).groupBy(part).agg(F.min(key).alias("least"), F.max(key).alias("greatest"), F.count(F.lit(1)).alias("n_cases"))
