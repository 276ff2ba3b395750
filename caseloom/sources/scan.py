"""Scans of sharded Parquet whose physical types drift, normalised by the meaning of column names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.functions.columns import lenient, relative_days
from caseloom.functions.schema import assert_no_leak, classify, resolve
from caseloom.operators.history import ORDINAL
from caseloom.operators.joins import assert_unique

from .footers import described

KEYS = ("case_id", "num_group1", "num_group2")


def read_shard(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def meanings(shards: list[DataFrame]) -> dict[str, str]:
    """From all shards of both splits. A column of all nulls and no type reads as int, and counts as its suffix says."""
    return resolve({f.name: classify(f.name, f.dataType) for f in s.schema} for s in shards)


def normalise(shard: DataFrame, kinds: dict[str, str], decisions: DataFrame | None, number: int = 0, bounds: tuple[int, int] | None = None) -> DataFrame:
    """Keys, predictors by meaning (dates as days from the decision), and a stable row ordinal.

    Cases outside decisions drop out. Columns that the shard lacks are null. A bound on case_id is applied to
    the stored column where it is a number, so that it reaches the scan.
    """
    assert_no_leak(shard.columns, "history")
    types = {f.name: f.dataType for f in shard.schema}
    if bounds and types["case_id"].typeName() in ("long", "integer", "short", "byte"):
        shard = shard.where(F.col("case_id").between(*bounds))
    keys = [lenient(F.col(k), "long").alias(k) for k in KEYS if k in types]
    raw = [F.col(c).alias(f"raw_{c}") for c in kinds if c in types]
    try:
        ordinal = F.concat_ws(":", F.lpad(F.lit(str(number)), 6, "0"), F.col("_metadata.file_path"), F.lpad(F.col("_metadata.row_index").cast("string"), 20, "0"))
        rows = shard.select(*keys, *raw, ordinal.alias(ORDINAL))
    except Exception as error:  # not read from files
        if "_metadata" not in str(error):
            raise
        rows = shard.select(*keys, *raw, F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0").alias(ORDINAL))
    if bounds:
        rows = rows.where(F.col("case_id").between(*bounds))
    if decisions is not None:
        rows = rows.join(decisions.select("case_id", "date_decision"), "case_id")
    out = [F.col(k) for k in KEYS if k in types]
    for c, meaning in kinds.items():
        here = F.col(f"raw_{c}")
        if meaning == "unsupported":
            continue
        if c not in types:
            out.append(F.lit(None).cast({"numeric": "double", "categorical": "string", "date": "float"}[meaning]).alias(c))
        elif meaning == "date":
            out.append(relative_days(here, types[c], F.col("date_decision") if decisions is not None else F.lit(None).cast("date")).alias(c))
        else:
            out.append(lenient(here, "double" if meaning == "numeric" else "string").alias(c))
    return rows.select(*out, ORDINAL)


def by_schema(spark: SparkSession, paths: list[str]) -> list[tuple[list[str], DataFrame]]:
    """Files of equal schema below the paths, and one frame over them all: a plan grows with schemas, not with shards.

    Schemas come from footers, read in tasks; one footer a schema is read on the driver.
    """
    if not paths:
        return []
    alike = described(spark, paths).groupBy("schema_sha256").agg(F.array_sort(F.collect_list("path")).alias("files")).orderBy(F.col("files")[0])
    groups = [r["files"] for r in alike.collect()]  # one name a file
    return [(files, spark.read.schema(read_shard(spark, files[0]).schema).parquet(*files)) for files in groups]


def scan_source(spark: SparkSession, paths: list[str], decisions: DataFrame | None, other_paths: list[str] | None = None, bounds: tuple[int, int] | None = None, check: bool = True) -> tuple[DataFrame, dict[str, str]]:
    """All shards of a source as one frame, and the meaning of its columns (other_paths: the other split's shards).

    Rows are stored in the order of their files' paths.
    """
    shards = [df for _, df in by_schema(spark, paths)]
    kinds = meanings([*shards, *(df for _, df in by_schema(spark, other_paths or []))])
    if decisions is not None and check:
        assert_unique(decisions, ["case_id"], "decisions")
    parts = [normalise(s, kinds, decisions, 0, bounds) for s in shards]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), kinds


def scan_base(spark: SparkSession, paths: list[str]) -> DataFrame:
    if len(paths) != 1:
        raise ValueError(f"a base is one file, not {len(paths)}")
    return spark.read.parquet(paths[0])
