"""Scoring in batches that can be resumed: all open batches are written by one job, and a manifest says what is done.

A batch is a range of cases. Its predictions are a partition of one table, and count as done only when the manifest
holds its number of rows, their digest, and the identity of the run: a digest of the inputs, the features, the model
and the size of batches. Done batches are checked against their digests and read; the others are scored together and
overwrite what an interrupted run may have left in their partitions. Another identity is refused.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from caseloom.sources.workspace import exists

from .blocks import case_partitions
from .frames import CASE, Feature, inference_frame

MANIFEST = "part int, n_rows long, digest string, identity string"


def content_digest(df: DataFrame, columns: Sequence[str]) -> str:
    """Of the rows of these columns as a bag, with their names and types: one pass, whatever the order of rows."""
    chosen = df.select(*[F.col(f"`{c}`") for c in columns])
    row = F.xxhash64(*[F.col(f"`{c}`") for c in columns])
    again = F.xxhash64(F.lit(1), *[F.col(f"`{c}`") for c in columns])
    found = chosen.agg(F.count(F.lit(1)), F.sum(row.cast("decimal(38,0)")), F.sum(again.cast("decimal(38,0)"))).first()
    return hashlib.sha256(json.dumps([chosen.dtypes, *map(str, found)]).encode()).hexdigest()


def inputs_digest(base: DataFrame, blocks: Mapping[str, DataFrame], features: Sequence[Feature]) -> str:
    """Of the cases and of the features in use."""
    parts = [content_digest(base, [CASE])]
    parts += [content_digest(blocks[b], [CASE, *[f.name for f in features if f.block == b]]) for b in dict.fromkeys(f.block for f in features)]
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def numbered(rows: DataFrame, starts: list[int], parts: list[int]) -> DataFrame:
    """rows with the number of the range that their case is in; ranges are given by their least cases, in order."""
    place = rows.columns.index(CASE)
    schema = StructType([*rows.schema.fields, StructField("part", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.searchsorted(starts, b.column(place).to_numpy(), "right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.array(parts, np.int32)[at])], schema.names)

    return rows.mapInArrow(run, schema)


def _contents(rows: DataFrame) -> DataFrame:
    """part, n_rows, digest, and how many cases and faults there are."""
    p = F.col("prediction")
    total = F.sum(F.xxhash64(CASE, "prediction").cast("decimal(38,0)"))
    return rows.groupBy("part").agg(F.count(F.lit(1)).alias("n_rows"), F.sha2(F.concat_ws(":", F.count(F.lit(1)), total).cast("binary"), 256).alias("digest"), F.count_distinct(CASE).alias("cases"), F.count_if(p.isNull() | F.isnan(p) | (p < 0) | (p > 1)).alias("faults"))


def score_batches(
    base: DataFrame,
    blocks: Mapping[str, DataFrame],
    features: Sequence[Feature],
    score: Callable[[DataFrame], DataFrame],
    folder: str,
    rows: int,
    model: str = "",
    inputs: str | None = None,
) -> DataFrame:
    """case_id, prediction and part of all cases of a base, by score(inference_frame), in ranges of at most rows cases.

    score gives case_id and prediction, of which each case must have one in [0, 1]. model is a digest of the model;
    inputs one of what base and blocks were read from, worked out from their rows if it is not given.
    """
    if rows < 1:
        raise ValueError("a batch holds at least one case")
    spark = base.sparkSession
    content = {"features": [(f.name, f.block, f.kind) for f in features], "inputs": inputs or inputs_digest(base, blocks, features), "model": model, "rows": rows}
    identity = hashlib.sha256(json.dumps(content, sort_keys=True).encode()).hexdigest()
    ranges = sorted(case_partitions(base, rows).collect(), key=lambda r: r["part"])  # one row a batch
    table, manifest = f"{folder}/parts", f"{folder}/manifest"
    done = {r["part"]: r for r in spark.read.schema(MANIFEST).json(manifest).collect()} if exists(spark, manifest) else {}
    if any(r["identity"] != identity for r in done.values()):
        raise ValueError(f"{folder} holds batches of other inputs, features or another model")
    shape = "case_id long, prediction double, part int"
    if done:
        stored = {r["part"]: r for r in _contents(spark.read.schema(shape).parquet(table).where(F.col("part").isin([*done]))).collect()}
        if odd := sorted(k for k, r in done.items() if k not in stored or stored[k]["digest"] != r["digest"]):
            raise ValueError(f"batch {odd[0]} is not what the manifest says")
    wanted = [r for r in ranges if r["part"] not in done]
    if wanted:
        starts, parts = [r["least"] for r in ranges], [r["part"] for r in ranges]
        in_ranges = F.col("part").isin([r["part"] for r in wanted])
        cases = numbered(base.select(F.col(CASE).cast("long").alias(CASE)), starts, parts).where(in_ranges).select(CASE) if done else None
        scored = score(inference_frame(base, blocks, features, cases)).select(F.col(CASE).cast("long").alias(CASE), F.col("prediction").cast("double").alias("prediction"))
        made = numbered(scored, starts, parts).repartition("part")
        made.write.partitionBy("part").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(table)
        found = {r["part"]: r for r in _contents(spark.read.schema(shape).parquet(table).where(in_ranges)).collect()}
        for r in wanted:
            have = found.get(r["part"])
            if not have or not have["n_rows"] == have["cases"] == r["n_cases"] or have["faults"]:
                raise ValueError("predictions do not cover the cases one to one, or lie outside [0, 1]")
        lines = [(r["part"], r["n_rows"], r["digest"], identity) for r in found.values()]
        spark.createDataFrame(lines, MANIFEST).coalesce(1).write.mode("append").json(manifest)
    return spark.read.schema(shape).parquet(table).where(F.col("part").isin([r["part"] for r in ranges]))
