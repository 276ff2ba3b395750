"""A stored snapshot of feature blocks of both splits, checked as a whole before it is used."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.functions.schema import parse_file_name
from caseloom.operators.frames import Feature, check_parity, index_features
from caseloom.operators.joins import key_parity

from .footers import Opener, open_file
from .verified import verify_folder


@dataclass(frozen=True)
class Snapshot:
    blocks: dict[str, dict[str, DataFrame]]
    features: list[Feature]
    parity: DataFrame


def load_snapshot(spark: SparkSession, folder: str, manifest: DataFrame, complete: bool = True, opener: Opener = open_file) -> Snapshot:
    """Blocks of train and test below a folder, one Parquet file or folder a block, pinned by a manifest.

    Refused: other files, sizes or digests; blocks of one split alone; a target in test; a feature in two blocks, or of
    another type in the other split; null keys and keys beside the base's, and, if blocks are to be complete, missing ones.
    """
    files = verify_folder(spark, folder, manifest, opener=opener)
    blocks: dict[str, dict[str, DataFrame]] = {"train": {}, "test": {}}
    for name in sorted({f.split("/")[0] for f in files if ".parquet" in f}):
        t = parse_file_name(name)
        block = "base" if t.family == "base" else f"{t.family}__d{t.depth}"
        if block in blocks[t.split]:
            raise ValueError(f"{t.split} holds {block} twice")
        blocks[t.split][block] = spark.read.parquet(f"{folder.rstrip('/')}/{name}")
    check_parity(blocks["train"], blocks["test"])
    features, test = index_features(blocks["train"]), {(f.name, f.block): f.kind for f in index_features(blocks["test"])}
    for f in features:
        if test.pop((f.name, f.block), None) != f.kind:
            raise ValueError(f"{f.name} of {f.block} differs between the splits")
    if test:
        raise ValueError(f"features of test alone: {', '.join(n for n, _ in sorted(test))}")
    parity = key_parity(blocks)
    odd = (F.col("extra") > 0) | (F.col("nulls") > 0) | ((F.col("missing") > 0) if complete else F.lit(False))
    if bad := parity.where(odd).orderBy("split", "block").head(1):
        raise ValueError(f"{bad[0]['split']} {bad[0]['block']}: {bad[0]['missing']} keys missing, {bad[0]['extra']} beside the base, {bad[0]['nulls']} null")
    return Snapshot(blocks, features, parity)
