"""Manifests of stored files, logical sources, and sinks."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.functions.schema import Sealed, TableIdentity, fingerprint, parse_file_name
from caseloom.operators.frames import block_totals

from .footers import list_files
from .verified import digested

MANIFEST = "file string, key string, bytes long, sha256 string"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of file, key, bytes and sha256; all valid, no file or key twice."""
    rows = spark.read.schema(MANIFEST).json(path, mode="FAILFAST")
    bad = rows.where("file IS NULL OR key IS NULL OR bytes IS NULL OR bytes < 0 OR NOT coalesce(sha256, '') RLIKE '^[0-9a-f]{64}$'")
    if bad.head(1):
        raise ValueError("the manifest has an invalid row")
    for c in ("file", "key"):
        if rows.groupBy(c).count().where("count > 1").head(1):
            raise ValueError(f"the manifest names a {c} twice")
    return rows


def parquet_records(manifest: DataFrame) -> DataFrame:
    return manifest.where(F.col("file").endswith(".parquet")).orderBy("file")


def directory_manifest(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, bytes and sha256 of each file below a folder; contents are streamed by tasks."""
    return digested(spark, path, glob).orderBy("path")


def verify(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """Manifest rows whose file is missing, or differs in size or digest. A name that two found files share is refused."""
    names = found.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("bytes").alias("found_bytes"), F.col("sha256").alias("found_sha256"))
    if twice := names.join(manifest.select("file"), "file", "left_semi").groupBy("file").count().where("count > 1").head(1):
        raise ValueError(f"{twice[0]['file']} is there twice: name files by their paths, and use differences()")
    return manifest.join(names, "file", "left").where("found_bytes IS NULL OR bytes != found_bytes OR sha256 != found_sha256")


def local_records(spark: SparkSession, path: str) -> list[str]:
    """Paths of test_*.parquet; a name in two places is refused."""
    paths = sorted(r[0] for r in list_files(spark, [path], "test_*.parquet").collect())
    names = [p.rpartition("/")[2] for p in paths]
    if len(set(names)) < len(names):
        raise ValueError("a file name appears twice")
    return paths


@dataclass(frozen=True)
class LogicalSource:
    split: str
    family: str
    depth: int
    files: tuple[str, ...]


def logical_sources(files: list[str]) -> list[LogicalSource]:
    """Shards by split, family and depth, files in order."""
    grouped: dict[tuple[str, str, int], list[str]] = {}
    for f in sorted(files):
        t: TableIdentity = parse_file_name(f.rpartition("/")[2])
        grouped.setdefault((t.split, t.family, t.depth), []).append(f)
    return [LogicalSource(*k, tuple(v)) for k, v in sorted(grouped.items())]


def select_sources(sources: list[LogicalSource], splits: set[str], families: set[str] | None = None) -> list[LogicalSource]:
    """A base always stays for its split."""
    return [s for s in sources if s.split in splits and (families is None or s.family == "base" or s.family in families)]


def write_block(block: DataFrame, path: str, key: str = "case_id") -> None:
    """Parquet by zstd, in ranges of the key and sorted within them; an existing path is refused."""
    block.repartitionByRange(key).sortWithinPartitions(key).write.option("compression", "zstd").parquet(path)


def write_lines(rows: DataFrame, path: str) -> None:
    rows.write.json(path)


def write_document(spark: SparkSession, payload: dict, path: str) -> None:
    """One JSON file with sorted keys, put in place by a rename; a file that holds anything else is refused."""
    data = json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()
    place, early = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.{uuid.uuid4().hex}"))
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(place):
        out = system.create(early, False)
        out.write(bytearray(data))
        out.close()
        if system.rename(early, place):
            return
        system.delete(early, False)  # another run was first
    if spark.read.text(path, wholetext=True).first()[0].encode() != data:
        raise ValueError(f"{path} holds another document")


def read_document(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def feature_manifest(blocks: Mapping[str, DataFrame]) -> dict:
    """Totals, columns and schema fingerprints of blocks, sealed by a digest: one entry a block."""
    totals = {r["block"]: r.asDict() for r in block_totals(blocks).collect()}  # one row a block
    entries = [totals[b] | {"schema_sha256": fingerprint([(f.name, f.dataType.simpleString(), True) for f in df.schema]), "columns": df.columns} for b, df in sorted(blocks.items())]
    whole = {k: sum(e[k] for e in entries) for k in ("feature_columns", "categorical_columns")}
    return Sealed({"blocks": entries, "totals": whole | {"blocks": len(entries)}}).payload()


def write_feature_manifest(spark: SparkSession, blocks: Mapping[str, DataFrame], path: str) -> dict:
    found = feature_manifest(blocks)
    write_document(spark, found, path)
    return found


def write_submission(predictions: DataFrame, path: str, key: str = "case_id", value: str = "prediction") -> None:
    """CSV that reads back to the same doubles (17 digits, by Java's rules); existing output is refused unless it holds the same rows."""
    rows = predictions.select(F.col(key).cast("string").alias(key), F.format_string("%.17g", value).alias(value))
    spark = predictions.sparkSession
    try:
        rows.repartitionByRange(key).sortWithinPartitions(key).write.option("header", "true").csv(path)
    except Exception as error:
        if "PATH_ALREADY_EXISTS" not in str(error):
            raise
        old = spark.read.option("header", "true").schema(rows.schema).csv(path)
        if old.exceptAll(rows).head(1) or rows.exceptAll(old).head(1):
            raise ValueError(f"{path} holds other predictions") from error
