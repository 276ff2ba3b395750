"""Reads that are refused before any row is used: sets of files, sizes and digests against a manifest.

Listing is Spark's, digests are streamed by tasks in pieces, so a file's size does not matter. Where Arrow has no file
system for a path, contents go through Spark's reader of whole files, which ends at 2 GB a file.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.operators.joins import aligned_violations

from .footers import Opener, in_tasks, list_files, open_file, plain_path, qualified, reachable

PIECE = 4 << 20
DIGEST = "path string, bytes long, sha256 string"
#: How object stores show encryption at rest and a stored digest among a file's attributes.
ENCRYPTION, STORED_DIGEST = "header.x-amz-server-side-encryption", "header.x-amz-meta-sha256"


@dataclass(frozen=True)
class Location:
    """scheme://store/key, each part present."""

    scheme: str
    store: str
    key: str

    @classmethod
    def parse(cls, uri: str, schemes: tuple[str, ...] = ("s3", "s3a", "gs", "abfss", "hdfs")) -> Location:
        scheme, _, rest = uri.partition("://")
        store, _, key = rest.partition("/")
        if scheme not in schemes or not store or not key:
            raise ValueError(f"not a scheme://store/key of {', '.join(schemes)}: {uri}")
        if any(part in ("", ".", "..") for part in key.rstrip("/").split("/")):
            raise ValueError(f"the key is not in its plain form: {uri}")
        return cls(scheme, store, key)

    @property
    def hadoop(self) -> str:
        """As Spark reads it."""
        return f"{'s3a' if self.scheme == 's3' else self.scheme}://{self.store}/{self.key}"


def digests(files: DataFrame, opener: Opener = open_file) -> DataFrame:
    """path, bytes (as read) and sha256 of each listed file, a piece in memory at a time."""

    def one(path: str, size: int) -> list[tuple]:
        found, n = hashlib.sha256(), 0
        with opener(path) as f:
            while piece := f.read(PIECE):
                found.update(piece)
                n += len(piece)
        return [(path, n, found.hexdigest())]

    return in_tasks(files, one, DIGEST)


def digested(spark: SparkSession, folder: str, glob: str = "*", opener: Opener = open_file) -> DataFrame:
    """path, bytes and sha256 of each file below a folder."""
    if opener is not open_file or reachable(qualified(spark, folder)):
        return digests(list_files(spark, [folder], glob), opener)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    return files.select(plain_path(F.col("path")).alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def relative(spark: SparkSession, folder: str, found: DataFrame) -> DataFrame:
    """found with file, the path below the folder, in place of path."""
    root = qualified(spark, folder).rstrip("/")
    return found.select(F.substr("path", F.lit(len(root) + 2)).alias("file"), *[c for c in found.columns if c != "path"])


def tree_manifest(spark: SparkSession, folder: str, glob: str = "*", opener: Opener = open_file) -> DataFrame:
    """file (below the folder), bytes and sha256 as they are now, in the order of files: one row a file, held by the driver."""
    found = relative(spark, folder, digested(spark, folder, glob, opener)).orderBy("file").collect()
    return spark.createDataFrame(found, DIGEST.replace("path", "file"))


def differences(spark: SparkSession, folder: str, manifest: DataFrame, glob: str = "*", opener: Opener = open_file) -> DataFrame:
    """(file, problem) where the files below a folder are not those of a manifest (file, bytes, sha256).

    problem: missing, extra, bytes, or sha256 of files whose size fits.
    """
    there = relative(spark, folder, digested(spark, folder, glob, opener)).select(F.col("file").alias("there"), F.col("bytes").alias("n"), F.col("sha256").alias("d"))
    met = manifest.select("file", "bytes", "sha256").join(there, F.col("file") == F.col("there"), "full")
    problem = F.when(F.col("there").isNull(), "missing").when(F.col("file").isNull(), "extra").when(F.col("bytes") != F.col("n"), "bytes").when(F.col("sha256") != F.col("d"), "sha256")
    return met.select(F.coalesce("file", "there").alias("file"), problem.alias("problem")).where("problem IS NOT NULL")


def verify_folder(spark: SparkSession, folder: str, manifest: DataFrame, glob: str = "*", opener: Opener = open_file) -> list[str]:
    """Files of the manifest, in order, once all is as it says; otherwise the first problem is raised."""
    if bad := differences(spark, folder, manifest, glob, opener).orderBy("file").head(1):
        raise ValueError(f"{folder}: {bad[0]['file']} ({bad[0]['problem']})")
    return [r[0] for r in manifest.select("file").orderBy("file").collect()]


def read_verified(spark: SparkSession, folder: str, manifest: DataFrame, glob: str = "*.parquet", opener: Opener = open_file) -> DataFrame:
    """The Parquet files below a folder, once they are exactly those of the manifest."""
    files = verify_folder(spark, folder, manifest, glob, opener)
    return spark.read.parquet(*[f"{folder.rstrip('/')}/{f}" for f in files])


def stored_attributes(spark: SparkSession, path: str) -> dict[str, str]:
    """What the store keeps beside a file; nothing where the file system has no attributes."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        found = place.getFileSystem(spark._jsc.hadoopConfiguration()).getXAttrs(place)
    except Exception as error:
        if "UnsupportedOperation" in f"{type(error).__name__} {error}" or "doesn't support getXAttrs" in str(error):
            return {}
        raise
    return {k: bytes(v).decode() for k, v in dict(found).items()}


def attribute_faults(spark: SparkSession, folder: str, manifest: DataFrame, encryption: str | None = "AES256", attributes_of: Callable[[SparkSession, str], Mapping[str, str]] = stored_attributes) -> list[tuple[str, str]]:
    """(file, problem) where a store's attributes lack the encryption or state another digest. One request a file; no content is read."""
    found = []
    for r in manifest.select("file", "sha256").orderBy("file").collect():  # one row a file
        of = attributes_of(spark, f"{folder.rstrip('/')}/{r['file']}")
        if encryption is not None and of.get(ENCRYPTION) != encryption:
            found.append((r["file"], "encryption"))
        if of.get(STORED_DIGEST) != r["sha256"]:
            found.append((r["file"], "sha256"))
    return found


PREDICTION = ["case_id", "WEEK_NUM", "target", "fold", "prediction"]


def read_fold_predictions(spark: SparkSession, sources: Mapping[str, tuple[str, DataFrame]], folds: Mapping[int, tuple[int, int]], n_rows: int | None = None, opener: Opener = open_file) -> DataFrame:
    """model and PREDICTION of several models, read from folders pinned by manifests, and aligned.

    sources: model -> (folder, manifest). folds: number -> first and last validation week. All files are verified before
    any row is read. Models must hold the same cases with the same week, target and fold, each case once, weeks that
    belong to the fold, and predictions in [0, 1].
    """
    if len({f for f, _ in sources.values()}) < len(sources) or not sources:
        raise ValueError("each model needs a folder of its own")
    frames = {}
    for model, (folder, manifest) in sources.items():
        found = read_verified(spark, folder, manifest, opener=opener)
        if gone := [c for c in PREDICTION if c not in found.columns]:
            raise ValueError(f"{model}: no column {', '.join(gone)}")
        frames[model] = found.select(*PREDICTION)
    p, week = F.col("prediction"), F.col("WEEK_NUM")
    of_fold = reduce(lambda a, b: a | b, [(F.col("fold") == k) & week.between(*span) for k, span in folds.items()])
    for model, df in frames.items():
        n, cases, odd, bad = df.agg(F.count(F.lit(1)), F.count_distinct("case_id"), F.count_if(~F.coalesce(of_fold, F.lit(False))), F.count_if(p.isNull() | F.isnan(p) | (p < 0) | (p > 1))).first()
        if n != cases or (n_rows is not None and n != n_rows):
            raise ValueError(f"{model}: {n} rows of {cases} cases")
        if odd or bad:
            raise ValueError(f"{model}: {odd} rows outside their fold, {bad} predictions outside [0, 1]")
    if problem := aligned_violations(frames, "case_id", ["target", "WEEK_NUM", "fold"]).head(1):
        raise ValueError(f"{problem[0]['model']}: case {problem[0]['case_id']} {problem[0]['problem']}")
    return reduce(DataFrame.unionAll, [df.select(F.lit(m).alias("model"), *PREDICTION) for m, df in frames.items()])
