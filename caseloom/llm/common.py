"""Pieces that the corpus operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words of digits, ASCII letters and anything outside ASCII.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_own_folder: list[str] = []
#: Paths that materialize has written and nothing has deleted yet; those of the current run of settled, in its thread.
_written: set[str] = set()
_run: ContextVar[list[str] | None] = ContextVar("run", default=None)
_path_of: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or in local mode a folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="spark-caseloom-"))
        atexit.register(shutil.rmtree, _own_folder[0], ignore_errors=True)
    return f"file://{_own_folder[0]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/caseloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.add(path)
    if (own := _run.get()) is not None:
        own.append(path)
    found = spark.read.schema(df.schema).parquet(path)
    _path_of[found] = path
    return found


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    _written.discard(path)


def discard(df: DataFrame) -> None:
    """Delete what materialize wrote for df, which nothing reads any more. Other frames are left alone."""
    if (path := _path_of.pop(df, None)) in _written:
        _delete(df.sparkSession, path)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """make() materialised; what was materialised on the way to it, in this thread, is deleted. Other threads' is left alone."""
    outer, own = _run.get(), []
    token = _run.set(own)
    try:
        found = materialize(make(), name)
    finally:
        _run.reset(token)
    kept = _path_of[found]
    for path in own:
        if path != kept and path in _written:
            _delete(found.sparkSession, path)
    if outer is not None:
        outer.append(kept)
    return found


def discard_all(spark: SparkSession) -> None:
    """Delete all that materialize has written in this process; call it when no result is read any more."""
    for path in [*_written]:
        _delete(spark, path)


def schema_with(df: DataFrame, more: str) -> StructType:
    """The schema of df and then the fields of more, a DDL string."""
    return StructType([*df.schema.fields, *StructType.fromDDL(more).fields])


def beside(columns: list[pa.Array], more: list[pa.Array], schema: StructType) -> pa.RecordBatch:
    """Columns of a batch and then more. Unlike pandas, Arrow keeps whole numbers exact in columns with nulls."""
    return pa.RecordBatch.from_arrays([*columns, *more], schema.names)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt anew where a few large row groups would leave most cores without work; else df itself."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone. lower() is quicker and the same where all is ASCII."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def words(text: Column) -> Column:
    """Words of a text, case kept; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


KEY = ["k_a", "k_b", "k_len"]


def row_key(id_col: Column, text: Column) -> list[Column]:
    """Columns without nulls that tell rows apart when ids repeat: rows of one id and text share their result."""
    return [F.xxhash64(id_col, text).alias("k_a"), F.hash(text, id_col).alias("k_b"), F.coalesce(F.length(text), F.lit(-1)).alias("k_len")]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(*row_key(F.col(id_col), F.col(text_col)), F.col(id_col).alias("k_id"), F.col(text_col).alias("k_body"))


def bucket(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus: the split that train and held-out rows are told by."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus
