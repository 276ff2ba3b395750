"""What Parquet footers know of stored files: Spark lists the files, tasks read the footers, no data page is touched.

A footer is read by Arrow through the file system that its path names. Where Arrow has no such file system, the same
numbers are counted by Spark's own readers in a scan, and row groups are unknown (null).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.functions.schema import fingerprint

#: nulls, least and greatest are null where a row group does not state them, or the column is nested.
COLUMN = "name:string,kind:string,nulls:long,least:string,greatest:string"
FOOTER = f"path string, bytes long, rows long, row_groups int, footer_bytes long, schema_sha256 string, columns array<struct<{COLUMN}>>"
ROW_GROUP = "path string, row_group int, rows long, bytes long, nulls long, least string, greatest string"

Opener = Callable[[str], BinaryIO]


def plain_path(path: Column) -> Column:
    """Local paths come with one slash or three."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def stored_path() -> Column:
    """_metadata.file_path as the listing names it: there it is an encoded URI."""
    return plain_path(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))))


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its file system, as Spark's listings have it."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(own).toString()


def list_files(spark: SparkSession, paths: list[str], glob: str = "*.parquet") -> DataFrame:
    """path and bytes of each file below the paths. Contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(paths)
    return found.select(plain_path(F.col("path")).alias("path"), F.col("length").alias("bytes"))


def open_file(path: str) -> BinaryIO:
    if path.startswith(("file:", "/")):
        return open("/" + path.removeprefix("file:").lstrip("/"), "rb")
    system, inner = pa.fs.FileSystem.from_uri(quote(path, safe=":/@+=,;&~"))
    return system.open_input_file(inner)


def reachable(path: str) -> bool:
    """Whether Arrow has a file system for a path of this kind."""
    try:
        return path.startswith(("file:", "/")) or bool(pyarrow.fs.FileSystem.from_uri(quote(path, safe=":/@+=,;&~")))
    except (OSError, pa.ArrowException):
        return False


def kind_of(found: pa.DataType) -> str:
    from pyspark.sql.pandas.types import from_arrow_type

    try:
        return from_arrow_type(found).simpleString()
    except Exception:  # a type that Spark has no name for keeps Arrow's
        return str(found)


def _flat(meta: pq.FileMetaData) -> dict[str, int]:
    """Place among the leaves of each column that is a leaf itself."""
    leaves = [meta.schema.column(k) for k in range(meta.num_columns)]
    return {leaf.name: k for k, leaf in enumerate(leaves) if leaf.path == leaf.name and leaf.max_repetition_level == 0}


def _statistics(meta: pq.FileMetaData, place: int | None, groups: list[int]) -> tuple[int | None, str | None, str | None]:
    """Nulls, least and greatest over row groups; each is known if all of them state it, or hold nothing but nulls."""
    if place is None or not groups:
        return (None if place is None else 0), None, None
    of = [meta.row_group(g).column(place).statistics for g in groups]
    counted = all(s is not None and s.has_null_count for s in of)
    nulls = sum(s.null_count for s in of) if counted else None
    valued = [s for s, g in zip(of, groups, strict=True) if not (counted and s.null_count == meta.row_group(g).num_rows)]
    if not valued or not all(s is not None and s.has_min_max for s in valued):
        return nulls, None, None
    return nulls, str(min(s.min for s in valued)), str(max(s.max for s in valued))


def describe(path: str, size: int, meta: pq.FileMetaData) -> tuple:
    fields = [(f.name, kind_of(f.type)) for f in meta.schema.to_arrow_schema()]
    flat = _flat(meta)
    groups = [g for g in range(meta.num_row_groups) if meta.row_group(g).num_rows]
    columns = [dict(zip(("name", "kind", "nulls", "least", "greatest"), (n, k, *_statistics(meta, flat.get(n), groups)), strict=True)) for n, k in fields]
    return path, size, meta.num_rows, meta.num_row_groups, meta.serialized_size, fingerprint([(n, k, True) for n, k in fields]), columns


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def in_tasks(files: DataFrame, rows_of: Callable[[str, int], list[tuple]], ddl: str) -> DataFrame:
    """rows_of each listed file, in a few tasks a core however many files there are."""
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [r for path, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r in rows_of(path, size)]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in made], schema=schema)

    cores = files.sparkSession.sparkContext.defaultParallelism
    return files.select("path", "bytes").coalesce(4 * cores).mapInArrow(run, ddl)


def footers(files: DataFrame, opener: Opener = open_file) -> DataFrame:
    """FOOTER of each listed file, one row a file."""

    def one(path: str, size: int) -> list[tuple]:
        with opener(path) as f:
            return [describe(path, size, pq.read_metadata(f))]

    return in_tasks(files, one, FOOTER)


def row_groups(files: DataFrame, key: str, opener: Opener = open_file) -> DataFrame:
    """ROW_GROUP of each row group: its size and the bounds of a key, for planning bounded scans."""

    def each(path: str, size: int) -> list[tuple]:
        with opener(path) as f:
            meta = pq.read_metadata(f)
        place = _flat(meta).get(key)
        return [(path, g, meta.row_group(g).num_rows, meta.row_group(g).total_byte_size, *_statistics(meta, place, [g])) for g in range(meta.num_row_groups)]

    return in_tasks(files, each, ROW_GROUP)


def scanned(files: DataFrame) -> DataFrame:
    """FOOTER counted by Spark's readers, for file systems that Arrow does not know: a plan for each file."""
    spark = files.sparkSession
    parts = []
    for path, size in files.collect():  # one row a file
        df = spark.read.parquet(path)
        flat = {f.name for f in df.schema if f.dataType.typeName() not in ("array", "map", "struct", "variant")}
        fields = [(f.name, f.dataType.simpleString()) for f in df.schema]
        c = lambda n: F.col(f"`{n}`")
        known = [F.count_if(c(n).isNull()) if n in flat else F.lit(None).cast("long") for n, _ in fields]
        ends = [[f(c(n)).cast("string") if n in flat else F.lit(None).cast("string") for f in (F.min, F.max)] for n, _ in fields]
        columns = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(k).alias("kind"), nulls.alias("nulls"), low.alias("least"), high.alias("greatest")) for (n, k), nulls, (low, high) in zip(fields, known, ends, strict=True)])
        parts.append(df.agg(F.lit(path).alias("path"), F.lit(size).alias("bytes"), F.count(F.lit(1)).alias("rows"), F.lit(None).cast("int").alias("row_groups"), F.lit(None).cast("long").alias("footer_bytes"), F.lit(fingerprint([(n, k, True) for n, k in fields])).alias("schema_sha256"), columns.alias("columns")))
    return reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], FOOTER)


def described(spark: SparkSession, paths: list[str], opener: Opener = open_file) -> DataFrame:
    """FOOTER of all files below the paths."""
    files = list_files(spark, paths)
    return footers(files, opener) if opener is not open_file or all(reachable(qualified(spark, p)) for p in paths) else scanned(files)


def max_missing() -> Column:
    """Of a FOOTER row: the largest share of nulls among columns whose nulls are known; 0 without rows, null without such columns."""
    known = F.filter("columns", lambda c: c["nulls"].isNotNull())
    return F.when(F.size(known) > 0, F.when(F.col("rows") == 0, 0.0).otherwise(F.array_max(F.transform(known, lambda c: c["nulls"] / F.col("rows")))))


def column_of(name: Column) -> Column:
    """Of a FOOTER row: what is known of the column of this name."""
    return F.get(F.filter("columns", lambda c: c["name"] == name), F.lit(0))


def file_catalog(found: DataFrame, key: str = "case_id") -> DataFrame:
    """One row a file: sizes, numbers of columns by meaning, missing values, and the bounds of the key."""
    of = column_of(F.lit(key))
    known = F.size(F.filter("columns", lambda c: c["nulls"].isNotNull()))
    return found.select("path", "bytes", "rows", "row_groups", "footer_bytes", "schema_sha256", F.size("columns").alias("n_columns"), known.alias("known_null_columns"), max_missing().alias("max_missing"), of["nulls"].alias("null_keys"), of["least"].alias("least_key"), of["greatest"].alias("greatest_key"))


def table_catalog(found: DataFrame, source: Column) -> DataFrame:
    """FOOTER rows of files put together by source: files, rows, bytes, and the largest share of nulls of a column.

    A column counts as known if all files that have it state its nulls. least_key and greatest_key are those of each
    file's first column, which must hold whole numbers.
    """
    named = found.withColumn("source", source).withColumn("first", F.get("columns", F.lit(0)))
    ends = [F.min(F.col("first.least").try_cast("long")).alias("least_key"), F.max(F.col("first.greatest").try_cast("long")).alias("greatest_key")]
    tables = named.groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.sum("rows").alias("n_rows"), F.sum("bytes").alias("bytes"), *ends)
    each = named.select("source", "rows", F.explode("columns").alias("c"))
    columns = each.groupBy("source", "c.name").agg(F.when(F.count_if(F.col("c.nulls").isNull()) == 0, F.coalesce(F.try_divide(F.sum("c.nulls"), F.sum("rows")), F.lit(0.0))).alias("missing"))
    known = columns.groupBy(F.col("source").alias("of")).agg(F.count(F.lit(1)).alias("n_columns"), F.count("missing").alias("known_null_columns"), F.max("missing").alias("max_missing"))
    return tables.join(known, F.col("source").eqNullSafe(F.col("of"))).drop("of")
