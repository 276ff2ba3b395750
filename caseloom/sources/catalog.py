"""Profiles of tables, and the structural contract they must keep."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass
from functools import reduce
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.functions.schema import DATE_SUFFIX, by_type, classify, fingerprint, parse_file_name, typed

from .footers import Opener, described, max_missing, open_file, qualified, stored_path


@dataclass(frozen=True)
class CatalogEntry:
    """What is known of one file; profile() fills the counts."""

    file: str
    split: str
    family: str
    depth: int
    rows: int
    columns: tuple[tuple[str, str], ...]
    bytes: int = 0
    null_case_ids: int = 0
    unique_cases: int = 0
    max_rows_per_case: int = 0
    #: Of stored files: from their footers; unknown for frames, and missing values for folders of several files.
    row_groups: int | None = None
    max_missing: float | None = None

    @property
    def fingerprint(self) -> str:
        return fingerprint([(n, t, True) for n, t in self.columns])


def type_counts(df: DataFrame) -> dict[str, int]:
    kinds = [classify(f.name, f.dataType) for f in df.schema]
    return {k: kinds.count(k) for k in ("numeric", "categorical", "date")}


def profile(df: DataFrame, key: str = "case_id") -> DataFrame:
    """One row: n_rows, n_columns, null_keys, unique_keys, max_rows_per_key, max_missing_fraction.

    Values are counted without a shuffle; only keys and their numbers are shuffled.
    """
    known = df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count(F.col(c)).alias(f"c{i}") for i, c in enumerate(df.columns)])
    most = F.greatest(*[1 - F.col(f"c{i}") / F.col("n_rows") for i in range(len(df.columns))], F.lit(0.0)) if df.columns else F.lit(0.0)
    per_key = df.groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    keys = per_key.agg(
        F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("n"))), F.lit(0)).alias("null_keys"),
        F.count("k").alias("unique_keys"),
        F.coalesce(F.max(F.when(F.col("k").isNotNull(), F.col("n"))), F.lit(0)).alias("max_rows_per_key"),
    )
    whole = known.crossJoin(keys)  # one row each
    return whole.select("n_rows", F.lit(len(df.columns)).cast("long").alias("n_columns"), "null_keys", "unique_keys", "max_rows_per_key", F.when(F.col("n_rows") > 0, most).alias("max_missing_fraction"))


def frame_entry(df: DataFrame, file: str, size: int = 0) -> CatalogEntry:
    """What a catalog holds of a frame that is stored under this name."""
    t = parse_file_name(file.rstrip("/").rpartition("/")[2])
    columns = tuple((f.name, f.dataType.simpleString()) for f in df.schema)
    p = profile(df).first() if "case_id" in df.columns else {"n_rows": df.count(), "null_keys": 0, "unique_keys": 0, "max_rows_per_key": 0}
    return CatalogEntry(file, t.split, t.family, t.depth, p["n_rows"], columns, size, p["null_keys"], p["unique_keys"], p["max_rows_per_key"])


def catalog_entry(spark: SparkSession, path: str, size: int = 0) -> CatalogEntry:
    return frame_entry(spark.read.parquet(path), path, size)


def build_catalog(spark: SparkSession, paths: list[str], key: str = "case_id", opener: Opener = open_file) -> list[CatalogEntry]:
    """Entries of many files, or folders of files: sizes, columns and missing values from footers, keys by a scan of the key alone.

    One row a file reaches the driver. A scan that does not count the rows that the footers state is refused.
    """
    found = [r.asDict() for r in described(spark, paths, opener).select("path", "bytes", "rows", "row_groups", "schema_sha256", max_missing().alias("max_missing"), F.transform("columns", lambda c: F.struct(c["name"].alias("name"), c["kind"].alias("kind"))).alias("columns")).collect()]
    given = {plain(qualified(spark, p)): p for p in paths}
    for r in found:
        r["source"] = next((given[x] for x in _upwards(r["path"]) if x in given), None)
    if odd := sorted(r["path"] for r in found if r["source"] is None):
        raise ValueError(f"listed below no given path: {odd[0]}")
    if empty := sorted({*paths} - {r["source"] for r in found}):
        raise ValueError(f"no files below {empty[0]}")
    profiles = _key_profiles(spark, found, key)
    entries = []
    for path in paths:
        own = [r for r in found if r["source"] == path]
        t = parse_file_name(path.rstrip("/").rpartition("/")[2])
        columns = tuple((c["name"], c["kind"]) for c in own[0]["columns"])
        n, size = (sum(r[k] for r in own) for k in ("rows", "bytes"))
        nulls, kinds, most, counted = profiles.get(path, (0, 0, 0, 0))
        if counted != n and key in dict(columns):
            raise ValueError(f"{path}: the scan counts {counted} rows, the footers {n}")
        groups = None if any(r["row_groups"] is None for r in own) else sum(r["row_groups"] for r in own)
        missing = max((r["max_missing"] for r in own if r["max_missing"] is not None), default=None) if len(own) == 1 else None
        entries.append(CatalogEntry(path, t.split, t.family, t.depth, n, columns, size, nulls, kinds, most, groups, missing))
    return sorted(entries, key=lambda e: e.file)


def plain(path: str) -> str:
    return re.sub("^file:/+", "file:/", path)


def _upwards(path: str) -> Iterator[str]:
    while path:
        yield path
        path = path.rpartition("/")[0]


def _key_profiles(spark: SparkSession, found: list[dict], key: str) -> dict[str, tuple[int, int, int, int]]:
    """Null keys, distinct keys, most rows a key, and rows, of each source, from the key column of its files alone."""
    of = spark.createDataFrame([(r["path"], r["source"]) for r in found], "path string, source string")
    parts = []
    for kind, files in _by(found, lambda r: next((c["kind"] for c in r["columns"] if c["name"] == key), None)).items():
        if kind is not None:  # keys of equal type are read together
            rows = spark.read.schema(f"`{key}` {kind}").parquet(*[r["path"] for r in files])
            per_file = rows.groupBy(stored_path().alias("path"), F.col(f"`{key}`").cast("string").alias("k")).agg(F.count(F.lit(1)).alias("n"))
            parts.append(per_file)
    if not parts:
        return {}
    met = reduce(DataFrame.unionAll, parts).join(of, "path", "left")
    per_key = met.groupBy("source", "k").agg(F.sum("n").alias("n"))
    known = F.col("k").isNotNull()
    per_source = per_key.groupBy("source").agg(F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)), F.count("k"), F.coalesce(F.max(F.when(known, F.col("n"))), F.lit(0)), F.sum("n"))
    stored = {r[0]: tuple(r)[1:] for r in per_source.collect()}  # one row a source
    if None in stored:
        raise ValueError(f"{stored[None][3]} rows come from files that were not listed")
    return stored


def _by(rows: list[dict], key: Callable[[dict], object]) -> dict:
    grouped: dict = {}
    for r in rows:
        grouped.setdefault(key(r), []).append(r)
    return grouped


def summarise(spark: SparkSession, entries: list[CatalogEntry]) -> DataFrame:
    """Per split, family and depth: files, rows, bytes and the distinct schemas."""
    rows = [(e.split, e.family, e.depth, e.rows, e.bytes, e.fingerprint) for e in entries]
    df = spark.createDataFrame(rows, "split string, family string, depth int, rows long, bytes long, schema string")
    return df.groupBy("split", "family", "depth").agg(F.count(F.lit(1)).alias("files"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"), F.array_sort(F.collect_set("schema")).alias("schemas"))


def schema_frame(df: DataFrame) -> DataFrame:
    rows = [(f.name, f.dataType.simpleString()) for f in df.schema]
    return df.sparkSession.createDataFrame(rows, "name string, kind string")


def schema_diff(left: DataFrame, right: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(name, difference) for schemas as frames of name and kind: missing_left, missing_right or type:left/right."""
    a = left.where(~F.col("name").isin(*exclude)).select("name", F.col("kind").alias("l")) if exclude else left.select("name", F.col("kind").alias("l"))
    b = right.where(~F.col("name").isin(*exclude)).select("name", F.col("kind").alias("r")) if exclude else right.select("name", F.col("kind").alias("r"))
    how = F.when(F.col("l").isNull(), "missing_left").when(F.col("r").isNull(), "missing_right").when(F.col("l") != F.col("r"), F.concat(F.lit("type:"), "l", F.lit("/"), "r"))
    return a.join(b, "name", "full").select("name", how.alias("difference")).where("difference IS NOT NULL")


def _family(name: str, kind: str) -> str:
    if name.endswith(DATE_SUFFIX):
        return "date"
    if kind == "void":
        return "any"
    return {"numeric": "numeric", "categorical": "text", "date": "time"}.get(by_type(typed(kind)), kind)


def compatible(name: str, a: str, b: str) -> bool:
    x, y = _family(name, a), _family(name, b)
    return x == y or "any" in (x, y)


def _logical_clashes(a: CatalogEntry, b: CatalogEntry, exclude: tuple[str, ...] = ()) -> list[str]:
    x, y = ({n: t for n, t in e.columns if n not in exclude} for e in (a, b))
    return sorted([f"missing:{n}" for n in x.keys() ^ y.keys()] + [f"type:{n}" for n in x.keys() & y.keys() if not compatible(n, x[n], y[n])])


def validate(entries: list[CatalogEntry], may_be_empty: tuple[str, ...] = ()) -> dict[str, list[str]]:
    """errors and warnings of the contract: identity, keys, bases, static tables, drift within and between splits."""
    errors: list[str] = []
    warnings: list[str] = []

    def need(ok: bool, what: str) -> None:
        if not ok:
            errors.append(what)

    need(bool(entries), "the catalog is empty")
    need(len({e.file for e in entries}) == len(entries), "a file is listed twice")
    for e in entries:
        names = [n for n, _ in e.columns]
        need(bool(names), f"{e.file}: no schema")
        need(len(set(names)) == len(names), f"{e.file}: a column appears twice")
        need("case_id" in names, f"{e.file}: no case_id")
        need(e.null_case_ids == 0, f"{e.file}: null case_id")
        if e.split == "train":
            need(e.rows > 0, f"{e.file}: no rows")
        else:
            need((e.rows == 0) <= (e.file in may_be_empty), f"{e.file}: no rows")
        need(e.file not in may_be_empty or e.rows == 0, f"{e.file}: has rows but is listed as empty")
        if e.depth == 0:
            need(e.max_rows_per_case <= 1, f"{e.file}: several rows a case in a static table")
    for split in ("train", "test"):
        here = [e for e in entries if e.split == split]
        bases = [e for e in here if e.family == "base"]
        if not here:
            warnings.append(f"no {split} split")
            continue
        need(len(bases) == 1, f"{split}: {len(bases)} bases")
        for e in bases:
            names = {n for n, _ in e.columns}
            need("WEEK_NUM" in names, f"{split}: no WEEK_NUM")
            need(("target" in names) == (split == "train"), f"{split}: target {'missing' if split == 'train' else 'present'}")
    key = lambda e: (e.family, e.depth)
    for (family, depth), group in groupby(sorted(entries, key=lambda e: (e.family, e.depth, e.split != "train", e.file)), key):
        first, *rest = list(group)
        for e in rest:
            exclude = ("target",) if family == "base" and e.split != first.split else ()
            if clash := _logical_clashes(first, e, exclude):
                errors.append(f"{family}_{depth}: {e.file} against {first.file}: {', '.join(clash)}")
            elif [c for c in first.columns if c[0] not in exclude] != [c for c in e.columns if c[0] not in exclude]:
                warnings.append(f"{family}_{depth}: {e.file} differs physically from {first.file}")
    return {"errors": errors, "warnings": warnings}


def contract_frame(spark: SparkSession, entries: list[CatalogEntry], may_be_empty: tuple[str, ...] = ()) -> DataFrame:
    """(check, passed, detail): what validate finds, one row a finding, and one that says whether there was any error."""
    found = validate(entries, may_be_empty)
    rows = [("contract", not found["errors"], f"{len(entries)} files")]
    rows += [(level, level == "warning", text) for level, texts in (("error", found["errors"]), ("warning", found["warnings"])) for text in texts]
    return spark.createDataFrame(rows, "check string, passed boolean, detail string")


def entries_frame(spark: SparkSession, entries: list[CatalogEntry]) -> DataFrame:
    names = "file string, split string, family string, depth int, rows long, bytes long, null_case_ids long, unique_cases long, max_rows_per_case long, row_groups int, max_missing double"
    rows = [(*(v for k, v in asdict(e).items() if k != "columns"), len(e.columns)) for e in entries]
    return spark.createDataFrame(rows, f"{names}, n_columns int")


def file_profiles(frames: dict[str, DataFrame], key: str) -> DataFrame:
    """profile() of several tables, with their names."""
    parts = [profile(df, key).withColumn("file", F.lit(name)) for name, df in frames.items()]
    return reduce(DataFrame.unionByName, parts)
