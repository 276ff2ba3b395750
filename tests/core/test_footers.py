"""Catalogs from Parquet footers, against full scans."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from caseloom.sources import catalog, footers, scan


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Files of two schemas, several row groups, nulls, no statistics in places; the path needs encoding."""
    path = tmp_path_factory.mktemp("with space+plus%20é")
    for k in range(3):
        ids = pa.array([k * 100 + i // 3 if i % 10 else None for i in range(90)], pa.int64())
        x = pa.array([None if i % (k + 2) == 0 else i / 7 for i in range(90)], pa.float64())
        pq.write_table(pa.table({"case_id": ids, "xA": x, "list": pa.array([[1, None]] * 90)}), f"{path}/train_h_1_{k}.parquet", row_group_size=40)
    t = pa.table({"case_id": pa.array([1, 2, 3], pa.int32()), "nM": pa.array(["a", None, None]), "emptyA": pa.array([None] * 3, pa.float64())})
    pq.write_table(t, f"{path}/train_other_0.parquet", write_statistics=["case_id", "emptyA"])
    pq.write_table(t.slice(0, 0), f"{path}/test_other_0.parquet")
    return str(path)


def listed(df):
    return {r["path"].rpartition("/")[2]: r for r in df.collect()}


def test_footers_equal_a_scan(spark, folder):
    found = listed(footers.file_catalog(footers.described(spark, [folder])))
    counted = listed(footers.file_catalog(footers.scanned(footers.list_files(spark, [folder]))))
    assert len(found) == 5 and {n: r["row_groups"] for n, r in found.items() if "_h_" in n} == {f"train_h_1_{k}.parquet": 3 for k in range(3)}
    for name, r in found.items():
        same = ["path", "bytes", "rows", "n_columns", "schema_sha256", "null_keys"] + (["max_missing", "known_null_columns", "least_key", "greatest_key"] if "other" not in name else [])
        assert [r[c] for c in same] == [counted[name][c] for c in same]
    other = found["train_other_0.parquet"]
    assert (other["known_null_columns"], other["max_missing"], other["least_key"], other["greatest_key"]) == (2, 1.0, "1", "3"), "a column without statistics is skipped"
    empty = found["test_other_0.parquet"]
    assert (empty["rows"], empty["max_missing"], empty["least_key"]) == (0, 0.0, None)
    assert counted["train_other_0.parquet"]["known_null_columns"] == 3


def test_bounds_of_row_groups(spark, folder):
    files = footers.list_files(spark, [folder], "train_h_1_0.parquet")
    got = [(r["row_group"], r["rows"], r["nulls"], r["least"], r["greatest"]) for r in footers.row_groups(files, "case_id").orderBy("row_group").collect()]
    assert got == [(0, 40, 4, "0", "13"), (1, 40, 4, "13", "26"), (2, 10, 1, "27", "29")]
    assert {r["nulls"] for r in footers.row_groups(files, "list").collect()} == {None}


def test_footers_alone_are_read(spark, tmp_path):
    pq.write_table(pa.table({"case_id": pa.array(range(400_000)), "xA": pa.array([k * 0.37 for k in range(400_000)])}), f"{tmp_path}/train_big_1.parquet")
    log = f"{tmp_path}/log"

    def counting(path):
        f = footers.open_file(path)
        read, size = f.read, [0]

        class Counted:
            closed = False

            def read(self, n=-1):
                data = read(n)
                with open(log, "a") as out:
                    out.write(f"{len(data)}\n")
                return data

            def __getattr__(self, name):
                return getattr(f, name)

            def __enter__(self):
                return self

            def __exit__(self, *_):
                f.close()

        return Counted()

    r = footers.footers(footers.list_files(spark, [str(tmp_path)]), counting).first()
    assert r["rows"] == 400_000 and r["bytes"] > 2_000_000
    assert 0 < sum(map(int, open(log))) < 150_000


def test_catalog_of_encoded_paths(spark, folder):
    paths = [f"{folder}/train_h_1_{k}.parquet" for k in range(3)] + [f"{folder}/train_other_0.parquet"]
    entries = {e.file: e for e in catalog.build_catalog(spark, paths)}
    for path in paths:
        want = catalog.frame_entry(spark.read.parquet(path), path)
        e = entries[path]
        assert (e.rows, e.columns, e.null_case_ids, e.unique_cases, e.max_rows_per_case) == (want.rows, want.columns, want.null_case_ids, want.unique_cases, want.max_rows_per_case)
        assert e.rows > 0 and e.bytes > 0
    assert entries[paths[0]].row_groups == 3 and entries[paths[0]].max_missing == 0.5
    rows = catalog.entries_frame(spark, [*entries.values()]).where("row_groups = 3").count()
    assert rows == 3


def test_catalog_of_a_folder_counts_a_case_once(spark, tmp_path):
    rows = spark.range(60).select((F.col("id") % 7).alias("case_id"), F.col("id").alias("xA"))
    rows.repartition(4).write.parquet(f"{tmp_path}/train_h_1.parquet")
    (e,) = catalog.build_catalog(spark, [f"{tmp_path}/train_h_1.parquet"])
    assert (e.rows, e.unique_cases, e.max_rows_per_case, e.row_groups) == (60, 7, 9, 4)


def test_what_does_not_match_is_refused(spark, folder, tmp_path, monkeypatch):
    (tmp_path / "train_none_0.parquet").mkdir()
    with pytest.raises(ValueError, match="no files below"):
        catalog.build_catalog(spark, [f"{folder}/train_other_0.parquet", f"{tmp_path}/train_none_0.parquet"])
    monkeypatch.setattr(catalog, "stored_path", lambda: F.lit("file:/elsewhere"))
    with pytest.raises(ValueError, match="not listed"):
        catalog.build_catalog(spark, [f"{folder}/train_other_0.parquet"])


def test_file_systems_without_arrow_are_scanned(spark, folder, monkeypatch):
    assert footers.reachable("file:/x") and not footers.reachable("nosuchfs://a/b")
    monkeypatch.setattr(footers, "reachable", lambda path: False)
    r = listed(footers.described(spark, [folder]))["train_h_1_1.parquet"]
    assert (r["rows"], r["row_groups"]) == (90, None)
    assert len(scan.by_schema(spark, [folder])) == 2


def test_shards_of_a_source_are_read_from_encoded_paths(spark, folder):
    paths = [f"{folder}/train_h_1_{k}.parquet" for k in range(3)]
    found, kinds = scan.scan_source(spark, paths, None)
    assert kinds["xA"] == "numeric" and found.count() == 270
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
