"""Reads pinned by manifests, key parity and snapshots."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from caseloom.operators import joins
from caseloom.sources import manifest, snapshot, verified


def test_digests_of_any_size(spark, tmp_path):
    (tmp_path / "a b+c").mkdir()
    (tmp_path / "a b+c" / "x.bin").write_bytes(b"abc" * 3_000_000)
    with open(tmp_path / "big.bin", "wb") as f:  # beyond what Spark's reader of whole files takes
        f.truncate((2 << 30) + 10_000_000)
    want = hashlib.sha256()
    for _ in range(2147 + 10):
        want.update(bytes(1_000_000))
    want.update(bytes((2 << 30) + 10_000_000 - 2157 * 1_000_000))
    found = {r["file"]: (r["bytes"], r["sha256"]) for r in verified.tree_manifest(spark, str(tmp_path)).collect()}
    assert found == {"a b+c/x.bin": (9_000_000, hashlib.sha256(b"abc" * 3_000_000).hexdigest()), "big.bin": ((2 << 30) + 10_000_000, want.hexdigest())}


def test_differences_are_found_before_a_read(spark, tmp_path):
    folder = tmp_path / "t"
    spark.range(10).repartition(2).write.parquet(f"{folder}/one.parquet")
    spark.range(5).coalesce(1).write.parquet(f"{folder}/two.parquet")
    m = verified.tree_manifest(spark, str(folder), "*.parquet").cache()
    assert verified.read_verified(spark, str(folder), m).count() == 15
    (path,) = (folder / "two.parquet").glob("*.parquet")
    data = path.read_bytes()
    for change, problem in ((data[:-1], "bytes"), (b"X" + data[1:], "sha256"), (None, "missing")):
        path.unlink() if change is None else path.write_bytes(change)
        assert [r["problem"] for r in verified.differences(spark, str(folder), m, "*.parquet").collect()] == [problem]
        with pytest.raises(ValueError, match=problem):
            verified.read_verified(spark, str(folder), m)
    path.write_bytes(data)
    (folder / "two.parquet" / "late.parquet").write_bytes(data)
    with pytest.raises(ValueError, match="extra"):
        verified.read_verified(spark, str(folder), m)
    with pytest.raises(ValueError, match="there twice"):
        (folder / "one.parquet" / "late.parquet").write_bytes(data)
        manifest.verify(spark.createDataFrame([("late.parquet", "k", 1, "0" * 64)], manifest.MANIFEST), manifest.directory_manifest(spark, str(folder)))


def test_locations_and_attributes(spark, tmp_path):
    assert verified.Location.parse("s3://b/k/x.parquet").hadoop == "s3a://b/k/x.parquet"
    for odd in ("b/k", "s3://b", "s3://b/", "s3:///k", "ftp://b/k", "s3://b/a/../k", "s3://b//k"):
        with pytest.raises(ValueError):
            verified.Location.parse(odd)
    m = spark.createDataFrame([("a", "f" * 64), ("b", "0" * 64)], "file string, sha256 string")
    of = {"a": {verified.ENCRYPTION: "AES256", verified.STORED_DIGEST: "f" * 64}, "b": {verified.STORED_DIGEST: "1" * 64}}
    assert verified.attribute_faults(spark, "s3a://b/k", m, attributes_of=lambda _, path: of[path[-1]]) == [("b", "encryption"), ("b", "sha256")]
    (tmp_path / "x").write_text("x")
    assert verified.STORED_DIGEST not in verified.stored_attributes(spark, f"file:{tmp_path}/x")


def test_fold_predictions_are_pinned_and_aligned(spark, tmp_path):
    rows = spark.createDataFrame([(k, 10 + k % 4, k % 2, 1 + k % 4 // 2, k / 40) for k in range(40)], "case_id long, WEEK_NUM int, target int, fold int, prediction double")
    folds = {1: (10, 11), 2: (12, 13)}

    def stored(name, df):
        df.write.parquet(f"{tmp_path}/{name}")
        return f"{tmp_path}/{name}", verified.tree_manifest(spark, f"{tmp_path}/{name}", "*.parquet")

    a, b = stored("a", rows), stored("b", rows.withColumn("prediction", F.col("prediction") / 2))
    found = verified.read_fold_predictions(spark, {"a": a, "b": b}, folds, 40)
    assert found.columns[0] == "model" and found.count() == 80
    odd = {
        "40 rows outside": rows.withColumn("fold", F.lit(3)),
        "1 predictions outside": rows.withColumn("prediction", F.when(F.col("case_id") == 3, 1.5).otherwise(F.col("prediction"))),
        "41 rows of 40 cases": rows.unionAll(rows.limit(1)),
        "no column target": rows.drop("target"),
        "case 7 changed": rows.withColumn("target", F.when(F.col("case_id") == 7, 0).otherwise(F.col("target"))),
    }
    for k, (words, df) in enumerate(odd.items()):
        with pytest.raises(ValueError, match=words):
            verified.read_fold_predictions(spark, {"a": a, "odd": stored(f"odd{k}", df)}, folds)
    with pytest.raises(ValueError, match="folder of its own"):
        verified.read_fold_predictions(spark, {"a": a, "b": a}, folds)
    path = next((tmp_path / "b").glob("*.parquet"))
    path.write_bytes(path.read_bytes()[:-4] + b"PAR2")
    with pytest.raises(ValueError, match="sha256"):
        verified.read_fold_predictions(spark, {"a": a, "b": b}, folds)


def test_keys_of_all_blocks_in_one_pass(spark):
    ids = lambda *k: spark.createDataFrame([(x,) for x in k], "case_id long")
    found = joins.key_parity({"train": {"base": ids(1, 2, 3), "a": ids(1, 2, 2, 9, None), "b": ids(3, 2, 1)}, "test": {"base": ids(5), "a": ids(), "b": ids(5, 6)}})
    assert sorted(map(tuple, found.collect())) == [("test", "a", 1, 0, 0), ("test", "b", 0, 1, 0), ("train", "a", 1, 1, 1), ("train", "b", 0, 0, 0)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("FullOuter") == 0
    with pytest.raises(ValueError, match="needs base"):
        joins.key_parity({"train": {"a": ids(1)}})


def test_snapshots_are_checked_as_a_whole(spark, tmp_path):
    def write(folder, **odd):
        base = spark.createDataFrame([(k, k % 2, k) for k in range(6)], "case_id long, target int, WEEK_NUM int")
        block = base.select("case_id", F.col("case_id").cast("double").alias("xA"))
        tables = {"train_base": base, "train_h_1": block, "test_base": base.drop("target"), "test_h_1": block} | odd
        for name, df in tables.items():
            df.write.parquet(f"{tmp_path}/{folder}/{name}.parquet")
        return f"{tmp_path}/{folder}", verified.tree_manifest(spark, f"{tmp_path}/{folder}", "*.parquet"), block

    folder, m, block = write("good")
    found = snapshot.load_snapshot(spark, folder, m)
    assert [f.name for f in found.features] == ["WEEK_NUM", "xA"] and {*found.blocks["test"]} == {"base", "h__d1"}
    assert found.parity.where("missing + extra + nulls > 0").count() == 0
    for k, (words, odd) in enumerate({"1 keys missing": {"test_h_1": block.where("case_id != 3")}, "1 beside": {"train_h_1": block.unionAll(block.limit(1).withColumn("case_id", F.lit(77).cast("long")))}, "differs between": {"test_h_1": block.withColumn("xA", F.lit("x"))}, "hold the target": {"test_h_1": block.withColumn("target", F.lit(1))}, "test alone": {"test_h_1": block.withColumn("yA", F.lit(1.0))}}.items()):
        with pytest.raises(ValueError, match=words):
            snapshot.load_snapshot(spark, *write(f"odd{k}", **odd)[:2])
    assert snapshot.load_snapshot(spark, *write("partial", test_h_1=block.where("case_id != 3"))[:2], complete=False)
    (tmp_path / "good" / "train_h_1.parquet" / "x.parquet").write_bytes(b"PAR1")
    with pytest.raises(ValueError, match="extra"):
        snapshot.load_snapshot(spark, folder, m)
