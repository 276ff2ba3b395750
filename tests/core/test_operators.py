"""Literal frames, traps of null and type, guards, files and streams."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from caseloom.functions import schema
from caseloom.functions.columns import calendar, decision_date, finite, relative_days, safe_ratio, sample_hash
from caseloom.operators import batches, blocks, encode, frames, history, joins, learning, metrics, ranks, selection, temporal
from caseloom.sources import catalog, manifest, scan
from caseloom.streaming.weekly import weekly_counts


def one(df):
    return df.first().asDict()


# names and meaning


@pytest.mark.parametrize("name, want", [("train_base.parquet", ("train", "base", 0, None)), ("test_credit_bureau_a_2_5.parquet", ("test", "credit_bureau_a", 2, 5)), ("train_static_0_1.parquet", ("train", "static", 0, 1)), ("train_person_1.parquet", ("train", "person", 1, None))])
def test_file_names(name, want):
    t = schema.parse_file_name(name)
    assert (t.split, t.family, t.depth, t.shard) == want


@pytest.mark.parametrize("name", ["train.parquet", "valid_base.parquet", "train_person.parquet", "train_person_1.csv"])
def test_bad_file_names(name):
    with pytest.raises(ValueError):
        schema.parse_file_name(name)


def test_meaning_of_columns(spark):
    found = [schema.classify(n, schema.typed(k)) for n, k in [("case_id", "bigint"), ("openedD", "string"), ("amountA", "void"), ("kindM", "void"), ("xL", "boolean"), ("x", "binary"), ("x", "array<string>"), ("y", "decimal(10,2)"), ("z", "void"), ("w", "timestamp_ntz")]]
    assert found == ["structural", "date", "numeric", "categorical", "categorical", "unsupported", "categorical", "numeric", "unsupported", "date"]


def test_meaning_over_shards():
    found = schema.resolve([{"aA": "numeric", "bM": "numeric", "cL": "numeric", "dD": "date", "eL": "unsupported"}, {"aA": "categorical", "bM": "numeric", "cL": "categorical"}])
    assert found == {"aA": "numeric", "bM": "categorical", "cL": "categorical", "dD": "date", "eL": "unsupported"}


def test_leaks_names_and_digests():
    with pytest.raises(ValueError, match="score"):
        schema.assert_no_leak(["a", "score"], "t")
    assert schema.feature_name("person", 1, "amountA", "mean", "applicant") == "person__d1__applicant__amountA__mean"
    a, b = ("x", "int", True), ("y", "string", True)
    assert schema.fingerprint([a, b]) != schema.fingerprint([b, a])
    payload = schema.Sealed({"weeks": [1, 2], "name": "é"}).payload()
    assert payload["protocol_sha256"] == hashlib.sha256('{"name":"é","weeks":[1,2]}'.encode()).hexdigest()
    assert schema.Sealed.opened(payload).payload() == payload
    with pytest.raises(ValueError):
        schema.Sealed.opened(payload | {"weeks": [2]})


# dates, casts and other traps


def test_dates(spark):
    rows = [("2020-02-29", dt.date(2020, 2, 29)), ("2020/01/31", None), ("2020-01-31 00:00:00", None), (None, None), ("x", None)]
    df = spark.createDataFrame(rows, "t string, d date")
    assert all(r[0] == r[1] for r in df.select(decision_date(F.col("t"), df.schema["t"].dataType), "d").collect())
    leap = one(df.limit(1).select(*[c.alias(k) for k, c in calendar(F.col("d")).items()]))
    assert leap == {"year": 2020, "month": 2, "day": 29, "weekday": 6, "ordinal_day": 60}
    forms = spark.createDataFrame([("2020/02/20",), ("20.02.2020",), ("20-02-2020",), ("02-2020",), ("2020-02-30",)], "t string")
    assert [r[0] for r in forms.select(relative_days(F.col("t"), forms.schema["t"].dataType, F.lit("2020-02-19").cast("date"))).collect()] == [1.0, 1.0, 1.0, None, None]
    days = df.limit(1).select(relative_days(F.lit("2020-02-19"), df.schema["t"].dataType, F.col("d")), relative_days(F.lit(-3), spark.range(1).schema["id"].dataType, F.col("d"))).first()
    assert tuple(days) == (-10.0, -3.0)


def test_traps(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,)], "x double")
    assert [r[0] for r in df.select(finite(F.col("x"))).collect()] == [1.0, None, None, None]
    assert tuple(spark.range(1).select(safe_ratio(F.lit(2), F.lit(0)), sample_hash(F.lit(-5), 0)).first()) == (None, (-5 * 1103515245) % 2147483647)


# history


@pytest.fixture(scope="module")
def cases(spark):
    rows = [(1, 2, 30.0, "b", -10.0), (1, 0, 10.0, "a", -40.0), (1, 1, None, None, 5.0), (2, 0, None, None, None)]
    return spark.createDataFrame(rows, "case_id long, num_group1 long, amountA double, kindM string, eventD double")


def test_history_of_literal_cases(cases):
    found = history.aggregate_history(cases, "h", 1, ["amountA"], ["kindM"], ["eventD"])
    a, b = (found.where(f"case_id = {k}").first().asDict() for k in (1, 2))
    get = lambda r, *n: [r["h__d1__" + x] for x in n]
    assert get(a, "rows__count", "num_group1__max", "num_group1__n_unique", "amountA__min", "amountA__mean", "amountA__sum", "amountA__first", "amountA__last") == [3, 2, 3, 10.0, 20.0, 40.0, 10.0, 30.0]
    assert get(a, "kindM__non_null_count", "kindM__n_unique", "kindM__diversity_ratio", "kindM__first", "eventD__last", "eventD__count_last_30d", "eventD__count_last_180d") == [2, 3, 1.5, "a", -10.0, 1, 2]
    assert get(b, "amountA__sum", "amountA__std", "kindM__n_unique", "kindM__diversity_ratio", "eventD__count_last_30d", "row_missing_fraction__mean") == [0.0, None, 1, None, 0, 1.0]


def test_chunks_and_partitions_do_not_change_results(cases, monkeypatch):
    make = lambda df: sorted(map(str, (r.asDict() for r in history.aggregate_history(df, "h", 1, ["amountA"], ["kindM"], ["eventD"], subgroups=("all", "applicant", "related")).collect())))
    whole = make(cases)
    assert make(cases.repartition(7)) == whole
    large = history.aggregate_history(cases, "h", 1, ["amountA"], ["kindM"], ["eventD"], subgroups=("all", "applicant", "related"), large_cases=True)
    assert sorted(map(str, (r.asDict() for r in large.collect()))) == whole
    monkeypatch.setattr(history, "CHUNK", 5)
    assert make(cases) == whole


def test_no_row_is_multiplied(cases):
    plan = history.aggregate_history(cases, "h", 1, ["amountA"], ["kindM"], ["eventD"], subgroups=("all", "applicant", "related"))._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan
    screen = encode.structural_screen(cases, ["amountA", "kindM", "eventD"])._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in screen


def test_subgroups_and_nan(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 1, float("nan")), (1, 2, 4.0), (2, 3, float("nan"))], "case_id long, num_group1 long, xA double")
    found = {r["case_id"]: r for r in history.aggregate_history(df, "p", 1, ["xA"], subgroups=("all", "applicant", "related")).collect()}
    assert found[1]["p__d1__all__xA__max"] == 4.0 and found[1]["p__d1__related__xA__min"] == 4.0
    assert found[2]["p__d1__applicant__rows__count"] is None and math.isnan(found[2]["p__d1__all__xA__max"])


def test_depth_two_order(spark):
    df = spark.createDataFrame([(1, 0, 1, "b"), (1, 0, 0, "a"), (1, None, 5, "n"), (1, 2, 0, "z")], "case_id long, num_group1 long, num_group2 long, kM string")
    r = one(history.aggregate_history(df, "d", 2, categorical=["kM"]))
    assert (r["d__d2__kM__first"], r["d__d2__kM__last"], r["d__d2__num_group1__n_unique"]) == ("n", "z", 3)


# scans


def test_drifted_shards(spark, tmp_path):
    spark.createDataFrame([(1, 0, 1.5, 3.0)], "case_id long, num_group1 long, statusL double, amountA double").write.parquet(f"{tmp_path}/a")
    spark.createDataFrame([("2", 1, "x", "2020-01-01"), ("9", 0, "y", None)], "case_id string, num_group1 int, statusL string, openedD string").write.parquet(f"{tmp_path}/b")
    decisions = spark.createDataFrame([(1, dt.date(2020, 1, 11)), (2, dt.date(2020, 1, 11))], "case_id long, date_decision date")
    found, kinds = scan.scan_source(spark, [f"{tmp_path}/a", f"{tmp_path}/b"], decisions)
    assert kinds == {"amountA": "numeric", "openedD": "date", "statusL": "categorical"}
    rows = {r["case_id"]: r for r in found.collect()}
    assert set(rows) == {1, 2}
    assert (rows[1]["statusL"], rows[1]["amountA"], rows[1]["openedD"]) == ("1.5", 3.0, None)
    assert (rows[2]["statusL"], rows[2]["amountA"], rows[2]["openedD"]) == ("x", None, -10.0)
    bounded, _ = scan.scan_source(spark, [f"{tmp_path}/a", f"{tmp_path}/b"], decisions, bounds=(2, 5))
    assert [r["case_id"] for r in bounded.collect()] == [2]
    with pytest.raises(ValueError, match="not unique"):
        scan.scan_source(spark, [f"{tmp_path}/a"], decisions.unionAll(decisions))
    with pytest.raises(ValueError, match="target"):
        scan.normalise(decisions.withColumn("target", F.lit(1)), {}, None)


def test_shards_of_equal_schema_are_read_together(spark, tmp_path):
    for k in range(4):
        rows = [(k % 2, 7, float(10 * k + i)) for i in range(3)]
        spark.createDataFrame(rows, "case_id long, num_group1 long, xA double").coalesce(1).write.parquet(f"{tmp_path}/train_h_1_{k}.parquet")
    paths = [f"{tmp_path}/train_h_1_{k}.parquet" for k in range(4)]
    found, kinds = scan.scan_source(spark, paths, None)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    ends = {r["case_id"]: (r["h__d1__xA__first"], r["h__d1__xA__last"]) for r in history.aggregate_history(found, "h", 1, ["xA"]).collect()}
    assert ends == {0: (0.0, 22.0), 1: (10.0, 32.0)}, "equal group numbers keep the order of storage"
    entries = catalog.build_catalog(spark, paths)
    assert [(e.rows, e.unique_cases, e.max_rows_per_case, e.null_case_ids) for e in entries] == [(3, 1, 3, 0)] * 4 and all(e.bytes > 0 for e in entries)


def test_bounds_reach_the_file(spark, tmp_path):
    spark.range(10).select(F.col("id").alias("case_id"), F.col("id").cast("double").alias("xA")).write.parquet(f"{tmp_path}/t")
    found, _ = scan.scan_source(spark, [f"{tmp_path}/t"], None, bounds=(2, 4))
    plan = found._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(case_id,2)" in plan and found.count() == 3


# manifests, sinks, catalog


def test_manifest(spark, tmp_path):
    (tmp_path / "files").mkdir()
    body = b"hello"
    (tmp_path / "files" / "test_x_1.parquet").write_bytes(body)
    good = {"file": "test_x_1.parquet", "key": "k", "bytes": 5, "sha256": hashlib.sha256(body).hexdigest()}
    (tmp_path / "m.jsonl").write_text(json.dumps(good) + "\n" + json.dumps(good | {"file": "gone.csv", "key": "l"}) + "\n")
    m = manifest.read_manifest(spark, f"{tmp_path}/m.jsonl")
    assert [r["file"] for r in manifest.parquet_records(m).collect()] == ["test_x_1.parquet"]
    assert [r["file"] for r in manifest.verify(m, manifest.directory_manifest(spark, f"{tmp_path}/files")).collect()] == ["gone.csv"]
    assert len(manifest.local_records(spark, f"{tmp_path}/files")) == 1
    (tmp_path / "bad.jsonl").write_text((json.dumps(good) + "\n") * 2)
    with pytest.raises(ValueError, match="twice"):
        manifest.read_manifest(spark, f"{tmp_path}/bad.jsonl")


def test_logical_sources():
    found = manifest.logical_sources(["a/train_x_1_1.parquet", "a/train_x_1_0.parquet", "a/test_x_1.parquet", "a/train_base.parquet", "a/train_y_2.parquet"])
    assert [(s.split, s.family, s.depth, len(s.files)) for s in found] == [("test", "x", 1, 1), ("train", "base", 0, 1), ("train", "x", 1, 2), ("train", "y", 2, 1)]
    assert [s.family for s in manifest.select_sources(found, {"train"}, {"y"})] == ["base", "y"]


def test_sinks(spark, tmp_path):
    p = spark.createDataFrame([(2, 0.1), (1, 1 / 3)], "case_id long, prediction double")
    manifest.write_submission(p, f"{tmp_path}/s")
    manifest.write_submission(p, f"{tmp_path}/s")
    text = "".join(sorted(f.read_text() for f in (tmp_path / "s").glob("*.csv")))
    assert sorted(float(line.split(",")[1]) for line in text.split() if line[0].isdigit()) == [0.1, 1 / 3]
    with pytest.raises(ValueError, match="other predictions"):
        manifest.write_submission(p.withColumn("prediction", F.lit(0.5)), f"{tmp_path}/s")
    manifest.write_block(p, f"{tmp_path}/b")
    assert spark.read.parquet(f"{tmp_path}/b").count() == 2
    manifest.write_lines(p, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 2


def entry(file, split="train", family="base", depth=0, rows=5, columns=(("case_id", "bigint"), ("WEEK_NUM", "int"), ("target", "int")), **more):
    return catalog.CatalogEntry(file, split, family, depth, rows, tuple(columns), **more)


def test_contract(spark):
    test = entry("t", "test", columns=(("case_id", "bigint"), ("WEEK_NUM", "int")))
    assert catalog.validate([entry("a"), test]) == {"errors": [], "warnings": []}
    bad = {
        "empty": [],
        "no rows": [entry("a", rows=0), test],
        "null case_id": [entry("a", null_case_ids=1), test],
        "several rows": [entry("a", max_rows_per_case=2), test],
        "target present": [entry("a"), entry("t", "test")],
        "listed twice": [entry("a"), entry("a"), test],
        "no case_id": [entry("a", columns=(("WEEK_NUM", "int"), ("target", "int"))), test],
        "2 bases": [entry("a"), entry("b"), test],
        "type:xA": [entry("a"), test, entry("h0", "train", "h", 1, columns=(("case_id", "bigint"), ("xA", "double"))), entry("h1", "train", "h", 1, columns=(("case_id", "bigint"), ("xA", "string")))],
    }
    for words, entries in bad.items():
        assert any(words in e for e in catalog.validate(entries)["errors"]), words
    drift = [entry("h0", "train", "h", 1, columns=(("case_id", "bigint"), ("xA", "double"))), entry("h1", "train", "h", 1, columns=(("case_id", "bigint"), ("xA", "int")))]
    found = catalog.validate([entry("a"), test, *drift])
    assert not found["errors"] and any("physically" in w for w in found["warnings"])
    assert catalog.validate([entry("a")])["warnings"] == ["no test split"]
    assert [tuple(r)[:2] for r in catalog.contract_frame(spark, [entry("a", rows=0), test]).collect()] == [("contract", False), ("error", False)]


def test_catalog_entry_and_summary(spark, tmp_path):
    path = f"{tmp_path}/train_h_1.parquet"
    spark.createDataFrame([(k, 1.0) for k in (1, 1, 2, 3, 3, 3)], "case_id long, xA double").write.parquet(path)
    e = catalog.catalog_entry(spark, path)
    assert (e.rows, e.unique_cases, e.max_rows_per_case, e.family) == (6, 3, 3, "h")
    assert one(catalog.summarise(spark, [e, e]))["files"] == 2
    assert catalog.type_counts(spark.read.parquet(path)) == {"numeric": 1, "categorical": 0, "date": 0}


# joins and blocks


def test_joins_check_their_promise(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (9, "c")], "case_id long, x string")
    right = spark.createDataFrame([(1, 5), (2, 6)], "case_id long, y int")
    assert joins.many_to_one(left, right, ["case_id"]).count() == 2
    with pytest.raises(ValueError, match="not unique"):
        joins.many_to_one(left, right.unionAll(right), ["case_id"])
    with pytest.raises(ValueError, match="twice"):
        joins.one_to_one(right, [right], ["case_id"])
    with pytest.raises(ValueError, match="not unique"):
        joins.one_to_one(right, [left], ["case_id"])
    with pytest.raises(ValueError, match="without a prediction"):
        joins.in_sample_order(right, right.limit(1).select("case_id", F.lit(0.5).alias("prediction")), "case_id", "y")
    assert joins.same_rows(left, left.orderBy("x")) and not joins.same_rows(left, left.limit(1))
    assert joins.key_overlap(left, right, "case_id").count() == 1


def test_static_tables(spark):
    df = spark.createDataFrame([(1, 2, None), (1, 1, 5.0)], "case_id long, o int, xA double")
    assert one(blocks.static_block(df, "s", ["xA"], ["o"]))["s__d0__xA__value"] == 5.0
    with pytest.raises(ValueError, match="repeats"):
        blocks.static_block(df, "s", ["xA"], ["o"], strict=True)
    assert {r["check"] for r in blocks.block_contract(df, False).collect() if not r["passed"]} == {"case_id_unique"}


# folds


def test_folds():
    folds = temporal.expanding_folds(0, 72)
    assert [(f.validation_min, f.validation_max) for f in folds] == [(33, 40), (41, 48), (49, 56), (57, 64), (65, 72)]
    with pytest.raises(ValueError):
        temporal.expanding_folds(0, 50)
    with pytest.raises(ValueError):
        temporal.check_folds(folds[1:], 0, 72)
    with pytest.raises(ValueError):
        temporal.check_folds(folds[:-1], 0, 72)


# encoders


def test_encoders(spark):
    train = spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0), (3, "b", None), (4, None, float("inf"))], "case_id long, c string, x double")
    rest = spark.createDataFrame([(1, "a", 1.0), (2, "c", float("inf")), (3, None, None)], "case_id long, c string, x double")
    found = {r["case_id"]: (r["c"], r["x"]) for r in encode.frequency_encode(rest, encode.frequency_maps(train, ["c"]), ["c"], ["x"]).collect()}
    assert found == {1: (0.5, 1.0), 2: (0.0, None), 3: (0.25, None)}
    codes = {r["case_id"]: r["c"] for r in encode.encode_codes(rest, encode.category_codes(train, ["c"]), ["c"]).collect()}
    assert codes == {1: 2, 2: 0, 3: 1}
    p = {r["feature"]: r for r in encode.linear_parameters(train.withColumn("k", F.lit(7.0)), ["x", "k"]).collect()}
    assert (p["x"]["median"], p["x"]["mean"], p["k"]["scale"]) == (1.5, 1.5, 1.0)


def test_block_floor(spark):
    rows = [("a1", "a", 9.0, 1.0), ("a2", "a", 8.0, 1.0), ("a3", "a", 7.0, 1.0), ("b1", "b", 1.0, 1.0), ("b2", "b", 0.5, 1.0)]
    found = encode.select_with_floor(spark.createDataFrame(rows, "name string, block string, score double, target_gain double"), 3, 1)
    assert {r["name"] for r in found.collect()} == {"a1", "a2", "b1"}
    tight = encode.select_with_floor(spark.createDataFrame(rows[3:] + [("a0", "a", 0.1, 1.0)], "name string, block string, score double, target_gain double"), 2, 2)
    assert {r["name"] for r in tight.collect()} == {"a0", "b1"}
    with pytest.raises(ValueError):
        encode.select_with_floor(tight, 0, 1)


# metrics


def brute_auc(rows):
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg)) if pos and neg else None


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 5)), min_size=1, max_size=40))
def test_auc_equals_brute_force(spark, rows):
    df = spark.createDataFrame([(1, y, p / 1e12) for y, p in rows], "g int, target int, prediction double")
    found, want = metrics.auc(df, ["g"]).first()["auc"], brute_auc(rows)
    assert found == (pytest.approx(want) if want is not None else None)


def weekly(spark, ginis, start=10):
    return spark.createDataFrame([(1, start + k, g) for k, g in enumerate(ginis)], "g int, WEEK_NUM int, gini double")


@pytest.mark.parametrize("ginis, want", [([1.0, 0.5, 0.0], -43.5), ([0.0, 0.5, 1.0], 0.5), ([0.7, 0.7, 0.6, 0.6], 0.65 + 88 * -0.04 - 0.5 * math.sqrt(0.0005)), ([0.5, None, 0.5], 0.5), ([0.4], None)])
def test_stability(spark, ginis, want):
    found = metrics.stability(weekly(spark, ginis), ["g"]).first()["stability"]
    assert found == (pytest.approx(want) if want is not None else None)


def test_probability_suite(spark):
    rows = [(k, w, y, p) for w in (1, 2) for k, (y, p) in enumerate([(0, 0.1), (0, 0.2), (1, 0.8), (1, 0.9)])]
    df = spark.createDataFrame([(1, *r) for r in rows], "g int, case_id int, WEEK_NUM int, target int, prediction double")
    r = one(metrics.probability_metrics(df, ["g"]))
    assert (r["auc"], r["average_precision"], r["stability"]) == (1.0, 1.0, 1.0)
    assert r["brier"] == pytest.approx(0.025) and r["log_loss"] == pytest.approx(-math.log(0.9 * 0.8) / 2)
    assert metrics.correlation(df.withColumn("a", F.lit(1.0)), ["a", "prediction"]).first()["correlation"] is None


def test_reliability_sides(spark):
    df = spark.createDataFrame([(float(k // 2), k % 2) for k in range(8)], "prediction double, target int")
    upper = {r["bin"]: r["n_rows"] for r in metrics.reliability_quantile(df, 2).collect()}
    lower = {r["bin"]: r["n_rows"] for r in metrics.reliability_qcut(df, 2).collect()}
    assert sum(upper.values()) == sum(lower.values()) == 8
    same = df.withColumn("prediction", F.lit(0.5))
    assert metrics.reliability_qcut(same).count() == metrics.reliability_quantile(same).count() == 1


# selection


def test_candidates_and_weights(spark):
    found = selection.declared_blends(["a", "b", "c", "d"], "a", "b")
    assert len(dict(found)) == 15 and all(abs(sum(w for _, w in members) - 1) < 1e-12 for _, members in found)
    assert [m for m, _ in dict(found)["equal_without_control"]] == ["a", "c", "d"]
    for bad in ((("q", 1.0),), (("a", 0.5),), (("a", 1.5), ("b", -0.5))):
        with pytest.raises(ValueError):
            selection.check_blends([("x", bad)], ["a", "b"])
    with pytest.raises(ValueError, match="control"):
        selection.declared_blends(["a", "b"], "a", "z")


def test_later_folds_cannot_change_a_choice(spark):
    rows = [(c, f, float(v)) for c, vs in {"a": [1, 1, 1, 1], "b": [0, 3, 0, 9]}.items() for f, v in enumerate(vs, 1)]
    zero = [F.lit(0.0).alias(c) for c in ("mean_gini", "slope", "residual_std", "brier")]
    make = lambda x: {r["fold"]: r["candidate"] for r in selection.prequential(spark.createDataFrame(x, "candidate string, fold int, stability double").select("*", *zero), "a").collect()}
    assert make(rows) == {2: "a", 3: "b", 4: "a"}
    assert make([r if r[:2] != ("a", 4) else ("a", 4, -99.0) for r in rows]) == make(rows)


@pytest.mark.parametrize("key, better", [("mean_gini", 0.9), ("slope", 0.9), ("residual_std", -0.9), ("brier", -0.9)])
def test_equal_stability_is_told_apart_by_the_other_keys(spark, key, better):
    keys = ["stability", "mean_gini", "slope", "residual_std", "brier"]
    rows = [(c, f, *[better if c == "b" and k == key else 0.1 for k in keys]) for c in "ab" for f in (1, 2)]
    found = selection.prequential(spark.createDataFrame(rows, "candidate string, fold int, " + ", ".join(f"{k} double" for k in keys)), "a")
    assert one(found)["candidate"] == "b"


# frames


def test_feature_frames(spark):
    base = spark.createDataFrame([(k, k % 2, k // 2) for k in range(12)], "case_id long, target int, WEEK_NUM int")
    block = spark.createDataFrame([(k, float(k), "x") for k in range(0, 12, 3)], "case_id long, xA double, kM string")
    features = frames.index_features({"base": base, "b": block})
    assert [(f.name, f.block, f.categorical) for f in features] == [("kM", "b", True), ("xA", "b", False), ("WEEK_NUM", "base", False)]
    with pytest.raises(ValueError, match="is in b and in c"):
        frames.index_features({"b": block, "c": block})
    with pytest.raises(ValueError, match="one split"):
        frames.check_parity({"a": base, "b": block}, {"a": base})
    with pytest.raises(ValueError, match="hold the target"):
        frames.check_parity({"a": base}, {"a": base})
    train, rest = frames.fold_frames(base, {"base": base, "b": block}, features, (0, 2), (3, 4))
    assert (train.count(), rest.count()) == (6, 4) and train.where("xA IS NULL").count() == 4
    with pytest.raises(ValueError, match="reach into"):
        frames.fold_frames(base, {}, [], (0, 3), (3, 4))
    small = frames.fold_frames(base, {"b": block}, features[:2], (0, 2), (3, 5), caps=(2, 3))
    assert [x.count() for x in small] == [2, 3] and [sorted(x.collect()) for x in frames.fold_frames(base, {"b": block}, features[:2], (0, 2), (3, 5), caps=(2, 3))] == [sorted(x.collect()) for x in small]
    bad = {r["check"]: r["violations"] for r in frames.frame_violations(base.unionAll(base.limit(1)), (0, 3)).collect()}
    assert (bad["case_id_repeated"], bad["week_outside"], bad["one_class"]) == (1, 4, 0)


def test_batches_score_like_the_whole(spark):
    base = spark.createDataFrame([(k, "2020-01-01", 0) for k in range(6)], "case_id long, date_decision string, WEEK_NUM int")
    block = spark.createDataFrame([(k, float(k)) for k in range(3)], "case_id long, xA double")
    features = frames.index_features({"b": block})
    whole = frames.inference_frame(base, {"b": block}, features)
    parts = [frames.inference_frame(base, {"b": block}, features, base.where(w)) for w in ("case_id < 2", "case_id >= 2")]
    assert joins.same_rows(whole, frames.concat_exact(parts, ["case_id"])) and whole.where("xA IS NULL").count() == 3
    for odd, words in ((base.withColumn("target", F.lit(1)), "target_present"), (base.unionAll(base), "case_id_repeated"), (base.withColumn("case_id", F.lit(-1)), "negative"), (base.withColumn("case_id", F.lit(0.5)), "not_whole"), (base.withColumn("date_decision", F.lit("x")), "date_invalid"), (base.limit(0), "empty")):
        with pytest.raises(ValueError, match=words):
            frames.inference_frame(odd, {"b": block}, features)
    with pytest.raises(ValueError, match="blocks are missing"):
        frames.inference_frame(base, {}, features)
    with pytest.raises(ValueError, match="features are missing"):
        frames.inference_frame(base, {"b": block.drop("xA")}, features)
    with pytest.raises(ValueError, match="unknown"):
        frames.inference_frame(base, {"b": block}, features, base.select((F.col("case_id") + 1).alias("case_id")))
    with pytest.raises(ValueError, match="another schema"):
        frames.concat_exact([whole, whole.withColumn("xA", F.lit(1))])


def test_batches_are_scored_once(spark, tmp_path):
    base = spark.createDataFrame([(k, "2020-01-01", 0) for k in range(70)], "case_id long, date_decision string, WEEK_NUM int")
    block = spark.createDataFrame([(k, k / 100) for k in range(70)], "case_id long, xA double")
    features, seen = frames.index_features({"b": block}), []

    def score(frame):
        seen.append(frame.count())
        return frame.select("case_id", F.col("xA").alias("prediction"))

    run = lambda score=score, base=base, block=block, folder="s", **more: batches.score_batches(base, {"b": block}, features, score, f"{tmp_path}/{folder}", 3, **more)
    for _ in range(2):
        assert sorted((r["case_id"], r["prediction"], r["part"]) for r in run().collect()) == [(k, k / 100, k // 3) for k in range(70)]
    assert seen == [70], "24 ranges in one go, and none again"
    for path in (tmp_path / "s" / "manifest").glob("part-*.json"):  # an interrupted run: two batches are not in the manifest
        lines = [x for x in path.read_text().splitlines() if json.loads(x)["part"] not in (4, 9)]
        path.write_text("\n".join(lines))
        (path.parent / f".{path.name}.crc").unlink(missing_ok=True)
    assert run().count() == 70 and seen == [70, 6]
    for odd in ({"model": "other"}, {"base": base.where("case_id < 60")}, {"block": block.withColumn("xA", F.col("xA") / 2)}):
        with pytest.raises(ValueError, match="other inputs"):
            run(**odd)
    assert run(inputs="abc", folder="by_digest").count() == 70
    part = next((tmp_path / "s" / "parts" / "part=7").glob("*.parquet"))
    spark.createDataFrame([(21, 0.5), (22, 0.5), (23, 0.5)], "case_id long, prediction double").coalesce(1).write.parquet(f"{tmp_path}/odd")
    next((tmp_path / "odd").glob("*.parquet")).replace(part)
    (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError, match="batch 7"):
        run()
    with pytest.raises(ValueError, match="outside"):
        run(lambda f: f.select("case_id", (F.col("xA") + 5).alias("prediction")), folder="t")
    with pytest.raises(ValueError, match="one to one"):
        run(lambda f: f.where("case_id != 5").select("case_id", F.col("xA").alias("prediction")), folder="u")


def test_requests_for_frames_are_checked(spark):
    base = spark.createDataFrame([(k, k % 2, k // 2) for k in range(12)], "case_id long, target int, WEEK_NUM int")
    f = frames.Feature("x", "b", "int", False)
    faults = frames.request_faults([f, f, frames.Feature("score", "b", "int", False)], [frames.Side("a", 3, 1), frames.Side("b", 0, 5, 0), frames.Side("b", 5, 6)])
    for words in ("x is asked for 2 times", "score would give", "a: weeks 3 to 1", "b: no case", "reach into", "b appears 2"):
        assert any(words in x for x in faults), words
    with pytest.raises(ValueError, match="late: empty"):
        frames.sided_frame(base, {}, [], [frames.Side("early", 0, 2), frames.Side("late", 50, 60)])
    with pytest.raises(ValueError, match="early: case_id_repeated"):
        frames.sided_frame(base.unionAll(base.limit(1)), {}, [], [frames.Side("early", 0, 2)])
    with pytest.raises(ValueError, match="one_class"):
        frames.sided_frame(base.where("target = 1"), {}, [], [frames.Side("early", 0, 2)])
    both = frames.sided_frame(base, {}, [], [frames.Side("late", 4, 5), frames.Side("early", 0, 1)])
    assert {(r["side"], r["count"]) for r in both.groupBy("side").count().collect()} == {("late", 4), ("early", 4)}
    assert frames.sided_frame(base.where("target = 1"), {}, [], [frames.Side("early", 0, 2)], check=False).count() == 3


def test_evaluation_needs_its_weeks(spark):
    rows = spark.createDataFrame([(w, y, p) for w in (1, 2) for y, p in ((0, 0.1), (0, 0.2), (1, 0.8), (1, 0.9))], "WEEK_NUM int, target int, prediction double")
    found = {(r["section"], r["key"], r["metric"]): r["value"] for r in frames.evaluation_report(rows.withColumn("case_id", F.lit(1)), [1, 2]).collect()}
    assert found["whole", 0, "auc"] == found["week", 2, "gini"] == 1.0 and found["whole", 0, "positive_rate"] == 0.5
    assert sum(v for (s, _, m), v in found.items() if s == "bin" and m == "n_rows") == 8
    with pytest.raises(ValueError, match="expected"):
        frames.evaluation_report(rows, [1])
    with pytest.raises(ValueError, match="one class"):
        frames.evaluation_report(rows.where("WEEK_NUM = 1 OR target = 1"), [1, 2])


# ranks


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.floats(-1e300, 1e300), st.sampled_from([0.0, -0.0, 1e-300, 5e-324, 0.5, 1.0, -1.0, 0.1, 0.1000000001])), min_size=1, max_size=30))
def test_quantiles_and_running_sums_equal_numpy(spark, values):
    df = spark.createDataFrame([(x,) for x in values], "x double")
    got = ranks.quantiles(df, [], "x", [0.0, 0.25, 0.5, 1.0]).first()["quantiles"]
    assert got == pytest.approx(np.quantile(np.array(values) / 4, [0.0, 0.25, 0.5, 1.0]) * 4, rel=1e-9, abs=1e-320)
    rows = df.distinct().withColumn("n", F.lit(1))
    below = {r["x"]: r["below_n"] for r in ranks.below(rows, [], "x", ["n"]).collect()}
    assert below == {x: sum(y < x for y in {*values}) for x in {*values}}


def test_pooled_ranks_are_no_single_task(spark):
    """Windows over distinct scores are dealt by bucket too; the one over buckets sees their sums alone."""
    df = spark.range(1000).select(F.lit(1).alias("g"), (F.col("id") % 2).cast("int").alias("target"), (F.col("id") / 1000.0).alias("prediction"))
    plan = metrics.auc(df, ["g"])._jdf.queryExecution().optimizedPlan().toString()
    assert "bucket" in plan and metrics.auc(df, ["g"]).first()["auc"] == pytest.approx(brute_auc([(i % 2, i / 1000) for i in range(1000)]))


# learners


def test_learning_guards(spark, tmp_path):
    rng = np.random.default_rng(1)
    data = [(k, int(k // 40), int(x > 0), float(x + rng.normal() / 4), None if k % 9 == 0 else 1.0) for k, x in enumerate(rng.normal(size=240))]
    df = spark.createDataFrame(data, "case_id long, WEEK_NUM int, target int, f double, g double")
    train, rest = df.where("WEEK_NUM < 4"), df.where("WEEK_NUM >= 4")
    for args in ((train, train, ["f"]), (train, rest, ["target"]), (train.where("target = 1"), rest, ["f"])):
        with pytest.raises(ValueError):
            learning.guard(*args)
    for model in (learning.fit_logistic(train, ["f", "g"]), learning.fit_trees(train, ["f", "g"], 3, validation=rest)):
        scored = learning.score(model, rest, ["case_id", "target", "WEEK_NUM"]).withColumn("k", F.lit(1))
        assert metrics.auc(scored, ["k"]).first()["auc"] > 0.9
    both = {"a": learning.fit_logistic(train, ["f", "g"]), "b": learning.fit_trees(train, ["f", "g"], 2)}
    learning.save(both["b"], f"{tmp_path}/m")
    again = learning.score(learning.load(f"{tmp_path}/m"), rest, ["case_id"])
    parts = {n: {r["case_id"]: r["prediction"] for r in learning.score(m, rest, ["case_id"]).collect()} for n, m in both.items()}
    assert {r["case_id"]: r["prediction"] for r in again.collect()} == parts["b"]
    learning.check_reload(both["a"], rest, "case_id", f"{tmp_path}/n")
    with pytest.raises(Exception, match="already exists|overwrite"):
        learning.check_reload(both["a"], rest, "case_id", f"{tmp_path}/n")
    mixed = learning.score_ensemble(both, {"a": 0.9, "b": 0.1}, rest, ["case_id"])
    assert {r["case_id"]: r["prediction"] for r in mixed.collect()} == pytest.approx({k: 0.9 * parts["a"][k] + 0.1 * parts["b"][k] for k in parts["a"]})
    with pytest.raises(ValueError):
        learning.score_ensemble(both, {"a": 0.5, "b": 0.4}, rest, ["case_id"])
    assert learning.median_rounds([5, 1, 9]) == 5
    assert learning.without_blocks(["a__d1__x", "b__d2__y"], {"b__d2"}) == ["a__d1__x"]


# streams


def test_weekly_stream(spark, tmp_path):
    rows = spark.createDataFrame([(dt.datetime(2024, 1, d), d % 2) for d in (1, 2, 8, 9, 10, 29)], "date_decision timestamp, target int")
    rows.write.parquet(f"{tmp_path}/in")
    stream = weekly_counts(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("weekly").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    found = {str(r["week_start"])[:10]: (r["n_rows"], r["positives"]) for r in spark.table("weekly").collect()}
    assert found == {"2024-01-01": (2, 1), "2024-01-08": (3, 1)}


def test_metrics_need_one_scan(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(g, w, int(y), float(p)) for g in "ab" for w in range(4) for y, p in zip(rng.random(60) < 0.3, rng.random(60).round(2))]
    spark.createDataFrame(rows, "g string, WEEK_NUM int, target int, prediction double").write.parquet(f"{tmp_path}/p")
    df = spark.read.parquet(f"{tmp_path}/p")
    found = metrics.probability_metrics(df, ["g"])
    got = {r["g"]: r for r in found.collect()}
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == 1 and plan.count("ShuffleQueryStage") <= 6
    parts = [metrics.stability(metrics.gini(df, ["g", "WEEK_NUM"]), ["g"]), metrics.auc(df, ["g"]), metrics.average_precision(df, ["g"]), metrics.losses(df, ["g"])]
    for part in parts:
        for r in part.collect():
            assert all(got[r["g"]][c] == pytest.approx(v) for c, v in r.asDict().items())


def test_keys_are_checked_where_they_are_joined(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "case_id long, x string")
    block = spark.createDataFrame([(1, 5.0), (3, 6.0)], "case_id long, `y.z` double")
    found = joins.one_to_one(base, [block, spark.createDataFrame([(2,)], "case_id long")], ["case_id"], "inline")
    assert sorted(found.collect()) == [(1, "a", 5.0), (2, "b", None)]
    for odd in ([base.unionAll(base), block], [base, block.unionAll(block)]):
        with pytest.raises(Exception, match="is not unique"):
            joins.one_to_one(odd[0], odd[1:], ["case_id"], "inline").collect()


def test_members(spark, monkeypatch):
    rows = spark.createDataFrame([(k % 5, k) for k in range(20)], "case_id long, v int")
    assert joins.members(rows, [1, 3, 99]).count() == 8 and joins.members(rows, []).count() == 0
    monkeypatch.setattr(joins, "LISTED", 1)
    assert joins.members(rows, [1, 3, 3, 99]).count() == 8
    assert joins.members(rows, rows.where("case_id = 4")).count() == 4


def test_documents_are_put_in_place_once(spark, tmp_path):
    path = f"{tmp_path}/a b/m.json"
    blocks_ = {"base": spark.createDataFrame([(1, 0, 3)], "case_id long, target int, WEEK_NUM int"), "h": spark.createDataFrame([(1, "x", 2.0)], "case_id long, kM string, xA double")}
    found = manifest.write_feature_manifest(spark, blocks_, path)
    assert manifest.read_document(spark, path) == found == manifest.write_feature_manifest(spark, blocks_, path)
    assert [(b["block"], b["n_rows"], b["feature_columns"], b["categorical_columns"]) for b in found["blocks"]] == [("base", 1, 1, 0), ("h", 1, 2, 1)]
    assert schema.Sealed.opened(found).content["totals"] == {"blocks": 2, "feature_columns": 3, "categorical_columns": 1}
    with pytest.raises(ValueError, match="another document"):
        manifest.write_document(spark, {"x": "é"}, path)
    assert len([p for p in (tmp_path / "a b").iterdir() if not p.name.startswith(".")]) == 1


def test_more_rows_make_more_buckets(spark):
    assert (ranks.parts_for(0), ranks.parts_for(1 << 28), ranks.parts_for((1 << 28) + 1), ranks.parts_for(10**11)) == (256, 256, 512, 1 << 17)
    rows = spark.range(2000).select((F.col("id") * F.col("id") - 900_000).alias("v"), F.lit(1).alias("n"))
    for parts in (1, 256, 1 << 14):
        found = {r["v"]: r["below_n"] for r in ranks.below(rows, [], "v", ["n"], parts=parts).collect()}
        assert found == {v: k for k, v in enumerate(sorted(found))}
