"""What queries need as their input grows."""

from __future__ import annotations

from dataclasses import replace

from caseloom.operators import boosting, joins
from caseloom.plans import queries as plans
from caseloom.plans.queries import queries


def test_catalog_files_are_one_row_group_each(spark, tiny):
    spark.conf.set("parquet.block.size", "4096")  # so that the small table has the row groups of a large one
    try:
        found = {r["family"]: r["row_groups"] for r in queries()["built_catalog"](spark, tiny).collect()}
    finally:
        spark.conf.unset("parquet.block.size")
    assert found == {"base": 1, "lines": 3}


def test_keys_are_dealt_before_they_are_grouped(spark):
    side = lambda n: spark.range(n).withColumnRenamed("id", "case_id")
    found = joins.key_parity({"train": {"base": side(50), "a": side(40)}, "test": {"base": side(5), "a": side(9)}})
    assert {tuple(r) for r in found.collect()} == {("train", "a", 10, 0, 0), ("test", "a", 0, 4, 0)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and "as string) AS k" not in plan


def test_features_are_computed_once(spark, tiny):
    train, rest, _ = plans._features(spark, tiny)
    for df in (train, rest):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan, "learners read stored features"


def test_two_models_score_in_one_pass(spark):
    rows = spark.createDataFrame([(k, k % 2, float(k)) for k in range(80)], "case_id long, target int, a double")
    model = boosting.boost(rows, None, ["a"], boosting.Settings(rounds=1, depth=1, bins=8))
    both = boosting.both_scores(model, replace(model, base=model.base + 1), rows, ["case_id"])
    assert "Join" not in both._jdf.queryExecution().optimizedPlan().toString()
    assert both.where("prediction < again").count() == 80
