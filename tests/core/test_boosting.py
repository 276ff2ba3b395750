"""Histogram boosting against plain Python."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseloom.operators import boosting
from caseloom.operators.boosting import Settings


@pytest.fixture(scope="module")
def cases(spark):
    """Two useful features, one with missing values, and two useless ones; the later weeks are held out."""
    rng = np.random.default_rng(8)
    n = 1500
    a, b, c = rng.normal(size=n), rng.normal(size=n), rng.normal(size=n)
    y = (rng.random(n) < 1 / (1 + np.exp(-(1.5 * (a > 0.3) + np.where(b > 1, 2, -0.5))))).astype(int)
    b[::7] = np.nan
    rows = [(k, int(y[k]), float(a[k]), None if math.isnan(b[k]) else float(b[k]), float(c[k]), 1.0) for k in range(n)]
    df = spark.createDataFrame(rows, "case_id long, target int, a double, b double, noise double, flat double").repartition(3).cache()
    return df.where("case_id < 1100"), df.where("case_id >= 1100")


NAMES = ["a", "b", "noise", "flat"]


def columns(df):
    rows = df.select("target", *NAMES).collect()
    x = np.array([[np.nan if v is None else v for v in r[1:]] for r in rows])
    return x, np.array([r[0] for r in rows], float)


def plain_level(x, y, margin, rows, settings, edges):
    """Best (gain, -feature...) cut of a set of rows by brute force."""
    p = 1 / (1 + np.exp(-margin))
    g, h = p - y, p * (1 - p)
    best = None
    part = lambda m: g[m].sum() ** 2 / (h[m].sum() + settings.l2)
    for f in range(x.shape[1]):
        for cut in range(len(edges[f]) + 1):
            for missing_left in (False, True):
                missing = np.isnan(x[:, f])
                left = rows & np.where(missing, missing_left, np.searchsorted(edges[f], x[:, f]) <= cut)
                right = rows & ~left
                if min(left.sum(), right.sum()) >= settings.min_rows:
                    gain = part(left) + part(right) - part(rows)
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-7):
                        best = (gain, f, cut, missing_left, left, right)
    return best, g, h


def test_trees_equal_plain_python(spark, cases):
    train, _ = cases
    settings = Settings(rounds=2, depth=2, bins=8, rate=0.3)
    model = boosting.boost(train, None, NAMES, settings)
    x, y = columns(train)
    quantile = lambda v: sorted({float(q) for q in np.quantile(v[np.isfinite(v)], [k / 8 for k in range(1, 8)])})
    edges = [quantile(x[:, f]) for f in range(4)]
    assert [list(e) for e in model.edges] == [pytest.approx(e) for e in edges]
    margin, gains = np.full(len(y), math.log(y.mean() / (1 - y.mean()))), dict.fromkeys(NAMES, 0.0)
    for _ in range(2):
        levels, step = [np.ones(len(y), bool)], np.zeros(len(y))
        for _ in range(2):
            following = []
            for rows in levels:
                best, g, h = plain_level(x, y, margin, rows, settings, edges)
                if best:
                    gains[NAMES[best[1]]] += best[0]
                    for side in best[4:]:
                        step[side] = -settings.rate * g[side].sum() / (h[side].sum() + settings.l2)
                    following += best[4:]
            levels = following
        margin = margin + step
    scored = {r["case_id"]: r["prediction"] for r in model.score(train, ["case_id"]).collect()}
    want = dict(zip([r[0] for r in train.select("case_id").collect()], 1 / (1 + np.exp(-margin)), strict=True))
    assert scored == pytest.approx(want, abs=1e-6)
    assert model.gains() == pytest.approx(gains, rel=1e-5)
    first = {r["name"]: r["gain"] for r in boosting.first_level_gains(train, tuple(NAMES), settings).collect()}
    assert first["a"] > first["noise"] and first["flat"] == 0


@pytest.fixture(scope="module")
def model(cases):
    return boosting.boost(*cases, NAMES, Settings(rounds=12, depth=3, bins=16, rate=0.4, patience=3))


def test_rounds_end_behind_the_best(spark, cases, model):
    assert 0 < model.best_round < 12 and len(model.curve) == min(12, model.best_round + 3)
    assert model.curve[model.best_round - 1] == max(model.curve) > 0.6
    assert [tuple(r) for r in model.curve_frame(spark).collect()] == [(k, v) for k, v in enumerate(model.curve, 1)]
    assert boosting.stopped((0.5, 0.6, 0.6, 0.59, 0.7), 2) == 4 and boosting.stopped((0.5, 0.6), 2) == 2 and boosting.best_of((0.5, 0.6, 0.6)) == 2
    held = cases[1].select("case_id", "target").join(model.score(cases[1], ["case_id"]), "case_id").toPandas()
    pos, neg = (held[held.target == t].prediction.to_numpy() for t in (1, 0))
    auc = ((pos[:, None] > neg).sum() + (pos[:, None] == neg).sum() / 2) / (len(pos) * len(neg))
    assert auc == pytest.approx(model.curve[model.best_round - 1], abs=1e-9)


def test_the_frozen_model_has_the_median_of_rounds(cases):
    settings = Settings(rounds=50, depth=2, bins=8)
    assert boosting.refit(cases[0], NAMES, [1, 2, 9], settings).best_round == 2


def test_a_model_does_not_depend_on_partitions(cases):
    settings = Settings(rounds=2, depth=2, bins=16, row_share=0.7, feature_share=0.8)
    one, other = (boosting.boost(cases[0].repartition(n), None, NAMES, settings) for n in (1, 5))
    assert one == other
    assert one != boosting.boost(cases[0], None, NAMES, Settings(rounds=2, depth=2, bins=16, row_share=0.7, feature_share=0.8, seed=1))


def test_ways_to_grow(cases):
    leaves = boosting.boost(cases[0], None, NAMES, Settings(rounds=1, depth=4, bins=16, growth="leaves", leaves=5)).trees[0]
    assert sum(f >= 0 for f in leaves.feature) == 4
    alike = boosting.boost(cases[0], None, NAMES, Settings(rounds=1, depth=3, bins=16, growth="oblivious")).trees[0]
    for level in range(3):
        nodes = range((1 << level) - 1, (2 << level) - 1)
        assert len({(alike.feature[k], alike.cut[k], alike.missing_left[k]) for k in nodes if alike.feature[k] >= 0}) == 1
    with pytest.raises(ValueError, match="growth"):
        Settings(growth="sideways")


def test_a_stored_model_scores_alike(spark, cases, model, tmp_path):
    again = boosting.check_reload(model, cases[1], "case_id", f"{tmp_path}/m")
    assert again == model
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        model.save(spark, f"{tmp_path}/m")


def test_useless_features_come_last(spark, cases):
    train, rest = (df.withColumn("kind", F.when(F.col("a") > 0.3, "high").otherwise("low")).withColumn("late", F.lit(float(k)) + F.rand(3)) for k, df in enumerate(cases))
    found = boosting.gain_screen(train, rest, ["b", "kind", "noise", "flat", "late"], ["kind"], Settings(rounds=4, depth=2, bins=16))
    order = [r["name"] for r in found.orderBy(F.desc("score"), "name").collect()]
    assert {*order[:2]} == {"b", "kind"} and order[-1] == "late" or order[-2:] == ["flat", "late"]
    assert {r["name"]: r["drift_gain"] for r in found.collect()}["late"] > 100


def test_classes_are_needed(cases):
    with pytest.raises(ValueError, match="both classes"):
        boosting.boost(cases[0].where("target = 1"), None, NAMES)


def tasks_of(spark, group, act):
    """act's result, and the number of tasks of its jobs."""
    spark.sparkContext.setJobGroup(group, group)
    try:
        found, tracker = act(), spark.sparkContext.statusTracker()
        stages = {k for j in tracker.getJobIdsForGroup(group) for k in tracker.getJobInfo(j).stageIds}
        return found, sum(s.numCompletedTasks for s in map(tracker.getStageInfo, stages) if s)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_passes_do_not_take_a_task_a_partition(spark, cases):
    many, settings = cases[0].repartition(60), Settings(rounds=2, depth=3, bins=8, growth="oblivious")
    found, tasks = tasks_of(spark, "passes", lambda: boosting.boost(many, None, NAMES, settings))
    assert found == boosting.boost(cases[0], None, NAMES, settings)
    assert tasks < 60 * 9, "rows are read for the bins and for the blocks; six levels read few blocks"


def test_models_of_the_same_rows_are_binned_once(spark, cases):
    ways = [Settings(rounds=2, depth=2, bins=16, growth=g, leaves=3) for g in boosting.GROWTHS]
    calls = []
    made, boosting.prepared = boosting.prepared, lambda *a: calls.append(a) or made(*a)
    try:
        found = boosting.boost_each(*cases, NAMES, ways)
    finally:
        boosting.prepared = made
    assert len(calls) == 1 and found == [boosting.boost(*cases, NAMES, w) for w in ways]
