"""Averaged stochastic gradient descent against plain Python."""

from __future__ import annotations

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseloom.operators import sgd
from caseloom.operators.metrics import auc

NAMES = ["a", "b"]


@pytest.fixture(scope="module")
def train(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(3, 2, 600), rng.normal(-1, 0.5, 600)
    y = rng.random(600) < 1 / (1 + np.exp(-(a - 3) + 2 * (b + 1)))
    rows = [(k, int(y[k]), None if k % 11 == 0 else float(a[k]), float("nan") if k % 13 == 0 else float(b[k])) for k in range(600)]
    return spark.createDataFrame(rows, "case_id long, target int, a double, b double").repartition(3)


def test_one_part_equals_the_sequential_learner(train):
    model = sgd.fit(train, NAMES, alpha=1e-3, rounds=3, parts=1)
    rows = train.select("case_id", "target", *NAMES).toPandas()
    x = []
    for c in NAMES:
        v = rows[c].to_numpy(float)
        v = np.where(np.isfinite(v), v, np.median(v[np.isfinite(v)]))
        x.append((v - v.mean()) / v.std())
    x = np.stack(x, axis=1)
    w, total, t = np.zeros(3), np.zeros(3), 1 / (1e-3 * (1e-3**-0.25) / max(1.0, 1 / (1 + math.exp(-(1e-3**-0.25)))))
    losses = []
    for r in range(3):
        order = [q["case_id"] for q in train.orderBy(F.xxhash64(F.lit(42), F.lit(r), "case_id"), "case_id").select("case_id").collect()]
        place = {c: k for k, c in enumerate(rows["case_id"])}
        loss = 0.0
        for c in order:
            k = place[c]
            eta, y = 1 / (1e-3 * t), rows["target"][k]
            m = x[k] @ w[:2] + w[2]
            loss += math.log1p(math.exp(-m if y else m))
            away = 1 / (1 + math.exp(-m)) - y
            w = w - eta * np.array([*(away * x[k] + 1e-3 * w[:2]), away])
            total += w
            t += 1
        losses.append(loss / 600)
    assert (*model.coefficients, model.intercept) == pytest.approx(total / 1800)
    assert model.losses == pytest.approx(losses)


def test_parts_agree_and_learn(spark, train):
    one, other = (sgd.fit(train.repartition(n), NAMES, rounds=4, parts=4) for n in (1, 6))
    assert (*one.coefficients, *one.losses) == pytest.approx((*other.coefficients, *other.losses)), "how rows are dealt beforehand does not matter"
    scored = one.score(train, ["target"]).withColumn("all", F.lit(1))
    assert auc(scored, ["all"]).first()["auc"] > 0.75
    assert one.losses_frame(spark).count() == 4 and one.losses[-1] < one.losses[0]


def test_rounds_end_where_loss_stays(train):
    assert len(sgd.fit(train, NAMES, rounds=30, parts=2, tol=10.0, wait=2).losses) == 3
    with pytest.raises(ValueError, match="both classes"):
        sgd.fit(train.where("target = 0"), NAMES)
    with pytest.raises(ValueError, match="positive"):
        sgd.fit(train, NAMES, alpha=0)


def test_steps_of_few_features_are_quick_and_the_same():
    rng = np.random.default_rng(7)
    x, y, w = rng.normal(size=(6000, 5)), (rng.random(6000) < 0.2).astype(float), rng.normal(size=6)
    seconds, found = {}, {}
    for step in (sgd.one_pass, sgd.wide_pass):
        for _ in range(3):
            start = time.perf_counter()
            found[step] = step(x, y, w, sgd.first_step(1e-4), 1e-4)
            seconds[step] = min(seconds.get(step, math.inf), time.perf_counter() - start)
    (one, one_total, one_loss), (other, total, loss) = found.values()
    assert one == pytest.approx(other, rel=1e-9) and one_total == pytest.approx(total, rel=1e-9) and one_loss == pytest.approx(loss)
    assert seconds[sgd.one_pass] < 0.7 * seconds[sgd.wide_pass]
    x = rng.normal(size=(50, sgd.NARROW + 1))
    found = [step(x, y[:50], np.zeros(sgd.NARROW + 2), 1000.0, 1e-4) for step in (sgd.one_pass, sgd.narrow_pass)]
    assert found[0][0] == pytest.approx(found[1][0])
