"""Identities, policies and proposals."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from caseloom.operators import proposals, review

RULES = {"low": ("s", "a", "x", 1.0, None, 0.0), "high": ("s", "a", "y", None, 5.0, 0.1), "open": ("s", "b", "x", None, None, 0.0)}


@pytest.fixture(scope="module")
def values(spark):
    return spark.createDataFrame([("s", "a", "x", 2.0), ("s", "a", "y", 5.05), ("s", "b", "x", -1.0)], "scope string, subject string, metric string, value double")


def test_identities_hold_or_name_the_fault(spark, values):
    one = spark.createDataFrame([("a",)], "subject string")
    sums = review.constraints(*[review.term(one, F.lit("sum"), "s", F.lit(s), "x", w) for s, w in (("a", 1.0), ("b", 2.0))])
    off = review.term(one, F.lit("off"), "s", F.col("subject"), "y", 1.0)
    gone = review.term(one, F.lit("gone"), "s", F.lit("c"), "x", 1.0)
    terms = review.constraints(sums, off, gone)
    found = {r["identity"]: (r["residual"], r["missing"], r["holds"]) for r in review.residuals(values, terms).collect()}
    assert found == {"sum": (0.0, 0, True), "off": (5.05, 0, False), "gone": (None, 1, False)}
    twice = review.residuals(values.unionAll(values.where("subject = 'a' AND metric = 'x'")), sums).first()
    assert (twice["missing"], twice["holds"]) == (1, False), "a value that is stated twice is no value"
    tiny = values.withColumn("value", F.col("value") + F.when(F.col("subject") == "b", 1e-13).otherwise(0.0))
    assert review.residuals(tiny, sums).first()["holds"] and not review.residuals(tiny, sums, 1e-14).first()["holds"]


def test_identities_of_deltas_and_scores(spark):
    subjects = spark.createDataFrame([("control",), ("cut",)], "subject string")
    rows = [("model", "control", "score", 0.5), ("model", "cut", "score", 0.3), ("model", "control", "delta", 0.0), ("model", "cut", "delta", -0.2)]
    named = "scope string, subject string, metric string, value double"
    found = review.residuals(spark.createDataFrame(rows, named), review.delta_identities(subjects, "control", "score", "delta"))
    assert {r["identity"].split(":")[0]: r["holds"] for r in found.collect()} == {"control": True, "cut": True}
    parts = [("fold", "m", k, v) for k, v in (("stability", 0.2), ("mean_gini", 0.5), ("trend_penalty", -0.25), ("residual_penalty", -0.05))]
    score = review.score_identities(spark.createDataFrame([("m",)], "subject string"), "fold")
    assert review.residuals(spark.createDataFrame(parts, named), score).first()["holds"]
    assert not review.residuals(spark.createDataFrame(parts, named).where("metric != 'trend_penalty'"), score).first()["holds"]


def test_policies_and_their_verdict(spark, values):
    passed = lambda v: {r["check"]: r["passed"] for r in review.policy(v, review.policy_rules(spark, RULES)).collect()}
    assert passed(values) == {"low": True, "high": True, "open": True, "verdict": True}
    assert passed(values.where("subject = 'a'")) == {"low": True, "high": True, "open": False, "verdict": False}
    assert passed(values.withColumn("value", F.col("value") + 0.2))["high"] is False
    assert passed(values.withColumn("value", F.lit(float("nan"))))["verdict"] is False
    assert passed(values.unionAll(values))["low"] is False
    assert passed(values.where("false"))["verdict"] is False


SPACE = [proposals.Number("depth", 2, 10), proposals.Number("rate", 0.01, 1, log=True), proposals.Choice("kind", ("a", "b"))]


def trials(spark, n):
    rows = [(k, -((k * 0.7 % 8 + 2 - 4) ** 2), k * 0.7 % 8 + 2, 10 ** (-2 + k % 10 / 5), "ab"[k % 2]) for k in range(n)]
    return spark.createDataFrame(rows, "slot int, value double, depth double, rate double, kind string")


def test_densities_of_candidates(spark):
    made = proposals.candidates(spark, SPACE, trials(spark, 12), 12, size=20)
    good = sorted(trials(spark, 12).collect(), key=lambda r: (-r["value"], r["slot"]))[:3]
    rest = [r for r in trials(spark, 12).collect() if r["slot"] not in {g["slot"] for g in good}]

    def log_density(rows, c):
        w, total = 0.5 / math.sqrt(len(rows) + 1), 0.0
        s = lambda x: 1 / (1 + math.exp(-x))
        for name, unit in (("depth", lambda v: (v - 2) / 8), ("rate", lambda v: math.log(v / 0.01) / math.log(100))):
            kernels = [s((unit(c[name]) - m) / w) * (1 - s((unit(c[name]) - m) / w)) / w / (s((1 - m) / w) - s(-m / w)) for m in (unit(r[name]) for r in rows)]
            total += math.log((1 + sum(kernels)) / (len(rows) + 1))
        return total + math.log((sum(r["kind"] == c["kind"] for r in rows) + 1) / (len(rows) + 2))

    for c in made.collect():
        assert 2 <= c["depth"] <= 10 and 0.01 <= c["rate"] <= 1 and c["kind"] in "ab"
        assert c["log_ratio"] == pytest.approx(log_density(good, c) - log_density(rest, c), abs=1e-6)


def test_a_replay_proposes_the_same(spark):
    known = trials(spark, 20)
    first = proposals.propose(spark, SPACE, known, 20)
    assert first == proposals.propose(spark, SPACE, known.repartition(3), 20)
    assert first != proposals.propose(spark, SPACE, known, 20, seed=7)
    assert abs(first["depth"] - 4) < 2.5, "near the best trials"
    assert {*proposals.propose(spark, SPACE, trials(spark, 2), 2)} == {"depth", "rate", "kind"}
    with pytest.raises(ValueError, match="not complete"):
        proposals.propose(spark, SPACE, known.where("slot != 4"), 20)
    with pytest.raises(ValueError, match="no finite value"):
        proposals.propose(spark, SPACE, known.withColumn("value", F.lit(float("nan"))), 20)
    with pytest.raises(ValueError, match="outside the space"):
        proposals.propose(spark, SPACE, known.withColumn("kind", F.lit("c")), 20)
