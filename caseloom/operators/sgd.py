"""Logistic regression by averaged stochastic gradient descent, in passes within partitions.

Rows are standardised by what the training rows alone say, and dealt to a fixed number of parts by a hash of their key.
Each round every part makes one pass over its rows, in an order drawn by a hash of seed, round and key, from the common
coefficients; the coefficients of the parts are then averaged by their numbers of rows. The result is the average of
all coefficients that any step has had. Sums of coefficients are all that reaches the driver, so a round costs one
number a feature there, and with one part the learner is the sequential one. Rounds end when the mean loss, taken
before each step, has not fallen by tol for some rounds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .encode import linear_parameters

#: Up to so many features, steps in plain numbers are quicker than in arrays.
NARROW = 12


@dataclass(frozen=True)
class Linear:
    features: tuple[str, ...]
    medians: tuple[float, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]
    coefficients: tuple[float, ...]
    intercept: float
    #: Mean loss of each round.
    losses: tuple[float, ...]

    def margin(self) -> Column:
        standard = [standardised(*p) for p in zip(self.features, self.medians, self.means, self.scales, strict=True)]
        return sum((x * F.lit(c) for x, c in zip(standard, self.coefficients, strict=True)), F.lit(self.intercept))

    def score(self, rows: DataFrame, keep: list[str]) -> DataFrame:
        return rows.select(*keep, (1 / (1 + F.exp(-self.margin()))).alias("prediction"))

    def losses_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, float(v)) for k, v in enumerate(self.losses, 1)], "round int, loss double")


def standardised(name: str, median: float, mean: float, scale: float) -> Column:
    c = F.col(name).cast("double")
    return (F.coalesce(F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c), F.lit(median)) - mean) / scale


def first_step(alpha: float) -> float:
    """The time at which step sizes 1 / (alpha * time) start: where a step is as large as typical coefficients."""
    typical = math.sqrt(1 / math.sqrt(alpha))
    slope = 1 / (1 + math.exp(-typical))  # of the loss of a positive row at -typical
    return 1 / (alpha * typical / max(1.0, slope))


def one_pass(x: np.ndarray, y: np.ndarray, w: np.ndarray, start: float, alpha: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Coefficients after a step a row (the intercept last, unpenalised), their sum over steps, and the summed loss."""
    return (narrow_pass if x.shape[1] <= NARROW else wide_pass)(x, y, w, start, alpha)


def narrow_pass(x: np.ndarray, y: np.ndarray, w: np.ndarray, start: float, alpha: float) -> tuple[np.ndarray, np.ndarray, float]:
    """one_pass in plain numbers. The first steps are long, so that a last bit grows: each number is made as in wide_pass."""
    now, margins, steps = w.tolist(), [], []
    rates = 1 / (alpha * (start + np.arange(len(x))))
    for row, target, rate in zip(x.tolist(), y.tolist(), rates.tolist(), strict=True):
        m = 0.0
        for c, v in zip(now, row):  # noqa: B905: the intercept is left over
            m += c * v
        m += now[-1]
        away = (1 / (1 + math.exp(-m)) if m > -700 else 0.0) - target
        last = now[-1] - rate * away
        now = [c - rate * (away * v + alpha * c) for c, v in zip(now, row)]  # noqa: B905
        now.append(last)
        margins.append(m)
        steps += now
    loss = np.logaddexp(0.0, np.where(y > 0, -1.0, 1.0) * margins).sum()
    return np.array(now), np.array(steps).reshape(len(x), len(w)).sum(axis=0), float(loss)


def wide_pass(x: np.ndarray, y: np.ndarray, w: np.ndarray, start: float, alpha: float) -> tuple[np.ndarray, np.ndarray, float]:
    w, total, loss = w.copy(), np.zeros(len(w)), 0.0
    for k in range(len(x)):
        rate = 1 / (alpha * (start + k))
        m = float(x[k] @ w[:-1] + w[-1])
        loss += float(np.logaddexp(0.0, -m if y[k] else m))
        away = (1 / (1 + math.exp(-m)) if m > -700 else 0.0) - y[k]
        w[:-1] -= rate * (away * x[k] + alpha * w[:-1])
        w[-1] -= rate * away
        total += w
    return w, total, loss


def fit(train: DataFrame, features: list[str], alpha: float = 1e-4, rounds: int = 10, parts: int = 8, tol: float = 1e-3, wait: int = 5, seed: int = 42, key: str = "case_id") -> Linear:
    """train: key, target (0 or 1), features. A part's rows stay in its task by the batch alone."""
    if alpha <= 0 or rounds < 1 or parts < 1:
        raise ValueError("alpha, rounds and parts must be positive")
    found = {r["feature"]: r for r in linear_parameters(train, features).collect()}  # one row a feature
    of = [tuple(float(found[f][c]) for f in features) for c in ("median", "mean", "scale")]
    x = F.array(*[standardised(*p) for p in zip(features, *of, strict=True)])
    rows = train.select(F.col(key).alias("key"), F.col("target").cast("double").alias("y"), x.alias("x")).repartition(parts, "key").persist()
    width = len(features)
    w, total, steps, losses, time = np.zeros(width + 1), np.zeros(width + 1), 0, [], first_step(alpha)
    try:
        largest, *classes = rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"), F.min("y").alias("a"), F.max("y").alias("z")).agg(F.max("n"), F.min("a"), F.max("z")).first()
        if classes != [0, 1]:
            raise ValueError("training rows need both classes")
        for k in range(rounds):
            made = passes(rows, w, time, alpha, seed, k).groupBy("place").agg(F.sum("mixed").alias("mixed"), F.sum("total").alias("total"), F.sum("n").alias("n"), F.sum("loss").alias("loss")).orderBy("place").collect()
            n = made[0]["n"]
            w = np.array([r["mixed"] for r in made]) / n
            total, steps, time = total + np.array([r["total"] for r in made]), steps + n, time + largest
            losses.append(made[0]["loss"] / n)
            if len(losses) > wait and min(losses[:-wait]) - tol < min(losses[-wait:]):
                break
    finally:
        rows.unpersist()
    mean = total / steps
    return Linear(tuple(features), *of, tuple(map(float, mean[:-1])), float(mean[-1]), tuple(losses))


def passes(rows: DataFrame, w: np.ndarray, time: float, alpha: float, seed: int, round_no: int) -> DataFrame:
    """(place, mixed, total, n, loss) of each part: a place is a coefficient's; mixed is it times the part's rows."""
    ordered = rows.sortWithinPartitions(F.xxhash64(F.lit(seed), F.lit(round_no), "key"), "key", "y").select("y", "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, total, n, loss = w, np.zeros(len(w)), 0, 0.0
        for b in batches:
            x = b.column(1).flatten().to_numpy().reshape(b.num_rows, len(w) - 1)
            here, more, lost = one_pass(x, b.column(0).to_numpy(), here, time + n, alpha)
            total, n, loss = total + more, n + b.num_rows, loss + lost
        if n:
            columns = [pa.array(np.arange(len(w), dtype=np.int32)), pa.array(here * n), pa.array(total), pa.array(np.full(len(w), n)), pa.array(np.full(len(w), loss))]
            yield pa.RecordBatch.from_arrays(columns, ["place", "mixed", "total", "n", "loss"])

    return ordered.mapInArrow(run, "place int, mixed double, total double, n long, loss double")
