"""Proposals of settings to try next, from the trials so far, that a replay draws again.

The best trials and the others each give a density over the settings: a logistic kernel around each trial's value, cut
off at the bounds, and a uniform one beside them; counts plus one for choices. Candidates are drawn from the density of
the good trials by hashed uniform numbers, and the one at which it exceeds the other density most is proposed.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Number:
    name: str
    low: float
    high: float
    log: bool = False

    def unit(self, x: Column) -> Column:
        """Between 0 and 1 over the range."""
        f = F.log if self.log else (lambda c: c)
        low, high = (math.log(v) if self.log else v for v in (self.low, self.high))
        return (f(x) - low) / (high - low)

    def value(self, u: Column) -> Column:
        low, high = (math.log(v) if self.log else v for v in (self.low, self.high))
        return F.exp(low + u * (high - low)) if self.log else low + u * (high - low)


@dataclass(frozen=True)
class Choice:
    name: str
    values: tuple[str, ...]


def uniform(seed: int, *parts: object) -> Column:
    """In (0, 1), of 52 bits of an MD5 digest."""
    text = F.concat_ws(":", F.lit(str(seed)), *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def kernel_mass(x: Column, centre: Column, width: float) -> Column:
    """Density at x of the logistic kernel, within 0 and 1."""
    s = sigmoid((x - centre) / width)
    return s * (1 - s) / width / (sigmoid((1 - centre) / width) - sigmoid(-centre / width))


def density(x: Column, centres: Column, n: int) -> Column:
    """Mean of the kernels around the centres and a uniform density."""
    return F.aggregate(centres, F.lit(1.0), lambda total, c: total + kernel_mass(x, c, kernel_width(n))) / float(n + 1)


def kernel_width(n: int) -> float:
    return 0.5 / math.sqrt(n + 1)


def split_trials(trials: DataFrame, share: float = 0.25) -> DataFrame:
    """trials with good: the best by value, then the earliest slot, a share of them rounded up. One row a trial, all in a study."""
    from pyspark.sql import Window as W

    n = trials.count()
    place = F.row_number().over(W.orderBy(F.desc("value"), "slot"))
    return trials.withColumn("good", place <= math.ceil(share * n))


def candidates(spark: SparkSession, space: Sequence[Number | Choice], trials: DataFrame, slot: int, size: int = 64, share: float = 0.25, seed: int = 42) -> DataFrame:
    """candidate, the settings, and log_ratio: the good trials' log density less the others'. trials: slot, value and settings of a study."""
    if bad := trials.where(F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf"))).head(1):
        raise ValueError(f"trial {bad[0]['slot']} has no finite value")
    for p in space:
        outside = ~F.col(p.name).isin(*p.values) if isinstance(p, Choice) else ~F.col(p.name).between(p.low, p.high)
        if odd := trials.where(F.coalesce(outside, F.lit(True))).head(1):
            raise ValueError(f"trial {odd[0]['slot']} lies outside the space of {p.name}")
    known = split_trials(trials, share)
    rows = known.orderBy("slot").select("good", *[p.unit(F.col(p.name)).alias(p.name) if isinstance(p, Number) else p.name for p in space]).collect()  # one row a trial of a study
    drawn, ratio = spark.range(size).withColumnRenamed("id", "candidate"), []
    for p in space:
        good, rest = ([r[p.name] for r in rows if r["good"] is side] for side in (True, False))
        u = [uniform(seed, slot, p.name, F.col("candidate").cast("string"), k) for k in range(2)]
        if isinstance(p, Choice):
            weight = lambda of: [(of.count(v) + 1) / (len(of) + len(p.values)) for v in p.values]
            steps = [sum(weight(good)[: k + 1]) for k in range(len(p.values))]
            place = sum((F.when(u[0] > s, 1).otherwise(0) for s in steps[:-1]), F.lit(0))
            drawn = drawn.withColumn(p.name, F.get(F.array(*map(F.lit, p.values)), place))
            gain = reduce(lambda a, b: a + b, [F.when(F.col(p.name) == v, math.log(a / b)).otherwise(0.0) for v, a, b in zip(p.values, weight(good), weight(rest), strict=True)])
        else:
            width = kernel_width(len(good))
            of = lambda some: F.array(*map(F.lit, some)).cast("array<double>")
            centre = F.get(of(good), F.floor(u[0] * (len(good) + 1)).cast("int"))  # null behind the last: the uniform one
            low, high = sigmoid(-centre / width), sigmoid((1 - centre) / width)
            q = low + u[1] * (high - low)
            at = F.when(centre.isNull(), u[1]).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), centre + width * F.log(q / (1 - q)))))
            drawn = drawn.withColumn(f"_{p.name}", at)
            gain = F.log(density(F.col(f"_{p.name}"), of(good), len(good))) - F.log(density(F.col(f"_{p.name}"), of(rest), len(rest)))
        ratio.append(gain)
    settings = [p.value(F.col(f"_{p.name}")).alias(p.name) if isinstance(p, Number) else F.col(p.name) for p in space]
    return drawn.select("candidate", *settings, reduce(lambda a, b: a + b, ratio).alias("log_ratio"))


def propose(spark: SparkSession, space: Sequence[Number | Choice], trials: DataFrame, slot: int, startup: int = 5, size: int = 64, share: float = 0.25, seed: int = 42) -> dict:
    """The settings of this slot. Slots must follow each other; the first ones are drawn uniformly."""
    slots = sorted(r[0] for r in trials.select("slot").collect())  # one row a trial of a study
    if slots != [*range(slot)]:
        raise ValueError("the trials before this slot are not complete")
    if slot < startup:
        row = spark.range(1).select(*[F.get(F.array(*map(F.lit, p.values)), F.floor(uniform(seed, slot, p.name) * len(p.values)).cast("int")).alias(p.name) if isinstance(p, Choice) else p.value(uniform(seed, slot, p.name)).alias(p.name) for p in space]).first()
    else:
        row = candidates(spark, space, trials, slot, size, share, seed).orderBy(F.desc("log_ratio"), "candidate").first()
    return {p.name: row[p.name] for p in space}
