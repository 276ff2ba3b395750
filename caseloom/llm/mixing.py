"""Mixing sources to target weights by Poisson replication.

A source of n documents and target weight w is to give total * w rows, so each of its documents is repeated
r = total * w / n times on average. A document's count inverts the Poisson distribution of mean r at a
uniform number hashed from seed and id: the same whatever the partitions, and independent between documents.
Copies are dealt to partitions by a hash of seed, id, copy, the row itself and the partition that it comes from, so
that rows of one id, or of equal content, spread over all partitions; within them they are ordered by a hash of seed, id
and copy, and copies for which that is equal by a hash of the row. Counts do not depend on partitions.

Null sources make a source of their own. Rows that repeat an id draw the same count; a null id draws as the
text 'null'. Sources with weight 0 or not named in given weights vanish. An empty table stays empty.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Step lists are broadcast up to this many steps in all, 32 MB; beyond it sources are joined by shuffle.
BROADCAST_STEPS = 4_000_000


def uniform(seed: int, *parts: Column) -> Column:
    """In [0, 1), of 52 bits of an MD5 digest: any SQL engine can repeat it."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_steps(rate: Column) -> Column:
    """Struct (least, steps): cumulative probabilities P(count <= k) for k from least until what is left can't be drawn.

    Counts below least, 12 deviations and 30 below the mean, can't be drawn either, so the list grows with the
    root of the rate. The first probability's factorial is Stirling's, exact to doubles beyond 30.
    """
    reach = 12 * F.sqrt(rate) + 30
    least = F.greatest(F.floor(rate - reach), F.lit(0)).cast("int")
    last = F.ceil(rate + reach).cast("int")
    k = F.greatest(least, F.lit(1)).cast("double")
    log_factorial = F.when(least > 0, k * F.log(k) - k + 0.5 * F.log(2 * math.pi * k) + 1 / (12 * k) - 1 / (360 * k * k * k)).otherwise(0.0)
    log_first = F.when(least > 0, least * F.log(rate)).otherwise(0.0) - rate - log_factorial
    none = F.array().cast("array<double>")
    start = F.struct(log_first.alias("log_p"), F.exp(log_first).alias("sum"), F.array_append(none, F.exp(log_first)).alias("steps"))

    def add(state: Column, k: Column) -> Column:
        log_p = state["log_p"] + F.log(rate) - F.log(k.cast("double"))
        total = state["sum"] + F.exp(log_p)
        return F.struct(log_p.alias("log_p"), total.alias("sum"), F.array_append(state["steps"], total).alias("steps"))

    steps = F.when(rate > 0, F.aggregate(F.sequence(least + 1, last), start, add, lambda s: s["steps"])).otherwise(none)
    return F.struct(least.alias("least"), steps.alias("steps"))


def rates(docs: DataFrame, source_col: str, weights: dict[str | None, float] | None, total: int | None) -> DataFrame:
    """src, n, rate: one row per source. Without weights, all sources weigh the same."""
    sizes = docs.groupBy(F.col(source_col).alias("src")).agg(F.count(F.lit(1)).alias("n"))
    n_all, n_sources = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    goal = float(n_all if total is None else total)
    if weights is None:
        return sizes.withColumn("rate", F.lit(goal / max(1, n_sources)) / F.col("n"))
    whole = sum(weights.values()) or 1.0
    wanted = docs.sparkSession.createDataFrame([(k, v / whole) for k, v in weights.items()], "src string, w double")
    met = sizes.join(F.broadcast(wanted.withColumnRenamed("src", "w_src")), F.col("src").cast("string").eqNullSafe(F.col("w_src")), "left")
    return met.select("src", "n", (F.lit(goal) * F.coalesce("w", F.lit(0.0)) / F.col("n")).alias("rate"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    weights: dict[str | None, float] | None = None,
    total: int | None = None,
    seed: int = 17,
    partitions: int | None = None,
) -> DataFrame:
    """Columns of docs (any of the two new names replaced), copy_no (from 1) and shuffle_key, globally shuffled."""
    columns = [c for c in docs.columns if c.lower() not in ("copy_no", "shuffle_key")]
    per_source = materialize(rates(docs, source_col, weights, total).select("src", poisson_steps(F.col("rate")).alias("p")), "rates")
    n_steps = per_source.agg(F.coalesce(F.sum(F.size("p.steps") + 16), F.lit(0))).first()[0]
    per_source = F.broadcast(per_source) if n_steps <= BROADCAST_STEPS else per_source
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(source_col).alias("source_key"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("id_text"))
    rated = own.join(per_source, F.col("source_key").eqNullSafe(F.col("src")))
    count = F.when(F.size("p.steps") > 0, F.col("p.least") + F.size(F.filter("p.steps", lambda p: p <= F.col("u")))).otherwise(0)
    drawn = rated.withColumn("u", uniform(seed, F.col("id_text"))).withColumn("times", count)
    # A step list that is empty is a source to leave out; else u is all but certain to lie below the last step.
    copies = drawn.where("times > 0").select("row", "id_text", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy_no"))
    key = F.md5(F.concat_ws(":", F.lit(f"{seed}:order"), F.col("id_text"), F.col("copy_no").cast("string")).cast("binary"))
    keyed = copies.select("row", "copy_no", key.alias("shuffle_key"), F.xxhash64("row").alias("content"), F.spark_partition_id().alias("origin"))
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartition(n, "shuffle_key", "content", "origin").sortWithinPartitions("shuffle_key", "content")
    return dealt.select("row.*", "copy_no", "shuffle_key")
