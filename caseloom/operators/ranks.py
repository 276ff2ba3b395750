"""Running sums and exact quantiles over ordered values, without one task that sees all of them.

Values fall into buckets by sign, exponent and leading bits of the fraction, which keep their order. Values are
ranked within buckets; the few buckets of a group are summed up and shift the ranks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Buckets between a power of two and the next, unless a number of rows asks for more.
PARTS = 256
#: Distinct values that a bucket shall hold about at most, were they spread over one power of two.
BUCKET_ROWS = 1 << 20


def parts_for(rows: int) -> int:
    """Buckets for so many distinct values: as many as keep a window's share bounded, up to 2^24."""
    return min(1 << 24, max(PARTS, 1 << max(0, -(-rows // BUCKET_ROWS) - 1).bit_length()))


def order_bucket(c: Column, parts: int = PARTS) -> Column:
    """A whole number that never falls as c grows; null for null and NaN, which have no place in the order."""
    size = F.abs(c.cast("double"))
    exponent = F.greatest(F.floor(F.log2(F.when(size > 0, size))), F.lit(-1000)).cast("long")
    exponent = F.least(exponent, F.lit(1023))
    part = F.least(F.floor(size / F.pow(F.lit(2.0), exponent.cast("double")) * parts), F.lit(2 * parts - 1)).cast("long")
    place = (exponent + 1100) * (2 * parts) + part
    return F.when(~F.isnan(c), F.when(size == 0, F.lit(0).cast("long")).otherwise(F.when(c > 0, place).otherwise(-place)))


def below(rows: DataFrame, groups: list[str], value: str, sums: list[str], descending: bool = False, parts: int = PARTS) -> DataFrame:
    """rows, one a group and value, with below_<s>: the sum of s over the values before, in the given order.

    Rows whose value is null or NaN have no place and are left out.
    """
    dealt = rows.withColumn("_bucket", order_bucket(F.col(value), parts))
    way = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    before = lambda *keys: W.partitionBy(*keys).rowsBetween(W.unboundedPreceding, -1)
    total = dealt.groupBy(*groups, "_bucket").agg(*[F.sum(s).alias(f"_total_{s}") for s in sums])
    shift = total.select(*groups, "_bucket", *[F.coalesce(F.sum(f"_total_{s}").over(before(*groups).orderBy(way("_bucket"))), F.lit(0)).alias(f"_shift_{s}") for s in sums])
    inside = dealt.select("*", *[F.coalesce(F.sum(s).over(before(*groups, "_bucket").orderBy(way(value))), F.lit(0)).alias(f"_inside_{s}") for s in sums])
    met = inside.join(shift, [*groups, "_bucket"])
    return met.select(*rows.columns, *[(F.col(f"_inside_{s}") + F.col(f"_shift_{s}")).alias(f"below_{s}") for s in sums])


def quantiles(rows: DataFrame, groups: list[str], value: str, shares: list[float], weight: str | None = None) -> DataFrame:
    """groups, quantiles: exact, with linear interpolation between neighbours; null and NaN take no part.

    weight: a column that says how many equal rows a row stands for.
    """
    known = rows.where(F.col(value).isNotNull() & ~F.isnan(value))
    times = F.sum(weight) if weight else F.count(F.lit(1))
    counted = known.groupBy(*groups, F.col(value).cast("double").alias("_value")).agg(times.alias("n"))
    ranked = below(counted, groups, "_value", ["n"])
    size = counted.groupBy(*groups).agg(F.sum("n").alias("_size"))  # of the counted values, so that rows are read once
    met = ranked.join(size, groups) if groups else ranked.crossJoin(F.broadcast(size))  # one row; with groups, one a group
    # As SQL text, which costs the driver one call a share where columns cost dozens.
    at = [f"((_size - 1) * {float(s)!r}D)" for s in shares]
    value_at = lambda rank: f"max(CASE WHEN below_n <= {rank} AND {rank} < below_n + n THEN _value END)"
    ends = [F.expr(f"{x} AS _{k}_{i}") for i, h in enumerate(at) for k, x in (("low", value_at(f"floor({h})")), ("high", value_at(f"ceil({h})")), ("rest", f"max({h} - floor({h}))"))]
    picked = met.groupBy(*groups).agg(*ends)
    between = ", ".join(f"_low_{i} + (_high_{i} - _low_{i}) * _rest_{i}" for i in range(len(shares)))
    return picked.select(*groups, F.expr(f"array({between}) AS quantiles"))
