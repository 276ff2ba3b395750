"""Encoders fitted on training rows alone, screens, and selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import FractionalType

from caseloom.functions.columns import finite

from .joins import small
from .ranks import quantiles

MISSING = "__missing__"


def _token(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(MISSING))


def frequency_maps(train: DataFrame, columns: list[str]) -> DataFrame:
    """feature, category, share: missing is a category of its own. One pass over train."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), _token(c).alias("category")) for c in columns]))
    counts = train.select(pairs.alias("p")).groupBy("p.feature", "p.category").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("feature").agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(totals), "feature").select("feature", "category", (F.col("n") / F.col("total")).alias("share"))


def frequency_encode(rows: DataFrame, maps: DataFrame, categorical: list[str], numeric: list[str] = (), key: str = "case_id") -> DataFrame:
    """Shares for categories, 0 where unseen; numbers finite or null."""
    out = rows
    for c in categorical:
        one = maps.where(F.col("feature") == c).select(F.col("category").alias(f"k_{c}"), F.col("share").alias(f"s_{c}"))
        out = out.join(small(one), _token(c) == F.col(f"k_{c}"), "left")
    kept = [F.coalesce(F.col(f"s_{c}"), F.lit(0.0)).cast("float").alias(c) for c in categorical]
    return out.select(key, *kept, *[finite(F.col(c)).alias(c) for c in numeric])


def category_codes(train: DataFrame, columns: list[str]) -> DataFrame:
    """feature, category, code: 1.. by the order of the categories; unseen ones will be 0. One row a category enters the window."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), _token(c).alias("category")) for c in columns]))
    seen = train.select(pairs.alias("p")).select("p.feature", "p.category").distinct()
    return seen.withColumn("code", F.row_number().over(W.partitionBy("feature").orderBy("category")))


def encode_codes(rows: DataFrame, codes: DataFrame, columns: list[str], key: str = "case_id") -> DataFrame:
    out = rows
    for c in columns:
        one = codes.where(F.col("feature") == c).select(F.col("category").alias(f"k_{c}"), F.col("code").alias(f"s_{c}"))
        out = out.join(small(one), _token(c) == F.col(f"k_{c}"), "left")
    return out.select(key, *[F.coalesce(F.col(f"s_{c}"), F.lit(0)).alias(c) for c in columns])


def linear_parameters(train: DataFrame, columns: list[str]) -> DataFrame:
    """feature, median, mean, scale: of finite values, mean and scale after missing ones took the median; scale 1 if tiny.

    Values are counted by feature and value, so that the exact median needs no task that holds them all.
    """
    shift = F.col("value") - F.col("median")
    value = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c).cast("double"))
    long = train.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), value(c).alias("value")) for c in columns])).alias("v")).select("v.*")
    middle = quantiles(long, ["feature"], "value", [0.5]).select("feature", F.get("quantiles", F.lit(0)).alias("median"))
    named = train.sparkSession.createDataFrame([(c,) for c in columns], "feature string").join(middle, "feature", "left")
    medians = named.select("feature", F.coalesce("median", F.lit(0.0)).alias("median"))
    away = long.join(F.broadcast(medians), "feature").select("feature", "median", F.coalesce(shift, F.lit(0.0)).alias("away"))  # one row of medians a feature
    stats = away.groupBy("feature", "median").agg(F.avg("away").alias("away"), F.stddev_pop("away").alias("sd"))
    return medians.join(stats, ["feature", "median"], "left").select("feature", "median", (F.col("median") + F.coalesce("away", F.lit(0.0))).alias("mean"), F.when(F.col("sd") > 1e-6, F.col("sd")).otherwise(1.0).alias("scale"))


def standardise(rows: DataFrame, parameters: DataFrame, columns: list[str], key: str = "case_id") -> DataFrame:
    p = {r["feature"]: r for r in parameters.collect()}  # one row a feature
    value = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c).cast("double"))
    return rows.select(key, *[((F.coalesce(value(c), F.lit(p[c]["median"])) - p[c]["mean"]) / p[c]["scale"]).alias(c) for c in columns])


def structural_screen(train: DataFrame, columns: list[str], categorical: list[str] = (), max_missing: float = 0.997, max_categories: int = 5000) -> DataFrame:
    """feature, missing_fraction, n_unique (null counts), reason why it is rejected, if so.

    One scan turns columns to rows of feature and value, which are counted in each task before they are shuffled.
    """
    text = lambda c: (F.col(c) + F.lit(0)).cast("string") if isinstance(train.schema[c].dataType, FractionalType) else F.col(c).cast("string")
    long = train.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), text(c).alias("value")) for c in columns])).alias("v")).select("v.*")
    counted = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    found = counted.groupBy("feature").agg(
        (F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)) / F.sum("n")).alias("missing_fraction"),
        F.count(F.lit(1)).alias("n_unique"),
    )
    reason = F.when(F.col("missing_fraction") > max_missing, "missing").when(F.col("n_unique") <= 1, "constant")
    many = F.col("feature").isin(*categorical) & (F.col("n_unique") > max_categories)
    return found.withColumn("reason", reason.when(many, "cardinality") if categorical else reason)


def select_with_floor(ranking: DataFrame, most: int, floor: int) -> DataFrame:
    """The floor best features of each block, block by block in order of their names, then the best of the rest, up to most.

    ranking: name, block, score, target_gain; one row a feature enters the windows. place is the order of choice.
    """
    if most < 1:
        raise ValueError("at least one feature must be chosen")
    best = [F.desc("score"), F.desc("target_gain"), F.asc("name")]
    in_block = ranking.withColumn("in_block", F.row_number().over(W.partitionBy("block").orderBy(*best)))
    sure = F.col("in_block") <= floor
    order = W.orderBy((~sure).cast("int"), F.when(sure, F.col("block")), *best)
    return in_block.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("name", "block", "score", "place")


def drift_scores(gains: DataFrame, penalty: float = 0.35) -> DataFrame:
    """score = scaled target gain, lessened by the scaled drift gain; scaled by the greatest."""
    top = gains.agg(F.max("target_gain").alias("t"), F.max("drift_gain").alias("d"))
    met = gains.crossJoin(F.broadcast(top))  # one row
    scaled = lambda c, m: F.coalesce(F.try_divide(F.col(c), F.when(F.col(m) > 0, F.col(m))), F.lit(0.0))
    return met.withColumn("score", scaled("target_gain", "t") * F.greatest(F.lit(0.0), 1 - penalty * scaled("drift_gain", "d"))).drop("t", "d")


def feature_accounting(candidates: DataFrame) -> DataFrame:
    """Counts by family and decision. candidates: family, reason (null if eligible), selected."""
    decision = F.when(F.col("selected"), "selected").otherwise(F.coalesce("reason", F.lit("eligible")))
    return candidates.groupBy("family", decision.alias("decision")).agg(F.count(F.lit(1)).alias("features"))
