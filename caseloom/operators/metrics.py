"""Prediction metrics, exact in ties, over any grouping: all scores are grouped before they are ranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caseloom.functions.columns import clipped

from .ranks import below, order_bucket, quantiles

SLOPE_PENALTY, RESIDUAL_PENALTY = 88.0, 0.5
# The edges of the fixed reliability bins.
FIXED_EDGES = (0.0, 0.01, 0.02, 0.03, 0.05, 0.075, 0.1, 0.15, 0.25, 0.5, 1.0)


def by_score(rows: DataFrame, groups: list[str]) -> DataFrame:
    """pos and neg of each distinct score of a group: what ranks need, combined before the shuffle."""
    return rows.groupBy(*groups, "prediction").agg(F.sum("target").alias("pos"), F.sum(1 - F.col("target")).alias("neg"))


def auc(rows: DataFrame, groups: list[str]) -> DataFrame:
    """groups, n_rows, positives, auc: ties count half; null with one class alone.

    Scores are ranked within buckets of their order, and only sums of buckets are ranked beyond them, so a pooled
    group is no single task's work.
    """
    return scored_auc(by_score(rows, groups), groups)


def scored_auc(scores: DataFrame, groups: list[str]) -> DataFrame:
    """auc() of scores whose rows are counted: groups, prediction, pos, neg, one row a group and prediction."""
    before = lambda *keys: W.partitionBy(*keys).rowsBetween(W.unboundedPreceding, -1)
    scored = scores.withColumn("bucket", order_bucket(F.col("prediction")))
    ranked = scored.withColumn("neg_below", F.coalesce(F.sum("neg").over(before(*groups, "bucket").orderBy("prediction")), F.lit(0)))
    wins = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0))
    buckets = ranked.groupBy(*groups, "bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), wins.alias("wins"))
    shifted = buckets.withColumn("shift", F.coalesce(F.sum("neg").over(before(*groups).orderBy("bucket")), F.lit(0)))
    won = F.sum(F.col("wins") + F.col("pos") * F.col("shift"))
    return shifted.groupBy(*groups).agg((F.sum("pos") + F.sum("neg")).alias("n_rows"), F.sum("pos").alias("positives"), F.try_divide(won, F.sum("pos").cast("double") * F.sum("neg")).alias("auc"))


def gini(rows: DataFrame, groups: list[str]) -> DataFrame:
    return auc(rows, groups).withColumn("gini", 2 * F.col("auc") - 1)


def stability(weekly: DataFrame, groups: list[str]) -> DataFrame:
    """Mean weekly Gini, less penalties for a falling trend and for residuals. weekly: groups, WEEK_NUM, gini.

    Weeks without a Gini are left out; fewer than two weeks give null. The trend is by the real week number.
    """
    w = weekly.where(F.col("gini").isNotNull())
    return _scored(w.groupBy(*groups).agg(*_trend(F.col("gini"))), groups, [])


def _trend(y: Column) -> list[Column]:
    """Aggregates of weekly values by week, of rows that have a value."""
    x = F.when(y.isNotNull(), F.col("WEEK_NUM").cast("double"))
    return [F.count(y).alias("weeks"), F.avg(y).alias("mean_gini"), F.covar_pop(x, y).alias("c"), F.var_pop(x).alias("v"), F.var_pop(y).alias("r")]


def _scored(fit: DataFrame, groups: list[str], more: list[str]) -> DataFrame:
    slope = F.when(F.col("weeks") > 1, F.try_divide("c", "v"))
    out = fit.withColumn("slope", slope).withColumn("residual_std", F.sqrt(F.greatest(F.lit(0.0), F.col("r") - F.coalesce("slope", F.lit(0.0)) * F.col("c"))))
    score = F.col("mean_gini") + SLOPE_PENALTY * F.least(F.lit(0.0), F.col("slope")) - RESIDUAL_PENALTY * F.col("residual_std")
    return out.select(*groups, "weeks", "mean_gini", "slope", F.when(F.col("weeks") > 1, F.col("residual_std")).alias("residual_std"), F.when(F.col("weeks") > 1, score).alias("stability"), *more)


def weekly_violations(weekly: DataFrame, groups: list[str]) -> DataFrame:
    """groups, check, violations of weekly Ginis: missing weeks or values, weeks that repeat, values outside [-1, 1]."""
    g = F.col("gini")
    counts = {
        "missing": F.count_if(F.col("WEEK_NUM").isNull() | g.isNull() | F.isnan(g)),
        "repeated_weeks": F.count("WEEK_NUM") - F.count_distinct("WEEK_NUM"),
        "out_of_range": F.count_if(~F.isnan(g) & (F.abs(g) > 1)),
        "too_few_weeks": F.when(F.count_distinct("WEEK_NUM") < 2, 1).otherwise(0),
    }
    one = weekly.groupBy(*groups).agg(*[c.cast("long").alias(k) for k, c in counts.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.col(k).alias("violations")) for k in counts]))
    return one.select(*groups, rows.alias("r")).select(*groups, "r.*")


def penalties(weekly: DataFrame, groups: list[str]) -> DataFrame:
    """stability() with what the trend and the residuals take from the mean: the three parts add up to the score."""
    found = stability(weekly, groups)
    trend = SLOPE_PENALTY * F.least(F.lit(0.0), F.col("slope"))
    return found.withColumn("trend_penalty", F.when(F.col("weeks") > 1, trend)).withColumn("residual_penalty", -RESIDUAL_PENALTY * F.col("residual_std"))


def average_precision(rows: DataFrame, groups: list[str]) -> DataFrame:
    """Step-wise area under precision and recall, one threshold a distinct score."""
    ranked = below(by_score(rows, groups), groups, "prediction", ["pos", "neg"], descending=True)
    tp, fp = F.col("below_pos") + F.col("pos"), F.col("below_neg") + F.col("neg")
    area = F.sum(F.col("pos") * tp / (tp + fp))
    return ranked.groupBy(*groups).agg(F.try_divide(area, F.sum("pos").cast("double")).alias("average_precision"))


def losses(rows: DataFrame, groups: list[str], clip_all: bool = False) -> DataFrame:
    """Brier score and log loss; the log loss alone is clipped, or both."""
    p, y = F.col("prediction"), F.col("target")
    q = clipped(p)
    brier = (q if clip_all else p) - y
    return rows.groupBy(*groups).agg(F.avg(brier * brier).alias("brier"), F.avg(-F.log(F.when(y == 1, q).otherwise(1 - q))).alias("log_loss"))


def score_cells(rows: DataFrame, groups: list[str]) -> DataFrame:
    """groups, pooled, week, prediction, pos, neg: each distinct score of a week, and of all weeks (pooled 1, week null).

    One scan and one shuffle of combined scores, from which all metrics follow. Null and NaN scores are left out.
    """
    levels = F.array(F.struct(F.lit(0).alias("pooled"), F.col("WEEK_NUM").alias("week")), F.struct(F.lit(1).alias("pooled"), F.lit(None).cast(rows.schema["WEEK_NUM"].dataType).alias("week")))
    known = rows.where(F.col("prediction").isNotNull() & ~F.isnan("prediction"))
    both = known.select(*groups, F.inline(levels), "prediction", "target")
    return both.groupBy(*groups, "pooled", "week", "prediction").agg(F.sum("target").alias("pos"), F.sum(1 - F.col("target")).alias("neg"))


def _by_week(cells: DataFrame, groups: list[str], clip_all: bool = False) -> DataFrame:
    """groups, pooled, WEEK_NUM and the metrics of each week, and of all weeks: n_rows, positives, auc and the rest.

    Scores are ranked within buckets of their order; sums of buckets are ranked by group, and come back to the scores as
    one row a bucket. What is summed up by bucket is dealt by group, so weeks and groups need no further shuffle.
    """
    keys = [*groups, "pooled", "week"]
    before = lambda *by: W.partitionBy(*by).rowsBetween(W.unboundedPreceding, -1)
    dealt = cells.select(*groups, "pooled", F.coalesce("week", F.lit(-1)).alias("week"), "prediction", "pos", "neg", order_bucket(F.col("prediction")).alias("bucket"))
    inside = before(*keys, "bucket").orderBy("prediction")
    dealt = dealt.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"in_{c}") for c in ("pos", "neg")])
    buckets = dealt.groupBy(*keys, "bucket").agg(F.sum("pos").alias("b_pos"), F.sum("neg").alias("b_neg")).repartition(*groups)
    sums = [F.coalesce(F.sum(f"b_{c}").over(before(*keys).orderBy("bucket")), F.lit(0)).alias(f"shift_{c}") for c in ("pos", "neg")]
    totals = [F.sum(f"b_{c}").over(W.partitionBy(*keys)).alias(f"all_{c}") for c in ("pos", "neg")]
    met = dealt.join(buckets.select(*keys, "bucket", *sums, *totals), [*keys, "bucket"])
    p, q = F.col("prediction"), clipped(F.col("prediction"))
    b = q if clip_all else p
    tp, fp = (F.col(f"all_{c}") - F.col(f"shift_{c}") - F.col(f"in_{c}") for c in ("pos", "neg"))
    won = F.col("pos") * (F.col("shift_neg") + F.col("in_neg") + F.col("neg") / 2.0)
    parts = {
        "positives": F.col("pos"),
        "negatives": F.col("neg"),
        "auc": won,
        "average_precision": F.col("pos") * tp / (tp + fp),
        "brier": F.col("pos") * (b - 1) * (b - 1) + F.col("neg") * b * b,
        "log_loss": -(F.col("pos") * F.log(q) + F.col("neg") * F.log(1 - q)),
    }
    of_bucket = met.groupBy(*keys, "bucket").agg(*[F.sum(x).alias(k) for k, x in parts.items()]).repartition(*groups)
    whole = of_bucket.groupBy(*keys).agg(*[F.sum(k).alias(k) for k in parts])
    n, pos = F.col("positives") + F.col("negatives"), F.col("positives").cast("double")
    return whole.select(*groups, "pooled", F.when(F.col("pooled") == 0, F.col("week")).alias("WEEK_NUM"), n.alias("n_rows"), "positives", F.try_divide("auc", pos * F.col("negatives")).alias("auc"), F.try_divide("average_precision", pos).alias("average_precision"), (F.col("brier") / n).alias("brier"), (F.col("log_loss") / n).alias("log_loss"))


def weekly_from_cells(cells: DataFrame, groups: list[str]) -> DataFrame:
    """groups, WEEK_NUM, n_rows, positives, auc, gini."""
    return _by_week(cells, groups).where("pooled = 0").select(*groups, "WEEK_NUM", "n_rows", "positives", "auc", (2 * F.col("auc") - 1).alias("gini"))


def metrics_from_cells(cells: DataFrame, groups: list[str], clip_all: bool = False) -> DataFrame:
    """probability_metrics of score_cells."""
    names = ["n_rows", "positives", "auc", "average_precision", "brier", "log_loss"]
    weekly = F.when(F.col("pooled") == 0, 2 * F.col("auc") - 1)
    pooled = [F.max(F.when(F.col("pooled") == 1, F.col(c))).alias(c) for c in names]
    return _scored(_by_week(cells, groups, clip_all).groupBy(*groups).agg(*_trend(weekly), *pooled), groups, names)


def probability_metrics(rows: DataFrame, groups: list[str], clip_all: bool = False) -> DataFrame:
    """The whole suite, from one scan: stability parts, AUC, average precision, Brier score and log loss; groups has a column at least."""
    r = rows.withColumn("prediction", clipped(F.col("prediction"))) if clip_all else rows
    return metrics_from_cells(score_cells(r, groups), groups, clip_all)


def weekly_diagnostics(rows: DataFrame, groups: list[str]) -> DataFrame:
    keys = [*groups, "WEEK_NUM"]
    sums = rows.groupBy(*keys).agg(F.avg("target").alias("positive_rate"), F.avg("prediction").alias("mean_prediction"))
    return gini(rows, keys).join(sums, keys).select(*keys, "n_rows", "positives", "positive_rate", "mean_prediction", "gini")


def _bins(rows: DataFrame, groups: list[str], edge: Column) -> DataFrame:
    return rows.withColumn("bin", edge).groupBy(*groups, "bin").agg(F.count(F.lit(1)).alias("n_rows"), F.avg("prediction").alias("mean_prediction"), F.avg("target").alias("observed_rate"))


def quantile_edges(rows: DataFrame, bins: int, groups: list[str]) -> DataFrame:
    """groups, inner: the exact quantiles that lie inside, each once."""
    found = quantiles(rows, groups, "prediction", [k / bins for k in range(bins + 1)])
    inside = F.filter(F.array_distinct("quantiles"), lambda x: (x > F.get("quantiles", F.lit(0))) & (x < F.get("quantiles", F.lit(bins))))
    return found.select(*groups, inside.alias("inner"))


def _quantile_bins(rows: DataFrame, bins: int, groups: list[str], upper: bool) -> DataFrame:
    edges = quantile_edges(rows, bins, groups)
    met = rows.join(edges, groups) if groups else rows.crossJoin(F.broadcast(edges))  # one row; with groups, one a group
    p = F.col("prediction")
    return _bins(met, groups, F.size(F.filter("inner", lambda e: p >= e if upper else p > e)))


def reliability_quantile(rows: DataFrame, bins: int = 10, groups: list[str] | None = None) -> DataFrame:
    """Quantile bins of each group; a score equal to an inner edge goes to the upper bin."""
    return _quantile_bins(rows, bins, groups or [], True)


def reliability_qcut(rows: DataFrame, bins: int = 10, groups: list[str] | None = None) -> DataFrame:
    """Quantile bins closed on the right; one bin if all scores are equal."""
    return _quantile_bins(rows, bins, groups or [], False)


def cell_bins(cells: DataFrame, bins: int) -> DataFrame:
    """reliability_qcut of one group's pooled score_cells."""
    weighted = cells.withColumn("n", F.col("pos") + F.col("neg"))
    q = quantiles(weighted, [], "prediction", [k / bins for k in range(bins + 1)], "n").first()["quantiles"]
    inner = [x for x in dict.fromkeys(q) if q[0] < x < q[-1]]
    place = sum((F.when(F.col("prediction") > e, 1).otherwise(0) for e in inner), F.lit(0))
    total = F.sum("n")
    return weighted.groupBy(place.alias("bin")).agg(total.alias("n_rows"), (F.sum(F.col("prediction") * F.col("n")) / total).alias("mean_prediction"), (F.sum("pos") / total).alias("observed_rate"))


def reliability_fixed(rows: DataFrame, edges: tuple[float, ...] = FIXED_EDGES, groups: list[str] | None = None) -> DataFrame:
    """Bins by fixed edges, closed on the left, the last one on both sides."""
    return _bins(rows, groups or [], sum((F.when(F.col("prediction") >= e, 1).otherwise(0) for e in edges[1:-1]), F.lit(0)))


def correlation(wide: DataFrame, names: list[str]) -> DataFrame:
    """a, b, correlation of each pair of score columns; null if one is constant."""
    pairs = [(a, b) for k, a in enumerate(names) for b in names[k + 1 :]]
    one = wide.agg(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)).alias("correlation")).alias(f"p{k}") for k, (a, b) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[f"p{k}" for k in range(len(pairs))])).alias("r")).select("r.*")


def prediction_violations(rows: DataFrame, weeks: list[int]) -> DataFrame:
    """(check, violations) of predictions: nulls, repeated cases, weeks, binary target, finite and in [0, 1], one-class weeks."""
    one_class = rows.groupBy("WEEK_NUM").agg(F.count_distinct("target").alias("k")).agg(F.count_if(F.col("k") != 2).alias("one_class_weeks"), F.count_if(~F.col("WEEK_NUM").isin(*weeks)).alias("odd_weeks"), (F.lit(len(weeks)) - F.count_if(F.col("WEEK_NUM").isin(*weeks))).alias("missing_weeks"))
    p = F.col("prediction")
    counts = {
        "null_values": F.count_if(F.col("case_id").isNull() | F.col("target").isNull() | F.col("WEEK_NUM").isNull() | p.isNull()),
        "repeated_cases": F.count("case_id") - F.count_distinct("case_id"),
        "target_not_binary": F.count_if(~F.col("target").isin(0, 1)),
        "not_finite": F.count_if(F.isnan(p) | (F.abs(p) == float("inf"))),
        "out_of_range": F.count_if((p < 0) | (p > 1)),
    }
    one = rows.agg(*[v.cast("long").alias(k) for k, v in counts.items()]).crossJoin(one_class)  # one row each
    names = [*counts, "one_class_weeks", "odd_weeks", "missing_weeks"]
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.col(k).cast("long").alias("violations")) for k in names])).alias("r")).select("r.*")


def compare(actual: DataFrame, expected: DataFrame, keys: list[str], columns: list[str], relative: float = 1e-8, absolute: float = 1e-10) -> DataFrame:
    """keys, metric, actual, expected of values that differ by more than the tolerance, or are missing on a side."""
    long = lambda df, name: df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias(name)) for c in columns])).alias("r")).select(*keys, "r.*")
    met = long(actual, "actual").join(long(expected, "expected"), [*keys, "metric"], "full")
    near = F.abs(F.col("actual") - F.col("expected")) <= absolute + relative * F.abs("expected")
    return met.where(~F.coalesce(near, F.col("actual").isNull() & F.col("expected").isNull()))
