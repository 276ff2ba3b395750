"""Gradient boosting over binned features, one aggregation a tree level for all features at once.

Features are cut into bins at exact quantiles of the training rows; missing values have a bin of their own, which goes
to either side of a cut, whichever gains more. Each row then is one byte a feature, and rows are kept in blocks, a
feature's bytes side by side, so that a pass costs neither a row nor a small task at a time. A level of a tree is one pass:
tasks sum up gradients, their weights and rows by (node, feature, bin), Spark adds these up, and a window over bins
finds the best cut of each node, so that what reaches the driver is one row a node. Gradients are added as whole
numbers, so a model does not depend on how rows are dealt.

Trees grow in one of three ways: ``level`` cuts every node as it likes, ``leaves`` cuts the nodes of the largest gains
while a number of leaves is left, ``oblivious`` cuts all nodes of a level alike. Rounds end where the AUC on held rows
has not grown for some rounds; the curve is kept, and the best round is the model's length.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .encode import drift_scores, frequency_encode, frequency_maps
from .learning import median_rounds
from .metrics import scored_auc
from .ranks import quantiles

GROWTHS = ("level", "leaves", "oblivious")
#: Gradients and weights lie within 1; as whole numbers of this unit their sums are exact over 2^33 rows.
UNIT = float(1 << 30)
MISSING = 255
#: Rows of a block at least, where a partition has as many.
BLOCK_ROWS = 1 << 16
#: Bytes of blocks that a task of a pass takes, once each core has one.
TASK_BYTES = 1 << 25


@dataclass(frozen=True)
class Settings:
    rounds: int = 20
    depth: int = 4
    rate: float = 0.1
    bins: int = 64
    l2: float = 1.0
    min_rows: int = 20
    min_weight: float = 1e-3
    growth: str = "level"
    leaves: int = 16
    #: Shares of rows and of features that a round looks at, drawn by seeded hashes.
    row_share: float = 1.0
    feature_share: float = 1.0
    patience: int = 5
    seed: int = 42

    def __post_init__(self) -> None:
        if self.growth not in GROWTHS:
            raise ValueError(f"growth is one of {', '.join(GROWTHS)}")
        if not (self.rounds > 0 and 0 < self.depth <= 10 and 1 < self.bins < MISSING and self.patience > 0 and self.leaves > 1):
            raise ValueError("rounds, depth, bins, patience or leaves out of range")
        if not (0 < self.row_share <= 1 and 0 < self.feature_share <= 1 and self.rate > 0 and self.l2 >= 0):
            raise ValueError("shares, rate or l2 out of range")


@dataclass(frozen=True)
class Tree:
    """Nodes as in a heap, 2k + 1 and 2k + 2 below k. feature is -1 at leaves; a bin up to cut goes left."""

    feature: tuple[int, ...]
    cut: tuple[int, ...]
    missing_left: tuple[bool, ...]
    value: tuple[float, ...]


@dataclass(frozen=True)
class Booster:
    features: tuple[str, ...]
    edges: tuple[tuple[float, ...], ...]
    base: float
    trees: tuple[Tree, ...] = ()
    #: AUC on held rows after each round, also of rounds behind the best.
    curve: tuple[float, ...] = ()
    #: (feature, gain) of every cut of the trees that are kept.
    cuts: tuple[tuple[tuple[str, float], ...], ...] = field(default=())

    @property
    def best_round(self) -> int:
        return len(self.trees)

    def gains(self) -> dict[str, float]:
        """Sum of the gains of a feature's cuts, 0 for those never cut."""
        found = dict.fromkeys(self.features, 0.0)
        for tree in self.cuts[: len(self.trees)]:
            for name, gain in tree:
                found[name] += gain
        return found

    def curve_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, float(v)) for k, v in enumerate(self.curve, 1)], "round int, auc double")

    def score(self, rows: DataFrame, keep: list[str]) -> DataFrame:
        """keep and prediction, for rows that hold the model's features."""
        wide = rows.select(*keep, values_of(self.features).alias("values"))
        schema = wide.select(*keep).schema.add("prediction", "double")
        n = len(keep)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                p = 1 / (1 + np.exp(-margins(binned(b.column(n), self.edges), self)))
                yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(p)], schema.names)

        return wide.mapInArrow(run, schema)

    def save(self, spark: SparkSession, path: str) -> None:
        """One line of JSON; an existing path is refused."""
        spark.createDataFrame([(json.dumps(asdict(self)),)], "value string").write.text(path)


def load(spark: SparkSession, path: str) -> Booster:
    found = json.loads(spark.read.text(path).first()[0])
    trees = tuple(Tree(*(tuple(t[k]) for k in ("feature", "cut", "missing_left", "value"))) for t in found["trees"])
    cuts = tuple(tuple((n, g) for n, g in tree) for tree in found["cuts"])
    return Booster(tuple(found["features"]), tuple(map(tuple, found["edges"])), found["base"], trees, tuple(found["curve"]), cuts)


def check_reload(model: Booster, rows: DataFrame, key: str, path: str) -> Booster:
    """The model saved at path and read again, which must score every row alike."""
    model.save(rows.sparkSession, path)
    again = load(rows.sparkSession, path)
    if both_scores(model, again, rows, [key]).where("prediction != again").head(1):
        raise ValueError("the stored model scores otherwise")
    return again


def both_scores(model: Booster, again: Booster, rows: DataFrame, keep: list[str]) -> DataFrame:
    """keep, prediction and again: the scores of two models in one pass over rows."""
    own = [f"_value_{k}" for k in range(len(again.features))]
    wide = rows.select(*keep, *model.features, *[F.col(c).alias(o) for c, o in zip(again.features, own, strict=True)])
    first = model.score(wide, [*keep, *own]).withColumnRenamed("prediction", "_prediction")
    second = replace(again, features=tuple(own)).score(first, [*keep, "_prediction"])
    return second.select(*keep, F.col("_prediction").alias("prediction"), F.col("prediction").alias("again"))


# binning


def bin_edges(train: DataFrame, features: tuple[str, ...], bins: int) -> tuple[tuple[float, ...], ...]:
    """Inner quantiles of each feature's finite values, each once: features x bins numbers."""
    value = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c).cast("double"))
    long = train.select(F.posexplode(F.array(*[value(c) for c in features])).alias("feature", "value"))
    found = quantiles(long, ["feature"], "value", [k / bins for k in range(1, bins)])
    of = {r["feature"]: tuple(sorted({*r["quantiles"]})) for r in found.collect()}
    return tuple(of.get(k, ()) for k in range(len(features)))


def values_of(features: tuple[str, ...]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in features])


def binned(values: pa.Array, edges: tuple[tuple[float, ...], ...]) -> np.ndarray:
    """A line of bytes a feature: the number of edges below a row's value, or MISSING."""
    rows = values.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(values), len(edges))
    found = np.empty((len(edges), len(values)), np.uint8)
    for k, e in enumerate(edges):
        found[k] = np.searchsorted(e, rows[:, k])
    found[~np.isfinite(rows.T)] = MISSING
    return found


def packed(rows: DataFrame, features: tuple[str, ...], edges: tuple[tuple[float, ...], ...], key: str) -> DataFrame:
    """Rows in blocks: their number, their sum of targets, and as bytes the targets, hashes of keys, and bins by feature."""
    wide = rows.select(F.col("target").cast("double").alias("target"), F.xxhash64(key).alias("key"), values_of(features).alias("values"))
    names = ["n", "total", "targets", "keys", "bins"]

    def block(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        y, k, x = (np.concatenate(c, axis=-1) for c in zip(*parts, strict=True))
        columns = [pa.array([len(y)], pa.int64()), pa.array([float(y.sum())]), *(pa.array([c.tobytes()], pa.binary()) for c in (y, k, x))]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for b in batches:
            if b.num_rows:
                parts.append((b.column(0).to_numpy(), b.column(1).to_numpy(), binned(b.column(2), edges)))
                n += b.num_rows
            if n >= BLOCK_ROWS:
                yield block(parts)
                parts, n = [], 0
        if parts:
            yield block(parts)

    return wide.mapInArrow(run, "n long, total double, targets binary, keys binary, bins binary")


def unpacked(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Targets, hashes of keys, and bins by feature, a block at a time."""
    for b in batches:
        for y, k, x in zip(*(b.column(c) for c in ("targets", "keys", "bins")), strict=True):
            yield np.frombuffer(y.as_buffer(), float), np.frombuffer(k.as_buffer(), np.int64), np.frombuffer(x.as_buffer(), np.uint8).reshape(width, -1)


def places(x: np.ndarray, tree: Tree) -> np.ndarray:
    """The node that each row reaches. x: a line of bytes a feature."""
    width, n = x.shape
    feature, cut, missing_left = (np.array(c) for c in (tree.feature, tree.cut, tree.missing_left))
    inner, nodes = feature >= 0, np.arange(len(feature))
    # Leaves lead to themselves: any byte goes left, and left is the leaf.
    line, last, left = np.maximum(feature, 0) * n, np.where(inner, cut, MISSING).astype(np.int16), np.where(inner, 2 * nodes + 1, nodes)
    missing_left = missing_left & inner
    node, rows, flat = np.zeros(n, int), np.arange(n), x.reshape(-1)
    for _ in range(int(math.log2(len(feature) + 1)) - 1):
        b = flat[line[node] + rows]
        right = b > last[node]
        if missing_left.any():
            right &= ~((b == MISSING) & missing_left[node])
        node = left[node] + right
    return node


def margins(x: np.ndarray, model: Booster) -> np.ndarray:
    total = np.full(x.shape[1], model.base)
    for tree in model.trees:
        total += np.array(tree.value)[places(x, tree)]
    return total


# one level


def taken(seed: int, round_no: int, key: np.ndarray, share: float) -> np.ndarray:
    """Which hashes belong to a round's sample."""
    with np.errstate(over="ignore"):
        mixed = (key.astype(np.uint64) ^ np.uint64(seed * 1_000_003 + round_no)) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(11)) < np.uint64(int(share * (1 << 53)))


def histograms(rows: DataFrame, model: Booster, tree: Tree, open_nodes: list[int], settings: Settings) -> DataFrame:
    """(node, feature, bin, g, h, n): sums over the rows that reach an open node."""
    width, round_no = len(model.features), len(model.trees)
    chosen = np.flatnonzero(taken(settings.seed + 1, round_no, np.arange(width) + 1, settings.feature_share))
    chosen = chosen if len(chosen) else np.array([round_no % width])
    size = MISSING + 1
    # Where all nodes of a level are cut alike, each lists its empty bins, too.
    per_feature = np.array([np.arange(size) <= len(model.edges[f]) for f in chosen]) | (np.arange(size) == MISSING)
    listed = np.tile(per_feature.ravel(), len(open_nodes))
    place = np.full(len(tree.feature), -1)
    place[open_nodes] = np.arange(len(open_nodes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, len(open_nodes), len(chosen), size), np.int64)
        for y, keys, x in unpacked(batches, width):
            p = 1 / (1 + np.exp(-margins(x, model)))
            at = place[places(x, tree)]
            used = at >= 0
            if settings.row_share < 1:
                used &= taken(settings.seed, round_no, keys, settings.row_share)
            weights, start = (np.rint((p - y) * UNIT)[used], np.rint(p * (1 - p) * UNIT)[used], None), at[used] * size
            for k, f in enumerate(chosen):
                cell = start + x[f][used]
                for s, w in zip(sums, weights, strict=True):
                    s[:, k] += np.bincount(cell, w, len(open_nodes) * size).astype(np.int64).reshape(-1, size)
        sums = sums.reshape(3, -1)
        full = np.flatnonzero(sums[2] > 0 if settings.growth != "oblivious" else listed)
        node, rest = np.divmod(full, len(chosen) * size)
        feature, bin_no = np.divmod(rest, size)
        columns = [pa.array(c, k) for c, k in ((np.array(open_nodes)[node], pa.int32()), (chosen[feature], pa.int32()), (bin_no, pa.int32()), *((sums[k][full], pa.int64()) for k in range(3)))]
        yield pa.RecordBatch.from_arrays(columns, ["node", "feature", "bin", "g", "h", "n"])

    made = rows.select("targets", "keys", "bins").mapInArrow(run, "node int, feature int, bin int, g long, h long, n long")
    # A task gives each cell once, so nothing is lost by dealing cells as the window over bins needs them.
    return made.repartition("node", "feature").groupBy("node", "feature", "bin").agg(*[F.expr(f"sum({c}) AS {c}") for c in ("g", "h", "n")])


def candidate_cuts(sums: DataFrame, settings: Settings) -> DataFrame:
    """(node, feature, cut, missing_left, gain, and the sums of both sides) of each cut that leaves enough on both sides.

    The gain is what the squared sums of gradients over their weights grow by.
    """
    # As SQL text: a level is planned anew each time, and text costs the driver one call where columns cost hundreds.
    over = "OVER (PARTITION BY node, feature"
    unit, l2, least = f"{UNIT!r}D", f"{float(settings.l2)!r}D", f"{settings.min_weight * UNIT!r}D"
    upto = [f"sum({c}) {over} ORDER BY bin ROWS UNBOUNDED PRECEDING) AS l_{c}" for c in "ghn"]
    missing = [f"coalesce(sum(if(bin = {MISSING}, {c}, NULL)) {over}), 0) AS m_{c}" for c in "ghn"]
    wide = sums.selectExpr("node", "feature", "bin AS cut", *upto, *missing, *[f"sum({c}) {over}) AS t_{c}" for c in "ghn"])
    both = wide.where(f"cut != {MISSING}").selectExpr("*", "explode(if(m_n > 0, array(false, true), array(false))) AS missing_left")
    left = {c: f"(l_{c} + if(missing_left, m_{c}, 0))" for c in "ghn"}
    sides = both.selectExpr("node", "feature", "cut", "missing_left", *[f"{left[c]} AS left_{c}" for c in "ghn"], *[f"t_{c} - {left[c]} AS right_{c}" for c in "ghn"])
    kept = sides.where(" AND ".join(f"{s}_n >= {settings.min_rows} AND {s}_h >= {least}" for s in ("left", "right")))
    part = lambda g, h: f"power({g} / {unit}, 2) / ({h} / {unit} + {l2})"
    return kept.selectExpr("*", f"{part('left_g', 'left_h')} + {part('right_g', 'right_h')} - {part('(left_g + right_g)', '(left_h + right_h)')} AS gain")


def best_cuts(cuts: DataFrame, by: list[str]) -> DataFrame:
    """The cut of the largest gain of each group; ties go to the first feature, the lowest cut, missing to the right."""
    order = [x for x in ("feature", "cut", "missing_left") if x not in by]
    rest = [c for c in cuts.columns if c not in (*by, "gain", "feature", "cut", "missing_left")]
    least = F.expr(f"min(struct(-gain AS loss, {', '.join([*order, *rest])})) AS best")
    return cuts.where("gain > 0").groupBy(*by).agg(least).selectExpr(*by, "-best.loss AS gain", *[f"best.{c}" for c in (*order, *rest)])


def first_level_gains(rows: DataFrame, features: tuple[str, ...], settings: Settings = Settings()) -> DataFrame:
    """(name, gain): the best gain of a single cut of all training rows by each feature, 0 if none helps. rows: target and features."""
    made = prepared(rows, None, features, settings.bins, "target")
    try:
        tree = leaf_tree(settings.depth, 0.0)
        sums = histograms(made.train, made.start, tree, [0], replace(settings, row_share=1.0, feature_share=1.0))
        best = best_cuts(candidate_cuts(sums, settings), ["feature"]).select("feature", "gain").collect()  # one row a feature
    finally:
        made.release()
    of = {r["feature"]: r["gain"] for r in best}
    return rows.sparkSession.createDataFrame([(f, float(of.get(k, 0.0))) for k, f in enumerate(features)], "name string, gain double")


# trees and rounds


def leaf_tree(depth: int, value: float) -> Tree:
    n = (1 << (depth + 1)) - 1
    return Tree((-1,) * n, (0,) * n, (False,) * n, (value, *(0.0,) * (n - 1)))


def with_cuts(tree: Tree, cuts: list, settings: Settings) -> Tree:
    """The tree with these nodes cut, and values at their new leaves."""
    feature, cut, missing_left, value = (list(c) for c in (tree.feature, tree.cut, tree.missing_left, tree.value))
    for r in cuts:
        node = r["node"]
        feature[node], cut[node], missing_left[node], value[node] = r["feature"], r["cut"], r["missing_left"], 0.0
        for side, child in (("left", 2 * node + 1), ("right", 2 * node + 2)):
            value[child] = -settings.rate * (r[f"{side}_g"] / UNIT) / (r[f"{side}_h"] / UNIT + settings.l2)
    return Tree(tuple(feature), tuple(cut), tuple(missing_left), tuple(value))


def grow(rows: DataFrame, model: Booster, settings: Settings) -> tuple[Tree, list[tuple[str, float]]]:
    """A further tree, level by level, and the gains of its cuts."""
    tree, open_nodes, gains, leaves = leaf_tree(settings.depth, 0.0), [0], [], 1
    for _ in range(settings.depth):
        cuts = candidate_cuts(histograms(rows, model, tree, open_nodes, settings), settings)
        if settings.growth == "oblivious":
            # The nodes of a cut come with it, as the cuts of a level are worked out by a pass.
            rest = ", ".join(c for c in cuts.columns if c not in ("feature", "cut", "missing_left"))
            alike = cuts.groupBy("feature", "cut", "missing_left").agg(F.expr("sum(gain) AS gain"), F.expr(f"collect_list(struct({rest})) AS nodes"))
            common = best_cuts(alike.withColumn("all", F.lit(1)), ["all"]).first()
            best = [{**n.asDict(), **{c: common[c] for c in ("feature", "cut", "missing_left")}} for n in common["nodes"]] if common else []
        else:
            best = best_cuts(cuts, ["node"]).collect()  # one row a node
        best = sorted(best, key=lambda r: (-r["gain"], r["node"]))
        if settings.growth == "leaves":
            best = best[: settings.leaves - leaves]
        if not best:
            break
        leaves += len(best)
        gains += [(model.features[r["feature"]], max(0.0, float(r["gain"]))) for r in best]
        tree = with_cuts(tree, best, settings)
        open_nodes = sorted(c for r in best for c in (2 * r["node"] + 1, 2 * r["node"] + 2))
    return tree, gains


@dataclass(frozen=True)
class Prepared:
    """A model without trees, and blocks of training and held rows, which are kept until they are released."""

    start: Booster
    train: DataFrame
    held: DataFrame | None
    kept: tuple[DataFrame, ...]

    def release(self) -> None:
        for df in self.kept:
            df.unpersist()


def prepared(train: DataFrame, held: DataFrame | None, features: tuple[str, ...], bins: int, key: str) -> Prepared:
    edges = bin_edges(train, features, bins)
    kept = tuple(packed(df, features, edges, key).persist() for df in (train, held) if df is not None)
    try:
        sizes = [df.agg(F.coalesce(F.sum("n"), F.lit(0)), F.sum("total")).first() for df in kept]
        n, total = sizes[0]
        if not (n and 0 < total < n):
            raise ValueError("training rows need both classes")
    except BaseException:
        for df in kept:
            df.unpersist()
        raise
    start = Booster(features, edges, math.log(total / n / (1 - total / n)))
    blocks = [df.coalesce(tasks_for(df.sparkSession, rows, len(features))) for df, (rows, _) in zip(kept, sizes, strict=True)]
    return Prepared(start, blocks[0], blocks[1] if held is not None else None, kept)


def tasks_for(spark: SparkSession, rows: int, width: int) -> int:
    """Tasks of a pass: one a core, more where a task would have more than TASK_BYTES of blocks."""
    return max(spark.sparkContext.defaultParallelism, -(-rows * (width + 16) // TASK_BYTES))


def curve_of(rows: DataFrame, model: Booster, first: int) -> list[float]:
    """AUC on held rows after each round from first on, of all those rounds in one pass. Rows of equal scores are counted in it."""
    rounds, width = range(first, len(model.trees) + 1), len(model.features)
    names = ["round", "prediction", "pos", "neg"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for y, _, x in unpacked(batches, width):
            total = margins(x, replace(model, trees=model.trees[: first - 1]))
            for r in rounds:
                tree = model.trees[r - 1]
                total = total + np.array(tree.value)[places(x, tree)]
                scores, at = np.unique(np.round(total, 9), return_inverse=True)
                counts = [np.bincount(at[y == t], minlength=len(scores)) for t in (1, 0)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(scores), r, np.int32)), pa.array(scores), *map(pa.array, counts)], names)

    made = rows.select("targets", "keys", "bins").mapInArrow(run, "round int, prediction double, pos long, neg long")
    scored = made.groupBy("round", "prediction").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    found = {r["round"]: r["auc"] for r in scored_auc(scored, ["round"]).collect()}  # one row a round
    if any(found.get(r) is None for r in rounds):
        raise ValueError("held rows need both classes")
    return [float(found[r]) for r in rounds]


def boost(train: DataFrame, held: DataFrame | None, features: list[str], settings: Settings = Settings(), key: str = "case_id") -> Booster:
    """A model of train (target, key, features). With held rows, rounds end behind the best by patience, and the best is kept.

    The curve is worked out for as many rounds at once as patience allows, which ends where a check each round would.
    """
    return boost_each(train, held, features, [settings], key)[0]


def boost_each(train: DataFrame, held: DataFrame | None, features: list[str], settings: list[Settings], key: str = "case_id") -> list[Booster]:
    """A model of each of the settings, from the same rows: these are binned once for settings of as many bins."""
    found: dict[int, Booster] = {}
    for bins in dict.fromkeys(s.bins for s in settings):
        rows = prepared(train, held, tuple(features), bins, key)
        try:
            found |= {k: boosted(rows, s) for k, s in enumerate(settings) if s.bins == bins}
        finally:
            rows.release()
    return [found[k] for k in range(len(settings))]


def boosted(rows: Prepared, settings: Settings) -> Booster:
    model = rows.start
    while len(model.trees) < settings.rounds:
        tree, gains = grow(rows.train, model, settings)
        model = replace(model, trees=(*model.trees, tree), cuts=(*model.cuts, tuple(gains)))
        n = len(model.trees)
        if rows.held is not None and (n - len(model.curve) == settings.patience or n == settings.rounds):
            model = replace(model, curve=(*model.curve, *curve_of(rows.held, model, len(model.curve) + 1)))
            if (stop := stopped(model.curve, settings.patience)) < n:
                return replace(model, trees=model.trees[: best_of(model.curve[:stop])], cuts=model.cuts[: best_of(model.curve[:stop])], curve=model.curve[:stop])
    best = best_of(model.curve) if rows.held is not None else len(model.trees)
    return replace(model, trees=model.trees[:best], cuts=model.cuts[:best])


def refit(train: DataFrame, features: list[str], best_rounds: list[int], settings: Settings = Settings(), key: str = "case_id") -> Booster:
    """The frozen model: as many rounds as the median of the folds' best, on all rows, without held ones."""
    return boost(train, None, features, replace(settings, rounds=median_rounds(best_rounds)), key)


def best_of(curve: tuple[float, ...]) -> int:
    """The first round of the highest value."""
    return max(range(len(curve)), key=lambda k: (curve[k], -k)) + 1


def stopped(curve: tuple[float, ...], patience: int) -> int:
    """The round at which a check each round would end; the curve's length if it would not."""
    for n in range(1, len(curve) + 1):
        if n - best_of(curve[:n]) >= patience:
            return n
    return len(curve)


def gain_screen(train: DataFrame, validation: DataFrame, features: list[str], categorical: list[str] = (), settings: Settings = Settings(), key: str = "case_id") -> DataFrame:
    """name, target_gain, drift_gain, score: gains for the target, less those for telling train from validation.

    Both models end early: the first by validation's rows, the second by a fifth of all rows, drawn by a hash.
    Categories count by their frequency in train.
    """
    numeric = [f for f in features if f not in categorical]
    maps = frequency_maps(train, [*categorical]) if categorical else None
    coded = lambda df: df.select(key, "target").join(frequency_encode(df, maps, [*categorical], numeric, key), key) if categorical else df.select(key, "target", *numeric)
    train, validation = coded(train), coded(validation)
    target = boost(train, validation, features, settings, key).gains()
    both = train.withColumn("target", F.lit(0)).unionByName(validation.withColumn("target", F.lit(1)))
    last = F.pmod(F.xxhash64(F.lit(settings.seed), key), F.lit(5)) == 0
    drift = boost(both.where(~last), both.where(last), features, replace(settings, seed=settings.seed + 17), key).gains()
    rows = [(f, target[f], drift[f]) for f in features]
    return drift_scores(train.sparkSession.createDataFrame(rows, "name string, target_gain double, drift_gain double"))
