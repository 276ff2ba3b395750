"""Modelling frames: feature indexes, folds, inference populations, evaluation reports and block totals."""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType

from caseloom.functions.columns import decision_date, sample_hash
from caseloom.functions.schema import LEAKS

from .joins import one_to_one
from .metrics import cell_bins, metrics_from_cells, score_cells, weekly_from_cells

CASE, TARGET, WEEK = "case_id", "target", "WEEK_NUM"


@dataclass(frozen=True)
class Feature:
    name: str
    block: str
    kind: str
    categorical: bool


def index_features(blocks: Mapping[str, DataFrame]) -> list[Feature]:
    """All columns of the blocks but id and target, by block and name; a name in two blocks is refused."""
    found: dict[str, Feature] = {}
    for block, df in blocks.items():
        for f in df.schema:
            if f.name in (CASE, TARGET):
                continue
            if f.name in found:
                raise ValueError(f"the feature {f.name} is in {found[f.name].block} and in {block}")
            found[f.name] = Feature(f.name, block, f.dataType.simpleString(), isinstance(f.dataType, StringType))
    return sorted(found.values(), key=lambda f: (f.block, f.name))


def check_parity(train: Mapping[str, DataFrame], test: Mapping[str, DataFrame]) -> None:
    """Both splits have the same blocks, and no target is in test."""
    if odd := {*train} ^ {*test}:
        raise ValueError(f"blocks of one split alone: {', '.join(sorted(odd))}")
    if held := [b for b, df in test.items() if TARGET in df.columns]:
        raise ValueError(f"test blocks hold the target: {', '.join(sorted(held))}")


@dataclass(frozen=True)
class Side:
    """A named span of weeks, ends included; most draws so many of its cases by a hash with this seed."""

    name: str
    first: int
    last: int
    most: int | None = None
    seed: int = 42

    @property
    def here(self) -> Column:
        return F.col(WEEK).between(self.first, self.last)


def request_faults(features: Sequence[Feature], sides: Sequence[Side]) -> list[str]:
    """What is wrong with a request for a frame, before any row is read."""
    names = Counter(f.name for f in features)
    spans = sorted(sides, key=lambda s: (s.first, s.last))
    return [
        *(f"{n} is asked for {k} times" for n, k in names.items() if k > 1),
        *(f"{n} would give the target away" for n in sorted(LEAKS & names.keys())),
        *(f"{s.name}: weeks {s.first} to {s.last} are no span" for s in sides if not 0 <= s.first <= s.last),
        *(f"{s.name}: no case is asked for" for s in sides if s.most is not None and s.most < 1),
        *(f"the weeks of {a.name} reach into those of {b.name}" for a, b in pairwise(spans) if a.last >= b.first),
        *(f"a side named {n} appears {k} times" for n, k in Counter(s.name for s in sides).items() if k > 1),
    ]


def sided_frame(base: DataFrame, blocks: Mapping[str, DataFrame], features: Sequence[Feature], sides: Sequence[Side], check: bool = True) -> DataFrame:
    """side, case_id, target, WEEK_NUM and the chosen features of the cases of all sides, each block joined once.

    Cases without a block's row have null. With check, violations of frame_violations in any whole side, before cases are
    drawn, are refused; base alone is read for that.
    """
    if faults := request_faults(features, sides):
        raise ValueError("; ".join(faults))
    side = F.coalesce(*[F.when(s.here, F.lit(s.name)) for s in sides])
    weeks = F.col(WEEK).between(min(s.first for s in sides), max(s.last for s in sides))
    of_base = [f.name for f in features if f.block == "base" and f.name != WEEK]
    rows = base.where(weeks).select(side.alias("side"), CASE, TARGET, WEEK, *of_base).where(F.col("side").isNotNull())
    if check:
        per_side = frame_violations(rows, None, ["side"]).where("violations > 0").collect()  # a few rows a side
        empty = {s.name for s in sides} - {r["side"] for r in rows.groupBy("side").count().collect()}
        if bad := sorted(f"{r['side']}: {r['check']}" for r in per_side) + sorted(f"{n}: empty" for n in empty):
            raise ValueError(f"the frame fails: {', '.join(bad)}")
    if any(s.most is not None for s in sides):
        drawn = [rows.where(F.col("side") == s.name) for s in sides]
        rows = reduce(DataFrame.unionAll, [df if s.most is None else df.orderBy(sample_hash(F.col(CASE), s.seed), CASE).limit(s.most) for df, s in zip(drawn, sides, strict=True)])
    wanted = {b: [f.name for f in features if f.block == b] for b in blocks if b != "base"}
    return one_to_one(rows, [blocks[b].select(CASE, *names) for b, names in wanted.items() if names], [CASE], check="inline" if check else False)


def feature_frame(base: DataFrame, blocks: Mapping[str, DataFrame], features: Sequence[Feature], weeks: tuple[int, int], max_rows: int | None = None, seed: int = 42, check: bool = True) -> DataFrame:
    """One side alone: case_id, target, WEEK_NUM and the chosen features of the cases of some weeks."""
    return sided_frame(base, blocks, features, [Side("all", *weeks, max_rows, seed)], check).drop("side")


def frame_violations(frame: DataFrame, weeks: tuple[int, int] | None, groups: Sequence[str] = ()) -> DataFrame:
    """(groups, check, violations) of a modelling frame: ids, weeks, a binary target of two classes."""
    inside = F.col(WEEK).between(*weeks) if weeks else F.col(WEEK).isNotNull()
    counts = {
        "empty": F.when(F.count(F.lit(1)) == 0, 1).otherwise(0),
        "case_id_null": F.count_if(F.col(CASE).isNull()),
        "case_id_repeated": F.count(CASE) - F.count_distinct(CASE),
        "week_outside": F.count_if(~F.coalesce(inside, F.lit(False))),
        "target_not_binary": F.count_if(~F.coalesce(F.col(TARGET).isin(0, 1), F.lit(False))),
        "one_class": F.when(F.count_distinct(TARGET) == 2, 0).otherwise(1),
    }
    return _listed(frame.groupBy(*groups).agg(*[c.cast("long").alias(k) for k, c in counts.items()]), [*counts], groups)


def _listed(wide: DataFrame, checks: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """Columns of counts as rows of check and violations."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.col(k).alias("violations")) for k in checks]))
    return wide.select(*groups, pairs.alias("r")).select(*groups, "r.*")


def fold_sides(train: tuple[int, int], validation: tuple[int, int], seed: int = 42, caps: tuple[int | None, int | None] = (None, None)) -> list[Side]:
    """The sides of a fold: training weeks before validation's; a capped validation draws with the next seed."""
    if train[1] >= validation[0]:
        raise ValueError("training weeks reach into validation")
    return [Side("train", *train, caps[0], seed), Side("validation", *validation, caps[1], seed + 1)]


def fold_frames(base: DataFrame, blocks: Mapping[str, DataFrame], features: Sequence[Feature], train: tuple[int, int], validation: tuple[int, int], seed: int = 42, caps: tuple[int | None, int | None] = (None, None), check: bool = True) -> tuple[DataFrame, DataFrame]:
    """The two sides of a fold apart. Where both are used at once, sided_frame reads each block once for both."""
    both = sided_frame(base, blocks, features, fold_sides(train, validation, seed, caps), check)
    return tuple(both.where(F.col("side") == name).drop("side") for name in ("train", "validation"))


def inference_violations(base: DataFrame) -> DataFrame:
    """(check, violations) of a scoring base: no target, whole non-negative ids that do not repeat, dates that can be read."""
    date = decision_date(F.col("date_decision"), base.schema["date_decision"].dataType)
    counts = {
        "empty": F.when(F.count(F.lit(1)) == 0, 1).otherwise(0),
        "target_present": F.lit(int(TARGET in base.columns)),
        "case_id_not_whole": F.lit(int(not isinstance(base.schema[CASE].dataType, IntegralType))),
        "case_id_null": F.count_if(F.col(CASE).isNull()),
        "case_id_repeated": F.count(CASE) - F.count_distinct(CASE),
        "case_id_negative": F.count_if(F.col(CASE).try_cast("long") < 0),
        "date_invalid": F.count_if(date.isNull()),
    }
    return _listed(base.agg(*[c.cast("long").alias(k) for k, c in counts.items()]), [*counts])


def inference_frame(base: DataFrame, blocks: Mapping[str, DataFrame], features: Sequence[Feature], cases: DataFrame | None = None) -> DataFrame:
    """case_id and the features, in their order, of each case of a base without a target, or of the given batch of cases.

    A missing history is null; a missing block or feature is an error. Each case's row depends on that case alone,
    so batches give the rows of a whole run.
    """
    if bad := [r["check"] for r in inference_violations(base).where("violations > 0").collect()]:
        raise ValueError(f"the scoring base fails: {', '.join(bad)}")
    if gone := sorted({f.block for f in features} - {*blocks}):
        raise ValueError(f"blocks are missing: {', '.join(gone)}")
    if gone := sorted(f.name for f in features if f.name not in blocks[f.block].columns):
        raise ValueError(f"features are missing: {', '.join(gone)}")
    ids = base.select(F.col(CASE).cast("long").alias(CASE))
    if cases is not None:
        wanted = cases.select(F.col(CASE).cast("long").alias(CASE))
        if wanted.groupBy(CASE).count().where("count > 1").head(1) or wanted.join(ids, CASE, "left_anti").head(1):
            raise ValueError("the batch repeats a case or names an unknown one")
        ids = ids.join(wanted, CASE, "left_semi")
    chosen = [blocks[b].select(CASE, *[f.name for f in features if f.block == b]) for b in dict.fromkeys(f.block for f in features)]
    return one_to_one(ids, chosen, [CASE]).select(CASE, *[f.name for f in features])


def evaluation_report(rows: DataFrame, weeks: Sequence[int], bins: int = 10) -> DataFrame:
    """(section, key, metric, value): the whole suite, each week, and reliability by quantile bins.

    rows: WEEK_NUM, target, prediction. The weeks must be exactly those expected, each with both classes. Rows are read
    once; all sections follow from their distinct scores. The report has a row a week, bin and metric, made on the driver.
    """
    everyone = rows.select(F.lit(1).alias("all"), WEEK, TARGET, "prediction")
    cells = score_cells(everyone, ["all"]).persist()
    try:
        weekly = [r.asDict() for r in weekly_from_cells(cells, ["all"]).select(WEEK, "n_rows", "positives", "gini").collect()]
        if {r[WEEK] for r in weekly} != {*weeks}:
            raise ValueError("the weeks are not those expected")
        if single := sorted(r[WEEK] for r in weekly if r["positives"] in (0, r["n_rows"])):
            raise ValueError(f"weeks of one class: {', '.join(map(str, single))}")
        (whole,) = metrics_from_cells(cells, ["all"]).drop("all").collect()
        binned = cell_bins(cells.where("pooled = 1"), bins).collect()
    finally:
        cells.unpersist()
    whole = whole.asDict() | {"positive_rate": whole["positives"] / whole["n_rows"]}
    parts = [("whole", 0, whole)]
    parts += [("week", r.pop(WEEK), r) for r in weekly]
    parts += [("bin", r.pop("bin"), r) for r in (b.asDict() for b in binned)]
    lines = [(section, int(key), metric, None if v is None else float(v)) for section, key, values in parts for metric, v in values.items()]
    return rows.sparkSession.createDataFrame(lines, "section string, key int, metric string, value double")


def concat_exact(parts: Sequence[DataFrame], key: Sequence[str] = ()) -> DataFrame:
    """Rows of parts whose names and types must be the same and in the same order; with a key, none may repeat."""
    first, *rest = parts
    for n, p in enumerate(rest, 1):
        if p.dtypes != first.dtypes:
            raise ValueError(f"part {n} has another schema: {sorted({*p.dtypes} ^ {*first.dtypes}) or 'another order'}")
    whole = reduce(DataFrame.unionAll, parts)
    if key and whole.groupBy(*key).count().where("count > 1").head(1):
        raise ValueError(f"{', '.join(key)} repeats")
    return whole


def block_totals(blocks: Mapping[str, DataFrame]) -> DataFrame:
    """block, n_rows, feature_columns, and how many of them are categorical, one row a block."""
    made = []
    for name, df in blocks.items():
        found = index_features({name: df})
        made.append(df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("block"), "n_rows", F.lit(len(found)).alias("feature_columns"), F.lit(sum(f.categorical for f in found)).alias("categorical_columns")))
    return reduce(DataFrame.unionAll, made)
