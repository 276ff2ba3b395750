"""Many history rows of a case to one feature row: null-exact aggregates in one shuffle."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions.columns import null_share, safe_ratio
from caseloom.functions.schema import feature_name

#: Where rows were stored, as scans write it.
ORDINAL = "row_ordinal"
WINDOWS = (30, 180, 365, 730, 1825)
#: Aggregates beyond this number go to further passes over the same shuffle, for the limits of generated code.
CHUNK = 240

#: Subgroups of a person table: all rows, the applicant (num_group1 = 0), related persons (> 0).
SUBGROUPS = {"all": None, "applicant": "num_group1 = 0", "related": "num_group1 > 0"}


def order_columns(columns: Sequence[str], depth: int) -> list[str]:
    wanted = ["num_group1", "num_group2"] if depth == 2 else ["num_group1"]
    return [c for c in wanted if c in columns]


def _plain(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def distinct_with_null(c: Column, here: Column, large_cases: bool = False) -> Column:
    """Null counts as one value. A set holds a case's distinct values; for large cases Spark counts them, at a copy of each row a column."""
    value = F.when(here, c)
    known = F.count_distinct(value) if large_cases else F.size(F.collect_set(value)).cast("long")
    return known + F.coalesce(F.max((here & c.isNull()).cast("int")), F.lit(0))


def numeric_aggregates(c: Column, here: Column) -> dict[str, Column]:
    v = F.when(here, c.cast("double"))
    return {
        "min": F.coalesce(F.min(_plain(v)), F.min(v)),
        "max": F.coalesce(F.max(_plain(v)), F.max(v)),
        "mean": F.avg(v),
        "std": F.stddev_samp(v),
        "sum": F.coalesce(F.sum(v), F.lit(0.0)),
    }


def date_aggregates(c: Column, here: Column, windows: Sequence[int]) -> dict[str, Column]:
    v = F.when(here, c.cast("double"))
    out = {"min": F.min(v), "max": F.max(v), "mean": F.avg(v), "std": F.stddev_samp(v)}
    out = {k: x.cast("float") for k, x in out.items()}
    return out | {f"count_last_{w}d": F.count_if(here & c.between(-w, 0)) for w in windows}


def categorical_aggregates(c: Column, here: Column, large_cases: bool = False) -> dict[str, Column]:
    known, kinds = F.count(F.when(here, c)), distinct_with_null(c, here, large_cases)
    return {"non_null_count": known, "n_unique": kinds, "diversity_ratio": safe_ratio(kinds, known).cast("float")}


def aggregate_history(
    frame: DataFrame,
    family: str,
    depth: int,
    numeric: Sequence[str] = (),
    categorical: Sequence[str] = (),
    dates: Sequence[str] = (),
    windows: Sequence[int] = WINDOWS,
    subgroups: Sequence[str | None] = (None,),
    key: str = "case_id",
    ties: Sequence[str] | None = None,
    ends: bool = True,
    large_cases: bool = False,
) -> DataFrame:
    """One row a case. dates hold days from the decision. ties order rows of equal group numbers: by default the order
    in which rows are stored, where the scan kept it as row_ordinal. ends False leaves out first and last values, and with them a sort.

    Subgroups are conditions inside the aggregates, so one pass serves all. First and last values come from
    one least and one greatest struct of all columns, nulls first, instead of a sort for each column. A case
    without rows of a subgroup has null there, and a case without rows at all has no row.
    """
    ties = ([ORDINAL] if ORDINAL in frame.columns else []) if ties is None else ties
    order = [*order_columns(frame.columns, depth), *ties]
    payload = [*numeric, *categorical, *dates]
    share = null_share([F.col(c) for c in payload])
    whole, ordered = {}, {}
    for group in subgroups:
        condition = SUBGROUPS.get(group) if group and group != "all" else None
        if condition and "num_group1" not in frame.columns:
            continue
        here = F.expr(condition) if condition else F.lit(True)
        here = F.coalesce(here, F.lit(False))
        found: dict[str, Column] = {}
        name = lambda column, op: feature_name(family, depth, column, op, group)  # noqa: B023, E731
        for g in order_columns(frame.columns, depth):
            found[name(g, "max")] = F.max(F.when(here, F.col(g)))
            found[name(g, "n_unique")] = distinct_with_null(F.col(g), here, large_cases)
        found[name("row_missing_fraction", "mean")] = F.avg(F.when(here, share)).cast("float")
        found[name("row_missing_fraction", "max")] = F.max(F.when(here, share)).cast("float")
        for columns, make in ((numeric, numeric_aggregates), (dates, lambda c, h: date_aggregates(c, h, windows)), (categorical, lambda c, h: categorical_aggregates(c, h, large_cases))):
            for c in columns:
                found |= {name(c, op): x for op, x in make(F.col(c), here).items()}
        any_row = F.count_if(here)
        if condition:
            found = {k: F.when(any_row > 0, x) for k, x in found.items()}
            any_row = F.when(any_row > 0, any_row)
        whole |= {name("rows", "count"): any_row} | found
        if ends and order and payload:
            row = F.when(here, F.struct(*order, *[F.col(c) for c in payload if c not in order]))
            for end, pick in (("first", F.min), ("last", F.max)):
                ordered |= {(name(c, end), c in dates): (pick(row), c, f"{end}_{group}") for c in payload}
    parts = list(whole.items())
    chunks = [parts[i : i + CHUNK] for i in range(0, len(parts), CHUNK)] or [[]]
    if len(chunks) > 1 or ordered:
        frame = frame.repartition(F.col(key))
    blocks = [frame.groupBy(key).agg(*[x.alias(k) for k, x in chunk]) for chunk in chunks if chunk]
    if ordered:
        structs = {}
        for agg, _, at in ordered.values():
            structs.setdefault(at, agg)
        outer = frame.groupBy(key).agg(*[x.alias(at) for at, x in structs.items()])
        kind = lambda c, is_date: c.cast("float") if is_date else c
        blocks.append(outer.select(key, *[kind(F.col(f"{at}.{c}"), is_date).alias(n) for (n, is_date), (_, c, at) in ordered.items()]))
    return reduce(lambda a, b: a.join(b, key), blocks)
