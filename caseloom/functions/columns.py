"""Column expressions whose nulls, NaN and days are exact."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lenient(c: Column, kind: str) -> Column:
    """A cast that gives null where the value does not fit."""
    return c.try_cast(kind)


def decision_date(c: Column, kind: T.DataType) -> Column:
    """ISO text by yyyy-MM-dd alone; dates and timestamps by their day."""
    return F.try_to_date(c, "yyyy-MM-dd") if isinstance(kind, T.StringType) else c.try_cast("date")


# Forms of dates in text, years first or days first, as history columns may hold them.
DATE_FORMS = ("yyyy-MM-dd", "yyyy/MM/dd", "yyyy.MM.dd", "dd-MM-yyyy", "dd/MM/yyyy", "dd.MM.yyyy")


def text_date(c: Column) -> Column:
    """The day that a text names in one of DATE_FORMS; null otherwise."""
    return F.coalesce(*[F.try_to_date(c, form) for form in DATE_FORMS])


def relative_days(c: Column, kind: T.DataType, decision: Column) -> Column:
    """Days from the decision: numbers are days already, dates and their text are subtracted, all else is null."""
    if isinstance(kind, T.NumericType):
        return c.cast("float")
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.datediff(c.cast("date"), decision).cast("float")
    if isinstance(kind, T.StringType):
        return F.datediff(text_date(c), decision).cast("float")
    return F.lit(None).cast("float")


def finite(c: Column) -> Column:
    """NaN and infinities become null; float."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c).cast("float")


def safe_ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, F.when(b != 0, b))


def null_share(columns: list[Column]) -> Column:
    """Share of a row's columns that are null; 0 without columns."""
    if not columns:
        return F.lit(0.0)
    return sum((c.isNull().cast("int") for c in columns), F.lit(0)) / F.lit(float(len(columns)))


def clipped(p: Column, eps: float = 1e-7) -> Column:
    return F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps))


def calendar(date: Column) -> dict[str, Column]:
    return {
        "year": F.year(date).cast("short"),
        "month": F.month(date).cast("byte"),
        "day": F.dayofmonth(date).cast("byte"),
        "weekday": (F.weekday(date) + 1).cast("byte"),
        "ordinal_day": F.dayofyear(date).cast("short"),
    }


def sample_hash(key: Column, seed: int) -> Column:
    """The reproducible order that samples are drawn by."""
    return F.pmod(key.cast("long") * F.lit(1103515245) + F.lit(seed), F.lit(2147483647))
