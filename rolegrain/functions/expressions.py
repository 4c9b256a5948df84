"""Column expressions that the operators share; all stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def nan() -> Column:
    return F.lit(float("nan"))


def to_numeric(c: str) -> Column:
    """NULL or unreadable becomes NaN (readers convert once; later operators test NaN only)."""
    return F.coalesce(F.expr(f"try_cast(`{c}` as double)"), nan())


def is_missing(c: Column) -> Column:
    return c.isNull() | F.isnan(c)


def log_odds(p: Column, eps: float = 1e-7) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.log(q / (1 - q))


def scalar_average(values: Column) -> Column:
    """Mean of the elements that aren't NULL, 0 if there are none."""
    there = F.filter(values, lambda x: x.isNotNull())
    total = F.aggregate(there, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(there) > 0, total / F.size(there)).otherwise(F.lit(0.0))


def vector_average(vectors: Column, dim: int) -> Column:
    """Element-wise mean of the arrays that aren't NULL, zeros if there are none."""

    def element(i: int) -> Column:
        return scalar_average(F.transform(vectors, lambda v: F.get(v, F.lit(i))))

    return F.array(*[element(i) for i in range(dim)])


def weighted_average(columns: list[Column], weights: list[float]) -> Column:
    """Weights of absent values are shared out among the others."""
    top = sum((F.coalesce(c, F.lit(0.0)) * w for c, w in zip(columns, weights)), F.lit(0.0))
    bottom = sum((F.when(c.isNotNull(), F.lit(float(w))).otherwise(0.0) for c, w in zip(columns, weights)), F.lit(0.0))
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def argmax(values: Column) -> Column:
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def fold_of(key: Column, folds: int = 5) -> Column:
    """A deterministic fold: the key's remainder for integers."""
    return F.pmod(key, F.lit(folds)).cast("int")


def replace_year(d: Column, year: Column) -> Column:
    first = F.make_date(year, F.month(d), F.lit(1))
    return F.make_date(year, F.month(d), F.least(F.dayofmonth(d), F.dayofmonth(F.last_day(first))))


def replace_month(d: Column, month: Column) -> Column:
    first = F.make_date(F.year(d), month, F.lit(1))
    return F.make_date(F.year(d), month, F.least(F.dayofmonth(d), F.dayofmonth(F.last_day(first))))


def replace_weekday(d: Column, weekday: Column) -> Column:
    """Monday is 0; the day moves inside its week."""
    return F.date_add(d.cast("date"), (weekday - F.weekday(d)).cast("int"))
