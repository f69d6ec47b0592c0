"""Column expressions shared by the operators.

NULL is the only missing value: NaN is turned into NULL on the way in and a
division by zero gives NULL.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T


OHLCV = ("open", "high", "low", "close", "volume")


def col(c: str | Column) -> Column:
    """A column by its exact name, dots included."""
    if not isinstance(c, str):
        return c
    return F.col(c if c.startswith("`") else quoted(c))


def div(a: str | Column, b: str | Column) -> Column:
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def nan_to_null(c: str | Column) -> Column:
    return F.when(~F.isnan(col(c)), col(c))


def log(c: str | Column) -> Column:
    """Natural log, NULL for values that are not positive."""
    return F.when(col(c) > 0, F.ln(col(c)))


def clamp(c: Column, lo: Column, hi: Column) -> Column:
    return F.greatest(lo, F.least(hi, c))


def tail(w: WindowSpec, n: int) -> WindowSpec:
    """The current row and the n-1 rows before it."""
    return w.rowsBetween(-(n - 1), 0)


def full(agg: Column, counted: Column, w: WindowSpec, n: int) -> Column:
    """A rolling aggregate that is NULL unless all n values are present."""
    frame = tail(w, n)
    return F.when(F.count(counted).over(frame) == n, agg.over(frame))


def rolling_mean(c: str | Column, w: WindowSpec, n: int) -> Column:
    return full(F.avg(col(c)), col(c), w, n)


def rolling_std(c: str | Column, w: WindowSpec, n: int) -> Column:
    return full(F.stddev_samp(col(c)), col(c), w, n)


def rolling_sum(c: str | Column, w: WindowSpec, n: int) -> Column:
    return full(F.sum(col(c)), col(c), w, n)


def correlation(a: str | Column, b: str | Column, over: Callable[[Column], Column] = lambda c: c) -> Column:
    """Pearson correlation of the rows with both values; NULL if either is constant.

    `over` turns each aggregate into a window expression where one is wanted.
    """
    a, b = col(a).cast("double"), col(b).cast("double")
    da, db = over(F.stddev_pop(F.when(b.isNotNull(), a))), over(F.stddev_pop(F.when(a.isNotNull(), b)))
    return F.try_divide(over(F.covar_pop(a, b)), da * db)


def pct_change(c: str | Column, w: WindowSpec, n: int = 1) -> Column:
    return div(col(c), F.lag(col(c), n).over(w)) - 1


def clean_name(name: str) -> str:
    """Blank, parenthesis, percent and dot runs become one underscore."""
    return re.sub(r"_+", "_", re.sub(r"[\s()%.]+", "_", name)).strip("_")


def clean_names(df: DataFrame) -> DataFrame:
    new = [clean_name(c) for c in df.columns]
    if len(set(new)) != len(new):
        raise ValueError(f"column names collide after cleaning: {new}")
    return df.toDF(*new)


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def require(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; have {df.columns}")


def quoted(name: str) -> str:
    return f"`{name}`"


def rounded(df: DataFrame, digits: int = 6, raw: Iterable[str] = ()) -> DataFrame:
    """Round every double but `raw`; adding 0.0 turns -0.0 into 0.0."""
    return df.select(
        *[
            (F.round(F.col(quoted(f.name)), digits) + F.lit(0.0)).alias(f.name)
            if isinstance(f.dataType, T.DoubleType) and f.name not in raw
            else F.col(quoted(f.name))
            for f in df.schema.fields
        ]
    )


