"""Bars from a stream of ticks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.plans.series import KEYS, TS


def stream_bars(
    ticks: DataFrame,
    duration: str,
    delay: str,
    price: str | Column = "price",
    volume: str | Column | None = None,
    order: Sequence[str] = (TS,),
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Open, high, low, close and volume per window, ready for append mode.

    A window is emitted once the newest tick is `delay` past its end; ticks
    later than that are dropped. Each window keeps five numbers of state.
    """
    p = F.col(price) if isinstance(price, str) else price
    v = F.lit(1.0) if volume is None else (F.col(volume) if isinstance(volume, str) else volume)
    place = F.struct(*order)
    ready = ticks.withColumns({"__p": p, "__v": v.cast("double")}).withWatermark(TS, delay)
    return (
        ready.groupBy(*keys, F.window(TS, duration).alias("__w"))
        .agg(
            F.min_by("__p", place).alias("open"),
            F.max("__p").alias("high"),
            F.min("__p").alias("low"),
            F.max_by("__p", place).alias("close"),
            F.sum("__v").alias("volume"),
        )
        .select(*keys, F.col("__w.start").alias(TS), "open", "high", "low", "close", "volume")
    )


def closing_tick(newest: str | Column, duration: str, delay: str) -> Column:
    """A time so far past the newest tick that one tick at it closes every window before.

    A stream that ends leaves its last windows open. Feed one more tick without
    a price at this time, and drop bars without a price. (A filter on the keys
    would run before the watermark and hide the tick from it.)
    """
    t = F.col(newest) if isinstance(newest, str) else newest
    return t + F.expr(f"INTERVAL {duration}") + F.expr(f"INTERVAL {duration}") + F.expr(f"INTERVAL {delay}") + F.expr(f"INTERVAL {delay}")
