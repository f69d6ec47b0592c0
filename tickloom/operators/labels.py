"""Labels that look ahead: triple barrier and direction."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.columns import col, div, quoted, require
from tickloom.plans.search import first_exit
from tickloom.plans.series import KEYS, N_ROWS, RN, index_series, over_chunks

FRAME_LIMIT = 64


def triple_barrier(
    df: DataFrame,
    atr: str | Column,
    atr_multiplier_tp: float,
    atr_multiplier_sl: float,
    max_holding_period: int,
    min_return_threshold: float = 0.0,
    name: str = "label",
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """1 if the upper barrier is met first (or in the same bar), -1 if the lower one is.

    Without a touch the return at the time barrier decides, or 0 without a
    threshold. The last row of a key, and a horizon below 1, give NULL. Short
    horizons use a forward frame; long ones search block summaries, so the
    cost does not grow with the horizon.
    """
    require(df, "high", "low", "close")
    indexed = df if RN in df.columns else index_series(df, keys)
    h = max_holding_period
    if h < 1:
        return indexed.withColumn(name, F.lit(None).cast("int"))
    leveled = indexed.withColumns(
        {
            "__tp": F.col("close") + col(atr) * atr_multiplier_tp,
            "__sl": F.col("close") - col(atr) * atr_multiplier_sl,
        }
    )
    if h <= FRAME_LIMIT:

        def build(d: DataFrame, w) -> DataFrame:
            frame = w.rowsBetween(1, h)
            ahead = F.collect_list(F.struct(RN, "high", "low")).over(frame)
            first = lambda hit: F.array_min(F.transform(F.filter("__ahead", hit), lambda b: b[RN]))
            return d.withColumns({"__ahead": ahead, "__end": F.last("close").over(frame)}).withColumns(
                {"__up": first(lambda b: b["high"] >= F.col("__tp")), "__down": first(lambda b: b["low"] <= F.col("__sl"))}
            )

        seen = over_chunks(leveled, build, ahead=h, keys=keys).drop("__ahead")
        hit = (
            F.when(F.col("__up").isNotNull() & (F.col("__down").isNull() | (F.col("__up") <= F.col("__down"))), 1)
            .when(F.col("__down").isNotNull(), -1)
        )
    else:
        entries = leveled.select(
            *keys, N_ROWS, F.col(RN).alias("entry_rn"), F.lit(1).alias("direction"), F.col("close").alias("entry_price"),
            F.col("__sl").alias("stop"), F.col("__tp").alias("target"),
            F.lit(None).cast("double").alias("activation"), F.lit(None).cast("double").alias("trail"),
            F.least(F.col(RN) + h, F.col(N_ROWS) - 1).alias("last_rn"),
        ).filter(F.col("entry_rn") < F.col(N_ROWS) - 1)
        found = first_exit(entries, indexed, keys, hi="high", lo="low", stop_first=False)
        found = found.select(*keys, F.col("entry_rn").alias(RN), F.col("exit_reason").alias("__why"), F.col("exit_price").alias("__end"))
        seen = leveled.join(found, [*keys, RN], "left")
        hit = F.when(F.col("__why") == "Take Profit", 1).when(F.col("__why") == "Stop Loss", -1)
    timed = div(F.col("__end") - F.col("close"), "close")
    if min_return_threshold > 0:
        timed_out = F.when(timed >= min_return_threshold, 1).when(timed <= -min_return_threshold, -1).otherwise(0)
    else:
        timed_out = F.lit(0)
    label = F.when(F.col(RN) < F.col(N_ROWS) - 1, F.coalesce(hit, timed_out))
    out = seen.withColumn(name, label.cast("int"))
    return out.drop("__tp", "__sl", "__up", "__down", "__end", "__why")


def directional(
    df: DataFrame,
    horizon: int = 10,
    threshold: float = 0.001,
    name: str = "label",
    keep_open: bool = False,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Sign of the return `horizon` bars ahead beyond a threshold; rows without one go."""
    indexed = df if RN in df.columns else index_series(df, keys)

    def build(d: DataFrame, w) -> DataFrame:
        return d.withColumn("__fut", div(F.lead("close", horizon).over(w), "close") - 1)

    out = over_chunks(indexed, build, ahead=horizon, keys=keys)
    label = F.when(F.col("__fut") > threshold, 1).when(F.col("__fut") < -threshold, -1).when(F.col("__fut").isNotNull(), 0)
    out = out.withColumn(name, label)
    return (out if keep_open else out.filter(F.col("__fut").isNotNull())).drop("__fut")


def add_label(df: DataFrame, spec, indicators: Sequence[Mapping] = (), keys: Sequence[str] = KEYS) -> DataFrame:
    """The label step of `build_features`.

    The barrier width is `atr_column` if given, else ATRr_{n} with n from the
    spec, the first configured atr, or 10. Undecided rows become 0.
    """
    if spec.method is None:
        return df
    if spec.method == "directional":
        return directional(df, spec.max_holding_period, spec.min_return_threshold, "directional_label", keys=keys)
    if spec.method != "triple_barrier":
        raise ValueError(f"unknown label method {spec.method!r}")
    configured = next((c.get("length", 14) for c in indicators if c["indicator"].lower() == "atr"), 10)
    width = spec.atr_column or f"ATRr_{spec.atr_period or configured}"
    require(df, width)
    labeled = triple_barrier(
        df,
        F.col(quoted(width)),
        spec.atr_multiplier_tp,
        spec.atr_multiplier_sl,
        spec.max_holding_period,
        spec.min_return_threshold,
        "triple_barrier_label",
        keys,
    )
    return labeled.fillna(0, ["triple_barrier_label"])
