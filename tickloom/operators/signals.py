"""Trading signals from probabilities or rules, and the filters on them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.columns import quoted, require, rolling_mean
from tickloom.operators.indicators import atr, rsi
from tickloom.plans.search import chain
from tickloom.plans.series import KEYS, RN, index_series, join_on_keys, over_chunks, quantiles


def signal_map(classes: Sequence[str | int]) -> dict[str, int]:
    """Which class means short, flat and long.

    {-1, 1}, {0, 1} and {-1, 0, 1} go by name, any other two or three classes
    by their position.
    """
    names = [str(c) for c in classes]
    if set(names) == {"-1", "1"} or set(names) == {"-1", "0", "1"}:
        return {n: int(n) for n in names}
    if set(names) == {"0", "1"}:
        return {"0": -1, "1": 1}
    if len(names) in (2, 3):
        return dict(zip(names, (-1, 1) if len(names) == 2 else (-1, 0, 1)))
    raise ValueError(f"no signals for {len(names)} classes")


def map_classes(df: DataFrame, column: str, classes: Sequence[str | int], name: str = "signal") -> DataFrame:
    """Turn predicted classes into signals; unknown classes give NULL."""
    pairs = [F.lit(x) for kv in signal_map(classes).items() for x in kv]
    return df.withColumn(name, F.try_element_at(F.create_map(*pairs), F.col(quoted(column)).cast("string")))


def probability_column(name: str | int) -> Column:
    return F.col(quoted(f"probability_{name}"))


def winner(classes: Sequence[str | int], take) -> Column:
    """`take(class)` of the most probable class; the first one wins a tie."""
    best = F.greatest(*[probability_column(c) for c in classes])
    out = None
    for c in classes:
        hit = probability_column(c) == best
        out = F.when(hit, take(c)) if out is None else out.when(hit, take(c))
    return out


def raw_signals(
    df: DataFrame,
    classes: Sequence[str | int],
    threshold: float = 0.5,
    force_neutral_long: bool = False,
) -> DataFrame:
    """Add probability_pos, probability_neg, confidence and signal.

    Below the threshold there is no signal. `force_neutral_long` turns a
    confident neutral class into a long signal.
    """
    require(df, *[f"probability_{c}" for c in classes])
    mapped = signal_map(classes)
    short, long = (next(c for c in mapped if mapped[c] == v) for v in (-1, 1))
    best = F.greatest(*[probability_column(c) for c in classes])
    value = winner(classes, lambda c: F.lit(1 if force_neutral_long and mapped[str(c)] == 0 else mapped[str(c)]))
    return df.withColumns(
        {
            "probability_pos": probability_column(long),
            "probability_neg": probability_column(short),
            "confidence": best,
            "signal": F.when(best >= threshold, value).otherwise(0),
        }
    )


def trend_filter(df: DataFrame, length: int, signal: str = "signal", keys: Sequence[str] = KEYS) -> DataFrame:
    """Keep longs above and shorts below the moving average; early rows use what they have."""
    indexed = df if RN in df.columns else index_series(df, keys)

    def build(d: DataFrame, w) -> DataFrame:
        mean, s, c = F.avg("close").over(w.rowsBetween(-(length - 1), 0)), F.col(signal), F.col("close")
        against = ((s == 1) & ~F.coalesce(c > mean, F.lit(False))) | ((s == -1) & ~F.coalesce(c < mean, F.lit(False)))
        return d.withColumn(signal, F.when(against, 0).otherwise(s))

    return over_chunks(indexed, build, back=length - 1, keys=keys)


def volatility_filter(
    df: DataFrame, length: int, quantile: float = 0.75, signal: str = "signal", keys: Sequence[str] = KEYS
) -> DataFrame:
    """No signal where the average true range is above its own quantile."""
    ranged = atr(df, length, name="__atr", keys=keys)
    limits = quantiles(ranged, {"__limit": ("__atr", quantile)}, keys)
    out = join_on_keys(ranged, limits, keys, "left")
    high = F.coalesce(F.col("__atr") > F.col("__limit"), F.lit(False))
    return out.withColumn(signal, F.when(high, 0).otherwise(F.col(signal))).drop("__atr", "__limit")


def regime_filter(df: DataFrame, actions: Mapping[int, str], regime: str = "regime", signal: str = "signal") -> DataFrame:
    """Per regime: no_trade, long_only or short_only; other actions change nothing."""
    s = F.col(signal)
    out = s
    for code, action in actions.items():
        here = F.coalesce(F.col(regime) == code, F.lit(False))
        blocked = {"no_trade": here, "long_only": here & (s == -1), "short_only": here & (s == 1)}.get(action)
        if blocked is not None:
            out = F.when(blocked, 0).otherwise(out)
    return df.withColumn(signal, out)


def cooling_period(df: DataFrame, bars: int, signal: str = "signal", keys: Sequence[str] = KEYS) -> DataFrame:
    """After an accepted signal the next `bars` bars give none."""
    if bars <= 0:
        return df
    indexed = df if RN in df.columns else index_series(df, keys)
    wanted = indexed.filter(F.col(signal) != 0).select(*keys, RN, (F.col(RN) + bars + 1).alias("__free"))
    kept = chain(wanted, RN, "__free", keys).select(*keys, RN, F.lit(True).alias("__kept"))
    out = indexed.join(kept, [*keys, RN], "left")
    return out.withColumn(signal, F.when(F.col("__kept"), F.col(signal)).otherwise(0)).drop("__kept")


def generate_signals(
    df: DataFrame,
    classes: Sequence[str | int],
    threshold: float = 0.5,
    trend_length: int | None = None,
    volatility_length: int | None = None,
    volatility_quantile: float = 0.75,
    regime_actions: Mapping[int, str] | None = None,
    cooling: int = 3,
    force_neutral_long: bool = False,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Probabilities to filtered signals, in the order trend, volatility, regime, cooling."""
    out = raw_signals(df if RN in df.columns else index_series(df, keys), classes, threshold, force_neutral_long)
    if trend_length:
        out = trend_filter(out, trend_length, keys=keys)
    if volatility_length:
        out = volatility_filter(out, volatility_length, volatility_quantile, keys=keys)
    if regime_actions:
        out = regime_filter(out, regime_actions)
    return cooling_period(out, cooling, keys=keys)


def crossover_signals(df: DataFrame, short: int, long: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """1 where the short mean crosses above the long one, -1 where it crosses below."""
    indexed = df if RN in df.columns else index_series(df, keys)

    def build(d: DataFrame, w) -> DataFrame:
        d = d.withColumns({"sma_short": rolling_mean("close", w, short), "sma_long": rolling_mean("close", w, long)})
        a, b = F.col("sma_short"), F.col("sma_long")
        pa, pb = F.lag(a).over(w), F.lag(b).over(w)
        return d.withColumn("signal", F.when((a > b) & (pa <= pb), 1).when((a < b) & (pa >= pb), -1).otherwise(0))

    return over_chunks(indexed, build, back=max(short, long), keys=keys)


def rsi_signals(
    df: DataFrame, length: int = 14, lower: float = 30.0, upper: float = 70.0, keys: Sequence[str] = KEYS
) -> DataFrame:
    """1 where the index falls below `lower`, -1 where it rises above `upper`."""
    measured = rsi(df, length, name="rsi", keys=keys)

    def build(d: DataFrame, w) -> DataFrame:
        now, before = F.col("rsi"), F.lag("rsi").over(w)
        return d.withColumn(
            "signal", F.when((now < lower) & (before >= lower), 1).when((now > upper) & (before <= upper), -1).otherwise(0)
        )

    return over_chunks(measured, build, back=1, keys=keys)
