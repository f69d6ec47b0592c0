"""Technical indicators: windows for bounded ones, the chunked average for the rest.

An `Indicator` says which bounded windows it needs, then which averages, then
which averages of those. `apply_indicators` runs any number of them level by
level: one window pass, one pass for all first averages, one for all second
ones, one for running sums. A series shorter than an indicator needs gets NULL
throughout.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tickloom.functions.columns import div, quoted, require, rolling_mean, rolling_std, rolling_sum
from tickloom.plans.series import KEYS, N_ROWS, RN, Ewm, ewm, first_rows, index_series, over_chunks, running


@dataclass(frozen=True)
class Indicator:
    """Steps of one indicator; helper columns carry the `tag` given to its builder."""

    results: Mapping[str, Column]
    windows: Callable[[DataFrame, WindowSpec], DataFrame] | None = None
    back: int = 0
    averages: Mapping[str, Ewm] = field(default_factory=dict)
    between: Mapping[str, Column] = field(default_factory=dict)
    seeds: Mapping[str, Column] = field(default_factory=dict)
    second: Mapping[str, Ewm] = field(default_factory=dict)
    totals: Mapping[str, tuple[str, str]] = field(default_factory=dict)


def apply_indicators(df: DataFrame, indicators: Sequence[Indicator], keys: Sequence[str] = KEYS) -> DataFrame:
    """Add the results of all indicators with one pass per level."""
    out = df if RN in df.columns and N_ROWS in df.columns else index_series(df, keys)
    kept = out.columns
    windows = [i for i in indicators if i.windows]
    if windows:

        def build(d: DataFrame, w: WindowSpec) -> DataFrame:
            for i in windows:
                d = i.windows(d, w)
            return d

        out = over_chunks(out, build, back=max(i.back for i in windows), keys=keys)

    def merged(part: str) -> dict:
        return {n: c for i in indicators for n, c in getattr(i, part).items()}

    if totals := merged("totals"):
        out = running(out, totals, keys)
    if averages := merged("averages"):
        out = ewm(out, averages, keys)
    for i in indicators:
        for name, c in i.between.items():
            out = out.withColumn(name, c)
    if seeds := merged("seeds"):
        out = first_rows(out, seeds, keys)
    if second := merged("second"):
        out = ewm(out, second, keys)
    results = merged("results")
    return out.withColumns(results).select(*[F.col(quoted(c)) for c in kept if c not in results], *[F.col(quoted(c)) for c in results])


def _long_enough(value: Column, rows: int) -> Column:
    return F.when(F.col(N_ROWS) >= rows, value)


def sma_plan(tag: str, out: str, length: int = 50, column: str = "close") -> Indicator:
    mean = f"{tag}mean"
    return Indicator({out: F.col(mean)}, lambda d, w: d.withColumn(mean, rolling_mean(column, w, length)), length - 1)


def bollinger_plan(tag: str, prefix: str = "", length: int = 20, std: float = 2.0) -> Indicator:
    mid, dev = f"{tag}mid", f"{tag}dev"

    def windows(d: DataFrame, w: WindowSpec) -> DataFrame:
        return d.withColumns({mid: rolling_mean("close", w, length), dev: rolling_std("close", w, length)})

    m, s = F.col(mid), F.col(dev)
    names = [f"{prefix}{b}_{length}_{std}" for b in ("BBL", "BBM", "BBU")]
    return Indicator(dict(zip(names, (m - s * std, m, m + s * std))), windows, length - 1)


def ema_plan(tag: str, out: str, length: int = 50, column: str = "close") -> Indicator:
    return Indicator({out: F.col(f"{tag}ema")}, averages={f"{tag}ema": Ewm.span(column, length)})


def true_range(w: WindowSpec) -> Column:
    before = F.lag("close").over(w)
    spread = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    return F.when(before.isNotNull(), spread)


def atr_plan(tag: str, out: str, length: int = 14, ratio: bool = True) -> Indicator:
    tr, mean = f"{tag}tr", f"{tag}atr"
    value = _long_enough(F.col(mean), length)
    results = {out: value}
    if ratio:
        results[f"ATRr_{length}"] = F.coalesce(div(value, "close"), F.lit(0.0))
    return Indicator(results, lambda d, w: d.withColumn(tr, true_range(w)), 1, {mean: Ewm.wilder(tr, length, seed=1)})


def rsi_plan(tag: str, out: str, length: int = 14) -> Indicator:
    gain, loss, g, l = (f"{tag}{n}" for n in ("gain", "loss", "g", "l"))  # noqa: E741

    def windows(d: DataFrame, w: WindowSpec) -> DataFrame:
        change = F.coalesce(F.col("close") - F.lag("close").over(w), F.lit(0.0))
        return d.withColumns({gain: F.greatest(change, F.lit(0.0)), loss: F.greatest(-change, F.lit(0.0))})

    strength = F.lit(100.0) - F.try_divide(F.lit(100.0), F.lit(1.0) + F.try_divide(F.col(g), F.col(l)))
    value = _long_enough(F.when(F.col(RN) >= length, strength), length + 1)
    return Indicator({out: value}, windows, 1, {g: Ewm.wilder(gain, length), l: Ewm.wilder(loss, length)})


def macd_plan(tag: str, prefix: str = "", fast: int = 12, slow: int = 26, signal: int = 9) -> Indicator:
    f, s, line, sig = (f"{tag}{n}" for n in ("fast", "slow", "line", "sig"))
    need = max(fast, slow) + signal - 1
    values = {
        f"{prefix}MACD_{fast}_{slow}": F.col(line),
        f"{prefix}MACDs_{signal}": F.col(sig),
        f"{prefix}MACDh_{fast}_{slow}_{signal}": F.col(line) - F.col(sig),
    }
    return Indicator(
        {n: _long_enough(c, need) for n, c in values.items()},
        averages={f: Ewm.span("close", fast), s: Ewm.span("close", slow)},
        between={line: F.col(f) - F.col(s)},
        second={sig: Ewm.span(line, signal, seed=max(fast, slow) - 1)},
    )


def adx_plan(tag: str, prefix: str = "", length: int = 14) -> Indicator:
    """The directional index is undefined until the first directional move and
    defined from then on, so its average starts at its first value."""
    tr, up, down, a, p, n, plus, minus, dx, seed, mean = (
        f"{tag}{c}" for c in ("tr", "pdm", "ndm", "atr", "p", "n", "plus", "minus", "dx", "seed", "adx")
    )

    def windows(d: DataFrame, w: WindowSpec) -> DataFrame:
        rise = F.col("high") - F.lag("high").over(w)
        fall = F.lag("low").over(w) - F.col("low")
        return d.withColumns(
            {
                tr: true_range(w),
                up: F.when((rise > fall) & (rise > 0), rise).otherwise(0.0),
                down: F.when((fall > rise) & (fall > 0), fall).otherwise(0.0),
            }
        )

    spread, total = F.abs(F.col(plus) - F.col(minus)), F.abs(F.col(plus) + F.col(minus))
    values = {
        f"{prefix}ADX_{length}": F.when(F.col(RN) >= 2 * length - 2, F.col(mean)),
        f"{prefix}DMP_{length}": F.col(plus),
        f"{prefix}DMN_{length}": F.col(minus),
    }
    return Indicator(
        {c: _long_enough(v, 2 * length) for c, v in values.items()},
        windows,
        1,
        {a: Ewm.wilder(tr, length, seed=1), p: Ewm.wilder(up, length), n: Ewm.wilder(down, length)},
        {
            plus: 100.0 * div(p, a),
            minus: 100.0 * div(n, a),
            dx: F.when(F.col(RN) >= length - 1, F.lit(100.0) * F.try_divide(spread, total)),
        },
        {seed: F.col(dx).isNotNull()},
        {mean: Ewm(dx, 1.0 / length, length, seed)},
    )


def obv_plan(tag: str, out: str = "obv") -> Indicator:
    flow = f"{tag}flow"

    def windows(d: DataFrame, w: WindowSpec) -> DataFrame:
        signed = F.col("volume") * F.signum(F.col("close") - F.lag("close").over(w))
        return d.withColumn(flow, F.coalesce(signed, F.lit(0.0)))

    return Indicator({out: F.col(f"{tag}sum")}, windows, 1, totals={f"{tag}sum": ("sum", flow)})


def mfi_plan(tag: str, out: str, length: int = 14) -> Indicator:
    tp, move, pos, neg, ratio = (f"{tag}{c}" for c in ("tp", "move", "pos", "neg", "ratio"))

    def windows(d: DataFrame, w: WindowSpec) -> DataFrame:
        d = d.withColumn(tp, (F.col("high") + F.col("low") + F.col("close")) / 3)
        d = d.withColumn(move, F.col(tp) - F.lag(tp).over(w))
        flow = F.col(tp) * F.col("volume")
        d = d.withColumns({pos: F.when(F.col(move) > 0, flow).otherwise(0.0), neg: F.when(F.col(move) < 0, flow).otherwise(0.0)})
        return d.withColumn(ratio, F.try_divide(rolling_sum(pos, w, length), rolling_sum(neg, w, length)))

    value = F.lit(100.0) - F.try_divide(F.lit(100.0), F.lit(1.0) + F.col(ratio))
    return Indicator({out: _long_enough(value, length + 1)}, windows, length)


def sma(df: DataFrame, length: int = 50, column: str = "close", name: str | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Simple moving average over full windows."""
    return apply_indicators(df, [sma_plan("__i_", name or f"sma_length{length}", length, column)], keys)


def bollinger(df: DataFrame, length: int = 20, std: float = 2.0, prefix: str = "", keys: Sequence[str] = KEYS) -> DataFrame:
    """Moving average and bands `std` sample deviations around it."""
    return apply_indicators(df, [bollinger_plan("__i_", prefix, length, std)], keys)


def ema(df: DataFrame, length: int = 50, column: str = "close", name: str | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Exponential moving average with span `length`."""
    return apply_indicators(df, [ema_plan("__i_", name or f"ema_length{length}", length, column)], keys)


def atr(df: DataFrame, length: int = 14, name: str | None = None, ratio: bool = False, keys: Sequence[str] = KEYS) -> DataFrame:
    """Average true range; with `ratio` also ATRr_{length}, the range relative to the close."""
    return apply_indicators(df, [atr_plan("__i_", name or f"atr_length{length}", length, ratio)], keys)


def rsi(df: DataFrame, length: int = 14, name: str | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Relative strength index; NULL while there has been no loss."""
    return apply_indicators(df, [rsi_plan("__i_", name or f"rsi_length{length}", length)], keys)


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, prefix: str = "", keys: Sequence[str] = KEYS) -> DataFrame:
    """Difference of two EMAs, its own EMA and the gap between them."""
    return apply_indicators(df, [macd_plan("__i_", prefix, fast, slow, signal)], keys)


def adx(df: DataFrame, length: int = 14, prefix: str = "", keys: Sequence[str] = KEYS) -> DataFrame:
    """Average directional index with its two directional lines."""
    return apply_indicators(df, [adx_plan("__i_", prefix, length)], keys)


def obv(df: DataFrame, name: str = "obv", keys: Sequence[str] = KEYS) -> DataFrame:
    """Running sum of volume signed by the direction of the close."""
    return apply_indicators(df, [obv_plan("__i_", name)], keys)


def mfi(df: DataFrame, length: int = 14, name: str | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Money flow index; NULL when the window has no negative flow."""
    return apply_indicators(df, [mfi_plan("__i_", name or f"mfi_length{length}", length)], keys)


def _single(plan: Callable) -> Callable:
    def make(tag: str, label: str, params: Mapping) -> Indicator:
        suffix = "_".join(f"{k}{v}" for k, v in params.items())
        return plan(tag, f"{label}_{suffix}" if params else label, **params)

    return make


def _multi(plan: Callable) -> Callable:
    return lambda tag, label, params: plan(tag, f"{label}_", **params)


REGISTRY = {
    "sma": _single(sma_plan),
    "ema": _single(ema_plan),
    "rsi": _single(rsi_plan),
    "atr": _single(atr_plan),
    "obv": _single(obv_plan),
    "mfi": _single(mfi_plan),
    "macd": _multi(macd_plan),
    "adx": _multi(adx_plan),
    "bbands": _multi(bollinger_plan),
    "bollinger_bands": _multi(bollinger_plan),
}


def add_indicators(df: DataFrame, configs: Iterable[Mapping], keys: Sequence[str] = KEYS) -> DataFrame:
    """Add indicators from a list such as ``[{"indicator": "sma", "length": 50}]``.

    Single columns are named ``{indicator}_{param}{value}_…``, the others
    ``{indicator}_{component}``. Unknown indicators raise.
    """
    require(df, "open", "high", "low", "close", "volume")
    plans = []
    for n, config in enumerate(configs):
        label = config["indicator"]
        make = REGISTRY.get(label.lower())
        if make is None:
            raise ValueError(f"unknown indicator {label!r}; known: {sorted(REGISTRY)}")
        plans.append(make(f"__{n}_", label, {k: v for k, v in config.items() if k != "indicator"}))
    return apply_indicators(df, plans, keys) if plans else df
