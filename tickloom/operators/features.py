"""Feature sets over indexed bars.

A feature set is a function ``(df, w) -> df`` plus how many rows it looks back
and ahead. Sets asked for together share one chunked window pass, so a feature
table costs one shuffle however many bounded features it has.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tickloom.functions.columns import (
    clean_names,
    correlation,
    div,
    full,
    log,
    numeric_columns,
    pct_change,
    quoted,
    rolling_mean,
    rolling_std,
    rolling_sum,
)
from tickloom.operators.clean import fill_nulls
from tickloom.operators.indicators import add_indicators
from tickloom.operators.statistics import garch_volatility, rolling_adf
from tickloom.plans.series import KEYS, N_ROWS, RN, TS, index_series, over_chunks
from tickloom.plans.storage import once


@dataclass(frozen=True)
class FeatureSet:
    build: Callable[[DataFrame, WindowSpec], DataFrame]
    back: int = 0
    ahead: int = 0


def add_features(df: DataFrame, sets: Sequence[FeatureSet], keys: Sequence[str] = KEYS) -> DataFrame:
    """Run feature sets in one pass over an indexed (or not yet indexed) bar table."""
    indexed = df if RN in df.columns else index_series(df, keys)

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        for s in sets:
            d = s.build(d, w)
        return d

    out = over_chunks(indexed, build, max(s.back for s in sets), max(s.ahead for s in sets), keys)
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def _flag(condition: Column) -> Column:
    return F.coalesce(condition.cast("int"), F.lit(0))


def _with_return(d: DataFrame, w: WindowSpec) -> DataFrame:
    return d if "__ret" in d.columns else d.withColumn("__ret", pct_change("close", w))


def base_features() -> FeatureSet:
    """Simple and log return, previous close, weekday (Monday 0)."""

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        before = F.lag("close").over(w)
        return d.withColumns(
            {
                "return": pct_change("close", w),
                "log_return": log(div("close", before)),
                "close_lag1": before,
                "day_of_week": F.weekday(TS),
            }
        )

    return FeatureSet(build, back=1)


def volatility_features() -> FeatureSet:
    """Rolling deviation of returns, its ratio and deviation, and the high-low estimate."""

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        d = _with_return(d, w)
        d = d.withColumns({f"volatility_{n}": rolling_std("__ret", w, n) for n in (5, 10, 20, 50)})
        d = d.withColumn("__hl", F.pow(log(div("high", "low")), F.lit(2.0)))
        return d.withColumns(
            {
                "volatility_ratio_20_50": div("volatility_20", "volatility_50"),
                "vol_of_vol_20": rolling_std("volatility_20", w, 20),
                "parkinson_vol_20": F.sqrt(rolling_mean("__hl", w, 20) / (4.0 * math.log(2.0))),
            }
        )

    return FeatureSet(build, back=50)


def efficiency_ratio(length: int, name: str | None = None) -> FeatureSet:
    """Net move over `length` bars divided by the sum of the single moves."""

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        d = d.withColumn("__step", F.abs(F.col("close") - F.lag("close").over(w)))
        net = F.abs(F.col("close") - F.lag("close", length).over(w))
        return d.withColumn(name or f"efficiency_ratio_{length}", F.try_divide(net, rolling_sum("__step", w, length)))

    return FeatureSet(build, back=length)


def trend_flags() -> FeatureSet:
    """Close above its 50 and 200 bar means, 20 bar mean above the 50 bar mean."""

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        mean = {n: rolling_mean("close", w, n) for n in (20, 50, 200)}
        return d.withColumns(
            {
                "close_gt_sma50": _flag(F.col("close") > mean[50]),
                "close_gt_sma200": _flag(F.col("close") > mean[200]),
                "sma20_gt_sma50": _flag(mean[20] > mean[50]),
            }
        )

    return FeatureSet(build, back=199)


def volatility_regime() -> FeatureSet:
    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        d = _with_return(d, w)
        return d.withColumn("volatility_regime", div(rolling_std("__ret", w, 20), rolling_std("__ret", w, 100)))

    return FeatureSet(build, back=100)


def volume_features() -> FeatureSet:
    """Volume against its 20 bar mean; 20 bar correlation of price and volume changes."""

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        d = _with_return(d, w).withColumn("__vol", pct_change("volume", w))
        both = F.when(F.col("__ret").isNotNull() & F.col("__vol").isNotNull(), F.lit(1))
        return d.withColumns(
            {
                "volume_ratio": div("volume", rolling_mean("volume", w, 20)),
                "price_volume_corr": correlation("__ret", "__vol", lambda c: full(c, both, w, 20)),
            }
        )

    return FeatureSet(build, back=20)


def market_regime_features() -> tuple[FeatureSet, ...]:
    return efficiency_ratio(10), efficiency_ratio(20), trend_flags(), volatility_regime(), volume_features()


def fractals(window: int = 5, suffix: str | None = None) -> FeatureSet:
    """Lows (highs) strictly beyond their `window // 2` neighbours on both sides."""
    half = window // 2
    tag = f"_{window}" if suffix is None else suffix

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        inner = (F.col(RN) >= half) & (F.col(RN) < F.col(N_ROWS) - half)
        before, after = w.rowsBetween(-half, -1), w.rowsBetween(1, half)
        low, high = F.col("low"), F.col("high")
        bullish = inner & (low < F.min(low).over(before)) & (low < F.min(low).over(after))
        bearish = inner & (high > F.max(high).over(before)) & (high > F.max(high).over(after))
        return d.withColumns({f"bullish_fractal{tag}": _flag(bullish), f"bearish_fractal{tag}": _flag(bearish)})

    return FeatureSet(build, back=half, ahead=half)


def support_resistance(window: int = 50) -> FeatureSet:
    """Fractals and the distance to the recent high and low."""
    marks = fractals(5, suffix="")

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        d = marks.build(d, w)
        top = full(F.max("high"), F.col("high"), w, window)
        bottom = full(F.min("low"), F.col("low"), w, window)
        d = d.withColumns(
            {"dist_from_recent_high": div(F.col("close") - top, top), "dist_from_recent_low": div(F.col("close") - bottom, bottom)}
        )
        return d.withColumns(
            {
                "near_resistance": _flag(F.abs("dist_from_recent_high") < 0.01),
                "near_support": _flag(F.abs("dist_from_recent_low") < 0.01),
            }
        )

    return FeatureSet(build, back=max(window - 1, marks.back), ahead=marks.ahead)


def candle_features() -> FeatureSet:
    """Body and shadows relative to the open."""

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        o, c = F.col("open"), F.col("close")
        return d.withColumns(
            {
                "body_size": div(F.abs(c - o), o),
                "upper_shadow": div(F.col("high") - F.greatest(o, c), o),
                "lower_shadow": div(F.least(o, c) - F.col("low"), o),
            }
        )

    return FeatureSet(build)


def momentum_features() -> FeatureSet:
    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        return d.withColumns({f"roc_{n}": pct_change("close", w, n) for n in (5, 10, 20)})

    return FeatureSet(build, back=20)


def vwap_features() -> FeatureSet:
    """Rolling volume-weighted price and the close's distance from it."""

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        typical = (F.col("high") + F.col("low") + F.col("close")) / 3
        d = d.withColumn("__tpv", typical * F.col("volume"))
        for n in (20, 50):
            vwap = F.try_divide(rolling_sum("__tpv", w, n), rolling_sum("volume", w, n))
            d = d.withColumn(f"vwap_roll_{n}", vwap)
            d = d.withColumn(f"dist_from_vwap_roll_{n}", div(F.col("close") - F.col(f"vwap_roll_{n}"), f"vwap_roll_{n}"))
        return d

    return FeatureSet(build, back=49)


def differenced(columns: Sequence[str], period: int = 1) -> FeatureSet:
    """Overwrite columns by their change over `period` bars."""

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        return d.withColumns({c: F.col(quoted(c)) - F.lag(F.col(quoted(c)), period).over(w) for c in columns})

    return FeatureSet(build, back=period)


GRAM_COLUMNS = 128
_GRAM = "i int, j int, sums binary"


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every column pair over the rows where both are present: a, b, corr.

    Columns go in blocks of `GRAM_COLUMNS`. Each task multiplies its rows' blocks with each other, which gives
    counts, sums and products of all their pairs; one shuffle by pair of blocks adds up the tasks' matrices. Any number of
    columns makes the same short plan. Pairs without two different values on either side have NULL.
    """
    names = list(columns)
    if len(names) < 2:
        return df.sparkSession.createDataFrame([], "a string, b string, corr double")
    rows = once(df.select(*[F.col(quoted(c)).cast("double").alias(f"c{i}") for i, c in enumerate(names)]))
    # Sums of centred values lose no digits to a common offset.
    means = np.array([0.0 if m is None or m != m or abs(m) == np.inf else m for m in rows.agg(*[F.avg(f"c{i}") for i in range(len(names))]).first()])
    blocks = [slice(k, min(k + GRAM_COLUMNS, len(names))) for k in range(0, len(names), GRAM_COLUMNS)]
    pairs = [(i, j) for i in range(len(blocks)) for j in range(i, len(blocks))]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            here = np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns], axis=1).astype(float)
            x = np.stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            x = np.where(here > 0, x - means, 0.0)
            for i, j in pairs:
                m, n, u, v = here[:, blocks[i]], here[:, blocks[j]], x[:, blocks[i]], x[:, blocks[j]]
                sums = np.stack([m.T @ n, u.T @ n, m.T @ v, (u * u).T @ n, m.T @ (v * v), u.T @ v])
                total[i, j] = total.get((i, j), 0.0) + sums
        for (i, j), sums in total.items():
            yield pa.RecordBatch.from_pydict({"i": pa.array([i], pa.int32()), "j": pa.array([j], pa.int32()), "sums": pa.array([sums.tobytes()], pa.binary())})

    def finish(table: pa.Table) -> pa.Table:
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        left, right = names[blocks[i]], names[blocks[j]]
        n, sa, sb, qa, qb, p = sum(np.frombuffer(s, float) for s in table["sums"].to_pylist()).reshape(6, len(left), len(right))
        va, vb = n * qa - sa * sa, n * qb - sb * sb
        # Rounding leaves constants a spread of about 1e-16 of their squares.
        flat = (va <= 1e-13 * n * qa) | (vb <= 1e-13 * n * qb)
        with np.errstate(all="ignore"):
            corr = np.clip((n * p - sa * sb) / (np.sqrt(va) * np.sqrt(vb)), -1, 1)
        at, to = (x.ravel() for x in np.indices(corr.shape))
        keep = np.ones(len(at), bool) if i != j else at < to
        at, to, value, none = at[keep], to[keep], corr.ravel()[keep], flat.ravel()[keep]
        return pa.table({"a": pa.array([left[k] for k in at], pa.string()), "b": pa.array([right[k] for k in to], pa.string()), "corr": pa.array(value, pa.float64(), mask=none)})

    return rows.mapInArrow(multiply, _GRAM).groupBy("i", "j").applyInArrow(finish, "a string, b string, corr double")


def uncorrelated_columns(df: DataFrame, columns: Sequence[str], threshold: float = 0.9) -> list[str]:
    """Columns kept when, of each pair above `threshold`, the later name goes.

    Only the column-pair table, whose size is fixed by the schema, is fetched.
    """
    high = {(r["a"], r["b"]) for r in correlation_matrix(df, columns).filter(F.abs("corr") > threshold).collect()}
    dropped: set[str] = set()
    for i, later in enumerate(columns):
        for earlier in columns[:i]:
            if later in dropped:
                break
            if (earlier, later) in high and earlier not in dropped:
                dropped.add(max(earlier, later))
    return [c for c in columns if c not in dropped]


_NOT_FEATURES = ("open", "high", "low", "close", "volume", "return", "log_return", RN, N_ROWS)


def filter_correlated(df: DataFrame, threshold: float = 0.9, keys: Sequence[str] = KEYS) -> DataFrame:
    """Drop features that duplicate another; prices, returns and text stay."""
    candidates = numeric_columns(df, {*_NOT_FEATURES, *keys, TS})
    kept = set(uncorrelated_columns(df, candidates, threshold))
    return df.drop(*[c for c in candidates if c not in kept])


def hurst(df: DataFrame, column: str = "close", min_window: int = 10, keys: Sequence[str] = KEYS) -> DataFrame:
    """Hurst exponent per key: slope of log rescaled range over log window size.

    Windows of 10^1, 10^1.25, 10^1.5, … rows (and the whole series) are cut
    side by side; each gives (max/min - 1) over the deviation of its returns.
    Every step is a merged aggregate, so long series need no single task.
    Series under 100 rows get 0.5.
    """
    ready = once(df if RN in df.columns else index_series(df, keys))
    start = math.log10(min_window)
    steps = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.log10(F.col(N_ROWS) - 1) - start) * 4).cast("int")))
    sizes = F.transform(steps, lambda i: F.floor(F.pow(F.lit(10.0), F.lit(start) + i * 0.25)))
    below = F.filter(sizes, lambda s: s < F.col(N_ROWS) - 1)
    stepped = over_chunks(ready, lambda d, w: d.withColumn("__ret", pct_change(column, w)), back=1, keys=keys)
    rows = stepped.select(*keys, RN, N_ROWS, column, "__ret", F.explode(F.array_append(below, F.col(N_ROWS))).alias("size"))
    block = F.floor(F.col(RN) / F.col("size"))
    x = F.col(column)
    blocks = (
        rows.groupBy(*keys, N_ROWS, "size", block.alias("block"))
        .agg(
            F.count(x).alias("rows"),
            (F.try_divide(F.max(x), F.min(x)) - 1).alias("range"),
            F.stddev_samp(F.when(F.col(RN) % F.col("size") != 0, F.col("__ret"))).alias("dev"),
        )
        .filter((F.col("rows") == F.col("size")) & (F.col("range") != 0) & (F.col("dev") != 0))
    )
    by_size = blocks.groupBy(*keys, N_ROWS, "size").agg(F.avg(F.col("range") / F.col("dev")).alias("rs"))
    fit = by_size.groupBy(*keys, N_ROWS).agg(F.regr_slope(F.log10("rs"), F.log10(F.col("size").cast("double"))).alias("h"))
    short = F.col(N_ROWS) < max(100, min_window)
    return ready.select(*keys, N_ROWS).distinct().join(fit, [*keys, N_ROWS], "left").select(
        *keys, F.when(short, 0.5).otherwise(F.coalesce("h", F.lit(0.5))).alias("hurst")
    )


def feature_nulls(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Carry every column forward, then 0 for what is still missing."""
    columns = [c for c in df.columns if c not in {*keys, TS, RN, N_ROWS}]
    return fill_nulls(fill_nulls(df, "ffill", columns, keys), "zero", columns)


@dataclass(frozen=True)
class LabelSpec:
    method: str | None = "triple_barrier"
    atr_multiplier_tp: float = 2.0
    atr_multiplier_sl: float = 1.0
    max_holding_period: int = 10
    min_return_threshold: float = 0.001
    atr_period: int | None = None
    atr_column: str | None = None


@dataclass(frozen=True)
class FeatureSpec:
    """What `build_features` computes; the defaults add base features only."""

    indicators: Sequence[Mapping] = ()
    volatility: bool = False
    regime: bool = False
    stationarity: bool = False
    garch: bool = False
    momentum: bool = False
    fractal_window: int | None = None
    difference: Sequence[str] = ()
    difference_period: int = 1
    correlation_threshold: float | None = None
    label: LabelSpec = field(default_factory=LabelSpec)

    def without_label(self) -> FeatureSpec:
        return replace(self, label=replace(self.label, method=None))


def build_features(df: DataFrame, spec: FeatureSpec, keys: Sequence[str] = KEYS) -> DataFrame:
    """Bars to a feature table with a label column.

    Base features and the chosen sets share one window pass; then indicators,
    differencing, the correlation filter, null filling, the label and clean
    column names.
    """
    from tickloom.operators.labels import add_label

    sets = [base_features()]
    if spec.volatility:
        sets.append(volatility_features())
    if spec.regime:
        sets.extend(market_regime_features())
    if spec.momentum:
        sets.append(momentum_features())
    if spec.fractal_window:
        sets.append(fractals(spec.fractal_window))
    out = add_features(df, sets, keys)
    if spec.stationarity:
        out = rolling_adf(out, keys=keys)
    if spec.garch:
        out = garch_volatility(out, keys=keys)
    out = add_indicators(out, spec.indicators, keys)
    if spec.difference:
        out = add_features(out, [differenced(spec.difference, spec.difference_period)], keys)
    if spec.correlation_threshold is not None:
        out = filter_correlated(once(out), spec.correlation_threshold, keys)
    out = feature_nulls(out, keys)
    out = add_label(out, spec.label, spec.indicators, keys)
    return clean_names(out.drop(RN, N_ROWS))
