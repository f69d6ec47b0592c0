"""A whole strategy over all assets in one job."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.columns import quoted
from tickloom.operators import signals as sg
from tickloom.operators.features import FeatureSpec, build_features
from tickloom.operators.indicators import atr
from tickloom.operators.ledger import LedgerSpec, Portfolio, backtest, buy_and_hold
from tickloom.operators.models import TrainSpec, fit_model
from tickloom.operators.regimes import FEATURES, assign_regimes, fit_regimes
from tickloom.operators.selection import chronological_split
from tickloom.operators.walkforward import Folds, fold_backtests, fold_summary, fold_testing, fold_training, strategy_summary
from tickloom.plans.series import KEYS, N_ROWS, RN, TS, index_series
from tickloom.plans.storage import cut

PRICES = ("open", "high", "low", "close", "volume")
#: Models of folds that are fitted side by side.
FITS_AT_ONCE = 4


@dataclass(frozen=True)
class StrategySpec:
    """kind is dma_crossover, rsi_mean_reversion or ml; `folds` turns walk-forward on.

    `regime_actions` says what a regime does to signals (no_trade, long_only, short_only) and to the
    size of trades (reduce_risk). Bars without a `regime` column get theirs from `n_regimes` clusters of the
    `regime_features`; where a bar has none, nothing changes.
    A model is fitted over all keys, or with `per_asset` one for each key that is
    long enough. `max_open` lets a portfolio of all keys hold only so many trades
    at once, `max_correlated` of them from one `group`, a column of the bars, or
    with partners in `pairs` (symbol, other). Everything in the result then comes from the trades that got in.
    """

    kind: str = "dma_crossover"
    short: int = 20
    long: int = 50
    rsi_length: int = 14
    rsi_lower: float = 30.0
    rsi_upper: float = 70.0
    atr_length: int = 14
    features: FeatureSpec = field(default_factory=FeatureSpec)
    training: TrainSpec = field(default_factory=TrainSpec)
    threshold: float = 0.5
    trend_length: int | None = None
    cooling: int = 3
    regime_actions: Mapping[int, str] | None = None
    regime_features: Sequence[str] = FEATURES
    n_regimes: int = 3
    regime_lookback: int = 60
    ledger: LedgerSpec = field(default_factory=LedgerSpec)
    folds: Folds | None = None
    per_asset: bool = False
    max_open: int | None = None
    max_correlated: int | None = None
    group: str | None = None
    pairs: DataFrame | None = None


@dataclass(frozen=True)
class StrategyResult:
    signals: DataFrame
    trades: DataFrame
    equity: DataFrame
    results: DataFrame
    assets: DataFrame
    overall: DataFrame


LABELS = {"triple_barrier": "triple_barrier_label", "directional": "directional_label"}


def _rule_signals(bars: DataFrame, spec: StrategySpec, keys: Sequence[str]) -> DataFrame:
    if spec.kind == "dma_crossover":
        return sg.crossover_signals(bars, spec.short, spec.long, keys)
    return sg.rsi_signals(bars, spec.rsi_length, spec.rsi_lower, spec.rsi_upper, keys)


def with_regimes(bars: DataFrame, spec: StrategySpec, keys: Sequence[str] = KEYS) -> DataFrame:
    """Add the cluster of each bar's features, NULL where features are missing or the key is short."""
    names = list(spec.regime_features)
    missing = [c for c in names if c not in bars.columns]
    wanted = FeatureSpec(volatility=True, regime=True, momentum=True, stationarity="adf_pvalue" in names).without_label()
    shape = cut(build_features(bars.select(*keys, TS, *PRICES), wanted, keys).select(*keys, TS, *names)) if missing else bars
    model = fit_regimes(shape, names, spec.n_regimes, spec.regime_lookback, keys)
    found = assign_regimes(shape, model, names, spec.regime_lookback, keys).select(*keys, TS, "regime")
    return bars.join(found, [*keys, TS], "left")


def _scores(table: DataFrame, spec: StrategySpec, label: str, names: Sequence[str], keys: Sequence[str]) -> DataFrame | None:
    """Probabilities of late rows of each key, or of the test rows of every fold; folds count within each key."""
    if spec.folds is None:
        early, late = chronological_split(table, spec.training.test_size, keys)
        parts = [(early, late)]
    else:
        most = table.agg(F.max(spec.folds.count())).collect()[0][0] or 0
        parts = []
        for fold in range(1, most + 1):
            model_fold = fold - (fold - 1) % spec.folds.retrain_every
            parts.append((model_fold, fold))
    if spec.folds is None:
        fits = {1: parts[0][0]}
        scoring = [(1, parts[0][1])]
    else:
        fits = {a: fold_training(table, spec.folds, a) for a, _ in parts}
        scoring = [(a, fold_testing(table, spec.folds, b)) for a, b in parts]

    def fitted_scores(a: int) -> list[DataFrame]:
        model = fit_model(fits[a], label, names, spec.training)
        columns = [quoted(f"probability_{c}") for c in model.classes]
        return [cut(model.score(rows).select(*keys, TS, *PRICES, *columns)) for b, rows in scoring if b == a]

    # Folds wait for nothing from each other.
    with ThreadPool(FITS_AT_ONCE) as pool:
        fresh = [part for own in pool.map(fitted_scores, fits, chunksize=1) for part in own]
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), fresh) if fresh else None


def _model_signals(bars: DataFrame, spec: StrategySpec, keys: Sequence[str]) -> DataFrame:
    """Out-of-sample signals of one model over all keys, or of one per key, before regimes and cooling."""
    label = LABELS[spec.features.label.method]
    table = cut(index_series(build_features(bars, spec.features, keys), keys))
    names = [c for c in table.columns if c not in {*keys, TS, RN, N_ROWS, label, *PRICES}]
    if not spec.per_asset:
        scored = _scores(table, spec, label, names, keys)
    else:
        scored = None
        # One row per asset; each gets its own fits.
        for asset in table.filter(F.col(label).isNotNull()).select(*keys).distinct().sort(*keys).collect():
            own = table
            for k in keys:
                own = own.filter(F.col(k) == F.lit(asset[k]))
            part = _scores(own, spec, label, names, keys)
            if part is not None:
                scored = part if scored is None else scored.unionByName(part, allowMissingColumns=True)
    if scored is None:
        raise ValueError("no key is long enough for a single fold")
    # Overlapping test slices score a row more than once: the mean counts.
    columns = [c for c in scored.columns if c.startswith("probability_")]
    once_each = scored.groupBy(*keys, TS).agg(*[F.first(c).alias(c) for c in PRICES], *[F.avg(F.coalesce(F.col(quoted(c)), F.lit(0.0))).alias(c) for c in columns])
    classes = sorted((c[len("probability_") :] for c in columns), key=lambda c: float(c))
    return sg.generate_signals(index_series(once_each, keys), classes, spec.threshold, spec.trend_length, cooling=0, keys=keys)


def run_strategy(bars: DataFrame, spec: StrategySpec = StrategySpec(), keys: Sequence[str] = KEYS) -> StrategyResult:
    """Signals, trades, equity and summaries for every key of the bar table."""
    if spec.kind not in ("dma_crossover", "rsi_mean_reversion", "ml"):
        raise ValueError(f"unknown strategy {spec.kind!r}")
    if spec.regime_actions and "regime" not in bars.columns:
        bars = cut(with_regimes(bars, spec, keys))
    tags = [c for c in ("regime" if spec.regime_actions else None, spec.group) if c is not None]
    if spec.kind == "ml":
        ready = _model_signals(bars.drop(*tags), spec, keys)
        if tags:
            ready = ready.join(bars.select(*keys, TS, *tags), [*keys, TS], "left")
    else:
        ready = _rule_signals(index_series(bars, keys), spec, keys)
    if spec.regime_actions:
        ready = sg.regime_filter(ready, spec.regime_actions)
    if spec.kind == "ml":
        ready = sg.cooling_period(ready, spec.cooling, keys=keys)
    if spec.ledger.range_column == "atr":
        ready = atr(ready, spec.atr_length, "atr", keys=keys)
    ready = cut(ready)
    portfolio = None
    if spec.max_open is not None:
        limit = spec.max_correlated if spec.max_correlated is not None else spec.max_open
        portfolio = Portfolio(spec.max_open, limit, spec.group, spec.pairs)
    if spec.folds is not None and spec.kind != "ml":
        done = fold_backtests(ready, spec.folds, spec.ledger, "signal", keys, portfolio, spec.regime_actions)
        assets = fold_summary(done.summary, buy_and_hold(bars, keys, spec.ledger.initial_capital).drop("benchmark_final"), keys)
    else:
        done = backtest(ready, spec.ledger, "signal", spec.regime_actions, keys, portfolio)
        assets = done.summary
    results = cut(done.summary)
    return StrategyResult(ready, done.trades, done.equity, results, assets, strategy_summary(assets))
