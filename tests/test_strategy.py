import threading
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import strategy
from tickloom.operators.features import FeatureSpec, LabelSpec
from tickloom.operators.ledger import LedgerSpec
from tickloom.operators.models import TrainSpec, fit_model
from tickloom.operators.strategy import StrategySpec, run_strategy
from tickloom.operators.walkforward import Folds
from tickloom.plans.series import KEYS, index_series

ROOMY = LedgerSpec(stop_multiple=1.0, target_multiple=1.0, trailing=None)


@pytest.fixture(scope="module")
def opposite(spark):
    """Two assets whose next move follows from the weekday in opposite ways."""
    rng = np.random.default_rng(3)
    days = pd.date_range("2019-01-01", periods=420)
    parts = []
    for symbol, sign in (("UP", 1), ("DOWN", -1)):
        step = np.where(np.roll(days.dayofweek < 3, 1), 0.01, -0.01) * sign + rng.normal(0, 0.001, 420)
        close = 100 * np.exp(np.cumsum(step))
        opened = np.roll(close, 1)
        opened[0] = 100
        parts.append(pd.DataFrame({"symbol": symbol, "ts": days, "open": opened, "high": np.maximum(opened, close) * 1.001, "low": np.minimum(opened, close) * 0.999, "close": close, "volume": 1000.0, "sector": "x"}))
    return spark.createDataFrame(pd.concat(parts))


def test_models_per_asset(opposite, monkeypatch):
    features = FeatureSpec(label=LabelSpec(method="directional", max_holding_period=1))
    training = TrainSpec("random_forest", {"n_estimators": 10, "max_depth": 5, "max_features": None}, test_size=0.3)
    fits = []

    def counted(df, *args):
        fits.append(sorted(r.symbol for r in df.select("symbol").distinct().collect()))
        return fit_model(df, *args)

    monkeypatch.setattr("tickloom.operators.strategy.fit_model", counted)
    for per_asset in (False, True):
        spec = StrategySpec("ml", features=features, training=training, threshold=0.4, cooling=0, ledger=ROOMY, per_asset=per_asset)
        signals = run_strategy(opposite.drop("sector"), spec).signals
        rows = signals.where("signal <> 0").select("symbol", "signal", F.weekday("ts").alias("d")).collect()
        assert {r.symbol for r in rows} == {"UP", "DOWN"}
        assert np.mean([r.signal == (1 if r.d < 3 else -1) * (1 if r.symbol == "UP" else -1) for r in rows]) > 0.9
    assert fits == [["DOWN", "UP"], ["DOWN"], ["UP"]]


def test_a_portfolio_holds_only_so_many_trades(opposite):
    # No drawdown ends a key's trading here.
    patient = replace(ROOMY, max_drawdown=9.0)
    spec = StrategySpec("dma_crossover", 3, 8, ledger=patient)
    free = run_strategy(opposite, spec).trades.count()
    limited = run_strategy(opposite, StrategySpec("dma_crossover", 3, 8, ledger=patient, max_open=1, group="sector"))
    exits = {(t.symbol, t.entry_time): t.exit_time + pd.Timedelta(microseconds=int(t.exit_reason == "End of Backtest")) for t in limited.trades.collect()}
    assert 0 < len(exits) < free
    # A signal acts on the next day: the place goes to each entry that finds it free, and to no other.
    asked = sorted((r.ts + pd.Timedelta(days=1), r.symbol) for r in limited.signals.where("signal <> 0 AND atr IS NOT NULL").collect())
    last, until = max(r.ts for r in limited.signals.select("ts").collect()), None
    for entry, symbol in asked:
        if entry <= last and (until is None or entry >= until):
            until = exits.pop((symbol, entry))
    assert not exits


def test_models_of_folds_are_fitted_side_by_side(opposite, monkeypatch):
    """Each of two fits waits until the other has begun."""
    both = threading.Barrier(2)

    def waiting(df, *args):
        both.wait(60)
        return fit_model(df, *args)

    monkeypatch.setattr(strategy, "fit_model", waiting)
    table = index_series(opposite.select("symbol", "ts", *strategy.PRICES)).withColumns({"x": F.weekday("ts").cast("double"), "y": (F.weekday("ts") < 3).cast("int")})
    spec = StrategySpec("ml", training=TrainSpec("random_forest", {"n_estimators": 2, "max_depth": 3}), folds=Folds(200, 100, 100))
    scored = strategy._scores(table, spec, "y", ["x"], KEYS)
    assert scored.count() == scored.select("symbol", "ts").distinct().count() == 400
    assert scored.where("(probability_1 > 0.5) <> (weekday(ts) < 3)").isEmpty()
