"""Trades that compete for places in a portfolio, against a loop over all bars."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators.ledger import LedgerSpec, Portfolio, backtest
from tickloom.operators.strategy import StrategySpec, run_strategy, with_regimes
from tickloom.operators.walkforward import Folds, fold_backtests
from tickloom.plans import gate


def prices(seed, symbols=5, n=90):
    """Walks that start on different days, with signals on about a third of all bars."""
    rng = np.random.default_rng(seed)
    parts = []
    for k in range(symbols):
        m = n - 7 * k
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, m)))
        opened = close * (1 + rng.normal(0, 0.005, m))
        parts.append(
            pd.DataFrame(
                {
                    "symbol": f"s{k}",
                    "ts": pd.date_range("2022-01-01", periods=n)[k : k + m],
                    "open": opened,
                    "high": np.maximum(opened, close) * 1.004,
                    "low": np.minimum(opened, close) * 0.996,
                    "close": close,
                    "prediction": rng.choice([-1, 0, 1], m, p=[0.2, 0.6, 0.2]),
                    "atr": 0.03 * close * rng.choice([0.0, 1.0], m, p=[0.1, 0.9]),
                    "sector": "xy"[k % 2],
                }
            )
        )
    return pd.concat(parts, ignore_index=True)


def loop(pdf, spec, limits, pairs=()):
    """Every bar in order of time: exits of all symbols, then entries symbol by symbol."""
    bars = {s: g.sort_values("ts").reset_index(drop=True) for s, g in pdf.groupby("symbol")}
    row = {s: {t: i for i, t in enumerate(g["ts"])} for s, g in bars.items()}
    cap = dict.fromkeys(bars, spec.initial_capital)
    peak, shown = dict(cap), dict(cap)
    open_, trades, waits = {}, [], {}
    for ts in sorted(pdf["ts"].unique()):
        for s in sorted(bars):
            i = row[s].get(ts)
            if i is None:
                continue
            # A bar's equity stands after its exits, before what its entry costs.
            shown[s] = cap[s]
            if s not in open_:
                continue
            t, c = open_[s], bars[s].loc[i, "close"]
            hit = None
            pnl = t["d"] * (c - t["e"]) / t["e"]
            if spec.trailing is not None:
                if not t["live"] and pnl >= spec.trailing_activation:
                    t["live"], t["best"] = True, c
                elif t["live"]:
                    t["best"] = max(t["best"], c) if t["d"] == 1 else min(t["best"], c)
            if t["d"] * (c - t["stop"]) <= 0:
                hit = t["stop"]
            elif t["live"] and t["d"] * (c - t["best"] * (1 - t["d"] * spec.trailing)) <= 0:
                hit = t["best"] * (1 - t["d"] * spec.trailing)
            elif t["d"] * (c - t["target"]) >= 0:
                hit = t["target"]
            if hit is not None:
                cap[s] += t["notional"] * t["d"] * (hit - t["e"]) / t["e"]
                trades.append((s, t["at"], ts, cap[s]))
                waits[s] = i if spec.same_bar_reentry else i + 1
                shown[s] = cap[s]
                del open_[s]
            peak[s] = max(peak[s], cap[s])
        for s in sorted(bars):
            i = row[s].get(ts)
            if not i:
                continue
            g = bars[s]
            d, o, width = g.loc[i - 1, "prediction"], g.loc[i, "open"], g.loc[i - 1, "atr"]
            if d == 0 or s in open_ or i < waits.get(s, 0):
                continue
            before = cap[s]
            cap[s] *= 1 - spec.cost
            entry, stop, target = o * (1 + spec.slippage * d), o - d * spec.stop_multiple * width, o + d * spec.target_multiple * width
            gap = abs(entry - stop)
            size = min(spec.risk_per_trade * entry / gap, spec.max_capital_per_trade) if gap >= 1e-9 and g.loc[i, "atr"] / g.loc[i, "close"] > 1e-6 else 0
            team = g.loc[i, "sector"]
            near = {b for a, b in pairs if a == s} | {a for a, b in pairs if b == s}
            full = len(open_) >= limits.max_open
            full |= limits.group is not None and sum(t["team"] == team for t in open_.values()) >= limits.max_correlated
            full |= bool(near) and sum(x in near for x in open_) >= limits.max_correlated
            if size <= 0 or full or (peak[s] - before) / peak[s] >= spec.max_drawdown:
                continue
            open_[s] = {"d": d, "e": entry, "stop": stop, "target": target, "notional": cap[s] * size, "live": False, "best": None, "at": ts, "team": team}
        # What a symbol still holds after its last bar is closed there, once all have had their turn.
        for s in [x for x in open_ if row[x].get(ts) == len(bars[x]) - 1]:
            t = open_.pop(s)
            cap[s] += t["notional"] * t["d"] * (bars[s]["close"].iloc[-1] - t["e"]) / t["e"]
            trades.append((s, t["at"], ts, cap[s]))
            shown[s] = cap[s]
    return sorted((s, a, b) for s, a, b, _ in trades), cap, shown


ROOMY = LedgerSpec(stop_multiple=1.0, target_multiple=2.0, trailing=0.03, trailing_activation=0.02)
CASES = {
    "one": (ROOMY, {"max_open": 1}, ()),
    "two": (ROOMY, {"max_open": 2}, ()),
    "teams": (ROOMY, {"max_open": 4, "max_correlated": 1, "group": "sector"}, ()),
    "pairs": (ROOMY, {"max_open": 4, "max_correlated": 1}, (("s0", "s1"), ("s1", "s2"), ("s4", "s0"))),
    "later": (LedgerSpec(stop_multiple=0.5, target_multiple=0.5, trailing=None, same_bar_reentry=False), {"max_open": 2}, ()),
    "drawdown": (LedgerSpec(stop_multiple=0.4, target_multiple=0.6, trailing=None, cost=0.01, max_drawdown=0.06), {"max_open": 2}, ()),
    "wide": (ROOMY, {"max_open": 50}, ()),
}


@pytest.mark.parametrize(("case", "chunk_rows"), [("two", 1 << 17), *((c, 9) for c in CASES)])
def test_backtest_under_limits_equals_the_loop(spark, monkeypatch, case, chunk_rows):
    spec, limits, pairs = CASES[case]
    monkeypatch.setattr(gate.admit, "__defaults__", (chunk_rows,))
    pdf = prices(len(case))
    df = spark.createDataFrame(pdf)
    table = spark.createDataFrame(list(pairs), "symbol string, other string") if pairs else None
    limits = Portfolio(**limits, pairs=table)
    done = backtest(df, spec, portfolio=limits)
    want, capital, shown = loop(pdf, spec, limits, pairs)
    got = sorted((r.symbol, r.entry_time, r.exit_time) for r in done.trades.collect())
    assert [(s, pd.Timestamp(a), pd.Timestamp(b)) for s, a, b in got] == [(s, pd.Timestamp(a), pd.Timestamp(b)) for s, a, b in want]
    summary = {r.symbol: r for r in done.summary.collect()}
    last = {r.symbol: r.e for r in done.equity.groupBy("symbol").agg(F.max_by("equity", "ts").alias("e")).collect()}
    for s, value in capital.items():
        assert summary[s].final_capital == pytest.approx(value, rel=1e-9)
        assert last[s] == pytest.approx(shown[s], rel=1e-9)
        assert summary[s].num_trades == sum(t[0] == s for t in want)
    if case == "drawdown":
        assert len(want) < len(loop(pdf, LedgerSpec(**{**spec.__dict__, "max_drawdown": 9.0}), limits)[0])


def test_an_entry_turned_away_leaves_room_for_a_later_one(spark):
    """B's first signal finds the place taken; its second one, which the first would have blocked, gets in."""
    days = pd.date_range("2022-01-01", periods=12)
    flat = {"open": 100.0, "high": 100.0, "low": 100.0, "close": 100.0, "atr": 1.0}
    a = pd.DataFrame({"symbol": "A", "ts": days, **flat, "prediction": [1] + [0] * 11})
    a.loc[3, "close"] = 110.0
    b = pd.DataFrame({"symbol": "B", "ts": days, **flat, "prediction": [0, 1, 0, 0, 1] + [0] * 7})
    done = backtest(spark.createDataFrame(pd.concat([a, b])), ROOMY, portfolio=Portfolio(max_open=1))
    assert sorted((r.symbol, str(r.entry_time.date())) for r in done.trades.collect()) == [("A", "2022-01-02"), ("B", "2022-01-06")]


def test_folds_are_portfolios_of_their_own(spark):
    pdf = prices(4, 3, 80)
    folds = Folds(20, 20, 20)
    df = spark.createDataFrame(pdf.rename(columns={"prediction": "signal"}))
    done = fold_backtests(df, folds, ROOMY, portfolio=Portfolio(max_open=1))
    trades = done.trades.toPandas()
    assert len(trades)
    for fold, own in trades.groupby("fold"):
        own = own.sort_values("entry_time")
        assert (own["entry_time"].iloc[1:].to_numpy() >= own["exit_time"].iloc[:-1].to_numpy()).all(), fold
    counted = done.summary.groupBy().agg(F.sum("num_trades")).first()[0]
    assert counted == len(trades) < fold_backtests(df, folds, ROOMY).trades.count()


def test_all_results_of_a_strategy_come_from_accepted_trades(spark):
    pdf = prices(6, 4, 90)
    df = spark.createDataFrame(pdf.assign(volume=1.0).drop(columns=["prediction", "atr"]))
    free = run_strategy(df, StrategySpec("dma_crossover", 3, 8, ledger=ROOMY))
    tight = run_strategy(df, StrategySpec("dma_crossover", 3, 8, ledger=ROOMY, max_open=1, group="sector"))
    n = tight.trades.count()
    assert 0 < n < free.trades.count()
    assert tight.results.agg(F.sum("num_trades")).first()[0] == tight.overall.first()["total_trades"] == n
    ends = {r.symbol: r.e for r in tight.equity.groupBy("symbol").agg(F.max_by("equity", "ts").alias("e")).collect()}
    finals = {r.symbol: r.final_capital for r in tight.results.collect()}
    assert ends == pytest.approx(finals)


def test_regimes_act_inside_a_strategy(spark):
    """Without a regime column, bars get one; its actions change signals and sizes."""
    pdf = prices(8, 3, 160)
    df = spark.createDataFrame(pdf.assign(volume=1.0).drop(columns=["prediction", "atr", "sector"]))
    spec = {"regime_features": ("volatility_ratio_20_50", "efficiency_ratio_20"), "regime_lookback": 30}
    every = run_strategy(df, StrategySpec("dma_crossover", 3, 8, ledger=ROOMY, regime_actions={0: "trade_normal"}, **spec))
    seen = {r.regime for r in every.signals.where("signal <> 0").select("regime").distinct().collect()}
    assert {0, 1, 2} & seen
    quiet = run_strategy(df, StrategySpec("dma_crossover", 3, 8, ledger=ROOMY, regime_actions={0: "no_trade", 1: "reduce_risk"}, **spec))
    rows = quiet.signals.select("symbol", "ts", "signal", "regime")
    assert rows.where("regime = 0 AND signal <> 0").isEmpty() and not rows.where("regime = 1 AND signal <> 0").isEmpty()
    tags = {t for r in quiet.trades.select("tags").collect() for t in r.tags}
    assert "action_reduce_risk" in tags and "regime_2" in tags
    codes = with_regimes(df, StrategySpec(regime_actions={0: "no_trade"}, **spec)).groupBy("regime").count().collect()
    assert {r.regime for r in codes} == {0, 1, 2}


def test_bad_limits_raise():
    with pytest.raises(ValueError, match="limits"):
        Portfolio(max_open=0)
