import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import ledger, performance, signals
from tickloom.operators.ledger import LedgerSpec
from tickloom.plans import gate
from tickloom.plans.series import index_series


def simulate(p, spec, atr="atr"):
    """One symbol, bar by bar, as the plain loop it would be on a single machine."""
    cap = peak = spec.initial_capital
    trade, trades, equity = None, [], []
    n = len(p)
    o, c, s, a = (p[k].to_numpy() for k in ("open", "close", "prediction", atr))
    vol0 = p["close"].pct_change().std()

    def close(price, why, i):
        nonlocal cap, trade
        pnl = trade["d"] * (price - trade["e"]) / trade["e"]
        cap += pnl * trade["size"] * trade["e"]
        trades.append((trade["i"], i, trade["d"], why, price, pnl, trade["size"], trade["mfe"], trade["mae"]))
        trade = None

    for i in range(1, n):
        if trade:
            d, e = trade["d"], trade["e"]
            pnl = d * (c[i] - e) / e
            trade["mfe"], trade["mae"] = max(trade["mfe"], pnl), min(trade["mae"], pnl)
            if spec.trailing is not None:
                if not trade["live"] and pnl >= spec.trailing_activation:
                    trade["live"], trade["best"] = True, c[i]
                elif trade["live"]:
                    trade["best"] = max(trade["best"], c[i]) if d == 1 else min(trade["best"], c[i])
            level = trade["best"] * (1 - d * (spec.trailing or 0)) if trade["live"] else None
            if d * (c[i] - trade["stop"]) <= 0:
                close(trade["stop"], "Stop Loss", i)
            elif level is not None and d * (c[i] - level) <= 0:
                close(level, "Trailing Stop", i)
            elif d * (c[i] - trade["target"]) >= 0:
                close(trade["target"], "Take Profit", i)
        equity.append(cap)
        peak = max(peak, cap)
        d = int(s[i - 1])
        if d and trade is None:
            e = o[i] * (1 + spec.slippage * d)
            if spec.range_column:
                stop, target, vol = o[i] - d * spec.stop_multiple * a[i - 1], o[i] + d * spec.target_multiple * a[i - 1], a[i] / c[i]
            else:
                stop, target, vol = o[i] * (1 - d * spec.fixed_stop), o[i] * (1 + d * spec.fixed_target), vol0
            blocked = (peak - cap) / peak >= spec.max_drawdown
            cap -= cap * spec.cost
            if not blocked and vol > 1e-6 and e > 0 and stop > 0 and abs(e - stop) >= 1e-9:
                f = min(spec.risk_per_trade * e / abs(e - stop), spec.max_capital_per_trade)
                trade = dict(i=i, d=d, e=e, stop=stop, target=target, size=cap * f / e, live=False, best=None, mfe=0.0, mae=0.0)
    if trade:
        close(c[-1], "End of Backtest", n - 1)
        equity[-1] = cap
    return trades, equity, cap


def market(rng, n, signals_share):
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
    opened = close * (1 + rng.normal(0, 0.003, n))
    return pd.DataFrame(
        {
            "ts": pd.date_range("2022-01-01", periods=n), "open": opened, "high": np.maximum(opened, close) * 1.003, "low": np.minimum(opened, close) * 0.997, "close": close,
            "atr": np.where(rng.random(n) < 0.03, 0.0, rng.uniform(0.5, 3.0, n)),
            "prediction": np.where(rng.random(n) < signals_share, rng.choice([-1, 1], n), 0),
        }
    )


SPECS = {
    "levels": LedgerSpec(trailing=None),
    "trailing": LedgerSpec(stop_multiple=2.0, target_multiple=6.0, trailing=0.02, trailing_activation=0.02),
    "fixed": LedgerSpec(range_column=None, trailing=None),
    "gate": LedgerSpec(stop_multiple=1.0, target_multiple=0.4, trailing=None, max_drawdown=0.05, cost=0.005),
    "rare": LedgerSpec(stop_multiple=30.0, target_multiple=30.0, trailing=None),
}


@pytest.mark.parametrize("name", SPECS)
def test_ledger_equals_the_plain_loop(spark, name):
    spec = SPECS[name]
    rng = np.random.default_rng(11)
    frames = {f"S{i}": market(rng, n, share) for i, (n, share) in enumerate([(300, 0.3), (150, 0.05), (60, 0.9), (5, 0.5), (40, 0.0)])}
    pdf = pd.concat([p.assign(symbol=k) for k, p in frames.items()])
    done = ledger.backtest(spark.createDataFrame(pdf), spec)
    rn = {(r["symbol"], r["ts"]): r["rn"] for r in index_series(spark.createDataFrame(pdf)).collect()}
    trades = done.trades.collect()
    equity = done.equity.orderBy("ts").collect()
    summary = {r["symbol"]: r for r in done.summary.collect()}
    for k, p in frames.items():
        want, curve, cap = simulate(p, spec)
        got = sorted((t for t in trades if t["symbol"] == k), key=lambda t: t["entry_time"])
        assert [(rn[k, t["entry_time"]], rn[k, t["exit_time"]], t["direction"], t["exit_reason"]) for t in got] == [w[:4] for w in want]
        for t, w in zip(got, want):
            values = [t[c] for c in ("exit_price", "realized_pnl", "size", "max_favorable_excursion", "max_adverse_excursion")]
            assert values == pytest.approx(list(w[4:]), rel=1e-9, abs=1e-12)
        assert [r["equity"] for r in equity if r["symbol"] == k] == pytest.approx(curve, rel=1e-9)
        assert summary[k]["final_capital"] == pytest.approx(cap, rel=1e-9)
        assert summary[k]["num_trades"] == len(want)


def test_entry_bars_and_levels(spark):
    rng = np.random.default_rng(21)
    pdf = market(rng, 40, 0.3).assign(symbol="S")
    pdf["atr"] = rng.uniform(0.2, 0.9, 40)
    pdf.loc[:3, "prediction"] = [0, 0, 0, -1]
    spec = LedgerSpec(stop_multiple=1.5, target_multiple=2.5)
    got = ledger.candidate_entries(spark.createDataFrame(pdf), spec).orderBy("entry_rn").collect()
    assert [r["entry_rn"] for r in got] == [i + 1 for i in range(39) if pdf["prediction"][i]] and got[0]["entry_rn"] == 4
    for row in got:
        i, d = row["entry_rn"], pdf["prediction"][row["entry_rn"] - 1]
        assert row["entry_price"] == pytest.approx(pdf["open"][i] * (1 + d * spec.slippage))
        assert (row["stop"], row["target"]) == (pytest.approx(pdf["open"][i] - d * 1.5 * pdf["atr"][i - 1]), pytest.approx(pdf["open"][i] + d * 2.5 * pdf["atr"][i - 1]))
    fixed = ledger.candidate_entries(spark.createDataFrame(pdf), LedgerSpec(range_column=None, fixed_stop=0.03, fixed_target=0.07)).orderBy("entry_rn").collect()[0]
    assert (fixed["stop"], fixed["target"]) == (pytest.approx(pdf["open"][4] * 1.03), pytest.approx(pdf["open"][4] * 0.93))


@pytest.mark.parametrize("entry,stop,vol,want", [(100.0, 98.0, 0.1, 0.25), (100.0, 80.0, 0.1, 0.1), (100.0, 100.0, 0.1, 0.0), (100.0, -1.0, 0.1, 0.0), (100.0, 98.0, 0.0, 0.0), (100.0, None, 0.1, 0.0)])
def test_position_fraction(spark, entry, stop, vol, want):
    row = spark.range(1).select(ledger.position_fraction(F.lit(entry), F.lit(stop).cast("double"), F.lit(vol), 0.02, 0.25).alias("f"))
    assert row.collect()[0]["f"] == pytest.approx(want)


@pytest.mark.parametrize("chunk_rows", [40, 1 << 17])
def test_portfolio_limits_equal_the_plain_loop(spark, monkeypatch, chunk_rows):
    monkeypatch.setattr(gate.admit, "__defaults__", (chunk_rows,))
    rng = np.random.default_rng(2)
    rows = []
    for i in range(250):
        a = dt.datetime(2022, 1, 1) + dt.timedelta(hours=int(rng.integers(0, 2000)))
        rows.append(("p", f"s{i % 12}", "xy"[i % 2], a, a + dt.timedelta(hours=int(rng.integers(1, 90)))))
    rows = list({(r[1], r[3]): r for r in rows}.values())
    want, open_ = set(), []
    for _, s, g, a, b in sorted(rows, key=lambda r: (r[3], r[1])):
        open_ = [o for o in open_ if o[2] > a]
        if len(open_) < 3 and sum(o[1] == g for o in open_) < 2 and all(o[0] != s for o in open_):
            open_.append((s, g, b))
            want.add((s, a))
    df = spark.createDataFrame(rows, "portfolio string, symbol string, sector string, entry_time timestamp_ntz, exit_time timestamp_ntz")
    got = ledger.concurrent_limits(df, 3, 2, "sector")
    assert {(r["symbol"], r["entry_time"]) for r in got.collect()} == want


@pytest.mark.parametrize("bars", [1, 2, 5])
def test_cooling_period(spark, bars):
    given = np.random.default_rng(bars).choice([-1, 0, 1], 60, p=[0.3, 0.4, 0.3]).tolist()
    want, last = [], -bars - 1
    for i, s in enumerate(given):
        kept = s if s and i - last > bars else 0
        last = i if kept else last
        want.append(kept)
    pdf = pd.DataFrame({"symbol": "S", "ts": pd.date_range("2023-01-01", periods=60), "signal": given})
    assert [r["signal"] for r in signals.cooling_period(spark.createDataFrame(pdf), bars).orderBy("ts").collect()] == want


def test_signal_maps():
    assert signals.signal_map(["-1", "1"]) == {"-1": -1, "1": 1}
    assert signals.signal_map([0, 1]) == {"0": -1, "1": 1}
    assert signals.signal_map(["a", "b", "c"]) == {"a": -1, "b": 0, "c": 1}
    with pytest.raises(ValueError):
        signals.signal_map(["a"])


def test_neutral_class_can_be_forced_long(spark):
    df = spark.createDataFrame([(0.1, 0.8, 0.1), (0.2, 0.2, 0.6), (0.4, 0.3, 0.3)], "`probability_-1` double, probability_0 double, probability_1 double")
    plain = [r["signal"] for r in signals.raw_signals(df, (-1, 0, 1), 0.5).collect()]
    forced = [r["signal"] for r in signals.raw_signals(df, (-1, 0, 1), 0.5, force_neutral_long=True).collect()]
    assert (plain, forced) == ([0, 1, 0], [1, 1, 0])


def returns(spark, values):
    n = len(values)
    return spark.createDataFrame(pd.DataFrame({"symbol": "S", "ts": pd.date_range("2023-01-01", periods=n), "ret": values}))


def _longest(flags):
    best = run = 0
    for f in flags:
        run = run + 1 if f else 0
        best = max(best, run)
    return best


def test_return_metrics_of_gains(spark):
    gains = np.random.default_rng(4).uniform(0.001, 0.04, 9)
    r = performance.return_metrics(returns(spark, gains)).collect()[0]
    assert r["total_return"] == pytest.approx(np.prod(1 + gains) - 1)
    assert (r["win_rate"], r["win_days"], r["lose_days"], r["max_drawdown"]) == (1.0, 9, 0, 0.0)
    assert r["sharpe_ratio"] > 0 and r["sortino_ratio"] is None and r["calmar_ratio"] is None
    assert r["profit_factor"] == float("inf") and r["win_loss_ratio"] == float("inf")
    assert (r["max_consecutive_wins"], r["max_consecutive_losses"]) == (9, 0)


def test_return_metrics_mixed_and_flat(spark):
    mixed = np.random.default_rng(6).normal(0.001, 0.02, 37)
    r = performance.return_metrics(returns(spark, mixed)).collect()[0]
    s = pd.Series(mixed)
    wealth = (1 + s).cumprod()
    assert r["total_return"] == pytest.approx((1 + s).prod() - 1)
    assert r["max_drawdown"] == pytest.approx(((wealth - wealth.cummax()) / wealth.cummax()).min())
    assert r["var_95"] == pytest.approx(s.quantile(0.05))
    assert r["autocorrelation_1d"] == pytest.approx(s.autocorr(1))
    assert (r["win_days"], r["lose_days"]) == ((s > 0).sum(), (s < 0).sum())
    assert (r["max_consecutive_wins"], r["max_consecutive_losses"]) == (_longest(s > 0), _longest(s < 0))
    f = performance.return_metrics(returns(spark, [0.0] * 8)).collect()[0]
    assert (f["total_return"], f["win_rate"], f["profit_factor"], f["win_loss_ratio"], f["sharpe_ratio"]) == (0.0, 0.0, 0.0, 0.0, None)
    assert performance.return_metrics(returns(spark, mixed).limit(0)).count() == 0


def test_total_loss_keeps_its_sign(spark):
    r = performance.return_metrics(returns(spark, [0.1, -1.0, 0.2])).collect()[0]
    assert r["total_return"] == -1.0


def _episodes(values):
    """Start, last day below the peak, lowest day, day of recovery, depth, one after the other."""
    out, peak, now = [], values[0], None
    for i, v in enumerate(values):
        if v >= peak:
            if now:
                out.append((*now[:3], i, now[3]))
            peak, now = v, None
        else:
            depth = v / peak - 1
            now = (i, i, i, depth) if now is None else (now[0], i, i if depth < now[3] else now[2], min(depth, now[3]))
    return out + ([(*now[:3], None, now[3])] if now else [])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_drawdown_episodes(spark, seed):
    values = (500 * np.exp(np.cumsum(np.random.default_rng(seed).normal(0.004, 0.03, 80)))).tolist()
    days = pd.date_range("2023-01-01", periods=80)
    df = spark.createDataFrame(pd.DataFrame({"symbol": "S", "ts": days, "equity": values}))
    rows = performance.drawdowns(df).orderBy("start_date").collect()
    want = _episodes(values)
    at = lambda t: None if t is None else (pd.Timestamp(t) - days[0]).days
    assert len(want) > 2
    assert [tuple(at(r[c]) for c in ("start_date", "end_date", "lowest_point_date", "recovery_date")) for r in rows] == [w[:4] for w in want]
    assert [r["max_drawdown"] for r in rows] == pytest.approx([w[4] for w in want])
    assert [r["recovery_duration_days"] for r in rows] == [None if w[3] is None else w[3] - w[2] for w in want]
    top = performance.top_drawdowns(performance.drawdowns(df), 2).orderBy("rank").collect()
    assert [t["max_drawdown"] for t in top] == pytest.approx(sorted(w[4] for w in want)[:2])
