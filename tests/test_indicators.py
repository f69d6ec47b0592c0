import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import indicators as ind
from tickloom.plans import series


def by_symbol(walk, fn):
    parts = [fn(p.reset_index(drop=True)) for _, p in walk.groupby("symbol")]
    return pd.concat(parts, ignore_index=True)


def wilder(x, n):
    return x.ewm(alpha=1 / n, adjust=False, min_periods=n).mean()


def close_to(got, want, rtol=1e-9):
    np.testing.assert_allclose(got.astype(float), want.astype(float), rtol=rtol)


def test_means_and_bands(bars, walk, sorted_rows):
    got = sorted_rows(ind.bollinger(ind.ema(ind.sma(bars, 20), 30), 20))
    close = walk.groupby("symbol")["close"]
    mean, dev = close.transform(lambda c: c.rolling(20).mean()), close.transform(lambda c: c.rolling(20).std())
    close_to(got["sma_length20"], mean)
    close_to(got["BBU_20_2.0"], mean + 2 * dev)
    close_to(got["BBL_20_2.0"], mean - 2 * dev)
    close_to(got["ema_length30"], close.transform(lambda c: c.ewm(span=30, adjust=False, min_periods=30).mean()))
    known = got.dropna()
    assert (known["BBL_20_2.0"] <= known["BBM_20_2.0"]).all() and (known["BBM_20_2.0"] <= known["BBU_20_2.0"]).all()


def pandas_atr(p, n):
    prev = p["close"].shift()
    tr = pd.concat([p["high"] - p["low"], (p["high"] - prev).abs(), (p["low"] - prev).abs()], axis=1).max(axis=1)
    tr[0] = np.nan
    return wilder(tr, n) if len(p) >= n else tr * np.nan


def test_atr_and_ratio(bars, walk, sorted_rows):
    got = sorted_rows(ind.atr(bars, 14, ratio=True))
    want = by_symbol(walk, lambda p: pandas_atr(p, 14))
    close_to(got["atr_length14"], want)
    close_to(got["ATRr_14"], (want / walk["close"]).fillna(0))


def test_rsi(bars, walk, sorted_rows):
    def one(p):
        d = p["close"].diff().fillna(0)
        g, l = wilder(d.clip(lower=0), 14), wilder(-d.clip(upper=0), 14)  # noqa: E741
        r = 100 - 100 / (1 + g / l.replace(0, np.nan))
        r[:14] = np.nan
        return r if len(p) > 14 else r * np.nan

    got = sorted_rows(ind.rsi(bars, 14))["rsi_length14"]
    close_to(got, by_symbol(walk, one))
    assert got.dropna().between(0, 100).all()


def test_rsi_without_losses_is_null(spark):
    up = pd.DataFrame({"symbol": "U", "ts": pd.date_range("2023-01-01", periods=40), "close": np.arange(1.0, 41.0)})
    assert ind.rsi(spark.createDataFrame(up), 14).filter("rsi_length14 IS NOT NULL").count() == 0


def test_macd(bars, walk, sorted_rows):
    def one(p):
        ema = lambda x, n: x.ewm(span=n, adjust=False, min_periods=n).mean()
        line = ema(p["close"], 12) - ema(p["close"], 26)
        sig = ema(line, 9)
        out = pd.DataFrame({"line": line, "sig": sig, "hist": line - sig})
        return out if len(p) >= 34 else out * np.nan

    got, want = sorted_rows(ind.macd(bars)), by_symbol(walk, one)
    close_to(got["MACD_12_26"], want["line"], 1e-7)
    close_to(got["MACDs_9"], want["sig"], 1e-7)


def test_adx(bars, walk, sorted_rows):
    def one(p, n=14):
        up, down = p["high"].diff(), -p["low"].diff()
        pdm, ndm = up.where((up > down) & (up > 0), 0.0), down.where((down > up) & (down > 0), 0.0)
        atr = pandas_atr(p, n)
        plus, minus = 100 * wilder(pdm, n) / atr, 100 * wilder(ndm, n) / atr
        dx = 100 * (plus - minus).abs() / (plus + minus).abs().replace(0, np.nan)
        dx[: n - 1] = np.nan
        adx = wilder(dx, n)
        adx[: 2 * n - 2] = np.nan
        out = pd.DataFrame({"a": adx, "p": plus, "m": minus})
        return out if len(p) >= 2 * n else out * np.nan

    got, want = sorted_rows(ind.adx(bars)), by_symbol(walk, one)
    close_to(got["ADX_14"], want["a"])
    close_to(got["DMP_14"], want["p"])
    close_to(got["DMN_14"], want["m"])


def test_volume_indicators(bars, walk, sorted_rows):
    def one(p):
        move = p["close"].diff()
        obv = (p["volume"] * np.sign(move)).fillna(0).cumsum()
        tp = (p["high"] + p["low"] + p["close"]) / 3
        flow, d = tp * p["volume"], tp.diff()
        pos, neg = flow.where(d > 0, 0.0).rolling(14).sum(), flow.where(d < 0, 0.0).rolling(14).sum()
        mfi = 100 - 100 / (1 + pos / neg.replace(0, np.nan))
        return pd.DataFrame({"obv": obv, "mfi": mfi if len(p) > 14 else mfi * np.nan})

    got, want = sorted_rows(ind.mfi(ind.obv(bars))), by_symbol(walk, one)
    close_to(got["obv"], want["obv"])
    close_to(got["mfi_length14"], want["mfi"])


def test_short_series_has_no_values(bars):
    tiny = bars.filter("symbol = 'TINY'")
    out = ind.add_indicators(tiny, [{"indicator": n} for n in ("sma", "ema", "rsi", "atr", "mfi", "macd", "adx", "bollinger_bands")])
    row = out.drop("symbol", "ts", "rn", "n_rows", "open", "high", "low", "close", "volume", "ATRr_14").agg(
        *[F.count(F.col(f"`{c}`")).alias(c.replace(".", "_")) for c in out.columns if c not in {"symbol", "ts", "rn", "n_rows", "open", "high", "low", "close", "volume", "ATRr_14"}]
    )
    assert set(row.collect()[0]) == {0}


def test_list_names_and_unknown(bars):
    out = ind.add_indicators(bars, [{"indicator": "sma", "length": 10}, {"indicator": "obv"}, {"indicator": "macd", "fast": 5, "slow": 9, "signal": 4}])
    assert {"sma_length10", "obv", "macd_MACD_5_9", "macd_MACDs_4", "macd_MACDh_5_9_4"} <= set(out.columns)
    assert not [c for c in out.columns if c.startswith("__")]
    with pytest.raises(ValueError):
        ind.add_indicators(bars, [{"indicator": "stoch"}])


def test_indicators_do_not_depend_on_the_chunk_size(bars, sorted_rows, monkeypatch):
    configs = [{"indicator": "adx"}, {"indicator": "macd"}, {"indicator": "obv"}, {"indicator": "mfi"}]
    want = sorted_rows(ind.add_indicators(bars, configs))
    small = {f: getattr(series, f) for f in ("over_chunks", "running", "ewm")}
    for name, fn in small.items():
        monkeypatch.setattr(ind, name, lambda *a, fn=fn, **k: fn(*a, **{**k, "chunk_rows": 41}))
    got = sorted_rows(ind.add_indicators(bars, configs))
    for c in want.columns[2:]:
        close_to(got[c], want[c], 1e-7)


def test_symbols_do_not_leak(spark, walk, sorted_rows):
    renamed = walk.assign(symbol=walk["symbol"].map({"HOT": "Z", "MID": "A", "TINY": "M"}))
    a = sorted_rows(ind.rsi(spark.createDataFrame(walk), 14))
    b = sorted_rows(ind.rsi(spark.createDataFrame(renamed), 14))
    for old, new in (("HOT", "Z"), ("MID", "A")):
        close_to(a.loc[a["symbol"] == old, "rsi_length14"].reset_index(drop=True), b.loc[b["symbol"] == new, "rsi_length14"].reset_index(drop=True))
