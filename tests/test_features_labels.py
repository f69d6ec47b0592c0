import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import features as ft
from tickloom.operators import labels as lab
from tickloom.plans import series


def frame(spark, **cols):
    n = len(next(iter(cols.values())))
    return spark.createDataFrame(pd.DataFrame({"symbol": "S", "ts": pd.date_range("2023-01-01", periods=n), **cols}))


def test_fractals_exact(spark, sorted_rows):
    df = frame(spark, high=[10.0, 12, 11, 13, 10, 9], low=[5.0, 7, 6, 8, 5, 4])
    got = sorted_rows(ft.add_features(df, [ft.fractals(3)]))
    assert got["bearish_fractal_3"].tolist() == [0, 1, 0, 1, 0, 0]
    assert got["bullish_fractal_3"].tolist() == [0, 0, 1, 0, 0, 0]


def test_sets_together_equal_sets_alone(bars, walk, sorted_rows):
    sets = [ft.volatility_features(), ft.efficiency_ratio(10), ft.momentum_features(), ft.support_resistance(), ft.vwap_features(), ft.candle_features()]
    together = sorted_rows(ft.add_features(bars, sets))
    for s in sets:
        alone = sorted_rows(ft.add_features(bars, [s]))
        for c in alone.columns[9:]:
            np.testing.assert_allclose(together[c].astype(float), alone[c].astype(float))
    assert together["efficiency_ratio_10"].dropna().between(0, 1 + 1e-12).all()
    want = walk.groupby("symbol")["close"].transform(lambda c: c.pct_change().rolling(20).std())
    np.testing.assert_allclose(together["volatility_20"], want)


def test_correlation_filter_drops_the_later_name(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=200)
    df = frame(spark, b_feature=a, a_feature=a * 2 + 1, other=rng.normal(size=200), close=a)
    assert ft.uncorrelated_columns(df, ["b_feature", "a_feature", "other"], 0.9) == ["a_feature", "other"]
    kept = ft.filter_correlated(df, 0.9)
    assert set(kept.columns) == {"symbol", "ts", "a_feature", "other", "close"}


def test_a_thousand_columns_correlate_as_in_pairs(spark, monkeypatch):
    """Nulls in different rows, large offsets, a constant and a column that is empty."""
    rng = np.random.default_rng(1)
    n = 60
    x = rng.normal(size=(n, 1000)) + 0.8 * rng.normal(size=(n, 1))
    x[:, 3] += 1e9
    x[rng.random(x.shape) < 0.05] = np.nan
    x[:, 7], x[:, 8] = 4.0, np.nan
    names = [f"f {i}" for i in range(1000)]
    pdf = pd.DataFrame(x, columns=names)
    table = spark.createDataFrame([tuple(None if v != v else float(v) for v in row) for row in x], ", ".join(f"`{c}` double" for c in names)).repartition(3)
    got = ft.correlation_matrix(table, names).toPandas()
    assert len(got) == 1000 * 999 // 2
    want = pdf.corr(min_periods=2).to_numpy()
    place = {c: i for i, c in enumerate(names)}
    a, b = got["a"].map(place).to_numpy(), got["b"].map(place).to_numpy()
    assert (a < b).all()
    flat = np.isin(a, (7, 8)) | np.isin(b, (7, 8))
    assert got.loc[flat, "corr"].isna().all()
    np.testing.assert_allclose(got.loc[~flat, "corr"], want[a, b][~flat], atol=1e-6)


def test_constant_columns_have_no_correlation(spark):
    df = frame(spark, x=[1.0, 2.0, 3.0], flat=[1.0, 1.0, 1.0])
    assert ft.correlation_matrix(df, ["x", "flat"]).collect()[0]["corr"] is None
    flat = frame(spark, close=np.full(60, 5.0), volume=np.full(60, 2.0))
    assert ft.add_features(flat, [ft.volume_features()]).filter("price_volume_corr IS NOT NULL").count() == 0


def test_feature_table_has_no_nulls(bars, walk):
    spec = ft.FeatureSpec(
        indicators=[{"indicator": "atr", "length": 10}, {"indicator": "bollinger_bands", "length": 20, "std": 2.0}],
        volatility=True, regime=True, momentum=True, fractal_window=5, difference=["volume"], correlation_threshold=0.97,
    )
    out = ft.build_features(bars.drop("rn", "n_rows"), spec)
    assert out.count() == len(walk)
    assert not [c for c in out.columns if " " in c or "." in c]
    nulls = out.select([F.sum(F.col(c).isNull().cast("int")).alias(c) for c in out.columns]).collect()[0]
    assert set(nulls) == {0}
    assert {r[0] for r in out.select("triple_barrier_label").distinct().collect()} <= {-1, 0, 1}


def test_statistics_can_be_features(bars):
    spec = ft.FeatureSpec(stationarity=True, garch=True, label=ft.LabelSpec(method="directional", max_holding_period=2))
    out = ft.build_features(bars.drop("rn", "n_rows"), spec)
    row = out.filter("symbol = 'HOT'").agg(F.max("garch_vol"), F.max("adf_pvalue"), F.count(F.lit(1))).collect()[0]
    assert row[0] > 0 and 0 < row[1] <= 1 and row[2] == 698


def plain_hurst(x):
    sizes = [int(10**e) for e in np.arange(1.0, np.log10(len(x) - 1), 0.25)] + [len(x)]
    points = []
    for w in sizes:
        parts = [x[i : i + w] for i in range(0, len(x) - w + 1, w)]
        ratios = [(p.max() / p.min() - 1) / np.std(p[1:] / p[:-1] - 1, ddof=1) for p in parts]
        points.append((np.log10(w), np.log10(np.mean(ratios))))
    return np.polyfit(*np.array(points).T, 1)[0]


def test_hurst(bars, walk):
    got = {r["symbol"]: r["hurst"] for r in ft.hurst(bars).collect()}
    assert got["TINY"] == 0.5
    for symbol in ("HOT", "MID"):
        assert got[symbol] == pytest.approx(plain_hurst(walk.loc[walk["symbol"] == symbol, "close"].to_numpy()))


BASE = np.linspace(100, 110, 20)


def barrier_case(high=None, low=None, close=None, spread=0.5):
    c = BASE.copy()
    for i, v in (close or {}).items():
        c[i] = v
    h, l = c + spread, c - spread  # noqa: E741
    for i, v in (high or {}).items():
        h[i] = v
    for i, v in (low or {}).items():
        l[i] = v
    return c, h, l


CASES = {
    "target": (dict(high={2: 105}), 5, 0.0, 1),
    "stop": (dict(low={3: 98}, high={1: 100.5, 2: 100.5, 3: 100.5}), 5, 0.0, -1),
    "neutral": (dict(close={i: 100.1 for i in range(1, 7)}, high={i: 100.2 for i in range(1, 7)}, low={i: 100.0 for i in range(1, 7)}), 5, 0.005, 0),
    "up": (dict(close=dict(zip(range(1, 7), np.linspace(100.1, 100.8, 6))), high={i: 100.9 for i in range(1, 7)}, low={i: 99.5 for i in range(1, 7)}), 5, 0.005, 1),
    "down": (dict(close=dict(zip(range(1, 7), np.linspace(99.9, 99.2, 6))), high={i: 100.4 for i in range(1, 7)}, low={i: 99.1 for i in range(1, 7)}), 5, 0.005, -1),
    "tie": (dict(high={3: 105}, low={3: 95}, close={1: 100.1, 2: 100.2}), 5, 0.0, 1),
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("limit", [64, 0])
def test_triple_barrier_cases(spark, monkeypatch, case, limit):
    monkeypatch.setattr(lab, "FRAME_LIMIT", limit)
    change, h, threshold, want = CASES[case]
    c, hi, lo = barrier_case(**change)
    df = frame(spark, close=c, high=hi, low=lo, atr=np.full(20, 0.5))
    rows = lab.triple_barrier(df, "atr", 2.0, 2.0, h, threshold).orderBy("ts").collect()
    assert rows[0]["label"] == want
    assert rows[19]["label"] is None and rows[18]["label"] is not None


def test_triple_barrier_edges(spark):
    c, hi, lo = barrier_case()
    df = frame(spark, close=c, high=hi, low=lo, atr=np.full(20, 0.5))
    assert lab.triple_barrier(df, "atr", 2.0, 2.0, 0).filter("label IS NOT NULL").count() == 0
    rows = lab.triple_barrier(df, "atr", 2.0, 2.0, 50).orderBy("ts").collect()
    assert rows[18]["label"] == 1 or rows[18]["label"] == 0
    assert rows[19]["label"] is None
    with pytest.raises(ValueError):
        lab.triple_barrier(df.drop("high"), "atr", 2.0, 2.0, 5)


@pytest.mark.parametrize("h", [3, 40])
def test_both_barrier_plans_agree(bars, sorted_rows, monkeypatch, h):
    width = F.col("close") * 0.02
    frames = sorted_rows(lab.triple_barrier(bars, width, 1.5, 1.0, h, 0.002))
    monkeypatch.setattr(lab, "FRAME_LIMIT", 0)
    search = sorted_rows(lab.triple_barrier(bars, width, 1.5, 1.0, h, 0.002))
    pd.testing.assert_series_equal(frames["label"], search["label"])


def test_directional(spark):
    df = frame(spark, close=[100.0, 101, 100, 100.05, 90])
    rows = lab.directional(df, 1, 0.001).orderBy("ts").collect()
    assert [r["label"] for r in rows] == [1, -1, 0, -1]


@pytest.mark.parametrize("h", [1, 3, 40])
def test_both_barrier_plans_agree_on_missing_bars(spark, sorted_rows, monkeypatch, h):
    rng = np.random.default_rng(8)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 150)))
    pdf = pd.DataFrame({"symbol": "S", "ts": pd.date_range("2022-01-01", periods=150), "close": close, "high": close * 1.006, "low": close * 0.994, "atr": close * 0.01})
    for c in ("close", "high", "low", "atr"):
        pdf.loc[rng.random(150) < 0.2, c] = np.nan
    pdf.loc[60:75, ["close", "high", "low"]] = np.nan
    df = spark.createDataFrame(pdf)
    df = df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("close", "high", "low", "atr")})
    frames = sorted_rows(lab.triple_barrier(df, "atr", 1.5, 1.0, h, 0.002))
    monkeypatch.setattr(lab, "FRAME_LIMIT", 0)
    search = sorted_rows(lab.triple_barrier(df, "atr", 1.5, 1.0, h, 0.002))
    pd.testing.assert_series_equal(frames["label"], search["label"])
