import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.plans import series
from tickloom.plans.series import Ewm


def test_index_numbers_every_row_per_symbol(bars, sorted_rows):
    got = sorted_rows(bars)
    for _, part in got.groupby("symbol"):
        assert part["rn"].tolist() == list(range(len(part)))
        assert (part["n_rows"] == len(part)).all()


@pytest.mark.parametrize("hours", [1, 24, 24 * 365])
def test_index_does_not_depend_on_the_slice_length(spark, walk, sorted_rows, hours):
    got = sorted_rows(series.index_series(spark.createDataFrame(walk), slice_hours=hours))
    assert (got["rn"] == got.groupby("symbol").cumcount()).all()


@pytest.mark.parametrize("chunk", [16, 100, 100_000])
def test_bounded_frames_do_not_depend_on_the_chunk_size(bars, walk, sorted_rows, chunk):
    out = series.over_chunks(
        bars, lambda d, w: d.withColumn("m", F.sum("close").over(w.rowsBetween(-12, 3))), back=12, ahead=3, chunk_rows=chunk
    )
    got = sorted_rows(out)
    want = pd.concat(
        pd.Series([c.iloc[max(0, i - 12) : i + 4].sum() for i in range(len(c))]) for _, c in walk.groupby("symbol")["close"]
    )
    assert len(got) == len(walk)
    np.testing.assert_allclose(got["m"], want)


@pytest.mark.parametrize("chunk", [7, 64, 100_000])
def test_running_aggregates_carry_across_chunks(bars, walk, sorted_rows, chunk):
    high = F.when(F.col("close") > 105, F.col("close"))
    specs = {"s": ("sum", "close"), "m": ("max", "close"), "n": ("min", "close"), "c": ("count", high), "l": ("last", high)}
    got = sorted_rows(series.running(bars, specs, chunk_rows=chunk))
    close = walk.groupby("symbol")["close"]
    marked = walk.assign(x=walk["close"].where(walk["close"] > 105)).groupby("symbol")["x"]
    np.testing.assert_allclose(got["s"], close.cumsum())
    np.testing.assert_allclose(got["m"], close.cummax())
    np.testing.assert_allclose(got["n"], close.cummin())
    np.testing.assert_allclose(got["l"], marked.ffill())
    assert got["c"].tolist() == marked.transform(lambda x: x.notna().cumsum()).astype(int).tolist()


def test_running_backwards(bars, walk, sorted_rows):
    got = sorted_rows(series.running(bars, {"s": ("sum", "volume")}, chunk_rows=50, reverse=True))
    want = walk.groupby("symbol")["volume"].transform(lambda x: x[::-1].cumsum()[::-1])
    np.testing.assert_allclose(got["s"], want)


@pytest.mark.parametrize("chunk", [10, 33, 100_000])
def test_exponential_average_equals_the_recursion(bars, walk, sorted_rows, chunk):
    specs = {"a": Ewm.span("close", 50), "b": Ewm.span("close", 2), "c": Ewm.wilder("close", 14), "d": Ewm("close", 1.0)}
    got = sorted_rows(series.ewm(bars, specs, chunk_rows=chunk))
    close = walk.groupby("symbol")["close"]
    for name, alpha, least in (("a", 2 / 51, 50), ("b", 2 / 3, 2), ("c", 1 / 14, 14), ("d", 1.0, 1)):
        want = close.transform(lambda x: x.ewm(alpha=alpha, adjust=False, min_periods=least).mean())
        np.testing.assert_allclose(got[name], want, rtol=1e-12)


def test_exponential_average_starts_at_its_seed(bars, walk, sorted_rows):
    later = bars.withColumn("x", F.when(F.col("rn") >= 5, F.col("close")))
    got = sorted_rows(series.ewm(later, {"a": Ewm("x", 0.2, 3, seed=5)}, chunk_rows=4))
    masked = walk["close"].where(walk.groupby("symbol").cumcount() >= 5)
    want = masked.groupby(walk["symbol"]).transform(lambda x: x.ewm(alpha=0.2, adjust=False, min_periods=3).mean())
    np.testing.assert_allclose(got["a"], want, rtol=1e-12)


@pytest.mark.parametrize("chunk", [3, 10, 33, 100_000])
def test_exponential_average_carries_over_gaps(spark, sorted_rows, chunk):
    rng = np.random.default_rng(3)
    parts = []
    for symbol, share in (("FEW", 0.9), ("HALF", 0.5), ("SOME", 0.1), ("NONE", 1.0)):
        x = rng.normal(100, 5, 400)
        x[rng.random(400) < share] = np.nan
        x[60:160] = np.nan
        parts.append(pd.DataFrame({"symbol": symbol, "ts": pd.date_range("2022-01-01", periods=400), "rn": range(400), "n_rows": 400, "x": x}))
    pdf = pd.concat(parts, ignore_index=True)
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    specs = {"a": Ewm.span("x", 3), "b": Ewm("x", 0.01, 5), "c": Ewm.wilder("x", 14), "d": Ewm("x", 1.0), "e": Ewm("x", 0.9, 2, seed=50)}
    got = sorted_rows(series.ewm(df, specs, chunk_rows=chunk))
    pdf = pdf.sort_values(["symbol", "ts"], ignore_index=True)
    later = pdf["x"].where(pdf["rn"] >= 50)
    for name, alpha, least, x in (("a", 0.5, 3, pdf["x"]), ("b", 0.01, 5, pdf["x"]), ("c", 1 / 14, 14, pdf["x"]), ("d", 1.0, 1, pdf["x"]), ("e", 0.9, 2, later)):
        want = x.groupby(pdf["symbol"]).transform(lambda v: v.ewm(alpha=alpha, adjust=False, min_periods=least).mean())  # noqa: B023
        np.testing.assert_allclose(got[name].astype(float), want, rtol=1e-11, err_msg=name)


def test_average_of_a_long_flat_stretch_keeps_decaying(spark):
    n = 4000
    pdf = pd.DataFrame({"symbol": "X", "rn": range(n), "n_rows": n, "x": [1.0] + [0.0] * (n - 1)})
    got = series.ewm(spark.createDataFrame(pdf), {"y": Ewm("x", 0.1)}, chunk_rows=500).toPandas().sort_values("rn")
    want = 0.9 ** np.arange(n)
    np.testing.assert_allclose(got["y"], want, rtol=1e-9)


@pytest.mark.parametrize("values", [[1.0], [2.0, 1.0], [5.0] * 40 + [1.0, 9.0], None])
def test_quantiles_are_exact(spark, values):
    rng = np.random.default_rng(1)
    values = values if values is not None else np.concatenate([rng.lognormal(0, 3, 20_000), np.zeros(8_000)])
    df = spark.createDataFrame(pd.DataFrame({"symbol": "S", "x": values}))
    probs = {f"q{i}": ("x", p) for i, p in enumerate((0.0, 0.05, 0.25, 0.5, 0.8, 0.999, 1.0))}
    got = series.quantiles(df, probs).toPandas().iloc[0]
    for name, (_, p) in probs.items():
        assert got[name] == pytest.approx(np.quantile(values, p), rel=1e-12)


def test_quantiles_of_all_rows_without_keys(spark):
    df = spark.createDataFrame([(float(i), None if i % 2 else float(i)) for i in range(11)], "a double, b double")
    got = series.quantiles(df, {"a": ("a", 0.5), "b": ("b", 0.5)}, keys=()).collect()
    assert [tuple(r) for r in got] == [(5.0, 5.0)]


def test_join_on_keys_spreads_a_hot_key(bars, walk):
    small = bars.groupBy("symbol").agg(F.avg("close").alias("mean"))
    joined = series.join_on_keys(bars, small, salts=8)
    assert joined.count() == len(walk)
    assert joined.filter("mean IS NULL").count() == 0
