import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.functions.columns import clean_name, clean_names
from tickloom.operators import clean
from tickloom.sources import bars as readers


@pytest.fixture(scope="module")
def ten_days(spark):
    rows = [("S", dt.datetime(2023, 1, 1) + dt.timedelta(days=i), 100.0 + i, 101.5 + i, 98.5 + i, 100.2 + i, 1000.0 + 10 * i) for i in range(10)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")


def test_weekly_resample_ends_on_sunday(ten_days):
    rows = clean.resample(ten_days, "week").orderBy("ts").collect()
    assert [r["ts"].day for r in rows] == [1, 8, 15]
    got = [(r["open"], r["high"], r["low"], r["close"], r["volume"]) for r in rows]
    assert got == [(100, 101.5, 98.5, 100.2, 1000), (101, 108.5, 99.5, 107.2, 7280), (108, 110.5, 106.5, 109.2, 2170)]


def test_resample_falls_back_to_close(ten_days):
    rows = clean.resample(ten_days.select("symbol", "ts", "close"), "week").orderBy("ts").collect()
    assert [(r["high"], r["low"]) for r in rows[1:]] == [(107.2, 101.2), (109.2, 108.2)]
    with pytest.raises(ValueError):
        clean.resample(ten_days.select("symbol", "ts", "volume"), "week")


def test_empty_bins_have_no_prices_and_no_volume(ten_days):
    gap = ten_days.filter(~F.dayofmonth("ts").isin(4, 5))
    rows = {r["ts"].day: r for r in clean.resample(gap, "day").collect()}
    assert sorted(rows) == list(range(1, 11))
    assert rows[4]["open"] is None and rows[4]["volume"] == 0.0


def test_bins_shorter_than_a_day(ten_days):
    rows = clean.resample(ten_days.limit(2), "6 hours").orderBy("ts").collect()
    assert [r["ts"].hour for r in rows] == [0, 6, 12, 18, 0]


@pytest.fixture(scope="module")
def spiky(spark):
    a = [10, 11, 12, 10, 11, 13, 9, 100, 11, 12]
    b = [20, 21, 19, 22, 20, -50, 21, 20, 18, 22]
    rows = [("S", dt.datetime(2023, 1, 1) + dt.timedelta(days=i), float(x), float(y), 5.0, "a") for i, (x, y) in enumerate(zip(a, b))]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, value1 double, value2 double, constant double, string string")


def flagged(df, column):
    return [r["ts"].day for r in df.filter(clean.mask_name(column)).orderBy("ts").collect()]


@pytest.mark.parametrize("method,threshold", [("zscore", 2.0), ("iqr", 1.5)])
def test_outlier_masks(spiky, method, threshold):
    out = clean.detect_outliers(spiky, ["value1", "value2", "constant", "string"], method, threshold)
    assert flagged(out, "value1") == [8] and flagged(out, "value2") == [6]
    assert flagged(out, "constant") == [] and flagged(out, "string") == []


def test_percentile_mask(spiky):
    out = clean.detect_outliers(spiky, ["value1", "value2"], "percentile", 10)
    assert flagged(out, "value1") == [7, 8] and 6 in flagged(out, "value2")


def test_unknown_methods_raise(spiky):
    with pytest.raises(ValueError):
        clean.detect_outliers(spiky, ["value1"], "nope")
    with pytest.raises(ValueError):
        clean.handle_outliers(spiky, "nope")


@pytest.mark.parametrize(
    "method,options,first,second",
    [
        ("clip", {}, 13.0, 18.0),
        ("clip", {"min_val": 0, "max_val": 50}, 50.0, 0.0),
        ("fillna", {"fill": "interpolate"}, 10.0, 20.5),
        ("fillna", {"fill": "ffill"}, 9.0, 20.0),
        ("fillna", {"fill": "bfill"}, 11.0, 21.0),
        ("fillna", {"fill": "median"}, 11.0, 20.0),
    ],
)
def test_outlier_treatment(spiky, method, options, first, second):
    masked = clean.detect_outliers(spiky, ["value1", "value2"], "zscore", 2.0)
    rows = {r["ts"].day: r for r in clean.handle_outliers(masked, method, **options).collect()}
    assert rows[8]["value1"] == first and rows[6]["value2"] == second


def test_remove_outliers(spiky):
    assert clean.handle_outliers(clean.detect_outliers(spiky, ["value1", "value2"], "zscore", 2.0), "remove").count() == 8


def test_interpolation_leaves_leading_gaps(spark):
    rows = [("S", dt.datetime(2023, 1, i + 1), x) for i, x in enumerate([None, 1.0, None, None, 4.0, None])]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, x double")
    assert [r["x"] for r in clean.interpolate(df, ["x"]).orderBy("ts").collect()] == [None, 1.0, 2.0, 3.0, 4.0, 4.0]


def aligned(spark):
    def frame(name, start, values):
        rows = [(dt.datetime(2023, 1, start + i), v) for i, v in enumerate(values)]
        return spark.createDataFrame(rows, f"ts timestamp_ntz, {name} int")

    return frame("A", 1, range(5)), frame("B", 3, range(10, 15)), frame("C", 2, range(20, 24))


@pytest.mark.parametrize("how,days", [("inner", [3, 4, 5]), ("outer", list(range(1, 8))), ("left", list(range(1, 6))), ("right", [2, 3, 4, 5])])
def test_alignment(spark, how, days):
    out = clean.align(aligned(spark), how, on=["ts"])
    frames = [{r["ts"].day: r[1] for r in f.collect()} for f in out]
    assert all(sorted(f) == days for f in frames)
    if how == "inner":
        assert [f[3] for f in frames] == [2, 10, 21]
    if how == "outer":
        assert frames[1][7] == 14 and frames[0][7] is None


def test_fill_and_preprocess(spark):
    rows = [("S", dt.datetime(2023, 1, i + 1), c, v) for i, (c, v) in enumerate([(None, 1.0), ("10", None), ("bad", 3.0), (None, 4.0), ("12.5", 5.0)])]
    df = spark.createDataFrame(rows, "Symbol string, TS timestamp_ntz, Close string, Volume double")
    got = [(r["close"], r["volume"]) for r in clean.preprocess(df).orderBy("ts").collect()]
    assert got == [(10.0, 1.0), (12.5, 5.0)]


def test_two_level_columns(spark):
    rows = [(dt.datetime(2023, 1, 1), 150.0, 300.0, 10000.0)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, `Close|AAPL` double, `Close|MSFT` double, `Volume|MSFT` double")
    row = clean.extract_ticker(df, "MSFT").collect()[0]
    assert (row["close"], row["volume"]) == (300.0, 10000.0)
    flipped = df.toDF("ts", "AAPL|Close", "MSFT|Close", "MSFT|Volume")
    assert clean.extract_ticker(flipped, "AAPL").collect()[0]["close"] == 150.0
    with pytest.raises(ValueError):
        clean.extract_ticker(df, "TSLA")


def test_asof_join_is_backward_and_inclusive(spark):
    day = lambda d: dt.datetime(2023, 1, d)
    left = spark.createDataFrame([("S", day(1), 1), ("S", day(5), 5), ("T", day(5), 6)], "symbol string, ts timestamp_ntz, a int")
    right = spark.createDataFrame([("S", day(2), 20), ("S", day(5), 50), ("S", day(6), 60)], "symbol string, ts timestamp_ntz, b int")
    got = {(r["symbol"], r["ts"].day): r["b"] for r in clean.asof_join(left, right, ["b"]).collect()}
    assert got == {("S", 1): None, ("S", 5): 50, ("T", 5): None}


def test_reindex_uses_equal_times_only(spark):
    day = lambda d: dt.datetime(2023, 1, d)
    spine = spark.createDataFrame([("S", day(d)) for d in (1, 3, 4)], "symbol string, ts timestamp_ntz")
    source = spark.createDataFrame([("S", day(2), 2.0), ("S", day(3), 3.0)], "symbol string, ts timestamp_ntz, x double")
    out = clean.reindex_ffill(spine, source, ["x"], {"x": 0.5}).orderBy("ts").collect()
    assert [r["x"] for r in out] == [0.5, 3.0, 3.0]


def test_clean_names(spark):
    assert clean_name("Close (USD) %.x") == "Close_USD_x"
    with pytest.raises(ValueError):
        clean_names(spark.createDataFrame([(1, 2)], "`a b` int, `a.b` int"))


def test_readers(spark, tmp_path):
    path = tmp_path / "AAPL.csv"
    path.write_text("Date,Open,High,Low,Close,Volume\n2023-01-02,1,2,0.5,1.5,10\n2023-01-01,1,2,0.5,1.2,20\n2023-02-01,1,2,0.5,1.1,30\n")
    schema = "Date string, Open double, High double, Low double, Close double, Volume double"
    out = readers.read_csv_bars(spark, str(path), schema, "2023-01-01", "2023-01-31", symbol_from_path=r"([A-Z]+)\.csv")
    assert sorted((r["symbol"], r["close"]) for r in out.collect()) == [("AAPL", 1.2), ("AAPL", 1.5)]
    raw = spark.createDataFrame([(1.0, 2.0, 3.0)], "Close double, `Adj Close` double, Volume double")
    assert readers.normalize_vendor_bars(raw, "yahoo").collect()[0]["close"] == 2.0
    assert readers.normalize_vendor_bars(raw, "yahoo", adjust=False).columns == ["close", "volume"]
    with pytest.raises(ValueError):
        readers.normalize_vendor_bars(raw, "other")


def test_panel_keeps_missing_symbols_as_empty_columns(spark):
    df = spark.createDataFrame(pd.DataFrame({"symbol": ["A", "B"], "ts": pd.to_datetime(["2023-01-01", "2023-01-02"]), "close": [1.0, 2.0]}))
    rows = readers.panel(df, ["A", "B", "C"]).orderBy("ts").collect()
    assert [(r["A"], r["B"], r["C"]) for r in rows] == [(1.0, None, None), (None, 2.0, None)]


def test_sinks_flatten_for_csv(spark, tmp_path):
    from tickloom.sources.sinks import write_table

    df = spark.sql("SELECT 'S' AS symbol, array('a', 'b') AS tags, map('k', 1) AS reasons")
    write_table(df, str(tmp_path / "out"), "csv", run_id="r1")
    row = spark.read.option("header", True).csv(str(tmp_path / "out")).collect()[0]
    assert (row["tags"], row["reasons"], row["run_id"]) == ("a,b", '{"k":1}', "r1")


def test_columns_with_dots(spark):
    rows = [("S", dt.datetime(2023, 1, 1) + dt.timedelta(days=i), v) for i, v in enumerate([1.0, None, 1.2, 0.9, 1.1, 40.0, None, 1.0])]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, `a.b` double")
    filled = clean.fill_nulls(clean.fill_nulls(df, "ffill"), "zero")
    assert filled.filter("`a.b` IS NULL").count() == 0
    for method in ("winsorize", "clip", "remove"):
        masked = clean.detect_outliers(filled, ["a.b"], "zscore", 1.5)
        assert clean.handle_outliers(masked, method).agg({"`a.b`": "max"}).collect()[0][0] < 40
    assert clean.interpolate(df, ["a.b"]).filter("`a.b` IS NULL").count() == 0


@pytest.mark.parametrize("rule", ["7 hours", "50 minutes", "36 hours", "90 seconds"])
def test_bins_that_do_not_divide_a_day(spark, rule):
    step = pd.Timedelta(rule)
    ts = pd.to_datetime(["2023-01-30 05:10:03", "2023-01-30 23:59:59", "2023-02-02 11:00:00", "2023-02-03 00:00:00"])
    df = spark.createDataFrame(pd.DataFrame({"symbol": ["A", "A", "A", "B"], "ts": ts, "close": [1.0, 2.0, 3.0, 4.0], "volume": [1.0, 1.0, 1.0, 1.0]}))
    got = clean.resample(df, rule).toPandas().sort_values(["symbol", "ts"], ignore_index=True)
    floor = ts.floor(step)
    want = list(pd.date_range(floor[0], floor[2], freq=step))
    assert got[got["symbol"] == "A"]["ts"].tolist() == want
    assert got[got["symbol"] == "B"]["ts"].tolist() == [floor[3]]
    filled = got[got["symbol"] == "A"].set_index("ts")["close"]
    assert filled.dropna().to_dict() == {t: c for t, c in zip(floor[:3], (1.0, 2.0, 3.0))}
