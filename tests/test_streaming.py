import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators.features import FeatureSpec, LabelSpec, build_features
from tickloom.operators.indicators import add_indicators
from tickloom.operators.models import TrainSpec, fit_model
from tickloom.sources.derived import bars_from_ticks
from tickloom.streaming.bars import closing_tick, stream_bars
from tickloom.streaming.indicators import KeyState, score_indicators, stream_indicators
from tickloom.streaming.scoring import score_latest, score_stream


def test_streamed_bars_equal_batch_bars_and_late_ticks_are_dropped(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    first = pd.DataFrame({"symbol": "S", "ts": pd.date_range("2023-01-01", periods=300, freq="min"), "price": range(300)})
    late = pd.DataFrame({"symbol": "S", "ts": [pd.Timestamp("2023-01-01 00:10"), pd.Timestamp("2023-01-01 06:00")], "price": [9999, 5]})
    schema = "symbol string, ts timestamp, price double"
    spark.createDataFrame(first).selectExpr("symbol", "ts", "double(price) price").write.parquet(source)
    ticks = spark.readStream.schema(schema).parquet(source)

    def run():
        job = stream_bars(ticks, "30 minutes", "10 minutes").writeStream.format("parquet").outputMode("append")
        job.option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()

    run()
    spark.createDataFrame(late).selectExpr("symbol", "ts", "double(price) price").write.mode("append").parquet(source)
    run()
    got = spark.read.parquet(out).toPandas().sort_values("ts", ignore_index=True)
    batch = bars_from_ticks(spark.createDataFrame(first), "symbol", F.window("ts", "30 minutes")["start"], F.col("price").cast("double"), F.count(F.lit(1)), ["ts"])
    want = batch.toPandas().sort_values("ts", ignore_index=True)
    assert len(got) == 10
    assert got["high"].max() < 9999
    pd.testing.assert_frame_equal(got[["open", "high", "low", "close", "volume"]], want[["open", "high", "low", "close", "volume"]])


def test_stream_scores_equal_batch_scores(spark, walk, tmp_path):
    spec = FeatureSpec(momentum=True, label=LabelSpec(method="directional", max_holding_period=5, min_return_threshold=0.01))
    data = spark.createDataFrame(walk[walk["symbol"] != "TINY"])
    model = fit_model(build_features(data, spec), "directional_label", ["roc_5", "roc_10", "roc_20"], TrainSpec("logistic_regression"))
    feed = str(tmp_path / "feed")
    data.coalesce(1).write.parquet(feed)
    stream = spark.readStream.schema(data.schema).parquet(feed)
    paths = [str(tmp_path / p) for p in ("known", "scores", "state")]
    score_stream(stream, paths[0], paths[1], paths[2], model, spec, rows=100, history="2000 days").start().awaitTermination()
    got = spark.read.parquet(paths[1]).toPandas().sort_values("symbol", ignore_index=True)
    want = score_latest(data, model, spec, rows=100).toPandas().sort_values("symbol", ignore_index=True)
    assert len(got) == 2
    pd.testing.assert_frame_equal(got[want.columns], want)


def test_a_closing_tick_lets_the_last_windows_out(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "symbol string, ts timestamp, price double"
    ticks = spark.createDataFrame(pd.DataFrame({"symbol": "S", "ts": pd.date_range("2023-01-01", periods=95, freq="min"), "price": range(95)})).selectExpr("symbol", "ts", "double(price) price")
    ticks.write.parquet(source)
    bars = stream_bars(spark.readStream.schema(schema).parquet(source), "30 minutes", "10 minutes").where("close IS NOT NULL")

    def run():
        job = bars.writeStream.format("parquet").outputMode("append")
        job.option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r["ts"].minute + 60 * r["ts"].hour, r["close"]) for r in spark.read.schema(bars.schema).parquet(out).collect())

    assert run() == [(0, 29.0), (30, 59.0)]
    last = ticks.agg(closing_tick(F.max("ts"), "30 minutes", "10 minutes").alias("ts"))
    last.selectExpr("cast(null as string) symbol", "ts", "cast(null as double) price").write.mode("append").parquet(source)
    assert run() == [(0, 29.0), (30, 59.0), (60, 89.0), (90, 94.0)]


def test_newest_scores_equal_the_batch_table(spark, walk):
    """Averages depend on all bars: the default reads them all."""
    spec = FeatureSpec(momentum=True, indicators=[{"indicator": "ema", "length": 200}], label=LabelSpec(method="directional", max_holding_period=5, min_return_threshold=0.01))
    data = spark.createDataFrame(walk[walk["symbol"] != "TINY"])
    model = fit_model(build_features(data, spec), "directional_label", ["roc_5", "roc_20"], TrainSpec("logistic_regression"))
    got = score_latest(data, model, spec).toPandas().set_index("symbol")
    table = build_features(data, spec.without_label())
    want = model.score(table).toPandas().sort_values("ts").groupby("symbol").last()
    assert len(got) == 2
    for c in ("probability_-1", "probability_1", "confidence"):
        assert (got[c] - want[c]).abs().max() < 1e-12


INDICATORS = [
    {"indicator": "sma", "length": 10},
    {"indicator": "ema", "length": 12},
    {"indicator": "rsi", "length": 14},
    {"indicator": "atr", "length": 14},
    {"indicator": "macd"},
    {"indicator": "bbands", "length": 20},
    {"indicator": "obv"},
]


def test_streamed_indicators_equal_the_batch_table_after_a_restart(spark, walk, tmp_path):
    """Three files, the stream stopped after each; gaps in prices, bars sent again and a late one."""
    bars = walk.copy()
    bars.loc[bars.index % 37 == 5, "close"] = np.nan
    bars = bars[~((bars["symbol"] == "TINY") & bars["close"].isna())]
    schema = spark.createDataFrame(bars).schema
    feed, out, state = (str(tmp_path / p) for p in ("feed", "out", "state"))

    def run(part):
        spark.createDataFrame(part.sample(frac=1, random_state=1), schema).selectExpr(*[f"nullif({c}, double('NaN')) {c}" if c == "close" else c for c in bars.columns]).coalesce(1).write.mode("append").parquet(feed)
        job = stream_indicators(spark.readStream.schema(schema).parquet(feed), INDICATORS).writeStream.format("parquet").outputMode("append")
        job.option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()

    cuts = [pd.Timestamp("2021-05-01"), pd.Timestamp("2022-02-01")]
    run(bars[bars["ts"] < cuts[0]])
    run(bars[(bars["ts"] >= cuts[0] - pd.Timedelta(days=3)) & (bars["ts"] < cuts[1])])
    run(pd.concat([bars[bars["ts"] >= cuts[1]], bars[bars["ts"] < cuts[0]].tail(1)]))
    plain = spark.createDataFrame(bars).withColumn("close", F.when(~F.isnan("close"), F.col("close")))
    want = add_indicators(plain, INDICATORS).toPandas().sort_values(["symbol", "ts"], ignore_index=True)
    got = spark.read.parquet(out).toPandas().sort_values(["symbol", "ts"], ignore_index=True)
    assert len(got) == len(bars)
    # A key that stays short has no values in the batch table.
    want, got = (x[x["symbol"] != "TINY"].reset_index(drop=True) for x in (want, got))
    for c in got.columns[len(bars.columns) :]:
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9, atol=1e-9, err_msg=c)


def test_a_state_does_not_grow():
    state = KeyState(INDICATORS)
    sizes = []
    for i in range(400):
        state = KeyState(INDICATORS, state.kept())
        state.add(i, 2.0 + i % 3, 1.0, 1.5 + i % 2, 10.0)
        sizes.append(len(state.closes))
    assert max(sizes) == 21 and len(state.kept()) < 2000


def test_scores_from_states(spark, walk, tmp_path):
    data = spark.createDataFrame(walk[walk["symbol"] != "TINY"])
    wanted = [{"indicator": "ema", "length": 12}, {"indicator": "rsi", "length": 14}]
    table = add_indicators(data, wanted).na.drop().withColumn("y", (F.col("rsi_length14") > 50).cast("int"))
    model = fit_model(table, "y", ["ema_length12", "rsi_length14"], TrainSpec("logistic_regression"))
    feed = str(tmp_path / "feed")
    data.coalesce(1).write.parquet(feed)
    score_indicators(spark.readStream.schema(data.schema).parquet(feed), str(tmp_path / "out"), str(tmp_path / "state"), model, wanted).start().awaitTermination()
    got = {r.symbol: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    last = model.score(table).toPandas().sort_values("ts").groupby("symbol").last()
    assert set(got) == {"HOT", "MID"}
    for s, r in got.items():
        assert r.probability_1 == pytest.approx(last.loc[s, "probability_1"], abs=1e-9)
