"""Scores for the newest bar of each key, in batch or per micro-batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tickloom.functions.columns import quoted
from tickloom.operators.features import FeatureSpec, build_features
from tickloom.operators.models import TrainedModel
from tickloom.plans.series import KEYS, N_ROWS, RN, TS, index_series
from tickloom.plans.storage import cut


def recent_bars(bars: DataFrame, rows: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """The last `rows` bars of each key."""
    return index_series(bars, keys).filter(F.col(RN) >= F.col(N_ROWS) - rows).drop(RN, N_ROWS)


def score_latest(bars: DataFrame, trained: TrainedModel, spec: FeatureSpec, rows: int | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Probabilities, decision and confidence for the last bar of each key.

    Averages and running sums depend on all earlier bars, so all are read; `rows`
    starts them anew that many bars back, where that is good enough.
    """
    table = build_features(bars if rows is None else recent_bars(bars, rows, keys), spec.without_label(), keys)
    last = table.groupBy(*keys).agg(F.max(TS).alias(TS))
    scored = trained.score(table.join(last, [*keys, TS], "left_semi"))
    return scored.select(*keys, TS, *[quoted(f"probability_{c}") for c in trained.classes], "prediction", "confidence")


def score_stream(
    stream: DataFrame,
    bar_path: str,
    out_path: str,
    checkpoint: str,
    trained: TrainedModel,
    spec: FeatureSpec,
    rows: int | None = None,
    history: str | None = None,
    keys: Sequence[str] = KEYS,
    interval: str | None = None,
) -> DataStreamWriter:
    """Writer that keeps each micro-batch's bars and scores the keys that got one.

    Both writes go to a folder named after the batch id and replace it, so a
    batch that is run again after a failure leaves the same result. Of the bars
    kept, those of the batch's keys are read back; `history`, such as "400 days",
    leaves out older ones, and `rows` all but the last ones of a key.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = cut(batch)
        if fresh.isEmpty():
            return
        fresh.write.mode("overwrite").parquet(f"{bar_path}/batch_id={batch_id}")
        # A batch that is replayed must not see bars of later batches.
        known = spark.read.parquet(bar_path).filter(F.col("batch_id") <= batch_id)
        if history is not None:
            oldest = fresh.agg((F.min(TS) - F.expr(f"INTERVAL {history}")).alias("t")).collect()[0]["t"]
            known = known.filter(F.col(TS) >= F.lit(oldest))
        known = known.join(fresh.select(*keys).distinct(), list(keys), "left_semi")
        # A bar sent again replaces its earlier version.
        rest = [c for c in known.columns if c not in {*keys, TS, "batch_id"}]
        unique = known.groupBy(*keys, TS).agg(*[F.max_by(c, "batch_id").alias(c) for c in rest])
        score_latest(unique, trained, spec, rows, keys).write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
