"""Bar tables built from order, line-item and event tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def bars_from_ticks(
    ticks: DataFrame,
    symbol: str,
    bucket: Column,
    price: Column,
    volume: Column,
    order: Sequence[str | Column],
) -> DataFrame:
    """Open, high, low, close and volume per (symbol, bucket).

    Every aggregate combines before the shuffle, so a hot symbol costs no more
    than one row per bucket and input split.
    """
    place = F.struct(*order)
    return (
        ticks.withColumn("__p", price)
        .groupBy(F.col(symbol).alias("symbol"), bucket.cast("timestamp_ntz").alias("ts"))
        .agg(
            F.min_by("__p", place).alias("open"),
            F.max("__p").alias("high"),
            F.min("__p").alias("low"),
            F.max_by("__p", place).alias("close"),
            volume.cast("double").alias("volume"),
        )
    )


def bars_brand_week(spark: SparkSession, folder: str) -> DataFrame:
    """Weekly unit-price bars per part brand."""
    lines = table(spark, folder, "lineitem").join(
        table(spark, folder, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")
    )
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return bars_from_ticks(
        lines,
        "p_brand",
        F.date_trunc("week", "l_shipdate"),
        price,
        F.sum("l_quantity"),
        ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", price.alias("p")],
    )


def bars_event_hour(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly bars of event values per event type; hours without events are absent."""
    return bars_from_ticks(
        table(spark, folder, "events"),
        "event_type",
        F.date_trunc("hour", "ts"),
        F.col("value"),
        F.count(F.lit(1)),
        ["ts", "event_id"],
    )


def bars_priority_day(spark: SparkSession, folder: str) -> DataFrame:
    """Daily bars of order totals per order priority."""
    return bars_from_ticks(
        table(spark, folder, "orders"),
        "o_orderpriority",
        F.col("o_orderdate"),
        F.col("o_totalprice"),
        F.count(F.lit(1)),
        ["o_orderkey"],
    )
