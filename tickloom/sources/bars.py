"""Readers for landed bar files and the column layouts vendors use."""

from __future__ import annotations

import re
from collections.abc import Sequence
from enum import Enum

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.columns import OHLCV, quoted, require


class Vendor(str, Enum):
    YAHOO = "yahoo"
    ALPHA_VANTAGE = "alpha_vantage"
    CSV = "csv"
    CRYPTO = "crypto"
    DATAREADER = "datareader"


def time_range(df: DataFrame, start=None, end=None, ts: str = "ts") -> DataFrame:
    """Keep start <= ts <= end; plain comparisons, so the scan can use them."""
    if start is not None:
        df = df.filter(F.col(ts) >= F.lit(start).cast(df.schema[ts].dataType))
    if end is not None:
        df = df.filter(F.col(ts) <= F.lit(end).cast(df.schema[ts].dataType))
    return df


def read_csv_bars(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: str,
    start=None,
    end=None,
    date_column: str = "date",
    date_format: str | None = None,
    symbol_from_path: str | None = None,
) -> DataFrame:
    """Bars from CSV with an explicit schema.

    Names are lower-cased, `date_column` becomes `ts`, and `symbol_from_path`
    is a regular expression whose first group is the symbol when the files
    have no symbol column. A bad row or a missing price column raises.
    """
    raw = spark.read.schema(schema).options(header=True, mode="FAILFAST").csv(path)
    df = raw.toDF(*[c.lower() for c in raw.columns])
    require(df, date_column.lower(), "open", "high", "low", "close")
    when = quoted(date_column.lower())
    parsed = F.to_timestamp_ntz(when, F.lit(date_format)) if date_format else F.to_timestamp_ntz(when)
    df = df.withColumn("ts", parsed if dict(df.dtypes)[date_column.lower()] == "string" else F.col(when).cast("timestamp_ntz"))
    if date_column.lower() != "ts":
        df = df.drop(date_column.lower())
    if symbol_from_path:
        df = df.withColumn("symbol", F.regexp_extract(F.input_file_name(), symbol_from_path, 1))
    return time_range(df, start, end)


def _rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(quoted(c)).alias(names.get(c, c)) for c in df.columns])


def normalize_vendor_bars(df: DataFrame, vendor: Vendor | str, adjust: bool = True) -> DataFrame:
    """Bring one vendor's columns to lower-case open, high, low, close, volume."""
    vendor = Vendor(vendor)
    if vendor is Vendor.ALPHA_VANTAGE:
        # "1. open" -> "open"
        return _rename(df, {c: m.group(1).lower() for c in df.columns if (m := re.match(r"^\d+\. (\w+)", c))})
    df = df.toDF(*[c.lower() for c in df.columns])
    if vendor is Vendor.YAHOO and "adj close" in df.columns:
        if not adjust and "close" in df.columns:
            return df.drop("adj close")
        # Without a plain close the adjusted one is all there is.
        return _rename(df.drop("close"), {"adj close": "close"})
    if vendor is Vendor.DATAREADER:
        return _rename(df, {"adj close": "adj_close", "adj. close": "adj_close", "last": "close", "value": "close"})
    return df


def flatten_wide_header(df: DataFrame, separator: str = "|") -> DataFrame:
    """Keep the first level of two-level column names such as ``Close|AAPL``."""
    return df.toDF(*[c.split(separator)[0] for c in df.columns])


def explode_ohlcv_json(df: DataFrame, payload: str | Column = "payload", end=None) -> DataFrame:
    """Rows from JSON arrays ``[[epoch_ms, open, high, low, close, volume], …]``."""
    payload = F.col(payload) if isinstance(payload, str) else payload
    rows = df.withColumn("__bar", F.explode(F.from_json(payload, "array<array<double>>")))
    kept = [c for c in df.columns if c != "payload"]
    ms = F.element_at("__bar", 1).cast("bigint")
    # Epoch milliseconds are UTC whatever the session's zone is.
    ts = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")) + F.make_dt_interval(secs=(ms / 1000).cast("decimal(18,6)"))
    out = rows.select(*kept, ts.alias("ts"), *[F.element_at("__bar", i + 2).alias(c) for i, c in enumerate(OHLCV)])
    return time_range(out, None, end)


def load_bars(
    spark: SparkSession,
    path: str | Sequence[str],
    vendor: Vendor | str = Vendor.CSV,
    fmt: str = "parquet",
    symbols: Sequence[str] | None = None,
    start=None,
    end=None,
    adjust: bool = True,
    schema: str | None = None,
) -> DataFrame:
    """Read landed files of one vendor; symbol and time filters reach the scan."""
    vendor = Vendor(vendor)
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.format(fmt).load(path)
    if vendor is Vendor.CRYPTO:
        df = explode_ohlcv_json(df.filter(F.col("symbol").isin(list(symbols))) if symbols else df)
        return time_range(df, start, end)
    df = normalize_vendor_bars(df, vendor, adjust)
    if symbols:
        df = df.filter(F.col("symbol").isin(list(symbols)))
    return time_range(df, start, end)


def panel(df: DataFrame, symbols: Sequence[str], column: str = "close") -> DataFrame:
    """One row per time, one column per symbol; symbols without rows are NULL columns."""
    require(df, column)
    wanted = df.filter(F.col("symbol").isin(list(symbols)))
    cells = [F.max(F.when(F.col("symbol") == s, F.col(column))).alias(s) for s in symbols]
    return wanted.groupBy("ts").agg(*cells)
