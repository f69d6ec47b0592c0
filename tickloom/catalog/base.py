"""Registry of queries with their SQL, and SQL text for the shared bar tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tickloom.plans.series import index_series
from tickloom.sources import derived

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


_OHLC = (
    "first({p} ORDER BY {o}) AS open, max({p}) AS high, min({p}) AS low, "
    "last({p} ORDER BY {o}) AS close"
)
_PRICE = "l_extendedprice/l_quantity"

BARS = {
    "brand": "SELECT p_brand AS symbol, date_trunc('week', l_shipdate)::TIMESTAMP AS ts, "
    + _OHLC.format(p=_PRICE, o=f"l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, {_PRICE}")
    + ", sum(l_quantity)::DOUBLE AS volume FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2",
    "event": "SELECT event_type AS symbol, date_trunc('hour', ts)::TIMESTAMP AS ts, "
    + _OHLC.format(p="value", o="ts, event_id")
    + ", count(*)::DOUBLE AS volume FROM events GROUP BY event_type, date_trunc('hour', ts)",
    "priority": "SELECT o_orderpriority AS symbol, o_orderdate::TIMESTAMP AS ts, "
    + _OHLC.format(p="o_totalprice", o="o_orderkey")
    + ", count(*)::DOUBLE AS volume FROM orders GROUP BY 1, 2",
}

_BUILDERS = {
    "brand": derived.bars_brand_week,
    "event": derived.bars_event_hour,
    "priority": derived.bars_priority_day,
}


def bars(spark: SparkSession, folder: str, which: str = "brand") -> DataFrame:
    return _BUILDERS[which](spark, folder)


def indexed(spark: SparkSession, folder: str, which: str = "brand") -> DataFrame:
    return index_series(bars(spark, folder, which))


def with_bars(which: str = "brand", recursive: bool = False) -> str:
    """WITH clause defining `bars` and `ix` (bars with rn and n_rows); add CTEs after a comma."""
    return (
        f"WITH {'RECURSIVE ' if recursive else ''}bars AS MATERIALIZED ({BARS[which]}), "
        "ix AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS rn, "
        "count(*) OVER (PARTITION BY symbol) AS n_rows FROM bars)"
    )


def r(expr: str, alias: str | None = None, digits: int = 6) -> str:
    """SQL rounding that matches `rounded`."""
    return f"round({expr}, {digits}) + 0.0 AS {alias or expr}"


def rs(*names: str, digits: int = 6) -> str:
    return ", ".join(r(n, digits=digits) for n in names)


OHLCV_RAW = "open, high, low, close, volume"
