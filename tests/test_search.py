import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.plans.search import chain, first_exit


def walk_forward(c, i, d, e, stop, target, act, trail, last):
    """The bar-by-bar rule the search must reproduce."""
    live, best, mfe, mae = False, None, 0.0, 0.0
    for j in range(i + 1, len(c)):
        pnl = d * (c[j] - e) / e
        mfe, mae = max(mfe, pnl), min(mae, pnl)
        if trail is not None:
            if not live and pnl >= act:
                live, best = True, c[j]
            elif live:
                best = max(best, c[j]) if d == 1 else min(best, c[j])
        if stop is not None and d * (c[j] - stop) <= 0:
            return j, stop, "Stop Loss", mfe, mae
        if live and d * (c[j] - best * (1 - d * trail)) <= 0:
            return j, best * (1 - d * trail), "Trailing Stop", mfe, mae
        if target is not None and d * (c[j] - target) >= 0:
            return j, target, "Take Profit", mfe, mae
        if last is not None and j >= last:
            return j, c[j], "Time Limit", mfe, mae
    return None, None, None, mfe, mae


@pytest.mark.parametrize("radix", [3, 8, 128])
@pytest.mark.parametrize("rules", ["levels", "trailing", "far", "limit"])
def test_first_exit_equals_the_walk(spark, walk, bars, radix, rules):
    rng = np.random.default_rng(3)
    entries, want = [], {}
    for symbol, part in walk.groupby("symbol"):
        c = part["close"].to_numpy()
        for i in rng.choice(len(c), size=min(len(c), 40), replace=False):
            d, e = int(rng.choice([1, -1])), float(c[i])
            wide = {"levels": 0.03, "trailing": 0.15, "far": 0.6, "limit": 0.3}[rules]
            stop = None if rules == "far" and i % 2 else e * (1 - d * wide)
            target = e * (1 + d * wide * 1.5) if rules != "trailing" else None
            act, trail = (0.01, 0.04) if rules in ("trailing", "far") and i % 3 else (None, None)
            last = int(min(i + 90, len(c) - 1)) if rules == "limit" else None
            entries.append((symbol, len(c), int(i), d, e, stop, target, act, trail, last))
            want[symbol, int(i)] = walk_forward(c, i, d, e, stop, target, act, trail, last)
    schema = "symbol string, n_rows bigint, entry_rn bigint, direction int, entry_price double, stop double, target double, activation double, trail double, last_rn bigint"
    got = first_exit(spark.createDataFrame(entries, schema), bars, radix=radix).collect()
    assert len(got) == len(want)
    for row in got:
        rn, price, why, mfe, mae = want[row["symbol"], row["entry_rn"]]
        assert (row["exit_rn"], row["exit_reason"]) == (rn, why)
        assert row["exit_price"] == (price if price is None else pytest.approx(price))
        assert (row["mfe"], row["mae"]) == (pytest.approx(mfe), pytest.approx(mae))


@pytest.mark.parametrize("chunk", [5, 64, 1 << 20])
def test_chain_takes_the_next_free_entry(spark, chunk):
    rng = np.random.default_rng(5)
    rows, want = [], set()
    for key, n in (("a", 400), ("b", 3), ("c", 90)):
        pos = np.sort(rng.choice(2000, size=n, replace=False))
        free = pos + 1 + rng.integers(0, 60, n) ** 2 // 20
        rows += [(key, int(p), int(f)) for p, f in zip(pos, free)]
        state = 0
        for p, f in zip(pos, free):
            if p >= state:
                want.add((key, int(p)))
                state = f
    df = spark.createDataFrame(rows, "symbol string, pos bigint, until bigint")
    got = chain(df, "pos", "until", chunk_rows=chunk)
    assert {(r["symbol"], r["pos"]) for r in got.collect()} == want


def test_chain_without_entries(spark):
    empty = spark.createDataFrame([], "symbol string, pos bigint, until bigint")
    assert chain(empty, "pos", "until").count() == 0


def test_entry_on_the_last_bar_stays_open(spark, bars, walk):
    n = int((walk["symbol"] == "MID").sum())
    entry = spark.range(1).select(
        F.lit("MID").alias("symbol"), F.lit(n).cast("bigint").alias("n_rows"), F.lit(n - 1).cast("bigint").alias("entry_rn"), F.lit(1).alias("direction"),
        F.lit(100.0).alias("entry_price"), *[F.lit(None).cast("double").alias(c) for c in ("stop", "target", "activation", "trail")],
        F.lit(None).cast("bigint").alias("last_rn"),
    )
    row = first_exit(entry, bars).collect()[0]
    assert row["exit_rn"] is None and row["mfe"] == 0.0


@pytest.mark.parametrize("chunk", [40, 700])
def test_chain_over_one_hot_key(spark, chunk):
    """One key has nine tenths of all entries, spread over many chunks, some of them empty."""
    rng = np.random.default_rng(9)
    rows, want = [], set()
    for key, n in [("hot", 4000), *[(f"k{i}", 20) for i in range(22)]]:
        pos = np.sort(rng.choice(np.r_[0:9000, 15000:40000], size=n, replace=False))
        free = pos + 1 + np.where(rng.random(n) < 0.02, rng.integers(0, 3000, n), rng.integers(0, 20, n))
        rows += [(key, int(p), int(f)) for p, f in zip(pos, free)]
        state = 0
        for p, f in zip(pos, free):
            if p >= state:
                want.add((key, int(p)))
                state = f
    got = chain(spark.createDataFrame(rows, "symbol string, pos bigint, until bigint"), "pos", "until", chunk_rows=chunk)
    assert {(r["symbol"], r["pos"]) for r in got.collect()} == want
