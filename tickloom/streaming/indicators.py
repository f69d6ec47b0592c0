"""Indicators of a stream of bars, from a state per key.

A key's state is its averages, its running sums and the few last closes that windows reach back to.
A new bar costs the same however long the history is: nothing earlier is read again. The state lives in
the stream's checkpoint, so a stream that is started again goes on where it stopped.

Values equal those of the batch indicators, from the bar on at which these have enough rows.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickloom.functions.columns import quoted, require
from tickloom.operators.models import TrainedModel
from tickloom.plans.series import KEYS, TS


class Average:
    """An exponential average that starts at its first value and counts missing ones as idle rows."""

    def __init__(self, alpha: float, need: int, kept: Sequence | None = None):
        self.alpha, self.need = alpha, need
        self.value, self.seen, self.idle = kept or (None, 0, 0)

    def add(self, x: float | None) -> float | None:
        if x is None:
            self.idle += 1
        elif self.value is None:
            self.value, self.seen, self.idle = x, 1, 0
        else:
            q = (1 - self.alpha) ** (self.idle + 1)
            if self.idle:
                self.value = (q * self.value + self.alpha * x) / (q + self.alpha)
            else:
                self.value = (1 - self.alpha) * self.value + self.alpha * x
            self.seen, self.idle = self.seen + 1, 0
        return self.value if self.seen >= self.need else None

    @property
    def kept(self) -> list:
        return [self.value, self.seen, self.idle]


def _plan(indicator: Mapping) -> tuple[list[str], dict[str, tuple[float, int]], int]:
    """Result columns, named as in batch, averages as (alpha, values needed), and closes to keep."""
    label, n = indicator["indicator"], indicator.get("length")
    kind = label.lower()
    own = "_".join([label, *(f"{k}{v}" for k, v in indicator.items() if k != "indicator")])
    if kind == "sma":
        return [own], {}, n or 50
    if kind == "ema":
        n = n or 50
        return [own], {"ema": (2 / (n + 1), n)}, 0
    if kind == "rsi":
        n = n or 14
        return [own], {"gain": (1 / n, n), "loss": (1 / n, n)}, 1
    if kind == "atr":
        n = n or 14
        return [own, f"ATRr_{n}"], {"range": (1 / n, n)}, 1
    if kind == "macd":
        fast, slow, signal = (indicator.get(k, d) for k, d in (("fast", 12), ("slow", 26), ("signal", 9)))
        names = [f"MACD_{fast}_{slow}", f"MACDs_{signal}", f"MACDh_{fast}_{slow}_{signal}"]
        return [f"{label}_{c}" for c in names], {"fast": (2 / (fast + 1), fast), "slow": (2 / (slow + 1), slow), "signal": (2 / (signal + 1), signal)}, 0
    if kind == "bbands":
        n, std = n or 20, float(indicator.get("std", 2.0))
        return [f"{label}_{b}_{n}_{std}" for b in ("BBL", "BBM", "BBU")], {}, n
    if kind == "obv":
        return [own], {}, 1
    raise ValueError(f"no streamed form of {kind!r}")


class KeyState:
    """One key's state; `add` takes the next bar and gives the values at it."""

    def __init__(self, indicators: Sequence[Mapping], kept: str | None = None):
        self.indicators = indicators
        self.plans = [_plan(i) for i in indicators]
        got = json.loads(kept) if kept else {"n": 0, "last": None, "closes": [], "sum": 0.0, "averages": [{} for _ in indicators]}
        self.n, self.last, self.closes, self.sum = got["n"], got["last"], got["closes"], got["sum"]
        self.averages = [{c: Average(*a, got["averages"][i].get(c)) for c, a in plan[1].items()} for i, plan in enumerate(self.plans)]
        self.depth = max([plan[2] for plan in self.plans], default=0) + 1

    def kept(self) -> str:
        averages = [{c: a.kept for c, a in own.items()} for own in self.averages]
        return json.dumps({"n": self.n, "last": self.last, "closes": self.closes, "sum": self.sum, "averages": averages})

    def add(self, ts: int, high: float | None, low: float | None, close: float | None, volume: float | None) -> list[float | None]:
        before = self.closes[-1] if self.closes else None
        self.closes = [*self.closes, close][-self.depth :]
        out: list[float | None] = []
        move = None if before is None or close is None else close - before
        if move is not None and volume is not None:
            self.sum += volume * ((move > 0) - (move < 0))
        for indicator, (_, _, reach), averages in zip(self.indicators, self.plans, self.averages, strict=True):
            kind = indicator["indicator"].lower()
            window = self.closes[-reach:] if reach else []
            full = len(window) == reach and None not in window
            if kind == "sma":
                out.append(math.fsum(window) / reach if full else None)
            elif kind == "bbands":
                if not full:
                    out += [None] * 3
                    continue
                mean = math.fsum(window) / reach
                spread = float(indicator.get("std", 2.0)) * math.sqrt(math.fsum((x - mean) ** 2 for x in window) / (reach - 1)) if reach > 1 else 0.0
                out += [mean - spread, mean, mean + spread]
            elif kind == "ema":
                out.append(averages["ema"].add(close))
            elif kind == "rsi":
                step = move or 0.0
                g, fall = averages["gain"].add(max(step, 0.0)), averages["loss"].add(max(-step, 0.0))
                length = indicator.get("length") or 14
                out.append(100 - 100 / (1 + g / fall) if g is not None and fall and self.n >= length else None)
            elif kind == "atr":
                spread = None if before is None or high is None or low is None else max(high - low, abs(high - before), abs(low - before))
                # The first bar has no range: the average starts at the second one.
                value = averages["range"].add(spread) if self.n else None
                out += [value, value / close if value is not None and close else 0.0]
            elif kind == "macd":
                fast, slow = averages["fast"].add(close), averages["slow"].add(close)
                line = None if fast is None or slow is None else fast - slow
                signal = averages["signal"].add(line) if line is not None else None
                out += [line, signal, None if signal is None else line - signal]
            elif kind == "obv":
                out.append(self.sum)
        self.n, self.last = self.n + 1, ts
        return out


def stream_indicators(stream: DataFrame, indicators: Sequence[Mapping], keys: Sequence[str] = KEYS) -> DataFrame:
    """The bars of a stream with their indicators.

    Bars of a key must come in the order of time from batch to batch; within a batch any order will do.
    A bar that isn't later than the last one of its key has come before, or too late, and is left out.
    """
    require(stream, TS, "high", "low", "close", "volume")
    names = [n for i in indicators for n in _plan(i)[0]]
    kept = [f for f in stream.schema.fields]
    schema = T.StructType([*kept, *[T.StructField(n, T.DoubleType()) for n in names]])

    def plain(x) -> float | None:
        return None if x is None or x != x else float(x)

    def step(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        key = KeyState(indicators, state.get[0] if state.exists else None)
        rows = pd.concat(list(batches)).sort_values(TS, kind="stable").drop_duplicates(TS)
        times = rows[TS].astype("datetime64[us]").astype("int64")
        rows = rows[times > key.last] if key.last is not None else rows
        times = times.loc[rows.index] if rows.index.is_unique else times[times > key.last] if key.last is not None else times
        values = [key.add(int(t), *map(plain, bar)) for t, bar in zip(times, rows[["high", "low", "close", "volume"]].itertuples(index=False), strict=True)]
        state.update((key.kept(),))
        found = pd.DataFrame(values, columns=names, index=rows.index, dtype=float)
        yield pd.concat([rows, found], axis=1)[[f.name for f in schema.fields]]

    return stream.groupBy(*keys).applyInPandasWithState(step, schema, "kept string", "append", GroupStateTimeout.NoTimeout)


def score_indicators(
    stream: DataFrame, out_path: str, checkpoint: str, trained: TrainedModel, indicators: Sequence[Mapping], keys: Sequence[str] = KEYS, interval: str | None = None
) -> DataStreamWriter:
    """Writer of the scores of each micro-batch's newest bar per key, from `stream_indicators`.

    A batch that runs again replaces the folder it wrote.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        newest = batch.groupBy(*keys).agg(F.max_by(F.struct(*[quoted(c) for c in batch.columns]), TS).alias("r")).select("r.*")
        scored = trained.score(newest)
        scored.select(*keys, TS, *[quoted(f"probability_{c}") for c in trained.classes], "prediction", "confidence").write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")

    writer = stream_indicators(stream, indicators, keys).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
