"""Resampling, alignment, outliers and fills."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.columns import OHLCV, clamp, col, numeric_columns, quoted, require
from tickloom.plans.series import (
    KEYS,
    N_ROWS,
    RN,
    SLICE_HOURS,
    TS,
    index_by,
    index_series,
    join_on_keys,
    quantiles,
    running,
    time_slice,
)
from tickloom.plans.storage import once

_CALENDAR = {"day": "1 day", "week": "7 days", "month": "1 month", "quarter": "3 months", "year": "1 year"}


def _bucket(rule: str, ts: Column) -> Column:
    """Start of the bucket; weeks carry the label of their last day, Sunday."""
    if rule == "week":
        return F.date_trunc("week", ts).cast("timestamp_ntz") + F.expr("INTERVAL 6 DAYS")
    if rule in _CALENDAR:
        return F.date_trunc(rule, ts).cast("timestamp_ntz")
    return F.window(ts, rule)["start"].cast("timestamp_ntz")


def _step_seconds(rule: str) -> int:
    n, unit = re.fullmatch(r"(\d+) (second|minute|hour)s?", rule).groups()
    return int(n) * {"second": 1, "minute": 60, "hour": 3600}[unit]


def _bins(spans: DataFrame, rule: str, keys: Sequence[str]) -> DataFrame:
    """Every bucket from the first to the last of each key.

    Buckets of hours, minutes and seconds are unrolled in groups of about a
    day, so no array is longer than one day of buckets.
    """
    if rule in _CALENDAR:
        return spans.select(*keys, F.explode(F.sequence("lo", "hi", F.expr(f"INTERVAL {_CALENDAR[rule]}"))).alias(TS))
    # Buckets count from the epoch, in steps that need not divide a day.
    step = _step_seconds(rule)

    def second(c: str) -> Column:
        days = F.datediff(F.col(c), F.lit("1970-01-01").cast("date")).cast("bigint")
        return days * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)

    numbered = spans.select(*keys, "lo", (second("lo") / step).cast("bigint").alias("a"), (second("hi") / step).cast("bigint").alias("z"))
    per_day = max(1, 86400 // step)
    first = F.sequence((F.col("a") / per_day).cast("bigint"), (F.col("z") / per_day).cast("bigint"))
    days = numbered.select(*keys, "lo", "a", "z", F.explode(first).alias("d"))
    steps = F.sequence(F.greatest(F.col("a"), F.col("d") * per_day), F.least(F.col("z"), F.col("d") * per_day + per_day - 1))
    each = days.select(*keys, "lo", "a", F.explode(steps).alias("k"))
    return each.select(*keys, (F.col("lo") + F.make_dt_interval(secs=((F.col("k") - F.col("a")) * step).cast("decimal(18,6)"))).alias(TS))


def resample(df: DataFrame, rule: str, keys: Sequence[str] = KEYS, fill_gaps: bool = True) -> DataFrame:
    """Bars of a longer interval: first, max, min, last and total volume.

    `rule` is day, week, month, quarter, year or a duration such as
    ``"4 hours"``. A missing price column is taken from close, else open.
    Empty buckets appear with NULL prices and volume 0.
    """
    source = {c: next((s for s in (c, "close", "open") if s in df.columns), None) for c in ("open", "high", "low", "close")}
    if not any(source.values()):
        raise ValueError("need a close or an open column")
    aggs = [
        F.min_by(source["open"], F.when(F.col(source["open"]).isNotNull(), F.col(TS))).alias("open"),
        F.max(source["high"]).alias("high"),
        F.min(source["low"]).alias("low"),
        F.max_by(source["close"], F.when(F.col(source["close"]).isNotNull(), F.col(TS))).alias("close"),
    ]
    if "volume" in df.columns:
        aggs.append(F.sum("volume").alias("volume"))
    out = df.withColumn("__b", _bucket(rule, F.col(TS))).groupBy(*keys, F.col("__b").alias(TS)).agg(*aggs)
    if not fill_gaps:
        return out
    spans = out.groupBy(*keys).agg(F.min(TS).alias("lo"), F.max(TS).alias("hi"))
    filled = _bins(spans, rule, keys).join(out, [*keys, TS], "left")
    return filled.fillna(0, ["volume"]) if "volume" in df.columns else filled


def align(frames: Sequence[DataFrame], how: str = "inner", on: Sequence[str] = (*KEYS, TS)) -> list[DataFrame]:
    """Bring frames to the same rows: inner, outer, left (first) or right (last)."""
    spines = [f.select(*on) for f in frames]
    if how == "left":
        spine = spines[0]
    elif how == "right":
        spine = spines[-1]
    elif how in ("inner", "outer"):
        union = spines[0].withColumn("__src", F.lit(0))
        for i, s in enumerate(spines[1:], 1):
            union = union.unionByName(s.withColumn("__src", F.lit(i)))
        seen = union.groupBy(*on).agg(F.count_distinct("__src").alias("__n"))
        spine = (seen.filter(F.col("__n") == len(frames)) if how == "inner" else seen).drop("__n")
    else:
        raise ValueError(f"unknown join method {how!r}")
    return [spine.join(f, list(on), "left") for f in frames]


def align_pair(a: DataFrame, b: DataFrame, on: Sequence[str] = (*KEYS, TS)) -> DataFrame:
    """Rows present on both sides."""
    return a.join(b, list(on), "inner")


def mask_name(column: str) -> str:
    return f"{column}__outlier"


def detect_outliers(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    method: str = "zscore",
    threshold: float = 3.0,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Add a Boolean `<column>__outlier` per column, judged within each key."""
    df = once(df)
    numeric = set(numeric_columns(df))
    columns = list(columns or [c for c in df.columns if c in numeric and c not in {RN, N_ROWS}])
    checked = [c for c in columns if c in numeric]
    if method == "zscore":
        stats = df.groupBy(*keys).agg(
            *[F.avg(col(c)).alias(f"__m_{c}") for c in checked], *[F.stddev_samp(col(c)).alias(f"__s_{c}") for c in checked]
        )
    elif method in ("iqr", "percentile"):
        lo, hi = (0.25, 0.75) if method == "iqr" else (threshold / 100, 1 - threshold / 100)
        stats = quantiles(df, {f"__{n}_{c}": (c, p) for c in checked for n, p in (("lo", lo), ("hi", hi))}, keys)
    else:
        raise ValueError(f"unknown outlier method {method!r}")

    def flag(c: str) -> Column:
        x = col(c)
        if method == "zscore":
            sd = col(f"__s_{c}")
            return (sd > 0) & (F.abs(F.try_divide(x - col(f"__m_{c}"), sd)) > threshold)
        low, high = col(f"__lo_{c}"), col(f"__hi_{c}")
        if method == "iqr":
            spread = high - low
            return (spread > 0) & ((x < low - spread * threshold) | (x > high + spread * threshold))
        return (x < low) | (x > high)

    out = join_on_keys(df, stats, keys, "left")
    masks = {mask_name(c): F.coalesce(flag(c), F.lit(False)) if c in checked else F.lit(False) for c in columns}
    return out.withColumns(masks).drop(*[s for s in stats.columns if s.startswith("__")])


def _masked(df: DataFrame) -> list[str]:
    return [c[: -len("__outlier")] for c in df.columns if c.endswith("__outlier")]


def drop_masks(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.endswith("__outlier")])


def winsorize(df: DataFrame, lower: float = 0.05, upper: float = 0.95, keys: Sequence[str] = KEYS) -> DataFrame:
    """Clamp each column with outliers to percentiles of its other values."""
    df, columns = once(df), _masked(df)
    kept = df.select(*keys, *[F.when(~col(mask_name(c)), col(c)).alias(c) for c in columns])
    bounds = quantiles(kept, {f"__{n}_{c}": (c, p) for c in columns for n, p in (("lo", lower), ("hi", upper))}, keys)
    return _clamp_flagged(df, bounds, columns, keys)


def clip(
    df: DataFrame, min_val: float | None = None, max_val: float | None = None, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Clamp each column with outliers to the range of its other values, or to given limits."""
    df, columns = once(df), _masked(df)
    aggs = []
    for c in columns:
        inlier = F.when(~col(mask_name(c)), col(c).cast("double"))
        aggs.append((F.lit(float(min_val)) if min_val is not None else F.min(inlier)).alias(f"__lo_{c}"))
        aggs.append((F.lit(float(max_val)) if max_val is not None else F.max(inlier)).alias(f"__hi_{c}"))
    return _clamp_flagged(df, df.groupBy(*keys).agg(*aggs), columns, keys)


def _clamp_flagged(df: DataFrame, bounds: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    flagged = df.groupBy(*keys).agg(*[F.max(col(mask_name(c))).alias(f"__any_{c}") for c in columns])
    out = join_on_keys(df, bounds.join(flagged, list(keys)), keys, "left")
    fixed = {}
    for c in columns:
        x, lo, hi = col(c).cast("double"), col(f"__lo_{c}"), col(f"__hi_{c}")
        usable = col(f"__any_{c}") & lo.isNotNull() & hi.isNotNull() & x.isNotNull()
        fixed[c] = F.when(usable, clamp(x, lo, hi)).otherwise(x)
    return out.withColumns(fixed).drop(*[f"__{p}_{c}" for c in columns for p in ("lo", "hi", "any")])


def remove_outliers(df: DataFrame) -> DataFrame:
    """Drop rows with any flagged column."""
    flags = [col(mask_name(c)) for c in _masked(df)]
    keep = ~flags[0]
    for f in flags[1:]:
        keep = keep & ~f
    return df.filter(keep)


def blank_outliers(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.when(~col(mask_name(c)), col(c)) for c in _masked(df)})


def fill_outliers(df: DataFrame, fill: str = "ffill", keys: Sequence[str] = KEYS) -> DataFrame:
    """Replace flagged values by ffill, bfill, interpolate, mean or median of the rest."""
    columns = _masked(df)
    blank = blank_outliers(once(df))
    if fill in ("ffill", "bfill"):
        return fill_nulls(blank, fill, columns, keys=keys)
    if fill == "interpolate":
        return interpolate(blank, columns, keys)
    if fill == "mean":
        stats = blank.groupBy(*keys).agg(*[F.avg(col(c)).alias(f"__v_{c}") for c in columns])
    elif fill == "median":
        stats = quantiles(blank, {f"__v_{c}": (c, 0.5) for c in columns}, keys)
    else:
        raise ValueError(f"unknown fill {fill!r}")
    out = join_on_keys(blank, stats, keys, "left")
    return out.withColumns({c: F.coalesce(col(c).cast("double"), col(f"__v_{c}")) for c in columns}).drop(
        *[f"__v_{c}" for c in columns]
    )


def handle_outliers(df: DataFrame, method: str = "winsorize", keys: Sequence[str] = KEYS, **options) -> DataFrame:
    """Apply one treatment to the columns that carry an outlier mask."""
    if method == "winsorize":
        return winsorize(df, keys=keys, **options)
    if method == "clip":
        return clip(df, keys=keys, **options)
    if method == "remove":
        return remove_outliers(df)
    if method == "fillna":
        return fill_outliers(df, keys=keys, **options)
    raise ValueError(f"unknown outlier treatment {method!r}")


def _with_index(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, bool]:
    have = RN in df.columns
    return (df if have else index_series(df, keys)), not have


def fill_nulls(
    df: DataFrame,
    method: str | float = "ffill",
    columns: Sequence[str] | None = None,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """ffill, bfill, zero or a constant; ffill and bfill stay within the key."""
    columns = list(columns or [c for c in df.columns if c not in {*keys, TS, RN, N_ROWS}])
    if method == "zero" or not isinstance(method, str):
        value = 0 if method == "zero" else method
        kinds = {f.name: f.dataType for f in df.schema.fields}
        numbers = [c for c in columns if isinstance(kinds[c], T.NumericType)]
        return df.withColumns({c: F.coalesce(col(c), F.lit(value).cast(kinds[c])) for c in numbers})
    if method not in ("ffill", "bfill"):
        raise ValueError(f"unknown fill {method!r}")
    indexed, added = _with_index(df, keys)
    filled = running(indexed, {f"__f_{c}": ("last", c) for c in columns}, keys, reverse=method == "bfill")
    out = filled.withColumns({c: col(f"__f_{c}") for c in columns}).drop(*[f"__f_{c}" for c in columns])
    return out.drop(RN, N_ROWS) if added else out


def interpolate(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Linear by row position; trailing gaps take the last value, leading ones stay NULL."""
    indexed, added = _with_index(df, keys)
    point = {c: F.when(col(c).isNotNull(), F.struct(F.col(RN).alias("r"), col(c).cast("double").alias("x"))) for c in columns}
    out = running(indexed, {f"__p_{c}": ("last", point[c]) for c in columns}, keys)
    out = running(out, {f"__n_{c}": ("last", point[c]) for c in columns}, keys, reverse=True)
    fixed = {}
    for c in columns:
        p, n = col(f"__p_{c}"), col(f"__n_{c}")
        between = p["x"] + (n["x"] - p["x"]) * F.try_divide(F.col(RN) - p["r"], n["r"] - p["r"])
        fixed[c] = F.coalesce(col(c).cast("double"), F.when(n.isNull(), p["x"]).when(p.isNotNull(), between))
    out = out.withColumns(fixed).drop(*[f"__{p}_{c}" for c in columns for p in "pn"])
    return out.drop(RN, N_ROWS) if added else out


def preprocess(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Lower-case names, ffill, numeric OHLCV, and only complete rows."""
    df = df.toDF(*[c.lower() for c in df.columns])
    kept = fill_nulls(df, "ffill", keys=keys).na.drop()
    numbers = {c: F.expr(f"try_cast(`{c}` AS DOUBLE)") for c in OHLCV if c in kept.columns}
    return kept.withColumns(numbers).na.drop(subset=list(numbers))


def wide_to_long(df: DataFrame, separator: str = "|", field_first: bool = True, ts: str = TS) -> DataFrame:
    """Long bars from columns named ``field|ticker`` (or ``ticker|field``)."""
    parts = {c: c.split(separator) for c in df.columns if separator in c}
    if not parts:
        raise ValueError("no two-level columns found")
    cells: dict[str, dict[str, str]] = {}
    for c, (a, b) in parts.items():
        ticker, field = (b, a) if field_first else (a, b)
        cells.setdefault(ticker, {})[field.lower()] = c
    fields = sorted({f for by_field in cells.values() for f in by_field})
    rows = [
        F.struct(
            F.lit(t).alias("symbol"),
            *[(F.col(quoted(by_field[f])).cast("double") if f in by_field else F.lit(None).cast("double")).alias(f) for f in fields],
        )
        for t, by_field in cells.items()
    ]
    return df.select(ts, F.explode(F.array(*rows)).alias("__r")).select("__r.symbol", ts, *[f"__r.{f}" for f in fields])


def extract_ticker(df: DataFrame, ticker: str, separator: str = "|", ts: str = TS) -> DataFrame:
    """One ticker's bars from two-level columns, whichever level holds the ticker."""
    pairs = [c.split(separator) for c in df.columns if separator in c]
    if any(b == ticker for _, b in pairs):
        return wide_to_long(df, separator, True, ts).filter(F.col("symbol") == ticker)
    if any(a == ticker for a, _ in pairs):
        return wide_to_long(df, separator, False, ts).filter(F.col("symbol") == ticker)
    raise ValueError(f"no columns for {ticker!r}")


def reindex_ffill(
    spine: DataFrame,
    source: DataFrame,
    columns: Sequence[str],
    default: Mapping[str, float] | None = None,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Source values at equal times, carried forward; then `default` before the first."""
    out = fill_nulls(spine.join(source.select(*keys, TS, *columns), [*keys, TS], "left"), "ffill", columns, keys)
    return out.fillna(dict(default)) if default else out


def asof_join(
    left: DataFrame,
    right: DataFrame,
    columns: Sequence[str],
    keys: Sequence[str] = KEYS,
    slice_hours: int = SLICE_HOURS,
) -> DataFrame:
    """Latest right row at or before each left row: one tagged union, no pair join."""
    payload = [c for c in left.columns if c not in {*keys, TS}]
    a = left.select(*keys, TS, F.lit(1).alias("__side"), F.struct(*payload).alias("__l") if payload else F.lit(1).alias("__l"))
    b = right.select(*keys, TS, F.lit(0).alias("__side"), F.struct(*columns).alias("__r"))
    both = a.unionByName(b, allowMissingColumns=True)
    ordered = index_by(both, keys, time_slice(TS, slice_hours), [F.col(TS), F.col("__side")])
    carried = running(ordered, {"__v": ("last", "__r")}, keys).filter(F.col("__side") == 1)
    return carried.select(*keys, TS, *[f"__l.{c}" for c in payload], *[F.col("__v")[c].alias(c) for c in columns])


def stack_folds(frames: Mapping[int, DataFrame]) -> DataFrame:
    """Fold tables under each other, tagged with `fold`."""
    out = None
    for fold, df in frames.items():
        tagged = df.withColumn("fold", F.lit(fold))
        out = tagged if out is None else out.unionByName(tagged)
    return out


def load_clean(
    df: DataFrame,
    fill: bool = True,
    outliers: str | None = None,
    columns: Sequence[str] = OHLCV,
    threshold: float = 3.0,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Fill both ways, then optionally blank outliers and interpolate over them."""
    require(df, *columns)
    out = index_series(df, keys)
    if fill:
        out = fill_nulls(fill_nulls(out, "ffill", columns, keys), "bfill", columns, keys)
    if outliers:
        out = drop_masks(fill_outliers(detect_outliers(out, columns, outliers, threshold, keys), "interpolate", keys))
    return out.drop(RN, N_ROWS)
