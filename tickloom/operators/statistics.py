"""Model-based statistics of a series: stationarity tests and conditional volatility."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.columns import full, pct_change
from tickloom.plans.series import KEYS, RN, index_series, join_on_keys, over_chunks, place_chunks
from tickloom.plans.storage import cut, once

# MacKinnon (1994) surface for the test with a constant.
TAU_MAX, TAU_MIN, TAU_STAR = 2.74, -18.83, -1.61
TAU_SMALL = (2.1659, 1.4412, 0.038269)
TAU_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)


def dickey_fuller_t(df: DataFrame, column: str = "close", window: int = 100, name: str = "df_t", keys: Sequence[str] = KEYS) -> DataFrame:
    """Rolling t statistic of the change regressed on the level before it, with a constant."""
    indexed = df if RN in df.columns else index_series(df, keys)
    n = window - 1

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        d = d.withColumns({"__x": F.lag(column).over(w)}).withColumn("__d", F.col(column) - F.col("__x"))
        frame = lambda agg: full(agg, F.col("__d"), w, n)
        d = d.withColumns({"__c": frame(F.covar_pop("__x", "__d")), "__v": frame(F.var_pop("__x")), "__u": frame(F.var_pop("__d"))})
        slope = F.try_divide(F.col("__c"), F.col("__v"))
        rest = F.col("__u") - slope * F.col("__c")
        error = F.sqrt(F.when(rest > 0, F.try_divide(rest, F.col("__v"))) / (n - 2))
        return d.withColumn(name, F.try_divide(slope, error)).drop("__x", "__d", "__c", "__v", "__u")

    return over_chunks(indexed, build, back=window, keys=keys)


def mackinnon_p(t: np.ndarray) -> np.ndarray:
    small = np.polyval(TAU_SMALL[::-1], t)
    large = np.polyval(TAU_LARGE[::-1], t)
    z = np.where(t <= TAU_STAR, small, large)
    p = np.array([0.5 * math.erfc(-v / math.sqrt(2.0)) if not math.isnan(v) else math.nan for v in z])
    return np.where(t > TAU_MAX, 1.0, np.where(t < TAU_MIN, 0.0, p))


def _regress(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per window: residual sum of squares, and t value of the first regressor (constant included)."""
    n, k = x.shape[1], x.shape[2]
    y = y - y.mean(axis=1, keepdims=True)
    x = x - x.mean(axis=1, keepdims=True)
    width = np.sqrt((x**2).mean(axis=1, keepdims=True))
    x = x / np.where(width > 0, width, np.nan)
    gram = np.einsum("wnk,wnj->wkj", x, x)
    good = np.isfinite(gram).all(axis=(1, 2))
    good[good] = np.linalg.matrix_rank(gram[good], hermitian=True) == k
    ssr, t = np.full(len(y), np.nan), np.full(len(y), np.nan)
    if good.any():
        inverse = np.linalg.inv(gram[good])
        beta = np.einsum("wkj,wj->wk", inverse, np.einsum("wnk,wn->wk", x[good], y[good]))
        rest = y[good] - np.einsum("wnk,wk->wn", x[good], beta)
        ssr[good] = (rest**2).sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            t[good] = beta[:, 0] / np.sqrt(ssr[good] / (n - k - 1) * inverse[:, 0, 0])
    return ssr, t


def adf_p(windows: np.ndarray, max_lag: int | None = None) -> np.ndarray:
    """Augmented Dickey-Fuller p-value per row of `windows`, lag order by AIC."""
    size = windows.shape[1]
    top = min(math.ceil(12.0 * (size / 100.0) ** 0.25), size // 2 - 2) if max_lag is None else max_lag
    change = np.diff(windows, axis=1)

    def parts(lag: int, first: int) -> tuple[np.ndarray, np.ndarray]:
        y = change[:, first:]
        cols = [windows[:, first:-1], *[change[:, first - j : change.shape[1] - j] for j in range(1, lag + 1)]]
        return y, np.stack(cols, axis=2)

    best, score = np.zeros(len(windows), dtype=int), np.full(len(windows), np.inf)
    rows = change.shape[1] - top
    for lag in range(top + 1):
        ssr, _ = _regress(*parts(lag, top))
        with np.errstate(divide="ignore", invalid="ignore"):
            aic = rows * np.log(ssr / rows) + 2 * (lag + 2)
        better = np.nan_to_num(aic, nan=np.inf) < score
        best[better], score[better] = lag, aic[better]
    t = np.full(len(windows), np.nan)
    for lag in range(top + 1):
        chosen = best == lag
        if chosen.any():
            y, x = parts(lag, lag)
            t[chosen] = _regress(y[chosen], x[chosen])[1]
    return mackinnon_p(t)


def rolling_adf(df: DataFrame, column: str = "close", window: int = 100, keys: Sequence[str] = KEYS, chunk_rows: int = 8192) -> DataFrame:
    """Add adf_pvalue (NULL for short or gappy windows) and is_stationary (p < 0.05).

    The lag search has no closed form over sliding sums, so each chunk, with
    the window - 1 rows before it, is tested in NumPy batches.
    """
    indexed = once(df if RN in df.columns else index_series(df, keys))
    placed = place_chunks(indexed.select(*keys, RN, F.col(column).cast("double").alias("__x")), window - 1, 0, RN, chunk_rows)
    schema = T.StructType([*[indexed.schema[k] for k in keys], T.StructField(RN, T.LongType()), T.StructField("adf_pvalue", T.DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(RN)
        x = pdf["__x"].to_numpy(dtype=float)
        p = np.full(len(x), np.nan)
        if len(x) >= window:
            views = np.lib.stride_tricks.sliding_window_view(x, window)
            for i in range(0, len(views), 512):
                part = views[i : i + 512]
                whole = ~np.isnan(part).any(axis=1)
                values = np.full(len(part), np.nan)
                values[whole] = adf_p(part[whole]) if whole.any() else values[whole]
                p[window - 1 + i : window - 1 + i + len(part)] = values
        out = pdf[[*keys, RN]].assign(adf_pvalue=p)
        return out[(pdf["__home"] == pdf["__chunk"]).to_numpy()]

    found = placed.groupBy(*keys, "__chunk").applyInPandas(run, schema)
    found = found.withColumn("adf_pvalue", F.when(~F.isnan("adf_pvalue"), F.col("adf_pvalue")))
    out = indexed.join(found, [*keys, RN], "left")
    return out.withColumn("is_stationary", F.coalesce((F.col("adf_pvalue") < 0.05).cast("int"), F.lit(0)))


ALPHAS = (0.01, 0.03, 0.06, 0.1, 0.15, 0.22, 0.3)
BETAS = (0.0, 0.3, 0.5, 0.65, 0.75, 0.82, 0.88, 0.92, 0.95, 0.97)
BETA_MAX = 0.98
# Rows after which even the slowest decay has vanished in double arithmetic.
MEMORY = math.ceil(-745.0 / math.log(BETA_MAX))


def _variances(e2: np.ndarray, level: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Conditional variances, one column per (a, b), starting at the overall variance."""
    out = np.empty((len(e2), len(a)))
    v = np.full(len(a), level)
    base = (1.0 - a - b) * level
    for i, x in enumerate(e2):
        out[i] = v
        v = base + a * x + b * v
    return out


def _candidates(a: float | None, b: float | None, width: float) -> tuple[np.ndarray, np.ndarray]:
    if a is None:
        pairs = [(x, y) for x in ALPHAS for y in BETAS]
    else:
        pairs = [(a + i * 0.04 * width, b + j * 0.06 * width) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    kept = [(x, y) for x, y in pairs if x > 0 and 0 <= y <= BETA_MAX and x + y < 0.999]
    return np.array([x for x, _ in kept]), np.array([y for _, y in kept])


def garch_volatility(df: DataFrame, column: str = "close", min_returns: int = 100, rounds: int = 4, keys: Sequence[str] = KEYS) -> DataFrame:
    """Add garch_vol, the conditional deviation of a GARCH(1,1) fitted per key.

    The constant is tied to the sample variance and (alpha, beta) maximise the
    Gaussian likelihood over a grid that is refined around the best point of
    each key. Chunks add up their likelihoods independently: each starts
    MEMORY rows early, when the start value no longer matters. Keys with too
    few returns get NULL.
    """
    indexed = df if RN in df.columns else index_series(df, keys)
    returned = once(over_chunks(indexed, lambda d, w: d.withColumn("__r", 100 * pct_change(column, w)), back=1, keys=keys))
    moments = returned.groupBy(*keys).agg(F.avg("__r").alias("__mu"), F.var_pop("__r").alias("__var"), F.count("__r").alias("__n"))
    rows = join_on_keys(returned.select(*keys, RN, "__r"), moments, keys).filter((F.col("__n") > min_returns) & (F.col("__var") > 0) & F.col("__r").isNotNull())
    rows = rows.withColumn("__e2", F.pow(F.col("__r") - F.col("__mu"), F.lit(2.0))).select(*keys, RN, "__e2", "__var")
    placed = cut(place_chunks(rows, MEMORY, 0))
    key_fields = [returned.schema[k] for k in keys]
    double = T.DoubleType()

    def likelihood(width: float):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(RN)
            fitted = "__a" in pdf.columns
            a, b = _candidates(pdf["__a"].iloc[0], pdf["__b"].iloc[0], width) if fitted else _candidates(None, None, width)
            e2 = pdf["__e2"].to_numpy()
            v = _variances(e2, float(pdf["__var"].iloc[0]), a, b)
            own = (pdf["__home"] == pdf["__chunk"]).to_numpy()
            total = (-0.5 * (np.log(v[own]) + e2[own, None] / v[own])).sum(axis=0)
            return pd.DataFrame({**{k: pdf[k].iloc[0] for k in keys}, "__a": a, "__b": b, "__ll": total})

        return run

    schema = T.StructType([*key_fields, *[T.StructField(c, double) for c in ("__a", "__b", "__ll")]])
    best = None
    for i in range(rounds):
        source = placed if best is None else join_on_keys(placed, best, keys)
        parts = source.groupBy(*keys, "__chunk").applyInPandas(likelihood(0.6**i), schema)
        summed = parts.groupBy(*keys, "__a", "__b").agg(F.sum("__ll").alias("__ll"))
        best = cut(summed.groupBy(*keys).agg(F.max_by(F.struct("__a", "__b"), F.struct("__ll", "__a", "__b")).alias("p")).select(*keys, "p.__a", "p.__b"))

    def volatility(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(RN)
        a, b = np.array([pdf["__a"].iloc[0]]), np.array([pdf["__b"].iloc[0]])
        v = _variances(pdf["__e2"].to_numpy(), float(pdf["__var"].iloc[0]), a, b)[:, 0]
        out = pdf[[*keys, RN]].assign(garch_vol=np.sqrt(v) / 100)
        return out[(pdf["__home"] == pdf["__chunk"]).to_numpy()]

    vol_schema = T.StructType([*key_fields, T.StructField(RN, T.LongType()), T.StructField("garch_vol", double)])
    found = join_on_keys(placed, best, keys).groupBy(*keys, "__chunk").applyInPandas(volatility, vol_schema)
    return returned.drop("__r").join(found, [*keys, RN], "left")
