"""Return, risk and drawdown figures per key."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import correlation, div
from tickloom.operators.clean import reindex_ffill
from tickloom.plans.series import (
    KEYS,
    N_ROWS,
    RN,
    TS,
    index_series,
    join_on_keys,
    over_chunks,
    quantiles,
    running,
)
from tickloom.plans.storage import once

PERIODS = 252


def product(c: Column) -> Column:
    """Aggregate product: logs of the sizes, the parity of the signs, and zero if any is zero."""
    negatives = F.sum(F.when(c < 0, 1).otherwise(0))
    zeros = F.sum(F.when(c == 0, 1).otherwise(0))
    size = F.exp(F.coalesce(F.sum(F.when(c != 0, F.ln(F.abs(c)))), F.lit(0.0)))
    return F.when(zeros > 0, 0.0).when(negatives % 2 == 1, -size).otherwise(size)


def running_product(df: DataFrame, factor: Column, name: str, keys: Sequence[str] = KEYS, rn: str = RN) -> DataFrame:
    """Product of `factor` from the start of the key up to each row."""
    parts = {
        "__ln": ("sum", F.when(factor != 0, F.ln(F.abs(factor))).otherwise(F.lit(0.0))),
        "__neg": ("sum", F.when(factor < 0, 1).otherwise(0)),
        "__zero": ("sum", F.when(factor == 0, 1).otherwise(0)),
    }
    out = running(df, parts, keys, rn)
    size = F.exp("__ln")
    value = F.when(F.col("__zero") > 0, 0.0).when(F.col("__neg") % 2 == 1, -size).otherwise(size)
    return out.withColumn(name, value).drop(*parts)


def streaks(df: DataFrame, ret: str = "ret", keys: Sequence[str] = KEYS) -> DataFrame:
    """Longest run of wins and of losses per key; anything else ends a run.

    A run is recognised by row number minus the count of its kind so far, so
    runs are ordinary groups and no key is walked in order.
    """
    indexed = df if RN in df.columns else index_series(df, keys)
    side = F.coalesce(F.signum(F.col(ret)), F.lit(0.0))
    counted = running(
        indexed.withColumn("__side", side),
        {"__w": ("sum", F.when(F.col("__side") > 0, 1).otherwise(0)), "__l": ("sum", F.when(F.col("__side") < 0, 1).otherwise(0))},
        keys,
    )
    island = F.col(RN) - F.when(F.col("__side") > 0, F.col("__w")).when(F.col("__side") < 0, F.col("__l"))
    runs = counted.groupBy(*keys, "__side", island.alias("__island")).agg(F.count(F.lit(1)).alias("__n"))
    longest = lambda sign: F.coalesce(F.max(F.when(F.col("__side") * sign > 0, F.col("__n"))), F.lit(0))
    return runs.groupBy(*keys).agg(longest(1).alias("max_consecutive_wins"), longest(-1).alias("max_consecutive_losses"))


def max_drawdown(df: DataFrame, ret: str = "ret", keys: Sequence[str] = KEYS) -> DataFrame:
    """Deepest fall of compounded returns below their running maximum."""
    indexed = df if RN in df.columns else index_series(df, keys)
    grown = running_product(indexed, F.lit(1.0) + F.coalesce(F.col(ret), F.lit(0.0)), "__wealth", keys)
    peaked = running(grown, {"__peak": ("max", "__wealth")}, keys)
    fall = F.when(F.col(ret).isNotNull(), div(F.col("__wealth") - F.col("__peak"), "__peak"))
    return peaked.groupBy(*keys).agg(F.min(fall).alias("max_drawdown"))


def return_metrics(
    df: DataFrame, ret: str = "ret", keys: Sequence[str] = KEYS, periods: int = PERIODS
) -> DataFrame:
    """One row of return, risk, ratio, tail, streak and shape figures per key."""
    indexed = once((df if RN in df.columns else index_series(df, keys)).select(*keys, TS, RN, N_ROWS, ret))
    r = F.col(ret)
    win, loss = F.when(r > 0, r), F.when(r < 0, r)
    year = math.sqrt(periods)
    zero = F.lit(0.0)
    base = indexed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"),
        F.count(r).alias("__valid"),
        (product(F.lit(1.0) + r) - 1).alias("total_return"),
        F.count(win).alias("win_days"),
        F.count(loss).alias("lose_days"),
        F.avg(r).alias("avg_return"),
        F.coalesce(F.avg(win), zero).alias("avg_win"),
        F.coalesce(F.avg(loss), zero).alias("avg_loss"),
        (F.stddev_samp(r) * year).alias("volatility"),
        F.when(F.count(loss) > 0, F.stddev_samp(loss) * year).otherwise(zero).alias("downside_volatility"),
        F.coalesce(F.sum(win), zero).alias("__gain"),
        F.abs(F.coalesce(F.sum(loss), zero)).alias("__pain"),
        F.skewness(r).alias("skewness"),
        F.kurtosis(r).alias("kurtosis"),
    )
    tails = quantiles(indexed.select(*keys, ret), {"var_95": (ret, 0.05)}, keys)
    beyond = join_on_keys(indexed.select(*keys, TS, ret), tails, keys).groupBy(*keys).agg(
        F.avg(F.when(r <= F.col("var_95"), r)).alias("cvar_95")
    )

    valid = running(indexed, {"__last": ("last", ret)}, keys)
    lagged = over_chunks(valid, lambda d, w: d.withColumn("__before", F.lag("__last").over(w)), back=1, keys=keys)
    chained = lagged.groupBy(*keys).agg(correlation(ret, "__before").alias("autocorrelation_1d"))

    out = base
    for part in (tails, beyond, chained, max_drawdown(indexed, ret, keys), streaks(indexed, ret, keys)):
        out = out.join(part, list(keys), "left")
    total, annual = F.col("total_return"), F.col("annualized_return")
    grown = F.lit(1.0) + total
    out = out.withColumns(
        {
            "annualized_return": F.when(grown >= 0, F.pow(grown, F.lit(float(periods)) / F.col("__n")) - 1),
            "win_rate": F.col("win_days") / F.col("__n"),
        }
    )
    infinite = F.lit(float("inf"))
    enough = F.col("__valid") > 1
    jb = F.col("__valid") / 6 * (F.pow("skewness", F.lit(2.0)) + F.pow("kurtosis", F.lit(2.0)) / 4)
    return out.withColumns(
        {
            "sharpe_ratio": F.when(F.col("volatility") > 1e-6, div(annual, "volatility")),
            "sortino_ratio": F.when(F.col("downside_volatility") > 1e-6, div(annual, "downside_volatility")),
            "calmar_ratio": F.when(F.abs("max_drawdown") > 1e-6, div(annual, F.abs("max_drawdown"))),
            "profit_factor": F.when(F.col("__pain") > 1e-6, div("__gain", "__pain")).when(F.col("__gain") > 0, infinite).otherwise(0.0),
            "win_loss_ratio": F.when(F.abs("avg_loss") > 1e-6, F.abs(div("avg_win", "avg_loss")))
            .when(F.col("avg_win") > 0, infinite)
            .otherwise(0.0),
            "cvar_95": F.coalesce("cvar_95", zero),
            "skewness": F.when(enough, F.col("skewness")),
            "kurtosis": F.when(enough, F.col("kurtosis")),
            "jb_statistic": F.when(enough, jb),
            "jb_pvalue": F.when(enough, F.exp(-jb / 2)),
            "autocorrelation_1d": F.when(enough, F.col("autocorrelation_1d")),
        }
    ).drop("__n", "__valid", "__gain", "__pain")


def drawdowns(df: DataFrame, value: str = "equity", keys: Sequence[str] = KEYS) -> DataFrame:
    """Episodes below the running peak: start, end, low, recovery, depth and lengths in days.

    Episode rows share the count of rows at a peak before them, so an episode
    is an ordinary group.
    """
    indexed = once((df if RN in df.columns else index_series(df, keys)).select(*keys, TS, RN, N_ROWS, value))
    first = indexed.groupBy(*keys).agg(F.min_by(value, RN).alias("__first"))
    wealth = join_on_keys(indexed, first, keys).withColumn("__w", div(value, "__first"))
    peaked = running(wealth, {"__peak": ("max", "__w")}, keys).withColumn("__dd", div(F.col("__w") - F.col("__peak"), "__peak"))
    under = F.coalesce(F.col("__dd") < 0, F.lit(False))
    numbered = running(peaked, {"__episode": ("sum", F.when(under, 0).otherwise(1))}, keys)
    ahead = over_chunks(numbered, lambda d, w: d.withColumn("__next", F.lead(TS).over(w)), ahead=1, keys=keys)
    low = F.struct(F.col("__dd"), F.col(TS))
    out = (
        ahead.filter(under)
        .groupBy(*keys, "__episode")
        .agg(
            F.min(TS).alias("start_date"),
            F.max(TS).alias("end_date"),
            F.min_by(TS, low).alias("lowest_point_date"),
            F.max_by("__next", RN).alias("recovery_date"),
            F.min("__dd").alias("max_drawdown"),
        )
    )
    days = lambda a, b: F.floor(F.timestamp_diff("SECOND", F.col(a), F.col(b)) / 86400).cast("bigint")
    return out.withColumns(
        {
            "duration_days": days("start_date", "end_date"),
            "recovery_duration_days": days("lowest_point_date", "recovery_date"),
        }
    ).drop("__episode")


def top_drawdowns(episodes: DataFrame, n: int = 5, keys: Sequence[str] = KEYS) -> DataFrame:
    """The n deepest episodes per key.

    Episodes are cut to n inside salted groups first, so the final list of a
    key has at most 64 * n candidates.
    """
    rest = [c for c in episodes.columns if c not in keys]
    ordered = F.struct("max_drawdown", "start_date", *[c for c in rest if c not in ("max_drawdown", "start_date")])
    salt = F.pmod(F.xxhash64("start_date"), F.lit(64))
    smallest = lambda c: F.slice(F.sort_array(F.collect_list(c)), 1, n)
    near = episodes.withColumn("__salt", salt)
    w = Window.partitionBy(*keys, "__salt").orderBy("max_drawdown", "start_date")
    near = near.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n)
    best = near.groupBy(*keys).agg(smallest(ordered).alias("__top"))
    ranked = best.select(*keys, F.posexplode("__top").alias("__i", "__e"))
    return ranked.select(*keys, (F.col("__i") + 1).alias("rank"), *[F.col(f"__e.{c}").alias(c) for c in rest])


def alpha_beta(
    df: DataFrame,
    benchmark: DataFrame,
    ret: str = "ret",
    bench: str = "bench",
    on: Sequence[str] = (TS,),
    keys: Sequence[str] = KEYS,
    periods: int = PERIODS,
) -> DataFrame:
    """Annualised intercept and slope of returns on benchmark returns at equal times."""
    both = df.join(benchmark, list(on)).filter(F.col(ret).isNotNull() & F.col(bench).isNotNull())
    fit = both.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"),
        (F.regr_intercept(ret, bench) * periods).alias("alpha"),
        F.regr_slope(ret, bench).alias("beta"),
    )
    enough = F.col("__n") >= 2
    fit = fit.select(*keys, F.when(enough, F.col("alpha")).alias("alpha"), F.when(enough, F.col("beta")).alias("beta"))
    return df.select(*keys).distinct().join(fit, list(keys), "left")


def monthly_returns(df: DataFrame, ret: str = "ret", keys: Sequence[str] = KEYS) -> DataFrame:
    """Compounded return per key, year and month."""
    return df.groupBy(*keys, F.year(TS).alias("year"), F.month(TS).alias("month")).agg(
        (product(F.lit(1.0) + F.col(ret)) - 1).alias("ret")
    )


def monthly_matrix(df: DataFrame, ret: str = "ret", keys: Sequence[str] = KEYS) -> DataFrame:
    """Monthly returns with one column per month."""
    monthly = monthly_returns(df, ret, keys)
    cells = [F.max(F.when(F.col("month") == m, F.col("ret"))).alias(f"m{m:02d}") for m in range(1, 13)]
    return monthly.groupBy(*keys, "year").agg(*cells)


def equity_from_trades(
    trades: DataFrame, bars: DataFrame, initial: float, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Initial capital plus the profit of the trades closed by each bar."""
    profit = (F.col("exit_price") - F.col("entry_price")) * F.col("size") * F.col("direction") - F.coalesce(
        F.col("commission"), F.lit(0.0)
    )
    closed = trades.groupBy(*keys, F.col("exit_time").alias(TS)).agg(F.sum(F.coalesce(profit, F.lit(0.0))).alias("__pnl"))
    summed = running(index_series(closed, keys), {"equity": ("sum", "__pnl")}, keys)
    curve = summed.withColumn("equity", F.col("equity") + initial)
    return reindex_ffill(bars.select(*keys, TS), curve, ["equity"], {"equity": initial}, keys)


def rolling_sharpe(folds: DataFrame, n: int = 10, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean Sharpe ratio of the latest n folds, from the first fold on."""

    def build(d: DataFrame, w) -> DataFrame:
        return d.withColumn("rolling_sharpe", F.avg("sharpe_ratio").over(w.rowsBetween(-(n - 1), 0)))

    return over_chunks(folds, build, back=n - 1, keys=keys, rn="fold")
