"""Walk-forward folds and roll-ups over them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.ledger import Backtest, LedgerSpec, Portfolio, backtest
from tickloom.operators.performance import product
from tickloom.plans.series import KEYS, N_ROWS, RN, TS, index_series
from tickloom.plans.storage import once


@dataclass(frozen=True)
class Folds:
    """Train on rows [start, end), test on the next `test` rows, advance by `step`."""

    train: int = 1000
    test: int = 200
    step: int = 200
    rolling: bool = True
    retrain_every: int = 1

    def __post_init__(self) -> None:
        if min(self.train, self.test, self.step, self.retrain_every) < 1:
            raise ValueError("fold sizes and retrain_every must be at least 1")

    def count(self) -> Column:
        room = F.col(N_ROWS) - self.train - self.test
        return F.when(room >= 0, F.floor(room / self.step) + 1).otherwise(0).cast("bigint")

    def model_fold(self, fold: Column) -> Column:
        """The fold whose model a fold uses when retraining only every k-th time."""
        return fold - (fold - 1) % self.retrain_every


def fold_table(df: DataFrame, folds: Folds = Folds(), keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per key and fold (from 1): row bounds, their times and the model's fold."""
    indexed = once(df if RN in df.columns else index_series(df, keys))
    per_key = indexed.groupBy(*keys).agg(F.max(N_ROWS).alias(N_ROWS)).withColumn("__f", folds.count()).filter("__f > 0")
    rows = per_key.withColumn("fold", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__f")))).drop("__f", N_ROWS)
    moved = (F.col("fold") - 1) * folds.step
    rows = rows.withColumns(
        {
            "train_lo": moved if folds.rolling else F.lit(0).cast("bigint"),
            "train_hi": moved + folds.train,
            "test_lo": moved + folds.train,
            "test_hi": moved + folds.train + folds.test,
            "model_fold": folds.model_fold(F.col("fold")),
        }
    )
    marks = {"train_start": F.col("train_lo"), "train_end": F.col("train_hi") - 1, "test_start": F.col("test_lo"), "test_end": F.col("test_hi") - 1}
    asked = rows.select(*keys, "fold", F.explode(F.array(*[F.struct(F.lit(n).alias("m"), c.alias(RN)) for n, c in marks.items()])).alias("e"))
    timed = asked.select(*keys, "fold", "e.*").join(indexed.select(*keys, RN, TS), [*keys, RN])
    times = timed.groupBy(*keys, "fold").agg(*[F.max(F.when(F.col("m") == n, F.col(TS))).alias(n) for n in marks])
    return rows.join(times, [*keys, "fold"])


def fold_rows(df: DataFrame, folds: Folds = Folds(), role: str = "test", keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows tagged with every fold they serve in the given role.

    The folds of a row follow from its number, so no join is needed. With an
    expanding window a training row serves all later folds; use
    `fold_training` for one fold at a time then.
    """
    indexed = df if RN in df.columns else index_series(df, keys)
    rn, step = F.col(RN), folds.step
    if role == "test":
        lo, hi = F.ceil((rn - folds.train - folds.test + 1) / step), F.floor((rn - folds.train) / step)
    elif role == "train":
        lo = F.ceil((rn - folds.train + 1) / step)
        hi = F.floor(rn / step) if folds.rolling else folds.count() - 1
    else:
        raise ValueError(f"unknown role {role!r}")
    lo, hi = F.greatest(lo, F.lit(0)), F.least(hi, folds.count() - 1)
    ids = F.when(lo <= hi, F.sequence(lo.cast("bigint") + 1, hi.cast("bigint") + 1))
    return indexed.withColumn("fold", F.explode(ids))


def fold_training(df: DataFrame, folds: Folds, fold: int) -> DataFrame:
    """Training rows of one fold from an indexed frame."""
    start = (fold - 1) * folds.step if folds.rolling else 0
    end = (fold - 1) * folds.step + folds.train
    return df.filter((F.col(RN) >= start) & (F.col(RN) < end) & (folds.count() >= fold))


def fold_testing(df: DataFrame, folds: Folds, fold: int) -> DataFrame:
    start = (fold - 1) * folds.step + folds.train
    return df.filter((F.col(RN) >= start) & (F.col(RN) < start + folds.test) & (folds.count() >= fold))


def fold_backtests(
    df: DataFrame,
    folds: Folds = Folds(),
    spec: LedgerSpec = LedgerSpec(),
    signal: str = "signal",
    keys: Sequence[str] = KEYS,
    portfolio: Portfolio | None = None,
    regime_actions: dict[int, str] | None = None,
) -> Backtest:
    """Backtest every test slice of every key in one job; results are keyed by (key, fold).

    A portfolio holds trades of one fold of all keys.
    """
    tagged = fold_rows(df, folds, "test", keys).drop(RN, N_ROWS)
    fold_keys = [*keys, "fold"]
    if portfolio is not None:
        portfolio = replace(portfolio, apart=(*portfolio.apart, "fold"))
    done = backtest(index_series(tagged, fold_keys), spec, signal, regime_actions, fold_keys, portfolio)
    bounds = fold_table(df, folds, keys).select(*fold_keys, "train_start", "train_end", "test_start", "test_end")
    return Backtest(done.attempts, done.trades, done.equity, done.summary.join(bounds, fold_keys))


def fold_summary(results: DataFrame, hold: DataFrame | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Means, spread, totals and the compounded return over a key's folds.

    The worst drawdown is the deepest one. `hold` adds the buy-and-hold return.
    """
    r = F.col("total_return_pct")
    out = results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_folds"),
        F.avg(r).alias("avg_return_per_fold_pct"),
        F.stddev_samp(r).alias("std_return_per_fold_pct"),
        F.avg("sharpe_ratio").alias("avg_sharpe"),
        F.avg("num_trades").alias("avg_trades_per_fold"),
        F.avg("win_rate_pct").alias("avg_win_rate_pct"),
        F.avg("max_drawdown_pct").alias("avg_max_drawdown_pct"),
        F.min("max_drawdown_pct").alias("worst_fold_drawdown_pct"),
        F.sum("num_trades").alias("total_trades"),
        F.count(F.when(r > 0, 1)).alias("profitable_folds"),
        (product(1 + r / 100) - 1).alias("__c"),
        F.min("test_start").alias("__a"),
        F.max("test_end").alias("__b"),
    )
    years = F.floor(F.timestamp_diff("SECOND", F.col("__a"), F.col("__b")) / 86400) / 365.25
    out = out.withColumns(
        {
            "profitable_folds_pct": F.col("profitable_folds") / F.col("num_folds") * 100,
            "compounded_return_pct": F.col("__c") * 100,
            "annualized_return_pct": F.when((years > 0) & (F.col("__c") >= -1), (F.pow(1 + F.col("__c"), F.try_divide(F.lit(1.0), years)) - 1) * 100),
            "total_years": F.when(years > 0, years),
        }
    ).drop("__a", "__b", "__c")
    return out.join(hold, list(keys), "left") if hold is not None else out


def strategy_summary(results: DataFrame) -> DataFrame:
    """One row over all assets: means of return, Sharpe, drawdown and win rate, and total trades.

    Per asset the first non-zero of the alternatives counts; an asset lacking
    any figure is left out.
    """
    choices = {
        "ret": ("annualized_return_pct", "compounded_return_pct", "total_return_pct"),
        "sharpe": ("sharpe_ratio", "avg_sharpe"),
        "max_dd": ("max_drawdown_pct", "worst_fold_drawdown_pct"),
        "win_rate": ("win_rate_pct", "avg_win_rate_pct"),
        "trades": ("num_trades", "total_trades"),
    }
    cols = []
    for name, options in choices.items():
        have = [F.col(c) for c in options if c in results.columns]
        if not have:
            raise ValueError(f"need one of {options}")
        cols.append(F.coalesce(*[F.nullif(c, F.lit(0)) for c in have[:-1]], have[-1]).alias(name))
    return results.select(*cols).na.drop().agg(
        F.avg("ret").alias("avg_annualized_return_pct"),
        F.avg("sharpe").alias("avg_sharpe_ratio"),
        F.avg("max_dd").alias("avg_max_drawdown_pct"),
        F.avg("win_rate").alias("avg_win_rate_pct"),
        F.sum("trades").alias("total_trades"),
        F.count(F.lit(1)).alias("num_assets_aggregated"),
    )
