"""From signals to trades, equity and trade statistics, as set operations.

Every signal is a candidate entry whose exit does not depend on the other
trades, so exits are found for all candidates at once. Which candidates are
taken is a chain (the next entry is the first one at or after the last exit).
Capital is a product over the taken trades, because size is a fraction of
capital and each key holds one position at a time. With a `Portfolio` the keys
compete for places, and candidates are taken in the order of time over all keys.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.columns import div, pct_change, require
from tickloom.operators.performance import return_metrics, running_product
from tickloom.plans.gate import NEVER, admit
from tickloom.plans.search import chain, first_exit
from tickloom.plans.series import (
    KEYS,
    N_ROWS,
    RN,
    SLICE_HOURS,
    TS,
    index_by,
    index_series,
    join_on_keys,
    over_chunks,
    running,
    time_slice,
)
from tickloom.plans.storage import cut


@dataclass(frozen=True)
class LedgerSpec:
    cost: float = 0.001
    slippage: float = 0.0005
    initial_capital: float = 10000.0
    risk_per_trade: float = 0.02
    max_capital_per_trade: float = 0.25
    stop_multiple: float | None = 1.0
    target_multiple: float | None = 2.0
    range_column: str | None = "atr"
    fixed_stop: float = 0.01
    fixed_target: float = 0.02
    trailing: float | None = 0.01
    trailing_activation: float = 0.01
    max_drawdown: float = 0.25
    same_bar_reentry: bool = True


@dataclass(frozen=True)
class Portfolio:
    """How many trades all keys may hold together.

    At most `max_open` at once, `max_correlated` of them with the same value of `group`, a column
    of the bars, and as many with one of the key's partners in `pairs`, a table of (symbol, other)
    read both ways. Keys named in `apart` are portfolios of their own.
    """

    max_open: int = 5
    max_correlated: int = 2
    group: str | None = None
    pairs: DataFrame | None = None
    apart: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if min(self.max_open, self.max_correlated) < 1:
            raise ValueError("limits must be at least 1")


def position_fraction(
    entry: Column, stop: Column, volatility: Column, risk: Column | float, cap: float, capital: Column | None = None
) -> Column:
    """Share of capital so that a stop costs `risk` of it, at most `cap`; 0 if undefined."""
    risk = F.lit(risk) if not isinstance(risk, Column) else risk
    distance = F.abs(entry - stop)
    usable = (entry > 0) & (stop > 0) & (distance >= 1e-9) & F.coalesce(volatility > 1e-6, F.lit(True))
    if capital is not None:
        usable = usable & (capital > 0)
    size = F.least(F.try_divide(risk * entry, distance), F.lit(cap))
    return F.when(usable, F.greatest(size, F.lit(0.0))).otherwise(0.0)


def candidate_entries(
    df: DataFrame,
    spec: LedgerSpec = LedgerSpec(),
    signal: str = "prediction",
    regime_actions: dict[int, str] | None = None,
    keys: Sequence[str] = KEYS,
    group: str | None = None,
) -> DataFrame:
    """One row per bar that follows a signal: prices, levels, fraction and tags, and `team` from a `group` column.

    A signal acts at the next bar's open with slippage. Levels come from the
    signal bar's range column, else fixed percentages of the open. In a regime
    marked reduce_risk half the risk is taken.
    """
    dynamic = spec.range_column is not None
    require(df, "open", "high", "low", "close", signal, *([spec.range_column] if dynamic else []))
    indexed = df if RN in df.columns else index_series(df, keys)

    def build(d: DataFrame, w) -> DataFrame:
        cols = {"direction": F.lag(signal).over(w)}
        if dynamic:
            cols["__range"] = F.lag(spec.range_column).over(w)
        else:
            cols["__ret"] = pct_change("close", w)
        return d.withColumns(cols)

    seen = over_chunks(indexed, build, back=1, keys=keys)
    if dynamic:
        seen = seen.withColumn("__vol", div(spec.range_column, "close"))
    else:
        seen = join_on_keys(seen, seen.groupBy(*keys).agg(F.stddev_samp("__ret").alias("__vol")), keys, "left")
    d, o = F.col("direction"), F.col("open")
    if dynamic:
        none = F.lit(None).cast("double")
        stop = none if spec.stop_multiple is None else o - d * spec.stop_multiple * F.col("__range")
        target = none if spec.target_multiple is None else o + d * spec.target_multiple * F.col("__range")
    else:
        stop, target = o * (1 - d * spec.fixed_stop), o * (1 + d * spec.fixed_target)
    rows = seen.filter(d != 0).withColumns(
        {
            "entry_rn": F.col(RN),
            "entry_time": F.col(TS),
            "entry_price": o * (1 + F.lit(spec.slippage) * d),
            "stop": stop,
            "target": target,
        }
    )
    risk, tags = F.lit(spec.risk_per_trade), F.array(F.lit("backtest"))
    if regime_actions and "regime" in df.columns:
        reg = F.col("regime").cast("int")
        action = F.element_at(F.create_map(*[F.lit(x) for kv in regime_actions.items() for x in kv]), reg)
        risk = F.when(action == "reduce_risk", risk / 2).otherwise(risk)
        tags = F.array_compact(F.array(F.lit("backtest"), F.concat(F.lit("regime_"), reg.cast("string")), F.concat(F.lit("action_"), action)))
    fraction = position_fraction(F.col("entry_price"), F.col("stop"), F.col("__vol"), risk, spec.max_capital_per_trade)
    rows = rows.withColumn("fraction", F.when(F.abs(d) == 1, fraction).otherwise(0.0)).withColumn("tags", tags)
    return rows.select(
        *keys, N_ROWS, "entry_rn", "entry_time", "direction", "entry_price", "stop", "target", "fraction", "tags",
        F.col("close").alias("entry_close"), *([F.col(group).cast("string").alias("team")] if group else []),
    )


def exits(
    candidates: DataFrame, bars: DataFrame, spec: LedgerSpec = LedgerSpec(), keys: Sequence[str] = KEYS
) -> DataFrame:
    """Add where each candidate would end: stop, trailing stop, target, or the last close.

    Levels are checked against closes, in that order, and fill at the level.
    """
    none = F.lit(None)
    asked = candidates.withColumns(
        {
            "activation": F.lit(spec.trailing_activation) if spec.trailing is not None else none,
            "trail": F.lit(spec.trailing) if spec.trailing is not None else none,
            "last_rn": none.cast("bigint"),
        }
    )
    out = first_exit(asked, bars.select(*keys, RN, "close"), keys)
    final = F.col("exit_rn").isNull()
    out = out.withColumns(
        {
            "exit_price": F.when(final, F.coalesce("last_price", "entry_close")).otherwise(F.col("exit_price")),
            "exit_reason": F.when(final, "End of Backtest").otherwise(F.col("exit_reason")),
            "exit_rn": F.when(final, F.col(N_ROWS) - 1).otherwise(F.col("exit_rn")),
            "at_end": final,
        }
    )
    change = F.col("direction") * (F.col("exit_price") - F.col("entry_price"))
    pnl = F.when(F.col("entry_price") == 0, 0.0).otherwise(F.try_divide(change, F.col("entry_price")))
    return out.withColumn("realized_pnl", pnl).drop("activation", "trail", "last_rn", "last_price")


def attempts(
    candidates: DataFrame,
    bars: DataFrame,
    spec: LedgerSpec = LedgerSpec(),
    keys: Sequence[str] = KEYS,
    portfolio: Portfolio | None = None,
) -> DataFrame:
    """The entries tried, in order: trades, and tries that only pay the cost.

    A try has no size if its fraction is 0, the portfolio is full or the drawdown limit is reached.
    Being flat, capital cannot recover, so from that try on every later
    candidate only pays the cost as well.
    """
    sized = cut(candidates)
    real = exits(sized.filter("fraction > 0"), bars, spec, keys)
    flat = sized.filter("fraction = 0")
    wait = 0 if spec.same_bar_reentry else 1
    free = F.when(F.col("at_end"), F.col(N_ROWS)).otherwise(F.greatest(F.col("exit_rn") + wait, F.col("entry_rn") + 1))
    real = real.withColumn("free", free)
    if portfolio is not None:
        every = _competing(sized, cut(real), bars, spec, keys, portfolio)
    else:
        tried = cut(real.unionByName(flat.withColumn("free", F.col("entry_rn") + 1), allowMissingColumns=True))
        taken = chain(tried, "entry_rn", "free", keys)
        limits = _drawdown_limits(taken, spec, keys)
        ok = join_on_keys(taken, limits, keys, "left").filter("__limit IS NULL OR entry_rn < __limit").drop("__limit")
        late = join_on_keys(sized, limits, keys).filter("entry_rn >= __limit").drop("__limit")
        every = ok.unionByName(late.withColumn("fraction", F.lit(0.0)), allowMissingColumns=True)
    out = running_product(every.withColumn("__f", _factor(spec)), F.col("__f"), "capital_after", keys, "entry_rn")
    return out.withColumns(
        {
            "capital_before": F.lit(spec.initial_capital) * F.coalesce(F.try_divide(F.col("capital_after"), F.col("__f")), F.lit(0.0)),
            "capital_after": F.lit(spec.initial_capital) * F.col("capital_after"),
        }
    ).drop("__f", "free", "team")


def _factor(spec: LedgerSpec) -> Column:
    """What a try makes of the key's capital."""
    return F.lit(1.0 - spec.cost) * (F.lit(1.0) + F.col("fraction") * F.coalesce("realized_pnl", F.lit(0.0)))


def _drawdown_limits(taken: DataFrame, spec: LedgerSpec, keys: Sequence[str]) -> DataFrame:
    """Per key with one: the first try (`__limit`) that finds capital too far below its peak."""
    grown = running_product(taken.withColumn("__f", _factor(spec)), F.col("__f"), "__after", keys, "entry_rn")
    grown = grown.withColumn("__before", F.coalesce(F.try_divide(F.col("__after"), F.col("__f")), F.lit(0.0)))
    peaked = running(grown, {"__peak": ("max", "__before")}, keys, "entry_rn")
    stuck = div(F.col("__peak") - F.col("__before"), "__peak") >= spec.max_drawdown
    return cut(peaked.filter(stuck).groupBy(*keys).agg(F.min("entry_rn").alias("__limit")))


def _competing(
    sized: DataFrame, real: DataFrame, bars: DataFrame, spec: LedgerSpec, keys: Sequence[str], portfolio: Portfolio
) -> DataFrame:
    """The tries of all keys under the limits of a portfolio.

    A candidate that is turned away leaves its key free, so the next one is tried. Which keys reach
    their drawdown limit depends on who got in, and the other way round: each round of the loop
    settles at least the earliest limit that is still wrong, as nothing before it changes any more.
    """
    micros = F.unix_micros(F.col(TS).cast("timestamp")) if dict(bars.dtypes)[TS] != "timestamp_ntz" else _micros(F.col(TS))
    times = bars.select(*keys, F.col(RN).alias("exit_rn"), micros.alias("__exit"))
    starts = bars.select(*keys, F.col(RN).alias("entry_rn"), micros.alias("a"))
    end = F.col("at_end")
    who = [k for k in keys if k not in portfolio.apart]
    placed = cut(
        real.join(times, [*keys, "exit_rn"])
        .join(starts, [*keys, "entry_rn"])
        .select(
            *keys,
            "entry_rn",
            "a",
            F.when(end, F.col("__exit") + 1).otherwise(F.col("__exit")).alias("gone"),
            F.when(end, F.lit(NEVER)).otherwise(F.col("__exit") + (0 if spec.same_bar_reentry else 1)).alias("free"),
            _name(portfolio.apart).alias("portfolio"),
            _name(who).alias("who"),
            (F.col("team") if portfolio.group else F.lit(None).cast("string")).alias("team"),
        )
    )
    placed = _with_peers(placed, portfolio.pairs)
    limits: DataFrame | None = None
    while True:
        open_ = placed
        if limits is not None:
            open_ = join_on_keys(placed, limits, keys, "left").filter("__limit IS NULL OR entry_rn < __limit").drop("__limit")
        got = admit(open_, portfolio.max_open, portfolio.max_correlated)
        inside = open_.join(got, ["portfolio", "who", "a"], "left_semi").select(*keys, "entry_rn")
        taken = real.join(inside, [*keys, "entry_rn"], "left_semi")
        until = taken.select(*keys, "entry_rn", F.col("free").alias("__until"))
        seen = running(sized.join(until, [*keys, "entry_rn"], "left"), {"__busy": ("max", "__until")}, keys, "entry_rn")
        tries = seen.filter("__until IS NULL AND (__busy IS NULL OR entry_rn >= __busy)").drop("__until", "__busy")
        every = cut(taken.unionByName(tries.withColumn("fraction", F.lit(0.0)), allowMissingColumns=True))
        found = _drawdown_limits(every, spec, keys)
        if limits is None and found.isEmpty():
            return every
        columns = [*keys, "__limit"]
        if limits is not None and limits.count() == found.count() and found.join(limits, columns, "left_anti").isEmpty():
            return every
        limits = found


def _micros(ts: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def _name(columns: Sequence[str]) -> Column:
    """Key columns as one string: a single one as it is, several as JSON."""
    if not columns:
        return F.lit("")
    return F.col(columns[0]).cast("string") if len(columns) == 1 else F.to_json(F.struct(*columns))


def _with_peers(rows: DataFrame, pairs: DataFrame | None) -> DataFrame:
    if pairs is None:
        return rows.withColumn("peers", F.lit(None).cast("array<string>"))
    both = pairs.select(F.col("symbol").cast("string").alias("who"), F.col("other").cast("string").alias("other"))
    both = both.unionByName(both.select(F.col("other").alias("who"), F.col("who").alias("other"))).filter("who <> other")
    return join_on_keys(rows, both.groupBy("who").agg(F.collect_set("other").alias("peers")), ["who"], "left")


def trade_summary(tried: DataFrame, bars: DataFrame, spec: LedgerSpec = LedgerSpec(), keys: Sequence[str] = KEYS) -> DataFrame:
    """The typed trade table; durations in seconds."""
    when = bars.select(*keys, F.col(RN).alias("exit_rn"), F.col(TS).alias("exit_time"))
    trades = tried.filter("fraction > 0").join(when, [*keys, "exit_rn"])
    size = F.col("capital_before") * (1 - spec.cost) * F.col("fraction") / F.col("entry_price")
    ident = F.concat(F.lit("trade_"), F.concat_ws("_", *keys), F.lit("_"), F.col("entry_rn").cast("string"))
    return trades.select(
        ident.alias("id"),
        *keys,
        F.col("direction").cast("int").alias("direction"),
        "entry_time",
        "entry_price",
        size.alias("size"),
        F.col("stop").alias("stop_loss"),
        F.col("target").alias("take_profit"),
        "exit_time",
        "exit_price",
        "exit_reason",
        "realized_pnl",
        F.col("mfe").alias("max_favorable_excursion"),
        F.col("mae").alias("max_adverse_excursion"),
        F.timestamp_diff("SECOND", F.col("entry_time"), F.col("exit_time")).alias("duration"),
        "tags",
    )


def equity_curve(tried: DataFrame, bars: DataFrame, spec: LedgerSpec = LedgerSpec(), keys: Sequence[str] = KEYS) -> DataFrame:
    """Cash capital per bar from the second bar on: after its exits, before its entry cost."""
    cost_rn = F.when(F.col("at_end"), F.least(F.col("entry_rn") + 1, F.col(N_ROWS) - 1)).otherwise(F.col("entry_rn") + 1)
    gain = F.lit(1.0) + F.col("fraction") * F.col("realized_pnl")
    events = tried.select(
        *keys,
        F.explode(
            F.array(
                F.struct(cost_rn.alias("rn"), F.lit(1.0 - spec.cost).alias("f")),
                F.struct(F.col("exit_rn").alias("rn"), F.when(F.col("fraction") > 0, gain).alias("f")),
            )
        ).alias("e"),
    ).select(*keys, F.col("e.rn").alias(RN), F.col("e.f").alias("f"))
    log = F.sum(F.when(F.col("f") != 0, F.ln(F.abs("f"))))
    odd = F.sum(F.when(F.col("f") < 0, 1).otherwise(0)) % 2
    factor = F.when(F.min(F.abs("f")) == 0, 0.0).otherwise(F.exp(log) * (1 - 2 * odd))
    per_bar = events.filter("f IS NOT NULL").groupBy(*keys, RN).agg(factor.alias("__f"))
    joined = bars.select(*keys, TS, RN).join(per_bar, [*keys, RN], "left")
    curve = running_product(joined, F.coalesce("__f", F.lit(1.0)), "equity", keys)
    return curve.filter(F.col(RN) >= 1).select(*keys, TS, (F.col("equity") * spec.initial_capital).alias("equity"))


def trade_metrics(trades: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Counts, win rate, average results in percent, profit factor, duration and exit reasons."""
    p = F.col("realized_pnl")
    win, loss = F.when(p > 0, p), F.when(p < 0, p)
    counts = trades.groupBy(*keys, "exit_reason").agg(F.count(F.lit(1)).alias("n"))
    reasons = counts.groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("exit_reason", "n")))).alias("exit_reasons")
    )
    pain = F.abs(F.coalesce(F.sum(loss), F.lit(0.0)))
    gain = F.coalesce(F.sum(win), F.lit(0.0))
    base = trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_trades"),
        F.count(win).alias("num_winning_trades"),
        F.count(loss).alias("num_losing_trades"),
        (F.count(win) / F.count(F.lit(1)) * 100).alias("win_rate_pct"),
        (F.avg(p) * 100).alias("avg_trade_pnl_pct"),
        F.coalesce(F.avg(win) * 100, F.lit(0.0)).alias("avg_win_pnl_pct"),
        F.coalesce(F.avg(loss) * 100, F.lit(0.0)).alias("avg_loss_pnl_pct"),
        F.when(pain > 0, gain / pain).otherwise(F.lit(float("inf"))).alias("profit_factor"),
        F.avg("duration").alias("avg_duration"),
    )
    return base.join(reasons, list(keys))


def recent_trade_stats(trades: DataFrame, n: int = 50, keys: Sequence[str] = KEYS) -> DataFrame:
    """Win rate and payoff ratio of the latest n trades, after each exit.

    The payoff ratio keeps its last value (2 at first) while the window lacks
    wins or losses.
    """
    ordered = index_by(trades, keys, time_slice("exit_time", SLICE_HOURS), [F.col("exit_time"), F.col("entry_time")])
    p = F.col("realized_pnl")

    def build(d: DataFrame, w) -> DataFrame:
        last = w.rowsBetween(-(n - 1), 0)
        won = F.avg(F.when(p > 0, p)).over(last)
        lost = F.avg(F.when(p < 0, -p)).over(last)
        return d.withColumns(
            {"win_rate": F.avg(F.when(p > 0, 1.0).otherwise(0.0)).over(last), "__payoff": F.try_divide(won, lost)}
        )

    out = running(over_chunks(ordered, build, back=n - 1, keys=keys), {"payoff_ratio": ("last", "__payoff")}, keys)
    return out.fillna({"payoff_ratio": 2.0}).drop("__payoff", RN, N_ROWS)


def buy_and_hold(bars: DataFrame, keys: Sequence[str] = KEYS, initial: float = 10000.0) -> DataFrame:
    """Return in percent of holding from the first to the last close, and its final value."""
    ends = bars.groupBy(*keys).agg(F.min_by("close", TS).alias("a"), F.max_by("close", TS).alias("b"))
    grown = div("b", "a")
    return ends.select(
        *keys,
        F.coalesce((grown - 1) * 100, F.lit(0.0)).alias("buy_and_hold_return_pct"),
        (grown * initial).alias("benchmark_final"),
    )


def benchmark_equity(bars: DataFrame, column: str = "close", initial: float = 10000.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Initial capital compounded with the benchmark's returns, bar by bar."""
    indexed = bars if RN in bars.columns else index_series(bars, keys)
    stepped = over_chunks(indexed, lambda d, w: d.withColumn("__r", pct_change(column, w)), back=1, keys=keys)
    out = running_product(stepped, F.lit(1.0) + F.coalesce("__r", F.lit(0.0)), "__g", keys)
    return out.select(*keys, TS, (F.col("__g") * initial).alias("benchmark_equity"))


@dataclass(frozen=True)
class Backtest:
    attempts: DataFrame
    trades: DataFrame
    equity: DataFrame
    summary: DataFrame


def backtest(
    df: DataFrame,
    spec: LedgerSpec = LedgerSpec(),
    signal: str = "prediction",
    regime_actions: dict[int, str] | None = None,
    keys: Sequence[str] = KEYS,
    portfolio: Portfolio | None = None,
) -> Backtest:
    """Trades, equity and one summary row per key for bars with a signal column.

    Under the limits of a `portfolio`, all of them come from the trades that got in.
    """
    bars = df if RN in df.columns else index_series(df, keys)
    group = portfolio.group if portfolio is not None else None
    tried = cut(attempts(candidate_entries(bars, spec, signal, regime_actions, keys, group), bars, spec, keys, portfolio))
    trades = trade_summary(tried, bars, spec, keys)
    equity = equity_curve(tried, bars, spec, keys)
    final = tried.groupBy(*keys).agg(F.max_by("capital_after", "entry_rn").alias("final_capital"))

    ordered = index_series(equity, keys)
    stepped = over_chunks(
        ordered, lambda d, w: d.withColumn("ret", F.coalesce(pct_change("equity", w), F.lit(0.0))), back=1, keys=keys
    )
    metrics = return_metrics(stepped, "ret", keys)
    percent = {f"{c}_pct": F.col(c) * 100 for c in ("total_return", "annualized_return", "volatility", "max_drawdown")}
    metrics = metrics.select(*keys, *[c.alias(n) for n, c in percent.items()], "sharpe_ratio", "sortino_ratio", "calmar_ratio")
    out = buy_and_hold(bars, keys, spec.initial_capital).drop("benchmark_final")
    for part in (metrics, trade_metrics(trades, keys).drop("exit_reasons"), final):
        out = out.join(part, list(keys), "left")
    summary = out.fillna({"num_trades": 0, "num_winning_trades": 0, "num_losing_trades": 0, "win_rate_pct": 0.0, "final_capital": spec.initial_capital})
    return Backtest(tried, trades, equity, summary)


def concurrent_limits(
    candidates: DataFrame,
    max_open: int = 5,
    max_correlated: int = 2,
    group: str | None = None,
    portfolio: Sequence[str] = ("portfolio",),
    pairs: DataFrame | None = None,
) -> DataFrame:
    """Given trades that a portfolio accepts when it may hold `max_open` trades at once.

    Also one trade per symbol, and at most `max_correlated` per `group` if one is named, and
    with partners in `pairs`. `candidates` needs symbol, entry_time and exit_time; a trade
    leaves before another enters at the same time. To let a portfolio choose among entries, pass a `Portfolio` to `backtest`.
    """
    named = candidates.withColumns({"__p": _name(portfolio), "__a": _micros(F.col("entry_time"))})
    slim = named.select(
        F.col("__p").alias("portfolio"),
        F.col("symbol").cast("string").alias("who"),
        F.col("__a").alias("a"),
        _micros(F.col("exit_time")).alias("gone"),
        _micros(F.col("exit_time")).alias("free"),
        (F.col(group).cast("string") if group else F.lit(None).cast("string")).alias("team"),
    )
    got = admit(_with_peers(slim, pairs), max_open, max_correlated)
    got = got.select(F.col("portfolio").alias("__p"), F.col("who").alias("__w"), F.col("a").alias("__a"))
    named = named.withColumn("__w", F.col("symbol").cast("string"))
    return named.join(got, ["__p", "__w", "__a"], "left_semi").drop("__p", "__w", "__a")
