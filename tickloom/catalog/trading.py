"""Signals, trade ledger and performance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.catalog.base import bars, indexed, query, r, rs, with_bars
from tickloom.catalog.technical import _MOVE, _TR, ewm_cte, lag, roll
from tickloom.functions.columns import div, pct_change, rolling_mean, rolling_std, rounded
from tickloom.operators import ledger, performance, signals
from tickloom.plans.series import RN, index_series, over_chunks
from tickloom.plans.storage import cut

CLASSES = ("-1", "0", "1")

# Deterministic stand-in for a three-class model's output.
_PROBS = (
    f"pr AS (SELECT *, coalesce(close / nullif({lag('close', 5)}, 0) - 1, 0.0) AS mom FROM ix), "
    'pb AS MATERIALIZED (SELECT *, 1 / (1 + exp(-greatest(-30.0, least(30.0, 20 * mom)))) AS p1, '
    '0.7 * (1 - 1 / (1 + exp(-greatest(-30.0, least(30.0, 20 * mom))))) AS pm, '
    '0.3 * (1 - 1 / (1 + exp(-greatest(-30.0, least(30.0, 20 * mom))))) AS p0 FROM pr)'
)


def with_probabilities(df: DataFrame) -> DataFrame:
    """Add `mom` and probability_-1, probability_0, probability_1 to indexed bars."""

    def build(d: DataFrame, w) -> DataFrame:
        return d.withColumn("mom", F.coalesce(pct_change("close", w, 5), F.lit(0.0)))

    out = over_chunks(df, build, back=5)
    up = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("mom") * 20))))
    return out.withColumns({"probability_1": up, "probability_-1": 0.7 * (1 - up), "probability_0": 0.3 * (1 - up)})


@query("SELECT doc_id, CASE quality WHEN 0 THEN -1 WHEN 1 THEN 1 END AS quality_signal, CASE toxic WHEN 0 THEN -1 WHEN 1 THEN 1 END AS toxic_signal FROM labels")
def class_signals(spark: SparkSession, folder: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/labels.parquet")
    df = signals.map_classes(df, "quality", (0, 1), "quality_signal")
    return signals.map_classes(df, "toxic", (0, 1), "toxic_signal").select("doc_id", "quality_signal", "toxic_signal")


_RAW = (
    "greatest(pm, p0, p1) AS confidence, CASE WHEN greatest(pm, p0, p1) < {t} THEN 0 WHEN pm = greatest(pm, p0, p1) THEN -1 "
    "WHEN p0 = greatest(pm, p0, p1) THEN {n} ELSE 1 END AS signal"
)


@query(
    with_bars("priority")
    + f", {_PROBS}, s AS (SELECT symbol, ts, p1, pm, {_RAW.format(t=0.6, n=0)} FROM pb) "
    + f"SELECT symbol, ts, {r('p1', 'probability_pos')}, {r('pm', 'probability_neg')}, {r('confidence')}, signal FROM s"
)
def probability_signals(spark: SparkSession, folder: str) -> DataFrame:
    df = signals.raw_signals(with_probabilities(indexed(spark, folder, "priority")), CLASSES, 0.6)
    return rounded(df.select("symbol", "ts", "probability_pos", "probability_neg", "confidence", "signal"))


_TREND = (
    ", t AS (SELECT *, avg(close) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS ma FROM s), "
    "u AS (SELECT * EXCLUDE (signal), CASE WHEN (signal = 1 AND NOT close > ma) OR (signal = -1 AND NOT close < ma) THEN 0 ELSE signal END AS signal FROM t)"
)
_SIGNALS = f", {_PROBS}, s AS (SELECT *, {_RAW.format(t=0.6, n=0)} FROM pb)"


def _signals(spark: SparkSession, folder: str) -> DataFrame:
    return signals.raw_signals(with_probabilities(indexed(spark, folder, "priority")), CLASSES, 0.6)


@query(with_bars("priority") + _SIGNALS + _TREND + " SELECT symbol, ts, signal FROM u")
def trend_filtered(spark: SparkSession, folder: str) -> DataFrame:
    return signals.trend_filter(_signals(spark, folder), 50).select("symbol", "ts", "signal")


@query(
    with_bars("priority", True)
    + _SIGNALS
    + f""", d AS MATERIALIZED (SELECT *, {_TR} AS tr FROM s), {ewm_cte('e', 'd', {'y': ('tr', 1 / 14)})},
    a AS (SELECT d.symbol, d.ts, d.signal, CASE WHEN rn >= 14 THEN y END AS atr FROM d JOIN e USING (symbol, rn)),
    q AS (SELECT symbol, quantile_cont(atr, 0.75) AS lim FROM a GROUP BY symbol)
    SELECT symbol, ts, CASE WHEN coalesce(atr > lim, false) THEN 0 ELSE signal END AS signal FROM a JOIN q USING (symbol)"""
)
def volatility_filtered(spark: SparkSession, folder: str) -> DataFrame:
    return signals.volatility_filter(_signals(spark, folder), 14).select("symbol", "ts", "signal")


@query(
    with_bars("priority")
    + _SIGNALS
    + """ SELECT symbol, ts, CASE WHEN month(ts) % 3 = 0 THEN 0 WHEN month(ts) % 3 = 1 AND signal = -1 THEN 0
    WHEN month(ts) % 3 = 2 AND signal = 1 THEN 0 ELSE signal END AS signal FROM s"""
)
def regime_filtered(spark: SparkSession, folder: str) -> DataFrame:
    df = _signals(spark, folder).withColumn("regime", F.month("ts") % 3)
    return signals.regime_filter(df, {0: "no_trade", 1: "long_only", 2: "short_only"}).select("symbol", "ts", "signal")


def cooling_cte(source: str, bars_: int) -> str:
    """Recursive CTE `cool(symbol, rn, signal, free)` walking the bars in order."""
    return (
        f"cool(symbol, rn, signal, free) AS (SELECT symbol, rn, signal, CASE WHEN signal <> 0 THEN {bars_ + 1} ELSE 0 END FROM {source} WHERE rn = 0 "
        f"UNION ALL SELECT x.symbol, x.rn, CASE WHEN x.rn >= c.free THEN x.signal ELSE 0 END, CASE WHEN x.signal <> 0 AND x.rn >= c.free THEN x.rn + {bars_ + 1} ELSE c.free END "
        f"FROM cool c JOIN {source} x ON x.symbol = c.symbol AND x.rn = c.rn + 1)"
    )


_SLIM = ", sm AS MATERIALIZED (SELECT symbol, rn, signal FROM {s})"


@query(with_bars("priority", True) + _SIGNALS + _SLIM.format(s="s") + f", {cooling_cte('sm', 5)} SELECT symbol, ts, cool.signal FROM ix JOIN cool USING (symbol, rn)")
def cooled_signals(spark: SparkSession, folder: str) -> DataFrame:
    return signals.cooling_period(_signals(spark, folder), 5).select("symbol", "ts", "signal")


@query(
    with_bars("priority", True)
    + f", {_PROBS}, s AS (SELECT *, {_RAW.format(t=0.6, n=1)} FROM pb)"
    + _TREND
    + _SLIM.format(s="u")
    + f", {cooling_cte('sm', 3)} SELECT symbol, ts, cool.signal, {r('p1', 'probability_pos')}, {r('pm', 'probability_neg')}, {r('confidence')} FROM u JOIN cool USING (symbol, rn)"
)
def filtered_signals(spark: SparkSession, folder: str) -> DataFrame:
    df = with_probabilities(indexed(spark, folder, "priority"))
    out = signals.generate_signals(df, CLASSES, 0.6, trend_length=50, cooling=3, force_neutral_long=True)
    return rounded(out.select("symbol", "ts", "signal", "probability_pos", "probability_neg", "confidence"))


def _cross_sql(short: int, long: int) -> str:
    return (
        f", m AS (SELECT *, {roll('avg(close)', short)} AS a, {roll('avg(close)', long)} AS b FROM ix), "
        f"c AS (SELECT *, {lag('a')} AS pa, {lag('b')} AS pb FROM m), "
        "x AS (SELECT *, CASE WHEN a > b AND pa <= pb THEN 1 WHEN a < b AND pa >= pb THEN -1 ELSE 0 END AS signal FROM c)"
    )


@query(with_bars("priority") + _cross_sql(20, 50) + f" SELECT symbol, ts, {r('a', 'sma_short')}, {r('b', 'sma_long')}, signal FROM x")
def crossover(spark: SparkSession, folder: str) -> DataFrame:
    df = signals.crossover_signals(indexed(spark, folder, "priority"), 20, 50)
    return rounded(df.select("symbol", "ts", "sma_short", "sma_long", "signal"))


@query(
    with_bars("brand", True)
    + f", d AS MATERIALIZED (SELECT symbol, ts, rn, greatest({_MOVE}, 0.0) AS g, greatest(-({_MOVE}), 0.0) AS l FROM ix), "
    + ewm_cte("e", "d", {"eg": ("g", 1 / 14), "el": ("l", 1 / 14)})
    + """, i AS (SELECT symbol, ts, rn, CASE WHEN rn >= 14 AND el <> 0 THEN 100 - 100 / (1 + eg / el) END AS rsi FROM d JOIN e USING (symbol, rn)),
    j AS (SELECT *, lag(rsi) OVER (PARTITION BY symbol ORDER BY rn) AS p FROM i)
    SELECT symbol, ts, CASE WHEN rsi < 45 AND p >= 45 THEN 1 WHEN rsi > 55 AND p <= 55 THEN -1 ELSE 0 END AS signal FROM j"""
)
def rsi_reversion(spark: SparkSession, folder: str) -> DataFrame:
    return signals.rsi_signals(indexed(spark, folder), 14, 45.0, 55.0).select("symbol", "ts", "signal")


@query(
    with_bars()
    + _cross_sql(4, 12)
    + f""", h AS (SELECT *, close / nullif({lag('close')}, 0) - 1 AS ret, {lag('signal')} AS held,
      {roll('avg(close)', 12)} + 2 * {roll('stddev_samp(close)', 12)} AS upper FROM x)
    SELECT symbol, count(*) FILTER (signal = 1) AS buys, count(*) FILTER (signal = -1) AS sells,
    {r('avg(held * ret)', 'mean_return')}, {r('stddev_samp(ret)', 'return_std')}, {r('max(upper)', 'top_band', 4)} FROM h GROUP BY symbol"""
)
def crossover_returns(spark: SparkSession, folder: str) -> DataFrame:
    """Weekly brand bars: crossover signals and the mean return of following them one bar later."""
    df = signals.crossover_signals(indexed(spark, folder), 4, 12)

    def build(d: DataFrame, w) -> DataFrame:
        return d.withColumns(
            {
                "ret": pct_change("close", w),
                "held": F.lag("signal").over(w),
                "upper": rolling_mean("close", w, 12) + 2 * rolling_std("close", w, 12),
            }
        )

    out = over_chunks(df, build, back=11)
    found = rounded(
        out.groupBy("symbol").agg(
            F.count(F.when(F.col("signal") == 1, 1)).alias("buys"),
            F.count(F.when(F.col("signal") == -1, 1)).alias("sells"),
            F.avg(F.col("held") * F.col("ret")).alias("mean_return"),
            F.stddev_samp("ret").alias("return_std"),
            F.round(F.max("upper"), 4).alias("top_band"),
        )
    )
    return found


# --- ledger -----------------------------------------------------------------

SPEC = ledger.LedgerSpec(stop_multiple=0.2, target_multiple=0.5, trailing=0.1, trailing_activation=0.05)
FIXED = ledger.LedgerSpec(range_column=None, trailing=None)

_ATR10 = "avg(high - low) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"
_PREDICTED = (
    f", g0 AS (SELECT *, close / nullif({lag('close', 3)}, 0) - 1 AS mom, {_ATR10} AS atr FROM ix), "
    "pd AS (SELECT *, CASE WHEN mom > 0.8 THEN 1 WHEN mom < -0.4 THEN -1 ELSE 0 END AS prediction, month(ts) % 3 AS regime FROM g0)"
)


def predicted(spark: SparkSession, folder: str) -> DataFrame:
    """Indexed daily bars with an average range, momentum predictions and a regime."""

    def build(d: DataFrame, w) -> DataFrame:
        mom = pct_change("close", w, 3)
        return d.withColumns(
            {
                "atr": F.avg(F.col("high") - F.col("low")).over(w.rowsBetween(-9, 0)),
                "prediction": F.when(mom > 0.8, 1).when(mom < -0.4, -1).otherwise(0),
                "regime": F.month("ts") % 3,
            }
        )

    return over_chunks(indexed(spark, folder, "priority"), build, back=9)


def _candidate_sql(spec: ledger.LedgerSpec, risk: str = "0.02") -> str:
    """CTE `cand`: every bar with the previous bar's signal and its levels."""
    if spec.range_column:
        stop, target = f"open - d * {spec.stop_multiple} * a", f"open + d * {spec.target_multiple} * a"
        vol = "atr / nullif(close, 0)"
    else:
        stop, target = f"open * (1 - d * {spec.fixed_stop})", f"open * (1 + d * {spec.fixed_target})"
        vol = "vol"
    return (
        _PREDICTED
        + f""", lg AS (SELECT *, {lag('prediction')} AS d, {lag('atr')} AS a, close / nullif({lag('close')}, 0) - 1 AS ret FROM pd),
      vl AS (SELECT *, stddev_samp(ret) OVER (PARTITION BY symbol) AS vol FROM lg),
      lv AS (SELECT *, open * (1 + {spec.slippage} * d) AS e, {stop} AS st, {target} AS tg, {vol} AS v FROM vl),
      cand AS MATERIALIZED (SELECT *, CASE WHEN abs(d) = 1 AND e > 0 AND st > 0 AND abs(e - st) >= 1e-9 AND coalesce(v > 1e-6, true)
        THEN greatest(least({risk} * e / abs(e - st), {spec.max_capital_per_trade}), 0.0) ELSE 0.0 END AS f FROM lv)"""
    )


def _sim_sql(spec: ledger.LedgerSpec, risk: str = "0.02") -> str:
    """Bar-by-bar simulation as a recursive CTE `sim`, one row per bar."""
    trail = spec.trailing if spec.trailing is not None else 0
    live = f"(live OR pnl >= {spec.trailing_activation})" if spec.trailing is not None else "false"
    return (
        with_bars("priority", True)
        + _candidate_sql(spec, risk)
        + f""", sim(symbol, rn, cap, peak, dir, e, st, tg, notional, live, best, mfe, mae, ern, x_rn, x_price, x_why, x_pnl, x_e, x_st, x_tg, x_not, x_dir, x_mfe, x_mae, equity, cap0, tried) AS (
      SELECT symbol, 0::BIGINT, {spec.initial_capital}::DOUBLE, {spec.initial_capital}::DOUBLE, 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, false, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0::BIGINT,
        NULL::BIGINT, NULL::DOUBLE, NULL::VARCHAR, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::INT, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, false FROM ix WHERE rn = 0
      UNION ALL
      SELECT symbol, rn, CASE WHEN try THEN cap3 * (1 - {spec.cost}) ELSE cap3 END, peak3,
        CASE WHEN opens THEN d WHEN why IS NOT NULL THEN 0 ELSE dir END, CASE WHEN opens THEN ce ELSE e END, CASE WHEN opens THEN cst ELSE st END, CASE WHEN opens THEN ctg ELSE tg END,
        CASE WHEN opens THEN cap3 * (1 - {spec.cost}) * f ELSE notional END, CASE WHEN opens THEN false ELSE live2 END, CASE WHEN opens THEN 0.0 ELSE best2 END,
        CASE WHEN opens THEN 0.0 ELSE mfe2 END, CASE WHEN opens THEN 0.0 ELSE mae2 END, CASE WHEN opens THEN rn ELSE ern END,
        CASE WHEN why IS NOT NULL THEN ern END, price, why, real, e, st, tg, notional, dir, mfe2, mae2, cap3, cap3, try
      FROM (
        SELECT *, coalesce(d, 0) <> 0 AND (dir = 0 OR why IS NOT NULL) AS try,
          coalesce(d, 0) <> 0 AND (dir = 0 OR why IS NOT NULL) AND f > 0 AND (peak3 - cap3) / peak3 < {spec.max_drawdown} AS opens
        FROM (
          SELECT *, greatest(peak, cap3) AS peak3 FROM (
            SELECT *, CASE WHEN why IS NOT NULL THEN cap + real * notional ELSE cap END AS cap3 FROM (
              SELECT *, CASE WHEN why IS NOT NULL THEN dir * (price - e) / e END AS real FROM (
                SELECT *, CASE WHEN hs THEN st WHEN ht THEN tl WHEN hp THEN tg END AS price, CASE WHEN hs THEN 'Stop Loss' WHEN ht THEN 'Trailing Stop' WHEN hp THEN 'Take Profit' END AS why FROM (
                  SELECT *, dir <> 0 AND (CASE WHEN dir = 1 THEN close <= st ELSE close >= st END) AS hs,
                    dir <> 0 AND live2 AND (CASE WHEN dir = 1 THEN close <= tl ELSE close >= tl END) AS ht,
                    dir <> 0 AND (CASE WHEN dir = 1 THEN close >= tg ELSE close <= tg END) AS hp FROM (
                    SELECT *, CASE WHEN dir = 1 THEN best2 * (1 - {trail}) ELSE best2 * (1 + {trail}) END AS tl FROM (
                      SELECT *, CASE WHEN NOT live2 THEN 0.0 WHEN NOT live THEN close WHEN dir = 1 THEN greatest(best, close) ELSE least(best, close) END AS best2 FROM (
                        SELECT *, CASE WHEN dir <> 0 THEN {live} ELSE false END AS live2, CASE WHEN dir <> 0 THEN greatest(mfe, pnl) ELSE mfe END AS mfe2, CASE WHEN dir <> 0 THEN least(mae, pnl) ELSE mae END AS mae2 FROM (
                          SELECT s.symbol, c.rn, s.cap, s.peak, s.dir, s.e, s.st, s.tg, s.notional, s.live, s.best, s.mfe, s.mae, s.ern, c.close, c.d, c.e AS ce, c.st AS cst, c.tg AS ctg, c.f,
                            CASE WHEN s.dir <> 0 THEN s.dir * (c.close - s.e) / s.e END AS pnl
                          FROM sim s JOIN cand c ON c.symbol = s.symbol AND c.rn = s.rn + 1))))))))))),
    closed AS (
      SELECT symbol, x_rn AS entry_rn, rn AS exit_rn, x_dir AS direction, x_e AS entry_price, x_st AS stop_loss, x_tg AS take_profit, x_price AS exit_price, x_why AS exit_reason,
        x_pnl AS realized_pnl, x_not / x_e AS size, x_mfe AS mfe, x_mae AS mae FROM sim WHERE x_why IS NOT NULL
      UNION ALL
      SELECT s.symbol, s.ern, s.rn, s.dir, s.e, s.st, s.tg, c.close, 'End of Backtest', s.dir * (c.close - s.e) / s.e, s.notional / s.e, s.mfe, s.mae
      FROM sim s JOIN cand c USING (symbol, rn) WHERE s.rn = c.n_rows - 1 AND s.dir <> 0),
    trades AS (SELECT t.*, a.ts AS entry_time, b.ts AS exit_time FROM closed t JOIN ix a ON a.symbol = t.symbol AND a.rn = t.entry_rn JOIN ix b ON b.symbol = t.symbol AND b.rn = t.exit_rn),
    curve AS (SELECT s.symbol, i.ts, s.rn, CASE WHEN s.rn = i.n_rows - 1 AND s.dir <> 0 THEN s.cap + s.dir * (i.close - s.e) / s.e * s.notional ELSE s.equity END AS equity,
      CASE WHEN s.rn = i.n_rows - 1 AND s.dir <> 0 THEN s.cap + s.dir * (i.close - s.e) / s.e * s.notional ELSE s.cap END AS final FROM sim s JOIN ix i USING (symbol, rn) WHERE s.rn >= 1)"""
    )


_TRADE_COLS = (
    "symbol, direction::INT AS direction, entry_time, exit_time, exit_reason, "
    + rs("entry_price", "stop_loss", "take_profit", "exit_price", digits=7)
    + ", "
    + rs("size", "realized_pnl", digits=5)
    + ", "
    + r("mfe", "max_favorable_excursion", 5)
    + ", "
    + r("mae", "max_adverse_excursion", 5)
    + ", date_diff('second', entry_time, exit_time)::BIGINT AS duration"
)


_LEVELS = ("entry_price", "stop", "target", "stop_loss", "take_profit", "exit_price")


def _shown(trades: DataFrame) -> DataFrame:
    """Price levels with 7 digits, everything else with 5."""
    shares = [f.name for f in trades.schema.fields if f.name not in _LEVELS]
    return rounded(rounded(trades, 5, raw=_LEVELS), 7, raw=shares)


def _trades(spark: SparkSession, folder: str, spec: ledger.LedgerSpec, regimes: dict | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    df = predicted(spark, folder)
    tried = cut(ledger.attempts(ledger.candidate_entries(df, spec, regime_actions=regimes), df, spec))
    return df, tried, ledger.trade_summary(tried, df, spec)


@query(
    with_bars("priority")
    + _candidate_sql(SPEC)
    + f" SELECT symbol, ts AS entry_time, d::INT AS direction, {r('e', 'entry_price', 7)}, {r('st', 'stop', 7)}, {r('tg', 'target', 7)}, {r('f', 'fraction')} FROM cand WHERE d <> 0"
)
def entry_candidates(spark: SparkSession, folder: str) -> DataFrame:
    df = ledger.candidate_entries(predicted(spark, folder), SPEC)
    out = df.select("symbol", "entry_time", F.col("direction").cast("int").alias("direction"), "entry_price", "stop", "target", "fraction")
    return rounded(rounded(out, 6, raw=_LEVELS), 7, raw=("fraction",))


@query(
    with_bars("priority")
    + _candidate_sql(SPEC)
    + f""", w AS (SELECT a.symbol, a.rn, b.rn AS brn, a.d, a.e, a.st, a.tg, b.close, a.n_rows, a.close AS own,
        a.d * (b.close - a.e) / a.e AS pnl FROM cand a JOIN ix b ON a.symbol = b.symbol AND b.rn > a.rn WHERE a.d <> 0 AND a.f > 0),
      act AS (SELECT *, bool_or(pnl >= 0.05) OVER p AS live FROM w WINDOW p AS (PARTITION BY symbol, rn ORDER BY brn)),
      bst AS (SELECT *, CASE WHEN d = 1 THEN max(CASE WHEN live THEN close END) OVER p ELSE min(CASE WHEN live THEN close END) OVER p END AS best FROM act WINDOW p AS (PARTITION BY symbol, rn ORDER BY brn)),
      hit AS (SELECT *, best * (1 - d * 0.1) AS tl, CASE WHEN d * (close - st) <= 0 THEN 'Stop Loss' WHEN live AND d * (close - best * (1 - d * 0.1)) <= 0 THEN 'Trailing Stop'
        WHEN d * (close - tg) >= 0 THEN 'Take Profit' END AS why FROM bst),
      fst AS (SELECT symbol, rn, min(CASE WHEN why IS NOT NULL THEN brn END) AS x FROM hit GROUP BY 1, 2),
      res AS (SELECT c.symbol, c.rn, c.n_rows, c.d, c.e, c.close, f.x, h.why, CASE h.why WHEN 'Stop Loss' THEN h.st WHEN 'Trailing Stop' THEN h.tl WHEN 'Take Profit' THEN h.tg END AS px
        FROM cand c LEFT JOIN fst f USING (symbol, rn) LEFT JOIN hit h ON h.symbol = c.symbol AND h.rn = c.rn AND h.brn = f.x WHERE c.d <> 0 AND c.f > 0),
      mm AS (SELECT h.symbol, h.rn, greatest(0.0, max(pnl)) AS mfe, least(0.0, min(pnl)) AS mae FROM hit h JOIN fst f USING (symbol, rn) WHERE f.x IS NULL OR brn <= f.x GROUP BY 1, 2),
      ls AS (SELECT symbol, last(close ORDER BY rn) AS lc FROM ix GROUP BY 1)
    SELECT symbol, rn AS entry_rn, coalesce(x, n_rows - 1)::BIGINT AS exit_rn, coalesce(why, 'End of Backtest') AS exit_reason, {r('coalesce(px, lc)', 'exit_price', 5)},
      {r('d * (coalesce(px, lc) - e) / e', 'realized_pnl', 5)}, {r('coalesce(mfe, 0.0)', 'mfe', 5)}, {r('coalesce(mae, 0.0)', 'mae', 5)}
    FROM res LEFT JOIN mm USING (symbol, rn) JOIN ls USING (symbol)"""
)
def exit_scan(spark: SparkSession, folder: str) -> DataFrame:
    df = predicted(spark, folder)
    found = ledger.exits(ledger.candidate_entries(df, SPEC).filter("fraction > 0"), df, SPEC)
    return rounded(found.select("symbol", "entry_rn", "exit_rn", "exit_reason", "exit_price", "realized_pnl", "mfe", "mae"), 5)


@query(
    with_bars("priority")
    + _PREDICTED
    + f""", z AS (SELECT *, {lag('atr')} AS a FROM pd) SELECT symbol, ts, {r('CASE WHEN a IS NULL OR open - a <= 0 OR abs(a) < 1e-9 OR atr / close <= 1e-6 THEN 0.0 ELSE least(0.02 * open / a, 0.25) END', 'fraction')} FROM z"""
)
def position_sizes(spark: SparkSession, folder: str) -> DataFrame:
    df = over_chunks(predicted(spark, folder), lambda d, w: d.withColumn("a", F.lag("atr").over(w)), back=1)
    size = ledger.position_fraction(F.col("open"), F.col("open") - F.col("a"), div("atr", "close"), 0.02, 0.25)
    return rounded(df.select("symbol", "ts", size.alias("fraction")))


@query(_sim_sql(SPEC) + f" SELECT {_TRADE_COLS} FROM trades")
def trade_ledger(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(_trades(spark, folder, SPEC)[2].drop("id", "tags"))


@query(_sim_sql(FIXED) + f" SELECT {_TRADE_COLS} FROM trades")
def trade_ledger_fixed_stops(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(_trades(spark, folder, FIXED)[2].drop("id", "tags"))


STRICT = ledger.LedgerSpec(stop_multiple=0.2, target_multiple=0.5, trailing=None, max_drawdown=0.04, cost=0.004)


@query(_sim_sql(STRICT) + f" SELECT {_TRADE_COLS} FROM trades")
def trade_ledger_drawdown_limit(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(_trades(spark, folder, STRICT)[2].drop("id", "tags"))


@query(_sim_sql(STRICT) + f" SELECT symbol, ts, {r('equity', digits=3)} FROM curve")
def equity_under_drawdown_limit(spark: SparkSession, folder: str) -> DataFrame:
    df, tried, _ = _trades(spark, folder, STRICT)
    return rounded(ledger.equity_curve(tried, df, STRICT), 3)


_REGIME_RISK = (
    _sim_sql(SPEC, "(CASE WHEN regime = 1 THEN 0.01 ELSE 0.02 END)")
    + f" SELECT {_TRADE_COLS}, 'backtest,regime_' || (month(entry_time) % 3) || CASE month(entry_time) % 3 WHEN 1 THEN ',action_reduce_risk' WHEN 2 THEN ',action_trade_normal' ELSE '' END AS tags FROM trades"
)


@query(_REGIME_RISK)
def regime_risk_ledger(spark: SparkSession, folder: str) -> DataFrame:
    out = _trades(spark, folder, SPEC, {1: "reduce_risk", 2: "trade_normal"})[2]
    return _shown(out.drop("id").withColumn("tags", F.array_join("tags", ",")))


@query(_sim_sql(SPEC) + f" SELECT symbol, ts, {r('equity', digits=3)} FROM curve")
def equity_per_bar(spark: SparkSession, folder: str) -> DataFrame:
    df, tried, _ = _trades(spark, folder, SPEC)
    return rounded(ledger.equity_curve(tried, df, SPEC), 3)


@query(
    _sim_sql(SPEC)
    + f""" SELECT symbol, count(*) AS num_trades, count(*) FILTER (realized_pnl > 0) AS num_winning_trades, count(*) FILTER (realized_pnl < 0) AS num_losing_trades,
    {r('100.0 * count(*) FILTER (realized_pnl > 0) / count(*)', 'win_rate_pct')}, {r('100 * avg(realized_pnl)', 'avg_trade_pnl_pct')},
    {r('coalesce(100 * avg(realized_pnl) FILTER (realized_pnl > 0), 0)', 'avg_win_pnl_pct')}, {r('coalesce(100 * avg(realized_pnl) FILTER (realized_pnl < 0), 0)', 'avg_loss_pnl_pct')},
    {r('coalesce(sum(realized_pnl) FILTER (realized_pnl > 0), 0) / abs(sum(realized_pnl) FILTER (realized_pnl < 0))', 'profit_factor')},
    {r("avg(date_diff('second', entry_time, exit_time))", 'avg_duration')},
    count(*) FILTER (exit_reason = 'Stop Loss') AS stops, count(*) FILTER (exit_reason = 'Trailing Stop') AS trails, count(*) FILTER (exit_reason = 'Take Profit') AS targets
    FROM trades GROUP BY symbol"""
)
def trade_statistics(spark: SparkSession, folder: str) -> DataFrame:
    out = ledger.trade_metrics(_trades(spark, folder, SPEC)[2])
    pick = lambda k: F.coalesce(F.try_element_at("exit_reasons", F.lit(k)), F.lit(0)).cast("bigint")
    out = out.withColumns({"stops": pick("Stop Loss"), "trails": pick("Trailing Stop"), "targets": pick("Take Profit")})
    return rounded(out.drop("exit_reasons"))


@query(
    _sim_sql(SPEC)
    + f""", w AS (SELECT *, avg(CASE WHEN realized_pnl > 0 THEN 1.0 ELSE 0.0 END) OVER l AS wr, avg(realized_pnl) FILTER (realized_pnl > 0) OVER l AS aw, avg(-realized_pnl) FILTER (realized_pnl < 0) OVER l AS al
      FROM trades WINDOW l AS (PARTITION BY symbol ORDER BY entry_rn ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))
    SELECT symbol, entry_time, exit_time, {r('wr', 'win_rate')}, round(coalesce(last_value(aw / nullif(al, 0) IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY entry_rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2.0), 6) + 0.0 AS payoff_ratio FROM w"""
)
def recent_trades(spark: SparkSession, folder: str) -> DataFrame:
    out = ledger.recent_trade_stats(_trades(spark, folder, SPEC)[2])
    return rounded(out.select("symbol", "entry_time", "exit_time", "win_rate", "payoff_ratio"))


@query(
    _sim_sql(SPEC)
    + f""", c AS (SELECT symbol, ts, rn, equity, coalesce(equity / lag(equity) OVER (PARTITION BY symbol ORDER BY rn) - 1, 0.0) AS ret FROM curve),
    k AS (SELECT symbol, min(equity / peak - 1) AS mdd FROM (SELECT symbol, equity, max(equity) OVER (PARTITION BY symbol ORDER BY rn) AS peak FROM curve) GROUP BY symbol),
    s AS (SELECT symbol, last(equity ORDER BY rn) / first(equity ORDER BY rn) - 1 AS tot, count(*) AS n, stddev_samp(ret) * sqrt(252) AS vol, coalesce(stddev_samp(ret) FILTER (ret < 0) * sqrt(252), 0) AS dvol FROM c GROUP BY symbol),
    f AS (SELECT symbol, last(final ORDER BY rn) AS final FROM curve GROUP BY symbol),
    b AS (SELECT symbol, (last(close ORDER BY rn) / first(close ORDER BY rn) - 1) * 100 AS bh FROM ix GROUP BY symbol),
    t AS (SELECT symbol, count(*) AS n_trades, count(*) FILTER (realized_pnl > 0) AS wins, count(*) FILTER (realized_pnl < 0) AS losses, 100 * avg(realized_pnl) AS mean,
      coalesce(100 * avg(realized_pnl) FILTER (realized_pnl > 0), 0) AS mean_win, coalesce(100 * avg(realized_pnl) FILTER (realized_pnl < 0), 0) AS mean_loss,
      coalesce(sum(realized_pnl) FILTER (realized_pnl > 0), 0) / abs(sum(realized_pnl) FILTER (realized_pnl < 0)) AS pf, avg(date_diff('second', entry_time, exit_time)) AS held FROM trades GROUP BY symbol),
    g AS (SELECT *, pow(1 + tot, 252.0 / n) - 1 AS yearly FROM s JOIN k USING (symbol) JOIN b USING (symbol) JOIN f USING (symbol) LEFT JOIN t USING (symbol))
    SELECT symbol, {r('tot * 100', 'total_return_pct')}, {r('yearly * 100', 'annualized_return_pct')}, {r('vol * 100', 'volatility_pct')}, {r('mdd * 100', 'max_drawdown_pct')},
    {r('yearly / vol', 'sharpe_ratio')}, {r('yearly / dvol', 'sortino_ratio')}, {r('yearly / abs(mdd)', 'calmar_ratio')}, {r('bh', 'buy_and_hold_return_pct')},
    coalesce(n_trades, 0) AS num_trades, coalesce(wins, 0) AS num_winning_trades, coalesce(losses, 0) AS num_losing_trades, {r('coalesce(100.0 * wins / n_trades, 0)', 'win_rate_pct')},
    {r('mean', 'avg_trade_pnl_pct')}, {r('mean_win', 'avg_win_pnl_pct')}, {r('mean_loss', 'avg_loss_pnl_pct')}, {r('pf', 'profit_factor')}, {r('held', 'avg_duration')}, {r('final', 'final_capital', 5)} FROM g"""
)
def backtest_summary(spark: SparkSession, folder: str) -> DataFrame:
    out = ledger.backtest(predicted(spark, folder), SPEC).summary
    return rounded(rounded(out, raw=("final_capital",)), 5, raw=[c for c in out.columns if c != "final_capital"])


@query(with_bars("priority") + f" SELECT symbol, ts, round(10000.0 * close / first(close) OVER (PARTITION BY symbol ORDER BY rn), 5) + 0.0 AS benchmark_equity FROM ix")
def benchmark_curve(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ledger.benchmark_equity(indexed(spark, folder, "priority")), 5)


@query(
    _sim_sql(SPEC)
    + """, tr AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY entry_time, symbol) AS k, CASE WHEN symbol < '3' THEN 'urgent' ELSE 'normal' END AS g FROM trades),
    pf(k, held, took) AS (SELECT 0::BIGINT, []::STRUCT(b TIMESTAMP, s VARCHAR, g VARCHAR)[], false UNION ALL
      SELECT k, CASE WHEN ok THEN list_append(o, {'b': exit_time, 's': symbol, 'g': g}) ELSE o END, ok FROM (
        SELECT *, len(o) < 2 AND len(list_filter(o, lambda x: x.g = u.g)) < 1 AND len(list_filter(o, lambda x: x.s = u.symbol)) = 0 AS ok FROM (
          SELECT t.k, t.symbol, t.g, t.exit_time, list_filter(p.held, lambda x: x.b > t.entry_time) AS o FROM pf p JOIN tr t ON t.k = p.k + 1) u))
    SELECT symbol, entry_time, exit_time, """
    + r("realized_pnl", digits=5)
    + " FROM tr JOIN pf USING (k) WHERE took"
)
def portfolio_limits(spark: SparkSession, folder: str) -> DataFrame:
    """All symbols in one portfolio that holds at most two trades, one per priority group."""
    trades = _trades(spark, folder, SPEC)[2].withColumn("portfolio", F.lit("all"))
    grouped = trades.withColumn("sector", F.when(F.col("symbol") < "3", "urgent").otherwise("normal"))
    kept = ledger.concurrent_limits(grouped, max_open=2, max_correlated=1, group="sector")
    return rounded(kept.select("symbol", "entry_time", "exit_time", "realized_pnl"), 5)


def _portfolio_sql(spec: ledger.LedgerSpec, max_open: int, max_correlated: int) -> str:
    """Every candidate's exit on its own, then one walk over the candidates of all symbols in order of time.

    The walk carries what is open and each symbol's capital and peak.
    """
    live = f"bool_or(pnl >= {spec.trailing_activation}) OVER p" if spec.trailing is not None else "false"
    trail = spec.trailing if spec.trailing is not None else 0
    return (
        with_bars("priority", True)
        + _candidate_sql(spec)
        + f""", w AS (SELECT a.symbol, a.rn, b.rn AS brn, a.d, a.e, a.st, a.tg, b.close, a.d * (b.close - a.e) / a.e AS pnl
        FROM cand a JOIN ix b ON a.symbol = b.symbol AND b.rn > a.rn WHERE a.d <> 0 AND a.f > 0),
      act AS (SELECT *, {live} AS live FROM w WINDOW p AS (PARTITION BY symbol, rn ORDER BY brn)),
      bst AS (SELECT *, CASE WHEN d = 1 THEN max(CASE WHEN live THEN close END) OVER p ELSE min(CASE WHEN live THEN close END) OVER p END AS best FROM act WINDOW p AS (PARTITION BY symbol, rn ORDER BY brn)),
      hit AS (SELECT *, best * (1 - d * {trail}) AS tl, CASE WHEN d * (close - st) <= 0 THEN 'Stop Loss' WHEN live AND d * (close - best * (1 - d * {trail})) <= 0 THEN 'Trailing Stop'
        WHEN d * (close - tg) >= 0 THEN 'Take Profit' END AS why FROM bst),
      fst AS (SELECT symbol, rn, min(CASE WHEN why IS NOT NULL THEN brn END) AS x FROM hit GROUP BY 1, 2),
      ls AS (SELECT symbol, last(close ORDER BY rn) AS lc FROM ix GROUP BY 1),
      ord AS MATERIALIZED (SELECT row_number() OVER (ORDER BY c.ts, c.symbol) AS k, c.symbol, c.rn, c.ts, c.n_rows, c.f, c.e, c.d, CASE WHEN c.symbol < '3' THEN 'urgent' ELSE 'normal' END AS g,
        coalesce(f.x, c.n_rows - 1) AS x, f.x IS NULL AS at_end, coalesce(h.why, 'End of Backtest') AS why, i.ts AS left_at,
        c.d * (coalesce(CASE h.why WHEN 'Stop Loss' THEN h.st WHEN 'Trailing Stop' THEN h.tl WHEN 'Take Profit' THEN h.tg END, CASE WHEN c.rn = c.n_rows - 1 THEN c.close ELSE lc END) - c.e) / c.e AS pnl
        FROM cand c LEFT JOIN fst f USING (symbol, rn) LEFT JOIN hit h ON h.symbol = c.symbol AND h.rn = c.rn AND h.brn = f.x JOIN ls ON ls.symbol = c.symbol
        JOIN ix i ON i.symbol = c.symbol AND i.rn = coalesce(f.x, c.n_rows - 1) WHERE c.d <> 0),
      pf(k, held, caps, ok, tried, cap) AS (
        SELECT 0::BIGINT, []::STRUCT(b TIMESTAMP, s VARCHAR, g VARCHAR)[], (SELECT list({{'s': symbol, 'cap': {spec.initial_capital}::DOUBLE, 'peak': {spec.initial_capital}::DOUBLE}}) FROM ls), false, false, 0.0::DOUBLE
        UNION ALL
        SELECT k, CASE WHEN ok THEN list_append(o, {{'b': CASE WHEN at_end THEN left_at + INTERVAL 1 MICROSECOND ELSE left_at END, 's': symbol, 'g': g}}) ELSE o END,
          CASE WHEN try THEN list_transform(caps, lambda zz: CASE WHEN zz.s = symbol THEN {{'s': zz.s, 'cap': zz.cap * (1 - {spec.cost}) * (CASE WHEN ok THEN 1 + f * pnl ELSE 1 END), 'peak': greatest(zz.peak, zz.cap)}} ELSE zz END) ELSE caps END, ok, try, mine.cap
        FROM (SELECT *, try AND f > 0 AND len(o) < {max_open} AND len(list_filter(o, lambda zz: zz.g = g)) < {max_correlated}
            AND (greatest(mine.peak, mine.cap) - mine.cap) / greatest(mine.peak, mine.cap) < {spec.max_drawdown} AS ok
          FROM (SELECT *, len(list_filter(o, lambda zz: zz.s = symbol)) = 0 AS try FROM (
            SELECT t.*, p.caps, list_filter(p.held, lambda zz: zz.b > t.ts) AS o, list_filter(p.caps, lambda zz: zz.s = t.symbol)[1] AS mine FROM pf p JOIN ord t ON t.k = p.k + 1)))),
      done AS (SELECT ord.*, pf.ok, pf.cap FROM ord JOIN pf USING (k) WHERE pf.tried),
      ev AS (SELECT symbol, CASE WHEN ok AND at_end THEN least(rn + 1, n_rows - 1) ELSE rn + 1 END AS rn, (1 - {spec.cost})::DOUBLE AS m FROM done
        UNION ALL SELECT symbol, x, (1 + f * pnl)::DOUBLE FROM done WHERE ok),
      curve AS (SELECT i.symbol, i.ts, i.rn, {spec.initial_capital} * exp(sum(coalesce(l, 0)) OVER (PARTITION BY i.symbol ORDER BY i.rn)) AS equity
        FROM ix i LEFT JOIN (SELECT symbol, rn, sum(ln(m)) AS l FROM ev GROUP BY 1, 2) e USING (symbol, rn))"""
    )


def _portfolio(spark: SparkSession, folder: str, spec: ledger.LedgerSpec, max_open: int, max_correlated: int) -> ledger.Backtest:
    df = predicted(spark, folder).withColumn("sector", F.when(F.col("symbol") < "3", "urgent").otherwise("normal"))
    return ledger.backtest(df, spec, portfolio=ledger.Portfolio(max_open, max_correlated, "sector"))


_HELD = f" SELECT symbol, d::INT AS direction, ts AS entry_time, left_at AS exit_time, why AS exit_reason, {r('pnl', 'realized_pnl', 5)}, {r('cap * (1 - {cost}) * f / e', 'size', 5)} FROM done WHERE ok"
_HELD_COLS = ("symbol", "direction", "entry_time", "exit_time", "exit_reason", "realized_pnl", "size")


@query(_portfolio_sql(SPEC, 2, 1) + _HELD.replace("{cost}", str(SPEC.cost)))
def portfolio_backtest(spark: SparkSession, folder: str) -> DataFrame:
    """Trades of all symbols that compete for two places, one per priority group."""
    return rounded(_portfolio(spark, folder, SPEC, 2, 1).trades.select(*_HELD_COLS), 5)


@query(_portfolio_sql(SPEC, 2, 1) + f" SELECT symbol, ts, {r('equity', digits=3)} FROM curve WHERE rn > 0")
def portfolio_equity(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_portfolio(spark, folder, SPEC, 2, 1).equity, 3)


@query(
    _portfolio_sql(SPEC, 2, 1)
    + f""", t AS (SELECT symbol, count(*) AS n, count(*) FILTER (pnl > 0) AS wins, avg(pnl) AS mean FROM done WHERE ok GROUP BY symbol), f AS (SELECT symbol, last(equity ORDER BY rn) AS equity FROM curve GROUP BY symbol)
    SELECT symbol, coalesce(n, 0) AS num_trades, coalesce(wins, 0) AS num_winning_trades, {r('100 * mean', 'avg_trade_pnl_pct', 5)}, {r('equity', 'final_capital', 3)} FROM f LEFT JOIN t USING (symbol)"""
)
def portfolio_summary(spark: SparkSession, folder: str) -> DataFrame:
    out = _portfolio(spark, folder, SPEC, 2, 1).summary.select("symbol", "num_trades", "num_winning_trades", "avg_trade_pnl_pct", "final_capital")
    return rounded(rounded(out, 5, raw=("final_capital",)), 3, raw=("avg_trade_pnl_pct",))


@query(_portfolio_sql(STRICT, 3, 2) + _HELD.replace("{cost}", str(STRICT.cost)))
def portfolio_drawdown_limit(spark: SparkSession, folder: str) -> DataFrame:
    """Symbols that reach their drawdown limit leave their places to the others."""
    return rounded(_portfolio(spark, folder, STRICT, 3, 2).trades.select(*_HELD_COLS), 5)


# --- performance ------------------------------------------------------------

_RETURNS = f", rt AS (SELECT symbol, ts, rn, 0.001 * (close / nullif({lag('close')}, 0) - 1) AS ret FROM ix), rr AS MATERIALIZED (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS rn, ret FROM rt WHERE rn > 0)"


def returns(spark: SparkSession, folder: str, which: str = "brand") -> DataFrame:
    """Scaled close-to-close returns without the first bar of each symbol."""

    def build(d: DataFrame, w) -> DataFrame:
        return d.withColumn("ret", 0.001 * pct_change("close", w))

    out = over_chunks(indexed(spark, folder, which), build, back=1)
    return out.filter(F.col(RN) > 0).select("symbol", "ts", "ret")


_RM = f"""
  a AS (SELECT symbol, count(*) AS n, exp(sum(ln(1 + ret))) - 1 AS total_return, count(*) FILTER (ret > 0) AS win_days, count(*) FILTER (ret < 0) AS lose_days,
    avg(ret) AS avg_return, coalesce(avg(ret) FILTER (ret > 0), 0) AS avg_win, coalesce(avg(ret) FILTER (ret < 0), 0) AS avg_loss, stddev_samp(ret) * sqrt(252) AS volatility,
    coalesce(stddev_samp(ret) FILTER (ret < 0) * sqrt(252), 0) AS downside_volatility, sum(ret) FILTER (ret > 0) AS gain, abs(sum(ret) FILTER (ret < 0)) AS pain,
    quantile_cont(ret, 0.05) AS var_95, avg(ret) AS m FROM rr GROUP BY symbol),
  mo AS (SELECT symbol, avg(pow(ret - m, 2)) AS m2, avg(pow(ret - m, 3)) AS m3, avg(pow(ret - m, 4)) AS m4, avg(ret) FILTER (ret <= var_95) AS cvar_95 FROM rr JOIN a USING (symbol) GROUP BY symbol),
  wl AS (SELECT symbol, rn, exp(sum(ln(1 + ret)) OVER (PARTITION BY symbol ORDER BY rn)) AS wealth FROM rr),
  pk AS (SELECT *, max(wealth) OVER (PARTITION BY symbol ORDER BY rn) AS peak FROM wl),
  md AS (SELECT symbol, min((wealth - peak) / peak) AS max_drawdown FROM pk GROUP BY symbol),
  lgd AS (SELECT symbol, ret, lag(ret) OVER (PARTITION BY symbol ORDER BY rn) AS pr FROM rr), ac AS (SELECT symbol, corr(ret, pr) AS autocorrelation_1d FROM lgd GROUP BY symbol),
  isl AS (SELECT symbol, sign(ret) AS s, rn - row_number() OVER (PARTITION BY symbol, sign(ret) ORDER BY rn) AS g FROM rr),
  run AS (SELECT symbol, s, g, count(*) AS n FROM isl GROUP BY 1, 2, 3),
  sk AS (SELECT symbol, coalesce(max(n) FILTER (s > 0), 0) AS max_consecutive_wins, coalesce(max(n) FILTER (s < 0), 0) AS max_consecutive_losses FROM run GROUP BY symbol),
  al AS (SELECT *, pow(1 + total_return, 252.0 / n) - 1 AS annualized_return, m3 / pow(m2, 1.5) AS skewness, m4 / (m2 * m2) - 3 AS kurtosis FROM a JOIN mo USING (symbol) JOIN md USING (symbol) JOIN ac USING (symbol) JOIN sk USING (symbol))"""


@query(
    with_bars()
    + _RETURNS
    + ","
    + _RM
    + f""" SELECT symbol, win_days, lose_days, max_consecutive_wins, max_consecutive_losses, {rs('total_return', 'annualized_return')}, {rs('avg_return', 'avg_win', 'avg_loss', 'volatility', 'downside_volatility', 'max_drawdown', 'var_95', 'cvar_95')},
    {r('win_days / n', 'win_rate')}, {r('annualized_return / volatility', 'sharpe_ratio')}, {r('annualized_return / downside_volatility', 'sortino_ratio')}, {r('annualized_return / abs(max_drawdown)', 'calmar_ratio')},
    {r('gain / pain', 'profit_factor')}, {r('abs(avg_win / avg_loss)', 'win_loss_ratio')}, {rs('skewness', 'kurtosis', 'autocorrelation_1d')},
    {r('n / 6 * (skewness ^ 2 + kurtosis ^ 2 / 4)', 'jb_statistic')}, {r('exp(-n / 6 * (skewness ^ 2 + kurtosis ^ 2 / 4) / 2)', 'jb_pvalue')} FROM al"""
)
def return_figures(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(performance.return_metrics(returns(spark, folder)))


_EQUITY = ", eq AS MATERIALIZED (SELECT symbol, ts, rn, exp(sum(ln(1 + ret)) OVER (PARTITION BY symbol ORDER BY rn)) * 100 AS equity FROM rr)"
_DRAWDOWNS = """,
  pe AS (SELECT *, max(equity) OVER (PARTITION BY symbol ORDER BY rn) AS peak FROM eq),
  dd AS (SELECT *, (equity - peak) / peak AS dd, sum(CASE WHEN equity < peak THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY rn) AS g, lead(ts) OVER (PARTITION BY symbol ORDER BY rn) AS nx FROM pe),
  ep AS (SELECT symbol, g, min(ts) AS start_date, max(ts) AS end_date, arg_min(ts, dd) AS lowest_point_date, last(nx ORDER BY rn) AS recovery_date, min(dd) AS max_drawdown FROM dd WHERE dd < 0 GROUP BY symbol, g)"""


def _equity(spark: SparkSession, folder: str) -> DataFrame:
    df = index_series(returns(spark, folder))
    return performance.running_product(df, 1 + F.col("ret"), "equity").withColumn("equity", F.col("equity") * 100)


_EPISODE = (
    "symbol, start_date, end_date, lowest_point_date, recovery_date, "
    + r("max_drawdown")
    + ", date_diff('day', start_date, end_date) AS duration_days, date_diff('day', lowest_point_date, recovery_date) AS recovery_duration_days"
)


@query(with_bars() + _RETURNS + _EQUITY + _DRAWDOWNS + f" SELECT {_EPISODE} FROM ep")
def drawdown_episodes(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(performance.drawdowns(_equity(spark, folder)))


@query(
    with_bars() + _RETURNS + _EQUITY + _DRAWDOWNS
    + f", rk AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY max_drawdown, start_date) AS rank FROM ep) SELECT {_EPISODE}, rank FROM rk WHERE rank <= 3"
)
def worst_drawdowns(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(performance.top_drawdowns(performance.drawdowns(_equity(spark, folder)), 3))


@query(
    with_bars() + _RETURNS
    + f", mk AS (SELECT ts, avg(ret) AS bench FROM rr GROUP BY ts) SELECT symbol, {r('regr_intercept(ret, bench) * 252', 'alpha')}, {r('regr_slope(ret, bench)', 'beta')} FROM rr JOIN mk USING (ts) GROUP BY symbol"
)
def alpha_and_beta(spark: SparkSession, folder: str) -> DataFrame:
    df = returns(spark, folder)
    market = df.groupBy("ts").agg(F.avg("ret").alias("bench"))
    return rounded(performance.alpha_beta(df, market))


@query(
    with_bars() + _RETURNS
    + ", mr AS (SELECT symbol, year(ts) AS year, month(ts) AS m, exp(sum(ln(1 + ret))) - 1 AS ret FROM rr GROUP BY 1, 2, 3) SELECT symbol, year, "
    + ", ".join(r(f"max(ret) FILTER (m = {m})", f"m{m:02d}") for m in range(1, 13))
    + " FROM mr GROUP BY symbol, year"
)
def monthly_return_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(performance.monthly_matrix(returns(spark, folder)))


@query(
    _sim_sql(SPEC)
    + f""", pl AS (SELECT symbol, exit_time AS ts, sum((exit_price - entry_price) * size * direction - 1.0) AS p FROM trades GROUP BY 1, 2),
    cu AS (SELECT symbol, ts, 10000.0 + sum(p) OVER (PARTITION BY symbol ORDER BY ts) AS equity FROM pl)
    SELECT symbol, ts, round(coalesce(last_value(equity IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 10000.0), 3) + 0.0 AS equity
    FROM (SELECT symbol, ts FROM bars) LEFT JOIN cu USING (symbol, ts)"""
)
def equity_from_closed_trades(spark: SparkSession, folder: str) -> DataFrame:
    df, _, trades = _trades(spark, folder, SPEC)
    return rounded(performance.equity_from_trades(trades.withColumn("commission", F.lit(1.0)), df, 10000.0), 3)
