"""Technical indicators, feature sets and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.catalog.base import BARS, bars, indexed, query, r, rs, with_bars
from tickloom.functions.columns import rounded
from tickloom.operators import clean
from tickloom.operators import features as ft
from tickloom.operators import indicators as ind
from tickloom.operators import labels as lab
from tickloom.plans.series import N_ROWS, RN


def ewm_cte(name: str, source: str, values: dict[str, tuple[str, float]]) -> str:
    """Recursive CTE with one average per entry of {output: (column, alpha)}.

    An average starts at the first non-null value. Source columns: symbol, rn.
    """
    def step(out: str, x: str, a: float) -> str:
        return f"CASE WHEN e.{out} IS NULL THEN s.{x} WHEN s.{x} IS NULL THEN e.{out} ELSE (1 - {a!r}) * e.{out} + {a!r} * s.{x} END"

    outs = ", ".join(values)
    first = ", ".join(f"{x}::DOUBLE" for x, _ in values.values())
    nxt = ", ".join(step(o, x, a) for o, (x, a) in values.items())
    return (
        f"{name}(symbol, rn, {outs}) AS (SELECT symbol, rn, {first} FROM {source} WHERE rn = 0 UNION ALL "
        f"SELECT s.symbol, s.rn, {nxt} FROM {name} e JOIN {source} s ON s.symbol = e.symbol AND s.rn = e.rn + 1)"
    )


def gap_ewm_cte(name: str, source: str, values: dict[str, tuple[str, float]]) -> str:
    """`ewm_cte` for columns with gaps: {out}_w is the weight the old average still has."""
    outs, first, nxt = [], [], []
    for o, (x, a) in values.items():
        old = f"({1 - a!r} * e.{o}_w)"
        outs += [o, f"{o}_w"]
        first += [f"{x}::DOUBLE", "1.0::DOUBLE"]
        nxt.append(f"CASE WHEN e.{o} IS NULL THEN s.{x} WHEN s.{x} IS NULL THEN e.{o} ELSE ({old} * e.{o} + {a!r} * s.{x}) / ({old} + {a!r}) END")
        nxt.append(f"CASE WHEN s.{x} IS NULL THEN {old} ELSE 1.0 END")
    return (
        f"{name}(symbol, rn, {', '.join(outs)}) AS (SELECT symbol, rn, {', '.join(first)} FROM {source} WHERE rn = 0 UNION ALL "
        f"SELECT s.symbol, s.rn, {', '.join(nxt)} FROM {name} e JOIN {source} s ON s.symbol = e.symbol AND s.rn = e.rn + 1)"
    )


def span(n: int) -> float:
    return 2.0 / (n + 1)


def roll(agg: str, n: int, counted: str | None = None) -> str:
    """Rolling SQL aggregate over n rows, NULL unless all n values are present."""
    inner = counted or agg[agg.index("(") + 1 : agg.rindex(")")]
    w = f"OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({inner}) {w} = {n} THEN {agg} {w} END"


def lag(c: str, n: int = 1) -> str:
    return f"lag({c}, {n}) OVER (PARTITION BY symbol ORDER BY rn)"


def _out(df: DataFrame, *names: str) -> DataFrame:
    return rounded(df.select("symbol", "ts", *[F.col(f"`{n}`") for n in names]))


@query(with_bars("priority") + f" SELECT symbol, ts, {r(roll('avg(close)', 50), 'sma_length50')}, {r(roll('avg(close)', 200), 'slow')} FROM ix")
def simple_moving_average(spark: SparkSession, folder: str) -> DataFrame:
    df = ind.sma(ind.sma(indexed(spark, folder, "priority"), 50), 200, name="slow")
    return _out(df, "sma_length50", "slow")


_BB = (
    with_bars()
    + f", b AS (SELECT symbol, ts, {roll('avg(close)', 20)} AS m, {roll('stddev_samp(close)', 20)} AS d FROM ix) "
    + f"SELECT symbol, ts, {r('m - 2.0 * d', 'lower', 4)}, {r('m', 'middle', 4)}, {r('m + 2.0 * d', 'upper', 4)} FROM b"
)


@query(_BB)
def bollinger_bands(spark: SparkSession, folder: str) -> DataFrame:
    df = ind.bollinger(indexed(spark, folder))
    named = {"BBL_20_2.0": "lower", "BBM_20_2.0": "middle", "BBU_20_2.0": "upper"}
    return rounded(df.select("symbol", "ts", *[F.col(f"`{c}`").alias(n) for c, n in named.items()]), 4)


@query(
    with_bars("brand", True)
    + f", {ewm_cte('e', 'ix', {'fast': ('close', span(12)), 'slow': ('close', span(50))})} "
    + f"SELECT symbol, ts, {r('CASE WHEN rn >= 11 THEN fast END', 'ema_length12')}, {r('CASE WHEN rn >= 49 THEN slow END', 'ema_length50')} FROM ix JOIN e USING (symbol, rn)"
)
def exponential_moving_average(spark: SparkSession, folder: str) -> DataFrame:
    return _out(ind.ema(ind.ema(indexed(spark, folder), 12), 50), "ema_length12", "ema_length50")


_TR = f"CASE WHEN {lag('close')} IS NOT NULL THEN greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) END"


@query(
    with_bars("brand", True)
    + f", d AS MATERIALIZED (SELECT symbol, ts, rn, close, {_TR} AS tr FROM ix), {ewm_cte('e', 'd', {'y': ('tr', 1 / 14)})}, "
    + "o AS (SELECT symbol, ts, close, CASE WHEN rn >= 14 THEN y END AS atr FROM d JOIN e USING (symbol, rn)) "
    + f"SELECT symbol, ts, {r('atr', 'atr_length14', 4)}, {r('coalesce(atr / nullif(close, 0), 0.0)', 'ATRr_14', 4)} FROM o"
)
def average_true_range(spark: SparkSession, folder: str) -> DataFrame:
    df = ind.atr(indexed(spark, folder), 14, ratio=True)
    return rounded(df.select("symbol", "ts", "atr_length14", "ATRr_14"), 4)


_MOVE = f"coalesce(close - {lag('close')}, 0.0)"


@query(
    with_bars("brand", True)
    + f", d AS MATERIALIZED (SELECT symbol, ts, rn, greatest({_MOVE}, 0.0) AS g, greatest(-({_MOVE}), 0.0) AS l FROM ix), "
    + ewm_cte("e", "d", {"eg": ("g", 1 / 14), "el": ("l", 1 / 14)})
    + f" SELECT symbol, ts, {r('CASE WHEN rn >= 14 AND el <> 0 THEN 100 - 100 / (1 + eg / el) END', 'rsi_length14')} FROM d JOIN e USING (symbol, rn)"
)
def relative_strength(spark: SparkSession, folder: str) -> DataFrame:
    return _out(ind.rsi(indexed(spark, folder), 14), "rsi_length14")


# Hourly bars in steps of half an hour: every second bar, and every idle hour, is empty.
_GAPPY = (
    f"WITH RECURSIVE bars AS MATERIALIZED ({BARS['event']}), "
    "spans AS (SELECT symbol, min(ts) AS lo, max(ts) AS hi FROM bars GROUP BY symbol), "
    "bins AS (SELECT symbol, unnest(generate_series(lo, hi, INTERVAL 30 MINUTES)) AS ts FROM spans), "
    "ix AS MATERIALIZED (SELECT symbol, ts, open, high, low, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS rn "
    "FROM bins LEFT JOIN bars USING (symbol, ts))"
)


def _gappy(spark: SparkSession, folder: str) -> DataFrame:
    return clean.resample(bars(spark, folder, "event"), "30 minutes")


def seen(column: str, n: int) -> str:
    return f"count({column}) OVER (PARTITION BY symbol ORDER BY rn) >= {n}"


@query(
    _GAPPY
    + f", {gap_ewm_cte('e', 'ix', {'y': ('close', span(12))})}, o AS (SELECT symbol, ts, CASE WHEN {seen('close', 12)} THEN y END AS y FROM ix JOIN e USING (symbol, rn)) "
    + f"SELECT symbol, ts, {r('y', 'ema_length12')} FROM o"
)
def ema_with_gaps(spark: SparkSession, folder: str) -> DataFrame:
    return _out(ind.ema(_gappy(spark, folder), 12), "ema_length12")


@query(
    _GAPPY
    + f", d AS MATERIALIZED (SELECT symbol, ts, rn, close, {_TR} AS tr FROM ix), {gap_ewm_cte('e', 'd', {'y': ('tr', 1 / 14)})}, "
    + f"o AS (SELECT symbol, ts, close, CASE WHEN {seen('tr', 14)} THEN y END AS atr FROM d JOIN e USING (symbol, rn)) "
    + f"SELECT symbol, ts, {r('atr', 'atr_length14')}, {r('coalesce(atr / nullif(close, 0), 0.0)', 'ATRr_14')} FROM o"
)
def atr_with_gaps(spark: SparkSession, folder: str) -> DataFrame:
    return _out(ind.atr(_gappy(spark, folder), 14, ratio=True), "atr_length14", "ATRr_14")


@query(
    _GAPPY
    + f", {gap_ewm_cte('e', 'ix', {'f': ('close', span(12)), 's': ('close', span(26))})}"
    + f", m AS MATERIALIZED (SELECT symbol, ts, rn, CASE WHEN {seen('close', 26)} THEN f - s END AS line FROM ix JOIN e USING (symbol, rn)), "
    + f"{gap_ewm_cte('g', 'm', {'sig': ('line', span(9))})}, "
    + f"o AS (SELECT symbol, ts, line, CASE WHEN {seen('line', 9)} THEN sig END AS sig FROM m JOIN g USING (symbol, rn)) "
    + f"SELECT symbol, ts, {r('line', 'macd')}, {r('sig', 'signal')}, {r('line - sig', 'histogram')} FROM o"
)
def macd_with_gaps(spark: SparkSession, folder: str) -> DataFrame:
    df = ind.macd(_gappy(spark, folder))
    return rounded(
        df.select(
            "symbol", "ts", F.col("MACD_12_26").alias("macd"), F.col("MACDs_9").alias("signal"), F.col("MACDh_12_26_9").alias("histogram")
        )
    )


@query(
    with_bars("brand", True)
    + ", "
    + ewm_cte("e", "ix", {"f": ("close", span(12)), "s": ("close", span(26))})
    + ", m AS MATERIALIZED (SELECT symbol, rn, CASE WHEN rn >= 25 THEN f - s END AS line FROM e), "
    + ewm_cte("g", "m", {"sig": ("line", span(9))})
    + f""" SELECT symbol, ts, {r('line', 'macd')}, {r('CASE WHEN rn >= 33 THEN sig END', 'signal')},
      {r('CASE WHEN rn >= 33 THEN line - sig END', 'histogram')} FROM ix JOIN m USING (symbol, rn) JOIN g USING (symbol, rn)"""
)
def moving_average_convergence(spark: SparkSession, folder: str) -> DataFrame:
    df = ind.macd(indexed(spark, folder))
    return rounded(
        df.select(
            "symbol", "ts", F.col("MACD_12_26").alias("macd"), F.col("MACDs_9").alias("signal"), F.col("MACDh_12_26_9").alias("histogram")
        )
    )


@query(
    with_bars("brand", True)
    + f""", u AS (SELECT *, {_TR} AS tr, high - {lag('high')} AS up, {lag('low')} - low AS down FROM ix),
    d AS MATERIALIZED (SELECT symbol, ts, rn, tr, CASE WHEN up > down AND up > 0 THEN up ELSE 0.0 END AS p,
      CASE WHEN down > up AND down > 0 THEN down ELSE 0.0 END AS n FROM u),
    {ewm_cte('e', 'd', {'a': ('tr', 1 / 14), 'ep': ('p', 1 / 14), 'en': ('n', 1 / 14)})},
    l AS (SELECT symbol, rn, CASE WHEN rn >= 14 AND a <> 0 THEN 100.0 * ep / a END AS pdi, CASE WHEN rn >= 14 AND a <> 0 THEN 100.0 * en / a END AS ndi FROM e),
    x AS MATERIALIZED (SELECT symbol, rn, pdi, ndi, CASE WHEN rn >= 13 THEN 100.0 * abs(pdi - ndi) / nullif(abs(pdi + ndi), 0) END AS dx FROM l),
    {ewm_cte('y', 'x', {'adx': ('dx', 1 / 14)})},
    f AS (SELECT symbol, min(rn) AS seed FROM x WHERE dx IS NOT NULL GROUP BY symbol)
    SELECT symbol, ts, {r('CASE WHEN rn - seed >= 13 AND rn >= 26 THEN adx END', 'adx')}, {r('pdi', 'plus_di')}, {r('ndi', 'minus_di')}
    FROM ix JOIN x USING (symbol, rn) JOIN y USING (symbol, rn) LEFT JOIN f USING (symbol)"""
)
def directional_index(spark: SparkSession, folder: str) -> DataFrame:
    df = ind.adx(indexed(spark, folder))
    return rounded(df.select("symbol", "ts", F.col("ADX_14").alias("adx"), F.col("DMP_14").alias("plus_di"), F.col("DMN_14").alias("minus_di")))


_CUM = "OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query(
    with_bars()
    + f", d AS (SELECT symbol, ts, rn, coalesce(volume * sign(close - {lag('close')}), 0.0) AS f FROM ix) SELECT symbol, ts, {r(f'sum(f) {_CUM}', 'obv')} FROM d"
)
def on_balance_volume(spark: SparkSession, folder: str) -> DataFrame:
    return _out(ind.obv(indexed(spark, folder)), "obv")


@query(
    with_bars()
    + f""", t AS (SELECT *, (high + low + close) / 3 AS tp FROM ix), m AS (SELECT *, tp - {lag('tp')} AS mv FROM t),
    f AS (SELECT *, CASE WHEN mv > 0 THEN tp * volume ELSE 0.0 END AS pos, CASE WHEN mv < 0 THEN tp * volume ELSE 0.0 END AS neg FROM m),
    w AS (SELECT *, {roll('sum(pos)', 14)} AS sp, {roll('sum(neg)', 14)} AS sn FROM f)
    SELECT symbol, ts, {r('CASE WHEN n_rows >= 15 AND sn <> 0 THEN 100 - 100 / (1 + sp / sn) END', 'mfi_length14')} FROM w"""
)
def money_flow(spark: SparkSession, folder: str) -> DataFrame:
    return _out(ind.mfi(indexed(spark, folder), 14), "mfi_length14")


@query(
    with_bars("brand", True)
    + f", {ewm_cte('e', 'ix', {'y': ('close', span(10))})}, d AS (SELECT symbol, rn, coalesce(volume * sign(close - {lag('close')}), 0.0) AS f FROM ix), "
    + f"o AS (SELECT symbol, rn, sum(f) {_CUM} AS obv FROM d), w AS (SELECT symbol, ts, rn, {roll('avg(close)', 20)} AS sma, {roll('stddev_samp(close)', 20)} AS sd FROM ix) "
    + f"SELECT symbol, ts, {r('sma', 'sma_length20')}, {r('CASE WHEN rn >= 9 THEN y END', 'ema_length10')}, {rs('obv')}, "
    + f"{r('sma + 2.0 * sd', 'bollinger_upper')} FROM w JOIN e USING (symbol, rn) JOIN o USING (symbol, rn)"
)
def indicator_list(spark: SparkSession, folder: str) -> DataFrame:
    configs = [
        {"indicator": "sma", "length": 20},
        {"indicator": "ema", "length": 10},
        {"indicator": "obv"},
        {"indicator": "bollinger_bands", "length": 20, "std": 2.0},
    ]
    df = ind.add_indicators(bars(spark, folder), configs)
    upper = F.col("`bollinger_bands_BBU_20_2.0`").alias("bollinger_upper")
    return rounded(df.select("symbol", "ts", "sma_length20", "ema_length10", "obv", upper))


def _features(spark: SparkSession, folder: str, which: str, *sets: ft.FeatureSet, digits: int = 6) -> DataFrame:
    df = ft.add_features(indexed(spark, folder, which), list(sets))
    base = {"open", "high", "low", "close", "volume", RN, N_ROWS}
    return rounded(df.drop(*base), digits)


_RET = f"ret AS (SELECT *, close / nullif({lag('close')}, 0) - 1 AS ret FROM ix)"


@query(
    with_bars("event")
    + f", {_RET} SELECT symbol, ts, {r('ret', '\"return\"')}, {r('CASE WHEN ret > -1 THEN ln(ret + 1) END', 'log_return')}, {lag('close')} AS close_lag1, isodow(ts)::INTEGER - 1 AS day_of_week FROM ret"
)
def returns_and_calendar(spark: SparkSession, folder: str) -> DataFrame:
    return _features(spark, folder, "event", ft.base_features())


@query(
    with_bars("priority")
    + f""", {_RET}, hl AS (SELECT *, CASE WHEN high > 0 AND low > 0 THEN ln(high / low) ^ 2 END AS hl FROM ret),
    v AS (SELECT *, {roll('stddev_samp(ret)', 5)} AS volatility_5, {roll('stddev_samp(ret)', 10)} AS volatility_10,
      {roll('stddev_samp(ret)', 20)} AS volatility_20, {roll('stddev_samp(ret)', 50)} AS volatility_50,
      sqrt({roll('avg(hl)', 20)} / (4 * ln(2))) AS parkinson_vol_20 FROM hl)
    SELECT symbol, ts, {rs('volatility_5', 'volatility_10', 'volatility_20', 'volatility_50')},
    {r('volatility_20 / nullif(volatility_50, 0)', 'volatility_ratio_20_50')}, {r(roll('stddev_samp(volatility_20)', 20), 'vol_of_vol_20')},
    {rs('parkinson_vol_20')} FROM v"""
)
def volatility_set(spark: SparkSession, folder: str) -> DataFrame:
    return _features(spark, folder, "priority", ft.volatility_features())


def _er(n: int) -> str:
    return f"abs(close - {lag('close', n)}) / nullif({roll('sum(step)', n)}, 0)"


_STEP = f"st AS (SELECT *, abs(close - {lag('close')}) AS step FROM ix)"


@query(with_bars() + f", {_STEP} SELECT symbol, ts, {r(_er(10), 'efficiency_ratio_10')}, {r(_er(20), 'efficiency_ratio_20')} FROM st")
def efficiency_ratios(spark: SparkSession, folder: str) -> DataFrame:
    return _features(spark, folder, "brand", ft.efficiency_ratio(10), ft.efficiency_ratio(20))


@query(
    with_bars()
    + """, s AS (SELECT *, generate_series(0, greatest(0, floor((log10(n_rows - 1) - 1.0) * 4)::INT)) AS i FROM ix WHERE n_rows >= 100),
    z AS (SELECT * EXCLUDE (i), unnest(list_distinct(list_append(list_filter(list_transform(i, lambda k: floor(pow(10.0, 1.0 + k * 0.25))::BIGINT), lambda w: w < n_rows - 1), n_rows))) AS size FROM s),
    """
    + f"p AS (SELECT symbol, rn, close / nullif({lag('close')}, 0) - 1 AS ret FROM ix), "
    + """b AS (SELECT z.symbol, size, rn // size AS block, count(*) AS c, max(close) / nullif(min(close), 0) - 1 AS rg,
      stddev_samp(CASE WHEN rn % size <> 0 THEN ret END) AS dev FROM z JOIN p USING (symbol, rn) GROUP BY 1, 2, 3),
    a AS (SELECT symbol, size, avg(rg / dev) AS rs FROM b WHERE c = size AND rg <> 0 AND dev <> 0 GROUP BY 1, 2),
    h AS (SELECT symbol, regr_slope(log10(rs), log10(size)) AS h FROM a GROUP BY 1)
    SELECT symbol, round(coalesce(h, 0.5), 6) + 0.0 AS hurst FROM (SELECT DISTINCT symbol FROM bars) LEFT JOIN h USING (symbol)"""
)
def hurst_exponent(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ft.hurst(indexed(spark, folder)))


@query(
    with_bars("priority")
    + f""", m AS (SELECT *, {roll('avg(close)', 20)} AS a, {roll('avg(close)', 50)} AS b, {roll('avg(close)', 200)} AS c FROM ix)
    SELECT symbol, ts, coalesce((close > b)::INT, 0) AS close_gt_sma50, coalesce((close > c)::INT, 0) AS close_gt_sma200,
    coalesce((a > b)::INT, 0) AS sma20_gt_sma50 FROM m"""
)
def trend_flag_set(spark: SparkSession, folder: str) -> DataFrame:
    return _features(spark, folder, "priority", ft.trend_flags())


@query(
    with_bars("priority")
    + f", {_RET} SELECT symbol, ts, {r(roll('stddev_samp(ret)', 20) + ' / nullif(' + roll('stddev_samp(ret)', 100) + ', 0)', 'volatility_regime')} FROM ret"
)
def volatility_regime_ratio(spark: SparkSession, folder: str) -> DataFrame:
    return _features(spark, folder, "priority", ft.volatility_regime())


@query(
    with_bars()
    + f""", p AS (SELECT *, close / nullif({lag('close')}, 0) - 1 AS ret, volume / nullif({lag('volume')}, 0) - 1 AS vr FROM ix)
    SELECT symbol, ts, {r('volume / nullif(' + roll('avg(volume)', 20) + ', 0)', 'volume_ratio')},
    {r(roll('corr(ret, vr)', 20, 'CASE WHEN ret IS NOT NULL AND vr IS NOT NULL THEN 1 END'), 'price_volume_corr')} FROM p"""
)
def volume_set(spark: SparkSession, folder: str) -> DataFrame:
    return _features(spark, folder, "brand", ft.volume_features())


_NEAR = "OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN {a} AND {b})"
_BEFORE = _NEAR.format(a="2 PRECEDING", b="1 PRECEDING")
_AFTER = _NEAR.format(a="1 FOLLOWING", b="2 FOLLOWING")
_FRACTAL = (
    f"CASE WHEN rn >= 2 AND rn < n_rows - 2 AND low < min(low) {_BEFORE} AND low < min(low) {_AFTER} THEN 1 ELSE 0 END AS bullish, "
    f"CASE WHEN rn >= 2 AND rn < n_rows - 2 AND high > max(high) {_BEFORE} AND high > max(high) {_AFTER} THEN 1 ELSE 0 END AS bearish"
)


@query(with_bars() + f", f AS (SELECT *, {_FRACTAL} FROM ix) SELECT symbol, ts, bullish AS bullish_fractal_5, bearish AS bearish_fractal_5 FROM f")
def fractal_set(spark: SparkSession, folder: str) -> DataFrame:
    return _features(spark, folder, "brand", ft.fractals(5))


@query(
    with_bars()
    + f""", f AS (SELECT *, {_FRACTAL}, {roll('max(high)', 50)} AS top, {roll('min(low)', 50)} AS bot FROM ix),
    g AS (SELECT *, (close - top) / nullif(top, 0) AS dh, (close - bot) / nullif(bot, 0) AS dl FROM f)
    SELECT symbol, ts, bullish AS bullish_fractal, bearish AS bearish_fractal, {r('dh', 'dist_from_recent_high')}, {r('dl', 'dist_from_recent_low')},
    coalesce((abs(dh) < 0.01)::INT, 0) AS near_resistance, coalesce((abs(dl) < 0.01)::INT, 0) AS near_support FROM g"""
)
def support_resistance_set(spark: SparkSession, folder: str) -> DataFrame:
    return _features(spark, folder, "brand", ft.support_resistance())


@query(
    with_bars("event")
    + f""" SELECT symbol, ts, {r('abs(close - open) / nullif(open, 0)', 'body_size')},
    {r('(high - greatest(open, close)) / nullif(open, 0)', 'upper_shadow')}, {r('(least(open, close) - low) / nullif(open, 0)', 'lower_shadow')} FROM ix"""
)
def candle_set(spark: SparkSession, folder: str) -> DataFrame:
    return _features(spark, folder, "event", ft.candle_features())


@query(
    with_bars("event")
    + " SELECT symbol, ts, " + ", ".join(r(f"close / nullif({lag('close', n)}, 0) - 1", f"roc_{n}") for n in (5, 10, 20)) + " FROM ix"
)
def momentum_set(spark: SparkSession, folder: str) -> DataFrame:
    return _features(spark, folder, "event", ft.momentum_features())


@query(
    with_bars("event")
    + f""", t AS (SELECT *, (high + low + close) / 3 * volume AS tpv FROM ix),
    v AS (SELECT *, {roll('sum(tpv)', 20)} / {roll('sum(volume)', 20)} AS a, {roll('sum(tpv)', 50)} / {roll('sum(volume)', 50)} AS b FROM t)
    SELECT symbol, ts, {r('a', 'vwap_roll_20', 9)}, {r('(close - a) / nullif(a, 0)', 'dist_from_vwap_roll_20', 9)},
    {r('b', 'vwap_roll_50', 9)}, {r('(close - b) / nullif(b, 0)', 'dist_from_vwap_roll_50', 9)} FROM v"""
)
def vwap_set(spark: SparkSession, folder: str) -> DataFrame:
    return _features(spark, folder, "event", ft.vwap_features(), digits=9)


@query(
    with_bars("priority")
    + f" SELECT symbol, ts, {r('close - ' + lag('close', 3), 'close')}, {r('volume - ' + lag('volume', 3), 'volume')} FROM ix"
)
def differenced_columns(spark: SparkSession, folder: str) -> DataFrame:
    df = ft.add_features(indexed(spark, folder, "priority"), [ft.differenced(["close", "volume"], 3)])
    return rounded(df.select("symbol", "ts", "close", "volume"))


_NUMERIC = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey")


@query(
    " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) + 0.0 AS corr FROM lineitem"
        for i, a in enumerate(_NUMERIC)
        for b in _NUMERIC[i + 1 :]
    )
)
def correlation_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ft.correlation_matrix(spark.read.parquet(f"{folder}/lineitem.parquet"), _NUMERIC))


@query(
    "SELECT l_orderkey, l_linenumber, round(l_discount, 6) + 0.0 AS l_discount, round(l_extendedprice, 6) + 0.0 AS l_extendedprice FROM lineitem"
)
def correlation_filter(spark: SparkSession, folder: str) -> DataFrame:
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").select(
        "l_orderkey",
        "l_linenumber",
        "l_discount",
        "l_extendedprice",
        (F.col("l_extendedprice") * 1.1).alias("l_taxed"),
    )
    return rounded(ft.filter_correlated(lines, 0.9, keys=["l_orderkey", "l_linenumber"]))


@query(
    with_bars()
    + f""", {_RET}, m AS (SELECT symbol, ts, rn, {roll('avg(ret)', 20)} AS mean FROM ret),
    f AS (SELECT symbol, ts, last_value(CASE WHEN rn % 5 = 0 THEN NULL ELSE mean END IGNORE NULLS) {_CUM} AS mean FROM m)
    SELECT symbol, ts, {r('coalesce(mean, 0.0)', 'mean')} FROM f"""
)
def feature_null_policy(spark: SparkSession, folder: str) -> DataFrame:
    def build(d: DataFrame, w) -> DataFrame:
        d = d.withColumn("__r", ft.pct_change("close", w))
        return d.withColumn("mean", F.when(F.col(RN) % 5 != 0, ft.rolling_mean("__r", w, 20)))

    df = ft.add_features(indexed(spark, folder), [ft.FeatureSet(build, back=20)])
    return rounded(ft.feature_nulls(df.select("symbol", "ts", RN, N_ROWS, "mean")).select("symbol", "ts", "mean"))


_SPEC = ft.FeatureSpec(
    indicators=[{"indicator": "sma", "length": 20}, {"indicator": "atr", "length": 10}],
    momentum=True,
    fractal_window=5,
    label=ft.LabelSpec(method="directional", max_holding_period=5, min_return_threshold=0.01),
)


def _ff0(expr: str, name: str, digits: int = 6) -> str:
    return f"round(coalesce(last_value({expr} IGNORE NULLS) {_CUM}, 0.0), {digits}) + 0.0 AS {name}"


@query(
    with_bars("priority", True)
    + f""", d AS MATERIALIZED (SELECT *, {_TR} AS tr FROM ix), {ewm_cte('e', 'd', {'y': ('tr', 0.1)})},
    f AS (SELECT *, {_FRACTAL}, close / nullif({lag('close')}, 0) - 1 AS ret, {lag('close')} AS c1, {roll('avg(close)', 20)} AS sma,
      close / nullif({lag('close', 5)}, 0) - 1 AS r5, close / nullif({lag('close', 10)}, 0) - 1 AS r10, close / nullif({lag('close', 20)}, 0) - 1 AS r20,
      lead(close, 5) OVER (PARTITION BY symbol ORDER BY rn) / close - 1 AS fut FROM ix),
    o AS (SELECT symbol, ts, rn, open, high, low, close, volume, fut, {_ff0('ret', 'ret')}, {_ff0('ln(ret + 1)', 'log_return')}, {_ff0('c1', 'close_lag1')},
      isodow(ts)::INT - 1 AS day_of_week, {_ff0('r5', 'roc_5')}, {_ff0('r10', 'roc_10')}, {_ff0('r20', 'roc_20')}, bullish AS bullish_fractal_5, bearish AS bearish_fractal_5,
      {_ff0('sma', 'sma_length20')}, {_ff0('CASE WHEN rn >= 10 THEN y END', 'atr_length10', 3)}, {r('CASE WHEN rn >= 10 THEN y / close ELSE 0.0 END', '"ATRr_10"')}
      FROM f JOIN e USING (symbol, rn))
    SELECT symbol, ts, open, high, low, close, volume, ret AS "return", log_return, close_lag1, day_of_week, roc_5, roc_10, roc_20,
    bullish_fractal_5, bearish_fractal_5, sma_length20, atr_length10, "ATRr_10",
    CASE WHEN fut > 0.01 THEN 1 WHEN fut < -0.01 THEN -1 ELSE 0 END AS directional_label FROM o WHERE fut IS NOT NULL"""
)
def feature_table(spark: SparkSession, folder: str) -> DataFrame:
    out = rounded(ft.build_features(bars(spark, folder, "priority"), _SPEC), raw=("open", "high", "low", "close", "volume", "atr_length10"))
    # Ranges of some 100,000 out of a long recursion: 3 digits are 9 significant ones.
    return rounded(out, 3, raw=[c for c in out.columns if c != "atr_length10"])


def _barrier_sql(which: str, tp: float, sl: float, h: int, threshold: float) -> str:
    return (
        with_bars(which)
        + f""", t AS MATERIALIZED (SELECT symbol, ts, rn, n_rows, close, high, low, close + {tp} * (high - low) AS tp, close - {sl} * (high - low) AS sl FROM ix),
    p AS (SELECT a.symbol, a.rn, min(CASE WHEN b.high >= a.tp THEN b.rn END) AS up, min(CASE WHEN b.low <= a.sl THEN b.rn END) AS down,
      arg_max(b.close, b.rn) AS last FROM t a JOIN t b ON a.symbol = b.symbol AND b.rn > a.rn AND b.rn <= a.rn + {h} GROUP BY 1, 2)
    SELECT symbol, ts, CASE WHEN rn = n_rows - 1 THEN NULL WHEN up IS NOT NULL AND (down IS NULL OR up <= down) THEN 1 WHEN down IS NOT NULL THEN -1
      WHEN {threshold} > 0 AND (last - close) / close >= {threshold} THEN 1 WHEN {threshold} > 0 AND (last - close) / close <= -{threshold} THEN -1
      ELSE 0 END AS label FROM t LEFT JOIN p USING (symbol, rn)"""
    )


@query(_barrier_sql("brand", 1.5, 0.3, 10, 0.001))
def triple_barrier_short(spark: SparkSession, folder: str) -> DataFrame:
    df = lab.triple_barrier(indexed(spark, folder), F.col("high") - F.col("low"), 1.5, 0.3, 10, 0.001)
    return df.select("symbol", "ts", "label")


@query(_barrier_sql("priority", 3.0, 0.8, 200, 0.0))
def triple_barrier_long(spark: SparkSession, folder: str) -> DataFrame:
    df = lab.triple_barrier(indexed(spark, folder, "priority"), F.col("high") - F.col("low"), 3.0, 0.8, 200)
    return df.select("symbol", "ts", "label")


@query(
    with_bars("priority", True)
    + f""", d AS MATERIALIZED (SELECT symbol, ts, rn, n_rows, close, high, low, {_TR} AS tr FROM ix), {ewm_cte('e', 'd', {'y': ('tr', 1 / 14)})},
    t AS MATERIALIZED (SELECT symbol, ts, rn, n_rows, close, high, low, coalesce(last_value(CASE WHEN rn >= 14 THEN y END IGNORE NULLS) {_CUM}, 0.0) AS a FROM d JOIN e USING (symbol, rn)),
    p AS (SELECT a.symbol, a.rn, min(CASE WHEN b.high >= a.close + 0.5 * a.a THEN b.rn END) AS up, min(CASE WHEN b.low <= a.close - 0.5 * a.a THEN b.rn END) AS down,
      arg_max(b.close, b.rn) AS last FROM t a JOIN t b ON a.symbol = b.symbol AND b.rn > a.rn AND b.rn <= a.rn + 10 GROUP BY 1, 2)
    SELECT symbol, ts, CASE WHEN rn = n_rows - 1 THEN 0 WHEN up IS NOT NULL AND (down IS NULL OR up <= down) THEN 1 WHEN down IS NOT NULL THEN -1
      WHEN (last - close) / close >= 0.001 THEN 1 WHEN (last - close) / close <= -0.001 THEN -1 ELSE 0 END AS triple_barrier_label
    FROM t LEFT JOIN p USING (symbol, rn)"""
)
def labeled_features(spark: SparkSession, folder: str) -> DataFrame:
    spec = ft.FeatureSpec(
        indicators=[{"indicator": "atr", "length": 14}],
        label=ft.LabelSpec(atr_multiplier_tp=0.5, atr_multiplier_sl=0.5, atr_column="atr_length14"),
    )
    return ft.build_features(bars(spark, folder, "priority"), spec).select("symbol", "ts", "triple_barrier_label")


@query(
    with_bars("event")
    + """, f AS (SELECT symbol, ts, lead(close, 10) OVER (PARTITION BY symbol ORDER BY rn) / nullif(close, 0) - 1 AS fut FROM ix)
    SELECT symbol, ts, CASE WHEN fut > 0.1 THEN 1 WHEN fut < -0.1 THEN -1 ELSE 0 END AS label FROM f WHERE fut IS NOT NULL"""
)
def directional_labels(spark: SparkSession, folder: str) -> DataFrame:
    return lab.directional(indexed(spark, folder, "event"), 10, 0.1).select("symbol", "ts", "label")
