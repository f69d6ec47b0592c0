"""Reading, cleaning, resampling and aligning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.catalog.base import OHLCV_RAW, bars, indexed, query, r, rs, with_bars
from tickloom.functions.columns import OHLCV, clean_names, rounded
from tickloom.operators import clean
from tickloom.plans.series import N_ROWS, RN
from tickloom.plans.storage import scratch_path
from tickloom.sources import bars as readers
from tickloom.sources.derived import table
from tickloom.sources.sinks import write_table

_CSV_SCHEMA = "Symbol string, Date string, Open double, High double, Low double, Close double, Volume double"


def _title(df: DataFrame) -> DataFrame:
    return df.select("symbol", "ts", *[F.col(c).alias(c.capitalize()) for c in OHLCV])


@query(with_bars("priority") + f" SELECT symbol, ts, {OHLCV_RAW} FROM bars WHERE ts BETWEEN TIMESTAMP '1995-03-01' AND TIMESTAMP '1997-06-30'")
def csv_scan(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "bars-csv")
    rows = _title(bars(spark, folder, "priority")).withColumn("Date", F.date_format("ts", "dd.MM.yyyy HH:mm"))
    rows.select("Symbol", "Date", *[c.capitalize() for c in OHLCV]).write.option("header", True).csv(path)
    got = readers.read_csv_bars(spark, path, _CSV_SCHEMA, "1995-03-01", "1997-06-30", date_format="dd.MM.yyyy HH:mm")
    return rounded(got.select("symbol", "ts", *OHLCV), raw=OHLCV)


@query(with_bars() + f" SELECT symbol, ts, open, high, low, close * 0.5 AS close, volume FROM bars")
def yahoo_layout(spark: SparkSession, folder: str) -> DataFrame:
    raw = _title(bars(spark, folder)).withColumn("Adj Close", F.col("Close") * 0.5)
    return rounded(readers.normalize_vendor_bars(raw, "yahoo", adjust=True).select("symbol", "ts", *OHLCV), raw=OHLCV)


@query(with_bars() + f" SELECT symbol, ts, {OHLCV_RAW} FROM bars WHERE ts BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31'")
def alpha_vantage_layout(spark: SparkSession, folder: str) -> DataFrame:
    raw = bars(spark, folder)
    raw = raw.select("symbol", "ts", *[F.col(c).alias(f"{i}. {c}") for i, c in enumerate(OHLCV, 1)])
    out = readers.time_range(readers.normalize_vendor_bars(raw, "alpha_vantage"), "1996-01-01", "1996-12-31")
    return rounded(out, raw=OHLCV)


@query(with_bars("event") + f" SELECT symbol, ts, {OHLCV_RAW} FROM bars WHERE ts <= TIMESTAMP '2024-01-20 12:00:00'")
def crypto_arrays(spark: SparkSession, folder: str) -> DataFrame:
    ms = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)").cast("double")
    day = F.date_trunc("day", "ts")
    raw = bars(spark, folder, "event").groupBy("symbol", day.alias("d")).agg(F.to_json(F.collect_list(F.array(ms, *OHLCV))).alias("payload"))
    return rounded(readers.explode_ohlcv_json(raw.drop("d"), end="2024-01-20 12:00:00"), raw=OHLCV)


@query(with_bars() + f" SELECT symbol, ts, open, close, {r('close * 0.9', 'adj_close', 8)} FROM bars")
def datareader_layout(spark: SparkSession, folder: str) -> DataFrame:
    raw = bars(spark, folder).select("symbol", "ts", F.col("open").alias("Open"), F.col("close").alias("Last"), (F.col("close") * 0.9).alias("Adj. Close"))
    return rounded(readers.normalize_vendor_bars(raw, "datareader"), 8, raw=OHLCV)


@query(with_bars() + f" SELECT symbol, ts, {OHLCV_RAW} FROM bars WHERE symbol IN ('Brand#11', 'Brand#23') AND ts BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1998-01-01'")
def load_by_symbol(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "bars")
    write_table(bars(spark, folder), path, partition_by=["symbol"])
    got = readers.load_bars(spark, path, "csv", "parquet", ["Brand#11", "Brand#23"], "1995-01-01", "1998-01-01")
    return rounded(got.select("symbol", "ts", *OHLCV), raw=OHLCV)


_EVENTS = ("click", "error", "purchase", "signup", "view")


@query(with_bars("event") + " SELECT ts, " + ", ".join(r(f"max(CASE WHEN symbol = '{s}' THEN close END)", s) for s in _EVENTS) + " FROM bars GROUP BY ts")
def close_panel(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(readers.panel(bars(spark, folder, "event"), _EVENTS))


# Every 7th row by row number loses its close, so that fills have work to do.
_HOLES = "holes AS (SELECT symbol, ts, rn, open, CASE WHEN rn % 7 IN (0, 3, 4) THEN NULL ELSE close END AS close FROM ix)"


def _holes(spark: SparkSession, folder: str, which: str) -> DataFrame:
    gap = (F.col(RN) % 7).isin(0, 3, 4)
    return indexed(spark, folder, which).withColumn("close", F.when(~gap, F.col("close")))


_FFILL = "last_value({c} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_BFILL = "first_value({c} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


def interp_sql(source: str, column: str, extra: str = "") -> str:
    """SELECT that interpolates `column` of `source` by row position."""
    return f"""
      SELECT symbol, ts{extra}, CASE WHEN x IS NOT NULL THEN x WHEN nx IS NULL THEN px WHEN px IS NULL THEN NULL
        ELSE px + (nx - px) * ((rn - prn)::DOUBLE / (nrn - prn)) END AS {column}
      FROM (SELECT symbol, ts, rn{extra}, {column} AS x,
        {_FFILL.format(c=column)} AS px, {_FFILL.format(c=f'CASE WHEN {column} IS NOT NULL THEN rn END')} AS prn,
        {_BFILL.format(c=column)} AS nx, {_BFILL.format(c=f'CASE WHEN {column} IS NOT NULL THEN rn END')} AS nrn
        FROM {source})"""


_Z_MASKED = (
    "s AS (SELECT symbol, avg(x) AS m, stddev_samp(x) AS sd FROM filled GROUP BY symbol), "
    "blanked AS (SELECT symbol, ts, rn, CASE WHEN sd > 0 AND abs((x - m) / sd) > 1.5 THEN NULL ELSE x END AS close "
    "FROM filled JOIN s USING (symbol))"
)


@query(
    with_bars()
    + f", {_HOLES}, f1 AS (SELECT *, {_FFILL.format(c='close')} AS f FROM holes), "
    + f"filled AS (SELECT symbol, ts, rn, {_BFILL.format(c='f')} AS x FROM f1), {_Z_MASKED} "
    + f"SELECT symbol, ts, {r('close', digits=7)} FROM ({interp_sql('blanked', 'close')})"
)
def load_and_clean(spark: SparkSession, folder: str) -> DataFrame:
    raw = _holes(spark, folder, "brand").drop(RN, N_ROWS).select("symbol", "ts", "close")
    return rounded(clean.load_clean(raw, outliers="zscore", columns=["close"], threshold=1.5), 7)


@query(with_bars() + f" SELECT symbol, ts, {OHLCV_RAW}, 'backfill' AS run_id FROM bars")
def write_and_read_back(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "sink")
    write_table(bars(spark, folder), path, "csv", run_id="backfill")
    schema = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double, run_id string"
    return rounded(spark.read.schema(schema).option("header", True).csv(path), raw=OHLCV)


def _resample_sql(which: str, bucket: str, bins: str) -> str:
    return (
        with_bars(which)
        + f""", agg AS (SELECT symbol, {bucket} AS ts, first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low,
        last(close ORDER BY ts) AS close, sum(volume) AS volume FROM bars GROUP BY symbol, {bucket}),
        lim AS (SELECT symbol, min(ts) AS lo, max(ts) AS hi FROM agg GROUP BY symbol),
        bins AS (SELECT symbol, unnest(generate_series(lo, hi, INTERVAL {bins})) AS ts FROM lim)
        SELECT symbol, ts, {rs('open', 'high', 'low', 'close')}, {r('coalesce(volume, 0.0)', 'volume')}
        FROM bins LEFT JOIN agg USING (symbol, ts)"""
    )


@query(_resample_sql("priority", "date_trunc('week', ts)::TIMESTAMP + INTERVAL 6 DAYS", "7 DAYS"))
def resample_week(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(clean.resample(bars(spark, folder, "priority"), "week"))


@query(_resample_sql("priority", "date_trunc('month', ts)::TIMESTAMP", "1 MONTH"))
def resample_month(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(clean.resample(bars(spark, folder, "priority"), "month"))


@query(_resample_sql("event", "time_bucket(INTERVAL 2 HOURS, ts, TIMESTAMP '2020-01-01')", "2 HOURS"))
def resample_two_hours(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(clean.resample(bars(spark, folder, "event"), "2 hours"))


_AB = (
    "a AS (SELECT symbol, ts, close AS a_close FROM bars WHERE volume > 100), "
    "b AS (SELECT symbol, ts, high AS b_high FROM bars WHERE high > 2 * low)"
)


def _ab(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    df = bars(spark, folder)
    a = df.filter(F.col("volume") > 100).select("symbol", "ts", F.col("close").alias("a_close"))
    b = df.filter(F.col("high") > 2 * F.col("low")).select("symbol", "ts", F.col("high").alias("b_high"))
    return a, b


def _aligned(spark: SparkSession, folder: str, how: str) -> DataFrame:
    a, b = clean.align(_ab(spark, folder), how)
    return a.join(b, ["symbol", "ts"])


_AB_OUT = "a_close, b_high"


@query(with_bars() + f", {_AB} SELECT symbol, ts, {_AB_OUT} FROM a JOIN b USING (symbol, ts)")
def align_inner(spark: SparkSession, folder: str) -> DataFrame:
    return _aligned(spark, folder, "inner")


@query(with_bars() + f", {_AB} SELECT symbol, ts, {_AB_OUT} FROM a FULL JOIN b USING (symbol, ts)")
def align_outer(spark: SparkSession, folder: str) -> DataFrame:
    return _aligned(spark, folder, "outer")


@query(with_bars() + f", {_AB} SELECT symbol, ts, {_AB_OUT} FROM a LEFT JOIN b USING (symbol, ts)")
def align_left(spark: SparkSession, folder: str) -> DataFrame:
    return _aligned(spark, folder, "left")


@query(with_bars() + f", {_AB} SELECT symbol, ts, {_AB_OUT} FROM a RIGHT JOIN b USING (symbol, ts)")
def align_right(spark: SparkSession, folder: str) -> DataFrame:
    return _aligned(spark, folder, "right")


@query(with_bars() + f", {_AB} SELECT symbol, ts, {_AB_OUT} FROM a JOIN b USING (symbol, ts)")
def align_two(spark: SparkSession, folder: str) -> DataFrame:
    return clean.align_pair(*_ab(spark, folder))


def _masks(spark: SparkSession, folder: str, method: str, threshold: float) -> DataFrame:
    df = bars(spark, folder).select("symbol", "ts", "close", "volume")
    return clean.detect_outliers(df, ["close", "volume"], method, threshold)


_ZSCORE = (
    "m AS (SELECT b.*, sc > 0 AND abs((close - mc) / sc) > 1.8 AS close__outlier, "
    "sv > 0 AND abs((volume - mv) / sv) > 1.8 AS volume__outlier FROM bars b JOIN (SELECT symbol, avg(close) AS mc, "
    "stddev_samp(close) AS sc, avg(volume) AS mv, stddev_samp(volume) AS sv FROM bars GROUP BY symbol) USING (symbol))"
)


@query(with_bars() + f", {_ZSCORE} SELECT symbol, ts, close, volume, close__outlier, volume__outlier FROM m")
def outliers_zscore(spark: SparkSession, folder: str) -> DataFrame:
    return _masks(spark, folder, "zscore", 1.8)


@query(
    with_bars()
    + """, q AS (SELECT symbol, quantile_cont(close, 0.25) AS c1, quantile_cont(close, 0.75) AS c3,
    quantile_cont(volume, 0.25) AS v1, quantile_cont(volume, 0.75) AS v3 FROM bars GROUP BY symbol)
    SELECT symbol, ts, close, volume, c3 > c1 AND (close < c1 - 0.3 * (c3 - c1) OR close > c3 + 0.3 * (c3 - c1)) AS close__outlier,
    v3 > v1 AND (volume < v1 - 0.3 * (v3 - v1) OR volume > v3 + 0.3 * (v3 - v1)) AS volume__outlier
    FROM bars JOIN q USING (symbol)"""
)
def outliers_iqr(spark: SparkSession, folder: str) -> DataFrame:
    return _masks(spark, folder, "iqr", 0.3)


@query(
    with_bars()
    + """, q AS (SELECT symbol, quantile_cont(close, 0.03) AS c1, quantile_cont(close, 0.97) AS c3,
    quantile_cont(volume, 0.03) AS v1, quantile_cont(volume, 0.97) AS v3 FROM bars GROUP BY symbol)
    SELECT symbol, ts, close, volume, close < c1 OR close > c3 AS close__outlier, volume < v1 OR volume > v3 AS volume__outlier FROM bars JOIN q USING (symbol)"""
)
def outliers_percentile(spark: SparkSession, folder: str) -> DataFrame:
    return _masks(spark, folder, "percentile", 3.0)


def _treated(spark: SparkSession, folder: str, method: str, digits: int = 7, **options) -> DataFrame:
    masked = _masks(spark, folder, "zscore", 1.8)
    return rounded(clean.drop_masks(clean.handle_outliers(masked, method, **options)).select("symbol", "ts", "close", "volume"), digits)


def _clamp_sql(lo: str, hi: str) -> str:
    def cell(c: str) -> str:
        return f"CASE WHEN a_{c} THEN greatest(lo_{c}, least(hi_{c}, {c})) ELSE {c} END"

    stats = ", ".join(
        f"{lo.format(x=f'CASE WHEN NOT {c}__outlier THEN {c} END')} AS lo_{c}, "
        f"{hi.format(x=f'CASE WHEN NOT {c}__outlier THEN {c} END')} AS hi_{c}, bool_or({c}__outlier) AS a_{c}"
        for c in ("close", "volume")
    )
    return (
        with_bars() + f", {_ZSCORE}, s AS (SELECT symbol, {stats} FROM m GROUP BY symbol) "
        f"SELECT symbol, ts, {r(cell('close'), 'close', 10)}, {r(cell('volume'), 'volume', 10)} FROM m JOIN s USING (symbol)"
    )


@query(_clamp_sql("quantile_cont({x}, 0.05)", "quantile_cont({x}, 0.95)"))
def outliers_winsorized(spark: SparkSession, folder: str) -> DataFrame:
    return _treated(spark, folder, "winsorize", 10)


@query(_clamp_sql("min({x})", "max({x})"))
def outliers_clipped(spark: SparkSession, folder: str) -> DataFrame:
    return _treated(spark, folder, "clip", 10)


@query(with_bars() + f", {_ZSCORE} SELECT symbol, ts, {rs('close', 'volume', digits=7)} FROM m WHERE NOT (close__outlier OR volume__outlier)")
def outliers_removed(spark: SparkSession, folder: str) -> DataFrame:
    return _treated(spark, folder, "remove")


_BLANK = (
    _ZSCORE + ", bl AS (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS rn, "
    "CASE WHEN close__outlier THEN NULL ELSE close END AS close, CASE WHEN volume__outlier THEN NULL ELSE volume END AS volume FROM m)"
)


@query(with_bars() + f", {_BLANK} SELECT symbol, ts, {r(_FFILL.format(c='close'), 'close', 7)}, {r(_FFILL.format(c='volume'), 'volume', 7)} FROM bl")
def outliers_ffilled(spark: SparkSession, folder: str) -> DataFrame:
    return _treated(spark, folder, "fillna", fill="ffill")


@query(with_bars() + f", {_BLANK} SELECT symbol, ts, {r(_BFILL.format(c='close'), 'close', 7)}, {r(_BFILL.format(c='volume'), 'volume', 7)} FROM bl")
def outliers_bfilled(spark: SparkSession, folder: str) -> DataFrame:
    return _treated(spark, folder, "fillna", fill="bfill")


@query(
    with_bars()
    + f", {_BLANK}, c AS ({interp_sql('bl', 'close')}), v AS ({interp_sql('bl', 'volume')}) "
    + f"SELECT symbol, ts, {rs('close', 'volume', digits=7)} FROM c JOIN v USING (symbol, ts)"
)
def outliers_interpolated(spark: SparkSession, folder: str) -> DataFrame:
    return _treated(spark, folder, "fillna", fill="interpolate")


def _stat_fill(agg: str) -> str:
    cells = ", ".join(r(f"coalesce({c}, {agg.format(c=c)} OVER (PARTITION BY symbol))", c, 7) for c in ("close", "volume"))
    return with_bars() + f", {_BLANK} SELECT symbol, ts, {cells} FROM bl"


@query(_stat_fill("avg({c})"))
def outliers_mean_filled(spark: SparkSession, folder: str) -> DataFrame:
    return _treated(spark, folder, "fillna", fill="mean")


@query(_stat_fill("quantile_cont({c}, 0.5)"))
def outliers_median_filled(spark: SparkSession, folder: str) -> DataFrame:
    return _treated(spark, folder, "fillna", fill="median")




@query(
    with_bars()
    + f""", t AS (SELECT symbol, ts, rn, CASE WHEN rn % 7 IN (0, 3) THEN NULL ELSE rn % 11 = 5 END AS bad,
    CASE WHEN rn % 7 IN (0, 3) THEN NULL ELSE close END AS c FROM ix),
    f AS (SELECT symbol, ts, {_FFILL.format(c='bad')} AS bad, {_FFILL.format(c='c')} AS close FROM t)
    SELECT symbol, ts, close FROM f WHERE NOT bad AND close IS NOT NULL"""
)
def preprocess_text_prices(spark: SparkSession, folder: str) -> DataFrame:
    raw = indexed(spark, folder)
    text = F.when((F.col(RN) % 7).isin(0, 3), None).when(F.col(RN) % 11 == 5, "n/a").otherwise(F.col("close").cast("string"))
    return clean.preprocess(raw.select("symbol", "ts", text.alias("Close")))


@query(with_bars("event") + f" SELECT symbol, ts, {rs('close', 'volume')} FROM bars WHERE symbol = 'purchase'")
def extract_one_ticker(spark: SparkSession, folder: str) -> DataFrame:
    df = bars(spark, folder, "event")
    cells = [
        F.max(F.when(F.col("symbol") == s, F.col(c))).alias(f"{c.capitalize()}|{s}") for c in ("close", "volume") for s in _EVENTS
    ]
    wide = df.groupBy("ts").agg(*cells)
    return rounded(clean.extract_ticker(wide, "purchase").filter("close IS NOT NULL"))


@query(
    with_bars()
    + f", {_HOLES} SELECT symbol, ts, {r(_FFILL.format(c='close'), 'ffilled', 7)}, {r(_BFILL.format(c='close'), 'bfilled', 7)}, "
    + f"{r('coalesce(close, 0.0)', 'zeroed', 7)} FROM holes"
)
def fill_gaps(spark: SparkSession, folder: str) -> DataFrame:
    df = _holes(spark, folder, "brand").withColumns({c: F.col("close") for c in ("ffilled", "bfilled", "zeroed")})
    df = clean.fill_nulls(df, "ffill", ["ffilled"])
    df = clean.fill_nulls(df, "bfill", ["bfilled"])
    return rounded(clean.fill_nulls(df, "zero", ["zeroed"]).select("symbol", "ts", "ffilled", "bfilled", "zeroed"), 7)


@query(
    "SELECT l_orderkey, l_linenumber, l_shipdate, round(l_quantity, 6) + 0.0 AS l_quantity FROM lineitem "
    "WHERE l_shipdate BETWEEN TIMESTAMP '1995-06-01' AND TIMESTAMP '1995-09-30'"
)
def time_range_scan(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity")
    return rounded(readers.time_range(lines, "1995-06-01", "1995-09-30", "l_shipdate"))


_MONTHLY = "src AS (SELECT symbol, date_trunc('month', ts)::TIMESTAMP AS ts, avg(close) AS level FROM bars GROUP BY 1, date_trunc('month', ts))"


@query(
    with_bars("priority")
    + f", {_MONTHLY} SELECT symbol, ts, {r('close')}, round(coalesce(last_value(level IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts "
    + "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1.0), 6) + 0.0 AS level FROM bars LEFT JOIN src USING (symbol, ts)"
)
def reindex_forward(spark: SparkSession, folder: str) -> DataFrame:
    df = bars(spark, folder, "priority")
    monthly = df.groupBy("symbol", F.date_trunc("month", "ts").cast("timestamp_ntz").alias("ts")).agg(F.avg("close").alias("level"))
    return rounded(clean.reindex_ffill(df.select("symbol", "ts", "close"), monthly, ["level"], {"level": 1.0}))


@query(
    with_bars("priority")
    + f", src AS (SELECT symbol, date_trunc('month', ts)::TIMESTAMP + INTERVAL 30 HOURS AS ts, avg(close) AS level FROM bars GROUP BY 1, date_trunc('month', ts)) "
    + f"SELECT b.symbol, b.ts, {r('b.close', 'close')}, {r('s.level', 'level')} FROM bars b ASOF LEFT JOIN src s ON b.symbol = s.symbol AND b.ts >= s.ts"
)
def asof_backward(spark: SparkSession, folder: str) -> DataFrame:
    df = bars(spark, folder, "priority")
    month = F.date_trunc("month", "ts").cast("timestamp_ntz") + F.expr("INTERVAL 30 HOURS")
    monthly = df.groupBy("symbol", month.alias("ts")).agg(F.avg("close").alias("level"))
    return rounded(clean.asof_join(df.select("symbol", "ts", "close"), monthly, ["level"]))


@query(with_bars() + f" SELECT symbol, ts, close AS Close_USD, volume AS Vol_chg FROM bars")
def sanitized_names(spark: SparkSession, folder: str) -> DataFrame:
    df = bars(spark, folder).select("symbol", "ts", F.col("close").alias("Close (USD)"), F.col("volume").alias("Vol. % chg"))
    return clean_names(df)


@query(
    with_bars()
    + f" SELECT symbol, ts, close, 0 AS fold FROM bars WHERE ts < TIMESTAMP '1996-01-01' "
    + f"UNION ALL SELECT symbol, ts, close, 1 AS fold FROM bars WHERE ts >= TIMESTAMP '1995-06-01'"
)
def stacked_folds(spark: SparkSession, folder: str) -> DataFrame:
    df = bars(spark, folder).select("symbol", "ts", "close")
    early = df.filter(F.col("ts") < F.lit("1996-01-01").cast("timestamp_ntz"))
    late = df.filter(F.col("ts") >= F.lit("1995-06-01").cast("timestamp_ntz"))
    return clean.stack_folds({0: early, 1: late})
