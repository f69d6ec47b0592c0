"""Statistics, preprocessing, models, walk-forward, strategies and streams."""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.catalog.base import bars, indexed, query, r, rs, with_bars
from tickloom.catalog.scoring import _BINARY, binary_scores
from tickloom.catalog.technical import _MOVE, _TR, ewm_cte, lag, roll
from tickloom.catalog.trading import _PREDICTED, _TRADE_COLS, SPEC, _cross_sql, _shown, _sim_sql, predicted
from tickloom.functions.columns import rounded
from tickloom.operators import evaluation, features, ledger, models, performance, regimes, selection, statistics, strategy, walkforward
from tickloom.plans.series import N_ROWS, RN, over_chunks
from tickloom.plans.storage import cut, scratch_path
from tickloom.sources.derived import table
from tickloom.streaming.bars import closing_tick, stream_bars
from tickloom.streaming.indicators import stream_indicators
from tickloom.streaming.scoring import score_latest, score_stream

# --- statistics ---------------------------------------------------------------

_W99 = "OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 98 PRECEDING AND CURRENT ROW)"


@query(
    with_bars("priority")
    + f""", x AS (SELECT symbol, ts, rn, close, {lag('close')} AS x, close - {lag('close')} AS d FROM ix),
    m AS (SELECT *, count(d) {_W99} AS n, covar_pop(x, d) {_W99} AS c, var_pop(x) {_W99} AS v, var_pop(d) {_W99} AS u FROM x)
    SELECT symbol, ts, {r('CASE WHEN n = 99 THEN (c / v) / sqrt((u - c * c / v) / v / 97) END', 'df_t')} FROM m"""
)
def dickey_fuller(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(statistics.dickey_fuller_t(indexed(spark, folder, "priority")).select("symbol", "ts", "df_t"))


@query()
def rolling_stationarity(spark: SparkSession, folder: str) -> DataFrame:
    out = statistics.rolling_adf(indexed(spark, folder, "priority"))
    return rounded(out.select("symbol", "ts", "adf_pvalue", "is_stationary"), 4)


def _garch_sql(rounds: int) -> str:
    """The likelihood search as one recursion per round over all candidates of each symbol."""
    out = (
        with_bars("event", True)
        + f""", g0 AS (SELECT *, 100 * (close / nullif({lag('close')}, 0) - 1) AS r FROM ix),
        gm AS (SELECT symbol, avg(r) AS mu, var_pop(r) AS lv, count(r) AS n FROM g0 GROUP BY symbol),
        gr AS MATERIALIZED (SELECT symbol, ts, lv, (r - mu) * (r - mu) AS e2, row_number() OVER (PARTITION BY symbol ORDER BY rn) AS k FROM g0 JOIN gm USING (symbol) WHERE n > 100 AND lv > 0 AND r IS NOT NULL)"""
    )
    for i in range(rounds):
        width = 0.6**i
        if i:
            pairs = f"SELECT symbol, a + i * {0.04 * width!r} AS a, b + j * {0.06 * width!r} AS b FROM best{i - 1}, (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j)"
        else:
            pairs = f"SELECT DISTINCT symbol, a, b FROM gr, (SELECT unnest({list(statistics.ALPHAS)}::DOUBLE[]) AS a), (SELECT unnest({list(statistics.BETAS)}::DOUBLE[]) AS b)"
        out += (
            f", ca{i} AS MATERIALIZED (SELECT * FROM ({pairs}) WHERE a > 0 AND b >= 0 AND b <= {statistics.BETA_MAX} AND a + b < 0.999), "
            f"vr{i}(symbol, a, b, k, v, ll) AS (SELECT c.symbol, a, b, 1::BIGINT, lv, -0.5 * (ln(lv) + e2 / lv) FROM ca{i} c JOIN gr ON gr.symbol = c.symbol AND k = 1 UNION ALL "
            "SELECT w.symbol, a, b, k, w.v, ll - 0.5 * (ln(w.v) + e2 / w.v) FROM (SELECT p.symbol, p.a, p.b, g.k, p.ll, g.e2, (1 - p.a - p.b) * g.lv + p.a * q.e2 + p.b * p.v AS v "
            f"FROM vr{i} p JOIN gr q ON q.symbol = p.symbol AND q.k = p.k JOIN gr g ON g.symbol = p.symbol AND g.k = p.k + 1) w), "
            f"tl{i} AS (SELECT v.*, max(k) OVER (PARTITION BY symbol) AS last FROM vr{i} v), "
            f"best{i} AS MATERIALIZED (SELECT symbol, arg_max(a, ll) AS a, arg_max(b, ll) AS b FROM tl{i} WHERE k = last GROUP BY symbol)"
        )
    n = rounds - 1
    return (
        out
        + f" SELECT g0.symbol, g0.ts, {r('sqrt(v) / 100', 'garch_vol', 4)} FROM g0 LEFT JOIN gr ON gr.symbol = g0.symbol AND gr.ts = g0.ts "
        + f"LEFT JOIN best{n} b ON b.symbol = g0.symbol LEFT JOIN vr{n} v ON v.symbol = gr.symbol AND v.k = gr.k AND v.a = b.a AND v.b = b.b"
    )


@query(_garch_sql(4))
def conditional_volatility(spark: SparkSession, folder: str) -> DataFrame:
    out = statistics.garch_volatility(indexed(spark, folder, "event"))
    return rounded(out.select("symbol", "ts", "garch_vol"), 4)


# --- preprocessing and selection ------------------------------------------------

_DOCS = ("n_chars", "n_words", "n_lines")
_DOC_SQL = (
    "WITH d AS MATERIALIZED (SELECT doc_id, lang, source, quality AS y, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE n_chars::DOUBLE END AS n_chars, "
    "(length(text) - length(replace(text, ' ', '')))::DOUBLE AS n_words, (length(text) - length(replace(text, chr(10), '')))::DOUBLE AS n_lines "
    "FROM documents JOIN labels USING (doc_id))"
)


def document_features(spark: SparkSession, folder: str) -> DataFrame:
    """Labeled documents with a few counts, some of them missing."""
    docs = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id")
    count = lambda s: (F.length("text") - F.length(F.replace("text", F.lit(s), F.lit("")))).cast("double")
    return docs.select(
        "doc_id", "lang", "source", F.col("quality").alias("y"),
        F.when(F.col("doc_id") % 7 != 0, F.col("n_chars").cast("double")).alias("n_chars"),
        count(" ").alias("n_words"), count("\n").alias("n_lines"),
    )


@query(
    with_bars("priority")
    + " SELECT symbol, ts, CASE WHEN rn < floor(n_rows * (1 - 0.3)) THEN 'train' ELSE 'test' END AS part FROM ix"
)
def split_by_time(spark: SparkSession, folder: str) -> DataFrame:
    early, late = selection.chronological_split(indexed(spark, folder, "priority"), 0.3)
    tag = lambda d, p: d.select("symbol", "ts", F.lit(p).alias("part"))
    return tag(early, "train").unionByName(tag(late, "test"))


@query(
    f"{_DOC_SQL} SELECT doc_id, y, CASE WHEN ('0x' || substr(md5(concat_ws('|', '42', y, doc_id)), 1, 8))::UBIGINT / 4294967296.0 < 0.25 THEN 'test' ELSE 'train' END AS part FROM d"
)
def split_by_class(spark: SparkSession, folder: str) -> DataFrame:
    rest, test = selection.stratified_split(document_features(spark, folder), "y", ["doc_id"], 0.25)
    tag = lambda d, p: d.select("doc_id", "y", F.lit(p).alias("part"))
    return tag(rest, "train").unionByName(tag(test, "test"))


def _prepared(spark: SparkSession, folder: str, scaling: str) -> DataFrame:
    df = document_features(spark, folder)
    return rounded(selection.Preprocessor.fit(df, [], list(_DOCS), scaling).transform(df, keep=["doc_id"]))


def _scaled(mid: str, width: str) -> str:
    filled = ", ".join(f"coalesce({c}, quantile_cont({c}, 0.5) OVER ()) AS {c}" for c in _DOCS)
    stats = ", ".join(f"{mid.format(c=c)} AS m_{c}, {width.format(c=c)} AS w_{c}" for c in _DOCS)
    cells = ", ".join(r(f"({c} - m_{c}) / CASE WHEN w_{c} = 0 THEN 1 ELSE w_{c} END", c) for c in _DOCS)
    return f"{_DOC_SQL}, f AS (SELECT doc_id, {filled} FROM d), s AS (SELECT {stats} FROM f) SELECT doc_id, {cells} FROM f CROSS JOIN s"


@query(_scaled("avg({c})", "stddev_pop({c})"))
def standard_scaled(spark: SparkSession, folder: str) -> DataFrame:
    return _prepared(spark, folder, "standard")


@query(_scaled("min({c})", "max({c}) - min({c})"))
def minmax_scaled(spark: SparkSession, folder: str) -> DataFrame:
    return _prepared(spark, folder, "minmax")


@query(_scaled("quantile_cont({c}, 0.5)", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"))
def robust_scaled(spark: SparkSession, folder: str) -> DataFrame:
    return _prepared(spark, folder, "robust")


@query(
    "WITH d AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE quality::VARCHAR END AS q, toxic::VARCHAR AS t FROM labels), "
    "m AS (SELECT q FROM d WHERE q IS NOT NULL GROUP BY q ORDER BY count(*) DESC, q LIMIT 1), f AS (SELECT doc_id, coalesce(q, (SELECT q FROM m)) AS q, t FROM d) "
    "SELECT doc_id, " + ", ".join(f"CASE WHEN {c} = '{v}' THEN 1.0 ELSE 0.0 END::DOUBLE AS {c}_{v}" for c in "qt" for v in "01") + " FROM f"
)
def one_hot_coded(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "labels").select(
        "doc_id", F.when(F.col("doc_id") % 5 != 0, F.col("quality").cast("string")).alias("q"), F.col("toxic").cast("string").alias("t")
    )
    return selection.Preprocessor.fit(df, ["q", "t"], []).transform(df, keep=["doc_id"])


_MI_EDGES = ", ".join(f"quantile_cont({c}, [{', '.join(str(i / 10) for i in range(1, 10))}]) AS e_{c}" for c in ("n_words", "n_lines"))


@query(
    f"{_DOC_SQL}, q AS (SELECT {_MI_EDGES} FROM d), b AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, y, len(list_filter(e_{c}, lambda e: {c} > e)) AS bin FROM d CROSS JOIN q" for c in ("n_words", "n_lines"))
    + """), j AS (SELECT feature, bin, y, count(*) AS n FROM b GROUP BY 1, 2, 3),
    k AS (SELECT *, sum(n) OVER (PARTITION BY feature, bin) AS nb, sum(n) OVER (PARTITION BY feature, y) AS ny, sum(n) OVER (PARTITION BY feature) AS nt FROM j)
    SELECT feature, round(sum(n / nt * ln(n * nt / (nb * ny))), 6) + 0.0 AS mutual_information FROM k GROUP BY feature"""
)
def mutual_information(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(selection.mutual_information(document_features(spark, folder), ["n_words", "n_lines"], "y"))


def _picked(spark: SparkSession, folder: str, method: str) -> DataFrame:
    """The one feature that a label made from it depends on."""
    df = document_features(spark, folder).withColumn("y", (F.col("n_words") > 250).cast("int"))
    (chosen,) = selection.select_features(df, "y", method, 1, columns=list(_DOCS[1:]))
    return df.select("doc_id", F.lit(chosen).alias("feature"), F.col(chosen).alias("value"))


_PICKED = f"{_DOC_SQL} SELECT doc_id, 'n_words' AS feature, n_words AS value FROM d"


@query(_PICKED)
def selected_by_importance(spark: SparkSession, folder: str) -> DataFrame:
    return _picked(spark, folder, "importance")


@query(_PICKED)
def selected_by_elimination(spark: SparkSession, folder: str) -> DataFrame:
    return _picked(spark, folder, "rfe")


@query(_PICKED)
def selected_by_model(spark: SparkSession, folder: str) -> DataFrame:
    return _picked(spark, folder, "model")


@query(f"{_DOC_SQL} SELECT doc_id, y, n_chars, n_words, n_lines FROM d WHERE n_chars IS NOT NULL")
def complete_rows(spark: SparkSession, folder: str) -> DataFrame:
    df = document_features(spark, folder)
    return selection.complete_numeric(df, "y", ["doc_id", *_DOCS])[0].withColumn("doc_id", F.col("doc_id").cast("bigint"))


# Two standardised features have the components (z1 + z2) and (z1 - z2) over the root of 2; the sign of their
# correlation says which one varies more. Components are defined up to sign.
@query(
    f"""{_DOC_SQL}, z AS (SELECT doc_id, (n_words - avg(n_words) OVER ()) / stddev_pop(n_words) OVER () AS a, (n_lines - avg(n_lines) OVER ()) / stddev_pop(n_lines) OVER () AS b FROM d),
    c AS (SELECT CASE WHEN sum(a * b) >= 0 THEN 1 ELSE -1 END AS s FROM z)
    SELECT doc_id, {r('abs(a + s * b) / sqrt(2.0)', 'pc1', 4)}, {r('abs(a - s * b) / sqrt(2.0)', 'pc2', 4)} FROM z CROSS JOIN c"""
)
def principal_components(spark: SparkSession, folder: str) -> DataFrame:
    out = selection.principal_components(document_features(spark, folder), ["n_words", "n_lines"], 2, keep=["doc_id"])
    return rounded(out.select("doc_id", F.abs("PC1").alias("pc1"), F.abs("PC2").alias("pc2")), 4)


# --- models -------------------------------------------------------------------

_FEATURES = ("weekday", "month", "open", "volume")
_SPEC = features.FeatureSpec(momentum=True, regime=True, label=features.LabelSpec(method="directional", max_holding_period=5))
# Classes that a model can learn without error, so that SQL can state what it must answer.
_CLASS = "CASE WHEN isodow(ts) <= 2 THEN -1 WHEN isodow(ts) <= 4 THEN 0 ELSE 1 END"
_SHARE = 0.3
_LATE = with_bars("priority") + f", late AS (SELECT symbol, ts, {_CLASS} AS y FROM ix WHERE rn >= floor(n_rows * (1 - {_SHARE})))"


def feature_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Daily feature table with a three-way direction label."""
    return features.build_features(bars(spark, folder, "priority"), _SPEC)


def calendar_rows(spark: SparkSession, folder: str, two: bool = False) -> DataFrame:
    """Indexed daily bars with the weekday and other columns, and a class that follows from the weekday."""
    day = F.weekday("ts")
    label = F.when(day <= 1, -1).when(day <= 3, 0).otherwise(1)
    if two:
        label = F.when(day <= 3, 0).otherwise(1)
    df = indexed(spark, folder, "priority").withColumns({"weekday": day.cast("double"), "month": F.month("ts").cast("double"), "y": label})
    return df


def _report_sql(two: bool = False) -> str:
    """Shares of right answers per part; SQL answers with the rule itself."""
    rule = "CASE WHEN isodow(ts) <= 4 THEN 0 ELSE 1 END" if two else _CLASS
    names = ["accuracy", *[f"{m}_{k}" for m in ("precision", "recall", "f1") for k in ("macro", "weighted")]]
    cells = " UNION ALL ".join(f"SELECT part, '{m}' AS metric, avg(CASE WHEN y = guess THEN 1.0 ELSE 0.0 END) AS value FROM p GROUP BY part" for m in names)
    return (
        with_bars("priority")
        + f", p AS (SELECT CASE WHEN rn < floor(n_rows * (1 - {_SHARE})) THEN 'train' ELSE 'test' END AS part, {rule} AS y, {rule} AS guess FROM ix) {cells}"
    )


def _report(spark: SparkSession, folder: str, spec: models.TrainSpec, two: bool = False) -> DataFrame:
    spec = dataclasses.replace(spec, test_size=_SHARE)
    out = models.train(calendar_rows(spark, folder, two), "y", _FEATURES, spec)[1]
    return rounded(out.where(F.col("metric").rlike("^(accuracy|(precision|recall|f1)_(macro|weighted))$")), 4)


@query(_report_sql())
def random_forest_report(spark: SparkSession, folder: str) -> DataFrame:
    return _report(spark, folder, models.TrainSpec("random_forest", {"max_depth": 10}, top_after=3))


# --- models of the next day's direction, with SQL that fits them as well -------------------------

_CALENDAR = ("weekday", "month", "day")


def direction_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Indexed daily bars with calendar columns and whether the next close is higher."""
    df = over_chunks(indexed(spark, folder, "priority"), lambda d, w: d.withColumn("__next", F.lead("close").over(w)), ahead=1)
    days = {"weekday": F.weekday("ts"), "month": F.month("ts"), "day": F.dayofmonth("ts")}
    df = df.where("__next IS NOT NULL").withColumns({c: v.cast("double") for c, v in days.items()} | {"y": (F.col("__next") > F.col("close")).cast("int")})
    return df.withColumn(N_ROWS, F.col(N_ROWS) - 1).drop("__next")


# Rows, and their counts by calendar cell: a model of calendar columns knows nothing else of a row.
_DIRECTION = (
    with_bars("priority", True)
    + f""", nx AS (SELECT *, lead(close) OVER (PARTITION BY symbol ORDER BY rn) AS nxt FROM ix),
    dr AS MATERIALIZED (SELECT symbol, ts, rn, (isodow(ts) - 1)::DOUBLE AS weekday, month(ts)::DOUBLE AS month, day(ts)::DOUBLE AS day, CASE WHEN nxt > close THEN 1 ELSE 0 END AS y,
      rn < floor((n_rows - 1) * (1 - {_SHARE})) AS early FROM nx WHERE nxt IS NOT NULL),
    cell AS MATERIALIZED (SELECT weekday, month, day, sum(CASE WHEN early THEN y ELSE 0 END)::DOUBLE AS pos, sum(CASE WHEN early THEN 1 ELSE 0 END)::DOUBLE AS n FROM dr GROUP BY ALL)"""
)


def _newton_sql(name: str, columns: Sequence[str], steps: int = 12) -> str:
    """CTEs that end in {name}_p: the probability of class 1 per cell, by Newton's steps on standardised columns."""
    k = len(columns) + 1
    x = ["1.0", *[f"z_{c}" for c in columns]]
    scale = ", ".join(f"sum(n * {c}) / sum(n) AS m_{c}, sqrt(sum(n * {c} * {c}) / sum(n) - (sum(n * {c}) / sum(n)) ** 2) AS s_{c}" for c in columns)
    scaled = ", ".join(f"({c} - m_{c}) / s_{c} AS z_{c}" for c in columns)
    out = f", {name}_z AS MATERIALIZED (SELECT cell.*, {scaled} FROM cell CROSS JOIN (SELECT {scale} FROM cell))"
    out += f", {name}_0 AS (SELECT ln(sum(pos) / (sum(n) - sum(pos))) AS b0, {', '.join(f'0.0::DOUBLE AS b{i}' for i in range(1, k))} FROM cell)"

    def det(m: list[list[str]]) -> str:
        if len(m) == 1:
            return m[0][0]
        return "(" + " ".join(f"{'-' if j % 2 else '+'} {m[0][j]} * {det([r[:j] + r[j + 1 :] for r in m[1:]])}" for j in range(len(m))) + ")"

    hess = [[f"h{min(i, j)}{max(i, j)}" for j in range(k)] for i in range(k)]
    for t in range(steps):
        p = "1 / (1 + exp(-(" + " + ".join(f"b{i} * {x[i]}" for i in range(k)) + ")))"
        sums = ", ".join(f"sum((n * q - pos) * {x[i]}) AS g{i}" for i in range(k)) + ", " + ", ".join(f"sum(n * q * (1 - q) * {x[i]} * {x[j]}) AS h{i}{j}" for i in range(k) for j in range(i, k))
        moved = ", ".join(f"b{i} - {det([[f'g{r}' if c == i else hess[r][c] for c in range(k)] for r in range(k)])} / {det(hess)} AS b{i}" for i in range(k))
        firsts = ", ".join(f"any_value(b{i}) AS b{i}" for i in range(k))
        out += f", {name}_{t + 1} AS MATERIALIZED (SELECT {moved} FROM (SELECT {firsts}, {sums} FROM (SELECT *, {p} AS q FROM {name}_z CROSS JOIN {name}_{t})))"
    p = "1 / (1 + exp(-(" + " + ".join(f"b{i} * {x[i]}" for i in range(k)) + ")))"
    return out + f", {name}_p AS MATERIALIZED (SELECT weekday, month, day, {p} AS p FROM {name}_z CROSS JOIN {name}_{steps})"


def _boosted_sql(rounds: int, rate: float, depth: int) -> str:
    """A recursive CTE with one step per round: `depth` times, each node's cut of the greatest gain; then the leaves' values."""
    out = f""", boost(t, weekday, month, day, pos, n, m) AS (
      SELECT 0, weekday, month, day, pos, n, ln((SELECT sum(pos) / (sum(n) - sum(pos)) FROM cell)) FROM cell
      UNION ALL (WITH l0 AS (SELECT *, 1 / (1 + exp(-m)) AS p, 1 AS node FROM boost WHERE t < {rounds}),
      k0 AS (SELECT *, n * p - pos AS g, n * p * (1 - p) AS h FROM l0)"""
    for d in range(depth):
        sums = " UNION ALL ".join(f"SELECT node, {i} AS f, {c} AS v, sum(g) AS g, sum(h) AS h, sum(n) AS n FROM k{d} GROUP BY ALL" for i, c in enumerate(_CALENDAR))
        value = "CASE f " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(_CALENDAR)) + " END"
        out += f""",
      u{d} AS (SELECT node, f, v, sum(g) OVER o AS gl, sum(h) OVER o AS hl, sum(n) OVER o AS nl, sum(g) OVER a AS gt, sum(h) OVER a AS ht, sum(n) OVER a AS nt
        FROM ({sums}) WINDOW o AS (PARTITION BY node, f ORDER BY v), a AS (PARTITION BY node, f)),
      w{d} AS (SELECT *, 0.5 * (gl * gl / hl + (gt - gl) * (gt - gl) / (ht - hl) - gt * gt / ht) AS gain FROM u{d} WHERE nl >= 1 AND nt - nl >= 1),
      c{d} AS (SELECT node, f, v FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, v) AS r FROM w{d} WHERE gain > 0) WHERE r = 1),
      k{d + 1} AS (SELECT k{d}.* EXCLUDE (node), 2 * k{d}.node + CASE WHEN c.node IS NOT NULL AND {value} > v THEN 1 ELSE 0 END AS node FROM k{d} LEFT JOIN c{d} c ON c.node = k{d}.node)"""
    return out + f"""
      SELECT t + 1, weekday, month, day, pos, n, m - {rate} * (sum(g) OVER (PARTITION BY node)) / (sum(h) OVER (PARTITION BY node)) FROM k{depth})),
    boost_p AS MATERIALIZED (SELECT weekday, month, day, 1 / (1 + exp(-m)) AS p FROM boost WHERE t = {rounds})"""


def _scores_sql(name: str) -> str:
    """The metrics of a report, from probabilities by cell."""
    return f""", gs AS (SELECT CASE WHEN early THEN 'train' ELSE 'test' END AS part, y, CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS guess FROM dr JOIN {name}_p USING (weekday, month, day)),
    pc AS (SELECT part, c, count(*) FILTER (y = c AND guess = c) AS hit, count(*) FILTER (guess = c) AS said, count(*) FILTER (y = c) AS actual FROM gs CROSS JOIN (VALUES (0), (1)) AS k(c) GROUP BY ALL),
    fg AS (SELECT part, actual, coalesce(hit / nullif(said, 0), 0) AS precision, coalesce(hit / nullif(actual, 0), 0) AS recall, coalesce(2 * hit / nullif(said + actual, 0), 0) AS f1 FROM pc),
    mt AS (SELECT part, 'accuracy' AS metric, avg(CASE WHEN y = guess THEN 1.0 ELSE 0.0 END) AS value FROM gs GROUP BY part
      """ + " ".join(f"UNION ALL SELECT part, '{m}_macro', avg({m}) FROM fg GROUP BY part UNION ALL SELECT part, '{m}_weighted', sum({m} * actual) / sum(actual) FROM fg GROUP BY part" for m in ("precision", "recall", "f1")) + f""")
    SELECT part, metric, {r('value', digits=4)} FROM mt"""


def _direction_report(spark: SparkSession, folder: str, columns: Sequence[str], spec: models.TrainSpec) -> DataFrame:
    out = models.train(direction_rows(spark, folder), "y", columns, dataclasses.replace(spec, test_size=_SHARE))[1]
    return rounded(out.where(F.col("metric").rlike("^(accuracy|(precision|recall|f1)_(macro|weighted))$")), 4)


@query(_DIRECTION + _boosted_sql(100, 0.1, 3) + _scores_sql("boost"))
def gradient_boosting_report(spark: SparkSession, folder: str) -> DataFrame:
    """All default settings: 100 rounds of trees of depth 3."""
    return _direction_report(spark, folder, _CALENDAR, models.TrainSpec("gradient_boosting"))


_EXACT = models.TrainSpec("logistic_regression", {"penalty": "none", "tol": 1e-9})


@query(_DIRECTION + _newton_sql("lg", ("weekday", "month")) + _scores_sql("lg"))
def logistic_regression_report(spark: SparkSession, folder: str) -> DataFrame:
    return _direction_report(spark, folder, ("weekday", "month"), _EXACT)


def _fitted_days(spark: SparkSession, folder: str, *columns: Sequence[str]) -> tuple[list[models.TrainedModel], DataFrame]:
    early, late = selection.chronological_split(cut(direction_rows(spark, folder)), _SHARE)
    return [models.fit_model(early, "y", c, _EXACT) for c in columns], late


@query(_DIRECTION + _newton_sql("lg", _CALENDAR) + f" SELECT symbol, ts, {r('p', 'probability_1', 4)} FROM dr JOIN lg_p USING (weekday, month, day) WHERE NOT early")
def direction_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Probabilities of a model that was stored and read back."""
    (model,), late = _fitted_days(spark, folder, _CALENDAR)
    path = scratch_path(spark, "model")
    model.save(path)
    return rounded(models.TrainedModel.load(path).score(late).select("symbol", "ts", "probability_1"), 4)


@query(_DIRECTION + _newton_sql("a", ("weekday",)) + _newton_sql("b", ("month", "day")) + f" SELECT symbol, ts, {r('(2 * a_p.p + b_p.p) / 3', 'probability_1', 4)} FROM dr JOIN a_p USING (weekday, month, day) JOIN b_p USING (weekday, month, day) WHERE NOT early")
def direction_soft_vote(spark: SparkSession, folder: str) -> DataFrame:
    (a, b), late = _fitted_days(spark, folder, ("weekday",), ("month", "day"))
    return rounded(models.vote({"a": a, "b": b}, late, "soft", {"a": 2.0}).select("symbol", "ts", "probability_1"), 4)


@query(
    _DIRECTION
    + "".join(_newton_sql(c, (c,)) for c in _CALENDAR)
    + " SELECT symbol, ts, CASE WHEN " + " + ".join(f"(CASE WHEN {c}_p.p > 0.5 THEN 1 ELSE 0 END)" for c in _CALENDAR) + " >= 2 THEN 1 ELSE 0 END AS prediction FROM dr "
    + " ".join(f"JOIN {c}_p USING (weekday, month, day)" for c in _CALENDAR) + " WHERE NOT early"
)
def direction_hard_vote(spark: SparkSession, folder: str) -> DataFrame:
    fitted, late = _fitted_days(spark, folder, *[(c,) for c in _CALENDAR])
    return models.vote(dict(zip("abc", fitted, strict=True)), late, "hard")


@query(_DIRECTION + _newton_sql("lg", _CALENDAR) + " " + " UNION ALL ".join(f"SELECT '{c}' AS feature, {r(f'abs(b{i + 1})', 'importance', 4)} FROM lg_12" for i, c in enumerate(_CALENDAR)))
def coefficient_importance(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes of a model's coefficients, of standardised columns."""
    (model,), _ = _fitted_days(spark, folder, _CALENDAR)
    return rounded(models.built_in_importance(model).select("feature", "importance"), 4)


@query(_report_sql())
def neural_network_report(spark: SparkSession, folder: str) -> DataFrame:
    return _report(spark, folder, models.TrainSpec("neural_network", {"activation": "sigmoid"}))


_LOGIT = models.TrainSpec("logistic_regression", {"penalty": "none"})
_FOREST = models.TrainSpec("random_forest", {"n_estimators": 20, "max_depth": 8, "max_features": None})


@query(_report_sql())
def grid_search_report(spark: SparkSession, folder: str) -> DataFrame:
    return _report(spark, folder, models.TrainSpec("logistic_regression", tuning="grid", search={"C": [1e-6, 1e4]}, selection="mutual_info", n_features=1))


@query(_report_sql())
def random_search_report(spark: SparkSession, folder: str) -> DataFrame:
    return _report(spark, folder, models.TrainSpec("random_forest", {"max_features": None}, tuning="random", search={"n_estimators": [5, 10], "max_depth": [5, 8]}, n_iter=3))


@query(_report_sql())
def space_search_report(spark: SparkSession, folder: str) -> DataFrame:
    return _report(spark, folder, models.TrainSpec("random_forest", {"max_features": None, "n_estimators": 5}, tuning="bayesian", search={"max_depth": ["int", 4, 9]}, n_iter=5))


def _fitted(spark: SparkSession, folder: str, *specs: models.TrainSpec) -> tuple[list[models.TrainedModel], DataFrame]:
    early, late = selection.chronological_split(cut(calendar_rows(spark, folder)), _SHARE)
    return [models.fit_model(early, "y", _FEATURES, s) for s in specs], late


@query(f"{_LATE} SELECT symbol, ts, y AS prediction FROM late")
def saved_model_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Answers of a model that was stored and read back."""
    (model,), late = _fitted(spark, folder, _FOREST)
    path = scratch_path(spark, "model")
    model.save(path)
    return models.TrainedModel.load(path).score(late).select("symbol", "ts", "prediction")


@query(f"{_LATE} SELECT symbol, ts, y AS prediction FROM late")
def soft_vote(spark: SparkSession, folder: str) -> DataFrame:
    """The class of the greatest mean probability."""
    (a, b), late = _fitted(spark, folder, _LOGIT, _FOREST)
    means = models.vote({"a": a, "b": b}, late, "soft", {"a": 2.0})
    best = F.element_at(F.array(*[F.lit(c) for c in a.classes]), evaluation.decide(a.classes) + 1)
    return means.select("symbol", "ts", best.alias("prediction"))


@query(f"{_LATE} SELECT symbol, ts, y AS prediction FROM late")
def hard_vote(spark: SparkSession, folder: str) -> DataFrame:
    fitted, late = _fitted(spark, folder, _LOGIT, _FOREST, models.TrainSpec("random_forest", {"n_estimators": 5, "max_depth": 1}))
    return models.vote(dict(zip("abc", fitted)), late, "hard")


_MATTERS = " UNION ALL ".join(f"SELECT '{c}' AS feature, {'true' if c == 'weekday' else 'false'} AS matters" for c in _FEATURES)


@query(_MATTERS)
def shuffled_importance(spark: SparkSession, folder: str) -> DataFrame:
    """Features whose exchange costs right answers."""
    (model,), late = _fitted(spark, folder, _FOREST)
    found = models.permutation_importance(model, late, "y", ["symbol", "ts"])
    return found.select("feature", (F.col("importance_mean") > 0.01).alias("matters"))


@query(_MATTERS)
def built_in_importance(spark: SparkSession, folder: str) -> DataFrame:
    (model,), _ = _fitted(spark, folder, _FOREST)
    return models.built_in_importance(model).select("feature", (F.col("importance") > 0.5).alias("matters"))


BINARY = _BINARY + ", s AS (SELECT doc_id, y, 1 - p1 AS probability_0, p1 AS probability_1 FROM b)"


def _isotonic_sql() -> str:
    """The fit at a score is the largest over starts up to it of the smallest mean over ends from it on."""
    out = BINARY
    for c in (0, 1):
        hit = f"CASE WHEN y = {c} THEN 1.0 ELSE 0.0 END"
        out += (
            f", n{c} AS (SELECT probability_{c} AS p, sum({hit}) AS h, count(*)::DOUBLE AS w FROM s GROUP BY 1), "
            f"k{c} AS MATERIALIZED (SELECT p, row_number() OVER (ORDER BY p) AS k, sum(h) OVER (ORDER BY p) AS ch, sum(w) OVER (ORDER BY p) AS cw, h, w FROM n{c}), "
            f"m{c} AS (SELECT a.k AS j, b.k AS e, (b.ch - a.ch + a.h) / (b.cw - a.cw + a.w) AS v FROM k{c} a JOIN k{c} b ON a.k <= b.k), "
            f"l{c} AS (SELECT j, e, min(v) OVER (PARTITION BY j ORDER BY e DESC ROWS UNBOUNDED PRECEDING) AS v FROM m{c}), "
            f"f{c} AS MATERIALIZED (SELECT p, max(v) AS v FROM l{c} JOIN k{c} ON k = e GROUP BY p)"
        )
    total = "nullif(f0.v + f1.v, 0)"
    cells = ", ".join(r(f"coalesce(f{c}.v / {total}, 0.5)", f"probability_{c}", 4) for c in (0, 1))
    return out + f" SELECT doc_id, {cells} FROM s JOIN f0 ON f0.p = s.probability_0 JOIN f1 ON f1.p = s.probability_1"


def _sigmoid_sql(steps: int = 25) -> str:
    """Newton's steps for both curves, one after the other, from the means' log odds."""
    out = BINARY
    for c in (0, 1):
        hit = f"CASE WHEN y = {c} THEN 1.0 ELSE 0.0 END"
        out += f", b{c}_0 AS (SELECT 0.0::DOUBLE AS a, ln(avg({hit}) / (1 - avg({hit}))) AS b FROM s)"
        for i in range(steps):
            out += (
                f", g{c}_{i} AS (SELECT any_value(a) AS a, any_value(b) AS b, sum((q - h) * x) AS ga, sum(q - h) AS gb, sum(q * (1 - q) * x * x) AS aa, sum(q * (1 - q) * x) AS ab, sum(q * (1 - q)) AS bb "
                f"FROM (SELECT a, b, probability_{c} AS x, {hit} AS h, 1 / (1 + exp(-(a * probability_{c} + b))) AS q FROM s CROSS JOIN b{c}_{i})), "
                f"b{c}_{i + 1} AS MATERIALIZED (SELECT a - (bb * ga - ab * gb) / (aa * bb - ab * ab) AS a, b - (aa * gb - ab * ga) / (aa * bb - ab * ab) AS b FROM g{c}_{i})"
            )
    curve = {c: f"(1 / (1 + exp(-(b{c}_{steps}.a * probability_{c} + b{c}_{steps}.b))))" for c in (0, 1)}
    cells = ", ".join(r(f"{curve[c]} / ({curve[0]} + {curve[1]})", f"probability_{c}", 3) for c in (0, 1))
    return out + f" SELECT doc_id, {cells} FROM s CROSS JOIN b0_{steps} CROSS JOIN b1_{steps}"


@query(_isotonic_sql())
def isotonic_calibrated(spark: SparkSession, folder: str) -> DataFrame:
    df = cut(binary_scores(spark, folder))
    out = models.calibrate(df, (0, 1), "y", "isotonic").apply(df)
    return rounded(out.select("doc_id", "probability_0", "probability_1"), 4)


@query(_sigmoid_sql())
def sigmoid_calibrated(spark: SparkSession, folder: str) -> DataFrame:
    df = cut(binary_scores(spark, folder))
    out = models.calibrate(df, (0, 1), "y", "sigmoid").apply(df)
    return rounded(out.select("doc_id", "probability_0", "probability_1"), 3)


# Fixed centres in standardised features, so that every bar's regime is known beforehand.
_CENTERS = ((-0.8, -0.5, -0.6), (0.1, 0.9, 0.2), (1.1, -0.3, 0.9))
_REGIME_FEATURES = ("volatility_ratio_20_50", "efficiency_ratio_20", "roc_20")


def _regime_sql() -> str:
    names = ("vr", "er", "rc")
    scaled = ", ".join(f"CASE WHEN stddev_pop({c}) OVER k > 0 THEN ({c} - avg({c}) OVER k) / stddev_pop({c}) OVER k ELSE 0 END AS z{i}" for i, c in enumerate(names))
    squares = ", ".join(" + ".join(f"(z{i} - ({x})) * (z{i} - ({x}))" for i, x in enumerate(c)) + f" AS d{k}" for k, c in enumerate(_CENTERS))
    return (
        with_bars("priority")
        + f""", st AS (SELECT *, close / nullif({lag('close')}, 0) - 1 AS ret, abs(close - {lag('close')}) AS step FROM ix),
        f AS (SELECT symbol, ts, {roll('stddev_samp(ret)', 20)} / nullif({roll('stddev_samp(ret)', 50)}, 0) AS vr,
          abs(close - {lag('close', 20)}) / nullif({roll('sum(step)', 20)}, 0) AS er, close / nullif({lag('close', 20)}, 0) - 1 AS rc FROM st),
        g AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM f WHERE vr IS NOT NULL AND er IS NOT NULL AND rc IS NOT NULL),
        z AS (SELECT *, {scaled} FROM g WHERE n >= 60 WINDOW k AS (PARTITION BY symbol)),
        q AS (SELECT *, {squares} FROM z),
        h AS (SELECT *, CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS regime, least(d0, d1, d2) AS d FROM q),
        a AS (SELECT symbol, ts, vr, er, rc, regime, 'Regime ' || chr(65 + regime) AS regime_name, 1 / (1 + sqrt(d)) AS confidence FROM h)"""
    )


def _regimes(spark: SparkSession, folder: str) -> DataFrame:
    df = features.add_features(indexed(spark, folder, "priority"), [features.volatility_features(), features.efficiency_ratio(20), features.momentum_features()])
    return regimes.assign_regimes(df, _CENTERS, _REGIME_FEATURES)


@query(_regime_sql() + f" SELECT symbol, ts, regime, regime_name, {r('confidence', digits=4)} FROM a")
def bar_regimes(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_regimes(spark, folder).select("symbol", "ts", "regime", "regime_name", "confidence"), 4)


@query(
    _regime_sql()
    + f" SELECT symbol, ts, regime, regime_name, {r('confidence', digits=4)}, {r('vr', _REGIME_FEATURES[0], 4)}, {r('er', _REGIME_FEATURES[1], 4)}, {r('rc', _REGIME_FEATURES[2], 4)} "
    "FROM a QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1"
)
def latest_regimes(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(regimes.latest_regime(_regimes(spark, folder), _REGIME_FEATURES), 4)


@query(_regime_sql() + " SELECT symbol, count(*) AS n, true AS tight FROM a GROUP BY symbol")
def fitted_regimes(spark: SparkSession, folder: str) -> DataFrame:
    """Bars that a fitted clustering covers, and whether it fits them no worse than the fixed centres do."""
    df = cut(features.add_features(indexed(spark, folder, "priority"), [features.volatility_features(), features.efficiency_ratio(20), features.momentum_features()]))
    cost = lambda model: regimes.assign_regimes(df, model, _REGIME_FEATURES).select("symbol", (F.pow(1 / F.col("confidence") - 1, 2)).alias("c"))
    own = cost(regimes.fit_regimes(df, _REGIME_FEATURES)).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("own"))
    whole = own.agg(F.sum("own").alias("own")).crossJoin(cost(_CENTERS).agg(F.sum("c").alias("fixed"))).first()
    return own.select("symbol", "n", F.lit(whole.own <= whole.fixed).alias("tight"))


# --- walk-forward and strategies ------------------------------------------------

FOLDS = walkforward.Folds(600, 200, 150, rolling=True, retrain_every=2)
_FOLD_SQL = (
    ", nr AS (SELECT symbol, max(n_rows) AS n FROM ix GROUP BY symbol), fd AS (SELECT symbol, unnest(generate_series(1, (n - 800) // 150 + 1)) AS fold FROM nr WHERE n >= 800), "
    "fb AS (SELECT symbol, fold, (fold - 1) * 150 AS train_lo, (fold - 1) * 150 + 600 AS train_hi, (fold - 1) * 150 + 600 AS test_lo, (fold - 1) * 150 + 800 AS test_hi, "
    "fold - (fold - 1) % 2 AS model_fold FROM fd)"
)


@query(
    with_bars("priority") + _FOLD_SQL
    + " SELECT f.*, a.ts AS train_start, b.ts AS train_end, c.ts AS test_start, d.ts AS test_end FROM fb f JOIN ix a ON a.symbol = f.symbol AND a.rn = train_lo "
    "JOIN ix b ON b.symbol = f.symbol AND b.rn = train_hi - 1 JOIN ix c ON c.symbol = f.symbol AND c.rn = test_lo JOIN ix d ON d.symbol = f.symbol AND d.rn = test_hi - 1"
)
def fold_bounds(spark: SparkSession, folder: str) -> DataFrame:
    return walkforward.fold_table(indexed(spark, folder, "priority"), FOLDS)


@query(
    with_bars("priority") + _FOLD_SQL
    + " SELECT i.symbol, i.ts, fold, 'train' AS role FROM ix i JOIN fb f ON i.symbol = f.symbol AND rn >= train_lo AND rn < train_hi "
    "UNION ALL SELECT i.symbol, i.ts, fold, 'test' FROM ix i JOIN fb f ON i.symbol = f.symbol AND rn >= test_lo AND rn < test_hi"
)
def fold_members(spark: SparkSession, folder: str) -> DataFrame:
    df = indexed(spark, folder, "priority")
    tag = lambda role: walkforward.fold_rows(df, FOLDS, role).select("symbol", "ts", "fold", F.lit(role).alias("role"))
    return tag("train").unionByName(tag("test"))


# Each test slice becomes a symbol of its own, "symbol#fold".
_FOLD_SIM = _sim_sql(SPEC).replace(_PREDICTED, "\x00", 1)
_FOLD_SIM = (
    _FOLD_SIM.split("\x00")[0] + _PREDICTED.replace("pd AS", "pd0 AS") + _FOLD_SQL
    + ", fx AS MATERIALIZED (SELECT p.* EXCLUDE (symbol, rn, n_rows), p.symbol || '#' || fold AS symbol, row_number() OVER (PARTITION BY p.symbol, fold ORDER BY p.ts) - 1 AS rn, "
    "count(*) OVER (PARTITION BY p.symbol, fold) AS n_rows FROM pd0 p JOIN fb f ON p.symbol = f.symbol AND p.rn >= test_lo AND p.rn < test_hi), pd AS (SELECT * FROM fx)"
    + _FOLD_SIM.split("\x00")[1].replace(" ix", " fx")
)


@query(_FOLD_SIM + f" SELECT {_TRADE_COLS} FROM trades")
def fold_trades(spark: SparkSession, folder: str) -> DataFrame:
    done = walkforward.fold_backtests(predicted(spark, folder), FOLDS, SPEC, "prediction")
    named = done.trades.withColumn("symbol", F.concat_ws("#", "symbol", "fold"))
    return _shown(named.drop("id", "tags", "fold"))


# A small result per fold whose value is known in closed form: holding over the test slice.
_FOLD_HOLD = (
    ", hr AS (SELECT f.symbol, f.fold, (d.close / c.close - 1) * 1.0 AS total_return_pct, (d.close - c.close) / 100000 AS sharpe_ratio, (f.fold * 3 % 7)::BIGINT AS num_trades, "
    "50.0 + f.fold AS win_rate_pct, -abs(d.close / c.close - 1) AS max_drawdown_pct, c.ts AS test_start, d.ts AS test_end "
    "FROM fb f JOIN ix c ON c.symbol = f.symbol AND c.rn = test_lo JOIN ix d ON d.symbol = f.symbol AND d.rn = test_hi - 1)"
)


def _fold_results(spark: SparkSession, folder: str) -> DataFrame:
    df = cut(indexed(spark, folder, "priority"))
    folds = walkforward.fold_table(df, FOLDS)
    price = lambda at, name: df.select("symbol", F.col(RN).alias(at), F.col("close").alias(name))
    ends = folds.withColumn("last", F.col("test_hi") - 1).join(price("test_lo", "a"), ["symbol", "test_lo"]).join(price("last", "b"), ["symbol", "last"])
    move = F.col("b") / F.col("a") - 1
    return ends.select(
        "symbol", "fold", move.alias("total_return_pct"), ((F.col("b") - F.col("a")) / 100000).alias("sharpe_ratio"), (F.col("fold") * 3 % 7).alias("num_trades"),
        (F.col("fold") + 50.0).alias("win_rate_pct"), (-F.abs(move)).alias("max_drawdown_pct"), "test_start", "test_end",
    )


_FOLD_SUMMARY = (
    with_bars("priority") + _FOLD_SQL + _FOLD_HOLD
    + """, fs AS (SELECT symbol, count(*) AS num_folds, avg(total_return_pct) AS avg_return_per_fold_pct, stddev_samp(total_return_pct) AS std_return_per_fold_pct, avg(sharpe_ratio) AS avg_sharpe,
    avg(num_trades) AS avg_trades_per_fold, avg(win_rate_pct) AS avg_win_rate_pct, avg(max_drawdown_pct) AS avg_max_drawdown_pct, min(max_drawdown_pct) AS worst_fold_drawdown_pct,
    sum(num_trades)::BIGINT AS total_trades, count(*) FILTER (total_return_pct > 0) AS profitable_folds, exp(sum(ln(1 + total_return_pct / 100))) - 1 AS c,
    date_diff('day', min(test_start), max(test_end)) / 365.25 AS total_years FROM hr GROUP BY symbol),
    fz AS (SELECT *, 100.0 * profitable_folds / num_folds AS profitable_folds_pct, c * 100 AS compounded_return_pct, (pow(1 + c, 1 / total_years) - 1) * 100 AS annualized_return_pct FROM fs)"""
)


@query(
    _FOLD_SUMMARY
    + f""" SELECT symbol, num_folds, total_trades, profitable_folds, {rs('avg_return_per_fold_pct', 'std_return_per_fold_pct', 'avg_sharpe', 'avg_trades_per_fold', 'avg_win_rate_pct',
    'avg_max_drawdown_pct', 'worst_fold_drawdown_pct', 'profitable_folds_pct', 'compounded_return_pct', 'annualized_return_pct', 'total_years')} FROM fz"""
)
def fold_summaries(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(walkforward.fold_summary(_fold_results(spark, folder)))


@query(
    _FOLD_SUMMARY
    + f""" SELECT {r('avg(coalesce(nullif(annualized_return_pct, 0), compounded_return_pct))', 'avg_annualized_return_pct')}, {r('avg(avg_sharpe)', 'avg_sharpe_ratio')},
    {r('avg(worst_fold_drawdown_pct)', 'avg_max_drawdown_pct')}, {r('avg(avg_win_rate_pct)', 'avg_win_rate_pct')}, sum(total_trades)::BIGINT AS total_trades, count(*) AS num_assets_aggregated FROM fz"""
)
def asset_summary(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(walkforward.strategy_summary(walkforward.fold_summary(_fold_results(spark, folder))))


@query(
    with_bars("priority") + _FOLD_SQL + _FOLD_HOLD
    + f" SELECT symbol, fold, {r('avg(sharpe_ratio) OVER (PARTITION BY symbol ORDER BY fold ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)', 'rolling_sharpe')} FROM hr"
)
def rolling_fold_sharpe(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(performance.rolling_sharpe(_fold_results(spark, folder), 3).select("symbol", "fold", "rolling_sharpe"))


_LEDGER = ledger.LedgerSpec(stop_multiple=0.5, target_multiple=1.0, trailing=0.2, trailing_activation=0.1)


def _rule_sql(signal_sql: str) -> str:
    """CTE `pd` with a rule's signals (CTE `sg`) and the average range."""
    return (
        f", rg AS MATERIALIZED (SELECT *, {_TR} AS tr FROM ix), {ewm_cte('ra', 'rg', {'y': ('tr', 1 / 14)})}, "
        + signal_sql
        + ", pd AS (SELECT rg.* EXCLUDE (tr), CASE WHEN rg.rn >= 14 THEN ra.y END AS atr, sg.signal AS prediction, 0 AS regime FROM rg JOIN ra USING (symbol, rn) JOIN sg USING (symbol, rn))"
    )


def _strategy_sql(signal_sql: str) -> str:
    shown = rs("entry_price", digits=7) + ", " + rs("stop_loss", "take_profit", "exit_price", "size", "realized_pnl", "mfe", "mae", digits=3)
    return _sim_sql(_LEDGER).replace(_PREDICTED, _rule_sql(signal_sql), 1) + f" SELECT symbol, direction::INT AS direction, entry_time, exit_time, exit_reason, {shown} FROM trades"


def _strategy_trades(spark: SparkSession, folder: str, spec: strategy.StrategySpec) -> DataFrame:
    """Trades; what follows from the average range, a long recursion, has 3 digits."""
    done = strategy.run_strategy(bars(spark, folder, "priority"), spec).trades
    named = done.withColumnsRenamed({"max_favorable_excursion": "mfe", "max_adverse_excursion": "mae"})
    return rounded(named.select("symbol", F.col("direction").cast("int").alias("direction"), "entry_time", "exit_time", "exit_reason", "entry_price", "stop_loss", "take_profit", "exit_price", "size", "realized_pnl", "mfe", "mae"), 3, raw=("entry_price",)).withColumn("entry_price", F.round("entry_price", 7))


_CROSS = _cross_sql(5, 20).removeprefix(", ") + ", sg AS (SELECT symbol, rn, signal FROM x)"
_REVERT = (
    f"rd AS MATERIALIZED (SELECT symbol, ts, rn, greatest({_MOVE}, 0.0) AS g, greatest(-({_MOVE}), 0.0) AS l FROM ix), "
    + ewm_cte("re", "rd", {"eg": ("g", 1 / 14), "el": ("l", 1 / 14)})
    + ", ri AS (SELECT symbol, rn, CASE WHEN rn >= 14 AND el <> 0 THEN 100 - 100 / (1 + eg / el) END AS rsi FROM rd JOIN re USING (symbol, rn)), "
    "rj AS (SELECT *, lag(rsi) OVER (PARTITION BY symbol ORDER BY rn) AS p FROM ri), "
    "sg AS (SELECT symbol, rn, CASE WHEN rsi < 45 AND p >= 45 THEN 1 WHEN rsi > 55 AND p <= 55 THEN -1 ELSE 0 END AS signal FROM rj)"
)


@query(_strategy_sql(_CROSS))
def crossover_strategy(spark: SparkSession, folder: str) -> DataFrame:
    spec = strategy.StrategySpec("dma_crossover", 5, 20, ledger=_LEDGER)
    return _strategy_trades(spark, folder, spec)


@query(_strategy_sql(_REVERT))
def rsi_strategy(spark: SparkSession, folder: str) -> DataFrame:
    spec = strategy.StrategySpec("rsi_mean_reversion", rsi_lower=45.0, rsi_upper=55.0, ledger=_LEDGER)
    return _strategy_trades(spark, folder, spec)


@query()
def folded_crossover_strategy(spark: SparkSession, folder: str) -> DataFrame:
    spec = strategy.StrategySpec("dma_crossover", 5, 20, ledger=_LEDGER, folds=FOLDS)
    return rounded(strategy.run_strategy(bars(spark, folder, "priority"), spec).assets, 4)


@query()
def model_strategy(spark: SparkSession, folder: str) -> DataFrame:
    spec = strategy.StrategySpec("ml", features=_SPEC, training=_LOGIT, threshold=0.4, ledger=_LEDGER, folds=walkforward.Folds(800, 400, 400))
    return rounded(strategy.run_strategy(bars(spark, folder, "priority"), spec).assets, 4)


# --- streams ------------------------------------------------------------------


_DAYS = ("day_of_week", "roc_5", "volume_ratio")


def _day_model(spark: SparkSession, folder: str) -> models.TrainedModel:
    """A forest that knows a bar's class by its weekday."""
    rows = feature_rows(spark, folder).withColumn("y", F.when(F.weekday("ts") <= 1, -1).when(F.weekday("ts") <= 3, 0).otherwise(1))
    return models.fit_model(rows, "y", _DAYS, _FOREST)


@query(with_bars("priority") + f" SELECT symbol, ts, {_CLASS} AS prediction FROM ix WHERE rn = n_rows - 1")
def newest_scores(spark: SparkSession, folder: str) -> DataFrame:
    return score_latest(bars(spark, folder, "priority"), _day_model(spark, folder), _SPEC).select("symbol", "ts", "prediction")


@query(
    "WITH b AS (SELECT event_type AS symbol, time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '2020-01-01') AS ts, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, "
    "last(value ORDER BY ts, event_id) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY event_type, time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '2020-01-01')) "
    "SELECT * FROM b"
)
def streamed_bars(spark: SparkSession, folder: str) -> DataFrame:
    """All bars of a stream of ticks that comes to its end: a last file's tick closes the windows still open."""
    events = spark.read.parquet(f"{folder}/events.parquet").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")
    source = scratch_path(spark, "ticks")
    events.write.parquet(source)
    feed = spark.readStream.schema(events.schema).parquet(source)
    closing = events.agg(closing_tick(F.max("ts"), "6 hours", "1 hour").alias("ts"))
    out = stream_bars(feed, "6 hours", "1 hour", "value", order=("ts", "event_id")).where(F.col("close").isNotNull())
    path = scratch_path(spark, "stream-bars")
    job = out.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", scratch_path(spark, "stream-state"))
    job.trigger(availableNow=True).start().awaitTermination()
    last = closing.select(F.lit(None).cast("string").alias("symbol"), "ts", F.lit(None).cast(events.schema["event_id"].dataType).alias("event_id"), F.lit(None).cast(events.schema["value"].dataType).alias("value"))
    last.write.mode("append").parquet(source)
    job.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


_STREAMED = ({"indicator": "sma", "length": 10}, {"indicator": "ema", "length": 12}, {"indicator": "rsi", "length": 14}, {"indicator": "atr", "length": 14}, {"indicator": "obv"})


@query(
    with_bars("brand", True)
    + f""", d AS MATERIALIZED (SELECT *, greatest({_MOVE}, 0.0) AS g, greatest(-({_MOVE}), 0.0) AS l, {_TR} AS tr, coalesce(volume * sign(close - {lag('close')}), 0.0) AS f FROM ix), """
    + ewm_cte("e", "d", {"em": ("close", 2 / 13), "eg": ("g", 1 / 14), "el": ("l", 1 / 14), "et": ("tr", 1 / 14)})
    + f""" SELECT symbol, ts, {r('CASE WHEN rn >= 9 THEN avg(close) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) END', 'sma_length10')}, {r('CASE WHEN rn >= 11 THEN em END', 'ema_length12')},
      {r('CASE WHEN rn >= 14 AND el <> 0 THEN 100 - 100 / (1 + eg / el) END', 'rsi_length14')}, {r('CASE WHEN rn >= 14 THEN et END', 'atr_length14')}, {r('sum(f) OVER (PARTITION BY symbol ORDER BY rn)', 'obv')} FROM d JOIN e USING (symbol, rn)"""
)
def streamed_indicators(spark: SparkSession, folder: str) -> DataFrame:
    """Weekly bars as a stream of one file a year, stopped and started again on the way: states per brand, no history."""
    week = cut(bars(spark, folder, "brand").withColumn("part", F.year("ts")))
    source, path, state = (scratch_path(spark, n) for n in ("feed", "indicators", "indicator-state"))
    years = sorted(row.part for row in week.select("part").distinct().collect())
    for some in (years[: len(years) // 2], years[len(years) // 2 :]):
        for part in some:
            week.where(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(source)
        feed = spark.readStream.schema(week.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(source)
        job = stream_indicators(feed, _STREAMED).writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", state)
        job.trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(path)
    return rounded(found.select("symbol", "ts", "sma_length10", "ema_length12", "rsi_length14", "atr_length14", "obv"))


@query(with_bars("priority") + f" SELECT symbol, ts, {_CLASS} AS prediction FROM ix QUALIFY row_number() OVER (PARTITION BY symbol, year(ts) ORDER BY ts DESC) = 1")
def streamed_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Replay the daily bars as a stream of one file a year and score each file's newest bars."""
    model = _day_model(spark, folder)
    source, out = scratch_path(spark, "feed"), scratch_path(spark, "scores")
    day = cut(bars(spark, folder, "priority").withColumn("part", F.year("ts")))
    for part in sorted(row.part for row in day.select("part").distinct().collect()):
        day.where(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(source)
    feed = spark.readStream.schema(day.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(source)
    job = score_stream(feed, scratch_path(spark, "known"), out, scratch_path(spark, "score-state"), model, _SPEC)
    job.start().awaitTermination()
    return spark.read.parquet(out).select("symbol", "ts", "prediction")
