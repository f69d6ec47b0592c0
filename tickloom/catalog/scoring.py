"""Evaluation of score tables and decisions on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.catalog.base import indexed, query, r, rs, with_bars
from tickloom.catalog.trading import _PROBS, CLASSES, with_probabilities
from tickloom.functions.columns import rounded
from tickloom.operators import evaluation as ev
from tickloom.operators.labels import directional
from tickloom.sources.derived import table

_BINARY = (
    "WITH b AS MATERIALIZED (SELECT doc_id, lang, quality AS y, 1 / (1 + exp(-(ln(n_chars) - 6))) AS p1, "
    "(1 / (1 + exp(-(ln(n_chars) - 6))) >= 0.5)::INT AS yhat FROM documents JOIN labels USING (doc_id))"
)


def binary_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Document quality with a score from the text length."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", "n_chars").join(table(spark, folder, "labels"), "doc_id")
    p = 1 / (1 + F.exp(-(F.ln("n_chars") - 6)))
    return docs.select("doc_id", "lang", F.col("quality").alias("y"), (p >= 0.5).cast("int").alias("yhat"), (1 - p).alias("probability_0"), p.alias("probability_1"))


_TERNARY = (
    with_bars("priority")
    + f", {_PROBS}, f AS (SELECT symbol, ts, lead(close, 5) OVER (PARTITION BY symbol ORDER BY rn) / nullif(close, 0) - 1 AS fut, pm, p0, p1 FROM pb), "
    + "t AS MATERIALIZED (SELECT symbol, ts, pm, p0, p1, CASE WHEN fut > 0.001 THEN 1 WHEN fut < -0.001 THEN -1 ELSE 0 END AS y, "
    + "CASE WHEN pm = greatest(pm, p0, p1) THEN -1 WHEN p0 = greatest(pm, p0, p1) THEN 0 ELSE 1 END AS yhat FROM f WHERE fut IS NOT NULL)"
)


def ternary_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Direction over five bars with momentum scores for three classes."""
    df = directional(with_probabilities(indexed(spark, folder, "priority")), 5, 0.001, "y")
    index = ev.decide(CLASSES)
    return df.withColumn("yhat", F.element_at(F.array(*[F.lit(int(c)) for c in CLASSES]), index + 1))


@query(
    _TERNARY
    + ", l AS (SELECT DISTINCT symbol, y AS v FROM t UNION SELECT DISTINCT symbol, yhat FROM t), g AS (SELECT a.symbol, a.v AS truth, b.v AS guess FROM l a JOIN l b USING (symbol)) "
    + "SELECT g.symbol, g.truth, g.guess, count(t.ts) AS n FROM g LEFT JOIN t ON t.symbol = g.symbol AND t.y = g.truth AND t.yhat = g.guess GROUP BY 1, 2, 3"
)
def confusion_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return ev.confusion(ternary_scores(spark, folder), keys=["symbol"])


_REPORT = """, l AS (SELECT DISTINCT y AS v FROM {t} UNION SELECT DISTINCT yhat FROM {t}),
  c AS (SELECT v AS label, count(*) FILTER (y = v) AS actual, count(*) FILTER (yhat = v) AS said, count(*) FILTER (y = v AND yhat = v) AS hit FROM l CROSS JOIN {t} GROUP BY v),
  p AS (SELECT label, CASE WHEN said > 0 THEN hit / said ELSE 0 END AS precision, CASE WHEN actual > 0 THEN hit / actual ELSE 0 END AS recall,
    CASE WHEN said + actual > 0 THEN 2.0 * hit / (said + actual) ELSE 0 END AS f1, actual AS support FROM c)"""
_PRF = rs("precision", "recall", "f1")


@query(
    _TERNARY + _REPORT.format(t="t")
    + f" SELECT 'class' AS kind, label::VARCHAR AS label, {_PRF}, support::BIGINT AS support FROM p"
    + f" UNION ALL SELECT 'macro', NULL, {r('avg(precision)', 'a')}, {r('avg(recall)', 'b')}, {r('avg(f1)', 'c')}, sum(support)::BIGINT FROM p"
    + f" UNION ALL SELECT 'weighted', NULL, {r('sum(precision * support) / sum(support)', 'a')}, {r('sum(recall * support) / sum(support)', 'b')}, {r('sum(f1 * support) / sum(support)', 'c')}, sum(support)::BIGINT FROM p"
)
def classification_report(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ev.class_report(ternary_scores(spark, folder)))


@query(
    _TERNARY
    + f" SELECT symbol, {r('avg(-ln(greatest(2.220446049250313e-16, least(1 - 2.220446049250313e-16, CASE y WHEN -1 THEN pm WHEN 0 THEN p0 ELSE p1 END))))', 'log_loss')} FROM t GROUP BY symbol"
)
def log_loss_per_symbol(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ev.log_loss(ternary_scores(spark, folder), CLASSES, keys=["symbol"]))


_CURVE = (
    ", g AS (SELECT p1 AS s, sum(y) AS pos, sum(1 - y) AS neg FROM b GROUP BY p1), "
    "c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS np, sum(neg) OVER () AS nn FROM g WINDOW w AS (ORDER BY s DESC))"
)


@query(_BINARY + _CURVE + f" SELECT {r('s', 'threshold', 9)}, {r('fp / nn', 'fpr', 9)}, {r('tp / np', 'tpr', 9)} FROM c")
def roc_points(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ev.roc_curve(binary_scores(spark, folder), "probability_1", F.col("y") == 1), 9)


@query(_BINARY + _CURVE + f" SELECT {r('s', 'threshold', 9)}, {r('tp / (tp + fp)', 'precision', 9)}, {r('tp / np', 'recall', 9)} FROM c")
def precision_recall_points(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ev.precision_recall_curve(binary_scores(spark, folder), "probability_1", F.col("y") == 1), 9)


_AUC_BINARY = "sum(neg * (tp - pos + pos / 2)) / (max(np) * max(nn))"


@query(_BINARY + _CURVE + f" SELECT {r(_AUC_BINARY, 'roc_auc')}, {r('sum(pos * tp / (tp + fp)) / max(np)', 'average_precision')} FROM c")
def binary_auc(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ev.auc(binary_scores(spark, folder), "probability_1", F.col("y") == 1))


_MULTI = """, k AS (SELECT 'ovr' AS kind, c AS a, 0 AS b, CASE c WHEN -1 THEN pm WHEN 0 THEN p0 ELSE p1 END AS s, (y = c)::INT AS h FROM t CROSS JOIN (VALUES (-1), (0), (1)) v(c)
    UNION ALL SELECT 'ovo', a, b, CASE a WHEN -1 THEN pm WHEN 0 THEN p0 ELSE p1 END, (y = a)::INT FROM t CROSS JOIN (VALUES (-1, 0), (0, -1), (-1, 1), (1, -1), (0, 1), (1, 0)) v(a, b) WHERE y IN (a, b)),
  g AS (SELECT kind, a, b, s, sum(h) AS pos, sum(1 - h) AS neg FROM k GROUP BY 1, 2, 3, 4),
  c AS (SELECT *, sum(pos) OVER w AS tp FROM g WINDOW w AS (PARTITION BY kind, a, b ORDER BY s DESC)),
  x AS (SELECT kind, a, b, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(neg * (tp - pos + pos / 2)) / (sum(pos) * sum(neg)) END AS auc, CASE kind WHEN 'ovr' THEN sum(pos) ELSE sum(pos) + sum(neg) END AS w FROM c GROUP BY 1, 2, 3),
  m AS (SELECT kind, avg(auc) AS macro, sum(auc * w) / sum(w) FILTER (auc IS NOT NULL) AS weighted FROM x GROUP BY kind)"""


@query(_TERNARY + _MULTI + f" SELECT kind, {rs('macro', 'weighted')} FROM m")
def multiclass_areas(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ev.multiclass_auc(ternary_scores(spark, folder), CLASSES))


# The report above names its class counts `c`; the score curve gets other names here.
_CURVE2 = (
    ", g2 AS (SELECT p1 AS s, sum(y) AS pos, sum(1 - y) AS neg FROM b GROUP BY p1), "
    "c2 AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS np, sum(neg) OVER () AS nn FROM g2 WINDOW w AS (ORDER BY s DESC))"
)


def _scalar(expr: str, source: str, name: str) -> str:
    return f"(SELECT round({expr}, 6) + 0.0 FROM {source}) AS {name}"


@query(
    _BINARY + _REPORT.format(t="b") + _CURVE2 + " SELECT "
    + ", ".join(
        [
            _scalar("avg((y = yhat)::INT)", "b", "accuracy"),
            _scalar("avg(-ln(CASE y WHEN 1 THEN p1 ELSE 1 - p1 END))", "b", "log_loss"),
            *[_scalar(f"avg({m})", "p", f"{m}_macro") for m in ("precision", "recall", "f1")],
            *[_scalar(f"sum({m} * support) / sum(support)", "p", f"{m}_weighted") for m in ("precision", "recall", "f1")],
            _scalar(_AUC_BINARY, "c2", "roc_auc"),
            _scalar("sum(pos * tp / (tp + fp)) / max(np)", "c2", "average_precision"),
        ]
    )
)
def validation_figures(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ev.evaluate(binary_scores(spark, folder), (0, 1)))


@query(
    with_bars("priority") + f", {_PROBS} SELECT symbol, ts, CASE WHEN p1 >= 0.65 THEN 1 ELSE 0 END AS decision, "
    "CASE WHEN pm = greatest(pm, p0, p1) THEN 0 WHEN p0 = greatest(pm, p0, p1) THEN 1 ELSE 2 END AS best, "
    + r("greatest(pm, p0, p1)", "confidence") + " FROM pb"
)
def threshold_decisions(spark: SparkSession, folder: str) -> DataFrame:
    df = with_probabilities(indexed(spark, folder, "priority"))
    return rounded(
        df.select("symbol", "ts", ev.decide(("0", "1"), 0.65).alias("decision"), ev.decide(CLASSES).alias("best"), ev.confidence(CLASSES).alias("confidence"))
    )


def _members(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    names = [f"`probability_{c}`" for c in CLASSES]
    a = with_probabilities(indexed(spark, folder, "priority")).select("symbol", "ts", *names)
    flat = {f"probability_{c}": F.lit(1 / 3) for c in CLASSES}
    return {"momentum": a, "flat": a.select("symbol", "ts", *[v.alias(n) for n, v in flat.items()])}


def _mixed(w: float, v: float, divisor: float) -> str:
    cells = [(f'"probability_{c}"', p) for c, p in zip(CLASSES, ("pm", "p0", "p1"))]
    return with_bars("priority") + f", {_PROBS} SELECT symbol, ts, " + ", ".join(r(f"({w} * {p} + {v} / 3.0) / {divisor}", n) for n, p in cells) + " FROM pb"


@query(_mixed(1.0, 1.0, 2.0))
def ensemble_average(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ev.combine_scores(_members(spark, folder), CLASSES))


@query(_mixed(3.0, 1.0, 4.0))
def ensemble_weighted(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ev.combine_scores(_members(spark, folder), CLASSES, "weighted_average", {"momentum": 3.0}))
