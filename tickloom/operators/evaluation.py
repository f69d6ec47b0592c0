"""Classifier evaluation and decisions on score tables.

`keys` groups the figures (per symbol, per fold); the default is one group.
Counts combine before the shuffle, and curves are built over distinct scores.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.columns import div, quoted
from tickloom.plans.series import index_by, join_on_keys, running
from tickloom.plans.storage import once

EPS = 2.220446049250313e-16


def confusion(df: DataFrame, truth: str = "y", guess: str = "yhat", keys: Sequence[str] = ()) -> DataFrame:
    """Counts for every pair of labels that occur as truth or prediction."""
    pairs = once(df.groupBy(*keys, F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(F.count(F.lit(1)).alias("n")))
    labels = pairs.groupBy(*keys).agg(F.array_union(F.collect_set("truth"), F.collect_set("guess")).alias("__l"))
    grid = labels.withColumn("truth", F.explode("__l")).withColumn("guess", F.explode("__l")).drop("__l")
    return grid.join(pairs, [*keys, "truth", "guess"], "left").fillna(0, ["n"])


def accuracy(df: DataFrame, truth: str = "y", guess: str = "yhat", keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg((F.col(truth) == F.col(guess)).cast("int")).alias("accuracy"))


def class_report(df: DataFrame, truth: str = "y", guess: str = "yhat", keys: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class, then macro and weighted means (class NULL)."""
    cells = confusion(df, truth, guess, keys)
    side = cells.select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.col("truth").alias("label"), F.col("n").alias("actual"), F.lit(0).cast("bigint").alias("said"), F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0).alias("hit")),
                F.struct(F.col("guess").alias("label"), F.lit(0).cast("bigint").alias("actual"), F.col("n").alias("said"), F.lit(0).cast("bigint").alias("hit")),
            )
        ).alias("s"),
    ).select(*keys, "s.*")
    total = side.groupBy(*keys, "label").agg(*[F.sum(c).alias(c) for c in ("actual", "said", "hit")])
    zero = F.lit(0.0)
    per_class = total.select(
        *keys,
        F.lit("class").alias("kind"),
        F.col("label").cast("string").alias("label"),
        F.coalesce(div("hit", "said"), zero).alias("precision"),
        F.coalesce(div("hit", "actual"), zero).alias("recall"),
        F.coalesce(div(2 * F.col("hit"), F.col("said") + F.col("actual")), zero).alias("f1"),
        F.col("actual").alias("support"),
    )
    per_class = once(per_class)
    names = ("precision", "recall", "f1")
    macro = per_class.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in names], F.sum("support").alias("support"))
    weighted = per_class.groupBy(*keys).agg(
        *[F.coalesce(div(F.sum(F.col(c) * F.col("support")), F.sum("support")), zero).alias(c) for c in names], F.sum("support").alias("support")
    )
    out = per_class
    for kind, table in (("macro", macro), ("weighted", weighted)):
        out = out.unionByName(table.withColumns({"kind": F.lit(kind), "label": F.lit(None).cast("string")}))
    return out


def probability_of(column: str, classes: Sequence[str | int]) -> Column:
    """The probability given to the class named by `column`."""
    out = F.lit(None).cast("double")
    for c in classes:
        out = F.when(F.col(column).cast("string") == str(c), F.col(quoted(f"probability_{c}"))).otherwise(out)
    return out


def log_loss(df: DataFrame, classes: Sequence[str | int], truth: str = "y", keys: Sequence[str] = ()) -> DataFrame:
    p = F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), probability_of(truth, classes)))
    return df.groupBy(*keys).agg(F.avg(-F.ln(p)).alias("log_loss"))


SLICES = 256


def score_counts(df: DataFrame, score: str, positive: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per distinct score, best score first, with running counts.

    Score slices come from a sketch of all scores, so they hold similar shares
    of the rows however the scores are distributed.
    """
    hit = F.coalesce(positive, F.lit(False))
    per_score = df.select(*keys, F.col(quoted(score)).cast("double").alias("score"), hit.alias("__hit")).filter("score IS NOT NULL")
    per_score = once(
        per_score.groupBy(*keys, "score").agg(
            F.count(F.when(F.col("__hit"), 1)).alias("pos"), F.count(F.when(~F.col("__hit"), 1)).alias("neg")
        )
    )
    grid = F.array(*[F.lit(i / SLICES) for i in range(1, SLICES)])
    # SLICES - 1 numbers, however many scores there are.
    marks = per_score.agg(F.percentile_approx("score", grid, F.lit(10 * SLICES)).alias("m")).collect()[0]["m"] or []
    edges = F.array(*[F.lit(float(m)) for m in sorted(set(marks))]).cast("array<double>")
    sliced = per_score.withColumn("__s", F.size(F.filter(edges, lambda m: m > F.col("score"))))
    group = list(keys) or ["__all"]
    sliced = sliced if keys else sliced.withColumn("__all", F.lit(0))
    ranked = index_by(sliced, group, F.col("__s"), [F.col("score").desc()]).drop("__s")
    out = running(ranked, {"tp": ("sum", "pos"), "fp": ("sum", "neg")}, group)
    totals = out.groupBy(*group).agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))
    return join_on_keys(out, totals, group).drop("__all")


def roc_curve(df: DataFrame, score: str, positive: Column, keys: Sequence[str] = ()) -> DataFrame:
    """One point per distinct score: false and true positive rate at `score` and above."""
    c = score_counts(df, score, positive, keys)
    return c.select(*keys, F.col("score").alias("threshold"), div("fp", "negatives").alias("fpr"), div("tp", "positives").alias("tpr"))


def precision_recall_curve(df: DataFrame, score: str, positive: Column, keys: Sequence[str] = ()) -> DataFrame:
    c = score_counts(df, score, positive, keys)
    return c.select(
        *keys, F.col("score").alias("threshold"), div("tp", F.col("tp") + F.col("fp")).alias("precision"), div("tp", "positives").alias("recall")
    )


def auc(df: DataFrame, score: str, positive: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve (ties count half) and average precision."""
    c = score_counts(df, score, positive, keys)
    above = F.col("tp") - F.col("pos")
    pairs = F.max(F.col("positives").cast("double") * F.col("negatives"))
    return c.groupBy(*keys).agg(
        F.when(pairs > 0, F.sum(F.col("neg") * (above + F.col("pos") / 2)) / pairs).alias("roc_auc"),
        F.when(F.max("positives") > 0, F.sum(F.col("pos") * div("tp", F.col("tp") + F.col("fp"))) / F.max("positives")).alias("average_precision"),
    )


def multiclass_auc(df: DataFrame, classes: Sequence[str | int], truth: str = "y", keys: Sequence[str] = ()) -> DataFrame:
    """One-vs-rest and one-vs-one ROC areas, macro and weighted means."""
    y = F.col(truth).cast("string")
    p = lambda c: F.col(quoted(f"probability_{c}"))
    rest = [F.struct(F.lit("ovr").alias("kind"), F.lit(str(c)).alias("a"), F.lit("").alias("b"), p(c).alias("s"), (y == str(c)).alias("hit")) for c in classes]
    duel = [
        F.when((y == str(a)) | (y == str(b)), F.struct(F.lit("ovo").alias("kind"), F.lit(str(a)).alias("a"), F.lit(str(b)).alias("b"), p(a).alias("s"), (y == str(a)).alias("hit")))
        for pair in combinations(classes, 2)
        for a, b in (pair, pair[::-1])
    ]
    long = df.select(*keys, F.explode(F.array_compact(F.array(*rest, *duel))).alias("t")).select(*keys, "t.*")
    group = [*keys, "kind", "a", "b"]
    counts = long.groupBy(*group).agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("hit"), 1)).alias("hits"))
    areas = auc(long, "s", F.col("hit"), group).join(counts, group)
    # Both directions of a pair count with the rows of the pair.
    weight = F.when(F.col("kind") == "ovr", F.col("hits")).otherwise(F.col("rows"))
    return areas.groupBy(*keys, "kind").agg(
        F.avg("roc_auc").alias("macro"),
        F.try_divide(F.sum(F.col("roc_auc") * weight), F.sum(F.when(F.col("roc_auc").isNotNull(), weight))).alias("weighted"),
    )


def evaluate(
    df: DataFrame,
    classes: Sequence[str | int],
    truth: str = "y",
    guess: str = "yhat",
    positive: str | int | None = None,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Accuracy, weighted and macro F1, log loss and the areas, one row per group."""
    df = once(df)
    report = class_report(df, truth, guess, keys)
    parts = [accuracy(df, truth, guess, keys), log_loss(df, classes, truth, keys)]
    for kind in ("macro", "weighted"):
        cols = [F.col(c).alias(f"{c}_{kind}") for c in ("precision", "recall", "f1")]
        parts.append(report.filter(F.col("kind") == kind).select(*keys, *cols))
    if len(classes) == 2:
        positive = str(positive if positive is not None else ("1" if "1" in map(str, classes) else max(map(str, classes))))
        parts.append(auc(df, f"probability_{positive}", F.col(truth).cast("string") == positive, keys))
    else:
        areas = multiclass_auc(df, classes, truth, keys)
        for kind in ("ovr", "ovo"):
            parts.append(
                areas.filter(F.col("kind") == kind).select(*keys, F.col("macro").alias(f"roc_auc_{kind}_macro"), F.col("weighted").alias(f"roc_auc_{kind}_weighted"))
            )
    one = ["__one"] if not keys else list(keys)
    parts = [p if keys else p.withColumn("__one", F.lit(1)) for p in parts]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, one, "left")
    return out.drop("__one")


def class_probabilities(classes: Sequence[str | int]) -> Column:
    return F.array(*[F.col(quoted(f"probability_{c}")) for c in classes])


def decide(classes: Sequence[str | int], threshold: float = 0.5, positive_index: int = 1) -> Column:
    """Index of the predicted class.

    Two classes: the positive one from the threshold on. More: the most
    probable, the first in a tie. One column: 1 from 0.5 on.
    """
    p = class_probabilities(classes)
    if len(classes) == 1:
        return (p[0] >= 0.5).cast("int")
    if len(classes) == 2:
        return F.when(p[positive_index] >= threshold, positive_index).otherwise(1 - positive_index)
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def confidence(classes: Sequence[str | int]) -> Column:
    return F.array_max(class_probabilities(classes))


def combine_scores(
    members: Mapping[str, DataFrame],
    classes: Sequence[str | int],
    method: str = "average",
    weights: Mapping[str, float] | None = None,
    on: Sequence[str] = ("symbol", "ts"),
) -> DataFrame:
    """Several models' probabilities as one.

    `average` is the mean of weight * p; `weighted_average` divides by the sum
    of the weights and falls back to `average` when that is zero. A row
    counts where every member scored it.
    """
    weights = {m: float((weights or {}).get(m, 1.0)) for m in members}
    columns = [f"probability_{c}" for c in classes]
    for name, df in members.items():
        if [c for c in df.columns if c.startswith("probability_")] != columns:
            raise ValueError(f"classes of {name!r} differ from {list(classes)}")
    total = sum(weights.values())
    divisor = total if method == "weighted_average" and total != 0 else float(len(members))
    if method not in ("average", "weighted_average"):
        raise ValueError(f"unknown method {method!r}")
    long = None
    for name, df in members.items():
        part = df.select(*on, *[(F.col(quoted(c)) * weights[name]).alias(c) for c in columns])
        long = part if long is None else long.unionByName(part)
    summed = long.groupBy(*on).agg(F.count(F.lit(1)).alias("__n"), *[(F.sum(quoted(c)) / divisor).alias(c) for c in columns])
    return summed.filter(F.col("__n") == len(members)).drop("__n")
