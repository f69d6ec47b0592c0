"""Classifiers on Spark ML: registry, training, tuning, calibration, scoring."""

from __future__ import annotations

import json
import math
import random
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from itertools import product
from multiprocessing.pool import ThreadPool

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import quoted
from tickloom.operators import evaluation, logistic
from tickloom.operators.boosting import BoostedModel, BoostedTrees, BoostSpec, cross_validated
from tickloom.operators.network import NetworkModel, NetworkSpec, NetworkTrainer
from tickloom.operators.selection import SEED, Preprocessor, chronological_split, indexed_label, select_features
from tickloom.plans.series import KEYS
from tickloom.plans.storage import cut, once

LABEL, FEATURES, WEIGHT = "__label", "__features", "__weight"

Factory = Callable[[Mapping, int, int, int], Estimator]
_FACTORIES: dict[str, Factory] = {}


def register_model(*names: str) -> Callable[[Factory], Factory]:
    """Register a factory ``(params, n_classes, n_features, n_rows) -> Estimator``."""

    def add(factory: Factory) -> Factory:
        for n in names:
            _FACTORIES[n] = factory
        return factory

    return add


def create_model(name: str, params: Mapping | None = None, n_classes: int = 2, n_features: int = 1, n_rows: int = 1) -> Estimator:
    if name not in _FACTORIES:
        raise ValueError(f"unknown model {name!r}; known: {sorted(_FACTORIES)}")
    return _FACTORIES[name](dict(params or {}), n_classes, n_features, n_rows)


def _take(params: Mapping, names: Mapping[str, str], defaults: Mapping) -> dict:
    """Rename parameters to Spark's; an unmapped one raises rather than being ignored."""
    unknown = set(params) - set(names)
    if unknown:
        raise ValueError(f"parameters without a counterpart: {sorted(unknown)}")
    return {**defaults, **{names[k]: v for k, v in params.items()}}


# Spark grows trees to this depth at most; a depth of None or below 0 means no limit of one's own.
DEEPEST = 30


def _weighted(params: dict, default: str | None) -> dict:
    """`class_weight` balanced or None; balanced_subsample has the same weights for all trees."""
    kind = params.pop("class_weight", default)
    if kind not in (None, "balanced", "balanced_subsample"):
        raise ValueError(f"unknown class_weight {kind!r}")
    return {"weightCol": WEIGHT} if kind else {}


def _depth(params: dict, name: str = "max_depth") -> dict:
    if name in params and (params[name] is None or params[name] < 0):
        params[name] = DEEPEST
    return params


@register_model("random_forest")
def random_forest(params: Mapping, n_classes: int, n_features: int, n_rows: int) -> Estimator:
    params = _depth({"max_depth": None, **params})
    weights = _weighted(params, "balanced")
    if "max_features" in params:
        params["max_features"] = "all" if params["max_features"] is None else str(params["max_features"])
    names = {"n_estimators": "numTrees", "max_depth": "maxDepth", "min_samples_leaf": "minInstancesPerNode", "max_features": "featureSubsetStrategy", "bootstrap": "bootstrap", "random_state": "seed"}
    args = _take(params, names, {"numTrees": 200, "featureSubsetStrategy": "sqrt", "seed": SEED})
    return RandomForestClassifier(labelCol=LABEL, featuresCol=FEATURES, **weights, **args)


# Settings of the boosting names that say how, not what, to fit.
_INERT = frozenset("objective eval_metric use_label_encoder n_jobs thread_count verbose verbosity silent".split())


def _column_share(value, n_features: int) -> float:
    """sqrt, log2, a number of columns or a share of them."""
    if value is None:
        return 1.0
    if value in ("sqrt", "auto"):
        return math.sqrt(n_features) / n_features
    if value == "log2":
        return max(1.0, math.log2(n_features)) / n_features
    return value / n_features if isinstance(value, int) and value > 1 else float(value)


def _boosted(defaults: Mapping) -> Factory:
    names = {
        "n_estimators": "rounds", "iterations": "rounds", "learning_rate": "rate", "max_depth": "depth", "depth": "depth", "num_leaves": "leaves", "max_leaf_nodes": "leaves", "max_leaves": "leaves",
        "subsample": "rows", "colsample_bytree": "columns", "max_features": "columns", "rsm": "columns", "l2_leaf_reg": "l2", "reg_lambda": "l2", "gamma": "gamma", "min_split_gain": "gamma",
        "min_samples_leaf": "min_rows", "min_child_samples": "min_rows", "min_samples_split": "min_split_rows", "min_child_weight": "min_curvature", "max_bin": "bins", "border_count": "bins",
        "random_state": "seed", "random_seed": "seed",
    }

    def build(params: Mapping, n_classes: int, n_features: int, n_rows: int) -> Estimator:
        params = {k: v for k, v in {**defaults, **params}.items() if k not in _INERT}
        symmetric, weights = params.pop("symmetric", False), _weighted(params, None)
        args = _take(params, names, {"seed": SEED})
        if args.get("depth") is not None and args["depth"] < 0:
            args["depth"] = None
        if not args.get("leaves"):
            args["leaves"] = None
        if args["leaves"] is None and args.get("depth") is None:
            args["depth"] = DEEPEST
        args["columns"] = _column_share(args.get("columns"), n_features)
        return BoostedTrees(BoostSpec(symmetric=symmetric, **args), n_classes, n_features, LABEL, FEATURES, weights.get("weightCol"))

    return build


# Default settings of the boosting names.
register_model("gradient_boosting")(_boosted({"n_estimators": 100, "learning_rate": 0.1, "max_depth": 3, "min_samples_split": 2, "min_samples_leaf": 1, "subsample": 1.0}))
register_model("xgboost")(_boosted({"n_estimators": 100, "learning_rate": 0.1, "max_depth": 6, "subsample": 0.8, "colsample_bytree": 0.8, "reg_lambda": 1.0, "min_child_weight": 1.0}))
register_model("lightgbm")(_boosted({"n_estimators": 100, "learning_rate": 0.1, "num_leaves": 31, "max_depth": -1, "subsample": 0.8, "colsample_bytree": 0.8, "min_child_samples": 20, "min_child_weight": 0.001}))
register_model("catboost")(_boosted({"iterations": 100, "learning_rate": 0.1, "depth": 6, "l2_leaf_reg": 3, "symmetric": True}))


@register_model("logistic_regression")
def logistic_regression(params: Mapping, n_classes: int, n_features: int, n_rows: int) -> Estimator:
    """`C` weighs the sum of all rows' losses against the penalty; Spark takes their mean."""
    params = dict(params)
    weights = _weighted(params, None)
    c, penalty = params.pop("C", 1.0), params.pop("penalty", "l2") or "none"
    strength = 0.0 if penalty == "none" else 1.0 / (c * max(n_rows, 1))
    mixing = {"l2": 0.0, "l1": 1.0, "none": 0.0, "elasticnet": 0.5}[penalty]
    args = _take(params, {"max_iter": "maxIter", "l1_ratio": "elasticNetParam", "tol": "tol"}, {"maxIter": 1000, "elasticNetParam": mixing})
    return LogisticRegression(labelCol=LABEL, featuresCol=FEATURES, regParam=strength, standardization=False, **weights, **args)


@register_model("neural_network")
def neural_network(params: Mapping, n_classes: int, n_features: int, n_rows: int) -> Estimator:
    """Rectified layers with dropout and Adam; `activation` "sigmoid" chooses Spark's network instead.

    There a learning rate needs gradient descent; without one Spark's l-bfgs sets its own steps.
    """
    params = {k: v for k, v in params.items() if k not in _INERT | {"input_dim", "num_classes", "output_activation"}}
    kind, hidden = params.pop("activation", "relu"), tuple(params.pop("hidden_layers", (64, 32)))
    if kind == "relu":
        names = {"dropout_rate": "dropout", "learning_rate": "rate", "epochs": "epochs", "batch_size": "batch", "random_state": "seed"}
        spec = NetworkSpec(hidden, **_take(params, names, {"seed": SEED}))
        return NetworkTrainer(spec, n_classes, n_features, LABEL, FEATURES)
    if kind != "sigmoid":
        raise ValueError(f"unknown activation {kind!r}")
    solver = {"solver": "gd"} if "learning_rate" in params else {}
    args = _take(params, {"epochs": "maxIter", "learning_rate": "stepSize", "random_state": "seed"}, {"maxIter": 100, "seed": SEED})
    return MultilayerPerceptronClassifier(labelCol=LABEL, featuresCol=FEATURES, layers=[n_features, *hidden, n_classes], **solver, **args)


def balanced_weights(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Add n / (k * n_class) per row; one number per class reaches the driver."""
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    n, k = sum(counts.values()), len(counts)
    weight = F.create_map(*[x for c, m in counts.items() for x in (F.lit(c), F.lit(n / (k * m)))])
    return df.withColumn(WEIGHT, F.element_at(weight, F.col(label)))


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=FEATURES).transform(df)


def _sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def class_scores(model: Model, df: DataFrame, n_classes: int) -> DataFrame:
    """Add `__p`, an array with one probability per class.

    A model without scores gives 0 and 1.
    """
    if isinstance(model, BoostedModel | NetworkModel):
        return model.transform(df)
    scored = model.transform(df)
    if "probability" in scored.columns:
        return scored.withColumn("__p", vector_to_array("probability")).drop("probability", "rawPrediction", "prediction")
    flags = [(F.col("prediction") == i).cast("double") for i in range(n_classes)]
    return scored.withColumn("__p", F.array(*flags)).drop("prediction")


@dataclass(frozen=True)
class TrainedModel:
    """A fitted classifier with everything needed to score raw features."""

    name: str
    model: Model
    preprocessor: Preprocessor
    selected: list[str]
    classes: list
    inputs: list[str]

    def score(self, df: DataFrame) -> DataFrame:
        """Add probability_<class>, the decided class and its probability; inputs stay."""
        marked = df.withColumn("__in", F.struct(*[F.col(quoted(c)) for c in df.columns]))
        ready = assemble(self.preprocessor.transform(marked, keep=["__in"]), self.selected)
        scored = class_scores(self.model, ready, len(self.classes))
        taken = [F.col("__in")[c].alias(c) for c in df.columns]
        out = scored.select(*taken, *[F.col("__p")[i].alias(f"probability_{c}") for i, c in enumerate(self.classes)])
        index = evaluation.decide(self.classes)
        return out.withColumns(
            {
                "prediction": F.element_at(F.array(*[F.lit(c) for c in self.classes]), index + 1),
                "confidence": evaluation.confidence(self.classes),
            }
        )

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        self.model.write().overwrite().save(f"{path}/model")
        meta = {"name": self.name, "preprocessor": self.preprocessor.to_json(), "selected": self.selected, "classes": self.classes, "inputs": self.inputs}
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @staticmethod
    def load(path: str) -> TrainedModel:
        spark = SparkSession.getActiveSession()
        meta = json.loads(spark.read.text(f"{path}/meta").collect()[0][0])
        model = DefaultParamsReader.loadParamsInstance(f"{path}/model", spark)
        return TrainedModel(meta["name"], model, Preprocessor.from_json(meta["preprocessor"]), meta["selected"], meta["classes"], meta["inputs"])


@dataclass(frozen=True)
class TrainSpec:
    model: str = "random_forest"
    params: Mapping = field(default_factory=dict)
    scaling: str | None = "standard"
    selection: str | None = None
    n_features: int | None = 30
    top_after: int | None = None
    tuning: str | None = None
    search: Mapping = field(default_factory=dict)
    n_iter: int = 20
    folds: int = 5
    test_size: float = 0.2


def fit_model(df: DataFrame, label: str, features: Sequence[str], spec: TrainSpec = TrainSpec()) -> TrainedModel:
    """Select, preprocess, optionally tune, and fit on all given rows."""
    df = once(df.select(label, *[quoted(c) for c in features]).filter(F.col(label).isNotNull()))
    inputs = list(features)
    if spec.selection:
        inputs = select_features(df, label, spec.selection, spec.n_features, columns=inputs)
    prep = Preprocessor.fit(df.select(label, *[quoted(c) for c in inputs]), scaling=spec.scaling, exclude=[label])
    labeled, classes = indexed_label(prep.transform(df, keep=[label]), label, LABEL)
    selected = prep.outputs
    if spec.top_after:
        # A first model of the same kind ranks the prepared features.
        probe = assemble(balanced_weights(labeled), selected)
        found = _own_importances(create_model(spec.model, spec.params, len(classes), len(selected), probe.count()).fit(probe))
        if found is None:
            raise ValueError(f"{spec.model} has no importances to choose features by")
        ranked = sorted(zip(selected, found), key=lambda kv: (-kv[1], kv[0]))
        selected = [c for c, _ in ranked[: spec.top_after]]
    ready = cut(assemble(balanced_weights(labeled), selected).select(LABEL, WEIGHT, FEATURES))
    n = ready.count()
    params = dict(spec.params)
    if spec.tuning:
        params.update(tune(ready, spec.model, spec.search, spec.tuning, len(classes), len(selected), spec.n_iter, spec.folds, spec.params)[0])
    model = create_model(spec.model, params, len(classes), len(selected), n).fit(ready)
    return TrainedModel(spec.model, model, prep, selected, classes, inputs)


def train(df: DataFrame, label: str, features: Sequence[str], spec: TrainSpec = TrainSpec(), keys: Sequence[str] = KEYS) -> tuple[TrainedModel, DataFrame]:
    """Fit on the early rows of each key; report on both parts (column `part`)."""
    early, late = chronological_split(df, spec.test_size, keys)
    trained = fit_model(early, label, features, spec)
    return trained, model_report(trained, early, late, label)


def model_report(trained: TrainedModel, early: DataFrame, late: DataFrame, label: str, top: int | None = 20) -> DataFrame:
    """Train and test figures under each other, one row per metric, then the `top` importances (None: all)."""
    parts = None
    for name, df in (("train", early), ("test", late)):
        wide = evaluation.evaluate(trained.score(df), trained.classes, label, "prediction")
        cells = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in wide.columns]
        tall = wide.select(F.lit(name).alias("part"), F.explode(F.array(*cells)).alias("m")).select("part", "m.*")
        parts = tall if parts is None else parts.unionByName(tall)
    if importances(trained) is None:
        return parts
    ranked = built_in_importance(trained)
    ranked = ranked if top is None else ranked.limit(top)
    return parts.unionByName(ranked.select(F.lit("importance").alias("part"), F.col("feature").alias("metric"), F.col("importance").alias("value")))


# Grids searched when none is given; settings without a counterpart in Spark are left out.
DEFAULT_GRIDS: dict[str, dict[str, list]] = {
    "random_forest": {
        "n_estimators": [100, 200, 500],
        "max_depth": [None, 10, 20, 30],
        "min_samples_leaf": [1, 2, 4],
        "max_features": ["sqrt", "log2", None],
        "class_weight": ["balanced", None],
    },
    "xgboost": {
        "n_estimators": [100, 200, 500],
        "learning_rate": [0.01, 0.05, 0.1, 0.2],
        "max_depth": [3, 5, 7, 9],
        "subsample": [0.8, 0.9, 1.0],
        "colsample_bytree": [0.8, 0.9, 1.0],
        "gamma": [0, 0.1, 0.2],
    },
    "lightgbm": {
        "n_estimators": [100, 200, 500],
        "learning_rate": [0.01, 0.05, 0.1, 0.2],
        "num_leaves": [31, 63, 127],
        "max_depth": [-1, 5, 10, 15],
        "subsample": [0.8, 0.9, 1.0],
        "colsample_bytree": [0.8, 0.9, 1.0],
    },
    "catboost": {"iterations": [100, 200, 500], "learning_rate": [0.01, 0.05, 0.1, 0.2], "depth": [4, 6, 8, 10]},
    "logistic_regression": {"C": [0.01, 0.1, 1.0, 10.0]},
}
DEFAULT_GRIDS["gradient_boosting"] = {k: v for k, v in DEFAULT_GRIDS["xgboost"].items() if k in ("n_estimators", "learning_rate", "max_depth", "subsample")}


def search_points(space: Mapping, method: str, n_iter: int = 20, seed: int = SEED) -> list[dict]:
    """Parameter sets to try.

    Grid: every combination of the listed values. Otherwise draws from lists or
    from ``[type, low, high, step or "log"]`` with type int, float or categorical.
    """
    if method == "grid":
        names = sorted(space)
        return [dict(zip(names, values)) for values in product(*[space[n] for n in names])]
    rng = random.Random(seed)
    return [{n: _draw(list(space[n]), rng) for n in sorted(space)} for _ in range(n_iter)]


def _draw(entry: list, rng: random.Random):
    kind = entry[0]
    if kind == "categorical":
        return rng.choice(entry[1])
    if kind not in ("int", "float"):
        return rng.choice(entry)
    low, high, extra = entry[1], entry[2], entry[3] if len(entry) > 3 else None
    if extra == "log":
        value = math.exp(rng.uniform(math.log(low), math.log(high)))
    elif extra:
        value = low + extra * rng.randint(0, int((high - low) / extra))
    else:
        value = rng.uniform(low, high)
    return int(round(value)) if kind == "int" else value


def _density(entry: list, seen: list, value) -> float:
    """How likely `value` is among the values seen, smoothed by the whole range."""
    if entry[0] not in ("int", "float"):
        choices = entry[1] if entry[0] == "categorical" else entry
        return (1 + sum(v == value for v in seen)) / (len(choices) + len(seen))
    scale = math.log if len(entry) > 3 and entry[3] == "log" else float
    low, high = scale(entry[1]), scale(entry[2])
    width = max((high - low) / max(1, len(seen)) ** 0.5, 1e-12)
    kernel = sum(math.exp(-0.5 * ((scale(value) - scale(v)) / width) ** 2) for v in seen) / (width * 2.5066)
    return (1 / max(high - low, 1e-12) + kernel) / (1 + len(seen))


def next_point(space: Mapping, results: Sequence[tuple[dict, float]], rng: random.Random, candidates: int = 24) -> dict:
    """The drawn point that is most like the best quarter of earlier points and least like the rest.

    Values are drawn near those of good points half of the time, else from the whole space.
    """
    ranked = sorted(results, key=lambda r: -r[1])
    good, rest = ranked[: max(1, len(ranked) // 4)], ranked[max(1, len(ranked) // 4) :]

    def near(name: str):
        entry, value = list(space[name]), rng.choice(good)[0][name]
        if entry[0] not in ("int", "float") or rng.random() < 0.5:
            return value if rng.random() < 0.5 else _draw(entry, rng)
        log = len(entry) > 3 and entry[3] == "log"
        low, high = (math.log(entry[1]), math.log(entry[2])) if log else (entry[1], entry[2])
        x = min(high, max(low, rng.gauss(math.log(value) if log else value, (high - low) / 8)))
        x = min(entry[2], max(entry[1], math.exp(x))) if log else x
        if not log and len(entry) > 3 and entry[3]:
            x = entry[1] + entry[3] * round((x - entry[1]) / entry[3])
        return int(round(x)) if entry[0] == "int" else x

    def gain(point: dict) -> float:
        return sum(math.log(_density(list(space[n]), [p[n] for p, _ in good], v) / _density(list(space[n]), [p[n] for p, _ in rest], v)) for n, v in point.items())

    return max(({n: near(n) for n in sorted(space)} for _ in range(candidates)), key=gain)


def tune(
    ready: DataFrame,
    name: str,
    space: Mapping,
    method: str,
    n_classes: int,
    n_features: int,
    n_iter: int = 20,
    folds: int = 5,
    fixed: Mapping | None = None,
    parallel: int = 5,
) -> tuple[dict, list[tuple[dict, float]]]:
    """Best parameters by cross-validated weighted F1 (grid, random or bayesian).

    A row's fold follows from its values, so it does not depend on partitions. Grid
    and random points of boosted trees and of logistic regressions are fitted all at once, over
    all folds; of others, `parallel` fits (one point and fold each) run at a time. The bayesian search chooses
    each point from the results of the earlier ones; only its first points and the folds of a point run side by side.
    """
    if method not in ("grid", "random", "bayesian"):
        raise ValueError(f"unknown tuning method {method!r}")
    if method == "grid":
        space = space or DEFAULT_GRIDS.get(name, {})
    fold_of = F.pmod(F.xxhash64(F.lit(SEED), LABEL, vector_to_array(FEATURES)), F.lit(folds))
    folded = cut(ready.withColumn("__fold", fold_of))
    sizes = {r["__fold"]: r["count"] for r in folded.groupBy("__fold").count().collect()}
    rows = sum(sizes.values())

    def counted(job: tuple[int, int, dict]) -> list[tuple]:
        """How often each label got each answer in one fold of one point."""
        number, fold, point = job
        estimator = create_model(name, {**(fixed or {}), **point}, n_classes, n_features, rows - sizes[fold])
        model = estimator.fit(folded.filter(F.col("__fold") != fold))
        scored = class_scores(model, folded.filter(F.col("__fold") == fold), n_classes)
        best = (F.array_position("__p", F.array_max("__p")) - 1).cast("double")
        pairs = scored.groupBy(F.col(LABEL).alias("label"), best.alias("guess")).count().collect()
        return [(number, fold, r["label"], r["guess"], r["count"]) for r in pairs]

    def scores(points: Sequence[dict]) -> list[float]:
        """Figures of points, a point that comes again counted once; fits of all points and folds share the threads."""
        distinct = [p for i, p in enumerate(points) if p not in points[:i]]
        jobs = [(i, fold, p) for i, p in enumerate(distinct) for fold in sorted(sizes)]
        with ThreadPool(parallel) as pool:
            cells = [c for part in pool.map(counted, jobs, chunksize=1) for c in part]
        found = _weighted_f1(cells, len(distinct))
        return [found[distinct.index(p)] for p in points]

    points = search_points(space, method, n_iter) if method != "bayesian" else []
    if points and isinstance(create_model(name, {**(fixed or {}), **points[0]}, n_classes, n_features, rows), BoostedTrees):
        makers = [create_model(name, {**(fixed or {}), **p}, n_classes, n_features, rows) for p in points]
        results = list(zip(points, _weighted_f1(_cells(cross_validated(folded, makers, "__fold", sorted(sizes))), len(points)), strict=True))
    elif points and name == "logistic_regression" and all(_ridge({**(fixed or {}), **p}) for p in points):
        cs = [None if {**(fixed or {}), **p}.get("penalty", "l2") in ("none", None) else {**(fixed or {}), **p}.get("C", 1.0) for p in points]
        pairs = logistic.cross_validated(folded, cs, n_classes, n_features, LABEL, FEATURES, "__fold", sorted(sizes))
        results = list(zip(points, _weighted_f1(_cells(pairs), len(points)), strict=True))
    elif points:
        results = list(zip(points, scores(points), strict=True))
    else:
        start = search_points(space, method, min(n_iter, max(2, n_iter // 4)))
        results, rng = list(zip(start, scores(start), strict=True)), random.Random(SEED + 1)
        while len(results) < n_iter:
            point = next_point(space, results, rng)
            known = [value for earlier, value in results if earlier == point]
            results.append((point, known[0] if known else scores([point])[0]))
    return max(results, key=lambda r: r[1])[0], results


def _ridge(params: Mapping) -> bool:
    """Whether a logistic regression has nothing but a squared penalty, or none."""
    return set(params) <= {"C", "penalty", "max_iter", "tol"} and params.get("penalty", "l2") in ("l2", "none", None)


def _cells(counted: DataFrame) -> list[tuple]:
    return [(r["number"], r["fold"], r["label"], r["guess"], r["n"]) for r in counted.collect()]


def _weighted_f1(counted: Sequence[tuple], n_points: int) -> list[float]:
    """The mean over folds of each point's F1, weighted by class sizes; counts by (number, fold, label, guess).

    Sums go in a fixed order, so that equal counts give equal figures.
    """
    by: dict[int, dict[int, dict]] = {}
    for number, fold, label, guess, n in counted:
        by.setdefault(number, {}).setdefault(fold, {})[label, guess] = n
    out = [0.0] * n_points
    for number, folds in by.items():
        for _, cells in sorted(folds.items()):
            weighted = 0.0
            for c in sorted({y for y, _ in cells}):
                real, said = (sum(n for pair, n in cells.items() if pair[side] == c) for side in (0, 1))
                weighted += real * 2 * cells.get((c, c), 0) / (real + said)
            out[number] += weighted / sum(cells.values())
        out[number] /= len(folds)
    return out


def score_table(trained: TrainedModel, df: DataFrame, on: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    scored = trained.score(df)
    return scored.select(*on, *[quoted(f"probability_{c}") for c in trained.classes])


def vote(members: Mapping[str, TrainedModel], df: DataFrame, kind: str = "soft", weights: Mapping[str, float] | None = None, on: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    """Ensemble of models: mean probabilities (soft) or the most frequent decision (hard)."""
    if kind not in ("soft", "hard"):
        raise ValueError(f"unknown vote {kind!r}")
    classes = next(iter(members.values())).classes
    out, shares = df, {n: float((weights or {}).get(n, 1.0)) for n in members}
    # All members score the same rows, one after the other in one narrow pass.
    for i, m in enumerate(members.values()):
        scored = m.score(out)
        own = [F.col(quoted(f"probability_{c}")).alias(f"__p{i}_{k}") for k, c in enumerate(classes)] if kind == "soft" else [F.col("prediction").alias(f"__v{i}")]
        out = scored.select(*[quoted(c) for c in out.columns], *own)
    if kind == "soft":
        total = sum(shares.values())
        means = [sum(F.col(f"__p{i}_{k}") * (w / total) for i, w in enumerate(shares.values())).alias(f"probability_{c}") for k, c in enumerate(classes)]
        return out.select(*on, *means)
    votes = F.array(*[F.col(f"__v{i}") for i in range(len(members))])
    ranked = F.array_sort(F.transform(F.array_distinct(votes), lambda v: F.struct((-F.size(F.filter(votes, lambda x: x == v))).alias("n"), v.alias("v"))))
    return out.select(*on, F.get(ranked, F.lit(0))["v"].alias("prediction"))


@dataclass(frozen=True)
class Calibration:
    """Per class a monotone map (isotonic) or a logistic curve (sigmoid)."""

    classes: list
    method: str
    maps: list

    def apply(self, df: DataFrame) -> DataFrame:
        out = df
        for c, m in zip(self.classes, self.maps):
            p = F.col(quoted(f"probability_{c}"))
            if self.method == "sigmoid":
                out = out.withColumn(f"__c_{c}", _sigmoid(F.lit(m[0]) * p + F.lit(m[1])))
            else:
                # Linear between the fitted points, found by binary search, constant outside.
                curve = m.copy({}).setFeaturesCol("__x").setPredictionCol(f"__c_{c}")
                out = curve.transform(out.withColumn("__x", p)).drop("__x")
        total = sum(F.col(quoted(f"__c_{c}")) for c in self.classes)
        even = F.lit(1.0 / len(self.classes))
        fixed = {f"probability_{c}": F.coalesce(F.try_divide(F.col(quoted(f"__c_{c}")), total), even) for c in self.classes}
        return out.withColumns(fixed).drop(*[f"__c_{c}" for c in self.classes])


def calibrate(df: DataFrame, classes: Sequence, label: str = "y", method: str = "isotonic", digits: int | None = None) -> Calibration:
    """Fit on held-out scores, one curve per class against the rest.

    The isotonic fit sees each distinct score once, with its weight. `digits` rounds
    scores before that, where a bound on what it sees is worth the loss; default none.
    """
    maps = []
    for c in classes:
        p, hit = F.col(quoted(f"probability_{c}")), (F.col(label).cast("string") == str(c)).cast("double")
        if method == "sigmoid":
            fitted = LogisticRegression(featuresCol="__x", labelCol="__y", maxIter=1000, tol=1e-12).fit(
                VectorAssembler(inputCols=["__p"], outputCol="__x").transform(df.select(p.alias("__p"), hit.alias("__y")))
            )
            maps.append((float(fitted.coefficients[0]), float(fitted.intercept)))
        elif method == "isotonic":
            cell = p if digits is None else F.round(p, digits)
            counted = df.groupBy(cell.alias("__p")).agg(F.avg(hit).alias("__y"), F.count(F.lit(1)).cast("double").alias("__w"))
            fitted = IsotonicRegression(featuresCol="__p", labelCol="__y", weightCol="__w").fit(counted)
            maps.append(fitted)
        else:
            raise ValueError(f"unknown calibration method {method!r}")
    return Calibration(list(classes), method, maps)


def _own_importances(model: Model) -> list[float] | None:
    if hasattr(model, "featureImportances"):
        return [float(v) for v in model.featureImportances.toArray()]
    if hasattr(model, "coefficientMatrix"):
        return [abs(float(v)) for v in model.coefficientMatrix.toArray()[0]]
    return None


def importances(trained: TrainedModel) -> list[float] | None:
    """Tree importances, or sizes of the first class's coefficients."""
    return _own_importances(trained.model)


def built_in_importance(trained: TrainedModel, df: DataFrame | None = None, label: str | None = None, ident: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    """The model's own importances, largest first.

    A model that has none is judged by `permutation_importance` on the rows given.
    """
    values = importances(trained)
    if values is None:
        if df is None or label is None:
            raise ValueError(f"{trained.name} has no built-in importance; give labelled rows to exchange values in")
        found = permutation_importance(trained, df, label, ident)
        return found.select("feature", F.col("importance_mean").alias("importance")).orderBy(F.desc("importance"), "feature")
    rows = list(zip(trained.selected, values))
    return SparkSession.getActiveSession().createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def permutation_importance(
    trained: TrainedModel,
    df: DataFrame,
    label: str,
    ident: Sequence[str],
    features: Sequence[str] | None = None,
    repeats: int = 5,
    group_rows: int = 4096,
    seed: int = SEED,
) -> DataFrame:
    """Fall in accuracy when one feature's values are dealt to other rows: mean and deviation.

    Rows are thrown into random groups of about `group_rows`; inside a group
    each row takes the value of the next one in a random order. Every row
    appears once per feature and repeat with that one value exchanged.
    """
    columns = list(features or trained.inputs)
    stored = once(df.select(*ident, label, *[quoted(c) for c in trained.inputs if c not in ident and c != label]))
    groups = max(1, math.ceil(stored.count() / group_rows))
    base = trained.score(stored).agg(F.avg((F.col("prediction") == F.col(label)).cast("int"))).collect()[0][0]
    rounds = stored.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    rounds = rounds.withColumn("__g", F.pmod(F.xxhash64(F.lit(seed), "repeat", *ident), F.lit(groups)))
    w = Window.partitionBy("repeat", "__g").orderBy(F.xxhash64(F.lit(seed + 1), "repeat", *ident), *ident)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    dealt = rounds.withColumns({f"__n_{c}": F.coalesce(F.lead(quoted(c)).over(w), F.first(quoted(c)).over(whole)) for c in columns})
    each = dealt.withColumn("feature", F.explode(F.array(*[F.lit(c) for c in columns])))
    swapped = each.withColumns({c: F.when(F.col("feature") == c, F.col(quoted(f"__n_{c}"))).otherwise(F.col(quoted(c))) for c in columns})
    scored = trained.score(swapped.drop("__g", *[f"__n_{c}" for c in columns]))
    per_round = scored.groupBy("feature", "repeat").agg(F.avg((F.col("prediction") == F.col(label)).cast("int")).alias("hit"))
    drops = per_round.withColumn("drop", F.lit(base) - F.col("hit"))
    return drops.groupBy("feature").agg(F.avg("drop").alias("importance_mean"), F.stddev_pop("drop").alias("importance_std"))
