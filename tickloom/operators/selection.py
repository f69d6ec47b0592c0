"""Splitting, preprocessing and choosing features.

Everything learned is a handful of numbers per feature, computed by merged
aggregates and applied as column expressions.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.columns import numeric_columns, quoted, require
from tickloom.plans.series import KEYS, N_ROWS, RN, index_series, quantiles
from tickloom.plans.storage import once

SEED = 42


def chronological_split(df: DataFrame, test_size: float = 0.2, keys: Sequence[str] = KEYS) -> tuple[DataFrame, DataFrame]:
    """First rows of each key for training, the last `test_size` share for testing."""
    indexed = df if RN in df.columns else index_series(df, keys)
    cut_at = F.floor(F.col(N_ROWS) * (1 - test_size))
    return indexed.filter(F.col(RN) < cut_at), indexed.filter(F.col(RN) >= cut_at)


def stratified_split(
    df: DataFrame, label: str, ident: Sequence[str], test_size: float = 0.2, seed: int = SEED
) -> tuple[DataFrame, DataFrame]:
    """The same share of each class by a hash (MD5) of the row's identity, stable across runs and engines."""
    identity = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in (label, *ident)])
    share = F.conv(F.substring(F.md5(identity.cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    test = share < test_size
    return df.filter(~test), df.filter(test)


def complete_numeric(df: DataFrame, label: str, columns: Sequence[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Numeric features and the label, only rows without NULL."""
    chosen = list(columns or numeric_columns(df, {label, RN, N_ROWS}))
    return df.select(label, *[F.col(quoted(c)).cast("double").alias(c) for c in chosen]).na.drop(), chosen


def _assembled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol="features").transform(df)


def indexed_label(df: DataFrame, label: str, out: str = "label") -> tuple[DataFrame, list]:
    """Class labels as 0, 1, … in sorted order; the list of classes is as long as there are classes."""
    classes = sorted(r[0] for r in df.select(label).distinct().collect() if r[0] is not None)
    pairs = [x for i, c in enumerate(classes) for x in (F.lit(c), F.lit(float(i)))]
    return df.withColumn(out, F.try_element_at(F.create_map(*pairs), F.col(label))), classes


def forest_importances(
    df: DataFrame, columns: Sequence[str], label: str = "label", trees: int = 100, depth: int = 10
) -> list[tuple[str, float]]:
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED, labelCol=label).fit(_assembled(df, columns))
    scores = model.featureImportances.toArray()
    return sorted(zip(columns, map(float, scores)), key=lambda kv: (-kv[1], kv[0]))


def mutual_information(df: DataFrame, columns: Sequence[str], label: str, bins: int = 10) -> DataFrame:
    """Information each feature's quantile bin holds about the class, in nats.

    Bin counts are one aggregate over (feature, bin, class).
    """
    df = once(df.select(label, *[F.col(quoted(c)).cast("double").alias(c) for c in columns]))
    probs = {f"{c}__{i}": (c, i / bins) for c in columns for i in range(1, bins)}
    # One row: bins - 1 edges per feature.
    edges = quantiles(df, probs, keys=())
    row = edges.collect()[0]
    cells = [
        F.struct(
            F.lit(c).alias("feature"),
            sum((F.col(c) > F.lit(row[f"{c}__{i}"])).cast("int") for i in range(1, bins)).alias("bin"),
        )
        for c in columns
    ]
    long = df.select(F.col(label).alias("y"), F.explode(F.array(*cells)).alias("e")).select("y", "e.*").na.drop()
    joint = once(long.groupBy("feature", "bin", "y").agg(F.count(F.lit(1)).alias("n")))
    by_bin = joint.groupBy("feature", "bin").agg(F.sum("n").alias("nb"))
    by_class = joint.groupBy("feature", "y").agg(F.sum("n").alias("ny"))
    total = joint.groupBy("feature").agg(F.sum("n").alias("nt"))
    every = joint.join(by_bin, ["feature", "bin"]).join(by_class, ["feature", "y"]).join(total, "feature")
    p = F.col("n") / F.col("nt")
    term = p * F.ln(F.col("n") * F.col("nt") / (F.col("nb") * F.col("ny")))
    return every.groupBy("feature").agg(F.sum(term).alias("mutual_information"))


def recursive_elimination(df: DataFrame, columns: Sequence[str], label: str, keep: int, step: int = 1) -> list[str]:
    """Drop the features with the smallest squared coefficients until `keep` remain."""
    left = list(columns)
    stored = once(df)
    while len(left) > keep:
        model = LogisticRegression(maxIter=100, regParam=0.0, standardization=True, labelCol=label).fit(_assembled(stored, left))
        weight = (model.coefficientMatrix.toArray() ** 2).sum(axis=0)
        drop = sorted(range(len(left)), key=lambda i: (weight[i], left[i]))[: min(step, len(left) - keep)]
        left = [c for i, c in enumerate(left) if i not in drop]
    return left


def principal_components(df: DataFrame, columns: Sequence[str], n: int, keep: Sequence[str] = ()) -> DataFrame:
    """Standardised features projected on their first n components, PC1, PC2, …"""
    ready = Preprocessor.fit(df, numeric=columns, scaling="standard").transform(df)
    vector = _assembled(ready, columns)
    projected = PCA(k=n, inputCol="features", outputCol="__pc").fit(vector).transform(vector)
    arr = vector_to_array("__pc")
    return projected.select(*keep, *[arr[i].alias(f"PC{i + 1}") for i in range(n)])


def select_features(
    df: DataFrame,
    label: str,
    method: str = "importance",
    n_features: int | None = 30,
    threshold: float | None = None,
    step: int = 1,
    columns: Sequence[str] | None = None,
) -> list[str]:
    """Names of the chosen features: importance, mutual_info, rfe or model.

    At most `n_features` of them; None sets no bound. A threshold chooses on its
    own: it keeps every feature that reaches it.
    """
    clean, candidates = complete_numeric(df, label, columns)
    n = len(candidates) if n_features is None else min(n_features, len(candidates))
    if method == "mutual_info":
        ranked = mutual_information(clean, candidates, label).orderBy(F.desc("mutual_information"), "feature").limit(n)
        return [r["feature"] for r in ranked.collect()]
    ready, _ = indexed_label(clean, label, "__y")
    if method == "rfe":
        return recursive_elimination(ready, candidates, "__y", n, step)
    if method == "importance":
        ranked = forest_importances(ready, candidates, "__y")
        if threshold is not None:
            return [c for c, s in ranked if s >= threshold]
        return [c for c, _ in ranked[:n]]
    if method == "model":
        ranked = forest_importances(ready, candidates, "__y", depth=5)
        scores = sorted(s for _, s in ranked)
        middle = (scores[(len(scores) - 1) // 2] + scores[len(scores) // 2]) / 2
        least = middle if threshold is None else threshold
        kept = [c for c, s in ranked if s >= least]
        return kept if threshold is not None else kept[:n]
    raise ValueError(f"unknown selection method {method!r}")


_SCALINGS = {"standard": "standard", "standardscaler": "standard", "minmax": "minmax", "minmaxscaler": "minmax", "robust": "robust", "robustscaler": "robust"}


@dataclass(frozen=True)
class Preprocessor:
    """Median imputation and scaling of numbers, one-hot coding of text."""

    numeric: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    medians: dict[str, float] = field(default_factory=dict)
    centers: dict[str, float] = field(default_factory=dict)
    scales: dict[str, float] = field(default_factory=dict)
    modes: dict[str, str] = field(default_factory=dict)
    levels: dict[str, list[str]] = field(default_factory=dict)

    @staticmethod
    def fit(
        df: DataFrame,
        categorical: Sequence[str] | None = None,
        numeric: Sequence[str] | None = None,
        scaling: str | None = "standard",
        handle_missing: bool = True,
        exclude: Sequence[str] = (),
    ) -> Preprocessor:
        """Learn from the training rows; columns are typed by the schema unless given."""
        if scaling not in (None, "none") and scaling.lower() not in _SCALINGS:
            raise ValueError(f"unknown scaling {scaling!r}")
        scaling = None if scaling in (None, "none") else _SCALINGS[scaling.lower()]
        numeric = list(numeric if numeric is not None else numeric_columns(df, {*exclude, RN, N_ROWS}))
        if categorical is None:
            categorical = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in exclude]
        stored = once(df.select(*[quoted(c) for c in (*numeric, *categorical)]))
        medians: dict[str, float] = {}
        if numeric and handle_missing:
            row = quantiles(stored, {c: (c, 0.5) for c in numeric}, keys=()).collect()[0]
            medians = {c: float(row[c] or 0.0) for c in numeric}
        filled = stored.fillna(medians)
        centers, scales = {c: 0.0 for c in numeric}, {c: 1.0 for c in numeric}
        if numeric and scaling:
            centers, scales = _scaling(filled, numeric, scaling)
        modes, levels = {}, {}
        if categorical:
            cells = [F.struct(F.lit(c).alias("c"), F.col(quoted(c)).alias("v")) for c in categorical]
            counts = stored.select(F.explode(F.array(*cells)).alias("e")).select("e.*").filter("v IS NOT NULL").groupBy("c", "v").count()
            # Each level becomes a column of the result, so their names are metadata.
            found = counts.collect()
            for c in categorical:
                seen = sorted((-r["count"], r["v"]) for r in found if r["c"] == c)
                levels[c] = sorted(v for _, v in seen)
                if seen:
                    modes[c] = seen[0][1]
        return Preprocessor(numeric, list(categorical), medians, centers, scales, modes if handle_missing else {}, levels)

    @property
    def outputs(self) -> list[str]:
        return [*self.numeric, *[f"{c}_{v}" for c in self.categorical for v in self.levels[c]]]

    def transform(self, df: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
        """Prepared columns next to `keep` (default: every other column). Unknown levels give all zeros."""
        missing = [c for c in (*self.numeric, *self.categorical) if c not in df.columns]
        if len(missing) == len(self.numeric) + len(self.categorical):
            raise ValueError("none of the features is present")
        require(df, *self.numeric, *self.categorical)
        kept = list(keep) if keep is not None else [c for c in df.columns if c not in {*self.numeric, *self.categorical}]
        numbers = []
        for c in self.numeric:
            x = F.col(quoted(c)).cast("double")
            x = F.coalesce(x, F.lit(self.medians[c])) if c in self.medians else x
            numbers.append(((x - self.centers[c]) / self.scales[c]).alias(c))
        flags = []
        for c in self.categorical:
            x = F.coalesce(F.col(quoted(c)), F.lit(self.modes[c])) if c in self.modes else F.col(quoted(c))
            flags += [F.coalesce((x == v).cast("double"), F.lit(0.0)).alias(f"{c}_{v}") for v in self.levels[c]]
        return df.select(*[quoted(k) for k in kept], *numbers, *flags)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Preprocessor:
        return Preprocessor(**json.loads(text))


def _scaling(df: DataFrame, columns: Sequence[str], scaling: str) -> tuple[dict[str, float], dict[str, float]]:
    if scaling == "robust":
        probs = {f"{c}__{n}": (c, p) for c in columns for n, p in (("lo", 0.25), ("mid", 0.5), ("hi", 0.75))}
        row = quantiles(df, probs, keys=()).collect()[0]
        center = {c: row[f"{c}__mid"] for c in columns}
        scale = {c: row[f"{c}__hi"] - row[f"{c}__lo"] for c in columns}
    else:
        pairs: list[Column] = []
        for c in columns:
            x = F.col(quoted(c))
            mid, width = (F.avg(x), F.stddev_pop(x)) if scaling == "standard" else (F.min(x), F.max(x) - F.min(x))
            pairs += [mid.alias(f"{c}__mid"), width.alias(f"{c}__width")]
        row = df.agg(*pairs).collect()[0]
        center = {c: row[f"{c}__mid"] for c in columns}
        scale = {c: row[f"{c}__width"] for c in columns}
    # A constant column is only centred.
    return {c: float(v or 0.0) for c, v in center.items()}, {c: float(v) if v and not math.isnan(v) else 1.0 for c, v in scale.items()}
