"""Dense networks with rectified layers and dropout, trained in parallel with averaged weights.

An epoch is one job. Every task walks its own rows in small batches, with Adam's steps, from the
weights the epoch starts with; the driver averages the tasks' weights and moments by their numbers
of rows. What travels is a network per task, whatever the number of rows. Row orders and
dropped units follow from seed, epoch and task, so a task that runs again ends as it did.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.plans.storage import cut

PART_ROWS = 1 << 16


@dataclass(frozen=True)
class NetworkSpec:
    hidden: tuple[int, ...] = (64, 32)
    dropout: float = 0.2
    rate: float = 0.001
    epochs: int = 100
    batch: int = 32
    seed: int = 42

    def __post_init__(self) -> None:
        if not 0 <= self.dropout < 1 or min(self.hidden, default=1) < 1:
            raise ValueError("dropout must be from 0 to below 1 and layers at least one unit wide")


class Network:
    """Weights as one flat array; layers are views into it."""

    def __init__(self, sizes: Sequence[int], flat: np.ndarray | None = None, seed: int = 0):
        self.sizes = list(sizes)
        self.shapes = [(a, b) for a, b in zip(sizes, sizes[1:], strict=False)]
        n = sum(a * b + b for a, b in self.shapes)
        if flat is None:
            rng = np.random.default_rng(seed)
            # Uniform within the root of six over the widths on both sides; no offsets at first.
            flat = np.concatenate([np.append(rng.uniform(-1, 1, a * b) * np.sqrt(6 / (a + b)), np.zeros(b)) for a, b in self.shapes])
        assert len(flat) == n
        self.flat = flat

    def layers(self, flat: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        at = 0
        for a, b in self.shapes:
            yield flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]
            at += a * b + b

    def forward(self, x: np.ndarray, masks: Sequence[np.ndarray] = ()) -> tuple[np.ndarray, list[np.ndarray]]:
        """Probabilities, and what went into each layer. A mask scales a hidden layer's units."""
        inputs, layers = [x], list(self.layers(self.flat))
        for i, (w, b) in enumerate(layers[:-1]):
            x = np.maximum(x @ w + b, 0)
            x = x * masks[i] if len(masks) else x
            inputs.append(x)
        w, b = layers[-1]
        m = x @ w + b
        e = np.exp(m - m.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True), inputs

    def gradient(self, x: np.ndarray, y: np.ndarray, masks: Sequence[np.ndarray] = ()) -> np.ndarray:
        """Of the mean log loss."""
        p, inputs = self.forward(x, masks)
        back = p.copy()
        back[np.arange(len(y)), y] -= 1
        back /= len(y)
        parts = []
        for i, (w, _) in reversed(list(enumerate(self.layers(self.flat)))):
            parts.append(np.concatenate([(inputs[i].T @ back).ravel(), back.sum(axis=0)]))
            if i:
                back = back @ w.T
                if len(masks):
                    back = back * masks[i - 1]
                back = back * (inputs[i] > 0)
        return np.concatenate(parts[::-1])


def _epoch(net: Network, moments: np.ndarray, step: int, x: np.ndarray, y: np.ndarray, spec: NetworkSpec, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """One walk over the rows in a drawn order; returns the moments and the number of steps."""
    order = rng.permutation(len(y))
    for first in range(0, len(y), spec.batch):
        rows = order[first : first + spec.batch]
        keep = 1 - spec.dropout
        masks = [(rng.random((len(rows), n)) < keep) / keep for n in net.sizes[1:-1]] if spec.dropout else []
        g = net.gradient(x[rows], y[rows], masks)
        step += 1
        moments[0] = 0.9 * moments[0] + 0.1 * g
        moments[1] = 0.999 * moments[1] + 0.001 * g * g
        net.flat = net.flat - spec.rate * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.999**step)) + 1e-7)
    return moments, step


def fit_network(df: DataFrame, n_classes: int, n_features: int, spec: NetworkSpec, label: str, features: str) -> Network:
    """`features` is an array column, `label` counts from 0."""
    n_parts = max(1, -(-df.count() // PART_ROWS))
    rows = df.select(F.col(label).cast("int").alias("label"), F.col(features).alias("x"), F.xxhash64(features, label).alias("h"))
    # Rows in a fixed order, dealt by hash: tasks hold about as many each, of every kind.
    table = cut(rows.repartition(n_parts, "h").sortWithinPartitions("h").withColumn("part", F.spark_partition_id()).drop("h"))
    net = Network([n_features, *spec.hidden, n_classes], seed=spec.seed)
    moments, step = np.zeros((2, len(net.flat))), 0
    def walked(flat: np.ndarray, moments: np.ndarray, step: int, epoch: int) -> list:
        """The tasks' weights and moments after an epoch."""

        def walk(rows: pa.Table) -> pa.Table:
            part = rows["part"][0].as_py()
            x = rows["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(rows.num_rows, n_features)
            own = Network(net.sizes, flat)
            after, steps = _epoch(own, moments.copy(), step, x, rows["label"].to_numpy(), spec, np.random.default_rng([spec.seed, epoch, part]))
            sent = np.concatenate([own.flat, *after]).tobytes()
            return pa.table({"part": pa.array([part], pa.int32()), "n": pa.array([rows.num_rows], pa.int64()), "steps": pa.array([steps], pa.int64()), "sent": pa.array([sent], pa.binary())})

        found = table.groupBy("part").applyInArrow(walk, "part int, n long, steps long, sent binary").collect()
        return sorted(found, key=lambda r: r.part)

    for epoch in range(spec.epochs):
        found = walked(net.flat, moments, step, epoch)
        if not found:
            break
        total = sum(r.n for r in found)
        mean = sum(np.frombuffer(bytes(r.sent), float) * (r.n / total) for r in found)
        size = len(net.flat)
        net.flat, moments, step = mean[:size], mean[size:].reshape(2, size), max(r.steps for r in found)
    return net


class NetworkModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """A trained network as a Spark ML model; adds `__p`, one probability per class."""

    content = Param(Params._dummy(), "content", "layer sizes and weights as JSON", typeConverter=TypeConverters.toString)
    featuresCol = Param(Params._dummy(), "featuresCol", "vector column", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, *, content: str | None = None, featuresCol: str = "features"):
        super().__init__()
        self._setDefault(featuresCol="features")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        got = json.loads(self.getOrDefault(self.content))
        sizes, flat = got["sizes"], np.array(got["flat"])

        @F.pandas_udf("array<double>")
        def score(rows: pd.Series) -> pd.Series:
            if not len(rows):
                return pd.Series([], dtype=object)
            return pd.Series(list(Network(sizes, flat).forward(np.stack(rows.to_list()))[0]))

        return df.withColumn("__p", score(vector_to_array(self.getOrDefault(self.featuresCol))))


class NetworkTrainer(Estimator):
    def __init__(self, spec: NetworkSpec, n_classes: int, n_features: int, label: str, features: str):
        super().__init__()
        self.spec, self.n_classes, self.n_features, self.label, self.features = spec, n_classes, n_features, label, features

    def _fit(self, df: DataFrame) -> NetworkModel:
        rows = df.select(self.label, vector_to_array(self.features).alias("x"))
        net = fit_network(rows, max(2, self.n_classes), self.n_features, self.spec, self.label, "x")
        return NetworkModel(content=json.dumps({"sizes": net.sizes, "flat": net.flat.tolist()}), featuresCol=self.features)
