"""Many penalised logistic regressions over the same rows, fitted side by side by Newton's method.

Every iteration is one job: each task adds up loss, gradient and curvature of its rows for all
fits that aren't done, one shuffle by fit adds up the tasks' sums, and the driver takes the steps.
What reaches the driver is one square of (classes * (features + 1)) numbers per fit, whatever the
number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.plans.storage import once

SUMS = "number int, sums binary"


@dataclass(frozen=True)
class Fit:
    """`c` weighs the sum of losses against half the squared coefficients; None is no penalty. Rows of fold `without` aren't seen."""

    c: float | None = 1.0
    without: int | None = None


def _scores(theta: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Probabilities per class; one row of `theta` is the second class against the first."""
    m = x @ theta.T
    if len(theta) == 1:
        p = 1 / (1 + np.exp(-m[:, 0]))
        return np.stack([1 - p, p], axis=1)
    e = np.exp(m - m.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _with_ones(column: pa.Array, width: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), width)
    return np.concatenate([x, np.ones((len(x), 1))], axis=1)


def _sums(theta: np.ndarray, x: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Loss, gradient and curvature, one after the other."""
    p = _scores(theta, x)
    loss = -np.log(np.maximum(p[np.arange(len(x)), label], 1e-300)).sum()
    k, d = theta.shape
    own = p[:, 1:] if k == 1 else p
    hit = (label[:, None] == (np.arange(k) + (k == 1))[None, :]).astype(float)
    gradient = ((own - hit).T @ x).ravel()
    curve = np.zeros((k * d, k * d))
    for a in range(k):
        for b in range(a, k):
            w = own[:, a] * ((a == b) - own[:, b])
            block = (x * w[:, None]).T @ x
            curve[a * d : (a + 1) * d, b * d : (b + 1) * d] = block
            curve[b * d : (b + 1) * d, a * d : (a + 1) * d] = block.T
    return np.concatenate([[loss], gradient, curve.ravel()])


def fit_many(df: DataFrame, n_classes: int, n_features: int, fits: Sequence[Fit], label: str = "label", features: str = "x", fold: str = "fold", iterations: int = 60) -> list[np.ndarray]:
    """Coefficients of each fit, a row per class (one row for two classes), the intercept last.

    With more than two classes intercepts sum to zero, and so do unpenalised coefficients.
    """
    rows = once(df.select(F.col(label).cast("int").alias("label"), F.col(fold).cast("int").alias("fold"), F.col(features).alias("x")))
    k, d = (1 if n_classes <= 2 else n_classes), n_features + 1
    weak = np.ones((k, d))
    weak[:, -1] = 0.0
    penalty = [0.0 if f.c is None else 1.0 / f.c for f in fits]
    theta = [np.zeros((k, d)) for _ in fits]
    step: list[np.ndarray | None] = [None] * len(fits)
    loss = [np.inf] * len(fits)
    open_ = list(range(len(fits)))

    def partial(at: dict[int, np.ndarray]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                y, own, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _with_ones(batch.column(2), n_features)
                for i, t in at.items():
                    use = np.ones(len(y), bool) if fits[i].without is None else own != fits[i].without
                    if use.any():
                        total[i] = total.get(i, 0.0) + _sums(t, x[use], y[use])
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["number", "sums"])

        return rows.mapInArrow(run, SUMS)

    def add_up(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x, float) for x in table["sums"].to_pylist()], axis=0)
        return pa.table({"number": pa.array([table["number"][0].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    for _ in range(iterations):
        if not open_:
            break
        found = {r.number: np.frombuffer(bytes(r.sums), float) for r in partial({i: theta[i] for i in open_}).groupBy("number").applyInArrow(add_up, SUMS).collect()}
        for i in list(open_):
            if i not in found:
                open_.remove(i)
                continue
            sums = found[i]
            now = sums[0] + 0.5 * penalty[i] * float((weak * theta[i] ** 2).sum())
            if step[i] is not None and now > loss[i] * (1 + 1e-12) + 1e-12 and np.abs(step[i]).max() > 1e-12:
                # Too far: back by half of the step.
                step[i] = step[i] / 2
                theta[i] = theta[i] - step[i]
                continue
            gradient = sums[1 : 1 + k * d] + penalty[i] * (weak * theta[i]).ravel()
            curve = sums[1 + k * d :].reshape(k * d, k * d) + penalty[i] * np.diag(weak.ravel())
            move = -np.linalg.lstsq(curve, gradient, rcond=1e-12)[0].reshape(k, d)
            loss[i], step[i] = now, move
            theta[i] = theta[i] + move
            if np.abs(move).max() < 1e-9:
                open_.remove(i)
    for i, f in enumerate(fits):
        if k > 1:
            theta[i] = theta[i] - theta[i].mean(axis=0) * (1 if f.c is None else 1 - weak)
    return theta


def cross_validated(ready: DataFrame, cs: Sequence[float | None], n_classes: int, n_features: int, label: str, features: str, fold: str, folds: Sequence[int]) -> DataFrame:
    """number, fold, label, guess, n: how rows of left-out folds are classed with each of `cs`."""
    rows = once(ready.select(F.col(label).cast("int").alias("label"), F.col(fold).cast("int").alias("fold"), vector_to_array(features).alias("x")))
    fits = [(i, Fit(c, f)) for i, c in enumerate(cs) for f in folds]
    thetas = fit_many(rows, n_classes, n_features, [f for _, f in fits])

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, own, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _with_ones(batch.column(2), n_features)
            for (i, fit), theta in zip(fits, thetas, strict=True):
                at = np.flatnonzero(own == fit.without)
                if len(at):
                    pairs, n = np.unique(np.stack([y[at], _scores(theta, x[at]).argmax(axis=1)]), axis=1, return_counts=True)
                    cells = {"number": np.full(len(n), i), "fold": np.full(len(n), fit.without), "label": pairs[0], "guess": pairs[1], "n": n}
                    yield pa.RecordBatch.from_pydict({c: pa.array(v.astype(np.int64)) for c, v in cells.items()})

    counted = rows.mapInArrow(guess, "number long, fold long, label long, guess long, n long")
    return counted.groupBy("number", "fold", "label", "guess").agg(F.sum("n").alias("n"))
