"""Boosted trees grown from histograms of gradients.

Features are cut into at most `bins` ranges once. In every round, and for every class, a tree is
grown from sums of gradients and curvatures by (node, feature, bin): each task adds up its own rows
for all nodes in question, and one shuffle by (tree, node, feature) adds up the tasks' sums and
finds the best cut of the feature. Only these cuts reach the driver, one row per tree, node and
feature, whatever the number of rows.

A tree grows leaf by leaf, the leaf of the greatest gain first, until it has `leaves` of them, or level
by level to `depth`, or level by level with one cut for all nodes of a level (`symmetric`). The cut of a
node doesn't depend on its siblings, so the nodes that a leaf-wise tree may come to split are summed
together, one job per level, and the order of splits is settled afterwards.

Rows keep the sums of all trees that were stored with them; every `STORED_ROUNDS` rounds they are written anew.
Tasks apply later trees on the fly, so a lost task reruns on its own.

Several models over the same rows grow side by side: a job sums for the trees of all of them, so a search
over many settings and folds takes as many jobs as its largest model.
"""

from __future__ import annotations

import heapq
import json
import math
import random
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.plans.storage import cut

STORED_ROUNDS = 16
PART_ROWS = 1 << 18


@dataclass(frozen=True)
class BoostSpec:
    """`depth` or `leaves` of None set no limit; one of them is needed.

    `l2` is added to a leaf's curvature, `gamma` is the gain a split must exceed, `rows` and
    `columns` are the shares drawn per round and per tree.
    """

    rounds: int = 100
    rate: float = 0.1
    depth: int | None = 6
    leaves: int | None = None
    symmetric: bool = False
    l2: float = 0.0
    gamma: float = 0.0
    rows: float = 1.0
    columns: float = 1.0
    min_rows: int = 1
    min_split_rows: int = 2
    min_curvature: float = 0.0
    bins: int = 255
    seed: int = 42

    def __post_init__(self) -> None:
        if self.depth is None and self.leaves is None:
            raise ValueError("trees need a limit of depth or of leaves")
        if self.symmetric and self.depth is None:
            raise ValueError("symmetric trees need a depth")
        if not 2 <= self.bins <= 255:
            raise ValueError("bins must be from 2 to 255")


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers with every bit spread."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def drawn(ids: np.ndarray, share: float, seed: int, round_: int) -> np.ndarray:
    """Which rows a round sees; a row's luck follows from its number alone."""
    if share >= 1:
        return np.ones(len(ids), bool)
    with np.errstate(over="ignore"):
        salt = _mixed(np.array([seed * 1_000_003 + round_ + 1], np.uint64))
        luck = _mixed(ids.astype(np.uint64) ^ salt)
    return (luck >> np.uint64(11)).astype(float) / (1 << 53) < share


def columns_of(n: int, share: float, seed: int, round_: int, tree: int) -> list[int]:
    """The features a tree may use."""
    k = max(1, round(n * share))
    return list(range(n)) if k >= n else sorted(random.Random(f"{seed}/{round_}/{tree}").sample(range(n), k))


# A tree is a list of nodes (feature, bin, left, right, value); leaves have feature -1 and others their gain
# as value. Rows whose bin is at most the node's go left.
Node = tuple[int, int, int, int, float]


def leaf_of(tree: Sequence[Node], x: np.ndarray) -> np.ndarray:
    """The number of the leaf that each row of bins comes to."""
    feature, at, left, right = (np.array([n[i] for n in tree], np.int64) for i in range(4))
    node = np.zeros(len(x), np.int64)
    rows = np.arange(len(x))
    while True:
        f = feature[node]
        inner = f >= 0
        if not inner.any():
            return node
        low = x[rows, np.where(inner, f, 0)] <= at[node]
        node = np.where(inner, np.where(low, left[node], right[node]), node)


def margins_after(margins: np.ndarray, rounds: Sequence[Sequence[Sequence[Node]]], x: np.ndarray) -> np.ndarray:
    out = margins.copy()
    for trees in rounds:
        for k, tree in enumerate(trees):
            out[:, k] += np.array([n[4] for n in tree])[leaf_of(tree, x)]
    return out


def probabilities(margins: np.ndarray) -> np.ndarray:
    """One column per class: logistic of a single margin, softmax of several."""
    if margins.shape[1] == 1:
        p = 1 / (1 + np.exp(-margins[:, 0]))
        return np.stack([1 - p, p], axis=1)
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradients(margins: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the log loss, a column per tree."""
    p = probabilities(margins)
    if margins.shape[1] == 1:
        p, hit = p[:, 1:], (label == 1)[:, None]
        scale = 1.0
    else:
        hit = label[:, None] == np.arange(margins.shape[1])[None, :]
        scale = margins.shape[1] / (margins.shape[1] - 1)
    w = weight[:, None]
    return w * (p - hit), w * scale * p * (1 - p)


def _score(g: np.ndarray, h: np.ndarray, l2: float) -> np.ndarray:
    return np.where(h + l2 > 0, g * g / np.where(h + l2 > 0, h + l2, 1), 0.0)


def gains(g: np.ndarray, h: np.ndarray, n: np.ndarray, spec: BoostSpec) -> np.ndarray:
    """The gain of cutting after each bin; minus infinity where a side is too small."""
    gl, hl, nl = np.cumsum(g), np.cumsum(h), np.cumsum(n)
    gr, hr, nr = gl[-1] - gl, hl[-1] - hl, nl[-1] - nl
    gain = 0.5 * (_score(gl, hl, spec.l2) + _score(gr, hr, spec.l2) - _score(gl[-1], hl[-1], spec.l2)) - spec.gamma
    small = (nl < spec.min_rows) | (nr < spec.min_rows) | (hl < spec.min_curvature) | (hr < spec.min_curvature)
    return np.where(small, -np.inf, gain)


class Growth:
    """A tree on its way: nodes with their sums, the best cuts known so far, and what to ask next."""

    def __init__(self, spec: BoostSpec, columns: Sequence[int]):
        self.spec, self.columns = spec, set(columns)
        #: Per node: depth, and from the first job on (g, h, n) and its best cut (gain, feature, bin).
        self.depth = [0]
        self.sums: list[tuple | None] = [None]
        self.best: list[tuple | None] = [None]
        self.children: dict[int, tuple[int, int]] = {}

    def _closed(self, node: int) -> bool:
        """Whether a node can't be split, whatever its sums by bin."""
        if self.spec.depth is not None and self.depth[node] >= self.spec.depth:
            return True
        return self.sums[node] is not None and self.sums[node][2] < max(self.spec.min_split_rows, 2 * self.spec.min_rows)

    def answer(self, node: int, found: Mapping[int, tuple]) -> None:
        """found: feature -> (gain, bin, g, h, n, sums left of the cut)."""
        first = next(iter(found.values()))
        self.sums[node] = tuple(first[2:5])
        own = [(v[0], -f, -v[1], v[5:8]) for f, v in found.items() if f in self.columns and v[0] > 0]
        self.best[node] = max(own) if own else ()

    def split(self, node: int) -> None:
        if node in self.children:
            return
        _, _, _, left = self.best[node]
        g, h, n = self.sums[node]
        self.children[node] = (len(self.depth), len(self.depth) + 1)
        for sums in (left, (g - left[0], h - left[1], n - left[2])):
            self.depth.append(self.depth[node] + 1)
            self.sums.append(tuple(sums))
            self.best.append(None)

    def settle(self) -> tuple[set[int], list[int]]:
        """Split leaf by leaf as far as cuts are known: nodes to ask about, and the splits in order."""
        most = self.spec.leaves or math.inf
        wanted, order, n_leaves = set(), [], 1
        queue: list[tuple] = []

        def put(node: int) -> None:
            if self._closed(node):
                return
            if self.best[node] is None:
                wanted.add(node)
            elif self.best[node]:
                heapq.heappush(queue, (-self.best[node][0], node))

        put(0)
        while queue and n_leaves < most:
            node = heapq.heappop(queue)[1]
            self.split(node)
            order.append(node)
            n_leaves += 1
            for child in self.children[node]:
                put(child)
        return wanted, order

    def nodes(self, inner: Sequence[int]) -> tuple[list[Node], list[int]]:
        """The tree that has split the nodes in `inner`, and its nodes' numbers here."""
        split = set(inner)
        tree: list = []
        numbers: list[int] = []

        def add(node: int) -> int:
            at = len(tree)
            tree.append(None)
            numbers.append(node)
            if node in split:
                gain, f, b, _ = self.best[node]
                left, right = self.children[node]
                tree[at] = (-f, -b, add(left), add(right), gain)
            else:
                g, h, _ = self.sums[node] or (0.0, 0.0, 0)
                value = -self.spec.rate * g / (h + self.spec.l2) if h + self.spec.l2 > 0 else 0.0
                tree[at] = (-1, 0, 0, 0, value)
            return at

        add(0)
        return tree, numbers


def bin_edges(df: DataFrame, features: str, n_features: int, bins: int) -> list[list[float]]:
    """Upper bounds of all but the last bin, per feature: its distinct values, or quantiles if there are more."""
    values = [F.col(features)[i] for i in range(n_features)]
    row = df.agg(*[F.percentile_approx(v, [k / bins for k in range(1, bins)], 20 * bins).alias(f"q{i}") for i, v in enumerate(values)], *[F.max(v).alias(f"m{i}") for i, v in enumerate(values)]).first()
    return [sorted({float(q) for q in row[f"q{i}"] or [] if q == q and q < row[f"m{i}"]}) for i in range(n_features)]


def binned(rows: np.ndarray, edges: Sequence[Sequence[float]]) -> np.ndarray:
    """A missing value falls into the last bin."""
    return np.stack([np.searchsorted(np.array(e), rows[:, i]) for i, e in enumerate(edges)], axis=1).astype(np.uint8) if rows.shape[1] else np.zeros((len(rows), 0), np.uint8)


def _matrix(column: pa.Array, width: int, kind: type = float) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), width)


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), np.uint8).reshape(len(column), width)


@dataclass(frozen=True)
class Fit:
    """One of several models: its settings, and the fold whose rows it doesn't see."""

    spec: BoostSpec
    without: int | None = None


STORED = "id long, fold int, x binary, label int, weight double, margins array<double>"
PARTIAL = "tree int, node int, feature int, g binary, h binary, n binary"
CUTS = "tree int, node int, feature int, gain double, bin int, g double, h double, n long, gl double, hl double, nl long, gains binary"


def _partial_sums(table: DataFrame, fits: Sequence[Fit], rounds: list, growing: list, asked: list, round_: int, width: int, per_fit: int, bins: int) -> DataFrame:
    """Sums by bin of each task's rows, for all nodes asked about. Trees are numbered by (fit, class)."""
    active = [m for m in range(len(fits)) if any(asked[m * per_fit : (m + 1) * per_fit])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, fold, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _bytes(batch.column(2), width)
            label, weight = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            margins = _matrix(batch.column(5), per_fit * len(fits))
            for m in active:
                spec, without = fits[m].spec, fits[m].without
                use = drawn(ids, spec.rows, spec.seed, round_)
                if without is not None:
                    use &= fold != without
                own, seen = slice(m * per_fit, (m + 1) * per_fit), x[use]
                after = margins_after(margins[use, own], [trees[own] for trees in rounds], seen)
                g, h = gradients(after, label[use], weight[use])
                for k in range(per_fit):
                    tree = m * per_fit + k
                    if not asked[tree]:
                        continue
                    nodes, numbers = growing[tree]
                    at = np.array(numbers)[leaf_of(nodes, seen)]
                    for node in asked[tree]:
                        rows = np.flatnonzero(at == node)
                        sums = total.setdefault((tree, node), np.zeros((3, width, bins)))
                        for f in range(width):
                            cell = seen[rows, f]
                            sums[0, f] += np.bincount(cell, g[rows, k], bins)
                            sums[1, f] += np.bincount(cell, h[rows, k], bins)
                            sums[2, f] += np.bincount(cell, minlength=bins)
        for (tree, node), sums in total.items():
            yield pa.RecordBatch.from_pydict(
                {"tree": pa.array([tree] * width, pa.int32()), "node": pa.array([node] * width, pa.int32()), "feature": pa.array(range(width), pa.int32()), **{c: pa.array([s.tobytes() for s in sums[i]], pa.binary()) for i, c in enumerate("ghn")}}
            )

    return table.mapInArrow(run, PARTIAL)


def _best_cuts(partial: DataFrame, fits: Sequence[Fit], per_fit: int) -> DataFrame:
    """Per tree, node and feature: the best cut, the node's sums and those on its left; with `symmetric` the gains of all cuts."""

    def add_up(rows: pa.Table) -> pa.Table:
        head = {c: [rows[c][0].as_py()] for c in ("tree", "node", "feature")}
        spec = fits[head["tree"][0] // per_fit].spec
        g, h, n = (np.sum([np.frombuffer(x, float) for x in rows[c].to_pylist()], axis=0) for c in "ghn")
        gain = gains(g, h, n, spec)
        b = int(np.argmax(gain))
        every = gain.tobytes() if spec.symmetric else None
        sides = {"gl": [g[: b + 1].sum()], "hl": [h[: b + 1].sum()], "nl": [int(n[: b + 1].sum())]}
        types = {"tree": pa.int32(), "node": pa.int32(), "feature": pa.int32(), "bin": pa.int32(), "n": pa.int64(), "nl": pa.int64(), "gains": pa.binary()}
        cells = {**head, "gain": [gain[b]], "bin": [b], "g": [g.sum()], "h": [h.sum()], "n": [int(n.sum())], **sides, "gains": [every]}
        return pa.table({c: pa.array(v, types.get(c, pa.float64())) for c, v in cells.items()})

    return partial.groupBy("tree", "node", "feature").applyInArrow(add_up, CUTS)


def fit_trees(df: DataFrame, n_classes: int, n_features: int, spec: BoostSpec, label: str, features: str, weight: str | None = None) -> tuple[list, list, list]:
    """Rounds of trees, edges of bins and the margins all rows start from; see `fit_many`."""
    return fit_many(df, n_classes, n_features, [Fit(spec)], label, features, weight)[0]


def fit_many(
    df: DataFrame, n_classes: int, n_features: int, fits: Sequence[Fit], label: str, features: str, weight: str | None = None, fold: str | None = None
) -> list[tuple[list, list, list]]:
    """For each fit: rounds of trees, edges of bins and the margins all rows start from.

    `features` is an array column, `label` counts from 0, `fold` numbers the rows' folds. Edges are
    common to all fits with as many bins.
    """
    if len({f.spec.bins for f in fits}) > 1:
        by_bins = {b: [i for i, f in enumerate(fits) if f.spec.bins == b] for b in {f.spec.bins for f in fits}}
        out: list = [None] * len(fits)
        for own in by_bins.values():
            for i, got in zip(own, fit_many(df, n_classes, n_features, [fits[i] for i in own], label, features, weight, fold), strict=True):
                out[i] = got
        return out
    spark = df.sparkSession
    edges = bin_edges(df, features, n_features, fits[0].spec.bins)
    bins = max([len(e) for e in edges], default=0) + 1
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    in_fold = F.col(fold).cast("int") if fold else F.lit(0)
    sums = {(r.f, r.k): r.w for r in df.groupBy(in_fold.alias("f"), F.col(label).cast("int").alias("k")).agg(F.sum(w).alias("w")).collect()}

    def start_of(fit: Fit) -> list[float]:
        shares = np.array([sum(v for (f, k), v in sums.items() if k == c and (fit.without is None or f != fit.without)) for c in range(max(2, n_classes))], float)
        logs = np.log(np.maximum(shares / max(shares.sum(), 1e-300), 1e-12))
        return [float(logs[1] - logs[0])] if n_classes <= 2 else [float(x) for x in logs]

    starts = [start_of(f) for f in fits]
    per_fit, begin = len(starts[0]), [x for s in starts for x in s]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = binned(_matrix(batch.column(2), n_features), edges)
            first = pa.array([begin] * len(batch), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary()), *batch.columns[3:5], first], names=["id", "fold", "x", "label", "weight", "margins"])

    numbered = df.select(F.monotonically_increasing_id().alias("id"), in_fold.alias("fold"), F.col(features).alias("x"), F.col(label).cast("int").alias("label"), w.alias("weight"))
    # Few rows in few tasks: a round is many short jobs.
    n_parts = max(1, -(-df.count() // PART_ROWS))
    table = cut(cut(numbered).coalesce(n_parts).mapInArrow(code, STORED))
    rounds: list[list[list[Node]]] = []
    stored = 0

    def store(since: list) -> DataFrame:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                after = margins_after(_matrix(batch.column(5), len(begin)), since, _bytes(batch.column(2), n_features))
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(after.tolist(), pa.list_(pa.float64()))], names=batch.schema.names)

        return cut(table.mapInArrow(add, STORED))

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    still: list[Node] = [(-1, 0, 0, 0, 0.0)]
    for round_ in range(max(f.spec.rounds for f in fits)):
        if round_ - stored >= STORED_ROUNDS:
            table, stored = store(rounds[stored:]), round_
        since = rounds[stored:]
        on = [round_ < f.spec.rounds for f in fits]
        grow = [Growth(f.spec, columns_of(n_features, f.spec.columns, f.spec.seed, round_, k)) for f in fits for k in range(per_fit)]

        def cuts_of(asked: list, growing: list, since: list = since, round_: int = round_, table: DataFrame = table) -> dict:
            partial = _partial_sums(table, fits, since, growing, asked, round_, n_features, per_fit, bins)
            found: dict[tuple[int, int], dict] = {}
            n_groups = sum(map(len, asked)) * n_features
            partial = partial.coalesce(1) if n_parts == 1 else partial.repartition(min(parts, n_groups), "tree", "node", "feature")
            for r in _best_cuts(partial, fits, per_fit).collect():
                found.setdefault((r.tree, r.node), {})[r.feature] = (r.gain, r.bin, r.g, r.h, r.n, r.gl, r.hl, r.nl, r.gains)
            return found

        trees: list = [still] * len(grow)
        for make, symmetric in ((_grown_trees, False), (_symmetric_trees, True)):
            own = [m * per_fit + k for m, f in enumerate(fits) if on[m] and f.spec.symmetric == symmetric for k in range(per_fit)]
            if own:
                trees = make(grow, own, trees, cuts_of)
        rounds.append(trees)
    return [([trees[m * per_fit : (m + 1) * per_fit] for trees in rounds[: f.spec.rounds]], edges, starts[m]) for m, f in enumerate(fits)]


def _grown_trees(grow: list[Growth], own: list[int], trees: list, cuts_of) -> list[list[Node]]:
    """The trees in `own`, grown leaf by leaf; the others stay as they are."""
    while True:
        asked: list[list[int]] = [[] for _ in grow]
        growing = [(t, [0] * len(t)) for t in trees]
        for k in own:
            wanted, order = grow[k].settle()
            asked[k], growing[k] = sorted(wanted), grow[k].nodes(order)
        if not any(asked):
            return [tree for tree, _ in growing]
        found = cuts_of(asked, growing)
        for k in own:
            for node in asked[k]:
                if (k, node) in found:
                    grow[k].answer(node, found[k, node])
                else:
                    grow[k].sums[node], grow[k].best[node] = grow[k].sums[node] or (0.0, 0.0, 0), ()


def _symmetric_trees(grow: list[Growth], own: list[int], trees: list, cuts_of) -> list[list[Node]]:
    """One cut per level, the best by the sum of all nodes' gains; a node that it can't split gains nothing."""
    inner: list[list[int]] = [[] for _ in grow]
    level: list[list[int]] = [[0] if k in set(own) else [] for k in range(len(grow))]

    def growing() -> list:
        return [grow[k].nodes(inner[k]) if k in set(own) else (t, [0] * len(t)) for k, t in enumerate(trees)]

    for depth in range(max(grow[k].spec.depth for k in own)):
        asked = [nodes if k in set(own) and depth < grow[k].spec.depth else [] for k, nodes in enumerate(level)]
        if not any(asked):
            break
        found = cuts_of(asked, growing())
        for k, nodes in enumerate(asked):
            tree = grow[k]
            nodes = [n for n in nodes if (k, n) in found]
            total: dict[int, np.ndarray] = {}
            for node in nodes:
                tree.sums[node] = tuple(next(iter(found[k, node].values()))[2:5])
                for f, v in found[k, node].items():
                    if f in tree.columns:
                        gain = np.frombuffer(v[8], float)
                        total[f] = total.get(f, 0.0) + np.where(np.isfinite(gain), gain, 0.0)
            best = max(((float(g.max()), -f, -int(g.argmax())) for f, g in total.items()), default=(0.0, 0, 0))
            if not asked[k]:
                continue
            level[k] = _split_level(tree, nodes, inner[k], best) if best[0] > 0 else []
    # Sums of the last leaves: one more pass over the rows.
    if any(level):
        for (k, node), v in cuts_of(level, growing()).items():
            grow[k].sums[node] = tuple(next(iter(v.values()))[2:5])
    return [tree for tree, _ in growing()]


def _split_level(tree: Growth, nodes: list[int], inner: list[int], cut_: tuple) -> list[int]:
    below = []
    gain, *rest = cut_
    for node in nodes:
        tree.best[node] = (gain / len(nodes), *rest, (0.0, 0.0, 0))
        tree.split(node)
        inner.append(node)
        for child in tree.children[node]:
            tree.sums[child] = None
            below.append(child)
    return below


class BoostedModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Rounds of trees as a Spark ML model; adds `probability`, one number per class."""

    content = Param(Params._dummy(), "content", "trees, edges and first margins as JSON", typeConverter=TypeConverters.toString)
    featuresCol = Param(Params._dummy(), "featuresCol", "vector column", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, *, content: str | None = None, featuresCol: str = "features"):
        super().__init__()
        self._setDefault(featuresCol="features")
        kept = {k: v for k, v in self._input_kwargs.items() if v is not None}
        self._set(**kept)

    @property
    def parts(self) -> tuple[list, list, list]:
        got = json.loads(self.getOrDefault(self.content))
        return got["rounds"], got["edges"], got["start"]

    def _transform(self, df: DataFrame) -> DataFrame:
        rounds, edges, start = self.parts

        @F.pandas_udf("array<double>")
        def score(rows: pd.Series) -> pd.Series:
            x = binned(np.stack(rows.to_list()), edges) if len(rows) else np.zeros((0, len(edges)), np.uint8)
            margins = margins_after(np.tile(np.array(start), (len(x), 1)), rounds, x)
            return pd.Series(list(probabilities(margins)))

        return df.withColumn("__p", score(vector_to_array(self.getOrDefault(self.featuresCol))))

    @property
    def featureImportances(self) -> DenseVector:
        """The share of all splits' gains, by feature."""
        rounds, edges, _ = self.parts
        total = np.zeros(len(edges))
        for trees in rounds:
            for tree in trees:
                for feature, _, _, _, gain in tree:
                    if feature >= 0:
                        total[feature] += gain
        return DenseVector(total / total.sum() if total.sum() else total)


class BoostedTrees(Estimator):
    """Estimator over `BoostSpec`; the label counts classes from 0."""

    def __init__(self, spec: BoostSpec, n_classes: int, n_features: int, label: str, features: str, weight: str | None = None):
        super().__init__()
        self.spec, self.n_classes, self.n_features = spec, n_classes, n_features
        self.label, self.features, self.weight = label, features, weight

    def _content(self, fit: tuple) -> BoostedModel:
        rounds, edges, start = fit
        return BoostedModel(content=json.dumps({"rounds": rounds, "edges": edges, "start": start}), featuresCol=self.features)

    def _fit(self, df: DataFrame) -> BoostedModel:
        rows = df.select(self.label, vector_to_array(self.features).alias("x"), *([self.weight] if self.weight else []))
        return self._content(fit_trees(rows, self.n_classes, self.n_features, self.spec, self.label, "x", self.weight))


def cross_validated(ready: DataFrame, estimators: Sequence[BoostedTrees], fold: str, folds: Sequence[int]) -> DataFrame:
    """number, label, guess, n: how rows of left-out folds are classed by each estimator, all fitted side by side."""
    one = estimators[0]
    rows = ready.select(one.label, vector_to_array(one.features).alias("x"), fold, *([one.weight] if one.weight else []))
    fits = [(i, Fit(e.spec, f)) for i, e in enumerate(estimators) for f in folds]
    models = fit_many(rows, one.n_classes, one.n_features, [f for _, f in fits], one.label, "x", one.weight, fold)
    n_features = one.n_features

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, own, values = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2), n_features)
            for (i, fit), (rounds, edges, start) in zip(fits, models, strict=True):
                at = np.flatnonzero(own == fit.without)
                if len(at):
                    x = binned(values[at], edges)
                    best = probabilities(margins_after(np.tile(np.array(start), (len(x), 1)), rounds, x)).argmax(axis=1)
                    pairs, n = np.unique(np.stack([label[at], best]), axis=1, return_counts=True)
                    cells = {"number": np.full(len(n), i), "label": pairs[0], "guess": pairs[1], "n": n}
                    yield pa.RecordBatch.from_pydict({c: pa.array(v.astype(np.int64)) for c, v in {**cells, "fold": np.full(len(n), fit.without)}.items()})

    counted = rows.select(F.col(one.label).cast("int"), F.col(fold).cast("int"), "x").mapInArrow(guess, "number long, label long, guess long, n long, fold long")
    return counted.groupBy("number", "fold", "label", "guess").agg(F.sum("n").alias("n"))
