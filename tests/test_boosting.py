"""Boosted trees against a plain version that looks at all rows at once."""

import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tickloom.operators import boosting
from tickloom.operators.boosting import BoostedModel, BoostedTrees, BoostSpec


def rows(spark, n=600, classes=3, seed=1, parts=3):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 4)), 3)
    x[:, 3] = rng.integers(0, 3, n)
    score = np.stack([x[:, 0] + x[:, 3], x[:, 1] * x[:, 0], -x[:, 2]], axis=1)[:, :classes]
    y = (score + rng.gumbel(size=score.shape)).argmax(axis=1)
    w = rng.choice([1.0, 2.0], n)
    table = spark.createDataFrame([(int(k), *map(float, r), float(v)) for k, r, v in zip(y, x, w, strict=True)], "y int, a double, b double, c double, d double, w double")
    return VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="f").transform(table.repartition(parts))


def plain_gain(g, h, spec):
    return g * g / (h + spec.l2) if h + spec.l2 > 0 else 0.0


def plain_tree(x, g, h, spec, columns):
    """Leaf by leaf over all rows; (feature, bin, left, right) or the leaf's value."""
    bins = int(x.max()) + 1

    def best(at):
        if spec.depth is not None and at["depth"] >= spec.depth or len(at["rows"]) < max(spec.min_split_rows, 2 * spec.min_rows):
            return None
        r, found = at["rows"], None
        for f in columns:
            for b in range(bins):
                low, high = r[x[r, f] <= b], r[x[r, f] > b]
                if min(len(low), len(high)) < spec.min_rows or min(h[low].sum(), h[high].sum()) < spec.min_curvature:
                    continue
                gain = 0.5 * (plain_gain(g[low].sum(), h[low].sum(), spec) + plain_gain(g[high].sum(), h[high].sum(), spec) - plain_gain(g[r].sum(), h[r].sum(), spec)) - spec.gamma
                if gain > 0 and (found is None or gain > found[0] + 1e-9):
                    found = (gain, f, b, low, high)
        return found

    root = {"rows": np.arange(len(x)), "depth": 0}
    leaves, n = [root], 1
    root["best"] = best(root)
    while n < (spec.leaves or math.inf):
        ready = [a for a in leaves if a["best"]]
        if not ready:
            break
        at = max(ready, key=lambda a: a["best"][0])
        leaves = [a for a in leaves if a is not at]
        _, f, b, low, high = at["best"]
        at["cut"] = (f, b)
        at["kids"] = [{"rows": r, "depth": at["depth"] + 1} for r in (low, high)]
        for kid in at["kids"]:
            kid["best"] = best(kid)
            leaves.append(kid)
        n += 1
    return root


def plain_symmetric(x, g, h, spec, columns):
    bins = int(x.max()) + 1
    root = {"rows": np.arange(len(x))}
    level = [root]
    for _ in range(spec.depth):
        top = None
        for f in columns:
            for b in range(bins):
                gain = 0.0
                for at in level:
                    r = at["rows"]
                    low, high = r[x[r, f] <= b], r[x[r, f] > b]
                    if min(len(low), len(high)) >= spec.min_rows:
                        gain += 0.5 * (plain_gain(g[low].sum(), h[low].sum(), spec) + plain_gain(g[high].sum(), h[high].sum(), spec) - plain_gain(g[r].sum(), h[r].sum(), spec)) - spec.gamma
                if gain > 1e-12 and (top is None or gain > top[0] + 1e-9):
                    top = (gain, f, b)
        if top is None:
            break
        below = []
        for at in level:
            r = at["rows"]
            at["cut"] = top[1:]
            at["kids"] = [{"rows": r[x[r, top[1]] <= top[2]]}, {"rows": r[x[r, top[1]] > top[2]]}]
            below += at["kids"]
        level = below
    return root


def same(tree, at, node, g, h, spec):
    """Every split and leaf value of the tree below a node is that of the plain version."""
    feature, cut, left, right, value = tree[node]
    if "cut" not in at:
        assert feature == -1
        r = at["rows"]
        want = -spec.rate * g[r].sum() / (h[r].sum() + spec.l2) if len(r) and h[r].sum() + spec.l2 > 0 else 0.0
        assert value == pytest.approx(want, rel=1e-9, abs=1e-12)
        return
    assert (feature, cut) == at["cut"]
    same(tree, at["kids"][0], left, g, h, spec)
    same(tree, at["kids"][1], right, g, h, spec)


CASES = {
    "levels": (3, BoostSpec(rounds=3, depth=3, bins=16, l2=1.0)),
    "leaves": (2, BoostSpec(rounds=4, depth=None, leaves=9, bins=16, min_rows=5)),
    "leaves and depth": (3, BoostSpec(rounds=2, depth=4, leaves=7, bins=12, gamma=0.4, min_curvature=2.0)),
    "draws": (2, BoostSpec(rounds=4, depth=3, bins=10, rows=0.7, columns=0.5, l2=0.5)),
    "symmetric": (3, BoostSpec(rounds=2, depth=3, bins=10, symmetric=True, l2=3.0)),
}


@pytest.mark.parametrize("case", CASES)
def test_trees_are_those_of_the_plain_version(spark, monkeypatch, case):
    classes, spec = CASES[case]
    monkeypatch.setattr(boosting, "STORED_ROUNDS", 2)
    monkeypatch.setattr(boosting, "PART_ROWS", 200)
    df = rows(spark, 400, classes)
    table = df.select("y", F.array("a", "b", "c", "d").alias("x"), "w")
    seen = {}
    original = boosting.cut

    def keeping(frame):
        out = original(frame)
        seen.setdefault("numbered" if "margins" not in frame.columns else "binned", out)
        return out

    monkeypatch.setattr(boosting, "cut", keeping)
    rounds, edges, start = boosting.fit_trees(table, classes, 4, spec, "y", "x", "w")
    got = sorted(seen["numbered"].collect(), key=lambda r: r.id)
    ids, y, w = np.array([r.id for r in got]), np.array([r.label for r in got]), np.array([r.weight for r in got])
    x = boosting.binned(np.array([r.x for r in got]), edges).astype(int)
    margins = np.tile(np.array(start), (len(x), 1))
    assert len(rounds) == spec.rounds
    for number, trees in enumerate(rounds):
        g, h = boosting.gradients(margins, y, w)
        use = np.flatnonzero(boosting.drawn(ids, spec.rows, spec.seed, number))
        for k, tree in enumerate(trees):
            columns = boosting.columns_of(4, spec.columns, spec.seed, number, k)
            plain = (plain_symmetric if spec.symmetric else plain_tree)(x[use], g[use, k], h[use, k], spec, columns)
            same(tree, plain, 0, g[use, k], h[use, k], spec)
        margins = boosting.margins_after(margins, [trees], x.astype(np.uint8))


def test_models_side_by_side_are_those_fitted_alone(spark):
    """Points of different shapes, rounds and draws, each without one fold."""
    df = rows(spark, 300, 3).select("y", F.array("a", "b", "c", "d").alias("x"), "w", (F.pmod(F.xxhash64("a"), F.lit(3))).cast("int").alias("fold"))
    df = boosting.cut(df)
    specs = [BoostSpec(rounds=3, depth=2, bins=12), BoostSpec(rounds=2, depth=None, leaves=5, bins=12, rows=0.6), BoostSpec(rounds=1, depth=2, bins=12, symmetric=True, l2=1.0), BoostSpec(rounds=1, depth=1, bins=5)]
    fits = [boosting.Fit(s, f) for s in specs for f in (0, 2)]
    for fit, (trees, edges, start) in zip(fits, boosting.fit_many(df, 3, 4, fits, "y", "x", "w", "fold"), strict=True):
        alone, own_edges, own_start = boosting.fit_many(df, 3, 4, [fit], "y", "x", "w", "fold")[0]
        assert edges == own_edges and start == own_start
        assert len(trees) == len(alone) == fit.spec.rounds
        for a, b in zip((n for t in trees for k in t for n in k), (n for t in alone for k in t for n in k), strict=True):
            assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-9)


def test_cross_validation_counts_each_left_out_row_once(spark):
    df = rows(spark, 200, 2).withColumn("fold", F.pmod(F.xxhash64("a"), F.lit(4)))
    makers = [BoostedTrees(BoostSpec(rounds=r, depth=2, bins=8), 2, 4, "y", "f") for r in (1, 3)]
    found = boosting.cross_validated(boosting.cut(df), makers, "fold", range(4)).groupBy("number").agg(F.sum("n").alias("n")).collect()
    assert {(r["number"], r["n"]) for r in found} == {(0, 200), (1, 200)}


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    for width in (1, 3):
        m, y, w = rng.normal(size=(7, width)), rng.integers(0, max(2, width), 7), np.ones(7)

        def loss(m, y=y):
            return -np.log(boosting.probabilities(m)[np.arange(7), y]).sum()

        g, h = boosting.gradients(m, y, w)
        for i in range(7):
            for k in range(width):
                step = np.zeros_like(m)
                step[i, k] = 1e-5
                assert g[i, k] == pytest.approx((loss(m + step) - loss(m - step)) / 2e-5, abs=1e-6)
                curve = (loss(m + step) - 2 * loss(m) + loss(m - step)) / 1e-10
                assert h[i, k] * (1 if width == 1 else (width - 1) / width) == pytest.approx(curve, abs=1e-3)


def test_a_fit_learns_and_survives_saving(spark, tmp_path):
    df = rows(spark, 600, 3)
    model = BoostedTrees(BoostSpec(rounds=12, depth=4, leaves=8, rate=0.3), 3, 4, "y", "f").fit(df)
    df = df.orderBy("a", "b", "c")
    scored = model.transform(df).select("y", "__p").collect()
    assert np.mean([r.y == int(np.argmax(r["__p"])) for r in scored]) > 0.7
    assert all(sum(r["__p"]) == pytest.approx(1) for r in scored)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = BoostedModel.load(str(tmp_path / "m"))
    assert [r["__p"] for r in again.transform(df).select("__p").collect()] == [r["__p"] for r in scored]
    assert sum(model.featureImportances.toArray()) == pytest.approx(1)


def test_odd_input(spark):
    """One class, a constant column, missing values, and rows that can't be told apart."""
    table = spark.createDataFrame([(0, 1.0, float("nan")), (0, 1.0, 2.0), (0, 1.0, 3.0)], "y int, a double, b double")
    df = VectorAssembler(inputCols=["a", "b"], outputCol="f", handleInvalid="keep").transform(table)
    model = BoostedTrees(BoostSpec(rounds=2, depth=2), 1, 2, "y", "f").fit(df)
    assert all(r["__p"][0] > 0.99 for r in model.transform(df).collect())
    with pytest.raises(ValueError, match="limit"):
        BoostSpec(depth=None)
    with pytest.raises(ValueError, match="bins"):
        BoostSpec(bins=256)
