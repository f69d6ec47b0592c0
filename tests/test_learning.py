import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import evaluation as ev
from tickloom.operators import models, regimes, selection, statistics, walkforward
from tickloom.plans.series import index_series

Y = [0, 1, 0, 1, 0, 1, 1, 0, 1, 0]
YHAT = [0, 1, 0, 0, 0, 1, 0, 0, 1, 1]
P1 = [0.1, 0.8, 0.3, 0.4, 0.2, 0.7, 0.6, 0.1, 0.9, 0.6]


@pytest.fixture(scope="module")
def scored(spark):
    rows = [(i, y, h, 1 - p, p) for i, (y, h, p) in enumerate(zip(Y, YHAT, P1))]
    return spark.createDataFrame(rows, "id int, y int, yhat int, probability_0 double, probability_1 double")


def test_confusion_and_report(scored):
    cells = {(r["truth"], r["guess"]): r["n"] for r in ev.confusion(scored).collect()}
    assert cells == {(0, 0): 4, (0, 1): 1, (1, 0): 2, (1, 1): 3}
    rows = {(r["kind"], r["label"]): r for r in ev.class_report(scored).collect()}
    one = rows["class", "1"]
    assert (one["precision"], one["recall"], one["support"]) == (0.75, 0.6, 5)
    assert rows["macro", None]["precision"] == pytest.approx((4 / 6 + 0.75) / 2)


def test_a_class_that_is_never_predicted_counts_as_zero(spark):
    df = spark.createDataFrame([(0, 0), (1, 0)], "y int, yhat int")
    rows = {r["label"]: r for r in ev.class_report(df).filter("kind = 'class'").collect()}
    assert (rows["1"]["precision"], rows["1"]["recall"], rows["1"]["f1"]) == (0.0, 0.0, 0.0)


def test_areas_count_ties_half(scored):
    pairs = [(a, b) for a, y in zip(P1, Y) if y for b, z in zip(P1, Y) if not z]
    want = np.mean([1.0 if a > b else 0.5 if a == b else 0.0 for a, b in pairs])
    row = ev.auc(scored, "probability_1", F.col("y") == 1).collect()[0]
    assert row["roc_auc"] == pytest.approx(want)
    total, hits = 0.0, 0
    for cut in sorted(set(P1), reverse=True):
        chosen = [y for y, p in zip(Y, P1) if p >= cut]
        total += (sum(chosen) - hits) / 5 * sum(chosen) / len(chosen)
        hits = sum(chosen)
    assert row["average_precision"] == pytest.approx(total)


def test_evaluation_row(scored):
    row = ev.evaluate(scored, (0, 1)).collect()[0]
    assert row["accuracy"] == 0.7
    assert row["log_loss"] == pytest.approx(-np.mean([np.log(p if y else 1 - p) for y, p in zip(Y, P1)]))


def test_one_sided_labels_have_no_area(spark):
    df = spark.createDataFrame([(1, 0.3), (1, 0.6)], "y int, p double")
    assert ev.auc(df, "p", F.col("y") == 1).collect()[0]["roc_auc"] is None


def test_decisions(scored):
    assert [r[0] for r in scored.orderBy("id").select(ev.decide((0, 1), 0.65)).collect()] == [int(p >= 0.65) for p in P1]
    tie = scored.limit(1).select(F.lit(0.4).alias("probability_a"), F.lit(0.4).alias("probability_b"), F.lit(0.2).alias("probability_c"))
    assert tie.select(ev.decide(("a", "b", "c"))).collect()[0][0] == 0


def test_score_mixes(spark):
    a = spark.createDataFrame([("S", 1, 0.2, 0.8)], "symbol string, ts int, probability_0 double, probability_1 double")
    b = spark.createDataFrame([("S", 1, 0.6, 0.4)], a.schema)
    mix = lambda *args: ev.combine_scores({"a": a, "b": b}, (0, 1), *args).collect()[0]["probability_1"]
    assert mix() == pytest.approx(0.6)
    assert mix("average", {"a": 2.0}) == pytest.approx(1.0)
    assert mix("weighted_average", {"a": 3.0}) == pytest.approx(0.7)
    assert mix("weighted_average", {"a": 0.0, "b": 0.0}) == pytest.approx(0.0)


@pytest.fixture(scope="module")
def mixed(spark):
    rows = [
        (float(10 + i * 10 / 9), [1.0, 2.0, None, 4.0, 5.0, 6.0, None, 8.0, 9.0, 10.0][i], "AB"[i % 2], ["P", "Q", "P", None, "Q", "P", "Q", None, "P", "Q"][i])
        for i in range(10)
    ]
    return spark.createDataFrame(rows, "numeric1 double, gaps double, category1 string, category_gaps string")


@pytest.mark.parametrize("scaling", ["standard", "minmax", "robust", None])
def test_preprocessing(mixed, scaling):
    prep = selection.Preprocessor.fit(mixed, scaling=scaling)
    got = prep.transform(mixed).toPandas()
    x = pd.Series([1.0, 2, np.nan, 4, 5, 6, np.nan, 8, 9, 10]).fillna(5.5)
    mid, width = {"standard": (x.mean(), x.std(ddof=0)), "minmax": (x.min(), x.max() - x.min()), "robust": (x.median(), x.quantile(0.75) - x.quantile(0.25)), None: (0, 1)}[scaling]
    np.testing.assert_allclose(sorted(got["gaps"]), sorted((x - mid) / width))
    assert got["category_gaps_P"].sum() == 6 and got["category_gaps_Q"].sum() == 4
    again = selection.Preprocessor.from_json(prep.to_json())
    assert again == prep


def test_unknown_levels_and_missing_features(mixed):
    prep = selection.Preprocessor.fit(mixed, numeric=[])
    other = mixed.limit(1).withColumn("category1", F.lit("Z"))
    row = prep.transform(other).collect()[0]
    assert (row["category1_A"], row["category1_B"]) == (0.0, 0.0)
    with pytest.raises(ValueError):
        prep.transform(mixed.select("numeric1"))


@pytest.fixture(scope="module")
def learnable(spark):
    rng = np.random.default_rng(0)
    parts = []
    for s in "AB":
        x = rng.normal(size=(150, 3))
        y = np.where(x[:, 0] + 0.3 * rng.normal(size=150) > 0.4, 1, np.where(x[:, 0] < -0.4, -1, 0))
        parts.append(pd.DataFrame({"symbol": s, "ts": pd.date_range("2022-01-01", periods=150), "useful": x[:, 0], "weak": x[:, 0] * 0.2 + x[:, 1], "noise": x[:, 2], "y": y}))
    return spark.createDataFrame(pd.concat(parts))


FEATURES = ["useful", "weak", "noise"]


def test_selection_finds_the_useful_feature(learnable):
    assert selection.select_features(learnable, "y", "mutual_info", 1, columns=FEATURES) == ["useful"]
    assert selection.select_features(learnable, "y", "rfe", 1, columns=FEATURES) == ["useful"]
    assert selection.select_features(learnable, "y", "importance", 2, columns=FEATURES)[0] == "useful"


def test_training_scores_and_storage(learnable, tmp_path):
    trained, report = models.train(learnable, "y", FEATURES, models.TrainSpec("logistic_regression"))
    assert trained.classes == [-1, 0, 1]
    accuracy = report.filter("part = 'test' AND metric = 'accuracy'").collect()[0]["value"]
    assert accuracy > 0.7
    scored = trained.score(learnable)
    total = scored.select((F.col("`probability_-1`") + F.col("probability_0") + F.col("probability_1")).alias("t")).agg(F.min("t"), F.max("t")).collect()[0]
    assert tuple(total) == pytest.approx((1.0, 1.0))
    trained.save(str(tmp_path / "m"))
    again = models.TrainedModel.load(str(tmp_path / "m")).score(learnable).orderBy("symbol", "ts").select("probability_1").toPandas()
    np.testing.assert_allclose(again["probability_1"], scored.orderBy("symbol", "ts").select("probability_1").toPandas()["probability_1"])
    importance = {r["feature"]: r["importance_mean"] for r in models.permutation_importance(trained, learnable, "y", ["symbol", "ts"], repeats=2, group_rows=64).collect()}
    assert max(importance, key=importance.get) == "useful" and importance["useful"] > 0.2


def test_boosting_probabilities(learnable):
    trained = models.fit_model(learnable, "y", FEATURES, models.TrainSpec("xgboost", {"n_estimators": 3}))
    row = trained.score(learnable).select((F.col("`probability_-1`") + F.col("probability_0") + F.col("probability_1")).alias("t")).agg(F.min("t"), F.max("t")).collect()[0]
    assert tuple(row) == pytest.approx((1.0, 1.0))


def test_registry_and_search_space():
    with pytest.raises(ValueError):
        models.create_model("nope")
    with pytest.raises(ValueError):
        models.create_model("random_forest", {"bogus": 1})
    assert models.search_points({"a": [1, 2], "b": [3]}, "grid") == [{"a": 1, "b": 3}, {"a": 2, "b": 3}]
    for p in models.search_points({"n": ["int", 10, 20, 5], "c": ["float", 0.1, 10.0, "log"], "k": ["categorical", ["x", "y"]]}, "bayesian", 20):
        assert p["n"] in (10, 15, 20) and 0.1 <= p["c"] <= 10.0 and p["k"] in ("x", "y")


@pytest.mark.parametrize("method", ["isotonic", "sigmoid"])
def test_calibration_is_monotone(spark, method):
    rng = np.random.default_rng(4)
    p = rng.random(3000)
    df = spark.createDataFrame(pd.DataFrame({"y": (rng.random(3000) < p**2).astype(int), "probability_0": 1 - p, "probability_1": p}))
    fixed = models.calibrate(df, (0, 1), "y", method).apply(df.withColumn("raw", F.col("probability_1"))).toPandas().sort_values("raw")
    assert (fixed["probability_1"].diff().dropna() >= -1e-9).all()
    np.testing.assert_allclose(fixed["probability_0"] + fixed["probability_1"], 1.0)
    middle = fixed[(fixed["raw"] > 0.45) & (fixed["raw"] < 0.55)]["probability_1"].mean()
    assert abs(middle - 0.25) < 0.08


def plain_adf_t(x, lag):
    d = np.diff(x)
    y = d[lag:]
    cols = [x[lag:-1], *[d[lag - j : len(d) - j] for j in range(1, lag + 1)], np.ones(len(y))]
    a = np.column_stack(cols)
    beta, *_ = np.linalg.lstsq(a, y, rcond=None)
    rest = y - a @ beta
    cov = rest @ rest / (len(y) - a.shape[1]) * np.linalg.inv(a.T @ a)
    return beta[0] / np.sqrt(cov[0, 0])


def test_adf_matches_a_direct_regression():
    rng = np.random.default_rng(9)
    x = np.cumsum(rng.normal(size=(6, 100)), axis=1)
    for lag in (0, 3):
        y = np.diff(x, axis=1)[:, lag:]
        cols = [x[:, lag:-1], *[np.diff(x, axis=1)[:, lag - j : 99 - j] for j in range(1, lag + 1)]]
        t = statistics._regress(y, np.stack(cols, axis=2))[1]
        np.testing.assert_allclose(t, [plain_adf_t(row, lag) for row in x], rtol=1e-6)
    assert statistics.adf_p(rng.normal(size=(4, 100))).max() < 0.01
    assert statistics.adf_p(x).mean() > 0.1
    assert np.isnan(statistics.adf_p(np.ones((1, 100)))[0])
    np.testing.assert_allclose(statistics.mackinnon_p(np.array([-2.86, -3.43])), [0.0502, 0.0101], atol=1e-3)


def test_rolling_tests_per_chunk(bars, sorted_rows):
    whole = sorted_rows(statistics.rolling_adf(bars, window=60))
    cut = sorted_rows(statistics.rolling_adf(bars, window=60, chunk_rows=128))
    np.testing.assert_allclose(whole["adf_pvalue"], cut["adf_pvalue"])
    assert whole[whole["symbol"] == "TINY"]["adf_pvalue"].isna().all()
    t = sorted_rows(statistics.dickey_fuller_t(bars, window=60))
    x = whole[whole["symbol"] == "MID"]["close"].to_numpy()
    got = t[t["symbol"] == "MID"]["df_t"].to_numpy()
    assert got[59] == pytest.approx(plain_adf_t(x[:60], 0)) and got[200] == pytest.approx(plain_adf_t(x[141:201], 0))


def test_garch_follows_the_true_volatility(spark):
    rng = np.random.default_rng(6)
    n, a, b, w = 1500, 0.12, 0.8, 0.08
    v, r = np.empty(n), np.empty(n)
    v[0] = 1.0
    for i in range(n):
        if i:
            v[i] = w + a * r[i - 1] ** 2 + b * v[i - 1]
        r[i] = np.sqrt(v[i]) * rng.normal()
    close = 100 * np.cumprod(1 + r / 100)
    df = spark.createDataFrame(pd.DataFrame({"symbol": "G", "ts": pd.date_range("2019-01-01", periods=n), "close": close}))
    got = statistics.garch_volatility(df).toPandas().sort_values("ts")["garch_vol"].to_numpy()
    assert np.isnan(got[0])
    assert np.corrcoef(got[50:], np.sqrt(v[50:]))[0, 1] > 0.9


def test_regimes(spark):
    rng = np.random.default_rng(8)
    group = np.repeat([0, 1, 2], 40)
    x = rng.normal(size=(120, 2)) * 0.1 + np.column_stack([group * 5, -group * 3])
    df = spark.createDataFrame(pd.DataFrame({"symbol": "S", "ts": pd.date_range("2022-01-01", periods=120), "a": x[:, 0], "b": x[:, 1]}))
    model = regimes.fit_regimes(df, ["a", "b"])
    out = regimes.assign_regimes(df, model, ["a", "b"]).toPandas().sort_values("ts")
    assert out.groupby(group)["regime"].nunique().tolist() == [1, 1, 1] and out["regime"].nunique() == 3
    assert out["confidence"].between(0, 1).all()
    assert regimes.assign_regimes(df.limit(30), model, ["a", "b"]).count() == 0


def plain_folds(n, train, test, step, rolling):
    s, e, out = 0, train, []
    while e + test <= n:
        out.append((s, e, e, e + test))
        e += step
        s += step if rolling else 0
    return out


@pytest.mark.parametrize("rolling", [True, False])
@pytest.mark.parametrize("sizes", [(100, 40, 30), (60, 20, 50), (200, 30, 30)])
def test_folds(bars, rolling, sizes):
    folds = walkforward.Folds(*sizes, rolling=rolling, retrain_every=3)
    table = walkforward.fold_table(bars, folds).collect()
    members = {role: walkforward.fold_rows(bars, folds, role).groupBy("symbol", "fold").agg(F.min("rn").alias("a"), F.max("rn").alias("b"), F.count(F.lit(1)).alias("n")).collect() for role in ("train", "test")}
    for symbol, n in (("HOT", 700), ("MID", 230), ("TINY", 9)):
        want = plain_folds(n, *sizes, rolling)
        got = sorted((r["fold"], r["train_lo"], r["train_hi"], r["test_lo"], r["test_hi"], r["model_fold"]) for r in table if r["symbol"] == symbol)
        assert got == [(i + 1, *w, i - i % 3 + 1) for i, w in enumerate(want)]
        for role, (lo, hi) in (("train", (0, 1)), ("test", (2, 3))):
            seen = sorted((r["fold"], r["a"], r["b"], r["n"]) for r in members[role] if r["symbol"] == symbol)
            assert seen == [(i + 1, w[lo], w[hi] - 1, w[hi] - w[lo]) for i, w in enumerate(want)]
    with pytest.raises(ValueError):
        walkforward.Folds(retrain_every=0)


def _points(spark, n=60, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, 2))
    y = (x[:, 0] + rng.normal(0, 1.2, n) > 0.6).astype(float)
    df = spark.createDataFrame(pd.DataFrame({models.LABEL: y, "a": x[:, 0], "b": x[:, 1]}))
    return models.assemble(models.balanced_weights(df), ["a", "b"]), x, y


def _newton(x, y, w, l2):
    """Weighted logistic regression, intercept free, penalty l2 / 2 * |coefficients|^2 on the summed loss."""
    z, beta = np.column_stack([x, np.ones(len(x))]), np.zeros(3)
    pen = np.diag([l2, l2, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ beta))
        beta -= np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + pen, z.T @ (w * (p - y)) + pen @ beta)
    return beta


@pytest.mark.parametrize(("params", "l2", "balanced"), [({"penalty": "none"}, 0.0, False), ({"C": 0.1}, 10.0, False), ({}, 1.0, False), ({"class_weight": "balanced", "penalty": "none"}, 0.0, True)])
def test_logistic_options_mean_what_they_say(spark, params, l2, balanced):
    ready, x, y = _points(spark)
    model = models.create_model("logistic_regression", {**params, "tol": 1e-10}, 2, 2, len(y)).fit(ready)
    w = len(y) / (2 * np.where(y == 1, y.sum(), len(y) - y.sum())) if balanced else np.ones(len(y))
    want = _newton(x, y, w, l2)
    np.testing.assert_allclose([*model.coefficients, model.intercept], want, rtol=1e-4, atol=1e-5)


def test_model_defaults_and_counterparts():
    forest = models.create_model("random_forest")
    assert (forest.getNumTrees(), forest.getMaxDepth(), forest.getWeightCol()) == (200, 30, models.WEIGHT)
    assert not models.create_model("random_forest", {"class_weight": None, "max_features": None, "max_depth": 4}).isSet("weightCol")
    light, wide = models.create_model("lightgbm").spec, models.create_model("lightgbm", {"num_leaves": 63, "max_depth": 5}).spec
    assert (light.leaves, light.depth, light.rounds, light.min_rows) == (31, None, 100, 20) and (wide.leaves, wide.depth) == (63, 5)
    assert models.create_model("xgboost", {"colsample_bytree": 0.9, "gamma": 0.2}, 3, 10).spec.columns == 0.9
    assert models.create_model("gradient_boosting", {"max_features": "sqrt", "max_depth": None}, 2, 16).spec.columns == 0.25
    even = models.create_model("catboost", {"l2_leaf_reg": 7, "verbose": False}).spec
    assert (even.symmetric, even.depth, even.l2) == (True, 6, 7) and models.create_model("gradient_boosting", {"min_samples_split": 9}).spec.min_split_rows == 9
    network = models.create_model("neural_network", {"learning_rate": 0.05, "activation": "sigmoid"}, 3, 4)
    assert (network.getSolver(), network.getStepSize(), network.getLayers()) == ("gd", 0.05, [4, 64, 32, 3])
    for name, bad in (("neural_network", "momentum"), ("catboost", "bogus"), ("random_forest", "min_samples_split")):
        with pytest.raises(ValueError, match=bad):
            models.create_model(name, {bad: 1})
    assert len(models.search_points(models.DEFAULT_GRIDS["random_forest"], "grid")) == 216


def test_folds_and_scores_do_not_depend_on_partitions(spark):
    ready, _, _ = _points(spark, 120)
    found = [models.tune(ready.repartition(n), "logistic_regression", {"C": [0.01, 1.0, 100.0]}, "grid", 2, 2, folds=3) for n in (1, 5)]
    assert [p for p, _ in found[0][1]] == [p for p, _ in found[1][1]]
    np.testing.assert_allclose([s for _, s in found[0][1]], [s for _, s in found[1][1]], atol=1e-9)


def test_the_learning_search_comes_closer_than_its_start():
    import random

    space = {"x": ["float", 0.0001, 10.0, "log"], "k": ["int", 1, 40], "c": ["categorical", ["a", "b", "c"]]}

    def value(p):
        return -abs(np.log(p["x"] / 0.3)) - abs(p["k"] - 30) / 10 - (p["c"] != "b")

    gains = []
    for seed in range(8):
        results = [(p, value(p)) for p in models.search_points(space, "random", 8, seed)]
        first, rng = max(v for _, v in results), random.Random(seed)
        for _ in range(32):
            p = models.next_point(space, results, rng)
            assert 0.0001 <= p["x"] <= 10 and 1 <= p["k"] <= 40 and p["c"] in "abc"
            results.append((p, value(p)))
        blind = max(value(p) for p in models.search_points(space, "random", 40, seed))
        gains.append((max(v for _, v in results) - first, max(v for _, v in results) - blind))
    assert all(g >= 0 for g, _ in gains) and np.mean([b for _, b in gains]) > 0


def test_importance_of_boosted_trees_is_their_share_of_gains(learnable):
    three = learnable.withColumn("y", F.when(F.col("useful") > 0.5, 2).when(F.col("useful") > -0.5, 1).otherwise(0))
    trained = models.fit_model(three, "y", FEATURES, models.TrainSpec("gradient_boosting", {"n_estimators": 2, "max_depth": 2}))
    total = dict.fromkeys(range(3), 0.0)
    for trees in trained.model.parts[0]:
        for feature, _, _, _, gain in (node for tree in trees for node in tree):
            if feature >= 0:
                total[feature] += gain
    assert models.importances(trained) == pytest.approx([v / sum(total.values()) for v in total.values()])
    found = models.built_in_importance(trained).collect()
    assert found[0].feature == "useful" and sum(r.importance for r in found) == pytest.approx(1)


def test_a_network_is_judged_by_exchanging_values(learnable):
    trained = models.fit_model(learnable, "y", FEATURES, models.TrainSpec("neural_network", {"epochs": 30, "hidden_layers": (4,)}))
    with pytest.raises(ValueError, match="no built-in"):
        models.built_in_importance(trained)
    ident = [c for c in learnable.columns if c not in FEATURES and c != "y"][:1] or FEATURES[:1]
    assert models.built_in_importance(trained, learnable, "y", ident).first()["feature"] == "useful"
