import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tickloom.operators import logistic, models
from tickloom.plans.storage import cut


@pytest.fixture(scope="module", params=[2, 3])
def table(spark, request):
    rng = np.random.default_rng(request.param)
    x = rng.normal(size=(400, 3))
    score = np.stack([x[:, 0], 0.7 * x[:, 1] + 0.4, -x[:, 2]], axis=1)[:, : request.param]
    y = (score + rng.gumbel(size=score.shape)).argmax(axis=1)
    df = spark.createDataFrame([(int(k), i % 3, *map(float, r)) for i, (k, r) in enumerate(zip(y, x, strict=True))], "label int, fold int, a double, b double, c double")
    return request.param, cut(VectorAssembler(inputCols=["a", "b", "c"], outputCol="f").transform(df.repartition(4)))


def test_coefficients_are_those_of_single_fits(table):
    """Every penalty and left-out fold, one job an iteration for all of them."""
    k, df = table
    fits = [logistic.Fit(c, f) for c in (0.01, 1.0, 100.0, None) for f in (None, 0, 2)]
    found = logistic.fit_many(df.withColumn("x", F.array("a", "b", "c")), k, 3, fits)
    for fit, theta in zip(fits, found, strict=True):
        rows = df if fit.without is None else df.where(F.col("fold") != fit.without)
        strength = 0.0 if fit.c is None else 1 / (fit.c * rows.count())
        alone = LogisticRegression(featuresCol="f", labelCol="label", regParam=strength, standardization=False, maxIter=500, tol=1e-10).fit(rows)
        want = np.concatenate([alone.coefficientMatrix.toArray(), alone.interceptVector.toArray()[:, None]], axis=1)
        np.testing.assert_allclose(theta, want, rtol=2e-4, atol=2e-5)


def test_search_scores_are_those_of_single_fits(table, monkeypatch):
    k, df = table
    ready = df.select(F.col("label").cast("double").alias(models.LABEL), F.col("f").alias(models.FEATURES), F.lit(1.0).alias(models.WEIGHT))
    best, results = models.tune(ready, "logistic_regression", {"C": [0.001, 0.1, 10.0]}, "grid", k, 3, folds=3)
    monkeypatch.setattr(models, "_ridge", lambda params: False)
    same, alone = models.tune(ready, "logistic_regression", {"C": [0.001, 0.1, 10.0]}, "grid", k, 3, folds=3)
    assert best == same
    assert [s for _, s in results] == pytest.approx([s for _, s in alone], abs=1e-9)


def test_boosted_points_are_searched_side_by_side(table):
    k, df = table
    ready = df.select(F.col("label").cast("double").alias(models.LABEL), F.col("f").alias(models.FEATURES), F.lit(1.0).alias(models.WEIGHT))
    space = {"n_estimators": [1, 4], "max_depth": [1, 2]}
    best, results = models.tune(ready, "gradient_boosting", space, "grid", k, 3, folds=2)
    scores = {(p["n_estimators"], p["max_depth"]): s for p, s in results}
    assert len(scores) == 4 and best == {"n_estimators": 4, "max_depth": max((1, 2), key=lambda d: scores[4, d])}
    assert all(scores[4, d] > scores[1, d] for d in (1, 2))


def test_a_bayesian_search_fits_no_point_twice(table, monkeypatch):
    """Two possible points and two folds make four fits, however many points are tried."""
    k, df = table
    ready = df.select(F.col("label").cast("double").alias(models.LABEL), F.col("f").alias(models.FEATURES), F.lit(1.0).alias(models.WEIGHT))
    made, create = [], models.create_model
    monkeypatch.setattr(models, "create_model", lambda name, params, *args: made.append(params["max_depth"]) or create(name, params, *args))
    fixed = {"n_estimators": 2, "max_features": None}
    best, results = models.tune(ready, "random_forest", {"max_depth": ["int", 1, 2]}, "bayesian", k, 3, n_iter=5, folds=2, fixed=fixed)
    assert len(results) == 5 and len({s for _, s in results}) == len({p["max_depth"] for p, _ in results})
    assert sorted(made) == sorted(2 * list({p["max_depth"] for p, _ in results}))
    assert best == max(results, key=lambda r: r[1])[0]
