"""Market regimes by clustering standardised features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.columns import quoted, require
from tickloom.plans.series import KEYS, TS, join_on_keys
from tickloom.plans.storage import once

FEATURES = ("volatility_ratio_20_50", "efficiency_ratio_20", "adf_pvalue")
NAMES = ("Regime A", "Regime B", "Regime C")


def standardized(df: DataFrame, features: Sequence[str], keys: Sequence[str], lookback: int) -> DataFrame:
    """Complete rows of keys with at least `lookback` of them, scaled within the key."""
    rows = once(df.na.drop(subset=list(features)))
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, c in enumerate(features):
        aggs += [F.avg(quoted(c)).alias(f"__m{i}"), F.stddev_pop(quoted(c)).alias(f"__s{i}")]
    out = join_on_keys(rows, rows.groupBy(*keys).agg(*aggs), keys).filter(F.col("__n") >= lookback)
    scaled = {}
    for i, c in enumerate(features):
        centred = F.col(quoted(c)) - F.col(f"__m{i}")
        scaled[f"__z{i}"] = F.when(F.col(f"__s{i}") > 0, centred / F.col(f"__s{i}")).otherwise(0.0)
    out = out.withColumns(scaled).drop("__n", *[f"__{p}{i}" for i in range(len(features)) for p in "ms"])
    return VectorAssembler(inputCols=list(scaled), outputCol="__features").transform(out).drop(*scaled)


def fit_regimes(
    df: DataFrame, features: Sequence[str] = FEATURES, n_regimes: int = 3, lookback: int = 60, keys: Sequence[str] = KEYS, seed: int = 42, starts: int = 10
) -> KMeansModel:
    """The tightest of `starts` clusterings."""
    require(df, *features)
    ready = once(standardized(df, features, keys, lookback).select("__features"))
    fits = [KMeans(k=n_regimes, seed=seed + i, featuresCol="__features", predictionCol="regime", initSteps=5, maxIter=100).fit(ready) for i in range(starts)]
    return min(fits, key=lambda m: m.summary.trainingCost)


def assign_regimes(
    df: DataFrame, model: KMeansModel | Sequence[Sequence[float]], features: Sequence[str] = FEATURES, lookback: int = 60, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Regime (the nearest centre's number) and confidence 1 / (1 + distance to it) for every complete row.

    `model` is a fitted clustering or its centres, in standardised features.
    """
    found = model.clusterCenters() if isinstance(model, KMeansModel) else model
    ready = standardized(df, features, keys, lookback).withColumn("__z", vector_to_array("__features"))

    def squared(center: Sequence[float]) -> Column:
        return sum((F.col("__z")[i] - float(x)) * (F.col("__z")[i] - float(x)) for i, x in enumerate(center))

    nearest = F.array_min(F.array(*[F.struct(squared(c).alias("d"), F.lit(k).alias("k")) for k, c in enumerate(found)]))
    ready = ready.withColumn("__near", nearest).withColumn("regime", F.col("__near.k")).withColumn("__d", F.sqrt("__near.d")).drop("__z", "__near")
    distance = F.col("__d")
    names = F.array(*[F.lit(n) for n in NAMES])
    name = F.coalesce(F.try_element_at(names, F.col("regime") + 1), F.concat(F.lit("Regime "), F.col("regime").cast("string")))
    return ready.withColumns({"confidence": 1 / (1 + distance), "regime_name": name}).drop("__features", "__d")


def latest_regime(assigned: DataFrame, features: Sequence[str] = (), keys: Sequence[str] = KEYS) -> DataFrame:
    """Each key's last regime, with the features of that bar."""
    pick = lambda c: F.max_by(quoted(c), TS).alias(c)
    return assigned.groupBy(*keys).agg(pick("regime"), pick("regime_name"), pick("confidence"), F.max(TS).alias(TS), *[pick(c) for c in features])
