"""Forecasts of the next z-score with pyspark.ml pipelines."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.feature import Imputer, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basisweave.operators.experiments import moments, ridge, with_constant, with_fits
from basisweave.operators.metrics import forecast_metrics
from basisweave.sources.files import kept

FEATURES = ("zscore", "zscore_lag1", "zscore_lag2", "zscore_lag3", "spread_bps")


def dataset(sig: DataFrame) -> DataFrame:
    return sig.where("target is not null").select("window_id", "coin", "pair", "snapshot_idx", "target", *FEATURES)


def pipeline(regressor) -> Pipeline:
    """Frozen categories with unseen ones kept, medians for missing values, one vector."""
    filled = [f"{c}_f" for c in FEATURES]
    return Pipeline(stages=[StringIndexer(inputCol="pair", outputCol="pair_i", handleInvalid="keep"), Imputer(inputCols=list(FEATURES), outputCols=filled, strategy="median"), VectorAssembler(inputCols=[*filled, "pair_i"], outputCol="features", handleInvalid="keep"), regressor])


def evaluate(pred: DataFrame, name: str) -> DataFrame:
    out = pred.groupBy("window_id").agg(*forecast_metrics(F.col("prediction"), F.col("target")))
    return out.select(F.lit(name).alias("model"), "window_id", "n", *(F.round(c, 4).alias(c) for c in ("mae", "rmse", "r2", "dir_acc", "corr")))


def boosted_forecast(sig: DataFrame) -> DataFrame:
    """Trees boosted on the first run with its last 15 % as validation, scored on both, beside naive persistence."""
    data = dataset(sig)
    first = data.where("window_id = 'w1'")
    # The 85 % mark of time as a number, so that no task ranks a whole run.
    mark = first.agg(F.expr("percentile(snapshot_idx, 0.85)")).first()[0]
    train = first.withColumn("val", F.col("snapshot_idx") >= F.lit(mark))
    model = pipeline(GBTRegressor(labelCol="target", maxIter=49, maxDepth=3, maxBins=32, seed=7, validationIndicatorCol="val")).fit(train)
    naive = evaluate(data.where("zscore is not null").withColumn("prediction", F.col("zscore")), "persistence")
    return evaluate(model.transform(data), "boosted").unionByName(naive)


def forest_forecast(sig: DataFrame) -> DataFrame:
    data = dataset(sig)
    model = pipeline(RandomForestRegressor(labelCol="target", numTrees=400, maxDepth=5, maxBins=32, seed=7)).fit(data.where("window_id = 'w1'"))
    return evaluate(model.transform(data), "forest")


def walk_forward(sig: DataFrame, folds: int) -> DataFrame:
    """Expanding folds by time: fit on all complete rows before a fold, scored on it; without rows there are no folds.

    The rows are evaluated and written once. One aggregate gives the moments of every part and pair; a fold's are the sum of
    those before it, its pairs numbered by their rows there, as an indexer would (the most first, unseen ones last), and one
    more pass scores all folds. So the number of folds multiplies neither scans nor shuffles."""
    data = kept(dataset(sig).dropna(subset=list(FEATURES)), "walk-forward")
    lo, hi = data.agg(F.min("snapshot_idx"), F.max("snapshot_idx")).first()
    if lo is None or hi - lo <= folds:
        return sig.sparkSession.createDataFrame([], "fold int, n long, mae double, r2 double, dir_acc double")
    starts = [lo + (hi + 1 - lo) * k // (folds + 1) for k in range(1, folds + 1)]
    part = sum(((F.col("snapshot_idx") >= s).cast("int") for s in starts), F.lit(0))
    rows = data.withColumn("fold", part)
    own = moments(rows, ["fold", "pair"], FEATURES, "target")
    names, fits = sorted({pair for _, pair in own}), {}
    for k in range(1, folds + 1):
        before = {name: sum((m for (f, pair), m in own.items() if f < k and pair == name), np.zeros((len(FEATURES) + 2,) * 2)) for name in names}
        seen = sorted((name for name in names if before[name][0, 0]), key=lambda name: (-before[name][0, 0], name))
        index = {name: seen.index(name) if name in seen else len(seen) for name in names}
        beta = ridge(sum(with_constant(before[name], float(index[name])) for name in names))
        fits |= {(k, name): np.append(beta[0] + beta[-1] * index[name], beta[1:-1]) for name in names}
    scored = with_fits(rows.where("fold > 0"), ["fold", "pair"], FEATURES, fits)
    found = scored.groupBy("fold").agg(*forecast_metrics(F.col("pred"), F.col("target")))
    every = sig.sparkSession.range(1, folds + 1).select(F.col("id").cast("int").alias("fold"))
    return every.join(found, "fold", "left").select("fold", F.coalesce("n", F.lit(0)).alias("n"), *(F.round(c, 4).alias(c) for c in ("mae", "r2", "dir_acc")))
