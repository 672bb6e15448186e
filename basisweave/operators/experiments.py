"""Model experiments over one assembled table: grouped linear fits from moment matrices, splits as columns, ablations of trees.

A linear fit needs its rows' moments alone. One aggregate gives the moment matrix of every split, horizon, target and
feature set at once; the matrices, whose size is the number of features squared, are solved on the driver, and one more
pass scores all fits together. The number of experiments therefore multiplies neither scans nor shuffles."""

from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basisweave.operators.metrics import forecast_metrics, global_rank
from basisweave.sources.files import kept

Group = tuple


def moments(rows: DataFrame, groups: Iterable[str], features: Iterable[str], target: str, weight: Column | None = None) -> dict[Group, np.ndarray]:
    """The weighted moment matrix of (1, features, target) of each group: few groups, features squared numbers each."""
    groups, v = list(groups), [F.lit(1.0), *(F.col(f).cast("double") for f in features), F.col(target).cast("double")]
    w = F.lit(1.0) if weight is None else weight
    upper = [(i, j) for i in range(len(v)) for j in range(i, len(v))]
    sums = rows.groupBy(*groups).agg(F.array(*(F.sum(w * v[i] * v[j]) for i, j in upper)).alias("m"))
    out = {}
    for r in sums.collect():
        m = np.zeros((len(v), len(v)))
        for (i, j), x in zip(upper, r["m"]):
            m[i, j] = m[j, i] = x or 0.0
        out[tuple(r[g] for g in groups)] = m
    return out


def with_constant(m: np.ndarray, value: float) -> np.ndarray:
    """The moments ``m`` of (1, features, target) with a last feature that is ``value`` in all of their rows."""
    out = np.insert(np.insert(m, -1, value * m[0], 0), -1, 0.0, 1)
    out[:, -2] = np.insert(value * m[0], -1, value * value * m[0, 0])
    return out


def ridge(m: np.ndarray, penalty: float = 0.0) -> np.ndarray:
    """(intercept, slopes) of least squares with ``penalty`` on the slopes of standardised features; constant ones get 0."""
    n = m[0, 0]
    if not n:
        return np.zeros(len(m) - 1)
    mean = m[0] / n
    cov = m / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    live = [k for k in range(1, len(m) - 1) if sd[k] > 1e-9 * max(1.0, abs(mean[k]))]
    out = np.zeros(len(m) - 1)
    if live:
        a = cov[np.ix_(live, live)] / np.outer(sd[live], sd[live])
        out[live] = np.linalg.lstsq(a + penalty * np.eye(len(live)), cov[live, -1] / sd[live], rcond=None)[0] / sd[live]
    out[0] = mean[-1] - out[1:] @ mean[1:-1]
    return out


def loss(m: np.ndarray, beta: np.ndarray) -> float:
    """Mean squared error of ``beta`` on rows of which only the moments are known."""
    b = np.append(beta, -1.0)
    return float(b @ m @ b / m[0, 0]) if m[0, 0] else float("inf")


def chosen_ridge(train: np.ndarray, val: np.ndarray, penalties: Iterable[float] = (0.0, 1e-3, 1e-2, 0.1, 1.0)) -> tuple[float, np.ndarray]:
    """The penalty of least validation error (the smaller of equals) and its fit."""
    fits = [(p, ridge(train, p)) for p in penalties]
    return min(fits, key=lambda f: (round(loss(val, f[1]), 12), f[0]))


def with_fits(rows: DataFrame, groups: Iterable[str], features: Iterable[str], fits: dict[Group, np.ndarray], out: str = "pred") -> DataFrame:
    """``rows`` with the prediction of their group's fit; the fits, a row a group, are broadcast."""
    groups, features = list(groups), list(features)
    if not fits:
        return rows.withColumn(out, F.lit(None).cast("double"))
    schema = ", ".join(f"{g} {rows.schema[g].dataType.simpleString()}" for g in groups)
    table = rows.sparkSession.createDataFrame([(*g, [float(x) for x in b]) for g, b in fits.items()], f"{schema}, _beta array<double>")
    beta = F.col("_beta")
    pred = sum((beta[k + 1] * F.col(f) for k, f in enumerate(features)), beta[0])
    return rows.join(F.broadcast(table), groups).withColumn(out, pred).drop("_beta")


def snapshot_marks(rows: DataFrame, shares: Iterable[float], order: str = "snapshot_idx") -> list[int]:
    """The snapshots that the given shares of all distinct ones lie before, by range-sorted ranks: no snapshot is in two parts."""
    distinct = rows.select(order).distinct()
    n = distinct.count()
    ranked = global_rank(distinct, [F.col(order)])
    row = ranked.agg(*(F.min(F.when(F.col("rank") > int(n * s), F.col(order))) for s in shares)).first()
    return [2**31 - 1 if x is None else x for x in row]


def rotation_roles(rows: DataFrame, salt: Iterable[str]) -> DataFrame:
    """Each row once per configuration with its role: train, val, test or forward, the last 15 % of snapshots, which no
    configuration learns from. A and B swap validation and test, C carves validation from the training part's tail,
    D draws it by hash of ``salt`` inside the middle part, E takes that part's first fifth."""
    half, swap, end, tail, fifth = snapshot_marks(rows, (0.5, 0.675, 0.85, 0.4, 0.57))
    t = F.col("snapshot_idx")
    drawn = F.pmod(F.xxhash64(F.lit(42), *salt), F.lit(5)) == 0
    middle = {
        "A": F.when(t < swap, "val").otherwise("test"),
        "B": F.when(t < swap, "test").otherwise("val"),
        "C": F.lit("test"),
        "D": F.when(drawn, "val").otherwise("test"),
        "E": F.when(t < fifth, "val").otherwise("test"),
    }
    early = {c: F.when(t < tail, "train").otherwise("val") if c == "C" else F.lit("train") for c in middle}
    role = lambda c: F.when(t >= end, "forward").when(t >= half, middle[c]).otherwise(early[c])
    return rows.select("*", F.inline(F.array(*(F.struct(F.lit(c).alias("config"), role(c).alias("role")) for c in middle))))


def rotation(rows: DataFrame, features: Iterable[str], target: str = "target", salt: Iterable[str] = ("coin", "pair", "snapshot_idx")) -> DataFrame:
    """Forecast metrics of each configuration's fit on its validation, test and forward rows."""
    features = list(features)
    split = kept(rotation_roles(rows.dropna(subset=[*features, target]), salt), "rotation")
    m = moments(split, ["config", "role"], features, target)
    zero = np.zeros((len(features) + 2,) * 2)
    fits = {(c,): chosen_ridge(m.get((c, "train"), zero), m.get((c, "val"), zero))[1] for c in "ABCDE"}
    scored = with_fits(split.where("role <> 'train'"), ["config"], features, fits)
    return scored.groupBy("config", "role").agg(*forecast_metrics(F.col("pred"), F.col(target)))


def objective_fits(rows: DataFrame, groups: Iterable[str], features: Iterable[str], target: str, objectives: dict[str, float | None], passes: int = 8) -> dict[Group, np.ndarray]:
    """Linear fits of every group and objective by iteratively reweighted least squares, all of them in each pass.

    ``objectives`` names 'ols' (None), 'huber' (its bend in units of the residuals' mean size) and 'quantile' (the level)."""
    groups, features = list(groups), list(features)
    kinds = F.array(*(F.lit(o) for o in objectives))
    long = rows.withColumn("objective", F.explode(kinds))
    start = moments(rows, groups, features, target)
    fits = {(*g, o): ridge(m) for g, m in start.items() for o in objectives}
    reweighted = {k: b for k, b in fits.items() if objectives[k[-1]] is not None}
    for _ in range(passes if reweighted else 0):
        held = with_fits(long, [*groups, "objective"], features, reweighted)
        miss = F.col(target) - F.col("pred")
        size = {tuple(r)[:-1]: r["s"] for r in held.groupBy(*groups, "objective").agg(F.avg(F.abs(miss)).alias("s")).collect()} if "huber" in objectives else {}
        scale = rows.sparkSession.createDataFrame([(*g, float(s or 0.0)) for g, s in size.items()], ", ".join([*(f"{c} {long.schema[c].dataType.simpleString()}" for c in [*groups, "objective"]), "_scale double"])) if size else None
        away = F.greatest(F.abs(miss), F.lit(1e-6))
        weight = F.lit(1.0)
        if scale is not None:
            held = held.join(F.broadcast(scale), [*groups, "objective"])
            weight = F.when(F.col("objective") == "huber", F.least(F.lit(1.0), objectives["huber"] * F.col("_scale") / away)).otherwise(weight)
        if "quantile" in objectives:
            level = objectives["quantile"]
            weight = F.when(F.col("objective") == "quantile", F.when(miss >= 0, level).otherwise(1 - level) / away).otherwise(weight)
        reweighted = {k: ridge(m) for k, m in moments(held, [*groups, "objective"], features, target, weight).items()}
    return fits | reweighted


def horizon_rows(sig: DataFrame, horizons: Iterable[int], keys: Iterable[str], features: Iterable[str]) -> DataFrame:
    """Each row once per horizon whose exact snapshot is there and per target kind: the later z, or the change to it."""
    keys = list(keys)
    wanted = sig.select(*keys, "snapshot_idx", *features, F.explode(F.array(*(F.lit(h) for h in horizons))).alias("horizon")).withColumn("_at", F.col("snapshot_idx") + F.col("horizon"))
    later = sig.select(*keys, F.col("snapshot_idx").alias("_at"), F.col("zscore").alias("_later"))
    met = wanted.join(later, [*keys, "_at"]).dropna(subset=[*features, "_later"]).drop("_at")
    targets = F.array(F.struct(F.lit("level").alias("kind"), F.col("_later").alias("y")), F.struct(F.lit("change").alias("kind"), (F.col("_later") - F.col("zscore")).alias("y")))
    return met.select("*", F.inline(targets)).drop("_later")


def ablation(rows: DataFrame, features: Iterable[str], train: Column, val: Column, test: Column, target: str = "target", rounds: int = 49, depth: int = 3, parallel: int = 4) -> DataFrame:
    """Trees over groups of features, named by the prefix before the first underscore: nested sets, each adding a group, and
    the full set less each group. One early-stopped fit of the full set locks the number of rounds for all.

    The table is assembled and written once; a variant is a slice of its vectors. Independent fits run side by side, and
    all are scored in one pass over the test rows."""
    features = list(features)
    groups: dict[str, list[int]] = {}
    for k, f in enumerate(features):
        groups.setdefault(f.split("_")[0], []).append(k)
    names, full = list(groups), list(range(len(features)))
    variants = [("nested", "+".join(names[: k + 1]), sorted(i for g in names[: k + 1] for i in groups[g])) for k in range(len(names))]
    variants += [("without", g, [i for i in full if i not in groups[g]]) for g in names if len(names) > 1]
    table = VectorAssembler(inputCols=features, outputCol="all", handleInvalid="skip").transform(rows.where(F.col(target).isNotNull()).select(target, *features, train.alias("_train"), val.alias("_val"), test.alias("_test")))
    table = kept(table.select(target, "all", "_train", "_val", "_test"), "assembled")
    learn = table.where("_train or _val")
    booster = GBTRegressor(featuresCol="x", labelCol=target, maxDepth=depth, maxBins=32, stepSize=0.05, validationTol=1e-5, minInstancesPerNode=20, seed=7)
    sliced = lambda df, at: VectorSlicer(inputCol="all", outputCol="x", indices=at).transform(df)
    locked = booster.copy({booster.maxIter: rounds, booster.validationIndicatorCol: "_val"}).fit(sliced(learn, full)).getNumTrees
    fixed = booster.copy({booster.maxIter: locked})
    with ThreadPoolExecutor(parallel) as pool:
        models = list(pool.map(lambda v: fixed.fit(sliced(table.where("_train"), v[2])), variants))
    scored = table.where("_test")
    for k, (model, (_, _, at)) in enumerate(zip(models, variants)):
        scored = model.setPredictionCol(f"_p{k}").transform(sliced(scored, at)).drop("x")
    each = F.array(*(F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("variant"), F.lit(len(at)).alias("n_features"), F.lit(locked).alias("rounds"), F.col(f"_p{k}").alias("pred")) for k, (kind, name, at) in enumerate(variants)))
    return scored.select(target, F.inline(each)).groupBy("kind", "variant", "n_features", "rounds").agg(*forecast_metrics(F.col("pred"), F.col(target)))
