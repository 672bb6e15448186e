"""Model experiments against numpy on rows in memory."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from basisweave.operators import experiments, panel

FEATURES = ["a_x", "a_y", "b_z"]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    n = 1500
    x = rng.normal(size=(n, 3)) * [1, 5, 0.2] + [0, 10, -3]
    y = 0.5 * x[:, 0] - 0.1 * x[:, 1] + rng.standard_t(3, n)
    return pd.DataFrame({"coin": "C0", "pair": [f"p{k % 5}" for k in range(n)], "snapshot_idx": np.arange(n) // 5 * 3, "group": [f"g{k % 2}" for k in range(n)], **{f: x[:, k] for k, f in enumerate(FEATURES)}, "target": y})


@pytest.fixture(scope="module")
def rows(spark, data):
    return spark.createDataFrame(data).repartition(4)


def ols(d, features=FEATURES):
    return np.linalg.lstsq(np.column_stack([np.ones(len(d)), d[features]]), d["target"], rcond=None)[0]


def test_moments_fit_and_loss(rows, data):
    m = experiments.moments(rows, ["group"], FEATURES, "target")
    for (g,), own in m.items():
        d = data[data.group == g]
        beta = experiments.ridge(own)
        assert beta == pytest.approx(ols(d), abs=1e-8)
        miss = d["target"] - np.column_stack([np.ones(len(d)), d[FEATURES]]) @ beta
        assert experiments.loss(own, beta) == pytest.approx((miss**2).mean())
    whole = m["g0",] + m["g1",]
    assert experiments.ridge(whole) == pytest.approx(ols(data), abs=1e-8)
    x = (data[FEATURES] - data[FEATURES].mean()) / data[FEATURES].std(ddof=0)
    shrunk = np.linalg.solve(x.T @ x / len(x) + 0.3 * np.eye(3), x.T @ (data["target"] - data["target"].mean()) / len(x)) / data[FEATURES].std(ddof=0)
    assert experiments.ridge(whole, 0.3)[1:] == pytest.approx(shrunk.to_numpy())
    penalty, _ = experiments.chosen_ridge(m["g0",], m["g1",])
    losses = {p: experiments.loss(m["g1",], experiments.ridge(m["g0",], p)) for p in (0.0, 1e-3, 1e-2, 0.1, 1.0)}
    assert losses[penalty] == min(losses.values())


def test_constant_feature_and_no_rows(spark, rows):
    m = experiments.moments(rows.withColumn("b_z", F.lit(7.0)), ["group"], FEATURES, "target")["g0",]
    assert experiments.ridge(m)[3] == 0
    assert experiments.moments(rows.where("false"), ["group"], FEATURES, "target") == {}
    assert experiments.ridge(np.zeros((5, 5))).tolist() == [0, 0, 0, 0]
    empty = experiments.with_fits(rows.where("false"), ["group"], FEATURES, {})
    assert empty.count() == 0 and "pred" in empty.columns


def test_snapshot_marks_cut_between_snapshots(rows, data):
    snaps = np.sort(data["snapshot_idx"].unique())
    assert experiments.snapshot_marks(rows, (0.6, 0.8, 1.0)) == [snaps[int(len(snaps) * 0.6)], snaps[int(len(snaps) * 0.8)], 2**31 - 1]
    # Snapshots with many rows count once.
    heavy = rows.unionByName(rows.where("snapshot_idx < 30")).unionByName(rows.where("snapshot_idx < 30"))
    assert experiments.snapshot_marks(heavy, (0.6,)) == experiments.snapshot_marks(rows, (0.6,))


def test_rotation_against_numpy(rows, data):
    roles = experiments.rotation_roles(rows, ["coin", "pair", "snapshot_idx"]).toPandas()
    assert len(roles) == 5 * len(data)
    got = {(r.config, r.role): r for r in experiments.rotation(rows, FEATURES).collect()}
    assert set(got) == {(c, role) for c in "ABCDE" for role in ("val", "test", "forward")}
    forward = {c: set(zip(d.pair, d.snapshot_idx)) for c, d in roles[roles.role == "forward"].groupby("config")}
    assert len({frozenset(f) for f in forward.values()}) == 1
    for c, d in roles.groupby("config"):
        fits = {p: None for p in (0.0, 1e-3, 1e-2, 0.1, 1.0)}
        train, val = d[d.role == "train"], d[d.role == "val"]
        x = (train[FEATURES] - train[FEATURES].mean()) / train[FEATURES].std(ddof=0)
        for p in fits:
            b = np.linalg.solve(x.T @ x / len(x) + p * np.eye(3), x.T @ (train["target"] - train["target"].mean()) / len(x)) / train[FEATURES].std(ddof=0)
            fits[p] = (train["target"].mean() - b @ train[FEATURES].mean(), b)
        best = min(fits, key=lambda p: (((val["target"] - fits[p][0] - val[FEATURES] @ fits[p][1]) ** 2).mean(), p))
        own = d[d.role == "forward"]
        miss = own["target"] - fits[best][0] - own[FEATURES] @ fits[best][1]
        assert got[c, "forward"].rmse == pytest.approx(np.sqrt((miss**2).mean())) and got[c, "forward"].n == len(own)


def test_objectives_against_direct_minimisation(rows, data):
    fits = experiments.objective_fits(rows, ["group"], FEATURES, "target", {"ols": None, "huber": 1.35, "quantile": 0.5}, passes=25)
    assert set(fits) == {(g, o) for g in ("g0", "g1") for o in ("ols", "huber", "quantile")}
    for g in ("g0", "g1"):
        d = data[data.group == g]
        a, y = np.column_stack([np.ones(len(d)), d[FEATURES]]), d["target"].to_numpy()
        assert fits[g, "ols"] == pytest.approx(ols(d), abs=1e-8)
        size = lambda b: np.abs(y - a @ b).mean()
        # No small step in any direction makes the median fit's absolute error less, beyond what the smoothing allows.
        best = size(fits[g, "quantile"])
        rng = np.random.default_rng(1)
        assert best < size(fits[g, "ols"]) and all(size(fits[g, "quantile"] + s * rng.normal(size=4) / np.maximum(1, np.abs(a).max(0))) > best - 1e-4 for s in (0.01, 0.05, 0.2) for _ in range(50))
        b = ols(d)
        for _ in range(25):
            miss = np.abs(y - a @ b)
            w = np.minimum(1, 1.35 * miss.mean() / np.maximum(miss, 1e-6))
            b = np.linalg.solve(a.T @ (w[:, None] * a), a.T @ (w * y))
        assert fits[g, "huber"] == pytest.approx(b, abs=1e-6)
    high = experiments.objective_fits(rows, ["group"], FEATURES, "target", {"quantile": 0.9}, passes=25)
    d = data[data.group == "g0"]
    below = (d["target"] <= np.column_stack([np.ones(len(d)), d[FEATURES]]) @ high["g0", "quantile"]).mean()
    assert below == pytest.approx(0.9, abs=0.02)


def test_horizons_meet_the_exact_snapshot(spark):
    sig = spark.createDataFrame([("k", t, float(t * t)) for t in (0, 1, 2, 4, 5)], "key string, snapshot_idx int, zscore double")
    got = {(r.snapshot_idx, r.horizon, r.kind): r.y for r in experiments.horizon_rows(sig, (1, 2), ["key"], ["zscore"]).collect()}
    level = {(t, h): v for (t, h, kind), v in got.items() if kind == "level"}
    assert level == {(0, 1): 1, (1, 1): 4, (4, 1): 25, (0, 2): 4, (2, 2): 16}
    assert all(got[t, h, "change"] == v - t * t for (t, h), v in level.items())


def test_ablation_by_prefix(rows):
    own = F.col("snapshot_idx")
    out = {(r.kind, r.variant): r for r in experiments.ablation(rows, FEATURES, own < 500, (own >= 500) & (own < 600), own >= 600, rounds=12).collect()}
    assert set(out) == {("nested", "a"), ("nested", "a+b"), ("without", "a"), ("without", "b")}
    assert len({r.rounds for r in out.values()}) == 1 and len({r.n for r in out.values()}) == 1
    assert {k: r.n_features for k, r in out.items()} == {("nested", "a"): 2, ("nested", "a+b"): 3, ("without", "a"): 1, ("without", "b"): 2}
    # The target follows group a alone.
    assert out["nested", "a"].r2 > out["without", "a"].r2 + 0.1 and out["nested", "a"].rmse == out["without", "b"].rmse


def test_sequences_against_a_loop(spark):
    rng = np.random.default_rng(6)
    rows = [("w", "C", p, t, None if rng.random() < 0.2 else float(t), None if rng.random() < 0.3 else float(rng.normal()), None if rng.random() < 0.1 else 1.0) for p in ("p", "q") for t in range(40)]
    df = spark.createDataFrame(rows, "window_id string, coin string, pair string, snapshot_idx int, a double, b double, target double").repartition(3)
    got = {(r.pair, r.snapshot_idx): r for r in panel.sequences(df, ("a", "b"), 5, 3, 0.3).collect()}
    want = {}
    for p in ("p", "q"):
        own = [r for r in rows if r[2] == p]
        for k in range(2, 40, 3):
            steps = [v for r in own[max(0, k - 4) : k + 1] for v in r[4:6]]
            if len(steps) == 10 and own[k][6] is not None and sum(v is None for v in steps) <= 3:
                want[p, k] = steps
    assert set(got) == set(want) and len(want) > 5
    for k, steps in want.items():
        assert got[k].n_missing == sum(v is None for v in steps)
        assert np.allclose(got[k].steps, [np.nan if v is None else v for v in steps], equal_nan=True)
