import bisect
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from basisweave.sources import venue
from basisweave.functions import exprs
from basisweave.operators import backtest, books, joins, metrics, series, stats


@pytest.fixture(scope="module")
def walk(spark):
    rng = random.Random(42)
    rows, x = [], {}
    for t in range(400):
        for pair in ("p", "q"):
            x[pair] = 0.85 * x.get(pair, 0.0) + 10 * rng.gauss(0, 1)
            if rng.random() > 0.05:
                rows.append(("w1", "C0", pair, t, x[pair]))
    return spark.createDataFrame(rows, "window_id string, coin string, pair string, snapshot_idx int, spread_bps double").cache()


def test_prefix_sums_equal_the_frame(walk):
    z = walk.withColumn("a", series.rolling_z(F.col("spread_bps"), series.frame(w=60), 18))
    both = series.prefix_rolling_z(z, "spread_bps", w=60, min_periods=18, out="b").collect()
    assert all((r.a is None) == (r.b is None) and (r.a is None or abs(r.a - r.b) < 1e-8) for r in both)


def test_hysteresis_equals_a_loop(walk):
    z = walk.withColumn("zscore", series.rolling_z(F.col("spread_bps"), series.frame(w=20), 6))
    got = {(r.pair, r.entry, r.exit, r.direction, r.reason) for r in backtest.hysteresis(z, series.KEYS, entry=1.5, exit=0.5, max_hold=8, cooldown=3).collect()}
    want = set()
    for pair in ("p", "q"):
        d, t0, free = 0, 0, -1
        for r in sorted((r for r in z.collect() if r.pair == pair and r.zscore is not None), key=lambda r: r.snapshot_idx):
            t = r.snapshot_idx
            if d:
                back = r.zscore >= -0.5 if d == 1 else r.zscore <= 0.5
                if back or t - t0 >= 8:
                    want.add((pair, t0, t, d, "signal" if back else "timeout"))
                    d, free = 0, t + 1 + 3
            elif abs(r.zscore) >= 1.5 and t >= free:
                d, t0 = (-1 if r.zscore > 0 else 1), t
    assert got == want and got


def test_asof_against_bisect(spark):
    rng = random.Random(1)
    right = sorted({(k, rng.randrange(500)) for k in "ab" for _ in range(60)})
    left = [(i, rng.choice("abc"), rng.randrange(520)) for i in range(300)]
    l = spark.createDataFrame(left, "id int, k string, t long")  # noqa: E741
    r = spark.createDataFrame([(k, t, float(t)) for k, t in right], "k string, t long, v double")
    for tol in (None, 5):
        got = {x.id: x.v_asof for x in joins.asof(l, r, ["k"], "t", ["v"], tolerance=tol).collect()}
        for i, k, t in left:
            own = [b for a, b in right if a == k]
            at = bisect.bisect_right(own, t) - 1
            want = float(own[at]) if at >= 0 and (tol is None or t - own[at] <= tol) else None
            assert got[i] == want


def test_global_rank_is_a_row_number(spark):
    df = spark.range(5000).withColumn("v", F.pmod(F.xxhash64("id"), F.lit(997)))
    got = sorted((r.rank, r.v, r.id) for r in metrics.global_rank(df, [F.desc("v"), F.col("id")]).collect())
    assert [r[0] for r in got] == list(range(1, 5001)) and got == sorted(got, key=lambda r: (-r[1], r[2]))


def test_equity_ends_at_the_sum_of_gains_when_flat(spark):
    trades = spark.createDataFrame([("w1", "C", "p", 1, 3, 1, 2.0), ("w1", "C", "p", 4, 6, -1, -0.5)], "window_id string, coin string, pair string, entry_snap int, exit_snap int, direction int, pnl double")
    marks = spark.createDataFrame([("w1", "C", "p", t, float(t)) for t in range(5)], "window_id string, coin string, pair string, snapshot_idx int, zscore double")
    path = sorted(books.equity_path(trades, marks).collect(), key=lambda r: r.bar)
    assert path[-1].bar == 6 and path[-1].equity == 1.5 and path[-1].n_open == 0
    assert abs(sum(r.delta for r in path) - 1.5) < 1e-9


def test_book_walk_and_calibration(spark):
    df = spark.createDataFrame([([(1.0, 10.0), (2.0, 10.0)],)], "asks array<struct<price:double,qty:double>>")
    got = df.select(books.walk_book(F.col("asks"), 20.0).alias("a"), books.walk_book(F.col("asks"), 40.0).alias("b"), books.slippage_bps(F.col("asks"), 5.0).alias("c")).first()
    assert abs(got.a - 20 / 15) < 1e-9 and got.b is None and got.c == 0
    v = spark.createDataFrame([(x,) for x in (-1.0, 0.5, 1.5, 9.0, None)], "x double").select(books.calibrate(F.col("x"), [(0.0, 0.0), (1.0, 10.0), (2.0, 30.0)]).alias("y"))
    assert [r.y for r in v.collect()] == [0.0, 5.0, 20.0, 30.0, None]


def test_ou_and_unit_root(spark, walk):
    fit = {r.pair: r for r in stats.ou_fit(walk, "spread_bps", ["pair"], "snapshot_idx").collect()}
    assert all(0.7 < r.phi < 0.95 for r in fit.values())
    assert all(r.stationary for r in stats.adf(walk, "spread_bps", ["pair"], "snapshot_idx").collect())
    rng = np.random.default_rng(3)
    stat, _, _ = stats.adf_statistic(np.cumsum(rng.normal(size=400)))
    assert stat > -2.86


def test_benjamini_hochberg_known_answer(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.5]
    got = {r.p: r.q for r in series.benjamini_hochberg(spark.createDataFrame([(v,) for v in p], "p double"), "p").collect()}
    assert {k: round(v, 6) for k, v in got.items()} == {0.005: 0.025, 0.01: 0.025, 0.03: 0.05, 0.04: 0.05, 0.5: 0.5}


def test_bootstrap_repeats_on_any_partitioning(spark):
    df = spark.range(300).select((F.col("id") % 2).alias("k"), "id", (F.col("id") % 13).cast("double").alias("v"))
    a, b = (sorted(map(tuple, stats.bootstrap(d, "v", ["k"], 50).collect())) for d in (df.repartition(2), df.repartition(5)))
    assert a == b and all(r[2] <= r[3] <= r[4] for r in a)


def test_zero_denominators_are_null(spark):
    row = spark.createDataFrame([(0.0, 0.0)], "a double, b double").select(*(exprs.spread_bps(F.col("a"), F.col("b"), c).alias(c) for c in ("signed", "absolute", "range", "percent"))).first()
    assert all(v is None for v in row)


def test_bootstrap_draws_equal_rows_each_for_itself(spark):
    """Ties must not narrow or widen the interval: half zeros, half ones, against the binomial's deviation."""
    rows = spark.createDataFrame([("k", float(i % 2)) for i in range(400)], "key string, v double")
    got = stats.bootstrap(rows, "v", ["key"], 400).first()
    assert got.reps == 400 and 0.43 < got.lo < 0.47 < got.median < 0.53 < got.hi < 0.57


def test_global_rank_numbers_every_row_once(spark):
    rows = spark.range(5000).selectExpr("(id * 7919) % 5003 AS v")
    got = metrics.global_rank(rows, [F.col("v")]).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 5001)) and all(a.v <= b.v for a, b in zip(got, got[1:]))


def test_snapshots_shrink_as_ticks_grow(spark):
    """The grid grows with the data: the cells hold about the same number of ticks."""
    small, large = (venue.bucket_of(spark, f"/root/testdata/sf{k}") for k in ("0.01", "0.1"))
    assert small == venue.BUCKET and large * 10 == small


def test_johansen_equals_residual_regressions(spark):
    rng = np.random.default_rng(3)
    common = rng.normal(size=150).cumsum()
    a, b = 5 + common + rng.normal(size=150) * 0.3, 2 + 0.5 * common + rng.normal(size=150) * 0.3
    data = [("k", i, float(a[i]), float(b[i])) for i in range(150)] + [("short", i, float(i), 1.0) for i in range(5)] + [("flat", i, 1.0, float(a[i])) for i in range(40)] + [("k", 150, None, 1.0)]
    got = {r["key"]: r for r in stats.johansen(spark.createDataFrame(data, "key string, at int, a double, b double"), ("a", "b"), ["key"], "at").collect()}
    y = np.column_stack([a, b])
    dy = np.diff(y, axis=0)
    z = np.column_stack([np.ones(148), dy[:-1]])
    r0, r1 = (m - z @ np.linalg.lstsq(z, m, rcond=None)[0] for m in (dy[1:], y[1:-1]))
    s00, s01, s11 = r0.T @ r0, r0.T @ r1, r1.T @ r1
    lam = np.sort(np.linalg.eigvals(np.linalg.solve(s11, s01.T) @ np.linalg.solve(s00, s01)).real)[::-1]
    assert got["k"]["n"] == 148 and got["k"]["trace_0"] == pytest.approx(-148 * np.log(1 - lam).sum(), rel=1e-6)
    assert got["k"]["trace_1"] == pytest.approx(-148 * np.log(1 - lam[1]), rel=1e-6) and got["k"]["rank_trace"] >= 1
    assert got["short"]["trace_0"] is None and got["flat"]["rank_max"] is None


def test_engle_granger_both_keeps_the_lower_statistic(spark):
    rng = np.random.default_rng(5)
    x = 100 + rng.normal(size=120).cumsum() * 0.5
    y = 50 + 0.4 * x + rng.normal(size=120)
    df = spark.createDataFrame([("k", i, float(y[i]), float(x[i])) for i in range(120)], "key string, at int, a double, b double")
    best = stats.engle_granger_both(df, ["key"], "at", "a", "b").first()

    def one(u, v):
        slope, base = np.polyfit(np.log(v), np.log(u), 1)
        return stats.adf_statistic(np.log(u) - base - slope * np.log(v))[0]

    found = {"a_on_b": one(y, x), "b_on_a": one(x, y)}
    assert best["adf_stat"] == pytest.approx(min(found.values()), rel=1e-6) and best["direction"] == min(found, key=found.get)


def test_asof_over_seams(spark):
    """Cut into chunks, long silences and chunks without a right row among them, it finds what one sorted pass finds."""
    rng = np.random.default_rng(8)
    left = [(f"k{rng.integers(3)}", int(t), int(i)) for i, t in enumerate(rng.integers(0, 2000, 300))]
    right = [(f"k{rng.integers(4)}", int(t), float(v)) for t, v in zip(rng.choice([*range(50), *range(600, 900), 1999], 120), rng.normal(size=120))]
    l, r = spark.createDataFrame(left, "k string, t long, i long"), spark.createDataFrame(right, "k string, t long, v double")  # noqa: E741
    want = sorted((i, k, max(((s, v) for q, s, v in right if q == k and s <= t), default=(None, None))[::-1]) for k, t, i in left)
    for chunk in (None, 10, 700, 10_000):
        got = joins.asof(l.repartition(3), r.repartition(3), ["k"], "t", ["v"], chunk=chunk)
        assert sorted((x.i, x.k, (x.v_asof, x.t_asof)) for x in got.collect()) == want
    near = {x.i: x.v_asof for x in joins.asof(l, r, ["k"], "t", ["v"], tolerance=20, chunk=50).collect()}
    assert near == {i: v if s is not None and t - s <= 20 else None for (i, _, (v, s)), t in ((w, next(t for _, t, i in left if i == w[0])) for w in want)}


def test_poisson_weights_have_mean_and_variance_one():
    w = stats.poisson_weights(np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 400), 500)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.03
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.2 and abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.2


def test_area_under_curve_against_pairs(spark):
    rng = np.random.default_rng(5)
    rows = [(f"g{k % 2}", float(rng.integers(0, 12)), float(rng.integers(0, 2))) for k in range(200)] + [("one", 0.5, 1.0), ("one", 0.7, 1.0)]
    got = {r.g: r.auc for r in metrics.area_under_curve(spark.createDataFrame(rows, "g string, s double, l double").repartition(3), "g", "s", "l").collect()}
    for g in ("g0", "g1"):
        pos, neg = ([s for q, s, v in rows if q == g and v == k] for k in (1.0, 0.0))
        assert got[g] == pytest.approx(np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg]))
    assert got["one"] is None


def test_fitted_frame_prunes_and_scales(spark):
    from basisweave.operators.features_frame import fitted_frame

    rng = np.random.default_rng(6)
    y = rng.normal(size=500)
    rows = [(k, bool(k < 400), float(v + rng.normal()) if k % 9 else None, float(v) if k % 2 else None, 1.0, float(v)) for k, v in enumerate(y)]
    df = spark.createDataFrame(rows, "i int, train boolean, good double, sparse double, constant double, target double")
    frame, kept = fitted_frame(df, F.col("train"), ["good", "sparse", "constant"], "target")
    assert kept == ["good"] and frame.columns == ["i", "train", "target", "good"]
    own = [r.good for r in frame.where("train and good is not null").collect()]
    assert np.mean(own) == pytest.approx(0, abs=1e-9) and np.std(own, ddof=1) == pytest.approx(1)
    assert frame.where("good is null").count() == df.where("good is null").count()
    assert fitted_frame(df.where("false"), F.col("train"), ["good"], "target")[1] == []


def test_sources_are_checked_and_marks_stripped(spark, tmp_path):
    from basisweave.sources import files

    with pytest.raises(ValueError, match="price"):
        files.required(spark.range(1), ["id", "price"])
    (tmp_path / "signals.jsonl").write_text('﻿{"a": 1}\n{"a": 2}\n{"a": \n\n')
    (tmp_path / "signals_001.jsonl").write_text('﻿{"a": 3}\n')
    assert sorted(r.a for r in files.read_marked_lines(spark, f"{tmp_path}/signals*.jsonl", "a int").where("a is not null").collect()) == [1, 2, 3]


def test_correlation_of_constants_and_gaps(spark):
    rng = np.random.default_rng(9)
    rows = [("c", 1.0, float(k)) for k in range(5)] + [("one", 1.0, 2.0)] + [("v", None if k % 5 == 0 else float(a), None if k % 7 == 0 else float(a + b)) for k, (a, b) in enumerate(rng.normal(size=(80, 2)))]
    got = {r.k: r.c for r in spark.createDataFrame(rows, "k string, x double, y double").groupBy("k").agg(exprs.corr("x", "y").alias("c")).collect()}
    own = [(x, y) for k, x, y in rows if k == "v" and x is not None and y is not None]
    assert got["c"] is None and got["one"] is None and got["v"] == pytest.approx(np.corrcoef(*zip(*own))[0, 1])


def test_a_fixed_bucket_keeps_earlier_snapshots(spark):
    """With the length given, a longer table repeats the cells that a shorter one has."""
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    small = venue.tickers(spark, "/root/testdata/sf0.001", bucket=7_200)
    assert small.agg(F.max("snapshot_idx")).first()[0] > venue.tickers(spark, "/root/testdata/sf0.001").agg(F.max("snapshot_idx")).first()[0]
    assert small.agg(F.sum("n_ticks")).first()[0] == e.count()
