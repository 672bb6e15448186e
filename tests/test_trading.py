"""Position rules, books and corrections against loops and numpy."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from basisweave.operators import backtest, books, stats

KEYS = ["window_id", "coin", "pair"]


def walks(n_series=5, n=150, seed=1):
    rng, rows = random.Random(seed), []
    for k in range(n_series):
        s, t = 0.0, 0
        for _ in range(n):
            s = 0.7 * s + rng.gauss(0, 1)
            t += 1 if rng.random() < 0.9 else 3
            rows.append((f"w{k % 2}", "C0", f"p{k}", t, s if rng.random() < 0.95 else None, 100 * s))
    return rows


@pytest.fixture(scope="module")
def signals(spark):
    return spark.createDataFrame(walks(), "window_id string, coin string, pair string, snapshot_idx int, zscore double, spread_bps double").repartition(3)


def loop(bars, entry, exit, hold, wait):
    d, out, free = 0, [], -(10**9)
    for t, z, s in bars:
        if z is None:
            continue
        if d:
            back = z >= -exit if d == 1 else z <= exit
            if back or t - t0 >= hold:
                out.append((t0, t, d, s0, s, "signal" if back else "timeout"))
                d, free = 0, t + 1 + wait
        elif abs(z) >= entry and t >= free:
            d, t0, s0 = (-1 if z > 0 else 1), t, s
    return out


def test_grid_and_fold_against_a_loop(spark, signals):
    grid = backtest.grid(spark, (0.8, 1.5), (0.0, 0.5), (3, 12), (0, 4))
    got = {}
    for r in backtest.hysteresis_grid(signals, KEYS, grid).collect():
        got.setdefault((r.pair, r.combo), []).append((r.entry, r.exit, r.direction, r.entry_spread, r.exit_spread, r.reason))
        assert r.gross_bps == pytest.approx(r.direction * (r.exit_spread - r.entry_spread)) and r.hold == r.exit - r.entry
    series = {}
    for _, _, pair, t, z, s in walks():
        series.setdefault(pair, []).append((t, z, s))
    combos = grid.collect()
    want = {(p, c.combo): out for p, bars in series.items() for c in combos if (out := loop(bars, c.entry_z, c.exit_z, c.max_hold, c.cooldown))}
    assert {k: sorted(v) for k, v in got.items()} == want and len(want) > 60
    one = backtest.hysteresis(signals, KEYS, entry=0.8, exit=0.5, max_hold=12, cooldown=4).collect()
    c = next(c.combo for c in combos if (c.entry_z, c.exit_z, c.max_hold, c.cooldown) == (0.8, 0.5, 12, 4))
    assert sorted((r.pair, r.entry, r.exit, r.reason) for r in one) == sorted((p, t[0], t[1], t[5]) for (p, k), v in want.items() if k == c for t in v)


def test_stricter_entries_and_longer_cooldowns_trade_less(spark, signals):
    by = {(r.entry_z, r.cooldown): r["count"] for r in backtest.hysteresis_grid(signals, KEYS, backtest.grid(spark, (1.0, 2.0), (0.0,), (60,), (0, 50))).groupBy("entry_z", "cooldown").count().collect()}
    assert by[1.0, 0] > by[1.0, 50] and by[1.0, 0] > by.get((2.0, 0), 0)


def test_grid_on_an_empty_table(spark, signals):
    assert backtest.hysteresis_grid(signals.where("false"), KEYS, backtest.grid(spark, (1.0,), (0.0,), (5,))).count() == 0


def test_walk_forward_and_grid_queries_read_every_series(spark):
    from basisweave.plans.registry import QUERIES

    best = QUERIES["pos_04_grid_search"](spark, "/root/testdata/sf0.001").collect()
    assert len(best) == 20 and all(r.n >= 10 for r in best)
    assert [r.avg_net for r in best] == sorted((r.avg_net for r in best), reverse=True)


@pytest.mark.parametrize("stuck", [False, True])
def test_fifo_book_against_a_loop(spark, stuck):
    rng = random.Random(7)
    rows = [(f"w{w}", t, f"C{rng.randrange(3)}", f"p{k}", rng.random() > 0.2 or not stuck) for w in range(2) for t in range(60) for k in range(12) if rng.random() < 0.5]
    got = books.fifo_capacity(spark.createDataFrame(rows, "window_id string, snapshot_idx int, coin string, pair string, has_exit boolean").repartition(4), 3, 5).collect()
    want, now, book = [], None, {}
    for row in sorted(rows):
        w, t, coin, pair, has_exit = row
        if now is None or now[0] != w:
            book = {}
        now = (w, t)
        book = {k: end for k, end in book.items() if end > t}
        if (coin, pair) not in book and len(book) < 5:
            book[coin, pair] = t + 3 if has_exit else math.inf
            want.append(row)
    assert sorted(map(tuple, got)) == want
    # Stuck bets fill the book for good.
    assert (max(r[1] for r in want) < 50) == stuck, max(r[1] for r in want)


def test_ou_signal_recovers_and_refuses(spark):
    rng = np.random.default_rng(42)
    x = np.zeros(4000)
    for k in range(1, len(x)):
        x[k] = 0.8 * x[k - 1] + rng.normal() * 0.5
    series = {"ou": 3 + x, "constant": np.ones(100) * 5, "trend": np.arange(100.0), "short": rng.normal(size=15)}
    df = spark.createDataFrame([("w", "C", n, k, float(v)) for n, s in series.items() for k, v in enumerate(s)], "window_id string, coin string, pair string, snapshot_idx int, spread_bps double")
    out = backtest.ou_signal(df)
    assert [r.pair for r in out.select("pair").distinct().collect()] == ["ou"]
    fit = out.select("theta", "mu", "sigma", "stationary").first()
    assert fit.theta == pytest.approx(0.2, abs=0.03) and fit.mu == pytest.approx(3, abs=0.1) and fit.sigma == pytest.approx(0.5, abs=0.02)
    assert fit.stationary == pytest.approx(0.5 / math.sqrt(1 - 0.8**2), abs=0.08)
    z = [r[0] for r in out.orderBy("snapshot_idx").select("z_stationary").collect()]
    assert z[:10] == [None] * 10 and statistics.pstdev(z[10:]) == pytest.approx(1, abs=0.1)
    adaptive = backtest.adaptive_signal(df.where("pair = 'ou'")).orderBy("snapshot_idx").select("snapshot_idx", "z_adaptive").collect()
    v = series["ou"]
    for r in adaptive[:200]:
        i = r.snapshot_idx
        pilot = v[i - 20 : i]
        b = np.polyfit(pilot[:-1], np.diff(pilot), 1)[0]
        w = max(10, min(round(3 * math.log(2) / -b), i)) if b < 0 else 20
        past = v[max(0, i - w) : i]
        assert r.z_adaptive == pytest.approx((v[i] - past.mean()) / past.std(), abs=1e-6)


def test_normal_quantile_and_effective_tests(spark):
    tails = [0.05, 0.025, 0.005, 0.0005, 1e-6, 1e-9, 1e-30, 1e-100]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in tails], "t double").select(stats.normal_upper_quantile(F.col("t"))).collect()]
    assert got == pytest.approx([-statistics.NormalDist().inv_cdf(t) for t in tails], rel=1e-7)
    rng = np.random.default_rng(1)
    common = rng.normal(size=(300, 1))
    x = rng.normal(size=(300, 6)) + np.array([0, 0, 2, 2, 2, 0]) * common
    df = spark.createDataFrame([(f"s{k}", t, float(x[t, k])) for k in range(6) for t in range(300)], "name string, t int, v double")
    row = stats.effective_tests(df, ["name"], ["t"], "v").first()
    lam = np.linalg.eigvalsh(np.corrcoef(x.T))
    assert row.n_tests == 6 and row.n_effective == pytest.approx(1 + 5 * (1 - lam.var(ddof=1) / 6))
    alone = stats.effective_tests(df.where("name = 's0'"), ["name"], ["t"], "v").first()
    assert (alone.n_tests, alone.n_effective) == (1, 1.0)


def test_isotonic_blocks_against_pooling(spark):
    rng = random.Random(5)
    rows = [(k / 1000, math.sin(k / 90) + k / 400 + rng.gauss(0, 2)) for k in range(1000)]
    got = books.isotonic_blocks(spark.createDataFrame(rows, "abs_pred double, gross_bps double").repartition(3), [F.col("abs_pred")]).orderBy("block").collect()
    edges = [1000 * k // 20 for k in range(21)]
    means = [statistics.mean(y for _, y in rows[a:b]) for a, b in zip(edges, edges[1:])]
    pools = []
    for m in means:
        pools.append([m, 1])
        while len(pools) > 1 and pools[-2][0] > pools[-1][0]:
            (a, n), (b, k) = pools[-2:]
            pools[-2:] = [[(a * n + b * k) / (n + k), n + k]]
    want = [m for m, n in pools for _ in range(n)]
    assert [r.n for r in got] == [50] * 20 and [r.expected for r in got] == pytest.approx(want)


def test_hurst_against_a_loop(spark):
    rng = np.random.default_rng(3)
    data = {"walk": np.cumsum(rng.normal(size=900)), "noise": rng.normal(size=400), "short": rng.normal(size=30)}
    df = spark.createDataFrame([(n, k, float(v)) for n, s in data.items() for k, v in enumerate(s)], "name string, t int, v double").repartition(3)
    got = {r.name: r.hurst for r in stats.hurst(df, "v", ["name"], "t").collect()}
    assert set(got) == {"walk", "noise"}
    for name in got:
        x, n = data[name], len(data[name])
        points = []
        for lag in sorted({int(math.floor(10 ** (1 + k * (math.log10(min(n // 4, 500)) - 1) / 29) + 1e-9)) for k in range(30)}):
            parts = [x[b * lag : (b + 1) * lag] for b in range(n // lag)]
            points.append((math.log(lag), math.log(np.mean([np.ptp(np.cumsum(p - p.mean())) / p.std(ddof=1) for p in parts]))))
        assert got[name] == pytest.approx(np.polyfit(*zip(*points), 1)[0])
    assert got["noise"] < 0.7 < got["walk"]
