"""Jobs whose draws grow with the data, against the plain form of what they compute."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from basisweave.operators import backtest, experiments, models, stats
from basisweave.plans.registry import QUERIES
from basisweave.streaming import stateful


def test_block_bootstrap_slopes_are_those_of_the_drawn_rows(spark):
    rng = np.random.default_rng(1)
    y = {p: np.cumsum(rng.normal(size=n)) for p, n in (("a", 57), ("b", 40), ("short", 20))}
    df = spark.createDataFrame([(p, k * 3, float(v)) for p, vs in y.items() for k, v in enumerate(vs)], "pair string, at int, y double")
    got = {(r.pair, r.rep): r.phi for r in stats.block_bootstrap_slopes(df, "y", ["pair"], "at", 10, 7).collect()}
    assert {p for p, _ in got} == {"a", "b"} and len(got) == 14
    for p in ("a", "b"):
        n = len(y[p])
        draws = spark.range(1).select(F.explode(F.sequence(F.lit(1), F.lit(7))).alias("rep")).select("rep", F.explode(F.sequence(F.lit(1), F.lit(-(-n // 10)))).alias("j"))
        start = F.pmod(F.xxhash64(F.lit(11), F.lit(p), "rep", "j"), F.lit(n - 10).cast("long"))
        drawn: dict[int, list] = {}
        for r in draws.select("rep", start.alias("s")).collect():
            drawn.setdefault(r.rep, []).extend((y[p][k - 1], y[p][k]) for k in range(r.s, r.s + 10) if k > 0)
        for rep, pairs in drawn.items():
            x, t = np.array(pairs).T
            assert abs(got[p, rep] - np.polyfit(x, t, 1)[0]) < 1e-9


def test_random_entries_pick_one_move_a_block(spark):
    moves = {("C0", k): float(k * k % 17) for k in range(31) if k not in (7, 30)} | {("C1", 2): 5.0}
    df = spark.createDataFrame([(c, k, m) for (c, k), m in moves.items()], "coin string, rn int, move double")
    blocks = spark.createDataFrame(sorted({(c, k // 6) for c, k in moves}), "coin string, block long")
    drawn = blocks.withColumn("sim", F.explode(F.sequence(F.lit(1), F.lit(40)))).select("sim", "coin", "block", F.pmod(F.xxhash64(F.lit(3), "sim", "coin", "block"), F.lit(8)).alias("u")).collect()
    want: dict[int, list] = {}
    for r in drawn:
        m = moves.get((r.coin, r.block * 6 + r.u % 4))
        if m is not None:
            want.setdefault(r.sim, []).append(m if r.u < 4 else -m)
    got = {r.sim: r["mean"] for r in stats.random_entries(df, ["coin"], "rn", "move", 40).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - np.mean(v)) < 1e-9 for k, v in want.items())


def _loop(bars, entry, exit, most, wait):
    d, t0, s0, free, out = 0, 0, 0.0, -(2**31), []
    for t, z, s in bars:
        if d:
            back = z >= -exit if d == 1 else z <= exit
            if back or t - t0 >= most:
                out.append((t0, t, d, d * (s - s0)))
                d, free = 0, t + 1 + wait
        elif abs(z) >= entry and t >= free:
            d, t0, s0 = (-1 if z > 0 else 1), t, s
    return out


def test_positions_over_several_batches_and_their_totals(spark):
    rng = np.random.default_rng(2)
    n = 25_000  # more than a batch holds
    at = np.cumsum(rng.integers(1, 4, n))
    series = {k: list(zip(at.tolist(), (3 * np.sin(np.arange(n) / (5 + k)) + rng.normal(size=n)).tolist(), rng.normal(size=n).tolist())) for k in (0, 1)}
    sig = spark.createDataFrame([(k, *b) for k, bars in series.items() for b in bars], "k int, snapshot_idx int, zscore double, spread_bps double")
    params = backtest.grid(spark, (1.0, 2.5), (0.0, 0.5), (6, 10**6), (-1, 3))
    lo, hi = int(at.min()), int(at.max())
    got = {(r.k, r.combo, r.fold): (r.n, r.net, r.won) for r in backtest.hysteresis_totals(sig, ["k"], params, 0.25, (lo, hi, 4)).collect()}
    want: dict[tuple, list] = {}
    for p in params.collect():
        for k, bars in series.items():
            trades = _loop(bars, p.entry_z, p.exit_z, p.max_hold, p.cooldown)
            for t0, _, _, gross in trades:
                want.setdefault((k, p.combo, 4 * (t0 - lo) // (hi - lo + 1)), []).append(gross - 0.25)
            if p.combo in (0, 7):
                one = backtest.hysteresis(sig.where(f"k = {k}"), ["k"], p.entry_z, p.exit_z, p.max_hold, p.cooldown).orderBy("entry").collect()
                assert [(r.entry, r.exit, r.direction, r.gross_bps) for r in one] == trades
    assert got.keys() == want.keys()
    assert all(got[k][0] == len(v) and abs(got[k][1] - sum(v)) < 1e-6 and got[k][2] == sum(x > 0 for x in v) for k, v in want.items())


class _State:
    def __init__(self):
        self.v = None

    def exists(self):
        return self.v is not None

    def get(self):
        return self.v

    def put(self, v):
        self.v = v

    update = put

    def appendList(self, v):
        self.v = [*(self.v or []), *v]

    def clear(self):
        self.v = None


class _Handle:
    def __init__(self):
        self.list, self.value, self.timers = _State(), _State(), []
        self.getListState, self.getValueState = lambda *_: self.list, lambda *_: self.value
        self.registerTimer = self.timers.append


class _Now:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = lambda: ms


@pytest.mark.parametrize("at_once", [7, 20_000])
def test_a_batch_is_one_value_of_state_and_parts_change_nothing(monkeypatch, at_once):
    monkeypatch.setattr(stateful, "_AT_ONCE", at_once)
    rng = np.random.default_rng(3)
    rows = pd.DataFrame({"at_ms": rng.integers(0, 4000, 1000), "order_id": [None if k % 3 else k for k in range(1000)], "price": rng.normal(100, 3, 1000)}).astype({"order_id": float})
    p = stateful.InOrder(stateful.Fills(50), ["coin", "side"], {"at_ms": True, "order_id": True, "price": False}, {"coin": "object", "side": "object", "order_id": "Int64", "placed_ms": "Int64", "filled_ms": "Int64"})
    handle = _Handle()
    p.init(handle)
    list(p.handleInputRows(("C0", "buy"), iter([rows[:600], rows[600:]]), None))
    assert len(handle.list.v) == 2 and handle.timers == [rows["at_ms"].min()]
    got = []
    for now in (1500, 3000, 10_000):
        got += [tuple(None if pd.isna(v) else v for v in r) for f in p.handleExpiredTimer(("C0", "buy"), _Now(now), None) for r in f[["order_id", "placed_ms", "filled_ms"]].itertuples(index=False)]
    plain = [tuple(None if pd.isna(v) else v for v in r) for r in rows.itertuples(index=False)]
    _, want, _ = stateful.Fills(50).advance(("C0", "buy"), None, sorted(((int(a), None if o is None else int(o), x) for a, o, x in plain), key=lambda r: tuple((v is not None, v) for v in r)), 10_000)
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) == 334 and handle.list.v is None


def test_walk_forward_reads_its_input_once(spark):
    """Every fold against least squares; the input is evaluated once, whatever the folds."""
    rng = np.random.default_rng(8)
    names = ("zscore", "zscore_lag1", "zscore_lag2", "zscore_lag3", "spread_bps")
    pdf = pd.DataFrame({"window_id": "w1", "coin": "C0", "pair": rng.choice(["a__b", "a__c", "b__c"], 600, p=[0.2, 0.5, 0.3]), "snapshot_idx": np.arange(600, dtype=np.int32), **{c: rng.normal(size=600) for c in names}})
    pdf.loc[pdf["snapshot_idx"] < 150, "pair"] = "a__c"  # the others are unseen in the first fold
    pdf["target"] = 0.5 * pdf["zscore"] + 0.3 * (pdf["pair"] == "a__b") + rng.normal(size=600) / 10
    pdf.loc[::50, "zscore_lag1"] = None
    seen, schema = spark.sparkContext.accumulator(0), spark.createDataFrame(pdf).schema

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    got = {r.fold: r for r in models.walk_forward(spark.createDataFrame(pdf).mapInArrow(counted, schema), 3).collect()}
    assert seen.value == 600 and set(got) == {1, 2, 3}
    data = pdf.dropna()
    lo, hi = int(data["snapshot_idx"].min()), int(data["snapshot_idx"].max())
    for k, r in got.items():
        start, stop = (lo + (hi + 1 - lo) * j // 4 for j in (k, k + 1))
        train, test = data[data["snapshot_idx"] < start], data[(data["snapshot_idx"] >= start) & (data["snapshot_idx"] < stop)]
        order = {p: i for i, p in enumerate(train["pair"].value_counts().index)}
        x = lambda d: np.column_stack([np.ones(len(d)), d[list(names)], d["pair"].map(order).fillna(len(order))])
        miss = test["target"] - x(test) @ np.linalg.lstsq(x(train), train["target"], rcond=None)[0]
        assert r.n == len(test) and r.mae == pytest.approx(miss.abs().mean(), abs=6e-5)


def test_feature_sets_share_one_moment_matrix(spark, monkeypatch):
    passes, moments = [], experiments.moments
    monkeypatch.setattr(experiments, "moments", lambda *a, **b: passes.append(a[1]) or moments(*a, **b))
    got = {(r.features, r.role) for r in QUERIES["ml_09_engineered_and_raw"](spark, "/root/testdata/sf0.001").collect()}
    assert len(passes) == 1 and got == {(f, role) for f in ("engineered", "raw", "both") for role in ("val", "test")}


def test_poisson_weights_by_table_are_those_of_the_whole_number():
    """A byte a weight, told by the first 16 bits but where those hold a bound of the cumulated mass."""
    h = np.random.default_rng(5).integers(-(2**63), 2**63 - 1, 300)
    w = stats.poisson_weights(h, 1000)
    for k in range(300):
        z = [(int(h[k]) + j * 0x9E3779B97F4A7C15) % 2**64 for j in range(1, 1001)]
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = [(x ^ (x >> shift)) * factor % 2**64 for x in z]
        u = np.array([((x ^ (x >> 31)) >> 11) * 2.0**-53 for x in z])
        assert (w[k] == np.searchsorted(stats._POISSON, u)).all()
    assert w.dtype == np.uint8


def test_hurst_of_a_series_in_chunks(spark):
    """Blocks over the seams, nulls, and blocks of one value; a series is in several tasks."""
    rng = np.random.default_rng(4)
    y = np.cumsum(rng.normal(size=1300))
    y[300:420] = y[300]
    values = [None if k % 97 == 5 or 640 <= k < 655 else float(v) for k, v in enumerate(y)]
    df = spark.createDataFrame([("a", k, v) for k, v in enumerate(values)] + [("few", k, 1.0) for k in range(39)], "name string, t int, v double")
    got = stats.hurst(df, "v", ["name"], "t", most=60, chunk=100).collect()
    points = []
    for size in sorted({int(np.floor(10 ** (1 + k * (np.log10(60) - 1) / 29) + 1e-9)) for k in range(30)}):
        rs = []
        for b in range(1300 // size):
            own = np.array([v for v in values[b * size : (b + 1) * size] if v is not None])
            if len(own) > 1 and np.ptp(own) > 0:
                rs.append(np.ptp(np.cumsum(own - own.mean())) / own.std(ddof=1))
        points.append((np.log(size), np.log(np.mean(rs))))
    assert [r.name for r in got] == ["a"] and got[0].n_lags == len(points)
    assert got[0].hurst == pytest.approx(np.polyfit(*zip(*points), 1)[0])
