"""Rules of keyed state: the same results however their rows are cut into batches."""

import math
import random

import pytest
from pyspark.sql import functions as F

from basisweave.streaming import live, stateful


def fed(rule, rows, cuts, key=("k",), last=None):
    """The rule's results when it is called at each of ``cuts`` with the rows up to then."""
    held, out, at = None, [], 0
    for now in [*cuts, math.inf if last is None else last]:
        ready = [r for r in rows[at:] if r[0] <= now]
        at += len(ready)
        held, found, _ = rule.advance(key, held, ready, now)
        out += found
    return out


def walk(n, seed, gap=0.1):
    rng, s, t, rows = random.Random(seed), 0.0, 0, []
    for _ in range(n):
        s = 0.8 * s + rng.gauss(0, 100)
        t += 1 if rng.random() > gap else rng.randint(2, 30)
        rows.append((t * 10, t, s))
    return rows


@pytest.mark.parametrize("seed", range(6))
def test_trader_does_not_depend_on_batches(seed):
    rows, rule = walk(400, seed), stateful.Trader(0, 10)
    rng = random.Random(seed)
    whole = fed(rule, rows, [])
    assert len(whole) > 20 and {w[5] for w in whole} == {"signal", "timeout"}
    for _ in range(5):
        assert fed(rule, rows, sorted(rng.sample(range(rows[-1][0]), 40))) == whole
    assert all(0 < b - a <= rule.max_hold for a, b, *_ in whole)
    assert all(later[0] >= b + 1 + rule.cooldown for (_, b, *_), later in zip(whole, whole[1:]))


def test_trader_gates():
    rows = walk(600, 9)
    base = fed(stateful.Trader(0, 10), rows, [])
    assert fed(stateful.Trader(0, 10, min_std=1e6), rows, []) == []
    assert len(fed(stateful.Trader(0, 10, cooldown=50), rows, [])) < len(base)
    assert len(fed(stateful.Trader(0, 10, entry=3.0), rows, [])) < len(base)
    assert min(t[0] for t in fed(stateful.Trader(0, 10, warmup=300), rows, [])) >= rows[299][1]
    flat = [(t * 10, t, 5.0) for t in range(100)]
    assert fed(stateful.Trader(0, 10), flat, []) == []


def test_trader_times_out_without_a_row():
    rows = [(t * 10, t, float(t % 3)) for t in range(30)] + [(300, 30, 90.0)]
    rule = stateful.Trader(0, 10, max_hold=5)
    held, found, deadline = rule.advance(("k",), None, rows, 300)
    assert found == [] and held[2] == -1 and deadline == 350
    held, found, deadline = rule.advance(("k",), held, [], 350)
    assert found == [(30, 35, -1, 90.0, 90.0, "timeout")] and deadline is None and held[2] == 0


@pytest.mark.parametrize("side", ["buy", "sell"])
def test_fills_against_a_search(side):
    rng = random.Random(3)
    rows = sorted(((rng.randrange(5000), None if rng.random() < 0.5 else k, rng.uniform(90, 110)) for k in range(600)), key=lambda r: (r[0], r[1] is not None, r[1] or 0))
    wait, last = 400, 4500
    want = set()
    for at, order, limit in rows:
        if order is None or at > last:
            continue
        hit = min((t for t, o, p in rows if o is None and at < t <= min(at + wait, last) and (p <= limit if side == "buy" else p >= limit)), default=None)
        if hit is not None or at + wait <= last:
            want.add((order, at, hit))
    for cuts in ([], [1000, 2000, 3000], range(0, 4500, 37)):
        got = fed(stateful.Fills(wait), rows, cuts, ("C0", side), last)
        assert len(got) == len(want) and set(got) == want
    assert any(f is None for *_, f in want) and any(f is not None for *_, f in want)


def test_stalls_are_raised_once():
    rows = [(t, 1) for t in (0, 50, 200, 210, 600)]
    want = [(50, 150), (210, 310), (600, 700)]
    for cuts in ([], [100, 150, 151, 199], [205, 500], range(0, 900, 7)):
        assert fed(stateful.Stalls(100), rows, cuts, last=900) == want
    assert fed(stateful.Stalls(100), rows, [], last=650) == want[:2]


def test_waves_restarts_and_late_rows_give_what_one_pass_gives(spark):
    rows = [(key, at, t, s) for key, seed in (("a", 1), ("b", 2), ("c", 3)) for at, t, s in walk(120, seed)]
    df = spark.createDataFrame(rows, "pair string, at_ms long, t long, s double").repartition(5)
    rule = stateful.Trader(0, 10)
    # A row in three lands with the wave after its own, within the delay.
    wave = F.floor((F.col("at_ms") + F.when(F.col("t") % 3 == 0, 40).otherwise(0)) / F.lit(max(r[1] for r in rows) // 3 + 14)).cast("int")
    got = stateful.replayed(df, wave, ["pair"], rule, 60)
    mark = max(r[1] for r in rows) - 60
    want = sorted((k, *t) for k in "abc" for t in fed(rule, [r[1:] for r in rows if r[0] == k and r[1] <= mark], [], last=mark))
    assert sorted(map(tuple, got.collect())) == want and len(want) > 10


def test_event_time_of_large_snapshots(spark):
    cells = spark.createDataFrame([("C0", v, s, 1.0 + s % 7) for s in range(3_000_000, 3_000_012) for v in ("click", "view")], "coin string, exchange string, snapshot_idx int, mid double")
    got = live.stream_spread_matrix(spark, cells, 14_400).collect()
    assert sorted((r.snapshot_idx, r.num_exchanges) for r in got) == [(s, 2) for s in range(3_000_000, 3_000_011)]
    assert cells.select(live.snapshot_time(14_400).alias("t")).agg(F.min(F.unix_timestamp("t"))).first()[0] == 1_704_067_200 + 3_000_000 * 14_400
