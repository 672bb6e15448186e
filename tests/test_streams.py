"""Streams that end give every window, the last ones among them."""

import datetime as dt

from basisweave.streaming import live

DAY = dt.datetime(2024, 1, 1)


def test_matrix_has_the_last_snapshot(spark):
    cells = spark.createDataFrame([("C0", v, k, float(10 * k + n)) for k in (0, 1, 5) for n, v in enumerate(("click", "view"))], "coin string, exchange string, snapshot_idx int, mid double")
    out = {(r.coin, r.snapshot_idx): (r.num_exchanges, r.price_range) for r in live.stream_spread_matrix(spark, cells, 24, ends=True).collect()}
    assert out == {("C0", k): (2, 1.0) for k in (0, 1, 5)}


def ticks(spark):
    return spark.createDataFrame([(v, float(k), float(100 + k), DAY + dt.timedelta(minutes=40 * k)) for k in range(9) for v in ("click", "view")], "exchange string, volume double, mid double, ts timestamp")


def test_hours_have_every_tick(spark):
    out = live.stream_hourly(spark, ticks(spark)).collect()
    assert sum(r.n for r in out) == 18 and max(r.hour for r in out) == DAY + dt.timedelta(hours=5) and {r.exchange for r in out} == {"click", "view"}


def test_slides_have_every_tick_four_times(spark):
    out = live.stream_sliding(spark, ticks(spark)).collect()
    assert sum(r.n for r in out) == 4 * 18 and max(r.start for r in out) == DAY + dt.timedelta(hours=5)
    assert {r.exchange for r in out} == {"click", "view"}
