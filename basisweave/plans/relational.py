"""Projections, filters, joins, sorts and set operations over the venue model."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basisweave.functions import exprs as x
from basisweave.operators import books, joins, metrics, pairs
from basisweave.plans.catalog import query, r
from basisweave.plans.sql import over
from basisweave.sources import venue

V = venue.VENUES


@query("prj_01_ticker_projection", over("ticker", "SELECT coin, exchange, snapshot_idx, round(mid, 8) AS mid, round(bid, 8) AS bid, round(ask, 8) AS ask, CAST(n_ticks AS BIGINT) AS n_ticks FROM ticker WHERE mid IS NOT NULL"))
def prj_01(spark, d):
    return venue.tickers(spark, d).where("mid is not null").select("coin", "exchange", "snapshot_idx", r("mid", 8), r("bid", 8), r("ask", 8), "n_ticks")


@query("prj_02_funding_projection", over("ticker", "SELECT coin, exchange, snapshot_idx, round(funding_rate * 1e4, 4) AS funding_bps FROM ticker WHERE funding_rate <> 0"))
def prj_02(spark, d):
    return venue.tickers(spark, d).where("funding_rate <> 0").select("coin", "exchange", "snapshot_idx", r((F.col("funding_rate") * 1e4)).alias("funding_bps"))


@query("prj_09_symbol_to_coin", over("ticker", "SELECT DISTINCT nullif(split_part(coin || '/USDT:' || exchange, '/', 1), '') AS coin FROM ticker"))
def prj_09(spark, d):
    symbol = F.concat(F.col("coin"), F.lit("/USDT:"), F.col("exchange"))
    return venue.tickers(spark, d).select(F.nullif(F.split(symbol, "/")[0], F.lit("")).alias("coin")).distinct()


@query("prj_10_mid_and_crossing", over("ticker", "SELECT coin, exchange, snapshot_idx, round(coalesce((bid + ask) / 2, mid), 4) AS mid_price, round((ask - bid) / ((ask + bid) / 2) * 1e4, 4) AS crossing_bps FROM ticker"))
def prj_10(spark, d):
    t = venue.tickers(spark, d)
    b, a = F.col("bid"), F.col("ask")
    return t.select("coin", "exchange", "snapshot_idx", r(x.mid_price(b, a, F.col("mid"))).alias("mid_price"), r(x.crossing_bps(b, a)).alias("crossing_bps"))


_CONVENTIONS = {
    "prj_12a_absolute_spread": ("absolute", "round(abs((mid_b - mid_a) / ((mid_a + mid_b) / 2)) * 1e4, 2)"),
    "prj_12b_signed_spread": ("signed", "round((mid_a - mid_b) / ((mid_a + mid_b) / 2) * 1e4, 4)"),
    "prj_12c_relative_spread": ("relative", "round(CASE WHEN mid_a <= 0 THEN 0 ELSE (mid_b - mid_a) / mid_a * 1e4 END, 4)"),
    "prj_12d_range_spread": ("range", "round((greatest(mid_a, mid_b) - least(mid_a, mid_b)) / least(mid_a, mid_b) * 1e4, 4)"),
}
for _name, (_kind, _sql) in _CONVENTIONS.items():

    @query(_name, over("pair", f"SELECT coin, pair, snapshot_idx, {_sql} AS spread FROM pair"))
    def prj_12(spark, d, kind=_kind):
        s = pairs.venue_pairs(venue.tickers(spark, d))
        return s.select("coin", "pair", "snapshot_idx", r(x.spread_bps(F.col("mid_a"), F.col("mid_b"), kind)).alias("spread"))


@query("prj_13_crossing_cost", over("pair", "SELECT coin, pair, snapshot_idx, round((ask_a - bid_a) / ((ask_a + bid_a) / 2) * 1e4 + (ask_b - bid_b) / ((ask_b + bid_b) / 2) * 1e4, 4) AS crossing_bps, round((ask_a - bid_a) / (ask_b - bid_b), 4) AS width_ratio FROM pair"))
def prj_13(spark, d):
    p = pairs.venue_pairs(venue.tickers(spark, d), values=("bid", "ask"))
    c = x.crossing_bps(F.col("bid_a"), F.col("ask_a")) + x.crossing_bps(F.col("bid_b"), F.col("ask_b"))
    return p.select("coin", "pair", "snapshot_idx", r(c).alias("crossing_bps"), r(x.safe_div(F.col("ask_a") - F.col("bid_a"), F.col("ask_b") - F.col("bid_b"))).alias("width_ratio"))


@query("prj_14_volume_share", over("pair", "SELECT coin, pair, snapshot_idx, round(ln(1 + greatest(vol_a, 0)) - ln(1 + greatest(vol_b, 0)), 4) AS log_volume_diff, round(greatest(vol_a, 0) / nullif(greatest(vol_a, 0) + greatest(vol_b, 0), 0), 4) AS share_a FROM pair"))
def prj_14(spark, d):
    p = pairs.venue_pairs(venue.tickers(spark, d), values=("base_volume",))
    a, b = (F.greatest(F.col(c), F.lit(0.0)) for c in ("base_volume_a", "base_volume_b"))
    return p.select("coin", "pair", "snapshot_idx", r(x.log1p_clip(a) - x.log1p_clip(b)).alias("log_volume_diff"), r(x.safe_div(a, a + b)).alias("share_a"))


@query("prj_15_time_features", over("tick", "SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS dow, isodow(ts) >= 6 AS weekend, CAST(least(least(hour(ts), 24 - hour(ts)), least(abs(hour(ts) - 8), 24 - abs(hour(ts) - 8)), least(abs(hour(ts) - 16), 24 - abs(hour(ts) - 16))) AS INTEGER) AS to_settlement FROM tick"))
def prj_15(spark, d):
    t = venue.ticks(spark, d)
    h = F.hour("ts")
    return t.select("event_id", h.alias("hour"), F.weekday("ts").alias("dow"), (F.weekday("ts") >= 5).alias("weekend"), x.hours_to_settlement(h).cast("int").alias("to_settlement"))


@query("prj_16_signed_log", over("pair", "SELECT coin, pair, snapshot_idx, round(sign(spread_bps) * ln(1 + abs(spread_bps)), 6) AS signed_log, round(ln(1 + greatest(spread_bps, 0)), 6) AS clipped_log FROM pair"))
def prj_16(spark, d):
    s = pairs.spread_series(venue.tickers(spark, d))
    c = F.col("spread_bps")
    return s.select("coin", "pair", "snapshot_idx", r(x.signed_log1p(c), 6).alias("signed_log"), r(x.log1p_clip(c), 6).alias("clipped_log"))


@query("prj_17_pair_key", over("pair", "SELECT DISTINCT pair, split_part(pair, '__', 1) AS exchange_a, split_part(pair, '__', 2) AS exchange_b FROM pair"))
def prj_17(spark, d):
    p = pairs.venue_pairs(venue.tickers(spark, d)).select("pair").distinct()
    return p.select("pair", F.split("pair", "__")[0].alias("exchange_a"), F.split("pair", "__")[1].alias("exchange_b"))


def _with_fees(spark, rows):
    fee = F.broadcast(venue.fees(spark))  # five rows
    a, b = fee.toDF("exchange_a", "fee_a"), fee.toDF("exchange_b", "fee_b")
    default = F.lit(venue.DEFAULT_TAKER_BPS)
    return rows.join(a, "exchange_a", "left").join(b, "exchange_b", "left").withColumns({"fee_a": F.coalesce("fee_a", default), "fee_b": F.coalesce("fee_b", default)})


@query("prj_18_fee_arithmetic", over("pair", "SELECT pair, CAST(count(*) AS BIGINT) AS n, round(max(coalesce(fa.taker_bps, 8) + coalesce(fb.taker_bps, 8)), 4) AS two_leg_bps, round(max(2 * (coalesce(fa.taker_bps, 8) + coalesce(fb.taker_bps, 8))), 4) AS round_trip_bps FROM pair LEFT JOIN fee fa ON fa.exchange = exchange_a LEFT JOIN fee fb ON fb.exchange = exchange_b GROUP BY pair", "fee"))
def prj_18(spark, d):
    f = _with_fees(spark, pairs.venue_pairs(venue.tickers(spark, d)))
    return f.groupBy("pair").agg(F.count(F.lit(1)).alias("n"), r(F.max(F.col("fee_a") + F.col("fee_b"))).alias("two_leg_bps"), r(F.max(2 * (F.col("fee_a") + F.col("fee_b")))).alias("round_trip_bps"))


@query("prj_19_book_summary", over("book", "SELECT book, CAST(len(asks) AS INTEGER) AS levels, round(list_sum(list_transform(asks, lambda v: v.qty)), 4) AS depth, round(list_sum(list_transform(asks, lambda v: v.price * v.qty)) / list_sum(list_transform(asks, lambda v: v.qty)), 4) AS vwap, round(asks[1].price, 8) AS best FROM book"))
def prj_19(spark, d):
    b = venue.order_books(spark, d)
    total = lambda f: F.aggregate("asks", F.lit(0.0), lambda a, v: a + f(v))
    depth = total(lambda v: v["qty"])
    return b.select("book", F.size("asks").alias("levels"), r(depth).alias("depth"), r(total(lambda v: v["price"] * v["qty"]) / depth).alias("vwap"), F.col("asks")[0]["price"].alias("best"))


@query(
    "prj_20_slippage_walk",
    over(
        "book",
        """WITH lv AS (SELECT book, unnest(asks) AS v, unnest(range(len(asks))) AS k, asks[1].price AS best FROM book),
run AS (SELECT book, best, v.price AS price, v.price * v.qty AS value, coalesce(sum(v.price * v.qty) OVER (PARTITION BY book ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM lv),
fill AS (SELECT book, best, size, sum(greatest(least(value, size - before), 0) / price) AS qty, sum(value) AS depth FROM run, (VALUES (1000), (5000), (10000), (50000)) AS s(size) GROUP BY book, best, size)
SELECT book, size AS notional, CASE WHEN depth >= size THEN round((size / qty - best) / best * 1e4, 3) END AS slippage_bps FROM fill""",
    ),
)
def prj_20(spark, d):
    b = venue.order_books(spark, d)
    sizes = (1000, 5000, 10000, 50000)
    parts = F.array(*(F.struct(F.lit(n).alias("notional"), r(books.slippage_bps(F.col("asks"), n), 3).alias("slippage_bps")) for n in sizes))
    return b.select("book", F.inline(parts))


@query("prj_21_tape_summary", over("tick", "SELECT coin, exchange, snapshot_idx, CAST(count(*) AS BIGINT) AS trade_count, round(min(mid), 4) AS price_min, round(max(mid), 4) AS price_max, round(avg(mid), 4) AS price_mean, CAST(sum(CASE WHEN side = 'buy' THEN 1 ELSE 0 END) AS BIGINT) AS buy_count, round(coalesce(sum(volume) FILTER (WHERE side = 'buy'), 0), 4) AS buy_volume, round(coalesce(sum(volume) FILTER (WHERE side = 'sell'), 0), 4) AS sell_volume, max(sec) - min(sec) AS span FROM tick GROUP BY ALL"))
def prj_21(spark, d):
    t = venue.with_snapshot(venue.ticks(spark, d), venue.bucket_of(spark, d))
    side = lambda s: r(F.coalesce(F.sum(F.when(F.col("side") == s, F.col("volume"))), F.lit(0.0)))
    return t.groupBy("coin", "exchange", "snapshot_idx").agg(
        F.count(F.lit(1)).alias("trade_count"), r(F.min("mid")).alias("price_min"), r(F.max("mid")).alias("price_max"), r(F.avg("mid")).alias("price_mean"), F.count_if(F.col("side") == "buy").alias("buy_count"), side("buy").alias("buy_volume"), side("sell").alias("sell_volume"), (F.max(F.unix_timestamp("ts")) - F.min(F.unix_timestamp("ts"))).alias("span")
    )


@query("prj_24_cross_venue_stats", over("ticker", "SELECT coin, snapshot_idx, round(stddev_samp(mid), 6) AS mid_std, round(max(mid) - min(mid), 6) AS mid_range, round(avg(mid), 6) AS mid_mean, round(avg(imbalance), 6) AS imbalance_mean FROM ticker GROUP BY ALL"))
def prj_24(spark, d):
    return venue.tickers(spark, d).groupBy("coin", "snapshot_idx").agg(r(F.stddev_samp("mid"), 6).alias("mid_std"), r(F.max("mid") - F.min("mid"), 6).alias("mid_range"), r(F.avg("mid"), 6).alias("mid_mean"), r(F.avg("imbalance"), 6).alias("imbalance_mean"))


@query("prj_25_venue_percentile", over("ticker", "SELECT coin, exchange, snapshot_idx, round((rank() OVER (PARTITION BY coin, snapshot_idx ORDER BY mid) + (count(*) OVER (PARTITION BY coin, snapshot_idx, mid) - 1) / 2.0) / count(*) OVER (PARTITION BY coin, snapshot_idx), 6) AS pct FROM ticker"))
def prj_25(spark, d):
    w = Window.partitionBy("coin", "snapshot_idx")
    ties = F.count(F.lit(1)).over(Window.partitionBy("coin", "snapshot_idx", "mid"))
    return venue.tickers(spark, d).select("coin", "exchange", "snapshot_idx", r((F.rank().over(w.orderBy("mid")) + (ties - 1) / 2) / F.count(F.lit(1)).over(w), 6).alias("pct"))


@query("prj_26_momentum", over("sig", "SELECT window_id, coin, pair, snapshot_idx, round(zscore_lag1 - zscore_lag3, 6) AS momentum, round(zscore - 2 * zscore_lag1 + zscore_lag2, 6) AS acceleration FROM sig"))
def prj_26(spark, d):
    s = pairs.scored(venue.tickers(spark, d))
    return s.select("window_id", "coin", "pair", "snapshot_idx", r(F.col("zscore_lag1") - F.col("zscore_lag3"), 6).alias("momentum"), r(F.col("zscore") - 2 * F.col("zscore_lag1") + F.col("zscore_lag2"), 6).alias("acceleration"))


_KNOTS = [(0.2, -1.0), (0.5, 2.0), (1.0, 8.0), (2.0, 20.0)]


@query("prj_32_calibration_lookup", over("sig", "SELECT window_id, coin, pair, snapshot_idx, round(CASE WHEN p <= 0.2 THEN -1 WHEN p < 0.5 THEN -1 + (p - 0.2) * 10 WHEN p < 1 THEN 2 + (p - 0.5) * 12 WHEN p < 2 THEN 8 + (p - 1) * 12 WHEN p >= 2 THEN 20 END, 4) AS expected_bps FROM (SELECT *, abs(pred) AS p FROM sig)"))
def prj_32(spark, d):
    return pairs.scored(venue.tickers(spark, d)).select("window_id", "coin", "pair", "snapshot_idx", r(books.calibrate(F.abs("pred"), _KNOTS)).alias("expected_bps"))


@query("prj_34_log_returns", over("candle", "SELECT coin, exchange, snapshot_idx, round(ln(close) - lag(ln(close)) OVER (PARTITION BY coin, exchange ORDER BY snapshot_idx), 8) AS log_return FROM candle"))
def prj_34(spark, d):
    w = Window.partitionBy("coin", "exchange").orderBy("snapshot_idx")
    return venue.candles(spark, d).select("coin", "exchange", "snapshot_idx", r(F.ln("close") - F.lag(F.ln("close")).over(w), 8).alias("log_return"))


@query("flt_03_snapshot_cut", over("ticker", "SELECT coin, exchange, snapshot_idx, round(mid, 4) AS mid FROM ticker WHERE snapshot_idx >= 30 AND snapshot_idx < 90 AND exchange IN ('click', 'view', 'error')"))
def flt_03(spark, d):
    return venue.tickers(spark, d).where(F.col("snapshot_idx").between(30, 89) & F.col("exchange").isin("click", "view", "error")).select("coin", "exchange", "snapshot_idx", r("mid"))


@query("flt_04_confidence_gate", over("sig", "SELECT window_id, CAST(count(*) FILTER (WHERE abs(pred) >= 0.9) AS BIGINT) AS live, CAST(count(*) FILTER (WHERE abs(pred) > 0.9) AS BIGINT) AS offline FROM sig GROUP BY 1"))
def flt_04(spark, d):
    return pairs.scored(venue.tickers(spark, d)).groupBy("window_id").agg(F.count_if(F.abs("pred") >= 0.9).alias("live"), F.count_if(F.abs("pred") > 0.9).alias("offline"))


@query("flt_05_fee_aware_gate", over("sig", "SELECT reason, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN pred IS NULL THEN 'no_prediction' WHEN p < 0.5 THEN 'below_floor' WHEN (CASE WHEN p < 1 THEN 2 + (p - 0.5) * 12 WHEN p < 2 THEN 8 + (p - 1) * 12 ELSE 20 END) < 6 THEN 'below_edge' ELSE 'pass' END AS reason FROM (SELECT *, abs(pred) AS p FROM sig)) GROUP BY 1"))
def flt_05(spark, d):
    p = F.abs("pred")
    reason = F.when(F.col("pred").isNull(), "no_prediction").when(p < 0.5, "below_floor").when(books.calibrate(p, _KNOTS) < 6, "below_edge").otherwise("pass")
    return pairs.scored(venue.tickers(spark, d)).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("flt_06_warm_up", over("sig", "SELECT window_id, coin, pair, CAST(min(snapshot_idx) AS INTEGER) AS first_ready, CAST(count(*) AS BIGINT) AS n FROM sig WHERE zscore_lag1 IS NOT NULL AND zscore_lag2 IS NOT NULL AND zscore_lag3 IS NOT NULL GROUP BY ALL"))
def flt_06(spark, d):
    ready = pairs.scored(venue.tickers(spark, d)).dropna(subset=["zscore_lag1", "zscore_lag2", "zscore_lag3"])
    return ready.groupBy("window_id", "coin", "pair").agg(F.min("snapshot_idx").alias("first_ready"), F.count(F.lit(1)).alias("n"))


@query("flt_08_minimum_overlap", over("pair", "SELECT coin, pair, CAST(count(*) AS BIGINT) AS n FROM pair GROUP BY ALL HAVING count(*) >= 150"))
def flt_08(spark, d):
    return pairs.venue_pairs(venue.tickers(spark, d)).groupBy("coin", "pair").agg(F.count(F.lit(1)).alias("n")).where("n >= 150")


@query("jn_01_two_venue_join", over("pair", "SELECT coin, snapshot_idx, round(mid_a, 4) AS mid_a, round(mid_b, 4) AS mid_b FROM pair WHERE exchange_a = 'click' AND exchange_b = 'view'"))
def jn_01(spark, d):
    t = venue.tickers(spark, d).select("coin", "snapshot_idx", "exchange", "mid")
    a, b = (t.where(F.col("exchange") == v).select("coin", "snapshot_idx", r("mid").alias(n)) for v, n in (("click", "mid_a"), ("view", "mid_b")))
    return a.join(b, ["coin", "snapshot_idx"])


@query("jn_02_venue_pair_triangle", over("pair", "SELECT coin, snapshot_idx, CAST(count(*) AS BIGINT) AS n_pairs, round(max(abs(spread_bps)), 4) AS widest FROM pair GROUP BY ALL"))
def jn_02(spark, d):
    return pairs.spread_series(venue.tickers(spark, d)).groupBy("coin", "snapshot_idx").agg(F.count(F.lit(1)).alias("n_pairs"), r(F.max(F.abs("spread_bps"))).alias("widest"))


@query("jn_03_left_micro_join", over("pair", "SELECT p.coin, p.pair, p.snapshot_idx, round(t.imbalance, 6) AS imbalance_a FROM pair p LEFT JOIN (SELECT * FROM ticker WHERE n_ticks > 2) t ON t.coin = p.coin AND t.exchange = p.exchange_a AND t.snapshot_idx = p.snapshot_idx"))
def jn_03(spark, d):
    t = venue.tickers(spark, d)
    micro = t.where("n_ticks > 2").select("coin", F.col("exchange").alias("exchange_a"), "snapshot_idx", r("imbalance", 6).alias("imbalance_a"))
    return pairs.venue_pairs(t).join(micro, ["coin", "exchange_a", "snapshot_idx"], "left").select("coin", "pair", "snapshot_idx", "imbalance_a")


@query("jn_04_forward_alignment", over("fwd", "SELECT window_id, coin, pair, snapshot_idx, round(zscore_fwd, 6) AS zscore_fwd, round(spread_bps_fwd - spread_bps, 4) AS spread_delta_bps FROM fwd"))
def jn_04(spark, d):
    f = pairs.align_forward(pairs.scored(venue.tickers(spark, d)), 1)
    return f.select("window_id", "coin", "pair", "snapshot_idx", r("zscore_fwd", 6), r(F.col("spread_bps_fwd") - F.col("spread_bps")).alias("spread_delta_bps"))


@query(
    "jn_05_last_tick_pairing",
    over(
        "tick",
        """WITH t AS (SELECT *, last_value(CASE WHEN exchange = 'click' THEN mid END IGNORE NULLS) OVER w AS a, last_value(CASE WHEN exchange = 'view' THEN mid END IGNORE NULLS) OVER w AS b,
last_value(CASE WHEN exchange = 'click' THEN sec END IGNORE NULLS) OVER w AS sa, last_value(CASE WHEN exchange = 'view' THEN sec END IGNORE NULLS) OVER w AS sb FROM tick WHERE exchange IN ('click', 'view')
WINDOW w AS (PARTITION BY coin ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT event_id, coin, round((b - a) / a * 1e4, 4) AS spread_bps, greatest(sec - sa, sec - sb) <= 3600 AS fresh FROM t WHERE a IS NOT NULL AND b IS NOT NULL""",
    ),
)
def jn_05(spark, d):
    p = joins.pair_last_ticks(venue.ticks(spark, d), ["coin"], "exchange", "click", "view")
    return p.select("event_id", "coin", r(x.spread_bps(F.col("mid_a"), F.col("mid_b"), "relative")).alias("spread_bps"), (F.greatest("age_a", "age_b") <= 3600).alias("fresh"))


_ASOF_SQL = """WITH l AS (SELECT event_id, coin, sec, mid FROM tick WHERE exchange = 'click'), q AS (SELECT coin, sec, max(mid) AS mid FROM tick WHERE exchange = 'view' GROUP BY ALL)
SELECT l.event_id, l.coin, round(q.mid, 4) AS mid_asof, coalesce(q.sec, -1) AS sec_asof FROM l ASOF LEFT JOIN q ON l.coin = q.coin AND l.sec >= q.sec"""


def _legs(spark, d):
    t = venue.ticks(spark, d).withColumn("sec", F.unix_timestamp("ts"))
    left = t.where(F.col("exchange") == "click").select("event_id", "coin", "sec", "mid")
    return left, t.where(F.col("exchange") == "view").groupBy("coin", "sec").agg(F.max("mid").alias("mid"))


@query("jn_05_asof_join", over("tick", _ASOF_SQL))
def jn_05_asof(spark, d):
    left, right = _legs(spark, d)
    return joins.asof(left, right, ["coin"], "sec", ["mid"], chunk=86_400).select("event_id", "coin", r("mid_asof"), F.coalesce("sec_asof", F.lit(-1)).alias("sec_asof"))


@query("jn_06_asof_tolerance", over("tick", _ASOF_SQL.replace("round(q.mid, 4) AS mid_asof, coalesce(q.sec, -1) AS sec_asof", "CASE WHEN l.sec - q.sec <= 1800 THEN round(q.mid, 4) END AS mid_asof, CASE WHEN l.sec - q.sec <= 1800 THEN q.sec ELSE -1 END AS sec_asof")))
def jn_06(spark, d):
    left, right = _legs(spark, d)
    return joins.asof(left, right, ["coin"], "sec", ["mid"], tolerance=1800, chunk=86_400).select("event_id", "coin", r("mid_asof"), F.coalesce("sec_asof", F.lit(-1)).alias("sec_asof"))


@query("jn_07_left_forward_fill", over("ticker", "SELECT coin, exchange, snapshot_idx, last_value(CASE WHEN last_id % 4 = 0 THEN open_interest END IGNORE NULLS) OVER (PARTITION BY coin, exchange ORDER BY snapshot_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS open_interest FROM ticker"))
def jn_07(spark, d):
    from basisweave.operators.series import forward_fill

    t = venue.tickers(spark, d)
    sparse = t.where("last_id % 4 = 0").select("coin", "exchange", "snapshot_idx", F.col("open_interest").alias("oi"))
    return t.join(sparse, ["coin", "exchange", "snapshot_idx"], "left").select("coin", "exchange", "snapshot_idx", forward_fill(F.col("oi"), ["coin", "exchange"], "snapshot_idx").alias("open_interest"))


@query("jn_09_interval_join", "SELECT CAST(b AS BIGINT) AS bar, CAST(count(*) AS BIGINT) AS n_open FROM (SELECT unnest(generate_series(CAST(ceil((o_orderkey % 5000) / 10.0) * 10 AS BIGINT), o_orderkey % 5000 + o_custkey % 90, 10)) AS b, o_orderkey, o_custkey FROM orders) WHERE b < o_orderkey % 5000 + o_custkey % 90 GROUP BY 1")
def jn_09(spark, d):
    o = venue.table(spark, d, "orders").select((F.col("o_orderkey") % 5000).alias("start"), (F.col("o_orderkey") % 5000 + F.col("o_custkey") % 90).alias("stop"))
    return joins.open_at(o, "start", "stop", 10).groupBy("bar").agg(F.count(F.lit(1)).alias("n_open"))


@query("jn_11_full_outer_master", "SELECT coalesce(c.c_nationkey, s.s_nationkey) AS nationkey, CAST(c.n AS BIGINT) AS n_customers, CAST(s.n AS BIGINT) AS n_suppliers FROM (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_nationkey < 20 GROUP BY 1) c FULL OUTER JOIN (SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_nationkey > 4 GROUP BY 1) s ON c.c_nationkey = s.s_nationkey")
def jn_11(spark, d):
    c = venue.table(spark, d, "customer").where("c_nationkey < 20").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count(F.lit(1)).alias("n_customers"))
    s = venue.table(spark, d, "supplier").where("s_nationkey > 4").groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count(F.lit(1)).alias("n_suppliers"))
    return c.join(s, "nationkey", "full_outer")


@query("jn_13_directed_rates", over("ticker", "SELECT a.exchange, a.snapshot_idx, a.coin AS coin_from, b.coin AS coin_to, round(a.mid / b.mid, 8) AS rate FROM ticker a JOIN ticker b ON a.exchange = b.exchange AND a.snapshot_idx = b.snapshot_idx AND a.coin <> b.coin"))
def jn_13(spark, d):
    t = venue.tickers(spark, d).select("exchange", "snapshot_idx", "coin", "mid")
    a, b = t.toDF("exchange", "snapshot_idx", "coin_from", "mid_a"), t.toDF("exchange", "snapshot_idx", "coin_to", "mid_b")
    return a.join(b, ["exchange", "snapshot_idx"]).where("coin_from <> coin_to").select("exchange", "snapshot_idx", "coin_from", "coin_to", r(F.col("mid_a") / F.col("mid_b"), 8).alias("rate"))


@query("jn_15_semi_two_venues", over("ticker", "SELECT coin, exchange, snapshot_idx FROM ticker WHERE (coin, snapshot_idx) IN (SELECT (coin, snapshot_idx) FROM ticker GROUP BY coin, snapshot_idx HAVING count(*) >= 4)"))
def jn_15(spark, d):
    t = venue.tickers(spark, d).select("coin", "exchange", "snapshot_idx")
    return t.join(t.groupBy("coin", "snapshot_idx").count().where("count >= 4"), ["coin", "snapshot_idx"], "left_semi").select("coin", "exchange", "snapshot_idx")


@query("jn_14_anti_open_keys", over("bet", "SELECT b.window_id, b.coin, b.pair, b.snapshot_idx FROM bet b WHERE b.abs_pred >= 0.5 AND NOT EXISTS (SELECT 1 FROM bet o WHERE o.abs_pred >= 1.5 AND o.window_id = b.window_id AND o.coin = b.coin AND o.pair = b.pair AND o.snapshot_idx + 1 = b.snapshot_idx)"))
def jn_14(spark, d):
    b = bets(spark, d).select("window_id", "coin", "pair", "snapshot_idx", "abs_pred")
    held = b.where("abs_pred >= 1.5").select("window_id", "coin", "pair", (F.col("snapshot_idx") + 1).alias("snapshot_idx"))
    return b.where("abs_pred >= 0.5").join(held, ["window_id", "coin", "pair", "snapshot_idx"], "left_anti").drop("abs_pred")


def bets(spark, d):
    """Persistence bets on every signal whose forward row exists."""
    aligned = pairs.align_forward(pairs.scored(venue.tickers(spark, d)), 1).where("pred is not null and zscore_fwd is not null")
    settled = pairs.settle(aligned, F.signum("zscore").cast("int"))
    return settled.withColumns({"gross_bps": F.col("direction") * F.col("spread_delta_bps"), "abs_pred": F.abs("pred")})


@query("srt_02_top_pairs", over("pair", "SELECT coin, pair, spread_std, CAST(k AS INTEGER) AS k FROM (SELECT coin, pair, round(stddev_samp(spread_bps), 4) AS spread_std, row_number() OVER (PARTITION BY coin ORDER BY round(stddev_samp(spread_bps), 4) DESC, pair) AS k FROM pair GROUP BY coin, pair) WHERE k <= 3"))
def srt_02(spark, d):
    s = pairs.spread_series(venue.tickers(spark, d)).groupBy("coin", "pair").agg(r(F.stddev_samp("spread_bps")).alias("spread_std"))
    return s.withColumn("k", F.row_number().over(Window.partitionBy("coin").orderBy(F.desc("spread_std"), "pair"))).where("k <= 3")


@query("srt_05_top_k_per_snapshot", over("bet", "SELECT window_id, snapshot_idx, coin, pair, CAST(k AS INTEGER) AS k FROM (SELECT *, row_number() OVER (PARTITION BY window_id, snapshot_idx ORDER BY round(abs_pred, 9) DESC, coin, pair) AS k FROM bet) WHERE k <= 5"))
def srt_05(spark, d):
    top = books.ranked_capacity(bets(spark, d), 5, [F.desc(F.round("abs_pred", 9)), F.col("coin"), F.col("pair")])
    return top.select("window_id", "snapshot_idx", "coin", "pair", F.col("slot").alias("k"))


@query("srt_01_ranked_opportunities", over("pair", "SELECT coin, pair, round(avg(abs(spread_bps)), 4) AS mean_abs FROM pair GROUP BY ALL ORDER BY mean_abs DESC, coin, pair LIMIT 10"))
def srt_01(spark, d):
    return pairs.spread_series(venue.tickers(spark, d)).groupBy("coin", "pair").agg(r(F.avg(F.abs("spread_bps"))).alias("mean_abs")).orderBy(F.desc("mean_abs"), "coin", "pair").limit(10)


@query("set_01_union_windows", over("ticker", "SELECT window_id, CAST(count(*) AS BIGINT) AS n FROM (SELECT * FROM ticker WHERE window_id = 'w1' UNION ALL SELECT * FROM ticker WHERE window_id = 'w2') GROUP BY 1"))
def set_01(spark, d):
    t = venue.tickers(spark, d)
    return t.where("window_id = 'w1'").unionByName(t.where("window_id = 'w2'")).groupBy("window_id").agg(F.count(F.lit(1)).alias("n"))


@query("set_02_upsert_candles", over("candle", "SELECT coin, exchange, snapshot_idx, round(close, 4) AS close FROM (SELECT *, row_number() OVER (PARTITION BY coin, exchange, snapshot_idx ORDER BY v DESC) AS k FROM (SELECT *, 0 AS v FROM candle UNION ALL SELECT coin, exchange, snapshot_idx, open, high, low, close * 1.01 AS close, volume, 1 AS v FROM candle WHERE snapshot_idx >= 100)) WHERE k = 1"))
def set_02(spark, d):
    c = venue.candles(spark, d)
    fresh = c.where("snapshot_idx >= 100").withColumn("close", F.col("close") * 1.01)
    both = c.withColumn("v", F.lit(0)).unionByName(fresh.withColumn("v", F.lit(1)))
    return both.groupBy("coin", "exchange", "snapshot_idx").agg(r(F.max_by("close", "v")).alias("close"))


@query("set_03_intersect_snapshots", over("ticker", "SELECT snapshot_idx FROM ticker WHERE exchange = 'click' AND coin = 'C0' INTERSECT SELECT snapshot_idx FROM ticker WHERE exchange = 'view' AND coin = 'C1'"))
def set_03(spark, d):
    t = venue.tickers(spark, d)
    return t.where("exchange = 'click' and coin = 'C0'").select("snapshot_idx").intersect(t.where("exchange = 'view' and coin = 'C1'").select("snapshot_idx"))


@query("set_04_except_snapshots", over("ticker", "SELECT snapshot_idx FROM ticker WHERE exchange = 'click' AND coin = 'C0' EXCEPT SELECT snapshot_idx FROM ticker WHERE exchange = 'view' AND coin = 'C1'"))
def set_04(spark, d):
    t = venue.tickers(spark, d)
    return t.where("exchange = 'click' and coin = 'C0'").select("snapshot_idx").subtract(t.where("exchange = 'view' and coin = 'C1'").select("snapshot_idx"))
