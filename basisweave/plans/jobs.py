"""Sources and sinks, books and backtests, statistics, models and streams as queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basisweave.operators import backtest, books, joins, pairs, stats
from basisweave.operators import models
from basisweave.operators import series as s
from basisweave.plans.catalog import query, r
from basisweave.plans.relational import bets
from basisweave.plans.sql import over
from basisweave.sources import files, venue
from basisweave.streaming import live

_KEY = ["window_id", "coin", "pair", "snapshot_idx"]


@query("src_04_envelope_scan", over("ticker", "SELECT window_id, coin, exchange, snapshot_idx, round(bid, 8) AS bid, round(ask, 8) AS ask FROM ticker WHERE snapshot_idx >= 40 AND snapshot_idx < 120 AND last_id % 11 <> 0"))
def src_04(spark, d):
    t = venue.tickers(spark, d).withColumn("error", F.when(F.col("last_id") % 11 == 0, "timeout"))
    path = files.landing(spark, "envelope")
    files.write_envelope(t, path, ["bid", "ask"])
    return files.read_envelope(spark, path, "bid double, ask double", 40, 120).select("window_id", "coin", "exchange", "snapshot_idx", r("bid", 8), r("ask", 8))


@query("src_01_signal_scan", over("ticker", "SELECT coin, exchange, snapshot_idx, round(mid, 4) AS mid FROM ticker WHERE last_id % 7 <> 0"))
def src_01(spark, d):
    t = venue.tickers(spark, d).select(F.lit("ticker").alias("type"), "ts", "snapshot_idx", "exchange", "coin", "bid", "ask", "mid", F.when(F.col("last_id") % 7 == 0, "x").alias("error"))
    path = files.landing(spark, "signals")
    files.write_signals(t, path, max_lines=50_000)
    return files.read_signals(spark, path, files.TICKER_SCHEMA, "ticker").select("coin", "exchange", "snapshot_idx", r("mid"))


@query("src_06_candle_tree", over("candle", "SELECT coin, exchange, snapshot_idx, round(open, 4) AS open, round(close, 4) AS close FROM candle"))
def src_06(spark, d):
    path = files.landing(spark, "candles")
    files.write_candle_tree(venue.candles(spark, d), path)
    return files.read_candle_tree(spark, path).select("coin", "exchange", "snapshot_idx", r("open"), r("close"))


@query("src_12_dimension_lookup", over("fee", "SELECT exchange, taker_bps, CAST(count(*) AS BIGINT) AS n FROM (SELECT event_type AS exchange FROM events) JOIN fee USING (exchange) GROUP BY ALL"))
def src_12(spark, d):
    return venue.ticks(spark, d).join(F.broadcast(venue.fees(spark)), "exchange").groupBy("exchange", "taker_bps").agg(F.count(F.lit(1)).alias("n"))


@query("snk_07_flattened_records", over("book", "SELECT book, '[' || len(asks) || ' items]' AS asks FROM book"))
def snk_07(spark, d):
    return files.flatten(venue.order_books(spark, d))


@query("pos_07_forward_settlement", over("bet", "SELECT window_id, coin, pair, snapshot_idx, direction, dir_hit, round(pnl_proxy, 6) AS pnl_proxy, round(spread_delta_bps, 4) AS spread_delta_bps FROM bet"))
def pos_07(spark, d):
    return bets(spark, d).select(*_KEY, "direction", "dir_hit", r("pnl_proxy", 6), r("spread_delta_bps"))


@query("pos_09_ranked_capacity_book", over("bet", "WITH k AS (SELECT *, row_number() OVER (PARTITION BY window_id, snapshot_idx ORDER BY round(abs_pred, 9) DESC, coin, pair) AS k FROM bet WHERE abs_pred >= 0.5) SELECT window_id, CAST(count(*) AS BIGINT) AS n, round(avg(dir_hit), 6) AS dir_acc, round(avg(pnl_proxy), 6) AS mean_pnl FROM k WHERE k <= 8 GROUP BY 1"))
def pos_09(spark, d):
    book = books.ranked_capacity(bets(spark, d).where("abs_pred >= 0.5"), 8, [F.desc(F.round("abs_pred", 9)), F.col("coin"), F.col("pair")])
    return book.groupBy("window_id").agg(F.count(F.lit(1)).alias("n"), r(F.avg("dir_hit"), 6).alias("dir_acc"), r(F.avg("pnl_proxy"), 6).alias("mean_pnl"))


@query(
    "pos_11_persistence_hold",
    over(
        "sig",
        """WITH o AS (SELECT window_id, coin, pair, snapshot_idx, CAST(sign(pred) AS INTEGER) AS side FROM sig WHERE abs(pred) >= 0.5),
n AS (SELECT *, CASE WHEN snapshot_idx - lag(snapshot_idx) OVER w = 1 AND side = lag(side) OVER w THEN 0 ELSE 1 END AS fresh FROM o WINDOW w AS (PARTITION BY window_id, coin, pair ORDER BY snapshot_idx)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY window_id, coin, pair ORDER BY snapshot_idx) AS run FROM n),
h AS (SELECT *, (row_number() OVER (PARTITION BY window_id, coin, pair, run ORDER BY snapshot_idx) - 1) // 4 AS part FROM g)
SELECT window_id, coin, pair, CAST(min(snapshot_idx) AS INTEGER) AS entry_snap, CAST(max(snapshot_idx) AS INTEGER) AS last_snap, max(side) AS side, CAST(count(*) AS BIGINT) AS n_bars FROM h GROUP BY window_id, coin, pair, run, part""",
    ),
)
def pos_11(spark, d):
    return books.persistence_runs(pairs.scored(venue.tickers(spark, d)), 0.5, 4).select("window_id", "coin", "pair", "entry_snap", "last_snap", "side", "n_bars")


@query(
    "win_19_equity_path",
    over(
        "bet",
        """WITH t AS (SELECT window_id, coin, pair, snapshot_idx AS entry_snap, snapshot_idx + 3 AS exit_snap, direction, round(pnl_proxy, 6) AS pnl FROM bet WHERE abs_pred >= 1.0),
b AS (SELECT *, unnest(range(entry_snap, exit_snap)) AS bar FROM t),
m AS (SELECT b.window_id, b.coin, b.pair, entry_snap, bar, direction, arg_max(z.zscore, z.snapshot_idx) AS mark FROM b JOIN z ON z.window_id = b.window_id AND z.coin = b.coin AND z.pair = b.pair AND z.snapshot_idx BETWEEN bar - 4 AND bar WHERE z.zscore IS NOT NULL GROUP BY ALL),
o AS (SELECT window_id, bar, sum(direction * mark) AS open_mtm, count(*) AS n_open FROM m GROUP BY ALL),
c AS (SELECT window_id, exit_snap AS bar, sum(pnl) AS closed FROM t GROUP BY ALL),
e AS (SELECT coalesce(o.window_id, c.window_id) AS window_id, coalesce(o.bar, c.bar) AS bar, open_mtm, n_open, closed FROM o FULL JOIN c ON o.window_id = c.window_id AND o.bar = c.bar)
SELECT window_id, CAST(bar AS INTEGER) AS bar, CAST(coalesce(n_open, 0) AS BIGINT) AS n_open, round(coalesce(sum(closed) OVER (PARTITION BY window_id ORDER BY bar), 0) + coalesce(open_mtm, 0), 4) AS equity FROM e""",
    ),
)
def win_19(spark, d):
    b = bets(spark, d).where("abs_pred >= 1.0")
    t = b.select("window_id", "coin", "pair", F.col("snapshot_idx").alias("entry_snap"), (F.col("snapshot_idx") + 3).alias("exit_snap"), "direction", r("pnl_proxy", 6).alias("pnl"))
    marks = pairs.scored(venue.tickers(spark, d)).where("zscore is not null")
    return books.equity_path(t, marks).select("window_id", "bar", F.col("n_open").cast("long").alias("n_open"), r("equity"))


@query("pos_14_realistic_costs", over("fwd", "SELECT f.pair, CAST(count(*) AS BIGINT) AS n, round(avg((ask_a - bid_a) / mid_a * 5e3 + (ask_b - bid_b) / mid_b * 5e3), 4) AS half_spreads, round(max(2 * (fa.taker_bps + fb.taker_bps)), 4) AS fees, round(avg(CASE WHEN vol_a < 0 OR vol_b < 0 THEN 10 ELSE 0 END), 4) AS mobility FROM fwd f JOIN fee fa ON fa.exchange = exchange_a JOIN fee fb ON fb.exchange = exchange_b WHERE pred IS NOT NULL GROUP BY f.pair", "fee"))
def pos_14(spark, d):
    from basisweave.plans.relational import _with_fees

    t = venue.tickers(spark, d)
    sig = pairs.align_forward(pairs.scored(t), 1).where("pred is not null").select(*_KEY, "exchange_a", "exchange_b")
    quotes = t.select("coin", "snapshot_idx", "exchange", ((F.col("ask") - F.col("bid")) / F.col("mid") * 5e3).alias("half"), "base_volume")
    a, b = quotes.toDF("coin", "snapshot_idx", "exchange_a", "half_a", "vol_a"), quotes.toDF("coin", "snapshot_idx", "exchange_b", "half_b", "vol_b")
    c = _with_fees(spark, sig.join(a, ["coin", "snapshot_idx", "exchange_a"]).join(b, ["coin", "snapshot_idx", "exchange_b"]))
    mobility = F.when((F.col("vol_a") < 0) | (F.col("vol_b") < 0), 10).otherwise(0)
    return c.groupBy("pair").agg(F.count(F.lit(1)).alias("n"), r(F.avg(F.col("half_a") + F.col("half_b"))).alias("half_spreads"), r(F.max(2 * (F.col("fee_a") + F.col("fee_b")))).alias("fees"), r(F.avg(mobility)).alias("mobility"))


@query(
    "pos_15_passive_fills",
    over("tick", "WITH o AS (SELECT event_id AS order_id, coin, sec AS placed, CASE WHEN event_id % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, mid * CASE WHEN event_id % 2 = 0 THEN 0.99 ELSE 1.01 END AS price FROM tick WHERE exchange = 'click'), f AS (SELECT o.order_id, min(t.sec) AS hit FROM o JOIN tick t ON t.coin = o.coin AND t.exchange = 'view' AND t.sec > o.placed AND t.sec <= o.placed + 7200 AND CASE WHEN o.side = 'buy' THEN t.mid <= o.price ELSE t.mid >= o.price END GROUP BY 1) SELECT side, CAST(count(*) AS BIGINT) AS n, CAST(count(hit) AS BIGINT) AS filled, round(avg(hit - placed), 4) AS mean_wait FROM o LEFT JOIN f USING (order_id) GROUP BY side"),
)
def pos_15(spark, d):
    t = venue.ticks(spark, d).withColumn("at", F.unix_timestamp("ts"))
    buy = F.col("event_id") % 2 == 0
    orders = t.where("exchange = 'click'").select(F.col("event_id").alias("order_id"), "coin", F.col("at").alias("placed"), F.when(buy, "buy").otherwise("sell").alias("side"), (F.col("mid") * F.when(buy, 0.99).otherwise(1.01)).alias("price"))
    filled = books.passive_fills(orders, t.where("exchange = 'view'").select("coin", "at", "mid"), ("coin",), 7200, 7200)
    return filled.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.count("filled_at").alias("filled"), r(F.avg("fill_seconds")).alias("mean_wait"))


_FOLD = """WITH RECURSIVE zb AS (SELECT window_id, coin, pair, snapshot_idx, zscore, spread_bps, row_number() OVER (PARTITION BY window_id, coin, pair ORDER BY snapshot_idx) AS k FROM z WHERE zscore IS NOT NULL),
f AS (SELECT window_id, coin, pair, 0::BIGINT AS k, 0 AS d, 0 AS t0, 0.0::DOUBLE AS s0, -1000000 AS free, NULL::INTEGER AS entry, NULL::INTEGER AS exit, NULL::INTEGER AS way, NULL::DOUBLE AS gross, NULL::VARCHAR AS reason FROM zb GROUP BY ALL
UNION ALL SELECT b.window_id, b.coin, b.pair, b.k,
CASE WHEN leave THEN 0 WHEN enter THEN CASE WHEN b.zscore > 0 THEN -1 ELSE 1 END ELSE d END, CASE WHEN leave THEN 0 WHEN enter THEN b.snapshot_idx ELSE t0 END, CASE WHEN leave THEN 0 WHEN enter THEN b.spread_bps ELSE s0 END,
CASE WHEN leave THEN b.snapshot_idx + 1 + 2 ELSE free END, CASE WHEN leave THEN t0 END, CASE WHEN leave THEN b.snapshot_idx END, CASE WHEN leave THEN d END, CASE WHEN leave THEN d * (b.spread_bps - s0) END, CASE WHEN leave THEN CASE WHEN back THEN 'signal' ELSE 'timeout' END END
FROM (SELECT f.window_id AS w, f.coin AS c, f.pair AS p, f.k AS kk, f.d, f.t0, f.s0, f.free, b.*, CASE WHEN f.d = 1 THEN b.zscore >= -0.5 ELSE b.zscore <= 0.5 END AS back,
 f.d <> 0 AND (CASE WHEN f.d = 1 THEN b.zscore >= -0.5 ELSE b.zscore <= 0.5 END OR b.snapshot_idx - f.t0 >= 12) AS leave, f.d = 0 AND abs(b.zscore) >= 1.5 AND b.snapshot_idx >= f.free AS enter
 FROM f JOIN zb b ON b.window_id = f.window_id AND b.coin = f.coin AND b.pair = f.pair AND b.k = f.k + 1) b)
SELECT window_id, coin, pair, entry, exit, way AS direction, reason, round(gross, 4) AS gross_bps FROM f WHERE exit IS NOT NULL"""


@query("pos_01_hysteresis_backtest", over("z", _FOLD).replace("WITH ", "WITH RECURSIVE ", 1).replace(", RECURSIVE zb AS", ", zb AS", 1))
def pos_01(spark, d):
    z = pairs.scored(venue.tickers(spark, d)).select(*_KEY, "zscore", "spread_bps")
    t = backtest.hysteresis(z, s.KEYS, entry=1.5, exit=0.5, max_hold=12, cooldown=2)
    return t.select("window_id", "coin", "pair", "entry", "exit", "direction", "reason", r("gross_bps"))


def _z_variants(spark, d, windows, gate_bps):
    """The spread with its z over each window, once as it is and once only where the trailing deviation pays the cost."""
    p = pairs.spread_series(venue.tickers(spark, d))
    least = lambda w: max(5, round(0.3 * w))
    p = p.withColumns({f"z{w}": s.rolling_z(F.col("spread_bps"), s.frame(w=w), least(w)) for w in windows} | {f"sd{w}": F.stddev_samp("spread_bps").over(s.frame(w=w)) for w in windows})
    kinds = [F.struct(F.lit(w).alias("w"), F.lit(g).alias("gated"), (F.when(F.col(f"sd{w}") >= gate_bps, F.col(f"z{w}")) if g else F.col(f"z{w}")).alias("zscore")) for w in windows for g in (False, True)]
    return p.select(*_KEY, "spread_bps", F.explode(F.array(*kinds)).alias("v")).select(*_KEY, "spread_bps", "v.*")


@query("pos_04_grid_search")
def pos_04(spark, d):
    """3,240 combinations (six windows, two gates, five entries, six exits, three holds, three cooldowns) on every series; the
    best 20 by mean net of those with ten trades."""
    z = _z_variants(spark, d, (10, 15, 20, 30, 40, 60), 12.0)
    grid = backtest.grid(spark, (1.0, 1.25, 1.5, 1.75, 2.0), (0.0, 0.1, 0.25, 0.4, 0.5, 0.75), (6, 12, 24), (0, 2, 5))
    t = backtest.hysteresis_totals(z, (*s.KEYS, "w", "gated"), grid, cost=16)
    by = t.groupBy("w", "gated", "combo", "entry_z", "exit_z", "max_hold", "cooldown").agg(F.sum("n").alias("n"), r(F.sum("net") / F.sum("n")).alias("avg_net"), r(F.sum("won") / F.sum("n")).alias("win_rate"))
    return by.where("n >= 10").orderBy(F.desc("avg_net"), "w", "gated", "combo").limit(20)


@query("sta_05_ou_fit", over("pair", "WITH l AS (SELECT coin, pair, spread_bps AS y, lag(spread_bps) OVER (PARTITION BY coin, pair ORDER BY snapshot_idx) AS x FROM pair), f AS (SELECT coin, pair, regr_slope(y, x) AS phi, regr_r2(y, x) AS r2, regr_count(y, x) AS n FROM l GROUP BY ALL) SELECT coin, pair, CAST(n AS BIGINT) AS n, round(phi, 6) AS phi, round(r2, 6) AS r2, CASE WHEN phi > 0 AND phi < 1 THEN round(0.6931471805599453 / -ln(phi), 4) END AS half_life FROM f"))
def sta_05(spark, d):
    o = stats.ou_fit(pairs.spread_series(venue.tickers(spark, d)), "spread_bps", ["coin", "pair"], "snapshot_idx")
    return o.select("coin", "pair", "n", r("phi", 6), r("r2", 6), r("half_life"))


@query("sta_01_adf")
def sta_01(spark, d):
    return stats.adf(pairs.spread_series(venue.tickers(spark, d)), "spread_bps", ["coin", "pair"], "snapshot_idx")


@query("sta_02_engle_granger")
def sta_02(spark, d):
    p = pairs.spread_series(venue.tickers(spark, d))
    return stats.engle_granger(p, ["coin", "pair"], "snapshot_idx", "mid_a", "mid_b")


@query("sta_09_bootstrap_mean")
def sta_09(spark, d):
    b = bets(spark, d).select("window_id", "coin", "pair", "snapshot_idx", "gross_bps")
    return stats.bootstrap(b, "gross_bps", ["coin"], 10_000)


@query("ml_05_ols_on_lags", over("sig", "SELECT CAST(count(*) AS BIGINT) AS n, round(regr_slope(target, zscore), 6) AS slope, round(regr_intercept(target, zscore), 6) AS intercept, round(regr_r2(target, zscore), 6) AS r2 FROM sig WHERE target IS NOT NULL AND zscore IS NOT NULL"))
def ml_05(spark, d):
    sig = pairs.scored(venue.tickers(spark, d)).where("target is not null and zscore is not null")
    return sig.agg(F.count(F.lit(1)).alias("n"), r(F.regr_slope("target", "zscore"), 6).alias("slope"), r(F.regr_intercept("target", "zscore"), 6).alias("intercept"), r(F.regr_r2("target", "zscore"), 6).alias("r2"))


@query("ml_02_boosted_forecast")
def ml_02(spark, d):
    return models.boosted_forecast(pairs.scored(venue.tickers(spark, d)))


@query("ml_04_random_forest")
def ml_04(spark, d):
    return models.forest_forecast(pairs.scored(venue.tickers(spark, d)))


@query("ml_06_walk_forward_cv")
def ml_06(spark, d):
    return models.walk_forward(pairs.scored(venue.tickers(spark, d)), 3)


@query("ml_18_chronological_carve", over("sig", "WITH k AS (SELECT window_id, percent_rank() OVER (PARTITION BY window_id ORDER BY snapshot_idx) AS p FROM sig WHERE target IS NOT NULL) SELECT window_id, p >= 0.85 AS validation, CAST(count(*) AS BIGINT) AS n FROM k GROUP BY ALL"))
def ml_18(spark, d):
    """Percent ranks from a count a snapshot: the running sum sees snapshots, not rows."""
    k = pairs.scored(venue.tickers(spark, d)).where("target is not null").groupBy("window_id", "snapshot_idx").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("window_id")
    before = F.sum("n").over(own.orderBy("snapshot_idx").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    p = F.coalesce(before / F.nullif(F.sum("n").over(own) - 1, F.lit(0)), F.lit(0.0))
    return k.select("window_id", (p >= 0.85).alias("validation"), "n").groupBy("window_id", "validation").agg(F.sum("n").alias("n"))


@query("str_13_stream_spread_matrix", over("ticker", "SELECT coin, snapshot_idx, CAST(count(*) AS BIGINT) AS num_exchanges, round(max(mid) - min(mid), 4) AS price_range FROM ticker GROUP BY ALL"))
def str_13(spark, d):
    return live.stream_spread_matrix(spark, venue.tickers(spark, d), venue.bucket_of(spark, d), ends=True)


@query("str_11_stream_hourly_counts", "SELECT date_trunc('hour', ts) AS hour, event_type AS exchange, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS volume FROM events GROUP BY ALL")
def str_11(spark, d):
    return live.stream_hourly(spark, venue.ticks(spark, d))


@query("str_05_stream_settlement", over("bet", "SELECT window_id, coin, pair, snapshot_idx, round(pnl_proxy, 6) AS pnl_proxy FROM bet WHERE abs_pred >= 0.5"))
def str_05(spark, d):
    return live.stream_settlement(spark, pairs.scored(venue.tickers(spark, d)), venue.bucket_of(spark, d))
