"""Feature builders, micro-signal projections, further filters, joins, reports and book variants."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basisweave.functions import exprs as x
from basisweave.operators import backtest, books, metrics, pairs, stats
from basisweave.operators import series as s
from basisweave.plans.catalog import query, r
from basisweave.plans.relational import _with_fees, bets
from basisweave.plans.sql import over
from basisweave.sources import venue

_KEY = ["window_id", "coin", "pair", "snapshot_idx"]
_K = ", ".join(_KEY)


@query("prj_05_explode_pairwise", over("pair", "SELECT coin, snapshot_idx, exchange_a AS ex1, exchange_b AS ex2, round(spread_bps, 4) AS spread_bps FROM pair WHERE exchange_a IN ('click', 'purchase') AND exchange_b IN ('signup', 'view')"))
def prj_05(spark, d):
    """Pair rows packed as JSON payloads per snapshot and exploded again."""
    rows = pairs.spread_series(venue.tickers(spark, d)).select("coin", "snapshot_idx", F.struct(F.col("exchange_a").alias("ex1"), F.col("exchange_b").alias("ex2"), r("spread_bps")).alias("p"))
    packed = rows.groupBy("coin", "snapshot_idx").agg(F.to_json(F.collect_list("p")).alias("payload"))
    out = packed.select("coin", "snapshot_idx", F.inline(F.from_json("payload", "array<struct<ex1:string,ex2:string,spread_bps:double>>")))
    return out.where(F.col("ex1").isin("click", "purchase") & F.col("ex2").isin("signup", "view"))


@query("prj_06_payload_numbers", "SELECT event_id, round(coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0), 6) AS k FROM events")
def prj_06(spark, d):
    return venue.table(spark, d, "events").select("event_id", r(F.coalesce(F.expr("try_cast(get_json_object(props, '$.k') as double)"), F.lit(0.0)), 6).alias("k"))


@query("prj_07_signed_quote_value", over("tick", "SELECT event_id, round(CASE WHEN side = 'buy' THEN 1 ELSE -1 END * mid * volume, 4) AS signed_value FROM tick"))
def prj_07(spark, d):
    return venue.ticks(spark, d).select("event_id", r(F.when(F.col("side") == "buy", 1).otherwise(-1) * F.col("mid") * F.col("volume")).alias("signed_value"))


@query("prj_22_leg_gather", over("pair", "SELECT p.coin, p.pair, p.snapshot_idx, round(a.funding_rate * 1e4, 4) AS funding_a, round(b.funding_rate * 1e4, 4) AS funding_b, round(ln(p.mid_a) - ln(p.mid_b), 8) AS log_mid_diff FROM pair p JOIN ticker a ON a.coin = p.coin AND a.snapshot_idx = p.snapshot_idx AND a.exchange = exchange_a JOIN ticker b ON b.coin = p.coin AND b.snapshot_idx = p.snapshot_idx AND b.exchange = exchange_b"))
def prj_22(spark, d):
    p = pairs.venue_pairs(venue.tickers(spark, d), values=("mid", "funding_rate"))
    return p.select("coin", "pair", "snapshot_idx", r(F.col("funding_rate_a") * 1e4).alias("funding_a"), r(F.col("funding_rate_b") * 1e4).alias("funding_b"), r(F.ln("mid_a") - F.ln("mid_b"), 8).alias("log_mid_diff"))


@query("prj_29_route_time", "SELECT s_suppkey, CAST(45 + sum(t) AS DOUBLE) AS seconds FROM (SELECT s_suppkey, unnest([s_nationkey % 5, s_suppkey % 3]) AS hop FROM supplier) JOIN (VALUES (0, 780), (1, 15), (2, 60), (3, 3), (4, 600)) AS c(hop, t) USING (hop) GROUP BY s_suppkey")
def prj_29(spark, d):
    chain = spark.createDataFrame([(0, 780), (1, 15), (2, 60), (3, 3), (4, 600)], "hop long, t int")  # five chains
    hops = venue.table(spark, d, "supplier").select("s_suppkey", F.explode(F.array((F.col("s_nationkey") % 5).cast("long"), (F.col("s_suppkey") % 3).cast("long"))).alias("hop"))
    return hops.join(F.broadcast(chain), "hop").groupBy("s_suppkey").agg((45 + F.sum("t")).cast("double").alias("seconds"))


@query("prj_30_finite_cleanup", "SELECT l_orderkey, l_linenumber, round(coalesce(CAST(l_extendedprice AS DOUBLE) / nullif(CAST(l_discount AS DOUBLE), 0), 0), 2) AS ratio FROM lineitem")
def prj_30(spark, d):
    ratio = x.safe_div(F.col("l_extendedprice").cast("double"), F.col("l_discount").cast("double"))
    return venue.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r(F.coalesce(x.finite(ratio), F.lit(0.0)), 2).alias("ratio"))


@query("prj_33_direction_terms", over("bet", f"SELECT {_K}, round(gross_bps, 4) AS gross_bps, round(gross_bps - 2 * (fa.taker_bps + fb.taker_bps), 4) AS net_bps, round(zscore_fwd - zscore, 6) AS delta_z FROM bet JOIN fee fa ON fa.exchange = exchange_a JOIN fee fb ON fb.exchange = exchange_b", "fee"))
def prj_33(spark, d):
    b = _with_fees(spark, bets(spark, d))
    return b.select(*_KEY, r("gross_bps"), r(F.col("gross_bps") - 2 * (F.col("fee_a") + F.col("fee_b"))).alias("net_bps"), r(F.col("zscore_fwd") - F.col("zscore"), 6).alias("delta_z"))


@query("flt_07_volatility_gate", over("pair", f"SELECT {_K} FROM (SELECT *, stddev_pop(spread_bps) OVER f AS sd, count(*) OVER f AS n FROM pair WINDOW f AS (PARTITION BY window_id, coin, pair ORDER BY snapshot_idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) WHERE n = 20 AND sd >= 2000 AND abs(spread_bps) >= 1000"))
def flt_07(spark, d):
    f = s.frame(w=20)
    v = pairs.spread_series(venue.tickers(spark, d)).withColumns({"sd": F.stddev_pop("spread_bps").over(f), "n": F.count(F.lit(1)).over(f)})
    return v.where((F.col("n") == 20) & (F.col("sd") >= 2000) & (F.abs("spread_bps") >= 1000)).select(*_KEY)


@query("flt_10_stale_ticks", over("tick", "SELECT event_id, age > 1800 AS stale FROM (SELECT event_id, sec - lag(sec) OVER (PARTITION BY coin, exchange ORDER BY ts, event_id) AS age FROM tick) WHERE age IS NOT NULL"))
def flt_10(spark, d):
    w = Window.partitionBy("coin", "exchange").orderBy("ts", "event_id")
    age = F.unix_timestamp("ts") - F.lag(F.unix_timestamp("ts")).over(w)
    return venue.ticks(spark, d).select("event_id", age.alias("age")).where("age is not null").select("event_id", (F.col("age") > 1800).alias("stale"))


@query("flt_11_sparse_assets", over("ticker", "WITH s AS (SELECT max(snapshot_idx) - min(snapshot_idx) + 1 AS grid FROM ticker), k AS (SELECT coin, exchange FROM ticker GROUP BY ALL HAVING 1 - count(*) / (SELECT grid FROM s) <= 0.2), t AS (SELECT coin, snapshot_idx, count(*) AS n_assets FROM ticker SEMI JOIN k USING (coin, exchange) GROUP BY ALL) SELECT coin, exchange, CAST(count(*) AS BIGINT) AS n FROM ticker SEMI JOIN k USING (coin, exchange) JOIN t USING (coin, snapshot_idx) WHERE n_assets >= 2 GROUP BY ALL"))
def flt_11(spark, d):
    """Series that lack over a fifth of the observed grid go, then snapshots of a coin that fewer than two series are left in."""
    t = venue.tickers(spark, d).select("coin", "exchange", "snapshot_idx")
    own = t.groupBy("coin", "exchange").agg(F.count(F.lit(1)).alias("n"), F.min("snapshot_idx").alias("lo"), F.max("snapshot_idx").alias("hi"))
    span = own.agg((F.max("hi") - F.min("lo") + 1).alias("grid"))
    dense = own.crossJoin(F.broadcast(span)).where(1 - F.col("n") / F.col("grid") <= 0.2).select("coin", "exchange")
    left = t.join(dense, ["coin", "exchange"], "left_semi").groupBy("coin", "snapshot_idx").agg(F.collect_set("exchange").alias("venues")).where(F.size("venues") >= 2)
    return left.select("coin", F.explode("venues").alias("exchange")).groupBy("coin", "exchange").agg(F.count(F.lit(1)).alias("n"))


@query("flt_12_near_duplicate_series", over("pair", "SELECT coin, exchange_a, exchange_b FROM pair GROUP BY ALL HAVING abs(corr(mid_a, mid_b)) <= 0.9999 AND var_pop(mid_a) > 0 AND var_pop(mid_b) > 0"))
def flt_12(spark, d):
    c = pairs.spread_series(venue.tickers(spark, d)).groupBy("coin", "exchange_a", "exchange_b").agg(F.abs(x.corr("mid_a", "mid_b")).alias("c"), F.var_pop("mid_a").alias("va"), F.var_pop("mid_b").alias("vb"))
    return c.where("c <= 0.9999 and va > 0 and vb > 0").select("coin", "exchange_a", "exchange_b")


@query("jn_08_asof_snapshot", over("z", "WITH q AS (SELECT window_id, coin, pair, snapshot_idx + 2 AS at FROM z WHERE snapshot_idx % 5 = 0) SELECT q.window_id, q.coin, q.pair, CAST(q.at AS INTEGER) AS at, round(arg_max(z.zscore, z.snapshot_idx), 6) AS mark FROM q JOIN z ON z.window_id = q.window_id AND z.coin = q.coin AND z.pair = q.pair AND z.snapshot_idx BETWEEN q.at - 4 AND q.at WHERE z.zscore IS NOT NULL GROUP BY ALL"))
def jn_08(spark, d):
    z = pairs.scored(venue.tickers(spark, d)).select(*_KEY, "zscore")
    wanted = z.where("snapshot_idx % 5 = 0").select(*s.KEYS, (F.col("snapshot_idx") + 2).alias("at")).withColumn("snapshot_idx", F.explode(F.array(*(F.col("at") - k for k in range(5)))))
    return wanted.join(z.where("zscore is not null"), _KEY).groupBy(*s.KEYS, "at").agg(r(F.max_by("zscore", "snapshot_idx"), 6).alias("mark"))


@query("jn_10_entry_exit_friction", over("fwd", f"SELECT f.window_id, f.coin, f.pair, f.snapshot_idx, round(e.funding_rate * 1e4, 4) AS at_entry, round(coalesce(o.funding_rate, e.funding_rate) * 1e4, 4) AS at_exit FROM fwd f JOIN ticker e ON e.coin = f.coin AND e.exchange = f.exchange_a AND e.snapshot_idx = f.snapshot_idx LEFT JOIN (SELECT * FROM ticker WHERE last_id % 2 = 0) o ON o.coin = f.coin AND o.exchange = f.exchange_a AND o.snapshot_idx = f.snapshot_idx + 1"))
def jn_10(spark, d):
    t = venue.tickers(spark, d)
    sig = pairs.align_forward(pairs.scored(t), 1).select(*_KEY, "exchange_a")
    entry = t.select("coin", F.col("exchange").alias("exchange_a"), "snapshot_idx", F.col("funding_rate").alias("e"))
    leave = t.where("last_id % 2 = 0").select("coin", F.col("exchange").alias("exchange_a"), (F.col("snapshot_idx") - 1).alias("snapshot_idx"), F.col("funding_rate").alias("o"))
    both = sig.join(entry, ["coin", "exchange_a", "snapshot_idx"]).join(leave, ["coin", "exchange_a", "snapshot_idx"], "left")
    return both.select(*_KEY, r(F.col("e") * 1e4).alias("at_entry"), r(F.coalesce("o", "e") * 1e4).alias("at_exit"))


@query("jn_17_model_compare", over("sig", "WITH p AS (SELECT window_id, target, pred AS model, zscore AS naive FROM sig WHERE target IS NOT NULL AND pred IS NOT NULL) SELECT window_id, round(avg(abs(target - model)) - avg(abs(target - naive)), 6) AS mae_gain, round(avg((sign(model) = sign(target))::INT) - avg((sign(naive) = sign(target))::INT), 6) AS hit_gain FROM p GROUP BY 1"))
def jn_17(spark, d):
    p = pairs.scored(venue.tickers(spark, d)).where("target is not null and pred is not null")
    t = F.col("target")
    hit = lambda c: F.avg((F.signum(c) == F.signum(t)).cast("double"))
    return p.groupBy("window_id").agg(r(F.avg(F.abs(t - F.col("pred"))) - F.avg(F.abs(t - F.col("zscore"))), 6).alias("mae_gain"), r(hit("pred") - hit("zscore"), 6).alias("hit_gain"))


@query("agg_12_sharpe", over("bet", "SELECT coin, pair, round(avg(pnl_proxy) / nullif(stddev_samp(pnl_proxy), 0), 6) AS sharpe FROM bet GROUP BY ALL"))
def agg_12(spark, d):
    return bets(spark, d).groupBy("coin", "pair").agg(r(x.sharpe(F.col("pnl_proxy")), 6).alias("sharpe"))


@query("agg_22_friction_report", over("bet", "SELECT coin, round(avg(2 * (fa.taker_bps + fb.taker_bps)), 4) AS fees, round(avg(gross_bps - 2 * (fa.taker_bps + fb.taker_bps)), 4) AS mean_net, round(avg((gross_bps > 2 * (fa.taker_bps + fb.taker_bps))::INT), 6) AS win_rate FROM bet JOIN fee fa ON fa.exchange = exchange_a JOIN fee fb ON fb.exchange = exchange_b GROUP BY coin", "fee"))
def agg_22(spark, d):
    b = _with_fees(spark, bets(spark, d))
    cost = 2 * (F.col("fee_a") + F.col("fee_b"))
    return b.groupBy("coin").agg(r(F.avg(cost)).alias("fees"), r(F.avg(F.col("gross_bps") - cost)).alias("mean_net"), r(F.avg((F.col("gross_bps") > cost).cast("double")), 6).alias("win_rate"))


@query("agg_31_session_views", over("tick", "SELECT exchange, time_bucket(INTERVAL 15 MINUTES, ts) AS start, CAST(count(*) AS BIGINT) AS entries FROM tick GROUP BY ALL"))
def agg_31(spark, d):
    return venue.ticks(spark, d).groupBy("exchange", F.window("ts", "15 minutes").alias("w")).agg(F.count(F.lit(1)).alias("entries")).select("exchange", F.col("w.start").cast("timestamp_ntz").alias("start"), "entries")


@query("agg_35_half_life_matrix", over("pair", "WITH l AS (SELECT coin, exchange_a, pair, spread_bps AS y, lag(spread_bps) OVER (PARTITION BY coin, pair ORDER BY snapshot_idx) AS x FROM pair), f AS (SELECT coin, pair, regr_slope(y, x) AS phi FROM l GROUP BY ALL) SELECT pair, " + ", ".join(f"max(CASE WHEN coin = '{c}' AND phi > 0 AND phi < 1 THEN round(0.6931471805599453 / -ln(phi), 4) END) AS {c}" for c in ("C0", "C1", "C2")) + " FROM f GROUP BY pair"))
def agg_35(spark, d):
    o = stats.ou_fit(pairs.spread_series(venue.tickers(spark, d)), "spread_bps", ["coin", "pair"], "snapshot_idx")
    return o.groupBy("pair").pivot("coin", ["C0", "C1", "C2"]).agg(F.max(F.round("half_life", 4)))


@query("agg_38_session_summary", over("bet", "SELECT window_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(dir_hit) AS BIGINT) AS hits, round(avg(pnl_proxy), 6) AS mean_pnl, round(quantile_cont(abs_pred, 0.5), 6) AS median_abs_pred FROM bet GROUP BY 1"))
def agg_38(spark, d):
    return bets(spark, d).groupBy("window_id").agg(F.count(F.lit(1)).alias("n"), F.sum("dir_hit").cast("long").alias("hits"), r(F.avg("pnl_proxy"), 6).alias("mean_pnl"), r(F.expr("percentile(abs_pred, 0.5)"), 6).alias("median_abs_pred"))


@query("agg_39_filter_lift", over("bet", "SELECT coin, round(avg(dir_hit) FILTER (WHERE abs_pred >= 0.9) - avg(dir_hit), 6) AS lift, round(avg(pnl_proxy) FILTER (WHERE abs_pred >= 0.9) - avg(pnl_proxy), 6) AS pnl_lift FROM bet GROUP BY coin"))
def agg_39(spark, d):
    gate = F.col("abs_pred") >= 0.9
    lift = lambda c: r(F.avg(F.when(gate, F.col(c))) - F.avg(c), 6)
    return bets(spark, d).groupBy("coin").agg(lift("dir_hit").alias("lift"), lift("pnl_proxy").alias("pnl_lift"))


@query("win_16_venue_share", over("ticker", "WITH v AS (SELECT coin, exchange, snapshot_idx, n_ticks / sum(n_ticks) OVER (PARTITION BY coin, snapshot_idx) AS share FROM ticker) SELECT coin, exchange, snapshot_idx, round(avg(share) OVER w, 6) AS mean_share, round(stddev_samp(share) OVER w, 6) AS std_share FROM v WINDOW w AS (PARTITION BY coin, exchange ORDER BY snapshot_idx ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"))
def win_16(spark, d):
    share = F.col("n_ticks") / F.sum("n_ticks").over(Window.partitionBy("coin", "snapshot_idx"))
    w = s.frame(("coin", "exchange"), w=10)
    return venue.tickers(spark, d).withColumn("share", share).select("coin", "exchange", "snapshot_idx", r(F.avg("share").over(w), 6).alias("mean_share"), r(F.stddev_samp("share").over(w), 6).alias("std_share"))


@query("srt_04_best_tau", over("bet", "WITH t AS (SELECT CAST(tau AS DOUBLE) AS tau, count(*) AS n, round(avg(pnl_proxy), 6) AS mean_pnl FROM bet, (VALUES (0.25), (0.5), (0.75), (1.0), (1.25)) AS g(tau) WHERE abs_pred >= CAST(tau AS DOUBLE) GROUP BY ALL HAVING count(*) >= 50) SELECT arg_max(tau, (mean_pnl, -tau)) AS tau, max(mean_pnl) AS mean_pnl FROM t"))
def srt_04(spark, d):
    levels = F.array(*(F.lit(v) for v in (0.25, 0.5, 0.75, 1.0, 1.25)))
    t = bets(spark, d).withColumn("tau", F.explode(F.filter(levels, lambda v: F.col("abs_pred") >= v))).groupBy("tau").agg(F.count(F.lit(1)).alias("n"), r(F.avg("pnl_proxy"), 6).alias("mean_pnl")).where("n >= 50")
    return t.agg(F.max_by("tau", F.struct("mean_pnl", -F.col("tau"))).alias("tau"), F.max("mean_pnl").alias("mean_pnl"))


@query("fea_01_pair_features", over("pair", f"SELECT {_K}, round(spread_bps, 4) AS spread_bps, round(spread_bps - lag(spread_bps) OVER w, 4) AS d1, round(avg(spread_bps) OVER f, 4) AS mean5, round(stddev_samp(spread_bps) OVER f, 4) AS std5, round((ask_a - bid_a) / ((ask_a + bid_a) / 2) * 1e4, 4) AS width_a FROM pair WINDOW w AS (PARTITION BY window_id, coin, pair ORDER BY snapshot_idx), f AS (PARTITION BY window_id, coin, pair ORDER BY snapshot_idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"))
def fea_01(spark, d):
    p = pairs.venue_pairs(venue.tickers(spark, d), ("coin", "window_id", "snapshot_idx"), values=("mid", "bid", "ask"))
    c = F.col("spread_bps")
    p = p.withColumn("spread_bps", x.spread_bps(F.col("mid_a"), F.col("mid_b")))
    f = s.frame(w=5)
    return p.select(*_KEY, r("spread_bps"), r(c - F.lag(c).over(s.series())).alias("d1"), r(F.avg(c).over(f)).alias("mean5"), r(F.stddev_samp(c).over(f)).alias("std5"), r(x.crossing_bps(F.col("bid_a"), F.col("ask_a"))).alias("width_a"))


@query("fea_07_micro_wide", over("ticker", "WITH l AS (SELECT coin, exchange, snapshot_idx, lag(imbalance) OVER (PARTITION BY window_id, coin, exchange ORDER BY snapshot_idx) AS v FROM ticker) SELECT coin, snapshot_idx, " + ", ".join(f"round(avg(v) FILTER (WHERE exchange = '{v}'), 6) AS {v}" for v in venue.VENUES) + " FROM l GROUP BY ALL"))
def fea_07(spark, d):
    lagged = s.lags(venue.tickers(spark, d), ["imbalance"], 1, ("window_id", "coin", "exchange"))
    return lagged.groupBy("coin", "snapshot_idx").pivot("exchange", venue.VENUES).agg(r(F.avg("imbalance_lag1"), 6))


@query("pos_10_stateless_fill", over("bet", "WITH k AS (SELECT *, row_number() OVER (PARTITION BY window_id, snapshot_idx ORDER BY round(abs_pred, 9) DESC, coin, pair) AS k FROM bet WHERE abs_pred >= 0.25) SELECT CAST(m AS INTEGER) AS max_open, CAST(count(*) AS BIGINT) AS n, round(avg(pnl_proxy), 6) AS mean_pnl FROM k, (VALUES (1), (3), (10)) AS g(m) WHERE k <= m GROUP BY m"))
def pos_10(spark, d):
    k = books.ranked_capacity(bets(spark, d).where("abs_pred >= 0.25"), 10, [F.desc(F.round("abs_pred", 9)), F.col("coin"), F.col("pair")])
    each = k.withColumn("max_open", F.explode(F.filter(F.array(F.lit(1), F.lit(3), F.lit(10)), lambda m: F.col("slot") <= m)))
    return each.groupBy("max_open").agg(F.count(F.lit(1)).alias("n"), r(F.avg("pnl_proxy"), 6).alias("mean_pnl"))


@query("pos_13_sharpe_family", over("bet", "WITH a AS (SELECT window_id, snapshot_idx, sum(pnl_proxy) AS pnl FROM bet GROUP BY ALL), h AS (SELECT window_id, snapshot_idx // 3 AS bar, sum(pnl) AS pnl FROM a GROUP BY ALL) SELECT window_id, (SELECT round(avg(pnl) / nullif(stddev_samp(pnl), 0), 6) FROM a WHERE a.window_id = w.window_id) AS per_snapshot, (SELECT round(avg(pnl) / nullif(stddev_samp(pnl), 0), 6) FROM h WHERE h.window_id = w.window_id) AS per_bar FROM (SELECT DISTINCT window_id FROM bet) w"))
def pos_13(spark, d):
    a = bets(spark, d).groupBy("window_id", "snapshot_idx").agg(F.sum("pnl_proxy").alias("pnl"))
    h = a.groupBy("window_id", F.floor(F.col("snapshot_idx") / 3).alias("bar")).agg(F.sum("pnl").alias("pnl"))
    one = a.groupBy("window_id").agg(r(x.sharpe(F.col("pnl")), 6).alias("per_snapshot"))
    return one.join(h.groupBy("window_id").agg(r(x.sharpe(F.col("pnl")), 6).alias("per_bar")), "window_id")


@query("pos_16_long_only", over("bet", "SELECT coin, round(avg(CASE WHEN pred > 0 THEN spread_delta_bps ELSE 0 END), 4) AS long_only, round(avg(sign(pred) * spread_delta_bps), 4) AS both_ways FROM bet GROUP BY coin"))
def pos_16(spark, d):
    c = F.col("spread_delta_bps")
    return bets(spark, d).groupBy("coin").agg(r(F.avg(F.when(F.col("pred") > 0, c).otherwise(0))).alias("long_only"), r(F.avg(F.signum("pred") * c)).alias("both_ways"))


@query("pos_17_buy_and_hold", over("candle", "WITH m AS (SELECT coin, exchange, close / lag(close) OVER (PARTITION BY coin, exchange ORDER BY snapshot_idx) - 1 AS ret FROM candle) SELECT coin, exchange, round(sum(ret), 6) AS total FROM m GROUP BY ALL"))
def pos_17(spark, d):
    w = Window.partitionBy("coin", "exchange").orderBy("snapshot_idx")
    return venue.candles(spark, d).withColumn("ret", F.col("close") / F.lag("close").over(w) - 1).groupBy("coin", "exchange").agg(r(F.sum("ret"), 6).alias("total"))


@query("sta_08_autocorrelation_half_life", over("pair", "WITH l AS (SELECT coin, pair, spread_bps - lag(spread_bps) OVER w AS dy, lag(spread_bps) OVER w AS x FROM pair WINDOW w AS (PARTITION BY coin, pair ORDER BY snapshot_idx)) SELECT coin, pair, round(sum(dy * x) / sum(x * x), 6) AS slope FROM l WHERE x IS NOT NULL GROUP BY ALL"))
def sta_08(spark, d):
    w = Window.partitionBy("coin", "pair").orderBy("snapshot_idx")
    l = pairs.spread_series(venue.tickers(spark, d)).select("coin", "pair", F.lag("spread_bps").over(w).alias("x"), (F.col("spread_bps") - F.lag("spread_bps").over(w)).alias("dy")).where("x is not null")  # noqa: E741
    return l.groupBy("coin", "pair").agg(r(F.sum(F.col("dy") * F.col("x")) / F.sum(F.col("x") * F.col("x")), 6).alias("slope"))


@query("sta_12_master_pairs", over("pair", "WITH l AS (SELECT coin, pair, mid_a, mid_b, spread_bps AS y, lag(spread_bps) OVER (PARTITION BY coin, pair ORDER BY snapshot_idx) AS x FROM pair) SELECT coin, pair, round(corr(mid_a, mid_b), 6) AS corr, round(regr_slope(mid_a, mid_b), 6) AS hedge_ratio, round(regr_slope(y, x), 6) AS phi FROM l GROUP BY ALL"))
def sta_12(spark, d):
    p = pairs.spread_series(venue.tickers(spark, d))
    corr = p.groupBy("coin", "pair").agg(r(x.corr("mid_a", "mid_b"), 6).alias("corr"), r(F.regr_slope("mid_a", "mid_b"), 6).alias("hedge_ratio"))
    ou = stats.ou_fit(p, "spread_bps", ["coin", "pair"], "snapshot_idx").select("coin", "pair", r("phi", 6))
    return corr.join(ou, ["coin", "pair"], "full_outer")


@query("sta_06_block_bootstrap_half_life")
def sta_06(spark, d):
    """Half-life intervals from moving blocks: each replicate draws block starts by hash."""
    fit = stats.block_bootstrap_slopes(pairs.spread_series(venue.tickers(spark, d)), "spread_bps", ["coin", "pair"], "snapshot_idx", 10, 300)
    fit = fit.where("phi > 0 and phi < 1").withColumn("half_life", F.lit(0.6931471805599453) / -F.ln("phi"))
    return fit.groupBy("coin", "pair").agg(F.count(F.lit(1)).alias("reps"), r(F.expr("percentile(half_life, 0.025)")).alias("lo"), r(F.expr("percentile(half_life, 0.975)")).alias("hi"))
