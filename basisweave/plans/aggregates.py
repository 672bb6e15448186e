"""Aggregates: spread and opportunity summaries, forecast and trading metrics, calibration, book reports."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basisweave.functions import exprs as x
from basisweave.operators import metrics, pairs
from basisweave.operators import series as s
from basisweave.plans.catalog import query, r
from basisweave.plans.relational import _with_fees, bets
from basisweave.plans.sql import BUCKET, over
from basisweave.sources import files, venue


@query("agg_01_spread_matrix", over("ticker", "SELECT coin, snapshot_idx, CAST(count(*) AS BIGINT) AS num_exchanges, round(min(mid), 4) AS price_min, round(max(mid), 4) AS price_max, round((max(mid) - min(mid)) / avg(mid) * 1e4, 4) AS total_spread_bps, arg_min(exchange, (mid, exchange)) AS cheapest_exchange, arg_min(exchange, (-mid, exchange)) AS most_expensive_exchange FROM ticker GROUP BY ALL HAVING count(*) >= 2"))
def agg_01(spark, d):
    return pairs.spread_matrix(venue.tickers(spark, d)).select("coin", "snapshot_idx", "num_exchanges", r("price_min"), r("price_max"), r("total_spread_bps"), "cheapest_exchange", "most_expensive_exchange")


@query("agg_02_low_high_venue", "SELECT p_brand AS token, CAST(count(*) AS BIGINT) AS n_pools, min(p_retailprice) AS low_price, max(p_retailprice) AS high_price, arg_min(p_partkey, (p_retailprice, p_partkey)) AS low_venue, arg_min(p_partkey, (-p_retailprice, p_partkey)) AS high_venue, round(CAST((max(p_retailprice) - min(p_retailprice)) / min(p_retailprice) * 1e4 AS DOUBLE), 4) AS spread_bps FROM part GROUP BY 1")
def agg_02(spark, d):
    p = venue.table(spark, d, "part")
    lo, hi = F.min("p_retailprice"), F.max("p_retailprice")
    return p.groupBy(F.col("p_brand").alias("token")).agg(
        F.count(F.lit(1)).alias("n_pools"), lo.alias("low_price"), hi.alias("high_price"), F.min(F.struct("p_retailprice", "p_partkey"))["p_partkey"].alias("low_venue"), F.min(F.struct((-F.col("p_retailprice")).alias("v"), "p_partkey"))["p_partkey"].alias("high_venue"), r(((hi - lo) / lo * 1e4).cast("double")).alias("spread_bps")
    )


@query("agg_03_opportunity_scan", over("pair", "SELECT coin, pair, round(max(abs(spread_bps)), 4) AS max_abs, round(avg(abs(spread_bps)), 4) AS mean_abs, round(stddev_samp(spread_bps), 4) AS std, CAST(arg_max(snapshot_idx, (round(abs(spread_bps), 6), -snapshot_idx)) AS INTEGER) AS best_snap, round(avg(abs(spread_bps)) - max(2 * (fa.taker_bps + fb.taker_bps)), 4) AS net_mean FROM pair JOIN fee fa ON fa.exchange = exchange_a JOIN fee fb ON fb.exchange = exchange_b GROUP BY ALL", "fee"))
def agg_03(spark, d):
    f = _with_fees(spark, pairs.spread_series(venue.tickers(spark, d)))
    a = F.abs("spread_bps")
    return f.groupBy("coin", "pair").agg(
        r(F.max(a)).alias("max_abs"), r(F.avg(a)).alias("mean_abs"), r(F.stddev_samp("spread_bps")).alias("std"), F.max_by("snapshot_idx", F.struct(F.round(a, 6), -F.col("snapshot_idx"))).alias("best_snap"), r(F.avg(a) - F.max(2 * (F.col("fee_a") + F.col("fee_b")))).alias("net_mean")
    )


@query("agg_03_category_rollup", over("ticker", "SELECT coin, exchange, CAST(count(*) AS BIGINT) AS n, round(avg(mid), 4) AS mean_mid FROM ticker GROUP BY ROLLUP (coin, exchange)"))
def agg_03_rollup(spark, d):
    return venue.tickers(spark, d).rollup("coin", "exchange").agg(F.count(F.lit(1)).alias("n"), r(F.avg("mid")).alias("mean_mid"))


@query("agg_04_funding_arbitrage", over("ticker", "SELECT coin, snapshot_idx, arg_min(exchange, (funding_rate, exchange)) AS long_venue, arg_min(exchange, (-funding_rate, exchange)) AS short_venue, round((max(funding_rate) - min(funding_rate)) * 1e4, 4) AS spread_bps, round((max(funding_rate) - min(funding_rate)) * 3 * 365 * 100, 4) AS annual_pct FROM ticker GROUP BY ALL HAVING count(*) >= 2"))
def agg_04(spark, d):
    t = venue.tickers(spark, d)
    gap = F.max("funding_rate") - F.min("funding_rate")
    out = t.groupBy("coin", "snapshot_idx").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("funding_rate", "exchange"))["exchange"].alias("long_venue"), F.min(F.struct((-F.col("funding_rate")).alias("v"), "exchange"))["exchange"].alias("short_venue"), r(gap * 1e4).alias("spread_bps"), r(gap * 3 * 365 * 100).alias("annual_pct")
    )
    return out.where("n >= 2").drop("n")


@query("agg_05_candle_quality", over("candle", "WITH g AS (SELECT *, snapshot_idx - lag(snapshot_idx) OVER (PARTITION BY coin, exchange ORDER BY snapshot_idx) AS gap FROM candle) SELECT coin, exchange, CAST(count(*) AS BIGINT) AS n_rows, round(100.0 * count(*) / (max(snapshot_idx) - min(snapshot_idx) + 1), 4) AS coverage_pct, CAST(coalesce(max(gap), 0) AS INTEGER) AS largest_gap, CAST(count(*) FILTER (WHERE high < low OR open > high OR close < low) AS BIGINT) AS broken FROM g GROUP BY ALL"))
def agg_05(spark, d):
    w = Window.partitionBy("coin", "exchange").orderBy("snapshot_idx")
    g = venue.candles(spark, d).withColumn("gap", F.col("snapshot_idx") - F.lag("snapshot_idx").over(w))
    return g.groupBy("coin", "exchange").agg(
        F.count(F.lit(1)).alias("n_rows"), r(100.0 * F.count(F.lit(1)) / (F.max("snapshot_idx") - F.min("snapshot_idx") + 1)).alias("coverage_pct"), F.coalesce(F.max("gap"), F.lit(0)).alias("largest_gap"), F.count_if((F.col("high") < F.col("low")) | (F.col("open") > F.col("high")) | (F.col("close") < F.col("low"))).alias("broken")
    )


@query("agg_06_feature_diagnostics", over("sig", "SELECT coin, round(avg(CASE WHEN zscore IS NULL THEN 1.0 ELSE 0 END), 6) AS null_share, round(skewness(zscore), 5) AS skew, round(kurtosis(zscore), 5) AS kurt, round(avg(CASE WHEN abs(zscore) < 0.1 THEN 1.0 WHEN zscore IS NOT NULL THEN 0 END), 6) AS near_zero, round(corr(zscore, target), 5) AS corr_target FROM sig GROUP BY coin"))
def agg_06(spark, d):
    z = F.col("zscore")
    return pairs.scored(venue.tickers(spark, d)).groupBy("coin").agg(
        r(F.avg(z.isNull().cast("double")), 6).alias("null_share"), r(x.sample_skew(z), 5).alias("skew"), r(x.sample_kurtosis(z), 5).alias("kurt"), r(F.avg((F.abs(z) < 0.1).cast("double")), 6).alias("near_zero"), r(x.corr("zscore", "target"), 5).alias("corr_target")
    )


@query("agg_07_venue_correlation", over("pair", "SELECT coin, exchange_a, exchange_b, round(corr(mid_a, mid_b), 6) AS corr, CAST(count(*) AS BIGINT) AS n FROM pair GROUP BY ALL"))
def agg_07(spark, d):
    return pairs.spread_series(venue.tickers(spark, d)).groupBy("coin", "exchange_a", "exchange_b").agg(r(x.corr("mid_a", "mid_b"), 6).alias("corr"), F.count(F.lit(1)).alias("n"))


@query("agg_08_spearman", over("pair", "WITH k AS (SELECT coin, pair, rank() OVER (PARTITION BY coin, pair ORDER BY mid_a) + (count(*) OVER (PARTITION BY coin, pair, mid_a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY coin, pair ORDER BY mid_b) + (count(*) OVER (PARTITION BY coin, pair, mid_b) - 1) / 2.0 AS rb FROM pair) SELECT coin, pair, round(corr(ra, rb), 6) AS spearman FROM k GROUP BY ALL"))
def agg_08(spark, d):
    p = pairs.spread_series(venue.tickers(spark, d))
    average = lambda c: F.rank().over(Window.partitionBy("coin", "pair").orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy("coin", "pair", c)) - 1) / 2
    return p.select("coin", "pair", average("mid_a").alias("ra"), average("mid_b").alias("rb")).groupBy("coin", "pair").agg(r(x.corr("ra", "rb"), 6).alias("spearman"))


@query("agg_09_fisher_interval", over("pair", "SELECT coin, pair, round(tanh(atanh(c) - 1.959963984540054 / sqrt(n - 3)), 6) AS lo, round(tanh(atanh(c) + 1.959963984540054 / sqrt(n - 3)), 6) AS hi FROM (SELECT coin, pair, corr(mid_a, mid_b) AS c, count(*) AS n FROM pair GROUP BY ALL) WHERE n > 3"))
def agg_09(spark, d):
    c = pairs.spread_series(venue.tickers(spark, d)).groupBy("coin", "pair").agg(x.corr("mid_a", "mid_b").alias("c"), F.count(F.lit(1)).alias("n")).where("n > 3")
    half = 1.959963984540054 / F.sqrt(F.col("n") - 3)
    return c.select("coin", "pair", r(F.tanh(F.atanh("c") - half), 6).alias("lo"), r(F.tanh(F.atanh("c") + half), 6).alias("hi"))


_METRICS = "CAST(count(*) AS BIGINT) AS n, round(avg(abs(target - pred)), 6) AS mae, round(sqrt(avg((target - pred) ** 2)), 6) AS rmse, round(1 - sum((target - pred) ** 2) / nullif(count(*) * var_pop(target), 0), 6) AS r2, round(avg(CASE WHEN pred <> 0 AND target <> 0 THEN (sign(pred) = sign(target))::INT END), 6) AS dir_acc, round(corr(pred, target), 6) AS corr, round(stddev_samp(target), 6) AS target_std"
_TRADING = "round(avg(sign(pred) * target), 6) AS mean_pnl, round(sum(sign(pred) * target), 4) AS total_pnl, round(avg(sign(pred) * target) / nullif(stddev_samp(sign(pred) * target), 0), 6) AS sharpe"


def _rounded(df, keys):
    digits = {"n": None, "total_pnl": 4}
    return df.select(*keys, *(c if digits.get(c, 6) is None else r(c, digits.get(c, 6)) for c in df.columns if c not in keys))


@query("agg_10_forecast_metrics", over("sig", f"SELECT window_id, {_METRICS} FROM sig WHERE pred IS NOT NULL AND target IS NOT NULL GROUP BY window_id"))
def agg_10(spark, d):
    sig = pairs.scored(venue.tickers(spark, d)).where("pred is not null and target is not null")
    return _rounded(sig.groupBy("window_id").agg(*metrics.forecast_metrics(F.col("pred"), F.col("target"))), ["window_id"])


@query("agg_11_trading_metrics", over("sig", f"SELECT coin, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN pred <> 0 AND target <> 0 THEN (sign(pred) = sign(target))::INT END), 6) AS dir_acc, {_TRADING} FROM sig WHERE pred IS NOT NULL AND target IS NOT NULL GROUP BY coin"))
def agg_11(spark, d):
    sig = pairs.scored(venue.tickers(spark, d)).where("pred is not null and target is not null")
    return _rounded(sig.groupBy("coin").agg(*metrics.trading_metrics(F.col("pred"), F.col("target"))), ["coin"])


@query("agg_13_tau_sweep", over("sig", f"SELECT CAST(tau AS DOUBLE) AS tau, {_METRICS}, {_TRADING} FROM sig, (VALUES (0.0), (0.25), (0.5), (0.75), (0.9), (1.0), (1.25), (1.5)) AS g(tau) WHERE pred IS NOT NULL AND target IS NOT NULL AND abs(pred) >= CAST(tau AS DOUBLE) GROUP BY ALL"))
def agg_13(spark, d):
    return _rounded(metrics.tau_sweep(pairs.scored(venue.tickers(spark, d)), (0.0, 0.25, 0.5, 0.75, 0.9, 1.0, 1.25, 1.5)), ["tau"])


@query("agg_14_period_sharpe", over("bet", f"WITH h AS (SELECT window_id, snapshot_idx * {BUCKET} // 86400 AS day, sum(pnl_proxy) AS pnl FROM bet WHERE abs_pred >= 0.5 GROUP BY ALL) SELECT window_id, CAST(count(*) AS BIGINT) AS n_days, round(avg(pnl) / nullif(stddev_samp(pnl), 0), 6) AS sharpe FROM h GROUP BY 1"))
def agg_14(spark, d):
    day = bets(spark, d).where("abs_pred >= 0.5").groupBy("window_id", venue.day_of(venue.bucket_of(spark, d)).alias("day")).agg(F.sum("pnl_proxy").alias("pnl"))
    return day.groupBy("window_id").agg(F.count(F.lit(1)).alias("n_days"), r(x.sharpe(F.col("pnl")), 6).alias("sharpe"))


@query("agg_14_period_sharpe_with_empty", over("bet", f"WITH b AS (SELECT *, snapshot_idx * {BUCKET} // 86400 AS day FROM bet), g AS (SELECT window_id, unnest(range(min(day), max(day) + 1)) AS day FROM b GROUP BY 1), h AS (SELECT window_id, day, sum(pnl_proxy) AS pnl FROM b WHERE abs_pred >= 1.2 GROUP BY ALL) SELECT window_id, CAST(count(*) AS BIGINT) AS n_days, CAST(count(pnl) AS BIGINT) AS n_traded, round(avg(coalesce(pnl, 0)) / nullif(stddev_samp(coalesce(pnl, 0)), 0), 6) AS sharpe FROM g LEFT JOIN h USING (window_id, day) GROUP BY 1"))
def agg_14_empty(spark, d):
    """Days from a run's first bet to its last; those without a confident one count as zero."""
    b = bets(spark, d).withColumn("day", venue.day_of(venue.bucket_of(spark, d)))
    grid = b.groupBy("window_id").agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    day = b.where("abs_pred >= 1.2").groupBy("window_id", "day").agg(F.sum("pnl_proxy").alias("pnl"))
    return grid.join(day, ["window_id", "day"], "left").groupBy("window_id").agg(F.count(F.lit(1)).alias("n_days"), F.count("pnl").alias("n_traded"), r(x.sharpe(F.coalesce("pnl", F.lit(0.0))), 6).alias("sharpe"))


_NET = "SELECT *, gross_bps - 5 AS net_bps, 1 + snapshot_idx % 3 AS hold FROM bet WHERE abs_pred >= 0.5"


@query("agg_15_book_summary", over("bet", f"SELECT coin, CAST(count(*) AS BIGINT) AS n_trades, round(sum(gross_bps), 2) AS total_gross_bps, round(sum(net_bps), 2) AS total_net_bps, round(avg((net_bps > 0)::INT), 6) AS win_rate, round(avg(net_bps) / nullif(stddev_pop(net_bps), 0), 6) AS sharpe, round(sum(net_bps) FILTER (WHERE net_bps > 0) / nullif(-sum(net_bps) FILTER (WHERE net_bps < 0), 0), 6) AS profit_factor, round(avg(hold), 6) AS avg_hold, CAST(quantile_cont(hold, 0.5) AS DOUBLE) AS median_hold, round(CAST(quantile_cont(hold, 0.9) AS DOUBLE), 4) AS p90_hold FROM ({_NET}) GROUP BY coin"))
def agg_15(spark, d):
    t = bets(spark, d).where("abs_pred >= 0.5").withColumns({"net_bps": F.col("gross_bps") - 5, "hold": 1 + F.col("snapshot_idx") % 3})
    o = t.groupBy("coin").agg(*metrics.book_summary())
    return o.select("coin", "n_trades", r("total_gross_bps", 2), r("total_net_bps", 2), r("win_rate", 6), r("sharpe", 6), r("profit_factor", 6), r("avg_hold", 6), F.col("median_hold").cast("double").alias("median_hold"), r("p90_hold"))


@query("agg_16_cost_grid", over("bet", "SELECT CAST(c AS DOUBLE) AS cost_bps, CAST(count(*) AS BIGINT) AS n, round(avg(gross_bps - c), 4) AS mean_net, round(quantile_cont(gross_bps - c, 0.5), 4) AS median_net, round(avg((gross_bps - c > 0)::INT), 6) AS win_rate, round(avg(gross_bps - c) / nullif(stddev_samp(gross_bps - c), 0), 6) AS sharpe FROM bet, (VALUES (0::DOUBLE), (4), (8), (16), (32)) AS g(c) GROUP BY c"))
def agg_16(spark, d):
    o = metrics.cost_grid(bets(spark, d), (0, 4, 8, 16, 32))
    return o.select("cost_bps", "n", r("mean_net"), r("median_net"), r("win_rate", 6), r("sharpe", 6))


@query("agg_17_quantile_bins", over("bet", "WITH b AS (SELECT round(abs_pred, 9) AS abs_pred, gross_bps FROM bet), e AS (SELECT list_distinct(quantile_cont(abs_pred, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])) AS edges FROM b), k AS (SELECT b.*, len(list_filter(list_slice(list_sort(edges), 2, len(edges) - 1), lambda v: v < abs_pred)) AS bin FROM b, e) SELECT CAST(bin AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS n, round(avg(gross_bps), 4) AS mean_gross, round(avg((gross_bps > 0)::INT), 6) AS win_rate FROM k GROUP BY bin"))
def agg_17(spark, d):
    b = bets(spark, d).withColumn("abs_pred", F.round("abs_pred", 9))
    return metrics.quantile_bins(b, 5).select("bin", "n", r("mean_gross"), r("win_rate", 6))


@query("agg_18_top_fraction", over("bet", "WITH k AS (SELECT *, row_number() OVER (ORDER BY round(abs_pred, 9) DESC, window_id, coin, pair, snapshot_idx) AS k, count(*) OVER () AS n FROM bet) SELECT CAST(f AS DOUBLE) AS frac, CAST(count(*) AS BIGINT) AS n, round(avg(gross_bps), 4) AS mean_gross, round(avg((gross_bps > 0)::INT), 6) AS win_rate FROM k, (VALUES (1.0::DOUBLE), (0.5), (0.25), (0.1), (0.05), (0.01)) AS g(f) WHERE k.k <= greatest(1, floor(k.n * f)) GROUP BY f"))
def agg_18(spark, d):
    o = metrics.top_fraction(bets(spark, d), (1.0, 0.5, 0.25, 0.1, 0.05, 0.01), [F.desc(F.round("abs_pred", 9)), F.col("window_id"), F.col("coin"), F.col("pair"), F.col("snapshot_idx")])
    return o.select("frac", "n", r("mean_gross"), r("win_rate", 6))


@query("agg_20_fee_clearing_floor", over("bet", "WITH k AS (SELECT row_number() OVER o AS k, avg(gross_bps) OVER o AS m FROM bet WINDOW o AS (ORDER BY round(abs_pred, 9) DESC, window_id, coin, pair, snapshot_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT CAST(max(k) AS BIGINT) AS loosest, CAST(min(k) AS BIGINT) AS tightest, CAST(count(*) AS BIGINT) AS n FROM k WHERE m > 20 AND k >= 20"))
def agg_20(spark, d):
    order = [F.desc(F.round("abs_pred", 9)), F.col("window_id"), F.col("coin"), F.col("pair"), F.col("snapshot_idx")]
    return running_mean(bets(spark, d), order, "gross_bps").where("mean > 20 and rank >= 20").agg(F.max("rank").alias("loosest"), F.min("rank").alias("tightest"), F.count(F.lit(1)).alias("n"))


def running_mean(rows, order, value):
    """Running mean over all rows in order: sums within sorted partitions, shifted by the totals of those before."""
    placed = files.kept(rows.sort(*order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "ordered")
    own = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    totals = placed.groupBy("_part").agg(F.sum(value).alias("_s"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    shifted = totals.select("_part", F.coalesce(F.sum("_s").over(before), F.lit(0.0)).alias("_s0"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"))
    run = placed.withColumns({"_s": F.sum(value).over(own), "_n": F.count(F.lit(1)).over(own)}).join(F.broadcast(shifted), "_part")
    return run.select((F.col("_n") + F.col("_n0")).alias("rank"), ((F.col("_s") + F.col("_s0")) / (F.col("_n") + F.col("_n0"))).alias("mean"))


@query("agg_23_volatility_regimes", over("pair", "WITH v AS (SELECT coin, stddev_pop(spread_bps) OVER f AS sd, count(*) OVER f AS n FROM pair WINDOW f AS (PARTITION BY window_id, coin, pair ORDER BY snapshot_idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) SELECT coin, round(quantile_cont(sd, 0.1), 3) AS p10, round(quantile_cont(sd, 0.5), 3) AS p50, round(quantile_cont(sd, 0.9), 3) AS p90, round(avg((sd > 300)::INT), 6) AS share_wild FROM v WHERE n = 20 GROUP BY coin"))
def agg_23(spark, d):
    f = s.frame(w=20)
    v = pairs.spread_series(venue.tickers(spark, d)).select("coin", F.stddev_pop("spread_bps").over(f).alias("sd"), F.count(F.lit(1)).over(f).alias("n")).where("n = 20")
    return v.groupBy("coin").agg(*(r(F.expr(f"percentile(sd, {p / 100})"), 3).alias(f"p{p}") for p in (10, 50, 90)), r(F.avg((F.col("sd") > 300).cast("double")), 6).alias("share_wild"))


@query("agg_24_time_of_day", over("pair", "SELECT CAST(hour(ts_a) AS INTEGER) AS hour, CAST(count(*) AS BIGINT) AS n, round(avg(abs(spread_bps)), 4) AS mean_abs, round(stddev_samp(spread_bps), 4) AS std FROM pair GROUP BY 1"))
def agg_24(spark, d):
    return pairs.spread_series(venue.tickers(spark, d)).groupBy(F.hour("ts_a").alias("hour")).agg(F.count(F.lit(1)).alias("n"), r(F.avg(F.abs("spread_bps"))).alias("mean_abs"), r(F.stddev_samp("spread_bps")).alias("std"))


@query("agg_25_crossing_percentiles", over("ticker", "SELECT exchange, round(avg((ask - bid) / mid * 1e4), 4) AS mean, round(quantile_cont((ask - bid) / mid * 1e4, 0.5), 4) AS median, round(quantile_cont((ask - bid) / mid * 1e4, 0.95), 4) AS p95 FROM ticker GROUP BY 1"))
def agg_25(spark, d):
    c = venue.tickers(spark, d).withColumn("c", (F.col("ask") - F.col("bid")) / F.col("mid") * 1e4)
    return c.groupBy("exchange").agg(r(F.avg("c")).alias("mean"), r(F.expr("percentile(c, 0.5)")).alias("median"), r(F.expr("percentile(c, 0.95)")).alias("p95"))


@query("agg_26_direction_asymmetry", over("bet", "SELECT direction, CAST(count(*) AS BIGINT) AS n, round(avg(gross_bps), 4) AS mean_gross, round(avg(dir_hit), 6) AS hit_rate FROM bet GROUP BY direction"))
def agg_26(spark, d):
    return bets(spark, d).groupBy("direction").agg(F.count(F.lit(1)).alias("n"), r(F.avg("gross_bps")).alias("mean_gross"), r(F.avg("dir_hit"), 6).alias("hit_rate"))


@query("agg_27_signed_rollup", over("tick", "SELECT coin, exchange, snapshot_idx, round(sum(CASE WHEN side = 'buy' THEN volume ELSE -volume END), 4) AS signed, round(sum(abs(volume)), 4) AS absolute FROM tick GROUP BY ALL"))
def agg_27(spark, d):
    t = venue.with_snapshot(venue.ticks(spark, d), venue.bucket_of(spark, d))
    return t.groupBy("coin", "exchange", "snapshot_idx").agg(r(F.sum(F.when(F.col("side") == "buy", F.col("volume")).otherwise(-F.col("volume")))).alias("signed"), r(F.sum(F.abs("volume"))).alias("absolute"))


@query("agg_28_keep_latest", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def agg_28(spark, d):
    last = F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id"))
    return venue.table(spark, d, "events").groupBy("user_id").agg(last.alias("l")).select("user_id", "l.event_id", "l.event_type")


@query("agg_29_pivot_wide", over("ticker", "SELECT coin, snapshot_idx, " + ", ".join(f"round(avg(mid) FILTER (WHERE exchange = '{v}'), 4) AS mid_{v}" for v in venue.VENUES) + " FROM ticker GROUP BY ALL"))
def agg_29(spark, d):
    wide = venue.tickers(spark, d).groupBy("coin", "snapshot_idx").pivot("exchange", venue.VENUES).agg(r(F.avg("mid")))
    return wide.select("coin", "snapshot_idx", *(F.col(v).alias(f"mid_{v}") for v in venue.VENUES))


@query("agg_30_signal_bars", over("z", "SELECT coin, pair, CAST(count(*) FILTER (WHERE zscore <= -1) AS BIGINT) AS long_bars, CAST(count(*) FILTER (WHERE zscore >= 1) AS BIGINT) AS short_bars, round(avg(coalesce((abs(zscore) >= 1)::INT, 0)), 6) AS invested FROM z GROUP BY ALL"))
def agg_30(spark, d):
    z = F.col("zscore")
    return pairs.scored(venue.tickers(spark, d)).groupBy("coin", "pair").agg(F.count_if(z <= -1).alias("long_bars"), F.count_if(z >= 1).alias("short_bars"), r(F.avg(F.coalesce((F.abs(z) >= 1).cast("int"), F.lit(0))), 6).alias("invested"))


@query("agg_33_snapshot_completeness", over("ticker", "SELECT coin, CAST(max(snapshot_idx) - min(snapshot_idx) + 1 AS INTEGER) AS expected, CAST(count(DISTINCT snapshot_idx) AS BIGINT) AS seen, CAST(count(*) FILTER (WHERE n_ticks >= 2) AS BIGINT) AS full_cells, max(snapshot_idx) >= 20 AS warm FROM ticker GROUP BY coin"))
def agg_33(spark, d):
    return venue.tickers(spark, d).groupBy("coin").agg((F.max("snapshot_idx") - F.min("snapshot_idx") + 1).alias("expected"), F.count_distinct("snapshot_idx").alias("seen"), F.count_if(F.col("n_ticks") >= 2).alias("full_cells"), (F.max("snapshot_idx") >= 20).alias("warm"))


@query("agg_34_winsor_bounds", over("pair", "SELECT coin, round(quantile_cont(spread_bps, 0.01), 3) AS lo, round(quantile_cont(spread_bps, 0.99), 3) AS hi, round(avg(spread_bps), 4) AS mean, round(stddev_samp(spread_bps), 4) AS std FROM pair WHERE window_id = 'w1' GROUP BY coin"))
def agg_34(spark, d):
    p = pairs.spread_series(venue.tickers(spark, d)).where("window_id = 'w1'")
    return p.groupBy("coin").agg(r(F.expr("percentile(spread_bps, 0.01)"), 3).alias("lo"), r(F.expr("percentile(spread_bps, 0.99)"), 3).alias("hi"), r(F.avg("spread_bps")).alias("mean"), r(F.stddev_samp("spread_bps")).alias("std"))


@query("agg_36_missing_report", over("ticker", "WITH s AS (SELECT min(snapshot_idx) AS lo, max(snapshot_idx) AS hi FROM ticker), g AS (SELECT coin, exchange, unnest(range(lo, hi + 1)) AS snapshot_idx FROM (SELECT DISTINCT coin, exchange FROM ticker), s) SELECT g.coin, g.exchange, CAST(count(t.mid) AS BIGINT) AS n, round(avg((t.mid IS NULL)::INT), 6) AS missing FROM g LEFT JOIN ticker t USING (coin, exchange, snapshot_idx) GROUP BY ALL"))
def agg_36(spark, d):
    """Of the snapshots from the first to the last of all series, those that a series has no price in. No grid is laid out."""
    own = venue.tickers(spark, d).groupBy("coin", "exchange").agg(F.count("mid").alias("n"), F.min("snapshot_idx").alias("lo"), F.max("snapshot_idx").alias("hi"))
    span = own.agg((F.max("hi") - F.min("lo") + 1).alias("grid"))
    return own.crossJoin(F.broadcast(span)).select("coin", "exchange", "n", r(1 - F.col("n") / F.col("grid"), 6).alias("missing"))


@query("agg_37_pair_ranking", over("pair", "SELECT coin, pair, round(avg(spread_bps), 4) AS mean, round(stddev_samp(spread_bps), 4) AS std, round(min(spread_bps), 4) AS lo, round(max(spread_bps), 4) AS hi, round(max(spread_bps) - min(spread_bps), 4) AS width FROM pair GROUP BY ALL"))
def agg_37(spark, d):
    c = "spread_bps"
    return pairs.spread_series(venue.tickers(spark, d)).groupBy("coin", "pair").agg(r(F.avg(c)).alias("mean"), r(F.stddev_samp(c)).alias("std"), r(F.min(c)).alias("lo"), r(F.max(c)).alias("hi"), r(F.max(c) - F.min(c)).alias("width"))


@query("agg_40_asset_summary", over("bet", "WITH p AS (SELECT coin, pair, sum(gross_bps - 5) AS net FROM bet WHERE abs_pred >= 0.5 GROUP BY ALL) SELECT coin, CAST(count(*) FILTER (WHERE net > 0) AS BIGINT) AS profitable, CAST(count(*) AS BIGINT) AS n, round(max(net), 2) AS best_net FROM p GROUP BY coin"))
def agg_40(spark, d):
    p = bets(spark, d).where("abs_pred >= 0.5").groupBy("coin", "pair").agg(F.sum(F.col("gross_bps") - 5).alias("net"))
    return p.groupBy("coin").agg(F.count_if(F.col("net") > 0).alias("profitable"), F.count(F.lit(1)).alias("n"), r(F.max("net"), 2).alias("best_net"))
