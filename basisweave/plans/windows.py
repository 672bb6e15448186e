"""Window operators: lags, rolling statistics, OU fits, fills, drawdowns, ranks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basisweave.functions import exprs as x
from basisweave.operators import pairs
from basisweave.operators import series as s
from basisweave.plans.catalog import query, r
from basisweave.plans.relational import bets
from basisweave.plans.sql import over
from basisweave.sources import venue

KEYS = "window_id, coin, pair, snapshot_idx"
_KEY = ["window_id", "coin", "pair", "snapshot_idx"]


def spreads(spark, d):
    return pairs.spread_series(venue.tickers(spark, d))


@query("win_01_lags", over("pair", f"SELECT {KEYS}, round(lag(spread_bps, 1) OVER w, 4) AS spread_bps_lag1, round(lag(spread_bps, 2) OVER w, 4) AS spread_bps_lag2 FROM pair WINDOW w AS (PARTITION BY window_id, coin, pair ORDER BY snapshot_idx)"))
def win_01(spark, d):
    return s.lags(spreads(spark, d), ["spread_bps"], 2).select(*_KEY, r("spread_bps_lag1"), r("spread_bps_lag2"))


@query("win_02_targets", over("sig", f"SELECT {KEYS}, round(target, 6) AS target, round(target - zscore, 6) AS z_delta, abs(target) < abs(zscore) AS narrowed, sign(target) <> sign(zscore) AS crossed FROM sig"))
def win_02(spark, d):
    t, z = F.col("target"), F.col("zscore")
    return pairs.scored(venue.tickers(spark, d)).select(*_KEY, r("target", 6), r(t - z, 6).alias("z_delta"), (F.abs(t) < F.abs(z)).alias("narrowed"), (F.signum(t) != F.signum(z)).alias("crossed"))


@query("win_03_rolling_zscore", over("z", f"SELECT {KEYS}, round(spread_bps, 4) AS spread_bps, round(zscore, 6) AS zscore FROM z"))
def win_03(spark, d):
    z = s.rolling_z(F.col("spread_bps"), s.frame(w=20), 6)
    return spreads(spark, d).withColumn("zscore", z).select(*_KEY, r("spread_bps"), r("zscore", 6))


_FRAME = "CASE WHEN count(spread_bps) OVER f >= {mp} AND stddev_samp(spread_bps) OVER f > 1e-6 THEN round((spread_bps - avg(spread_bps) OVER f) / stddev_samp(spread_bps) OVER f, 5) END"


@query("win_03_prefix_zscore", over("pair", f"SELECT {KEYS}, {_FRAME.format(mp=18)} AS zscore FROM pair WINDOW f AS (PARTITION BY window_id, coin, pair ORDER BY snapshot_idx ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"))
def win_03_prefix(spark, d):
    return s.prefix_rolling_z(spreads(spark, d), "spread_bps", w=60, min_periods=18).select(*_KEY, r("zscore", 5))


@query("win_04_population_zscore", over("pair", f"SELECT {KEYS}, CASE WHEN count(*) OVER f = 20 AND stddev_pop(spread_bps) OVER f > 1e-10 THEN round((spread_bps - avg(spread_bps) OVER f) / stddev_pop(spread_bps) OVER f, 6) END AS zscore FROM pair WINDOW f AS (PARTITION BY window_id, coin, pair ORDER BY snapshot_idx ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"))
def win_04(spark, d):
    z = s.rolling_z(F.col("spread_bps"), s.frame(w=20, exclude_current=True), 20, sample=False, eps=1e-10)
    return spreads(spark, d).select(*_KEY, r(z, 6).alias("zscore"))


@query("win_05_rolling_stats", over("pair", f"SELECT {KEYS}, " + ", ".join(f"round(avg(spread_bps) OVER f{w}, 4) AS mean{w}, round(CASE WHEN count(*) OVER f{w} >= 2 THEN stddev_samp(spread_bps) OVER f{w} END, 4) AS std{w}, round(min(spread_bps) OVER f{w}, 4) AS min{w}, round(max(spread_bps) OVER f{w}, 4) AS max{w}" for w in (3, 5, 10, 20)) + " FROM pair WINDOW " + ", ".join(f"f{w} AS (PARTITION BY window_id, coin, pair ORDER BY snapshot_idx ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)" for w in (3, 5, 10, 20))))
def win_05(spark, d):
    cols = []
    for w in (3, 5, 10, 20):
        f = s.frame(w=w)
        cols += [r(fn("spread_bps").over(f)).alias(f"{n}{w}") for n, fn in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))]
    return spreads(spark, d).select(*_KEY, *cols)


@query("win_06_fill_limit", over("ticker", "SELECT coin, exchange, snapshot_idx, round(coalesce(last_value(CASE WHEN last_id % 3 = 0 THEN mid END IGNORE NULLS) OVER w, -1), 4) AS filled FROM ticker WINDOW w AS (PARTITION BY coin, exchange ORDER BY snapshot_idx ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)"))
def win_06(spark, d):
    t = venue.tickers(spark, d).withColumn("x", F.when(F.col("last_id") % 3 == 0, F.col("mid")))
    return t.select("coin", "exchange", "snapshot_idx", r(F.coalesce(s.forward_fill(F.col("x"), ["coin", "exchange"], "snapshot_idx", 5), F.lit(-1.0))).alias("filled"))


@query("win_07_drawdown", over("bet", "WITH per AS (SELECT window_id, coin, pair, snapshot_idx, sum(pnl_proxy) OVER w AS cum FROM bet WINDOW w AS (PARTITION BY window_id, coin, pair ORDER BY snapshot_idx)), p AS (SELECT *, greatest(0, max(cum) OVER (PARTITION BY window_id, coin, pair ORDER BY snapshot_idx)) AS peak FROM per) SELECT window_id, coin, pair, round(max(peak - cum), 4) AS max_drawdown, round(arg_max(cum, snapshot_idx), 4) AS total FROM p GROUP BY ALL"))
def win_07(spark, d):
    dd = s.drawdown(bets(spark, d), "pnl_proxy", s.KEYS, "snapshot_idx")
    return dd.groupBy("window_id", "coin", "pair").agg(r(F.max("drawdown")).alias("max_drawdown"), r(F.max_by("cum", "snapshot_idx")).alias("total"))


@query(
    "win_08_rolling_ou",
    over(
        "pair",
        f"""WITH m AS (SELECT *, lag(spread_bps) OVER w AS x, spread_bps - lag(spread_bps) OVER w AS y FROM pair WINDOW w AS (PARTITION BY window_id, coin, pair ORDER BY snapshot_idx)),
o AS (SELECT *, regr_slope(y, x) OVER f AS b, regr_intercept(y, x) OVER f AS a, regr_count(y, x) OVER f AS n FROM m WINDOW f AS (PARTITION BY window_id, coin, pair ORDER BY snapshot_idx ROWS BETWEEN 39 PRECEDING AND CURRENT ROW))
SELECT {KEYS}, CASE WHEN n >= 20 AND b < 0 THEN round(-b, 6) END AS theta, CASE WHEN n >= 20 AND b < 0 THEN round(a / -b, 3) END AS mu, CASE WHEN n >= 20 AND b < 0 THEN round(0.6931471805599453 / -b, 4) END AS half_life FROM o""",
    ),
)
def win_08(spark, d):
    return s.rolling_ou(spreads(spark, d), "spread_bps", w=40).select(*_KEY, r("theta", 6), r("mu", 3), r("half_life"))


@query("win_09_differences", over("pair", f"SELECT {KEYS}, round(spread_bps - lag(spread_bps, 1) OVER w, 4) AS d1, round(spread_bps - lag(spread_bps, 3) OVER w, 4) AS d3, round(spread_bps - 2 * lag(spread_bps, 1) OVER w + lag(spread_bps, 2) OVER w, 4) AS velocity_change FROM pair WINDOW w AS (PARTITION BY window_id, coin, pair ORDER BY snapshot_idx)"))
def win_09(spark, d):
    w, c = s.series(), F.col("spread_bps")
    return spreads(spark, d).select(*_KEY, r(c - F.lag(c, 1).over(w)).alias("d1"), r(c - F.lag(c, 3).over(w)).alias("d3"), r(c - 2 * F.lag(c, 1).over(w) + F.lag(c, 2).over(w)).alias("velocity_change"))


@query("win_10_rolling_correlation", over("pair", f"SELECT {KEYS}, CASE WHEN count(*) OVER f >= 30 THEN round(corr(mid_a, mid_b) OVER f, 6) END AS corr FROM pair WINDOW f AS (PARTITION BY window_id, coin, pair ORDER BY snapshot_idx ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"))
def win_10(spark, d):
    f = s.frame(w=60)
    return spreads(spark, d).select(*_KEY, F.when(F.count(F.lit(1)).over(f) >= 30, r(x.corr("mid_a", "mid_b", f), 6)).alias("corr"))


@query("win_11_running_index", over("pair", f"SELECT {KEYS}, CAST(row_number() OVER (PARTITION BY window_id, coin, pair ORDER BY snapshot_idx) AS INTEGER) AS k FROM pair"))
def win_11(spark, d):
    return spreads(spark, d).select(*_KEY, F.row_number().over(s.series()).alias("k"))


@query("win_12_conformal_interval", over("pair", "WITH p AS (SELECT coin, pair, abs(spread_bps - avg(spread_bps) OVER f) AS resid, count(*) OVER f AS n FROM pair WINDOW f AS (PARTITION BY window_id, coin, pair ORDER BY snapshot_idx ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) SELECT coin, pair, round(quantile_cont(resid, 0.9), 3) AS half_width, CAST(count(*) AS BIGINT) AS n FROM p WHERE n = 20 GROUP BY ALL"))
def win_12(spark, d):
    f = s.frame(w=20, exclude_current=True)
    c = F.col("spread_bps")
    resid = spreads(spark, d).select("coin", "pair", F.abs(c - F.avg(c).over(f)).alias("resid"), F.count(c).over(f).alias("k")).where("k = 20")
    return resid.groupBy("coin", "pair").agg(r(F.expr("percentile(resid, 0.9)"), 3).alias("half_width"), F.count(F.lit(1)).alias("n"))


@query("win_14_multi_window", over("pair", f"SELECT {KEYS}, " + ", ".join(f"round(avg(spread_bps) OVER f{w}, 4) AS mean{w}, round(stddev_pop(spread_bps) OVER f{w}, 4) AS sd{w}" for w in (8, 16, 32)) + " FROM pair WINDOW " + ", ".join(f"f{w} AS (PARTITION BY window_id, coin, pair ORDER BY snapshot_idx ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)" for w in (8, 16, 32))))
def win_14(spark, d):
    cols = [r(fn("spread_bps").over(s.frame(w=w))).alias(f"{n}{w}") for w in (8, 16, 32) for n, fn in (("mean", F.avg), ("sd", F.stddev_pop))]
    return spreads(spark, d).select(*_KEY, *cols)


@query("win_15_gaps_and_outliers", over("candle", "WITH g AS (SELECT coin, exchange, snapshot_idx - lag(snapshot_idx) OVER w AS gap, abs(close / lag(close) OVER w - 1) AS move FROM candle WINDOW w AS (PARTITION BY coin, exchange ORDER BY snapshot_idx)) SELECT coin, exchange, CAST(count(*) FILTER (WHERE gap > 1) AS BIGINT) AS gaps, CAST(max(gap) AS INTEGER) AS largest_gap, CAST(count(*) FILTER (WHERE move > 0.5) AS BIGINT) AS outliers FROM g GROUP BY ALL"))
def win_15(spark, d):
    w = Window.partitionBy("coin", "exchange").orderBy("snapshot_idx")
    g = venue.candles(spark, d).withColumns({"gap": F.col("snapshot_idx") - F.lag("snapshot_idx").over(w), "move": F.abs(F.col("close") / F.lag("close").over(w) - 1)})
    return g.groupBy("coin", "exchange").agg(F.count_if(F.col("gap") > 1).alias("gaps"), F.max("gap").alias("largest_gap"), F.count_if(F.col("move") > 0.5).alias("outliers"))


@query("win_17_benjamini_hochberg", "WITH p AS (SELECT p_partkey, CAST(p_partkey % 97 + 1 AS DOUBLE) / (p_size * 100.0) AS p, p_brand FROM part), k AS (SELECT *, count(*) OVER (PARTITION BY p_brand ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k, count(*) OVER (PARTITION BY p_brand) AS m FROM p) SELECT p_partkey, round(least(1, min(p * m / k) OVER (PARTITION BY p_brand ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 8) AS q FROM k")
def win_17(spark, d):
    p = venue.table(spark, d, "part").select("p_partkey", "p_brand", ((F.col("p_partkey") % 97 + 1).cast("double") / (F.col("p_size") * 100.0)).alias("p"))
    return s.benjamini_hochberg(p, "p", ["p_brand"]).select("p_partkey", r("q", 8))


@query("win_18_sequences", over("z", "WITH q AS (SELECT window_id, coin, pair, snapshot_idx, count(*) OVER f AS t, count(zscore) OVER f AS known, sum(zscore) OVER f AS total, row_number() OVER (PARTITION BY window_id, coin, pair ORDER BY snapshot_idx) AS k FROM z WINDOW f AS (PARTITION BY window_id, coin, pair ORDER BY snapshot_idx ROWS BETWEEN 15 PRECEDING AND CURRENT ROW)) SELECT window_id, coin, pair, snapshot_idx, CAST(known AS BIGINT) AS known, round(total, 4) AS total FROM q WHERE t = 16 AND t - known <= 0.35 * 16 AND k % 4 = 0"))
def win_18(spark, d):
    f = s.frame(w=16)
    z = pairs.scored(venue.tickers(spark, d))
    q = z.withColumns({"steps": F.collect_list(F.struct("zscore")).over(f), "k": F.row_number().over(s.series())})
    known = F.size(F.filter("steps", lambda v: v["zscore"].isNotNull()))
    kept = q.where((F.size("steps") == 16) & (16 - known <= 0.35 * 16) & (F.col("k") % 4 == 0))
    return kept.select(*_KEY, known.cast("long").alias("known"), r(F.aggregate("steps", F.lit(0.0), lambda a, v: a + F.coalesce(v["zscore"], F.lit(0.0)))).alias("total"))


@query("win_20_threshold_signal", over("z", f"SELECT {KEYS}, CAST(CASE WHEN zscore >= 1.5 THEN -1 WHEN zscore <= -1.5 THEN 1 ELSE 0 END AS INTEGER) AS signal FROM z"))
def win_20(spark, d):
    z = F.col("zscore")
    return pairs.scored(venue.tickers(spark, d)).select(*_KEY, F.when(z >= 1.5, -1).when(z <= -1.5, 1).otherwise(0).alias("signal"))


@query("win_21_wildest_window", over("pair", "WITH v AS (SELECT coin, pair, snapshot_idx, round(stddev_samp(spread_bps) OVER f, 4) AS sd FROM pair WINDOW f AS (PARTITION BY window_id, coin, pair ORDER BY snapshot_idx ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)), m AS (SELECT coin, pair, arg_max(snapshot_idx, (sd, -snapshot_idx)) AS peak FROM v WHERE sd IS NOT NULL GROUP BY ALL) SELECT p.coin, p.pair, p.snapshot_idx, round(p.spread_bps, 4) AS spread_bps FROM pair p JOIN m ON p.coin = m.coin AND p.pair = m.pair WHERE p.snapshot_idx BETWEEN peak - 3 AND peak + 3"))
def win_21(spark, d):
    sp = spreads(spark, d)
    v = sp.select("coin", "pair", "snapshot_idx", r(F.stddev_samp("spread_bps").over(s.frame(w=12))).alias("sd")).where("sd is not null")
    peak = v.groupBy("coin", "pair").agg(F.max_by("snapshot_idx", F.struct("sd", -F.col("snapshot_idx"))).alias("peak"))
    return sp.join(peak, ["coin", "pair"]).where(F.abs(F.col("snapshot_idx") - F.col("peak")) <= 3).select("coin", "pair", "snapshot_idx", r("spread_bps"))


@query("win_22_resample_last", "SELECT event_type AS exchange, date_trunc('hour', ts) AS hour, round(arg_max(100 + value, (ts, event_id)), 4) AS mid FROM events GROUP BY ALL")
def win_22(spark, d):
    return venue.ticks(spark, d).groupBy("exchange", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(r(F.max_by("mid", F.struct("ts", "event_id"))).alias("mid"))


@query("win_23_autocorrelation", over("pair", "WITH l AS (SELECT coin, pair, spread_bps AS x, lag(spread_bps) OVER w AS y, spread_bps - lag(spread_bps) OVER w AS dx FROM pair WINDOW w AS (PARTITION BY window_id, coin, pair ORDER BY snapshot_idx)) SELECT coin, pair, round(corr(x, y), 6) AS level_autocorr, round(corr(dx, y), 6) AS change_level_corr FROM l GROUP BY ALL"))
def win_23(spark, d):
    c = F.col("spread_bps")
    l = spreads(spark, d).withColumn("y", F.lag(c).over(s.series()))  # noqa: E741
    return l.groupBy("coin", "pair").agg(r(x.corr("spread_bps", "y"), 6).alias("level_autocorr"), r(x.corr(c - F.col("y"), F.col("y")), 6).alias("change_level_corr"))


@query("win_24_latest_z", over("z", "SELECT coin, pair, CAST(max(snapshot_idx) AS INTEGER) AS snapshot_idx, round(arg_max(zscore, snapshot_idx), 6) AS zscore FROM z WHERE zscore IS NOT NULL GROUP BY ALL"))
def win_24(spark, d):
    z = pairs.scored(venue.tickers(spark, d)).where("zscore is not null")
    return z.groupBy("coin", "pair").agg(F.max("snapshot_idx").alias("snapshot_idx"), r(F.max_by("zscore", "snapshot_idx"), 6).alias("zscore"))
