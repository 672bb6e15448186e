"""Sweeps, Monte Carlo baselines, carried features and stateful streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basisweave.functions import exprs as x
from basisweave.operators import books, pairs, stats
from basisweave.operators import series as s
from basisweave.plans.catalog import query, r
from basisweave.plans.relational import bets
from basisweave.plans.sql import over
from basisweave.sources import venue
from basisweave.streaming import live

_KEY = ["window_id", "coin", "pair", "snapshot_idx"]
_K = ", ".join(_KEY)
_WINDOWS = ((10, 5), (20, 6), (40, 12), (80, 24))


def _z(w: int, mp: int) -> str:
    return f"SELECT {w} AS w, {_K}, CASE WHEN count(*) OVER f >= {mp} AND stddev_samp(spread_bps) OVER f > 0 THEN (spread_bps - avg(spread_bps) OVER f) / stddev_samp(spread_bps) OVER f END AS z FROM pair WINDOW f AS (PARTITION BY window_id, coin, pair ORDER BY snapshot_idx ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"


@query("ml_12_window_sweep", over("pair", "WITH a AS (" + " UNION ALL ".join(_z(w, mp) for w, mp in _WINDOWS) + "), t AS (SELECT *, lead(z) OVER (PARTITION BY w, window_id, coin, pair ORDER BY snapshot_idx) AS y FROM a) SELECT CAST(w AS INTEGER) AS w, CAST(count(*) AS BIGINT) AS n, round(corr(z, y), 6) AS corr, round(avg(CASE WHEN z <> 0 AND y <> 0 THEN (sign(z) = sign(y))::INT END), 6) AS dir_acc FROM t WHERE z IS NOT NULL AND y IS NOT NULL GROUP BY w"))
def ml_12(spark, d):
    """All window sizes over one sort of the series."""
    p = pairs.spread_series(venue.tickers(spark, d))
    zs = p.select(*_KEY, *(s.rolling_z(F.col("spread_bps"), s.frame(w=w), mp).alias(f"z{w}") for w, mp in _WINDOWS))
    both = zs.select(*_KEY, *(c for w, _ in _WINDOWS for c in (F.col(f"z{w}"), F.lead(f"z{w}").over(s.series()).alias(f"y{w}"))))
    long = both.select(F.inline(F.array(*(F.struct(F.lit(w).alias("w"), F.col(f"z{w}").alias("z"), F.col(f"y{w}").alias("y")) for w, _ in _WINDOWS)))).where("z is not null and y is not null")
    return long.groupBy("w").agg(F.count(F.lit(1)).alias("n"), r(x.corr("z", "y"), 6).alias("corr"), r(x.dir_acc(F.col("z"), F.col("y")), 6).alias("dir_acc"))


@query("agg_32_fill_statistics", over("tick", "WITH o AS (SELECT event_id AS order_id, coin, sec AS placed, mid * 0.98 AS price FROM tick WHERE exchange = 'purchase'), f AS (SELECT o.order_id, min(t.sec) AS hit FROM o JOIN tick t ON t.coin = o.coin AND t.exchange = 'click' AND t.sec > o.placed AND t.sec <= o.placed + 14400 AND t.mid <= o.price GROUP BY 1) SELECT coin, round(count(hit) / count(*), 6) AS fill_rate, round(quantile_cont(hit - placed, 0.5), 4) AS p50, round(quantile_cont(hit - placed, 0.9), 4) AS p90 FROM o LEFT JOIN f USING (order_id) GROUP BY coin"))
def agg_32(spark, d):
    t = venue.ticks(spark, d).withColumn("at", F.unix_timestamp("ts"))
    orders = t.where("exchange = 'purchase'").select(F.col("event_id").alias("order_id"), "coin", F.col("at").alias("placed"), F.lit("buy").alias("side"), (F.col("mid") * 0.98).alias("price"))
    f = books.passive_fills(orders, t.where("exchange = 'click'").select("coin", "at", "mid"), ("coin",), 14400, 7200)
    return f.groupBy("coin").agg(r(F.count("filled_at") / F.count(F.lit(1)), 6).alias("fill_rate"), r(F.expr("percentile(fill_seconds, 0.5)")).alias("p50"), r(F.expr("percentile(fill_seconds, 0.9)")).alias("p90"))


@query("fea_02_funding_features", over("pair", f"SELECT p.window_id, p.coin, p.pair, p.snapshot_idx, round((a.funding_rate - b.funding_rate) * 1e4, 4) AS diff, round(avg((a.funding_rate - b.funding_rate) * 1e4) OVER (PARTITION BY p.window_id, p.coin, p.pair ORDER BY p.snapshot_idx ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 4) AS mean10 FROM pair p JOIN ticker a ON a.coin = p.coin AND a.snapshot_idx = p.snapshot_idx AND a.exchange = p.exchange_a JOIN ticker b ON b.coin = p.coin AND b.snapshot_idx = p.snapshot_idx AND b.exchange = p.exchange_b"))
def fea_02(spark, d):
    p = pairs.venue_pairs(venue.tickers(spark, d), ("coin", "window_id", "snapshot_idx"), values=("funding_rate",))
    diff = p.withColumn("d", (F.col("funding_rate_a") - F.col("funding_rate_b")) * 1e4)
    return diff.select(*_KEY, r("d").alias("diff"), r(F.avg("d").over(s.frame(w=10))).alias("mean10"))


@query("fea_03_open_interest_features", over("pair", "SELECT p.window_id, p.coin, p.pair, p.snapshot_idx, round(a.open_interest / b.open_interest, 6) AS ratio, round(a.open_interest / lag(a.open_interest) OVER w - 1, 6) AS change_a FROM pair p JOIN ticker a ON a.coin = p.coin AND a.snapshot_idx = p.snapshot_idx AND a.exchange = p.exchange_a JOIN ticker b ON b.coin = p.coin AND b.snapshot_idx = p.snapshot_idx AND b.exchange = p.exchange_b WINDOW w AS (PARTITION BY p.window_id, p.coin, p.pair ORDER BY p.snapshot_idx)"))
def fea_03(spark, d):
    p = pairs.venue_pairs(venue.tickers(spark, d), ("coin", "window_id", "snapshot_idx"), values=("open_interest",))
    a, b = F.col("open_interest_a"), F.col("open_interest_b")
    return p.select(*_KEY, r(x.safe_div(a, b), 6).alias("ratio"), r(a / F.lag(a).over(s.series()) - 1, 6).alias("change_a"))


@query("fea_05_targets", over("z", f"SELECT {_K}, CASE WHEN lead(spread_bps, 3) OVER w IS NOT NULL THEN abs(lead(spread_bps, 3) OVER w) < abs(spread_bps) END AS narrowed, round(lead(spread_bps, 3) OVER w - spread_bps, 4) AS change FROM z WINDOW w AS (PARTITION BY window_id, coin, pair ORDER BY snapshot_idx)"))
def fea_05(spark, d):
    """Targets three rows on; the last rows stay null instead of counting as misses."""
    ahead = F.lead("spread_bps", 3).over(s.series())
    return pairs.spread_series(venue.tickers(spark, d)).select(*_KEY, (F.abs(ahead) < F.abs("spread_bps")).alias("narrowed"), r(ahead - F.col("spread_bps")).alias("change"))


@query("sta_10_random_entry_baseline")
def sta_10(spark, d):
    """Share of random books that beat the signal: each simulation enters once in every block of six rows, by hash, so that no
    two entries overlap, and holds two rows."""
    sims = 5000
    w = s.series()
    moves = pairs.scored(venue.tickers(spark, d)).select("window_id", "coin", "pair", (F.row_number().over(w) - 1).alias("rn"), (F.lead("spread_bps", 2).over(w) - F.col("spread_bps")).alias("move")).where("move is not null")
    random = stats.random_entries(moves, s.KEYS, "rn", "move", sims)
    actual = bets(spark, d).where("abs_pred >= 0.5").agg(F.avg(-F.col("direction") * F.col("spread_delta_bps")).alias("actual"))
    return random.crossJoin(F.broadcast(actual)).groupBy("actual").agg(F.count(F.lit(1)).alias("sims"), F.avg((F.col("mean") >= F.col("actual")).cast("double")).alias("share_better"), F.avg("mean").alias("mean_random"))


@query("str_12_stream_sliding", "SELECT start, exchange, CAST(count(*) AS BIGINT) AS n, round(avg(100 + value), 4) AS mean FROM (SELECT event_type AS exchange, value, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR, date_trunc('hour', ts) - INTERVAL 2 HOUR, date_trunc('hour', ts) - INTERVAL 3 HOUR]) AS start FROM events) GROUP BY ALL")
def str_12(spark, d):
    return live.stream_sliding(spark, venue.ticks(spark, d))


@query("win_13_adaptive_window", over("pair", f"WITH q AS (SELECT *, CASE WHEN abs(spread_bps) > 2000 THEN 10 ELSE 30 END AS w, sum(spread_bps) OVER (PARTITION BY window_id, coin, pair ORDER BY snapshot_idx) AS cum, row_number() OVER (PARTITION BY window_id, coin, pair ORDER BY snapshot_idx) AS rn FROM pair) SELECT q.window_id, q.coin, q.pair, q.snapshot_idx, round((q.cum - coalesce(o.cum, 0)) / least(q.w, q.rn), 4) AS mean FROM q LEFT JOIN q o ON o.window_id = q.window_id AND o.coin = q.coin AND o.pair = q.pair AND o.rn = q.rn - q.w"))
def win_13(spark, d):
    """A mean over a window whose length each row names, from running sums joined at the row that leaves it."""
    w = s.series()
    q = pairs.spread_series(venue.tickers(spark, d)).select(*_KEY, F.when(F.abs("spread_bps") > 2000, 10).otherwise(30).alias("w"), F.sum("spread_bps").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cum"), F.row_number().over(w).alias("rn"))
    o = q.select(*s.KEYS, F.col("rn").alias("gone"), F.col("cum").alias("before"))
    met = q.withColumn("gone", F.col("rn") - F.col("w")).join(o, [*s.KEYS, "gone"], "left")
    return met.select(*_KEY, r((F.col("cum") - F.coalesce("before", F.lit(0.0))) / F.least("w", "rn")).alias("mean"))
