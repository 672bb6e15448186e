"""Streams over several triggers and restarts, rotated and tick-level files, and pair statistics of two directions or two series."""

from __future__ import annotations

from pyspark.sql import functions as F

from basisweave.functions import exprs as x
from basisweave.operators import pairs, stats
from basisweave.operators import series as s
from basisweave.plans.catalog import query, r
from basisweave.plans.sql import over
from basisweave.plans.sweeps import _KEY, _WINDOWS, _z
from basisweave.sources import files, venue
from basisweave.streaming import live


@query("str_01_tail_ingest", over("ticker", "SELECT coin, exchange, snapshot_idx, round(mid, 4) AS mid FROM ticker"))
def str_01(spark, d):
    """Also STR-07 and SRC-13: byte offsets and replay are the checkpoint's."""
    t = venue.tickers(spark, d).select("coin", "exchange", "snapshot_idx", "mid")
    return live.tail_ingest(t, F.pmod(F.col("snapshot_idx"), F.lit(3))).select("coin", "exchange", "snapshot_idx", r("mid"))


@query("str_06_late_snapshots", over("ticker", """WITH c AS (SELECT min(snapshot_idx) + (max(snapshot_idx) - min(snapshot_idx)) // 2 AS cut, max(snapshot_idx) AS hi FROM ticker),
  f AS (SELECT coin, snapshot_idx, last_id % 10 = 0 AND snapshot_idx < cut AS late, snapshot_idx < cut AS early, hi FROM ticker, c), w AS (SELECT max(snapshot_idx) AS seen FROM f WHERE early AND NOT late)
  SELECT coin, snapshot_idx, CAST(count(*) AS BIGINT) AS n, count(*) >= 5 AS complete FROM f, w WHERE snapshot_idx <= hi - 2 AND (NOT late OR snapshot_idx > seen - 2) GROUP BY ALL"""))
def str_06(spark, d):
    """A tenth of the first half's rows lands a wave late."""
    t = venue.tickers(spark, d)
    lo, hi = t.agg(F.min("snapshot_idx"), F.max("snapshot_idx")).first()
    cut = (lo or 0) + ((hi or 0) - (lo or 0)) // 2
    out = live.closed_snapshots(t, (F.col("last_id") % 10 == 0) & (F.col("snapshot_idx") < cut), cut, venue.bucket_of(spark, d))
    return out.select("coin", "snapshot_idx", "n", (F.col("n") >= 5).alias("complete"))


@query("str_04_live_signals", over("sig", "SELECT window_id, coin, pair, snapshot_idx, round(zscore, 6) AS zscore, round(pred, 6) AS pred, CAST(sign(pred) AS INTEGER) AS direction FROM sig WHERE abs(pred) >= 0.5"))
def str_04(spark, d):
    """Also STR-02 and STR-03: the buffer and the live matrix are what each micro-batch is scored from."""
    p = pairs.spread_series(venue.tickers(spark, d)).select(*_KEY, "spread_bps")
    lo, hi = p.agg(F.min("snapshot_idx"), F.max("snapshot_idx")).first()
    span = ((hi or 0) - (lo or 0)) // 3 + 1
    out = live.live_signals(p, F.floor((F.col("snapshot_idx") - (lo or 0)) / span).cast("int"))
    return out.select(*_KEY, r("zscore", 6), r("pred", 6), F.signum("pred").cast("int").alias("direction"))


@query("snk_04_rotated_shards", over("ticker", "SELECT window_id, CAST(count(*) AS BIGINT) AS n, true AS within_limit FROM ticker GROUP BY 1"))
def snk_04(spark, d):
    """Shards of at most 200 lines: every file read back under its name and counted."""
    path = files.landing(spark, "rotated")
    venue.tickers(spark, d).select("window_id", "coin", "mid").write.option("maxRecordsPerFile", 200).json(path)
    shards = spark.read.schema("window_id string, coin string, mid double").json(path).withColumn("shard", F.input_file_name())
    sizes = shards.groupBy("shard", "window_id").agg(F.count(F.lit(1)).alias("n"))
    total = sizes.groupBy("shard").agg(F.sum("n").alias("lines"))
    return sizes.join(total, "shard").groupBy("window_id").agg(F.sum("n").alias("n"), F.bool_and(F.col("lines") <= 200).alias("within_limit"))


@query("src_09_tick_log", over("tick", "SELECT coin, exchange, CAST(count(*) AS BIGINT) AS n, round(avg(mid), 4) AS mid, CAST(min(sec) AS BIGINT) AS first_sec FROM tick WHERE event_id % 19 <> 0 GROUP BY ALL"))
def src_09(spark, d):
    """A log of one line a tick, day by day; lines without a price go."""
    t = venue.ticks(spark, d)
    path = files.landing(spark, "ticklog")
    price = F.when(F.col("event_id") % 19 != 0, F.col("mid"))
    t.select("coin", "exchange", F.unix_timestamp("ts").alias("sec"), price.alias("mid"), F.date_format("ts", "yyyyMMdd").alias("day")).write.partitionBy("day").json(path)
    log = spark.read.schema("coin string, exchange string, sec long, mid double").json(path).where("mid is not null")
    return log.groupBy("coin", "exchange").agg(F.count(F.lit(1)).alias("n"), r(F.avg("mid")).alias("mid"), F.min("sec").alias("first_sec"))


_TAUS = (0.0, 0.5, 1.0, 1.5)


@query("ml_13_window_tau_grid", over("pair", "WITH a AS (" + " UNION ALL ".join(_z(w, mp) for w, mp in _WINDOWS) + "), t AS (SELECT *, lead(z) OVER (PARTITION BY w, window_id, coin, pair ORDER BY snapshot_idx) AS y FROM a) SELECT CAST(w AS INTEGER) AS w, CAST(tau AS DOUBLE) AS tau, CAST(count(*) AS BIGINT) AS n, round(avg(abs(y - z)), 6) AS mae, round(avg(CASE WHEN z <> 0 AND y <> 0 THEN (sign(z) = sign(y))::INT END), 6) AS dir_acc, round(avg(sign(z) * y), 6) AS mean_pnl FROM t, (VALUES (0.0), (0.5), (1.0), (1.5)) AS g(tau) WHERE window_id = 'w2' AND z IS NOT NULL AND y IS NOT NULL AND abs(z) >= CAST(tau AS DOUBLE) GROUP BY ALL"))
def ml_13(spark, d):
    """Persistence on the second run for every window size and threshold, over one sort of the series."""
    p = pairs.spread_series(venue.tickers(spark, d).where("window_id = 'w2'"))
    zs = p.select(*_KEY, *(s.rolling_z(F.col("spread_bps"), s.frame(w=w), mp).alias(f"z{w}") for w, mp in _WINDOWS))
    both = zs.select(*(c for w, _ in _WINDOWS for c in (F.col(f"z{w}"), F.lead(f"z{w}").over(s.series()).alias(f"y{w}"))))
    long = both.select(F.inline(F.array(*(F.struct(F.lit(w).alias("w"), F.col(f"z{w}").alias("z"), F.col(f"y{w}").alias("y")) for w, _ in _WINDOWS)))).where("z is not null and y is not null")
    swept = long.withColumn("tau", F.explode(F.array(*(F.lit(t) for t in _TAUS)))).where(F.abs("z") >= F.col("tau"))
    gain = F.avg(F.signum("z") * F.col("y"))
    return swept.groupBy("w", "tau").agg(F.count(F.lit(1)).alias("n"), r(F.avg(F.abs(F.col("y") - F.col("z"))), 6).alias("mae"), r(x.dir_acc(F.col("z"), F.col("y")), 6).alias("dir_acc"), r(gain, 6).alias("mean_pnl"))


@query("sta_03_engle_granger_both")
def sta_03(spark, d):
    return stats.engle_granger_both(pairs.spread_series(venue.tickers(spark, d)), ["coin", "pair"], "snapshot_idx", "mid_a", "mid_b")


@query("sta_04_johansen")
def sta_04(spark, d):
    p = pairs.spread_series(venue.tickers(spark, d)).where("mid_a > 0 and mid_b > 0")
    return stats.johansen(p.withColumns({"log_a": F.ln("mid_a"), "log_b": F.ln("mid_b")}), ("log_a", "log_b"), ["coin", "pair"], "snapshot_idx")
