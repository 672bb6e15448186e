"""Record-level queries: tolerant reads, sinks, projections, gates, feature frames, books and user-defined hooks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from basisweave.functions import exprs as x
from basisweave.operators import books, features_frame, metrics, pairs
from basisweave.operators import series as s
from basisweave.plans.catalog import query, r
from basisweave.plans.relational import bets
from basisweave.plans.sql import BUCKET, over
from basisweave.sources import files, venue

_KEY = ["window_id", "coin", "pair", "snapshot_idx"]
_K = ", ".join(_KEY)


def _count(name="n"):
    return F.count(F.lit(1)).alias(name)


@query("src_02_tolerant_lines", over("ticker", "SELECT coin, exchange, snapshot_idx, round(mid, 4) AS mid FROM ticker WHERE last_id % 13 <> 0 AND last_id % 17 <> 0 AND last_id % 7 <> 0"))
def src_02(spark, d):
    """Lines of which some are cut off, some blank and some error records: what is left of them after a tolerant read."""
    t = venue.tickers(spark, d)
    error = F.when(F.col("last_id") % 7 == 0, "timeout")
    line = F.to_json(F.struct("coin", "exchange", "snapshot_idx", "mid", error.alias("error")))
    line = F.when(F.col("last_id") % 13 == 0, F.substring(line, 1, 11)).when(F.col("last_id") % 17 == 0, "").otherwise(line)
    path = files.landing(spark, "lines")
    t.select(line.alias("value")).write.text(path)
    read = spark.read.schema("coin string, exchange string, snapshot_idx int, mid double, error string, _corrupt_record string").json(path)
    return read.where("_corrupt_record is null and error is null").select("coin", "exchange", "snapshot_idx", r("mid"))


@query("src_03_sharded_log", over("ticker", "SELECT window_id, CAST(count(*) AS BIGINT) AS n, round(sum(mid), 3) AS mid, round(arg_min(mid, (snapshot_idx, last_id)), 4) AS first_mid, round(arg_max(mid, (snapshot_idx, last_id)), 4) AS last_mid FROM ticker GROUP BY 1"))
def src_03(spark, d):
    """Shards whose lines may begin with a byte-order mark, as joined files' do; the order is the data's, not the files'."""
    path = files.landing(spark, "shards")
    line = F.to_json(F.struct("window_id", "snapshot_idx", "last_id", "mid"))
    venue.tickers(spark, d).select(F.when(F.col("last_id") % 50 == 0, F.concat(F.lit("\ufeff"), line)).otherwise(line).alias("value")).write.option("maxRecordsPerFile", 500).text(path)
    log = files.read_marked_lines(spark, path, "window_id string, snapshot_idx int, last_id long, mid double")
    at = F.struct("snapshot_idx", "last_id")
    return log.groupBy("window_id").agg(_count(), r(F.sum("mid"), 3).alias("mid"), r(F.min_by("mid", at)).alias("first_mid"), r(F.max_by("mid", at)).alias("last_mid"))


@query("src_05_pooled_runs", over("ticker", "SELECT window_id, CASE WHEN window_id = 'w1' THEN 'train' ELSE 'test' END AS role, exchange, CAST(count(*) AS BIGINT) AS n, CAST(count(CASE WHEN window_id = 'w2' THEN open_interest END) AS BIGINT) AS n_interest FROM ticker GROUP BY ALL"))
def src_05(spark, d):
    """Two runs landed apart, the second with a table column the first has not, read by a catalogue of windows and pooled."""
    t = venue.tickers(spark, d).select("window_id", "coin", "exchange", "snapshot_idx", "mid", "open_interest")
    base = files.landing(spark, "runs")
    for run, columns in (("w1", ["coin", "exchange", "snapshot_idx", "mid"]), ("w2", ["coin", "exchange", "snapshot_idx", "mid", "open_interest"])):
        t.where(F.col("window_id") == run).select(*columns).write.parquet(f"{base}/{run}/ticker")
    pooled = files.pool_runs(spark, base, {"w1": "train", "w2": "test"}, "ticker")
    return pooled.groupBy("window_id", "role", "exchange").agg(_count(), F.count("open_interest").alias("n_interest"))


@query("src_07_ticker_close", over("ticker", "SELECT coin, exchange, CAST(epoch_us(ts) // 1000 AS BIGINT) AS timestamp, round(mid, 4) AS close FROM ticker"))
def src_07(spark, d):
    return venue.tickers(spark, d).select("coin", "exchange", F.unix_millis("ts").alias("timestamp"), r(F.col("mid")).alias("close"))


@query("src_08_candle_normaliser", over("candle", "SELECT coin, exchange, CAST(row_number() OVER (PARTITION BY coin, exchange ORDER BY snapshot_idx) - 1 AS INTEGER) AS snapshot_idx, round(close, 4) AS close FROM candle"))
def src_08(spark, d):
    """A flat and a payload schema brought to one; the snapshot index is the running count where the source has none."""
    c = venue.candles(spark, d)
    flat = c.where("snapshot_idx % 2 = 0").select("coin", "exchange", F.col("snapshot_idx").alias("at"), "close")
    packed = c.where("snapshot_idx % 2 <> 0").select("coin", "exchange", F.col("snapshot_idx").alias("at"), F.to_json(F.struct("close")).alias("payload"))
    both = flat.unionByName(packed.select("coin", "exchange", "at", F.from_json("payload", "close double")["close"].alias("close")))
    n = F.row_number().over(Window.partitionBy("coin", "exchange").orderBy("at")) - 1
    return both.select("coin", "exchange", n.cast("int").alias("snapshot_idx"), r("close"))


@query("src_10_checked_panel", over("ticker", "SELECT 'perp' AS source, coin, snapshot_idx, round(avg(mid), 4) AS price FROM ticker WHERE exchange <> 'view' AND funding_rate IS NOT NULL GROUP BY ALL UNION ALL SELECT 'pool', coin, snapshot_idx, round(sum(mid * base_volume) / sum(base_volume), 4) FROM ticker WHERE exchange = 'view' AND base_volume > 0 GROUP BY ALL"))
def src_10(spark, d):
    """A price panel from landed perpetual marks and, weighted by liquidity, from pools whose time is their run's name; a
    source without one of the needed columns is refused."""
    t = venue.tickers(spark, d)
    bucket = venue.bucket_of(spark, d)
    perps, pools = files.landing(spark, "perps"), files.landing(spark, "pools")
    t.where("exchange <> 'view'").select("coin", "snapshot_idx", F.col("mid").alias("mark_price"), "funding_rate").write.parquet(perps)
    begin = F.timestamp_seconds(F.lit(venue.EPOCH).cast("long") + F.col("snapshot_idx").cast("long") * bucket)
    t.where("exchange = 'view'").select(F.col("coin").alias("token"), F.col("mid").alias("price_usd"), F.col("base_volume").alias("liquidity_usd"), F.date_format(begin, "yyyyMMdd'T'HHmmss").alias("run_id")).write.parquet(pools)
    marks = files.required(spark.read.parquet(perps), ["coin", "snapshot_idx", "mark_price", "funding_rate"]).where("funding_rate is not null")
    pool = files.required(spark.read.parquet(pools), ["token", "price_usd", "liquidity_usd", "run_id"]).where("liquidity_usd > 0")
    at = venue.snapshot_of(F.to_timestamp("run_id", "yyyyMMdd'T'HHmmss"), bucket)
    price = F.sum(F.col("price_usd") * F.col("liquidity_usd")) / F.sum("liquidity_usd")
    panel = marks.groupBy("coin", "snapshot_idx").agg(r(F.avg("mark_price")).alias("price")).withColumn("source", F.lit("perp"))
    other = pool.groupBy(F.col("token").alias("coin"), at.alias("snapshot_idx")).agg(r(price).alias("price")).withColumn("source", F.lit("pool"))
    return panel.unionByName(other).select("source", "coin", "snapshot_idx", "price")


@query("src_11_friction_scan", over("ticker", "SELECT coin, exchange, snapshot_idx, round((ask - bid) / ((ask + bid) / 2) * 1e4, 4) AS width_bps, CASE WHEN last_id % 4 <> 0 THEN round(imbalance, 6) END AS imbalance, CASE WHEN last_id % 3 <> 0 THEN last_id % 5 <> 0 END AS can_withdraw, CASE WHEN last_id % 11 = 0 THEN 'maintenance' ELSE 'ok' END AS status FROM ticker"))
def src_11(spark, d):
    """Four signals of one run, landed as lines and scanned apart: tickers, books and withdrawal flags by snapshot, venue and
    coin, the venue's status only where it is not ok."""
    t = venue.tickers(spark, d)
    path, on = files.landing(spark, "friction"), ["coin", "exchange", "snapshot_idx"]
    signals = {
        "ticker": (t, ["bid", "ask"], "bid double, ask double"),
        "orderbook": (t.where("last_id % 4 <> 0"), ["imbalance"], "imbalance double"),
        "withdrawal": (t.where("last_id % 3 <> 0").withColumn("can_withdraw", F.col("last_id") % 5 != 0), ["can_withdraw"], "can_withdraw boolean"),
        "status": (t.where("last_id % 11 = 0").withColumn("status", F.lit("maintenance")), ["status"], "status string"),
    }
    scans = []
    for name, (rows, columns, kinds) in signals.items():
        files.write_signals(rows.select(F.lit(name).alias("type"), "ts", *on, *columns), f"{path}/{name}")
        schema = f"type string, ts timestamp, coin string, exchange string, snapshot_idx int, {kinds}, error string"
        scans.append(files.read_signals(spark, f"{path}/{name}", schema, name).select(*on, *columns))
    first, *rest = scans
    for other in rest:
        first = first.join(other, on, "left")
    return first.select(*on, r(x.crossing_bps(F.col("bid"), F.col("ask"))).alias("width_bps"), r("imbalance", 6), "can_withdraw", F.coalesce("status", F.lit("ok")).alias("status"))


@query("src_14_filtered_features", over("pair", "SELECT coin, snapshot_idx, round(spread_bps, 4) AS spread_bps FROM pair WHERE pair = 'click__view'"))
def src_14(spark, d):
    """Features by pair on disk; the name filter prunes partitions."""
    path = files.landing(spark, "features")
    pairs.spread_series(venue.tickers(spark, d)).select("coin", "pair", "snapshot_idx", "spread_bps").write.partitionBy("pair").parquet(path)
    return spark.read.parquet(path).where("pair = 'click__view'").select("coin", "snapshot_idx", r("spread_bps"))


_REPORT = over("bet", "SELECT coin, CAST(count(*) AS BIGINT) AS n, round(avg(gross_bps), 4) AS mean_gross FROM bet GROUP BY coin")


def _report(spark, d):
    return bets(spark, d).groupBy("coin").agg(_count(), r(F.avg("gross_bps")).alias("mean_gross"))


@query("src_15_report_scan", _REPORT)
def src_15(spark, d):
    path = files.landing(spark, "report")
    _report(spark, d).coalesce(1).write.option("header", True).csv(path)
    return spark.read.schema("coin string, n long, mean_gross double").option("header", True).csv(path)


@query("snk_08_metric_report", _REPORT)
def snk_08(spark, d):
    path = files.landing(spark, "metrics")
    _report(spark, d).coalesce(1).write.json(path)
    return spark.read.schema("coin string, n long, mean_gross double").json(path)


@query("snk_05_candle_upsert", over("candle", "SELECT coin, exchange, snapshot_idx, round(CASE WHEN snapshot_idx >= 60 THEN close + 1 ELSE close END, 4) AS close FROM candle"))
def snk_05(spark, d):
    """A resumed download lands over what is there: the later row of a key stays."""
    c = venue.candles(spark, d).select("coin", "exchange", "snapshot_idx", "close")
    again = c.where("snapshot_idx >= 60").withColumn("close", F.col("close") + 1)
    both = c.withColumn("load", F.lit(0)).unionByName(again.withColumn("load", F.lit(1)))
    last = both.groupBy("coin", "exchange", "snapshot_idx").agg(F.max_by("close", "load").alias("close"))
    return files.kept(last, "upserted").select("coin", "exchange", "snapshot_idx", r("close"))


@query("snk_06_feature_output", over("pair", "SELECT coin, exchange_a AS ex1, exchange_b AS ex2, CAST(count(*) AS BIGINT) AS n, round(avg(spread_bps), 4) AS mean_spread FROM pair GROUP BY ALL"))
def snk_06(spark, d):
    path = files.landing(spark, "pair-features")
    rows = pairs.spread_series(venue.tickers(spark, d)).select("coin", F.col("exchange_a").alias("ex1"), F.col("exchange_b").alias("ex2"), "spread_bps")
    rows.write.partitionBy("coin", "ex1", "ex2").parquet(path)
    return spark.read.parquet(path).groupBy("coin", "ex1", "ex2").agg(_count(), r(F.avg("spread_bps")).alias("mean_spread"))


@query("snk_01_trimmed_envelope", over("ticker", "SELECT window_id, CAST(count(*) AS BIGINT) AS n, min(snapshot_idx) AS first_snap, max(snapshot_idx) AS last_snap, round(sum(bid), 3) AS bid FROM ticker WHERE snapshot_idx BETWEEN 10 AND 150 GROUP BY 1"))
def snk_01(spark, d):
    path = files.landing(spark, "trimmed")
    files.write_envelope(venue.tickers(spark, d).where("snapshot_idx between 10 and 150"), path, ["bid"])
    return files.read_envelope(spark, path, "bid double").groupBy("window_id").agg(_count(), F.min("snapshot_idx").alias("first_snap"), F.max("snapshot_idx").alias("last_snap"), r(F.sum("bid"), 3).alias("bid"))


@query("snk_03_day_partitions", over("ticker", "SELECT strftime(ts, '%Y%m%d') AS day, CAST(count(*) AS BIGINT) AS n FROM ticker GROUP BY 1"))
def snk_03(spark, d):
    path = files.landing(spark, "days")
    t = venue.tickers(spark, d)
    t.select(F.date_format("ts", "yyyyMMdd").alias("day"), F.lit("ticker").alias("type"), "coin", "mid").write.partitionBy("type", "day").json(path)
    return spark.read.schema("coin string, mid double, type string, day string").json(path).groupBy("day").agg(_count())


@query("prj_03_open_interest", over("ticker", "SELECT coin, exchange, snapshot_idx, CASE WHEN last_id % 3 = 0 THEN open_interest ELSE open_interest / 2 END AS open_interest FROM ticker"))
def prj_03(spark, d):
    """The amount where the source gives one, else its other field."""
    t = venue.tickers(spark, d).withColumn("amount", F.when(F.col("last_id") % 3 != 0, F.col("open_interest") / 2))
    return t.select("coin", "exchange", "snapshot_idx", F.coalesce("amount", "open_interest").alias("open_interest"))


@query("prj_04_withdrawal_flags", over("ticker", "SELECT coin, exchange, snapshot_idx, last_id % 5 <> 0 AS withdraw_enabled, last_id % 7 <> 0 AS deposit_enabled, CASE WHEN last_id % 2 = 0 THEN (last_id % 9) / 1000 END AS withdraw_fee FROM ticker"))
def prj_04(spark, d):
    i = F.col("last_id")
    return venue.tickers(spark, d).select("coin", "exchange", "snapshot_idx", (i % 5 != 0).alias("withdraw_enabled"), (i % 7 != 0).alias("deposit_enabled"), F.when(i % 2 == 0, (i % 9) / 1000).alias("withdraw_fee"))


@query("prj_08_tolerant_payload", "SELECT event_id, TRY_CAST(coalesce(json_extract_string(props, '$.key'), json_extract_string(props, '$.k')) AS DOUBLE) AS k FROM events")
def prj_08(spark, d):
    """Payload numbers under either of two names; what does not parse is null."""
    either = F.coalesce(F.get_json_object("props", "$.key"), F.get_json_object("props", "$.k"))
    return venue.table(spark, d, "events").select("event_id", either.try_cast("double").alias("k"))


_MARKETS = ["/USDT", "/USD", "/EUR", "/BTC"]


@query("prj_11_usd_price", over("ticker", "WITH m AS (SELECT *, CASE WHEN last_id % 7 = 0 THEN 'USD/' || coin ELSE coin || CASE last_id % 4 WHEN 0 THEN '/USDT' WHEN 1 THEN '/USD' WHEN 2 THEN '/EUR' ELSE '/BTC' END END AS market FROM ticker) SELECT coin, exchange, snapshot_idx, market, round(CASE WHEN split_part(market, '/', 2) IN ('USD', 'USDT', 'USDC') THEN mid WHEN split_part(market, '/', 1) IN ('USD', 'USDT', 'USDC') AND mid > 0 THEN 1 / mid END, 6) AS usd FROM m"))
def prj_11(spark, d):
    """Dollar quotes as they are, inverted quotes turned over, any other currency unknown."""
    i, dollars = F.col("last_id"), ["USD", "USDT", "USDC"]
    quote = F.element_at(F.array(*(F.lit(m) for m in _MARKETS)), (i % 4 + 1).cast("int"))
    t = venue.tickers(spark, d).withColumn("market", F.when(i % 7 == 0, F.concat(F.lit("USD/"), "coin")).otherwise(F.concat("coin", quote)))
    base, counter = F.split_part("market", F.lit("/"), F.lit(1)), F.split_part("market", F.lit("/"), F.lit(2))
    usd = F.when(counter.isin(dollars), F.col("mid")).when(base.isin(dollars) & (F.col("mid") > 0), 1 / F.col("mid"))
    return t.select("coin", "exchange", "snapshot_idx", "market", r(usd, 6).alias("usd"))


@query("prj_23_log_mid_difference", over("pair", f"SELECT {_K}, round(ln(nullif(mid_a, 0)) - ln(nullif(mid_b, 0)), 8) AS log_diff FROM pair"))
def prj_23(spark, d):
    ln = lambda c: F.ln(F.nullif(F.col(c), F.lit(0.0)))
    return pairs.spread_series(venue.tickers(spark, d)).select(*_KEY, r(ln("mid_a") - ln("mid_b"), 8).alias("log_diff"))


@query("prj_27_networks", over("ticker", "SELECT coin, exchange, snapshot_idx, network, CASE network WHEN 'erc' THEN 1 WHEN 'sol' THEN 2 WHEN 'trx' THEN 3 END * 0.5 + CASE WHEN network IS NOT NULL THEN last_id % 3 END AS withdraw_fee, CASE network WHEN 'erc' THEN 10.0 WHEN 'sol' THEN 20.0 WHEN 'trx' THEN 30.0 END::DOUBLE AS min_withdraw FROM (SELECT *, unnest(CASE WHEN last_id % 6 = 0 THEN [NULL] ELSE list_slice(['erc', 'sol', 'trx'], 1, 1 + last_id % 3) END) AS network FROM ticker)").replace("THEN 3 END * 0.5 +", "THEN 3 END * 0.5::DOUBLE +"))
def prj_27(spark, d):
    """A row per network of an asset with its own fee and least amount, one with nulls where it has none; from a payload."""
    t = venue.tickers(spark, d)
    net = lambda k, n: F.struct(F.lit(n).alias("network"), F.struct(((k + 1) * F.lit(0.5) + F.col("last_id") % 3).alias("fee")).alias("withdraw"), F.struct(F.lit(10.0 * (k + 1)).alias("min")).alias("limits"))
    held = F.slice(F.array(*(net(k, n) for k, n in enumerate(("erc", "sol", "trx")))), F.lit(1), (1 + F.col("last_id") % 3).cast("int"))
    sent = t.select("coin", "exchange", "snapshot_idx", F.to_json(F.struct(F.when(F.col("last_id") % 6 != 0, held).alias("networks"))).alias("payload"))
    read = F.from_json("payload", "networks array<struct<network:string, withdraw:struct<fee:double>, limits:struct<min:double>>>")["networks"]
    out = sent.select("coin", "exchange", "snapshot_idx", F.explode_outer(read).alias("n"))
    return out.select("coin", "exchange", "snapshot_idx", "n.network", F.col("n.withdraw.fee").alias("withdraw_fee"), F.col("n.limits.min").alias("min_withdraw"))


@query("prj_28_fee_lookup", over("fee", "SELECT event_id, coalesce(taker_bps, 8.0) AS taker_bps FROM (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'OTHER' ELSE upper(event_type) END AS venue FROM events) LEFT JOIN fee ON venue = upper(exchange)"))
def prj_28(spark, d):
    t = venue.ticks(spark, d).select("event_id", F.when(F.col("event_id") % 10 == 0, "OTHER").otherwise(F.upper("exchange")).alias("venue"))
    fee = venue.fees(spark).select(F.upper("exchange").alias("venue"), "taker_bps")
    return t.join(F.broadcast(fee), "venue", "left").select("event_id", F.coalesce("taker_bps", F.lit(venue.DEFAULT_TAKER_BPS)).alias("taker_bps"))


@query("flt_01_error_rows", "SELECT event_id, event_type FROM events WHERE event_type <> 'error'")
def flt_01(spark, d):
    return venue.table(spark, d, "events").where("event_type <> 'error'").select("event_id", "event_type")


@query("flt_02_venue_whitelist", over("ticker", "SELECT coin, exchange, CAST(count(*) AS BIGINT) AS n FROM ticker WHERE exchange IN ('click', 'signup', 'view') GROUP BY ALL"))
def flt_02(spark, d):
    return venue.tickers(spark, d).where(F.col("exchange").isin("click", "signup", "view")).groupBy("coin", "exchange").agg(_count())


@query("flt_09_pool_eligibility", over("ticker", "SELECT coin, exchange, snapshot_idx, CASE WHEN coin = 'C1' THEN 'C0' ELSE coin END AS token, exchange IN ('click', 'view') AS major FROM ticker WHERE mid > 0 AND open_interest >= 1500"))
def flt_09(spark, d):
    """Priced and liquid pools; wrapped tokens go under the plain one's name, the major venues are marked."""
    alias = F.coalesce(F.create_map(F.lit("C1"), F.lit("C0"))[F.col("coin")], F.col("coin"))
    t = venue.tickers(spark, d).where("mid > 0 and open_interest >= 1500")
    return t.select("coin", "exchange", "snapshot_idx", alias.alias("token"), F.col("exchange").isin("click", "view").alias("major"))


_FEATURES = ("zscore", "zscore_lag1", "zscore_lag2", "zscore_lag3", "spread_bps", "vol_ratio")


def _matrix(spark, d):
    """The feature matrix: spread, z and lags of a pair, its venues' volumes and books, and the target."""
    t = venue.tickers(spark, d)
    leg = lambda side: t.select("coin", "snapshot_idx", F.col("exchange").alias(f"exchange_{side}"), F.col("imbalance").alias(f"imbalance_{side}"), F.col("base_volume").alias(f"volume_{side}"))
    m = pairs.scored(t).join(leg("a"), ["coin", "snapshot_idx", "exchange_a"], "left").join(leg("b"), ["coin", "snapshot_idx", "exchange_b"], "left")
    return m.withColumn("vol_ratio", x.safe_div(F.col("volume_a"), F.col("volume_b")))


_M_SQL = "WITH m AS (SELECT s.*, a.imbalance AS imbalance_a, b.imbalance AS imbalance_b, vol_a / nullif(vol_b, 0) AS vol_ratio FROM sig s LEFT JOIN ticker a ON a.coin = s.coin AND a.snapshot_idx = s.snapshot_idx AND a.exchange = s.exchange_a LEFT JOIN ticker b ON b.coin = s.coin AND b.snapshot_idx = s.snapshot_idx AND b.exchange = s.exchange_b)"


@query("fea_08_full_matrix", over("sig", f"{_M_SQL} SELECT {_K}, round(spread_bps, 4) AS spread_bps, round(zscore, 6) AS zscore, round(zscore_lag3, 6) AS zscore_lag3, round(vol_ratio, 6) AS vol_ratio, round(imbalance_a, 6) AS imbalance_a, round(imbalance_b, 6) AS imbalance_b, round(target, 6) AS target FROM m"))
def fea_08(spark, d):
    return _matrix(spark, d).select(*_KEY, r("spread_bps"), r("zscore", 6), r("zscore_lag3", 6), r("vol_ratio", 6), r("imbalance_a", 6), r("imbalance_b", 6), r("target", 6))


@query("fea_04_transfer_flags", over("pair", f"SELECT p.coin, p.pair, p.snapshot_idx, a.last_id % 5 = 0 AS withdraw_off_a, b.last_id % 7 = 0 AS deposit_off_b, a.last_id % 5 = 0 OR b.last_id % 7 = 0 AS any_off FROM pair p JOIN ticker a ON a.coin = p.coin AND a.snapshot_idx = p.snapshot_idx AND a.exchange = p.exchange_a JOIN ticker b ON b.coin = p.coin AND b.snapshot_idx = p.snapshot_idx AND b.exchange = p.exchange_b"))
def fea_04(spark, d):
    p = pairs.venue_pairs(venue.tickers(spark, d), values=("mid", "last_id"))
    off_a, off_b = F.col("last_id_a") % 5 == 0, F.col("last_id_b") % 7 == 0
    return p.select("coin", "pair", "snapshot_idx", off_a.alias("withdraw_off_a"), off_b.alias("deposit_off_b"), (off_a | off_b).alias("any_off"))


@query("fea_06_ranked_build", over("sig", "WITH k AS (SELECT coin, pair, row_number() OVER (PARTITION BY coin ORDER BY round(stddev_samp(spread_bps), 4) DESC, pair) AS k FROM pair GROUP BY coin, pair) SELECT s.coin, s.pair, CAST(count(*) AS BIGINT) AS n, round(avg(zscore_lag1), 6) AS mean_lag1 FROM sig s JOIN k USING (coin, pair) WHERE k <= 3 GROUP BY ALL"))
def fea_06(spark, d):
    """Pairs ranked by spread deviation; features are built for the first three of each coin and written by pair."""
    sig = pairs.scored(venue.tickers(spark, d))
    rank = F.row_number().over(Window.partitionBy("coin").orderBy(F.desc("sd"), "pair"))
    top = sig.groupBy("coin", "pair").agg(F.round(F.stddev_samp("spread_bps"), 4).alias("sd")).withColumn("k", rank).where("k <= 3").select("coin", "pair")
    path = files.landing(spark, "ranked-features")
    sig.join(F.broadcast(top), ["coin", "pair"]).write.partitionBy("coin", "pair").parquet(path)
    return spark.read.parquet(path).groupBy("coin", "pair").agg(_count(), r(F.avg("zscore_lag1"), 6).alias("mean_lag1"))


def _columns_sql(template: str, join: str = ", ") -> str:
    return join.join(template.replace("@", c) for c in _FEATURES)


@query(
    "fea_09_model_frame",
    over(
        "sig",
        f"""{_M_SQL}, w AS (SELECT * FROM m WHERE window_id = 'w1' AND target IS NOT NULL),
n AS (SELECT {_columns_sql("avg((@ IS NULL)::INT) <= 0.4 AND abs(coalesce(corr(@, target), 0)) >= 0.005 AS k_@, quantile_cont(@, 0.01) AS lo_@, quantile_cont(@, 0.99) AS hi_@")} FROM w),
f AS (SELECT {_columns_sql("avg(greatest(lo_@, least(hi_@, @))) FILTER (WHERE @ IS NOT NULL) AS mu_@, stddev_samp(greatest(lo_@, least(hi_@, @))) FILTER (WHERE @ IS NOT NULL) AS sd_@")} FROM w, n)
""" + " UNION ALL ".join(f"SELECT window_id, '{c}' AS feature, CAST(count({c}) AS BIGINT) AS n, round(avg((greatest(lo_{c}, least(hi_{c}, {c})) - mu_{c}) / sd_{c}), 5) AS mean, round(stddev_samp((greatest(lo_{c}, least(hi_{c}, {c})) - mu_{c}) / sd_{c}), 5) AS sd FROM m, n, f WHERE target IS NOT NULL AND k_{c} AND {c} IS NOT NULL GROUP BY ALL" for c in _FEATURES),
    ),
)
def fea_09(spark, d):
    """The frame a model gets: features that are there and tell something on the first run, clipped and standardised by what that
    run says, for both runs; a row a run and feature of it."""
    rows = files.kept(_matrix(spark, d).where("target is not null").select("window_id", "target", *_FEATURES), "matrix")
    frame, kept = features_frame.fitted_frame(rows, F.col("window_id") == "w1", _FEATURES, "target")
    long = frame.select("window_id", F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("v")) for c in kept)))) if kept else frame.select("window_id", F.lit(None).cast("string").alias("feature"), F.lit(None).cast("double").alias("v")).limit(0)
    return long.where("v is not null").groupBy("window_id", "feature").agg(_count(), r(F.avg("v"), 5).alias("mean"), r(F.stddev_samp("v"), 5).alias("sd"))


@query("ml_17_train_fitted_transforms", over("pair", "WITH b AS (SELECT coin, quantile_cont(spread_bps, 0.01) AS lo, quantile_cont(spread_bps, 0.99) AS hi FROM pair WHERE window_id = 'w1' GROUP BY coin) SELECT coin, window_id, CAST(count(*) FILTER (WHERE spread_bps < lo OR spread_bps > hi) AS BIGINT) AS n_clipped, round(avg(greatest(lo, least(hi, spread_bps))), 4) AS mean FROM pair JOIN b USING (coin) GROUP BY ALL"))
def ml_17(spark, d):
    p = pairs.spread_series(venue.tickers(spark, d))
    b = p.where("window_id = 'w1'").groupBy("coin").agg(F.expr("percentile(spread_bps, array(0.01, 0.99))").alias("q"))
    v, lo, hi = F.col("spread_bps"), F.col("q")[0], F.col("q")[1]
    return p.join(F.broadcast(b), "coin").groupBy("coin", "window_id").agg(F.count_if((v < lo) | (v > hi)).alias("n_clipped"), r(F.avg(F.greatest(lo, F.least(hi, v)))).alias("mean"))


@query("flt_13_feature_prune", over("sig", f"{_M_SQL}, n AS (SELECT " + ", ".join(f"avg(({c} IS NULL)::INT) AS u_{c}, corr({c}, target) AS c_{c}" for c in _FEATURES) + " FROM m WHERE target IS NOT NULL) " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(u_{c}, 6) AS null_share, round(c_{c}, 4) AS corr, u_{c} <= 0.4 AND coalesce(abs(round(c_{c}, 4)), 0) >= 0.005 AS kept FROM n" for c in _FEATURES)))
def flt_13(spark, d):
    """Null share and correlation with the target of each feature in one pass, and whether it stays."""
    m = _matrix(spark, d).where("target is not null")
    stats = m.agg(*(F.struct(F.avg(F.col(c).isNull().cast("int")).alias("null_share"), x.corr(c, "target").alias("corr")).alias(c) for c in _FEATURES))
    out = stats.select(F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c)["null_share"].alias("u"), F.round(F.col(c)["corr"], 4).alias("corr")) for c in _FEATURES))))
    return out.select("feature", r(F.col("u"), 6).alias("null_share"), "corr", ((F.col("u") <= 0.4) & (F.coalesce(F.abs("corr"), F.lit(0.0)) >= 0.005)).alias("kept"))


@query("flt_14_advice", over("sig", "SELECT pair, avg((zscore IS NULL)::INT) > 0.5 AS too_sparse, abs(round(corr(zscore, target), 4)) < 0.01 AS weak, abs(round(skewness(spread_bps), 6)) > 0.1 AS take_log, round(kurtosis(spread_bps), 6) > -1.1 AS winsorise, round(skewness(spread_bps), 4) AS skew, round(kurtosis(spread_bps), 4) AS kurtosis FROM sig GROUP BY pair"))
def flt_14(spark, d):
    """Advisory flags per pair: sparse, weak against the target, skewed, heavy-tailed. The limits are parameters; the given ticks are
    all but uniform, so they are set low here for both answers to occur."""
    g = pairs.scored(venue.tickers(spark, d)).groupBy("pair")
    v = F.col("spread_bps")
    flags = features_frame.advice(F.col("zscore"), v, F.col("target"), skew=0.1, kurtosis=-1.1)
    return g.agg(*flags, r(x.sample_skew(v)).alias("skew"), r(x.sample_kurtosis(v)).alias("kurtosis"))


@query("jn_12_leg_fees", over("bet", "SELECT window_id, coin, pair, snapshot_idx, fa.taker_bps + fb.taker_bps AS fee_bps FROM bet JOIN fee fa ON fa.exchange = exchange_a JOIN fee fb ON fb.exchange = exchange_b", "fee"))
def jn_12(spark, d):
    fee = venue.fees(spark)
    leg = lambda c: F.broadcast(fee.select(F.col("exchange").alias(f"exchange_{c}"), F.col("taker_bps").alias(f"fee_{c}")))
    return bets(spark, d).join(leg("a"), "exchange_a").join(leg("b"), "exchange_b").select(*_KEY, (F.col("fee_a") + F.col("fee_b")).alias("fee_bps"))


@query("jn_16_parameter_grid", over("bet", "SELECT CAST(tau AS DOUBLE) AS tau, CAST(cost AS DOUBLE) AS cost, CAST(count(*) AS BIGINT) AS n, round(avg(gross_bps - cost), 4) AS mean_net FROM bet, (VALUES (0.25), (0.5), (1.0)) AS a(tau), (VALUES (5.0), (10.0)) AS b(cost) WHERE abs_pred >= tau GROUP BY ALL"))
def jn_16(spark, d):
    """Every series meets a small grid of thresholds and costs."""
    grid = spark.createDataFrame([(t, c) for t in (0.25, 0.5, 1.0) for c in (5.0, 10.0)], "tau double, cost double")
    met = bets(spark, d).crossJoin(F.broadcast(grid)).where("abs_pred >= tau")
    return met.groupBy("tau", "cost").agg(_count(), r(F.avg(F.col("gross_bps") - F.col("cost"))).alias("mean_net"))


@query(
    "agg_21_session_gate",
    over(
        "bet",
        """WITH b AS (SELECT window_id, coin, pair, snapshot_idx, abs_pred, -gross_bps AS gross FROM bet), k AS (SELECT *, row_number() OVER (ORDER BY round(abs_pred, 9), window_id, coin, pair, snapshot_idx) AS rank, count(*) OVER () AS n FROM b WHERE window_id = 'w1'),
m AS (SELECT (rank * least(40, greatest(5, n // 50)) - 1) // n AS block, avg(abs_pred) AS x, avg(gross) AS y FROM k GROUP BY 1),
i AS (SELECT u.block AS lo, v.block AS hi, avg(c.y) AS mean FROM m u JOIN m v ON v.block >= u.block JOIN m c ON c.block BETWEEN u.block AND v.block GROUP BY ALL),
t AS (SELECT m.block, any_value(m.x) AS x, max(least) AS y FROM m JOIN (SELECT q.block, lo, min(mean) AS least FROM m q JOIN i ON lo <= q.block AND hi >= q.block GROUP BY ALL) l ON l.block = m.block GROUP BY m.block),
s AS (SELECT x AS x0, y AS y0, lead(x) OVER (ORDER BY block) AS x1, lead(y) OVER (ORDER BY block) AS y1 FROM t),
e AS (SELECT b.*, CASE WHEN x0 IS NULL THEN (SELECT y FROM t ORDER BY block LIMIT 1) WHEN x1 IS NULL THEN y0 ELSE y0 + (abs_pred - x0) * (y1 - y0) / (x1 - x0) END AS expected FROM b ASOF LEFT JOIN s ON b.abs_pred >= s.x0),
g AS (SELECT *, 'all' AS gate FROM e UNION ALL SELECT *, 'tau' FROM e WHERE abs_pred >= 0.5 UNION ALL SELECT *, 'calibrated' FROM e WHERE round(expected, 6) >= 3000)
SELECT window_id, gate, CAST(count(*) AS BIGINT) AS n, round(avg(gross), 4) AS mean_gross, round(avg(gross - 12), 4) AS mean_net, round(avg((gross > 12)::INT), 6) AS win_rate, round(avg(gross) / nullif(stddev_samp(gross), 0), 6) AS sharpe FROM g GROUP BY ALL""",
    ),
)
def agg_21(spark, d):
    """The session's reversion book under no gate, a confidence gate, and a gate on the gross that the first run's monotone
    calibration expects of a bet, before and after cost. The calibration is at most forty knots."""
    b = files.kept(bets(spark, d).select(*_KEY, "abs_pred", (-F.col("gross_bps")).alias("gross_bps")), "session")
    order = [F.round("abs_pred", 9), F.col("window_id"), F.col("coin"), F.col("pair"), F.col("snapshot_idx")]
    fit = books.isotonic_blocks(b.where("window_id = 'w1'"), order)
    knots = [(k["mean_x"], k["expected"]) for k in fit.select("mean_x", "expected").collect()]
    expected = books.calibrate(F.col("abs_pred"), knots) if knots else F.lit(None).cast("double")
    gates = F.array(F.struct(F.lit("all").alias("gate"), F.lit(True).alias("on")), F.struct(F.lit("tau").alias("gate"), (F.col("abs_pred") >= 0.5).alias("on")), F.struct(F.lit("calibrated").alias("gate"), (F.round(expected, 6) >= 3000).alias("on")))
    gated = b.select("window_id", "gross_bps", F.inline(F.filter(gates, lambda g: g["on"])))
    v = F.col("gross_bps")
    return gated.groupBy("window_id", "gate").agg(_count(), r(F.avg(v)).alias("mean_gross"), r(F.avg(v - 12)).alias("mean_net"), r(F.avg((v > 12).cast("int")), 6).alias("win_rate"), r(x.sharpe(v), 6).alias("sharpe"))


@query("srt_03_ranked_reports", over("bet", "WITH g AS (SELECT coin, pair, count(*) AS n, round(avg(gross_bps), 6) AS avg_net FROM bet GROUP BY ALL) SELECT coin, pair, CAST(n AS BIGINT) AS n, avg_net, round(avg_net * sqrt(least(n, 200)), 4) AS score FROM g WHERE n >= 20 ORDER BY avg_net DESC, coin, pair LIMIT 20"))
def srt_03(spark, d):
    """The twenty best pairs by mean gain, with the score that weighs it by their number of trades."""
    g = bets(spark, d).groupBy("coin", "pair").agg(_count(), r(F.avg("gross_bps"), 6).alias("avg_net")).where("n >= 20")
    return g.withColumn("score", r(F.col("avg_net") * F.sqrt(F.least(F.col("n"), F.lit(200))))).orderBy(F.desc("avg_net"), "coin", "pair").limit(20)


@query("srt_06_last_rows", over("pair", "SELECT window_id, coin, pair, snapshot_idx FROM (SELECT *, row_number() OVER (PARTITION BY window_id, coin, pair ORDER BY snapshot_idx DESC) AS k FROM pair) WHERE k <= 10"))
def srt_06(spark, d):
    """The last ten rows of every series, in the order of the windows."""
    k = F.row_number().over(Window.partitionBy(*s.KEYS).orderBy(F.desc("snapshot_idx")))
    return pairs.spread_series(venue.tickers(spark, d)).withColumn("k", k).where("k <= 10").select(*_KEY)


@query("srt_07_by_correlation", over("pair", "SELECT coin, pair, c AS corr, CAST(row_number() OVER (ORDER BY abs(c) DESC NULLS LAST, coin, pair) AS INTEGER) AS place FROM (SELECT coin, pair, round(corr(mid_a, mid_b), 6) AS c FROM pair GROUP BY coin, pair)"))
def srt_07(spark, d):
    g = pairs.spread_series(venue.tickers(spark, d)).groupBy("coin", "pair").agg(r(x.corr("mid_a", "mid_b"), 6).alias("corr"))
    return metrics.global_rank(g, [F.desc_nulls_last(F.abs("corr")), F.col("coin"), F.col("pair")]).select("coin", "pair", "corr", F.col("rank").cast("int").alias("place"))


@query("pos_18_settlement_record", over("bet", f"SELECT {_K}, direction, CASE WHEN zscore_fwd = 0 THEN 0 ELSE dir_hit END AS dir_hit, round(pnl_proxy, 6) AS pnl_proxy, round(spread_delta_bps, 4) AS spread_delta_bps, round(gross_bps, 4) AS gross_bps FROM bet"))
def pos_18(spark, d):
    return bets(spark, d).select(*_KEY, "direction", "dir_hit", r("pnl_proxy", 6), r("spread_delta_bps"), r("gross_bps"))


@query("pos_12_book_summary", over("bet", f"WITH k AS (SELECT * FROM bet WHERE abs_pred >= 0.5), h AS (SELECT window_id, snapshot_idx * {BUCKET} // 86400 AS bar, sum(pnl_proxy) AS pnl FROM k GROUP BY ALL) SELECT window_id, CAST(count(*) AS BIGINT) AS n, round(avg(dir_hit), 6) AS dir_acc, round(avg(pnl_proxy), 6) AS mean_pnl, round(avg(pnl_proxy) / nullif(stddev_samp(pnl_proxy), 0), 6) AS sharpe, (SELECT round(avg(pnl) / nullif(stddev_samp(pnl), 0), 6) FROM h WHERE h.window_id = k.window_id) AS bar_sharpe FROM k GROUP BY window_id"))
def pos_12(spark, d):
    k = bets(spark, d).where("abs_pred >= 0.5")
    own = k.groupBy("window_id").agg(_count(), r(F.avg("dir_hit"), 6).alias("dir_acc"), r(F.avg("pnl_proxy"), 6).alias("mean_pnl"), r(x.sharpe(F.col("pnl_proxy")), 6).alias("sharpe"))
    bars = k.groupBy("window_id", venue.day_of(venue.bucket_of(spark, d)).alias("bar")).agg(F.sum("pnl_proxy").alias("pnl"))
    return own.join(bars.groupBy("window_id").agg(r(x.sharpe(F.col("pnl")), 6).alias("bar_sharpe")), "window_id", "left")


@query("ml_01_model_rows", over("sig", "SELECT window_id, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT pair) AS BIGINT) AS n_pairs, round(avg(coalesce(zscore_lag3, 0)), 6) AS mean_lag3 FROM sig WHERE target IS NOT NULL GROUP BY window_id"))
def ml_01(spark, d):
    rows = pairs.scored(venue.tickers(spark, d)).where("target is not null")
    return rows.groupBy("window_id").agg(_count(), F.count_distinct("pair").alias("n_pairs"), r(F.avg(F.coalesce("zscore_lag3", F.lit(0.0))), 6).alias("mean_lag3"))


@query("ml_07_model_and_naive", over("sig", "WITH p AS (SELECT window_id, 'model' AS name, pred AS p, target FROM sig WHERE pred IS NOT NULL AND target IS NOT NULL UNION ALL SELECT window_id, 'naive', zscore, target FROM sig WHERE pred IS NOT NULL AND target IS NOT NULL) SELECT window_id, name, CAST(count(*) AS BIGINT) AS n, round(avg(abs(target - p)), 6) AS mae, round(sqrt(avg((target - p) * (target - p))), 6) AS rmse, round(corr(p, target), 6) AS corr FROM p GROUP BY ALL"))
def ml_07(spark, d):
    """Both predictors on the same rows, unpivoted and measured in one pass."""
    rows = pairs.scored(venue.tickers(spark, d)).where("pred is not null and target is not null")
    both = rows.select("window_id", F.col("pred").alias("model"), F.col("zscore").alias("naive"), "target").unpivot(["window_id", "target"], ["model", "naive"], "name", "p")
    err = F.col("target") - F.col("p")
    return both.groupBy("window_id", "name").agg(_count(), r(F.avg(F.abs(err)), 6).alias("mae"), r(F.sqrt(F.avg(err * err)), 6).alias("rmse"), r(x.corr("p", "target"), 6).alias("corr"))


@query("ml_03_sign_classifier")
def ml_03(spark, d):
    """A logistic model of the target's sign on the first run, its accuracy and area under the curve on both; rows without a
    sign are left out."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    columns = ["zscore", "zscore_lag1", "zscore_lag2", "spread_bps"]
    rows = pairs.scored(venue.tickers(spark, d)).where("target <> 0").dropna(subset=columns).withColumn("label", (F.col("target") > 0).cast("double"))
    model = Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="features"), LogisticRegression(maxIter=50)]).fit(rows.where("window_id = 'w1'"))
    scored = files.kept(model.transform(rows).select("window_id", "label", "prediction", vector_to_array("probability")[1].alias("p")), "signs")
    hit = (F.col("prediction") == F.col("label")).cast("int")
    areas = metrics.area_under_curve(scored, "window_id", "p", "label")
    return scored.groupBy("window_id").agg(_count(), r(F.avg(hit), 6).alias("accuracy")).join(areas, "window_id").select("window_id", "n", "accuracy", r("auc", 6))


@query("ml_16_saved_model_scores", over("sig", "WITH f AS (SELECT regr_slope(target, zscore) AS b, regr_intercept(target, zscore) AS a FROM sig WHERE window_id = 'w1' AND target IS NOT NULL AND zscore IS NOT NULL) SELECT window_id, CAST(count(*) AS BIGINT) AS n, round(avg(abs(a + b * zscore - target)), 4) AS mae FROM sig, f WHERE target IS NOT NULL AND zscore IS NOT NULL GROUP BY window_id"))
def ml_16(spark, d):
    """A linear model fitted, saved, loaded again and applied to both runs."""
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rows = pairs.scored(venue.tickers(spark, d)).dropna(subset=["target", "zscore"])
    stages = [VectorAssembler(inputCols=["zscore"], outputCol="features"), LinearRegression(labelCol="target", solver="normal")]
    path = files.landing(spark, "model")
    Pipeline(stages=stages).fit(rows.where("window_id = 'w1'")).save(path)
    scored = PipelineModel.load(path).transform(rows)
    return scored.groupBy("window_id").agg(_count(), r(F.avg(F.abs(F.col("prediction") - F.col("target")))).alias("mae"))


@query("srt_08_feature_importance")
def srt_08(spark, d):
    """A small forest's features by importance."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    columns = ["zscore", "zscore_lag1", "zscore_lag2", "zscore_lag3", "spread_bps"]
    rows = pairs.scored(venue.tickers(spark, d)).dropna(subset=["target", *columns])
    model = Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="features"), RandomForestRegressor(labelCol="target", numTrees=20, maxDepth=4, seed=7)]).fit(rows)
    found = [(c, float(v)) for c, v in zip(columns, model.stages[-1].featureImportances.toArray())]
    return spark.createDataFrame(found, "feature string, importance double").orderBy(F.desc("importance"), "feature")


@query("udf_01_strategy_hooks", over("bet", "SELECT coin, CAST(count(*) AS BIGINT) AS n, round(avg(-sign(zscore) * spread_delta_bps), 4) AS mean_gross FROM bet WHERE abs_pred >= 0.5 AND exchange_a <> 'error' GROUP BY coin"))
def udf_01(spark, d):
    """A book whose eligibility and direction the caller gives as column functions."""

    def run(rows, eligible, direction):
        return rows.where(eligible(rows)).groupBy("coin").agg(_count(), r(F.avg(direction(rows) * F.col("spread_delta_bps"))).alias("mean_gross"))

    return run(bets(spark, d), lambda t: (t["abs_pred"] >= 0.5) & (t["exchange_a"] != "error"), lambda t: -F.signum(t["zscore"]))


@query("udf_02_group_transform", over("pair", "SELECT coin, pair, snapshot_idx, round(spread_bps - avg(spread_bps) OVER (PARTITION BY coin, pair), 4) AS centred FROM pair"))
def udf_02(spark, d):
    """A caller's function over each series, in pandas."""

    def centre(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(centred=pdf["spread_bps"] - pdf["spread_bps"].mean())[["coin", "pair", "snapshot_idx", "centred"]]

    p = pairs.spread_series(venue.tickers(spark, d)).select("coin", "pair", "snapshot_idx", "spread_bps")
    return p.groupBy("coin", "pair").applyInPandas(centre, "coin string, pair string, snapshot_idx int, centred double").select("coin", "pair", "snapshot_idx", r("centred"))


@query("udf_04_predict_on_frame", over("sig", f"SELECT {_K}, round(0.1 + 0.5 * zscore - 0.25 * zscore_lag1, 6) AS prediction FROM sig WHERE zscore IS NOT NULL AND zscore_lag1 IS NOT NULL"))
def udf_04(spark, d):
    """A model's predict over Arrow batches of rows."""

    @F.pandas_udf(T.DoubleType())
    def predict(z: pd.Series, lag: pd.Series) -> pd.Series:
        return 0.1 + 0.5 * z - 0.25 * lag

    rows = pairs.scored(venue.tickers(spark, d)).where("zscore is not null and zscore_lag1 is not null")
    return rows.select(*_KEY, r(predict("zscore", "zscore_lag1"), 6).alias("prediction"))


@query("udf_05_table_function", over("ticker", "SELECT coin, snapshot_idx, unnest([exchange || ':bid', exchange || ':ask']) AS side, unnest([round(bid, 8), round(ask, 8)]) AS price FROM ticker"))
def udf_05(spark, d):
    """One payload to many rows."""
    t = venue.tickers(spark, d)
    quotes = F.array(*(F.struct(F.concat("exchange", F.lit(f":{c}")).alias("side"), F.round(c, 8).alias("price")) for c in ("bid", "ask")))
    return t.select("coin", "snapshot_idx", F.inline(quotes))


@query("udaf_01_book_aggregates", over("bet", "SELECT coin, round(avg(gross_bps) / nullif(stddev_samp(gross_bps), 0), 6) AS sharpe, round(sum(CASE WHEN gross_bps > 0 THEN gross_bps END) / nullif(-sum(CASE WHEN gross_bps < 0 THEN gross_bps END), 0), 6) AS profit_factor, round(avg(dir_hit), 6) AS dir_acc FROM bet GROUP BY coin"))
def udaf_01(spark, d):
    """Sharpe, profit factor and direction accuracy as composed aggregate columns."""
    v = F.col("gross_bps")
    return bets(spark, d).groupBy("coin").agg(r(x.sharpe(v), 6).alias("sharpe"), r(x.profit_factor(v), 6).alias("profit_factor"), r(F.avg("dir_hit"), 6).alias("dir_acc"))
