"""Structured Streaming: replayed files through watermarked aggregates and a stream-stream settlement join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basisweave.operators import pairs
from basisweave.operators.series import KEYS
from basisweave.sources.files import kept, landing
from basisweave.sources.venue import EPOCH


def replay(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    """The rows as a file stream: written once, read with whatever has landed in one micro-batch, so that none is late."""
    path = landing(spark, name)
    rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


def ended(rows: DataFrame, ahead: int) -> DataFrame:
    """``rows`` (with the event time ``at``) and one empty row, ``ahead`` seconds after the last: the end of the feed, by which the
    watermark passes every window that holds a row. The end's own window stays open, so it is in no result."""
    last = (F.max("at") + F.make_dt_interval(secs=F.lit(ahead))).alias("at")
    return rows.unionByName(rows.agg(last).where("at is not null"), allowMissingColumns=True)


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run the stream over what has landed and read its sink."""
    spark = stream.sparkSession
    path = landing(spark, name)
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-state").format("parquet").option("path", path).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def snapshot_time(bucket: int) -> Column:
    """When a snapshot begins: its number counts lengths of ``bucket`` seconds from the grid's epoch. 64-bit throughout."""
    return F.timestamp_seconds(F.lit(EPOCH).cast("long") + F.col("snapshot_idx").cast("long") * F.lit(bucket).cast("long"))


def stream_spread_matrix(spark: SparkSession, cells: DataFrame, bucket: int, ends: bool = False) -> DataFrame:
    """Per coin and snapshot, venue count and price range, emitted when the watermark, a snapshot behind, closes the snapshot.
    The last stays open while more may come; where the feed ``ends`` with ``cells``, its end closes it."""
    rows = cells.select("coin", "exchange", "snapshot_idx", "mid", snapshot_time(bucket).alias("at"))
    stream = replay(spark, ended(rows, 2 * bucket) if ends else rows, "cells").withWatermark("at", f"{bucket} seconds")
    agg = stream.groupBy("at", "coin", "snapshot_idx").agg(F.count("mid").alias("num_exchanges"), F.max("mid").alias("hi"), F.min("mid").alias("lo"))
    out = drain(agg.select("coin", "snapshot_idx", "num_exchanges", "hi", "lo"), "matrix")
    return out.select("coin", "snapshot_idx", "num_exchanges", F.round(F.col("hi") - F.col("lo"), 4).alias("price_range"))


def stream_hourly(spark: SparkSession, ticks: DataFrame) -> DataFrame:
    """Tumbling hours per venue, emitted when the watermark, an hour behind, closes them; the last by the end of the feed."""
    stream = replay(spark, ended(ticks.select("exchange", "volume", F.col("ts").alias("at")), 3 * 3600), "ticks").withWatermark("at", "1 hour")
    agg = stream.groupBy(F.window("at", "1 hour"), "exchange").agg(F.count(F.lit(1)).alias("n"), F.sum("volume").alias("volume"))
    out = drain(agg.select(F.col("window.start").alias("hour"), "exchange", "n", "volume"), "hours")
    return out.select(F.col("hour").cast("timestamp_ntz").alias("hour"), "exchange", "n", F.round("volume", 4).alias("volume"))


def stream_settlement(spark: SparkSession, sig: DataFrame, bucket: int, tau: float = 0.5) -> DataFrame:
    """Bets meet the next snapshot's z in a stream-stream join whose state the watermarks bound."""
    at = snapshot_time(bucket)
    bets = sig.where((F.abs("pred") >= tau)).select("window_id", "coin", "pair", "snapshot_idx", "zscore", at.alias("at"))
    marks = sig.where("zscore is not null").select("window_id", "coin", "pair", (F.col("snapshot_idx") - 1).alias("snapshot_idx"), F.col("zscore").alias("zscore_fwd"), at.alias("at"))
    b = replay(spark, bets, "bets").withWatermark("at", f"{6 * bucket} seconds").alias("b")
    m = replay(spark, marks, "marks").withWatermark("at", f"{6 * bucket} seconds").alias("m")
    keys = [F.col(f"b.{k}") == F.col(f"m.{k}") for k in ("window_id", "coin", "pair", "snapshot_idx")]
    near = (F.col("m.at") >= F.col("b.at")) & (F.col("m.at") <= F.col("b.at") + F.make_dt_interval(secs=F.lit(bucket)))
    joined = b.join(m, keys[0] & keys[1] & keys[2] & keys[3] & near)
    out = drain(joined.select("b.window_id", "b.coin", "b.pair", "b.snapshot_idx", (F.signum("b.zscore") * F.col("m.zscore_fwd")).alias("pnl_proxy")), "settled")
    return out.withColumn("pnl_proxy", F.round("pnl_proxy", 6))


def stream_sliding(spark: SparkSession, ticks: DataFrame) -> DataFrame:
    """Sliding statistics: four hours, every hour, per venue, emitted when the watermark, an hour behind, closes them; the last
    by the end of the feed."""
    stream = replay(spark, ended(ticks.select("exchange", "mid", F.col("ts").alias("at")), 6 * 3600), "sliding").withWatermark("at", "1 hour")
    agg = stream.groupBy(F.window("at", "4 hours", "1 hour"), "exchange").agg(F.count(F.lit(1)).alias("n"), F.avg("mid").alias("mean"))
    out = drain(agg.select(F.col("window.start").alias("start"), "exchange", "n", "mean"), "slides")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "exchange", "n", F.round("mean", 4).alias("mean"))


def _run(stream: DataFrame, state: str, path: str | None = None, batch=None) -> None:
    """One start of a query from its checkpoint, until it has taken all that landed."""
    w = stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True)
    (w.foreachBatch(batch) if batch else w.outputMode("append").format("parquet").option("path", path)).start().awaitTermination()


def tail_ingest(rows: DataFrame, wave: Column, waves: int = 3, files: int = 4) -> DataFrame:
    """JSON lines that land in waves, tailed by a query that is stopped after each wave and started anew from its checkpoint,
    a few files a trigger: each line is read once, whatever earlier starts had read."""
    spark = rows.sparkSession
    landed, source, sink = kept(rows.withColumn("_wave", wave), "rows"), landing(spark, "tail"), landing(spark, "tailed")
    for k in range(waves):
        landed.where(F.col("_wave") == k).drop("_wave").write.mode("append").json(source)
        _run(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).json(source), f"{sink}-state", sink)
    return spark.read.schema(rows.schema).parquet(sink)


def closed_snapshots(cells: DataFrame, late: Column, cut: int, bucket: int, delay: int = 2) -> DataFrame:
    """Venues per coin and snapshot, emitted once when the watermark of ``delay`` snapshots closes it. Rows land in two waves
    with a restart between them: what is before ``cut`` and not ``late``, then the rest. Late rows of closed snapshots go; a
    snapshot that is still open waits."""
    spark = cells.sparkSession
    at = snapshot_time(bucket)
    rows = cells.select("coin", "snapshot_idx", at.alias("at"), (late | (F.col("snapshot_idx") >= cut)).alias("second"))
    landed, source, sink = kept(rows, "cells"), landing(spark, "waves"), landing(spark, "closed")
    for second in (False, True):
        landed.where(F.col("second") == second).write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source).withWatermark("at", f"{delay * bucket} seconds")
        closed = stream.groupBy("at", "coin", "snapshot_idx").agg(F.count(F.lit(1)).alias("n"))
        _run(closed, f"{sink}-state", sink)
    return spark.read.schema(closed.schema).parquet(sink).drop("at")


def live_signals(spreads: DataFrame, wave: Column, waves: int = 3, w: int = 20, tau: float = 0.5) -> DataFrame:
    """Signals of spreads that land in waves of time: each micro-batch is scored behind a buffer of its series' last rows, with
    the batch job's own functions, gated at ``tau`` and written. Buffer and signals are named by the batch, so a batch that
    is run again replaces its own, and the query is restarted after each wave."""
    spark = spreads.sparkSession
    n_lags = 3
    landed, source, base = kept(spreads.withColumn("_wave", wave), "spreads"), landing(spark, "live"), landing(spark, "signals")

    def score(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("_fresh", F.lit(True))
        if number:
            rows = rows.unionByName(spark.read.parquet(f"{base}/buffer/{number - 1}").withColumn("_fresh", F.lit(False)))
        behind = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("snapshot_idx")))
        rows.drop("_fresh").withColumn("_behind", behind).where(F.col("_behind") <= w + n_lags).drop("_behind").write.mode("overwrite").parquet(f"{base}/buffer/{number}")
        signals = pairs.scored_series(rows, w, n_lags=n_lags).where(F.col("_fresh") & (F.abs("pred") >= tau))
        signals.select(*KEYS, "snapshot_idx", "zscore", "pred").write.mode("overwrite").parquet(f"{base}/out/{number}")

    for k in range(waves):
        landed.where(F.col("_wave") == k).drop("_wave").write.mode("append").parquet(source)
        _run(spark.readStream.schema(spreads.schema).parquet(source), f"{base}-state", batch=score)
    kinds = ", ".join(f"{c} {spreads.schema[c].dataType.simpleString()}" for c in (*KEYS, "snapshot_idx"))
    return spark.read.schema(f"{kinds}, zscore double, pred double").option("recursiveFileLookup", "true").parquet(f"{base}/out")
