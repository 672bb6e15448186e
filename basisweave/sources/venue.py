"""The driver's tables as venue data: ticks, tickers on a snapshot grid, candles, books, tapes and dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: 2024-01-01 UTC, where snapshot 0 begins, and the snapshot length in seconds.
EPOCH = 1_704_067_200
BUCKET = 14_400
#: Ticks up to which a snapshot has that length; with more it shrinks in proportion, down to a second.
FULL_BUCKET_TICKS = 10_000
#: Seconds from the epoch after which the second run begins.
SECOND_RUN = 84 * 14_400

VENUES = ["click", "error", "purchase", "signup", "view"]
#: Taker fee in basis points by venue, in the order of VENUES.
TAKER_BPS = [4.0, 5.0, 6.0, 7.5, 10.0]
DEFAULT_TAKER_BPS = 8.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("exchange"),
        F.concat(F.lit("C"), (F.col("user_id") % 3).cast("string")).alias("coin"),
        (F.lit(100.0) + F.col("value")).alias("mid"),
        F.col("value").alias("volume"),
        F.when(F.col("event_id") % 2 == 0, "buy").otherwise("sell").alias("side"),
    )


def bucket_of(spark: SparkSession, sf_dir: str) -> int:
    """The snapshot length for these ticks: about the same number of ticks a cell at any size, so that the grid grows with the data."""
    n = table(spark, sf_dir, "events").count()  # from the files' footers
    return max(1, BUCKET * FULL_BUCKET_TICKS // max(n, FULL_BUCKET_TICKS))


def snapshot_of(ts, bucket: int = BUCKET):
    return F.floor((F.unix_timestamp(ts) - EPOCH) / bucket).cast("int")


def day_of(bucket: int):
    """The day, counted from the epoch, that a snapshot begins in."""
    return F.floor(F.col("snapshot_idx").cast("long") * F.lit(bucket).cast("long") / 86_400)


def with_snapshot(rows: DataFrame, bucket: int = BUCKET) -> DataFrame:
    return rows.withColumn("snapshot_idx", snapshot_of(F.col("ts"), bucket))


def tickers(spark: SparkSession, sf_dir: str, bucket: int | None = None) -> DataFrame:
    """One row per coin, venue and snapshot: the last tick's price and the quotes around it (one aggregate, no window).

    ``bucket`` fixes the snapshot's seconds, so that more ticks change no earlier row; by default it follows their number."""
    bucket = bucket or bucket_of(spark, sf_dir)
    last = F.max_by(F.struct("mid", "event_id", "ts"), F.struct("ts", "event_id"))
    cells = with_snapshot(ticks(spark, sf_dir), bucket).groupBy("coin", "exchange", "snapshot_idx").agg(last.alias("last"), F.count(F.lit(1)).alias("n_ticks"), F.sum("volume").alias("base_volume"))
    half = F.col("mid") * (1 + F.col("last_id") % 5) / 20000
    return (
        cells.select("coin", "exchange", "snapshot_idx", F.col("last.mid").alias("mid"), F.col("last.event_id").alias("last_id"), F.col("last.ts").alias("ts"), "n_ticks", "base_volume")
        .withColumn("bid", F.col("mid") - half)
        .withColumn("ask", F.col("mid") + half)
        .withColumn("bid_volume", (100 + F.col("last_id") % 37).cast("double"))
        .withColumn("ask_volume", (100 + F.col("last_id") % 53).cast("double"))
        .withColumn("imbalance", (F.col("bid_volume") - F.col("ask_volume")) / (F.col("bid_volume") + F.col("ask_volume")))
        .withColumn("funding_rate", (F.col("last_id") % 21 - 10) / 10000)
        .withColumn("open_interest", (1000 + F.col("last_id") % 997).cast("double"))
        .withColumn("window_id", F.when(F.col("snapshot_idx") * bucket < SECOND_RUN, "w1").otherwise("w2"))
    )


def candles(spark: SparkSession, sf_dir: str, bucket: int | None = None) -> DataFrame:
    bucket = bucket or bucket_of(spark, sf_dir)
    order = F.struct("ts", "event_id")
    return with_snapshot(ticks(spark, sf_dir), bucket).groupBy("coin", "exchange", "snapshot_idx").agg(
        F.min_by("mid", order).alias("open"), F.max("mid").alias("high"), F.min("mid").alias("low"), F.max_by("mid", order).alias("close"), F.sum("volume").alias("volume")
    )


def fees(spark: SparkSession) -> DataFrame:
    """Venue fees: a fixed dimension of one row a venue."""
    return spark.createDataFrame(list(zip(VENUES, TAKER_BPS)), "exchange string, taker_bps double")


def order_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as book levels: (book, levels of price and quantity), the cheapest first."""
    li = table(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice").cast("double") / F.col("l_quantity").cast("double")
    level = F.struct(F.round(price, 8).alias("price"), F.col("l_linenumber").cast("int").alias("line"), F.col("l_quantity").cast("double").alias("qty"))
    return li.groupBy(F.col("l_orderkey").alias("book")).agg(F.sort_array(F.collect_list(level)).alias("asks"))
