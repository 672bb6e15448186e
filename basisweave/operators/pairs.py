"""Venue pairs: the upper-triangle self-join, spread series, spread summaries, forward alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basisweave.functions.exprs import spread_bps
from basisweave.operators.series import KEYS, frame, lags, rolling_z, series


def venue_pairs(cells: DataFrame, keys: tuple[str, ...] = ("coin", "snapshot_idx"), venue: str = "exchange", values: tuple[str, ...] = ("mid", "ts")) -> DataFrame:
    """Each pair of venues at a key, the alphabetically first as a. An equi-join on the key; the venues' order is a filter inside it."""
    a = cells.select(*keys, F.col(venue).alias("exchange_a"), *(F.col(v).alias(f"{v}_a") for v in values))
    b = cells.select(*keys, F.col(venue).alias("exchange_b"), *(F.col(v).alias(f"{v}_b") for v in values))
    return a.join(b, list(keys)).where("exchange_a < exchange_b").withColumn("pair", F.concat_ws("__", "exchange_a", "exchange_b"))


def spread_series(cells: DataFrame, convention: str = "signed") -> DataFrame:
    joined = venue_pairs(cells, ("coin", "window_id", "snapshot_idx"))
    return joined.withColumn("spread_bps", spread_bps(F.col("mid_a"), F.col("mid_b"), convention))


def scored(cells: DataFrame, w: int = 20, min_periods: int = 6, n_lags: int = 3, horizon: int = 1) -> DataFrame:
    """Spread series with rolling z, its lags, the row-based target and the model-free prediction."""
    return scored_series(spread_series(cells), w, min_periods, n_lags, horizon)


def scored_series(spreads: DataFrame, w: int = 20, min_periods: int = 6, n_lags: int = 3, horizon: int = 1) -> DataFrame:
    """``scored`` for spreads that are there already, such as a live buffer's."""
    s = spreads.withColumn("zscore", rolling_z(F.col("spread_bps"), frame(w=w), min_periods))
    lagged = lags(s, ["zscore"], n_lags)
    return lagged.withColumns({"target": F.lead("zscore", horizon).over(series(KEYS)), "pred": 0.6 * F.col("zscore") + 0.2 * F.col("zscore_lag1")})


def spread_matrix(cells: DataFrame) -> DataFrame:
    """Per coin and snapshot: venue count, price range, total spread, cheapest and dearest venue (ties: first name)."""
    out = cells.groupBy("coin", "snapshot_idx").agg(
        F.count(F.lit(1)).alias("num_exchanges"),
        F.min("mid").alias("price_min"),
        F.max("mid").alias("price_max"),
        F.avg("mid").alias("price_mean"),
        F.min(F.struct("mid", "exchange"))["exchange"].alias("cheapest_exchange"),
        F.min(F.struct((-F.col("mid")).alias("m"), "exchange"))["exchange"].alias("most_expensive_exchange"),
    )
    return out.where("num_exchanges >= 2").withColumn("total_spread_bps", (F.col("price_max") - F.col("price_min")) / F.col("price_mean") * 1e4)


def align_forward(sig: DataFrame, horizon: int, values: tuple[str, ...] = ("zscore", "spread_bps"), keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Join the exact snapshot ``horizon`` later: a gap in the grid leaves no row, unlike a lead."""
    later = sig.select(*keys, (F.col("snapshot_idx") - horizon).alias("snapshot_idx"), *(F.col(v).alias(f"{v}_fwd") for v in values))
    return sig.join(later, [*keys, "snapshot_idx"])


def settle(aligned: DataFrame, direction: Column) -> DataFrame:
    """Bets closed at the forward row: direction hit, proxy gain, spread change."""
    d = aligned.withColumn("direction", direction)
    return d.withColumns(
        {
            "dir_hit": F.when((F.col("zscore_fwd") != 0) & (F.signum("zscore_fwd") == F.col("direction")), 1).otherwise(0),
            "pnl_proxy": F.col("direction") * F.col("zscore_fwd"),
            "spread_delta_bps": F.col("spread_bps_fwd") - F.col("spread_bps"),
        }
    )
