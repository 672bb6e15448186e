"""The leg-channel panel: every pair row with both legs' own channels and the coin's cross-venue context, and sequences of it."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basisweave.functions.exprs import safe_div, spread_bps
from basisweave.operators.series import KEYS, frame, lags, rolling_z, series

#: Channels of a pair row in the order of a sequence's vectors.
CHANNELS = ("spread_bps", "zscore", "log_mid_diff", "ba_bps_a", "ba_bps_b", "bid_vol_a", "ask_vol_a", "bid_vol_b", "ask_vol_b", "imb_a", "imb_b", "bsr_a", "vol_a", "bsr_b", "vol_b", "cross_mid_std", "cross_ba_std", "net_ob_pressure")


def leg_panel(cells: DataFrame, tape: DataFrame, w: int = 20, min_periods: int = 6) -> DataFrame:
    """Keys, legs, ``CHANNELS``, funding and open interest of both legs, and ``target``, the next row's z.

    ``cells``: a row per coin, venue and snapshot; ``tape``: bsr (buys over sells) and vol there. A coin's venues at a snapshot meet in one
    row, whose few venues are paired inside it: one shuffle for both legs and the context, where joins would take five."""
    ba = safe_div(F.col("ask") - F.col("bid"), (F.col("ask") + F.col("bid")) / 2) * 1e4
    legs = cells.join(tape, ["coin", "exchange", "snapshot_idx"], "left")
    leg = F.struct("exchange", "mid", ba.alias("ba"), F.col("bid_volume").alias("bid_vol"), F.col("ask_volume").alias("ask_vol"), F.col("imbalance").alias("imb"), "bsr", "vol", F.col("funding_rate").alias("fr"), F.col("open_interest").alias("oi"))
    met = legs.groupBy("window_id", "coin", "snapshot_idx").agg(
        F.collect_list(leg).alias("v"), F.stddev_samp("mid").alias("cross_mid_std"), F.stddev_samp(ba).alias("cross_ba_std"), F.avg("imbalance").alias("net_ob_pressure")
    )
    two = F.flatten(F.transform("v", lambda a: F.transform(F.filter("v", lambda b: b["exchange"] > a["exchange"]), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    rows = met.select("window_id", "coin", "snapshot_idx", "cross_mid_std", "cross_ba_std", "net_ob_pressure", F.inline(two))
    a, b = (lambda f: F.col(f"a.{f}")), (lambda f: F.col(f"b.{f}"))
    flat = rows.select(
        "window_id",
        "coin",
        F.concat_ws("__", a("exchange"), b("exchange")).alias("pair"),
        "snapshot_idx",
        a("exchange").alias("exchange_a"),
        b("exchange").alias("exchange_b"),
        spread_bps(a("mid"), b("mid")).alias("spread_bps"),
        F.when((a("mid") > 0) & (b("mid") > 0), F.ln(a("mid")) - F.ln(b("mid"))).alias("log_mid_diff"),
        *(leg_of(f).alias(f"{name}_{side}") for f, name in (("ba", "ba_bps"), ("bid_vol", "bid_vol"), ("ask_vol", "ask_vol"), ("imb", "imb"), ("bsr", "bsr"), ("vol", "vol"), ("fr", "fr"), ("oi", "oi")) for side, leg_of in (("a", a), ("b", b))),
        "cross_mid_std",
        "cross_ba_std",
        "net_ob_pressure",
    )
    z = flat.withColumn("zscore", rolling_z(F.col("spread_bps"), frame(w=w), min_periods))
    return z.withColumn("target", F.lead("zscore").over(series()))


def model_features(panel: DataFrame, n_lags: int = 3) -> DataFrame:
    """Keys, ``target`` and features whose names begin with their group: base_, tk_, ob_, tr_, fr_, oi_, cross_; nulls are 0."""
    named = {"base_z": "zscore", "base_spread": "spread_bps", "tk_mid_diff": "log_mid_diff", "cross_mid_std": "cross_mid_std", "cross_ba_std": "cross_ba_std", "cross_pressure": "net_ob_pressure"}
    named |= {f"base_lag{k}": f"zscore_lag{k}" for k in range(1, n_lags + 1)}
    for side in "ab":
        named |= {f"{group}_{f}_{side}": f"{f}_{side}" for group, fs in (("tk", ("ba_bps", "bid_vol", "ask_vol")), ("ob", ("imb",)), ("tr", ("bsr", "vol"))) for f in fs}
        named |= {f"fr_rate_{side}": f"fr_{side}", f"oi_open_{side}": f"oi_{side}"}
    return lags(panel, ["zscore"], n_lags).select(*KEYS, "snapshot_idx", "target", *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(n) for n, c in named.items()))


def sequences(panel: DataFrame, channels: Iterable[str] = CHANNELS, length: int = 16, stride: int = 4, max_missing: float = 0.35, keys: Iterable[str] = KEYS) -> DataFrame:
    """Keys, snapshot, target, ``n_missing`` and ``steps``: the last ``length`` rows' channels, oldest first, as one flat array of floats
    (Arrow's list layout, length x channels), every ``stride``-th row. Missing values are NaN; a row whose target or too
    many of whose values are missing has no sequence. One sort a series; a row holds ``length`` steps, not its series."""
    channels = list(channels)
    row = F.array(*(F.coalesce(F.col(c).cast("float"), F.lit(float("nan")).cast("float")) for c in channels))
    f = frame(keys, w=length)
    held = panel.withColumn("_row", row).withColumns({"_steps": F.collect_list("_row").over(f), "_k": F.row_number().over(series(keys))})
    full = held.where((F.size("_steps") == length) & (F.col("_k") % stride == 0) & F.col("target").isNotNull())
    missing = F.size(F.filter(F.flatten("_steps"), F.isnan))
    out = full.select(*keys, "snapshot_idx", "target", missing.alias("n_missing"), F.flatten("_steps").alias("steps"))
    return out.where(F.col("n_missing") <= max_missing * length * len(channels))


def buy_sell(ticks: DataFrame, side: Column | str = "side") -> DataFrame:
    """bsr (buys over sells, null without a sell) and vol per coin, venue and snapshot."""
    buys, sells = F.count_if(F.col(side) == "buy"), F.count_if(F.col(side) == "sell")
    return ticks.groupBy("coin", "exchange", "snapshot_idx").agg((buys / F.nullif(sells, F.lit(0))).alias("bsr"), F.sum("volume").alias("vol"))
