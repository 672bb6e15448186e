"""Per-series operators over ordered rows: lags, rolling statistics, OU fits, fills, drawdowns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEYS = ("window_id", "coin", "pair")


def series(keys: Iterable[str] = KEYS, order: str = "snapshot_idx") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def frame(keys: Iterable[str] = KEYS, order: str = "snapshot_idx", w: int = 20, exclude_current: bool = False) -> WindowSpec:
    return series(keys, order).rowsBetween(-w if exclude_current else -(w - 1), -1 if exclude_current else 0)


def rolling_z(x: Column, over: WindowSpec, min_periods: int, sample: bool = True, eps: float = 0.0) -> Column:
    """(x - mean) / std over the frame; null below ``min_periods`` values or when the deviation is ``eps`` or less."""
    sd = (F.stddev_samp(x) if sample else F.stddev_pop(x)).over(over)
    return F.when((F.count(x).over(over) >= min_periods) & (sd > eps), (x - F.avg(x).over(over)) / sd)


def prefix_rolling_z(df: DataFrame, col: str, keys: Iterable[str] = KEYS, order: str = "snapshot_idx", w: int = 300, min_periods: int = 90, out: str = "zscore") -> DataFrame:
    """Rolling z from running sums: a row costs the same for any ``w``, where a sliding frame costs ``w``.

    Sums are of deviations from the series' first value, which keeps the differences of running sums exact enough.
    """
    s = series(keys, order)
    run = s.rowsBetween(Window.unboundedPreceding, 0)
    d = F.col(col) - F.first(col, ignorenulls=True).over(s.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    sums = df.withColumn("_d", d).withColumns({"_n": F.count("_d").over(run), "_s": F.sum(F.coalesce("_d", F.lit(0.0))).over(run), "_q": F.sum(F.coalesce(F.col("_d") * F.col("_d"), F.lit(0.0))).over(run)})
    gone = lambda c: F.col(c) - F.coalesce(F.lag(c, w).over(s), F.lit(0))
    parts = sums.withColumns({"_wn": gone("_n"), "_ws": gone("_s"), "_wq": gone("_q")})
    var = (F.col("_wq") - F.col("_ws") * F.col("_ws") / F.nullif(F.col("_wn"), F.lit(0))) / F.nullif(F.col("_wn") - 1, F.lit(0))
    z = F.when((F.col("_wn") >= min_periods) & (var > 1e-12), (F.col("_d") - F.col("_ws") / F.nullif(F.col("_wn"), F.lit(0))) / F.sqrt(var))
    return parts.withColumn(out, z).drop("_d", "_n", "_s", "_q", "_wn", "_ws", "_wq")


def lags(df: DataFrame, cols: Iterable[str], n: int, keys: Iterable[str] = KEYS, order: str = "snapshot_idx") -> DataFrame:
    s = series(keys, order)
    return df.withColumns({f"{c}_lag{k}": F.lag(c, k).over(s) for c in cols for k in range(1, n + 1)})


def forward_fill(x: Column, keys: Iterable[str], order: str, limit: int | None = None) -> Column:
    s = series(keys, order)
    return F.last(x, ignorenulls=True).over(s.rowsBetween(Window.unboundedPreceding if limit is None else -limit, 0))


def rolling_ou(df: DataFrame, col: str, keys: Iterable[str] = KEYS, order: str = "snapshot_idx", w: int = 60, min_obs: int = 20) -> DataFrame:
    """theta, mu, sigma, half_life of the change regressed on the level over ``w`` trailing rows; null unless reverting."""
    s, f = series(keys, order), frame(keys, order, w)
    moved = df.withColumns({"_x": F.lag(col).over(s), "_y": F.col(col) - F.lag(col).over(s)})
    fit = moved.withColumns({"_b": F.regr_slope("_y", "_x").over(f), "_a": F.regr_intercept("_y", "_x").over(f), "_n": F.regr_count("_y", "_x").over(f), "_sse": (F.regr_syy("_y", "_x").over(f) - F.regr_sxy("_y", "_x").over(f) * F.regr_sxy("_y", "_x").over(f) / F.nullif(F.regr_sxx("_y", "_x").over(f), F.lit(0.0)))})
    ok = (F.col("_n") >= min_obs) & (F.col("_b") < 0)
    return fit.withColumns(
        {"theta": F.when(ok, -F.col("_b")), "mu": F.when(ok, F.col("_a") / -F.col("_b")), "sigma": F.when(ok, F.sqrt(F.greatest(F.col("_sse"), F.lit(0.0)) / F.col("_n"))), "half_life": F.when(ok, F.lit(0.6931471805599453) / -F.col("_b"))}
    ).drop("_x", "_y", "_b", "_a", "_n", "_sse")


def drawdown(df: DataFrame, col: str, keys: Iterable[str], order: str) -> DataFrame:
    """Running total, its running peak (never below 0) and the fall from the peak."""
    run = series(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    cum = df.withColumn("cum", F.sum(col).over(run))
    return cum.withColumn("peak", F.greatest(F.lit(0.0), F.max("cum").over(run))).withColumn("drawdown", F.col("peak") - F.col("cum"))


def benjamini_hochberg(df: DataFrame, p: str, keys: Iterable[str] = (), out: str = "q") -> DataFrame:
    """Step-up q-values: the running minimum, from the largest p down, of p * m / rank."""
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    ranked = df.withColumn("_r", F.rank().over(part.orderBy(F.desc(p)))).withColumn("_m", F.count(F.lit(1)).over(part))
    raw = ranked.withColumn("_k", F.count(F.lit(1)).over(part.orderBy(p).rangeBetween(Window.unboundedPreceding, 0)))
    running = part.orderBy(F.desc(p)).rangeBetween(Window.unboundedPreceding, 0)
    return raw.withColumn(out, F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_k")).over(running))).drop("_r", "_m", "_k")
