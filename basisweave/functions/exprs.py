"""Column expressions: spreads, transforms, fees, metrics. Everything stays inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def safe_div(x: Column, y: Column) -> Column:
    return x / F.nullif(y, F.lit(0.0))


def corr(x: Column | str, y: Column | str, over: WindowSpec | None = None) -> Column:
    """Pearson's correlation of the rows that have both, as an aggregate or ``over`` a window; null where either is constant, which
    the built-in one refuses with an error in ANSI mode."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    agg = (lambda c: c) if over is None else (lambda c: c.over(over))
    return safe_div(agg(F.covar_pop(a, b)), agg(F.stddev_pop(a)) * agg(F.stddev_pop(b)))


def spread_bps(p1: Column, p2: Column, convention: str = "signed") -> Column:
    """Basis-point spread of two prices. signed: over the mean; absolute: its size; relative: over the first; range: over the lower."""
    mean = (p1 + p2) / 2
    return {
        "signed": safe_div(p1 - p2, mean) * 1e4,
        "absolute": F.round(F.abs(safe_div(p2 - p1, mean)) * 1e4, 2),
        "relative": F.when(p1 <= 0, F.lit(0.0)).otherwise(safe_div(p2 - p1, p1) * 1e4),
        "range": safe_div(F.greatest(p1, p2) - F.least(p1, p2), F.least(p1, p2)) * 1e4,
        "percent": safe_div(p2 - p1, p1) * 100,
    }[convention]


def mid_price(bid: Column, ask: Column, last: Column) -> Column:
    return F.coalesce((bid + ask) / 2, last)


def crossing_bps(bid: Column, ask: Column) -> Column:
    return safe_div(ask - bid, (ask + bid) / 2) * 1e4


def signed_log1p(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def log1p_clip(x: Column) -> Column:
    return F.log1p(F.greatest(x, F.lit(0.0)))


def finite(x: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), None).otherwise(x)


def hours_to_settlement(hour: Column) -> Column:
    """Hours on the clock's circle to the nearest of 0, 8 and 16."""
    away = lambda h: F.least(F.abs(hour - h), 24 - F.abs(hour - h))
    return F.least(away(0), away(8), away(16))


def sample_skew(x: Column) -> Column:
    """Bias-corrected skewness, null under three values."""
    n = F.count(x).cast("double")
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(x: Column) -> Column:
    """Bias-corrected excess kurtosis, null under four values."""
    n = F.count(x).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))


def sharpe(x: Column, sample: bool = True) -> Column:
    return safe_div(F.avg(x), F.stddev_samp(x) if sample else F.stddev_pop(x))


def profit_factor(x: Column) -> Column:
    return safe_div(F.sum(F.when(x > 0, x)), -F.sum(F.when(x < 0, x)))


def dir_acc(pred: Column, actual: Column, count_zeros: bool = False) -> Column:
    """Share of equal signs; zeros are left out unless asked for."""
    hit = (F.signum(pred) == F.signum(actual)).cast("double")
    return F.avg(hit) if count_zeros else F.avg(F.when((pred != 0) & (actual != 0), hit))


def r_squared(pred: Column, actual: Column) -> Column:
    return 1 - safe_div(F.sum((actual - pred) * (actual - pred)), F.count(actual) * F.var_pop(actual))
