"""Metric aggregates: forecast quality, threshold sweeps, cost grids, book summaries."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basisweave.sources import files
from basisweave.functions.exprs import corr, dir_acc, profit_factor, r_squared, safe_div, sharpe


def forecast_metrics(pred: Column, actual: Column) -> list[Column]:
    err = actual - pred
    return [
        F.count(err).alias("n"),
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        r_squared(pred, actual).alias("r2"),
        dir_acc(pred, actual).alias("dir_acc"),
        corr(pred, actual).alias("corr"),
        F.stddev_samp(actual).alias("target_std"),
    ]


def trading_metrics(pred: Column, actual: Column) -> list[Column]:
    pnl = F.signum(pred) * actual
    return [F.count(pnl).alias("n"), dir_acc(pred, actual).alias("dir_acc"), F.avg(pnl).alias("mean_pnl"), F.sum(pnl).alias("total_pnl"), sharpe(pnl).alias("sharpe")]


def tau_sweep(rows: DataFrame, taus: Iterable[float], strict: bool = False) -> DataFrame:
    """Forecast and trading metrics at every confidence threshold in one pass: a row goes to each threshold that it clears."""
    levels = F.array(*(F.lit(float(t)) for t in taus))
    size = F.abs("pred")
    cleared = F.filter(levels, lambda t: size > t if strict else size >= t)
    pred, actual = F.col("pred"), F.col("target")
    known = rows.where("pred is not null and target is not null")
    aggs = [*forecast_metrics(pred, actual), *(c for c in trading_metrics(pred, actual)[2:])]
    return known.withColumn("tau", F.explode(cleared)).groupBy("tau").agg(*aggs)


def cost_grid(trades: DataFrame, costs: Iterable[float], gross: str = "gross_bps") -> DataFrame:
    net = F.col(gross) - F.col("cost_bps")
    grid = F.array(*(F.lit(float(c)) for c in costs))
    return trades.withColumn("cost_bps", F.explode(grid)).groupBy("cost_bps").agg(F.count(net).alias("n"), F.avg(net).alias("mean_net"), F.expr(f"percentile({gross} - cost_bps, 0.5)").alias("median_net"), F.avg((net > 0).cast("double")).alias("win_rate"), sharpe(net).alias("sharpe"))


def quantile_bins(rows: DataFrame, n_bins: int, by: str = "abs_pred", value: str = "gross_bps") -> DataFrame:
    """Right-closed bins at exact quantile edges, equal edges merged; the edges are n_bins + 1 numbers."""
    probs = ", ".join(str(k / n_bins) for k in range(n_bins + 1))
    edges = rows.agg(F.expr(f"array_distinct(percentile({by}, array({probs})))").alias("edges"))
    inner = F.slice("edges", 2, F.size("edges") - 2)
    binned = rows.crossJoin(F.broadcast(edges)).withColumn("bin", F.size(F.filter(inner, lambda e: e < F.col(by))))
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.min(by).alias("lo"), F.max(by).alias("hi"), F.avg(value).alias("mean_gross"), F.avg((F.col(value) > 0).cast("double")).alias("win_rate"))


def top_fraction(rows: DataFrame, fractions: Iterable[float], by: list[Column], value: str = "gross_bps") -> DataFrame:
    """Metrics of the best 100 f % of rows, for each f: ranks through sorted runs, not one task's window."""
    ranked = global_rank(rows, by)
    grid = F.array(*(F.lit(float(f)) for f in fractions))
    total = rows.agg(F.count(F.lit(1)).alias("all"))
    kept = ranked.crossJoin(F.broadcast(total)).withColumn("frac", F.explode(grid)).where(F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("all") * F.col("frac"))))
    return kept.groupBy("frac").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_gross"), F.avg((F.col(value) > 0).cast("double")).alias("win_rate"))


def global_rank(rows: DataFrame, by: list[Column], out: str = "rank") -> DataFrame:
    """Row number over all rows: a range sort, then each partition's numbers start where the ones before it end."""
    # Written once: a second evaluation could draw other range bounds.
    placed = files.kept(rows.sort(*by).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))  # a row a partition
    starts = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return placed.join(F.broadcast(starts), "_part").withColumn(out, F.col("_before") + F.col("_at") - F.col("_first") + 1).drop("_part", "_at", "_first", "_before")


def book_summary(net: str = "net_bps", gross: str = "gross_bps", hold: str = "hold") -> list[Column]:
    n = F.col(net)
    return [
        F.count(n).alias("n_trades"),
        F.sum(gross).alias("total_gross_bps"),
        F.sum(n).alias("total_net_bps"),
        F.avg((n > 0).cast("double")).alias("win_rate"),
        safe_div(F.avg(n), F.stddev_pop(n)).alias("sharpe"),
        profit_factor(n).alias("profit_factor"),
        F.avg(hold).alias("avg_hold"),
        F.expr(f"percentile({hold}, 0.5)").alias("median_hold"),
        F.expr(f"percentile({hold}, 0.9)").alias("p90_hold"),
    ]


def area_under_curve(rows: DataFrame, group: str, score: str, label: str) -> DataFrame:
    """(group, auc): the share of pairs of a positive and a negative that ``score`` puts in order, ties half; null with one kind alone.

    From the rank sum of the positives, with ranks of sorted runs over all groups; a group's ranks begin where the ones
    before it end."""
    ranked = global_rank(rows.select(group, F.col(score).alias("_s"), F.col(label).alias("_l")), [F.col(group), F.col("_s")])
    ties = ranked.groupBy(group, "_s").agg(F.avg("rank").alias("_at"), F.min("rank").alias("_first"), F.count_if(F.col("_l") > 0).alias("_p"), F.count_if(F.col("_l") <= 0).alias("_n"))
    own = ties.groupBy(group).agg(F.sum(F.col("_at") * F.col("_p")).alias("_sum"), F.min("_first").alias("_begin"), F.sum("_p").alias("_p"), F.sum("_n").alias("_n"))
    inside = F.col("_sum") - F.col("_p") * (F.col("_begin") - 1) - F.col("_p") * (F.col("_p") + 1) / 2
    return own.select(group, (inside / F.nullif(F.col("_p") * F.col("_n"), F.lit(0))).alias("auc"))
