"""Books: capacity, equity with open positions marked, realistic costs, passive fills, calibration."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basisweave.functions.exprs import safe_div
from basisweave.operators.metrics import global_rank
from basisweave.operators.series import KEYS
from basisweave.sources.files import kept


def ranked_capacity(candidates: DataFrame, max_open: int, order: list[Column], session: tuple[str, ...] = ("window_id", "snapshot_idx")) -> DataFrame:
    """With a horizon of one snapshot every slot is free again at the next: the book is the first ``max_open`` of each snapshot."""
    return candidates.withColumn("slot", F.row_number().over(Window.partitionBy(*session).orderBy(*order))).where(F.col("slot") <= max_open)


def fifo_capacity(candidates: DataFrame, horizon: int, max_open: int, session: tuple[str, ...] = ("window_id",), key: tuple[str, ...] = ("coin", "pair"), exits: str = "has_exit", order: str = "snapshot_idx") -> DataFrame:
    """The candidates that a book of ``max_open`` slots takes: at each snapshot bets of ``horizon`` snapshots ago settle, then rows
    open in the order of ``key``, one bet a key, while there is room. A bet whose exit row is absent (``exits`` false) keeps its
    slot and its key to the end of the session.

    No more than ``max_open`` keys are busy and no more than that many bets open at a snapshot, so its first 2 * ``max_open`` rows decide;
    the rest goes before the shuffle's sort. Sessions are independent, and one streams through in batches with at most
    ``max_open`` bets held: the fold is sequential in its session, whose rows are few a snapshot."""
    first = F.row_number().over(Window.partitionBy(*session, order).orderBy(*key))
    few = candidates.withColumn("_k", first).where(F.col("_k") <= 2 * max_open).drop("_k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, book = None, {}
        for b in batches:
            taken = []
            sessions, ends = list(zip(*(b.column(c).to_pylist() for c in session))), b.column(exits).to_pylist()
            for k, (s, at, own) in enumerate(zip(sessions, b.column(order).to_pylist(), zip(*(b.column(c).to_pylist() for c in key)))):
                if now is None or now[0] != s:
                    now, book = (s, at), {}
                elif now[1] != at:
                    now, book = (s, at), {own: end for own, end in book.items() if end is None or end > at}
                if own not in book and len(book) < max_open:
                    book[own] = at + horizon if ends[k] else None
                    taken.append(k)
            yield b.take(pa.array(taken, pa.int64()))

    return few.repartition(*session).sortWithinPartitions(*session, order, *key).mapInArrow(run, few.schema)


def persistence_runs(sig: DataFrame, tau: float, max_hold: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Holds while |pred| >= tau, the sign stays and snapshots are consecutive, cut every ``max_hold`` rows: gaps and islands."""
    w = Window.partitionBy(*keys).orderBy("snapshot_idx")
    on = sig.where(F.abs("pred") >= tau).withColumn("side", F.signum("pred").cast("int"))
    new = F.when((F.col("snapshot_idx") - F.lag("snapshot_idx").over(w) == 1) & (F.col("side") == F.lag("side").over(w)), 0).otherwise(1)
    runs = on.withColumn("_new", new).withColumn("run", F.sum("_new").over(w)).drop("_new")
    at = F.row_number().over(Window.partitionBy(*keys, "run").orderBy("snapshot_idx")) - 1
    return runs.withColumn("part", F.floor(at / max_hold).cast("int")).groupBy(*keys, "run", "part").agg(
        F.first("side").alias("side"), F.min("snapshot_idx").alias("entry_snap"), F.max("snapshot_idx").alias("last_snap"), F.count(F.lit(1)).alias("n_bars")
    )


def equity_path(trades: DataFrame, marks: DataFrame, tolerance: int = 4) -> DataFrame:
    """Per window and bar: realised total, open positions marked at the latest z within ``tolerance`` snapshots, and their number.

    ``trades``: window_id, coin, pair, entry_snap, exit_snap, direction, pnl; ``marks``: window_id, coin, pair, snapshot_idx, zscore.
    Each trade meets only its own open bars, and each bar only its own few candidate marks, all by equality.
    """
    open_bars = trades.withColumn("bar", F.explode(F.sequence(F.col("entry_snap"), F.col("exit_snap") - 1)))
    wanted = open_bars.withColumn("back", F.explode(F.array(*(F.lit(k) for k in range(tolerance + 1))))).withColumn("snapshot_idx", F.col("bar") - F.col("back"))
    seen = wanted.join(marks.select(*KEYS, "snapshot_idx", "zscore"), [*KEYS, "snapshot_idx"])
    marked = seen.groupBy(*KEYS, "entry_snap", "bar", "direction").agg(F.max_by("zscore", "snapshot_idx").alias("mark"))
    mtm = marked.groupBy("window_id", F.col("bar")).agg(F.sum(F.col("direction") * F.col("mark")).alias("open_mtm"), F.count(F.lit(1)).alias("n_open"))
    closed = trades.groupBy("window_id", F.col("exit_snap").alias("bar")).agg(F.sum("pnl").alias("closed"))
    bars = mtm.join(closed, ["window_id", "bar"], "full_outer")
    run = Window.partitionBy("window_id").orderBy("bar").rowsBetween(Window.unboundedPreceding, 0)
    path = bars.withColumn("realised", F.coalesce(F.sum("closed").over(run), F.lit(0.0)))
    equity = F.col("realised") + F.coalesce("open_mtm", F.lit(0.0))
    return path.withColumns({"equity": equity, "n_open": F.coalesce("n_open", F.lit(0))}).withColumn("delta", F.col("equity") - F.coalesce(F.lag("equity").over(Window.partitionBy("window_id").orderBy("bar")), F.lit(0.0)))


def walk_book(levels: Column, notional: float) -> Column:
    """Average price paid for ``notional`` by taking levels in order; null if the book is too thin. A fold inside the JVM."""
    zero = F.struct(F.lit(float(notional)).alias("left"), F.lit(0.0).alias("qty"))
    step = lambda s, x: F.struct((s["left"] - F.least(s["left"], x["price"] * x["qty"])).alias("left"), (s["qty"] + F.least(s["left"], x["price"] * x["qty"]) / x["price"]).alias("qty"))
    return F.aggregate(levels, zero, step, lambda s: F.when(s["left"] <= 1e-9, F.lit(float(notional)) / s["qty"]))


def slippage_bps(levels: Column, notional: float) -> Column:
    return safe_div(walk_book(levels, notional) - levels[0]["price"], levels[0]["price"]) * 1e4


def calibrate(value: Column, knots: list[tuple[float, float]]) -> Column:
    """Piecewise-linear through the knots, flat beyond the ends."""
    xs = sorted(knots)
    out = F.lit(xs[-1][1])
    for (x0, y0), (x1, y1) in reversed(list(zip(xs[:-1], xs[1:]))):
        out = F.when(value < x1, y0 + (value - x0) * ((y1 - y0) / (x1 - x0))).otherwise(out)
    return F.when(value.isNull(), None).when(value <= xs[0][0], xs[0][1]).otherwise(out)


def passive_fills(orders: DataFrame, ticks: DataFrame, keys: tuple[str, ...], wait: int, bucket: int) -> DataFrame:
    """First tick that crosses each resting order within ``wait`` seconds.

    A bucketed range join: ticks of the order's time bucket and the ones its life reaches, never all ticks of a key.
    ``orders``: keys, order_id, placed (seconds), price, side; ``ticks``: keys, at (seconds), mid.
    """
    reach = orders.withColumn("slot", F.explode(F.sequence(F.floor(F.col("placed") / bucket), F.floor((F.col("placed") + wait) / bucket))))
    slotted = ticks.withColumn("slot", F.floor(F.col("at") / bucket))
    crossed = F.when(F.col("side") == "buy", F.col("mid") <= F.col("price")).otherwise(F.col("mid") >= F.col("price"))
    met = reach.join(slotted, [*keys, "slot"]).where((F.col("at") > F.col("placed")) & (F.col("at") <= F.col("placed") + wait) & crossed)
    first = met.groupBy("order_id").agg(F.min("at").alias("filled_at"))
    return orders.join(first, "order_id", "left").withColumn("fill_seconds", F.col("filled_at") - F.col("placed"))


def isotonic_blocks(bets: DataFrame, by: list[Column], x: str = "abs_pred", y: str = "gross_bps", most: int = 40, rows_a_block: int = 50) -> DataFrame:
    """Expected ``y`` by ``x``: rows ranked by ``by`` in at most ``most`` equal blocks, whose means get a monotone fit.

    The ranks come from range-sorted runs; what the fit sees is a row a block."""
    ranked = global_rank(bets, by)
    total = bets.agg(F.count(F.lit(1)).alias("_n"))
    blocks = F.least(F.lit(most), F.greatest(F.lit(5), F.floor(F.col("_n") / rows_a_block)))
    at = F.floor((F.col("rank") * F.col("_blocks") - 1) / F.col("_n"))
    means = ranked.crossJoin(F.broadcast(total)).withColumn("_blocks", blocks).groupBy(at.alias("block")).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"))
    means = kept(means, "blocks")
    fit = IsotonicRegression(featuresCol="mean_x", labelCol="mean_y", predictionCol="expected").fit(means)
    return fit.transform(means)
