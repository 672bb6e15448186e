"""Sequential position rules: series stream through in order, and all parameter sets of a grid move from trade to trade side by side."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from basisweave.operators.series import KEYS, series

_GRID = "combo int, entry_z double, exit_z double, max_hold int, cooldown int"
_FOUND = "entry int, exit int, direction int, entry_spread double, exit_spread double, reason string, gross_bps double, hold int"


def _first_from(hit: np.ndarray) -> np.ndarray:
    """Per row, for every place and the one past the last: the first place from there on that hits, the length where none does."""
    m = hit.shape[1]
    out = np.full((len(hit), m + 1), m)
    out[:, :m] = np.minimum.accumulate(np.where(hit, np.arange(m), m)[:, ::-1], axis=1)[:, ::-1]
    return out


class _Positions:
    """A position for each combination in one series, moved from trade to trade: where a threshold is met next is looked up, so bars
    without an entry or exit cost nothing."""

    def __init__(self, rows: list[tuple]):
        self.combo, self.enter_z, self.exit_z, self.most, self.wait = (np.array(c) for c in zip(*rows))
        (self.e, self.ei), (self.x, self.xi), (self.h, self.hi), (self.w, self.wi) = (np.unique(c, return_inverse=True) for c in (self.enter_z, self.exit_z, self.most, self.wait))
        self.reset()

    def reset(self) -> None:
        n = len(self.combo)
        self.d, self.t0, self.s0, self.free = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.full(n, -(2**31), np.int64)

    def advance(self, t: np.ndarray, z: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, ...]:
        """Take the next bars of the series; the trades that end in them: place of the exit, combination, entry, direction, entry's
        spread, whether by signal."""
        m, i = len(t), np.arange(len(t))
        z = np.where(np.isnan(z), np.inf, z)  # not a number is above every number, as in Spark
        enter, up, down = _first_from(np.abs(z) >= self.e[:, None]).ravel(), _first_from(z >= -self.x[:, None]).ravel(), _first_from(z <= self.x[:, None]).ravel()
        late_at = np.maximum(np.searchsorted(t, t + self.h[:, None]), i + 1).ravel()
        free_at = np.maximum(np.searchsorted(t, t + 1 + self.w[:, None]), i + 1).ravel()
        e0, x0, h0, w0 = self.ei * (m + 1), self.xi * (m + 1), self.hi * m, self.wi * m
        d, t0, s0 = self.d, self.t0, self.s0
        found: list[tuple] = []
        flat, who = np.flatnonzero(d == 0), np.flatnonzero(d)
        begin = np.searchsorted(t, self.free[flat])
        back = np.where(d[who] == 1, up[x0[who]], down[x0[who]])
        late = np.searchsorted(t, t0[who] + self.most[who])
        while True:
            j = np.minimum(back, late)
            ends = j < m
            signal, gone, j = (back <= late)[ends], who[ends], j[ends]
            if len(gone):
                found.append((j, gone, t0[gone], d[gone], s0[gone], signal))
                d[gone], self.free[gone] = 0, t[j] + 1 + self.wait[gone]
            flat, begin = np.concatenate((flat, gone)), np.concatenate((begin, free_at[w0[gone] + j]))
            at = enter[e0[flat] + begin]
            starts = at < m
            who, at = flat[starts], at[starts]
            if not len(who):
                break
            flat, begin = flat[:0], begin[:0]
            way = np.where(z[at] > 0, -1, 1)
            d[who], t0[who], s0[who] = way, t[at], s[at]
            back = np.where(way == 1, up[x0[who] + at + 1], down[x0[who] + at + 1])
            late = late_at[h0[who] + at]
        return tuple(np.concatenate(c) for c in zip(*found)) if found else ()


def _segments(b: pa.RecordBatch, keys: list[str]) -> Iterator[tuple[tuple, int, int]]:
    """Key, begin and end of each run of equal keys."""
    new = np.zeros(b.num_rows + 1, bool)
    new[[0, -1]] = True
    for k in keys:
        codes = b.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy()
        new[1:-1] |= codes[1:] != codes[:-1]
    at = np.flatnonzero(new).tolist()
    for lo, hi in zip(at, at[1:]):
        yield tuple(b.column(k)[lo].as_py() for k in keys), lo, hi


def _bars(sig: DataFrame, keys: list[str], order: str, z: str, spread: str) -> DataFrame:
    """Bars with a z, a series whole and in order in its partition. The number of partitions is fixed, or small rows would be
    put together in few tasks."""
    bars = sig.where(F.col(z).isNotNull()).select(*keys, F.col(order).cast("int").alias("_t"), F.col(z).cast("double").alias("_z"), F.col(spread).cast("double").alias("_s"))
    tasks = max(int(sig.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return bars.repartition(tasks, *keys).sortWithinPartitions(*keys, "_t", "_z", "_s")


def _walk(batches: Iterable[pa.RecordBatch], keys: list[str], pos: _Positions) -> Iterator[tuple]:
    """Batch, key, whether the series is new, first row of the run, its times and spreads, trades."""
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        t, z, s = (b.column(c).to_numpy(zero_copy_only=False) for c in ("_t", "_z", "_s"))
        t = t.astype(np.int64)
        for own, lo, hi in _segments(b, keys):
            fresh = own != last
            if fresh:
                last = own
                pos.reset()
            yield b, own, fresh, lo, t[lo:hi], s[lo:hi], pos.advance(t[lo:hi], z[lo:hi], s[lo:hi])


def _trades(bars: DataFrame, keys: list[str], rows: list[tuple]) -> DataFrame:
    schema = T.StructType([*bars.select(*keys).schema.fields, *T.StructType.fromDDL(f"{_GRID}, {_FOUND}").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos = _Positions(rows)
        for b, _, _, lo, t, s, found in _walk(batches, keys, pos):
            if not found:
                continue
            j, which, entry, way, first, signal = found
            yield pa.RecordBatch.from_arrays(
                [
                    *(b.column(k).take(pa.array(j + lo)) for k in keys),
                    *(pa.array(c[which], kind) for c, kind in ((pos.combo, pa.int32()), (pos.enter_z, pa.float64()), (pos.exit_z, pa.float64()), (pos.most, pa.int32()), (pos.wait, pa.int32()))),
                    *(pa.array(c, kind) for c, kind in ((entry, pa.int32()), (t[j], pa.int32()), (way, pa.int32()), (first, pa.float64()), (s[j], pa.float64()))),
                    pa.array(np.where(signal, "signal", "timeout")),
                    pa.array(way * (s[j] - first), pa.float64()),
                    pa.array(t[j] - entry, pa.int32()),
                ],
                names=[f.name for f in schema.fields],
            )

    return bars.mapInArrow(run, schema)


def hysteresis(sig: DataFrame, keys: Iterable[str], entry: float = 2.0, exit: float = 0.5, max_hold: int = 50, cooldown: int = 0, order: str = "snapshot_idx", z: str = "zscore", spread: str = "spread_bps") -> DataFrame:
    """Trades of the rule: enter against |z| >= entry, leave when z comes within exit or after ``max_hold`` bars.

    A bar without z is skipped whole; no entry on an exit bar nor within ``cooldown`` bars after it.
    """
    keys = list(keys)
    return _trades(_bars(sig, keys, order, z, spread), keys, [(0, float(entry), float(exit), max_hold, cooldown)]).drop("combo", "entry_z", "exit_z", "max_hold", "cooldown")


def grid(spark, entries: Iterable[float], exits: Iterable[float], holds: Iterable[int], cooldowns: Iterable[int] = (0,)) -> DataFrame:
    """All combinations as a small table with a number each."""
    rows = [(k, float(e), float(x), int(h), int(c)) for k, (e, x, h, c) in enumerate((e, x, h, c) for e in entries for x in exits for h in holds for c in cooldowns)]
    return spark.createDataFrame(rows, "combo int, entry_z double, exit_z double, max_hold int, cooldown int")


def _rows(params: DataFrame) -> list[tuple]:
    return [tuple(p) for p in params.select("combo", "entry_z", "exit_z", "max_hold", "cooldown").orderBy("combo").collect()]


def hysteresis_grid(sig: DataFrame, keys: Iterable[str], params: DataFrame, order: str = "snapshot_idx", z: str = "zscore", spread: str = "spread_bps") -> DataFrame:
    """The trades of ``hysteresis`` for every row of ``params`` (columns as of ``grid``, a small table), one pass for all of them.

    Series lie sorted in their partitions and stream through in batches; what is held is a position a combination, so neither
    the length of a series nor the number of its trades counts."""
    keys = list(keys)
    return _trades(_bars(sig, keys, order, z, spread), keys, _rows(params))


def hysteresis_totals(sig: DataFrame, keys: Iterable[str], params: DataFrame, cost: float = 0.0, folds: tuple[int, int, int] | None = None, order: str = "snapshot_idx", z: str = "zscore", spread: str = "spread_bps") -> DataFrame:
    """``hysteresis_grid`` summed where the trades are found: ``n``, ``net`` (gains less ``cost`` each) and ``won`` of them above it, per
    series, combination and ``fold``, and no row where there is no trade. ``folds``: first and last time, and into how many equal parts
    entries between them fall (without it: all in 0)."""
    keys = list(keys)
    rows = _rows(params)
    first, last, parts = folds or (0, 0, 1)
    bars = _bars(sig, keys, order, z, spread)
    schema = T.StructType([*bars.select(*keys).schema.fields, *T.StructType.fromDDL(f"{_GRID}, fold int, n long, net double, won long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos = _Positions(rows)
        size = len(rows) * parts
        series, sums, kinds = None, np.zeros((3, size)), []

        def totals() -> Iterator[pa.RecordBatch]:
            at = np.flatnonzero(sums[0])
            if len(at):
                which = at % len(rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array([v] * len(at), kind) for v, kind in zip(series, kinds)),
                        *(pa.array(c[which], kind) for c, kind in ((pos.combo, pa.int32()), (pos.enter_z, pa.float64()), (pos.exit_z, pa.float64()), (pos.most, pa.int32()), (pos.wait, pa.int32()))),
                        pa.array(at // len(rows), pa.int32()),
                        *(pa.array(c, kind) for c, kind in ((sums[0, at].astype(np.int64), pa.int64()), (sums[1, at], pa.float64()), (sums[2, at].astype(np.int64), pa.int64()))),
                    ],
                    names=[f.name for f in schema.fields],
                )
            sums[:] = 0

        for b, own, fresh, _, _, s, found in _walk(batches, keys, pos):
            if fresh:
                yield from totals()
                series, kinds = own, [b.column(k).type for k in keys]
            if found:
                j, which, entry, way, begun, _ = found
                net = way * (s[j] - begun) - cost
                at = which + len(rows) * (parts * (entry - first) // (last - first + 1) if folds else 0)
                sums[0] += np.bincount(at, minlength=size)
                sums[1] += np.bincount(at, net, size)
                sums[2] += np.bincount(at, net > 0, size)
        yield from totals()

    return bars.mapInArrow(run, schema)


def ou_signal(spreads: DataFrame, keys: Iterable[str] = KEYS, order: str = "snapshot_idx", min_obs: int = 20, warmup: int = 10) -> DataFrame:
    """The spread against its series' own mean-reverting fit: ``z_residual`` over the deviation of one step, ``z_stationary`` over the
    long-run deviation. The fit regresses the change on the level; series of fewer than ``min_obs`` changes, that do not
    revert, or of no residual are refused. The first ``warmup`` rows have no z."""
    keys = list(keys)
    w = series(keys, order)
    moved = spreads.withColumn("_x", F.lag("spread_bps").over(w)).withColumn("_y", F.col("spread_bps") - F.col("_x"))
    slope, base = F.regr_slope("_y", "_x"), F.regr_intercept("_y", "_x")
    left = F.regr_syy("_y", "_x") - F.regr_sxy("_y", "_x") * F.regr_sxy("_y", "_x") / F.nullif(F.regr_sxx("_y", "_x"), F.lit(0.0))
    fit = moved.groupBy(*keys).agg(F.regr_count("_y", "_x").alias("_n"), slope.alias("_b"), base.alias("_a"), left.alias("_sse"))
    fit = fit.where((F.col("_n") >= min_obs) & (F.col("_b") < 0) & (F.col("_sse") > 1e-9))
    fit = fit.select(*keys, (-F.col("_b")).alias("theta"), (F.col("_a") / -F.col("_b")).alias("mu"), F.sqrt(F.col("_sse") / F.col("_n")).alias("sigma"))
    # A step keeps 1 - theta of the distance: the long-run variance is sigma^2 / (1 - (1 - theta)^2), if that is less than one.
    fit = fit.withColumn("stationary", F.when(F.col("theta") < 2, F.col("sigma") / F.sqrt(1 - (1 - F.col("theta")) * (1 - F.col("theta")))))
    ready = F.row_number().over(w) > warmup
    away = F.col("spread_bps") - F.col("mu")
    return spreads.join(fit, keys).withColumns({"z_residual": F.when(ready, away / F.col("sigma")), "z_stationary": F.when(ready, away / F.col("stationary"))})


def adaptive_signal(spreads: DataFrame, keys: Iterable[str] = KEYS, order: str = "snapshot_idx", window: int = 20, multiple: float = 3.0, least: int = 10) -> DataFrame:
    """``z_adaptive``: the spread against the rows before it, as many as ``multiple`` half-lives of the fit over the ``window`` rows
    before it (``window`` where that does not revert). Sums come from running sums joined at the row before the window."""
    keys = list(keys)
    w = series(keys, order)
    past = w.rowsBetween(-(window - 1), -1)  # window rows before this one make window - 1 changes
    moved = spreads.withColumn("_x", F.lag("spread_bps").over(w)).withColumn("_y", F.col("spread_bps") - F.col("_x"))
    moved = moved.withColumns({"_b": F.regr_slope("_y", "_x").over(past), "_rn": F.row_number().over(w)})
    # Deviations from the first value keep differences of running sums exact enough.
    run = w.rowsBetween(Window.unboundedPreceding, -1)
    d = F.col("spread_bps") - F.first("spread_bps").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    wanted = F.round(F.lit(multiple * float(np.log(2))) / -F.col("_b")).cast("long")
    length = F.when(F.col("_b") < 0, F.greatest(F.lit(least).cast("long"), F.least(wanted, (F.col("_rn") - 1).cast("long")))).otherwise(F.lit(window).cast("long"))
    sums = moved.withColumn("_d", d).withColumns({"_s": F.coalesce(F.sum("_d").over(run), F.lit(0.0)), "_q": F.coalesce(F.sum(F.col("_d") * F.col("_d")).over(run), F.lit(0.0)), "_w": length})
    sums = sums.withColumn("_start", F.greatest(F.lit(1).cast("long"), F.col("_rn") - F.col("_w")))
    before = sums.select(*keys, F.col("_rn").cast("long").alias("_start"), F.col("_s").alias("_s0"), F.col("_q").alias("_q0"))
    met = sums.where(F.col("_rn") > window).join(before, [*keys, "_start"])
    n = F.col("_rn") - F.col("_start")
    mean = (F.col("_s") - F.col("_s0")) / n
    var = F.greatest((F.col("_q") - F.col("_q0")) / n - mean * mean, F.lit(0.0))
    z = F.when(F.sqrt(var) > 1e-10, (F.col("_d") - mean) / F.sqrt(var)).otherwise(F.lit(0.0))
    return met.withColumn("z_adaptive", z).select(*spreads.columns, "z_adaptive")
