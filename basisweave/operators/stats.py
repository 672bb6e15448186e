"""Statistical jobs fanned out over series, pairs and replicates."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from basisweave.functions.exprs import corr

#: MacKinnon's 1 %, 5 % and 10 % critical values of the constant-only Dickey-Fuller test: b0 + b1/n + b2/n^2.
ADF_CRITICAL = {1: (-3.43035, -6.5393, -16.786), 5: (-2.86154, -2.8903, -4.234), 10: (-2.56677, -1.5384, -2.809)}


def ou_fit(df: DataFrame, col: str, keys: Iterable[str], order: str) -> DataFrame:
    """kappa, mu, half_life and r2 per series from the level regressed on its lag; native aggregates only."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(order)
    pairs = df.withColumn("_x", F.lag(col).over(w))
    fit = pairs.groupBy(*keys).agg(F.regr_slope(col, "_x").alias("phi"), F.regr_intercept(col, "_x").alias("a"), F.regr_r2(col, "_x").alias("r2"), F.regr_count(col, "_x").alias("n"))
    ok = (F.col("phi") > 0) & (F.col("phi") < 1)
    return fit.select(*keys, "n", "phi", "r2", F.when(ok, -F.ln("phi")).alias("kappa"), F.when(ok, F.col("a") / (1 - F.col("phi"))).alias("mu"), F.when(ok, F.lit(0.6931471805599453) / -F.ln("phi")).alias("half_life"))


def adf_statistic(y: np.ndarray, max_lag: int = 8) -> tuple[float, int, int]:
    """t-ratio of the level in the Dickey-Fuller regression with a constant, the lags of least AIC, and the observations."""
    dy = np.diff(y)
    best = (np.inf, np.nan, 0, 0)
    top = min(max_lag, max(0, len(dy) // 4))
    for lag in range(top + 1):
        rows = slice(top, None)
        x = np.column_stack([y[:-1][rows], np.ones(len(dy) - top), *(dy[top - k : len(dy) - k] for k in range(1, lag + 1))])
        t = dy[rows]
        if len(t) <= x.shape[1] + 2:
            break
        beta, *_ = np.linalg.lstsq(x, t, rcond=None)
        rss = float(((t - x @ beta) ** 2).sum())
        se = np.sqrt(rss / (len(t) - x.shape[1]) * np.linalg.pinv(x.T @ x)[0, 0])
        aic = len(t) * np.log(max(rss, 1e-300) / len(t)) + 2 * x.shape[1]
        if aic < best[0]:
            best = (aic, float(beta[0] / se) if se > 0 else np.nan, lag, len(t))
    return best[1], best[2], best[3]


def adf(df: DataFrame, col: str, keys: Iterable[str], order: str, max_lag: int = 8) -> DataFrame:
    """Dickey-Fuller statistic per series with its 5 % verdict. A task holds one series; the fan-out is over series."""
    keys = list(keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values(order)[col].dropna().to_numpy(float)
        stat, lag, n = adf_statistic(y, max_lag) if len(y) > 10 else (np.nan, 0, len(y))
        b = ADF_CRITICAL[5]
        limit = b[0] + b[1] / max(n, 1) + b[2] / max(n, 1) ** 2
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in keys), stat, lag, n, bool(stat < limit)]], columns=[*keys, "adf_stat", "lags", "n", "stationary"])

    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, order, col).groupBy(*keys).applyInPandas(run, f"{kinds}, adf_stat double, lags int, n int, stationary boolean")


def engle_granger(prices: DataFrame, keys: Iterable[str], order: str, y: str, x: str, max_lag: int = 8) -> DataFrame:
    """Hedge ratio by native regression, then the residual's Dickey-Fuller statistic, per key."""
    keys = list(keys)
    w = Window.partitionBy(*keys)
    resid = prices.withColumns({"hedge": F.regr_slope(y, x).over(w), "base": F.regr_intercept(y, x).over(w)}).withColumn("resid", F.col(y) - F.col("base") - F.col("hedge") * F.col(x))
    ratio = resid.groupBy(*keys).agg(F.first("hedge").alias("hedge_ratio"), F.first("base").alias("intercept"))
    return adf(resid, "resid", keys, order, max_lag).join(ratio, keys)


def engle_granger_both(prices: DataFrame, keys: Iterable[str], order: str, a: str, b: str, max_lag: int = 8) -> DataFrame:
    """Engle-Granger on logarithms in both directions; the one of lower statistic stays (ties: ``a`` on ``b``)."""
    keys = list(keys)
    logs = prices.where((F.col(a) > 0) & (F.col(b) > 0)).withColumns({"_a": F.ln(a), "_b": F.ln(b)})
    both = engle_granger(logs, keys, order, "_a", "_b", max_lag).withColumn("direction", F.lit("a_on_b")).unionByName(engle_granger(logs, keys, order, "_b", "_a", max_lag).withColumn("direction", F.lit("b_on_a")))
    stat = F.nanvl("adf_stat", F.lit(float("inf")))
    best = F.min_by(F.struct("direction", "adf_stat", "lags", "n", "stationary", "hedge_ratio", "intercept"), F.struct(stat, "direction"))
    return both.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


#: 5 % critical values of the trace and largest-eigenvalue tests with a constant, by series less rank (1, 2).
JOHANSEN_TRACE_5 = (3.8415, 15.4943)
JOHANSEN_MAX_5 = (3.8415, 14.2639)


def johansen(df: DataFrame, cols: tuple[str, str], keys: Iterable[str], order: str) -> DataFrame:
    """Trace and largest-eigenvalue statistics of two series per key, with a constant and one lagged difference.

    The moments of differences, lagged levels and lagged differences are native sums, so a series of any length is one small
    matrix a key before Python sees it. Rows with nulls go; keys of ten complete rows or fewer, or of a constant series, are null."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(order)
    k = len(cols)
    # Levels from their first value: the same statistics, and sums that don't cancel.
    clean = df.dropna(subset=list(cols))
    level = clean.select(*keys, order, *((F.col(c) - F.first(c).over(w)).alias(f"x{i}") for i, c in enumerate(cols)))
    step = level.withColumns({f"l{i}": F.lag(f"x{i}").over(w) for i in range(k)}).withColumns({f"d{i}": F.col(f"x{i}") - F.col(f"l{i}") for i in range(k)})
    step = step.withColumns({f"p{i}": F.lag(f"d{i}").over(w) for i in range(k)}).withColumn("one", F.lit(1.0))
    v = [*(f"d{i}" for i in range(k)), *(f"l{i}" for i in range(k)), "one", *(f"p{i}" for i in range(k))]
    ready = F.col("p0").isNotNull()
    sums = F.array(*(F.sum(F.when(ready, F.col(a) * F.col(b))) for a in v for b in v))
    moments = step.groupBy(*keys).agg(F.count("p0").alias("n"), sums.alias("m"))

    def solve(batches):
        for pdf in batches:
            found = [johansen_statistics(m, n, k) if n > 10 else (None,) * 4 for m, n in zip(pdf["m"], pdf["n"])]
            out = pd.DataFrame(found, columns=["trace_0", "trace_1", "max_0", "max_1"], dtype="float64")
            yield pd.concat([pdf[[*keys, "n"]].reset_index(drop=True), out], axis=1)

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keys)
    found = moments.mapInPandas(solve, f"{kinds}, n long, trace_0 double, trace_1 double, max_0 double, max_1 double")
    first, second = F.col("trace_0") > JOHANSEN_TRACE_5[1], F.col("trace_1") > JOHANSEN_TRACE_5[0]
    return found.withColumns({"rank_trace": F.when(~first, 0).when(~second, 1).otherwise(2), "rank_max": F.when(F.col("max_0") <= JOHANSEN_MAX_5[1], 0).when(F.col("max_1") <= JOHANSEN_MAX_5[0], 1).otherwise(2)}).withColumns(
        {c: F.when(F.col("trace_0").isNotNull() & ~F.isnan("trace_0"), F.col(c)) for c in ("trace_0", "trace_1", "max_0", "max_1", "rank_trace", "rank_max")}
    )


def johansen_statistics(moments, n: int, k: int) -> tuple[float, ...]:
    """Trace and largest-eigenvalue statistics for rank 0 and 1 from the moment matrix of (differences, levels, 1, lagged differences)."""
    s = np.asarray(moments, float).reshape(3 * k + 1, -1) / n
    a, z = slice(0, 2 * k), slice(2 * k, None)
    if not np.isfinite(s).all() or (np.diag(s) <= 0).any():
        return (np.nan,) * 4
    r = s[a, a] - s[a, z] @ np.linalg.pinv(s[z, z]) @ s[z, a]
    r00, r01, r11 = r[:k, :k], r[:k, k:], r[k:, k:]
    lam = np.linalg.eigvals(np.linalg.pinv(r11) @ r01.T @ np.linalg.pinv(r00) @ r01).real
    gain = -n * np.log1p(-np.clip(np.sort(lam)[::-1], 0, 1 - 1e-12))
    return float(gain.sum()), float(gain[1]), float(gain[0]), float(gain[1])


#: The cumulated mass of Poisson(1) at 0 to 6; beyond six it is below 1e-4.
_POISSON = np.array([0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582])
#: The weight by a uniform number's first 16 bits, and those first bits that a bound of the cumulated mass parts.
_FIRST = 2.0**-16
_WEIGHT = np.searchsorted(_POISSON, np.arange(1 << 16) * _FIRST).astype(np.uint8)
_PARTED = np.unique((_POISSON / _FIRST).astype(np.int64))
_IS_PARTED = np.isin(np.arange(1 << 16), _PARTED)
_MIXED = 255  # where the first bits don't tell
_WEIGHT[_IS_PARTED] = _MIXED


def poisson_weights(hashes: np.ndarray, reps: int) -> np.ndarray:
    """(rows, reps) weights: the row's hash and the replicate's number, mixed by splitmix64, give a uniform number each.

    The number's first 16 bits tell its weight by table but for the six values that hold a bound."""
    with np.errstate(over="ignore"):
        z = hashes.view(np.uint64)[:, None] + (np.arange(1, reps + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
        held = np.empty_like(z)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            np.right_shift(z, np.uint64(shift), out=held)
            z ^= held
            z *= np.uint64(factor)
        np.right_shift(z, np.uint64(31), out=held)
        z ^= held
    np.right_shift(z, np.uint64(48), out=held)
    w = _WEIGHT.take(held.view(np.int64))
    mixed = np.nonzero(w == _MIXED)
    w[mixed] = np.searchsorted(_POISSON, (z[mixed] >> np.uint64(11)).astype(np.float64) * 2.0**-53)
    return w


def bootstrap(df: DataFrame, value: str, keys: Iterable[str], reps: int, seed: int = 7, rows_at_once: int = 16, keys_held: int = 200) -> DataFrame:
    """Poisson bootstrap of the mean per key: each row's weight in each replicate follows from a hash of the row, its number
    among rows equal to it, and the replicate, so it needs no index join and repeats exactly on any partitioning, and equal
    rows are drawn each for itself. A task draws all replicates of a row side by side and hands on two numbers a key and
    replicate, however many rows it has; their means are summarised natively."""
    keys = list(keys)
    df = df.withColumn("_copy", F.row_number().over(Window.partitionBy(*df.columns).orderBy(F.lit(1))))
    drawn = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"), F.xxhash64(F.lit(seed), *df.columns).alias("_h"))
    schema = T.StructType([*drawn.select(*keys).schema.fields, T.StructField("rep", T.IntegerType()), T.StructField("_w", T.LongType()), T.StructField("_s", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[np.ndarray]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for own, (w, s) in held.items():
                names = [pa.array([v] * reps, pa_type) for v, pa_type in zip(own, kinds)]
                yield pa.RecordBatch.from_arrays([*names, pa.array(np.arange(reps, dtype=np.int32)), pa.array(w), pa.array(s)], names=[*keys, "rep", "_w", "_s"])
            held.clear()

        kinds: list[pa.DataType] = []
        for b in batches:
            kinds = [b.column(k).type for k in keys]
            v, h = b.column("_v").to_numpy(), b.column("_h").to_numpy()
            groups: dict[tuple, list[int]] = {}
            for k, own in enumerate(zip(*(b.column(c).to_pylist() for c in keys))):
                groups.setdefault(own, []).append(k)
            for own, at in groups.items():
                total = held.setdefault(own, [np.zeros(reps, np.int64), np.zeros(reps)])
                for lo in range(0, len(at), rows_at_once):
                    part = np.array(at[lo : lo + rows_at_once])
                    # The weights' sums are whole numbers, exact as doubles too: one product for both sums.
                    sums = np.stack([np.ones(len(part)), v[part]]) @ poisson_weights(np.ascontiguousarray(h[part]), reps).astype(np.float64)
                    total[0] += sums[0].astype(np.int64)
                    total[1] += sums[1]
                if len(held) > keys_held:
                    yield from flush()
        yield from flush()

    merged = drawn.mapInArrow(run, schema).groupBy(*keys, "rep").agg((F.sum("_s") / F.nullif(F.sum("_w"), F.lit(0))).alias("mean"))
    return merged.groupBy(*keys).agg(F.count("mean").alias("reps"), F.expr("percentile(mean, 0.025)").alias("lo"), F.expr("percentile(mean, 0.5)").alias("median"), F.expr("percentile(mean, 0.975)").alias("hi"))


def block_bootstrap_slopes(df: DataFrame, col: str, keys: Iterable[str], order: str, block: int, reps: int, seed: int = 11) -> DataFrame:
    """Moving-block bootstrap of the level regressed on its lag: ``phi`` per series and replicate.

    A block is drawn whole, so what meets a draw is the block's moments (one row a start, from a sliding window), not its rows;
    draws are numbers alone, made in tasks of a replicate of a series and shuffled once. Series of ``2 * block`` rows or fewer have none."""
    keys = list(keys)
    own = Window.partitionBy(*keys)
    w = own.orderBy(order)
    # From the series' mean: the same slope, and sums that don't cancel.
    rows = df.select(*keys, F.row_number().over(w).alias("rn"), F.lag(col).over(w).alias("_l"), (F.col(col) - F.avg(col).over(own)).alias("_y"))
    rows = rows.withColumn("_x", F.when(F.col("_l").isNotNull(), F.lag("_y").over(Window.partitionBy(*keys).orderBy("rn"))))
    n = rows.where("_l is not null").groupBy(*keys).agg(F.max("rn").alias("n")).where(F.col("n") > 2 * block)
    series = n.withColumn("_id", F.dense_rank().over(Window.orderBy(*keys)))  # a row a series
    ahead = Window.partitionBy("_id").orderBy("rn").rowsBetween(0, block - 1)
    both = F.col("_x").isNotNull() & F.col("_y").isNotNull()
    parts = {"m": F.when(both, 1.0), "x": F.when(both, F.col("_x")), "y": F.when(both, F.col("_y")), "xx": F.when(both, F.col("_x") * F.col("_x")), "xy": F.col("_x") * F.col("_y")}
    moments = rows.join(F.broadcast(series.select(*keys, "_id")), keys).select("_id", "rn", *(F.coalesce(F.sum(c).over(ahead), F.lit(0.0)).alias(k) for k, c in parts.items()))
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    draws = series.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))).repartition(tasks, "_id", "rep")
    draws = draws.withColumn("j", F.explode(F.sequence(F.lit(1), F.ceil(F.col("n") / block).cast("int"))))
    start = F.pmod(F.xxhash64(F.lit(seed), *keys, "rep", "j"), (F.col("n") - block).cast("long"))
    wanted = draws.select("_id", "rep", (start + 1).cast("int").alias("rn"))
    sums = wanted.join(moments.hint("shuffle_hash"), ["_id", "rn"]).groupBy("_id", "rep").agg(*(F.sum(k).alias(k) for k in parts))
    across = F.col("xx") - F.col("x") * F.col("x") / F.col("m")
    phi = (F.col("xy") - F.col("x") * F.col("y") / F.col("m")) / F.nullif(across, F.lit(0.0))
    return sums.where("m > 1").withColumn("phi", phi).join(F.broadcast(series), "_id").select(*keys, "rep", "phi")


def random_entries(moves: DataFrame, keys: Iterable[str], rn: str, move: str, sims: int, block: int = 6, choices: int = 4, seed: int = 3) -> DataFrame:
    """``mean`` per simulation of signed moves: each simulation enters every block of ``block`` rows of a series once, at one of its
    first ``choices`` rows and on a side, by hash; an entry where no move is known counts nothing.

    A block is one row with its moves beside each other, so a simulation picks in place and only a sum and a count a
    simulation leave a task."""
    keys = list(keys)
    place = F.col(rn) % block
    each = [F.max(F.when(place == k, F.col(move))).alias(f"_m{k}") for k in range(choices)]
    blocks = moves.groupBy(*keys, F.floor(F.col(rn) / block).alias("block")).agg(*each)
    tasks = max(int(moves.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    entries = blocks.repartition(tasks, *keys, "block").withColumn("sim", F.explode(F.sequence(F.lit(1), F.lit(sims))))
    u = F.pmod(F.xxhash64(F.lit(seed), "sim", *keys, "block"), F.lit(2 * choices))
    picked = entries.withColumn("_u", u)
    at = F.pmod(F.col("_u"), F.lit(choices))
    found = F.coalesce(*(F.when(at == k, F.col(f"_m{k}")) for k in range(choices)))
    return picked.select("sim", (F.when(F.col("_u") < choices, 1).otherwise(-1) * found).alias("_g")).groupBy("sim").agg(F.avg("_g").alias("mean")).where("mean is not null")


def block_lengths(n: int, n_lags: int, least: int, most: int) -> list[int]:
    """Block lengths for a series of ``n`` rows, evenly spaced by their logarithm, equal ones once."""
    step = (np.log10(min(n // 4, most)) - np.log10(least)) / (n_lags - 1)
    return sorted({int(np.floor(10.0 ** (np.log10(least) + k * step) + 1e-9)) for k in range(n_lags)})


def rescaled_ranges(y: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The cumulated deviation's range over the deviation of each row of ``y``, a block; blocks of one value are left out.
    Values that are not ``known`` count nothing."""
    n = known.sum(1)
    # From the block's first value: the same figures, and exact zeros where all are equal.
    d = np.where(known, y - y[np.arange(len(y)), known.argmax(1)][:, None], 0.0)
    d = np.where(known, d - (d.sum(1) / np.maximum(n, 1))[:, None], 0.0)
    sd = np.sqrt((d * d).sum(1) / np.maximum(n - 1, 1))
    c, seen = np.cumsum(d, axis=1), np.maximum.accumulate(known, axis=1)
    span = np.where(seen, c, -np.inf).max(1) - np.where(seen, c, np.inf).min(1)
    whole = (n > 1) & ~(sd <= 0)
    return span[whole] / sd[whole]


def hurst(df: DataFrame, col: str, keys: Iterable[str], order: str, n_lags: int = 30, least: int = 10, most: int = 500, chunk: int = 8192) -> DataFrame:
    """Rescaled-range exponent per series: ``n_lags`` block lengths, evenly spaced by their logarithm from ``least`` to a quarter of
    the series (``most`` at most), equal ones once; the mean over whole blocks of the cumulated deviation's range over the
    deviation, regressed on the length. Null with five lengths or fewer.

    A row goes to the task of its ``chunk`` of the series, and to the chunk before if a block that begins there may reach it:
    a row is shuffled about once for all lengths, and a task holds a chunk. Sums a chunk and length come out."""
    keys, chunk = list(keys), max(chunk, most)
    own = Window.partitionBy(*keys)
    rn = F.row_number().over(own.orderBy(order)) - 1
    rows = df.select(*keys, F.col(col).cast("double").alias("_y"), rn.alias("rn"), F.count(F.lit(1)).over(own).alias("n")).where(F.least(F.floor(F.col("n") / 4), F.lit(most)) >= least)
    at = F.floor(F.col("rn") / chunk)
    reached = F.when((at > 0) & (F.col("rn") % chunk < most), F.array(at - 1, at)).otherwise(F.array(at))
    dealt = rows.select(*keys, "_y", "rn", "n", F.explode(reached).alias("_chunk"))
    schema = T.StructType([*dealt.select(*keys).schema.fields, T.StructField("size", T.LongType()), T.StructField("_s", T.DoubleType()), T.StructField("_n", T.LongType())])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rn")
        y, known = table.column("_y").fill_null(0.0).to_numpy(), table.column("_y").is_valid().to_numpy()
        first, n, start = table.column("rn")[0].as_py(), table.column("n")[0].as_py(), table.column("_chunk")[0].as_py() * chunk
        sums = []
        for size in block_lengths(n, n_lags, least, most):
            # Blocks that begin in the chunk and end in the series.
            lo, hi = -(-start // size), min(-(-(start + chunk) // size), n // size)
            if hi > lo:
                part = slice(lo * size - first, hi * size - first)
                rs = rescaled_ranges(y[part].reshape(-1, size), known[part].reshape(-1, size))
                sums.append((size, float(rs.sum()), len(rs)))
        names = [pa.array([table.column(k)[0].as_py()] * len(sums), table.column(k).type) for k in keys]
        return pa.Table.from_arrays([*names, *(pa.array([r[k] for r in sums], t) for k, t in enumerate((pa.int64(), pa.float64(), pa.int64())))], names=[*keys, "size", "_s", "_n"])

    # Dealt by chunk: the series' own partitions would do for Spark, and leave a series in one task.
    mean = dealt.repartition(*keys, "_chunk").groupBy(*keys, "_chunk").applyInArrow(run, schema).groupBy(*keys, "size").agg((F.sum("_s") / F.nullif(F.sum("_n"), F.lit(0))).alias("rs")).where("rs > 0")
    fit = mean.groupBy(*keys).agg(F.regr_slope(F.ln("rs"), F.ln("size")).alias("_h"), F.count(F.lit(1)).alias("n_lags"))
    return fit.select(*keys, F.when(F.col("n_lags") > 5, F.col("_h")).alias("hurst"), "n_lags")


def normal_upper_quantile(tail: Column, terms: int = 80, steps: int = 5) -> Column:
    """The standard normal value that ``tail`` (at most 0.05) lies above, as an expression: Newton steps on the logarithm of the
    tail, which keep relative precision however small it is, from a start of sqrt(-2 ln tail). The tail over the
    density is a continued fraction of ``terms`` terms."""
    mills = lambda x: 1 / (x + F.aggregate(F.sequence(F.lit(terms), F.lit(1)), F.lit(0.0), lambda f, k: k / (x + f)))
    log_density = lambda x: -x * x / 2 - 0.9189385332046727  # noqa: E731  half the logarithm of 2 pi

    def step(x: Column, _: Column) -> Column:
        with_ratio = F.transform(F.array(mills(x)), lambda m: x + (log_density(x) + F.ln(m) - F.ln(tail)) * m)
        return with_ratio[0]

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.sqrt(-2 * F.ln(tail)), step)


def effective_tests(series: DataFrame, keys: Iterable[str], order: Iterable[str], value: str) -> DataFrame:
    """One row: ``n_tests`` series, and ``n_effective`` independent ones by the variance of their correlation matrix's eigenvalues,
    1 + (m - 1)(1 - var / m). The eigenvalues' squares sum to the squares of the correlations, so no decomposition is needed.
    The matrix grows with the square of the series; each correlation is an aggregate of joined rows."""
    keys, order = list(keys), list(order)
    name = F.concat_ws("|", *keys)
    a = series.select(*order, name.alias("_a"), F.col(value).alias("_x"))
    b = series.select(*order, name.alias("_b"), F.col(value).alias("_y"))
    each = a.join(b, order).where("_a < _b").groupBy("_a", "_b").agg(F.coalesce(corr("_x", "_y"), F.lit(0.0)).alias("r"))
    square = each.agg((2 * F.coalesce(F.sum(F.col("r") * F.col("r")), F.lit(0.0))).alias("_square"))
    m = series.select(*keys).distinct().agg(F.count(F.lit(1)).alias("n_tests"))
    variance = F.coalesce(F.col("_square") / F.nullif(F.col("n_tests") - 1, F.lit(0)), F.lit(0.0))
    return m.crossJoin(square).select("n_tests", (1 + (F.col("n_tests") - 1) * (1 - variance / F.col("n_tests"))).alias("n_effective"))
