"""Position rules over fitted signals and grids, the FIFO book, calibrated gates and corrections for many tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from basisweave.functions import exprs as x
from basisweave.operators import backtest, books, pairs, stats
from basisweave.operators import series as s
from basisweave.plans.catalog import query, r
from basisweave.plans.relational import bets
from basisweave.plans.sql import over
from basisweave.sources import files, venue

_KEY = ["window_id", "coin", "pair", "snapshot_idx"]
_K = "window_id, coin, pair"


def _folded(view: str, before: str, source: str, grid: str, after: str, keys: str = _K, *more: str) -> str:
    """SQL of the position rule as a recursion over ``source`` (keys, t, z, s) for each row of ``grid`` (combo, en, ex, mh, cd)."""
    same = " AND ".join(f"b.{k.strip()} = f.{k.strip()}" for k in keys.split(","))
    own = ", ".join(f"f.{k.strip()}" for k in keys.split(","))
    fold = f"""{before} src AS ({source}), grid AS ({grid}),
zb AS (SELECT {keys}, t, z, s, row_number() OVER (PARTITION BY {keys} ORDER BY t) AS k FROM src WHERE z IS NOT NULL),
f AS (SELECT DISTINCT {keys}, combo, en, ex, mh, cd, 0::BIGINT AS k, 0 AS d, 0 AS t0, 0.0::DOUBLE AS s0, -1000000 AS free, NULL::INTEGER AS entry, NULL::INTEGER AS exit, NULL::INTEGER AS way, NULL::DOUBLE AS gross, NULL::VARCHAR AS reason FROM zb, grid
UNION ALL SELECT {keys}, combo, en, ex, mh, cd, k, CASE WHEN leave THEN 0 WHEN enter THEN CASE WHEN z > 0 THEN -1 ELSE 1 END ELSE d END, CASE WHEN leave THEN 0 WHEN enter THEN t ELSE t0 END, CASE WHEN leave THEN 0 WHEN enter THEN s ELSE s0 END,
 CASE WHEN leave THEN t + 1 + cd ELSE free END, CASE WHEN leave THEN t0 END, CASE WHEN leave THEN t END, CASE WHEN leave THEN d END, CASE WHEN leave THEN d * (s - s0) END, CASE WHEN leave THEN CASE WHEN back THEN 'signal' ELSE 'timeout' END END
 FROM (SELECT {own}, f.combo, f.en, f.ex, f.mh, f.cd, b.k, b.t, b.z, b.s, f.d, f.t0, f.s0, f.free, CASE WHEN f.d = 1 THEN b.z >= -f.ex ELSE b.z <= f.ex END AS back,
  f.d <> 0 AND (CASE WHEN f.d = 1 THEN b.z >= -f.ex ELSE b.z <= f.ex END OR b.t - f.t0 >= f.mh) AS leave, f.d = 0 AND abs(b.z) >= f.en AND b.t >= f.free AS enter
  FROM f JOIN zb b ON {same} AND b.k = f.k + 1)),
trade AS (SELECT * FROM f WHERE exit IS NOT NULL) {after}"""
    return over(view, "WITH " + fold.strip(), *more).replace("WITH ", "WITH RECURSIVE ", 1)


_OU = """ou AS (SELECT *, regr_slope(dy, x) OVER k AS b, regr_intercept(dy, x) OVER k AS a, regr_count(dy, x) OVER k AS n, regr_syy(dy, x) OVER k - regr_sxy(dy, x) OVER k * regr_sxy(dy, x) OVER k / nullif(regr_sxx(dy, x) OVER k, 0) AS sse, row_number() OVER (PARTITION BY window_id, coin, pair ORDER BY snapshot_idx) AS rn
  FROM (SELECT *, lag(spread_bps) OVER w AS x, spread_bps - lag(spread_bps) OVER w AS dy FROM pair WINDOW w AS (PARTITION BY window_id, coin, pair ORDER BY snapshot_idx)) WINDOW k AS (PARTITION BY window_id, coin, pair)),
fit AS (SELECT *, -b AS theta, a / -b AS mu, sqrt(sse / n) AS sigma FROM ou WHERE n >= 20 AND b < 0 AND sse > 1e-9),
mv AS (SELECT *, regr_slope(dy, x) OVER (PARTITION BY window_id, coin, pair ORDER BY snapshot_idx ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING) AS pb FROM ou),
wd AS (SELECT *, rn - greatest(1, rn - CASE WHEN pb < 0 THEN greatest(10, least(CAST(round(3 * ln(2) / -pb) AS BIGINT), rn - 1)) ELSE 20 END) AS w FROM mv WHERE rn > 20),
ad AS (SELECT c.window_id, c.coin, c.pair, c.snapshot_idx, any_value(c.spread_bps) AS s, CASE WHEN stddev_pop(p.spread_bps) > 1e-10 THEN (any_value(c.spread_bps) - avg(p.spread_bps)) / stddev_pop(p.spread_bps) ELSE 0 END AS z FROM wd c JOIN ou p ON p.window_id = c.window_id AND p.coin = c.coin AND p.pair = c.pair AND p.rn >= c.rn - c.w AND p.rn < c.rn GROUP BY ALL),"""


@query(
    "pos_02_in_sample_ou_book",
    _folded(
        "pair",
        _OU,
        "SELECT window_id, coin, pair, 'residual' AS model, snapshot_idx AS t, CASE WHEN rn > 10 THEN (spread_bps - mu) / sigma END AS z, spread_bps AS s FROM fit UNION ALL SELECT window_id, coin, pair, 'stationary', snapshot_idx, CASE WHEN rn > 10 AND theta < 2 THEN (spread_bps - mu) / (sigma / sqrt(1 - (1 - theta) * (1 - theta))) END, spread_bps FROM fit UNION ALL SELECT window_id, coin, pair, 'adaptive', snapshot_idx, z, s FROM ad",
        "SELECT 0 AS combo, 2.0 AS en, 0.5 AS ex, 1000000 AS mh, -1 AS cd",
        "SELECT window_id, coin, pair, model, entry, exit, way AS direction, round(gross, 4) AS gross_bps FROM trade",
        "window_id, coin, pair, model",
    ),
)
def pos_02(spark, d):
    """Enter two deviations from the in-sample mean-reverting fit, leave within half a one: by the step's deviation, by the
    long-run one, and against an adaptive window that leaves the row itself out. Series that do not revert have no book."""
    p = pairs.spread_series(venue.tickers(spark, d)).select(*_KEY, "spread_bps").where("spread_bps is not null")
    ou = backtest.ou_signal(p).select(*_KEY, "spread_bps", F.col("z_residual").alias("residual"), F.col("z_stationary").alias("stationary"))
    fitted = ou.unpivot([*_KEY, "spread_bps"], ["residual", "stationary"], "model", "zscore")
    moving = backtest.adaptive_signal(p).select(*_KEY, "spread_bps", F.lit("adaptive").alias("model"), F.col("z_adaptive").alias("zscore"))
    t = backtest.hysteresis(fitted.unionByName(moving), (*s.KEYS, "model"), entry=2.0, exit=0.5, max_hold=1_000_000, cooldown=-1)
    return t.select(*s.KEYS, "model", "entry", "exit", "direction", r("gross_bps"))


@query(
    "pos_03_gated_book",
    _folded(
        "z",
        "",
        "SELECT window_id, coin, pair, snapshot_idx AS t, CASE WHEN stddev_samp(spread_bps) OVER f >= 1500 THEN zscore END AS z, spread_bps AS s FROM z WINDOW f AS (PARTITION BY window_id, coin, pair ORDER BY snapshot_idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)",
        "SELECT 0 AS combo, 1.5 AS en, 0.5 AS ex, 12 AS mh, 3 AS cd",
        "SELECT window_id, coin, pair, entry, exit, way AS direction, reason, round(gross, 4) AS gross_bps FROM trade",
    ),
)
def pos_03(spark, d):
    """The rule where the spread's trailing deviation pays the cost, with a cooldown after each exit; every trade."""
    sd = F.stddev_samp("spread_bps").over(s.frame(w=20))
    sig = pairs.scored(venue.tickers(spark, d)).withColumn("zscore", F.when(sd >= 1500, F.col("zscore")))
    t = backtest.hysteresis(sig, s.KEYS, entry=1.5, exit=0.5, max_hold=12, cooldown=3)
    return t.select(*s.KEYS, "entry", "exit", "direction", "reason", r("gross_bps"))


_ENTRIES, _EXITS, _HOLDS, _WAITS = (1.0, 1.25, 1.5, 1.75, 2.0), (0.0, 0.1, 0.25, 0.4, 0.5, 0.75), (6, 12, 24), (0, 2, 5)


@query(
    "pos_05_walk_forward",
    _folded(
        "z",
        "",
        f"SELECT {_K}, snapshot_idx AS t, zscore AS z, spread_bps AS s FROM z",
        f"SELECT CAST(row_number() OVER (ORDER BY en, ex, mh, cd) - 1 AS INTEGER) AS combo, * FROM (SELECT unnest({list(_ENTRIES)}) AS en), (SELECT unnest({list(_EXITS)}) AS ex), (SELECT unnest({list(_HOLDS)}) AS mh), (SELECT unnest({list(_WAITS)}) AS cd)",
        """, span AS (SELECT min(snapshot_idx) AS lo, max(snapshot_idx) AS hi FROM z),
g AS (SELECT 4 * (entry - lo) // (hi - lo + 1) AS fold, combo, round(avg(gross), 6) AS mean, count(*) AS n FROM trade, span GROUP BY ALL HAVING count(*) >= 10),
best AS (SELECT fold + 1 AS fold, arg_max(combo, (mean, -combo)) AS combo, max(mean) AS train_mean FROM g GROUP BY 1)
SELECT CAST(fold AS INTEGER) AS fold, combo, round(train_mean, 4) AS train_mean, round(mean, 4) AS test_mean, n, round(mean / nullif(train_mean, 0), 4) AS retention FROM g JOIN best USING (fold, combo)""",
    ),
)
def pos_05(spark, d):
    """Four folds of time: the best of 270 combinations in each, and what it earned in the next."""
    z = pairs.scored(venue.tickers(spark, d)).select(*_KEY, "zscore", "spread_bps")
    lo, hi = z.agg(F.min("snapshot_idx"), F.max("snapshot_idx")).first()
    t = backtest.hysteresis_totals(z, s.KEYS, backtest.grid(spark, _ENTRIES, _EXITS, _HOLDS, _WAITS), folds=(lo or 0, hi or 0, 4))
    by = t.groupBy("fold", "combo").agg(F.round(F.sum("net") / F.sum("n"), 6).alias("mean"), F.sum("n").alias("n"))
    by = files.kept(by.where("n >= 10"), "folds")
    best = by.groupBy((F.col("fold") + 1).alias("fold")).agg(F.max_by("combo", F.struct("mean", -F.col("combo"))).alias("combo"), F.max("mean").alias("train_mean"))
    out = by.join(F.broadcast(best), ["fold", "combo"])
    return out.select("fold", "combo", r("train_mean"), r("mean").alias("test_mean"), "n", r(F.col("mean") / F.nullif("train_mean", F.lit(0.0))).alias("retention"))


_CENTRE = {"window": 20, "vol": 1.0, "entry": 1.5, "exit": 0.5}
#: One parameter at a time, the others at the centre; a gate is its multiple of 1,500 bps of trailing deviation.
_AROUND = {"window": (15, 20, 30), "vol": (0.6, 0.8, 1.0, 1.2, 1.4), "entry": (1.0, 1.25, 1.5, 1.75, 2.0), "exit": (0.35, 0.5, 0.65, 0.8)}
_MOVES = [(axis, float(v), *(v if a == axis else c for a, c in _CENTRE.items())) for axis, values in _AROUND.items() for v in values]
_SIGNALS = sorted({(w, g) for _, _, w, g, _, _ in _MOVES})


def _z_of(w: int, g: float) -> str:
    f = f"(PARTITION BY {_K} ORDER BY snapshot_idx ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    return f"SELECT {_K}, {w} AS w, CAST({g} AS DOUBLE) AS vol, snapshot_idx AS t, CASE WHEN count(spread_bps) OVER f >= 6 AND stddev_samp(spread_bps) OVER f > 0 AND stddev_samp(spread_bps) OVER f >= {g} * 1500 THEN (spread_bps - avg(spread_bps) OVER f) / stddev_samp(spread_bps) OVER f END AS z, spread_bps AS s FROM pair WINDOW f AS {f}"


@query(
    "pos_06_parameter_stability",
    _folded(
        "pair",
        "",
        " UNION ALL ".join(_z_of(*v) for v in _SIGNALS),
        f"SELECT CAST(row_number() OVER (ORDER BY en, ex) AS INTEGER) AS combo, *, 12 AS mh, 2 AS cd FROM (SELECT unnest({list(_AROUND['entry'])}) AS en), (SELECT unnest({list(_AROUND['exit'])}) AS ex)",
        f""", m AS (SELECT * FROM (VALUES {', '.join(f"('{m[0]}', CAST({m[1]} AS DOUBLE), {m[2]}, CAST({m[3]} AS DOUBLE), CAST({m[4]} AS DOUBLE), CAST({m[5]} AS DOUBLE))" for m in _MOVES)}) AS t(param, val, mw, mv, men, mex)),
o AS (SELECT param, val, CAST(count(gross) AS BIGINT) AS n, round(avg(gross - 16), 4) AS avg_net, round(avg((gross > 16)::INT), 6) AS win_rate FROM m LEFT JOIN trade ON w = mw AND vol = mv AND en = men AND ex = mex GROUP BY ALL),
c AS (SELECT avg_net AS base FROM o WHERE param = 'entry' AND val = {_CENTRE['entry']})
SELECT param, val AS value, n, avg_net, win_rate, round(avg_net - base, 4) AS delta FROM o, c""",
        f"{_K}, w, vol",
    ),
)
def pos_06(spark, d):
    """Each parameter moved alone around a centre, window and volatility gate among them: what the net gain loses."""
    p = pairs.spread_series(venue.tickers(spark, d)).select(*_KEY, "spread_bps")
    frames = {w: s.frame(w=w) for w, _ in _SIGNALS}
    p = p.withColumns({f"z{w}": s.rolling_z(F.col("spread_bps"), f, 6) for w, f in frames.items()} | {f"sd{w}": F.stddev_samp("spread_bps").over(f) for w, f in frames.items()})
    variants = F.array(*(F.struct(F.lit(w).alias("w"), F.lit(float(g)).alias("vol"), F.when(F.col(f"sd{w}") >= g * 1500, F.col(f"z{w}")).alias("zscore")) for w, g in _SIGNALS))
    sig = p.select(*_KEY, "spread_bps", F.inline(variants))
    t = backtest.hysteresis_totals(sig, (*s.KEYS, "w", "vol"), backtest.grid(spark, _AROUND["entry"], _AROUND["exit"], (12,), (2,)), cost=16)
    moves = spark.createDataFrame([(m[0], m[1], int(m[2]), *(float(v) for v in m[3:])) for m in _MOVES], "param string, value double, w int, vol double, entry_z double, exit_z double")
    met = F.broadcast(moves).join(t.groupBy("w", "vol", "entry_z", "exit_z").agg(F.sum("n").alias("n"), F.sum("net").alias("net"), F.sum("won").alias("won")), ["w", "vol", "entry_z", "exit_z"], "left")
    out = met.select("param", "value", F.coalesce("n", F.lit(0)).alias("n"), r(F.col("net") / F.col("n")).alias("avg_net"), r(F.col("won") / F.col("n"), 6).alias("win_rate"))
    base = out.where((F.col("param") == "entry") & (F.col("value") == _CENTRE["entry"])).select(F.col("avg_net").alias("base"))
    return out.crossJoin(F.broadcast(base)).select("param", "value", "n", "avg_net", "win_rate", r(F.col("avg_net") - F.col("base")).alias("delta"))


@query(
    "pos_08_fifo_book",
    over(
        "sig",
        f"""WITH c AS (SELECT s.window_id, s.coin, s.pair, s.snapshot_idx, s.zscore, n.zscore AS z_exit, n.spread_bps - s.spread_bps AS delta, n.snapshot_idx IS NOT NULL AS has_exit FROM sig s LEFT JOIN sig n ON n.window_id = s.window_id AND n.coin = s.coin AND n.pair = s.pair AND n.snapshot_idx = s.snapshot_idx + 3 WHERE abs(s.zscore) >= 1),
m AS (SELECT 'live' AS mode, * FROM c UNION ALL SELECT 'replay', * FROM c WHERE has_exit),
k AS (SELECT *, row_number() OVER (PARTITION BY mode, window_id ORDER BY snapshot_idx, coin, pair) AS k, CASE WHEN has_exit THEN snapshot_idx + 3 ELSE 1000000000 END AS until FROM m),
b AS (SELECT DISTINCT mode, window_id, 0::BIGINT AS k, false AS taken, CAST([] AS STRUCT(key VARCHAR, until INTEGER)[]) AS held FROM k
UNION ALL SELECT mode, window_id, k, take, CASE WHEN take THEN list_append(live, {{'key': key, 'until': until}}) ELSE live END FROM
 (SELECT *, len(live) < 12 AND NOT list_contains(list_transform(live, lambda h: h.key), key) AS take FROM
  (SELECT n.mode, n.window_id, n.k, n.coin || '|' || n.pair AS key, n.until, list_filter(b.held, lambda h: h.until > n.snapshot_idx) AS live FROM b JOIN k n ON n.mode = b.mode AND n.window_id = b.window_id AND n.k = b.k + 1)))
SELECT mode, window_id, coin, pair, snapshot_idx AS entry_snap, has_exit AS settled, CAST(sign(zscore) AS INTEGER) AS direction, round(sign(zscore) * z_exit, 6) AS pnl_proxy, round(delta, 4) AS spread_delta_bps FROM b JOIN k USING (mode, window_id, k) WHERE taken""",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def pos_08(spark, d):
    """Bets of three snapshots in twelve slots: 'replay' admits only bets whose exit row is there, 'live' any, and a bet whose
    exit never comes keeps its slot and its key to the end of the run."""
    sig = pairs.scored(venue.tickers(spark, d)).select(*_KEY, "zscore", "spread_bps")
    later = sig.select(*s.KEYS, (F.col("snapshot_idx") - 3).alias("snapshot_idx"), F.col("zscore").alias("z_exit"), F.col("spread_bps").alias("later_bps"), F.lit(True).alias("has_exit"))
    c = sig.where(F.abs("zscore") >= 1).join(later, _KEY, "left").withColumn("has_exit", F.coalesce("has_exit", F.lit(False)))
    c = c.withColumn("mode", F.explode(F.when(F.col("has_exit"), F.array(F.lit("live"), F.lit("replay"))).otherwise(F.array(F.lit("live")))))
    book = books.fifo_capacity(c, 3, 12, ("mode", "window_id"))
    side = F.signum("zscore")
    return book.select("mode", "window_id", "coin", "pair", F.col("snapshot_idx").alias("entry_snap"), F.col("has_exit").alias("settled"), side.cast("int").alias("direction"), r(side * F.col("z_exit"), 6).alias("pnl_proxy"), r(F.col("later_bps") - F.col("spread_bps")).alias("spread_delta_bps"))


@query(
    "agg_19_isotonic_blocks",
    over(
        "bet",
        """WITH k AS (SELECT abs_pred, gross_bps, row_number() OVER (ORDER BY round(abs_pred, 9), window_id, coin, pair, snapshot_idx) AS rank, count(*) OVER () AS n FROM bet),
m AS (SELECT (rank * least(40, greatest(5, n // 50)) - 1) // n AS block, count(*) AS n, avg(abs_pred) AS x, avg(gross_bps) AS y FROM k GROUP BY 1),
i AS (SELECT a.block AS lo, b.block AS hi, avg(c.y) AS mean FROM m a JOIN m b ON b.block >= a.block JOIN m c ON c.block BETWEEN a.block AND b.block GROUP BY ALL),
t AS (SELECT k.block, lo, min(mean) AS least FROM m k JOIN i ON lo <= k.block AND hi >= k.block GROUP BY ALL)
SELECT CAST(m.block AS BIGINT) AS block, CAST(any_value(n) AS BIGINT) AS n, round(any_value(x), 6) AS mean_abs_pred, round(any_value(y), 4) AS mean_gross, round(max(least), 4) AS expected_gross FROM m JOIN t ON t.block = m.block GROUP BY m.block""",
    ),
)
def agg_19(spark, d):
    """A monotone expectation of gross by confidence over at most forty block means."""
    fit = books.isotonic_blocks(bets(spark, d), [F.round("abs_pred", 9), F.col("window_id"), F.col("coin"), F.col("pair"), F.col("snapshot_idx")])
    return fit.select("block", "n", r("mean_x", 6).alias("mean_abs_pred"), r("mean_y").alias("mean_gross"), r("expected").alias("expected_gross"))


_RATIO = "1 / (x + list_reduce([0.0] || list_transform(range(0, 80), lambda k: CAST(80 - k AS DOUBLE)), lambda f, k: k / (x + f)))"
_NEWTON = f"SELECT coin, pair, c, n, n_tests, n_effective, which, level, x + (-x * x / 2 - 0.9189385332046727 + ln({_RATIO}) - ln(level / 2)) * {_RATIO} AS x FROM "


@query(
    "sta_11_effective_tests",
    over(
        "pair",
        f"""WITH c AS (SELECT coin, pair, corr(mid_a, mid_b) AS c, count(*) AS n FROM pair GROUP BY ALL),
q AS (SELECT a.coin || '|' || a.pair AS a, b.coin || '|' || b.pair AS b, CASE WHEN isfinite(corr(a.spread_bps, b.spread_bps)) THEN corr(a.spread_bps, b.spread_bps) ELSE 0 END AS r FROM pair a JOIN pair b ON a.snapshot_idx = b.snapshot_idx AND a.coin || '|' || a.pair < b.coin || '|' || b.pair GROUP BY ALL),
e AS (SELECT m AS n_tests, 1 + (m - 1) * (1 - (SELECT 2 * sum(r * r) FROM q) / (m - 1) / m) AS n_effective FROM (SELECT count(*) AS m FROM c)),
x0 AS (SELECT *, sqrt(-2 * ln(level / 2)) AS x FROM (SELECT c.*, e.*, which, 0.05 / CASE WHEN which = 'all' THEN n_tests ELSE n_effective END AS level FROM c, e, (VALUES ('all'), ('effective')) w(which))),
x1 AS ({_NEWTON} x0), x2 AS ({_NEWTON} x1), x3 AS ({_NEWTON} x2), x4 AS ({_NEWTON} x3), x5 AS ({_NEWTON} x4)
SELECT coin, pair, which, CAST(n_tests AS BIGINT) AS n_tests, round(n_effective, 6) AS n_effective, round(level, 10) AS level, round(x, 6) AS critical, abs(atanh(c)) * sqrt(n - 3) > x AS stands FROM x5""",
    ),
)
def sta_11(spark, d):
    """Correlations of two venues' prices against the level that all tests, or the effective number of them, leave to each."""
    p = pairs.spread_series(venue.tickers(spark, d))
    c = p.groupBy("coin", "pair").agg(x.corr("mid_a", "mid_b").alias("c"), F.count(F.lit(1)).alias("n"))
    m = stats.effective_tests(p, ["coin", "pair"], ["snapshot_idx"], "spread_bps")
    both = c.crossJoin(F.broadcast(m)).withColumn("which", F.explode(F.array(F.lit("all"), F.lit("effective"))))
    level = both.withColumn("level", 0.05 / F.when(F.col("which") == "all", F.col("n_tests")).otherwise(F.col("n_effective")))
    critical = level.withColumn("critical", stats.normal_upper_quantile(F.col("level") / 2))
    stands = F.abs(F.atanh("c")) * F.sqrt(F.col("n") - 3) > F.col("critical")
    return critical.select("coin", "pair", "which", "n_tests", r("n_effective", 6), r("level", 10), r("critical", 6), stands.alias("stands"))


@query(
    "sta_07_hurst",
    over(
        "pair",
        """WITH y AS (SELECT coin, pair, spread_bps, row_number() OVER (PARTITION BY coin, pair ORDER BY snapshot_idx) - 1 AS rn, count(*) OVER (PARTITION BY coin, pair) AS n FROM pair),
l AS (SELECT DISTINCT coin, pair, CAST(floor(pow(10.0, 1.0 + i * (log10(least(n // 4, 500)) - 1.0) / 29) + 1e-9) AS BIGINT) AS size FROM (SELECT DISTINCT coin, pair, n FROM y WHERE least(n // 4, 500) >= 10), range(0, 30) t(i)),
b AS (SELECT y.coin, y.pair, size, rn // size AS block, rn, spread_bps, spread_bps - avg(spread_bps) OVER (PARTITION BY y.coin, y.pair, size, rn // size) AS dev FROM y JOIN l ON l.coin = y.coin AND l.pair = y.pair WHERE (rn // size + 1) * size <= n),
c AS (SELECT *, sum(dev) OVER (PARTITION BY coin, pair, size, block ORDER BY rn) AS cum FROM b),
g AS (SELECT coin, pair, size, (max(cum) - min(cum)) / stddev_samp(spread_bps) AS rs FROM c GROUP BY coin, pair, size, block HAVING stddev_samp(spread_bps) > 0),
m AS (SELECT coin, pair, size, avg(rs) AS rs FROM g GROUP BY ALL HAVING avg(rs) > 0)
SELECT coin, pair, CASE WHEN count(*) > 5 THEN round(regr_slope(ln(rs), ln(size)), 6) END AS hurst, CAST(count(*) AS BIGINT) AS n_lags FROM m GROUP BY ALL""",
    ),
)
def sta_07(spark, d):
    h = stats.hurst(pairs.spread_series(venue.tickers(spark, d)), "spread_bps", ["coin", "pair"], "snapshot_idx")
    return h.select("coin", "pair", r("hurst", 6), "n_lags")
