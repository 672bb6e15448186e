"""Model experiments as queries: the leg panel and its sequences, ablations, validation rotation, horizons and objectives."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from basisweave.functions.exprs import r_squared
from basisweave.operators import experiments, joins, pairs, panel
from basisweave.operators.metrics import forecast_metrics
from basisweave.operators.series import KEYS
from basisweave.plans.catalog import query, r
from basisweave.plans.sql import over
from basisweave.sources import files, venue

_KEY = ["window_id", "coin", "pair", "snapshot_idx"]
_METRICS = ("mae", "rmse", "r2", "dir_acc", "corr")


def _panel(spark, d):
    bucket = venue.bucket_of(spark, d)
    return panel.leg_panel(venue.tickers(spark, d), panel.buy_sell(venue.with_snapshot(venue.ticks(spark, d), bucket)))


_LEG = """WITH tape AS (SELECT coin, exchange, snapshot_idx, count(*) FILTER (WHERE side = 'buy') / nullif(count(*) FILTER (WHERE side = 'sell'), 0) AS bsr, sum(volume) AS vol FROM tick GROUP BY ALL),
leg AS (SELECT t.*, (ask - bid) / ((ask + bid) / 2) * 1e4 AS ba, bsr, vol FROM ticker t JOIN tape USING (coin, exchange, snapshot_idx)),
ctx AS (SELECT coin, snapshot_idx, stddev_samp(mid) AS cross_mid_std, stddev_samp(ba) AS cross_ba_std, avg(imbalance) AS net_ob_pressure FROM leg GROUP BY ALL),
panel AS (SELECT z.window_id, z.coin, z.pair, z.snapshot_idx, z.spread_bps, z.zscore, lead(zscore) OVER (PARTITION BY z.window_id, z.coin, z.pair ORDER BY z.snapshot_idx) AS target, CASE WHEN a.mid > 0 AND b.mid > 0 THEN ln(a.mid) - ln(b.mid) END AS log_mid_diff, a.ba AS ba_bps_a, b.ba AS ba_bps_b, a.bid_volume AS bid_vol_a, a.ask_volume AS ask_vol_a, b.bid_volume AS bid_vol_b, b.ask_volume AS ask_vol_b,
  a.imbalance AS imb_a, b.imbalance AS imb_b, a.bsr AS bsr_a, a.vol AS vol_a, b.bsr AS bsr_b, b.vol AS vol_b, cross_mid_std, cross_ba_std, net_ob_pressure
  FROM z JOIN leg a ON a.coin = z.coin AND a.snapshot_idx = z.snapshot_idx AND a.exchange = z.exchange_a JOIN leg b ON b.coin = z.coin AND b.snapshot_idx = z.snapshot_idx AND b.exchange = z.exchange_b JOIN ctx ON ctx.coin = z.coin AND ctx.snapshot_idx = z.snapshot_idx)"""


@query("ml_20_leg_panel", over("z", f"{_LEG} SELECT window_id, coin, pair, snapshot_idx, round(target, 6) AS target, {', '.join(f'round({c}, 4) AS {c}' for c in panel.CHANNELS)} FROM panel"))
def ml_20(spark, d):
    """Eighteen channels a pair row: spread and z, both legs' quotes, sizes, imbalance and tape, and the coin's context."""
    return _panel(spark, d).select(*_KEY, r("target", 6), *(r(c) for c in panel.CHANNELS))


_KNOWN = " + ".join(f"({c} IS NULL)::INT" for c in panel.CHANNELS)
_TOTAL = " + ".join(f"coalesce({c}, 0)" for c in panel.CHANNELS)


@query("ml_20_sequences", over("z", f"{_LEG}, q AS (SELECT window_id, coin, pair, snapshot_idx, target, count(*) OVER f AS t, sum({_KNOWN}) OVER f AS gone, sum({_TOTAL}) OVER f AS total, row_number() OVER (PARTITION BY window_id, coin, pair ORDER BY snapshot_idx) AS k FROM panel WINDOW f AS (PARTITION BY window_id, coin, pair ORDER BY snapshot_idx ROWS BETWEEN 15 PRECEDING AND CURRENT ROW)) SELECT window_id, coin, pair, snapshot_idx, round(target, 6) AS target, CAST(gone AS INTEGER) AS n_missing, 288 AS n_values, round(total / 1000, 0) AS total_k FROM q WHERE t = 16 AND k % 4 = 0 AND target IS NOT NULL AND gone <= 0.35 * 288"))
def ml_20_sequences(spark, d):
    """Sixteen steps of eighteen channels as one vector; its values' sum in thousands."""
    seq = panel.sequences(_panel(spark, d))
    total = F.aggregate("steps", F.lit(0.0), lambda a, v: a + F.when(F.isnan(v), 0.0).otherwise(v.cast("double")))
    return seq.select(*_KEY, r("target", 6), "n_missing", F.size("steps").alias("n_values"), F.round(total / 1000, 0).alias("total_k"))


def _rounded(df, *keys):
    return df.select(*keys, "n", *(r(m, 6) for m in _METRICS))


@query("ml_08_group_ablation")
def ml_08(spark, d):
    """Nested and leave-one-out feature groups; the first run's last 15 % of snapshots stops the one fit that locks the rounds."""
    rows = files.kept(panel.model_features(_panel(spark, d)), "features")
    names = [c for c in rows.columns if c not in (*_KEY, "target")]
    first = rows.where("window_id = 'w1'")
    mark = experiments.snapshot_marks(first, (0.85,))[0]
    own = F.col("window_id") == "w1"
    out = experiments.ablation(rows, names, own & (F.col("snapshot_idx") < mark), own & (F.col("snapshot_idx") >= mark), ~own, rounds=20)
    return _rounded(out, "kind", "variant", "n_features", "rounds")


_FEATURES = ("zscore", "zscore_lag1", "zscore_lag2", "zscore_lag3", "spread_bps")


@query("ml_10_validation_rotation")
def ml_10(spark, d):
    """Five ways to choose validation rows, each fit measured on the same forward rows."""
    return _rounded(experiments.rotation(pairs.scored(venue.tickers(spark, d)).select(*_KEY, "target", *_FEATURES), _FEATURES), "config", "role")


@query("ml_11_horizon_objectives")
def ml_11(spark, d):
    """Five horizons, level and change, least squares, a robust and a median fit on the first run; tested on the second."""
    sig = pairs.scored(venue.tickers(spark, d)).select(*_KEY, *_FEATURES)
    rows = files.kept(experiments.horizon_rows(sig, (1, 2, 5, 10, 20), KEYS, _FEATURES), "horizons")
    fits = experiments.objective_fits(rows.where("window_id = 'w1'"), ["horizon", "kind"], _FEATURES, "y", {"ols": None, "huber": 1.35, "quantile": 0.5})
    later = rows.where("window_id = 'w2'").withColumn("objective", F.explode(F.array(*(F.lit(o) for o in ("ols", "huber", "quantile")))))
    fitted = experiments.with_fits(later, ["horizon", "kind", "objective"], _FEATURES, fits)
    naive = rows.where("window_id = 'w2'").withColumns({"objective": F.lit("naive"), "pred": F.col("zscore")})
    both = fitted.select("horizon", "kind", "objective", "y", "pred").unionByName(naive.select("horizon", "kind", "objective", "y", "pred"))
    return _rounded(both.groupBy("horizon", "kind", "objective").agg(*forecast_metrics(F.col("pred"), F.col("y"))), "horizon", "kind", "objective")


@query("ml_14_aux_ablation")
def ml_14(spark, d):
    """With and without a sparse signal, the last large trade of the coin within six snapshots, joined as of each row; the
    distinct snapshots are cut 60, 20 and 20, so that none lies in two parts."""
    bucket = venue.bucket_of(spark, d)
    sig = pairs.scored(venue.tickers(spark, d)).select(*_KEY, "target", *_FEATURES)
    large = venue.with_snapshot(venue.ticks(spark, d), bucket).where("volume >= 90").groupBy("coin", "snapshot_idx").agg(F.sum(F.when(F.col("side") == "buy", F.col("volume")).otherwise(-F.col("volume"))).alias("signed"), F.sum("volume").alias("size"))
    # Known at the snapshot's end, so a row sees those before it.
    rows = joins.asof(sig, large.withColumn("snapshot_idx", F.col("snapshot_idx") + 1), ["coin"], "snapshot_idx", ["signed", "size"], tolerance=6, chunk=100)
    rows = rows.withColumns({f"aux_{c}": F.coalesce(f"{c}_asof", F.lit(0.0)) for c in ("signed", "size")}).dropna(subset=["target", *_FEATURES])
    val, test = experiments.snapshot_marks(sig, (0.6, 0.8))
    t = F.col("snapshot_idx")
    rows = files.kept(rows.select(*_KEY, "target", *_FEATURES, "aux_signed", "aux_size", F.when(t < val, "train").when(t < test, "val").otherwise("test").alias("role")), "aux")
    every = [*_FEATURES, "aux_signed", "aux_size"]
    fits = {}
    for name, features in (("spread_only", list(_FEATURES)), ("with_aux", every)):
        m = experiments.moments(rows, ["role"], features, "target")
        if ("train",) in m and ("val",) in m:
            beta = experiments.chosen_ridge(m["train",], m["val",])[1]
            fits[name,] = [*beta, *[0.0] * (len(every) + 1 - len(beta))]
    tested = rows.where("role = 'test'").withColumn("features", F.explode(F.array(F.lit("spread_only"), F.lit("with_aux"))))
    scored = experiments.with_fits(tested, ["features"], every, fits).select("features", "target", "pred")
    naive = rows.where("role = 'test'").select(F.lit("naive").alias("features"), "target", F.col("zscore").alias("pred"))
    return _rounded(scored.unionByName(naive).groupBy("features").agg(*forecast_metrics(F.col("pred"), F.col("target"))), "features")


@query("ml_09_engineered_and_raw")
def ml_09(spark, d):
    """What lags and z-scores add to the legs' raw channels: one fit of each set on the first run, on the same rows of both; the
    first run's last 15 % of snapshots chooses the penalty."""
    # Written once, before the mark: all else reads the rows there.
    rows = files.kept(panel.model_features(_panel(spark, d)).where("target is not null"), "raw")
    names = [c for c in rows.columns if c not in (*_KEY, "target")]
    mark = experiments.snapshot_marks(rows.where("window_id = 'w1'"), (0.85,))[0]
    role = F.when(F.col("window_id") == "w2", "test").when(F.col("snapshot_idx") < mark, "train").otherwise("val")
    rows = rows.withColumn("role", role)
    sets = {"engineered": [c for c in names if c.startswith("base_")], "raw": [c for c in names if not c.startswith("base_")], "both": names}
    # A set's moments are a part of those of all features: one pass for all sets.
    m, fits = experiments.moments(rows, ["role"], names, "target"), {}
    if ("train",) in m and ("val",) in m:
        for name, features in sets.items():
            at = [0, *(1 + names.index(c) for c in features), len(names) + 1]
            train, val = (m[part,][np.ix_(at, at)] for part in ("train", "val"))
            beta = dict(zip(["", *features], experiments.chosen_ridge(train, val)[1]))
            fits[name,] = [beta[""], *(beta.get(c, 0.0) for c in names)]
    long = rows.where("role <> 'train'").withColumn("features", F.explode(F.array(*(F.lit(s) for s in sets))))
    scored = experiments.with_fits(long, ["features"], names, fits)
    return _rounded(scored.groupBy("features", "role").agg(*forecast_metrics(F.col("pred"), F.col("target"))), "features", "role")


_R2 = "1 - sum((y - @) * (y - @)) / nullif(count(*) * var_pop(y), 0)"


@query(
    "ml_15_protocols",
    over(
        "sig",
        f"""WITH s AS (SELECT snapshot_idx, row_number() OVER (ORDER BY snapshot_idx) AS rank, count(*) OVER () AS n FROM (SELECT DISTINCT snapshot_idx FROM sig)),
q AS (SELECT min(snapshot_idx) FILTER (WHERE rank > n // 4) AS a, min(snapshot_idx) FILTER (WHERE rank > n // 2) AS b, min(snapshot_idx) FILTER (WHERE rank > 3 * n // 4) AS c FROM s),
p AS (SELECT zscore AS z, target AS y, CASE WHEN snapshot_idx < a THEN 0 WHEN snapshot_idx < b THEN 1 WHEN snapshot_idx < c THEN 2 ELSE 3 END AS part FROM sig, q WHERE zscore IS NOT NULL AND target IS NOT NULL),
l AS (SELECT 'chronological' AS protocol, CASE part WHEN 3 THEN 'test' WHEN 2 THEN 'val' ELSE 'train' END AS role, z, y FROM p UNION ALL SELECT 'inverted', CASE part WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END, z, y FROM p),
f AS (SELECT protocol, regr_slope(y, z) AS slope, regr_intercept(y, z) AS base FROM l WHERE role = 'train' GROUP BY 1),
t AS (SELECT l.*, base + slope * z AS pred FROM l JOIN f USING (protocol)), u AS (SELECT * FROM t UNION ALL SELECT protocol, 'all', z, y, pred FROM t)
SELECT protocol, role, CAST(count(*) AS BIGINT) AS n, round({_R2.replace('@', 'pred')}, 6) AS r2, round({_R2.replace('@', 'z')}, 6) AS naive_r2, round(({_R2.replace('@', 'pred')}) - ({_R2.replace('@', 'z')}), 5) AS lift FROM u GROUP BY ALL""",
    ),
)
def ml_15(spark, d):
    """The same fit learnt forward in time and backward, scored on four splits beside naive persistence."""
    sig = pairs.scored(venue.tickers(spark, d)).select(*_KEY, "target", "zscore")
    a, b, c = experiments.snapshot_marks(sig, (0.25, 0.5, 0.75))
    t = F.col("snapshot_idx")
    forward = F.when(t < b, "train").when(t < c, "val").otherwise("test")
    backward = F.when(t < a, "test").when(t < b, "val").otherwise("train")
    each = F.array(*(F.struct(F.lit(n).alias("protocol"), role.alias("role")) for n, role in (("chronological", forward), ("inverted", backward))))
    rows = files.kept(sig.dropna(subset=["target", "zscore"]).select("zscore", "target", F.inline(each)), "protocols")
    m = experiments.moments(rows.where("role = 'train'"), ["protocol"], ["zscore"], "target")
    scored = experiments.with_fits(rows, ["protocol"], ["zscore"], {g: experiments.ridge(own) for g, own in m.items()})
    split = scored.withColumn("role", F.explode(F.array(F.col("role"), F.lit("all"))))
    model, naive = (r_squared(F.col(p), F.col("target")) for p in ("pred", "zscore"))
    return split.groupBy("protocol", "role").agg(F.count(F.lit(1)).alias("n"), r(model, 6).alias("r2"), r(naive, 6).alias("naive_r2"), r(model - naive, 5).alias("lift"))


@query(
    "ml_19_fee_targets",
    over(
        "fwd",
        """WITH y AS (SELECT window_id, zscore AS z, spread_bps_fwd - spread_bps AS move, k, CASE k WHEN 'level' THEN zscore_fwd WHEN 'bps' THEN spread_bps_fwd - spread_bps ELSE sign(spread_bps_fwd - spread_bps) * greatest(abs(spread_bps_fwd - spread_bps) - 1500, 0) END AS y FROM fwd, (VALUES ('level'), ('bps'), ('bps_net')) t(k) WHERE zscore IS NOT NULL AND zscore_fwd IS NOT NULL),
f AS (SELECT k, regr_slope(y, z) AS slope, regr_intercept(y, z) AS base FROM y WHERE window_id = 'w1' GROUP BY k),
t AS (SELECT k, z, base + slope * z AS pred, move FROM y JOIN f USING (k) WHERE window_id = 'w2'),
g AS (SELECT k, CASE WHEN k = 'level' THEN -sign(z - pred) ELSE sign(pred) END * move AS gross FROM t WHERE CASE k WHEN 'level' THEN abs(z - pred) >= 1 WHEN 'bps' THEN abs(pred) >= 1500 ELSE abs(pred) > 0 END)
SELECT k AS target, CAST(count(*) AS BIGINT) AS n, round(avg(gross), 4) AS mean_gross, round(avg(gross - 1500), 4) AS mean_net, round(avg((gross > 1500)::INT), 6) AS win_rate, round(avg(gross - 1500) / nullif(stddev_samp(gross), 0), 6) AS sharpe FROM g GROUP BY k""",
    ),
)
def ml_19(spark, d):
    """Retrained for the later z, for the spread's change, and for the change beyond cost: what each target's trades earn on the second
    run. One pass gives all fits."""
    cost = 1500.0
    sig = pairs.align_forward(pairs.scored(venue.tickers(spark, d)), 1).dropna(subset=["zscore", "zscore_fwd"])
    move = F.col("spread_bps_fwd") - F.col("spread_bps")
    beyond = F.signum(move) * F.greatest(F.abs(move) - cost, F.lit(0.0))
    targets = F.array(*(F.struct(F.lit(n).alias("target"), y.alias("y")) for n, y in (("level", F.col("zscore_fwd")), ("bps", move), ("bps_net", beyond))))
    rows = files.kept(sig.select("window_id", "zscore", move.alias("move"), F.inline(targets)), "targets")
    m = experiments.moments(rows.where("window_id = 'w1'"), ["target"], ["zscore"], "y")
    t = experiments.with_fits(rows.where("window_id = 'w2'"), ["target"], ["zscore"], {g: experiments.ridge(own) for g, own in m.items()})
    fall = F.col("zscore") - F.col("pred")
    level = F.col("target") == "level"
    side = F.when(level, -F.signum(fall)).otherwise(F.signum("pred"))
    taken = F.when(level, F.abs(fall) >= 1).when(F.col("target") == "bps", F.abs("pred") >= cost).otherwise(F.abs("pred") > 0)
    g = t.where(taken).withColumn("gross", side * F.col("move"))
    net = F.col("gross") - cost
    return g.groupBy("target").agg(F.count(F.lit(1)).alias("n"), r(F.avg("gross")).alias("mean_gross"), r(F.avg(net)).alias("mean_net"), r(F.avg((net > 0).cast("int")), 6).alias("win_rate"), r(F.avg(net) / F.nullif(F.stddev_samp("gross"), F.lit(0.0)), 6).alias("sharpe"))
