"""Live trading state as queries: a trader, resting orders, two-feed pairing and feed stalls on keyed state with timers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basisweave.functions import exprs as x
from basisweave.operators import pairs
from basisweave.operators.series import KEYS
from basisweave.plans.catalog import query, r
from basisweave.plans.sql import over
from basisweave.sources import venue
from basisweave.streaming import stateful

_DELAY = 3_600_000
_GAP = 4 * 3_600_000
_WAIT = 7_200_000


def _waves(rows: DataFrame, delay_ms: int, waves: int = 3) -> tuple[DataFrame, Column]:
    """Waves of time, in which a third of the rows lands up to half the delay after its time."""
    lo, hi = rows.agg(F.min("at_ms"), F.max("at_ms")).first()
    span = ((hi or 0) - (lo or 0) + delay_ms) // waves + 1
    late = F.when(F.pmod(F.xxhash64("at_ms"), F.lit(3)) == 0, delay_ms // 2).otherwise(0)
    return rows, F.floor((F.col("at_ms") - F.lit(lo or 0) + late) / span).cast("int")


_TRADER = """WITH zb AS (SELECT window_id, coin, pair, snapshot_idx AS t, spread_bps AS s, zscore, stddev_samp(spread_bps) OVER (PARTITION BY window_id, coin, pair ORDER BY snapshot_idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS sd,
  row_number() OVER (PARTITION BY window_id, coin, pair ORDER BY snapshot_idx) AS k FROM z WHERE snapshot_idx <= (SELECT max(snapshot_idx) - 2 FROM z)),
f AS (SELECT DISTINCT window_id, coin, pair, 0::BIGINT AS k, 0 AS d, 0 AS t0, 0.0::DOUBLE AS s0, -1000000 AS free, 0.0::DOUBLE AS last, NULL::INTEGER AS entry, NULL::INTEGER AS exit, NULL::INTEGER AS way, NULL::DOUBLE AS s_in, NULL::DOUBLE AS s_out, NULL::VARCHAR AS reason FROM zb
UNION ALL SELECT w, c, p, k, CASE WHEN leave THEN 0 WHEN enter THEN CASE WHEN zscore > 0 THEN -1 ELSE 1 END ELSE d1 END, CASE WHEN enter THEN t ELSE t0 END, CASE WHEN enter THEN s ELSE s0 END, CASE WHEN leave THEN t + 3 ELSE free1 END, s,
  CASE WHEN stale OR leave THEN t0 END, CASE WHEN stale THEN t0 + 12 WHEN leave THEN t END, CASE WHEN stale OR leave THEN d END, CASE WHEN stale OR leave THEN s0 END, CASE WHEN stale THEN last WHEN leave THEN s END, CASE WHEN stale THEN 'timeout' WHEN leave THEN CASE WHEN back THEN 'signal' ELSE 'timeout' END END
  FROM (SELECT *, d1 <> 0 AND (back OR t = t0 + 12) AS leave, d1 = 0 AND known AND abs(zscore) >= 1.5 AND sd >= 1500 AND t >= free1 AS enter
    FROM (SELECT *, d1 <> 0 AND known AND CASE WHEN d1 = 1 THEN zscore >= -0.5 ELSE zscore <= 0.5 END AS back
      FROM (SELECT f.window_id AS w, f.coin AS c, f.pair AS p, b.k, b.t, b.s, b.zscore, b.sd, f.d, f.t0, f.s0, f.last, f.d <> 0 AND b.t > f.t0 + 12 AS stale, CASE WHEN f.d <> 0 AND b.t > f.t0 + 12 THEN 0 ELSE f.d END AS d1,
        CASE WHEN f.d <> 0 AND b.t > f.t0 + 12 THEN f.t0 + 15 ELSE f.free END AS free1, b.zscore IS NOT NULL AND b.k >= 10 AS known
        FROM f JOIN zb b ON b.window_id = f.window_id AND b.coin = f.coin AND b.pair = f.pair AND b.k = f.k + 1)))),
a AS (SELECT window_id, coin, pair, entry, exit, way, s_in, s_out, reason FROM f WHERE exit IS NOT NULL
  UNION ALL SELECT window_id, coin, pair, t0, t0 + 12, d, s0, last, 'timeout' FROM (SELECT *, row_number() OVER (PARTITION BY window_id, coin, pair ORDER BY k DESC) AS rk FROM f) WHERE rk = 1 AND d <> 0 AND t0 + 12 <= (SELECT max(snapshot_idx) - 2 FROM z))
SELECT window_id, coin, pair, CAST(entry AS BIGINT) AS entry, CAST(exit AS BIGINT) AS exit, way AS direction, reason, round(way * (s_out - s_in), 4) AS gross_bps FROM a"""


@query("str_09_stream_trader", over("z", _TRADER).replace("WITH ", "WITH RECURSIVE ", 1))
def str_09(spark, d):
    """Warm-up of ten rows, volatility gate, cooldown of two steps, exits by signal and, by timer, after twelve steps."""
    bucket = venue.bucket_of(spark, d)
    spreads = pairs.spread_series(venue.tickers(spark, d)).where("spread_bps is not null")
    at_ms = (F.lit(venue.EPOCH).cast("long") + F.col("snapshot_idx").cast("long") * bucket) * 1000
    rows = spreads.select(*KEYS, at_ms.alias("at_ms"), F.col("snapshot_idx").cast("long").alias("t"), F.col("spread_bps").alias("s"))
    rule = stateful.Trader(venue.EPOCH * 1000, bucket * 1000, min_std=1500.0)
    delay = 2 * bucket * 1000
    rows, wave = _waves(rows, delay)
    t = stateful.replayed(rows, wave, list(KEYS), rule, delay)
    return t.select(*KEYS, "entry", "exit", "direction", "reason", r(F.col("direction") * (F.col("exit_spread") - F.col("entry_spread"))).alias("gross_bps"))


@query(
    "str_10_stream_fill_tracker",
    over(
        "tick",
        """WITH m AS (SELECT *, epoch_us(ts) // 1000 AS ms FROM tick WHERE exchange IN ('click', 'view')), c AS (SELECT max(ms) - 3600000 AS cut FROM m),
o AS (SELECT event_id AS order_id, coin, ms AS placed, side, mid * CASE WHEN side = 'buy' THEN 0.99 ELSE 1.01 END AS price FROM m, c WHERE exchange = 'click' AND ms <= cut),
f AS (SELECT order_id, min(m.ms) AS hit FROM o JOIN m ON m.coin = o.coin AND m.exchange = 'view' AND m.ms > placed AND m.ms <= placed + 7200000 AND CASE WHEN o.side = 'buy' THEN m.mid <= price ELSE m.mid >= price END, c WHERE m.ms <= cut GROUP BY 1)
SELECT coin, side, order_id, hit IS NOT NULL AS filled, hit - placed AS wait_ms FROM o LEFT JOIN f USING (order_id), c WHERE hit IS NOT NULL OR placed + 7200000 <= cut""",
    ),
)
def str_10(spark, d):
    """Every click tick rests an order 1 % away; view ticks fill it within two hours, or a timer gives it up."""
    t = venue.ticks(spark, d).where("exchange in ('click', 'view')").withColumn("at_ms", F.unix_millis("ts"))
    limit = F.col("mid") * F.when(F.col("side") == "buy", 0.99).otherwise(1.01)
    orders = t.where("exchange = 'click'").select("coin", "side", "at_ms", F.col("event_id").alias("order_id"), limit.alias("price"))
    prices = t.where("exchange = 'view'").select("coin", F.explode(F.array(F.lit("buy"), F.lit("sell"))).alias("side"), "at_ms", F.lit(None).cast("long").alias("order_id"), F.col("mid").alias("price"))
    rows, wave = _waves(orders.unionByName(prices), _DELAY)
    f = stateful.replayed(rows, wave, ["coin", "side"], stateful.Fills(_WAIT), _DELAY)
    return f.select("coin", "side", "order_id", F.col("filled_ms").isNotNull().alias("filled"), (F.col("filled_ms") - F.col("placed_ms")).alias("wait_ms"))


@query(
    "str_08_stream_tick_pairing",
    over(
        "tick",
        """WITH p AS (SELECT a, b, a || '__' || b AS pair FROM (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view')) x(a), (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view')) y(b) WHERE a < b),
t AS (SELECT event_id, coin, pair, ts, last_value(CASE WHEN exchange = a THEN mid END IGNORE NULLS) OVER w AS ma, last_value(CASE WHEN exchange = b THEN mid END IGNORE NULLS) OVER w AS mb,
  last_value(CASE WHEN exchange = a THEN sec END IGNORE NULLS) OVER w AS sa, last_value(CASE WHEN exchange = b THEN sec END IGNORE NULLS) OVER w AS sb, sec FROM tick JOIN p ON exchange = a OR exchange = b
  WINDOW w AS (PARTITION BY coin, pair ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT event_id, coin, pair, round((mb - ma) / ma * 1e4, 4) AS spread_bps, sec - least(sa, sb) <= 3600 AS fresh FROM t WHERE ma IS NOT NULL AND mb IS NOT NULL AND epoch_us(ts) // 1000 <= (SELECT epoch_us(max(ts)) // 1000 - 3600000 FROM tick)""",
    ),
)
def str_08(spark, d):
    """Every pair of venues of a coin is a key of its own: the two last prices at each tick of either venue."""
    both = F.array(*(F.struct(F.lit(f"{a}__{b}").alias("pair"), F.lit(a).alias("a"), F.lit(b).alias("b")) for a in venue.VENUES for b in venue.VENUES if a < b))
    met = venue.ticks(spark, d).withColumn("p", F.explode(F.filter(both, lambda p: (p["a"] == F.col("exchange")) | (p["b"] == F.col("exchange")))))
    rows = met.select("coin", "p.pair", F.unix_millis("ts").alias("at_ms"), F.unix_micros("ts").alias("us"), "event_id", (F.col("exchange") == F.col("p.b")).alias("second"), "mid")
    rows, wave = _waves(rows, _DELAY)
    p = stateful.replayed(rows, wave, ["coin", "pair"], stateful.Pairing(), _DELAY)
    return p.select("event_id", "coin", "pair", r(x.spread_bps(F.col("mid_a"), F.col("mid_b"), "relative")).alias("spread_bps"), (F.col("age") <= 3600).alias("fresh"))


@query(
    "str_14_feed_stalls",
    over(
        "tick",
        """WITH c AS (SELECT epoch_us(max(ts)) // 1000 - 3600000 AS cut FROM tick), t AS (SELECT coin, exchange, epoch_us(ts) // 1000 AS ms, cut FROM tick, c WHERE epoch_us(ts) // 1000 <= cut),
g AS (SELECT *, coalesce(lead(ms) OVER (PARTITION BY coin, exchange ORDER BY ms), cut) - ms AS silence FROM t)
SELECT coin, exchange, ms AS last_ms, ms + 14400000 AS raised_ms FROM g WHERE silence > 14400000""",
    ),
)
def str_14(spark, d):
    """A feed of no tick for four hours is reported when the four hours are over, by a timer, not when the next tick comes."""
    rows = venue.ticks(spark, d).select("coin", "exchange", F.unix_millis("ts").alias("at_ms"), F.lit(1).cast("long").alias("n"))
    rows, wave = _waves(rows, _DELAY)
    return stateful.replayed(rows, wave, ["coin", "exchange"], stateful.Stalls(_GAP), _DELAY).select("coin", "exchange", "last_ms", "raised_ms")


@query(
    "str_07_archive_and_replay",
    over(
        "tick",
        """WITH m AS (SELECT coin, exchange, epoch_us(ts) // 1000 AS ms FROM tick), b AS (SELECT min(ms) AS lo, max(ms) AS hi FROM m),
g AS (SELECT 1 AS gen, * FROM m UNION ALL SELECT 0, m.* FROM m, b WHERE (ms - lo) // ((hi - lo) // 3 + 1) < 2), c AS (SELECT gen, max(ms) - 3600000 AS cut FROM g GROUP BY gen),
t AS (SELECT g.*, cut FROM g JOIN c USING (gen) WHERE ms <= cut),
s AS (SELECT gen, coin, exchange, ms AS last_ms FROM (SELECT *, coalesce(lead(ms) OVER (PARTITION BY gen, coin, exchange ORDER BY ms), cut) - ms AS silence FROM t) WHERE silence > 14400000)
SELECT coin, exchange, last_ms, bool_or(gen = 0) AS archived FROM s GROUP BY coin, exchange, last_ms HAVING bool_or(gen = 1)""",
    ),
)
def str_07(spark, d):
    """The stall watch is restarted from zero after two of three waves: what it reports now, and whether the archive has it too.
    Rows are told apart by what they are about, so a replay adds none twice."""
    rows = venue.ticks(spark, d).select("coin", "exchange", F.unix_millis("ts").alias("at_ms"), F.lit(1).cast("long").alias("n"))
    lo, hi = rows.agg(F.min("at_ms"), F.max("at_ms")).first()
    wave = F.floor((F.col("at_ms") - F.lit(lo or 0)) / (((hi or 0) - (lo or 0)) // 3 + 1)).cast("int")
    out = stateful.replayed(rows, wave, ["coin", "exchange"], stateful.Stalls(_GAP), _DELAY, anew_after=2)
    return out.groupBy("coin", "exchange", "last_ms").agg(F.bool_or(F.col("generation") == 0).alias("archived"), F.bool_or(F.col("generation") == 1).alias("_now")).where("_now").drop("_now")
