"""DuckDB text of the shared views, so that each query's SQL states only what is its own."""

from __future__ import annotations

#: The snapshot length in seconds.
BUCKET = "(SELECT greatest(1, 144000000 // greatest(count(*), 10000)) FROM events)"

BASE = {
    "tick": """SELECT event_id, ts, event_type AS exchange, 'C' || CAST(user_id % 3 AS VARCHAR) AS coin, 100 + value AS mid, value AS volume,
  CASE WHEN event_id % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, CAST(floor(epoch(ts)) AS BIGINT) AS sec,
  CAST(floor((floor(epoch(ts)) - 1704067200) / """ + BUCKET + """) AS INTEGER) AS snapshot_idx FROM events""",
    "cell": """SELECT coin, exchange, snapshot_idx, arg_max(mid, (ts, event_id)) AS mid, arg_max(event_id, (ts, event_id)) AS last_id, max(ts) AS ts,
  count(*) AS n_ticks, sum(volume) AS base_volume FROM tick GROUP BY ALL""",
    "ticker": """SELECT *, mid - mid * (1 + last_id % 5) / 20000 AS bid, mid + mid * (1 + last_id % 5) / 20000 AS ask,
  CAST(100 + last_id % 37 AS DOUBLE) AS bid_volume, CAST(100 + last_id % 53 AS DOUBLE) AS ask_volume,
  (CAST(100 + last_id % 37 AS DOUBLE) - (100 + last_id % 53)) / (200 + last_id % 37 + last_id % 53) AS imbalance,
  (last_id % 21 - 10) / 10000 AS funding_rate, CAST(1000 + last_id % 997 AS DOUBLE) AS open_interest,
  CASE WHEN snapshot_idx * """ + BUCKET + """ < 1209600 THEN 'w1' ELSE 'w2' END AS window_id FROM cell""",
    "candle": """SELECT coin, exchange, snapshot_idx, arg_min(mid, (ts, event_id)) AS open, max(mid) AS high, min(mid) AS low,
  arg_max(mid, (ts, event_id)) AS close, sum(volume) AS volume FROM tick GROUP BY ALL""",
    "pair": """SELECT a.coin, a.window_id, a.snapshot_idx, a.exchange AS exchange_a, b.exchange AS exchange_b, a.exchange || '__' || b.exchange AS pair,
  a.mid AS mid_a, b.mid AS mid_b, a.bid AS bid_a, b.bid AS bid_b, a.ask AS ask_a, b.ask AS ask_b, a.base_volume AS vol_a, b.base_volume AS vol_b, a.ts AS ts_a, b.ts AS ts_b,
  (a.mid - b.mid) / ((a.mid + b.mid) / 2) * 1e4 AS spread_bps
  FROM ticker a JOIN ticker b ON a.coin = b.coin AND a.snapshot_idx = b.snapshot_idx AND a.exchange < b.exchange""",
    "z": """SELECT *, CASE WHEN count(spread_bps) OVER f >= 6 AND stddev_samp(spread_bps) OVER f > 0
  THEN (spread_bps - avg(spread_bps) OVER f) / stddev_samp(spread_bps) OVER f END AS zscore FROM pair
  WINDOW f AS (PARTITION BY window_id, coin, pair ORDER BY snapshot_idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
    "sig": """SELECT *, 0.6 * zscore + 0.2 * zscore_lag1 AS pred FROM (SELECT *, lag(zscore, 1) OVER s AS zscore_lag1, lag(zscore, 2) OVER s AS zscore_lag2,
  lag(zscore, 3) OVER s AS zscore_lag3, lead(zscore, 1) OVER s AS target FROM z WINDOW s AS (PARTITION BY window_id, coin, pair ORDER BY snapshot_idx))""",
    "fwd": """SELECT s.*, n.zscore AS zscore_fwd, n.spread_bps AS spread_bps_fwd FROM sig s JOIN sig n
  ON s.window_id = n.window_id AND s.coin = n.coin AND s.pair = n.pair AND n.snapshot_idx = s.snapshot_idx + 1""",
    "fee": "SELECT * FROM (VALUES ('click', 4.0::DOUBLE), ('error', 5.0::DOUBLE), ('purchase', 6.0::DOUBLE), ('signup', 7.5::DOUBLE), ('view', 10.0::DOUBLE)) AS t(exchange, taker_bps)",
    "bet": """SELECT *, CAST(sign(zscore) AS INTEGER) AS direction, sign(zscore) * zscore_fwd AS pnl_proxy, spread_bps_fwd - spread_bps AS spread_delta_bps,
  sign(zscore) * (spread_bps_fwd - spread_bps) AS gross_bps, abs(pred) AS abs_pred,
  CASE WHEN zscore_fwd <> 0 AND sign(zscore_fwd) = sign(zscore) THEN 1 ELSE 0 END AS dir_hit FROM fwd WHERE pred IS NOT NULL AND zscore_fwd IS NOT NULL""",
    "book": """SELECT l_orderkey AS book, list({'price': price, 'line': l_linenumber, 'qty': qty} ORDER BY price, l_linenumber) AS asks FROM
  (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS qty, round(CAST(l_extendedprice AS DOUBLE) / CAST(l_quantity AS DOUBLE), 8) AS price FROM lineitem) GROUP BY l_orderkey""",
}
NEEDS = {"tick": (), "cell": ("tick",), "ticker": ("cell",), "candle": ("tick",), "pair": ("ticker",), "z": ("pair",), "sig": ("z",), "fwd": ("sig",), "fee": (), "bet": ("fwd",), "book": ()}


def over(view: str, body: str, *more: str) -> str:
    """``body`` with the named views, and what they need, in front of it."""
    names: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS[name]:
            add(n)
        if name not in names:
            names.append(name)

    for v in (view, *more):
        add(v)
    own = ""
    body = body.strip()
    if body[:5].upper() == "WITH ":
        cut = body[5:]
        return "WITH " + ", ".join(f"{n} AS ({BASE[n]})" for n in names) + ", " + cut
    return "WITH " + ", ".join(f"{n} AS ({BASE[n]})" for n in names) + own + " " + body
