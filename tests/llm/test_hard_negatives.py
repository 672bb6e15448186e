import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from basisweave.llm.hard_negatives import OP11_SQL, Block, negatives, op11_hard_negatives, positives, quantised

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=5, m=10):
    """rows: {id: (label, whole-number vector)}."""
    out = []
    for a, (label, q) in rows.items():
        if a % 100:
            continue
        score = {b: sum(x * y for x, y in zip(q, v)) for b, (_, v) in rows.items() if b != a and len(v) == len(q)}
        for p in sorted((b for b in score if rows[b][0] == label), key=lambda b: (-score[b], b))[:k]:
            inside = [b for b in score if rows[b][0] != label and 30 * score[p] <= 100 * score[b] <= 90 * score[p]]
            out += [(a, p, n, b, score[p], score[b]) for n, b in enumerate(sorted(inside, key=lambda b: (-score[b], b))[:m], 1)]
    return sorted(out)


def table(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("id", "q", "cell", "score", "length")}).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def test_query_on_odd_rows(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k, [rng.uniform(-1, 1) for _ in range(12)], rng.randrange(4)) for k in range(420)]
    rows += [(1000 + k, [0.5] * 12, 2) for k in range(60)]  # ties
    rows += [(1500, [0.5] * 12, 1), (1600, [0.5] * 7, 1), (1601, [0.25] * 7, 1), (1602, [0.2] * 7, 3), (1700, [], 1), (1701, [], 2), (1702, [], 1)]
    rows += [(None, [0.1] * 12, 1), (1800, None, 1), (1801, [0.1] * 12, None), (1802, [0.1, None] * 6, 1), (1803, [float("nan")] * 12, 1), (1804, [float("inf")] * 12, 1)]
    rows += [(100, rows[100][1], rows[100][2])] * 2 + [(200, [0.9] * 12, 9)]  # repeated rows, and one that repeats an id alone
    held = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        own = (label, [int(np.floor(256 * float(np.float32(x)))) for x in v])
        held[i] = min(held.get(i, own), own)
    got = op11_hard_negatives(spark, table(spark, tmp_path, rows))
    assert sorted(map(tuple, got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())) == brute(held)
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert sorted(db.sql(f"SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ({OP11_SQL})").fetchall()) == brute(held)


def test_blocks_do_not_change_the_result(spark):
    rng = np.random.default_rng(4)
    rows = quantised(spark.createDataFrame([(k, rng.normal(size=16).tolist(), int(rng.integers(0, 3))) for k in range(700)], SCHEMA)).cache()
    anchors = rows.where("id % 50 = 0")
    whole = positives(rows, anchors)
    parts = positives(rows, anchors, block_rows=90, block_anchors=4)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))
    a, b = negatives(rows, anchors, whole), negatives(rows, anchors, whole, block_rows=64, block_anchors=3)
    assert a.count() > 300 and sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_bounds_drop_rows_and_lose_none():
    rng = np.random.default_rng(5)
    x = rng.integers(-50, 50, (3000, 40)).astype(float)
    x[:, 4:] = np.round(x[:, 4:] / 25)  # most of the magnitude lies in few dimensions
    block = Block(np.arange(3000), np.zeros(3000, np.int64), x)
    seen = []

    class Counted(Block):
        def reads(self, anchor):
            for r in super().reads(anchor):
                seen.append(r)
                yield r

    score = x @ x[7]
    want = sorted((k for k in range(3000) if k != 7), key=lambda k: (-score[k], k))[:5]
    assert block.best(x[7], 7, np.arange(3000), 5)[0].tolist() == want
    top = int(score[want[0]])
    [(rows, scores)] = block.in_windows(x[7], np.arange(3000), [(top // 4, top // 2)], 10)
    inside = sorted((k for k in range(3000) if top // 4 <= score[k] <= top // 2), key=lambda k: (-score[k], k))[:10]
    assert rows.tolist() == inside and scores.tolist() == [score[k] for k in inside]


def test_large_components_stay_exact(spark):
    big = float(2**40)
    rows = quantised(spark.createDataFrame([(0, [big, 1.0], 1), (1, [0.0, 1.0], 1), (2, [0.0, 0.5], 2), (3, [1e-2, 0.0], 2)], "vec_id long, embedding array<double>, label int"))
    pairs = positives(rows, rows.where("id = 0"))
    assert [tuple(r) for r in pairs.collect()] == [(0, 1, 256 * 256)]
    beyond = quantised(spark.createDataFrame([(0, [big], 1), (1, [big], 1)], "vec_id long, embedding array<double>, label int"))
    with pytest.raises(Exception, match="int64|too large|too big"):
        positives(beyond, beyond.where("id = 0")).collect()


def test_empty_table(spark, tmp_path):
    assert op11_hard_negatives(spark, table(spark, tmp_path, [])).count() == 0
