"""Hard negatives by vertical scans: each anchor's positives, and per positive the best rows of other labels in a score window.

Vectors are quantised to whole numbers, so scores are exact. Rows and anchors are dealt into blocks, and every block of
anchors meets every block of rows in a task of its own. A block of rows lies there by dimension. An anchor reads the
dimensions in the descending order of its own magnitudes, a few at a time; after each read the least and the most that
the unread dimensions can add (from the block's minimum and maximum of each) bound every candidate's score. A positive
candidate goes when the bounds of enough others lie above its own; a negative one when its bounds miss all of
the anchor's windows, or enough others certainly lie in a window above it. What is left when all dimensions are read has
its exact score. Tasks return a few rows an anchor; the overall first ones are ranked natively.

Defined cases: rows with a null id, label or vector, or a null or non-finite component, take no part; of rows that repeat an
id the one of least label and vector does; vectors of another length than the anchor's are no candidates of it; equal
scores go by the smaller id; an anchor without positives, and a positive without rows in its window (a negative score
has an empty one), have no rows; an empty table gives no rows; extra columns are ignored. Scores beyond 64 bits are
refused by an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basisweave.llm.common import read_table, written

#: Dimensions read before the first bounds, and the factor by which further reads grow.
_FIRST, _GROWTH = 8, 2
_EXACT = 2.0**53


def quantised(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None, scale: float = 256.0) -> DataFrame:
    """(id, label, q): rows that take part, one an id, with ``q`` the whole-number components."""
    label = F.col("label") if label is None else label
    named = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    clean = named.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).where(finite)
    whole = clean.select("id", "label", F.transform("v", lambda x: F.floor(x * scale)).alias("q"))
    one = F.min(F.struct("label", "q"))
    return whole.groupBy("id").agg(one.alias("r")).select("id", "r.label", "r.q")


def _order(score: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Places by descending score, then row."""
    if score.dtype == object:
        return np.array(sorted(range(len(rows)), key=lambda k: (-score[k], rows[k])), np.int64)
    return np.lexsort((rows, -score))


class Block:
    """Rows by dimension, with each dimension's least and greatest value. Floats hold whole numbers exactly up to 2^53."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids)
        self.ids, self.labels = ids[order], labels[order]
        self.columns = np.ascontiguousarray(vectors[order].T)
        self.low, self.high = self.columns.min(1), self.columns.max(1)

    def reads(self, anchor: np.ndarray):
        """(dimensions of each read, least and most that the dimensions after it can add)."""
        order = np.argsort(-np.abs(anchor), kind="stable")
        least = np.minimum(anchor * self.low, anchor * self.high)[order]
        most = np.maximum(anchor * self.low, anchor * self.high)[order]
        at, step = 0, _FIRST
        while at < len(order):
            stop = min(len(order), at + step)
            yield order[at:stop], least[stop:].sum(), most[stop:].sum()
            at, step = stop, step * _GROWTH

    def best(self, anchor: np.ndarray, own: int, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The first ``k`` of ``rows`` other than id ``own``, by score and id: (places, scores)."""
        rows = rows[self.ids[rows] != own]
        score = np.zeros(len(rows), anchor.dtype)
        for dims, least, most in self.reads(anchor):
            score += anchor[dims] @ self.columns[np.ix_(dims, rows)]
            if len(rows) > k:
                bar = np.partition(score, len(score) - k)[len(score) - k] + least
                stays = score + most >= bar
                rows, score = rows[stays], score[stays]
        first = _order(score, rows)[:k]
        return rows[first], score[first]

    def in_windows(self, anchor: np.ndarray, rows: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each (low, high) the first ``k`` of ``rows`` with a score in it."""
        score = np.zeros(len(rows), anchor.dtype)
        for dims, least, most in self.reads(anchor):
            score += anchor[dims] @ self.columns[np.ix_(dims, rows)]
            stays = np.zeros(len(rows), bool)
            for low, high in windows:
                may = (score + most >= low) & (score + least <= high)
                sure = score[(score + least >= low) & (score + most <= high)]
                if len(sure) > k:  # k others certainly stand above a row whose most is below their least
                    may &= score + most >= np.partition(sure, len(sure) - k)[len(sure) - k] + least
                stays |= may
            rows, score = rows[stays], score[stays]
        out = []
        for low, high in windows:
            at = np.flatnonzero((score >= low) & (score <= high))
            at = at[_order(score[at], rows[at])[:k]]
            out.append((rows[at], score[at]))
        return out


def _matrix(table: pa.Table) -> np.ndarray:
    """The vectors of a group, all of one length."""
    flat = table.column("q").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(table.num_rows, -1) if table.num_rows else np.zeros((0, 0), np.int64)


def _exact(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as doubles if every partial score stays exact, else as Python's whole numbers."""
    most = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * max(1, a.shape[1])
    kind = np.float64 if most < _EXACT else object
    return a.astype(kind), b.astype(kind)


def _blocked(rows: DataFrame, anchors: DataFrame, block_rows: int, block_anchors: int):
    """Rows and anchors with ``cell``, the number of a pair of blocks: every anchor block meets every row block in one cell."""
    n, m = rows.count(), anchors.count()
    across, down = max(1, -(-n // block_rows)), max(1, -(-m // block_anchors))
    own = lambda salt, k: F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(k))
    r = rows.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(down - 1)))).withColumn("cell", F.col("cell") * across + own(1, across))
    a = anchors.select(*(F.col(c).alias(c) for c in anchors.columns)).withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(across - 1)))).withColumn("cell", own(2, down) * across + F.col("cell"))
    length = F.size("q").alias("length")
    return r.select("cell", length, "id", "label", "q"), a.select("cell", length, *anchors.columns)


def _ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    by = Window.partitionBy(*keys).orderBy(F.desc("score"), "found_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def positives(rows: DataFrame, anchors: DataFrame, k: int = 5, block_rows: int = 8192, block_anchors: int = 4096) -> DataFrame:
    """(anchor_id, positive_id, positive_score): each anchor's first ``k`` other rows of its label. Inputs as of ``quantised``."""

    def scan(right: pa.Table, left: pa.Table) -> pa.Table:
        a, r = _exact(_matrix(left), _matrix(right))
        out: list[tuple[int, int, int]] = []
        if left.num_rows and right.num_rows:
            block = Block(right.column("id").to_numpy(), right.column("label").to_numpy(), r)
            by_label = {v: np.flatnonzero(block.labels == v) for v in np.unique(block.labels).tolist()}
            none = np.zeros(0, np.int64)
            for own, label, q in zip(left.column("id").to_pylist(), left.column("label").to_pylist(), a):
                at, scores = block.best(q, own, by_label.get(label, none), k)
                out += [(own, int(block.ids[p]), int(s)) for p, s in zip(at, scores)]
        return pa.table([pa.array([x[j] for x in out], pa.int64()) for j in range(3)], names=["anchor_id", "found_id", "score"])

    r, a = _blocked(rows, anchors, block_rows, block_anchors)
    found = r.groupBy("cell", "length").cogroup(a.groupBy("cell", "length")).applyInArrow(scan, "anchor_id long, found_id long, score long")
    return _ranked(found, ["anchor_id"], k).select("anchor_id", F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"))


def negatives(rows: DataFrame, anchors: DataFrame, pairs: DataFrame, k: int = 10, scale: int = 100, low: int = 30, high: int = 90, block_rows: int = 8192, block_anchors: int = 4096) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): per pair of ``positives`` the first ``k`` rows of
    another label with low * positive_score <= scale * score <= high * positive_score."""
    held = pairs.groupBy(F.col("anchor_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct(F.col("positive_id").alias("p"), F.col("positive_score").alias("s")))).alias("positives"))
    wanted = anchors.join(held, "id")

    def scan(right: pa.Table, left: pa.Table) -> pa.Table:
        a, r = _exact(_matrix(left), _matrix(right))
        out: list[tuple[int, int, int, int, int]] = []
        if left.num_rows and right.num_rows:
            block = Block(right.column("id").to_numpy(), right.column("label").to_numpy(), r)
            other = {v: np.flatnonzero(block.labels != v) for v in set(left.column("label").to_pylist())}
            for own, label, q, ps in zip(left.column("id").to_pylist(), left.column("label").to_pylist(), a, left.column("positives").to_pylist()):
                # Whole numbers of the window's ends: the least score not below and the greatest not above.
                windows = [(-(-low * p["s"] // scale), high * p["s"] // scale) for p in ps]
                for p, (at, scores) in zip(ps, block.in_windows(q, other[label], windows, k)):
                    out += [(own, p["p"], p["s"], int(block.ids[n]), int(s)) for n, s in zip(at, scores)]
        names = ["anchor_id", "positive_id", "positive_score", "found_id", "score"]
        return pa.table([pa.array([x[j] for x in out], pa.int64()) for j in range(5)], names=names)

    r, a = _blocked(rows, wanted, block_rows, block_anchors)
    found = r.groupBy("cell", "length").cogroup(a.groupBy("cell", "length")).applyInArrow(scan, "anchor_id long, positive_id long, positive_score long, found_id long, score long")
    best = _ranked(found, ["anchor_id", "positive_id"], k)
    return best.select("anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = written(quantised(read_table(spark, sf_dir, "embeddings"), label=label), "negatives-rows")
    anchors = rows.where(F.col("id") % 100 == 0)
    pairs = written(positives(rows, anchors), "negatives-positives")
    return negatives(rows, anchors, pairs)


OP11_SQL = """WITH c AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
d AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY label, q) AS k FROM c), r AS (SELECT vec_id, label, q FROM d WHERE k = 1),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM r a JOIN r b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS k FROM s WHERE same) WHERE k <= 5),
n AS (SELECT p.*, other_id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS rank FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""
