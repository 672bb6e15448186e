"""Quality classifier: random-indexing word vectors, pooled per document, under a calibrated two-layer network.

Every token has a sparse random index vector that follows from its bucket alone. One pass over all documents adds, for
each token, the index vectors of its neighbours; summed over tasks these are the context vectors. A document's vector
is the mean of its tokens' (length-normalised) context and index vectors. A numpy network with one hidden layer learns
from a bounded sample of labelled documents (``max_labelled``, the first by the hash of their id), and a temperature
fitted on a fifth of that sample calibrates its probabilities. Tokens are lower-cased runs of letters, and runs of
punctuation; marks for digits, capitals and a word said again stand beside them.

Defined cases: null and empty texts have the zero vector and get the network's score for it; repeated rows score
alike, and of an id's different texts the one of least hash is learnt; labels other than 0 and 1, and null ids, teach
nothing; where not both labels meet a document every score is the share of label 1 among those that do, or 0.5 without
any; an empty table gives no rows; extra columns are kept by ``score_quality``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basisweave.llm.common import bucket, first_by_hash, one_blas_thread, one_text, read_table

BUCKETS = 8192
DIM = 48
NONZERO = 4
_CACHE = 120_000
_TOKEN = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[!-/:-@\[-`{-~]+")
_CAPITALS = 1 << 30


def index_vectors(buckets: int = BUCKETS, dim: int = DIM, nonzero: int = NONZERO) -> tuple[np.ndarray, np.ndarray]:
    """(position, sign) of the non-zero entries of each bucket's index vector, from one fixed seed."""
    rng = np.random.default_rng(20240501)
    return rng.integers(0, dim, (buckets, nonzero)), rng.choice([-1.0, 1.0], (buckets, nonzero))


class _Buckets(dict):
    """token -> bucket, with ``_CAPITALS`` added for a word in capitals; filled as tokens come, emptied when large."""

    def __missing__(self, token: bytes) -> int:
        if len(self) > _CACHE:
            self.clear()
        if token[:1].isdigit():
            out = 1
        elif token[:1].isalpha() or token[0] >= 0x80:
            out = 3 + zlib.crc32(token.lower()) % (BUCKETS - 3)
        else:
            out = 3 + zlib.crc32(token[:3]) % (BUCKETS - 3)
        self[token] = out = out + (_CAPITALS if len(token) > 1 and token.isupper() else 0)
        return out


def token_buckets(text: str | None, held: _Buckets) -> np.ndarray:
    """The text's tokens as buckets; 1 stands for digits, and 2 goes before a word in capitals and a word said again."""
    found = _TOKEN.findall((text or "").encode("utf-8", "surrogatepass"))
    if not found:
        return np.zeros(0, np.int64)
    out = np.fromiter(map(held.__getitem__, found), np.int64, len(found))
    marked = out >= _CAPITALS
    out[marked] -= _CAPITALS
    marked[1:] |= out[1:] == out[:-1]
    return np.insert(out, np.flatnonzero(marked), 2) if marked.any() else out


def context_vectors(docs: DataFrame, text_col: str = "text", window: int = 2) -> np.ndarray:
    """(BUCKETS, DIM) context vectors from all rows: each task sums its own, Spark sums the tasks'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_blas_thread()
        position, sign = index_vectors()
        held, total = _Buckets(), np.zeros(BUCKETS * DIM)
        for b in batches:
            # One run of tokens a batch; bucket 0, which no token has, parts the documents.
            parts = [x for t in b.column(0).to_pylist() for x in (token_buckets(t, held), np.zeros(window, np.int64))]
            if not parts:
                continue
            ids = np.concatenate(parts)
            for gap in range(1, window + 1):
                for own, other in ((ids[gap:], ids[:-gap]), (ids[:-gap], ids[gap:])):
                    real = (own > 0) & (other > 0)
                    own, other = own[real], other[real]
                    for k in range(NONZERO):
                        total += np.bincount(own * DIM + position[other, k], sign[other, k], BUCKETS * DIM)
        at = np.flatnonzero(total.reshape(BUCKETS, DIM).any(1)).astype(np.int32)
        rows = total.reshape(BUCKETS, DIM)[at]
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(rows[:, k]) for k in range(DIM))], names=["bucket", *(f"v{k}" for k in range(DIM))])

    schema = "bucket int, " + ", ".join(f"v{k} double" for k in range(DIM))
    summed = docs.select(text_col).mapInArrow(run, schema).groupBy("bucket").agg(*(F.sum(f"v{k}").alias(f"v{k}") for k in range(DIM)))
    got = summed.toArrow()  # BUCKETS rows at most
    out = np.zeros((BUCKETS, DIM))
    if got.num_rows:
        out[got.column(0).to_numpy()] = np.stack([got.column(k + 1).to_numpy() for k in range(DIM)], 1)
    return out


def word_vectors(context: np.ndarray) -> np.ndarray:
    """Unit context vectors beside the index vectors, float32."""
    position, sign = index_vectors()
    own = np.zeros((BUCKETS, DIM))
    for k in range(NONZERO):
        np.add.at(own, (np.arange(BUCKETS), position[:, k]), sign[:, k] / np.sqrt(NONZERO))
    norm = np.linalg.norm(context, axis=1, keepdims=True)
    return np.concatenate((context / np.maximum(norm, 1e-9), own), 1).astype(np.float32)


def pooled(texts: list[str | None], vectors: np.ndarray, held: _Buckets) -> np.ndarray:
    """Mean word vector per text, with the log of its length and its share of distinct tokens."""
    out = np.zeros((len(texts), vectors.shape[1] + 2), np.float32)
    for k, t in enumerate(texts):
        ids = token_buckets(t, held)
        if len(ids):
            kinds, n = np.unique(ids, return_counts=True)
            out[k, :-2] = n @ vectors[kinds] / len(ids)
            out[k, -2:] = np.log1p(len(ids)) / 10, len(kinds) / len(ids)
    return out


@dataclass
class QualityModel:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logits(x) / self.temperature))


def train_network(vectors: np.ndarray, x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, batch: int = 128, rate: float = 3e-3, decay: float = 1e-3, seed: int = 5) -> QualityModel:
    """Two layers by Adam on four fifths of the rows, the temperature on the rest; rows are expected in random order."""
    rng = np.random.default_rng(seed)
    own = np.arange(len(x)) % 5 > 0
    mean, scale = x[own].mean(0), x[own].std(0) + 1e-3
    xs, ys = (x[own] - mean) / scale, y[own]
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    m, v, step = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    for _ in range(epochs):
        order = rng.permutation(len(xs))
        for at in range(0, len(xs), batch):
            xb, yb = xs[order[at : at + batch]], ys[order[at : at + batch]]
            h = np.tanh(xb @ p[0] + p[1])
            d = (1 / (1 + np.exp(-(h @ p[2] + p[3]))) - yb) / len(xb)
            dh = d[:, None] * p[2] * (1 - h * h)
            grads = [xb.T @ dh + decay * p[0], dh.sum(0), h.T @ d + decay * p[2], np.array([d.sum()])]
            step += 1
            for q, g, a, b in zip(p, grads, m, v):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                q -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    model = QualityModel(vectors, mean, scale, *(q.astype(np.float32) for q in p[:3]), float(p[3][0]), 1.0)
    held = x[~own] if (~own).any() else x[own]
    truth = y[~own] if (~own).any() else y[own]
    z = model.logits(held)
    grid = np.geomspace(0.25, 8, 61)
    model.temperature = float(grid[np.argmin([np.mean(np.logaddexp(0, z / t) - truth * z / t) for t in grid])])
    return model


def fit_quality(docs: DataFrame, learnable_docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = 12_000) -> QualityModel:
    """Word vectors from all of ``docs``; the network from ``labels`` (id, quality) and the rows of ``learnable_docs``."""
    vectors = word_vectors(context_vectors(docs, text_col))
    known = labels.where("quality in (0, 1)").select(F.col(id_col).alias("id"), F.col("quality").cast("int").alias("quality"))
    # Both labels get half of the sample, so that a rare one is learnt; a prior shift puts the odds back.
    share = {r[0]: r[1] for r in known.groupBy("quality").count().collect()}
    parts = [first_by_hash(known.where(F.col("quality") == q), max_labelled // 2).withColumn("quality", F.lit(q)) for q in (0, 1)]
    chosen = one_text(learnable_docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(parts[0].unionByName(parts[1])), "id"), "id", "quality")
    shipped = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Buckets()
        for b in batches:
            x = pooled(b.column("text").to_pylist(), shipped.value, held)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("quality"), pa.array(list(x), pa.list_(pa.float32()))], names=["id", "quality", "x"])

    schema = T.StructType([chosen.schema["id"], T.StructField("quality", T.IntegerType()), T.StructField("x", T.ArrayType(T.FloatType()))])
    rows = chosen.mapInArrow(run, schema).orderBy(F.xxhash64("id"), "id", "quality").toArrow()
    x, y = np.array(rows.column("x").to_pylist(), np.float32), rows.column("quality").to_numpy().astype(np.float64)
    if not 0 < y.sum() < len(y):  # only labels that met a document teach
        rate = y.mean() if len(y) else 0.5
        z = np.zeros(vectors.shape[1] + 2)
        return QualityModel(vectors, z, z + 1, np.zeros((len(z), 1)), np.zeros(1), np.zeros(1), float(np.log((rate + 1e-9) / (1 - rate + 1e-9))), 1.0)
    model = train_network(vectors, x, y)
    sampled = y.mean()
    true = share[1] / (share[0] + share[1])
    model.b2 += model.temperature * float(np.log(true / (1 - true)) - np.log(sampled / (1 - sampled)))
    return model


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", keep: list[str] | None = None, out: str = "score") -> DataFrame:
    """``docs`` (or its ``keep`` columns) with the calibrated probability of label 1."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != out]
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField(out, T.DoubleType())])
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_blas_thread()
        model, held = shipped.value, _Buckets()
        for b in batches:
            p = model.probability(pooled(b.column(text_col).to_pylist(), model.vectors, held))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(p.astype(np.float64))], names=[*keep, out])

    return docs.select(*dict.fromkeys([*keep, text_col])).mapInArrow(run, schema)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    learnable = bucket(F.col("doc_id"), 3) != 1
    model = fit_quality(docs, docs.where(learnable), read_table(spark, sf_dir, "labels").where(learnable))
    out = score_quality(docs, model, keep=["doc_id"])
    return out.select("doc_id", (bucket(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
