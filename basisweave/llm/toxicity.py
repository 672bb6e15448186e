"""Toxicity: non-negative positive-unlabelled learning over hashed word and character-gram features.

Confirmed toxic documents are the positives; any other text is unlabelled and holds an unknown toxic share, the class
prior, which is estimated from these two samples alone: labels of clean documents are not used. Features that positives have far more often than unlabelled texts are selected from document frequencies
counted in Spark, and numpy logistic classifiers minimise the class-prior-corrected risk: the positives' share of the
unlabelled loss is subtracted, and where that would go below zero the step is reversed, so that the classifiers don't
overfit to "unlabelled means clean". The classifiers' mean is the score.

The learning sample is bounded by ``max_positive`` and ``max_unlabelled`` documents, the first by the hash of their
id; scoring covers whole texts of all rows.

Defined cases: null and empty texts have no features and score the bias alone; repeated rows score alike, and of an id's different texts the one
of least hash is learnt; a null id teaches nothing and
counts as empty text in the fold rule; without positives every score is 0; an empty table gives no rows; extra columns
are kept by ``score_toxicity``, but for one of the output's name, which is replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basisweave.llm.common import bucket, first_by_hash, one_text, read_table, written

#: ASCII letters lower-cased and digits stay, other ASCII becomes a space; bytes from 0x80 on are letters.
_LETTERS = bytes(b if b >= 0x80 or chr(b).isdigit() or "a" <= chr(b) <= "z" else b + 32 if "A" <= chr(b) <= "Z" else 0x20 for b in range(256))

GRAM = 5
_CACHE = 120_000


def distinct_words(text: str | None) -> set[bytes]:
    return set((text or "").encode("utf-8", "surrogatepass").translate(_LETTERS).split())


def word_features(word: bytes) -> list[int]:
    """Hashes of the word and of its ``GRAM``-byte pieces, the ends marked."""
    marked = b"^" + word + b"$"
    crc = zlib.crc32
    return [crc(marked), *(crc(marked[i : i + GRAM]) for i in range(len(marked) - GRAM + 1))] if len(marked) > GRAM else [crc(marked)]


class _Selected(dict):
    """word -> positions of its selected features, filled as words come; emptied when large."""

    def __init__(self, position: dict[int, int]):
        self.position = position

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) > _CACHE:
            self.clear()
        get = self.position.get
        self[word] = out = tuple({p for f in word_features(word) if (p := get(f)) is not None})
        return out


@dataclass
class ToxicModel:
    features: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def scorer(self):
        """text -> score."""
        none = float(0.5 + 0.5 * np.tanh(self.bias / 2))
        held = _Selected({int(f): k for k, f in enumerate(self.features)})

        def score(text: str | None) -> float:
            hits = sorted({p for own in map(held.__getitem__, distinct_words(text)) if own for p in own})
            return float(0.5 + 0.5 * np.tanh((self.bias + self.weights[hits].sum()) / 2)) if hits else none

        return score


def nnpu_logistic(xp: np.ndarray, xu: np.ndarray, prior: float, seed: int, steps: int = 1000, batch: int = 256, rate: float = 0.05, decay: float = 2e-5) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise pi R_p(+) + max(0, R_u(-) - pi R_p(-)) by Adam; a batch's rows alone become floats."""
    rng = np.random.default_rng(seed)
    w, b = np.zeros(xp.shape[1]), -1.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        p, u = xp[rng.integers(0, len(xp), batch)].astype(float), xu[rng.integers(0, len(xu), batch)].astype(float)
        zp, zu = p @ w + b, u @ w + b
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        # Logistic losses: R_p(-) and R_u(-) are means of softplus(z).
        gap = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        if gap >= 0:
            gp, gu = np.full(batch, -prior / batch), su / batch
        else:
            gp, gu = prior * sp / batch, -su / batch
        grad = np.concatenate((p.T @ gp + u.T @ gu + decay * w * (gap >= 0), [gp.sum() + gu.sum()]))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        change = rate * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - change[:-1], b - change[-1]
    return w, float(b)


def logits(x: np.ndarray, w: np.ndarray, b: float, at_once: int = 1024) -> np.ndarray:
    """``x @ w + b``, a few rows at once: a product with the whole matrix would hold it as floats."""
    return np.concatenate([np.zeros(0), *(x[lo : lo + at_once].astype(float) @ w + b for lo in range(0, len(x), at_once))])


def calibrated(z_p: np.ndarray, z_u: np.ndarray, prior: float) -> tuple[float, float]:
    """Scale and shift of the logits: for each scale of a grid the shift that makes the unlabelled mean the prior (where
    the corrected risk is flat in the shift), then the scale of least corrected risk."""
    best = (np.inf, 1.0, 0.0)
    for scale in (1.0, 1.5, 2.0, 3.0, 4.0, 6.0):
        low, high = -60.0, 60.0
        for _ in range(60):
            shift = (low + high) / 2
            low, high = (low, shift) if (0.5 + 0.5 * np.tanh((scale * z_u + shift) / 2)).mean() > prior else (shift, high)
        risk = np.logaddexp(0, scale * z_u + shift).mean() - prior * (scale * z_p + shift).mean()
        best = min(best, (float(risk), scale, shift))
    return best[1], best[2]


def estimate_prior(xp: np.ndarray, xu: np.ndarray, folds: int = 5, rounds: int = 3, guess: float = 0.1) -> float:
    """The positives' share of the unlabelled sample: on rows left out of fits of positives against unlabelled, the least
    ratio of what exceeds a threshold among the unlabelled to what does among the positives.

    Above a threshold that only positives pass the ratio is the share; below it, it is larger. Thresholds that few
    positives pass are noise, which a bound of two standard errors on both shares keeps out. The median over ``rounds``
    ways to deal the folds is taken.
    """
    if min(len(xp), len(xu)) < 4 * folds:
        return guess
    found = []
    for seed in range(rounds):
        rng = np.random.default_rng(seed)
        fp, fu = rng.permutation(len(xp)) % folds, rng.permutation(len(xu)) % folds
        zp, zu = np.zeros(len(xp)), np.zeros(len(xu))
        for k in range(folds):
            w, b = nnpu_logistic(xp[fp != k], xu[fu != k], guess, seed, steps=400, decay=2e-4)
            zp[fp == k], zu[fu == k] = logits(xp[fp == k], w, b), logits(xu[fu == k], w, b)
        zp, zu = np.sort(zp), np.sort(zu)
        cuts = np.unique(zp)
        over_p, over_u = 1 - np.searchsorted(zp, cuts) / len(zp), 1 - (np.searchsorted(zu, cuts) - 1) / len(zu)
        over_u = np.minimum(over_u, 1)
        noise = 2 * np.sqrt(over_u * (1 - over_u) / len(zu)) / over_p + 2 * over_u / over_p * np.sqrt((1 - over_p) / (over_p * len(zp)))
        best = int(np.argmin(over_u / over_p + noise))
        found.append(float(over_u[best] / over_p[best]))
    return float(np.median(found))


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_positive: int = 4000, max_unlabelled: int = 16_000, n_features: int = 1500, classifiers: int = 3, prior: float | None = None, min_lift: float = 3.0) -> ToxicModel:
    """Learn from ``labels`` (id, toxic) and ``docs``; both already limited to the rows that may be learnt from.

    The class prior is estimated unless given. ``max_unlabelled`` bounds the classifier's learning sample alone.
    """
    known = labels.where("toxic = 1").select(F.col(id_col).alias("id"))
    empty = ToxicModel(np.zeros(0, np.int64), np.zeros(0), -np.inf, 0.0)
    if not known.take(1):
        return empty
    positive = first_by_hash(known, max_positive).withColumn("toxic", F.lit(True))
    # From all texts, confirmed ones among them: the prior is the toxic share of just this sample.
    unlabelled = first_by_hash(docs.select(F.col(id_col).alias("id")), max_unlabelled).withColumn("toxic", F.lit(False))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(np.array([f for w in distinct_words(t) for f in word_features(w)], np.int64)) for t in b.column("text").to_pylist()]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))
            yield pa.RecordBatch.from_arrays([b.column("toxic"), lists], names=["toxic", "features"])

    # Bounded by the two parameters: the chosen ids are broadcast, and texts meet them where they lie.
    chosen = one_text(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(positive.unionByName(unlabelled)), "id"), "id", "toxic").select("toxic", "text")
    sample = written(chosen.mapInArrow(features, "toxic boolean, features array<long>"), "toxic-sample")
    sizes = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    n_p, n_u = sizes.get(True, 0), sizes.get(False, 0)
    if not n_p or not n_u:
        return empty
    frequency = sample.select("toxic", F.explode("features").alias("f")).groupBy("f").agg(F.count_if("toxic").alias("p"), F.count_if(~F.col("toxic")).alias("u"))
    in_p, in_u = F.col("p") / n_p, F.col("u") / n_u
    lift = (in_p + 0.5 / n_p) / (in_u + 0.5 / n_u)
    best = [r[0] for r in frequency.where((F.col("p") >= 5) & (lift > min_lift)).orderBy((in_p * F.log(lift)).desc(), "f").limit(n_features).collect()]
    if not best:
        return empty
    position = {f: k for k, f in enumerate(best)}

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = np.zeros((b.num_rows, len(position)), bool)
            for k, own in enumerate(b.column("features").to_pylist()):
                bits[k, [position[f] for f in own if f in position]] = True
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array([r.tobytes() for r in np.packbits(bits, axis=1)], pa.binary())], names=["toxic", "bits"])

    # A row comes as bits and stays a byte a feature, so that the bounded sample is small on the driver.
    rows = sample.mapInArrow(keep, "toxic boolean, bits binary").toArrow()
    packed = np.frombuffer(b"".join(rows.column("bits").to_pylist()), np.uint8).reshape(rows.num_rows, -1)
    toxic = rows.column("toxic").to_numpy()
    # Whatever order the tasks came in: rows by their features.
    order = np.lexsort(packed.T)
    packed, toxic = packed[order], toxic[order]
    xp, xu = (np.unpackbits(packed[own], axis=1, count=len(best)).view(bool) for own in (toxic, ~toxic))
    if prior is None:
        prior = float(np.clip(estimate_prior(xp, xu), 0.005, 0.5))
    fits = [nnpu_logistic(xp, xu, prior, seed) for seed in range(classifiers)]
    # The classifiers' mean logit, calibrated: one linear score.
    weights, bias = np.mean([w for w, _ in fits], 0), float(np.mean([b for _, b in fits]))
    scale, shift = calibrated(logits(xp, weights, bias), logits(xu, weights, bias), prior)
    return ToxicModel(np.array(best, np.int64), scale * weights, scale * bias + shift, prior)


def score_toxicity(docs: DataFrame, model: ToxicModel, text_col: str = "text", keep: list[str] | None = None, out: str = "score") -> DataFrame:
    """``docs`` (or its ``keep`` columns) with the score."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != out]
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField(out, T.DoubleType())])
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shipped.value.scorer()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array([score(t) for t in b.column(text_col).to_pylist()], pa.float64())], names=[*keep, out])

    return docs.select(*dict.fromkeys([*keep, text_col])).mapInArrow(run, schema)


def production_model(docs: DataFrame, labels: DataFrame) -> ToxicModel:
    learnable = bucket(F.col("doc_id"), 3) != 1
    return fit_toxicity(docs.where(learnable), labels.where(learnable))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = production_model(docs, read_table(spark, sf_dir, "labels"))
    out = score_toxicity(docs, model, keep=["doc_id"])
    return out.select("doc_id", (bucket(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
