"""Language-model scores of whole documents: a smoothed unigram base and a gated recurrent network.

Counts come from all training documents: each task counts its own words, Spark adds them up. Arrow splits texts in pieces
of bounded size, and a piece's distinct words are looked up once each. The ``head`` most
frequent words (a bounded number, chosen from a histogram of counts) go to the tasks; what a document holds beyond
them meets the count table in a join, so nothing broadcast grows with the vocabulary. The network starts from the
unigram distribution, warms up on ``warm_documents`` documents, then every partition trains its own copy over all its
training documents by truncated backpropagation, and the copies are averaged, weighted by their tokens.

Defined cases: a null or empty text is one end token; an unseen word has count 0; a null id is held out, its text being
empty for the fold rule; repeated rows score alike, and of an id's different texts the one of least hash warms the network; without training documents all counts are 0; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basisweave.llm.common import bucket, first_by_hash, keep_freed_memory, one_blas_thread, one_text, read_table, written
from basisweave.llm.gru_lm import SUFFIXES, GruModel, Trainer

END = b""
SMOOTH = 0.1
#: Bytes of text that a task splits into words at once, a longer text apart.
_PIECE = 2_000_000
_COLUMNS = 64


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased words and one end."""
    out = (text or "").encode("utf-8", "surrogatepass").lower().split()
    out.append(END)
    return out


def token_array(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The ``tokens`` of all texts, one after another, and how many each text has."""
    trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(texts.fill_null("")))
    # A space behind the last word leaves one empty string after it, the end; an empty text is that string alone.
    gap = pc.if_else(pc.equal(pc.binary_length(trimmed), 0), "", " ").cast(trimmed.type)
    split = pc.ascii_split_whitespace(pc.binary_join_element_wise(trimmed, gap, pa.scalar("", trimmed.type)))
    lengths = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    return split.flatten().cast(pa.binary()), lengths


def _pieces(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``_PIECE`` bytes of text."""
    for b in batches:
        ends = np.cumsum(pc.binary_length(b.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _PIECE, side="right")))
            yield b.slice(at, end - at)
            at = end


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over all documents, as a written table; tasks count the words of a piece at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches, "text"):
            counted = token_array(b.column(0))[0].value_counts()
            yield pa.RecordBatch.from_arrays([counted.field("values"), counted.field("counts")], names=["word", "n"])

    return written(docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")


@dataclass
class Head:
    """The most frequent words by rank, and the corpus totals."""

    words: list[bytes]
    counts: np.ndarray
    total: int
    distinct: int
    vocabulary: int

    @property
    def rare_total(self) -> int:
        return self.total - int(self.counts[: self.vocabulary].sum())

    def base_logp(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + SMOOTH) / (self.total + SMOOTH * (self.distinct + 1)))

    @property
    def rare_scale(self) -> float:
        return self.rare_total + SMOOTH * (self.distinct - self.vocabulary + 1)


def head_of(counts: DataFrame, size: int, vocabulary: int) -> Head:
    """At most ``size`` words: those above a count level that a histogram of levels gives."""
    level = F.floor(F.log2("n") * 8).cast("int")
    levels = sorted(((r[0], r[1], r[2]) for r in counts.groupBy(level).agg(F.count(F.lit(1)), F.sum("n")).collect()), reverse=True)
    total, distinct = sum(r[2] for r in levels), sum(r[1] for r in levels)
    kept, lowest = 0, None
    for lv, n, _ in levels:
        if kept + n > size:
            break
        kept, lowest = kept + n, lv
    got = counts.where(level >= F.lit(lowest)).toArrow() if lowest is not None else None
    words = got.column("word").to_pylist() if got else []
    n = got.column("n").to_numpy() if got else np.zeros(0, np.int64)
    order = sorted(range(len(words)), key=lambda k: (-int(n[k]), words[k]))
    return Head([words[k] for k in order], n[order], total, distinct, min(vocabulary, len(words)))


@dataclass
class Encoded:
    """Texts as numbers: tokens and tokens in the head a text, sums of their shares, the input ids of all texts one after
    another, and the words beyond the head: how many distinct ones a text has, which, and how often."""

    n_tokens: np.ndarray
    n_head: np.ndarray
    base: np.ndarray
    rare: np.ndarray
    x: np.ndarray
    n_tail: np.ndarray
    tail: pa.Array
    tail_counts: np.ndarray


class Encoder:
    """Texts to the input ids of the network, and what of them the head knows. Each distinct word is looked up once a piece."""

    def __init__(self, head: Head):
        self.head = head
        self.words = pa.array(head.words, pa.binary())
        base, rare = head.base_logp(head.counts), np.log10((head.counts + SMOOTH) / head.rare_scale)
        rare[: head.vocabulary] = 0
        # What no word of the head is, rank -1, adds nothing.
        self.base, self.rare = np.append(base, 0.0), np.append(rare, 0.0)

    @staticmethod
    def _suffix(words: pa.Array) -> np.ndarray:
        ends = pc.binary_slice(words, -3).dictionary_encode()
        return np.array([zlib.crc32(w) % SUFFIXES for w in ends.dictionary.to_pylist()], np.int64)[ends.indices.to_numpy()]

    def encode(self, texts: pa.Array) -> Encoded:
        n, m = len(texts), self.head.vocabulary
        words, lengths = token_array(texts)
        coded = words.dictionary_encode()
        distinct, codes = coded.dictionary, coded.indices.to_numpy()
        ranks = pc.index_in(distinct, value_set=self.words).fill_null(-1).to_numpy()
        ids = np.where((ranks >= 0) & (ranks < m), ranks, m + self._suffix(distinct)).astype("<u2")
        owner = np.repeat(np.arange(n), lengths)
        beyond = ranks[codes] < 0
        tail, counts = np.unique(owner[beyond] * len(distinct) + codes[beyond], return_counts=True)
        per_text = lambda values: np.bincount(owner, values[codes], n)
        return Encoded(
            lengths, lengths - np.bincount(owner[beyond], minlength=n), per_text(self.base[ranks]), per_text(self.rare[ranks]), ids[codes],
            np.bincount(tail // max(1, len(distinct)), minlength=n), distinct.take(pa.array(tail % max(1, len(distinct)))), counts,
        )


def encoder_of(head: Head) -> Encoder:
    """The head's encoder, built once a worker process: a broadcast head is the same object in all its tasks."""
    if not hasattr(head, "_encoder"):
        head._encoder = Encoder(head)
    return head._encoder


_NUMBERS = {"n_tokens": pa.int64(), "n_head": pa.int64(), "base": pa.float64(), "rare": pa.float64()}


def encode_documents(docs: DataFrame, head: Head, id_col: str = "doc_id", text_col: str = "text", learn: Column | None = None) -> DataFrame:
    """(rid, id, learn, n_tokens, n_head, base, rare, x, tail) per row, as a written table that training and scoring share.

    ``x``: the input ids as 16-bit numbers; an id beyond the vocabulary is a rarer word, whose target is the rare class.
    ``base`` and ``rare`` sum the shares of the words in the head; ``tail`` counts those beyond it.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(head)
    numbered = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), (F.lit(True) if learn is None else learn).alias("learn"), F.col(text_col).alias("text"))
    kept = ["rid", "id", "learn"]
    schema = T.StructType(
        [*numbered.select(*kept).schema.fields, *(T.StructField(c, T.LongType() if t == pa.int64() else T.DoubleType()) for c, t in _NUMBERS.items())]
        + [T.StructField("x", T.BinaryType()), T.StructField("tail", T.ArrayType(T.StructType([T.StructField("word", T.BinaryType()), T.StructField("k", T.LongType())])))]
    )
    tail_type = pa.list_(pa.struct([("word", pa.binary()), ("k", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shipped.value)
        for b in _pieces(batches, "text"):
            e = encoder.encode(b.column("text"))
            pairs = pa.StructArray.from_arrays([e.tail, pa.array(e.tail_counts, pa.int64())], names=["word", "k"])
            tails = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(e.n_tail)), pa.int32()), pairs).cast(tail_type)
            ends = np.append(0, np.cumsum(2 * e.n_tokens)).astype(np.int32)
            ids = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(e.x)])
            numbers = [pa.array(getattr(e, c), t) for c, t in _NUMBERS.items()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *numbers, ids, tails], names=[*kept, *_NUMBERS, "x", "tail"])

    return written(numbered.mapInArrow(run, schema), "lm-ids")


def _inputs(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(input ids, target ids) of each row, in the column's own memory: ids beyond the vocabulary are the rare class as targets."""
    for x in column:
        ids = np.frombuffer(x.as_buffer(), "<u2")
        yield ids, ids


def train_network(docs: DataFrame, head: Head, id_col: str = "doc_id", text_col: str = "text", hidden: int = 16, warm_documents: int = 1000, warm_chars: int = 20_000, buffer: int = 2_000_000, encoded: DataFrame | None = None) -> GruModel:
    """The averaged copies of all partitions; no training text gives the unigram network.

    The warm start takes ``warm_documents`` of at most ``warm_chars`` characters, which bounds what the driver holds; the
    partitions then train on every whole document, from ``encoded`` if that is at hand.
    """
    spark = docs.sparkSession
    encoded = encode_documents(docs, head, id_col, text_col) if encoded is None else encoded
    model = GruModel.start(head.counts[: head.vocabulary].astype(float), float(head.rare_total), hidden)
    short = docs.where(F.char_length(text_col) <= warm_chars).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ids = first_by_hash(short.select("id"), warm_documents)
    chosen = one_text(short.join(F.broadcast(ids), "id"), "id")
    warm = [r[0] for r in chosen.orderBy(F.xxhash64("id"), "id").select("text").collect()]
    trainer, first = Trainer(model, lanes=32, steps=20, rate=5e-3), Encoder(head).encode(pa.array(warm, pa.string()))
    trainer.feed([(x, x) for x in np.split(first.x, np.cumsum(first.n_tokens)[:-1])] if warm else [])
    shipped = spark.sparkContext.broadcast((model.shape, model.flat))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_blas_thread()
        keep_freed_memory()
        shape, flat = shipped.value
        trainer = Trainer(GruModel(shape, flat.copy()), rate=2e-3)
        held, size = [], 0
        for b in batches:
            for x, y in _inputs(b.column(0)):
                held.append((x, y))
                size += len(x)
                if size > buffer:
                    trainer.feed(held)
                    held, size = [], 0
        trainer.feed(held)
        if trainer.tokens:
            rows = np.zeros(-(-len(trainer.model.flat) // _COLUMNS) * _COLUMNS)
            rows[: len(trainer.model.flat)] = trainer.model.flat
            rows = rows.reshape(-1, _COLUMNS) * trainer.tokens
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows), dtype=np.int32)), pa.array(np.full(len(rows), trainer.tokens)), *(pa.array(rows[:, k]) for k in range(_COLUMNS))], names=["chunk", "w", *(f"v{k}" for k in range(_COLUMNS))])

    schema = "chunk int, w long, " + ", ".join(f"v{k} double" for k in range(_COLUMNS))
    mean = encoded.where("learn").select("x").mapInArrow(run, schema).groupBy("chunk").agg(*((F.sum(f"v{k}") / F.sum("w")).alias(f"v{k}") for k in range(_COLUMNS))).toArrow()
    if mean.num_rows:  # the size of the network, whatever the input
        order = np.argsort(mean.column(0).to_numpy())
        model = GruModel(model.shape, np.stack([mean.column(k + 1).to_numpy()[order] for k in range(_COLUMNS)], 1).reshape(-1)[: len(model.flat)])
    return model


def score_documents(docs: DataFrame, counts: DataFrame, head: Head, model: GruModel, id_col: str = "doc_id", text_col: str = "text", buffer: int = 6_400_000, encoded: DataFrame | None = None) -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) of whole texts, from ``encoded`` if that is at hand."""
    encoded = encode_documents(docs, head, id_col, text_col) if encoded is None else encoded
    shipped = docs.sparkSession.sparkContext.broadcast((model.shape, model.flat))
    kept = ["rid", "id", *_NUMBERS]
    schema = T.StructType([*encoded.select(*kept).schema.fields, T.StructField("logp", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_blas_thread()
        keep_freed_memory()
        network = GruModel(*shipped.value)
        held, rows, size = [], [], 0

        def flush() -> pa.RecordBatch:
            logp = pa.array(network.score(held) / np.log(10), pa.float64())
            return pa.RecordBatch.from_arrays([*(pa.concat_arrays([r.column(c) for r in rows]) for c in kept), logp], names=[*kept, "logp"])

        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                rows.append(b.select(kept))
                own = list(_inputs(b.column("x")))
                held += own
                size += sum(len(x) for x, _ in own)
                if size > buffer:
                    yield flush()
                    held, rows, size = [], [], 0
        if rows:
            yield flush()

    scored = encoded.select(*kept, "x").mapInArrow(run, schema)
    beyond = encoded.select("rid", F.explode("tail").alias("t")).select("rid", "t.word", "t.k").join(counts, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    base = F.log10((F.col("n") + SMOOTH) / F.lit(head.total + SMOOTH * (head.distinct + 1)))
    rare = F.log10((F.col("n") + SMOOTH) / F.lit(head.rare_scale))
    summed = beyond.groupBy("rid").agg(F.sum(F.col("k") * base).alias("tail_base"), F.sum(F.col("k") * rare).alias("tail_score"), F.sum(F.when(F.col("n") > 0, F.col("k")).otherwise(0)).alias("tail_known"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return scored.join(summed, "rid", "left").select("id", "n_tokens", (F.col("n_head") + zero("tail_known")).alias("n_known"), (F.col("base") + zero("tail_base")).alias("base_score"), (F.col("logp") + F.col("rare") + zero("tail_score")).alias("score"))


def op1_lm_scoring(spark: SparkSession, sf_dir: str, head_words: int = 1 << 18, vocabulary: int = 4096) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    training = docs.where(bucket(F.col("doc_id"), 10) != 0)
    counts = word_counts(training)
    head = head_of(counts, head_words, vocabulary)
    encoded = encode_documents(docs, head, learn=bucket(F.col("doc_id"), 10) != 0)
    model = train_network(training, head, encoded=encoded)
    out = score_documents(docs, counts, head, model, encoded=encoded)
    return out.select(F.col("id").alias("doc_id"), (bucket(F.col("id"), 10) == 0).alias("held_out"), "n_tokens", "n_known", F.lit(head.total).cast("long").alias("train_tokens"), "base_score", "score")
