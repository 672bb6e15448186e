import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from basisweave.llm.common import first_by_hash
from basisweave.llm.gru_lm import GruModel, Trainer
from basisweave.llm.lm_scoring import Encoder, Head, head_of, op1_lm_scoring, score_documents, token_array, tokens, train_network, word_counts


def corpus(n, seed=0):
    rng = random.Random(seed)
    tongues = [[f"{p}{k}" for k in range(40)] for p in ("aa", "bb", "cc")]
    return [" ".join(rng.choice(tongues[k % 3]) for _ in range(rng.randint(5, 60))) for k in range(n)]


def test_gradients():
    rng = np.random.default_rng(0)
    model = GruModel.start(np.array([9.0, 5, 3, 2] + [1] * 70), 4.0, hidden=4, embed=3)
    x, y = rng.integers(0, 74, (2, 5)), rng.integers(0, 75, (2, 5))
    keep = np.array([[1, 1, 0, 1, 1], [1, 1, 1, 1, 0]], np.float32)

    def loss():
        h, total = np.zeros((2, 4), np.float32), 0.0
        for t in range(5):
            s = h * keep[:, t, None]
            total -= model.token_logp(s, y[:, t])[0].sum()
            h = s.copy()
            model.advance(h, model.inputs()[x[:, t]])
        return total

    trainer = Trainer(model, lanes=2, steps=5)
    trainer._adam = lambda scale: None
    trainer._window(x, y, keep, np.zeros((2, 4), np.float32))
    grad = trainer.grad.copy()
    for k in np.argsort(-np.abs(grad))[:25]:
        was, eps = model.flat[k], 2e-2
        model.flat[k] = was + eps
        up = loss()
        model.flat[k] = was - eps
        down = loss()
        model.flat[k] = was
        assert abs((up - down) / (2 * eps) - grad[k]) < 0.05 * max(1, abs(grad[k]))


def test_state_is_carried_across_windows():
    model = GruModel.start(np.arange(100, 0, -1).astype(float), 1.0)
    rng = np.random.default_rng(1)
    docs = [(x := rng.integers(0, 100, n).astype(np.int32), x) for n in (1, 3, 70, 200, 65)]
    assert np.allclose(model.score(docs), model.score(docs, at_once=7), atol=1e-3)
    one = [float(model.score([d])[0]) for d in docs]
    assert np.allclose(model.score(docs), one, atol=1e-3)


def test_scores_against_brute_force(make_docs):
    texts = corpus(150)
    rows = [*enumerate(texts), (900, None), (901, ""), (902, "unseen words"), (3, texts[3]), (None, "aa1 aa2")]
    docs, train = make_docs(rows, word="x", n=1), make_docs(list(enumerate(texts[:120])))
    counts = word_counts(train)
    head = head_of(counts, 60, 32)
    assert 0 < len(head.words) <= 60
    model = train_network(train, head, warm_documents=120)
    got = score_documents(docs, counts, head, model).collect()
    assert len(got) == len(rows)
    c = Counter(w for t in texts[:120] for w in tokens(t))
    n, v = sum(c.values()), len(c)
    base = lambda t: sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))
    want = sorted((str(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), round(base(t), 6)) for i, t in rows)
    assert sorted((str(r.id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    held = [r for r in got if r.id is not None and 120 <= r.id < 150]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert score_documents(make_docs([]), counts, head, model).count() == 0


def test_no_training_documents(make_docs):
    empty = make_docs([])
    counts = word_counts(empty)
    head = head_of(counts, 10, 5)
    got = score_documents(make_docs([(1, "a b")]), counts, head, train_network(empty, head)).first()
    assert got.n_tokens == 3 and got.n_known == 0 and abs(got.base_score) < 1e-9 and math.isfinite(got.score)


def test_every_token_is_trained_on():
    for sizes in ([1000], [40_000], [1], [7, 0, 5, 31], [20_001]):
        trainer = Trainer(GruModel.start(np.arange(100, 0, -1).astype(float), 1.0))
        rng, seen = np.random.default_rng(2), []
        inner = trainer._window
        trainer._window = lambda x, y, keep, h: (seen.append(y[y >= 0]), inner(x, y, keep, h))[1]
        docs = [(x := rng.integers(0, 100, n).astype(np.int32), x) for n in sizes]
        trainer.feed(docs)
        assert trainer.tokens == sum(sizes) and np.array_equal(np.sort(np.concatenate(seen)), np.sort(np.concatenate([x for x, _ in docs])))


def test_padding_teaches_nothing():
    model = GruModel.start(np.arange(100, 0, -1).astype(float), 1.0)
    trainer = Trainer(model, steps=4)
    trainer._adam = lambda scale: None
    x, keep = np.array([[3, 5, 7, 9]]), np.ones((1, 4), np.float32)
    trainer._window(x[:, :2], x[:, :2], keep[:, :2], np.zeros((1, 16), np.float32))
    short = trainer.grad.copy()
    trainer._window(x, np.array([[3, 5, -1, -1]]), keep, np.zeros((1, 16), np.float32))
    assert np.allclose(short, trainer.grad, atol=1e-6)


def test_samples_count_keys_and_not_rows(spark):
    rows = spark.range(100).withColumnRenamed("id", "k").crossJoin(spark.range(1000)).select(F.col("k").alias("id"))
    assert first_by_hash(rows, 100).count() == 100
    assert first_by_hash(rows.unionByName(spark.range(100, 5000)), 40).count() == 40


def test_query_against_brute_force(spark, small_tables):
    got = op1_lm_scoring(spark, small_tables)
    assert {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"} <= set(got.columns)
    got = got.collect()
    rows = spark.read.parquet(f"{small_tables}/documents.parquet").select("doc_id", "text").collect()
    fold = lambda r: zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 10
    c = Counter(w for r in rows if fold(r) for w in tokens(r.text))
    n, v = sum(c.values()), len(c)
    base = lambda t: sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))
    want = sorted((str(r.doc_id), fold(r) == 0, len(tokens(r.text)), sum(c[w] > 0 for w in tokens(r.text)), n, round(base(r.text), 3)) for r in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    tie = [r.score for r in got if r.doc_id in (9005, 9006)]
    assert abs(tie[0] - tie[1]) < 1e-4


def test_scores_do_not_depend_on_windows():
    """Documents of any lengths, empty ones among them, score alike alone, together and in small windows."""
    rng = np.random.default_rng(7)
    model = GruModel.start(np.array([9.0, 5, 3, 2] + [1] * 70), 4.0, hidden=4, embed=3)
    model.flat += rng.normal(0, 0.1, len(model.flat)).astype(model.flat.dtype)
    docs = [(rng.integers(0, 74, n), rng.integers(0, 75, n)) for n in (1, 300, 0, 7, 7, 40, 1)]
    together = model.score(docs)
    assert together == pytest.approx([model.score([d])[0] for d in docs], abs=1e-3)
    assert together == pytest.approx(model.score(docs, at_once=1), abs=1e-3) and together[2] == 0
    assert model.score([]).tolist() == []


def test_pieces_are_encoded_as_single_texts():
    odd = [None, "", " ", "\n\t ", " a", "a ", "a\x1cb \x0b x  y", "\u00c4\u00d6 a\u00c4\u00a0B", "x" * 3000, *(f" A{chr(c)}{chr(c)}b{chr(c)}" for c in range(128)), *corpus(30)]
    flat, lengths = token_array(pa.array(["cut", *odd]).slice(1))
    assert flat.to_pylist() == [w for t in odd for w in tokens(t)] and lengths.tolist() == [len(tokens(t)) for t in odd]
    c = Counter(w for t in odd for w in tokens(t)).most_common(80)
    head = Head([w for w, _ in c], np.array([n for _, n in c]), 5000, 300, 40)
    rank, e = {w: k for k, (w, _) in enumerate(c)}, Encoder(head).encode(pa.array(odd))
    at = tail_at = 0
    for k, t in enumerate(odd):
        words = tokens(t)
        known, tail = [w for w in words if w in rank], Counter(w for w in words if w not in rank)
        assert e.n_tokens[k] == len(words) and e.n_head[k] == len(known)
        assert e.base[k] == pytest.approx(sum(math.log10((c[rank[w]][1] + 0.1) / (5000 + 30.1)) for w in known))
        assert e.rare[k] == pytest.approx(sum(math.log10((c[rank[w]][1] + 0.1) / head.rare_scale) for w in known if rank[w] >= 40))
        assert e.x[at : at + len(words)].tolist() == [rank[w] if rank.get(w, 99) < 40 else 40 + zlib.crc32(w[-3:]) % 256 for w in words]
        assert dict(zip(e.tail.to_pylist()[tail_at : tail_at + e.n_tail[k]], e.tail_counts[tail_at : tail_at + e.n_tail[k]].tolist(), strict=True)) == tail
        at, tail_at = at + len(words), tail_at + e.n_tail[k]
    assert at == len(e.x) and tail_at == len(e.tail) and len(Encoder(head).encode(pa.array([], pa.string())).x) == 0


def test_encoding_costs_less_than_a_lookup_a_token():
    rng = random.Random(5)
    texts = [" ".join(f"word{int(rng.paretovariate(0.6)) % 40_000}" for _ in range(500)) for _ in range(600)]
    c = Counter(w for t in texts for w in tokens(t)).most_common(20_000)
    encoder, rank = Encoder(Head([w for w, _ in c], np.array([n for _, n in c]), 300_600, 40_000, 4096)), {w: k for k, (w, _) in enumerate(c)}

    def least(run):
        times = []
        for _ in range(5):
            start = time.process_time()
            run()
            times.append(time.process_time() - start)
        return min(times)

    column = pa.array(texts)
    assert least(lambda: encoder.encode(column)) < 0.8 * least(lambda: [Counter(w for w in tokens(t) if rank.get(w, -1) < 0) or [rank.get(w) for w in tokens(t)] for t in texts])
