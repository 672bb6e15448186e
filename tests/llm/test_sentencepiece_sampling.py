import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from basisweave.llm.sentencepiece_sampling import BYTES_WEIGHT, MODEL_PATH, RANK_SHIFT, decode_pieces, op6_sentencepiece_sampling, sample_segmentations, search_batch, vocabulary


@pytest.fixture(scope="module")
def pieces():
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL_PATH)
    plain = [k for k in range(model.get_piece_size()) if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k))]
    return {model.id_to_piece(k): (k, -np.log(k - 259 + RANK_SHIFT)) for k in plain}


def all_paths(pieces, text):
    """Every segmentation of the whole text with its probability, by enumeration from the vocabulary alone."""
    whole = " " + text
    marked = whole.replace("▁", "\0").replace(" ", "▁")

    def walk(at):
        if at == len(marked):
            return [((), 0.0)]
        out = []
        for end in range(at + 1, min(len(marked), at + 16) + 1):
            own = pieces.get(marked[at:end])
            if own is None and end == at + 1:
                own = (-1 - ord(whole[at]), BYTES_WEIGHT)
            if own is not None:
                out += [((own[0], *rest), own[1] + w) for rest, w in walk(end)]
        return out

    found = dict(walk(0))
    top = max(found.values())
    total = sum(np.exp(v - top) for v in found.values())
    return {p: float(np.exp(v - top)) / total for p, v in found.items()}


def ids_of(lattices, path):
    return tuple(lattices.piece[path.edges].tolist())


@pytest.mark.parametrize("text", ["an in", "x7 漢a"])
def test_order_and_pairs_follow_sampling_without_replacement(pieces, text):
    n = 6000
    want = all_paths(pieces, text)
    lattices, found = search_batch(vocabulary(MODEL_PATH), [text] * n, [str(k) for k in range(n)], 2)
    first, pair = Counter(), Counter()
    for paths, after in found:
        a, b = (ids_of(lattices, p) for p in paths)
        assert a != b and paths[0].value >= paths[1].value >= after
        assert abs(np.exp(paths[0].before[-1]) - want[a]) < 1e-9 and abs(np.exp(paths[1].before[-1]) - want[b]) < 1e-9
        first[a] += 1
        pair[a, b] += 1
    assert all(abs(first[p] / n - want[p]) < 0.03 for p in want)
    assert all(abs(pair[a, b] / n - want[a] * want[b] / (1 - want[a])) < 0.03 for a in want for b in want if a != b)


@pytest.mark.parametrize("text", ["in", "an in", "7", "éa b", "theand"])
def test_few_segmentations_are_all_found_and_rows_repeat(pieces, text):
    lattices, ((paths, after), (other, _)) = search_batch(vocabulary(MODEL_PATH), [text, text], ["k", "k"], 1000)
    want = all_paths(pieces, text)
    assert len(want) < 1000 and after == -np.inf
    assert Counter(ids_of(lattices, p) for p in paths) == Counter(list(want))
    assert all(abs(np.exp(p.before[-1]) - want[ids_of(lattices, p)]) < 1e-9 for p in paths)
    assert [p.value for p in paths] == [p.value for p in other] == sorted((p.value for p in paths), reverse=True)


def test_inclusion_weights_are_unbiased(pieces):
    """Weighted by 1 / inclusion, the samples' mean number of pieces is that of all segmentations."""
    want, n = sum(p * len(s) for s, p in all_paths(pieces, "an in").items()), 3000
    _, found = search_batch(vocabulary(MODEL_PATH), ["an in"] * n, [f"r{k}" for k in range(n)], 4)
    estimate = [sum(len(p.edges) * np.exp(p.before[-1]) / -np.expm1(-np.exp(p.before[-1] - after)) for p in paths) for paths, after in found]
    assert abs(np.mean(estimate) / want - 1) < 0.02


def test_long_words_are_not_cut(pieces):
    """A piece may lie anywhere in a word of over 16 letters: probabilities are those of the whole lattice."""
    text = "zzzzzzzzzzzzzzzthe"
    want = all_paths(pieces, text)
    lattices, found = search_batch(vocabulary(MODEL_PATH), [text] * 500, [str(k) for k in range(500)], 1)
    seen = Counter()
    for paths, _ in found:
        assert abs(np.exp(paths[0].before[-1]) - want[ids_of(lattices, paths[0])]) < 1e-9
        seen[ids_of(lattices, paths[0])[-1]] += 1
    last = Counter()
    for p, w in want.items():
        last[p[-1]] += w
    assert all(abs(seen[k] / 500 - w) < 0.08 for k, w in last.items())


def test_round_trips(make_docs):
    texts = ["", None, "a", " ", "\n\n", "  two  spaces ", "▁ mark ▁▁", "漢字 \U0001f600 é́", "\x00\t\r", "A,b.C!1_2", "x" * 5000, "word " * 3000, "internationalization " * 10, "long text, " * 60_000]
    rows = [*enumerate(texts), (0, ""), (None, "same"), (None, "same")]
    docs = make_docs(rows, samples="x", _key=1, exact=2, _text="other")
    out = sample_segmentations(docs, k=3).cache()
    assert out.count() == len(rows) and out.where("exact").count() == len(rows)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "_key", "_text", "samples", "exact"]
    assert out.where("_key <> 1 or _text <> 'other'").count() == 0
    back = decode_pieces(out.select("text", F.explode("samples").alias("s")).select("text", "s.ids", "s.inclusion"))
    assert all(r.decoded == (r.text or "") and 0 <= r.inclusion <= 1 for r in back.collect())
    assert sample_segmentations(make_docs([])).count() == 0


def test_same_samples_on_any_partitioning(make_docs):
    docs = make_docs([(k, f"some words number {k} here") for k in range(40)])
    a, b = ({r.doc_id: [s.ids for s in r.samples] for r in sample_segmentations(d, batch_chars=c).collect()} for d, c in ((docs.repartition(1), 10_000), (docs.repartition(7), 30)))
    assert a == b


def test_query_returns_two_samples_of_every_text(spark, small_tables):
    rows = op6_sentencepiece_sampling(spark, small_tables).collect()
    per = {}
    for r in rows:
        per.setdefault(r.doc_id, []).append(r)
    ids = Counter(r.doc_id for r in spark.read.parquet(f"{small_tables}/documents.parquet").select("doc_id").collect())
    assert set(per) == set(ids) and all(r.round_trip for r in rows)
    for own in per.values():
        assert all(r.n_pieces >= 0 and r.log_prob <= 1e-9 and 0 <= r.inclusion <= 1 for r in own)


def test_query_ids_decode_with_the_library(spark, small_tables):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL_PATH)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small_tables}/documents.parquet").select("doc_id", "text").collect()}
    for r in op6_sentencepiece_sampling(spark, small_tables).collect():
        digest = hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
        assert r.decoded_sha256 == digest and r.n_pieces == len(r.ids)
        if len(r.ids) < 5000:
            assert model.decode(r.ids) == texts[r.doc_id]
