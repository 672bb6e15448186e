import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from basisweave.llm.byte_bpe import VOCABULARY, Merger, decode, encode, encode_texts, monoid, op12_byte_bpe, read_ranks, token_starts


@pytest.fixture(scope="module")
def ranks():
    return read_ranks(public_tokenizers.path(VOCABULARY))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


PARTS = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "'", "''", "s", "t", "RE", " ", "  ", "\n", "\t", "\r\n", "\x85", "\x00", "\x1c", " ", "　", "a", "é", "中", "1", "٣", "½", "!", "?", ".", "\U0001f600", "́", "ʼ", "Ᲊ", "\U00010d4a", "\U00016130", "꟎", "x" * 70, "<|endoftext|>"]


def test_against_the_library_on_random_texts(ranks, library):
    rng = random.Random(1)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += [None, "", " ", "'s", "'", "''s", " 's", "x" * 3000, "ab" * 1500, "a" * 300, "word " * 3000, "'" * 999, "\n" * 999]
    merger = Merger(ranks)
    ids, counts = encode_texts(texts, merger)
    parts = np.split(ids, np.cumsum(counts)[:-1])
    assert len(parts) == len(texts)
    assert all(p.tolist() == library.encode_ordinary(t or "") for p, t in zip(parts, texts))


def test_classes_of_code_points(ranks, library):
    rng = random.Random(2)
    codes = [c for c in rng.sample(range(0x110000), 20_000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}1{chr(c)} {chr(c)}\t{chr(c)}!" for c in codes]
    ids, counts = encode_texts(texts, Merger(ranks))
    assert ids.tolist() == [k for t in texts for k in library.encode_ordinary(t)]


def test_scan_against_one_step_at_a_time():
    of_class, table, value, begins = monoid()
    assert (table[0] == np.arange(len(table))).all() and (table[:, 0] == np.arange(len(table))).all()
    rng = np.random.default_rng(3)
    a, b, c = rng.integers(0, len(table), (3, 500))
    assert (table[table[a, b], c] == table[a, table[b, c]]).all()
    codes = rng.choice([ord(x) for x in "a1 '\n!st"] + [0x110000], 5000).astype(np.uint32)
    whole, _ = token_starts(codes)
    # Texts are parted by the end mark, so each can be scanned alone.
    alone, start = [], 0
    for stop in np.flatnonzero(codes == 0x110000):
        alone += (token_starts(codes[start : stop + 1])[0] + start).tolist()
        start = stop + 1
    assert whole[whole < start].tolist() == alone


def test_cache_is_emptied_and_long_pieces_stay_out(ranks, library, monkeypatch):
    monkeypatch.setattr("basisweave.llm.byte_bpe._CACHE", 50)
    merger, rng = Merger(ranks), random.Random(4)
    for _ in range(20):
        texts = ["".join(rng.choice("abcdefgh ") for _ in range(200)) + "z" * 90 for _ in range(5)]
        ids, _ = encode_texts(texts, merger)
        assert ids.tolist() == [k for t in texts for k in library.encode_ordinary(t)]
        assert all(len(p) <= 64 for p in merger.number)


def test_offsets_and_round_trip(spark, make_docs, ranks, library):
    rows = [(1, None), (2, ""), (3, "Don't  stop\n\n\tnow… 中文字 \U0001f600's"), (3, "Don't  stop\n\n\tnow… 中文字 \U0001f600's"), (4, "long text é " * 30_000), (None, "no id")]
    docs = make_docs(rows, ids="old", offsets="old", decoded="old")
    got = decode(encode(docs, ranks), ranks)
    assert set(got.columns) == {"doc_id", "lang", "source", "n_chars", "ids", "offsets", "decoded"}
    got = got.orderBy("doc_id", "n_chars").collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0]))
    for r, (i, t) in zip(got, want):
        raw = (t or "").encode()
        assert r.doc_id == i and r.ids == library.encode_ordinary(t or "") and bytes(r.decoded) == raw
        assert r.offsets == np.append(0, np.cumsum([len(library.decode_single_token_bytes(k)) for k in r.ids])).tolist()
    assert encode(make_docs([]), ranks).count() == 0
    assert decode(encode(docs, ranks).withColumn("ids", F.lit(None).cast("array<int>")), ranks).where("decoded is not null").count() == 0


def test_query_against_the_library(spark, small_tables, library):
    got = op12_byte_bpe(spark, small_tables)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = []
    for r in spark.read.parquet(f"{small_tables}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(map(tuple, got.collect())) == sorted(want)
