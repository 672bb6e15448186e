"""Byte-level BPE: texts to ids by the ranks of a public vocabulary, and back.

A batch of texts becomes one array of code points, each with a class (letter, number, other, kinds of white space, an
apostrophe that may open a contraction). A class is a function from the state before a character to the state after
it. Composition of these functions is associative, and the few functions there are (a monoid, closed once) compose by
one table look-up, so a blocked scan over the array gives the state before every character, and with it every boundary
of the pre-tokeniser's pattern; no regex runs. The slices between boundaries meet a cache of merged pieces; the pieces of
a batch that are not there are merged side by side, pair by pair, the lowest rank first and the leftmost of equals. Each
token's byte offset is kept, and decoding gathers the tokens' bytes by these offsets.

Defined cases: null and empty texts have no tokens and decode to nothing; very long texts and runs of one class are
merged with a heap, in time n log n; repeated rows and ties are encoded alike; an empty table gives no rows; extra
columns pass through, but for ones of the outputs' names, which are replaced. Ids and offsets are 32-bit.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basisweave.llm.common import read_table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
_CACHE, _LONGEST = 150_000, 64
#: Characters scanned at once (a longer text alone), and rows taken out of a batch at once: what a worker holds.
_CHARS, _ROWS = 400_000, 256
_BLOCK = 256

LETTER, NUMBER, OTHER, SPACE_ON, BLANK_LAST, SPACE_LAST, SHORT, LONG, END = range(9)
"""Classes. SPACE_ON: white space before white space or the end; BLANK_LAST: a blank before something else;
SPACE_LAST: other white space there; SHORT and LONG: an apostrophe before one or two letters of a contraction."""
_L, _N, _O, _W, _JOIN, _FRESH, _ONE, _TWO = range(8)
"""States: within a run of letters, numbers, others or white space; after a blank that joins what comes; where a token
begins whatever comes; one or two letters of a contraction to go."""

#: Letters and numbers of Unicode 16, the tokeniser's version, that Unicode 15.1 has not; all white space.
NEW_LETTERS = "1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B 1138E 11390-113B5 113B7 113D1 113D3 11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 18CFF 1E5D0-1E5ED 1E5F0"
NEW_NUMBERS = "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA"
WHITE_SPACE = "9-D 20 85 A0 1680 2000-200A 2028-2029 202F 205F 3000"

_IN_CONTRACTION = {_ONE: _FRESH, _TWO: _ONE}
_RUNS = {LETTER: _L, NUMBER: _N, OTHER: _O}


def _step(kind: int, state: int) -> tuple[int, bool]:
    """(next state, whether a token begins here)."""
    if kind == END:
        return _FRESH, True
    if state in _IN_CONTRACTION:
        return _IN_CONTRACTION[state], False
    if kind == SPACE_ON:
        return _W, state != _W
    if kind in (BLANK_LAST, SPACE_LAST):
        return (_JOIN if kind == BLANK_LAST else _FRESH), True
    if kind in (SHORT, LONG):
        return (_O, False) if state in (_O, _JOIN) else (_ONE if kind == SHORT else _TWO, True)
    return _RUNS[kind], state not in (_RUNS[kind], _JOIN)


@lru_cache(1)
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(element of each class, product table, value of an element at a state, whether a token begins by class and state).

    Element 0 is the identity; ``product[a, b]`` is a first, then b."""
    first = [tuple(_step(k, s)[0] for s in range(8)) for k in range(9)]
    elements = [tuple(range(8))]
    number = {elements[0]: 0}
    for f in elements:  # grows while it is read: the closure
        for g in first:
            h = tuple(g[s] for s in f)
            if h not in number:
                number[h] = len(elements)
                elements.append(h)
    table = np.array([[number[tuple(g[s] for s in f)] for g in elements] for f in elements], np.uint16)
    begins = np.array([[_step(k, s)[1] for s in range(8)] for k in range(9)])
    return np.array([number[f] for f in first], np.uint16), table, np.array(elements, np.uint8), begins


@lru_cache(1)
def code_classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or SPACE_ON (any white space) by code point; the one past the last is END."""
    out = np.full(0x110001, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            out[c] = LETTER if kind == "L" else NUMBER
    for kind, runs in ((LETTER, NEW_LETTERS), (NUMBER, NEW_NUMBERS), (SPACE_ON, WHITE_SPACE)):
        for run in runs.split():
            low, _, high = run.partition("-")
            out[int(low, 16) : int(high or low, 16) + 1] = kind
    out[0x110000] = END
    return out


def _scanned(elements: np.ndarray) -> np.ndarray:
    """The product of all elements before each place, blocks first, then the blocks' products in the same way."""
    _, table, _, _ = monoid()
    n = len(elements)
    if n <= _BLOCK:
        out, held = np.zeros(n, np.uint16), 0
        for k, e in enumerate(elements.tolist()):
            out[k] = held
            held = int(table[held, e])
        return out
    rows = -(-n // _BLOCK)
    padded = np.zeros(rows * _BLOCK, np.uint16)
    padded[:n] = elements
    columns = np.ascontiguousarray(padded.reshape(rows, _BLOCK).T)
    before = np.zeros_like(columns)
    flat, width = table.ravel(), len(table)
    for k in range(1, _BLOCK):
        before[k] = flat[before[k - 1].astype(np.intp) * width + columns[k - 1]]
    whole = flat[before[-1].astype(np.intp) * width + columns[-1]]
    entry = _scanned(whole)
    return flat[entry.astype(np.intp) * width + before].T.reshape(-1)[:n]


def token_starts(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions where a pre-token begins, their classes) in code points of texts that END parts; END begins one itself."""
    kinds = code_classes()[codes]
    follow = np.append(kinds[1:], END)
    space = np.flatnonzero(kinds == SPACE_ON)
    last = space[(follow[space] != SPACE_ON) & (follow[space] != END)]
    kinds[last] = np.where(codes[last] == 32, BLANK_LAST, SPACE_LAST)
    marks = np.flatnonzero(codes == 39)
    if len(marks):
        ahead = np.append(codes, (0x110000, 0x110000))
        one, two = ahead[marks + 1], ahead[marks + 2]
        kinds[marks[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
        e = two == ord("e")
        kinds[marks[(one == ord("r")) & e | (one == ord("v")) & e | (one == ord("l")) & (two == ord("l"))]] = LONG
    of_class, _, value, begins = monoid()
    states = value[_scanned(of_class[kinds]), _FRESH]
    at = np.flatnonzero(begins[kinds, states])
    return at, kinds[at]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


_NONE = 1 << 30


class Merger:
    """Pieces to ids, with a cache of merged pieces that is emptied when large and holds no long ones.

    Ids are the ranks, so the pair that is merged next is the one whose whole has the lowest id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        pairs = {ranks[b[:k]] << 32 | ranks[b[k:]]: r for b, r in ranks.items() for k in range(1, len(b)) if b[:k] in ranks and b[k:] in ranks}
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys, self.wholes = np.append(keys[order], 1 << 62), np.append(np.fromiter(pairs.values(), np.int64, len(pairs))[order], _NONE)
        self.single = np.array([ranks[bytes([k])] for k in range(256)], np.int64)
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.flat, self.ends = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def whole(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id of each pair's whole, or ``_NONE``."""
        pair = left << 32 | right
        at = np.searchsorted(self.keys, pair)
        return np.where(self.keys[at] == pair, self.wholes[at], _NONE)

    def ids(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in a row, how many each piece has)."""
        if len(self.number) > _CACHE:
            self.forget()
        new = set(pieces).difference(self.number)
        long = {p for p in new if len(p) > _LONGEST and p not in self.ranks}
        self._learn([p for p in new if p not in long])
        own = {p: np.array(self.merged_long(p), np.int32) for p in long}
        if not long:
            return self._held(pieces)
        ids, counts, start = [], [], 0
        for k in [*(k for k, p in enumerate(pieces) if p in own), len(pieces)]:
            between, lengths = self._held(pieces[start:k])
            last = [own[p] for p in pieces[k : k + 1]]
            ids += [between, *last]
            counts += [lengths, np.array([len(x) for x in last], np.int64)]
            start = k + 1
        return np.concatenate(ids), np.concatenate(counts)

    def _held(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        at = np.fromiter(map(self.number.__getitem__, pieces), np.int64, len(pieces))
        ends = self.ends[at]
        counts = ends - np.append(0, self.ends)[at]
        after = np.cumsum(counts)
        return self.flat[np.repeat(ends - after, counts) + np.arange(after[-1] if len(after) else 0)], counts

    def _learn(self, pieces: list[bytes]) -> None:
        """Merge new pieces side by side: each round merges the leftmost lowest pair of every piece that has one."""
        ready = [p for p in pieces if p in self.ranks]
        rest = [p for p in pieces if p not in self.ranks]
        self._add(ready, np.array([self.ranks[p] for p in ready], np.int32), np.ones(len(ready), np.int64))
        lengths = np.array([len(p) for p in rest], np.int64)
        token = self.single[np.frombuffer(b"".join(rest), np.uint8)]
        owner = np.repeat(np.arange(len(rest)), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        inner = np.append(owner[1:] == owner[:-1], False)
        pair = np.full(len(token), _NONE)
        left = np.flatnonzero(inner)
        pair[left] = self.whole(token[left], token[left + 1])
        while len(token):
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            least = np.minimum.reduceat(pair, starts)
            sizes = np.diff(np.append(starts, len(token)))
            open_ = np.repeat(least < _NONE, sizes)
            if not open_.all():
                done.append((owner[~open_], token[~open_]))
                token, owner, pair = token[open_], owner[open_], pair[open_]
                sizes, least = sizes[least < _NONE], least[least < _NONE]
                if not len(token):
                    break
            hits = np.flatnonzero(pair == np.repeat(least, sizes))
            at = hits[np.append(True, owner[hits[1:]] != owner[hits[:-1]])]
            token[at] = least
            stays = np.ones(len(token), bool)
            stays[at + 1] = False
            at = at - np.arange(len(at))
            token, owner, pair = token[stays], owner[stays], pair[stays]
            for side in (at, at[(at > 0)] - 1):
                follow = np.minimum(side + 1, len(token) - 1)
                joined = (owner[follow] == owner[side]) & (follow > side)
                if side is not at:
                    side, follow, joined = side[joined], follow[joined], joined[joined]
                pair[side] = np.where(joined, self.whole(token[side], token[follow]), _NONE)
        owners = np.concatenate([np.zeros(0, np.int64), *(o for o, _ in done)])
        tokens = np.concatenate([np.zeros(0, np.int64), *(t for _, t in done)])
        order = np.argsort(owners, kind="stable")
        self._add(rest, tokens[order].astype(np.int32), np.bincount(owners, minlength=len(rest)).astype(np.int64))

    def _add(self, pieces: list[bytes], flat: np.ndarray, counts: np.ndarray) -> None:
        base = self.ends[-1] if len(self.ends) else 0
        self.number |= zip(pieces, range(len(self.number), len(self.number) + len(pieces)))
        self.flat = np.concatenate([self.flat, flat])
        self.ends = np.concatenate([self.ends, base + np.cumsum(counts)])

    def merged_long(self, piece: bytes) -> list[int]:
        """The same merges from a heap of (rank, place); entries of parts that changed are passed over."""
        get, n = self.ranks.get, len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of each part that begins at a place
        rank = [get(piece[k : k + 2], _NONE) for k in range(n - 1)] + [_NONE]
        heap = [(r, k) for k, r in enumerate(rank) if r < _NONE]
        heapq.heapify(heap)

        def renew(k: int) -> None:
            rank[k] = get(piece[k : after[after[k]]], _NONE) if after[k] < n else _NONE
            if rank[k] < _NONE:
                heapq.heappush(heap, (rank[k], k))

        while heap:
            r, k = heapq.heappop(heap)
            if rank[k] != r:
                continue
            gone = after[k]
            after[k], rank[gone] = after[gone], -1
            if after[k] < n:
                before[after[k]] = k
            renew(k)
            if before[k] >= 0:
                renew(before[k])
        out, k = [], 0
        while k < n:
            out.append(get(piece[k : after[k]]))
            k = after[k]
        return out


def encode_texts(texts: list[str | None], merger: Merger) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in a row, number of ids of each text)."""
    plain = [t or "" for t in texts]
    sizes = np.array([len(t) for t in plain], np.int64)
    ends = np.cumsum(sizes + 1) - 1
    codes = np.empty(int(sizes.sum()) + len(plain), np.uint32)
    inside = np.ones(len(codes), bool)
    inside[ends] = False
    joined = "".join(plain)
    codes[inside] = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes[ends] = 0x110000
    at, kinds = token_starts(codes)
    width = inside.astype(np.int64) + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
    width[ends] = 0
    cuts = (np.cumsum(width) - width)[at].tolist()
    whole = joined.encode("utf-8", "surrogatepass")
    # The piece that would begin at a text's end is empty.
    cuts.append(len(whole))
    ids, counts = merger.ids([p for a, b in pairwise(cuts) if (p := whole[a:b])])
    text = (np.cumsum(kinds == END) - (kinds == END))[kinds != END]
    return ids, np.bincount(text, counts, len(plain)).astype(np.int64)


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(values, pa.int32()))


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, _ROWS):
            yield whole.slice(at, _ROWS)


def _parts(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """(first row, rows) of runs of about ``_CHARS``."""
    start = held = 0
    for k, n in enumerate(sizes):
        held += n + 1
        if held > _CHARS:
            yield start, k + 1 - start
            start, held = k + 1, 0
    if start < len(sizes):
        yield start, len(sizes) - start


def _token_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all tokens' bytes in a row, where each id's begin, their lengths)."""
    by_id = dict(sorted((r, b) for b, r in ranks.items()))
    size = max(by_id, default=-1) + 1
    lengths = np.array([len(by_id.get(k, b"")) for k in range(size)], np.int64)
    return np.frombuffer(b"".join(by_id.values()), np.uint8), np.cumsum(lengths) - lengths, lengths


class _Shared:
    """Ranks of a broadcast, with what a worker process builds from them once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks

    def __reduce__(self):
        return _Shared, (self.ranks,)

    def merger(self) -> Merger:
        if not hasattr(self, "_merger"):
            self._merger = Merger(self.ranks)
        return self._merger

    def tokens(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not hasattr(self, "_tokens"):
            self._tokens = _token_table(self.ranks)
        return self._tokens


def encode(docs: DataFrame, ranks: dict[bytes, int], text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all but the text by default) with ``ids`` and ``offsets``: where each token begins in the text's
    UTF-8 bytes, and their number last. The ranks, the vocabulary's size, are broadcast."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (text_col, "ids", "offsets")]
    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("ids", ints), T.StructField("offsets", ints)])
    shipped = docs.sparkSession.sparkContext.broadcast(_Shared(ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger, (_, _, lengths) = shipped.value.merger(), shipped.value.tokens()
        for b in sliced(batches):
            texts = b.column(text_col).to_pylist()
            for at, n in _parts([len(t or "") for t in texts]):
                ids, counts = encode_texts(texts[at : at + n], merger)
                total = np.append(0, np.cumsum(lengths[ids]))
                ends = np.cumsum(counts)
                starts = ends - counts
                # One offset more than ids a text; each text's begin at 0.
                row = np.repeat(np.arange(n), counts + 1)
                offsets = total[np.arange(len(row)) - row] - total[starts][row]
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(at, n) for c in keep), _lists(ids, counts), _lists(offsets, counts + 1)], names=[*keep, "ids", "offsets"])

    return docs.select(*dict.fromkeys([*keep, text_col])).mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``encoded`` with ``decoded``, the bytes of ``ids`` laid out by ``offsets``; null ids decode to null."""
    schema = T.StructType([*(f for f in encoded.schema.fields if f.name != "decoded"), T.StructField("decoded", T.BinaryType())])
    keep = [c for c in encoded.columns if c != "decoded"]
    shipped = encoded.sparkSession.sparkContext.broadcast(_Shared(ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, place, _ = shipped.value.tokens()
        for b in sliced(batches):
            out = []
            for ids, offsets in zip(b.column("ids"), b.column("offsets")):
                if not ids.is_valid:
                    out.append(None)
                    continue
                i, o = ids.values.to_numpy(), offsets.values.to_numpy()
                at = np.repeat(place[i] - o[:-1], np.diff(o)) + np.arange(o[-1])
                out.append(table[at].tobytes())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(out, pa.binary())], names=[*keep, "decoded"])

    return encoded.select(*keep).mapInArrow(run, schema)


def op12_byte_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    ranks = read_ranks(vocabulary or public_tokenizers.path(VOCABULARY))
    out = decode(encode(read_table(spark, sf_dir, "documents").select("doc_id", "text"), ranks), ranks)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
