"""SentencePiece encoding and decoding with sampled segmentations: Gumbel top-k over the piece lattice.

The vocabulary is that of a public piece model, given by its path; its ids, byte fallback and white-space marks are
kept, so that any sampled sequence decodes to the text. A text is cut where no piece of the vocabulary holds the two
characters on either side, so that no piece could cross; what lies between two cuts is a unit with a lattice of pieces,
and a text's lattice is exactly the chain of its units'. Weights follow the piece's rank in the vocabulary,
log p = -log(rank + ``RANK_SHIFT``), normalised over the lattice by backward sums, so every node's edges carry the exact
conditional probabilities. Lattices are built for the distinct units of a batch of texts together.

``k`` segmentations are drawn without replacement by perturbed A-star search. A region of the search is a set of
segmentations with a known mass, and its perturbed value is a Gumbel at the mass's logarithm, truncated at the value of the
path it was left by. The first path is drawn freely. A path leaves regions: the paths that first differ from it in
one of its units, held together as a bundle. The queue's region of largest value is opened next: a unit is drawn in
proportion to the masses, a different way through that unit too, and the rest of the path is completed freely; what
the region still holds goes back to the queue. The perturbed values come out in falling order, and the (k+1)-th gives
the threshold of the inclusion probabilities. The random stream of a row follows from its key alone, so that lost
tasks repeat exactly, whatever batch a row falls into.

Defined cases: null and empty texts have one empty segmentation; a text with fewer than ``k`` segmentations yields all
of them; equal keys with equal texts yield the same; an empty table gives no rows; extra columns pass through, but for
those that bear the name of an output, which are replaced.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basisweave.llm.common import read_table, unused

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
RANK_SHIFT = 30.0
SPACE_MARK = "▁"
#: Log-weight of a character that has no piece of its own and is written as bytes.
BYTES_WEIGHT = -30.0
#: Characters of text whose lattices are held at a time; a longer text is a batch by itself.
BATCH_CHARS = 300_000
#: Steps through a unit that share one uniform number.
STEPS_A_DRAW = 4

_ALL = 2**64 - 1
_MIX_A, _MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


class PieceTrie:
    """The pieces as a trie in a hash table: (state, character class) -> state; classes number the pieces' characters."""

    def __init__(self, pieces: dict[str, int]):
        letters = sorted({c for p in pieces for c in p})
        self.class_of = np.zeros(0x110000, np.uint16)
        self.class_of[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        own = {c: k for k, c in enumerate(letters, 1)}
        self.bits = np.int64(len(letters) + 1).item().bit_length()
        states: dict[int, int] = {}
        piece_at = [-1]
        self.adjacent = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        for piece, number in pieces.items():
            state = 0
            for c in piece:
                key = state << self.bits | own[c]
                if key not in states:
                    states[key] = len(piece_at)
                    piece_at.append(-1)
                state = states[key]
            piece_at[state] = number
            for a, b in zip(piece, piece[1:]):
                self.adjacent[own[a], own[b]] = True
        self.piece_at = np.array(piece_at, np.int32)
        self.longest = max(map(len, pieces), default=1)
        size = max(4, (8 * len(states)).bit_length())
        self.shift = np.uint64(64 - size)
        self.keys, self.values = np.full((1 << size) + 64, -1, np.int64), np.zeros((1 << size) + 64, np.int32)
        for key, state in states.items():
            slot = (key * int(_MIX_A) % 2**64) >> int(self.shift)
            while self.keys[slot] >= 0:
                slot += 1
            self.keys[slot], self.values[slot] = key, state

    def step(self, state: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """The states after one more character; 0 where no piece goes on."""
        key = state.astype(np.int64) << self.bits | classes
        slot = ((key.view(np.uint64) * _MIX_A) >> self.shift).view(np.int64)
        got = self.keys[slot]
        out = np.where(got == key, self.values[slot], 0)
        open_ = np.flatnonzero((got != key) & (got >= 0))
        while len(open_):
            slot[open_] += 1
            got = self.keys[slot[open_]]
            met = got == key[open_]
            out[open_[met]] = self.values[slot[open_[met]]]
            open_ = open_[~met & (got >= 0)]
        return out


class Vocabulary:
    def __init__(self, model_path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = [model.id_to_piece(k) for k in range(model.get_piece_size())]
        self.byte_ids = np.zeros(256, np.int32)
        self.text_of = [p.replace(SPACE_MARK, " ").encode() for p in pieces]
        known: dict[str, int] = {}
        for k, piece in enumerate(pieces):
            if model.is_byte(k):
                self.byte_ids[int(piece[3:5], 16)] = k
                self.text_of[k] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(k) or model.is_unknown(k)):
                known[piece] = k
        self.trie = PieceTrie(known)
        first = 3 + 256
        self.weight = -np.log(np.maximum(0, np.arange(len(pieces)) - first) + RANK_SHIFT)
        sizes = np.array([len(t) for t in self.text_of], np.int64)
        self.bytes_first, self.bytes_size = np.cumsum(sizes) - sizes, sizes
        self.all_bytes = np.frombuffer(b"".join(self.text_of), np.uint8)

    def decode(self, ids: list[int]) -> str:
        """The text of a piece sequence, without the space that encoding puts first."""
        text_of = self.text_of
        return b"".join([text_of[k] for k in ids])[1:].decode("utf-8", "surrogatepass")

    def decoded_bytes(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of piece sequences laid end to end."""
        return self.all_bytes[_spans(self.bytes_first[ids], self.bytes_size[ids])]


@lru_cache(maxsize=2)
def vocabulary(model_path: str) -> Vocabulary:
    return Vocabulary(model_path)


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of all spans, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


@dataclass
class Units:
    """The units of some texts in order, as classes of distinct ones: ``kind`` numbers them in falling order of length."""

    codes: np.ndarray
    kind: np.ndarray
    size: np.ndarray
    per_text: np.ndarray
    starts: np.ndarray  # of one unit of each kind
    lengths: np.ndarray


def cut_units(held: Vocabulary, texts: list[str | None]) -> Units:
    """Cut where two neighbours stand in no piece. A text gets a leading space; an empty one has no unit."""
    marked = [" " + t if t else "" for t in texts]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    ends = np.cumsum(np.fromiter(map(len, marked), np.int64, len(marked)))
    classes = held.trie.class_of[np.where(codes == 32, ord(SPACE_MARK), np.where(codes == ord(SPACE_MARK), 0, codes))]
    cut = np.ones(len(codes), bool)
    cut[1:] = ~held.trie.adjacent[classes[:-1], classes[1:]]
    cut[ends[:-1][ends[:-1] < len(codes)]] = True
    starts = np.flatnonzero(cut)
    size = np.diff(np.append(starts, len(codes)))
    # Polynomial hashes of all units at once; equal units share one lattice.
    powers = np.cumprod(np.full(len(codes) + 1, _MIX_B))
    mixed = (codes.astype(np.uint64) + np.uint64(1)) * _MIX_A
    mixed ^= mixed >> np.uint64(29)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed * powers[: len(codes)])))
    # B^(n-start) puts all units' sums to one scale.
    hashes = (sums[starts + size] - sums[starts]) * powers[len(codes) - starts] ^ size.astype(np.uint64)
    _, some, kind = np.unique(hashes, return_index=True, return_inverse=True)
    order = np.argsort(-size[some], kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return Units(codes, rank[kind], size, np.diff(np.searchsorted(starts, np.concatenate(([0], ends)))), starts[some[order]], size[some[order]])


@dataclass
class Lattices:
    """Lattices of units, packed: a node owns a run of edges, an edge leads to a node; node 0 is the end of every unit.

    Nodes at the same distance from their unit's end lie together: ``at[d] + kind``. A node's longest edge comes first.
    """

    at: np.ndarray
    first: np.ndarray
    piece: np.ndarray
    to: np.ndarray
    p: np.ndarray
    byte_ids: np.ndarray

    @classmethod
    def build(cls, held: Vocabulary, units: Units) -> Lattices:
        """A character without a piece is one edge, its piece -1 - code. A mark in the text has no piece."""
        longest = int(units.lengths[0]) if len(units.lengths) else 0
        n_at = np.searchsorted(-units.lengths, -np.arange(1, longest + 1), side="right")
        at = np.concatenate(([0, 1], 1 + np.cumsum(n_at)))
        n_nodes = int(at[-1])
        to_end = np.repeat(np.arange(1, longest + 1), n_at)
        kind = np.arange(1, n_nodes) - at[to_end]
        code = np.zeros(n_nodes, np.int64)
        code[1:] = units.codes[units.starts[kind] + units.lengths[kind] - to_end]
        classes = held.trie.class_of[np.where(code == 32, ord(SPACE_MARK), np.where(code == ord(SPACE_MARK), 0, code))].astype(np.int64)
        node, state = np.arange(1, n_nodes), np.zeros(n_nodes - 1, np.int32)
        found, count = [], np.zeros(n_nodes + 1, np.int64)
        for width in range(1, held.trie.longest + 1):
            state = held.trie.step(state, classes[at[to_end - width + 1] + kind])
            piece = held.trie.piece_at[state]
            piece = np.where(state > 0, piece, -1)
            real = np.flatnonzero(piece >= 0) if width > 1 else np.arange(len(node))
            if width == 1:
                piece = np.where(piece >= 0, piece, -1 - code[node])
            own = node[real]
            target = at[to_end[real] - width] + kind[real]
            found.append((own, piece[real], np.where(to_end[real] > width, target, 0)))
            count[own] += 1
            going = np.flatnonzero((state > 0) & (to_end > width))
            node, state, to_end, kind = node[going], state[going], to_end[going], kind[going]
            if not len(node):
                break
        first = np.concatenate(([0], np.cumsum(count[:n_nodes])))
        pieces, to, place = np.zeros(first[-1], np.int64), np.zeros(first[-1], np.int64), first[1:].copy()
        for own, piece, target in found:
            place[own] -= 1
            pieces[place[own]], to[place[own]] = piece, target
        weight = np.where(pieces >= 0, held.weight[np.maximum(pieces, 0)], BYTES_WEIGHT)
        p, back = np.zeros(len(pieces)), np.zeros(n_nodes)
        for d in range(1, longest + 1):
            lo, hi = at[d], at[d + 1]
            heads = first[lo:hi] - first[lo]
            score = weight[first[lo] : first[hi]] + back[to[first[lo] : first[hi]]]
            base = score[first[lo + 1 : hi + 1] - 1 - first[lo]]  # the one-character edge, present everywhere
            part = np.exp(score - np.repeat(base, count[lo:hi]))
            total = np.add.reduceat(part, heads)
            back[lo:hi] = base + np.log(total)
            p[first[lo] : first[hi]] = part / np.repeat(total, count[lo:hi])
        return cls(at, first, pieces, to, p, held.byte_ids)

    def draw(self, node: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An edge of each node by its probability, and what is left of the uniform number, stretched to (0, 1) again."""
        edge, last = self.first[node], self.first[node + 1] - 1
        p, left = self.p[edge], u.copy()
        going = np.flatnonzero((left >= p) & (edge < last))
        while len(going):
            left[going] -= p[going]
            edge[going] += 1
            p[going] = self.p[edge[going]]
            going = going[(left[going] >= p[going]) & (edge[going] < last[going])]
        return edge, np.clip(left / p, 2.0**-53, 1 - 2.0**-53)

    def walk(self, nodes: np.ndarray, seed: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(edges, edges per node, log-probabilities) of one path from each node to its unit's end; ``number``: the unit's counter."""
        at, node = np.flatnonzero(nodes > 0), nodes[nodes > 0]
        found, sizes, logp, depth = [], np.zeros(len(nodes), np.int64), np.zeros(len(nodes)), 0
        u = np.zeros(0)
        while len(at):
            if depth % STEPS_A_DRAW == 0:
                u = uniforms(seed[at], number[at], depth // STEPS_A_DRAW)
            edge, u = self.draw(node, u)
            found.append((at, edge))
            sizes[at] += 1
            logp[at] += np.log(self.p[edge])
            node = self.to[edge]
            going = np.flatnonzero(node > 0)
            at, node, u, depth = at[going], node[going], u[going], depth + 1
        place = np.cumsum(sizes) - sizes
        out = np.zeros(int(sizes.sum()), np.int64)
        for k, (at, edge) in enumerate(found):
            out[place[at] + k] = edge
        return out, sizes, logp

    def deviations(self, node: int, taken: list[list[int]]) -> list[tuple[float, int, int, int]]:
        """(mass, way, depth, edge): the edges that leave the paths ``taken`` through a unit that begins at ``node``, after
        ``depth`` edges of that way."""
        out, open_ = [], [(1.0, 0, node, list(range(len(taken))))]
        while open_:
            mass, depth, node, ways = open_.pop()
            for e in range(int(self.first[node]), int(self.first[node + 1])):
                same = [w for w in ways if taken[w][depth] == e]
                p = mass * float(self.p[e])
                if not same:
                    out.append((p, ways[0], depth, e))
                elif self.to[e] > 0 and p > 0:
                    open_.append((p, depth + 1, int(self.to[e]), same))
        return out

    def piece_ids(self, edges: np.ndarray) -> np.ndarray:
        """Piece ids of a path's edges, bytes written out for characters without a piece."""
        kinds = self.piece[edges]
        odd = np.flatnonzero(kinds < 0)
        if not len(odd):
            return kinds.astype(np.int32)
        parts, done = [], 0
        for k in odd.tolist():
            parts += [kinds[done:k], self.byte_ids[list(chr(-1 - int(kinds[k])).encode("utf-8", "surrogatepass"))]]
            done = k + 1
        return np.concatenate([*parts, kinds[done:]]).astype(np.int32)


def uniforms(seed: np.ndarray, a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """Numbers in (0, 1) that follow from the seed and two counters alone (a 64-bit mixing function)."""
    x = seed + a.astype(np.uint64) * _MIX_A + np.asarray(b).astype(np.uint64) * _MIX_B
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def truncated_gumbel(place: float, bound: float, u: float) -> float:
    """A Gumbel value at ``place``, given that it does not exceed ``bound``; ``u`` uniform."""
    x, y = -bound, math.log(-math.log(u)) - place
    return -(max(x, y) + math.log1p(math.exp(-abs(x - y))))


@dataclass
class Path:
    """Edges of all units, the units' cuts among them, log-probabilities before each unit, and the perturbed value."""

    edges: np.ndarray
    cuts: np.ndarray
    before: np.ndarray
    value: float

    def masses(self, first: int) -> np.ndarray:
        """Mass of the paths that part from this one in each unit from ``first`` on, relative to what goes before ``first``."""
        own = self.before[first:]
        return np.exp(own[:-1] - own[0]) * -np.expm1(np.diff(own))


@dataclass
class Region:
    """Paths that part from ``path`` in a unit from ``first`` on (a bundle), or in unit ``first`` by none of the ways ``taken``."""

    value: float
    path: Path
    first: int
    taken: list[list[int]] = field(default_factory=list)
    removed: list[int] = field(default_factory=list)


class Search:
    """Perturbed A-star search in one text's lattice: the paths found and the queue of regions."""

    def __init__(self, held: Lattices, starts: np.ndarray, seed: int):
        self.held, self.starts, self.seed = held, starts, seed
        self.paths: list[Path] = []
        self.queue: list[Region] = []
        self.numbers = 0

    def uniform(self) -> float:
        """The text's next uniform number."""
        self.numbers += 1
        x = (self.seed + self.numbers * 0x9E3779B97F4A7C15 + 0xA3B195354A39B70D) & _ALL
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _ALL
        x = (x ^ x >> 27) * 0x94D049BB133111EB & _ALL
        return (((x ^ x >> 31) >> 11) + 0.5) * 2.0**-53

    def put(self, log_mass: float, bound: float, path: Path, first: int, taken: list[list[int]] | None = None, removed: list[int] | None = None) -> None:
        if log_mass > -math.inf:
            self.queue.append(Region(truncated_gumbel(log_mass, bound, self.uniform()), path, first, taken or [], removed or []))

    def put_bundle(self, path: Path, first: int, removed: list[int], bound: float) -> None:
        whole = -math.expm1(float(path.before[-1] - path.before[first]))
        m = path.masses(first) if removed else None
        left = whole if m is None else float(np.delete(m, [k - first for k in removed]).sum())
        if left > 0:
            self.put(float(path.before[first]) + math.log(left), bound, path, first, None, removed)

    def put_unit(self, path: Path, unit: int, taken: list[list[int]], bound: float) -> None:
        left = sum(m for m, *_ in self.held.deviations(int(self.starts[unit]), taken))
        if left > 0:
            self.put(float(path.before[unit]) + math.log(left), bound, path, unit, taken)

    def following(self) -> float:
        return max((r.value for r in self.queue), default=-math.inf)

    def open_best(self) -> tuple[Region, int, list[int], int] | None:
        """(region, unit, edges taken in that unit, node to go on from) of the best region; what it still holds is put back later."""
        if not self.queue:
            return None
        best = self.queue.pop(max(range(len(self.queue)), key=lambda k: self.queue[k].value))
        path, unit, taken = best.path, best.first, best.taken
        if not taken:
            m = path.masses(unit)
            m[[k - unit for k in best.removed]] = 0
            c = np.cumsum(m)
            unit += min(int(np.searchsorted(c, self.uniform() * c[-1], side="right")), int(np.flatnonzero(m)[-1]))
            taken = [path.edges[path.cuts[unit] : path.cuts[unit + 1]].tolist()]
            self.put_bundle(path, best.first, [*best.removed, unit], best.value)
        ways = self.held.deviations(int(self.starts[unit]), taken)
        left = self.uniform() * sum(m for m, *_ in ways)
        for m, way, depth, edge in ways:
            left -= m
            if left < 0:
                break
        return Region(best.value, path, unit, taken), unit, [*taken[way][:depth], edge], int(self.held.to[edge])

    def take(self, path: Path, parent: Region | None) -> None:
        """Record a path and queue the regions it leaves."""
        self.paths.append(path)
        first = 0
        if parent is not None:
            own = path.edges[path.cuts[parent.first] : path.cuts[parent.first + 1]].tolist()
            self.put_unit(parent.path, parent.first, [*parent.taken, own], path.value)
            first = parent.first + 1
        if first < len(self.starts):
            self.put_bundle(path, first, [], path.value)


def search_batch(held: Vocabulary, texts: list[str | None], keys: list[str], k: int) -> tuple[Lattices, list[tuple[list[Path], float]]]:
    """Per text: up to ``k`` paths, their perturbed values falling, and the next value after them."""
    units = cut_units(held, texts)
    lattices = Lattices.build(held, units)
    nodes = lattices.at[units.size] + units.kind
    ends = np.cumsum(units.per_text)
    seeds = [xxhash.xxh64_intdigest(key.encode("utf-8", "surrogatepass"), 6) for key in keys]
    searches = [Search(lattices, nodes[e - n : e], s) for e, n, s in zip(ends.tolist(), units.per_text.tolist(), seeds)]
    jobs: list[tuple[Search, Region | None, int, list[int], int, float]] = [(w, None, -1, [], 0, -math.log(-math.log(w.uniform()))) for w in searches]
    for turn in range(k):
        if not jobs:
            break
        # The rest of every text's new path, all texts at once: the branching unit's rest, then whole units.
        tails = [np.concatenate(([node], w.starts[unit + 1 :])) if unit >= 0 else w.starts for w, _, unit, _, node, _ in jobs]
        sizes = np.array([len(t) for t in tails], np.int64)
        numbers = _spans(np.array([max(0, unit) for _, _, unit, _, _, _ in jobs], np.int64), sizes)
        stream = np.repeat(np.array([(w.seed + (turn + 1) * 0xA0761D6478BD642F) % 2**64 for w, *_ in jobs], np.uint64), sizes)
        edges, per_unit, logp = lattices.walk(np.concatenate([np.zeros(0, np.int64), *tails]), stream, numbers)
        unit_ends = np.cumsum(sizes)
        edge_ends = np.concatenate(([0], np.cumsum(per_unit)))
        for (w, parent, unit, head, _, value), hi, n in zip(jobs, unit_ends.tolist(), sizes.tolist()):
            lo = hi - n
            own, cuts, gain = edges[edge_ends[lo] : edge_ends[hi]], edge_ends[lo : hi + 1] - edge_ends[lo], logp[lo:hi]
            if parent is None:
                path = Path(own, cuts, np.concatenate(([0.0], np.cumsum(gain))), value)
            else:
                before, kept = parent.path, int(parent.path.cuts[unit])
                gain = gain.copy()
                gain[0] += float(np.log(lattices.p[head]).sum())
                path = Path(
                    np.concatenate((before.edges[:kept], head, own)),
                    np.concatenate((before.cuts[: unit + 1], cuts[1:] + kept + len(head))),
                    np.concatenate((before.before[: unit + 1], before.before[unit] + np.cumsum(gain))),
                    value,
                )
            w.take(path, parent)
        again = []
        if turn + 1 < k:
            for w, *_ in jobs:
                if (found := w.open_best()) is not None:
                    parent, unit, head, node = found
                    again.append((w, parent, unit, head, node, parent.value))
        jobs = again
    return lattices, [(w.paths, w.following()) for w in searches]


def _batches(texts: list[str | None], chars: int) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of texts with about ``chars`` characters each."""
    lo, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t or "") > chars:
            yield lo, k
            lo, size = k, 0
        size += len(t or "") + 1
    if lo < len(texts):
        yield lo, len(texts)


SAMPLE = "array<struct<ids:array<int>,log_prob:double,perturbed:double,inclusion:double>>"


def sample_segmentations(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", k: int = 2, model_path: str = MODEL_PATH, keep: list[str] | None = None, batch_chars: int = BATCH_CHARS, digests: bool = False) -> DataFrame:
    """``keep`` columns (all by default) with ``samples`` and ``exact``: whether each sample decodes to the text; with ``digests`` also
    ``decoded_sha256``, the hash of what each sample decodes to.

    ``inclusion`` is the probability that a segmentation is among the first ``k``, given the value that follows them.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("samples", "exact", "decoded_sha256")]
    key, text = unused(docs.columns, "key"), unused(docs.columns, "text")
    sample = pa.list_(pa.struct([("ids", pa.list_(pa.int32())), ("log_prob", pa.float64()), ("perturbed", pa.float64()), ("inclusion", pa.float64())]))
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("samples", T._parse_datatype_string(SAMPLE)), T.StructField("exact", T.BooleanType()), *([T.StructField("decoded_sha256", T.ArrayType(T.StringType()))] if digests else [])])

    def rows_of(held: Vocabulary, b: pa.RecordBatch, texts: list[str | None], keys: list[str]) -> pa.RecordBatch:
        lattices, found = search_batch(held, texts, keys, k)
        ids = [lattices.piece_ids(p.edges) for paths, _ in found for p in paths]
        scores = [(float(p.before[-1]), p.value, -math.expm1(-math.exp(min(700.0, p.before[-1] - after))) if after > -math.inf else 1.0) for paths, after in found for p in paths]
        counts = np.array([len(paths) for paths, _ in found], np.int64)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.concatenate([np.zeros(0, np.int32), *ids])
        exact, decoded = _round_trip(held, flat, sizes, counts, texts, digests)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(flat))
        columns = np.array(scores, np.float64).reshape(-1, 3)
        rows = pa.StructArray.from_arrays([lists, *(pa.array(np.ascontiguousarray(columns[:, j])) for j in range(3))], names=["ids", "log_prob", "perturbed", "inclusion"])
        samples = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), rows)
        more = [pa.ListArray.from_arrays(samples.offsets, pa.array(decoded, pa.string()))] if digests else []
        return pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), samples.cast(sample), pa.array(exact), *more], names=[f.name for f in schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = vocabulary(model_path)
        for whole in batches:
            texts, keys = whole.column(text).to_pylist(), [str(v) for v in whole.column(key).to_pylist()]
            for lo, hi in _batches(texts, batch_chars):
                yield rows_of(held, whole.slice(lo, hi - lo), texts[lo:hi], keys[lo:hi])

    keyed = docs.select(*keep, F.col(text_col).alias(text), F.coalesce(F.col(key_col).cast("string"), F.lit("")).alias(key))
    return keyed.mapInArrow(run, schema)


def _round_trip(held: Vocabulary, flat: np.ndarray, sizes: np.ndarray, counts: np.ndarray, texts: list[str | None], digests: bool = False) -> tuple[np.ndarray, list[str]]:
    """Whether all samples of each text decode to it, and, if asked, the hash of what each sample decodes to."""
    wanted = [b" " + t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    got = held.decoded_bytes(flat)
    ends = np.concatenate(([0], np.cumsum(sizes)))
    length = np.concatenate(([0], np.cumsum(held.bytes_size[flat])))[ends]
    out, hashes, at = np.ones(len(texts), bool), [], 0
    for k, (n, w) in enumerate(zip(counts.tolist(), wanted)):
        for s in range(at, at + n):
            own = got[length[s] : length[s + 1]].tobytes()
            out[k] &= own == w
            if digests:
                hashes.append(hashlib.sha256(own[1:]).hexdigest())  # without the blank that the encoding puts first
        at += n
    return out, hashes


def decode_pieces(rows: DataFrame, ids_col: str = "ids", model_path: str = MODEL_PATH) -> DataFrame:
    """``rows`` with ``decoded``, the text of the piece ids; a column of that name is replaced."""
    keep = [c for c in rows.columns if c != "decoded"]
    schema = T.StructType([*rows.select(*keep).schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = vocabulary(model_path)
        for b in batches:
            texts = [None if ids is None else held.decode(ids) for ids in b.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(texts, pa.string())], names=[*keep, "decoded"])

    return rows.mapInArrow(run, schema)


def op6_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sample_segmentations(read_table(spark, sf_dir, "documents").select("doc_id", "text"), k=2, keep=["doc_id"], digests=True)
    rows = out.select("doc_id", "exact", "decoded_sha256", F.posexplode("samples").alias("sample", "s"))
    return rows.select("doc_id", "sample", F.size("s.ids").cast("long").alias("n_pieces"), "s.ids", F.get("decoded_sha256", "sample").alias("decoded_sha256"), "s.log_prob", "s.perturbed", "s.inclusion", F.col("exact").alias("round_trip"))
