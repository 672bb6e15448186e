"""A gated recurrent language model in numpy: truncated backpropagation, class-factored softmax, carried state.

The vocabulary's words lie in classes of equal size; P(word) = P(class | state) P(word | class, state). One more class
stands for all rarer words, whose share inside it comes from outside the network. Before training the biases hold the
unigram distribution, so that the network starts as the unigram model and can only learn from there.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

PER_CLASS = 64
_CHUNK = 1024
#: Documents that advance side by side in scoring: their states stay in a core's cache.
_ABREAST = 1024
#: Input ids beyond the vocabulary: rarer words by the hash of their last bytes.
SUFFIXES = 256


@dataclass
class Shape:
    words: int
    hidden: int = 16
    embed: int = 16

    @property
    def classes(self) -> int:
        return -(-self.words // PER_CLASS)

    def parts(self) -> dict[str, tuple[int, ...]]:
        h, k, c = self.hidden, self.embed, self.classes
        return {"e": (self.words + SUFFIXES, k), "wx": (k, 3 * h), "bx": (3 * h,), "ug": (h, 2 * h), "uc": (h, h), "wk": (h, c + 1), "bk": (c + 1,), "wo": (c, h, PER_CLASS), "bo": (c, PER_CLASS)}


@dataclass
class GruModel:
    shape: Shape
    flat: np.ndarray
    part: dict[str, np.ndarray] = field(init=False, repr=False)

    def __post_init__(self) -> None:
        self.flat = np.ascontiguousarray(self.flat, np.float32)
        self.part = _views(self.flat, self.shape)

    @classmethod
    def start(cls, counts: np.ndarray, rare: float, hidden: int = 16, embed: int = 16, seed: int = 11) -> GruModel:
        """From the vocabulary's ``counts``, in rank order, and the rarer words' total."""
        shape = Shape(len(counts), hidden, embed)
        model = cls(shape, np.zeros(sum(int(np.prod(s)) for s in shape.parts().values()), np.float32))
        rng, p = np.random.default_rng(seed), model.part
        for name, scale in (("e", 0.3), ("wx", embed**-0.5), ("ug", hidden**-0.5), ("uc", hidden**-0.5)):
            p[name][...] = rng.normal(0, scale, p[name].shape)
        padded = np.full(shape.classes * PER_CLASS, 0.0)
        padded[: len(counts)] = counts
        grid = padded.reshape(shape.classes, PER_CLASS)
        with np.errstate(divide="ignore"):
            p["bo"][...] = np.maximum(np.log(grid), -60) - np.log(np.maximum(grid.sum(1, keepdims=True), 1e-9))
        kinds = np.log(np.append(grid.sum(1), rare) + 0.5)
        p["bk"][...] = kinds - kinds.max()
        return model

    def inputs(self) -> np.ndarray:
        """What each input id adds to the gates."""
        return self.part["e"] @ self.part["wx"] + self.part["bx"]

    def advance(self, h: np.ndarray, x: np.ndarray) -> None:
        """The next states, in the place of ``h``; ``x``: what the inputs add to the gates."""
        n = self.shape.hidden
        self._advance(h, _blocks(x, n), _blocks(self.part["ug"], n))

    def _advance(self, h: np.ndarray, x: np.ndarray, ug: np.ndarray) -> None:
        """``advance`` on blocks of their own for the two gates and the candidate."""
        g = np.matmul(h, ug)
        g += x[:2]
        _sigmoid(g, out=g)
        g[1] *= h
        c = g[1] @ self.part["uc"]
        c += x[2]
        _tanh(c, out=c)
        c -= h
        c *= g[0]
        h += c

    def token_logp(self, states: np.ndarray, targets: np.ndarray, grad: dict[str, np.ndarray] | None = None) -> tuple[np.ndarray | None, np.ndarray | None]:
        """ln P(target | state) and None; targets are word ranks, ``shape.words`` and more for the rare class, or -1 for no token.

        With ``grad``, adds the gradients of the negative sum there and returns None and those of the states.
        """
        p, n_classes, width = self.part, self.shape.classes, self.shape.hidden
        kind = np.where((targets >= 0) & (targets < self.shape.words), targets // PER_CLASS, n_classes)
        order = _sorted(kind)
        kind, targets = kind[order], targets[order]
        cuts, inner, none = np.searchsorted(kind, np.arange(n_classes + 1)).tolist(), targets % PER_CLASS, targets < 0
        # A column of ones carries the biases through the products. Biases start at most at 0 and states lie in (-1, 1),
        # so no row needs a shift of its own; should weights ever grow far, the bound keeps exp finite.
        s = np.ones((len(states), width + 1), np.float32)
        s[:, :width] = states.take(order, axis=0)
        wk = np.concatenate((p["wk"], p["bk"][None]))
        wo = np.concatenate((p["wo"], p["bo"][:, None]), 1)
        bounded = max(np.abs(p["wk"]).sum(0).max(initial=0), np.abs(p["wo"]).sum(1).max(initial=0)) + max(0.0, p["bk"].max(), p["bo"].max(initial=0)) < 80
        result = np.zeros(len(s)) if grad is None else np.zeros_like(states)
        counted, ones = np.arange(_CHUNK), np.ones((max(PER_CLASS, n_classes + 1), 1), np.float32)

        def softmax(first: int, end: int, w: np.ndarray, chosen: np.ndarray, back: np.ndarray, into: np.ndarray | None) -> None:
            for lo in range(first, end, _CHUNK):  # small enough to stay in a core's cache
                part = slice(lo, min(end, lo + _CHUNK))
                z = s[part] @ w
                if not bounded:
                    np.minimum(z, 80, out=z)
                at = counted[: len(z)], chosen[part]
                own = z[at] if into is None else None
                np.exp(z, out=z)
                total = z @ ones[: z.shape[1]]
                if into is None:
                    result[part] += own - np.log(total[:, 0])
                    continue
                z *= 1 / total
                z[at] -= 1
                if w is wk and none[part].any():
                    z[none[part]] = 0
                into += z.T @ s[part]
                result[part] += z @ back

        g_kind, g_word = np.zeros((n_classes + 1, width + 1), np.float32), np.zeros((n_classes, PER_CLASS, width + 1), np.float32)
        softmax(0, len(s), wk, kind, p["wk"].T, None if grad is None else g_kind)
        for c in range(n_classes):
            softmax(cuts[c], cuts[c + 1], wo[c], inner, p["wo"][c].T, None if grad is None else g_word[c])
        if grad is not None:
            grad["wk"] += g_kind[:, :width].T
            grad["bk"] += g_kind[:, width]
            grad["wo"] += g_word[:, :, :width].swapaxes(1, 2)
            grad["bo"] += g_word[:, :, width]
        back = np.empty_like(result)
        back[order] = result
        return (back, None) if grad is None else (None, back)

    def score(self, documents: list[tuple[np.ndarray, np.ndarray]], at_once: int = 65_536) -> np.ndarray:
        """ln P of each document, given as (input ids, target ids); the state is carried over the whole document.

        Documents of about equal length advance side by side, the longest first, in windows of about ``at_once`` tokens: the fewer
        are left, the more steps a window has."""
        result, order = np.zeros(len(documents)), np.argsort([-len(x) for x, _ in documents], kind="stable")
        table, ug = _blocks(self.inputs(), self.shape.hidden), _blocks(self.part["ug"], self.shape.hidden)
        for lo in range(0, len(order), _ABREAST):
            own = order[lo : lo + _ABREAST]
            result[own] = self._score_sorted([documents[k] for k in own.tolist()], table, ug, at_once)
        return result

    def _score_sorted(self, documents: list[tuple[np.ndarray, np.ndarray]], table: np.ndarray, ug: np.ndarray, at_once: int) -> np.ndarray:
        out = np.zeros(len(documents))
        lengths = np.array([len(x) for x, _ in documents], np.int64)
        starts = np.cumsum(lengths) - lengths
        x_all, y_all = (np.concatenate([d[k] for d in documents], dtype=np.int32) for k in (0, 1))
        h, longest, t0 = np.zeros((len(documents), self.shape.hidden), np.float32), int(lengths[0]), 0
        while t0 < longest:
            left = int(np.searchsorted(-lengths, -t0, side="left"))  # documents longer than t0
            times = np.arange(t0, min(longest, t0 + max(8, at_once // left)))
            wide = np.searchsorted(-lengths[:left], -times, side="left")
            h, ends = h[:left].copy(), np.cumsum(wide)
            owner = np.arange(ends[-1]) - np.repeat(ends - wide, wide)
            at = starts[owner] + np.repeat(times, wide)
            x, target = table.take(x_all[at], axis=1), y_all[at]
            states, place = np.empty((len(at), self.shape.hidden), np.float32), 0
            for m in wide.tolist():
                states[place : place + m] = h[:m]
                self._advance(h[:m], x[:, place : place + m], ug)
                place += m
            out[:left] += np.bincount(owner, self.token_logp(states, target)[0], left)
            t0 = int(times[-1]) + 1
        return out


def _sigmoid(x: np.ndarray, out: np.ndarray, scale: float = 1) -> np.ndarray:
    """By exp, which numpy computes several times faster than tanh; the bound keeps it finite."""
    np.multiply(x, -scale, out=out)
    np.minimum(out, 80, out=out)
    np.exp(out, out=out)
    out += 1
    return np.reciprocal(out, out=out)


def _tanh(x: np.ndarray, out: np.ndarray) -> np.ndarray:
    _sigmoid(x, out, 2)
    out *= 2
    out -= 1
    return out


def _blocks(rows: np.ndarray, n: int) -> np.ndarray:
    """(rows, k * n) as k arrays of n columns, each in one piece."""
    return np.ascontiguousarray(rows.reshape(len(rows), -1, n).swapaxes(0, 1))


def _sorted(keys: np.ndarray) -> np.ndarray:
    """Stable order of small non-negative keys; 16-bit ones are sorted by radix."""
    return np.argsort(keys.astype(np.uint16) if len(keys) and keys.max() < 65536 else keys, kind="stable")


def _views(flat: np.ndarray, shape: Shape) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, size in shape.parts().items():
        n = int(np.prod(size))
        out[name] = flat[at : at + n].reshape(size)
        at += n
    return out


class Trainer:
    """Adam over truncated windows; ``lanes`` streams of documents, states carried from window to window."""

    def __init__(self, model: GruModel, lanes: int = 512, steps: int = 32, rate: float = 3e-3):
        self.model, self.lanes, self.steps, self.rate = model, lanes, steps, rate
        self.m, self.v, self.t = np.zeros_like(model.flat), np.zeros_like(model.flat), 0
        self.grad = np.zeros_like(model.flat)
        self.views = _views(self.grad, model.shape)
        self.tokens = 0

    def feed(self, documents: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """One pass over the documents, laid end to end and cut into equal lanes; a document's start clears the state.

        The last lane is filled up with targets of -1, which teach nothing.
        """
        x, y = (np.concatenate([np.zeros(0, np.int32), *(d[k] for d in documents)], dtype=np.int32) for k in (0, 1))
        fresh = np.zeros(len(x), np.float32)
        if len(x):
            fresh[np.cumsum([0, *(len(d[0]) for d in documents if len(d[0]))])[:-1]] = 1
        if not len(x):
            return
        self.tokens += len(x)
        lanes = max(1, min(self.lanes, len(x) // self.steps))
        length = -(-len(x) // lanes)
        grid = lambda a, rest: np.append(a, np.full(lanes * length - len(a), rest, a.dtype)).reshape(lanes, length)
        x, y, keep = grid(x, 0), grid(y, -1), 1 - grid(fresh, 1)
        h = np.zeros((lanes, self.model.shape.hidden), np.float32)
        for at in range(0, length, self.steps):
            h = self._window(x[:, at : at + self.steps], y[:, at : at + self.steps], keep[:, at : at + self.steps], h)

    def _window(self, x: np.ndarray, y: np.ndarray, keep: np.ndarray, h: np.ndarray) -> np.ndarray:
        p, n = self.model.part, self.model.shape.hidden
        lanes, steps = x.shape
        ids = np.ascontiguousarray(x.T).reshape(-1)
        embedded = p["e"].take(ids, axis=0)
        # The two gates and the candidate have arrays of their own.
        wx, ug, uc = _blocks(p["wx"], n), _blocks(p["ug"], n), p["uc"]
        x_all = np.matmul(embedded, wx).reshape(3, steps, lanes * n)
        x_all += np.tile(p["bx"].reshape(3, 1, n), lanes)
        x_all, cleared = x_all.reshape(3, steps, lanes, n), [np.flatnonzero(k == 0) for k in keep.T]
        s_all, rs_all, c_all = (np.empty((steps, lanes, n), np.float32) for _ in range(3))
        g_all = np.empty((steps, 2, lanes, n), np.float32)
        for t in range(steps):
            s, g, rs, c = s_all[t], g_all[t], rs_all[t], c_all[t]
            s[:] = h
            s[cleared[t]] = 0
            np.matmul(s, ug, out=g)
            g += x_all[:2, t]
            _sigmoid(g, out=g)
            np.multiply(g[1], s, out=rs)
            np.matmul(rs, uc, out=c)
            c += x_all[2, t]
            _tanh(c, out=c)
            h = c - s
            h *= g[0]
            h += s
        self.grad[:] = 0
        _, ds = self.model.token_logp(s_all.reshape(-1, n), y.T.reshape(-1), self.views)
        ds, d_all = ds.reshape(steps, lanes, n), x_all  # its place is taken over
        uc, ug = np.ascontiguousarray(uc.T), np.ascontiguousarray(ug.swapaxes(1, 2))
        dh = np.zeros_like(h)
        for t in range(steps - 1, -1, -1):
            s, z, r, c, dz, dr, dc = s_all[t], g_all[t, 0], g_all[t, 1], c_all[t], d_all[0, t], d_all[1, t], d_all[2, t]
            np.multiply(dh, z, out=dc)
            dh -= dc
            np.subtract(c, s, out=dz)
            dz *= dc
            up = 1 - z
            dz *= up
            np.multiply(c, c, out=up)
            up *= dc
            dc -= up
            drs = dc @ uc
            np.multiply(drs, s, out=dr)
            dr *= r
            np.subtract(1, r, out=up)
            dr *= up
            drs *= r
            dh += drs
            dh += np.matmul(dz, ug[0], out=up)
            dh += np.matmul(dr, ug[1], out=up)
            dh += ds[t]
            dh[cleared[t]] = 0
        g, d_all, s_all = self.views, d_all.reshape(3, -1, n), s_all.reshape(-1, n)
        g["ug"] += np.concatenate(np.matmul(s_all.T, d_all[:2]), 1)
        g["uc"] += rs_all.reshape(-1, n).T @ d_all[2]
        g["bx"] += (np.ones((1, len(s_all)), np.float32) @ d_all).reshape(-1)
        g["wx"] += np.concatenate(np.matmul(embedded.T, d_all), 1)
        de = np.matmul(d_all, wx.swapaxes(1, 2)).sum(0)
        for k in range(de.shape[1]):
            g["e"][:, k] += np.bincount(ids, de[:, k], len(g["e"]))
        self._adam(1 / max(1, int((y >= 0).sum())))
        return h

    def _adam(self, scale: float) -> None:
        self.t += 1
        g = self.grad
        g *= scale
        norm = float(np.sqrt(g @ g))
        if norm > 1:
            g /= norm
        self.m += 0.1 * (g - self.m)
        self.v += 0.01 * (g * g - self.v)
        self.model.flat -= self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.99**self.t)) + 1e-6)
