"""A gated recurrent network over word ids in numpy, with a softmax factored into classes.

Ids are ordered by frequency; 0 ends a text and 1 stands for every word outside the vocabulary. Classes
are stretches of ids of about equal sums of root frequency, so frequent words sit in small classes. The
probability of a word is that of its class times that of the word in the class.

Texts run side by side in lanes: a lane takes its next text when one ends, and the state starts anew
there. Inside a text the state is carried from window to window; gradients stop at the window's edge.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

END, OTHER = 0, 1
WINDOW = 16
PRODUCT = 1024  # rows of a product, so that its kernel is the one for small ones
TOP = 60.0  # logits are cut here, so that no exponential overflows


class Shape(NamedTuple):
    vocab: int
    embed: int
    hidden: int
    edges: tuple[int, ...]  # first id of each class, and the size of the vocabulary

    def parts(self) -> list[tuple[str, tuple[int, ...]]]:
        v, d, h, c = self.vocab, self.embed, self.hidden, len(self.edges) - 1
        return [("E", (v, d)), ("Wx", (d, 3 * h)), ("bx", (3 * h,)), ("U", (h, 3 * h)), ("bn", (h,)), ("Wc", (h, c)), ("bc", (c,)), ("Wo", (v, h)), ("bo", (v,))]

    def size(self) -> int:
        return sum(int(np.prod(s)) for _, s in self.parts())


def class_edges(counts: np.ndarray, classes: int) -> tuple[int, ...]:
    root = np.sqrt(np.maximum(counts, 1.0))
    at = np.searchsorted(np.cumsum(root), root.sum() * np.arange(1, classes) / classes)
    return tuple(sorted({0, *(int(i) + 1 for i in at if i + 1 < len(counts)), len(counts)}))


def views(flat: np.ndarray, shape: Shape) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, dims in shape.parts():
        n = int(np.prod(dims))
        out[name] = flat[at:at + n].reshape(dims)
        at += n
    return out


def fresh(shape: Shape, counts: np.ndarray, seed: int = 5) -> np.ndarray:
    """Small random weights; the biases of the softmax give the counted frequencies."""
    rng = np.random.default_rng(seed)
    flat = (rng.standard_normal(shape.size()) * 0.1).astype(np.float32)
    w = views(flat, shape)
    w["U"][:] = rng.standard_normal(w["U"].shape) / np.sqrt(shape.hidden)
    w["bx"][:] = w["bn"][:] = 0
    w["Wo"] *= 0.5
    c = np.maximum(counts, 0.5)
    mass = np.add.reduceat(c, np.array(shape.edges[:-1]))
    w["bc"][:] = np.log(mass / mass.sum())
    w["bo"][:] = np.log(c)
    return flat


class Lanes(NamedTuple):
    ids: np.ndarray  # of all lanes one after the other, so that a long text costs no more room than its words
    starts: np.ndarray
    lengths: np.ndarray  # longest lane first
    texts: np.ndarray  # number of each text in the order of ids


def deal(texts: list[np.ndarray], width: int) -> Lanes:
    """Deal texts to at most ``width`` lanes, longest first, always to the shortest lane."""
    width = max(1, min(width, len(texts)))
    heap = [(0, i) for i in range(width)]
    mine: list[list[int]] = [[] for _ in range(width)]
    for i in sorted(range(len(texts)), key=lambda i: -len(texts[i])):
        n, lane = heapq.heappop(heap)
        mine[lane].append(i)
        heapq.heappush(heap, (n + len(texts[i]), lane))
    by_length = sorted(heap, reverse=True)
    order = np.array([i for _, lane in by_length for i in mine[lane]], np.int64)
    lengths = np.array([n for n, _ in by_length], np.int64)
    return Lanes(np.concatenate([texts[i] for i in order]), np.cumsum(lengths) - lengths, lengths, order)


class Window(NamedTuple):
    inputs: np.ndarray  # (steps, lanes still running); the input of a place is the word before it
    targets: np.ndarray
    places: np.ndarray  # of the targets in Lanes.ids
    valid: np.ndarray  # False beyond a lane's end


def windows(lanes: Lanes) -> Iterator[Window]:
    longest, last = int(lanes.lengths[0]), len(lanes.ids) - 1
    for t in range(0, longest, WINDOW):
        m = int(np.searchsorted(-lanes.lengths, -t, "left"))
        steps = np.arange(t, min(t + WINDOW, longest))[:, None]
        places, valid = np.minimum(lanes.starts[:m] + steps, last), steps < lanes.lengths[:m]
        targets = np.where(valid, lanes.ids[places], END)
        before = lanes.ids[lanes.starts[:m] + t - 1][None] if t else np.full((1, m), END, targets.dtype)
        yield Window(np.concatenate([before, targets[:-1]]), targets, places, valid)


def cut(x: np.ndarray) -> np.ndarray:
    """Numbers beyond ``TOP`` become it, in place; to look for one costs less."""
    if x.size and x.max() > TOP:
        np.minimum(x, TOP, out=x)
    return x


class Softmax(NamedTuple):
    """The places of a window in the order of their targets' classes, and one stretch of numbers: for each place those of its class's words."""

    order: np.ndarray  # places that do not count come last
    classes: np.ndarray  # of the places that count
    words: np.ndarray  # how many words of its class a place has in the stretch; none in a class of one word
    starts: np.ndarray  # and where they begin
    several: np.ndarray  # places with words in the stretch
    own: np.ndarray  # and where their targets stand there
    blocks: list[tuple[int, int, int, int, int]]  # (first place, last, first word, last, beginning) of the classes in the stretch


class Net:
    """Weights at work. Gates lie one behind the other, logits with the places last, and arrays of a window are
    taken up again by the next one: short rows and fresh memory cost more than the numbers in them."""

    def __init__(self, flat: np.ndarray, shape: Shape):
        self.w, self.shape = views(flat, shape), shape
        self.sizes = np.diff(shape.edges)
        self.word_class = np.repeat(np.arange(len(self.sizes)), self.sizes).astype(np.int16)
        self.ones = np.ones(shape.vocab, flat.dtype)
        self.rooms: dict[str, np.ndarray] = {}

    def room(self, name: str, *dims: int) -> np.ndarray:
        """An array for the numbers of one window; what it held before is lost."""
        n = int(np.prod(dims))
        if name not in self.rooms or len(self.rooms[name]) < n:
            self.rooms[name] = np.empty(n, self.ones.dtype)
        return self.rooms[name][:n].reshape(dims)

    def rows_of(self, name: str, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        return rows.take(at, 0, out=self.room(name, len(at), rows.shape[1]), mode="clip")

    def ones_like(self, rows: np.ndarray) -> np.ndarray:
        """One 1 for each row: sums of short rows as products."""
        if len(self.ones) < len(rows):
            self.ones = np.ones(len(rows), self.ones.dtype)
        return self.ones[:len(rows)]

    def prepared(self) -> tuple[np.ndarray, np.ndarray]:
        """Recurrent weights and input gates of every word, (gate, ..., hidden); halved where a sigmoid is taken by a tanh."""
        w, size = self.w, self.shape.hidden
        u = w["U"].reshape(size, 3, size).transpose(1, 0, 2).copy()
        table = (w["E"] @ w["Wx"] + w["bx"]).reshape(-1, 3, size).transpose(1, 0, 2).copy()
        u[:2] *= 0.5
        table[:2] *= 0.5
        return u, table

    def states(self, h: np.ndarray, inputs: np.ndarray, u: np.ndarray, table: np.ndarray, kept: list | None = None) -> np.ndarray:
        """Hidden states after each input, (window, lanes, hidden), up to the next call; ``kept`` takes what gradients need of all steps."""
        size = self.shape.hidden
        before, out = self.room("before", *inputs.shape, size), self.room("states", *inputs.shape, size)
        gates, told = self.room("gates", 3, *inputs.shape, size), self.room("told", 3, *inputs.shape, size)
        table.take(inputs.ravel(), 1, out=gates.reshape(3, -1, size), mode="clip")
        bn = np.tile(self.w["bn"], (inputs.shape[1], 1))
        ends = inputs == END
        for t, any_ends in enumerate(ends.any(1)):
            before[t] = h
            h = before[t]
            if any_ends:
                h[ends[t]] = 0
            g = np.matmul(h, u, out=told[:, t])
            rz, q, n = gates[:2, t], g[2], gates[2, t]
            rz += g[:2]
            np.tanh(rz, out=rz)
            rz *= 0.5
            rz += 0.5
            q += bn
            n += rz[0] * q
            np.tanh(n, out=n)
            h = np.subtract(h, n, out=out[t])
            h *= rz[1]
            h += n
        if kept is not None:
            kept += [before, gates, told]
        return out

    def softmax(self, targets: np.ndarray, valid: np.ndarray) -> Softmax:
        cls = np.where(valid, self.word_class[targets], np.int16(len(self.sizes)))
        order = np.argsort(cls, kind="stable")
        cls = cls[order]
        edges = np.searchsorted(cls, np.arange(len(self.sizes) + 1, dtype=np.int16))
        many, lows = int(edges[-1]), self.shape.edges
        cls, targets = cls[:many], targets[order[:many]]
        words = np.where(self.sizes > 1, self.sizes, 0)[cls]
        starts = np.cumsum(words) - words
        several = np.flatnonzero(words)
        own = starts[several] + targets[several] - np.array(lows)[cls[several]]
        met = np.flatnonzero((edges[1:] > edges[:-1]) & (self.sizes > 1))
        blocks = [(a, b, lows[c], lows[c + 1], at) for c, a, b, at in
                  zip(met.tolist(), edges[met].tolist(), edges[met + 1].tolist(), starts[edges[met]].tolist(), strict=True)]
        return Softmax(order, cls, words, starts, several, own, blocks)

    def sorted_states(self, h: np.ndarray, s: Softmax) -> np.ndarray:
        """States of the places that count, and a 1 for the biases."""
        here = self.room("here", len(s.classes), h.shape[1] + 1)
        here[:, :-1] = self.rows_of("rows", h, s.order[:len(here)])
        here[:, -1] = 1
        return here

    def class_logits(self, here: np.ndarray) -> np.ndarray:
        """(class, place) of sorted states."""
        x, weights = self.room("classes", len(self.sizes), len(here)), np.vstack([self.w["Wc"], self.w["bc"]])
        for i in range(0, len(here), PRODUCT):
            np.matmul(weights.T, here[i:i + PRODUCT].T, out=x[:, i:i + PRODUCT])
        return cut(x)

    def word_logits(self, here: np.ndarray, s: Softmax) -> tuple[np.ndarray, list[np.ndarray]]:
        """The stretch, and its block (place, word) for each class."""
        weights = np.vstack([self.w["Wo"].T, self.w["bo"]])
        stretch = self.room("stretch", int(s.words.sum()))
        blocks = []
        for a, b, low, high, at in s.blocks:
            x = stretch[at:at + (b - a) * (high - low)].reshape(b - a, high - low)
            blocks.append(np.matmul(here[a:b], weights[:, low:high], out=x))
        return cut(stretch), blocks

    def word_sums(self, stretch: np.ndarray, s: Softmax) -> np.ndarray:
        """Sum over its words for each place of the stretch."""
        return np.add.reduceat(stretch, s.starts[s.several]) if len(stretch) else stretch

    def log_probs(self, h: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural log probability of each target after its hidden state."""
        s = self.softmax(targets, np.True_)
        here = self.sorted_states(h, s)
        x = self.class_logits(here)
        logs = x[s.classes, np.arange(len(here))]
        logs -= np.log(np.exp(x, out=x).sum(0))
        stretch, _ = self.word_logits(here, s)
        own = stretch[s.own]
        logs[s.several] += own - np.log(self.word_sums(np.exp(stretch, out=stretch), s))
        out = np.empty_like(logs)
        out[s.order] = logs
        return out

    def score(self, texts: list[np.ndarray], width: int = 256) -> np.ndarray:
        """Natural log probability of each whole text (ids closed by END), the state carried through it."""
        if not texts:
            return np.zeros(0)
        lanes = deal(texts, width)
        u, table = self.prepared()
        h = np.zeros((len(lanes.lengths), self.shape.hidden), table.dtype)
        logs = np.zeros(len(lanes.ids), table.dtype)
        for x in windows(lanes):
            states = self.states(h[:x.inputs.shape[1]], x.inputs, u, table)
            h = states[-1]
            found = self.log_probs(states.reshape(-1, self.shape.hidden), x.targets.ravel()).reshape(x.targets.shape)
            if x.valid.all():
                logs[x.places] = found
            else:
                logs[x.places[x.valid]] = found[x.valid]
        sizes = np.array([len(texts[i]) for i in lanes.texts])
        out = np.zeros(len(texts))
        out[lanes.texts] = np.add.reduceat(logs, np.cumsum(sizes) - sizes, dtype=np.float64)
        return out

    def gradient(self, h: np.ndarray, window: Window, grad: dict[str, np.ndarray]) -> np.ndarray:
        """Fill ``grad`` for one window; returns the state to carry on with."""
        inputs, targets, _, valid = window
        w, size, dims = self.w, self.shape.hidden, (*inputs.shape, self.shape.hidden)
        u, table = self.prepared()
        kept: list[np.ndarray] = []
        flat = self.states(h, inputs, u, table, kept).reshape(-1, size)
        s = self.softmax(targets.ravel(), valid.ravel())
        here = self.sorted_states(flat, s)
        many = len(here)
        share = h.dtype.type(1.0 / max(1, many))
        # the softmax over classes, then the one inside each class
        d = self.class_logits(here)
        np.exp(d, out=d)
        d *= share / d.sum(0)
        d[s.classes, np.arange(many)] -= share
        both = (d @ here).T
        grad["Wc"][:], grad["bc"][:] = both[:-1], both[-1]
        slope, inner = self.room("slope", *flat.shape), self.room("inner", *flat.shape)
        slope[many:] = 0
        np.matmul(d.T, w["Wc"].T, out=slope[:many])
        stretch, blocks = self.word_logits(here, s)
        np.exp(stretch, out=stretch)
        stretch *= np.repeat(share / self.word_sums(stretch, s), s.words[s.several])
        stretch[s.own] -= share
        both = self.room("both", self.shape.vocab, size + 1)
        both[:] = inner[:] = 0
        for (a, b, low, high, _), p in zip(s.blocks, blocks, strict=True):
            np.matmul(p.T, here[a:b], out=both[low:high])
            np.matmul(p, w["Wo"][low:high], out=inner[a:b])
        grad["Wo"][:], grad["bo"][:] = both[:, :-1], both[:, -1]
        slope += inner
        back_to = np.empty_like(s.order)
        back_to[s.order] = np.arange(len(back_to))
        dh = self.rows_of("dh", slope, back_to).reshape(dims)
        # back through the window; what needs no carried gradient is taken for all steps at once
        before, (r, z, n), told = kept
        to_z, to_n, to_r = told  # what gradients are multiplied by; the last holds the state's part of its gate
        rest = np.subtract(1, z, out=self.room("rest", *dims))
        np.subtract(1, np.multiply(n, n, out=to_n), out=to_n)
        to_n *= rest
        np.subtract(before, n, out=to_z)
        to_z *= z
        to_z *= rest
        to_r *= r
        to_r *= np.subtract(1, r, out=rest)
        carry = np.zeros_like(h)
        back = w["U"].reshape(size, 3, size).transpose(1, 2, 0)[[1, 2, 0]]
        ends = inputs == END
        some = ends.any(1)
        for t in range(len(inputs) - 1, -1, -1):
            # gradients take the room of what they are made of: dn that of n, dr and dz of their factors, dq of dn's factor
            total = dh[t]
            total += carry
            dn = np.multiply(total, to_n[t], out=n[t])
            np.multiply(dn, to_r[t], out=to_r[t])
            np.multiply(total, to_z[t], out=to_z[t])
            np.multiply(dn, r[t], out=to_n[t])
            carry = np.multiply(total, z[t], out=total)
            for part in told[:, t] @ back:
                carry += part
            if some[t]:
                carry[ends[t]] = 0
        dz, dq, dr = told
        gu = np.matmul(before.transpose(0, 2, 1), told).sum(1)
        grad["U"][:] = np.concatenate([gu[2], gu[0], gu[1]], axis=1)
        grad["bn"][:] = self.ones_like(flat) @ dq.reshape(-1, size)
        words = inputs.ravel()
        put = self.rows_of("put", w["E"], words)
        ge = self.room("ge", *put.shape)
        for i, part in enumerate((dr, dz, n)):
            part = part.reshape(-1, size)
            at = slice(i * size, (i + 1) * size)
            grad["Wx"][:, at], grad["bx"][at] = put.T @ part, self.ones_like(part) @ part
            if i:
                ge += np.matmul(part, w["Wx"][:, at].T, out=self.room("more", *put.shape))
            else:
                np.matmul(part, w["Wx"][:, at].T, out=ge)
        order = np.argsort(words.astype(np.int16) if self.shape.vocab < 1 << 15 else words, kind="stable")
        ordered = words[order]
        starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        grad["E"][:] = 0
        grad["E"][ordered[starts]] = np.add.reduceat(self.rows_of("put", ge, order), starts, axis=0)
        return self.room("states", *dims)[-1].copy()


def train(flat: np.ndarray, shape: Shape, chunks: Iterator[list[np.ndarray]], rate: float, width: int = 256) -> tuple[np.ndarray, int]:
    """Adam over all windows of all texts; returns the new weights and the number of words seen."""
    flat = flat.copy()
    net, grad = Net(flat, shape), np.zeros_like(flat)
    parts = views(grad, shape)
    first, second, step, seen = np.zeros_like(flat), np.zeros_like(flat), 0, 0
    for texts in chunks:
        total = sum(len(t) for t in texts)
        if not total:
            continue
        # few words: narrower lanes, so that there are steps enough to learn from
        lanes = deal(texts, max(8, min(width, total // (WINDOW * 100))))
        h = np.zeros((len(lanes.lengths), shape.hidden), flat.dtype)
        for window in windows(lanes):
            h = net.gradient(h[:window.inputs.shape[1]], window, parts)
            norm = float(np.sqrt(np.dot(grad, grad)))
            if norm > 1.0:
                np.multiply(grad, np.float32(1.0 / norm), out=grad)
            step += 1
            first += 0.1 * (grad - first)
            np.multiply(grad, grad, out=grad)
            second += 0.01 * (grad - second)
            pace = np.float32(rate * np.sqrt(1 - 0.99 ** step) / (1 - 0.9 ** step))
            flat -= pace * first / (np.sqrt(second) + 1e-8)
        seen += total
    return flat, seen
