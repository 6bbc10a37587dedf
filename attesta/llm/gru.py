"""A gated recurrent language model with a class-factored softmax, in numpy.

Words of the vocabulary lie in classes of CLASS_WORDS by frequency; every other word lies in one of BUCKETS
open classes, by its first two bytes, and has a fixed share of its class's probability.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

WORDS, CLASS_WORDS, BUCKETS, HIDDEN = 1024, 32, 48, 16
CLASSES = WORDS // CLASS_WORDS + BUCKETS
INPUTS = WORDS + BUCKETS
#: Steps of a window of truncated backpropagation, parallel streams of a long text, tokens of a stream at least, step size.
WINDOW, STREAMS, STREAM_TOKENS, RATE = 20, 256, 400, 0.01
#: Rows whose logits are held at once, so that they stay in a processor's cache.
CHUNK = 1024
F32 = np.float32


@functools.cache  # of two bytes at most
def _bucket(start: bytes) -> int:
    return zlib.crc32(start) % BUCKETS


def buckets_of(words: list[bytes]) -> list[int]:
    return [_bucket(w[:2]) for w in words]


@dataclass
class Gru:
    """x: input rows for [z, r, n]; u: hidden to [z, r, n]; c, cb: classes; w, wb: words in their classes."""

    x: np.ndarray
    u: np.ndarray
    c: np.ndarray
    cb: np.ndarray
    w: np.ndarray
    wb: np.ndarray

    NAMES = ("x", "u", "c", "cb", "w", "wb")

    @staticmethod
    def start(counts: np.ndarray, seed: int = 0) -> Gru:
        """Output biases from the counts of the INPUTS words and buckets; small random weights."""
        rng = np.random.default_rng(seed)
        words = counts[:WORDS].reshape(-1, CLASS_WORDS) + 0.5
        classes = np.concatenate((words.sum(axis=1), counts[WORDS:] + 0.5))
        small = lambda *shape: rng.normal(0, 0.1, shape).astype(F32)
        return Gru(small(INPUTS, 3 * HIDDEN), small(HIDDEN, 3 * HIDDEN), small(HIDDEN, CLASSES), np.log(classes / classes.sum()).astype(F32), small(WORDS // CLASS_WORDS, CLASS_WORDS, HIDDEN), np.log(words / words.sum(axis=1, keepdims=True)).astype(F32))

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, k).ravel() for k in self.NAMES])

    def with_flat(self, values: np.ndarray) -> Gru:
        out, at = {}, 0
        for k in self.NAMES:
            old = getattr(self, k)
            out[k] = values[at : at + old.size].reshape(old.shape).astype(F32)
            at += old.size
        return Gru(**out)

    def gates(self) -> tuple[np.ndarray, ...]:
        """x and u of [z, r], and x and u of n, each gate a contiguous array of its own."""
        xs, us = (np.stack(np.split(a, 3, axis=1)) for a in (self.x, self.u))
        return xs[:2], us[:2], xs[2], us[2]

    def states(self, h: np.ndarray, ids: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """For each step of ids (steps x streams) the next state, and what the gradients need of it: z and r, n, n's share of h."""
        x, u, xn, un = self.gates()
        for zr, n in zip(np.take(x, ids, axis=1).swapaxes(0, 1), xn[ids]):
            zr += np.matmul(h, u)
            np.exp(np.negative(zr, out=zr), out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            an = h @ un
            n += zr[1] * an
            np.tanh(n, out=n)
            h = h - n
            h *= zr[0]
            h += n
            yield h, zr, n, an

    def small_logits(self, h: np.ndarray) -> bool:
        """No logit of states h is so large that its exponential, or a sum of them, leaves the range of a float."""
        reach = float(np.abs(h).max(initial=0))
        most = (np.abs(c).sum(axis=axis).max() * reach + np.abs(b).max() for c, b, axis in ((self.c, self.cb, 0), (self.w, self.wb, 2)))
        return max(most) < 80

    def output(self) -> tuple[np.ndarray, np.ndarray]:
        """c and w, each with its biases as one more value of the state, which is 1."""
        return np.concatenate((self.c, self.cb[None])), np.concatenate((self.w, self.wb[:, :, None]), axis=2)

    def log_probs(self, h: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural log of the probability of each target word, or of its open class."""
        out, cls, small = np.empty(len(h), dtype=h.dtype), _classes(targets), self.small_logits(h)
        h, (c_, w_) = _with_ones(h), self.output()
        for at in range(0, len(h), CHUNK):
            part = slice(at, at + CHUNK)
            logits = h[part] @ c_
            out[part] = logits[np.arange(len(logits)), cls[part]] - _log_sum(logits, small)
        for c, i in _by_class(targets, np.flatnonzero(targets < WORDS)):
            inner = h[i] @ w_[c].T
            out[i] += inner[np.arange(len(i)), targets[i] % CLASS_WORDS] - _log_sum(inner, small)
        return out


def _with_ones(h: np.ndarray) -> np.ndarray:
    out = np.ones((len(h), HIDDEN + 1), dtype=h.dtype)
    out[:, :HIDDEN] = h
    return out


def _classes(targets: np.ndarray) -> np.ndarray:
    return np.where(targets < WORDS, targets // CLASS_WORDS, targets - WORDS + WORDS // CLASS_WORDS)


def _by_class(targets: np.ndarray, places: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The places of listed words by their class, one product for each class."""
    cls = (targets[places] // CLASS_WORDS).astype(np.int16)  # short numbers are sorted by their digits
    order = np.argsort(cls, kind="stable")
    bounds = np.searchsorted(cls[order], np.arange(WORDS // CLASS_WORDS + 1))
    for c in range(WORDS // CLASS_WORDS):
        if bounds[c] < bounds[c + 1]:
            yield c, places[order[bounds[c] : bounds[c + 1]]]


def _summed(ids: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Sum of the rows of each id."""
    ids = ids.astype(np.int16)
    order = np.argsort(ids, kind="stable")
    found = ids[order]
    first = np.flatnonzero(np.diff(found, prepend=-1))
    out = np.zeros((size, rows.shape[1]), dtype=rows.dtype)
    out[found[first]] = np.add.reduceat(rows[order], first, axis=0)
    return out


def _exp_sum(logits: np.ndarray, small: bool) -> tuple[np.ndarray, np.ndarray | float]:
    """Sums of the rows' exponentials, which logits become, and what was taken from logits before: nothing where they are small (as
    `small_logits` says), else the greatest of each row."""
    top = 0.0 if small else logits.max(axis=1)
    if not small:
        logits -= top[:, None]
    return np.exp(logits, out=logits) @ np.ones(logits.shape[1], dtype=logits.dtype), top


def _log_sum(logits: np.ndarray, small: bool) -> np.ndarray:
    """Of each row; logits become their exponentials."""
    total, top = _exp_sum(logits, small)
    return np.log(total) + top


def _softmax_loss(logits: np.ndarray, at: np.ndarray, small: bool) -> tuple[float, np.ndarray]:
    """The loss of the picks `at`, one of each row, and what each row is to be divided by: logits become their gradients times that."""
    rows = np.arange(len(at))
    picked = logits[rows, at]
    total, top = _exp_sum(logits, small)
    logits[rows, at] -= total
    return float((np.log(total) + top - picked).sum(dtype=np.float64)), total


def gradients(m: Gru, h0: np.ndarray, ids: np.ndarray, targets: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
    """Gradients of the mean loss of one window (steps x streams), the last state, the loss."""
    steps, streams = ids.shape
    hs, zr, nn, an = map(np.stack, zip(*m.states(h0, ids)))
    before, z, r = np.concatenate((h0[None], hs[:-1])), zr[:, 0], zr[:, 1]
    flat, y = hs.reshape(-1, HIDDEN), targets.reshape(-1)
    n, cls, loss, dflat, small = len(y), _classes(y), 0.0, np.empty_like(flat), m.small_logits(flat)
    (c_, w_), ones = m.output(), _with_ones(flat)
    gc, gw = np.zeros_like(c_), np.zeros_like(w_)
    for at in range(0, n, CHUNK):
        part = slice(at, at + CHUNK)
        hi = ones[part]
        dl = hi @ c_
        lost, total = _softmax_loss(dl, cls[part], small)
        loss += lost
        share = (1 / (n * total))[:, None]  # is taken by the state's few values, not by all logits
        gc += (hi * share).T @ dl
        np.multiply(dl @ m.c.T, share, out=dflat[part])
    for c, i in _by_class(y, np.flatnonzero(y < WORDS)):
        hi = ones[i]
        di = hi @ w_[c].T
        lost, total = _softmax_loss(di, y[i] % CLASS_WORDS, small)
        loss += lost
        share = (1 / (n * total))[:, None]
        gw[c] = di.T @ (hi * share)
        dflat[i] += (di @ m.w[c]) * share
    g = {"c": gc[:HIDDEN], "cb": gc[HIDDEN], "w": gw[:, :, :HIDDEN], "wb": gw[:, :, HIDDEN]}
    # what the gradient of each state is multiplied with, for all steps at once
    by_n = (1 - z) * (1 - nn * nn)
    by_z = (before - nn) * z * (1 - z)
    by_r = an * r * (1 - r)
    dh = np.zeros_like(h0)
    dflat = dflat.reshape(steps, streams, HIDDEN)
    dx, da = (np.empty((steps, streams, 3 * HIDDEN), dtype=flat.dtype) for _ in "xa")
    for t in range(steps - 1, -1, -1):
        dh = dh + dflat[t]
        dn = dh * by_n[t]
        np.multiply(dh, by_z[t], out=da[t, :, :HIDDEN])
        np.multiply(dn, by_r[t], out=da[t, :, HIDDEN : 2 * HIDDEN])
        np.multiply(dn, r[t], out=da[t, :, 2 * HIDDEN :])
        dx[t, :, 2 * HIDDEN :] = dn
        dh *= z[t]
        dh += da[t] @ m.u.T
    dx[:, :, : 2 * HIDDEN] = da[:, :, : 2 * HIDDEN]
    g["u"] = before.reshape(-1, HIDDEN).T @ da.reshape(-1, 3 * HIDDEN)
    g["x"] = _summed(ids.reshape(-1), dx.reshape(-1, 3 * HIDDEN), INPUTS)
    return g, hs[-1], loss / n


def train(m: Gru, stream: np.ndarray, passes: int = 1) -> Gru:
    """Truncated backpropagation over one long sequence of ids, cut into up to STREAMS parallel ones; Adam."""
    streams = max(1, min(STREAMS, (len(stream) - 1) // STREAM_TOKENS))
    length = (len(stream) - 1) // streams
    if length < 1:
        return m
    x = stream[: length * streams].reshape(streams, length).T
    y = stream[1 : length * streams + 1].reshape(streams, length).T
    m = m.with_flat(m.flat())
    mean = {k: np.zeros_like(getattr(m, k)) for k in m.NAMES}
    var = {k: np.zeros_like(getattr(m, k)) for k in m.NAMES}
    updates, total = 0, passes * -(-length // WINDOW)
    for _ in range(passes):
        h = np.zeros((streams, HIDDEN), dtype=F32)
        for at in range(0, length, WINDOW):
            g, h, _ = gradients(m, h, x[at : at + WINDOW], y[at : at + WINDOW])
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            scale = min(1.0, 1.0 / (norm + 1e-9))
            rate = RATE * (1 - 0.9 * updates / max(1, total))
            updates += 1
            for k, v in g.items():
                v = v * F32(scale)
                mean[k] += F32(0.1) * (v - mean[k])
                var[k] += F32(0.01) * (v * v - var[k])
                step = mean[k] / F32(1 - 0.9**updates) / (np.sqrt(var[k] / F32(1 - 0.99**updates)) + F32(1e-6))
                setattr(m, k, getattr(m, k) - F32(rate) * step)
    return m


def score_sequences(m: Gru, sequences: list[np.ndarray], cells: int = 2_000_000, window: int = 32, most: int = 2048) -> np.ndarray:
    """Natural log probability of each sequence of ids, each from the start state (the end id 0 before it).

    The state is carried over windows to the end of the sequence, whatever its length; sequences of like
    length advance together.
    """
    out = np.zeros(len(sequences))
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    at = 0
    while at < len(order):
        longest = max(1, len(sequences[order[at]]))
        some = order[at : at + max(1, min(most, cells // longest))]
        at += len(some)
        lengths = np.array([len(sequences[i]) for i in some])
        ids = np.zeros((longest + 1, len(some)), dtype=np.int32)
        for k, i in enumerate(some):
            ids[1 : lengths[k] + 1, k] = sequences[i]
        h = np.zeros((len(some), HIDDEN), dtype=F32)
        for t0 in range(0, longest, window):
            live = int((lengths > t0).sum())  # lengths descend
            steps = min(window, longest - t0)
            hs = [state[0] for state in m.states(h[:live], ids[t0 : t0 + steps, :live])]
            h = hs[-1]
            valid = (np.arange(t0, t0 + steps)[:, None] < lengths[None, :live]).reshape(-1)
            owner = np.tile(np.arange(live), steps)[valid]
            lp = m.log_probs(np.concatenate(hs)[valid], ids[t0 + 1 : t0 + steps + 1, :live].reshape(-1)[valid])
            out[some] += np.bincount(owner, weights=lp, minlength=len(some))
    return out
