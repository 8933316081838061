"""Linear-chain conditional random field over word shapes, in numpy.

Sentences are runs of words; every word emits by its own shape, the shapes
before and after it, and a bucket of its digits; labels chain by a transition
matrix.  Training is exact (forward-backward, full-batch Adam on a small
labelled table); decoding is Viterbi for all sequences of a block at once,
longest first, so that step t works on the sequences that still run.
"""

from __future__ import annotations

import numpy as np

from .tokens import Words, mix

SHAPES = 1 << 12
_U = np.uint64
_DIGIT = np.zeros(256, np.int64)
_DIGIT[48:58] = 1
BUCKETS = 24


def observe(data: np.ndarray, off: np.ndarray):
    """Words of a block, their features (words x 4) and the first words of the sequences (lines)."""
    w = Words(data, off)
    n = len(w.start)
    shape = (mix(w.shapes()) >> _U(52)).astype(np.int64) % (SHAPES - 1) + 1
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    digits = np.minimum(digits[w.end] - digits[w.start], BUCKETS - 1)
    feats = np.zeros((n, 4), np.int32)
    feats[:, 0], feats[:, 3] = shape, digits
    line = np.concatenate([[0], np.cumsum(data == 10)])
    first = np.ones(n, bool)
    if n:
        doc = np.repeat(np.arange(len(off) - 1), np.diff(w.off))
        first[1:] = (line[w.start[1:]] != line[w.start[:-1]]) | (doc[1:] != doc[:-1])
        inner = np.flatnonzero(~first)
        feats[inner, 1] = shape[inner - 1]
        feats[inner - 1, 2] = shape[inner]
    return w, feats, np.flatnonzero(first)


class Crf:
    """Parameters: emission tables (4 x features x labels), transitions, start scores."""

    def __init__(self, labels: list[str]):
        k = len(labels)
        self.labels = labels
        self.emit = np.zeros((4, SHAPES, k), np.float32)
        self.trans = np.zeros((k, k), np.float32)
        self.start = np.zeros(k, np.float32)

    def emissions(self, feats: np.ndarray) -> np.ndarray:
        e = self.emit[0][feats[:, 0]]
        for i in range(1, 4):
            e += self.emit[i][feats[:, i]]
        return e

    def decode(self, feats: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Most likely label numbers of all words; ``first`` are the sequences' first words."""
        n, k = len(feats), len(self.labels)
        out = np.zeros(n, np.int8)
        if not n:
            return out
        e = self.emissions(feats)
        size = np.diff(np.append(first, n))
        order = np.argsort(-size, kind="stable")
        begin, size = first[order], size[order]
        running = np.searchsorted(-size, -np.arange(size[0] + 1), side="left")  # sequences longer than t
        back = np.zeros((n, k), np.int8)
        best = self.start + e[begin]
        into = np.ascontiguousarray(self.trans.T)[None]
        last = np.empty((len(begin), k), np.float32)
        for t in range(1, size[0] + 1):
            m = running[t]
            last[m:len(best)] = best[m:]
            if not m:
                break
            at = begin[:m] + t
            via = best[:m, None, :] + into
            arg = via.argmax(axis=2)
            back[at] = arg
            best = np.take_along_axis(via, arg[:, :, None], axis=2)[:, :, 0] + e[at]
        lab = last.argmax(axis=1)
        for t in range(size[0] - 1, -1, -1):
            m = running[t]
            at = begin[:m] + t
            out[at] = lab[:m]
            lab[:m] = back[at, lab[:m]]
        return out

    def fit(self, feats: np.ndarray, first: np.ndarray, label: np.ndarray, steps: int = 150,
            rate: float = 0.2, l2: float = 2e-3) -> Crf:
        """Maximise the penalised likelihood of labelled sequences."""
        n, k = len(feats), len(self.labels)
        size = np.diff(np.append(first, n))
        s, top = len(first), int(size.max())
        pos = np.arange(top)
        live = pos[None, :] < size[:, None]
        at = np.where(live, first[:, None] + pos[None, :], 0)
        gold = label[at]
        params = [self.emit.astype(np.float64), self.trans.astype(np.float64), self.start.astype(np.float64)]
        m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        onehot = np.eye(k)[gold] * live[:, :, None]
        pair_live = live[:, 1:]
        gold_pairs = np.einsum("sti,stj->ij", onehot[:, :-1] * pair_live[:, :, None], onehot[:, 1:])
        for step in range(1, steps + 1):
            emit, trans, start = params
            e = sum(emit[i][feats[:, i]] for i in range(4))[at]
            alpha, beta = np.zeros((s, top, k)), np.zeros((s, top, k))
            alpha[:, 0] = start + e[:, 0]
            for t in range(1, top):
                a = np.logaddexp.reduce(alpha[:, t - 1, :, None] + trans, axis=1) + e[:, t]
                alpha[:, t] = np.where(live[:, t, None], a, alpha[:, t - 1])
            z = np.logaddexp.reduce(alpha[:, -1], axis=1)
            for t in range(top - 2, -1, -1):
                b = np.logaddexp.reduce(trans + (e[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
                beta[:, t] = np.where(live[:, t + 1, None], b, 0.0)
            prob = np.exp(alpha + beta - z[:, None, None]) * live[:, :, None]
            pairs = np.exp(alpha[:, :-1, :, None] + trans + (e[:, 1:] + beta[:, 1:])[:, :, None, :]
                           - z[:, None, None, None]) * pair_live[:, :, None, None]
            miss = np.zeros((n, k))
            miss[at[live]] = (prob - onehot)[live]
            grads = [np.zeros_like(emit), pairs.sum(axis=(0, 1)) - gold_pairs, (prob - onehot)[:, 0].sum(axis=0)]
            for i in range(4):
                np.add.at(grads[0][i], feats[:, i], miss)
            for p, g, a, b in zip(params, grads, m1, m2):
                g = g / s + l2 * p
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= rate * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.99 ** step)) + 1e-8)
        self.emit, self.trans, self.start = (p.astype(np.float32) for p in params)
        return self
