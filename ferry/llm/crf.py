"""A small linear-chain conditional random field (log-likelihood, Adagrad, Viterbi)."""

from __future__ import annotations

import numpy as np


class LinearCRF:
    """Labels 0..L-1; ``allowed`` [L, L] marks legal transitions, ``first`` legal first labels."""

    def __init__(self, n_features: int, allowed: np.ndarray, first: np.ndarray):
        labels = len(first)
        self.w = np.zeros((n_features, labels))
        self.t = np.zeros((labels, labels))
        self.barred = np.where(allowed, 0.0, -1e9)
        self.start = np.where(first, 0.0, -1e9)

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """x [n, k] feature ids (0: none) -> [n, L]."""
        return self.w[x].sum(1)

    def decode(self, x: np.ndarray, forced_out: np.ndarray) -> np.ndarray:
        """Viterbi; where ``forced_out`` the label is 0."""
        e = self.emissions(x)
        e[forced_out, 1:] = -1e9
        t = self.t + self.barred
        n = len(e)
        back = np.zeros((n, e.shape[1]), int)
        v = self.start + e[0]
        for i in range(1, n):
            into = v[:, None] + t
            back[i] = into.argmax(0)
            v = into.max(0) + e[i]
        y = np.zeros(n, int)
        y[-1] = v.argmax()
        for i in range(n - 1, 0, -1):
            y[i - 1] = back[i, y[i]]
        return y

    def gradient(self, x: np.ndarray, y: np.ndarray):
        e, t = self.emissions(x), self.t + self.barred
        n, labels = e.shape
        f, b = np.zeros((n, labels)), np.zeros((n, labels))
        f[0] = self.start + e[0]
        for i in range(1, n):
            f[i] = _lse(f[i - 1][:, None] + t, 0) + e[i]
        for i in range(n - 2, -1, -1):
            b[i] = _lse(t + (e[i + 1] + b[i + 1])[None, :], 1)
        z = _lse(f[-1], 0)
        ge = -np.exp(f + b - z)
        ge[np.arange(n), y] += 1
        gt = np.zeros_like(self.t)
        for i in range(1, n):
            gt -= np.exp(f[i - 1][:, None] + t + (e[i] + b[i])[None, :] - z)
            gt[y[i - 1], y[i]] += 1
        return ge, gt

    def fit(self, data, epochs=6, rate=0.3, l2=1e-3, seed=1):
        sw, st = np.full_like(self.w, 1e-6), np.full_like(self.t, 1e-6)
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for k in rng.permutation(len(data)):
                x, y = data[k]
                if not len(x):
                    continue
                ge, gt = self.gradient(x, y)
                ids, at = np.unique(x, return_inverse=True)
                g = np.zeros((len(ids), ge.shape[1]))
                np.add.at(g, at.reshape(x.shape), np.repeat(ge[:, None, :], x.shape[1], 1))
                g -= l2 * self.w[ids]
                g[ids == 0] = 0
                sw[ids] += g * g
                self.w[ids] += rate * g / np.sqrt(sw[ids])
                st += gt * gt
                self.t += rate * gt / np.sqrt(st)
        return self


def _lse(v: np.ndarray, axis: int):
    m = v.max(axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(v - m).sum(axis))
