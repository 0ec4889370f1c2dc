"""A small semi-Markov conditional random field.

A sequence of n positions is cut into segments. Label 0 is "outside" and has
segments of one position; every other label may only cover the candidate spans
handed in, each with its whole-span features. The score of a segmentation is
the sum over its segments of feature weights plus a weight per pair of
neighbouring labels. Training maximises the conditional likelihood
(forward-backward over segments, Adagrad); decoding is dynamic programming
over segments, so boundaries and labels are chosen together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Lattice:
    n: int
    outside: np.ndarray        # [n, k] feature ids of each single outside position
    start: np.ndarray          # [s] candidate spans, ordered by stop
    stop: np.ndarray           # [s]
    inside: np.ndarray         # [s, k] feature ids


class SemiCRF:
    def __init__(self, n_features: int, n_labels: int):
        self.w = np.zeros((n_features, n_labels))
        self.t = np.zeros((n_labels, n_labels))

    def scores(self, lat: Lattice):
        out = self.w[lat.outside, 0].sum(1) if lat.n else np.zeros(0)
        spans = self.w[lat.inside].sum(1) if len(lat.start) else np.zeros((0, self.w.shape[1]))
        return out, spans

    def decode(self, lat: Lattice) -> list[tuple[int, int, int]]:
        """The best segmentation's (start, stop, label) of the labels other than 0."""
        out, spans = self.scores(lat)
        labels = self.w.shape[1]
        best = np.full((lat.n + 1, labels), -np.inf)
        best[0, 0] = 0.0
        back: dict[tuple[int, int], tuple[int, int]] = {}
        at = 0
        for i in range(1, lat.n + 1):
            into = best[i - 1] + self.t[:, 0]
            p = int(into.argmax())
            best[i, 0] = into[p] + out[i - 1]
            back[i, 0] = (i - 1, p)
            while at < len(lat.stop) and lat.stop[at] == i:
                a = int(lat.start[at])
                into = best[a][:, None] + self.t[:, 1:]
                prev = into.argmax(0)
                total = into.max(0) + spans[at, 1:]
                for y in np.flatnonzero(total > best[i, 1:]):
                    best[i, y + 1] = total[y]
                    back[i, int(y) + 1] = (a, int(prev[y]))
                at += 1
        found, i, y = [], lat.n, int(best[lat.n].argmax())
        while i > 0:
            a, p = back[i, y]
            if y:
                found.append((a, i, y))
            i, y = a, p
        return found[::-1]

    def _forward(self, n, out, spans, start, stop):
        labels = self.w.shape[1]
        f = np.full((n + 1, labels), -np.inf)
        f[0, 0] = 0.0
        at = 0
        for i in range(1, n + 1):
            parts = {0: [_lse(f[i - 1] + self.t[:, 0]) + out[i - 1]]}
            while at < len(stop) and stop[at] == i:
                v = f[start[at]][:, None] + self.t[:, 1:]
                m = v.max(0)
                m[~np.isfinite(m)] = 0
                with np.errstate(divide="ignore"):
                    v = np.log(np.exp(v - m).sum(0)) + m + spans[at, 1:]
                for y in range(1, labels):
                    parts.setdefault(y, []).append(v[y - 1])
                at += 1
            for y, p in parts.items():
                f[i, y] = _lse(np.array(p))
        return f

    def gradient(self, lat: Lattice, gold: list[tuple[int, int, int]]):
        """(feature ids, weight gradient rows, transition gradient) of the log-likelihood."""
        out, spans = self.scores(lat)
        n, labels = lat.n, self.w.shape[1]
        f = self._forward(n, out, spans, lat.start, lat.stop)
        z = _lse(f[n])
        # backward: b[i, y] = log sum over what may follow a segment of label y ending at i
        b = np.full((n + 1, labels), -np.inf)
        b[n] = 0.0
        by_start = np.lexsort((lat.stop, lat.start))[::-1]
        at = 0
        for i in range(n - 1, -1, -1):
            v = [self.t[:, 0] + out[i] + b[i + 1, 0]]
            while at < len(by_start) and lat.start[by_start[at]] == i:
                s = by_start[at]
                v.extend((self.t[:, y] + spans[s, y] + b[lat.stop[s], y]) for y in range(1, labels))
                at += 1
            v = np.array(v)
            m = v.max(0)
            m[~np.isfinite(m)] = 0
            with np.errstate(divide="ignore"):
                b[i] = np.log(np.exp(v - m).sum(0)) + m
        gt = np.zeros_like(self.t)
        p_out = np.zeros(n)
        p_span = np.zeros_like(spans)
        with np.errstate(invalid="ignore"):
            for i in range(n):
                joint = np.exp(f[i] + self.t[:, 0] + out[i] + b[i + 1, 0] - z)
                p_out[i] = joint.sum()
                gt[:, 0] -= joint
            for s in range(len(lat.start)):
                joint = np.exp(f[lat.start[s]][:, None] + self.t[:, 1:] + spans[s, 1:] + b[lat.stop[s], 1:] - z)
                p_span[s, 1:] = joint.sum(0)
                gt[:, 1:] -= joint
        # the gold segmentation
        where = {(a, e): s for s, (a, e) in enumerate(zip(lat.start, lat.stop))}
        g_out, g_span, prev, i = np.zeros(n), np.zeros_like(spans), 0, 0
        todo = {a: (e, y) for a, e, y in gold if (a, e) in where}
        while i < n:
            if i in todo:
                e, y = todo[i]
                g_span[where[i, e], y] += 1
                gt[prev, y] += 1
                prev, i = y, e
            else:
                g_out[i] += 1
                gt[prev, 0] += 1
                prev, i = 0, i + 1
        return g_out - p_out, g_span - p_span, gt

    def fit(self, data, epochs=5, rate=0.3, l2=1e-4, seed=1):
        sw, st = np.full_like(self.w, 1e-6), np.full_like(self.t, 1e-6)
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for k in rng.permutation(len(data)):
                lat, gold = data[k]
                if not lat.n:
                    continue
                go, gs, gt = self.gradient(lat, gold)
                g = np.zeros_like(self.w)
                np.add.at(g[:, 0], lat.outside, np.repeat(go[:, None], lat.outside.shape[1], 1))
                if len(lat.start):
                    np.add.at(g, lat.inside, np.repeat(gs[:, None, :], lat.inside.shape[1], 1))
                touched = np.any(g != 0, 1)
                g[touched] -= l2 * self.w[touched]
                sw += g * g
                self.w += rate * g / np.sqrt(sw)
                st += gt * gt
                self.t += rate * gt / np.sqrt(st)
        return self


def _lse(v: np.ndarray) -> float:
    m = v.max()
    return float(m + np.log(np.exp(v - m).sum())) if np.isfinite(m) else -np.inf
