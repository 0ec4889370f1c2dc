"""A bidirectional gated recurrent network with attention pooling, in numpy.

Inputs per word: the mean of its hashed character n-gram vectors next to a
hashed word vector. Both directions run over a window, attention weighs the
states, and a linear layer gives one logit per window. Training is
back-propagation through time with Adam (dense) and Adagrad (tables).
"""

from __future__ import annotations

import numpy as np

CHAR_ROWS, WORD_ROWS = 1 << 14, 1 << 13
CHAR_DIM, WORD_DIM, HIDDEN, ATTEND = 12, 4, 8, 8
X_DIM = CHAR_DIM + WORD_DIM


def word_features(words: list[str]):
    """(n-gram rows, where each word's rows start, word rows) of a list of words.

    N-grams of 3, 4 and 5 characters of ``<word>``, hashed over code points.
    """
    marked = [f"<{w}>" for w in words]
    c = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    ends = np.cumsum(lengths)
    starts = ends - lengths
    owner_end = np.repeat(ends, lengths)
    at = np.arange(len(c))
    rows, owners = [], []
    owner = np.repeat(np.arange(len(words)), lengths)
    h = c * np.uint32(0x9E3779B1)
    for n in (2, 3, 4, 5):
        if len(c) < n:
            break
        h = (h[:len(c) - n + 1] * np.uint32(0x01000193)) ^ (c[n - 1:] * np.uint32(0x85EBCA77))
        if n < 3:
            continue
        ok = at[:len(h)] + n <= owner_end[:len(h)]
        mixed = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        rows.append((mixed >> np.uint32(18))[ok])
        owners.append(owner[:len(h)][ok])
    rows = np.concatenate(rows) if rows else np.zeros(0, np.uint32)
    owners = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    order = np.argsort(owners, kind="stable")
    rows, owners = rows[order].astype(np.int64), owners[order]
    first = np.searchsorted(owners, np.arange(len(words)))
    w = np.zeros(len(words), np.uint32)
    if len(c):
        weight = (np.arange(len(c)) - np.repeat(starts, lengths)).astype(np.uint32) * np.uint32(2) + np.uint32(1)
        mixed = (c * np.uint32(0xCC9E2D51)) * (weight * np.uint32(0x1B873593) | np.uint32(1))
        w = np.add.reduceat(mixed ^ (mixed >> np.uint32(15)), starts, dtype=np.uint32)
    return rows, first, ((w * np.uint32(0x27D4EB2F)) >> np.uint32(19)).astype(np.int64)


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-x))


class BiGRU:
    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        small = lambda *s: (r.standard_normal(s) * 0.1).astype(np.float32)
        self.chars = (r.standard_normal((CHAR_ROWS, CHAR_DIM)) * 0.3).astype(np.float32)
        self.words = (r.standard_normal((WORD_ROWS, WORD_DIM)) * 0.1).astype(np.float32)
        glorot = lambda a, b: (r.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        # gates in the order update, reset, candidate
        self.p = {}
        for d in "fb":
            self.p[f"W{d}"] = glorot(X_DIM, 3 * HIDDEN)
            self.p[f"U{d}"] = glorot(HIDDEN, 3 * HIDDEN)
            self.p[f"b{d}"] = np.zeros(3 * HIDDEN, np.float32)
        self.p["A"] = glorot(2 * HIDDEN, ATTEND)
        self.p["v"] = small(ATTEND)
        self.p["o"] = glorot(2 * HIDDEN, 1)[:, 0]
        self.p["c"] = np.zeros(1, np.float32)

    # -- inputs ------------------------------------------------------------------
    def embed(self, words: list[str]) -> np.ndarray:
        rows, first, wrows = word_features(words)
        return self._embed(rows, first, wrows)

    def _embed(self, rows, first, wrows):
        n = np.diff(np.append(first, len(rows)))
        total = np.add.reduceat(np.concatenate([self.chars[rows], np.zeros((1, CHAR_DIM), np.float32)]),
                                np.minimum(first, len(rows)), axis=0)
        total[n == 0] = 0
        return np.concatenate([total / np.maximum(np.sqrt(n), 1)[:, None], self.words[wrows]], 1).astype(np.float32)

    def gate_inputs(self, x: np.ndarray) -> np.ndarray:
        """[n, 2, 3H]: what each word adds to the gates of both directions."""
        return np.stack([x @ self.p["Wf"] + self.p["bf"], x @ self.p["Wb"] + self.p["bb"]], 1)

    # -- forward -----------------------------------------------------------------
    def _run(self, g: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        """g [T, B, 3H] gate inputs in running order, mask [T, B]."""
        u, H = self.p[f"U{d}"], HIDDEN
        T, B = mask.shape
        h = np.zeros((B, H), np.float32)
        hs = np.empty((T, B, H), np.float32)
        saved = []
        for t in range(T):
            hu = h @ u
            zr = _sigmoid(g[t, :, :2 * H] + hu[:, :2 * H])
            z, r = zr[:, :H], zr[:, H:]
            cand = np.tanh(g[t, :, 2 * H:] + r * hu[:, 2 * H:])
            new = h + z * (cand - h)
            m = mask[t][:, None]
            new = np.where(m, new, h)
            if keep:
                saved.append((h, z, r, cand, hu[:, 2 * H:], m))
            h = new
            hs[t] = h
        return hs, saved

    def forward(self, gates: np.ndarray, ids: np.ndarray, mask: np.ndarray, keep: bool = False):
        """gates [words, 2, 3H], ids [B, T] into it, mask [B, T] -> logits [B]."""
        i, m = ids.T, mask.T
        f, sf = self._run(gates[i, 0], m, "f", keep)
        b, sb = self._run(gates[i[::-1], 1], m[::-1], "b", keep)
        hs = np.concatenate([f, b[::-1]], 2)                       # [T, B, 2H]
        k = np.tanh(hs @ self.p["A"])
        e = np.where(m, k @ self.p["v"], -1e9)
        a = np.exp(e - e.max(0))
        a = a / a.sum(0)
        pooled = (a[:, :, None] * hs).sum(0)
        logit = pooled @ self.p["o"] + self.p["c"]
        return logit, (hs, k, a, pooled, sf, sb, i, m)

    # -- backward ----------------------------------------------------------------
    def _back(self, dh_all, saved, d, grads):
        u, H = self.p[f"U{d}"], HIDDEN
        T, B, _ = dh_all.shape
        dg = np.empty((T, B, 3 * H), np.float32)
        du = np.zeros_like(u)
        dh = np.zeros((B, H), np.float32)
        for t in range(T - 1, -1, -1):
            h, z, r, cand, hc, m = saved[t]
            dh = dh + dh_all[t]
            live = np.where(m, dh, 0)
            dcand = live * z * (1 - cand * cand)
            dz = live * (cand - h) * z * (1 - z)
            dr = dcand * hc * r * (1 - r)
            dg[t, :, :H], dg[t, :, H:2 * H], dg[t, :, 2 * H:] = dz, dr, dcand
            dhu = np.concatenate([dz, dr, dcand * r], 1)
            du += h.T @ dhu
            dh = np.where(m, live * (1 - z), dh) + dhu @ u.T
        grads[f"U{d}"] = du
        return dg

    def gradient(self, gates, ids, mask, y, weight):
        logit, (hs, k, a, pooled, sf, sb, i, m) = self.forward(gates, ids, mask, True)
        dl = ((_sigmoid(logit) - y) * weight / len(y)).astype(np.float32)
        g = {"o": pooled.T @ dl, "c": dl.sum(keepdims=True)}
        dpool = dl[:, None] * self.p["o"]
        dhs = a[:, :, None] * dpool
        da = (hs * dpool).sum(2)
        de = a * (da - (a * da).sum(0))
        g["v"] = (k * de[:, :, None]).sum((0, 1))
        dk = de[:, :, None] * self.p["v"] * (1 - k * k)
        g["A"] = np.tensordot(hs, dk, ([0, 1], [0, 1]))
        dhs = dhs + dk @ self.p["A"].T
        H = HIDDEN
        dgf = self._back(dhs[:, :, :H], sf, "f", g)
        dgb = self._back(dhs[::-1, :, H:], sb, "b", g)
        dgates = np.zeros_like(gates)
        np.add.at(dgates[:, 0], i, dgf)
        np.add.at(dgates[:, 1], i[::-1], dgb)
        return logit, g, dgates

    def fit(self, windows: list[list[str]], y, weight=None, epochs: int = 5, batch: int = 128,
            rate: float = 0.01, table_rate: float = 0.05, drop: float = 0.4, seed: int = 5):
        """Fit on labelled windows; ``drop`` is the share of words blanked out per batch."""
        y = np.asarray(y, np.float32)
        weight = np.ones(len(y), np.float32) if weight is None else weight
        rng = np.random.default_rng(seed)
        mom = {k: np.zeros_like(v) for k, v in self.p.items()}
        var = {k: np.zeros_like(v) for k, v in self.p.items()}
        sc, sw = np.full(CHAR_ROWS, 1e-6, np.float32), np.full(WORD_ROWS, 1e-6, np.float32)
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for s in range(0, len(order), batch):
                pick = order[s:s + batch]
                words, ids, mask = index([windows[i] for i in pick])
                rows, first, wrows = word_features(words)
                kept = (rng.random(len(words)) >= drop)[:, None].astype(np.float32)
                x = self._embed(rows, first, wrows) * kept
                _, g, dgates = self.gradient(self.gate_inputs(x), ids, mask, y[pick], weight[pick])
                dx = np.zeros_like(x)
                for j, d in enumerate("fb"):
                    g[f"W{d}"] = x.T @ dgates[:, j]
                    g[f"b{d}"] = dgates[:, j].sum(0)
                    dx += dgates[:, j] @ self.p[f"W{d}"].T
                dx *= kept
                step += 1
                norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
                clip = min(1.0, 5.0 / (norm + 1e-9))
                for k in self.p:
                    v = g[k].reshape(self.p[k].shape) * clip
                    mom[k] += 0.1 * (v - mom[k])
                    var[k] += 0.01 * (v * v - var[k])
                    self.p[k] -= rate * (mom[k] / (1 - 0.9 ** step)) / (np.sqrt(var[k] / (1 - 0.99 ** step)) + 1e-7)
                n = np.diff(np.append(first, len(rows)))
                dchar = np.repeat(dx[:, :CHAR_DIM] / np.maximum(np.sqrt(n), 1)[:, None], n, axis=0)
                _adagrad(self.chars, sc, rows, dchar, table_rate)
                _adagrad(self.words, sw, wrows, dx[:, CHAR_DIM:], table_rate)
        return self


def _adagrad(table, acc, rows, grad, rate):
    ids, at = np.unique(rows, return_inverse=True)
    g = np.zeros((len(ids), table.shape[1]), np.float32)
    np.add.at(g, at, grad)
    acc[ids] += (g * g).mean(1)
    table[ids] -= rate * g / np.sqrt(acc[ids])[:, None]


def index(windows: list[list[str]], width: int | None = None):
    """Distinct words, ids [B, T] and mask [B, T] of a batch of windows."""
    seen: dict[str, int] = {}
    width = width or max(1, max(map(len, windows), default=1))
    ids = np.zeros((len(windows), width), np.int64)
    mask = np.zeros((len(windows), width), bool)
    for i, w in enumerate(windows):
        ids[i, :len(w)] = [seen.setdefault(t, len(seen)) for t in w]
        mask[i, :len(w)] = True
    return list(seen) or [""], ids, mask
