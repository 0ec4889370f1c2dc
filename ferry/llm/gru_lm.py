"""A gated recurrent language model with a class-factored softmax, in numpy.

Symbols: ``words`` short-list words in order of frequency, ``tails`` classes of all
other words, and the end of a text (also the first input). The short list is cut
into classes of ``WIDTH`` words; the chance of a word is that of its class times
its own inside the class. A tail or the end is a class of its own.
"""

from __future__ import annotations

from copy import copy

import numpy as np

EMBED, HIDDEN, WIDTH = 16, 16, 64
WINDOW = 32          # steps of one window; the state goes on into the next
ROWS = 4096          # states whose classes are worked out at once
SCORED = 1 << 16     # states scored at once: a class of words has many of them, however few texts still run


def _sigmoid(x):
    """In place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.divide(1, x, out=x)


def _tops(w: np.ndarray, b: np.ndarray) -> list[float | None]:
    """Of each softmax [k, H, n]: a bound of its logits for states within -1..1; None where
    a row's largest one may be so far below that it has to be looked for."""
    reach = np.abs(w).sum(1)
    tops, least = (b + reach).max(1), (b - reach).max(1)
    return [float(t) if t - m < 60 else None for t, m in zip(tops, least)]


def _chances(x: np.ndarray, w: np.ndarray, b: np.ndarray, y: np.ndarray, top: float | None, back: bool):
    """(ln P(y), with ``back`` d(-ln P)/d logits) of a softmax for states x [n, H]."""
    logits = x @ w
    if top is None:
        logits += b
        logits -= logits.max(1, keepdims=True)
    else:
        logits += b - b.dtype.type(top)
    at = np.arange(len(y))
    picked = logits[at, y].astype(np.float64)
    np.exp(logits, out=logits)
    total = logits @ np.ones(len(b), b.dtype)
    found = picked - np.log(total)
    if back:
        logits /= total[:, None]
        logits[at, y] -= 1
    return found, logits


class GruLM:
    def __init__(self, words: int, tails: int, counts: np.ndarray, seed: int = 3):
        """``counts``: occurrences of every symbol, for the first biases."""
        r = np.random.default_rng(seed)
        self.words, self.end = words, words + tails
        self.word_classes = -(-words // WIDTH)
        self.classes = self.word_classes + tails + 1
        draw = lambda *s: (r.standard_normal(s) / np.sqrt(s[-2])).astype(np.float32)
        log = lambda x: np.log(np.maximum(x, 0.5)).astype(np.float32)                 # noqa: E731
        inside = np.zeros(self.word_classes * WIDTH)
        inside[:words] = counts[:words]
        inside = inside.reshape(-1, WIDTH)
        per_class = np.concatenate([inside.sum(1), counts[words:]])
        self.p = {
            "E": (r.standard_normal((self.end + 1, EMBED)) * 0.1).astype(np.float32),
            "W": draw(EMBED, 3 * HIDDEN), "U": draw(HIDDEN, 3 * HIDDEN), "b": np.zeros(3 * HIDDEN, np.float32),
            "C": 0.1 * draw(HIDDEN, self.classes), "c": log(per_class),
            "O": 0.1 * draw(self.word_classes, HIDDEN, WIDTH),
            "o": np.where(np.arange(inside.size).reshape(inside.shape) < words, log(inside), np.float32(-1e9)),
        }

    def copy(self) -> "GruLM":
        out = copy(self)
        out.p = {k: v.copy() for k, v in self.p.items()}
        return out

    def weights(self) -> np.ndarray:
        """All weights, one after the other."""
        return np.concatenate([v.reshape(-1) for v in self.p.values()])

    def set_weights(self, flat: np.ndarray) -> None:
        cuts = np.cumsum([v.size for v in self.p.values()])[:-1]
        self.p = {k: part.reshape(v.shape).astype(v.dtype) for (k, v), part in zip(self.p.items(), np.split(flat, cuts))}

    def class_of(self, symbols: np.ndarray) -> np.ndarray:
        return np.where(symbols < self.words, symbols // WIDTH, self.word_classes + symbols - self.words)

    def _step(self, g, h):
        hu = h @ self.p["U"]
        z, r = (_sigmoid(g[:, at:at + HIDDEN] + hu[:, at:at + HIDDEN]) for at in (0, HIDDEN))
        hc = hu[:, 2 * HIDDEN:]
        cand = r * hc
        cand += g[:, 2 * HIDDEN:]
        np.tanh(cand, out=cand)
        after = cand - h
        after *= z
        after += h
        return after, (h, z, r, cand, hc)

    def _softmax(self, x: np.ndarray, y: np.ndarray, grads: dict | None = None):
        """ln P(y) for states x [n, H]; with ``grads`` also d(sum of -ln P)/dx, and its
        gradients for the softmax's parameters put there."""
        p, own = self.p, self.class_of(y)
        found, dx = np.empty(len(y)), None
        if grads is not None:
            grads |= {k: np.zeros_like(p[k]) for k in "CcOo"}
            dx = np.empty_like(x)
        top, = _tops(p["C"][None], p["c"][None])
        for at in range(0, len(y), ROWS):
            rows = slice(at, at + ROWS)
            found[rows], back = _chances(x[rows], p["C"], p["c"], own[rows], top, grads is not None)
            if grads is not None:
                grads["C"] += x[rows].T @ back
                grads["c"] += back.sum(0)
                dx[rows] = back @ p["C"].T
        order = np.argsort(own.astype(np.uint16), kind="stable")
        cuts = np.searchsorted(own[order], np.arange(self.word_classes + 1))
        order = order[:cuts[-1]]
        xs, ys, inside = x[order], y[order] % WIDTH, np.empty(len(order))
        dxs = np.empty_like(xs) if grads is not None else None
        tops = _tops(p["O"], p["o"])
        for k in np.flatnonzero(np.diff(cuts)):
            rows = slice(cuts[k], cuts[k + 1])
            inside[rows], back = _chances(xs[rows], p["O"][k], p["o"][k], ys[rows], tops[k], grads is not None)
            if grads is not None:
                grads["O"][k], grads["o"][k] = xs[rows].T @ back, back.sum(0)
                np.matmul(back, p["O"][k].T, out=dxs[rows])
        found[order] += inside
        if grads is not None:
            dx[order] += dxs
        return found, dx

    # -- scoring -----------------------------------------------------------------
    def log_likelihood(self, texts: list[np.ndarray]) -> np.ndarray:
        """ln P of every whole text (its symbols, then the end).

        Texts run side by side, the longest first, each until its end; the chances
        of about SCORED states are worked out at once.
        """
        lengths = np.array([len(t) + 1 for t in texts], np.int64)
        order = np.argsort(-lengths, kind="stable")
        n = lengths[order]
        first = np.cumsum(n) - n
        flat = np.full(int(n.sum()), self.end, np.int32)
        for at, i in zip(first, order):
            flat[at:at + len(texts[i])] = texts[i]
        gates = self.p["E"] @ self.p["W"] + self.p["b"]
        total = np.zeros(len(texts))
        h = np.zeros((len(texts), HIDDEN), np.float32)
        steps = int(n[0]) if len(n) else 0
        live = np.searchsorted(-n, -np.arange(steps), "left").tolist()      # texts longer than t
        states, targets, held = [], [], 0
        for t, k in enumerate(live):
            before = targets[-1][:k] if targets else flat[first[:k] + t - 1] if t else np.full(k, self.end)
            h, _ = self._step(gates[before], h[:k])
            states.append(h)
            targets.append(flat[first[:k] + t])
            held += k
            if held >= SCORED or t == steps - 1:
                found, _ = self._softmax(np.concatenate(states), np.concatenate(targets))
                at = 0
                for own in targets:
                    total[:len(own)] += found[at:at + len(own)]
                    at += len(own)
                states, targets, held = [], [], 0
        out = np.empty(len(texts))
        out[order] = total
        return out

    # -- training ----------------------------------------------------------------
    def window_gradient(self, symbols: np.ndarray, targets: np.ndarray, h: np.ndarray):
        """Symbols and targets [T, B], the state before: (ln P sum, gradients, state after).

        The gradient stops at the window's first step (truncated back-propagation
        through time). A text's first symbol is the end mark, where the state restarts.
        """
        p, steps = self.p, len(symbols)
        fresh = (symbols == self.end)[..., None]
        stops = fresh.any((1, 2))
        x = p["E"][symbols]
        gates = x @ p["W"] + p["b"]
        saved, states = [], []
        for t in range(steps):
            h, kept = self._step(gates[t], np.where(fresh[t], 0, h).astype(gates.dtype))
            saved.append(kept)
            states.append(h)
        grads: dict = {}
        found, dx = self._softmax(np.concatenate(states), targets.reshape(-1), grads)
        dx = dx.reshape(steps, -1, HIDDEN)
        dg, dhu = np.empty_like(gates), np.empty_like(gates)
        dh = np.zeros_like(h)
        for t in range(steps - 1, -1, -1):
            before, z, r, cand, hc = saved[t]
            stay = 1 - z
            dh = dh + dx[t]
            dcand = dh * z
            dcand *= 1 - cand * cand
            dz = dh * (cand - before)
            dz *= z
            dz *= stay
            dr = dcand * hc
            dr *= r
            dr *= 1 - r
            dg[t] = np.concatenate([dz, dr, dcand], 1)
            dhu[t] = np.concatenate([dz, dr, dcand * r], 1)
            dh = dh * stay
            dh += dhu[t] @ p["U"].T
            if stops[t]:
                dh[fresh[t, :, 0]] = 0
        flat = lambda a: a.reshape(-1, a.shape[-1])
        grads["U"] = np.concatenate([s[0] for s in saved]).T @ flat(dhu)
        grads["W"], grads["b"], grads["E"] = flat(x).T @ flat(dg), flat(dg).sum(0), np.zeros_like(p["E"])
        order = np.argsort(symbols.reshape(-1).astype(np.uint16), kind="stable")
        ids, starts = np.unique(symbols.reshape(-1)[order], return_index=True)
        grads["E"][ids] = np.add.reduceat((flat(dg) @ p["W"].T)[order], starts)
        return found.sum(), grads, h

    def fit(self, texts: list[np.ndarray], epochs: int = 6, streams: int = 64, rate: float = 0.01, seed: int = 9):
        """Adam over ``streams`` rows of texts laid end to end, windows of WINDOW steps;
        the step falls to a tenth over the epochs."""
        rng = np.random.default_rng(seed)
        mean = {k: np.zeros_like(v) for k, v in self.p.items()}
        square = {k: np.zeros_like(v) for k, v in self.p.items()}
        total = sum(len(t) + 1 for t in texts)
        long = -(-total // streams)
        updates, step = max(1, epochs * -(-long // WINDOW)), 0
        for _ in range(epochs):
            flat = np.concatenate([np.append(texts[i], self.end) for i in rng.permutation(len(texts))])
            before = np.append(self.end, flat[:-1])
            short = streams * long - len(flat)       # the rows' rest is filled from the start
            pad = lambda a: np.concatenate([a, np.resize(a, short)]).astype(np.int64).reshape(streams, long).T
            before, after = pad(before), pad(flat)
            h = np.zeros((streams, HIDDEN), np.float32)
            for s in range(0, long, WINDOW):
                _, grads, h = self.window_gradient(before[s:s + WINDOW], after[s:s + WINDOW], h)
                step += 1
                pace = rate * (1 - 0.9 * step / updates)
                size = after[s:s + WINDOW].size
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values())) / size
                scale = min(1.0, 1.0 / (norm + 1e-9)) / size
                for k, v in self.p.items():
                    g = grads[k] * np.float32(scale)
                    mean[k] += 0.1 * (g - mean[k])
                    square[k] += 0.01 * (g * g - square[k])
                    v -= pace * (mean[k] / (1 - 0.9 ** step)) / (np.sqrt(square[k] / (1 - 0.99 ** step)) + 1e-6)
        return self
