"""A small gated recurrent language model with a class-factored softmax, in numpy.

Ids 0..size-1 are words, unknown words and the end token; each belongs to one class of neighbouring ids. The
probability of the next id is ``p(class | state) * p(id | class, state)``. Training runs over parallel streams with
truncated backpropagation: the state crosses windows, gradients do not. Scoring carries the state through all windows
of a document, so the result is the log-likelihood of the complete document.
"""

from __future__ import annotations

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place; an exponential takes less time than a hyperbolic tangent. Its overflow gives the right limit."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _tanh(x: np.ndarray) -> np.ndarray:
    """In place, likewise."""
    x *= -2
    np.exp(x, out=x)
    x += 1
    np.divide(2, x, out=x)
    x -= 1
    return x


def _log_at(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log of the softmax of each column of ``z`` at one place; ``z`` is used up."""
    z -= z.max(0)
    own = z[at, np.arange(len(at))]
    np.exp(z, out=z)
    return own - np.log(z.sum(0))


def _loss(z: np.ndarray, at: np.ndarray, scale: float) -> tuple[float, np.ndarray]:
    """Summed loss of the softmax of each column of ``z`` at one place, and its gradient times ``scale``; ``z`` is used up."""
    z -= z.max(0)
    columns = np.arange(len(at))
    own = z[at, columns]
    np.exp(z, out=z)
    total = z.sum(0)
    loss = float((np.log(total) - own).sum())
    z *= np.float32(scale) / total
    z[at, columns] -= np.float32(scale)
    return loss, z


def _with_ones(states: list[np.ndarray]) -> np.ndarray:
    """States side by side, and a row of ones for the biases."""
    d = len(states[0])
    out = np.ones((d + 1, sum(s.shape[1] for s in states)), states[0].dtype)
    np.concatenate(states, axis=1, out=out[:d])
    return out


class Gru:
    """Parameters as float32 arrays; ``size`` ids in ``n_classes`` classes of equal width."""

    NAMES = ("emb", "wx", "wh", "bh", "wc", "bc", "wo", "bo")

    def __init__(self, counts: np.ndarray, hidden: int = 24, n_classes: int = 32, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.size, self.hidden = len(counts), hidden
        self.width = -(-len(counts) // n_classes)
        n = -(-len(counts) // self.width)
        scale = 1 / np.sqrt(hidden)
        r = lambda *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.emb = np.concatenate([r(len(counts), hidden), np.zeros((1, hidden), np.float32)])  # the last row begins a text
        self.wx, self.wh, self.bh = r(hidden, 3 * hidden), r(hidden, 3 * hidden), np.zeros(3 * hidden, np.float32)
        smooth = np.zeros(n * self.width)
        smooth[: len(counts)] = counts + 0.1
        table = smooth.reshape(n, self.width)
        with np.errstate(divide="ignore"):  # ids beyond the last have probability 0
            self.bc = np.log(table.sum(1) / table.sum()).astype(np.float32)
            self.bo = np.maximum(np.log(table / table.sum(1, keepdims=True)), -1e9).astype(np.float32)
        self.wc = np.zeros((hidden, n), np.float32)
        self.wo = np.zeros((n, hidden, self.width), np.float32)

    @property
    def start(self) -> int:
        return self.size

    def vector(self) -> np.ndarray:
        """All parameters in a row."""
        return np.concatenate([getattr(self, k).ravel() for k in self.NAMES])

    def load(self, vector: np.ndarray) -> None:
        at = 0
        for k in self.NAMES:
            old = getattr(self, k)
            setattr(self, k, vector[at : at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size

    def learn(self, ids: np.ndarray, streams: int, rate: float) -> None:
        """One pass over all of ``ids``, in fewer streams where they are short; the last stream is filled from the first."""
        n = max(1, min(streams, len(ids) // 1024))
        self.train(np.concatenate([ids, ids[: -len(ids) % n]]), streams=n, epochs=1, rate=rate)

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, tuple]:
        """The state after ``h``, one row for each text; ``x`` is the input's part of the gates."""
        h, cache = self._step(np.ascontiguousarray(x.T), np.ascontiguousarray(h.T), np.ascontiguousarray(self.wh.T))
        return h.T, cache

    def _step(self, x: np.ndarray, h: np.ndarray, wh: np.ndarray) -> tuple[np.ndarray, tuple]:
        """The same with one column for each text and ``wh`` transposed, so that every gate is a whole piece of memory."""
        d = self.hidden
        u = wh @ h
        gates = _sigmoid(x[: 2 * d] + u[: 2 * d])
        z, r, un = gates[:d], gates[d:], u[2 * d :]
        n = r * un
        n += x[2 * d :]
        _tanh(n)
        out = n - h
        out *= z
        out += h
        return out, (z, r, n, un, h)

    def _transposed(self) -> tuple[np.ndarray, ...]:
        """Inputs with ones, and weights with their biases as a last column: of the inputs, the classes, the words of a class."""
        return (
            np.concatenate([self.emb, np.ones((self.size + 1, 1), self.emb.dtype)], axis=1).T.copy(),
            np.concatenate([self.wx, self.bh[None]]).T.copy(),
            np.concatenate([self.wc, self.bc[None]]).T.copy(),
            np.concatenate([self.wo, self.bo[:, None]], axis=1).transpose(0, 2, 1).copy(),
        )

    def _by_class(self, cls: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """An order by class, and each class that occurs with its range in it."""
        order = np.argsort(cls.astype(np.int16), kind="stable")
        cuts = np.concatenate([[0], np.cumsum(np.bincount(cls, minlength=len(self.bc)))]).tolist()
        return order, [(c, a, b) for c, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b]

    def log_probs(self, states: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Natural-log probability of each id after each state."""
        _, _, wc, wo = self._transposed()
        return self._log_probs(_with_ones([states.T]), ids, wc, wo)

    def _log_probs(self, s: np.ndarray, ids: np.ndarray, wc: np.ndarray, wo: np.ndarray) -> np.ndarray:
        """The same for states as columns that end with a one."""
        cls = ids // self.width
        order, ranges = self._by_class(cls)
        s, cls = s.take(order, axis=1, mode="clip"), cls[order]
        z = np.empty((self.width, len(ids)), s.dtype)
        for c, a, b in ranges:
            np.matmul(wo[c], s[:, a:b], out=z[:, a:b])
        out = np.empty(len(ids))
        out[order] = _log_at(wc @ s, cls).astype(np.float64) + _log_at(z, ids[order] - cls * self.width)
        return out

    def _window(self, inputs: np.ndarray, targets: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray, dict]:
        """Mean loss, last state and gradients of one window of shape (time, batch)."""
        time, batch = inputs.shape
        d = self.hidden
        emb, wx, wc, wo = self._transposed()
        wh = np.ascontiguousarray(self.wh.T)
        h = np.ascontiguousarray(h.T)
        states, caches = [], []
        for t in range(time):
            h, cache = self._step(wx @ emb.take(inputs[t], axis=1, mode="clip"), h, wh)
            states.append(h)
            caches.append(cache)
        y = targets.ravel()
        scale = 1 / len(y)
        order, ranges = self._by_class(y // self.width)
        place = np.empty(len(y), np.int64)
        place[order] = np.arange(len(y))
        s, y = _with_ones(states).take(order, axis=1, mode="clip"), y[order]  # by class
        cls = y // self.width
        loss, dc = _loss(wc @ s, cls, scale)
        do = np.empty((self.width, len(y)), s.dtype)
        for c, a, b in ranges:
            np.matmul(wo[c], s[:, a:b], out=do[:, a:b])
        part, do = _loss(do, y - cls * self.width, scale)
        gc, go = s @ dc.T, np.zeros((len(wo), d + 1, self.width), s.dtype)
        ds = self.wc @ dc
        for c, a, b in ranges:
            np.matmul(s[:, a:b], do[:, a:b].T, out=go[c])
            ds[:, a:b] += self.wo[c] @ do[:, a:b]
        ds = ds.take(place, axis=1, mode="clip")
        # Gradients before the gates: of the new state, both gates, and the new state's part that the reset gate lets through.
        # Rows are longer than needed, as those of a power of two share few lines of the cache.
        grad = np.empty((4 * d, time * batch + 80), s.dtype)
        dh = np.zeros((d, batch), s.dtype)
        for t in reversed(range(time)):
            z, r, n, un, h0 = caches[t]
            now = slice(t * batch, (t + 1) * batch)
            dn, dz, dr, dp = (grad[k * d : (k + 1) * d, now] for k in range(4))
            dh += ds[:, now]
            keep = 1 - z
            np.subtract(n, h0, out=dz)
            dz *= keep
            z *= dh
            dz *= z
            n *= n
            np.subtract(1, n, out=n)
            np.multiply(z, n, out=dn)
            np.multiply(dn, r, out=dp)
            np.subtract(1, r, out=dr)
            dr *= dp
            dr *= un
            dh *= keep
            dh += self.wh @ grad[d:, now]
        grad = grad[:, : time * batch]
        before = np.concatenate([c[4] for c in caches], axis=1)
        ids = np.ascontiguousarray(inputs).ravel()
        by_id = np.array([np.bincount(ids, row, self.size + 1) for row in grad[: 3 * d]], s.dtype)
        by_id = np.concatenate([by_id[d:], by_id[:d]])  # in the order of the parameters
        g = {"emb": by_id.T @ self.wx.T, "wx": self.emb.T @ by_id.T, "wh": before @ grad[d:].T, "bh": by_id.sum(1)}
        g |= {"wc": gc[:d], "bc": gc[d], "wo": go[:, :d], "bo": go[:, d]}
        return (loss + part) * scale, h.T, g

    def train(self, ids: np.ndarray, streams: int = 64, window: int = 32, epochs: int = 2, rate: float = 4e-3) -> list[float]:
        """Truncated backpropagation over ``ids``, texts in a row that each end with the end token (the last id)."""
        per = len(ids) // streams
        if per < 2:
            return []
        y = ids[: per * streams].reshape(streams, per).T
        end = self.size - 1
        x = np.concatenate([np.full((1, streams), self.start), np.where(y[:-1] == end, self.start, y[:-1])])
        m1 = {k: np.zeros_like(getattr(self, k)) for k in self.NAMES}
        m2 = {k: np.zeros_like(getattr(self, k)) for k in self.NAMES}
        np.empty(1 << 24, np.uint8)  # once such a block was freed, malloc keeps the windows' memory, which they would ask for page by page
        losses, t = [], 0
        n_steps = epochs * -(-per // window)
        for _ in range(epochs):
            h = np.zeros((streams, self.hidden), np.float32)
            for a in range(0, per, window):
                loss, h_next, g = self._window(x[a : a + window], y[a : a + window], h)
                h = np.where((y[min(a + window, per) - 1] == end)[:, None], 0, h_next).astype(np.float32)
                losses.append(float(loss))
                t += 1
                norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
                clip = min(1.0, 1.0 / (float(norm) + 1e-9))
                lr = rate * (1 - 0.9 * t / n_steps)
                for k in self.NAMES:
                    v = g[k] * clip
                    m1[k] = 0.9 * m1[k] + 0.1 * v
                    m2[k] = 0.99 * m2[k] + 0.01 * v * v
                    w = getattr(self, k)
                    w -= (lr * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
        return losses

    def score(self, ids: np.ndarray, bounds: np.ndarray, group: int = 1024, window: int = 32) -> np.ndarray:
        """Natural-log likelihood of each text ``ids[bounds[i]:bounds[i + 1]]``, the state starting at zero."""
        length = np.diff(bounds)
        out = np.zeros(len(length))
        order = np.argsort(-length, kind="stable")
        emb, wx, wc, wo = self._transposed()
        wh = np.ascontiguousarray(self.wh.T)
        for first in range(0, len(order), group):
            docs = order[first : first + group]
            docs = docs[length[docs] > 0]
            if not len(docs):
                continue
            starts, most = bounds[docs], int(length[docs[0]])
            longer = len(docs) - np.searchsorted(length[docs][::-1], np.arange(most), side="right")  # texts longer than t, which come first
            h = np.zeros((self.hidden, len(docs)), np.float32)
            previous = np.full(len(docs), self.start)
            states, ys, who, held = [], [], [], 0
            for t, n in enumerate(longer.tolist()):
                if n < len(previous):
                    h, previous = h[:, :n].copy(), previous[:n]
                h, _ = self._step(wx @ emb.take(previous, axis=1, mode="clip"), h, wh)
                previous = ids[starts[:n] + t]
                states.append(h)
                ys.append(previous)
                who.append(docs[:n])
                held += n
                if held >= window * 256 or t + 1 == most:
                    lp = self._log_probs(_with_ones(states), np.concatenate(ys), wc, wo)
                    out += np.bincount(np.concatenate(who), lp, len(out))
                    states, ys, who, held = [], [], [], 0
        return out
