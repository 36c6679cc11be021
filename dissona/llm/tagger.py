"""A character-level bidirectional LSTM with CRF transitions, in numpy: training, scoring and Viterbi decoding."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

CHARS = 98  # 0 padding, 1-95 printable ASCII, 96 other letters, 97 the rest


def char_ids(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.where((c >= 32) & (c < 127), c - 31, 97)
    return np.where(c >= 0xC0, 96, out).astype(np.int64)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Tagger:
    """Tags are 0 outside, then begin and inside of each kind. Direction 0 reads forwards, 1 backwards."""

    kinds: list[str]
    hidden: int = 16
    width: int = 12
    w: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self):
        self.tags = 1 + 2 * len(self.kinds)
        allowed = np.ones((self.tags, self.tags), bool)
        for k in range(len(self.kinds)):
            allowed[:, 2 + 2 * k] = False
            allowed[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = True
        self.forbidden = np.where(allowed, 0, -1e4).astype(np.float32)
        self.start = np.where(np.arange(self.tags) % 2 == 0, -1e4, 0).astype(np.float32)
        self.start[0] = 0

    def init(self, rng: np.random.Generator) -> None:
        h, d, k = self.hidden, self.width, self.tags
        self.w = {"e": rng.normal(0, 0.3, (CHARS, d)), "v": rng.normal(0, 0.2, (2 * h, k)), "c": np.zeros(k), "t": np.zeros((k, k))}
        for s in "01":
            b = np.zeros(4 * h)
            b[h : 2 * h] = 1  # remember at first
            self.w |= {"x" + s: rng.normal(0, 0.3, (d, 4 * h)), "h" + s: rng.normal(0, 0.2, (h, 4 * h)), "b" + s: b}
        self.w = {n: x.astype(np.float32) for n, x in self.w.items()}

    def _read(self, ids: np.ndarray, s: str, keep: bool) -> tuple[np.ndarray, list]:
        w, hid = self.w, self.hidden
        n, size = ids.shape
        table = w["e"] @ w["x" + s] + w["b" + s]
        h, c = np.zeros((n, hid), np.float32), np.zeros((n, hid), np.float32)
        out, steps = np.empty((n, size, hid), np.float32), []
        for t in range(size) if s == "0" else range(size - 1, -1, -1):
            z = table[ids[:, t]] + h @ w["h" + s]
            i, f, o = (sigmoid(z[:, k * hid : (k + 1) * hid]) for k in (0, 1, 3))
            g = np.tanh(z[:, 2 * hid : 3 * hid])
            before = (h, c)
            c = f * c + i * g
            y = np.tanh(c)
            h = o * y
            out[:, t] = h
            if keep:
                steps.append((t, before, i, f, g, o, y))
        return out, steps

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """windows x characters x tags."""
        both = np.concatenate([self._read(ids, s, False)[0] for s in "01"], 2)
        return both @ self.w["v"] + self.w["c"]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The best tag sequence of each window (Viterbi)."""
        e = self.emissions(ids)
        n, size, k = e.shape
        step = self.w["t"] + self.forbidden
        score, back = e[:, 0] + self.start, np.zeros((n, size, k), np.int8)
        for t in range(1, size):
            both = score[:, :, None] + step
            back[:, t] = both.argmax(1)
            score = both.max(1) + e[:, t]
        out = np.zeros((n, size), np.int8)
        out[:, -1] = score.argmax(1)
        for t in range(size - 1, 0, -1):
            out[:, t - 1] = back[np.arange(n), t, out[:, t]]
        return out

    def gradients(self, ids: np.ndarray, gold: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the gold tags a window, and its gradients."""
        w, hid, k = self.w, self.hidden, self.tags
        n, size = ids.shape
        reads = {s: self._read(ids, s, True) for s in "01"}
        both = np.concatenate([reads["0"][0], reads["1"][0]], 2)
        e = both @ w["v"] + w["c"]
        step = w["t"] + self.forbidden
        log = lambda x, axis: (m := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis))
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0] + self.start
        for t in range(1, size):
            alpha[:, t] = log(alpha[:, t - 1][:, :, None] + step, 1) + e[:, t]
        for t in range(size - 2, -1, -1):
            beta[:, t] = log(step + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        z = log(alpha[:, -1], 1)
        rows, cols = np.arange(n)[:, None], np.arange(size)
        loss = float((z - e[rows, cols, gold].sum(1) - step[gold[:, :-1], gold[:, 1:]].sum(1) - self.start[gold[:, 0]]).mean())
        de = np.exp(alpha + beta - z[:, None, None])
        de[rows, cols, gold] -= 1
        dt = np.zeros((k, k), np.float32)
        for t in range(1, size):
            dt += np.exp(alpha[:, t - 1][:, :, None] + step + (e[:, t] + beta[:, t])[:, None, :] - z[:, None, None]).sum(0)
        np.subtract.at(dt, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
        de, dt = de / n, dt / n
        grads = {"t": dt, "c": de.sum((0, 1)), "v": both.reshape(-1, 2 * hid).T @ de.reshape(-1, k), "e": np.zeros_like(w["e"])}
        dboth = de @ w["v"].T
        one = (ids.reshape(-1, 1) == np.arange(CHARS)).astype(np.float32)
        for s in "01":
            dout = dboth[:, :, :hid] if s == "0" else dboth[:, :, hid:]
            dh_w = np.zeros_like(w["h" + s])
            dzs = np.empty((n, size, 4 * hid), np.float32)
            dh, dc = np.zeros((n, hid), np.float32), np.zeros((n, hid), np.float32)
            for t, (h0, c0), i, f, g, o, y in reversed(reads[s][1]):
                dh = dh + dout[:, t]
                dc = dc + dh * o * (1 - y * y)
                dz = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dc * i * (1 - g * g), dh * y * o * (1 - o)], 1)
                dzs[:, t] = dz
                dh_w += h0.T @ dz
                dh, dc = dz @ w["h" + s].T, dc * f
            dtable = one.T @ dzs.reshape(-1, 4 * hid)
            grads |= {"h" + s: dh_w, "b" + s: dtable.sum(0), "x" + s: w["e"].T @ dtable}
            grads["e"] += dtable @ w["x" + s].T
        return loss, grads

    def fit(self, ids: np.ndarray, gold: np.ndarray, steps: int = 450, batch: int = 48, rate: float = 0.02, seed: int = 3) -> list[float]:
        """Adam with clipped gradients over random batches; the losses."""
        rng = np.random.default_rng(seed)
        self.init(rng)
        m, v = ({n: np.zeros_like(x) for n, x in self.w.items()} for _ in range(2))
        losses = []
        for k in range(1, steps + 1):
            rows = rng.integers(0, len(ids), batch)
            loss, grads = self.gradients(ids[rows], gold[rows])
            losses.append(loss)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            now = rate * (1 if k < 0.7 * steps else 0.3)
            for name, g in grads.items():
                g = g * min(1, 5 / (norm + 1e-9))
                m[name] += 0.1 * (g - m[name])
                v[name] += 0.001 * (g * g - v[name])
                self.w[name] -= (now * (m[name] / (1 - 0.9**k)) / (np.sqrt(v[name] / (1 - 0.999**k)) + 1e-8)).astype(np.float32)
        return losses
