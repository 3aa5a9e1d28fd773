"""Character tagger: bidirectional LSTM with CRF transitions, forward, backward and decoding in numpy."""

from __future__ import annotations

import numpy as np

#: Character ids: 0 padding, 1..128 ASCII, then letters, digits, white space and other characters beyond it.
ALPHABET = 133


def char_ids(text: str) -> np.ndarray:
    out = np.empty(len(text), np.int64)
    for i, c in enumerate(text):
        o = ord(c)
        out[i] = o + 1 if o < 128 else 129 if c.isalpha() else 130 if c.isdigit() else 131 if c.isspace() else 132
    return out


def _logsumexp(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def _sigmoid(a: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(a, -30, 30)))


class Tagger:
    """Emissions per character and tag; ``forbidden`` transitions keep a large negative score."""

    def __init__(self, tags: int, forbidden: np.ndarray, embed: int = 16, hidden: int = 24, seed: int = 11):
        r = np.random.default_rng(seed)
        n = lambda *s: (r.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
        self.hidden, self.forbidden = hidden, forbidden
        self.p = {"embed": r.normal(scale=0.3, size=(ALPHABET, embed)).astype(np.float32), "out": n(2 * hidden, tags),
                  "bias": np.zeros(tags, np.float32), "trans": np.zeros((tags, tags), np.float32)}
        for d in "fb":
            self.p |= {f"x{d}": n(embed, 4 * hidden), f"h{d}": n(hidden, 4 * hidden), f"c{d}": np.zeros(4 * hidden, np.float32)}
            self.p[f"c{d}"][hidden:2 * hidden] = 1.0

    def _lstm(self, x: np.ndarray, d: str, mask: np.ndarray, keep: list | None) -> np.ndarray:
        n, w, _ = x.shape
        hd = self.hidden
        h, c = np.zeros((n, hd), np.float32), np.zeros((n, hd), np.float32)
        out, zx = np.zeros((n, w, hd), np.float32), x @ self.p[f"x{d}"] + self.p[f"c{d}"]
        for t in range(w) if d == "f" else range(w - 1, -1, -1):
            z = zx[:, t] + h @ self.p[f"h{d}"]
            s, g = _sigmoid(z[:, :3 * hd]), np.tanh(z[:, 3 * hd:])
            m = mask[:, t, None]
            new = s[:, hd:2 * hd] * c + s[:, :hd] * g
            th = np.tanh(new)
            if keep is not None:
                keep.append((t, h, c, s, g, th, m))
            c = np.where(m, new, c)
            h = np.where(m, s[:, 2 * hd:] * th, h)
            out[:, t] = h
        return out

    def emissions(self, ids: np.ndarray, keep: dict | None = None) -> np.ndarray:
        mask, x = ids > 0, self.p["embed"][ids]
        kf, kb = ([], []) if keep is not None else (None, None)
        y = np.concatenate((self._lstm(x, "f", mask, kf), self._lstm(x, "b", mask, kb)), axis=2)
        if keep is not None:
            keep |= {"f": kf, "b": kb, "y": y, "x": x}
        return y @ self.p["out"] + self.p["bias"]

    def transitions(self) -> np.ndarray:
        return np.where(self.forbidden, np.float32(-1e4), self.p["trans"])

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags of every window (rows padded with 0), and each character's margin over the best other emission."""
        e, tr, mask = self.emissions(ids), self.transitions(), ids > 0
        n, w, k = e.shape
        score, back = e[:, 0].copy(), np.zeros((n, w, k), np.int64)
        score[:, self.forbidden[0]] = -1e4  # a span cannot go on at the start, as it cannot behind O
        for t in range(1, w):
            s = score[:, :, None] + tr
            back[:, t] = s.argmax(1)
            score = np.where(mask[:, t, None], s.max(1) + e[:, t], score)
            back[:, t] = np.where(mask[:, t, None], back[:, t], np.arange(k))
        tags = np.zeros((n, w), np.int64)
        tags[:, -1] = score.argmax(1)
        for t in range(w - 1, 0, -1):
            tags[:, t - 1] = np.take_along_axis(back[:, t], tags[:, t, None], 1)[:, 0]
        tags = np.where(mask, tags, 0)
        mine = np.take_along_axis(e, tags[:, :, None], 2)[:, :, 0]
        other = e.copy()
        np.put_along_axis(other, tags[:, :, None], -np.inf, 2)
        return tags, mine - other.max(2)

    def gradients(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the tags, and its gradients."""
        keep: dict = {}
        e, tr, mask = self.emissions(ids, keep), self.transitions(), ids > 0
        n, w, k = e.shape
        alpha, beta = np.empty((w, n, k), np.float32), np.zeros((w, n, k), np.float32)
        alpha[0] = e[:, 0]
        for t in range(1, w):
            a = _logsumexp(alpha[t - 1][:, :, None] + tr, 1) + e[:, t]
            alpha[t] = np.where(mask[:, t, None], a, alpha[t - 1])
        for t in range(w - 2, -1, -1):
            b = _logsumexp(tr + (e[:, t + 1] + beta[t + 1])[:, None, :], 2)
            beta[t] = np.where(mask[:, t + 1, None], b, beta[t + 1])
        z = _logsumexp(alpha[-1], 1)
        de = np.exp(np.clip(alpha + beta - z[None, :, None], -50, 0)).transpose(1, 0, 2) * mask[:, :, None]
        rows, cols = np.nonzero(mask)
        de[rows, cols, tags[rows, cols]] -= 1
        gold = np.where(mask, np.take_along_axis(e, tags[:, :, None], 2)[:, :, 0], 0).sum(1)
        dt = np.zeros((k, k), np.float32)
        for t in range(1, w):
            m = mask[:, t]
            if m.any():
                p = alpha[t - 1][m][:, :, None] + tr + (e[m, t] + beta[t][m])[:, None, :] - z[m][:, None, None]
                dt += np.exp(np.clip(p, -50, 0)).sum(0)
                np.add.at(dt, (tags[m, t - 1], tags[m, t]), -1)
                gold[m] += tr[tags[m, t - 1], tags[m, t]]
        g = {"trans": np.where(self.forbidden, 0, dt), "out": keep["y"].reshape(-1, 2 * self.hidden).T @ de.reshape(-1, k), "bias": de.sum((0, 1))}
        dy, dx = de @ self.p["out"].T, np.zeros_like(keep["x"])
        for d, part in (("f", dy[:, :, :self.hidden]), ("b", dy[:, :, self.hidden:])):
            dx += self._lstm_back(keep["x"], d, keep[d], part, g)
        g["embed"] = np.zeros_like(self.p["embed"])
        np.add.at(g["embed"], ids, dx)
        return float((z - gold).mean()), {name: v / n for name, v in g.items()}

    def _lstm_back(self, x, d, steps, dy, g) -> np.ndarray:
        hd = self.hidden
        dz_all, dh, dc = np.zeros((*x.shape[:2], 4 * hd), np.float32), 0.0, 0.0
        dhh = np.zeros_like(self.p[f"h{d}"])
        for t, h, c, s, tanh_g, th, m in reversed(steps):
            gh = dy[:, t] + dh
            live, dead = np.where(m, gh, 0), np.where(m, 0, gh)
            i, f, o = s[:, :hd], s[:, hd:2 * hd], s[:, 2 * hd:]
            dnew = np.where(m, dc, 0) + live * o * (1 - th * th)
            dz = np.concatenate((dnew * tanh_g * i * (1 - i), dnew * c * f * (1 - f), live * th * o * (1 - o), dnew * i * (1 - tanh_g ** 2)), 1)
            dz_all[:, t] = dz
            dhh += h.T @ dz
            dh = dz @ self.p[f"h{d}"].T + dead
            dc = dnew * f + np.where(m, 0, dc)
        g[f"h{d}"], g[f"c{d}"] = dhh, dz_all.sum((0, 1))
        g[f"x{d}"] = x.reshape(-1, x.shape[2]).T @ dz_all.reshape(-1, 4 * hd)
        return dz_all @ self.p[f"x{d}"].T

    def train(self, windows: list[tuple[np.ndarray, np.ndarray]], epochs: int, batch: int = 64, rate: float = 8e-3, seed: int = 3) -> float:
        """Adam over (ids, tags) windows; returns the last epoch's mean loss."""
        r, m, v, step, loss = np.random.default_rng(seed), {}, {}, 0, 0.0
        for epoch in range(epochs):
            order, total, seen = r.permutation(len(windows)), 0.0, 0
            for at in range(0, len(order), batch):
                ids, tags = pad([windows[i] for i in order[at:at + batch]])
                one, grads = self.gradients(ids, tags)
                step += 1
                total, seen = total + one, seen + 1
                lr = rate * (0.3 if epoch >= epochs - 1 else 1.0)
                for name, grad in grads.items():
                    grad = np.clip(grad, -1, 1)
                    m[name] = 0.9 * m.get(name, 0) + 0.1 * grad
                    v[name] = 0.99 * v.get(name, 0) + 0.01 * grad * grad
                    self.p[name] -= (lr * (m[name] / (1 - 0.9 ** step)) / (np.sqrt(v[name] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
            loss = total / max(1, seen)
        return loss


def pad(windows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    w = max(len(a) for a, _ in windows)
    ids, tags = np.zeros((len(windows), w), np.int64), np.zeros((len(windows), w), np.int64)
    for i, (a, b) in enumerate(windows):
        ids[i, :len(a)], tags[i, :len(b)] = a, b
    return ids, tags
