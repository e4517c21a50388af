"""A small bidirectional gated recurrent network over characters and words, in numpy.

Each word is its own vector joined with the last states of a character network run both ways over its
characters; a word network runs both ways over a window of words; attention pools its states to one value.
"""

from __future__ import annotations

import numpy as np

MAX_CHARS = 32   # longer words are cut into pieces of this length, all of which are read
CHARS = 512      # code points modulo this


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class GRU:
    """One direction. Shapes: x (T, N, D), mask (T, N, 1); the state stays where the mask is 0."""

    def __init__(self, p: dict, name: str, reverse: bool) -> None:
        self.w, self.u, self.b = (p[f"{name}.{k}"] for k in "wub")
        self.name, self.reverse, self.size = name, reverse, p[f"{name}.u"].shape[0]

    def forward(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        steps, n, _ = x.shape
        s = self.size
        h = np.zeros((n, s), np.float32)
        out = np.empty((steps, n, s), np.float32)
        self.kept = {}
        for t in (range(steps - 1, -1, -1) if self.reverse else range(steps)):
            a, v = x[t] @ self.w + self.b, h @ self.u
            zr = sigmoid(a[:, :2 * s] + v[:, :2 * s])
            z, r = zr[:, :s], zr[:, s:]
            c = np.tanh(a[:, 2 * s:] + r * v[:, 2 * s:])
            self.kept[t] = (h, z, r, c, v[:, 2 * s:])
            h = h + mask[t] * (c - h) * (1 - z)
            out[t] = h
        self.x, self.mask = x, mask
        return out

    def backward(self, dout: np.ndarray, grads: dict) -> np.ndarray:
        steps = dout.shape[0]
        dw, du, db = np.zeros_like(self.w), np.zeros_like(self.u), np.zeros_like(self.b)
        dx = np.empty_like(self.x)
        dh = np.zeros_like(dout[0])
        for t in (range(steps) if self.reverse else range(steps - 1, -1, -1)):
            before, z, r, c, vc = self.kept[t]
            dh = dh + dout[t]
            dm = dh * self.mask[t]
            dc = dm * (1 - z) * (1 - c * c)
            dz = dm * (before - c) * z * (1 - z)
            dr = dc * vc * r * (1 - r)
            da = np.concatenate([dz, dr, dc], 1)
            dv = np.concatenate([dz, dr, dc * r], 1)
            dw += self.x[t].T @ da
            du += before.T @ dv
            db += da.sum(0)
            dx[t] = da @ self.w.T
            dh = dh * (1 - self.mask[t]) + dm * z + dv @ self.u.T
        for k, g in (("w", dw), ("u", du), ("b", db)):
            grads[f"{self.name}.{k}"] = grads.get(f"{self.name}.{k}", 0) + g
        return dx


def parameters(words: int, seed: int, word_dim: int = 8, char_dim: int = 8, char_size: int = 6,
               size: int = 8, attention: int = 8) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)

    def random(*shape: int, scale: float | None = None) -> np.ndarray:
        return (rng.standard_normal(shape) * (scale or (1 / np.sqrt(shape[0])))).astype(np.float32)

    p = {"words": random(words, word_dim, scale=0.1), "chars": random(CHARS, char_dim, scale=0.3)}
    for name, d, s in (("cf", char_dim, char_size), ("cb", char_dim, char_size),
                       ("wf", word_dim + 2 * char_size, size), ("wb", word_dim + 2 * char_size, size)):
        p |= {f"{name}.w": random(d, 3 * s), f"{name}.u": random(s, 3 * s), f"{name}.b": np.zeros(3 * s, np.float32)}
    return p | {"att.w": random(2 * size, attention), "att.b": np.zeros(attention, np.float32),
                "att.v": random(attention), "out.w": random(2 * size), "out.b": np.zeros(1, np.float32)}


class Network:
    """Training pass: logits of windows of words and gradients of their cross entropy."""

    def __init__(self, p: dict) -> None:
        self.p = p

    def forward(self, word_ids: np.ndarray, chars: np.ndarray, lengths: np.ndarray, windows: np.ndarray,
                mask: np.ndarray) -> np.ndarray:
        """``windows`` (T, N) index rows of ``word_ids``/``chars`` (the words of this batch)."""
        p = self.p
        self.ids, self.chars, self.windows = word_ids, chars, windows
        cmask = (np.arange(chars.shape[0])[:, None] < lengths[None]).astype(np.float32)[..., None]
        cx = p["chars"][chars]
        self.cf, self.cb = GRU(p, "cf", False), GRU(p, "cb", True)
        last, first = self.cf.forward(cx, cmask)[-1], self.cb.forward(cx, cmask)[0]
        self.vec = np.concatenate([p["words"][word_ids], last, first], 1)
        x, m = self.vec[windows], mask[..., None].astype(np.float32)
        self.wf, self.wb = GRU(p, "wf", False), GRU(p, "wb", True)
        h = np.concatenate([self.wf.forward(x, m), self.wb.forward(x, m)], 2)
        u = np.tanh(h @ p["att.w"] + p["att.b"])
        s = np.where(mask, u @ p["att.v"], -1e9)
        e = np.exp(s - s.max(0)) * mask
        share = e / np.maximum(e.sum(0), 1e-9)
        pooled = (share[..., None] * h).sum(0)
        self.state = h, u, share, pooled
        return pooled @ p["out.w"] + p["out.b"][0]

    def backward(self, dlogit: np.ndarray) -> dict[str, np.ndarray]:
        p, (h, u, share, pooled) = self.p, self.state
        g: dict[str, np.ndarray] = {"out.w": pooled.T @ dlogit, "out.b": dlogit.sum(keepdims=True)}
        dpool = dlogit[:, None] * p["out.w"]
        dshare = (h * dpool[None]).sum(2)
        ds = share * (dshare - (share * dshare).sum(0))
        g["att.v"] = (u * ds[..., None]).sum((0, 1))
        du = ds[..., None] * p["att.v"] * (1 - u * u)
        g["att.w"], g["att.b"] = np.einsum("tnh,tna->ha", h, du), du.sum((0, 1))
        dh = share[..., None] * dpool[None] + du @ p["att.w"].T
        s = self.wf.size
        dx = self.wf.backward(dh[..., :s], g) + self.wb.backward(dh[..., s:], g)
        dvec = np.zeros_like(self.vec)
        np.add.at(dvec, self.windows.ravel(), dx.reshape(-1, dx.shape[2]))
        d = p["words"].shape[1]
        g["words"] = np.zeros_like(p["words"])
        np.add.at(g["words"], self.ids, dvec[:, :d])
        c = self.cf.size
        dlast = np.zeros((*self.chars.shape, c), np.float32)
        dfirst = dlast.copy()
        dlast[-1], dfirst[0] = dvec[:, d:d + c], dvec[:, d + c:]
        dc = self.cf.backward(dlast, g) + self.cb.backward(dfirst, g)
        g["chars"] = np.zeros_like(p["chars"])
        np.add.at(g["chars"], self.chars.ravel(), dc.reshape(-1, dc.shape[2]))
        return g


class Adam:
    def __init__(self, p: dict, rate: float, decay: float) -> None:
        self.p, self.rate, self.decay, self.t = p, rate, decay, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, grads: dict) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        clip = min(1.0, 5.0 / (norm + 1e-9))
        for k, g in grads.items():
            g = g * clip
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            m, v = self.m[k] / (1 - 0.9 ** self.t), self.v[k] / (1 - 0.999 ** self.t)
            self.p[k] -= self.rate * (m / (np.sqrt(v) + 1e-8) + self.decay * self.p[k])


def _run(proj: np.ndarray, u: np.ndarray, codes: np.ndarray, mask: np.ndarray | None, keep: bool,
         reverse: bool) -> np.ndarray:
    """States (steps, size, rows) or the last state (size, rows) for rows of projected inputs.

    Gates lie in rows, so that every operation runs over contiguous memory. The z and r parts of
    ``proj`` and ``u`` are halved beforehand.
    """
    steps, n = codes.shape
    s = u.shape[0]
    ut = np.ascontiguousarray(u.T)
    h = np.zeros((s, n), np.float32)
    out = np.empty((steps, s, n), np.float32) if keep else None
    rows, a, v = np.empty((n, 3 * s), np.float32), np.empty((3 * s, n), np.float32), np.empty((3 * s, n), np.float32)
    zr, z, r, c, vc = a[:2 * s], a[:s], a[s:2 * s], a[2 * s:], v[2 * s:]
    for t in (range(steps - 1, -1, -1) if reverse else range(steps)):
        np.take(proj, codes[t], axis=0, out=rows, mode="clip")
        np.copyto(a, rows.T)
        np.matmul(ut, h, out=v)
        zr += v[:2 * s]
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        vc *= r
        c += vc
        np.tanh(c, out=c)
        h -= c
        h *= z
        h += c
        if mask is not None:
            h *= mask[t]
        if keep:
            out[t] = h
    return out if keep else h


class Scorer:
    """Fast scoring: inputs are projected once per distinct word, then gathered for every window."""

    def __init__(self, p: dict) -> None:
        self.p = {k: v.copy() for k, v in p.items()}
        for name in ("cf", "cb", "wf", "wb"):
            s = p[f"{name}.u"].shape[0]
            for k in "wub":
                self.p[f"{name}.{k}"][..., :2 * s] *= 0.5

    def words(self, ids: np.ndarray, points: np.ndarray, starts: np.ndarray, lengths: np.ndarray,
              block: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """Projected inputs of both directions for words given as code points."""
        p = self.p
        char_in = {k: p["chars"] @ p[f"{k}.w"] + p[f"{k}.b"] for k in ("cf", "cb")}
        c = p["cf.u"].shape[0]
        ends = np.empty((len(ids), 2 * c), np.float32)
        order = np.argsort(lengths, kind="stable")
        for at in range(0, len(order), block):
            rows = order[at:at + block]
            n = lengths[rows]
            t = np.arange(int(n.max()))[:, None]
            back = t < n[None]
            forward = t >= (n.max() - n)[None]  # aligned at the right, so that the last state is the word's
            left = np.where(back, points[np.minimum(starts[rows][None] + t, len(points) - 1)], 0)
            right = np.where(forward, points[np.maximum(starts[rows][None] + t - (n.max() - n)[None], 0)], 0)
            mf, mb = (None if m.all() else m.astype(np.float32) for m in (forward, back))
            ends[rows, :c] = _run(char_in["cf"], p["cf.u"], right, mf, False, False).T
            ends[rows, c:] = _run(char_in["cb"], p["cb.u"], left, mb, False, True).T
        x = np.concatenate([p["words"][ids], ends], 1)
        return x @ p["wf.w"] + p["wf.b"], x @ p["wb.w"] + p["wb.b"]

    def windows(self, forward: np.ndarray, backward: np.ndarray, codes: np.ndarray, starts: np.ndarray,
                ends: np.ndarray, width: int, block: int = 2048) -> np.ndarray:
        """Logit of each window, given by where it starts and where its text ends in ``codes``."""
        p = self.p
        out = np.empty(len(starts), np.float32)
        t = np.arange(width)[:, None]
        for at in range(0, len(starts), block):
            where = starts[at:at + block][None] + t
            mask = where < ends[at:at + block][None]
            full = bool(mask.all())
            ids = codes[np.where(mask, where, 0)] if len(codes) else np.zeros(where.shape, np.int64)
            m = None if full else mask.astype(np.float32)
            h = np.concatenate([_run(forward, p["wf.u"], ids, None, True, False),
                                _run(backward, p["wb.u"], ids, m, True, True)], 1)
            s = p["att.v"] @ np.tanh(p["att.w"].T @ h + p["att.b"][:, None])
            if not full:
                s = np.where(mask, s, -1e9)
            e = np.exp(s - s.max(0))
            if not full:
                e *= mask
            e /= np.maximum(e.sum(0), 1e-9)
            out[at:at + block] = ((p["out.w"] @ h) * e).sum(0) + p["out.b"][0]
        return out
