"""A gated recurrent unit over word symbols, with a softmax over classes and one over the words of a class, in numpy.

Symbols are ordered by their counts and dealt to classes of WIDTH in this order. Inputs are symbols, so the input
matrix is a table of rows. States and gates are held component by component, a lane a column. A text's last symbol is its end, which is also the input before the next text's first
one: wherever the input is the end, the state starts afresh.
"""

from __future__ import annotations

import numpy as np

F32 = np.float32
WIDTH = 16


def _sign(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), in place of the hyperbolic tangent: a few operations where that takes many."""
    size = np.abs(x)
    size += F32(1)
    return np.divide(x, size, out=size)


def _exp_and_log_sum(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The exponentials of each column, their sum, and its log."""
    np.clip(x, F32(-60), F32(60), out=x)
    e = np.exp(x)
    total = e.sum(axis=0)
    return e, total, np.log(total)


def _rows_summed(to: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """to[at] += rows, rows of one place together."""
    order = np.argsort(at.astype(np.uint16), kind="stable")
    s = at[order]
    edge = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    to[s[edge]] += np.add.reduceat(np.take(rows, order, axis=0), edge, axis=0)


class Model:
    """Parameters by name in one vector, with the squares of their gradients so far (Adagrad) in another."""

    def __init__(self, symbols: int, hidden: int):
        self.classes, self.hidden = -(-symbols // WIDTH), hidden
        n, h, c = self.classes * WIDTH, hidden, self.classes
        self.shapes = {"x": (n, 3 * h), "u": (3 * h, h), "b": (3 * h,), "cw": (c, h), "cb": (c,), "ow": (c, WIDTH, h), "ob": (c, WIDTH)}
        self.size = sum(int(np.prod(s)) for s in self.shapes.values())
        self.flat, self.seen = np.zeros(self.size, F32), np.zeros(self.size, F32)
        self._views()

    def _views(self) -> None:
        self.p, self.g2, at = {}, {}, 0
        for name, shape in self.shapes.items():
            n = int(np.prod(shape))
            self.p[name], self.g2[name] = self.flat[at : at + n].reshape(shape), self.seen[at : at + n].reshape(shape)
            at += n

    def start(self, counts: np.ndarray, seed: int = 3) -> Model:
        """Small random weights, and biases that give each symbol its share of the counts (descending)."""
        rng, p = np.random.default_rng(seed), self.p
        for name in ("x", "u", "cw", "ow"):
            p[name][...] = rng.normal(0, 0.1, p[name].shape)
        p["b"][: self.hidden] = 1  # the state lasts at first
        full = np.zeros(self.classes * WIDTH)
        full[: len(counts)] = counts + 0.5
        full = full.reshape(self.classes, WIDTH)
        p["cb"][...] = np.log(full.sum(1) / full.sum())
        p["ob"][...] = np.where(full > 0, np.log(np.maximum(full, 1e-9) / full.sum(1, keepdims=True)), -30)
        self.seen[...] = 1e-4
        return self

    @classmethod
    def of(cls, symbols: int, hidden: int, state: bytes) -> Model:
        own = cls(symbols, hidden)
        both = np.frombuffer(state, F32)
        own.flat[...], own.seen[...] = both[: own.size], both[own.size :]
        return own

    def state(self) -> bytes:
        return self.flat.tobytes() + self.seen.tobytes()

    def step(self, x: np.ndarray, h: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, ...]:
        """One step of all lanes (columns): the new state, and what the gradient needs."""
        k = self.hidden
        h = h * (~fresh).astype(F32)
        a, u = np.take(self.p["x"], x, axis=0).T, self.p["u"] @ h
        s = _sign(a[: 2 * k] + u[: 2 * k])
        zr = s * F32(0.5)
        zr += F32(0.5)
        n = zr[k:] * u[2 * k :]
        n += a[2 * k :]
        n = _sign(n)
        out = h - n
        out *= zr[:k]
        out += n
        return out, h, s, zr, n, u

    def outputs(self, h: np.ndarray, y: np.ndarray, gradient: bool = False):
        """The natural log of each symbol's probability; with `gradient` also that of the sum by h and by the output parameters."""
        p, kind = self.p, (y // WIDTH).astype(np.uint16)
        order = np.argsort(kind.astype(np.uint8) if self.classes <= 256 else kind, kind="stable")
        y, h, rows = y[order], np.take(h, order, axis=1), np.arange(len(y))
        kind = y // WIDTH
        place, edges = y - kind * WIDTH, np.searchsorted(kind, np.arange(self.classes + 1))
        x = p["cw"] @ h
        x += p["cb"][:, None]
        chosen = x[kind, rows]
        e, total, logs = _exp_and_log_sum(x)
        sorted_out = (chosen - logs).astype(np.float64)
        if gradient:
            e *= F32(-1) / total
            e[kind, rows] += 1
            grads = {"cw": e @ h.T, "cb": e.sum(1), "ow": np.zeros_like(p["ow"]), "ob": np.zeros_like(p["ob"])}
            dh = p["cw"].T @ e
        for c in range(self.classes):
            lo, hi = edges[c], edges[c + 1]
            if lo == hi:
                continue
            hs, here, spot = h[:, lo:hi], rows[: hi - lo], place[lo:hi]
            x = p["ow"][c] @ hs
            x += p["ob"][c][:, None]
            chosen = x[spot, here]
            e, total, logs = _exp_and_log_sum(x)
            sorted_out[lo:hi] += chosen - logs
            if gradient:
                e *= F32(-1) / total
                e[spot, here] += 1
                grads["ow"][c], grads["ob"][c] = e @ hs.T, e.sum(1)
                dh[:, lo:hi] += p["ow"][c].T @ e
        out = np.empty(len(y))
        out[order] = sorted_out
        if not gradient:
            return out
        back = np.empty_like(dh)
        back[:, order] = dh
        return out, back, grads

    def train(self, stream: np.ndarray, end: int, lanes: int, window: int, rate: float) -> float:
        """Climb the log-likelihood of a stream of whole texts by truncated backpropagation: `lanes` stretches side by side, the state carried from window to window, the gradient not. The mean log before each update."""
        lanes = max(1, min(lanes, len(stream) // (64 * window)))
        length = len(stream) // lanes
        y = stream[: lanes * length].reshape(lanes, length)
        rest = stream[lanes * length :]
        x = np.concatenate([np.append(end, stream[length - 1 : lanes * length - 1 : length])[:lanes, None], y[:, :-1]], axis=1)
        h, total = np.zeros((self.hidden, lanes), F32), 0.0
        for at in range(0, length, window):
            h, got = self._window(x[:, at : at + window].T, y[:, at : at + window].T, h, end, rate)
            total += got
        if len(rest):  # what the lanes left over
            total += self._window(np.append(stream[-len(rest) - 1] if len(rest) < len(stream) else end, rest[:-1])[:, None], rest[:, None], h[:, -1:], end, rate)[1]
        return total / max(1, len(stream))

    def _window(self, x: np.ndarray, y: np.ndarray, h: np.ndarray, end: int, rate: float) -> tuple[np.ndarray, float]:
        k, u = self.hidden, self.p["u"]
        trail = []
        self.p["x"] += self.p["b"]  # while the window runs, each input's row holds the bias too
        for t in range(len(x)):
            now = self.step(x[t], h, x[t] == end)
            h = now[0]
            trail.append(now)
        self.p["x"] -= self.p["b"]
        logs, dh_out, grads = self.outputs(np.concatenate([s[0] for s in trail], axis=1), y.ravel(), gradient=True)
        dh_out = dh_out.reshape(k, len(x), -1)
        da_all, dh = np.empty((len(x), 3 * k, x.shape[1]), F32), np.zeros_like(h)
        du = np.zeros_like(u)
        for t in range(len(x) - 1, -1, -1):
            _, before, s, zr, n, un = trail[t]
            z, r = zr[:k], zr[k:]
            dh += dh_out[:, t]
            da = da_all[t]
            slope = F32(1) - np.abs(s)
            slope *= slope
            slope *= F32(0.5)
            bend = F32(1) - np.abs(n)
            bend *= bend
            bend *= dh
            bend *= F32(1) - z
            da[2 * k :] = bend
            np.multiply(dh, before - n, out=da[:k])
            np.multiply(bend, un[2 * k :], out=da[k : 2 * k])
            da[: 2 * k] *= slope
            back = da.copy()
            back[2 * k :] *= r
            du += back @ before.T
            dh = dh * z
            dh += u.T @ back
            dh *= (x[t] != end).astype(F32)
        flat = da_all.transpose(0, 2, 1).reshape(-1, 3 * k)
        dx = np.zeros_like(self.p["x"])
        _rows_summed(dx, x.ravel(), flat)
        grads |= {"x": dx, "u": du, "b": dx.sum(0)}
        for name, g in grads.items():
            g = g / F32(np.sqrt(x.size))
            self.g2[name] += g * g
            self.p[name] += F32(rate) * g / np.sqrt(self.g2[name])
        return h, float(logs.sum())


def lanes_of(lengths: np.ndarray, lanes: int) -> list[np.ndarray]:
    """Texts in lanes of about equal length, each text whole; long lanes first."""
    order = np.argsort(-lengths, kind="stable")
    ends = np.cumsum(lengths[order])
    target = max(int(lengths.max()), -(-int(ends[-1]) // lanes))
    out: list[list[int]] = []
    room: list[int] = []
    first = 0  # lanes before it are full
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        at = first
        while at < len(out) and room[at] < n and at < first + 8:
            at += 1
        if at < len(out) and room[at] >= n:
            out[at].append(i)
            room[at] -= n
        else:
            out.append([i])
            room.append(target - n)
        while first < len(out) and room[first] < 2:
            first += 1
        if len(out) - first > 64:
            first += 1
    out.sort(key=lambda own: -int(lengths[own].sum()))
    return [np.array(own) for own in out]


def scores(model: Model, stream: np.ndarray, lengths: np.ndarray, end: int, lanes: int, chunk: int = 1 << 13) -> np.ndarray:
    """The natural log-likelihood of each whole text of a stream; the state goes through the whole text."""
    total = np.zeros(len(lengths))
    if not len(lengths):
        return total
    dealt = lanes_of(lengths, lanes)
    starts = np.cumsum(lengths) - lengths
    order = np.concatenate(dealt)  # texts lane by lane
    size = lengths[order]
    begin = np.cumsum(size) - size
    flat = stream[np.arange(len(stream)) + np.repeat(starts[order] - begin, size)]
    lane_size = np.array([int(lengths[own].sum()) for own in dealt])
    lane_at = np.cumsum(lane_size) - lane_size
    live = np.searchsorted(-lane_size, -np.arange(lane_size[0]))  # at each step, the lanes that are longer
    h, x = np.zeros((model.hidden, len(dealt)), F32), np.full(len(dealt), end, stream.dtype)
    model.p["x"] += model.p["b"]  # as in training
    logs, states, symbols, places, held = np.empty(len(flat)), [], [], [], 0
    for t, n in enumerate(live.tolist()):
        at = lane_at[:n] + t
        h = model.step(x[:n], h[:, :n], x[:n] == end)[0]
        x = flat[at]
        states.append(h)
        symbols.append(x)
        places.append(at)
        held += n
        if held >= chunk or t + 1 == len(live):
            logs[np.concatenate(places)] = model.outputs(np.concatenate(states, axis=1), np.concatenate(symbols))
            states, symbols, places, held = [], [], [], 0
    total[order] = np.add.reduceat(logs, begin)
    model.p["x"] -= model.p["b"]
    return total
