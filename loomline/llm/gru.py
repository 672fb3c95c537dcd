"""A gated recurrent language model in numpy: class-factored softmax, truncated backpropagation through time.

Head words have ids 0..n-1 by falling count; id n is the tail, all other words. Head words fall into classes of
like mass; the tail is a class of its own. P(word) = P(class | state) P(word | class, state). Texts stand one behind the
other in lanes; the state is carried from window to window and cleared where a text begins.
"""

from __future__ import annotations

import heapq

import numpy as np

WINDOW, LANES = 16, 512
Params = dict[str, np.ndarray]


def class_starts(counts: np.ndarray, classes: int) -> np.ndarray:
    """Where each class of head words begins: classes of equal mass by the square root of the counts."""
    mass = np.cumsum(np.sqrt(np.maximum(counts, 1.0)))
    at = np.searchsorted(mass, np.linspace(0, mass[-1], classes + 1)[1:-1])
    return np.unique(np.concatenate(([0], at, [len(counts)])))


def init(counts: np.ndarray, tail: float, dim: int, classes: int, seed: int = 1) -> Params:
    """Weights at random, output biases at the log shares of the counts, so that training starts from single words."""
    rng = np.random.default_rng(seed)
    n, starts = len(counts), class_starts(counts, classes)
    mass = np.append(np.add.reduceat(counts, starts[:-1]), tail) + 1.0
    w = lambda *shape: (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
    return {
        "emb": w(n + 1, dim) * np.float32(np.sqrt(n + 1) * 0.1), "wx": w(dim, 3 * dim), "wh": w(dim, 3 * dim), "b": np.zeros(3 * dim, np.float32),
        "wc": w(dim, len(starts)) * np.float32(0.1), "bc": np.log(mass / mass.sum()).astype(np.float32),
        "wo": w(dim, n) * np.float32(0.1), "bo": np.log((counts + 1.0) / n).astype(np.float32), "starts": starts,
    }


def forward(p: Params, xw: np.ndarray, ids: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """States after each step of a window, and the last one. ids: what is read; fresh: lanes where a text begins; xw: emb @ wx + b.

    Inside, lanes are columns, so that a gate's numbers lie together; keep gets the states before each step, the gates z and r with what is new, and h @ wh.
    """
    d, kind, h = h.shape[1], np.result_type(h, xw), h.T
    wh, begins = np.ascontiguousarray(p["wh"].T), fresh.any(1).tolist()
    out = np.empty((len(ids), d, ids.shape[1]), kind)
    if keep is not None:
        keep.extend(np.empty((len(ids), m * d, ids.shape[1]), kind) for m in (1, 3, 3))
    rows = [v[0] for v in keep] if keep else [None, *np.empty((2, 3 * d, ids.shape[1]), kind)]
    for t in range(len(ids)):
        if begins[t]:
            h = np.where(fresh[t], kind.type(0), h)
        if keep is not None:
            rows = [v[t] for v in keep]
            rows[0][:] = h
        _, x, u = rows
        np.matmul(wh, h, out=u)
        x[:] = xw[ids[t]].T
        zr, n = x[: 2 * d], x[2 * d :]
        zr += u[: 2 * d]
        zr *= 0.5  # the logistic function by tanh, in place
        np.tanh(zr, out=zr)
        zr += 1
        zr *= 0.5
        n += zr[d:] * u[2 * d :]
        np.tanh(n, out=n)
        new = out[t]
        np.subtract(h, n, out=new)
        new *= zr[:d]
        new += n
        h = new
    return out.transpose(0, 2, 1), h.T


def _softmax(x: np.ndarray, sizes: list[tuple[int, int]], own: np.ndarray, shares: bool) -> np.ndarray:
    """Log shares at the places `own` (one a column) of blocks of logits that lie in x one behind the other; x is overwritten, with shares if asked. sizes: (rows, columns) of each block."""
    blocks, at = [], 0
    for m, n in sizes:
        blocks.append(x[at : at + m * n].reshape(m, n))
        at += m * n
    if x.size and max(x.max(), -x.min()) > 60:  # exponentials might leave the range of single precision
        for v in blocks:
            v -= v.max(0)
    logs = x[own]
    np.exp(x, out=x)
    for v, s in zip(blocks, np.split(total := np.empty(len(own), x.dtype), np.cumsum([n for _, n in sizes])[:-1]), strict=True):
        v.sum(0, out=s)
        if shares:
            v /= s
    return logs - np.log(total)


def order(values: np.ndarray, most: int) -> np.ndarray:
    """Stable order of whole numbers from 0 to most; small ones are sorted by their digits."""
    return np.argsort(values.astype(np.uint16) if most < 1 << 16 else values, kind="stable")


def output(p: Params, h: np.ndarray, y: np.ndarray, grad: Params | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural log probabilities of y (the tail: of its class alone), and the loss's slope by h if grad is given (it gets the sums).

    Tokens are ordered by class and lie in columns, so that each class is a run of them.
    """
    starts, d, h = p["starts"], h.shape[1], h.T
    cls = np.searchsorted(starts[1:], np.arange(starts[-1] + 1), side="right")[y]  # the tail's id is the last start, so its class is the last
    by = order(cls, len(starts))
    cls, y, n = cls[by], y[by], len(y)
    ht = np.ones((d + 1, n), h.dtype)  # the last row carries the biases
    np.take(h, by, axis=1, out=ht[:d], mode="clip")
    wc, wo = np.vstack((p["wc"], p["bc"])), np.vstack((p["wo"], p["bo"]))
    x, row = wc.T @ ht, np.arange(n)
    own = cls * n + row
    logs = _softmax(x.reshape(-1), [x.shape], own, grad is not None).astype(np.float64)
    back = None
    if grad is not None:
        x.reshape(-1)[own] -= 1
        slope = ht @ x.T
        grad["wc"] += slope[:d]
        grad["bc"] += slope[d]
        back = p["wc"] @ x
    cuts, bounds = np.searchsorted(cls, np.arange(len(starts))).tolist(), starts.tolist()
    runs = [(i, j, a, b) for i, j, a, b in zip(cuts, cuts[1:], bounds, bounds[1:], strict=False) if i < j]
    if runs:
        first = np.cumsum([0] + [(j - i) * (b - a) for i, j, a, b in runs])  # where each class's block of logits lies
        flat, size = np.empty(first[-1], h.dtype), [j - i for i, j, _, _ in runs]
        blocks = [flat[at : at + (j - i) * (b - a)].reshape(b - a, j - i) for at, (i, j, a, b) in zip(first.tolist(), runs, strict=False)]
        for v, (i, j, a, b) in zip(blocks, runs, strict=True):
            np.matmul(wo[:, a:b].T, ht[:, i:j], out=v)
        heads = runs[-1][1]  # tail words come behind
        at, i, a, width = (np.repeat(v, size) for v in (first[:-1], [r[0] for r in runs], [r[2] for r in runs], size))
        own = at + (y[:heads] - a) * width + row[:heads] - i
        logs[:heads] += _softmax(flat, [v.shape for v in blocks], own, grad is not None)
        if grad is not None:
            flat[own] -= 1
            for v, (i, j, a, b) in zip(blocks, runs, strict=True):
                slope = ht[:, i:j] @ v.T
                grad["wo"][:, a:b] += slope[:d]
                grad["bo"][a:b] += slope[d]
                back[:, i:j] += p["wo"][:, a:b] @ v
    logp = np.empty(n)
    logp[by] = logs
    if back is None:
        return logp, None
    place = np.empty(n, np.int64)
    place[by] = row
    return logp, np.take(back, place, axis=1).T


def keep_freed() -> None:
    """Once a block of this size was freed (it is never touched), malloc no longer hands a window's arrays back to the system each time."""
    np.empty(30 << 20, np.uint8)


def columns(out: np.ndarray) -> np.ndarray:
    """The states that forward() gives as columns, step by step."""
    return out.transpose(2, 0, 1).reshape(out.shape[2], -1)


def backward(p: Params, ids: np.ndarray, fresh: np.ndarray, kept: list, dh_out: np.ndarray, grad: Params) -> None:
    """Through the steps of one window; what came before it is left out."""
    d, begins = dh_out.shape[2], fresh.any(1).tolist()
    h, zrn, u = kept
    z, r, n, dh = zrn[:, :d], zrn[:, d : 2 * d], zrn[:, 2 * d :], dh_out.transpose(0, 2, 1).copy()
    by_n, by_z, by_r = (1 - z) * (1 - n * n), (h - n) * z * (1 - z), u[:, 2 * d :] * r * (1 - r)  # slopes of all steps at once
    carry, du, sums = np.zeros_like(dh[0]), np.empty((len(ids), 3 * d, ids.shape[1]), h.dtype), np.zeros_like(grad["wh"])
    for t in range(len(ids) - 1, -1, -1):
        g, at, dn = dh[t], du[t], by_n[t]
        g += carry
        dn *= g
        np.multiply(g, by_z[t], out=at[:d])
        np.multiply(dn, by_r[t], out=at[d : 2 * d])
        np.multiply(dn, r[t], out=at[2 * d :])
        sums += h[t] @ at.T
        carry = p["wh"] @ at
        g *= z[t]
        carry += g
        if begins[t]:
            carry *= ~fresh[t]
    grad["wh"] += sums
    du[:, 2 * d :] = by_n  # what reaches the gates' inputs
    flat, read = du.transpose(1, 0, 2).reshape(3 * d, -1), ids.ravel()
    grad["b"] += flat.sum(1)
    grad["wx"] += np.take(np.ascontiguousarray(p["emb"].T), read, axis=1) @ flat.T
    by = order(read, len(p["emb"]))
    edges = np.flatnonzero(np.concatenate(([True], np.diff(read[by]) > 0)))
    grad["emb"][read[by[edges]]] += np.add.reduceat(np.take(p["wx"] @ flat, by, axis=1), edges, 1).T


class Lanes:
    """Texts (ids, each ending with end) dealt to lanes of like length, kept one behind the other: memory follows the tokens, however long one text is."""

    def __init__(self, texts: list[np.ndarray], width: int, end: int) -> None:
        mine: list[list[int]] = [[] for _ in range(max(1, min(width, len(texts))))]
        load = [(0, k) for k in range(len(mine))]
        for k in sorted(range(len(texts)), key=lambda k: -len(texts[k])):
            n, lane = load[0]
            mine[lane].append(k)
            heapq.heapreplace(load, (n + len(texts[k]), lane))
        mine.sort(key=lambda ks: -sum(len(texts[k]) for k in ks))  # lanes that run out are last
        order, self.end = [k for ks in mine for k in ks], end
        self.sizes = np.array([sum(len(texts[k]) for k in ks) for ks in mine])
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))[:-1]
        self.steps, self.width = int(self.sizes.max()), len(mine)
        self.y = np.concatenate([texts[k] for k in order]).astype(np.int32, copy=False)
        self.whose = np.repeat(np.array(order, np.int32), [len(texts[k]) for k in order])
        self.first = np.concatenate(([True], self.whose[1:] != self.whose[:-1]))

    def window(self, t: int, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Steps t to t + steps of the lanes that go on at t: what is read, what is to come, where texts begin, whose they are (-1: none)."""
        n = int((self.sizes > t).sum())
        step = np.arange(t, min(t + steps, self.steps))[:, None]
        there = step < self.sizes[:n]
        at = np.where(there, self.starts[:n] + step, 0)
        fresh = there & self.first[at]
        x = np.where(fresh | (step == 0), self.end, self.y[at - 1])  # a text's first word is read after an end
        return x, np.where(there, self.y[at], self.end), fresh, np.where(there, self.whose[at], -1)


def score(p: Params, texts: list[np.ndarray], end: int) -> np.ndarray:
    """The natural log probability of each whole text (tail words: of the tail class)."""
    total = np.zeros(len(texts))
    if not texts:
        return total
    keep_freed()
    lanes = Lanes(texts, LANES, end)
    xw = p["emb"] @ p["wx"] + p["b"]
    h = np.zeros((lanes.width, p["emb"].shape[1]), np.float32)
    t = 0
    while t < lanes.steps:  # where few lanes go on, windows are longer, so that each has about as many tokens
        steps = max(WINDOW, WINDOW * LANES // max(1, int((lanes.sizes > t).sum())))
        x, y, fresh, whose = lanes.window(t, steps)
        t += steps
        out, h = forward(p, xw, x, fresh, h[: x.shape[1]])
        on, flat = whose.ravel() >= 0, columns(out)
        logp, _ = output(p, (flat if on.all() else flat[:, on]).T, y.ravel()[on])
        total += np.bincount(whose.ravel()[on], weights=logp, minlength=len(texts))
    return total


def stream(texts: list[np.ndarray], width: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts one behind the other, cut into `width` lanes of like length wherever that is: what is read, what is to come, where texts begin, what is there.

    So all windows but the last are full, however long one text is. A lane that begins within a text starts without a state.
    """
    y = np.concatenate(texts).astype(np.int32, copy=False)
    width = max(1, min(width, len(y) // (32 * WINDOW)))  # few texts still give some windows
    steps = -(-len(y) // width)
    first = np.zeros(steps * width, bool)
    first[np.concatenate(([0], np.cumsum([len(t) for t in texts])))[:-1]] = True
    there = np.arange(steps * width) < len(y)
    y = np.concatenate((y, np.full(steps * width - len(y), end, np.int32)))
    x = np.concatenate(([end], y[:-1])).astype(np.int32)
    x[first] = end  # a text's first word is read after an end
    return tuple(np.ascontiguousarray(v.reshape(width, steps).T) for v in (x, y, first, there))


class Trainer:
    """Adam over windows; the state goes on from one window to the next. Weights, their slopes and moments lie in one vector each, p and grad are views."""

    def __init__(self, params: Params, rate: float = 0.004) -> None:
        names = [k for k in params if k != "starts"]
        self.flat = np.concatenate([params[k].ravel() for k in names])
        self.slope, self.m, self.v, self.held = (np.zeros_like(self.flat) for _ in range(4))
        self.p, self.grad, at = {"starts": params["starts"].copy()}, {}, 0
        for k in names:
            for views, base in ((self.p, self.flat), (self.grad, self.slope)):
                views[k] = base[at : at + params[k].size].reshape(params[k].shape)
            at += params[k].size
        self.rate, self.steps, self.tokens = rate, 0, 0

    def learn(self, texts: list[np.ndarray], end: int) -> float:
        """One pass; the mean loss."""
        if not texts:
            return 0.0
        keep_freed()
        xs, ys, firsts, there = stream(texts, LANES, end)
        p, d, loss = self.p, self.p["emb"].shape[1], 0.0
        h = np.zeros((xs.shape[1], d), np.float32)
        for t in range(0, len(xs), WINDOW):
            x, y, fresh, on = (v[t : t + WINDOW] for v in (xs, ys, firsts, there))
            kept: list = []
            out, h = forward(p, p["emb"] @ p["wx"] + p["b"], x, fresh, h, kept)
            self.slope[:] = 0
            flat, on = columns(out), on.ravel()
            if on.all():
                logp, dh = output(p, flat.T, y.ravel(), self.grad)
            else:
                logp, back = output(p, flat[:, on].T, y.ravel()[on], self.grad)
                dh = np.zeros_like(flat).T
                dh[on] = back
            backward(p, x, fresh, kept, dh.T.reshape(d, *x.shape).transpose(1, 2, 0), self.grad)
            self._step(WINDOW * xs.shape[1])  # a short last window weighs little
            loss -= logp.sum()
            self.tokens += int(on.sum())
        return loss / max(1, int(there.sum()))

    def _step(self, n: int) -> None:
        self.steps += 1
        a, b, g, held = 1 - 0.9**self.steps, 1 - 0.99**self.steps, self.slope, self.held
        g *= np.float32(1 / n)
        self.m *= np.float32(0.9)
        np.multiply(g, np.float32(0.1), out=held)
        self.m += held
        self.v *= np.float32(0.99)
        g *= g
        g *= np.float32(0.01)
        self.v += g
        np.multiply(self.v, np.float32(1 / b), out=held)
        np.sqrt(held, out=held)
        held += np.float32(1e-6)
        np.divide(self.m, held, out=held)
        held *= np.float32(self.rate / a)
        self.flat -= held
