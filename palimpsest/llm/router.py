"""Learned partitions of a vector space: a balanced partition of a neighbour graph and a small
classifier that tells which partitions a vector's neighbours lie in."""

from __future__ import annotations

import io
import math

import numpy as np

NEIGHBOURS = 10
HIDDEN = 128
EPOCHS = 12
BATCH = 256
SLACK = 1.1


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k nearest rows of every row, by blocks of exact distances."""
    n = len(x)
    k = min(k, n - 1)
    norms = (x * x).sum(1)
    out = np.empty((n, k), dtype=np.int32)
    for low in range(0, n, 1024):
        part = x[low : low + 1024]
        d = norms[None, :] - 2.0 * (part @ x.T)
        d[np.arange(len(part)), np.arange(low, low + len(part))] = np.inf
        out[low : low + len(part)] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def _bisect(x: np.ndarray, rows: np.ndarray, parts: int, labels: np.ndarray, first: int, rng: np.random.Generator) -> None:
    """Halves of equal size along the line between two means, until ``parts`` are left."""
    if parts == 1:
        labels[rows] = first
        return
    left = parts // 2
    sub = x[rows]
    a, b = sub[rng.integers(len(sub))], sub[rng.integers(len(sub))]
    for _ in range(6):
        side = ((sub - a) ** 2).sum(1) < ((sub - b) ** 2).sum(1)
        if side.all() or not side.any():
            break
        a, b = sub[side].mean(0), sub[~side].mean(0)
    order = np.argsort(sub @ (b - a), kind="stable")
    at = len(rows) * left // parts
    _bisect(x, rows[order[:at]], left, labels, first, rng)
    _bisect(x, rows[order[at:]], parts - left, labels, first + left, rng)


def partition_graph(x: np.ndarray, graph: np.ndarray, parts: int, seed: int = 0, rounds: int = 10) -> np.ndarray:
    """Balanced labels: recursive bisection, then moves to the label most neighbours have.

    A label never holds more than SLACK times its even share.
    """
    n = len(x)
    labels = np.zeros(n, dtype=np.int32)
    _bisect(x, np.arange(n), parts, labels, 0, np.random.default_rng(seed))
    most = math.ceil(SLACK * n / parts)
    for _ in range(rounds):
        near = labels[graph]
        votes = (near[:, :, None] == near[:, None, :]).sum(2)
        best = votes.argmax(1)
        target = near[np.arange(n), best]
        gain = votes[np.arange(n), best] - (near == labels[:, None]).sum(1)
        movers = np.flatnonzero((gain > 0) & (target != labels))
        if not len(movers):
            break
        movers = movers[np.argsort(-gain[movers], kind="stable")]
        goal = target[movers]
        by_goal = np.argsort(goal, kind="stable")
        starts = np.searchsorted(goal[by_goal], np.arange(parts))
        rank = np.empty(len(movers), dtype=np.int64)
        rank[by_goal] = np.arange(len(movers)) - starts[goal[by_goal]]
        room = most - np.bincount(labels, minlength=parts)
        allowed = movers[rank < room[goal]]
        if not len(allowed):
            break
        labels[allowed] = target[allowed]
    return labels


class Router:
    """Two-layer network from a vector to partition probabilities."""

    def __init__(self, w1, b1, w2, b2):
        self.w1, self.b1, self.w2, self.b2 = w1, b1, w2, b2

    @property
    def parts(self) -> int:
        return len(self.b2)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum(x @ self.w1 + self.b1, 0.0)
        z = h @ self.w2 + self.b2
        z -= z.max(1, keepdims=True)
        np.exp(z, out=z)
        return z / z.sum(1, keepdims=True)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, w1=self.w1, b1=self.b1, w2=self.w2, b2=self.b2)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Router:
        found = np.load(io.BytesIO(data))
        return cls(found["w1"], found["b1"], found["w2"], found["b2"])


def fit(x: np.ndarray, parts: int, seed: int = 0) -> Router:
    """Router for ``parts`` partitions, learned from the sample ``x`` (float32 rows)."""
    rng = np.random.default_rng(seed)
    n, dim = x.shape
    graph = neighbour_graph(x, NEIGHBOURS)
    labels = partition_graph(x, graph, parts, seed)
    # Half the target is the own partition, half where the neighbours are.
    target = np.zeros((n, parts), dtype=np.float32)
    np.add.at(target, (np.repeat(np.arange(n), graph.shape[1]), labels[graph].ravel()), 0.5 / graph.shape[1])
    target[np.arange(n), labels] += 0.5
    w = [
        rng.normal(0, math.sqrt(2 / dim), (dim, HIDDEN)).astype(np.float32),
        np.zeros(HIDDEN, dtype=np.float32),
        rng.normal(0, math.sqrt(1 / HIDDEN), (HIDDEN, parts)).astype(np.float32),
        np.zeros(parts, dtype=np.float32),
    ]
    m, v = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
    step = 0
    total = EPOCHS * math.ceil(n / BATCH)
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for low in range(0, n, BATCH):
            rows = order[low : low + BATCH]
            xb = x[rows]
            hidden = np.maximum(xb @ w[0] + w[1], 0.0)
            z = hidden @ w[2] + w[3]
            z -= z.max(1, keepdims=True)
            np.exp(z, out=z)
            z /= z.sum(1, keepdims=True)
            g = (z - target[rows]) / len(rows)
            gh = (g @ w[2].T) * (hidden > 0)
            grads = [xb.T @ gh, gh.sum(0), hidden.T @ g, g.sum(0)]
            step += 1
            rate = 0.004 * 0.5 * (1 + math.cos(math.pi * step / total))
            for i, gi in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * gi
                v[i] = 0.999 * v[i] + 0.001 * gi * gi
                w[i] -= (rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Router(*w)


def routes(router: Router, x: np.ndarray, most: int, mass: float) -> np.ndarray:
    """Partitions of every row, most probable first, -1 past the point where their probabilities
    add up to ``mass``; at most ``most`` columns."""
    p = router.probabilities(x)
    most = min(most, p.shape[1])
    top = np.argpartition(-p, most - 1, axis=1)[:, :most] if most < p.shape[1] else np.tile(np.arange(p.shape[1]), (len(p), 1))
    values = np.take_along_axis(p, top, 1)
    order = np.argsort(-values, axis=1, kind="stable")
    top, values = np.take_along_axis(top, order, 1).astype(np.int32), np.take_along_axis(values, order, 1)
    enough = np.cumsum(values, axis=1) - values >= mass
    top[enough] = -1
    return top
