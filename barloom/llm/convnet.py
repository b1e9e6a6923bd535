"""A small convolutional network over byte or character codes, in numpy.

Codes are embedded, filters slide over neighbouring codes, each filter keeps its
maximum, and a hidden layer turns the maxima into one logit.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Net:
    """Weights; ``a`` and ``b`` turn a logit (or a mean of logits) into log odds."""
    embed: np.ndarray   # codes x size
    conv: np.ndarray    # width x size x filters
    bias: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    a: float = 1.0
    b: float = 0.0

    def odds(self, logit: np.ndarray) -> np.ndarray:
        """Calibrated probability."""
        return 1 / (1 + np.exp(-np.clip(self.a * logit + self.b, -30, 30)))


def random_net(rng: np.random.Generator, codes: int, size: int, width: int, filters: int, hidden: int) -> Net:
    return Net(rng.normal(0, 0.5, (codes, size)), rng.normal(0, 0.25, (width, size, filters)), np.zeros(filters),
               rng.normal(0, 0.25, (filters, hidden)), np.zeros(hidden), rng.normal(0, 0.25, hidden), np.zeros(()))


def logits(net: Net, peak: np.ndarray) -> np.ndarray:
    return np.maximum(peak @ net.w1 + net.b1, 0) @ net.w2 + net.b2


NAMES = ("embed", "conv", "bias", "w1", "b1", "w2", "b2")


class Adam:
    """The moments of the weights' gradients, and the steps made."""

    def __init__(self, net: Net):
        self.m = {n: np.zeros_like(getattr(net, n)) for n in NAMES}
        self.v = {n: np.zeros_like(getattr(net, n)) for n in NAMES}
        self.t = 0.0

    def step(self, net: Net, x: np.ndarray, y: np.ndarray, weight: np.ndarray, stride: int = 1) -> None:
        """One step on the weighted log loss of some rows, in place."""
        grads = gradients(net, x, y, weight, stride)
        self.t += 1
        for n in NAMES:
            self.m[n] = 0.9 * self.m[n] + 0.1 * grads[n]
            self.v[n] = 0.99 * self.v[n] + 0.01 * grads[n] ** 2
            step = 0.004 * (self.m[n] / (1 - 0.9 ** self.t)) / (np.sqrt(self.v[n] / (1 - 0.99 ** self.t)) + 1e-7)
            setattr(net, n, getattr(net, n) - step)

    def packed(self, net: Net) -> np.ndarray:
        """Weights, moments and steps as one row of numbers, which can be averaged with others."""
        return np.concatenate([np.ravel(a) for n in NAMES for a in (getattr(net, n), self.m[n], self.v[n])] + [[self.t]])

    def unpack(self, net: Net, row: np.ndarray) -> None:
        """Take weights, moments and steps from such a row."""
        at = 0
        for n in NAMES:
            shape, size = getattr(net, n).shape, getattr(net, n).size
            part = row[at:at + 3 * size].reshape(3, *shape)
            setattr(net, n, part[0])
            self.m[n], self.v[n] = part[1], part[2]
            at += 3 * size
        self.t = float(row[at])


def learn(net: Net, x: np.ndarray, y: np.ndarray, weight: np.ndarray, rng: np.random.Generator, rounds: int, stride: int = 1) -> None:
    """Adam on the weighted log loss, in place; rows of ``x`` are codes."""
    adam = Adam(net)
    for _ in range(rounds):
        perm = rng.permutation(len(x))
        for k in range(0, len(perm), 128):
            at = perm[k:k + 128]
            adam.step(net, x[at], y[at], weight[at], stride)


def gradients(net: Net, x: np.ndarray, y: np.ndarray, weight: np.ndarray, stride: int) -> dict[str, np.ndarray]:
    width, size, filters = net.conv.shape
    places = np.arange(0, x.shape[1] - width + 1, stride)
    e = net.embed[x]                                                     # n, length, size
    windows = np.stack([e[:, places + k] for k in range(width)], axis=2)  # n, places, width, size
    n, p = windows.shape[:2]
    flat = windows.reshape(n * p, width * size)
    answer = (flat @ net.conv.reshape(width * size, filters)).reshape(n, p, filters)
    best = answer.argmax(axis=1)
    top = np.take_along_axis(answer, best[:, None, :], 1)[:, 0] + net.bias
    peak = np.maximum(top, 0)
    h0 = peak @ net.w1 + net.b1
    h = np.maximum(h0, 0)
    z = h @ net.w2 + net.b2
    d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight / n
    dh = np.outer(d, net.w2) * (h0 > 0)
    dpeak = (dh @ net.w1.T) * (top > 0)
    chosen = windows[np.arange(n)[:, None], best]                         # n, filters, width, size
    dconv = np.einsum("nf,nfke->kef", dpeak, chosen)
    dwin = np.einsum("nf,kef->nfke", dpeak, net.conv)
    byte = x[np.arange(n)[:, None, None], places[best][:, :, None] + np.arange(width)]
    dembed = np.zeros_like(net.embed)
    np.add.at(dembed, byte.reshape(-1), dwin.reshape(-1, size))
    return {"embed": dembed, "conv": dconv, "bias": dpeak.sum(0), "w1": peak.T @ dh, "b1": dh.sum(0), "w2": h.T @ d, "b2": d.sum()}


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray | float = 1.0) -> tuple[float, float]:
    """Slope and intercept by Newton steps, drawn a little towards slope 1 so that separable samples stay finite.

    The classes count alike, so the probability does not depend on how often a label was drawn.
    A row stands ``n`` times.
    """
    n = np.broadcast_to(n, y.shape)
    w = n * np.where(y > 0, 0.5 / max((n * y).sum(), 1), 0.5 / max((n * (1 - y)).sum(), 1)) * n.sum()
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(w * (p - y) * x).sum() + (a - 1), (w * (p - y)).sum() + 0.1 * b])
        s = w * np.maximum(p * (1 - p), 1e-9)
        hess = np.array([[(s * x * x).sum() + 1, (s * x).sum()], [(s * x).sum(), s.sum() + 0.1]])
        da, db = np.linalg.solve(hess, g)
        a, b = float(np.clip(a - np.clip(da, -1, 1), 0.05, 20)), b - float(np.clip(db, -2, 2))
    return a, b
