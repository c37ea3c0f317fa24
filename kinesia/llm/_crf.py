"""Linear-chain conditional random field over one-hot features, trained and decoded with arrays.

An item has one value of each feature; ``ids[i, k]`` is the row of that value in
the weight table.  Sequences lie one after another, bounded by ``offs``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Crf:
    emit: np.ndarray  # rows of features by labels
    trans: np.ndarray  # label before by label
    start: np.ndarray

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        out = self.emit[ids[:, 0]].copy()
        for k in range(1, ids.shape[1]):
            out += self.emit[ids[:, k]]
        return out

    def viterbi(self, scores: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """The best labels; all sequences advance together, the longest first."""
        n, labels = scores.shape
        out = np.zeros(n, np.int8)
        lens = np.diff(offs)
        order = np.argsort(-lens, kind="stable")
        order = order[lens[order] > 0]
        if len(order) == 0:
            return out
        first, lens = offs[order], lens[order]
        back = np.zeros((n, labels), np.int8)
        best = scores[first] + self.start
        live = np.searchsorted(-lens, -np.arange(1, lens[0] + 1), side="right")
        for t in range(1, int(lens[0])):
            m = live[t]
            at = first[:m] + t
            ways = best[:m, :, None] + self.trans
            back[at] = ways.argmax(1)
            best[:m] = ways.max(1) + scores[at]
        label = best.argmax(1).astype(np.int8)
        for t in range(int(lens[0]) - 1, -1, -1):
            m = live[t]
            at = first[:m] + t
            out[at] = label[:m]
            if t:
                label[:m] = back[at, label[:m]]
        return out

    def cut_margin(self) -> float:
        """An item whose label 0 leads every other by more than this has label 0 in the best sequence."""
        t = self.trans
        gain = t[:, :, None] + t[None, :, :] - t[:, 0][:, None, None] - t[0, :][None, None, :]
        edge = (self.start[:, None] + t - self.start[0] - t[0]).max()
        last = (t - t[:, :1]).max()
        return float(max(gain.max(), edge, last, (self.start - self.start[0]).max(), 0))


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis, keepdims=True)) + top).squeeze(axis)


def train(ids: np.ndarray, labels: np.ndarray, offs: np.ndarray, n_features: int, n_labels: int, *, weights: np.ndarray | None = None, l2: float = 1e-4, rounds: int = 120, rate: float = 0.15) -> Crf:
    """Maximum likelihood with an L2 penalty, by Adam over all sequences; ``weights`` weigh sequences."""
    lens = np.diff(offs)
    keep = lens > 0
    first, lens = offs[:-1][keep], lens[keep]
    share = np.ones(len(lens)) if weights is None else weights[keep].astype(float)
    order = np.argsort(-lens, kind="stable")
    first, lens, share = first[order], lens[order], share[order]
    live = np.searchsorted(-lens, -np.arange(1, lens[0] + 1), side="right")
    steps = [first[:m] + t for t, m in enumerate(live)]
    w = np.zeros(len(ids))
    for t, at in enumerate(steps):
        w[at] = share[: live[t]]
    norm = share.sum()
    size = n_features * n_labels
    params = np.zeros(size + n_labels * n_labels + n_labels)
    gold = np.zeros_like(params)
    for k in range(ids.shape[1]):
        gold[:size] += np.bincount(ids[:, k] * n_labels + labels, w, size)
    for t in range(1, len(steps)):
        m = live[t]
        pair = labels[first[:m] + t - 1].astype(int) * n_labels + labels[steps[t]]
        gold[size : size + n_labels**2] += np.bincount(pair, share[:m], n_labels**2)
    gold[size + n_labels**2 :] = np.bincount(labels[first], share, n_labels)
    m1, m2 = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, rounds + 1):
        crf = _unpack(params, n_features, n_labels)
        e = crf.emissions(ids)
        a, b = np.empty_like(e), np.zeros_like(e)
        a[steps[0]] = e[steps[0]] + crf.start
        for t in range(1, len(steps)):
            m = live[t]
            a[steps[t]] = e[steps[t]] + _lse(a[first[:m] + t - 1][:, :, None] + crf.trans, 1)
        expected = np.zeros_like(params)
        for t in range(len(steps) - 1, 0, -1):
            m = live[t]
            before = first[:m] + t - 1
            b[before] = _lse(crf.trans + (e[steps[t]] + b[steps[t]])[:, None, :], 2)
        z = _lse(a[first + lens - 1], 1)
        for t in range(1, len(steps)):
            m = live[t]
            before = first[:m] + t - 1
            joint = np.exp(a[before][:, :, None] + crf.trans + (e[steps[t]] + b[steps[t]])[:, None, :] - z[:m, None, None])
            expected[size : size + n_labels**2] += (joint * share[:m, None, None]).sum(0).ravel()
        zs = np.empty(len(ids))
        for t, at in enumerate(steps):
            zs[at] = z[: live[t]]
        marginal = np.exp(a + b - zs[:, None]) * w[:, None]
        for k in range(ids.shape[1]):
            for label in range(n_labels):
                expected[label:size:n_labels] += np.bincount(ids[:, k], marginal[:, label], n_features)
        expected[size + n_labels**2 :] = marginal[first].sum(0)
        g = (gold - expected) / norm - l2 * params
        m1 = 0.9 * m1 + 0.1 * g
        m2 = 0.999 * m2 + 0.001 * g * g
        params = params + rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return _unpack(params, n_features, n_labels)


def _unpack(params: np.ndarray, n_features: int, n_labels: int) -> Crf:
    size = n_features * n_labels
    return Crf(params[:size].reshape(n_features, n_labels).copy(), params[size : size + n_labels**2].reshape(n_labels, n_labels).copy(), params[size + n_labels**2 :].copy())
