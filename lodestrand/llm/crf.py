"""A linear-chain conditional random field with two labels, in numpy.

Observations are bit masks of features. The score of a labelling is the sum over lines of
the weights of the line's features under its label, plus a weight for each pair of
neighbouring labels.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np

#: Lines of a block of sequences that are trained on at a time.
CELLS = 300_000


@dataclass
class Crf:
    emission: np.ndarray  # [features, 2]
    transition: np.ndarray  # [2, 2], from and to

    def decode(self, masks: list[int], table: dict[int, tuple[float, float]]) -> list[int]:
        """The best labels of one sequence (Viterbi); on equal scores label 1. ``table`` caches scores by mask."""
        (t00, t01), (t10, t11) = self.transition.tolist()
        a = b = 0.0
        back = []
        first = True
        for mask in masks:
            e = table.get(mask)
            if e is None:
                e = table[mask] = self.scores(mask)
            if first:
                a, b, first = e[0], e[1], False
                continue
            from_a, from_b = a + t00 > b + t10, a + t01 > b + t11
            a, b = (a + t00 if from_a else b + t10) + e[0], (a + t01 if from_b else b + t11) + e[1]
            back.append((0 if from_a else 1, 0 if from_b else 1))
        if first:
            return []
        label = 0 if a > b else 1
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]

    def scores(self, mask: int) -> tuple[float, float]:
        on = [i for i in range(len(self.emission)) if mask >> i & 1]
        e = self.emission[on].sum(axis=0)
        return float(e[0]), float(e[1])


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


Sequence_ = tuple[np.ndarray, np.ndarray]


def _blocks(sequences: list[Sequence_]) -> Iterator[list[Sequence_]]:
    """Sequences in runs of at most ``CELLS`` lines, or one sequence, when padded to the first, the longest."""
    at = 0
    while at < len(sequences):
        n = max(1, CELLS // len(sequences[at][0]))
        yield sequences[at : at + n]
        at += n


def train(sequences: list[tuple[Sequence[int], int | Sequence[int]]], features: int, steps: int = 150, rate: float = 0.1, ridge: float = 1e-3) -> Crf:
    """Maximum conditional likelihood by Adam, with an L2 penalty. Each sequence comes with a label
    for each line, or one for all of its lines. The likelihood of a sequence counts as its mean
    over lines, so long texts don't decide alone.

    Every line counts. Sequences are gone through in blocks, so that memory is bounded by
    ``CELLS`` lines or the longest sequence, besides 5 bytes a line.
    """
    known = [(np.asarray(m, dtype=np.int32), np.broadcast_to(np.asarray(y, dtype=np.int8), (len(m),))) for m, y in sequences if len(m)]
    if not known:
        return Crf(np.zeros((features, 2)), np.zeros((2, 2)))
    known.sort(key=lambda s: -len(s[0]))
    n = len(known)
    # A line's scores depend on its mask alone, so there is one row of features for each mask.
    masks = np.unique(np.concatenate([np.unique(m) for m, _ in known]))
    x = ((masks[:, None] >> np.arange(features)) & 1).astype(np.float64)
    blocks = []
    for block in _blocks(known):
        lengths = np.array([len(m) for m, _ in block])
        of, labels = np.zeros((lengths[0], len(block)), dtype=np.int32), np.zeros((lengths[0], len(block)), dtype=np.int8)
        for i, (m, y) in enumerate(block):
            of[: len(m), i] = np.searchsorted(masks, m)
            labels[: len(m), i] = y
        blocks.append((of, lengths, labels))
    theta = np.zeros(features * 2 + 4)
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, tr = theta[: features * 2].reshape(features, 2), theta[features * 2 :].reshape(2, 2)
        e = x @ w
        grad_m, grad_t = np.zeros((len(masks), 2)), np.zeros((2, 2))
        for block in blocks:
            _add_gradient(*block, e, tr, grad_m, grad_t)
        grad = np.concatenate([(x.T @ grad_m).ravel(), grad_t.ravel()]) / n - ridge * theta
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad * grad
        theta = theta + rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return Crf(theta[: features * 2].reshape(features, 2).copy(), theta[features * 2 :].reshape(2, 2).copy())


def _add_gradient(of: np.ndarray, lengths: np.ndarray, y: np.ndarray, scores: np.ndarray, tr: np.ndarray, grad_m: np.ndarray, grad_t: np.ndarray) -> None:
    """Adds a block's gradient by mask and by pair of labels. ``of`` and ``y`` [line, sequence] are the place of a line's mask, and its label."""
    longest, n = of.shape
    weight = 1.0 / lengths
    alive = np.searchsorted(-lengths, -np.arange(longest), side="left").tolist()  # sequences longer than t
    e = scores[of]
    alpha = np.zeros((longest, n, 2))
    beta = np.zeros((longest, n, 2))
    alpha[0] = e[0]
    for t in range(1, longest):
        k = alive[t]
        alpha[t, :k] = _logsum(alpha[t - 1, :k, :, None] + tr[None], 1) + e[t, :k]
    z = _logsum(alpha[lengths - 1, np.arange(n)], 1)
    for t in range(longest - 2, -1, -1):
        k = alive[t + 1]
        beta[t, :k] = _logsum(tr[None] + (e[t + 1, :k] + beta[t + 1, :k])[:, None, :], 2)
    for t in range(longest):
        k = alive[t]
        d = -np.exp(alpha[t, :k] + beta[t, :k] - z[:k, None]) * weight[:k, None]
        d[np.arange(k), y[t, :k]] += weight[:k]
        np.add.at(grad_m, of[t, :k], d)
        if t:
            pair = np.exp(alpha[t - 1, :k, :, None] + tr[None] + (e[t, :k] + beta[t, :k])[:, None, :] - z[:k, None, None])
            grad_t -= (pair * weight[:k, None, None]).sum(axis=0)
            np.add.at(grad_t, (y[t - 1, :k], y[t, :k]), weight[:k])
