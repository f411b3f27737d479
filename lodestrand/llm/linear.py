"""Hashed byte n-grams and linear models over them.

A text's features are the shares of its byte n-grams of 1 to 4 bytes, hashed to
``SLOTS`` slots each. A linear model of shares is a mean of weights over the text's
positions, so scoring whole texts is a table look-up and a segmented sum.
"""

from __future__ import annotations

import numpy as np

ORDERS = (1, 2, 3, 4)
BITS = 14
SLOTS = 1 << BITS
#: Features of different orders have slots of their own.
FEATURES = SLOTS * len(ORDERS)


def _slots(raw: bytes, order: int) -> np.ndarray:
    view = np.ndarray((len(raw) - 3,), dtype="<u4", buffer=raw, strides=(1,))
    grams = view if order == 4 else view & np.uint32((1 << (8 * order)) - 1)
    h = grams * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA77)
    return (h >> np.uint32(32 - BITS)) + np.uint32((order - 1) * SLOTS)


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(slots, shares) of a text; shares of each order add to 1."""
    raw = text + bytes(4)
    slots, values = [], []
    for order in ORDERS:
        n = len(text) - order + 1
        if n > 0:
            found, counts = np.unique(_slots(raw, order)[:n], return_counts=True)
            slots.append(found)
            values.append(counts / n)
    if not slots:
        return np.empty(0, dtype=np.uint32), np.empty(0)
    return np.concatenate(slots), np.concatenate(values)


def scores(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    """Mean weights [len(texts), models] of non-empty texts; weights: float32[FEATURES, models].

    N-grams that run over a text's end are left out, as in ``features``.
    """
    raw = b"".join(texts) + bytes(4)
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    out = np.zeros((len(texts), weights.shape[1]))
    for order in ORDERS:
        slots = _slots(raw, order)
        for model in range(weights.shape[1]):
            w = weights[:, model][slots]
            for back in range(1, order):  # positions whose n-gram is cut by the text's end
                at = ends - back
                w[at[at >= begins]] = 0.0
            sums = np.add.reduceat(w[: ends[-1]], begins, dtype=np.float64)
            out[:, model] += sums / np.maximum(sizes - order + 1, 1)
    return out


def train_svm(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 12, lam: float = 1e-4, scale: float = 10.0) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear SVM (hinge loss, L2) by dual coordinate descent.

    ``rows`` are sparse features, ``y`` is +1 or -1. The order of updates is fixed, so the
    same rows give the same model. Classes weigh the same whatever their counts.
    """
    n = len(rows)
    w = np.zeros(FEATURES + 1)
    alpha = np.zeros(n)
    top = {c: (1.0 / (lam * n)) * n / (2 * max(1, int((y == c).sum()))) for c in (-1, 1)}
    norms = np.array([scale * scale * float(v @ v) + 1.0 for _, v in rows])
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(n):
            slots, values = rows[i]
            margin = y[i] * (scale * float(w[slots] @ values) + w[FEATURES])
            new = min(max(alpha[i] + (1.0 - margin) / norms[i], 0.0), top[int(y[i])])
            step = (new - alpha[i]) * y[i]
            if step:
                w[slots] += step * scale * values
                w[FEATURES] += step
                alpha[i] = new
    return w[:FEATURES] * scale, float(w[FEATURES])


def fit_sigmoid(margins: np.ndarray, y: np.ndarray) -> float:
    """Slope a of 1 / (1 + exp(-a * margin)) by Newton steps on the log loss; at least 0.5."""
    a, t = 1.0, (y > 0).astype(float)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins, -30, 30)))
        gradient = float(((p - t) * margins).mean()) + 1e-3 * a
        a -= gradient / (float((p * (1 - p) * margins * margins).mean()) + 1e-3)
        a = min(max(a, 0.5), 20.0)
    return a
