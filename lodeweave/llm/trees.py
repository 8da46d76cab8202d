"""Bisecting k-means trees: the split of the largest-dispersion node is repeated until the limits hold."""

from __future__ import annotations

import heapq

import numpy as np


def _two_means(x: np.ndarray, rounds: int, rng: np.random.Generator) -> np.ndarray | None:
    """Side (bool) of each row under a spherical 2-means, or None where the rows cannot be told apart."""
    a = x[rng.integers(len(x))]
    b = x[int(np.argmin(x @ a))]
    a = x[int(np.argmin(x @ b))]
    side = None
    for _ in range(rounds):
        w = b - a
        new = x @ w > 0
        n = int(new.sum())
        if n == 0 or n == len(x):
            return side
        if side is not None and np.array_equal(new, side):
            break
        side = new
        a, b = x[~new].mean(0), x[new].mean(0)
        a, b = a / max(np.linalg.norm(a), 1e-12), b / max(np.linalg.norm(b), 1e-12)
    return side


def bisect(x: np.ndarray, max_rows: int, min_cos: float = 2.0, rounds: int = 6, seed: int = 7) -> list[np.ndarray]:
    """Leaves (row numbers) of a bisecting k-means over unit rows ``x``.

    The node of the largest dispersion (sum of squared distances to its centre) is split until every leaf has at most
    ``max_rows`` rows or all its rows lie within ``min_cos`` of its centre. Rows that are all equal stay one leaf.
    """
    rng = np.random.default_rng(seed)

    def node(rows: np.ndarray) -> tuple[float, int, np.ndarray]:
        s = x[rows].sum(0)
        norm = float(np.linalg.norm(s))
        return (-(len(rows) - norm), int(rows[0]), rows)

    done, heap = [], []

    def put(rows: np.ndarray) -> None:
        if len(rows) <= max_rows:
            compact = True
            if min_cos <= 1:
                c = x[rows].mean(0)
                compact = len(rows) == 1 or float((x[rows] @ (c / max(np.linalg.norm(c), 1e-12))).min()) >= min_cos
            if compact:
                done.append(rows)
                return
        heapq.heappush(heap, node(rows))

    put(np.arange(len(x)))
    while heap:
        rows = heapq.heappop(heap)[2]
        side = _two_means(x[rows], rounds, rng)
        if side is None:
            done.append(rows)
            continue
        put(rows[~side])
        put(rows[side])
    return done


def centres(x: np.ndarray, leaves: list[np.ndarray]) -> np.ndarray:
    c = np.stack([x[r].mean(0) for r in leaves])
    return (c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def probes(x: np.ndarray, c: np.ndarray, most: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Cells of every row: the nearest centres, at most ``most``, whose cosine is within ``slack`` of the best; the home cell first."""
    k = min(most, len(c))
    cells, good = np.empty((len(x), k), np.int32), np.empty((len(x), k), bool)
    for i in range(0, len(x), 4096):
        s = x[i : i + 4096] @ c.T
        top = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < len(c) else np.broadcast_to(np.arange(k), s.shape).copy()
        v = np.take_along_axis(s, top, 1)
        order = np.argsort(-v, axis=1, kind="stable")
        cells[i : i + 4096] = np.take_along_axis(top, order, 1)
        v = np.take_along_axis(v, order, 1)
        good[i : i + 4096] = v >= v[:, :1] - slack
    good[:, 0] = True
    return cells, good
