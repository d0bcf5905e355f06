"""Small numpy helpers used inside tasks on one bounded block at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd


def stack(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances between all rows of two blocks."""
    sq = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(sq, 0.0))


def one_hot(labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct labels and the rows-by-labels indicator matrix."""
    values, codes = np.unique(labels, return_inverse=True)
    matrix = np.zeros((len(labels), len(values)))
    matrix[np.arange(len(labels)), codes] = 1.0
    return values, matrix


def star_edges(ids_a: np.ndarray, ids_b: np.ndarray, linked: np.ndarray) -> pd.DataFrame:
    """Edges ``(src, dst)`` connecting each component of a block pair to its
    smallest id: at most one edge per row instead of one per linked pair.

    ``linked[i, j]`` says that ``ids_a[i]`` and ``ids_b[j]`` are neighbours. The
    blocks may be the same block. Ids may be of any ordered type.
    """
    src = np.concatenate([ids_a, ids_b])
    values, codes = np.unique(src, return_inverse=True)
    none = len(values)
    la, lb = codes[: len(ids_a)], codes[len(ids_a) :]
    while True:
        na = np.minimum(la, np.where(linked, lb[None, :], none).min(axis=1, initial=none))
        nb = np.minimum(lb, np.where(linked, na[:, None], none).min(axis=0, initial=none))
        if np.array_equal(na, la) and np.array_equal(nb, lb):
            break
        la, lb = na, nb
    dst = values[np.concatenate([la, lb])]
    edges = pd.DataFrame({"src": src, "dst": dst})
    return edges[edges["src"] != edges["dst"]].drop_duplicates()
