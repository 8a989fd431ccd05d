"""Pairs of two scored lists whose sum exceeds a threshold, found without trying pairs that fail; strings of a window by halving."""

from __future__ import annotations

import numpy as np

#: Scores this near the threshold are compared by their sum.
_NEAR = 1e-9


def threshold_pairs(a: np.ndarray, b: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """``(i, j, score, tried)``: all pairs with ``a[i] + b[j] > eps``, and how many pairs were looked at.

    The shorter side is sorted from its best; the place of ``eps - x`` among it says how many partners an ``x`` of the
    other side has, and those come first. Only sums within 1e-9 of the threshold are looked at and may fail.
    """
    if len(a) < len(b):
        j, i, score, tried = threshold_pairs(b, a, eps)
        return i, j, score, tried
    order = np.argsort(-b, kind="stable")
    counts = np.searchsorted(-b[order], a - eps + _NEAR, side="left")  # how many b exceed eps - a
    i = np.repeat(np.arange(len(a)), counts)
    j = order[np.arange(len(i)) - np.repeat(np.cumsum(counts) - counts, counts)]
    score = a[i] + b[j]
    keep = score > eps
    return i[keep], j[keep], score[keep], len(i)


def joined(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], length: int, sigma: int, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """``(codes, scores)`` above ``eps`` of the strings of ``left`` followed by those of ``right``, which have this length."""
    i, j, scores, _ = threshold_pairs(left[1], right[1], eps)
    return left[0][i] * sigma**length + right[0][j], scores


def strings(logp: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """``(codes, scores)`` of all strings above ``eps`` over ``logp(sites, states)``, from those of its two halves."""
    sites, sigma = logp.shape
    if sites == 1:
        codes = np.nonzero(logp[0] > eps)[0]
        return codes.astype(np.int64), logp[0][codes]
    h = sites // 2
    best = logp.max(axis=1)
    left, right = strings(logp[:h], eps - best[h:].sum() - _NEAR), strings(logp[h:], eps - best[:h].sum() - _NEAR)
    return joined(left, right, sites - h, sigma, eps)
