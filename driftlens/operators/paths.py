"""Cheapest label paths of long series, by min-plus products.

A switch from label a to b costs toll[a] + toll[b]. A stretch of rows reduces to
a matrix m[a, b]: the least cost of its rows if the label before it is a and its
last one is b, with the turns of that path (switches out of or into each label).
Matrices of neighbours compose, so stretches are reduced side by side; then the
labels at their ends give the labels within. Ties go to the smallest label.
"""

from __future__ import annotations

import numpy as np

#: Rows that a matrix is computed for step by step, side by side with others.
SIDE = 256
#: (least costs k by k, turns of those paths k by k by k)
Reduced = tuple[np.ndarray, np.ndarray]


def moves(toll: np.ndarray) -> np.ndarray:
    out = toll[:, None] + toll[None, :]
    np.fill_diagonal(out, 0)
    return out


def _switches(k: int) -> np.ndarray:
    """The turns of a switch from a to b."""
    one = np.eye(k)
    return np.where(np.eye(k, dtype=bool)[:, :, None], 0, one[:, None, :] + one[None, :, :])


def _stretches(costs: np.ndarray, toll: np.ndarray, first: bool) -> Reduced:
    """Matrices of stretches of one length (stretches by rows by k); with first, nothing is paid for entering the first of them."""
    b, n, k = costs.shape
    move, switch = moves(toll), _switches(k)
    m, turns = move + costs[:, 0, None, :], np.broadcast_to(switch, (b, k, k, k)).copy()
    if first:
        m[0], turns[0] = costs[0, 0], 0
    for t in range(1, n):
        options = m[:, :, :, None] + move
        came = options.argmin(2)
        m = np.take_along_axis(options, came[:, :, None, :], 2)[:, :, 0] + costs[:, t, None, :]
        turns = np.take_along_axis(turns, came[..., None], 2) + switch[came, np.arange(k)]
    return m, turns


def _parts(costs: np.ndarray) -> list[np.ndarray]:
    """Rows as stretches of SIDE, and the rest as one."""
    n, k = costs.shape
    whole = n // SIDE * SIDE
    return [x for x in (costs[:whole].reshape(-1, SIDE, k), costs[None, whole:]) if x.size]


def composed(each: list[Reduced]) -> Reduced:
    """The matrix of stretches that follow each other."""
    m, turns = each[0]
    for n, more in each[1:]:
        options = m[:, :, None] + n[None]
        came = options.argmin(1)
        m = np.take_along_axis(options, came[:, None], 1)[:, 0]
        turns = np.take_along_axis(turns, came[..., None], 1) + more[came, np.arange(len(m))]
    return m, turns


def _all(costs: np.ndarray, toll: np.ndarray, first: bool) -> list[Reduced]:
    return [r for k, part in enumerate(_parts(costs)) for r in zip(*_stretches(part, toll, first and k == 0))]


def reduced(costs: np.ndarray, toll: np.ndarray, first: bool) -> Reduced:
    """The matrix of consecutive rows (rows by k)."""
    return composed(_all(costs, toll, first))


def ends(each: list[Reduced], entry: int, last: int) -> list[tuple[int, int]]:
    """(label before, last label) of each of the stretches on the cheapest path from the label before them all to the last."""
    best, came = each[0][0][entry], []
    for m, _ in each[1:]:
        options = best[:, None] + m
        came.append(options.argmin(0))
        best = options[came[-1], np.arange(len(best))]
    lasts = [last]
    for c in reversed(came):
        lasts.append(int(c[lasts[-1]]))
    lasts.reverse()
    return list(zip([entry, *lasts[:-1]], lasts))


def path(costs: np.ndarray, toll: np.ndarray, entry: int, last: int, first: bool) -> np.ndarray:
    """The labels of consecutive rows, from the label before them and their last one."""
    between, out, at = ends(_all(costs, toll, first), entry, last), [], 0
    move = moves(toll)
    for k, part in enumerate(_parts(costs)):
        b, n, _ = part.shape
        begin, end = np.array(between[at : at + b]).T
        best = move[begin] + part[:, 0]
        if first and k == 0:
            best[0] = part[0, 0]
        came = np.zeros((n, *best.shape), np.int8 if best.shape[1] < 128 else np.int64)
        for t in range(1, n):
            options = best[:, :, None] + move
            came[t] = options.argmin(1)
            best = np.take_along_axis(options, came[t][:, None].astype(np.int64), 1)[:, 0] + part[:, t]
        labels = np.zeros((b, n), np.int64)
        labels[:, -1] = end
        for t in range(n - 1, 0, -1):
            labels[:, t - 1] = came[t][np.arange(b), labels[:, t]]
        out.append(labels.ravel())
        at += b
    return np.concatenate(out)
