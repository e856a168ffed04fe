"""A dense simplex for problems with a few dozen columns: the driver's part of column generation."""

from __future__ import annotations

import numpy as np


def maximize(c: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """max c.x subject to a x <= b, x >= 0, with b >= 0. Returns x, the row duals and the value."""
    rows, cols = a.shape
    table = np.zeros((rows + 1, cols + rows + 1))
    table[:rows, :cols] = a
    table[:rows, cols : cols + rows] = np.eye(rows)
    table[:rows, -1] = b
    table[-1, :cols] = -np.asarray(c, dtype=float)
    basis = list(range(cols, cols + rows))
    for step in range(20_000):
        entering = np.flatnonzero(table[-1, :-1] < -1e-11)
        if not len(entering):
            break
        # Steepest column at first; smallest index later, which cannot cycle.
        j = int(table[-1, :-1].argmin()) if step < 1_000 else int(entering[0])
        positive = np.flatnonzero(table[:rows, j] > 1e-11)
        if not len(positive):
            raise ArithmeticError("unbounded program")
        ratio = table[positive, -1] / table[positive, j]
        tied = positive[ratio <= ratio.min() + 1e-13]
        i = int(min(tied, key=lambda r: basis[r]))
        table[i] /= table[i, j]
        factor = table[:, j].copy()
        factor[i] = 0.0
        table -= np.outer(factor, table[i])
        basis[i] = j
    else:
        raise ArithmeticError("simplex did not finish")
    x = np.zeros(cols + rows)
    x[basis] = table[:rows, -1]
    return x[:cols], np.maximum(table[-1, cols : cols + rows], 0.0), float(table[-1, -1])


def game(columns: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """max over q of min over rows of (columns @ q): weights, value and the witness over rows."""
    a = np.asarray(columns, dtype=float)
    scale = max(float(np.abs(a).max()), 1e-300)
    # Losses of at least 1: minimizing the largest one has one constraint per row of the game.
    loss = 1.0 + (a.max() - a) / scale
    x, y, _ = maximize(np.ones(a.shape[1]), loss, np.ones(a.shape[0]))
    q, lam = x / x.sum(), y / y.sum()
    return q, float((a @ q).min()), lam


def guarded(primary: np.ndarray, guards: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """max primary.w with guards @ w >= 0 over the simplex.

    Returns weights, guard multipliers and feasibility; when infeasible the multipliers price a
    column that could restore it.
    """
    rows, cols = guards.shape
    a = np.vstack([-guards, np.ones(cols)])
    b = np.r_[np.zeros(rows), 1.0]
    w, duals, mass = maximize(np.ones(cols), a, b)
    if mass < 0.5:
        # No column mix meets the guards: the multipliers of the least violated mix.
        q, _, lam = game(guards)
        return q, lam, False
    w, duals, _ = maximize(primary - primary.min() + 1.0, a, b)
    return w / w.sum(), duals[:rows], True


def face(old: np.ndarray, new: np.ndarray, bound: float) -> tuple[float, np.ndarray]:
    """min over witnesses with witness.old <= bound of max witness.new: the value and the witness."""
    m = new.shape[0]
    lift = 1.0 - float(new.min())
    # Variables: the value, weights on new columns, multipliers on old columns.
    a = np.zeros((m + 1, 1 + new.shape[1] + old.shape[1]))
    a[:m, 0] = 1.0
    a[:m, 1 : 1 + new.shape[1]] = -(new + lift)
    a[:m, 1 + new.shape[1] :] = -(old - bound)
    a[m, 1 : 1 + new.shape[1]] = 1.0
    c = np.zeros(a.shape[1])
    c[0] = 1.0
    _, duals, value = maximize(c, a, np.r_[np.zeros(m), 1.0])
    lam = duals[:m]
    return value - lift, lam / max(lam.sum(), 1e-300)
