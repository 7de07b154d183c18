"""Finite automata over long character arrays as associative scans.

A chunk of characters is a function from states to states; functions compose associatively. The array is
cut into equal chunks, all chunks are run in lockstep for every start state, their functions are composed
by a doubling prefix scan, and a second lockstep pass from the then known start states yields the state
before each character. Work is O(n * states) in vectorised steps, whatever the lengths of the documents:
one very long text costs the same per character as many short ones.
"""

from __future__ import annotations

import numpy as np


def compose_prefix(funcs: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of the rows of ``funcs`` (row k maps the state before chunk k to that after)."""
    out, d = funcs.copy(), 1
    while d < len(out):
        out[d:] = np.take_along_axis(out[d:], out[:-d].copy(), axis=1)
        d *= 2
    return out


def states_before(classes: np.ndarray, table: np.ndarray, start: int = 0) -> np.ndarray:
    """State before each character. ``classes``: class per character; ``table[class, state]``: next state."""
    n, s = len(classes), table.shape[1]
    if n == 0:
        return np.empty(0, np.uint8)
    width = int(min(1024, max(16, n // 2048 + 1)))
    rows = -(-n // width)
    flat = np.concatenate([table, np.arange(s, dtype=table.dtype)[None]]).ravel().astype(np.uint8)
    cols = np.full(rows * width, table.shape[0], np.int32)  # the padding class leaves the state as it is
    cols[:n] = classes
    cols = np.ascontiguousarray(cols.reshape(rows, width).T) * s
    state = np.full(rows, start, np.uint8)
    if rows > 1:
        func = np.broadcast_to(np.arange(s, dtype=np.uint8), (rows, s)).copy()
        for c in cols:
            func = flat[c[:, None] + func]
        state[1:] = compose_prefix(func)[:-1, start]
    out = np.empty((width, rows), np.uint8)
    for k, c in enumerate(cols):
        out[k] = state
        state = flat[c + state]
    return np.ascontiguousarray(out.T).ravel()[:n]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
