"""Small dense systems on the driver, without the threads of a linear algebra library.

The driver has started the JVM as a child process, after which those threads may wait for ever. What is solved here has
some hundred rows.
"""

from __future__ import annotations

import numpy as np


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of two matrices, or of a matrix and a vector on either side."""
    left, right = ("ij" if a.ndim == 2 else "j"), ("jk" if b.ndim == 2 else "j")
    return np.einsum(f"{left},{right}->{left[:-1]}{right[1:]}", a, b)


def solved(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x with a x = b for a vector or matrix b, by elimination in vector steps."""
    m, both = len(a), np.column_stack([a, b]).astype(float)
    for k in range(m):
        p = k + int(np.abs(both[k:, k]).argmax())
        if not both[p, k]:
            raise ValueError("the matrix is singular")
        both[[k, p]] = both[[p, k]]
        both[k] /= both[k, k]
        rest = np.arange(m) != k
        both[rest, k:] -= both[rest, k, None] * both[k, k:]
    return both[:, m] if np.ndim(b) == 1 else both[:, m:]
