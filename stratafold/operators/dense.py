"""Positive definite systems larger than memory: a Cholesky factor by blocks in a temporary file of the driver."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

import numpy as np

#: Rows of a block: what is in memory at once is a few blocks squared and a few vectors.
ROWS = 512


class Factor:
    """L of A = L L', left-looking: each block is computed from A's entries when its turn comes and written once.

    ``entries(i, j)`` gives A of two slices. Only the lower half of the file is ever written. Raises LinAlgError where A is not
    positive definite. With n rows the file has 4 n² bytes and the work is n³ / 3.
    """

    def __init__(self, n: int, entries: Callable[[slice, slice], np.ndarray]) -> None:
        self.n = n
        self.blocks = [slice(i, min(i + ROWS, n)) for i in range(0, n, ROWS)]
        self.file = tempfile.TemporaryFile(prefix="stratafold-")
        self.lower = np.memmap(self.file, dtype=np.float64, mode="w+", shape=(n, n))
        self.inverse = []
        for k, at in enumerate(self.blocks):
            above = np.array(self.lower[at, : at.start])
            top = np.linalg.cholesky(entries(at, at) - above @ above.T)
            self.inverse.append(np.linalg.inv(top))
            self.lower[at, at] = top
            for below in self.blocks[k + 1 :]:
                self.lower[below, at] = (entries(below, at) - self.lower[below, : at.start] @ above.T) @ self.inverse[k].T

    def forward(self, b: np.ndarray) -> np.ndarray:
        """L⁻¹ b of columns."""
        out = np.empty_like(b)
        for k, at in enumerate(self.blocks):
            out[at] = self.inverse[k] @ (b[at] - self.lower[at, : at.start] @ out[: at.start])
        return out

    def backward(self, b: np.ndarray) -> np.ndarray:
        """L'⁻¹ b of columns."""
        out = b.copy()
        for k, at in reversed(list(enumerate(self.blocks))):
            out[at] = self.inverse[k].T @ out[at]
            out[: at.start] -= self.lower[at, : at.start].T @ out[at]
        return out
