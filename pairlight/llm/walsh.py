"""The Walsh-Hadamard transform that the operators on vectors share."""

from __future__ import annotations

import numpy as np


def transform(x: np.ndarray) -> np.ndarray:
    """The unnormalised transform along the last axis, whose length is a power of two.

    Additions and subtractions alone: exact on integers, and on floats the same for a row in whatever
    batch it stands.  Squared distances come out multiplied by the length.
    """
    n = x.shape[-1]
    half = 1
    while half < n:
        y = x.reshape(*x.shape[:-1], n // (2 * half), 2, half)
        x = np.stack([y[..., 0, :] + y[..., 1, :], y[..., 0, :] - y[..., 1, :]], axis=-2).reshape(x.shape)
        half *= 2
    return x


def coarse_to_fine(n: int) -> np.ndarray:
    """Places of the coefficients by rising number of sign changes in their rows."""
    rows = transform(np.eye(n, dtype=np.int64))
    return np.argsort((rows[:, 1:] != rows[:, :-1]).sum(1), kind="stable")
