"""Random stochastic matrices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from driftlens.functions import vec


def uniform_stochastic(shape: tuple[int, int], axis: int, state: np.random.RandomState) -> np.ndarray:
    """Uniform draws, normalised so that sums along the axis are 1."""
    if axis not in (0, 1, -1, -2):
        raise ValueError(f"axis must be 0, 1, -1 or -2, not {axis}")
    draws = state.uniform(size=shape)
    return draws / draws.sum(axis=axis, keepdims=True)


def left_stochastic(shape: tuple[int, int], state: np.random.RandomState) -> np.ndarray:
    """Columns sum to 1."""
    return uniform_stochastic(shape, 0, state)


def right_stochastic(shape: tuple[int, int], state: np.random.RandomState) -> np.ndarray:
    """Rows sum to 1."""
    return uniform_stochastic(shape, 1, state)


def random_weights(k: int, seed: int, *keys: str) -> Column:
    """A row of a right-stochastic matrix for each DataFrame row; it depends on seed and keys alone, so a task that runs again draws it again."""
    unit = [(F.pmod(F.xxhash64(*[F.col(c) for c in keys], F.lit(seed), F.lit(i)), F.lit(1 << 40)) + 1) / float(1 << 40) for i in range(k)]
    return vec.normalised(F.array(*unit))
