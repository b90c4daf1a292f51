"""Vectors as whole numbers, for exact arithmetic."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Largest magnitude of a component: 64 squares of differences of such numbers fit a long.
MOST = 1 << 27


def finite_vector(column: Column) -> Column:
    """Not null, and every component neither null nor NaN nor infinite."""
    finite = F.forall(column, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(finite, F.lit(False))


def whole_components(column: Column, factor: int) -> Column:
    """``floor(factor * x)`` of each component of a finite vector.

    Magnitudes beyond :data:`MOST` count as :data:`MOST`, less in vectors of more
    than 64 components, so that sums of their products fit a long.
    """
    most = F.least(F.lit(float(MOST)), F.floor(F.sqrt(F.lit(2.0**62) / F.greatest(F.size(column), F.lit(1)))))
    return F.transform(column, lambda x: F.floor(F.greatest(-most, F.least(most, x * F.lit(float(factor))))).cast("int"))


def whole_matrix(column: pa.ListArray, components: int) -> np.ndarray:
    """The vectors of a batch, all of one length, as rows of longs."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), components)
