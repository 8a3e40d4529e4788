"""What the operators on embeddings share: valid vectors, their dimension and batches of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType


def valid(vec: Column) -> Column:
    """Not null, not empty, all components finite, not all zero."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vec.isNotNull() & (F.size(vec) > 0) & ~bad & F.exists(vec, lambda x: x != 0), F.lit(False))


def dimension(rows: DataFrame, vec_col: str) -> int:
    """The dimension of most vectors, the larger one in a tie; 0 without vectors."""
    found = rows.groupBy(F.size(vec_col).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return found["d"] if found else 0


def element(rows: DataFrame, vec_col: str) -> str:
    """float for a column of float arrays, else double: vectors travel as they are."""
    given = rows.schema[vec_col].dataType
    return "float" if isinstance(given, ArrayType) and isinstance(given.elementType, FloatType) else "double"


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """A list column of vectors that all have dimension d, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), d)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row; the order of additions depends on the dimension only, unlike in a matrix product."""
    return np.ascontiguousarray(a * b).sum(axis=1)


def normal_cdf(x: np.ndarray) -> np.ndarray:
    """Of the standard normal distribution, to seven digits (Abramowitz and Stegun 7.1.26)."""
    z = np.abs(x) / np.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    erf = 1 - t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-z * z)
    return 0.5 * (1 + np.sign(x) * erf)
