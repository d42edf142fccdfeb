"""Integer vectors out of Arrow lists, and products of them that are exact at any magnitude."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Integers of float64 are exact below FLOAT, of int64 below LONG; matrices of greater values hold Python's integers.
FLOAT, LONG = 2**53, 2**63


def finite(vec: Column) -> Column:
    """Whether a list of numbers is given and none of them is null, NaN or infinite."""
    return vec.isNotNull() & ~F.coalesce(F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def integer_rows(column: pa.Array, scale: int, width: int = 0) -> np.ndarray:
    """floor(scale * x) of each component x of a list array without nulls, one row per list; shorter rows end in zeros.

    The matrix is of float64, whose integers are exact; where a product with
    `scale` (a power of two) would leave its range, of Python's integers.
    """
    if pa.types.is_fixed_size_list(column.type):
        column = column.cast(pa.list_(column.type.value_type))
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    lengths = np.diff(np.asarray(column.offsets))
    width = max([width, *lengths.tolist()])
    if len(flat) and np.abs(flat).max() > 2.0**1000:
        whole = np.array([int(x) * scale if abs(x) >= FLOAT else int(np.floor(x * scale)) for x in flat.tolist()], object)
    else:
        whole = np.floor(flat * scale)
    if len(lengths) and lengths.min() == width:
        return whole.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), whole.dtype)
    out[np.arange(width) < lengths[:, None]] = whole
    return out


def greatest(rows: np.ndarray) -> int:
    """The greatest magnitude in a matrix of integers."""
    return int(np.abs(rows).max()) if rows.size else 0


def as_python(rows: np.ndarray) -> np.ndarray:
    """The same integers as Python's."""
    return rows if rows.dtype == object else np.frompyfunc(int, 1, 1)(rows).astype(object)


def fitting(bound: int, *rows: np.ndarray) -> list[np.ndarray]:
    """The matrices in the fastest type in which integers up to `bound` are exact: float64 (BLAS), int64, Python's."""
    if bound < FLOAT:
        return [r.astype(np.float64) for r in rows]
    return [r.astype(np.int64) for r in rows] if bound < LONG else [as_python(r) for r in rows]


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of a with all of b: every partial sum stays below the type's bound, so their order is free."""
    x, y = fitting(a.shape[1] * greatest(a) * greatest(b), a, b)
    return x @ y.T


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact |x|^2 - 2 x.c + |c|^2 of all rows of a and of b, the products as one matrix product."""
    x, c = fitting(4 * a.shape[1] * max(greatest(a), greatest(b)) ** 2, a, b)
    return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]


def magnitude_groups(rows: np.ndarray) -> list[np.ndarray]:
    """Positions of rows for which the same type fits: ordinary ones, large ones and huge ones apart, so that one outlier slows no other row."""
    if not len(rows):
        return []
    most = np.abs(rows).max(1) if rows.shape[1] else np.zeros(len(rows))
    d = max(1, rows.shape[1])
    edges = [int((limit / (8 * d)) ** 0.5) for limit in (FLOAT, LONG)]
    kind = (most >= edges[0]).astype(int) + (most >= edges[1]).astype(int)
    return [g for k in range(3) if len(g := np.flatnonzero(kind == k))]


def longs(values) -> pa.Array:
    """Integers as Arrow longs; those out of a long's range are null."""
    if isinstance(values, np.ndarray) and values.dtype != object:
        return pa.array(values.astype(np.int64), pa.int64())
    return pa.array([v if -LONG <= v < LONG else None for v in map(int, values)], pa.int64())
