"""Integer vectors: which rows count, their components, and exact squared distances."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components are held within this bound, since a long can't hold more than their square.
MOST = 1 << 62
LARGEST_LONG = (1 << 63) - 1
#: Components become floor(SCALE * x).
SCALE = 1024


def kept_vectors(vectors: DataFrame, vector_column: str, **others: str) -> DataFrame:
    """``_x`` (doubles) and ``others`` (new name: column) of the rows whose vector is there and has no null or non-finite component."""
    x = F.col(vector_column).cast("array<double>")
    sound = F.forall("_x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vectors.select(*(F.col(c).alias(name) for name, c in others.items()), x.alias("_x")).filter(F.col("_x").isNotNull()).filter(sound)


def integers(column: pa.ListArray, width: int) -> np.ndarray:
    """The integer components of one batch, a row a vector."""
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    scaled = np.floor(SCALE * flat)
    whole = np.clip(scaled, -float(MOST), float(MOST)).astype(np.int64)
    return whole


def integer_components(x: Column) -> Column:
    """The same as a column expression, for the few rows that start a search."""
    return F.transform(x, lambda c: F.least(F.greatest(F.floor(F.lit(float(SCALE)) * c).cast("decimal(38,0)"), F.lit(-MOST)), F.lit(MOST)).cast("long"))


def reach(*arrays: np.ndarray) -> int:
    """The largest absolute value in any of the arrays."""
    return max((max(abs(int(a.max())), abs(int(a.min()))) for a in arrays if a.size), default=0)


def squared_norms(diff: np.ndarray, most: int) -> np.ndarray:
    """Exact squared lengths of the rows of ``diff``, whose entries reach ``most``; Python integers where a long is too small."""
    if diff.shape[-1] * most * most >= 1 << 62:
        diff = diff.astype(object)
    return (diff * diff).sum(axis=-1)


def squared_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``x`` from all ``centres``."""
    most = 2 * reach(x, centres)
    if x.shape[1] * most * most < 1 << 53:  # then a matrix product in doubles is exact
        a, b = x.astype(np.float64), centres.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    if most >= 1 << 62:
        x, centres = x.astype(object), centres.astype(object)
    out = [squared_norms(x - c, most) for c in centres]
    return np.stack(out, axis=1) if out else np.zeros((len(x), 0), np.int64)


def as_longs(values: np.ndarray) -> np.ndarray:
    """``values`` as longs; what a long can't hold becomes the largest."""
    return np.minimum(values, LARGEST_LONG).astype(np.int64)


def exact_sum(x: np.ndarray) -> list[int]:
    """The sum of the rows of ``x`` by column, as Python integers."""
    if reach(x) * max(1, len(x)) >= 1 << 62:
        x = x.astype(object)
    return [int(v) for v in x.sum(axis=0)]


def narrow(x: np.ndarray) -> bytes:
    """Integers in the fewest of 2, 4 or 8 bytes each; the first byte tells which."""
    most = reach(x) + 1
    kind = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
    return bytes([kind]) + x.astype(f"<i{kind}").tobytes()


def widened(data: bytes, width: int) -> np.ndarray:
    """What ``narrow`` packed, a row a vector."""
    return np.frombuffer(data, dtype=f"<i{data[0]}", offset=1).astype(np.int64).reshape(-1, width)
