"""Product-quantised codes of integer vectors, trained and assigned exactly under segment-mean lower bounds.

Every vector is cut into equal parts, and each part position has a codebook. A
part's nearest entry is found from coarse to fine: the squared distance of two
runs is at least the sum over segments of (difference of means)^2 times the
segment's length, plus the squared difference of the norms of what the means
leave over (Cauchy-Schwarz on the residuals). One segment a part goes first, then
four; entries whose bound exceeds an exact distance already known are out, and
the survivors get exact integer distances (ties: the lower index).

A round is one pass over the written integer vectors, from which each task sends
one row of count and sums an entry; only codebooks visit the driver.

Cases: rows whose vector is null, empty, or has null or non-finite components are
left out, and so are those not of the most common length (of equally common ones
the smaller), since parts of unlike lengths can't share a codebook. A length that
the parts don't divide is filled up with zeros, which changes no distance. Equal
ids at the start go by components, null ids come last. With fewer vectors than
entries there are as many entries as vectors. No vectors give no rows. Components
beyond 2^62 are held there; an error that a long can't hold is the largest long.
Columns other than id, vector and label are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm._shared import written
from tessera.llm._vectors import LARGEST_LONG, as_longs, exact_sum, integer_components, integers, kept_vectors, narrow, reach, squared_norms, widened

#: Segments of the fine bound; parts that are compared at a time.
SEGMENTS, AT_ONCE = 4, 2048


class _Sketch:
    """Segment means and residual norms of some runs, coarse and fine."""

    def __init__(self, x: np.ndarray) -> None:
        values = x.astype(np.float64)
        n, width = values.shape
        square = (values * values).sum(axis=1)
        self.scale = np.sqrt(square)
        edges = np.unique(np.linspace(0, width, min(SEGMENTS, width) + 1).astype(int))
        self.sizes = np.diff(edges).astype(np.float64)
        sums = np.add.reduceat(values, edges[:-1], axis=1)
        self.fine = sums / np.sqrt(self.sizes)  # means times the root of the segment's length
        self.coarse = sums.sum(axis=1) / np.sqrt(width)
        self.fine_rest = np.sqrt(np.maximum(square - (self.fine**2).sum(axis=1), 0))
        self.coarse_rest = np.sqrt(np.maximum(square - self.coarse**2, 0))


def nearest_entries(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest entry of each row, its exact squared distance, and how many exact distances were taken."""
    index, distance, taken = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0
    other = _Sketch(entries)
    for start in range(0, len(x), AT_ONCE):
        found = _nearest(x[start : start + AT_ONCE], entries, other)
        index.append(found[0])
        distance.append(found[1])
        taken += found[2]
    return np.concatenate(index), np.concatenate(distance), taken


def _nearest(x: np.ndarray, entries: np.ndarray, other: _Sketch) -> tuple[np.ndarray, np.ndarray, int]:
    most = 2 * reach(x, entries)
    if most >= 1 << 62:
        x, entries = x.astype(object), entries.astype(object)
    exact = lambda rows, numbers: squared_norms(x[rows] - entries[numbers], most)
    own, n = _Sketch(x), len(x)
    every = np.arange(n)
    # Rounding errors of means and norms are some 1e-15 of the runs' lengths; the bounds give way by far more.
    slack = 1e-6 + 1e-10 * (own.scale.max(initial=0) + other.scale.max(initial=0)) ** 2
    bound = (own.coarse[:, None] - other.coarse) ** 2
    bound += (own.coarse_rest[:, None] - other.coarse_rest) ** 2
    known = exact(every, bound.argmin(axis=1)).astype(np.float64)
    rows, numbers = np.nonzero(bound <= (known * (1 + 1e-12) + slack)[:, None])
    bound = (own.fine_rest[rows] - other.fine_rest[numbers]) ** 2
    for s in range(own.fine.shape[1]):
        bound += (own.fine[rows, s] - other.fine[numbers, s]) ** 2
    starts = np.searchsorted(rows, every)
    least = np.minimum.reduceat(bound, starts)
    at = np.flatnonzero(bound == np.repeat(least, np.diff(np.append(starts, len(rows)))))
    best = at[np.searchsorted(rows[at], every)]
    known = np.minimum(known, exact(every, numbers[best]).astype(np.float64))
    left = bound <= (known * (1 + 1e-12) + slack)[rows]
    rows, numbers = rows[left], numbers[left]
    distances = exact(rows, numbers)
    starts = np.searchsorted(rows, every)
    least = np.minimum.reduceat(distances, starts)
    at = np.flatnonzero(distances == np.repeat(least, np.diff(np.append(starts, len(rows)))))
    first = at[np.searchsorted(rows[at], every)]  # entries ascend within a row
    return numbers[first].astype(np.int32), as_longs(least), len(rows)


def integer_blocks(vectors: DataFrame, width: int, padded: int) -> DataFrame:
    """The written integer vectors of ``_id``, ``_label`` and ``_x``: one row an Arrow batch."""
    kinds = [vectors.schema[c].dataType.simpleString() for c in ("_id", "_label")]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.zeros((batch.num_rows, padded), dtype=np.int64)
                x[:, :width] = integers(batch.column(2), width)
                ends = pa.array([0, batch.num_rows], pa.int32())
                listed = [pa.ListArray.from_arrays(ends, batch.column(i)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*listed, pa.array([narrow(x)], pa.binary())], names=["ids", "labels", "x"])

    return written(vectors.select("_id", "_label", "_x").mapInArrow(gather, f"ids array<{kinds[0]}>, labels array<{kinds[1]}>, x binary"), "parts")


def _entry_sums(blocks: DataFrame, books: np.ndarray) -> list[T.Row]:
    """Count and exact sums of the parts of each used entry: part, entry, n, s0, s1, ..."""
    parts, _, size = books.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[tuple[int, int], int] = {}
        total: dict[tuple[int, int], list[int]] = {}
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                x = widened(packed, parts * size)
                for p in range(parts):
                    own = x[:, p * size : (p + 1) * size]
                    index, _, _ = nearest_entries(own, books[p])
                    order = np.argsort(index, kind="stable")
                    for places in np.split(order, np.flatnonzero(np.diff(index[order])) + 1):
                        key = p, int(index[places[0]])
                        count[key] = count.get(key, 0) + len(places)
                        total[key] = [a + b for a, b in zip(total.get(key, [0] * size), exact_sum(own[places]), strict=True)]
        keys = sorted(count)
        columns = [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([count[k] for k in keys], pa.int64())]
        columns += [pa.array([Decimal(total[k][i]) for k in keys], pa.decimal128(38, 0)) for i in range(size)]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "n", *(f"s{i}" for i in range(size))])

    schema = ", ".join(("part int, entry int, n long", *(f"s{i} decimal(38,0)" for i in range(size))))
    summed = blocks.select("x").mapInArrow(add, schema).groupBy("part", "entry")
    return summed.agg(F.sum("n").alias("n"), *(F.sum(f"s{i}").alias(f"s{i}") for i in range(size))).collect()


def compress_vectors(
    vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label"
) -> DataFrame:
    """Every kept vector's id with code, error, label_error and codebooks_sha256."""
    sound = kept_vectors(vectors, vector_column, _id=id_column, _label=label_column).filter(F.size("_x") > 0)
    kinds = {c: sound.schema[c].dataType.simpleString() for c in ("_id", "_label")}
    common = sound.groupBy(F.size("_x").alias("width")).count().orderBy(F.desc("count"), "width").limit(1).collect()
    schema = f"_id {kinds['_id']}, _label {kinds['_label']}, code string, error long"
    if not common:
        spark = vectors.sparkSession
        return spark.createDataFrame([], f"_id {kinds['_id']}, code string, error long, label_error long, codebooks_sha256 string").withColumnRenamed("_id", id_column)
    width = common[0]["width"]
    size = -(-width // parts)
    sound = sound.filter(F.size("_x") == width)
    blocks = integer_blocks(sound, width, size * parts)
    firsts = sound.select("_id", integer_components(F.col("_x")).alias("_c")).orderBy(F.asc_nulls_last("_id"), "_c").limit(entries).collect()
    books = np.zeros((parts, len(firsts), size), dtype=np.int64)
    for e, row in enumerate(firsts):
        filled = np.zeros(size * parts, dtype=np.int64)
        filled[:width] = row["_c"]
        books[:, e] = filled.reshape(parts, size)
    for _ in range(rounds):
        for row in _entry_sums(blocks, books):
            books[row["part"], row["entry"]] = [int(row[f"s{i}"]) // row["n"] for i in range(size)]
    name = hashlib.sha256(",".join(map(str, books.ravel()[_unfilled(width, size, parts, len(firsts))].tolist())).encode()).hexdigest()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, packed in enumerate(batch.column("x").to_pylist()):
                x = widened(packed, parts * size)
                found = [nearest_entries(x[:, p * size : (p + 1) * size], books[p]) for p in range(parts)]
                digits = np.stack([f[0] for f in found], axis=1)
                codes = ["".join(f"{e:02x}" for e in row) for row in digits.tolist()]
                error = as_longs(sum(f[1].astype(object) for f in found))
                columns = [batch.column("ids").slice(i, 1).flatten(), batch.column("labels").slice(i, 1).flatten(), pa.array(codes), pa.array(error)]
                yield pa.RecordBatch.from_arrays(columns, names=["_id", "_label", "code", "error"])

    coded = written(blocks.mapInArrow(finish, schema), "codes")
    # One row a label; where a label holds many rows the join's large side is what Spark splits.
    total = F.least(F.sum(F.col("error").cast("decimal(20,0)")), F.lit(LARGEST_LONG).cast("decimal(38,0)")).cast("long")
    summed = coded.groupBy(F.col("_label").alias("_l")).agg(total.alias("label_error"))
    joined = coded.join(summed, F.col("_label").eqNullSafe(F.col("_l")))
    return joined.select(F.col("_id").alias(id_column), "code", "error", "label_error", F.lit(name).alias("codebooks_sha256"))


def _unfilled(width: int, size: int, parts: int, entries: int) -> np.ndarray:
    """Which of the codebooks' components, by part, entry and position, stand for components of vectors."""
    own = (np.arange(parts * size) < width).reshape(parts, 1, size)
    return np.broadcast_to(own, (parts, entries, size)).ravel()
