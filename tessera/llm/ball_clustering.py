"""Exact integer k-means by partition-local ball trees.

Each partition's vectors are gathered into blocks and each block into a metric
tree, once: a node holds a ball (centre, radius) with the count and the integer
sum of its vectors. A round walks the trees from the roots: where the triangle
inequality shows that one centroid is nearer than all others to every point of a
ball, the whole ball goes to it by its stored count and sum; else the children
take over with the centroids that are still possible, and leaves compare exact
integer distances (ties: the smaller number). Trees are written to the shared
folder, so a round costs one pass over them and a lost executor a re-read. Only
the centroids (k x width integers) visit the driver.

Cases: vectors that are null, of another length, or with null or non-finite
components are left out. Equal starting hashes (repeated ids) go by components;
a null id hashes like the text ``null``. With fewer than k vectors there are as
many centroids as vectors, and equal centroids are won by the smaller number. No
vectors give no rows. Components beyond 2^62 are held there, and a distance or
inertia that a long can't hold is the largest long. Columns other than the id
and the vector are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import written
from tessera.llm._vectors import (
    LARGEST_LONG, as_longs, exact_sum, integer_components, integers, kept_vectors, narrow, reach, squared_distances, squared_norms, widened,
)

#: Vectors of a tree, and of a leaf.
BLOCK, LEAF = 4096, 32


@dataclass(frozen=True)
class BallTree:
    """Vectors in leaf order, and nodes: the range each covers, its children (0: a leaf), radius and sum."""

    x: np.ndarray
    first: np.ndarray
    last: np.ndarray
    left: np.ndarray
    right: np.ndarray
    radius: np.ndarray
    sums: np.ndarray

    def packed(self) -> tuple[bytes, ...]:
        ranges = np.stack((self.first, self.last, self.left, self.right)).astype("<i4").tobytes()
        return narrow(self.x), ranges, self.radius.astype("<f8").tobytes(), narrow(self.sums)

    @classmethod
    def unpacked(cls, width: int, x: bytes, ranges: bytes, radius: bytes, sums: bytes) -> BallTree:
        first, last, left, right = np.frombuffer(ranges, dtype="<i4").reshape(4, -1)
        return cls(widened(x, width), first, last, left, right, np.frombuffer(radius, dtype="<f8"), widened(sums, width))


def ball_tree(x: np.ndarray) -> tuple[BallTree, np.ndarray]:
    """The tree of some vectors, and their order in it.

    A ball is cut at the median of the line between two far points of it. Vectors
    too large for sums in a long make one leaf of unknown radius.
    """
    n, width = x.shape
    order = np.arange(n)
    if reach(x) * n >= 1 << 52:
        ends = np.array([0]), np.array([n]), np.zeros(1, int), np.zeros(1, int)
        return BallTree(x, *ends, np.array([np.inf]), np.zeros((1, width), np.int64)), order
    points = x.astype(np.float64)
    nodes: list[list[int]] = [[0, n, 0, 0]]
    radius, sums = [], []
    k = 0
    while k < len(nodes):
        a, b = nodes[k][:2]
        own = points[order[a:b]]
        sums.append(x[order[a:b]].sum(axis=0))
        centre = sums[-1] / (b - a)
        away = ((own - centre) ** 2).sum(axis=1)
        radius.append(float(np.sqrt(away.max())) * (1 + 1e-9))
        if b - a > LEAF and radius[-1] > 0:
            one = own[away.argmax()]
            two = own[((own - one) ** 2).sum(axis=1).argmax()]
            along = np.argsort(own @ (two - one), kind="stable")
            order[a:b] = order[a:b][along]
            middle = (a + b) // 2
            nodes[k][2:] = len(nodes), len(nodes) + 1
            nodes += [[a, middle, 0, 0], [middle, b, 0, 0]]
        k += 1
    first, last, left, right = np.array(nodes, dtype=np.int64).T
    return BallTree(x[order], first, last, left, right, np.array(radius), np.array(sums)), order


def assigned(tree: BallTree, centroids: np.ndarray) -> tuple[np.ndarray, dict[int, list[int]], np.ndarray]:
    """The cluster of every vector, the balls that went whole to each cluster, and which vectors met exact distances in leaves."""
    centres = centroids.astype(np.float64)
    labels = np.zeros(len(tree.x), dtype=np.int32)
    exact = np.zeros(len(tree.x), dtype=bool)
    whole: dict[int, list[int]] = {}
    # Of equal centroids only the first can win a vector.
    _, firsts = np.unique(centroids, axis=0, return_index=True)
    possible = np.zeros((1, len(centroids)), dtype=bool)
    possible[0, firsts] = True
    front = np.zeros(1, dtype=np.int64)
    while len(front):
        middle = tree.sums[front] / (tree.last[front] - tree.first[front])[:, None]
        # Differences one by one: a matrix product would cancel digits that the bound needs.
        away = np.stack([np.sqrt(((middle - c) ** 2).sum(axis=1)) for c in centres], axis=1)
        radius = tree.radius[front][:, None]
        slack = 1e-9 * (away + radius + 1)
        nearest = np.where(possible, away + radius + slack, np.inf).min(axis=1, keepdims=True)
        possible = possible & ~(away - radius - slack > nearest)
        decided = possible.sum(axis=1) == 1
        for node, cluster in zip(front[decided].tolist(), possible[decided].argmax(axis=1).tolist(), strict=True):
            labels[tree.first[node] : tree.last[node]] = cluster
            whole.setdefault(cluster, []).append(node)
        leaf = ~decided & (tree.left[front] == 0)
        if leaf.any():
            sizes = (tree.last - tree.first)[front[leaf]]
            starts = np.cumsum(sizes) - sizes
            places = np.repeat(tree.first[front[leaf]] - starts, sizes) + np.arange(sizes.sum())
            numbers = np.flatnonzero(possible[leaf].any(axis=0))
            distances = squared_distances(tree.x[places], centroids[numbers])
            # All bounds kept the nearest one possible, so the first of the least is right among all of these.
            labels[places] = numbers[distances.argmin(axis=1)]
            exact[places] = True
        inner = ~decided & ~leaf
        front, possible = np.concatenate((tree.left[front[inner]], tree.right[front[inner]])), np.concatenate((possible[inner], possible[inner]))
    return labels, whole, exact


def own_distances(tree: BallTree, centroids: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Squared distance of every vector from its centroid; what a long can't hold is the largest long."""
    most = 2 * reach(tree.x, centroids)
    wide = most >= 1 << 62
    diff = (tree.x.astype(object) if wide else tree.x) - centroids[labels]
    return as_longs(squared_norms(diff, most))


_PACKED = ("x", "ranges", "radius", "sums")
_TREE = "x binary, ranges binary, radius binary, sums binary"


def tree_blocks(vectors: DataFrame, width: int) -> DataFrame:
    """The written trees of ``_id`` and ``_x``: one row a block of at most ``BLOCK`` vectors of one partition."""
    kind = vectors.schema["_id"].dataType.simpleString()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            while batch.num_rows:
                room = BLOCK - sum(b.num_rows for b in held)
                held.append(batch.slice(0, room))
                batch = batch.slice(room)
                if sum(b.num_rows for b in held) == BLOCK:
                    yield _block(held, width)
                    held = []
        if held:
            yield _block(held, width)

    return written(vectors.select("_id", "_x").mapInArrow(gather, f"ids array<{kind}>, {_TREE}"), "balls")


def _block(batches: list[pa.RecordBatch], width: int) -> pa.RecordBatch:
    held = pa.Table.from_batches(batches).combine_chunks()
    tree, order = ball_tree(integers(held.column(1).combine_chunks(), width))
    ids = held.column(0).combine_chunks().take(pa.array(order))
    listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    return pa.RecordBatch.from_arrays([listed, *(pa.array([p], pa.binary()) for p in tree.packed())], names=["ids", *_PACKED])


def _trees(batch: pa.RecordBatch, width: int) -> Iterator[BallTree]:
    for packed in zip(*(batch.column(c).to_pylist() for c in _PACKED), strict=True):
        yield BallTree.unpacked(width, *packed)


def cluster_sums(blocks: DataFrame, centroids: np.ndarray, inertia: bool = False) -> dict[int, tuple[int, list[int], int]]:
    """Count, exact sum and (if asked for) inertia of each cluster that has vectors; one row a cluster and task is shuffled."""
    k, width = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, error, total = [0] * k, [0] * k, [[0] * width for _ in range(k)]

        def put(cluster: int, n: int, own: list[int]) -> None:
            count[cluster] += n
            total[cluster] = [a + b for a, b in zip(total[cluster], own, strict=True)]

        for batch in batches:
            for tree in _trees(batch, width):
                labels, whole, exact = assigned(tree, centroids)
                for cluster, nodes in whole.items():
                    put(cluster, int((tree.last[nodes] - tree.first[nodes]).sum()), exact_sum(tree.sums[nodes]))
                for cluster in np.unique(labels[exact]).tolist():
                    own = exact & (labels == cluster)
                    put(cluster, int(own.sum()), exact_sum(tree.x[own]))
                if inertia:
                    away = own_distances(tree, centroids, labels)
                    for cluster in np.unique(labels).tolist():
                        error[cluster] += sum(away[labels == cluster].tolist())
        full = [c for c in range(k) if count[c]]
        wide = lambda values: pa.array([Decimal(v) for v in values], pa.decimal128(38, 0))
        columns = [pa.array(full, pa.int32()), pa.array([count[c] for c in full], pa.int64()), wide(error[c] for c in full)]
        names = ["cluster", "n", "error", *(f"s{i}" for i in range(width))]
        yield pa.RecordBatch.from_arrays([*columns, *(wide(total[c][i] for c in full) for i in range(width))], names=names)

    schema = ", ".join(("cluster int, n long, error decimal(38,0)", *(f"s{i} decimal(38,0)" for i in range(width))))
    summed = blocks.select(*_PACKED).mapInArrow(add, schema).groupBy("cluster")
    rows = summed.agg(F.sum("n").alias("n"), F.sum("error").alias("error"), *(F.sum(f"s{i}").alias(f"s{i}") for i in range(width))).collect()
    return {r["cluster"]: (r["n"], [int(r[f"s{i}"]) for i in range(width)], int(r["error"])) for r in rows}


def starting_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The integer vectors with the k smallest sha256 of ``seed:id``, in the order of these."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit("null")))
    whole = vectors.select(F.sha2(text.cast("binary"), 256).alias("_hash"), integer_components(F.col("_x")).alias("_c"))
    return np.array([r["_c"] for r in whole.orderBy("_hash", "_c").limit(k).collect()], dtype=np.int64)


def cluster_vectors(
    vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, width: int = 64, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """Every kept vector's id with cluster, distance, cluster_inertia, inertia and centroid_sha256."""
    vectors = kept_vectors(vectors, vector_column, _id=id_column).filter(F.size("_x") == width)
    blocks = tree_blocks(vectors, width)
    kind = vectors.schema["_id"].dataType.simpleString()
    schema = f"_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    centroids = starting_centroids(vectors, k, seed)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("_id", id_column)
    for _ in range(rounds):
        for cluster, (n, total, _) in cluster_sums(blocks, centroids).items():
            centroids[cluster] = [s // n for s in total]
    errors = {cluster: error for cluster, (_, _, error) in cluster_sums(blocks, centroids, inertia=True).items()}
    overall = min(LARGEST_LONG, sum(errors.values()))
    by_cluster = np.array([min(LARGEST_LONG, errors.get(c, 0)) for c in range(len(centroids))], dtype=np.int64)
    names = np.array([hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, tree in enumerate(_trees(batch, width)):
                labels, _, _ = assigned(tree, centroids)
                columns = [
                    batch.column("ids").slice(i, 1).flatten(), pa.array(labels), pa.array(own_distances(tree, centroids, labels)),
                    pa.array(by_cluster[labels]), pa.array(np.full(len(labels), overall)), pa.array(names[labels], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return blocks.mapInArrow(finish, schema).withColumnRenamed("_id", id_column)
