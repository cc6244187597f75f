"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints within ``RADIUS`` = 4 bits have a common variant within
2 bits of each. So every distinct fingerprint emits all its 2081 variants within
half the radius, and fingerprints that share a variant are linked; by the
triangle inequality such a pair is within the radius, so the collision itself is
the check.

The shuffle does not carry the variants one by one. It deals them by their first
``k`` bits: a fingerprint goes to the 1 + k + k(k-1)/2 buckets that any of its
variants can lie in, together with the number of bits that it may still change,
and the bucket writes out the variants it is meant to hold. k grows with the
logarithm of the number of fingerprints, so that a bucket has some two million
variants; a bucket that has more works through them by further bits, one part at
a time. A bucket returns a spanning forest of its links, never all pairs of a
group, and components are joined by alternating large-star and small-star steps
on written tables.

Copies have one fingerprint and count once before anything is emitted, so a hot
group of copies costs one row. Cases: a null text has no words; texts without
words have fingerprint zero and are linked like any other. Rows are nodes, so a
repeated doc_id is harmless; a null doc_id never is the smallest id, and a
component with null ids only has a null component_id. An empty table gives an
empty result.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tessera.llm._shared import written

SHINGLE_WORDS, SEED = 4, 42
RADIUS, HALF = 4, 2
BUCKET_VARIANTS = 1 << 21
LEAST_BITS, MOST_BITS = 8, 40


def fingerprint_of(text: str | None) -> int:
    """The 64-bit SimHash: a bit is set if over half of the shingle hashes have it."""
    hashes = shingle_hashes(text)
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    most = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(most, bitorder="little").view("<u8")[0])


def shingle_hashes(text: str | None, size: int = SHINGLE_WORDS) -> np.ndarray:
    """XXH64 of every shingle of ``size`` words, repeats included; A-Z are lower-cased, words end at ASCII white space."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, dtype="<u8")
    n = max(1, len(words) - size + 1)
    runs = zip(*(words[i:] for i in range(size)), strict=False) if len(words) >= size else [words]
    return np.fromiter(map(xxh64_intdigest, map(b" ".join, runs), itertools.repeat(SEED)), dtype="<u8", count=n)


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``fp``, the fingerprint as a signed long, for every row."""
    source = docs.select(*keep, F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint_of(t) for t in batch.column("_text").to_pylist()], dtype=np.uint64)
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(fps.view(np.int64))], names=[*keep, "fp"])

    return source.mapInArrow(sketch, f"{schema}, fp long")


def masks(bits: int, weight: int) -> np.ndarray:
    """All patterns of at most ``weight`` set bits among the lowest ``bits``."""
    one = np.uint64(1) << np.arange(bits, dtype=np.uint64)
    out = [np.zeros(1, dtype=np.uint64)]
    if weight >= 1:
        out.append(one)
    if weight >= 2:
        i, j = np.triu_indices(bits, 1)
        out.append(one[i] | one[j])
    return np.concatenate(out)


def n_masks(bits: int, weight: int) -> int:
    return sum(math.comb(bits, w) for w in range(weight + 1))


def collisions(values: np.ndarray, left: np.ndarray, source: np.ndarray, bits: int, limit: int = 4 * BUCKET_VARIANTS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (source, smallest source) among entries that share a variant.

    An entry stands for the variants of ``values`` that change at most ``left``
    of the lowest ``bits`` bits. More than ``limit`` variants are taken in two
    parts by the highest of these bits, one after the other.
    """
    per = np.array([n_masks(bits, w) for w in range(HALF + 1)])
    if len(values) < 2:
        return
    if per[left].sum() > limit and bits > 1:
        top = np.uint64(1) << np.uint64(bits - 1)
        has = (values & top) != 0
        for wanted in (False, True):
            same, turned = has == wanted, (has != wanted) & (left > 0)
            yield from collisions(
                np.concatenate((values[same], values[turned] ^ top)),
                np.concatenate((left[same], left[turned] - 1)),
                np.concatenate((source[same], source[turned])),
                bits - 1, limit,
            )
        return
    variants, owner = [], []
    for w in range(HALF + 1):
        of = left == w
        if of.any():
            m = masks(bits, w)
            variants.append((values[of][:, None] ^ m[None, :]).ravel())
            owner.append(np.repeat(source[of], len(m)))
    variants, owner = np.concatenate(variants), np.concatenate(owner)
    order = np.argsort(variants)
    variants = variants[order]
    same = variants[1:] == variants[:-1]
    if not same.any():
        return
    member = np.concatenate(([False], same)) | np.concatenate((same, [False]))
    who, value = owner[order[member]], variants[member]
    starts = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
    least = np.repeat(np.minimum.reduceat(who, starts), np.diff(np.append(starts, len(who))))
    linked = who != least
    pairs = np.unique(np.stack((who[linked], least[linked]), axis=1), axis=0)
    yield pairs[:, 0], pairs[:, 1]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes the smallest node of its component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == label).all():
            return label
        label = new


def linked_fingerprints(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) of a forest per bucket over the distinct fingerprints in column ``fp``."""
    n = max(1, distinct.count())
    k = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(n * n_masks(64, HALF) / BUCKET_VARIANTS))))
    low = 64 - k
    patterns = {w: np.setdiff1d(masks(k, w), masks(k, w - 1) if w else np.zeros(0, np.uint64)) for w in range(HALF + 1)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(fps), 2000):
                part = fps[at : at + 2000]
                for w, m in patterns.items():
                    bucket = ((part >> np.uint64(low))[:, None] ^ m[None, :]).ravel()
                    yield pa.RecordBatch.from_pydict(
                        {"bucket": bucket.view(np.int64), "fp": np.repeat(part, len(m)).view(np.int64), "budget": np.full(len(bucket), HALF - w, dtype=np.int8)}
                    )

    def meet(table: pa.Table) -> pa.Table:
        fps, first = np.unique(table.column("fp").to_numpy().view(np.uint64), return_index=True)
        left = table.column("budget").to_numpy()[first].astype(np.int64)
        found = list(collisions(fps & np.uint64((1 << low) - 1), left, np.arange(len(fps)), low))
        if not found:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        root = forest(len(fps), np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found]))
        node = np.flatnonzero(root != np.arange(len(fps)))
        return pa.table({"a": fps[node].view(np.int64), "b": fps[root[node]].view(np.int64)})

    dealt = distinct.select("fp").mapInArrow(deal, "bucket long, fp long, budget byte")
    return dealt.groupBy("bucket").applyInArrow(meet, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of the undirected edges (a, b); the root is the smallest node of the component.

    Alternates large-star and small-star steps, with minima by aggregation and
    joins that AQE can split, until no edge changes. Each step is written.
    """
    star = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "edges")
    before = None
    while True:
        both = star.select("a", "b").union(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low")).withColumnRenamed("a", "_a")
        large = both.join(low, F.col("a") == F.col("_a")).filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("low")).withColumnRenamed("a", "_a")
        joined = large.join(down, F.col("a") == F.col("_a"))
        small = joined.filter("b != low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        small = small.union(joined.select("a", F.col("low").alias("b"))).distinct()
        star = written(small, "edges")
        now = star.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if before == now:
            return star.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
        before = now


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fp and component_id of every row of ``docs``."""
    named = written(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")), "_text"), "fingerprints")
    least = written(named.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    rooted = components(linked_fingerprints(least))
    owned = least.join(rooted, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = owned.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "_root")
    of = owned.join(smallest, F.col("root") == F.col("_root")).select(F.col("fp").alias("_fp"), "component_id")
    return named.join(of, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")
