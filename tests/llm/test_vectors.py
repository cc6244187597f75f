"""Clustering and vector codes against brute force, on small and on awkward inputs."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import ball_clustering, vector_codes

VECTOR = "vec_id long, embedding array<float>, label int, cluster string, code string"


def whole(v):
    return [math.floor(1024 * float(np.float32(x))) for x in v]


def square(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def sound(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def nearest(v, centres):
    return min(range(len(centres)), key=lambda c: (square(v, centres[c]), c))


def moved(rows, labels, centres):
    out = list(centres)
    for c in set(labels):
        own = [r for r, x in zip(rows, labels, strict=True) if x == c]
        out[c] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    return out


def brute_clusters(rows, width, k=8, rounds=10):
    kept = [(i, whole(v)) for i, v, *_ in rows if sound(v) and len(v) == width]
    name = lambda i: hashlib.sha256(f"3:{'null' if i is None else i}".encode()).hexdigest()
    centres = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    for _ in range(rounds):
        labels = [nearest(v, centres) for _, v in kept]
        centres = moved([v for _, v in kept], labels, centres)
    labels = [nearest(v, centres) for _, v in kept]
    away = [square(v, centres[c]) for (_, v), c in zip(kept, labels, strict=True)]
    by = {c: sum(a for a, x in zip(away, labels, strict=True) if x == c) for c in set(labels)}
    digest = lambda c: hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()
    return sorted(((i, c, a, by[c], sum(away), digest(c)) for (i, _), c, a in zip(kept, labels, away, strict=True)), key=repr)


def clustered(spark, rows, **options):
    df = ball_clustering.cluster_vectors(spark.createDataFrame([(*r, "x", "y") for r in rows], VECTOR), **options)
    assert df.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def some_vectors(rng, n, width, spread=0.1):
    middles = [[rng.uniform(-0.5, 0.5) for _ in range(width)] for _ in range(6)]
    return [(i, [rng.gauss(m, spread) for m in rng.choice(middles)], rng.choice([0, 0, 0, 1, 2, None])) for i in range(n)]


def test_clusters_equal_brute_force(spark):
    rng = random.Random(4)
    rows = some_vectors(rng, 500, 6, 0.05)
    rows += [(1000 + i, rows[7][1], None) for i in range(200)]  # copies
    assert clustered(spark, rows, width=6) == brute_clusters(rows, 6)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, None, 0), (2, [], 0), (3, [1.0, None], 0), (4, [nan, 1.0], 0), (5, [inf, 0.0], 0), (6, [1.0], 0), (7, [1.0, 2.0, 3.0], 0)]
    few = [*odd, (8, [1.0, 2.0], 1), (8, [1.0, 2.0], 1), (None, [-0.3, 0.0], None), (9, [-0.0001, 0.0], 2)]
    assert clustered(spark, few, width=2) == brute_clusters(few, 2)
    assert clustered(spark, odd, width=2) == [] and clustered(spark, [], width=2) == []
    ties = [(i, [float(x), 0.0], 0) for i, x in enumerate([0, 1, 2, 3, 4, 1, 3] * 9)]
    assert clustered(spark, ties, width=2, k=3) == brute_clusters(ties, 2, k=3)
    big = [(i, [x, 1.0], 0) for i, x in enumerate([1e6, -1e6, 3e9, -3e9, 0.0, 5.0] * 3)]
    got, want = clustered(spark, big, width=2, k=2), brute_clusters(big, 2, k=2)
    held = [tuple(min(x, (1 << 63) - 1) if isinstance(x, int) else x for x in r) for r in want]
    assert [r[:3] for r in got] == [r[:3] for r in held] and [r[5] for r in got] == [r[5] for r in want]
    huge = [(1, [3e38, 0.0], 0), (2, [-3e38, 1.0], 0)]
    assert {r[1] for r in clustered(spark, huge, width=2)} == {0, 1}


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 300), st.integers(1, 5), st.integers(1, 9), st.integers(0, 10**6), st.sampled_from([2, 50, 10**4, 10**8, 10**12]))
def test_tree_assigns_like_all_distances(n, width, k, seed, most):
    rng = np.random.default_rng(seed)
    x, centroids = rng.integers(-most, most, (n, width)), rng.integers(-most, most, (k, width))
    tree, order = ball_clustering.ball_tree(x)
    assert sorted(order.tolist()) == list(range(n)) and (tree.x == x[order]).all()
    labels, whole_balls, exact = ball_clustering.assigned(tree, centroids)
    wide = tree.x.astype(object)
    assert labels.tolist() == [nearest(v, centroids.astype(object).tolist()) for v in wide.tolist()]
    covered = exact.astype(int)
    for nodes in whole_balls.values():
        for k in nodes:
            covered[tree.first[k] : tree.last[k]] += 1
    assert (covered == 1).all()


def test_balls_spare_distances():
    rng = np.random.default_rng(1)
    centroids = rng.integers(-1000, 1000, (8, 64))
    x = np.concatenate([c + rng.integers(-20, 20, (500, 64)) for c in centroids])
    _, whole_balls, exact = ball_clustering.assigned(ball_clustering.ball_tree(x)[0], centroids)
    assert sum(map(len, whole_balls.values())) >= 8 and exact.sum() < 400


def brute_codes(rows, parts=4, entries=256, rounds=4):
    kept = [(i, whole(v), label) for i, v, label in rows if sound(v) and v]
    if not kept:
        return []
    lengths = [len(v) for _, v, _ in kept]
    width = min(set(lengths), key=lambda n: (-lengths.count(n), n))
    size = -(-width // parts)
    kept = [(i, v + [0] * (size * parts - width), label) for i, v, label in kept if len(v) == width]
    firsts = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    cut = lambda v, p: v[p * size : (p + 1) * size]
    books = [[cut(v, p) for _, v, _ in firsts] for p in range(parts)]
    for _ in range(rounds):
        books = [moved(own := [cut(v, p) for _, v, _ in kept], [nearest(x, books[p]) for x in own], books[p]) for p in range(parts)]
    codes = [[nearest(cut(v, p), books[p]) for p in range(parts)] for _, v, _ in kept]
    error = [sum(square(cut(v, p), books[p][c[p]]) for p in range(parts)) for (_, v, _), c in zip(kept, codes, strict=True)]
    by = {}
    for (_, _, label), e in zip(kept, error, strict=True):
        by[label] = by.get(label, 0) + e
    flat = [x for p in range(parts) for e in books[p] for j, x in enumerate(e) if p * size + j < width]
    name = hashlib.sha256(",".join(map(str, flat)).encode()).hexdigest()
    hexed = ["".join(f"{d:02x}" for d in c) for c in codes]
    return sorted(((i, c, e, by[label], name) for (i, _, label), c, e in zip(kept, hexed, error, strict=True)), key=repr)


def compressed(spark, rows, **options):
    df = vector_codes.compress_vectors(spark.createDataFrame([(*r, "x", "y") for r in rows], VECTOR), **options)
    assert df.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_codes_equal_brute_force(spark):
    rows = some_vectors(random.Random(5), 240, 8, 0.2)
    rows += [(1000 + i, rows[3][1], 0) for i in range(60)]
    assert compressed(spark, rows, entries=20) == brute_codes(rows, entries=20)


def test_awkward_codes(spark):
    nan = float("nan")
    odd = [(1, None, 0), (2, [], 0), (3, [1.0, None], 0), (4, [nan, 1.0], None)]
    few = [*odd, (5, [0.5, 1.0, 2.0], None), (5, [0.25, 1.0, 2.0], None), (None, [0.0, 0.0, 1.0], 3), (6, [1.0], 3), (7, [9.0, 1.0], 3)]
    assert compressed(spark, few) == brute_codes(few)
    assert compressed(spark, odd) == [] and compressed(spark, []) == []
    same = [(i, [0.5, -0.5, 0.5, -0.5], i % 2) for i in range(40)]
    assert compressed(spark, same, entries=5) == brute_codes(same, entries=5)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 60), st.integers(1, 20), st.integers(1, 40), st.integers(0, 10**6), st.sampled_from([2, 60, 10**4, 10**8, 10**12]))
def test_bounds_keep_the_nearest_entry(n, width, k, seed, most):
    rng = np.random.default_rng(seed)
    x, entries = rng.integers(-most, most, (n, width)), rng.integers(-most, most, (k, width))
    index, distance, taken = vector_codes.nearest_entries(x, entries)
    listed = entries.tolist()
    assert index.tolist() == [nearest(v, listed) for v in x.tolist()] and n <= taken <= n * k
    assert distance.tolist() == [min((1 << 63) - 1, square(v, listed[e])) for v, e in zip(x.tolist(), index.tolist(), strict=True)]


def test_bounds_spare_distances():
    rng = np.random.default_rng(2)
    x = np.cumsum(rng.integers(-30, 30, (500, 16)), axis=1)
    _, _, taken = vector_codes.nearest_entries(x, x[:256])
    assert taken < 0.2 * 500 * 256


@pytest.mark.parametrize("width", [1, 3, 4, 17])
def test_sketch_bounds_are_below_distances(width):
    rng = np.random.default_rng(3)
    a, b = rng.integers(-500, 500, (50, width)), rng.integers(-500, 500, (50, width))
    one, two = vector_codes._Sketch(a), vector_codes._Sketch(b)
    true = ((a - b) ** 2).sum(axis=1)
    coarse = (one.coarse - two.coarse) ** 2 + (one.coarse_rest - two.coarse_rest) ** 2
    fine = ((one.fine - two.fine) ** 2).sum(axis=1) + (one.fine_rest - two.fine_rest) ** 2
    assert (coarse <= true + 1e-6).all() and (fine <= true + 1e-6).all()
