"""Stages of the pipeline against brute force."""

from __future__ import annotations

import itertools
import pathlib
import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tessera.llm import toxicity
from tessera.llm.jaccard_dedup import BITS, FEW, TABLES, bitmap_of, meetings, prefix_pairs, similar

DOC = "doc_id long, text string, source string"


def five_words(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def groups(texts):
    sets, root = [five_words(t) for t in texts], list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if alike(sets[i], sets[j]):
            old, new = root[j], root[i]
            root = [new if r == old else r for r in root]
    return root


def near_copies(rng, n_bases=12, copies=6):
    """Texts with 1 to 7 of 150 words replaced, one after the other and all from one base, above and below 0.8."""
    words = [f"w{i}" for i in range(500)]
    texts = []
    for k in range(n_bases):
        base = rng.choices(words, k=150)
        texts.append(" ".join(base))
        for _ in range(copies):
            copy = list(base)
            for at in rng.sample(range(150), rng.randint(1, 7)):
                copy[at] = rng.choice(words)
            texts.append(" ".join(copy))
            base = copy if k % 2 else base
    return texts


def stage_rows(spark, stage, rows, sf_dir):
    out = stage(spark, spark.createDataFrame([(i, t, "s") for i, t in rows], DOC), sf_dir)
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)


def test_near_copies_go_as_all_pairs_say(spark, sf_dir):
    rng = random.Random(8)
    texts = [*near_copies(rng), None, "", " \t", "one two", "One TWO", "one two three four five six seven eight", "one two three four five six seven eight nine"]
    rng.shuffle(texts)
    root = groups(texts)
    want = [(min(i for i, q in enumerate(root) if q == r), r) for r in set(root)]
    assert stage_rows(spark, pipeline.drop_near_duplicates, enumerate(texts), sf_dir) == sorted(((i, texts[i]) for i, _ in want), key=repr)
    assert 5 < len(want) < len(texts) - 30


def test_near_duplicates_with_null_and_repeated_ids(spark, sf_dir):
    a, b, c, d, e, f = (" ".join(f"{k}{i}" for i in range(40)) for k in "abcdef")
    rows = [(1, a), (None, a), (None, b), (None, c), (None, c), (2, d), (2, e), (2, e), (3, d), (5, f), (4, f), (4, a)]
    want = [(1, a), (None, b), (None, c), (2, d), (2, e), (4, f)]
    assert stage_rows(spark, pipeline.drop_near_duplicates, rows, sf_dir) == sorted(want, key=repr)


def test_repeats_are_cut_as_brute_force_cuts(spark, sf_dir):
    rng = random.Random(4)
    shared = "é".join(rng.choices("abcdefgh\ufffd", k=60))
    rows = [(i, "".join(rng.choices("xyzé\ufffd", k=rng.randint(0, 90))) + (shared[rng.randrange(30) :] if i % 2 else "")) for i in range(30)]
    rows += [(None, shared), (3, shared), (40, None), (41, ""), (42, rows[5][1])]
    whole = [(i, (t or "").encode()) for i, t in rows]
    starts: dict[bytes, int] = {}
    for i, b in whole:
        for at in range(len(b) - 49):
            key = b[at : at + 50]
            starts[key] = min(starts.get(key, 1 << 60), 1 << 60 if i is None else i)
    want = []
    for i, b in whole:
        gone = set()
        for at in range(len(b) - 49):
            if starts[b[at : at + 50]] < (1 << 60 if i is None else i):
                gone.update(range(at, at + 50))
        want.append((i, bytes(x for k, x in enumerate(b) if k not in gone).decode("utf-8", "ignore")))
    docs = spark.createDataFrame([(i, t, 7, "clash") for i, t in rows], "doc_id long, text string, n_chars long, _other string")
    got = pipeline.cut_repeated_passages(spark, docs, sf_dir)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_a_stage_removes_what_the_one_before_left(spark, sf_dir):
    folder = pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pipeline.drop_toxic(spark, docs, sf_dir)  # takes away what other tests left
    before, tables = set(folder.iterdir()), len(spark.catalog.listTables())
    for step in (pipeline.drop_near_duplicates, pipeline.cut_repeated_passages, pipeline.drop_leaks):
        step(spark, docs, sf_dir).write.format("noop").mode("overwrite").save()
        assert set(folder.iterdir()) - before
    pipeline.drop_toxic(spark, docs, sf_dir).count()
    assert not any(p.name.startswith(("rows", "chunks", "words", "pairs", "classes")) for p in set(folder.iterdir()) - before)
    assert len(spark.catalog.listTables()) <= tables
    first = pipeline.numbered(docs)[0].select(docs.toDF(*(f"_c{i}" for i in range(len(docs.columns)))).columns).toDF(*docs.columns)
    assert pipeline.drop_toxic(spark, first, sf_dir).count() > 0


def test_columns_named_like_the_operators_own_stay(spark, sf_dir):
    names = ["_row", "_text", "_kept", "_spans", "_n_bytes", "_id", "_bytes", "_words", "chunk", "size", "digest", "bands", "least", "rest"]
    texts = ["a b c d e f g h " * 9, "unlike the others in all its words", None, ""]
    rows = [(i, t, *(1000 * i + k for k in range(len(names)))) for i, t in enumerate([*texts, texts[0]])]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *(f"{n} long" for n in names)]))
    for stage, kept in ((pipeline.drop_toxic, 5), (pipeline.drop_near_duplicates, 3), (pipeline.cut_repeated_passages, 5), (pipeline.drop_leaks, 5)):
        got = stage(spark, docs, sf_dir)
        out = got.collect()
        assert got.columns == docs.columns and len(out) == kept, stage.__name__
        assert all(tuple(r)[2:] == rows[r.doc_id][2:] for r in out), stage.__name__


def test_toxic_rows_go_and_columns_may_clash(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = docs.withColumn("score", F.lit("mine")).withColumn("predicted", F.lit(5)).withColumn("evidence", F.col("doc_id"))
    odd = odd.unionByName(odd.limit(3)).unionByName(spark.createDataFrame([(None, None, None, None, None, "mine", 5, None)], odd.schema))
    model = pipeline.toxicity_model(spark, odd, sf_dir)
    score = {(r.doc_id, r.text): r.predicted for r in toxicity.score_toxicity(docs, model, keep=("doc_id", "text")).collect()}
    got = pipeline.drop_toxic(spark, odd, sf_dir)
    assert got.columns == odd.columns and {(r.score, r.predicted) for r in got.collect()} == {("mine", 5)}
    kept = {(r.doc_id, r.text) for r in got.collect()}
    assert kept == {k for k, p in score.items() if p == 0} | {(None, None)}


def test_leaks_go_row_by_row(spark, sf_dir):
    item = max((r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()), key=len)
    clean = [" ".join(f"{k}{i}" for i in range(40)) for k in "xyz"]
    rows = [(None, item), (None, clean[0]), (None, clean[1]), (7, item), (7, clean[2]), (8, item)]
    want = [(None, clean[0]), (None, clean[1]), (7, clean[2])]
    assert stage_rows(spark, pipeline.drop_leaks, rows, sf_dir) == sorted(want, key=repr)


def test_prefix_pairs_hold_every_similar_pair_of_unlike_roots(spark):
    """Sets around one base, so that most pairs lie just above or below the bound; none is lost, and far fewer than all are met."""
    rng = np.random.default_rng(3)
    base = rng.integers(1, 1 << 62, 120, dtype=np.uint64)
    held = []
    for row in range(160):
        size = int(rng.integers(2, 34))
        kept = rng.permutation(base)[: 120 - size]
        held.append((row, np.unique(np.concatenate((kept, rng.integers(1, 1 << 62, size + row % 3, dtype=np.uint64))))))
    sets = spark.createDataFrame([(row, bytearray(s.tobytes())) for row, s in held], "_row long, shingles binary")
    rest = spark.createDataFrame([(row, len(s), row % 7) for row, s in held], "_row long, size long, root long")
    found = {(r["a"], r["b"]) for r in prefix_pairs(rest, sets).collect()}
    apart = [(x, y) for x in held for y in held if x[0] < y[0] and x[0] % 7 != y[0] % 7]
    assert {(x[0], y[0]) for x, y in apart if similar(x[1], y[1])} <= found
    assert len(found) < len(apart) / 2


def ball_rows(rng, crowd):
    """Fingerprints of rows that differ in 0 to 8 bits in one table or another, some of them many from one."""
    fps = []
    for k in range(60):
        base = rng.integers(0, 1 << BITS, TABLES)
        for _ in range(crowd if k == 7 else 2):
            turned = np.array([sum(1 << int(i) for i in rng.choice(BITS, rng.integers(0, 5), replace=False)) for _ in range(TABLES)])
            fps.append((base ^ turned if rng.random() < 0.5 else np.where(np.arange(TABLES) == k % TABLES, base ^ turned, rng.integers(0, 1 << BITS, TABLES))).tolist())
    return fps


def met_and_crowded(spark, fps, sizes, roots=None, turn=0, bits=4):
    rows = [(1000 + i, z, f, *([roots[i]] if roots else [])) for i, (z, f) in enumerate(zip(sizes, fps, strict=True))]
    met = meetings(spark.createDataFrame(rows, "_row long, size long, fps array<long>" + (", root long" if roots else "")), bits, turn).collect()
    return {(r.a - 1000, r.b - 1000) for r in met if r.b is not None}, {r.a - 1000 for r in met if r.b is None}


def test_balls_meet_where_fingerprints_are_within_four_bits(spark):
    """All pairs within 4 bits in some table, and no others, by whatever bits they are dealt."""
    rng = np.random.default_rng(1)
    fps = ball_rows(rng, 3)
    fps += [fps[0], fps[0]]
    sizes = [100 if i % 9 else 126 for i in range(len(fps))]
    within = lambda a, b: any((x ^ y).bit_count() <= 4 for x, y in zip(fps[a], fps[b], strict=True))
    near = {(a, b) for a, b in itertools.combinations(range(len(fps)), 2) if within(a, b)}
    want = {(a, b) for a, b in near if sizes[a] == sizes[b]}
    assert 30 < len(want) < len(near)
    for bits in (4, 7):
        assert met_and_crowded(spark, fps, sizes, bits=bits) == (want, set())


def test_no_pair_of_a_crowd_is_lost(spark):
    """A pair within 4 bits is met, or both its rows come back as rows of a crowd while their roots differ."""
    fps = ball_rows(np.random.default_rng(2), 60)
    fps += [fps[14]] * (FEW + 4)
    within = lambda a, b: any((x ^ y).bit_count() <= 4 for x, y in zip(fps[a], fps[b], strict=True))
    near = {(a, b) for a, b in itertools.combinations(range(len(fps)), 2) if within(a, b)}
    met, crowded = met_and_crowded(spark, fps, [50] * len(fps))
    assert met < near and len(crowded) > 20
    assert all({a, b} <= crowded for a, b in near - met)
    roots = [1000 + i % 2 for i in range(len(fps))]
    again, still = met_and_crowded(spark, fps, [50] * len(fps), roots, 1)
    assert again <= near and all((a - b) % 2 for a, b in again)
    assert all({a, b} <= still for a, b in near - met - again if (a - b) % 2)
    assert met_and_crowded(spark, fps, [50] * len(fps), [1000] * len(fps), 1) == (set(), set())


def test_a_hot_group_of_near_copies_goes_as_all_pairs_say(spark, sf_dir):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(70):
        copy = list(base)
        for at in rng.sample(range(60), rng.choice((0, 1, 1, 2))):
            copy[at] = rng.choice("xyz")
        texts.append(" ".join(copy))
    root = groups(texts)
    want = sorted(((min(i for i, q in enumerate(root) if q == r), r) for r in set(root)), key=repr)
    assert 1 < len(want) < 60
    assert stage_rows(spark, pipeline.drop_near_duplicates, enumerate(texts), sf_dir) == sorted(((i, texts[i]) for i, _ in want), key=repr)


def test_a_crowd_is_tested_against_few_rows_each(spark):
    """Pairs to test of a crowd grow with its rows, not with their pairs: at most one of each row's own a table."""
    rng, met = np.random.default_rng(9), {}
    base = rng.integers(0, 1 << BITS, TABLES)
    turned = lambda: [sum(1 << int(i) for i in rng.choice(BITS, rng.integers(0, 4), replace=False)) for _ in range(TABLES)]
    for n in (100, 400):
        fps = [(base ^ np.array(turned())).tolist() for _ in range(n)]
        met[n], crowded = met_and_crowded(spark, fps, [50] * n)
        assert crowded == set(range(n))
        again, still = met_and_crowded(spark, fps, [50] * n, [1000 + i % 2 for i in range(n)], 1)
        assert still == set(range(n)) and n / 2 <= len(again) <= TABLES * n
        assert n / 2 <= len(met[n]) <= TABLES * n
    assert len(met[400]) < 6 * len(met[100])


def test_prefix_pairs_leave_out_what_bitmaps_tell_apart(spark):
    """Of sets around one base nearly all pairs given are similar; bitmaps never differ in more bits than sets in shingles."""
    rng = np.random.default_rng(6)
    base = rng.integers(1, 1 << 62, 150, dtype=np.uint64)
    held = [(row, np.unique(np.concatenate((rng.permutation(base)[: 150 - n], rng.integers(1, 1 << 62, n, dtype=np.uint64))))) for row in range(120) for n in [int(rng.integers(5, 20))]]
    for (_, a), (_, b) in itertools.combinations(held, 2):
        assert np.unpackbits((bitmap_of(a) ^ bitmap_of(b)).view(np.uint8)).sum() <= len(np.setxor1d(a, b))
    sets = spark.createDataFrame([(row, bytearray(s.tobytes())) for row, s in held], "_row long, shingles binary")
    found = {(r["a"], r["b"]) for r in prefix_pairs(spark.createDataFrame([(row, len(s), row) for row, s in held], "_row long, size long, root long"), sets).collect()}
    want = {(x[0], y[0]) for x, y in itertools.combinations(held, 2) if similar(x[1], y[1])}
    assert want <= found and len(want) > 100
    assert len(found - want) < len(want) / 4
