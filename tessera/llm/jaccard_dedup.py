"""Near duplicates by the exact Jaccard similarity of five-word shingles.

Rows with one set of shingles are a class and count once, so a hot group of
copies costs one row. Candidates come from meet-in-the-middle ball hashing of
``TABLES`` fingerprints a class: a bit of a fingerprint is a bit of the hash of
another minimum hash, so in each of its ``BITS`` bits two classes of similarity s
differ with probability (1 - s) / 2. Fingerprints within 4 bits have a
common variant within 2 bits of each; as in ``simhash_dedup`` the variants are
dealt by their first bits and written out in their bucket. Candidates are linked
only if the similarity of their whole sets is ``LEAST`` or more. A pair at 0.8 is
within 4 bits in no table with probability 5e-5, a more similar one less often.

A row that meets at most ``FEW`` others in a bucket is tested against all of them.
The others, and those whom they meet, are a crowd, as in a hot group of near copies:
each is tested against one row a table, and this is repeated, against other rows of
other components, while each turn takes away some of the crowd's components. So the
tests grow with the rows of a crowd, not with their pairs. Of the rows that are left
``prefix_pairs`` gives all pairs that can still be similar, by exact bounds. Pairs
within a component need no test, so nothing is left out. Components are joined by
``simhash_dedup.components``.

Cases: texts of fewer than five words are one shingle; a null text has no words,
and all texts without words are copies of each other. Rows, not ids, are nodes:
of each component the row with the smallest (doc_id, row key) stays, null ids
last, so repeated and null ids are harmless. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from tessera.llm._hashing import mixed
from tessera.llm._shared import written
from tessera.llm.simhash_dedup import HALF, components, masks, n_masks, shingle_hashes

SHINGLE_WORDS = 5
#: The least similarity of near duplicates, as a fraction of whole numbers.
LEAST = (4, 5)
TABLES, BITS = 10, 40
#: Sets of fewer shingles reach the least similarity only if they are equal.
LEAST_SHINGLES = 4
#: Rows that share a variant and are all compared with each other.
FEW = 8
#: Rows dealt to a bucket, about, and variants that it writes out at once.
BUCKET_ROWS, MOST_VARIANTS = 1 << 21, 1 << 22
LEAST_BITS, MOST_BITS = 4, 20
#: Where an entry keeps the bits that it may still change and the size of its set.
BUDGET_AT, SIZE_AT = BITS - 2, BITS
MOST_SIZE = (1 << 22) - 1
#: The exact bound takes over when a turn leaves more than this part of the components of a crowd.
STALLED = (49, 50)
#: Longs of the bitmap of a set.
MAP_LONGS = 32
BLOCK = 4096
#: The place of no row, after all others.
NOWHERE = (1 << 63) - 1
_rng = np.random.default_rng(5)
_ORDERS = _rng.integers(0, 1 << 32, TABLES * BITS, dtype=np.uint32) | np.uint32(1)
_PLACES = np.uint64(1) << np.arange(BITS, dtype=np.uint64)


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct hashes of the five-word shingles, in order."""
    return np.unique(shingle_hashes(text, SHINGLE_WORDS))


def fingerprints_of(shingles: np.ndarray) -> np.ndarray:
    """``TABLES`` fingerprints of ``BITS`` bits, each bit from another minimum hash."""
    least, short = np.full(TABLES * BITS, np.iinfo(np.uint32).max, dtype=np.uint32), shingles.astype(np.uint32)
    for at in range(0, len(short), BLOCK):
        np.minimum(least, (_ORDERS[:, None] * short[None, at : at + BLOCK]).min(axis=1), out=least)
    bits = (mixed(least.astype(np.uint64)) >> np.uint64(20)) & np.uint64(1)
    return (bits.reshape(TABLES, BITS) * _PLACES).sum(axis=1, dtype=np.uint64)


def bitmap_of(shingles: np.ndarray) -> np.ndarray:
    """A bit for each value of the lowest bits of a shingle: whether an odd number of shingles has it.

    Two bitmaps differ in no more bits than the sets differ in shingles.
    """
    odd = np.bincount((shingles & np.uint64(64 * MAP_LONGS - 1)).astype(np.int64), minlength=64 * MAP_LONGS).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view("<i8")


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two ordered sets is ``LEAST`` or more."""
    if len(a) > len(b):
        a, b = b, a
    if LEAST[1] * len(a) < LEAST[0] * len(b):
        return False
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(b) else 0
    return LEAST[1] * both >= LEAST[0] * (len(a) + len(b) - both)


def sketches(rows: DataFrame) -> DataFrame:
    """doc_id, _row, size and digest of the shingle set and its fingerprints, for every row of (doc_id, _row, text)."""
    doc_id = rows.schema["doc_id"].dataType.simpleString()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, digest, fps = [], [], []
            for text in batch.column("text").to_pylist():
                shingles = shingle_set(text)
                size.append(len(shingles))
                digest.append(xxh3_128_digest(shingles.tobytes()))
                fps.append(fingerprints_of(shingles).view(np.int64) if len(shingles) >= LEAST_SHINGLES else np.zeros(0, np.int64))
            columns = [batch.column("doc_id"), batch.column("_row"), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(fps, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "_row", "size", "digest", "fps"])

    return rows.select("doc_id", "_row", "text").mapInArrow(sketch, f"doc_id {doc_id}, _row long, size long, digest binary, fps array<long>")


def shingle_sets(rows: DataFrame) -> DataFrame:
    """_row and its shingle set as bytes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(sets, pa.binary())], names=["_row", "shingles"])

    return rows.select("_row", "text").mapInArrow(cut, "_row long, shingles binary")


def similar_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of rows whose sets are similar."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("_left"), batch.column("_right")
            of = lambda x: np.frombuffer(x.as_buffer(), dtype="<u8")
            passed = pa.array([similar(of(x), of(y)) for x, y in zip(left, right, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(passed), batch.column("b").filter(passed)], names=["a", "b"])

    named = lambda row, shingles: sets.select(F.col("_row").alias(row), F.col("shingles").alias(shingles))
    held = pairs.join(named("a", "_left"), "a").join(named("b", "_right"), "b")
    return held.select("a", "b", "_left", "_right").mapInArrow(test, "a long, b long")


def _near(x: Column, y: Column) -> Column:
    """Whether sets of these sizes can be similar."""
    return LEAST[1] * F.least(x, y) >= LEAST[0] * F.greatest(x, y)


def _places(row: np.ndarray, turn: int) -> np.ndarray:
    """An order of rows, another one in each turn."""
    return (mixed(row.view(np.uint64) * np.uint64(2 * turn + 1) + np.uint64(turn)) >> np.uint64(2)).view(np.int64)


def prefix_bits(n: int) -> int:
    """Leading bits by which the variants of ``n`` rows are dealt, so that a bucket gets some ``BUCKET_ROWS`` at most."""
    fits = (k for k in range(LEAST_BITS, MOST_BITS) if n * n_masks(k, HALF) <= BUCKET_ROWS << k)
    return next(fits, MOST_BITS)


def shared_variants(values: np.ndarray, left: np.ndarray, bits: int, source: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(source, group) of the variants that two or more of the distinct ``values`` share, a group a variant.

    A value stands for its variants that change at most ``left`` of the lowest
    ``bits`` bits. More than ``MOST_VARIANTS`` are taken in two parts by the highest
    of these bits, one after the other.
    """
    source = np.arange(len(values)) if source is None else source
    if len(values) < 2:
        return
    if np.array([n_masks(bits, w) for w in range(HALF + 1)])[left].sum() > MOST_VARIANTS and bits > 1:
        top = np.uint64(1) << np.uint64(bits - 1)
        has = (values & top) != 0
        for wanted in (False, True):
            same, turned = has == wanted, (has != wanted) & (left > 0)
            yield from shared_variants(
                np.concatenate((values[same], values[turned] ^ top)), np.concatenate((left[same], left[turned] - 1)), bits - 1, np.concatenate((source[same], source[turned]))
            )
        return
    width = np.uint64(int(source.max()).bit_length())
    variants = []
    for w in range(HALF + 1):
        of = left == w
        if of.any():
            variants.append((((values[of][:, None] ^ masks(bits, w)[None, :]) << width) | source[of].astype(np.uint64)[:, None]).ravel())
    found = np.sort(np.concatenate(variants))  # the variant above, its source below
    variants = found >> width
    same = variants[1:] == variants[:-1]
    if same.any():
        member = np.concatenate(([False], same)) | np.concatenate((same, [False]))
        value = variants[member]
        yield (found[member] & ((np.uint64(1) << width) - np.uint64(1))).astype(np.int64), np.cumsum(np.diff(value, prepend=value[0]) != 0)


def _met(row: np.ndarray, root: np.ndarray | None, entry: np.ndarray, low: int, turn: int) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of a bucket's entries: the pairs of rows to test, and the rows of a crowd, each with one row to test it against and that one's place.

    Without roots the pairs are all those of rows that meet ``FEW`` rows at most. The
    others, and whom they meet, are a crowd, as are all that share a variant with more
    than ``FEW``. With roots, all rows that share a variant with another root are. A
    row of a crowd goes with the first one that it can be similar to and whose root is
    another, in an order that changes with ``turn`` and is one for all buckets; where
    there is none the place is ``NOWHERE``.
    """
    place = _places(row, turn)
    key = entry & ((1 << SIZE_AT) - 1)
    order = np.lexsort((place, key))
    row, key, place, size = row[order], key[order], place[order], entry[order] >> SIZE_AT
    start = np.flatnonzero(np.diff(key, prepend=-1))  # a fingerprint's rows, the first one in order ahead
    n, count = len(start), np.diff(np.append(start, len(key)))
    of = np.repeat(np.arange(n), count)
    node = np.arange(len(row)) if root is None else root[order]
    ranking = np.argsort(place[start])
    rank = np.empty_like(ranking)
    rank[ranking] = np.arange(n)

    least, most = np.minimum.reduceat(node, start), np.maximum.reduceat(node, start)
    crowd = np.flatnonzero(count > FEW if root is None else least < most)
    near, star = [], [crowd * (n + 1)]
    for who, group in shared_variants((key[start] & ((1 << low) - 1)).view(np.uint64), key[start] >> BUDGET_AT, low):
        first = np.flatnonzero(np.diff(group, prepend=-1))
        if root is None:
            crowded = np.add.reduceat(count[who], first) > FEW
            for d in range(1, FEW):
                meets = (group[d:] == group[:-d]) & ~crowded[group[d:]]
                if not meets.any():
                    break
                near.append(np.unique(who[:-d][meets] * n + who[d:][meets]))
        else:
            crowded = np.minimum.reduceat(least[who], first) < np.maximum.reduceat(most[who], first)
        if crowded.any():
            centre = np.repeat(ranking[np.minimum.reduceat(rank[who], first)], np.diff(np.append(first, len(who))))
            star.append(np.unique(who[crowded[group]] * n + centre[crowded[group]]))
    near = np.unique(np.concatenate(near)) if near else np.zeros(0, np.int64)
    i, j = near // n, near % n
    meets = count - 1 + np.bincount(i, count[j], n).astype(np.int64) + np.bincount(j, count[i], n).astype(np.int64)
    many = meets > FEW if root is None else np.zeros(n, dtype=bool)
    parted = many[i] | many[j]
    star = np.unique(np.concatenate([*star, near[parted], (j * n + i)[parted], np.flatnonzero(many) * (n + 1)]))
    i, j = i[~parted], j[~parted]

    def crossed(i: np.ndarray, j: np.ndarray, of_j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All rows of fingerprints i with the first ``of_j`` rows of j, where the sizes allow that they are similar."""
        both = count[i] * of_j
        at = np.arange(both.sum()) - np.repeat(np.cumsum(both) - both, both)
        of_j = np.repeat(of_j, both)
        a, b = np.repeat(start[i], both) + at // of_j, np.repeat(start[j], both) + at % of_j
        fit = (node[a] != node[b]) & (LEAST[1] * np.minimum(size[a], size[b]) >= LEAST[0] * np.maximum(size[a], size[b]))
        return a[fit], b[fit]

    own = np.flatnonzero((count > 1) & ~many & (root is None) & (count <= FEW))
    pairs = [crossed(i, j, count[j]), crossed(own, own, count[own])]
    a, b = (row[np.concatenate(x)] for x in zip(*pairs, strict=True))
    who, centre = crossed(star // n, star % n, np.ones(len(star), dtype=np.int64))
    by = np.lexsort((place[centre], who))
    by = by[np.diff(who[by], prepend=-1) != 0]  # each one's first centre
    met = np.full(len(row), -1)
    met[who[by]] = centre[by]
    crowd = np.flatnonzero(np.isin(of, star // n))
    met = met[crowd]
    return (np.minimum(a, b), np.maximum(a, b)), (row[crowd], row[met], np.where(met < 0, NOWHERE, place[met]))


def meetings(rows: DataFrame, bits: int, turn: int = 0) -> DataFrame:
    """Pairs (a < b) of rows of (_row, size, fps and, later, root) to test, and the rows a of a crowd, where b is null.

    A row of a crowd is in one pair of its own a table, however many it meets.
    """
    low, rooted = BITS - bits, "root" in rows.columns
    patterns = {w: np.setdiff1d(masks(bits, w), masks(bits, w - 1) if w else np.zeros(0, np.uint64)) for w in range(HALF + 1)}
    names = ["bucket", "_row", *(["root"] if rooted else []), "entry"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(at, 500) for at in range(0, whole.num_rows, 500)):
                fps = batch.column("fps").flatten().to_numpy().view(np.uint64).reshape(-1, TABLES)
                size = np.minimum(batch.column("size").to_numpy(), MOST_SIZE) << SIZE_AT
                kept = (fps & np.uint64((1 << low) - 1)).view(np.int64) | size[:, None]
                prefix = (fps >> np.uint64(low)) | (np.arange(TABLES, dtype=np.uint64) << np.uint64(bits))
                for w, m in patterns.items():
                    bucket = (prefix[:, :, None] ^ m).ravel().astype(np.int32)
                    each = [np.repeat(batch.column(c).to_numpy(), TABLES * len(m)) for c in names[1:-1]]
                    entry = np.repeat((kept | (HALF - w << BUDGET_AT)).ravel(), len(m))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (bucket, *each, entry)], names=names)

    def meet(table: pa.Table) -> pa.Table:
        root = table.column("root").to_numpy() if rooted else None
        (a, b), (who, centre, place) = _met(table.column("_row").to_numpy(), root, table.column("entry").to_numpy(), low, turn)
        own = np.full(len(who), -1 - (table.column("bucket")[0].as_py() >> bits)) if len(who) else who
        columns = (np.concatenate(x) for x in ((a, who), (b, own), (b, centre), (np.zeros(len(a), np.int64), place)))
        return pa.table(dict(zip(("a", "slot", "b", "place"), columns, strict=True)))

    kinds = "bucket int, _row long, root long, entry long" if rooted else "bucket int, _row long, entry long"
    dealt = rows.select("_row", "size", "fps", *(["root"] if rooted else [])).mapInArrow(deal, kinds)
    met = dealt.groupBy("bucket").applyInArrow(meet, "a long, slot long, b long, place long")
    met = met.groupBy("a", "slot").agg(F.min_by("b", "place").alias("b"), F.min("place").alias("place"))
    pair = F.struct(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    alone = F.struct(F.col("a"), F.lit(None).cast("long").alias("b"))
    pairs = F.when(F.col("slot") >= 0, F.array(pair)).when(F.col("place") == NOWHERE, F.array(alone)).otherwise(F.array(pair, alone))
    return met.select(F.inline(pairs)).distinct()


def prefix_pairs(rest: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of rows of ``rest`` (_row, size, root) with unlike roots, among them every similar pair.

    Sets are ordered by how many rows hold a shingle, rarest first. Similar sets have
    their first common shingle near the start of both, with enough left behind it in
    both, so a passage that many unlike rows share brings none of them together.
    A shingle's largest component is met only with the shingle's other rows. Of these
    pairs only those are given whose bitmaps differ in no more bits than similar sets
    of their sizes differ in shingles.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, shingles in enumerate(batch.column("shingles")):
                values = np.frombuffer(shingles.as_buffer(), dtype="<i8")
                for i in range(0, len(values), BLOCK):
                    part = pa.array(values[i : i + BLOCK], pa.int64())
                    same = [pa.repeat(batch.column(k)[at], len(part)) for k in ("_row", "size", "root")]
                    yield pa.RecordBatch.from_arrays([*same, part], names=["_row", "size", "root", "shingle"])

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = [bitmap_of(np.frombuffer(x.as_buffer(), dtype="<u8")) for x in batch.column("shingles")]
            columns = np.array(maps, dtype=np.int64).reshape(-1, MAP_LONGS).T
            yield pa.RecordBatch.from_arrays([batch.column("_row"), *(pa.array(c) for c in columns)], names=["_row", *bits])

    bits = [f"map{i}" for i in range(MAP_LONGS)]
    held = rest.join(sets, "_row").select("_row", "size", "root", "shingles")
    maps = held.select("_row", "shingles").mapInArrow(drawn, ", ".join(["_row long", *(f"{c} long" for c in bits)]))
    entries = written(held.mapInArrow(cut, "_row long, size long, root long, shingle long"), "entries")
    counted = entries.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("shingle")
    common = counted.agg(F.sum("n").alias("n"), F.max_by("root", "n").alias("major"), F.count(F.lit(1)).alias("roots")).filter("n > 1")
    placed = entries.join(common, "shingle", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    placed = placed.withColumn("at", F.row_number().over(Window.partitionBy("_row").orderBy("n", "shingle")) - 1)
    t, u = LEAST
    before = F.expr(f"size - ceil({t} * size / {u})")
    placed = placed.filter((F.col("at") <= before) & (F.col("roots") > 1)).select("shingle", "_row", "size", "root", "at", "major")
    placed = written(placed.join(maps, "_row"), "prefixes")
    left = placed.filter(F.expr(f"at <= size - ceil({2 * t} * size / {t + u})"))
    right = placed.select("shingle", *(F.col(c).alias(f"_{c}") for c in ("_row", "size", "root", "at", "major", *bits)))
    enough = F.least(F.col("size") - F.col("at"), F.col("_size") - F.col("_at")) * (t + u) >= (F.col("size") + F.col("_size")) * t
    order = (F.col("size") < F.col("_size")) | ((F.col("size") == F.col("_size")) & (F.col("_row") < F.col("__row")))
    unlike = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"_{c}"))) for c in bits), F.lit(0))
    close = unlike * (t + u) <= (F.col("size") + F.col("_size")) * (u - t)
    meets = order & enough & (F.col("root") != F.col("_root")) & _near(F.col("size"), F.col("_size")) & close
    found = left.join(right.filter("_root != _major"), "shingle").filter(meets).select("_row", "__row")
    found = found.union(left.filter("root != major").join(right.filter("_root = _major"), "shingle").filter(meets).select("_row", "__row"))
    return found.select(F.least("_row", "__row").alias("a"), F.greatest("_row", "__row").alias("b")).distinct()


def _rooted(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` with the root of each one's component."""
    root = components(links)
    return rows.select("_row", "size", "fps").join(root, F.col("_row") == F.col("node"), "left").select("_row", "size", "fps", F.coalesce("root", "_row").alias("root"))


def surplus_rows(rows: DataFrame) -> DataFrame:
    """_row of every row of (doc_id, _row, text) that another row of its component stands for.

    ``_row`` is a distinct long that does not change when ``rows`` is read again.
    """
    sketched = written(sketches(rows), "sketches")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_row")
    classes = written(sketched.groupBy("digest").agg(F.min(first).alias("least")).select("least", F.col("least._row").alias("_row")), "classes")
    nodes = sketched.filter(F.size("fps") > 0).join(classes.select("_row"), "_row", "left_semi").select("_row", "size", "fps")
    bits = prefix_bits(classes.count())
    met = written(meetings(nodes, bits), "met")
    crowded = met.filter("b is null").select(F.col("a").alias("_row"))
    tested = met.filter("b is not null")
    involved = tested.select(F.col("a").alias("_row")).union(tested.select("b")).union(crowded).distinct()
    sets = written(shingle_sets(rows.join(involved, "_row", "left_semi")), "shingles")
    links = written(similar_pairs(tested, sets), "links")

    rest = written(_rooted(nodes.join(crowded, "_row", "left_semi"), links), "members")
    before, turn = None, 0
    while left := rest.agg(F.count_distinct("root")).first()[0]:
        if before and STALLED[1] * left > STALLED[0] * before:
            found = prefix_pairs(rest.select("_row", "size", "root"), sets)
            pairs = written(found.join(tested, ["a", "b"], "left_anti"), "pairs")
            links = links.unionByName(written(similar_pairs(pairs, sets), "links"))
            break
        before, turn = left, turn + 1
        met = written(meetings(rest, bits, turn), "met")
        pairs = written(met.filter("b is not null").join(tested, ["a", "b"], "left_anti"), "pairs")
        tested = tested.unionByName(pairs)
        links = links.unionByName(written(similar_pairs(pairs, sets), "links"))
        rest = written(_rooted(rest.join(met.filter("b is null").select(F.col("a").alias("_row")), "_row", "left_semi"), links), "members")

    rooted = components(links)
    owned = classes.join(rooted, F.col("_row") == F.col("node"), "left").select("least", F.coalesce("root", "_row").alias("root"))
    kept = owned.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least._row").alias("_row"))
    return sketched.select("_row").join(kept, "_row", "left_anti")
