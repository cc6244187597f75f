"""Benchmark decontamination by latent semantic retrieval.

1. Texts become word hashes, once. Passages of ``PASSAGE`` words are unit TF-IDF
   vectors over hashed words. Word statistics come from all documents.
2. A randomised SVD of the passage matrix A finds the latent space: Z = A'(A R)
   with a random R, an orthonormal basis Q of Z, one power step Z = A'(A Q), and
   the eigenvectors of Q'Z. Both products are summed up by Spark; only the
   BUCKETS x RANK results come to the driver.
3. Segments of the benchmark items and sliding windows of the documents are
   folded into that space (scaled by the inverse singular values) and compared
   by cosine; every pair above ``least_cosine`` is a candidate. A window's vector
   is the difference of two running sums.
4. A candidate's surroundings are compared with the whole item by the longest
   common subsequence of words. A document leaks an item if the subsequence
   covers ``least_lcs`` of the item, or, for a paraphrase, ``paraphrase_lcs`` of it
   and the item's answer is there too: its last sentence, or of an item of one
   sentence the last third of its words. Surroundings that hold too few benchmark
   words for any such subsequence are passed over, which loses nothing.

Documents are never shuffled: candidates are checked where the text is. The
distinct item texts are broadcast in slices of some ``SLICE_ITEMS``, one pass over
the documents for each slice.

Cases: null or empty texts and items match nothing. Items shorter than a window
are compared with shorter windows. Repeated documents are reported once each;
repeated items under each item id, null ids included. Equal scores keep the first
place in the text. An empty table on either side gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh32_intdigest

from tessera.llm._shared import written
from tessera.llm.toxicity import words_of

BUCKETS, RANK, PASSAGE = 8192, 32, 16
SLICE_ITEMS = 5000
BATCH_WORDS = 1 << 16
ROWS_A_BLOCK = 512
#: A candidate's begin is taken as a cell of so many words; its surroundings cover the whole cell.
ALIGNED = 4
#: Window lengths, each begun every half of it; an item is cut into segments of the longest that any copy of the item holds whole.
WINDOWS = (16, 8, 4, 2, 1)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh32_intdigest, words), dtype=np.uint32, count=len(words))


def tokenised(docs: DataFrame, text: str, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` columns and ``_words``, the 32-bit hashes of the words; written, since several passes read it."""
    source = docs.select(*keep, F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])

    def hash_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [word_hashes(words_of(t)).tobytes() for t in batch.column("_text").to_pylist()]
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.binary())], names=[*keep, "_words"])

    return written(source.mapInArrow(hash_words, f"{schema}, _words binary"), "words")


def _joined(held: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word hashes of several texts at a time, and where each text begins and ends among them."""
    at, size = 0, 0
    for i, words in enumerate(held):
        size += len(words) // 4
        if size >= BATCH_WORDS or i + 1 == len(held):
            part = held[at : i + 1]
            yield np.frombuffer(b"".join(part), dtype=np.uint32), np.concatenate((np.zeros(1, np.int64), np.cumsum([len(w) // 4 for w in part])))
            at, size = i + 1, 0


def _buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint32(BUCKETS - 1)).astype(np.int32)  # BUCKETS is a power of two


def inverse_frequencies(words: DataFrame) -> np.ndarray:
    """The inverse document frequency of every bucket, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(BUCKETS, dtype=np.int64), 0
        for batch in batches:
            for hashes, bounds in _joined(batch.column(0).to_pylist()):
                for first in range(0, len(bounds) - 1, 1000):  # rows of flags for at most 1000 documents
                    part = bounds[first : first + 1001]
                    seen = np.zeros((len(part) - 1, BUCKETS), dtype=bool)
                    seen[np.repeat(np.arange(len(part) - 1), np.diff(part)), _buckets(hashes[part[0] : part[-1]])] = True
                    df += seen.sum(axis=0)
                n += len(bounds) - 1
        yield pa.RecordBatch.from_pydict({"bucket": np.arange(-1, BUCKETS), "df": np.concatenate(([n], df))})

    rows = words.select("_words").mapInArrow(count, "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df")).collect()
    df = np.zeros(BUCKETS + 1)
    for bucket, n in rows:  # BUCKETS + 1 rows
        df[bucket + 1] = n
    return np.log((df[0] + 1.0) / (df[1:] + 1.0)) + 0.05


def _passages(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of distinct buckets a passage, filled up with BUCKETS; no passage spans two texts."""
    sizes = np.diff(bounds)
    rows = -(-sizes // PASSAGE)
    before = np.cumsum(rows) - rows
    place = np.arange(len(hashes)) + np.repeat(before * PASSAGE - bounds[:-1], sizes)
    out = np.full(int(rows.sum()) * PASSAGE, BUCKETS, dtype=np.uint16)
    out[place] = _buckets(hashes)
    out = np.sort(out.reshape(-1, PASSAGE), axis=1)
    out[:, 1:][out[:, 1:] == out[:, :-1]] = BUCKETS
    return out


def _gram_times(words: DataFrame, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """A'(A basis) over the unit TF-IDF vectors of all passages, summed in two levels."""
    held = words.sparkSession.sparkContext.broadcast((idf, basis))  # BUCKETS x RANK floats

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, basis = held.value
        scaled = np.vstack((basis * idf[:, None], np.zeros((1, basis.shape[1])))).astype(np.float32)
        squares = np.append(idf * idf, 0.0)
        total = np.zeros((BUCKETS, basis.shape[1]))
        for batch in batches:
            for hashes, bounds in _joined(batch.column(0).to_pylist()):
                if not len(hashes):
                    continue
                at = _passages(hashes, bounds)
                y = scaled[at].sum(axis=1) / np.maximum(squares[at].sum(axis=1), 1e-12)[:, None]
                flat, y = at.ravel(), np.ascontiguousarray(y.T)
                for j in range(len(y)):
                    total[:, j] += np.bincount(flat, weights=np.repeat(y[j], PASSAGE), minlength=BUCKETS + 1)[:BUCKETS]
        total *= idf[:, None]
        part = TaskContext.get().partitionId()
        for k in range(0, BUCKETS, ROWS_A_BLOCK):
            yield pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int32()), "part": pa.array([part], pa.int32()), "sums": pa.array([total[k : k + ROWS_A_BLOCK].tobytes()], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        sums = sum(np.frombuffer(x, dtype=np.float64) for x in table.column("sums").to_pylist())
        return pa.table({"block": table.column("block")[:1], "part": table.column("part")[:1], "sums": pa.array([sums.tobytes()], pa.binary())})

    schema = "block int, part int, sums binary"
    parts = words.select("_words").mapInArrow(multiply, schema)
    some = parts.withColumn("part", F.col("part") % 64).groupBy("block", "part").applyInArrow(add, schema)
    rows = some.groupBy("block").applyInArrow(add, schema).collect()
    out = np.zeros((BUCKETS, basis.shape[1]))
    for block, _, sums in rows:  # BUCKETS / ROWS_A_BLOCK rows
        out[block : block + ROWS_A_BLOCK] = np.frombuffer(sums, dtype=np.float64).reshape(-1, basis.shape[1])
    return out


@dataclass(frozen=True)
class LatentSpace:
    """``fold[bucket]`` is what a word adds to a latent vector, ``idf`` its weight; the last row stands for no word."""

    fold: np.ndarray
    idf: np.ndarray

    def vectors(self, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Unit vectors of the words from each start to its end."""
        sums = np.zeros((len(hashes) + 1, self.fold.shape[1]))
        np.cumsum(self.fold[_buckets(hashes)], axis=0, dtype=np.float64, out=sums[1:])
        return _unit(sums[ends] - sums[starts])

    def windows(self, hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sliding windows of each text: text, first word within it, unit vector.

        Windows begin every ``step`` words and share the sums of as many words; the
        last one of a text ends with it.
        """
        step = max(1, width // 2)
        sizes = np.diff(bounds)
        blocks = -(-sizes // step)
        before = np.cumsum(blocks) - blocks
        padded = np.full(int(blocks.sum()) * step, BUCKETS, dtype=np.int32)
        padded[np.arange(len(hashes)) + np.repeat(before * step - bounds[:-1], sizes)] = _buckets(hashes)
        sums = self.fold[padded[::step]]
        for k in range(1, step):
            sums += self.fold[padded[k::step]]
        some = np.flatnonzero(blocks)
        count = np.maximum(0, blocks[some] - width // step) + 1
        text = np.repeat(some, count)
        place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        at, end = before[text] + place, before[text] + blocks[text]
        sums = np.vstack((sums, np.zeros((1, sums.shape[1]), np.float32)))
        total = sums[at]
        for k in range(1, width // step):
            total += sums[np.where(at + k < end, at + k, len(sums) - 1)]
        return text, place * step, _unit(total)


def fit_latent_space(words: DataFrame, rank: int = RANK, seed: int = 7) -> LatentSpace:
    """Randomised SVD of the passages of all documents, whose word hashes are in ``_words``."""
    idf = inverse_frequencies(words)
    start = np.random.default_rng(seed).standard_normal((BUCKETS, rank))
    q, _ = np.linalg.qr(_gram_times(words, idf, start))
    z = _gram_times(words, idf, q)
    values, rotation = np.linalg.eigh((q.T @ z + z.T @ q) / 2)
    singular = np.sqrt(np.maximum(values, 0.0))
    used = singular > 1e-6 * max(float(singular.max()), 1e-12)
    scale = np.where(used, 1.0 / np.where(used, singular, 1.0), 0.0)
    fold = (q @ rotation) * scale * idf[:, None]
    return LatentSpace(np.vstack((fold, np.zeros((1, rank)))).astype(np.float32), np.append(idf, 0.0))


def places_of(words: list[int]) -> dict[int, int]:
    """Each word's places as the bits of a number."""
    places: dict[int, int] = {}
    for i, x in enumerate(words):
        places[x] = places.get(x, 0) | 1 << i
    return places


def lcs_length(a: list[int], b: list[int], places: dict[int, int] | None = None) -> int:
    """Length of the longest common subsequence, by bit-parallel dynamic programming."""
    places = places or places_of(a)
    full = (1 << len(a)) - 1
    row = full
    for at in filter(None, map(places.get, b)):
        u = row & at
        row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def answer_of(text: str) -> list[bytes]:
    """The words of an item's last sentence; of a single sentence the last third, three words at least."""
    parts = [w for w in map(words_of, re.split(r"(?<=[.!?])\s+", text)) if w]
    if len(parts) == 1:
        return parts[0][-max(3, -(-len(parts[0]) // 3)) :]
    return parts[-1] if parts else []


@dataclass(frozen=True)
class Items:
    """Benchmark items as word hashes, their segments in the latent space by window length, and their vocabulary."""

    texts: list[str]
    words: list[list[int]]
    places: list[dict[int, int]]
    answers: list[list[int]]
    segments: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # vectors, item, offset
    vocabulary: np.ndarray  # the distinct words
    held_by: np.ndarray  # items that hold each word of the vocabulary, word by word
    bounds: np.ndarray  # where each word's items begin in ``held_by``

    def enough(self, hashes: np.ndarray, item: np.ndarray, first: np.ndarray, last: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Which rows have at least ``least`` words of their item from ``first`` to ``last``.

        Rows with too few words of any item go first; the others' words are then
        counted item by item.
        """
        if not len(self.vocabulary) or not len(hashes):
            return np.zeros(0, dtype=np.int64)
        low = np.zeros(1 << 16, dtype=bool)  # most words end in 16 bits that no known word has, and need no search
        low[self.vocabulary & np.uint32(0xFFFF)] = True
        maybe = np.flatnonzero(low[hashes & np.uint32(0xFFFF)])
        word = np.zeros(len(hashes), dtype=np.int64)
        word[maybe] = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), len(self.vocabulary) - 1)
        known = self.vocabulary[word] == hashes
        running = np.concatenate((np.zeros(1, np.int64), np.cumsum(known)))
        row = np.flatnonzero(running[last] - running[first] >= least)
        item, first, last = item[row], first[row], last[row]
        edge = np.bincount(first, minlength=len(hashes) + 1) - np.bincount(last, minlength=len(hashes) + 1)
        at = np.flatnonzero(known & (np.cumsum(edge[:-1]) > 0))
        word = word[at]
        kind = np.int32 if len(self.words) * (len(hashes) + 1) < 1 << 31 and len(self.held_by) < 1 << 31 else np.int64
        bounds = self.bounds.astype(kind)
        count = np.diff(bounds)[word]
        ends = np.cumsum(count)
        entry = np.repeat(bounds[word] - (ends - count).astype(kind), count)
        entry += np.arange(len(entry), dtype=kind)
        held = self.held_by[entry]
        order = np.argsort(held, kind="stable")  # 16 bits, which SLICE_ITEMS fit; places are in order already
        key = held[order].astype(kind)
        key *= len(hashes)
        key += np.repeat(at.astype(kind), count)[order]
        base = item.astype(kind) * kind(len(hashes))
        found = np.searchsorted(key, base + last.astype(kind)) - np.searchsorted(key, base + first.astype(kind))
        return row[found >= least[row]]


def prepare_items(texts: list[str], space: LatentSpace) -> Items:
    held = [(t, word_hashes(words_of(t))) for t in texts]
    held = [(t, h) for t, h in held if len(h)]
    found: dict[int, tuple[list, list, list]] = {}
    for k, (_, h) in enumerate(held):
        width = next(w for w in WINDOWS if w + w // 2 - 1 <= len(h))
        starts = np.array(sorted({*range(0, len(h) - width + 1, max(1, width // 2)), len(h) - width}))
        vectors, item, offset = found.setdefault(width, ([], [], []))
        vectors.append(space.vectors(h, starts, starts + width))
        item += [k] * len(starts)
        offset += starts.tolist()
    segments = {w: (np.concatenate(v).astype(np.float32), np.array(i), np.array(o)) for w, (v, i, o) in found.items()}
    answers = [word_hashes(answer_of(t)).tolist() for t, _ in held]
    pairs = np.array(sorted({(w, k) for k, (_, h) in enumerate(held) for w in h.tolist()}), dtype=np.int64).reshape(-1, 2)
    vocabulary, starts = np.unique(pairs[:, 0], return_index=True)
    return Items([t for t, _ in held], [h.tolist() for _, h in held], [places_of(h.tolist()) for _, h in held], answers, segments, vocabulary.astype(np.uint32), pairs[:, 1].astype(np.uint16), np.append(starts, len(pairs)))


def _places(flags: np.ndarray) -> np.ndarray:
    """Where the few set flags are; eight are looked at together."""
    n = len(flags) // 8 * 8
    some = np.flatnonzero(flags[:n].view(np.uint64))
    row, column = np.nonzero(flags[:n].reshape(-1, 8)[some])
    return np.concatenate((some[row] * 8 + column, n + np.flatnonzero(flags[n:])))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


@dataclass(frozen=True)
class Limits:
    """What counts as a candidate and as a leak."""

    least_cosine: float = 0.65
    least_lcs: float = 0.8
    paraphrase_lcs: float = 0.55
    least_answer: float = 0.8


def candidates(hashes: np.ndarray, bounds: np.ndarray, items: Items, space: LatentSpace, limits: Limits) -> tuple[np.ndarray, ...]:
    """Text, item, cell and highest cosine of every candidate: the item may begin in that cell of ALIGNED words of the text."""
    found: list[tuple[np.ndarray, ...]] = []
    cells = int(np.diff(bounds).max(initial=0)) // ALIGNED + max(map(len, items.words), default=0)  # more than any text has, either way
    for width, (vectors, item, offset) in items.segments.items():
        text, first, unit = space.windows(hashes, bounds, width)
        for at in range(0, len(text), 256):
            cosine = (unit[at : at + 256] @ vectors.T).ravel()
            near = _places(cosine >= limits.least_cosine)
            w, g = np.divmod(near, len(vectors))
            w += at
            found.append(((text[w] * len(items.words) + item[g]) * (2 * cells) + (first[w] - offset[g]) // ALIGNED + cells, cosine[near]))
    key, cosine = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0))
    order = np.argsort(key)
    key, cosine = key[order], cosine[order]
    starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
    key, cosine = key[starts], np.maximum.reduceat(cosine, starts) if len(starts) else cosine
    pair, cell = np.divmod(key, 2 * cells)
    return *np.divmod(pair, max(1, len(items.words))), cell - cells, cosine


def leaks_among(hashes: np.ndarray, bounds: np.ndarray, items: Items, space: LatentSpace, limits: Limits) -> list[tuple[int, int, float, float, float, int]]:
    """(text, item, cosine, lcs share, answer share, first word) of each leak in the joined texts."""
    text, item, cell, cosine = candidates(hashes, bounds, items, space, limits)
    size = np.array([len(w) for w in items.words], dtype=np.int64)[item] if len(item) else item
    begin, slack = bounds[text] + ALIGNED * cell, 4 + size // 4
    first = np.maximum(bounds[text], begin - slack)
    last = np.maximum(first, np.minimum(bounds[text + 1], begin + ALIGNED + size + slack))
    # No subsequence is longer than the number of the item's words in the surroundings.
    least = limits.paraphrase_lcs * size
    enough = items.enough(hashes, item, first, last, least)
    best: dict[tuple[int, int], tuple[float, float, float, int]] = {}
    for doc, k, cos, a, b in zip(*(x[enough].tolist() for x in (text, item, cosine, first, last)), strict=True):
        words, region = items.words[k], hashes[a:b].tolist()
        share = lcs_length(words, region, items.places[k]) / len(words)
        if share < limits.paraphrase_lcs:
            continue
        answer = lcs_length(items.answers[k], region) / max(1, len(items.answers[k]))
        if share >= limits.least_lcs or (share >= limits.paraphrase_lcs and answer >= limits.least_answer):
            now = (share, cos, answer, -a)
            if now > best.get((doc, k), (-1.0, 0.0, 0.0, 0)):
                best[doc, k] = now
    return [(doc, k, c, share, answer, -a - int(bounds[doc])) for (doc, k), (share, c, answer, a) in sorted(best.items())]


def find_leaks(
    docs: DataFrame, items: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), item_id: str = "item_id", item_text: str = "text",
    limits: Limits = Limits(), space: LatentSpace | None = None,
) -> DataFrame:
    """``keep`` columns, item_id, cosine, lcs_share, answer_share and first_word of every leak."""
    source = tokenised(docs, text, keep)
    space = space or fit_latent_space(source)
    spark = docs.sparkSession
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    schema += ", _item string, cosine double, lcs_share double, answer_share double, first_word long"
    names = [*keep, "_item", "cosine", "lcs_share", "answer_share", "first_word"]
    wanted = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("_item")).dropna(subset=["_item"])
    distinct = wanted.select("_item").distinct()
    n_slices = max(1, -(-distinct.count() // SLICE_ITEMS))  # hashing deals them evenly, far from the 65536 that Items.enough can tell apart
    found = None
    for k in range(n_slices):
        part = distinct.filter(F.pmod(F.xxhash64("_item"), F.lit(n_slices)) == k)  # some SLICE_ITEMS rows
        held = spark.sparkContext.broadcast((space, prepare_items(sorted(r[0] for r in part.collect()), space)))

        def search(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            space, prepared = held.value
            for batch in batches:
                row, rest, first = [], [], 0
                for hashes, bounds in _joined(batch.column("_words").to_pylist()):
                    for doc, item, *values in leaks_among(hashes, bounds, prepared, space, limits):
                        row.append(first + doc)
                        rest.append((prepared.texts[item], *values))
                    first += len(bounds) - 1
                columns = [batch.column(i).take(pa.array(row, pa.int64())) for i in range(batch.num_columns - 1)]
                kinds = (pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
                columns += [pa.array([r[i] for r in rest], t) for i, t in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

        leaked = source.mapInArrow(search, schema)
        if n_slices > 1:  # one slice's broadcast at a time
            leaked = written(leaked, "leaks")
            held.unpersist()
        found = leaked if found is None else found.unionByName(leaked)
    return found.join(wanted, "_item").select(*keep, "item_id", *names[-4:])
