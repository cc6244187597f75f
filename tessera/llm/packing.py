"""Packing of tokenised documents into sequences by a grouping genetic algorithm.

Documents become pieces of at most ``capacity`` tokens; only longer documents
are cut. Pieces are dealt to blocks of some ``BLOCK_PIECES``, which are best-fitted
once. Where that takes more bins than the total length needs, several islands
evolve packings of the block, from best-fit packings on, until one has as few
bins or the generations are used up. A packing is a set of bins. Crossover injects whole well-filled bins of one parent into the
other and removes the bins that hold a piece twice; mutation empties the worst
bins and some others. The displaced pieces are first exchanged for one or two
pieces of a bin that they fill better, then best-fitted, longest first. Fewer
bins win, then the larger sum of squared fills. After each epoch every island's
elite migrates to the next island of its block. At the end each block keeps its
best packing. Its worst-filled bins are opened again and packed together with
those of neighbouring blocks, and so on up a tree; a group passes on no more
than its share of a block, so no group grows with the input.

Only piece lengths travel in the shuffles, and a group never holds more than the
pieces of one block for all islands. Rows are dealt by a row number that is
written with the pieces, so no value of any column can fill a block and a task
that runs again deals as before.

Cases: a null text is an empty document: one piece holding the closing id alone.
Repeated rows are separate documents. Extra columns in ``keep`` pass through;
``_row`` is the only name they may not have. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import codecs
import functools
import itertools
import random
import re
import zlib
from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import written

if TYPE_CHECKING:
    from tokenizers import Tokenizer

CAPACITY = 2048
END_ID = 0
BLOCK_PIECES, JOINED_BLOCKS = 4000, 8
ISLANDS, EPOCHS, POPULATION, GENERATIONS = 3, 2, 5, 24
#: Bins filled less than this may be opened and packed again across blocks.
WELL_FILLED = 0.998
#: Bins with the most room that an exchange looks at.
LOOSE_BINS = 60
#: Bins that a crossover injects at most.
INJECTED = 30
#: Characters that end a word for str.split() but not for the tokenizer.
_ODD_SPACE = frozenset("\x1c\x1d\x1e\x1f")
#: The tokenizer's own pre-tokens (fixed values) where all characters are Latin-1 and in lower case.
_LETTER, _NUMERAL = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
_SYMBOL = r"\x00-\x08\x0e-\x1f!-/:-@\[-`{-\x84\x86-\x9f\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf\xd7\xf7"
_PRE_TOKEN = re.compile(f"[{_LETTER}]+|[{_NUMERAL}]|'(?:s|t|re|ve|m|ll|d)|[{_SYMBOL}]+")
#: Of each Latin-1 character: L is a letter, N a numeral, which is a pre-token alone, S a symbol, W white space; Q where only the pattern will do.
_KINDS = bytes(
    ord("Q" if c in _ODD_SPACE or c == "'" else next((k for k, of in (("L", _LETTER), ("N", _NUMERAL), ("S", _SYMBOL)) if re.match(f"[{of}]", c.lower())), "W"))
    for c in map(chr, range(256))
)
_NOT_ALONE = bytes(i for i in range(256) if _KINDS[i] not in b"NS")
#: The tokenizer's own letter of each byte (fixed values): printable ones are themselves, the others follow from 256 on; a space stays.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_OTHER = [b for b in range(256) if b not in _PLAIN]
_LETTER_OF = {**{b: chr(b) for b in _PLAIN}, **{b: chr(256 + i) for i, b in enumerate(_OTHER)}, 32: " "}
_LETTERS = "".join(_LETTER_OF[b] for b in range(256))
#: Words in each of the two generations of a Python worker's store, some 150 bytes each.
MOST_STORED = 250_000
#: Characters of text whose new words are encoded at once.
BATCH_CHARS = 1 << 18

Bins = list[list[int]]


class WordIds:
    """Ids, as little-endian 32-bit bytes, of strings free of white space.

    New words are encoded many at a time, as one text. Of a pre-token's ids the
    last, and no other, ends a word. When the younger generation is full it
    becomes the older one, and words met again move over, so frequent words stay.
    Latin-1 pre-tokens are in the tokenizer's normal form and need no second split,
    so ``plain``, which has its model alone, gets their bytes as its letters.
    """

    def __init__(self, path: str, most: int = MOST_STORED) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_word[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.most = most

    def encode(self, text: str) -> np.ndarray:
        return self._ids(self.tokenizer, text)

    @staticmethod
    def _ids(tokenizer: Tokenizer, text: str) -> np.ndarray:
        return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """Have the ids of all ``words`` in the younger generation; also in a dictionary of their own, which is small and so is faster to look up in."""
        held = dict(zip(words, map(self.young.get, words), strict=True))
        new = {w for w, ids in held.items() if ids is None}
        if len(self.young) + len(new) > self.most:
            self.old, self.young = self.young, {w: ids for w, ids in held.items() if ids is not None}
        found = {w: self.old[w] for w in new if w in self.old}  # a set's intersection would walk through all that is stored
        single = []
        for w in new.difference(found):
            if _PRE_TOKEN.fullmatch(w):
                single.append(w)
            else:
                found[w] = self.encode(w).tobytes()
        for at in range(0, len(single), 20_000):
            part = single[at : at + 20_000]
            ids = self._ids(self.plain, codecs.charmap_decode(" ".join(part).encode(), "strict", _LETTERS)[0])
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) != len(part):
                raise ValueError("the vocabulary does not mark word ends")
            joined, bounds = ids.tobytes(), [0, *(4 * ends).tolist()]
            found.update(zip(part, (joined[a:b] for a, b in itertools.pairwise(bounds)), strict=True))
        self.young.update(found)
        held.update(found)
        return held


@functools.cache
def _word_ids(path: str) -> WordIds:
    return WordIds(path)


def _words(text: str) -> list[str] | None:
    """Strings whose ids make up the ids of the text; None where the text must be encoded as a whole.

    The tokenizer lower-cases, drops white space, and no pre-token of it spans
    white space, so words will do. In Latin-1 text, where lower-casing depends on
    no context and nothing composes, they are the pre-tokens themselves, of which
    there are far fewer.
    """
    if "<|" in text:  # the vocabulary's special tokens begin so
        return None
    try:
        plain = text.encode("latin-1")
    except UnicodeEncodeError:
        return text.split() if _ODD_SPACE.isdisjoint(text) else None
    kinds, lower = plain.translate(_KINDS), text.lower()
    if b"Q" in kinds or b"SS" in kinds:
        return _PRE_TOKEN.findall(lower)
    for c in map(chr, set(plain.translate(None, _NOT_ALONE))):  # white space sets off what stands alone
        lower = lower.replace(c, f" {c} ")
    return lower.split()


def token_bytes(texts: list[str | None], path: str) -> Iterator[bytes]:
    """The ids of each text and END_ID, as little-endian 32-bit bytes."""
    store, end = _word_ids(path), END_ID.to_bytes(4, "little")
    at, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size < BATCH_CHARS and i + 1 < len(texts):
            continue
        part = texts[at : i + 1]
        split = [_words(t) if t else [] for t in part]
        held = store.learn(set().union(*(ws for ws in split if ws)))
        for t, ws in zip(part, split, strict=True):
            yield (store.encode(t).tobytes() if ws is None else b"".join(map(held.__getitem__, ws))) + end
        at, size = i + 1, 0


def pieces_of(docs: DataFrame, tokenizer_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row a piece: ``keep``, piece, start, length, ids_crc32 and, if asked for, the ``ids``."""
    source = docs.select(*keep, F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, held in enumerate(token_bytes(batch.column("_text").to_pylist(), tokenizer_path)):
                for k, at in enumerate(range(0, len(held), 4 * capacity)):
                    part = held[at : at + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, dtype="<u4").astype(np.int32))
            columns = [batch.column(i).take(pa.array(row, pa.int32())) for i in range(batch.num_columns - 1)]
            columns += [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = [*keep, "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    more = ", ids array<int>" if with_ids else ""
    return source.mapInArrow(cut, f"{schema}, piece int, start long, length long, ids_crc32 long{more}")


class Packer:
    """Genetic operators over the pieces of one group; bins hold piece numbers."""

    def __init__(self, lengths: list[int], capacity: int, seed: int) -> None:
        self.lengths, self.capacity, self.rng = lengths, capacity, random.Random(seed)

    def fill(self, bin_: list[int]) -> int:
        return sum(self.lengths[i] for i in bin_)

    def best_fit(self, bins: Bins, pieces: list[int]) -> Bins:
        """Put each piece, in the given order, in the fullest bin that has room for it."""
        room = sorted((self.capacity - self.fill(b), k) for k, b in enumerate(bins))
        for i in pieces:
            at = bisect.bisect_left(room, (self.lengths[i], -1))
            if at == len(room):
                left, k = self.capacity, len(bins)
                bins.append([])
            else:
                left, k = room.pop(at)
            bins[k].append(i)
            bisect.insort(room, (left - self.lengths[i], k))
        return bins

    def longest_first(self, pieces: list[int], noise: float = 0.0) -> list[int]:
        return sorted(pieces, key=lambda i: (-self.lengths[i] * (1 + noise * self.rng.random()), i))

    def least(self) -> int:
        """Bins that the total length needs; no packing has fewer."""
        return -(-sum(self.lengths) // self.capacity)

    def fitness(self, bins: Bins) -> tuple[int, int]:
        return -len(bins), sum(self.fill(b) ** 2 for b in bins)

    def exchange(self, bins: Bins, free: list[int]) -> list[int]:
        """Put free pieces in place of one or two pieces of a bin where that fills it better; what is free then.

        A bin takes the one or two free pieces that fill it most. Each exchange
        lengthens the bins and shortens what is free, so this ends.
        """
        lengths = self.lengths
        free = sorted(free, key=lengths.__getitem__)
        for b in bins:
            room = self.capacity - self.fill(b)
            if not room or not free or lengths[free[0]] > room + max(map(lengths.__getitem__, b), default=0) * 2:
                continue
            size = [lengths[i] for i in free]
            best = (0, (), ())
            for out in ((), *((i,) for i in b), *itertools.combinations(b[:6], 2)):
                less = sum(lengths[i] for i in out)
                at = bisect.bisect_right(size, less + room) - 1
                if at >= 0 and size[at] - less > best[0]:
                    best = (size[at] - less, out, (at,))
                low, high = 0, at
                while low < high and best[0] < room:
                    both = size[low] + size[high]
                    if both > less + room:
                        high -= 1
                    else:
                        if both - less > best[0]:
                            best = (both - less, out, (low, high))
                        low += 1
            if best[0]:
                put = [free[k] for k in best[2]]
                b[:] = [i for i in b if i not in best[1]] + put
                free = sorted([i for i in free if i not in put] + list(best[1]), key=lengths.__getitem__)
        return free

    def settle(self, bins: Bins, displaced: list[int], noise: float = 0.0) -> Bins:
        """All of ``bins`` and the displaced pieces: exchanged while that helps the bins with some room, then best-fitted."""
        loose = sorted((b for b in bins if self.fill(b) < self.capacity), key=self.fill)[:LOOSE_BINS]
        self.rng.shuffle(loose)
        return self.best_fit(bins, self.longest_first(self.exchange(loose, displaced), noise))

    def crossover(self, base: Bins, donor: Bins) -> Bins:
        """``base`` with some of the well-filled bins of ``donor``, which it lacks, injected whole."""
        own = {frozenset(b) for b in base}
        good = [b for b in donor if self.fill(b) >= WELL_FILLED * self.capacity and frozenset(b) not in own]
        injected = self.rng.sample(good, max(1, min(INJECTED, len(good) // 3))) if good else []
        taken = {i for b in injected for i in b}
        kept, displaced = [], []
        for b in base:
            if taken.isdisjoint(b):
                kept.append(list(b))
            else:
                displaced += [i for i in b if i not in taken]
        return self.settle([*kept, *map(list, injected)], displaced)

    def mutate(self, bins: Bins) -> Bins:
        by_fill = sorted(bins, key=self.fill)
        n = min(len(bins), self.rng.randint(2, 6))
        opened = by_fill[:n] + self.rng.sample(by_fill[n:], min(len(bins) - n, n))
        chosen = {id(b) for b in opened}
        kept = [list(b) for b in bins if id(b) not in chosen]
        return self.settle(kept, [i for b in opened for i in b], noise=0.1)

    def evolve(self, population: list[Bins], generations: int = GENERATIONS, size: int = POPULATION) -> Bins:
        """The best packing after some generations, beginning with ``population`` and some greedy packings."""
        everything = list(range(len(self.lengths)))
        least, population = self.least(), list(population)
        while len(population) < size and not any(len(b) <= least for b in population):
            population.append(self.best_fit([], self.longest_first(everything, noise=0.3 * bool(population))))
        ranked = sorted(((self.fitness(b), -k, b) for k, b in enumerate(population)), key=lambda x: x[:2], reverse=True)
        for g in range(generations):
            if -ranked[0][0][0] <= least or len(ranked) < 2:  # no packing has fewer bins
                break
            a, b = self.rng.sample(ranked, 2)
            child = self.crossover(max(a, b)[2], min(a, b)[2]) if g % 2 else self.mutate(self.rng.choice(ranked[:2])[2])
            made = (self.fitness(child), -len(population) - g, child)
            if made[0] not in {r[0] for r in ranked}:  # an equal one would only crowd out what is different
                ranked[-1] = max(made, ranked[-1], key=lambda x: x[:2]) if g % 4 else made
                ranked.sort(key=lambda x: x[:2], reverse=True)
        return ranked[0][2]


def _grouped(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The places of each value of a column, values ascending."""
    values = column.to_numpy()
    order = np.argsort(values, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(values[order])) + 1) if len(order) else []


def _populations(table: pa.Table) -> tuple[np.ndarray, list[int], list[Bins]]:
    """Row numbers and lengths of a group's pieces, and the packings that came with it (one for each origin)."""
    rows, bins = table.column("_row").to_numpy(), table.column("_bin").to_numpy()
    unique, first, place = np.unique(rows, return_index=True, return_inverse=True)
    lengths = table.column("length").to_numpy()[first].tolist()
    found = []
    for of in _grouped(table.column("_origin")):
        if bins[of[0]] >= 0:
            order = of[np.argsort(bins[of], kind="stable")]
            found.append([place[x].tolist() for x in np.split(order, np.flatnonzero(np.diff(bins[order])) + 1)])
    return unique, lengths, found


def _flat(packing: Bins) -> tuple[np.ndarray, np.ndarray]:
    """Piece numbers and their bins."""
    return np.array([i for b in packing for i in b], dtype=np.int64), np.repeat(np.arange(len(packing)), [len(b) for b in packing])


def _offsets(lengths: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """Where each piece begins in its bin; pieces come bin by bin."""
    before = np.cumsum(lengths) - lengths
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    return before - np.repeat(before[first], np.diff(np.append(first, len(bins))))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to ``pieces``, which have a length of 1 to ``capacity``."""
    held = written(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    n_blocks = max(1, -(-held.count() // BLOCK_PIECES))
    rows = held.select("_row", "length", F.pmod(F.xxhash64("_row"), F.lit(n_blocks)).alias("_block"))
    group = "_block long, _island int, _origin int, _row long, length long, _bin long"

    def fitted(key: tuple, table: pa.Table) -> pa.Table:
        """A best-fit packing of a block, and whether it is done, as no packing has fewer bins."""
        ids, lengths = table.column("_row").to_numpy(), table.column("length").to_numpy()
        order = np.argsort(ids)
        ids, lengths = ids[order], lengths[order]
        packer = Packer(lengths.tolist(), capacity, 0)
        packing = packer.best_fit([], packer.longest_first(list(range(len(ids)))))
        at, bins = _flat(packing)
        done = np.full(len(at), len(packing) <= packer.least())
        return pa.table({"_block": np.full(len(at), key[0].as_py()), "_done": done, "_row": ids[at], "length": lengths[at], "_bin": bins.astype(np.int64)})

    def evolve(key: tuple, table: pa.Table) -> pa.Table:
        block, island = key[0].as_py(), key[1].as_py()
        ids, lengths, found = _populations(table)
        best = Packer(lengths, capacity, 1009 * block + island).evolve(found)
        at, bins = _flat(best)
        n = len(at)
        return pa.table({
            "_block": np.full(n, block), "_island": np.full(n, island, dtype=np.int32), "_origin": np.full(n, island, dtype=np.int32),
            "_row": ids[at], "length": np.array(lengths, dtype=np.int64)[at], "_bin": bins.astype(np.int64),
        })

    first = written(rows.groupBy("_block").applyInArrow(fitted, "_block long, _done boolean, _row long, length long, _bin long"), "fitted")
    state = first.filter("not _done").withColumn("_island", F.explode(F.array(*map(F.lit, range(ISLANDS))))).withColumn("_origin", F.col("_island"))
    for epoch in range(EPOCHS):
        if epoch:  # each elite goes to its own island and to the next one
            to = F.explode(F.array(F.col("_origin"), F.pmod(F.col("_origin") + 1, F.lit(ISLANDS))))
            state = state.withColumn("_island", to)
        state = state.select(*(c.split()[0] for c in group.split(", "))).groupBy("_block", "_island").applyInArrow(evolve, group)
    done = first.filter("_done").select("_block", F.lit(0).alias("_island"), F.lit(0).alias("_origin"), "_row", "length", "_bin")
    state = state.unionByName(done)

    placed = "_row long, length long, _group long, sequence_id long, offset long"

    def result(ids: np.ndarray, lengths: np.ndarray, packing: Bins, level: int, number: int, last: bool) -> pa.Table:
        """Places of pieces; those of the worst bins have no sequence, as they are packed again with those of other groups."""
        at, bins = _flat(packing)
        size = lengths[at]
        closed = np.ones(len(packing), dtype=bool)
        if not last:
            fills, counts = np.bincount(bins, weights=size), np.bincount(bins)
            worst = np.argsort(fills, kind="stable")
            passed = (fills[worst] < WELL_FILLED * capacity) & (np.cumsum(counts[worst]) <= BLOCK_PIECES // JOINED_BLOCKS)
            closed[worst[passed]] = False
        return pa.table({
            "_row": ids[at], "length": size, "_group": np.full(len(at), number // JOINED_BLOCKS),
            "sequence_id": pa.array((level << 56) + (number << 16) + bins, mask=~closed[bins]), "offset": _offsets(size, bins),
        })

    def choose(key: tuple, table: pa.Table) -> pa.Table:
        """The best island's packing."""
        ids, lengths, found = _populations(table)
        best = max(found, key=Packer(lengths, capacity, 0).fitness)
        return result(ids, np.array(lengths, dtype=np.int64), best, 0, key[0].as_py(), n_blocks == 1)

    def opened(level: int, last: bool) -> Callable[[tuple, pa.Table], pa.Table]:
        """Packs the open pieces of a group anew."""

        def again(key: tuple, table: pa.Table) -> pa.Table:
            ids, lengths = table.column("_row").to_numpy(), table.column("length").to_numpy()
            order = np.argsort(ids)
            ids, lengths = ids[order], lengths[order]
            best = Packer(lengths.tolist(), capacity, key[0].as_py()).evolve([], 2 * GENERATIONS)
            return result(ids, lengths, best, level, key[0].as_py(), last)

        return again

    levels = [written(state.groupBy("_block").applyInArrow(choose, placed), "packed")]
    n_groups = n_blocks
    while n_groups > 1:
        n_groups = -(-n_groups // JOINED_BLOCKS)
        rest = levels[-1].filter("sequence_id is null")
        levels.append(written(rest.groupBy("_group").applyInArrow(opened(len(levels), n_groups == 1), placed), "packed"))
    done = functools.reduce(DataFrame.unionByName, levels).filter("sequence_id is not null").select(F.col("_row").alias("_r"), "sequence_id", "offset")
    return held.join(done, F.col("_row") == F.col("_r")).drop("_row", "_r")
