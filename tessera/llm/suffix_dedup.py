"""Exact substring deduplication by blockwise suffix sorting with a difference cover.

A byte is removed if a string of ``LEAST`` = 50 bytes that covers it also starts
in a document with a smaller doc_id. That asks, of every suffix, whether its
first 50 bytes open an earlier document's suffix, so suffixes are sorted by these
bytes, one bucket at a time, and only as far as needed:

1. Documents are written once as chunks of some 4 MB, bucketed by chunk number,
   so that later passes join on the chunk number without moving texts again.
2. Cover ranks. The positions whose residue modulo 31 lies in a perfect
   difference cover (6 of 31) are sampled. For any two positions there is a shift
   under 31 that makes both sampled, so two equal 50-byte strings share an aligned
   sample whose next 20 bytes are equal. Samples are named by hash, the names of
   a chunk are sorted, and each bucket of names is sorted across chunks on its
   own; the chunk learns which of its ranks another document shares.
3. Suffix buckets. A suffix that no shared rank can reach within its first 50
   bytes is unique there and done with. Of the others, whole-document copies of
   an earlier document aside, the chunk sends the sorted 50-byte names, one of
   each with the smallest of its documents; each bucket is sorted on its own and
   answers for which names an earlier document exists.
4. Each chunk turns the answers into removed byte runs.

A name occurs once a chunk however often the chunk repeats it, so a passage that
a third of all documents share costs one entry a chunk, and no bucket can grow
hot. Ranks are 37 bits or more, and a false match there only keeps a suffix for
step 3; the names of step 3 have 64 bits, the one place where equal hashes are
taken for equal bytes.

Cases: a null text is empty; texts under 50 bytes lose nothing. Documents with
the same doc_id never remove bytes from each other; a null doc_id counts as the
largest. Empty chunks and an empty table give an empty result. Other columns pass
through untouched, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm._hashing import Rolling
from tessera.lineage import recorded
from tessera.llm._shared import shared_dir, written

LEAST, RANKED = 50, 20
#: A perfect difference cover modulo 31, and its modulus.
COVER, MODULUS = (1, 5, 11, 24, 25, 27), 31
CHUNK_BYTES = 1 << 22
BUCKET_ENTRIES = 1 << 22
RANK_BITS = 31
LAST_ID = np.iinfo(np.int64).max
_in_cover = np.isin(np.arange(MODULUS), COVER)


class Chunk:
    """The bytes of some documents one after the other, in order of doc_id."""

    def __init__(self, ids: bytes, ends: bytes, data: bytes) -> None:
        self.ids = np.frombuffer(ids, dtype="<i8")
        self.ends = np.frombuffer(ends, dtype="<i8")
        self.data = np.frombuffer(data, dtype=np.uint8)
        self.starts = np.concatenate((np.zeros(1, np.int64), self.ends[:-1]))
        self.document = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.ends - self.starts)
        self.rolling = Rolling(self.data)

    def ranked(self) -> tuple[np.ndarray, np.ndarray]:
        """The cover's positions, counted from each document's start, and their names."""
        lengths = self.ends - self.starts
        pattern = np.resize(_in_cover, int(lengths.max(initial=0)))
        sampled = np.zeros(len(self.data), dtype=bool)
        for a, n in zip(self.starts.tolist(), lengths.tolist(), strict=True):
            sampled[a : a + max(0, n - RANKED + 1)] = pattern[: max(0, n - RANKED + 1)]
        at = np.flatnonzero(sampled)
        return at, self.rolling.at(at, RANKED) >> np.uint64(1)

    def shared(self, told: list[dict] | None, rank_cut: np.uint64, shift: int) -> np.ndarray:
        """Sampled positions whose rank another document has: one of this chunk, or of another as ``told``."""
        at, names = self.ranked()
        if not len(at):
            return at
        order = np.argsort(names)
        names, at = names[order], at[order]
        cut = names >> rank_cut
        new = np.concatenate(([True], cut[1:] != cut[:-1]))
        bits = _bits(told, _bucket_sizes(cut[new], shift))
        starts = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1])))
        of = self.document[at]
        here = np.minimum.reduceat(of, starts) != np.maximum.reduceat(of, starts)
        return at[bits[np.cumsum(new) - 1] | np.repeat(here, np.diff(np.append(starts, len(at))))]

    def open_suffixes(self, shared: np.ndarray, skipped: list[int]) -> Suffixes:
        """The suffixes that a shared rank reaches within their first 50 bytes, sorted by the name of these.

        ``shared`` are sampled positions, ``skipped`` documents to leave out.
        """
        n = len(self.data)
        edge = np.bincount(np.maximum(shared + RANKED - LEAST, self.starts[self.document[shared]]), minlength=n + 1)
        edge -= np.bincount(shared + 1, minlength=n + 1)
        reached = np.cumsum(edge[:n]) > 0
        for a, b in zip(self.starts.tolist(), self.ends.tolist(), strict=True):
            reached[max(a, b - LEAST + 1) : b] = False
        for k in skipped:
            reached[self.starts[k] : self.ends[k]] = False
        at = np.flatnonzero(reached)
        del edge, reached
        names = self.rolling.at(at, LEAST)
        del self.rolling  # its last use; the rest of the work needs the room
        order = np.argsort(names)
        names, at = names[order], at[order]
        starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(at)), bool), names[1:] != names[:-1])))
        of = self.document[at]
        least = np.minimum.reduceat(of, starts) if len(at) else of
        return Suffixes(at, of, names[starts], least, np.diff(np.append(starts, len(at))))


@dataclass(frozen=True)
class Suffixes:
    """Suffixes sorted by name: positions, documents; the distinct names, the first document and the number of each."""

    at: np.ndarray
    document: np.ndarray
    names: np.ndarray
    least: np.ndarray
    sizes: np.ndarray


def _pack_sorted(values: np.ndarray) -> bytes:
    """Ascending integers as 2-, 3- or 8-byte steps; the first byte tells which."""
    steps = np.diff(values, prepend=np.uint64(0))
    top = int(steps.max()) if len(steps) else 0
    width = next(w for w in (2, 3, 4, 5, 6, 7, 8) if top < 1 << (8 * w))
    return bytes([width]) + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpack_sorted(data: bytes) -> np.ndarray:
    steps = np.frombuffer(data, dtype=np.uint8, offset=1).reshape(-1, data[0])
    wide = np.zeros((len(steps), 8), dtype=np.uint8)
    wide[:, : data[0]] = steps
    return np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64)


def chunked(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """Documents as written chunks: chunk, ids, ends, data, and the other columns as an Arrow stream."""
    spark = docs.sparkSession
    rest = [c for c in docs.columns if c != text]
    source = docs.select(F.col(doc_id).cast("long").alias("_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_bytes"), *rest)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            sizes = pa.compute.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
            start = 0
            for i, n in enumerate(sizes):
                size += int(n)
                if size >= CHUNK_BYTES:
                    held.append(batch.slice(start, i + 1 - start))
                    yield _chunk(held)
                    held, size, start = [], 0, i + 1
            if start < batch.num_rows:
                held.append(batch.slice(start))
        if held:
            yield _chunk(held)

    path = f"{shared_dir(spark)}/chunks-{uuid.uuid4().hex}"
    name = f"tessera_chunks_{uuid.uuid4().hex}"
    recorded(path, name)
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    chunks = source.mapInArrow(gather, "chunk long, ids binary, ends binary, data binary, rest binary")
    chunks.write.format("parquet").bucketBy(parts, "chunk").option("compression", "zstd").option("path", path).saveAsTable(name)
    return spark.table(name)


def _chunk(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One chunk row; its number is a hash of what it holds, so a task that runs again gives the same."""
    held = pa.Table.from_batches(batches).combine_chunks()
    ids = held.column(0).fill_null(LAST_ID).to_numpy()
    order = np.argsort(ids, kind="stable")
    held, ids = held.take(pa.array(order)), ids[order]
    texts = held.column(1).to_pylist()
    data = b"".join(texts)
    ends = np.cumsum([len(t) for t in texts]).astype("<i8")
    sink = pa.BufferOutputStream()
    rest = held.drop_columns(held.column_names[:2]) if held.num_columns > 2 else held.select([0])
    with pa.ipc.new_stream(sink, rest.schema) as out:
        out.write_table(rest)
    ids = ids.astype("<i8").tobytes()
    number = int.from_bytes(hashlib.blake2b(ids + ends.tobytes() + data, digest_size=8).digest(), "little", signed=True)
    return pa.RecordBatch.from_pydict({
        "chunk": pa.array([number], pa.int64()), "ids": pa.array([ids], pa.binary()), "ends": pa.array([ends.tobytes()], pa.binary()),
        "data": pa.array([data], pa.binary()), "rest": pa.array([sink.getvalue().to_pybytes()], pa.binary()),
    })


_CHUNK = ("chunk", "ids", "ends", "data")


def _answered(chunks: DataFrame, *answers: tuple[str, DataFrame | None]) -> DataFrame:
    """Chunks with what each answer table says of them; only the answers, which are small, are moved."""
    for name, answer in answers:
        if answer is not None:
            own = answer.withColumnRenamed("chunk", f"_{name}_chunk").hint("shuffle_hash")
            chunks = chunks.join(own, F.col("chunk") == F.col(f"_{name}_chunk"), "left").drop(f"_{name}_chunk")
    return chunks


def _per_chunk(rows: DataFrame, name: str) -> DataFrame:
    """All answers of a chunk in one row, by bucket; a chunk has at most one row a bucket."""
    return rows.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "bits"))).alias(name))


def _bits(answer: list[dict] | None, sizes: dict[int, int]) -> np.ndarray:
    """The answer's bits for the sorted names of a chunk."""
    given = {a["bucket"]: a["bits"] for a in answer or []}
    out = [np.unpackbits(np.frombuffer(given[b], np.uint8), count=n).astype(bool) if b in given else np.zeros(n, bool) for b, n in sorted(sizes.items())]
    return np.concatenate(out) if out else np.zeros(0, bool)


def _ask(chunk: int, names: np.ndarray, bits: int, shift: int, extra: Callable[[slice], bytes]) -> Iterator[tuple[int, int, bytes, bytes]]:
    """Sorted names by bucket (their first bits): chunk, bucket, the packed rest of the names, and what goes with them."""
    if not len(names):
        return
    bucket = (names >> np.uint64(shift)).astype(np.int64)
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    for a, b in zip(starts, np.append(starts[1:], len(names)), strict=True):
        yield chunk, int(bucket[a]), _pack_sorted(names[a:b] & np.uint64((1 << shift) - 1)), extra(slice(a, b))


def _bucket_sizes(names: np.ndarray, shift: int) -> dict[int, int]:
    bucket, n = np.unique(names >> np.uint64(shift), return_counts=True)
    return dict(zip(bucket.tolist(), n.tolist(), strict=True))


_QUESTION = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("names", pa.binary()), ("extra", pa.binary())])
_ANSWER = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("bits", pa.binary())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _met_ranks(table: pa.Table) -> pa.Table:
    """Of each chunk's ranks in one bucket, which another chunk has too."""
    lists = [_unpack_sorted(x) for x in table.column("names").to_pylist()]
    names = np.concatenate(lists)
    order = np.sort(names)
    met = np.unique(order[1:][order[1:] == order[:-1]])
    found = np.searchsorted(met, names)
    hit = met[np.minimum(found, len(met) - 1)] == names if len(met) else np.zeros(len(names), bool)
    parts = np.split(hit, np.cumsum([len(x) for x in lists])[:-1])
    return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "bits": pa.array([np.packbits(p).tobytes() for p in parts], pa.binary())})


def _earlier_suffixes(table: pa.Table) -> pa.Table:
    """Of each chunk's names in one bucket, which a document before the chunk's first has."""
    lists = [_unpack_sorted(x) for x in table.column("names").to_pylist()]
    owners = []
    for n, extra in zip(map(len, lists), table.column("extra").to_pylist(), strict=True):
        kind = np.dtype(f"<u{extra[0]}")
        place = np.frombuffer(extra, dtype=kind, count=n, offset=1)
        owners.append(np.frombuffer(extra, dtype="<i8", offset=1 + n * kind.itemsize)[place])
    names, ids = np.concatenate(lists), np.concatenate(owners)
    order = np.argsort(names)
    n, d = names[order], ids[order]
    starts = np.flatnonzero(np.concatenate(([True], n[1:] != n[:-1])))
    hit = np.empty(len(n), dtype=bool)
    hit[order] = d > np.repeat(np.minimum.reduceat(d, starts), np.diff(np.append(starts, len(n))))
    parts = np.split(hit, np.cumsum([len(x) for x in lists])[:-1])
    return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "bits": pa.array([np.packbits(p).tobytes() for p in parts], pa.binary())})


def removed_bytes(n: int, hit: np.ndarray) -> np.ndarray:
    """A mask of the ``n`` bytes that the first 50 bytes of the suffixes at ``hit`` cover."""
    edge = np.bincount(hit, minlength=n + 1) - np.bincount(hit + LEAST, minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", with_text: bool = False) -> DataFrame:
    """Every row of ``docs`` with its other columns, and as new columns

    ``_kept`` (binary, the bytes left), ``_n_bytes``, ``_spans`` (array of
    (start, length) of the removed runs), and if asked for ``_text``, the bytes
    left as a string without the parts of characters that were cut in two.
    """
    chunks = chunked(docs, text, doc_id)
    n_chunks = max(1, chunks.select("chunk").count())
    rank_shift = RANK_BITS
    # A chunk has some 0.8 million samples; a bucket should have BUCKET_ENTRIES of them.
    bits = max(6, math.ceil(math.log2(n_chunks * CHUNK_BYTES * len(COVER) / MODULUS / BUCKET_ENTRIES)))
    use_bits = min(bits, 24)
    rank_cut = np.uint64(63 - use_bits - rank_shift)
    suffix_shift = 64 - use_bits

    def ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, *held in zip(*(batch.column(c).to_pylist() for c in _CHUNK), strict=True):
                _, names = Chunk(*held).ranked()
                rows = list(_ask(number, np.unique(names >> rank_cut), use_bits, rank_shift, lambda _: b""))
                if rows:
                    yield _batch(rows, _QUESTION)

    question, answer = "chunk long, bucket long, names binary, extra binary", "chunk long, bucket long, bits binary"
    asked = chunks.select(*_CHUNK).mapInArrow(ranks, question)
    shared = written(_per_chunk(asked.groupBy("bucket").applyInArrow(_met_ranks, answer), "ranks"), "ranks")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, *held in zip(*(batch.column(c).to_pylist() for c in _CHUNK), strict=True):
                chunk, data = Chunk(*held), held[2]
                sha = [hashlib.sha256(data[a:b]).digest() for a, b in zip(chunk.starts, chunk.ends, strict=True)]
                n = len(sha)
                yield pa.RecordBatch.from_pydict({
                    "chunk": pa.array([number] * n, pa.int64()), "place": pa.array(range(n), pa.int32()), "id": pa.array(chunk.ids), "sha": pa.array(sha, pa.binary()),
                })

    listed = written(chunks.select(*_CHUNK).mapInArrow(documents, "chunk long, place int, id long, sha binary"), "listed")
    firsts = listed.groupBy("sha").agg(F.min("id").alias("first")).withColumnRenamed("sha", "_sha")
    copies = listed.join(firsts, F.col("sha") == F.col("_sha")).filter("id > first")
    copied = written(copies.groupBy("chunk").agg(F.sort_array(F.collect_list("place")).alias("copies")), "copies")

    def opened(held: list[bytes], told: list[dict] | None, copies: list[int] | None) -> tuple[Chunk, Suffixes]:
        """The chunk and its open suffixes, given the shared ranks."""
        chunk = Chunk(*held)
        return chunk, chunk.open_suffixes(chunk.shared(told, rank_cut, rank_shift), copies or [])

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, told, copies, *held in zip(*(batch.column(c).to_pylist() for c in ("chunk", "ranks", "copies", *_CHUNK[1:])), strict=True):
                chunk, found = opened(held, told, copies)

                def owner(part: slice, chunk: Chunk = chunk, found: Suffixes = found) -> bytes:
                    own, place = np.unique(found.least[part], return_inverse=True)
                    width = next(w for w in (1, 2, 4) if len(own) <= 1 << (8 * w))
                    return bytes([width]) + place.astype(f"<u{width}").tobytes() + chunk.ids[own].tobytes()

                rows = list(_ask(number, found.names, use_bits, suffix_shift, owner))
                if rows:
                    yield _batch(rows, _QUESTION)

    told = _answered(chunks, ("ranks", shared), ("copies", copied)).select(*_CHUNK, "ranks", "copies")
    asked = told.mapInArrow(suffixes, question)
    earlier = written(_per_chunk(asked.groupBy("bucket").applyInArrow(_earlier_suffixes, answer), "earlier"), "earlier")

    fields = [f for f in docs.schema.fields if f.name != text]
    extra = [T.StructField("_kept", T.BinaryType()), T.StructField("_n_bytes", T.LongType())]
    extra.append(T.StructField("_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]))))

    if with_text:
        extra.append(T.StructField("_text", T.StringType()))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names_in = ("chunk", "ranks", "copies", "earlier", "rest", *_CHUNK[1:])
        for batch in batches:
            for _, told, copies, answer, rest, *held in zip(*(batch.column(c).to_pylist() for c in names_in), strict=True):
                chunk, found = opened(held, told, copies)
                before = _bits(answer, _bucket_sizes(found.names, suffix_shift))
                here = chunk.ids[found.document] > np.repeat(chunk.ids[found.least], found.sizes)
                gone = removed_bytes(len(chunk.data), found.at[here | np.repeat(before, found.sizes)])
                for k in copies or []:
                    if chunk.ends[k] - chunk.starts[k] >= LEAST:
                        gone[chunk.starts[k] : chunk.ends[k]] = True
                kept, spans = [], []
                for a, b in zip(chunk.starts, chunk.ends, strict=True):
                    own = gone[a:b]
                    if not own.any():
                        kept.append(held[2][a:b])
                        spans.append([])
                        continue
                    turn = np.flatnonzero(np.diff(np.concatenate(([False], own, [False])).astype(np.int8)))
                    spans.append([{"start": int(s), "length": int(e - s)} for s, e in zip(turn[::2], turn[1::2], strict=True)])
                    kept.append(chunk.data[a:b][~own].tobytes())
                other = pa.ipc.open_stream(rest).read_all().combine_chunks()
                columns = [other.column(f.name).combine_chunks() if other.num_rows else other.column(f.name) for f in fields]
                columns += [
                    pa.array(kept, pa.binary()), pa.array(chunk.ends - chunk.starts),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))),
                ]
                if with_text:
                    columns.append(pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[*(f.name for f in fields), *(f.name for f in extra)])

    told = _answered(chunks, ("ranks", shared), ("copies", copied), ("earlier", earlier)).select(*_CHUNK, "rest", "ranks", "copies", "earlier")
    return told.mapInArrow(finish, T.StructType(fields + extra))
