"""Document fingerprints by winnowing.

Every k-gram of characters gets a rolling hash; in every window of ``window``
consecutive k-grams the smallest hash is chosen, of equal ones the rightmost,
and kept with its position. Two texts that share a passage of at least
``k + window - 1`` characters share a chosen hash there (the match guarantee),
and texts that share nothing of k characters share none but by chance.

A text shorter than k has one gram, itself; one with fewer grams than a window
has one window.

Cases: a null text is empty; an empty text has no hash, and its likeness to
another empty text is 1, to any other 0. Positions count code points. Extra
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._hashing import Rolling
from tessera.llm._shared import written

GRAM, WINDOW = 16, 32
#: Low bits of a choice key that hold the position counted from the end, so that the rightmost tie is least.
PLACE_BITS = 26
_PLACES = (1 << PLACE_BITS) - 1


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """A mixed 64-bit hash of every k-gram of ``codes``; of the whole if it is shorter."""
    return Rolling(codes).everywhere(min(k, len(codes))) if len(codes) else np.zeros(0, dtype=np.uint64)


def winnow(text: str | None, k: int = GRAM, window: int = WINDOW, stretch: int = _PLACES) -> tuple[np.ndarray, np.ndarray]:
    """Chosen hashes (38 bits) and their positions, in order of position.

    The grams are worked through in stretches of ``stretch`` that overlap by a
    window less one, so a text may have any length.
    """
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    h = gram_hashes(codes, k)
    n = len(h)
    if not n:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    width = min(window, n)
    step = max(1, stretch - width + 1)
    parts = [_minima(h[at : at + step + width - 1], width, at) for at in range(0, n - width + 1, step)]
    hashes, places = (np.concatenate(x) for x in zip(*parts, strict=True))
    new = np.concatenate(([True], places[1:] != places[:-1]))
    return hashes[new], places[new]


def _minima(h: np.ndarray, width: int, offset: int) -> tuple[np.ndarray, np.ndarray]:
    """The rightmost least hash of every window, once each, and its position."""
    n = len(h)
    keys = (h >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.uint64(_PLACES) - np.arange(n, dtype=np.uint64)
    span, low = 1, keys
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: n - width + 1], low[width - span :])
    chosen = low[np.concatenate(([True], low[1:] != low[:-1]))]
    place = np.int64(_PLACES) - (chosen & np.uint64(_PLACES)).astype(np.int64)
    return chosen >> np.uint64(PLACE_BITS), place + offset


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of the sets of chosen hashes."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def digest(hashes: np.ndarray, places: np.ndarray) -> str:
    """The fingerprint as 32 hex digits: blake2b over the chosen hashes and positions."""
    return hashlib.blake2b(hashes.astype("<u8").tobytes() + places.astype("<i8").tobytes(), digest_size=16).hexdigest()


def document_fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), k: int = GRAM, window: int = WINDOW) -> DataFrame:
    """``keep`` columns, n_chars and the chosen ``hashes`` and ``places`` of every row."""
    source = docs.select(*keep, F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            found = [winnow(t, k, window) for t in texts]
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            columns += [
                pa.array([len(t or "") for t in texts], pa.int64()),
                pa.array([h.astype(np.int64) for h, _ in found], pa.list_(pa.int64())),
                pa.array([p for _, p in found], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "n_chars", "hashes", "places"])

    return source.mapInArrow(choose, f"{schema}, n_chars long, hashes array<long>, places array<long>")


class _Row:
    """A document in order, with its fingerprint."""

    def __init__(self, doc_id: int | None, text: str | None, k: int, window: int) -> None:
        self.doc_id, self.text = doc_id, text or ""
        self.hashes, self.places = winnow(self.text, k, window)

    def against(self, following: _Row, k: int, window: int) -> dict:
        """The result row of this document, whose next one is ``following``."""
        n = len(self.text)
        edited = self.text[: n - n // 2] + following.text[: n // 2]
        hashes, places = winnow(edited, k, window)
        return {
            "doc_id": self.doc_id, "n_chars": n,
            "edited_sha256": hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
            "fingerprint": digest(self.hashes, self.places), "edited_fingerprint": digest(hashes, places), "n_hashes": len(self.hashes),
            "near_edited": likeness(self.hashes, hashes), "near_next": likeness(self.hashes, following.hashes),
        }


_RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, n_hashes long, near_edited double, near_next double"
)


def compare_with_edits(docs: DataFrame, k: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Fingerprints of every document (doc_id, text) and of its edited text.

    The edited text has its last half replaced by the beginning of the next
    document in descending doc_id (null ids last, ties by a hash of the text, then
    by the text; after the last document comes the first). Documents are ranged
    once, by id and hash, and each range is walked in order. The first and the last
    document of each range are also written as they are, and these few rows close
    the gaps between ranges; only range numbers are put in one order.
    """
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    ordered = ordered.withColumn("_hash", F.xxhash64("text"))
    by = (F.col("doc_id").desc_nulls_last(), F.col("_hash"))  # no text: a sample of these comes to the driver
    ranged = ordered.repartitionByRange(*by).sortWithinPartitions(*by, F.col("text")).select("doc_id", "text")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Result rows, and as edge rows the first (edge 1), the last (edge 2) or the only (edge 3) document."""
        first = last = None
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                row = _Row(doc_id, text, k, window)
                if last is None:
                    first = row
                else:
                    out.append({**last.against(row, k, window), "edge": 0})
                last = row
            if out:
                yield _as_batch(out)
        if last is not None:
            part = TaskContext.get().partitionId()
            ends = [{"doc_id": first.doc_id, "text": first.text, "part": part, "edge": 3 if first is last else 1}]
            if first is not last:
                ends.append({"doc_id": last.doc_id, "text": last.text, "part": part, "edge": 2})
            yield _as_batch(ends)

    done = written(ranged.mapInArrow(walk, f"{_RESULT}, edge int, part int, text string"), "winnowed")
    names = [x.split()[0] for x in _RESULT.split(", ")]
    # Two rows a range at most. Range numbers alone are ordered, then the texts are looked up.
    starts = done.filter("edge in (1, 3)").select(F.col("part").alias("_at"), F.col("text").alias("_next"))
    ends = done.filter("edge in (2, 3)").select("part", "doc_id", "text")
    turn = done.filter("edge in (1, 3)").select("part", F.lead("part").over(Window.orderBy("part")).alias("_lead"), F.min("part").over(Window.partitionBy()).alias("_first"))
    turn = turn.select("part", F.coalesce("_lead", "_first").alias("_at"))
    joined = ends.join(turn, "part").join(starts, "_at")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
            out = [_Row(d, t, k, window).against(_Row(None, n, k, window), k, window) for d, t, n in rows]
            if out:
                yield _as_batch(out, edges=False)

    closed = joined.select("doc_id", "text", "_next").mapInArrow(close, _RESULT)
    return done.filter("edge = 0").select(*names).unionByName(closed)


def _as_batch(rows: list[dict], edges: bool = True) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "int": pa.int32()}
    fields = [x.split() for x in (_RESULT + (", edge int, part int, text string" if edges else "")).split(", ")]
    return pa.RecordBatch.from_pydict({n: pa.array([r.get(n) for r in rows], kinds[t]) for n, t in fields})
