"""Toxicity by compression distance.

Two zstandard dictionaries are built, one from toxic and one from ordinary text,
and every window of a text is compressed with both. A window that grows shorter
with the toxic dictionary, by at least ``LEAST_SAVING`` bytes, counts with the
bytes it saves; a text's evidence is the sum over its windows. The threshold on
the evidence is calibrated on labelled texts that the compared dictionary has
not seen (two folds, each scored with the other's dictionaries).

Before compression each word is replaced by the eight bytes of its hash, so that
the compressor matches whole words: syllables that toxic and ordinary words
share save nothing. The dictionaries have raw content that is chosen by document
frequency: words frequent in ordinary text come first in both; at the end, where
matches are cheap, stand the words that mark the class. Each window begins with
the same carrier, which both dictionaries hold, so that no block is stored raw.

Fitting reads at most ``per_class`` labelled texts of each class; prediction
reads whole texts.

Cases: a null or empty text has no window and gets the lowest score. With no
toxic label nothing is predicted toxic. A document labelled twice is toxic if
any label says so; null labels and ids teach nothing. Repeated rows are scored
alike. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_digest, xxh64_intdigest

WINDOW_WORDS = 32
LEAST_SAVING = 3
COMMON_WORDS, CLASS_WORDS = 500, 1500
#: The shares of toxic documents that a marking word must reach; calibration chooses one.
SHARES = (0.005, 0.01, 0.02, 0.04)
CARRIER = b"".join(xxh64_digest(b"carrier %d" % i) for i in range(6))
#: ASCII punctuation and white space become spaces.
_SPLIT = bytes(32 if c < 33 or (c < 128 and not chr(c).isalnum()) else c for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The lower-case words of a text, in UTF-8, without ASCII punctuation."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_SPLIT).split() if text else []


def _symbol(word_hash: int) -> bytes:
    return (word_hash & 0xFFFFFFFFFFFFFFFF).to_bytes(8, "big")


@dataclass(frozen=True)
class CompressionModel:
    """Dictionary contents of both classes and the least evidence that counts as toxic."""

    ordinary: bytes
    toxic: bytes
    threshold: float = 1.0

    def compressors(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        made = []
        for content in (self.ordinary, self.toxic):
            params = zstandard.ZstdCompressionParameters(
                window_log=17, hash_log=17, chain_log=17, search_log=4, min_match=6, target_length=16, strategy=zstandard.STRATEGY_GREEDY,
                write_content_size=False, write_checksum=False, write_dict_id=False,
            )
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            made.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params))
        return made[0], made[1]


def evidence(words: list[bytes], compressors: tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]) -> int:
    """Bytes that the toxic dictionary saves over the windows of one text."""
    if not words:
        return 0
    symbols = list(map(xxh64_digest, words))
    windows = [CARRIER + b"".join(symbols[i : i + WINDOW_WORDS]) for i in range(0, len(symbols), WINDOW_WORDS)]
    ends = np.cumsum([len(w) for w in windows])
    segments = np.column_stack((np.concatenate(([0], ends[:-1])), np.diff(ends, prepend=0))).astype("<u8")
    held = zstandard.BufferWithSegments(b"".join(windows), segments.tobytes())
    plain, toxic = (np.fromiter(map(len, c.multi_compress_to_buffer(held)), np.int64, len(windows)) for c in compressors)
    saved = plain - toxic
    return int(saved[saved >= LEAST_SAVING].sum())


def _contents(words: list[tuple[int, float, float]], n_toxic: int, n_ordinary: int, share: float) -> CompressionModel:
    """Dictionary contents from (word hash, toxic documents, ordinary documents) counts.

    A word marks the toxic class if a ``share`` of the toxic documents has it and
    ordinary ones hardly do.
    """
    n_toxic, n_ordinary = max(n_toxic, 1), max(n_ordinary, 1)
    least = max(2.0, share * n_toxic)
    marks = [w for w in words if w[1] >= least and w[2] / n_ordinary <= 0.02 * w[1] / n_toxic]
    marks = sorted(marks, key=lambda w: (-w[1], w[0]))[:CLASS_WORDS]
    chosen = {w[0] for w in marks}
    plain = sorted((w for w in words if w[0] not in chosen and w[2] > 0), key=lambda w: (-w[2], w[0]))
    common, rest = plain[:COMMON_WORDS], plain[COMMON_WORDS : COMMON_WORDS + len(marks)]
    shared = b"".join(_symbol(w[0]) for w in reversed(common))
    tail = b"".join(_symbol(w[0]) for w in reversed(marks))
    other = b"".join(_symbol(w[0]) for w in reversed(rest)).rjust(len(tail), b"\0")
    return CompressionModel(shared + other + CARRIER, shared + tail + CARRIER)


def _scored(rows: DataFrame, models: list[CompressionModel], keep: tuple[str, ...], text: str) -> DataFrame:
    """``keep`` and the evidence under the model numbered in column ``_model`` (0 if there is none)."""
    held = rows.sparkSession.sparkContext.broadcast(models)  # some 16 KB each
    which = F.col("_model") if "_model" in rows.columns else F.lit(0)
    source = rows.select(*keep, which.cast("int").alias("_model"), F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-2])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [m.compressors() for m in held.value]
        for batch in batches:
            found = [evidence(words_of(t), made[k]) for t, k in zip(batch.column("_text").to_pylist(), batch.column("_model").to_pylist(), strict=True)]
            columns = [batch.column(i) for i in range(batch.num_columns - 2)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.int64())], names=[*keep, "evidence"])

    return source.mapInArrow(score, f"{schema}, evidence long")


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 6000, most_words: int = 20000) -> CompressionModel:
    """Learn from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic).

    ``per_class`` bounds the labelled documents of each class that are read, and
    with them everything that comes to the driver; a hash of the id picks them.
    """
    marked = labels.select("doc_id", "toxic").dropna().groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    some = [marked.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    some = some[0].unionByName(some[1]).select(F.col("doc_id").alias("_id"), "y")
    half = F.pmod(F.xxhash64(F.col("text"), F.lit("fold")), F.lit(2)).cast("int")
    sample = docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("_id"))  # 2 x per_class rows
    sample = sample.dropna(subset=["text"]).select("y", half.alias("fold"), "text")

    def distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for y, fold, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                hashes = [xxh64_intdigest(w) for w in {*words_of(text)}]
                h = np.array([*hashes, 0], dtype=np.uint64).astype(np.int64)  # 0 stands for the document itself
                yield pa.RecordBatch.from_pydict({"word": h, "kind": np.full(len(h), 2 * fold + y, dtype=np.int32)})

    counted = sample.mapInArrow(distinct_words, "word long, kind int").groupBy("word").agg(
        *(F.sum(F.when(F.col("kind") == k, 1).otherwise(0)).alias(f"n{k}") for k in range(4))
    )
    toxic_first = F.when(F.col("word") == 0, 2).when(F.col("n1") + F.col("n3") >= 2, 1).otherwise(0)
    contrast = (F.col("n1") + F.col("n3") + 1.0) / (F.col("n0") + F.col("n2") + 1.0)
    top = counted.orderBy(toxic_first.desc(), contrast.desc(), "word").limit(most_words)
    usual = counted.orderBy((F.col("n0") + F.col("n2")).desc(), "word").limit(4 * COMMON_WORDS + CLASS_WORDS)
    rows = {r[0]: r[1:] for r in [*top.collect(), *usual.collect()]}
    sizes = rows.pop(0, (0, 0, 0, 0))

    def from_folds(folds: tuple[int, ...], share: float) -> CompressionModel:
        words = [(w, float(sum(n[2 * f + 1] for f in folds)), float(sum(n[2 * f] for f in folds))) for w, n in rows.items()]
        return _contents(words, sum(sizes[2 * f + 1] for f in folds), sum(sizes[2 * f] for f in folds), share)

    # Fold 0 is scored with what fold 1 teaches, and the other way round.
    other = [from_folds((1 - fold,), share) for share in SHARES for fold in (0, 1)]
    numbered = sample.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(len(SHARES) - 1)))).withColumn("_model", 2 * F.col("share") + F.col("fold"))
    tried = _scored(numbered, other, ("y", "share"), "text")
    spread = tried.groupBy("share", "y", F.least("evidence", F.lit(1000)).alias("e")).count().collect()
    best, threshold, chosen = -1.0, 1.0, SHARES[-1]
    for k, share in enumerate(SHARES):
        own = [(r.y, r.e, r["count"]) for r in spread if r.share == k]
        for t in sorted({e for _, e, _ in own if e > 0}):
            hit = sum(c for y, e, c in own if y == 1 and e >= t)
            wrong = sum(c for y, e, c in own if (y == 1) != (e >= t))
            if (f1 := 2 * hit / max(1, 2 * hit + wrong)) > best:
                best, threshold, chosen = f1, float(t), share
    final = from_folds((0, 1), chosen)
    return CompressionModel(final.ordinary, final.toxic, threshold)


def score_toxicity(docs: DataFrame, model: CompressionModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with evidence (bytes), score (0 to 1) and predicted (1 if score >= 0.5) for every row."""
    scale = max(1.0, model.threshold / 2)
    score = 1.0 / (1.0 + F.exp((F.lit(model.threshold - 0.5) - F.col("evidence")) / scale))
    return _scored(docs, [model], keep, text).withColumn("score", score).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
