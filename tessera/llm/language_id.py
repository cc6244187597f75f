"""Language identification by nearest clustered centroid.

Texts become TF-IDF vectors of hashed character 1- to 3-grams of unit length.
Each language has several centroids, from spherical k-means over a bounded
sample of its labelled texts, since one language holds several kinds of text. A
text gets the language of the centroid with the highest cosine. A text whose
cosine is under the language's own low quantile, less a margin, is marked as
rejected: it lies farther off than nearly all texts that the language was
learned from.

Document frequencies are counted over all labelled texts; the centroids come from
about ``per_language`` different texts of each language (a hash of the text picks
them, so the pick is the same wherever rows lie, and copies count once).
Prediction reads every character of every text.

Cases: a null text, or one without a letter, is ``und`` with score 0 and is
rejected. With nothing to learn from, every text is ``und``. Rows with a null
language teach nothing. Ties between centroids go to the language that sorts
first. Repeated rows are predicted alike. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
BUCKETS = 8192
#: Odd multipliers that spread the 2- and 3-grams over the buckets.
MIX1, MIX2, MIX3 = np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917)


@functools.cache
def _letters() -> np.ndarray:
    """For each code point, itself if it is a letter, else a space."""
    return np.array([c if chr(c).isalpha() else 32 for c in range(0x110000)], dtype=np.uint32)


def gram_counts(text: str | None) -> np.ndarray | None:
    """Counts of the hashed 1- to 3-grams over BUCKETS; None if there is no letter."""
    if not text:
        return None
    codes = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    gap = codes == 32
    keep = ~(gap[1:] & gap[:-1])
    codes = np.concatenate(([np.uint32(32)], codes[:1], codes[1:][keep], [np.uint32(32)])).astype(np.uint32)
    if (codes == 32).all():
        return None
    one = codes * MIX1
    two = (codes[:-1] * MIX2) ^ (codes[1:] * MIX1)
    three = (two[:-1] * MIX3) ^ (codes[2:] * MIX1)
    hashed = np.concatenate((one, two, three))
    hashed ^= hashed >> np.uint32(15)
    hashed *= MIX2
    return np.bincount(hashed >> np.uint32(32 - 13), minlength=BUCKETS)


def unit_vectors(texts: list[str | None], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit TF-IDF rows of the texts that have letters, and the places of those texts."""
    rows, places = [], []
    for i, text in enumerate(texts):
        counts = gram_counts(text)
        if counts is not None:
            x = np.sqrt(counts).astype(np.float32) * idf
            norm = np.sqrt(x @ x)
            rows.append(x / norm if norm else x)
            places.append(i)
    return (np.stack(rows) if rows else np.zeros((0, BUCKETS), np.float32)), np.array(places, dtype=np.int64)


@dataclass(frozen=True)
class LanguageModel:
    """Centroids (one row each), the language of each, and the least cosine that is accepted."""

    idf: np.ndarray
    centroids: np.ndarray
    languages: tuple[str, ...]
    floors: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cosine and whether rejected, for each text."""
        n = len(texts)
        names, score, cosine, rejected = [UNKNOWN] * n, np.zeros(n), np.zeros(n), np.ones(n, dtype=bool)
        labels = sorted(set(self.languages))
        of = np.array([labels.index(x) for x in self.languages], dtype=np.int64)
        for at in range(0, n if labels else 0, 256):
            x, places = unit_vectors(texts[at : at + 256], self.idf)
            if not len(places):
                continue
            sims = x @ self.centroids.T
            best = np.stack([sims[:, of == k].max(axis=1) for k in range(len(labels))], axis=1).astype(np.float64)
            pick = best.argmax(axis=1)
            top = best[np.arange(len(pick)), pick]
            spread = np.exp(20.0 * (best - top[:, None]))
            places = places + at
            score[places], cosine[places] = 1.0 / spread.sum(axis=1), top
            rejected[places] = top < self.floors[pick]
            for p, k in zip(places, pick, strict=True):
                names[p] = labels[k]
        return names, score, cosine, rejected


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """At most ``k`` unit centroids; starts are spread by farthest-first choice, so the result is the same each time."""
    centres = [x.mean(axis=0)]
    far = x @ centres[0]
    centres = [x[int(far.argmax())]]
    near = x @ centres[0]
    while len(centres) < min(k, len(x)) and near.min() < 0.999:
        centres.append(x[int(near.argmin())])
        near = np.maximum(near, x @ centres[-1])
    c = np.stack(centres)
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        sums = np.stack([x[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c


def fit_languages(
    labelled: DataFrame, text: str = "text", lang: str = "lang", per_language: int = 1500, clusters: int = 4,
    quantile: float = 0.01, margin: float = 0.05,
) -> LanguageModel:
    """Learn from the rows with text and language.

    ``per_language`` bounds the sample of different texts that each language's
    centroids come from; it is the only bound. The model that comes to the driver has ``clusters``
    rows a language.
    """
    spark = labelled.sparkSession
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).dropna()
    hashed = rows.withColumn("_hash", F.xxhash64("text"))
    sizes = hashed.groupBy(F.col("lang").alias("_lang")).agg((F.lit(float(per_language)) / F.approx_count_distinct("_hash", 0.02)).alias("_share"))
    picked = hashed.join(F.broadcast(sizes), F.col("lang") == F.col("_lang"))  # one row a language
    picked = picked.filter(F.pmod(F.xxhash64("_hash"), F.lit(1 << 20)) < F.col("_share") * (1 << 20))
    picked = picked.groupBy("lang", "_hash").agg(F.min("text").alias("text"))  # copies meet before the shuffle

    def document_frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(BUCKETS, dtype=np.int64), 0
        for batch in batches:
            for t in batch.column("text").to_pylist():
                counts = gram_counts(t)
                if counts is not None:
                    df += counts > 0
                    n += 1
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"bucket": np.append(used, -1), "df": np.append(df[used], n)})

    counted = rows.select("text").mapInArrow(document_frequency, "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df")).collect()
    df = np.zeros(BUCKETS)
    total = 0
    for bucket, count in counted:  # BUCKETS + 1 rows at most
        if bucket < 0:
            total = count
        else:
            df[bucket] = count
    idf = np.log((1.0 + total) / (1.0 + df)).astype(np.float32) + np.float32(0.1)

    def centroids(key: tuple[pa.Scalar], group: pa.Table) -> pa.Table:
        x, _ = unit_vectors(group.column("text").to_pylist(), idf)
        if not len(x):
            return pa.table({"lang": pa.array([], pa.string()), "centroid": pa.array([], pa.list_(pa.float32())), "floor": pa.array([], pa.float64())})
        c = spherical_kmeans(x, clusters)
        floor = float(np.quantile((x @ c.T).max(axis=1), quantile)) - margin
        return pa.table({"lang": [key[0].as_py()] * len(c), "centroid": pa.array(list(c), pa.list_(pa.float32())), "floor": [floor] * len(c)})

    fitted = picked.groupBy("lang").applyInArrow(centroids, "lang string, centroid array<float>, floor double").collect()
    fitted = sorted(fitted, key=lambda r: r.lang)
    languages = tuple(r.lang for r in fitted)
    floors = {r.lang: r.floor for r in fitted}
    c = np.array([r.centroid for r in fitted], dtype=np.float32).reshape(-1, BUCKETS)
    return LanguageModel(idf, c, languages, np.array([floors[x] for x in sorted(floors)]))


def identify_languages(docs: DataFrame, model: LanguageModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with lang_pred, score (0 to 1), cosine and rejected for every row of ``docs``."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # clusters x languages x BUCKETS floats
    source = docs.select(*keep, F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score, cosine, rejected = held.value.predict(batch.column("_text").to_pylist())
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            columns += [pa.array(names, pa.string()), pa.array(score), pa.array(cosine), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "lang_pred", "score", "cosine", "rejected"])

    return source.mapInArrow(predict, f"{schema}, lang_pred string, score double, cosine double, rejected boolean")
