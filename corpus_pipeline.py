"""The corpus pipeline: toxicity, near duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``. ``run`` writes each stage's result to the
shared folder and reads it again for the next one. A stage's result is to be
written before the next stage begins: that one removes what the stage before kept
in the shared folder, so that the pipeline never holds more than one stage's
tables.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.lineage import record, remove
from tessera.llm._shared import crc_bucket, table, written
from tessera.llm.decontamination import find_leaks
from tessera.llm.jaccard_dedup import surplus_rows
from tessera.llm.packing import pack, pieces_of
from tessera.llm.suffix_dedup import remove_repeats
from tessera.llm.toxicity import CompressionModel, fit_toxicity, score_toxicity


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: What the last stage of a session wrote, by application.
_LEFT: dict[str, list[tuple[str, str | None]]] = {}


def stage(fn: Stage) -> Stage:
    """The stage, which first removes the tables of the stage before, except what its documents are read from."""

    @functools.wraps(fn)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        left = _LEFT.pop(app, [])
        read = docs.inputFiles() if left else []
        used = [x for x in left if any(f.rsplit("/", 1)[0].endswith(x[0].rsplit("/", 1)[-1]) for f in read)]
        remove(spark, [x for x in left if x not in used])
        with record() as made:
            out = fn(spark, docs, sf_dir)
        _LEFT[app] = [*used, *made]
        return out

    return begun


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> CompressionModel:
    """Learned from four fifths of the labels."""
    labels = table(spark, sf_dir, "labels").filter(crc_bucket(F.col("doc_id"), 5) != 0)
    return fit_toxicity(docs, labels)


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic; learned from four fifths of the labels.

    Null and empty texts are not toxic, repeated rows are judged alike, columns may
    have any names, and no documents give none.
    """
    model = toxicity_model(spark, docs, sf_dir)
    plain, named = renamed(docs)
    scored = score_toxicity(plain, model, text=named["text"], keep=tuple(plain.columns))
    return scored.filter("predicted = 0").select(plain.columns).toDF(*docs.columns)


def renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns that no operator's own can be named like, and what each is called."""
    named = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*named.values()), named


def numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` renamed with ``_row``, an own key of every row, and ``_row``, doc_id and text alone; written, since the keys must not change between passes."""
    plain, named = renamed(docs)
    rows = written(plain.withColumn("_row", F.monotonically_increasing_id()), "rows")
    return rows, rows.select("_row", F.col(named["doc_id"]).alias("doc_id"), F.col(named["text"]).alias("text"))


def without(rows: DataFrame, gone: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` of ``numbered`` that are not ``gone``, under their names again."""
    return rows.join(gone, "_row", "left_anti").drop("_row").toDF(*columns)


@stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five-word Jaccard similarity of 0.8 or more): the one with the smallest doc_id.

    Null ids come last; of equal ids one row stays.
    """
    rows, texts = numbered(docs)
    return without(rows, surplus_rows(texts), docs.columns)


@stage
def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the 50-byte strings of earlier ones; characters that were cut in two go.

    A null text becomes empty; documents with one id, or repeated rows, leave each
    other alone; null ids come last; no documents give none.
    """
    plain, named = renamed(docs)
    left = remove_repeats(plain, named["text"], named["doc_id"], with_text=True)
    made = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return left.select(*(made.get(c, F.col(named[c])).alias(c) for c in docs.columns))


@stage
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item; decided row by row, so null and repeated ids are harmless.

    Null and empty texts leak nothing; no items or no documents lose nothing.
    """
    rows, texts = numbered(docs)
    leaks = find_leaks(texts, table(spark, sf_dir, "benchmark"), keep=("_row",)).select("_row").distinct()
    return without(rows, leaks, docs.columns)


@stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a training sequence.

    A null text is an empty document, repeated rows are packed one by one, and no documents give no pieces.
    """
    return pack(pieces_of(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_dedup", cut_repeated_passages),
    ("decontamination", drop_leaks),
    ("packing", pack_sequences),
]

#: SQL cannot express the stages; tests/llm/test_pipeline_stages.py holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, step in STAGES[:-1]:
        with record() as made:
            docs = written(step(spark, docs, sf_dir), f"stage-{name}")
        remove(spark, before)
        before = made
    return STAGES[-1][1](spark, docs, sf_dir)
