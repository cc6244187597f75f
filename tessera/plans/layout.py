"""Queries over positioned text; the words of documents stand for text items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import layout
from tessera.plans.base import query, table

_WORDS = "regexp_split_to_array(trim(text), '[ \\n]+')"


@query(
    rf"""WITH w AS (SELECT doc_id, unnest({_WORDS}) AS word, generate_subscripts({_WORDS}, 1) - 1 AS i FROM documents WHERE trim(text) <> ''),
i AS (SELECT doc_id, i, i // 200 AS page, i % 200 // 10 AS h, CASE WHEN i % 41 = 40 THEN NULL ELSE (i * 7) % 10 END AS x, CASE WHEN i % 9 = 4 THEN word || '-' ELSE word END AS word FROM w),
l AS (SELECT doc_id, page, h // 2 AS line, trim(regexp_replace(string_agg(word, ' ' ORDER BY x, i), '\s+', ' ', 'g')) AS t FROM i WHERE x IS NOT NULL GROUP BY ALL),
r AS (SELECT doc_id, page, 0 AS kind, line AS nth, t FROM l UNION ALL SELECT doc_id, page, 1, i, word FROM i WHERE x IS NULL),
p AS (SELECT doc_id, page, string_agg(t, chr(10) ORDER BY kind, nth) AS t FROM r GROUP BY ALL)
SELECT doc_id AS document_id, page, length(s) AS n_chars, sha256(s) AS text_sha256 FROM (SELECT doc_id, page, regexp_replace(t, '-\n([a-z])', '\1', 'g') AS s FROM p)"""
)
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page of 200 words, read from words that stand ten a height, with heights 1.5 apart, so that two make a line."""
    docs = table(spark, sf_dir, "documents").filter("trim(text) <> ''").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split(F.trim("text"), "[ \n]+")).alias("position", "word"))
    at = F.col("position")
    items = docs.select(
        "document_id", F.floor(at / 200).alias("page"), at.alias("position"), F.when(at % 41 != 40, at * 7 % 10).alias("x"),
        (F.lit(700.0) - F.floor(at % 200 / 10) * F.lit(1.5)).alias("y"), F.when(at % 9 == 4, F.concat("word", F.lit("-"))).otherwise(F.col("word")).alias("text"),
    )
    made = layout.page_texts(items.select("document_id", "page").distinct(), items)
    return made.select("document_id", "page", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
