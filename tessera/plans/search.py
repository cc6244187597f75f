"""Search queries: keyword, vector, hybrid, lexical, reranked.

Documents stand in for chunks (doc_id as chunk, source as bundle, lang as type)
and embeddings for their vectors (vec_id is the doc_id).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import excerpt
from tessera.operators import retrieval
from tessera.plans.base import query, table

QUESTION = "What is the ation of onble with ering"
TERMS_SQL = "['ation', 'onble', 'ering']"
LEXICAL_QUESTION = "the and of nd st for er"

KEYWORD_SQL = f"""
kw_found AS (
  SELECT doc_id, text, list_sum(list_transform({TERMS_SQL}, lambda x: CASE WHEN contains(lower(text), x) THEN 1 ELSE 0 END)) / 3.0::DOUBLE AS score
  FROM documents
), kw_first AS (
  SELECT * FROM kw_found WHERE score > 0 ORDER BY doc_id LIMIT 2000
), kw AS (
  SELECT doc_id, text, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM kw_first
  QUALIFY rank <= 10
)"""
VECTOR_SQL = """
vq AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id = 0),
vec AS (
  SELECT vec_id AS doc_id, round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 6) AS score,
         row_number() OVER (ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 6) DESC, vec_id) AS rank
  FROM embeddings, vq QUALIFY rank <= 10
)"""
COLLAPSE_SQL = "trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r\\x{00A0}]+', ' ', 'g'))"


def _keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.keyword_search(table(spark, sf_dir, "documents").select("doc_id", "text"), QUESTION, ["doc_id"])


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.filter("vec_id = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return retrieval.vector_search(vectors, asked, "query_id", "q", "embedding", "vec_id")


@query(
    f"""WITH {KEYWORD_SQL}
SELECT doc_id, score, CAST(rank AS INTEGER) AS rank,
       CASE WHEN length(c) > 240 THEN rtrim(c[1:237]) || '...' ELSE c END AS excerpt
FROM (SELECT *, {COLLAPSE_SQL} AS c FROM kw)"""
)
def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 10 documents by the share of query terms, with excerpts."""
    found = _keyword(spark, sf_dir)
    return found.select("doc_id", "score", "rank", excerpt(F.col("text"), 240).alias("excerpt"))


@query(f"WITH {VECTOR_SQL} SELECT doc_id AS vec_id, score, CAST(rank AS INTEGER) AS rank FROM vec")
def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 10 vectors by cosine to vector 0."""
    return _vectors(spark, sf_dir).select("vec_id", "score", "rank")


@query(
    f"""WITH {KEYWORD_SQL}, {VECTOR_SQL}, b AS (
  SELECT doc_id, rank, score FROM kw UNION ALL SELECT doc_id, rank, score FROM vec
), f AS (
  SELECT doc_id, sum(1.0::DOUBLE / (60.0::DOUBLE + rank)) AS rrf, max(score) AS score, count(*) AS n_lists FROM b GROUP BY doc_id
)
SELECT doc_id, round(rrf, 6) AS rrf, round(score, 6) AS score, n_lists,
       CAST(row_number() OVER (ORDER BY rrf DESC, doc_id) AS INTEGER) AS rank
FROM f QUALIFY rank <= 10"""
)
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword and vector results fused by reciprocal rank."""
    vectors = _vectors(spark, sf_dir).withColumnRenamed("vec_id", "doc_id")
    return retrieval.hybrid_merge(_keyword(spark, sf_dir), vectors, "doc_id")


@query(
    """WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0)
SELECT query_id, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 6) AS score,
       CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 6) DESC, vec_id) AS INTEGER) AS rank
FROM embeddings, q QUALIFY rank <= 5"""
)
def batch_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 5 of all vectors for each stated query vector (ids divisible by 100)."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return retrieval.vector_search(vectors, asked, "query_id", "q", "embedding", "vec_id", k=5)


@query(
    f"""WITH life AS (
  SELECT doc_id, CASE WHEN max(toxic) = 1 THEN 'retracted' ELSE 'active' END AS status FROM labels GROUP BY doc_id
), q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)
SELECT e.vec_id, d.source, round(list_cosine_similarity(e.embedding::DOUBLE[], q.q::DOUBLE[]), 6) AS score,
       CAST(row_number() OVER (ORDER BY round(list_cosine_similarity(e.embedding::DOUBLE[], q.q::DOUBLE[]), 6) DESC, e.vec_id) AS INTEGER) AS rank
FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id LEFT JOIN life l ON l.doc_id = d.doc_id, q
WHERE coalesce(l.status, 'active') = 'active' AND d.lang IN ('en', 'de')
QUALIFY rank <= 10"""
)
def vector_filtered_by_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector search over active documents in two languages; no lifecycle row means active."""
    status = F.when(F.max("toxic") == 1, "retracted").otherwise("active")
    life = table(spark, sf_dir, "labels").groupBy("doc_id").agg(status.alias("status"))
    docs = retrieval.retrieval_filter(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), lang=["en", "de", " "])
    docs = docs.join(life, "doc_id", "left").filter(F.coalesce("status", F.lit("active")) == "active")
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.filter("vec_id = 0").select(F.lit(0).alias("query_id"), F.col("embedding").alias("q"))
    kept = vectors.join(docs.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    found = retrieval.vector_search(kept, asked, "query_id", "q", "embedding", "vec_id")
    return found.join(docs.select(F.col("doc_id").alias("vec_id"), "source"), "vec_id").select("vec_id", "source", "score", "rank")


_TOK = "list_filter(string_split_regex(lower(coalesce({0}, '')), '[^a-z0-9]+'), lambda x: length(x) >= 2)"
_PHRASE = "contains(' ' || array_to_string({0}, ' ') || ' ', ' ' || array_to_string(q, ' ') || ' ')"


@query(
    f"""WITH c AS (
  SELECT doc_id, {_TOK.format("split_part(text, chr(10), 1)")} AS t, {_TOK.format("split_part(text, chr(10), 2)")} AS d,
         {_TOK.format("source || ' ' || lang")} AS m, {_TOK.format("text")} AS b, ['nd', 'st', 'er'] AS q
  FROM documents
), s AS (
  SELECT doc_id, q, {_PHRASE.format("t")} AS pt, {_PHRASE.format("d")} AS pd, {_PHRASE.format("m")} AS pm, {_PHRASE.format("b")} AS pb,
         list_filter(q, lambda x: list_contains(t, x)) AS mt, list_filter(q, lambda x: list_contains(d, x)) AS md,
         list_filter(q, lambda x: list_contains(m, x)) AS mm, list_filter(q, lambda x: list_contains(b, x)) AS mb
  FROM c
), r AS (
  SELECT doc_id, CAST((CASE WHEN pt THEN 100 ELSE 0 END) + (CASE WHEN pd THEN 50 ELSE 0 END) + (CASE WHEN pm THEN 30 ELSE 0 END)
           + (CASE WHEN pb THEN 10 ELSE 0 END) + 20 * len(mt) + 8 * len(md) + 5 * len(mm) + len(mb) AS INTEGER) AS score,
         (pt OR pd OR pm) AS exact, len(list_distinct(list_concat(list_concat(mt, md), mm))) AS named, len(mt) AS nt
  FROM s
)
SELECT doc_id, score, ((exact OR named >= 2) AND score >= 8) AS qualifies, CASE WHEN exact OR nt >= 2 THEN 'strong' ELSE 'medium' END AS strength
FROM r"""
)
def lexical_field_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted field score of every document: first line as title, second as description."""
    lines = F.split("text", "\n")
    concepts = table(spark, sf_dir, "documents").select(
        "doc_id", F.element_at(lines, 1).alias("title"), F.get(lines, 1).alias("description"),
        F.concat_ws(" ", "source", "lang").alias("metadata"), F.col("text").alias("body"),
    )
    return retrieval.lexical_scores(concepts, LEXICAL_QUESTION).select("doc_id", "score", "qualifies", "strength")


@query(
    f"""WITH {VECTOR_SQL}, l AS (SELECT doc_id, max(quality) * 2 + 1 AS relevance FROM labels GROUP BY doc_id),
r AS (SELECT v.doc_id, v.rank, coalesce(l.relevance, 0) AS relevance FROM vec v LEFT JOIN l ON l.doc_id = v.doc_id)
SELECT doc_id, CAST(relevance AS INTEGER) AS relevance, CAST(row_number() OVER (ORDER BY relevance DESC, rank) AS INTEGER) AS new_rank
FROM r WHERE relevance > 0 QUALIFY new_rank <= 6"""
)
def rerank_by_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector results reordered by a relevance table that covers them all."""
    results = _vectors(spark, sf_dir).select(F.lit(0).alias("query_id"), F.col("vec_id").alias("doc_id"), "rank")
    given = table(spark, sf_dir, "labels").groupBy("doc_id").agg((F.max("quality") * 2 + 1).alias("given"))
    scores = results.select("query_id", "doc_id").join(given, "doc_id", "left").select("query_id", "doc_id", F.coalesce("given", F.lit(0)).alias("relevance"))
    return retrieval.rerank(results, scores, "doc_id").select("doc_id", F.col("relevance").cast("int").alias("relevance"), "new_rank")


@query(
    """WITH q AS (SELECT vec_id AS query_id, label, embedding AS q FROM embeddings WHERE vec_id % 100 = 0), r AS (
  SELECT query_id, q.label AS query_label, e.label, row_number() OVER (PARTITION BY query_id
           ORDER BY round(list_cosine_similarity(e.embedding::DOUBLE[], q::DOUBLE[]), 6) DESC, e.vec_id) AS rank
  FROM embeddings e, q WHERE e.vec_id <> query_id QUALIFY rank <= 5
), h AS (SELECT query_id, count(*) FILTER (label = query_label) AS n_correct FROM r GROUP BY query_id)
SELECT count(*) FILTER (n_correct > 0) AS n_hits, CAST(sum(n_correct) AS BIGINT) AS n_correct, count(*) AS n_queries,
       CAST(sum(n_correct) AS BIGINT) - 17 AS delta FROM h"""
)
def hit_rate_vs_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits and correct results of the stated vector queries against a baseline of 17."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    found = retrieval.vector_search(vectors, asked, "query_id", "q", "embedding", "vec_id", k=6).filter("vec_id <> query_id")
    order = F.row_number().over(retrieval.Window.partitionBy("query_id").orderBy("rank"))
    found = found.withColumn("at", order).filter("at <= 5")
    labels = vectors.select("vec_id", "label")
    own = labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label"))
    joined = found.join(labels, "vec_id").join(own, "query_id")
    per = joined.groupBy("query_id").agg(F.count_if(F.col("label") == F.col("query_label")).alias("n"))
    n = F.sum("n")
    return per.agg(F.count_if(F.col("n") > 0).alias("n_hits"), n.alias("n_correct"), F.count(F.lit(1)).alias("n_queries"), (n - 17).alias("delta"))
